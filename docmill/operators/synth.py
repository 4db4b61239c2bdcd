"""Synthetic records that are valid by construction, from a seed, as expressions over ``range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import ID_CARD, PAYSLIP, RESIDENCE, TAX
from ..functions.amounts import german_amount
from ..functions.identifiers import check_digit, iban_remainder

FIRST = ["Anna", "Ben", "Clara", "David", "Elif", "Finn", "Greta", "Hannes", "Ida", "Jonas"]
LAST = ["Albrecht", "Bauer", "Celik", "Dietrich", "Engel", "Fuchs", "Graf", "Hoffmann", "Ivanov", "Jung"]
STREETS = ["Hauptstraße", "Am See", "Bahnhofstraße", "Lindenweg", "Gartenstraße", "Schulweg"]
CITIES = ["Berlin", "Hamburg", "Köln", "Leipzig", "Bremen", "Dresden"]
FIRMS = ["Nordbau GmbH", "Weber AG", "Sonnenhof KG", "Elbtal Logistik GmbH"]
OFFICES = ["Stadt Berlin", "Stadt Bremen", "Landkreis Harz"]


def draw(seed: Column, name: str, n: int) -> Column:
    """A number under n from a seed and a name."""
    return F.pmod(F.xxhash64(seed, F.lit(name)), F.lit(n)).cast("int")


def pick(seed: Column, name: str, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), draw(seed, name, len(values)) + 1)


def tax_id(seed: Column, name: str = "tax") -> Column:
    """Nine of the ten digits in a shuffled order, one of them twice, no leading 0, and the check digit."""
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.struct(F.xxhash64(seed, F.lit(name), d).alias("h"), d.alias("d")))), lambda x: x["d"].cast("string"))
    at = draw(seed, name + "-twice", 9)

    # The digit drawn first is left out; if the next is 0 it changes places with the one after it.
    def ten(o: Column) -> Column:
        nine = F.when(F.get(o, F.lit(1)) == "0", F.concat(F.slice(o, 3, 1), F.slice(o, 2, 1), F.slice(o, 4, 7))).otherwise(F.slice(o, 2, 9))
        return F.array_join(F.concat(nine, F.slice(nine, at + 1, 1)), "")

    payload = F.transform(F.array(order), ten)  # arrays of one bind what is used more than once
    return F.transform(payload, lambda p: F.concat(p, check_digit(p).cast("string")))[0]


def iban(seed: Column, name: str = "iban") -> Column:
    """A German account number with its check digits."""
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(18)), lambda i: F.pmod(F.xxhash64(seed, F.lit(name), i), F.lit(10)).cast("string")), "")
    whole = lambda b: F.concat(F.lit("DE"), F.lpad((F.lit(98) - iban_remainder(F.concat(F.lit("DE00"), b))).cast("string"), 2, "0"), b)
    return F.transform(F.array(body), whole)[0]


def document_number(seed: Column, name: str = "doc") -> Column:
    alphabet = "CFGHJKLMNPRTVWXYZ0123456789"
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substr(F.lit(alphabet), F.pmod(F.xxhash64(seed, F.lit(name), i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))), "")


def postal_code(seed: Column, name: str = "plz") -> Column:
    """Five digits that do not begin with 00."""
    return F.lpad((draw(seed, name, 98_999) + 1_000).cast("string"), 5, "0")


def date_text(seed: Column, name: str, first: int, last: int) -> Column:
    """A day from 1 to 28 of any month."""
    return F.concat_ws(".", F.lpad((draw(seed, name + "d", 28) + 1).cast("string"), 2, "0"), F.lpad((draw(seed, name + "m", 12) + 1).cast("string"), 2, "0"), (draw(seed, name + "y", last - first + 1) + first).cast("string"))


def amount_text(seed: Column, name: str, low: int, high: int) -> Column:
    return german_amount(draw(seed, name, (high - low) * 100) / 100.0 + low)


def records(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(doc_id, document_type, fields): n records, the four types in turn. Row i depends on the seed and i only."""
    rows = spark.range(n).withColumn("s", F.xxhash64(F.lit(seed), F.col("id")))
    s = F.col("s")
    person = {"familienname": pick(s, "last", LAST), "vorname": pick(s, "first", FIRST), "geburtsdatum": date_text(s, "born", 1950, 2004), "geburtsort": pick(s, "place", CITIES), "staatsangehoerigkeit": F.lit("deutsch")}
    gross = draw(s, "gross", 600_000) / 100.0 + 2_000
    kinds = {
        RESIDENCE: person | {"strasse": pick(s, "street", STREETS), "hausnummer": (draw(s, "house", 180) + 1).cast("string"), "postleitzahl": postal_code(s), "wohnort": pick(s, "city", CITIES), "einzugsdatum": date_text(s, "moved", 2010, 2023)},
        TAX: {"steueridentifikationsnummer": tax_id(s), "veranlagungszeitraum": (draw(s, "year", 8) + 2016).cast("string"), "zu_versteuerndes_einkommen": amount_text(s, "income", 15_000, 95_000), "festgesetzte_steuer": amount_text(s, "due", 1_000, 25_000)},
        PAYSLIP: {"arbeitgeber": pick(s, "firm", FIRMS), "brutto_lohn": german_amount(gross), "netto_lohn": german_amount(F.round(gross * 0.62, 2)), "abrechnungszeitraum": F.concat_ws(".", F.lpad((draw(s, "month", 12) + 1).cast("string"), 2, "0"), (draw(s, "year", 8) + 2016).cast("string")), "steuerklasse": pick(s, "class", ["I", "II", "III", "IV", "V", "VI"]), "steueridentifikationsnummer": tax_id(s)},
        ID_CARD: person | {"dokumentnummer": document_number(s), "gueltig_bis": date_text(s, "until", 2030, 2038), "ausstellende_behoerde": pick(s, "office", OFFICES)},
    }
    turn = (F.col("id") % len(kinds)).cast("int")
    kind, fields = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for i, (k, f) in enumerate(kinds.items()):
        kind = F.when(turn == i, k).otherwise(kind)
        fields = F.when(turn == i, F.create_map(*[x for name, v in f.items() for x in (F.lit(name), v)])).otherwise(fields)
    return rows.select(F.col("id").alias("doc_id"), kind.alias("document_type"), fields.alias("fields"))
