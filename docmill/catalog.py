"""Fixed values of the engine: document types, fields, dictionaries, patterns, thresholds, and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: they must equal those of the forms' specification for right results -----------------------------------

RESIDENCE, TAX, PAYSLIP, ID_CARD, UNKNOWN = "Meldebescheinigung", "Steuerbescheid", "Gehaltsausweis", "Personalausweis", "Unbekannt"

#: Document type, field, label synonyms; order decides ties.
LABELS: dict[str, dict[str, list[str]]] = {
    RESIDENCE: {
        "familienname": ["familienname", "nachname", "name"],
        "vorname": ["vorname", "vornamen", "rufname"],
        "geburtsdatum": ["geburtsdatum", "geborenam", "gebam", "geburtstag"],
        "geburtsort": ["geburtsort", "geboreninin", "geborenin"],
        "staatsangehoerigkeit": ["staatsangehoerigkeit", "staatsangehörigkeit", "nationalitaet", "nationalität"],
        "strasse": ["strasse", "straße", "anschriftstrasse", "wohnungsanschrift"],
        "hausnummer": ["hausnummer", "hausnr", "nr"],
        "postleitzahl": ["postleitzahl", "plz"],
        "wohnort": ["wohnort", "ort", "stadt", "gemeinde", "wohnortstadt"],
        "einzugsdatum": ["einzugsdatum", "einzug", "eingezogenam", "zuzugsdatum", "zuzug"],
        "vorherige_anschrift": ["vorherigeanschrift", "vorigeanschrift", "fruehereanschrift", "letzteanschrift"],
    },
    TAX: {
        "steueridentifikationsnummer": ["steueridentifikationsnummer", "steuerid", "idnr", "identifikationsnummer", "steuernummer"],
        "veranlagungszeitraum": ["veranlagungszeitraum", "veranlagung", "zeitraum", "steuerjahr", "jahr"],
        "zu_versteuerndes_einkommen": ["zuversteuerndeseinkommen", "zveinkommen", "versteuerndeseinkommen", "einkommen"],
        "festgesetzte_steuer": ["festgesetztesteuer", "festgesetzteeinkommensteuer", "festgesetzt", "einkommensteuer"],
        "ermässigung": ["ermaessigung", "ermäßigung", "steuerermaessigung"],
        "vorauszahlungen": ["vorauszahlungen", "vorauszahlung", "geleistetevorauszahlungen"],
        "kirchensteuer": ["kirchensteuer", "kist"],
        "solidaritätszuschlag": ["solidaritaetszuschlag", "solidaritätszuschlag", "soli", "solz"],
    },
    PAYSLIP: {
        "arbeitgeber": ["arbeitgeber", "firma", "unternehmen", "ag"],
        "brutto_lohn": ["bruttolohn", "bruttogehalt", "brutto", "gesamtbrutto", "bruttobezuege"],
        "netto_lohn": ["nettolohn", "nettogehalt", "netto", "auszahlungsbetrag", "nettoverdienst"],
        "abrechnungszeitraum": ["abrechnungszeitraum", "abrechnungsmonat", "lohnzeitraum", "zeitraum", "monat"],
        "steuerklasse": ["steuerklasse", "stkl", "lohnsteuerklasse", "klasse"],
        "steueridentifikationsnummer": ["steueridentifikationsnummer", "steuerid", "idnr", "identifikationsnummer"],
        "sozialversicherungsnummer": ["sozialversicherungsnummer", "svnummer", "rentenversicherungsnummer", "svnr"],
        "rentenversicherung": ["rentenversicherung", "rv"],
        "krankenversicherung": ["krankenversicherung", "kv"],
        "arbeitslosenversicherung": ["arbeitslosenversicherung", "av"],
        "pflegeversicherung": ["pflegeversicherung", "pv"],
    },
    ID_CARD: {
        "dokumentnummer": ["dokumentnummer", "ausweisnummer", "documentno", "dokumentnr", "cardno"],
        "familienname": ["familienname", "name", "surname", "nachname"],
        "vorname": ["vorname", "vornamen", "givenname", "givennames"],
        "geburtsdatum": ["geburtsdatum", "dateofbirth", "geborenam", "dob"],
        "geburtsort": ["geburtsort", "placeofbirth", "geborenin"],
        "staatsangehoerigkeit": ["staatsangehoerigkeit", "staatsangehörigkeit", "nationality", "nationalitaet"],
        "gueltig_bis": ["gueltigbis", "gültigbis", "dateofexpiry", "expiry", "validuntil"],
        "ausstellungsdatum": ["ausstellungsdatum", "dateofissue", "ausgestelltam"],
        "ausstellende_behoerde": ["ausstellendebehoerde", "ausstellendebehörde", "authority", "behoerde", "behörde"],
    },
}

AMOUNT_FIELDS = [
    "zu_versteuerndes_einkommen", "festgesetzte_steuer", "ermässigung", "vorauszahlungen", "kirchensteuer", "solidaritätszuschlag",
    "brutto_lohn", "netto_lohn", "rentenversicherung", "krankenversicherung", "arbeitslosenversicherung", "pflegeversicherung",
]
DATE_FIELDS = ["geburtsdatum", "gueltig_bis", "ausstellungsdatum", "einzugsdatum"]

#: Words that tell a document's type from its text.
TYPE_KEYWORDS: dict[str, list[str]] = {
    RESIDENCE: ["meldebescheinigung", "meldebehörde", "meldeamt", "bürgeramt", "einzugsdatum"],
    TAX: ["steuerbescheid", "finanzamt", "steueridentifikationsnummer", "einkommensteuer", "veranlagungszeitraum"],
    PAYSLIP: ["gehaltsausweis", "lohnabrechnung", "gehaltsabrechnung", "nettolohn", "gesamt-brutto", "sozialversicherung"],
    ID_CARD: ["personalausweis", "bundesrepublik deutschland", "dokumentnummer", "gültig bis", "ausweisnummer"],
}

#: The set used on a quick preview of the page.
PREVIEW_KEYWORDS: dict[str, list[str]] = {
    RESIDENCE: ["meldebescheinigung", "meldeamt", "meldebehörde", "einzugsdatum", "auszugsdatum", "familienstand", "bürgeramt"],
    TAX: ["steuerbescheid", "finanzamt", "steueridentifikationsnummer", "einkommensteuer", "veranlagungszeitraum"],
    PAYSLIP: ["gehaltsausweis", "lohnabrechnung", "brutto", "nettolohn", "arbeitgeber", "sozialversicherung"],
    ID_CARD: ["personalausweis", "reisepass", "dokumentnummer", "gültig bis", "ausweisnummer"],
}

#: Field and the pattern that its whole value must match.
PATTERNS: dict[str, str] = {
    "familienname": r"[A-Za-zÄÖÜäöüß\-\s']{2,100}",
    "vorname": r"[A-Za-zÄÖÜäöüß\-\s']{2,100}",
    "geburtsort": r"[A-Za-zÄÖÜäöüß\-\s().]{2,100}",
    "staatsangehoerigkeit": r"[A-Za-zÄÖÜäöüß\-\s]{2,100}",
    "strasse": r"[A-Za-zÄÖÜäöüß0-9\-\s./]{2,100}",
    "hausnummer": r"[0-9]{1,4}[a-zA-Z]?",
    "postleitzahl": r"\d{5}",
    "wohnort": r"[A-Za-zÄÖÜäöüß\-\s]{2,100}",
    "vorherige_anschrift": r"[A-Za-zÄÖÜäöüß0-9\-\s.,/]{5,200}",
    "steueridentifikationsnummer": r"\d{11}",
    "dokumentnummer": r"[A-Z0-9]{9}",
    "veranlagungszeitraum": r"\d{4}",
    "abrechnungszeitraum": r"(0[1-9]|1[0-2])\.\d{4}",
    "steuerklasse": r"(I|II|III|IV|V|VI)",
    "sozialversicherungsnummer": r"\d{12}",
    "arbeitgeber": r"[A-Za-zÄÖÜäöüß0-9\-\s&.,()]{2,200}",
    "ausstellende_behoerde": r"[A-Za-zÄÖÜäöüß0-9\-\s.,()]{2,200}",
}

IBAN_LENGTHS = {"DE": 22, "AT": 20, "CH": 21, "NL": 18, "BE": 16, "FR": 27, "IT": 27, "ES": 24}

#: Accepted content types; those of files without one, by extension; and the first bytes of binary types (hexadecimal).
CONTENT_TYPES = [
    "image/png", "image/jpeg", "image/jpg", "image/tiff", "image/bmp", "application/pdf", "text/plain", "text/csv", "text/tab-separated-values",
    "text/markdown", "text/html", "application/json", "application/xml", "text/xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
]
EXTENSIONS = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tiff": "image/tiff", ".tif": "image/tiff", ".bmp": "image/bmp",
    ".pdf": "application/pdf", ".txt": "text/plain", ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".md": "text/markdown",
    ".json": "application/json", ".xml": "application/xml", ".html": "text/html", ".htm": "text/html",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
MAGIC = {
    "image/png": ["89504E470D0A1A0A"],
    "image/jpeg": ["FFD8FF"],
    "image/jpg": ["FFD8FF"],
    "image/tiff": ["49492A00", "4D4D002A"],
    "image/bmp": ["424D"],
    "application/pdf": ["25504446"],
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ["504B0304", "504B0506", "504B0708"],
}
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"]
MAX_FILE_BYTES = 52_428_800

STATUSES = ["EXTRACTED", "UNRESOLVED", "LOW_CONFIDENCE", "VALIDATION_FAILURE", "CORRECTED"]
REVIEW_STATUSES = ["UNRESOLVED", "VALIDATION_FAILURE", "LOW_CONFIDENCE"]
RESOLVED_STATUSES = ["EXTRACTED", "CORRECTED"]
NULLISH = ["", "null", "None"]

# Thresholds and weights.
ADMIT, DEGRADED = 0.70, 0.20
LOW_CONFIDENCE = 0.70
SHARP_WEIGHT, CONTRAST_WEIGHT, SIZE_WEIGHT, MIN_SIDE = 0.40, 0.35, 0.25, 600
SOURCE_FACTORS = {"inline": 1.0, "spatial-right": 0.90, "spatial-below": 0.82, "pattern": 0.72, "card-surname": 0.85}
DEFAULT_CONFIDENCE = 0.85
SAME_ROW, BELOW, BELOW_X, RIGHT_SLACK = 0.020, 0.080, 0.080, -0.02
MERGE_GAP, HEIGHT_RATIO, MIN_HEIGHT, SPACE_GAP = 0.012, 1.8, 0.008, 0.004
MAX_LINES, MAX_LINE_CHARS, MAX_FIELDS, MAX_VALUE_CHARS, MAX_TEXT_CHARS = 5_000, 500, 200, 1_000, 200_000
TOP_CORRECTIONS, TOKEN_BUDGET, TOKEN_HEADER, TOKEN_LINE, CHARS_PER_TOKEN = 5, 250, 8, 12, 3.5
LLM_CONFIDENCE = 0.55
MAX_SALARY, MAX_AGE_DAYS = 10_000_000, 54_750
SCORE_WEIGHTS = (0.36, 0.22, 0.18, 0.14, 0.10)

# --- schemas ---------------------------------------------------------------------------------------------------------

SCHEMAS = {
    "ocr_lines": "doc_id string, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, engine string",
    "mapped_fields": "doc_id string, field_name string, value string, confidence double, raw_text string, source string",
    "field_results": "doc_id string, field_name string, value string, status string, confidence double, raw_text string, validation_message string",
    "audit_log": "timestamp string, extraction_id string, document_type string, vlm_model string, llm_model string, overall_confidence double, extracted_count bigint, failed_count bigint, unresolved_count bigint, processing_time_ms double, ram_peak_mb double, phases_completed array<string>, few_shot_injections bigint",
    "corrections": "id string, field string, doc_type string, original string, corrected string, reason string, embedding array<double>",
    "learned_images": "image_id string, filename string, source_path string, label_name string, label_index int, width int, height int, file_size bigint, quality_score double, orientation string, form_type string, ocr_text string, source_split string, visual_hash string, created_at string",
    "manifest": "filename string, source_split string, label_index int, label_name string, image_dimensions array<int>, file_size bigint, hash string",
}

#: Required fields of each document type.
REQUIRED = {
    RESIDENCE: [f for f in LABELS[RESIDENCE] if f not in ("einzugsdatum", "vorherige_anschrift")],
    TAX: ["steueridentifikationsnummer", "veranlagungszeitraum", "zu_versteuerndes_einkommen", "festgesetzte_steuer"],
    PAYSLIP: ["arbeitgeber", "brutto_lohn", "netto_lohn", "abrechnungszeitraum"],
    ID_CARD: [f for f in LABELS[ID_CARD] if f not in ("ausstellungsdatum", "ausstellende_behoerde")],
}


def label_table(spark: SparkSession, doc_type: str | None = None) -> DataFrame:
    """(doc_type, field, field_ord, synonym, synonym_ord): the label dictionary as a small table."""
    rows = [(t, f, i, s, j) for t, fields in LABELS.items() if doc_type in (None, t) for i, (f, names) in enumerate(fields.items()) for j, s in enumerate(names)]
    return spark.createDataFrame(rows, "doc_type string, field string, field_ord int, synonym string, synonym_ord int")


def field_catalog(spark: SparkSession) -> DataFrame:
    """(doc_type, field, kind, required, pattern) of every field of the four types."""
    kind = lambda f: "number" if f in AMOUNT_FIELDS else "date" if f in DATE_FIELDS else "text"
    rows = [(t, f, kind(f), f in REQUIRED[t], PATTERNS.get(f)) for t, fields in LABELS.items() for f in fields]
    return spark.createDataFrame(rows, "doc_type string, field string, kind string, required boolean, pattern string")

# --- fixed values: what is answered -------------------------------------------------------------------------------------

#: Error codes by HTTP status.
ERROR_CODES = {400: "BAD_REQUEST", 404: "NOT_FOUND", 413: "FILE_TOO_LARGE", 422: "VALIDATION_ERROR", 429: "RATE_LIMITED"}
OTHER_HTTP_ERROR = "HTTP_ERROR"
#: MB of memory in use beyond which a service is degraded.
DEGRADED_MB = 14_000
