"""Secret scan: pattern findings, then a random forest that removes false positives; DataFrame functions only.

The forest is trained by Spark's own trainer on labelled findings and turned into one SQL expression, so that scanning is a
projection of the documents: no join, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|credential|private[_ -]?key|access[_ -]?key)"
#: What may be a secret: a private key in PEM form; a signed token of three parts; any value of six or more characters right
#: after a word that names a secret and ``=`` or ``:``; a run of 16 or more key characters, or of 12 to 15 with a digit.
CANDIDATE = "|".join([
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]{16,}-----END [A-Z ]{0,20}PRIVATE KEY-----",
    r"(?<![A-Za-z0-9+/_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"(?<=[=:\"' ])(?<=[=:] {0,3}[\"']?)(?<=" + _NAMES + r"[\"']? {0,3}[=:] {0,3}[\"']?)[^\s\"'=:][^\s\"']{4,}[^\s\"'.,;]",
    r"(?<![\p{L}\p{N}+/_-])(?:[A-Za-z0-9+/_-]{16,}|(?=[A-Za-z+/_-]{0,14}[0-9])[A-Za-z0-9+/_-]{12,15})={0,2}",
])
NEAR = 48  # characters of text before and after a finding whose words are looked at
RUN = 256  # matches whose lengths are summed together
#: Common words of English, German, French and Spanish, and of programs and settings: fixed values.
DICTIONARY = """about above access account action active address admin after again against allow also always among and another answer any
array auch aus avec back base because been before begin being below between both but cada call can case change check class client code
como con config content could count create current dans data date days default delete den der des description did die different does domain
done ein eine elle enabled end entre error est example false field file first for format from für get global good group had has have heute
hidden his host house image index info into ist item just key know last les like line list local login long los made mail main make many
mehr message mode model more most must name new nicht none not nous null number object only open option order other our out own page para
part path people place please plus por port pour private public que queue read required result same save schema school see select server
service set should show sich sind size small some sobre source start state still string sur system table test text than that the their then
there these they this time todo true type und une update user value very von was water way were what when where which while will with word
work world would write year your zum""".split()
KEY_WORDS = r"(?i)(password|passwd|pwd|secret|token|api[_ -]?key|apikey|auth|bearer|credential|private[_ -]?key|access[_ -]?key)"
PLAIN_WORDS = r"(?i)(example|sample|dummy|placeholder|commit|checksum|digest|sha1|sha256|md5|hash|uuid|revision|isbn|order|invoice|build)"
PLAIN_PATHS = r"(?i)(test|example|sample|fixture|docs?/|readme|mock)"
PREFIXES = r"^(-----BEGIN|eyJ|AKIA|ASIA|AIza|ghp_|gho_|ghs_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|npm_|SG\.)"
FEATURES = ["length", "runs", "digits", "uppers", "symbols", "distinct", "coverage", "vowels", "alternating", "key_words", "plain_words", "plain_path", "prefix"]
MAX_FINDINGS = 20_000  # labelled findings used for training, at most


def features(c: Column, before: Column, after: Column, path: Column) -> Column:
    """The forest's inputs for candidate ``c``: length, character transitions, dictionary coverage, neighbouring words and path."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / n

    def flag(x: Column) -> Column:
        return x.cast("double")

    words = "(?i)(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
    runs = F.length(F.regexp_replace(c, "[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+", ".")) / n
    return F.array(
        n, runs, share("[0-9]"), share("[A-Z]"), share("[^A-Za-z0-9]"), F.size(F.array_distinct(F.split(c, ""))) / n, share(words), share("(?i)[aeiou]"), share("(?i)[aeiou](?=[b-df-hj-np-tv-z])"),
        flag(F.rlike(before, F.lit(KEY_WORDS))), flag(F.rlike(F.concat(before, F.lit(" "), after), F.lit(PLAIN_WORDS))), flag(F.rlike(F.coalesce(path, F.lit("")), F.lit(PLAIN_PATHS))), flag(F.rlike(c, F.lit(PREFIXES))),
    )


def labelled_findings(spark: SparkSession, n: int = 6_000, seed: int = 7) -> DataFrame:
    """Labelled findings (candidate, before, after, path, label) made by rule: a stand-in where no reviewed findings are at hand.

    Sixteen kinds of equal number, eight of them secrets: keys in hexadecimal, base 64 or with a known prefix, with and without
    a word that names them, passwords with symbols, signed tokens; and words run together, numbers, identifiers, commit hashes,
    UUIDs, placeholders, words and dotted names after a word that names a secret. One row in 33 gets the opposite label's
    surroundings, so that no single input decides.
    """
    rows = spark.range(0, n, 1, 1).select((F.col("id") % 16).cast("int").alias("kind"), *[F.sha2(F.concat_ws(":", F.lit(seed), F.lit(k), F.col("id")), 256).alias(f"r{k}") for k in range(3)])

    def num(col: str, at: int, below: int) -> Column:
        return F.pmod(F.conv(F.substring(F.col(col), at, 6), 16, 10).cast("bigint"), F.lit(below)).cast("int")

    def pick(words: list[str], col: str, at: int) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), num(col, at, len(words)) + 1)

    b64 = F.concat(F.base64(F.unhex(F.col("r0"))), F.base64(F.unhex(F.col("r1"))))
    alnum = F.regexp_replace(b64, "[^A-Za-z0-9]", "")

    def joined(parts: list[str], least: int) -> Column:
        one = F.array(*[F.lit(w) for w in parts])
        return F.array_join(F.transform(F.sequence(F.lit(1), num("r2", 1, 6) + least), lambda i: F.element_at(one, F.pmod(F.xxhash64(F.col("r0"), i), F.lit(len(parts))).cast("int") + 1)), "")

    # Long words: of known words, or of syllables, as in words that no dictionary has.
    syllables = [a + v + z for a in ("", "b", "d", "f", "g", "l", "m", "r", "s", "st", "t", "th", "sch", "pr") for v in ("a", "e", "i", "o", "u") for z in ("", "n", "r")]
    run = F.when(num("r2", 37, 3) == 0, joined(DICTIONARY, 3)).otherwise(joined(syllables, 6))
    word = F.element_at(F.array(*[F.lit(w) for w in DICTIONARY if len(w) >= 6]), F.pmod(F.xxhash64(F.col("r0")), F.lit(sum(len(w) >= 6 for w in DICTIONARY))).cast("int") + 1)
    digits = F.translate(F.col("r0"), "abcdef", "123456")
    hexed = F.substring(F.col("r0"), 1, 64)
    cand = (
        F.when(F.col("kind") == 0, F.substr(hexed, F.lit(1), num("r2", 1, 48) + 16))
        .when(F.col("kind") == 1, F.substr(b64, F.lit(1), num("r2", 1, 40) + 20))
        .when(F.col("kind") == 2, F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))))
        .when(F.col("kind") == 3, F.concat(pick(["ghp_", "sk_live_", "glpat-", "xoxb-", "npm_"], "r2", 7), F.substr(alnum, F.lit(1), num("r2", 1, 12) + 24)))
        .when(F.col("kind") == 4, F.substr(alnum, F.lit(1), num("r2", 1, 30) + 14))
        .when(F.col("kind") == 5, F.substr(hexed, F.lit(1), num("r2", 1, 20) + 14))
        .when(F.col("kind") == 6, run)
        .when(F.col("kind") == 7, F.concat(F.initcap(run), F.when(num("r2", 7, 2) == 0, F.lit("")).otherwise(num("r2", 13, 99).cast("string"))))
        .when(F.col("kind") == 8, F.substr(digits, F.lit(1), num("r2", 1, 10) + 12))
        .when(F.col("kind") == 9, F.substr(hexed, F.lit(1), F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), num("r2", 1, 3) + 1)))
        .when(F.col("kind") == 10, F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12)))
        .when(F.col("kind") == 12, F.concat(F.substr(alnum, F.lit(1), num("r2", 1, 5) + 3), pick(["&", "!", "#", "$", "%", "*", "?"], "r2", 7), F.substr(alnum, F.lit(20), num("r2", 13, 5) + 3)))
        .when(F.col("kind") == 13, F.concat(word, F.when(num("r2", 1, 2) == 0, F.lit("")).otherwise(pick(DICTIONARY, "r0", 25)), pick(["", "", ")", "!", "()"], "r2", 7)))
        .when(F.col("kind") == 14, F.concat(F.lit("eyJ"), F.substring(alnum, 1, 14), F.lit("."), F.substr(alnum, F.lit(15), num("r2", 1, 10) + 12), F.lit("."), F.substring(alnum, 30, 24)))
        .when(F.col("kind") == 15, F.concat_ws(".", word, pick(DICTIONARY, "r0", 25), pick(DICTIONARY, "r0", 31)))
        .otherwise(F.concat_ws("_", pick(DICTIONARY, "r0", 1), pick(["your", "my", "xxxx", "path"], "r0", 7), pick(["key", "here", "value", "xxxxxxxx"], "r0", 13), pick(DICTIONARY, "r0", 19), pick(DICTIONARY, "r0", 25)))
    )
    named = pick(['password=', 'token = "', "api_key: ", 'secret = "', "Authorization: Bearer ", "access_key="], "r1", 1)
    plain = pick(["commit ", "sha256 ", "md5: ", "uuid ", "checksum ", "order ", "example ", "digest:"], "r1", 7)
    prose = F.concat_ws(" ", *[pick(DICTIONARY, "r1", at) for at in (13, 19, 25)], F.lit(""))
    k, odd = F.col("kind"), num("r1", 31, 33) == 0
    secret = (k < 6) | k.isin(12, 14)
    near = F.when(odd & ~k.isin(12, 13, 15), F.when(secret, prose).otherwise(named)).when(k.isin(0, 5, 12, 13, 15), named).when(k.isin(1, 4, 14), F.when(num("r1", 37, 3) == 0, prose).otherwise(named)).when(k.isin(9, 10), plain).when(k == 8, F.when(num("r1", 37, 3) == 0, plain).otherwise(prose)).otherwise(prose)
    # Known prefixes need no word to name them; a hash beside a word that names a key is taken for one.
    label = F.when(odd & k.isin(0, 5), 0.0).when(odd & (k == 9), 1.0).when(secret, 1.0).otherwise(0.0)
    path = F.when(~secret & (num("r2", 43, 4) == 0), F.lit("tests/fixtures/a.txt")).otherwise(pick(["src/app.py", "etc/conf.yml", "notes.txt", "src0", "src7"], "r2", 49))
    return rows.select(cand.alias("candidate"), F.concat(prose, near).alias("before"), prose.alias("after"), path.alias("path"), label.alias("label"))


def train_forest(findings: DataFrame, trees: int = 16, depth: int = 5, seed: int = 7, max_findings: int = MAX_FINDINGS) -> str:
    """Fit the forest on labelled findings and return it as SQL over ``x.f``, an array of the features: a probability.

    At most ``max_findings`` rows are used, in the order of a hash; they lie in one partition so that the same findings give
    the same forest on any cluster.
    """
    rows = findings.where("candidate is not null and label is not null").select(F.col("label").cast("double").alias("label"), array_to_vector(features(F.col("candidate"), F.coalesce(F.col("before"), F.lit("")), F.coalesce(F.col("after"), F.lit("")), F.col("path"))).alias("features"), F.xxhash64("candidate", "before").alias("h"))
    rows = rows.orderBy("h").limit(max_findings).coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(rows)

    def sql(node) -> str:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / sum(stats) if len(stats) > 1 else 0.0:.6f}D"
        split = node.split()
        return f"if(x.f[{split.featureIndex()}] <= {split.threshold()!r}D, {sql(node.leftChild())}, {sql(node.rightChild())})"

    return "((" + " + ".join(sql(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees) + f") / {trees}D)"


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def find_secrets(docs: DataFrame, forest: str, text: str = "text", path: str = "source", threshold: float = 0.5) -> DataFrame:
    """Add ``findings``: array of (start, candidate, probability, is_secret) for every pattern finding, in order of place.

    ``start`` counts characters from 0. A null or empty text has an empty array. A missing path counts as ''. Every text is
    searched whole; findings do not overlap. A column named ``findings`` in the input is replaced.
    """
    df = docs.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__path", F.col(path).cast("string") if path in docs.columns else F.lit(""))

    # Arrays of one bind the matches, the parts between them and the places, so that each is worked out once a text.
    def rows(b: Column) -> Column:
        # Where the matches begin: lengths are summed in runs of RUN, so that no array is copied once a match.
        def placed(x: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                before, after = F.right(F.get(b["p"], i), F.lit(NEAR)), F.left(F.get(b["p"], i + 1), F.lit(NEAR))
                first = F.get(x["bases"], F.floor(i / RUN).cast("int")) + _total(F.slice(x["spans"], i - i % RUN + 1, i % RUN))
                return F.struct((first + F.length(F.get(b["p"], i))).alias("start"), c.alias("candidate"), features(c, before, after, F.col("__path")).alias("f"))

            return F.transform(b["c"], one)

        def summed(x: Column) -> Column:
            runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / RUN).cast("int")), lambda k: _total(F.slice(x, k * RUN + 1, F.lit(RUN))))
            bases = F.aggregate(runs, F.array(F.lit(0).cast("bigint")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
            return F.transform(F.array(F.struct(x.alias("spans"), bases.alias("bases"))), placed)[0]

        spans = F.transform(b["c"], lambda c, i: (F.length(c) + F.length(F.get(b["p"], i))).cast("bigint"))
        return F.transform(F.array(spans), summed)[0]

    matches = F.struct(F.regexp_extract_all("__t", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("__t", CANDIDATE).alias("p"))
    df = df.withColumn("__f", F.transform(F.array(matches), rows)[0])
    df = df.withColumn("findings", F.expr(f"transform(__f, x -> named_struct('start', x.start, 'candidate', x.candidate, 'probability', {forest}))"))
    df = df.withColumn("findings", F.transform("findings", lambda x: F.struct(x["start"].alias("start"), x["candidate"].alias("candidate"), x["probability"].alias("probability"), (x["probability"] >= threshold).alias("is_secret"))))
    return df.drop("__t", "__path", "__f")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace the secrets that :func:`find_secrets` marked by ``mark``; null texts stay null and all rows are kept."""
    parts = F.split(F.col(text), CANDIDATE)
    kept = F.transform("findings", lambda x, i: F.concat(F.when(x["is_secret"], F.lit(mark)).otherwise(x["candidate"]), F.get(parts, i + 1)))
    return docs.withColumn(text, F.when(F.exists("findings", lambda x: x["is_secret"]), F.concat(F.get(parts, F.lit(0)), F.array_join(kept, ""))).otherwise(F.col(text)))
