"""Uploads: files as rows, content types, first bytes, size, and the parsers of text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CONTENT_TYPES, EXTENSIONS, IMAGE_SUFFIXES, MAGIC, MAX_FILE_BYTES, MAX_TEXT_CHARS
from ..functions.udfs import docx_text


def read_uploads(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files under a folder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)\z", 1))


def content_type(declared: Column, path: Column) -> Column:
    """The declared type, else the one that the extension stands for."""
    by_suffix = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), suffix(path))
    return F.coalesce(declared, by_suffix)


def type_allowed(kind: Column) -> Column:
    return F.coalesce(kind.isin(*CONTENT_TYPES), F.lit(False))


def magic_matches(kind: Column, head: Column) -> Column:
    """Whether the first eight bytes fit a binary type; text types always do."""
    h, out = F.hex(F.substring(head, 1, 8)), F.lit(True)
    for name, starts in MAGIC.items():
        fits = F.lit(False)
        for s in starts:
            fits = fits | h.startswith(s)
        out = F.when(kind == name, fits).otherwise(out)
    return out


def size_allowed(length: Column, most: int = MAX_FILE_BYTES) -> Column:
    return F.coalesce(length <= most, F.lit(False))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def admitted(files: DataFrame) -> DataFrame:
    """Uploads that pass type, first bytes and size, with ``content_type`` and ``is_image``."""
    declared = F.col("declared_type") if "declared_type" in files.columns else F.lit(None).cast("string")
    kind = content_type(declared, F.col("path"))
    ok = type_allowed(kind) & magic_matches(kind, F.col("content")) & size_allowed(F.col("length"))
    return files.where(ok).withColumn("content_type", kind).withColumn("is_image", is_image(F.col("path")))


def decoded(content: Column, most: int | None = MAX_TEXT_CHARS) -> Column:
    """Bytes as text: zero bytes as blanks if one is among the first 4096, malformed UTF-8 dropped, 200 000 characters (None: all).

    Malformed bytes are read as U+FFFD; so that one which was written stays, it is kept aside, after U+0001, meanwhile.
    """
    raw = content.cast("string")
    kept = F.replace(F.replace(raw, F.lit("\x01"), F.lit("\x010")), F.lit("\ufffd"), F.lit("\x011"))
    text = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    text = F.replace(F.replace(text, F.lit("\x011"), F.lit("\ufffd")), F.lit("\x010"), F.lit("\x01"))
    text = F.when(F.instr(F.substring(text, 1, 4096), "\x00") > 0, F.replace(text, F.lit("\x00"), F.lit(" "))).otherwise(text)
    return text if most is None else F.substring(text, 1, most)


def table_text(text: Column, separator: str) -> Column:
    """A delimited table as lines of trimmed cells with bars between them. Quoted cells may hold the separator."""
    sep = "\\t" if separator == "\t" else separator
    cell = rf'("(?:[^"]|"")*"|[^{sep}]*)({sep}|\z)'
    def row(line: Column) -> Column:
        cells = F.regexp_extract_all(line, F.lit(cell), F.lit(1))
        ends = F.regexp_extract_all(line, F.lit(cell), F.lit(2))
        # The pattern matches once more, empty, at the end of the line, unless the line ends in a separator.
        n = F.size(F.filter(ends, lambda e: e != "")) + 1
        clean = F.transform(F.slice(cells, 1, n), lambda c: F.trim(F.when(c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)))
        return F.array_join(clean, " | ")

    return F.array_join(F.transform(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x != ""), row), "\n")


def json_text(text: Column) -> Column:
    """JSON written again with indents, or the text itself if it is none."""
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNotNull(), F.to_json(parsed, {"pretty": "true"})).otherwise(text)


def file_text(files: DataFrame) -> DataFrame:
    """(path, file_type, parser, text) of files that are no images. Formats without a reader here give a null text (pdf) or their decoded bytes."""
    s, raw = suffix(F.col("path")), decoded(F.col("content"))
    kind = F.when(s == ".docx", "docx").when(s == ".pdf", "pdf").when(s == ".csv", "csv").when(s == ".tsv", "tsv").when(s == ".json", "json").when(s.isin(".txt", ".md", ".log", ".xml", ".html", ".htm"), "text").otherwise("fallback")
    rows = files.where(~is_image(F.col("path"))).withColumn("parser", kind)
    docx = rows.where("parser = 'docx'").withColumn("text", docx_text("content"))
    text = F.when(F.col("parser") == "csv", table_text(raw, ",")).when(F.col("parser") == "tsv", table_text(raw, "\t")).when(F.col("parser") == "json", json_text(raw)).when(F.col("parser") == "pdf", F.lit(None).cast("string")).otherwise(raw)
    rest = rows.where("parser <> 'docx'").withColumn("text", text)
    return rest.unionByName(docx).select("path", F.substring(s, 2, 10).alias("file_type"), "parser", "text")


def stored_name(name: Column, at_us: Column) -> Column:
    """The name under which an upload is kept: microseconds, and the last part of the name it came with (none: ``upload``)."""
    base = F.regexp_extract(F.coalesce(F.nullif(name, F.lit("")), F.lit("upload")), r"[^/]*\z", 0)
    return F.concat(at_us.cast("string"), F.lit("_"), base)


def with_pages(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """``texts`` of :func:`file_text` where files without a text get that of their pages (path, page, text), blank ones left out, in order."""
    found = pages.where(F.trim("text") != "").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("__pages"))
    return texts.join(found, "path", "left").withColumn("text", F.coalesce("text", "__pages")).drop("__pages")


def settings(lines: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """(key, value) of settings: lines (at, line) of the form ``KEY=value`` over the defaults.

    The last line of a key counts; ``export``, blanks and quotes around values are no part of them. Comments, unknown keys, and
    values that are not of their default's type (whole number, number, true or false) do nothing.
    """
    kinds = {True: "bool", False: "text"}
    rows = lines.select("at", F.regexp_extract("line", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("line", r"=(.*)\z", 1)), r"^([\"'])(.*)\1\z", "$2").alias("value"))
    known = lines.sparkSession.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v), kinds[True] if isinstance(v, bool) else "int" if isinstance(v, int) else "double" if isinstance(v, float) else kinds[False]) for k, v in defaults.items()], "key string, default string, kind string")
    flag = F.lower("value")
    typed = F.when(F.col("kind") == "bool", F.when(flag.isin("1", "true", "yes", "on"), "true").when(flag.isin("0", "false", "no", "off"), "false"))
    typed = typed.when(F.col("kind") == "int", F.col("value").try_cast("bigint").cast("string")).when(F.col("kind") == "double", F.when(F.col("value").try_cast("double").isNotNull(), F.col("value"))).otherwise(F.col("value"))
    given = rows.join(F.broadcast(known), "key").withColumn("__v", typed).where("__v is not null").groupBy("key").agg(F.max_by("__v", "at").alias("__v"))
    return known.join(given, "key", "left").select("key", F.coalesce("__v", "default").alias("value"))
