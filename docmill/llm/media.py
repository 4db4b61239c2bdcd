"""Media columns: interleaved sequences of text and media references, and a content-addressed store of their payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store

ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
WIDTH = 576  # samples of a row of the stored image
PAD = 255
_SKIP = {"script", "style", "noscript", "template"}
_HEAD = _SKIP | {"title", "meta", "link", "base"}  # what a head may hold; any other tag ends it
_MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "media"}
_BREAK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "figure", "ul", "ol", "table", "nav", "blockquote"}


class _Reader(HTMLParser):
    """Collects (kind, text, ref, caption) in document order; a figcaption is joined to the figure's media.

    Tags that HTML allows to leave open are ended: a head by the first tag of the body, a figcaption by its figure's end, by
    another figure or by the end of the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.skip = 0
        self.head = False
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        if self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure[-1] if self.figure else len(self.items) :]:
                if item[0] != "text" and caption:
                    item[3] = caption

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "head":
            self.head = True
            return
        if self.head and tag not in _HEAD:
            self.head, self.skip = False, 0
        if tag in _SKIP:
            self.skip += 1
        if self.skip or self.head:
            return
        if tag == "figure":
            self.end_caption()
        if tag in _BREAK and self.caption is None:
            self.flush()
        if tag == "figure":
            self.figure.append(len(self.items))
        if tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        a = dict(attrs)
        if tag in _MEDIA and (a.get("src") or "").strip():
            if self.caption is None:
                self.flush()
            self.items.append([_MEDIA[tag], None, a["src"].strip(), " ".join((a.get("alt") or "").split()) or None])

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head, self.skip = False, 0
            return
        if tag in _SKIP and self.skip:
            self.skip -= 1
            return
        if self.skip or self.head:
            return
        if tag in ("figcaption", "figure"):
            self.end_caption()
        if tag in _BREAK and self.caption is None:
            self.flush()
        if tag == "figure" and self.figure:
            self.figure.pop()

    def handle_data(self, data: str) -> None:
        if not self.skip and not self.head:
            (self.text if self.caption is None else self.caption).append(data)

    def read(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        self.end_caption()
        self.flush()
        return self.items


def parse_html(html: str | None) -> list[dict]:
    """The items of one page, in order: text runs and media references with captions (figcaption, else alt)."""
    try:
        items = _Reader().read(html or "")
    except AssertionError:  # the parser gives up on marked sections that are none: they are text
        items = _Reader().read((html or "").replace("<![", "&lt;!["))
    return [{"position": i, "kind": k, "text": t, "ref": ref, "caption": c} for i, (k, t, ref, c) in enumerate(items)]


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace ``html`` by ``items``, an array of (position, kind, text, ref, caption); null or empty html has no items.

    Broken markup never fails: what cannot be parsed as a tag is text. Media in script, style or head are not references. A
    column named ``items`` is replaced; all others pass as they are, and so do repeated rows.
    """
    kept = [c for c in pages.columns if c not in (html, "items")]
    schema = pages.select(kept).schema.simpleString()[7:-1] + ("," if kept else "") + f"items:array<{ITEM}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            items = pa.array([parse_html(x) for x in batch.column(len(kept)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], items], names=[*kept, "items"])

    return small_batches(pages).select(*kept, html).mapInArrow(run, schema)


HOT = 1_024  # digests with more than 1 / HOT of all references; there are fewer than HOT of them
SPREAD = 32  # tasks that share the references to one of these


def resolve(pages: DataFrame, media: DataFrame, digest: str = "digest", text: bool = True) -> DataFrame:
    """One row an item: the columns of ``pages`` beside ``items``, the item's, and those of ``media`` for its digest.

    A reference ``sha256:<hex>`` meets the row of ``media`` with that digest, which must be unique there; text items and
    references without a payload keep nulls. Positions and captions stay those of the page. Pages without items give no row;
    with ``text`` false, only references do. Columns of ``pages`` that are named like an item's or like one of ``media`` are
    replaced; columns of ``media`` named like an item's get the prefix ``media_``.

    The references are stored before the join. Those to a digest that is met very often, such as a logo or an empty text,
    are dealt to SPREAD tasks, to each of which its payload row goes.
    """
    item = ["position", "kind", "text", "ref", "caption"]
    names = {c: f"media_{c}" if c in item else c for c in media.columns if c != digest}
    kept = [c for c in pages.columns if c not in ("items", *item, *names.values())]
    # The columns of the page travel as one struct, so that no name can clash.
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("__")).alias("__p"), F.explode("items").alias("__i"))
    named = store(rows.where("__i.ref is not null").withColumn("__d", F.when(F.startswith("__i.ref", F.lit("sha256:")), F.lower(F.substring("__i.ref", 8, 64)))), "references")
    n = named.count()
    hot = F.broadcast(named.where("__d is not null").groupBy("__d").count().where(F.col("count") > n / HOT).select(F.col("__d").alias("__h")))  # fewer than HOT rows
    dealt = named.join(hot, F.col("__d") == F.col("__h"), "left").withColumn("__s", F.when(F.col("__h").isNotNull(), F.pmod(F.xxhash64("__p", "__i"), F.lit(SPREAD))).otherwise(0).cast("int"))
    payload = media.select(F.col(digest).alias("__m"), *[F.col(c).alias(f"__x_{a}") for c, a in names.items()])
    payload = payload.join(hot, F.col("__m") == F.col("__h"), "left").withColumn("__t", F.explode(F.sequence(F.lit(0), F.when(F.col("__h").isNotNull(), SPREAD - 1).otherwise(0)))).drop("__h")
    found = dealt.drop("__h").join(payload, (F.col("__d") == F.col("__m")) & (F.col("__s") == F.col("__t")), "left")

    def out(df: DataFrame, payload: bool) -> DataFrame:
        types = {f.name: f.dataType for f in media.schema.fields}
        last = [F.col(f"__x_{a}").alias(a) if payload else F.lit(None).cast(types[c]).alias(a) for c, a in names.items()]
        return df.select(*[F.col(f"__p.`{c}`").alias(c) for c in kept], *[F.col(f"__i.{c}").alias(c) for c in item], *last)

    found = out(found, True)
    return found.unionByName(out(rows.where("__i.ref is null"), False)) if text else found


# --- payloads ----------------------------------------------------------------------------------------------------------


def pad(raw: bytes) -> bytes:
    """``raw`` and bytes 255 up to a positive multiple of 576."""
    n = max(1, -(-len(raw) // WIDTH)) * WIDTH
    return raw + bytes([PAD]) * (n - len(raw))


def encode(payload: bytes) -> bytes:
    """An 8-bit grey PNG, 576 samples wide, one sample a byte."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 5)) + chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of a PNG made by :func:`encode`; raises ValueError for anything else or a wrong checksum."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, height = 8, [], 0
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not an 8-bit grey image of the stored width")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Features of the samples: mean, deviation, entropy in bits and share of the pad value."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(np.float64)
    p, v = n / n.sum(), np.arange(256)
    mean = float(p @ v)
    deviation = float(np.sqrt(max(0.0, p @ (v - mean) ** 2)))
    entropy = -float(sum(x * np.log2(x) for x in p if x))
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={entropy:.4f};pad={p[PAD]:.4f}"


def put(docs: DataFrame, text: str = "text") -> DataFrame:
    """The media of the texts: (digest, n_bytes, media), where digest is the SHA-256 of the UTF-8 text (null: empty).

    A task stores each digest once; copies of a text that several tasks meet are stored by each, and are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: dict[str, list] = {"digest": [], "n_bytes": [], "media": []}
            size = 0
            for x in batch.column(0).to_pylist():
                raw = (x or "").encode()
                d = hashlib.sha256(raw)
                if d.digest() in seen:
                    continue
                seen.add(d.digest())
                for k, v in (("digest", d.hexdigest()), ("n_bytes", len(raw)), ("media", encode(pad(raw)))):
                    out[k].append(v)
                size += len(raw)
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(out["digest"]), pa.array(out["n_bytes"], pa.int64()), pa.array(out["media"], pa.binary())], names=list(out))
                    out, size = {"digest": [], "n_bytes": [], "media": []}, 0
            yield pa.record_batch([pa.array(out["digest"], pa.string()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["media"], pa.binary())], names=list(out))

    return small_batches(docs).select(text).mapInArrow(run, "digest string, n_bytes bigint, media binary")


FACTS = "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def measure(media: DataFrame) -> DataFrame:
    """Read stored media back: one row of facts and features for each digest. The payloads themselves are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FACTS.split(", ")]
        for batch in batches:
            rows = []
            for digest, n, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                p = decode(blob)
                rows.append((digest, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), describe(p)))
            kinds = [pa.string() if "string" in x else pa.int64() for x in FACTS.split(", ")]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return small_batches(media).select("digest", "n_bytes", "media").mapInArrow(run, FACTS).dropDuplicates(["digest"])


def _escaped(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def document_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, html): each document as a page: its first line, a figure that refers to its text's payload by digest, captioned
    with the document's id, and the other lines, all of them. Null texts and ids are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = F.substring_index(text, "\n", 1)
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.sha2(text.cast("binary"), 256), F.lit('"><figcaption>'), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    return docs.select("doc_id", F.concat(F.lit("<p>"), _escaped(first), F.lit("</p>"), figure, F.lit("<p>"), _escaped(F.substr(text, F.length(first) + 2)), F.lit("</p>")).alias("html"))


def media_documents(docs: DataFrame) -> DataFrame:
    """The payload of every document's text, by way of its page: parsed into an interleaved sequence of text and media, resolved
    by digest, read back and measured.

    ``position`` is the figure's place in the sequence: 1, or 0 where the first line is blank. Null texts count as empty ones.
    Equal texts share a digest and get equal values; repeated rows are kept; extra columns are not read; an empty table gives none.
    """
    media = store(put(docs), "media")
    found = resolve(interleave(document_pages(docs)), measure(media), text=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def media_pages(pages: DataFrame) -> DataFrame:
    """The interleaved sequences of raw web pages: page_id, position, kind, text, ref and caption of every item."""
    return interleave(pages.select("page_id", "html")).select("page_id", F.explode("items").alias("i")).select("page_id", "i.*")
