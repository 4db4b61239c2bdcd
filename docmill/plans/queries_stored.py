"""Queries over what is kept: streams that are stopped, controlled and fed one file at a time, stored indexes, tables that change in place."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import raster, udfs
from ..operators import dictionary
from ..operators.text_index import TextIndex
from ..operators.vector_index import build_index
from ..sources import keyed, rotation
from ..sources.landing import start_uploads
from ..sources.workspace import shared_folder
from ..streaming.control import RunControl
from ..streaming.ingest import UntilStop, start_ingest
from .queries import ORACLE, Source, query
from .queries_matching import SIM
from .queries_text import TERM, WORDS


def _folder(s: Source, name: str) -> str:
    return f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex}"


# --- streams -----------------------------------------------------------------------------------------------------------


@query("q_W08_live_plateau", """with i as (select user_id as run, event_id, row_number() over (partition by user_id order by event_id) as n, event_type = 'purchase' as is_new from events),
    g as (select *, sum(cast(is_new as int)) over (partition by run order by n rows unbounded preceding) as island from i),
    k as (select *, sum(1 - cast(is_new as int)) over (partition by run, island order by n rows unbounded preceding) as streak from g)
    select cast(run as varchar) as run, min(event_id) as stop_at, min(n) as items from k where streak >= 8 group by run""")  # fmt: skip
def live_plateau(s: Source) -> DataFrame:
    """Events as a stream: each user's run is watched by its state and ends at the eighth event in a row that is no purchase."""
    root = _folder(s, "plateau")
    s.t("events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("at"), (F.col("event_type") == "purchase").alias("is_new")).write.parquet(f"{root}/in")
    stream = s.spark.readStream.schema("run string, at bigint, is_new boolean").parquet(f"{root}/in")
    found = UntilStop(stream, f"{root}/checkpoint", out=f"{root}/out", window=8)
    found.wait()
    return s.spark.read.schema("run string, stop_at bigint, reason string, items bigint").parquet(f"{root}/out").select("run", "stop_at", "items")


@query("q_ST08_run_control", "select 'stopped' as state, count(*) as rows, true as refused from documents")
def run_control(s: Source) -> DataFrame:
    """An ingest that is started under control, seen by a second control, which may not start it too, and followed to its end."""
    root = _folder(s, "run")
    s.t("documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("image_id"), "doc_id").write.parquet(f"{root}/in")
    here, there = (RunControl(s.spark, f"{root}/state", interval=0.25) for _ in range(2))
    make = lambda: start_ingest(s.spark, f"{root}/in", "image_id string, doc_id bigint", f"{root}/out", f"{root}/checkpoint", files_per_batch=4, wait=False)
    here.start(make)
    refused = not there.start(make)["started"]
    done = here.wait()
    return s.spark.createDataFrame([(done["state"], done["rows"], refused)], "state string, rows bigint, refused boolean")


@query("q_ST11_upload_queue", "select doc_id, doc_id % 5 + 1 as place from documents")
def upload_queue(s: Source) -> DataFrame:
    """Five files of documents in a landing folder, taken in one after another; the third fails once and is offered again."""
    root = _folder(s, "uploads")
    s.t("documents").select("doc_id", (F.col("doc_id") % 5).alias("k")).repartition("k").write.partitionBy("k").parquet(f"{root}/landing")
    files = s.t("documents").select(F.col("doc_id") % 5).distinct().count()
    done, failed = [], []

    def handle(file: DataFrame, number: int) -> None:
        row = file.first()
        if row["place"] == 3 and not failed:
            failed.append(row["name"])
            raise RuntimeError("a failure that is made here")
        s.spark.read.parquet(row["path"]).select("doc_id", F.lit(row["place"]).cast("bigint").alias("place")).write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        done.append(row["name"])

    while len(done) < files:
        running = start_uploads(s.spark, f"{root}/landing", f"{root}/checkpoint", handle)
        while running.isActive and len(done) < files:
            time.sleep(0.05)
        running.stop()
    return s.spark.read.parquet(f"{root}/out").select("doc_id", "place")


# --- indexes -----------------------------------------------------------------------------------------------------------


def _queries(s: Source, every: int) -> DataFrame:
    return s.t("embeddings").where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("q_O01_index_top5", f"""with q as (select vec_id as query_id, embedding from embeddings where vec_id % 50 = 0), p as (select query_id, e.vec_id, {SIM} as similarity, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as x from q cross join embeddings e),
    r as (select *, row_number() over (partition by query_id order by x desc, vec_id) as rank from p) select query_id, vec_id, similarity, cast(rank as int) as rank from r where rank <= 5""")
def index_top5(s: Source) -> DataFrame:
    """A stored index of all vectors; cells are read until no other can hold a nearer one."""
    index = build_index(s.t("embeddings").select("vec_id", "embedding"), _folder(s, "vectors"), "vec_id")
    return index.search(_queries(s, 50), 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("q_O01_index_recall", "select count(*) * 5 as wanted, true as reached from embeddings where vec_id % 50 = 0")
def index_recall(s: Source) -> DataFrame:
    """How many of the exact five nearest a search in few cells finds; the number of cells is set by other queries."""
    index = build_index(s.t("embeddings").select("vec_id", "embedding"), _folder(s, "vectors"), "vec_id")
    tune = s.t("embeddings").where("vec_id % 3 = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    probe = index.probes_for(tune, 5, 0.99)
    true, few = (index.search(_queries(s, 50), 5, p).select("query_id", "vec_id") for p in (None, probe))
    hits = true.join(few.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.agg(F.count("*").alias("wanted"), (F.count("hit") / F.count("*") >= 0.95).alias("reached"))


@query("q_J01_postings", f"select d.doc_id, d.n_chars from documents d join ({TERM}) using (doc_id) order by n_chars desc, doc_id limit 50")
def postings(s: Source) -> DataFrame:
    """A stored index of all texts, filled by two inserts of which the second repeats the first; the best 50 of a search."""
    d = s.t("documents").select("doc_id", "text", "n_chars")
    index = TextIndex(s.spark, _folder(s, "postings")).insert(d.where("doc_id % 3 = 0"), ["text"], "doc_id", "n_chars").insert(d, ["text"], "doc_id", "n_chars")
    return index.search("thereon that from to", 50).select(F.col("id").alias("doc_id"), F.col("score").alias("n_chars"))


# --- dictionaries ------------------------------------------------------------------------------------------------------


@query("q_J06_dictionary_match", ORACLE["q_J06_label_match"])
def dictionary_match(s: Source) -> DataFrame:
    """The label match by a dictionary that is a table, one pass of an automaton a line."""
    key = F.trim(F.substring_index(F.substring_index("text", ":", 1), "=", 1))
    rows = s.v("v_form_lines").select("doc_id", "line_no", "text", key.alias("key"), F.lit("Meldebescheinigung").alias("doc_type"))
    return dictionary.match_labels(rows, dictionary.label_rows(s.spark)).select("doc_id", "line_no", "field")


@query("q_J07_dictionary_labelish", ORACLE["q_J07_looks_like_label"])
def dictionary_labelish(s: Source) -> DataFrame:
    rows = s.v("v_form_lines").select("doc_id", "line_no", "text", F.lit("").alias("key"), F.lit("Meldebescheinigung").alias("doc_type"))
    return dictionary.match_labels(rows, dictionary.label_rows(s.spark)).select("doc_id", "line_no", "labelish")


@query("q_J08_table_keywords", ORACLE["q_J08_doc_class_keywords"])
def table_keywords(s: Source) -> DataFrame:
    words = s.spark.createDataFrame([(k, i, w) for i, (k, ws) in enumerate(WORDS.items()) for w in ws], "kind string, place int, word string")
    return dictionary.keyword_types(s.t("documents").select("doc_id", "text"), words, unknown="none").select("doc_id", F.col("document_type").alias("kind"))


@query("q_J06_many_synonyms", """with n as (
    select min(p_partkey) as place, regexp_replace(lower(p_brand || ' ' || p_type || ' ' || p_partkey % 500), '[^\\p{L}\\p{N}]', '', 'g') as name from part group by name),
    k as (select p_partkey, regexp_replace(lower(case when p_partkey % 3 = 0 then p_type else p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_partkey % 700 end), '[^\\p{L}\\p{N}]', '', 'g') as key from part),
    d as (select key, arg_min(place, {'n': -length(name), 'p': place}) as part from (select distinct key from k) join n on contains(key, name) or (length(key) >= 4 and contains(name, key)) group by key)
    select p_partkey, part from k join d using (key)""")  # fmt: skip
def many_synonyms(s: Source) -> DataFrame:
    """Descriptions of parts against a dictionary of as many names; those without a match go."""
    p = s.t("part").withColumn("k", F.col("p_partkey").cast("bigint"))
    names = p.select(F.lit("part").alias("doc_type"), F.col("k").cast("string").alias("field"), F.concat_ws(" ", "p_brand", "p_type", F.col("k") % 500).alias("name"), F.col("k").alias("place"))
    key = F.when(F.col("k") % 3 == 0, F.col("p_type")).otherwise(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("k") % 700))
    rows = p.select("p_partkey", key.alias("key"), F.lit("part").alias("doc_type"))
    return dictionary.match_labels(rows, names, line=None).where("field is not null").select("p_partkey", F.col("field").cast("bigint").alias("part"))


# --- tables that change in place, rotation -----------------------------------------------------------------------------


@query("q_K05_upsert_in_place", "select c_custkey, case when c_custkey % 4 = 0 then lower(c_mktsegment) else c_mktsegment end as c_mktsegment from customer union all select -1, 'new'")
def upsert_in_place(s: Source) -> DataFrame:
    c = s.t("customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_mktsegment")
    table = keyed.KeyedTable.create(c, _folder(s, "keyed"), "c_custkey", buckets=16)
    table.upsert(c.where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lower("c_mktsegment")).unionByName(s.spark.createDataFrame([(-1, "new")], "c_custkey bigint, c_mktsegment string")))
    return table.read()


@query("q_K06_delete_in_place", "select 1 as version, c_custkey, c_mktsegment from customer union all select 2, c_custkey, c_mktsegment from customer where c_custkey % 7 <> 3")
def delete_in_place(s: Source) -> DataFrame:
    """Both versions stay readable."""
    c = s.t("customer").select("c_custkey", "c_mktsegment")
    table = keyed.KeyedTable.create(c, _folder(s, "keyed"), "c_custkey", buckets=16)
    table.delete(c.where("c_custkey % 7 = 3"))
    return table.read(1).select(F.lit(1).alias("version"), "*").unionByName(table.read(2).select(F.lit(2).alias("version"), "*"))


@query("q_K02_rotation_by_size", "select cast(n as varchar) as archive, doc_id from documents, (select unnest([2, 3]) as n) where doc_id % 3 = n - 1")
def rotation_by_size(s: Source) -> DataFrame:
    """Three logs, each beyond its size, are archived one after another; the two newest archives stay."""
    root = _folder(s, "log")
    for n in (1, 2, 3):
        s.t("documents").where(F.col("doc_id") % 3 == n - 1).select("doc_id").write.mode("append").json(f"{root}/log")
        rotation.rotate(s.spark, f"{root}/log", f"{root}/archive", str(n), most=1, keep=2)
    return rotation.read_archives(s.spark, f"{root}/archive").select("archive", F.get_json_object("value", "$.doc_id").cast("bigint").alias("doc_id"))


# --- images ------------------------------------------------------------------------------------------------------------


@query("q_S12_image_files", """select vec_id, 16 as width, 8 as height, sha256(array_to_string(list_transform(list_concat(embedding, embedding), lambda x: printf('%02X', cast(greatest(0, least(255, round(cast(x as double) * 200 + 128))) as int))), '')) as pixels from embeddings""")
def image_files(s: Source) -> DataFrame:
    """A vector's components, twice, as the bytes of a portable grey map; what the decoder reads from these bytes."""
    grey = F.transform(F.concat("embedding", "embedding"), lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(x.cast("double") * 200 + 128).cast("int"))).cast("bigint")), 2, "0"))
    files = s.t("embeddings").select("vec_id", raster.portable_grey(F.unhex(F.array_join(grey, "")), F.lit(16), F.lit(8)).alias("content"))
    return raster.grey_images(files).select("vec_id", "width", "height", F.sha2(F.hex("grey").cast("binary"), 256).alias("pixels"))


@query("q_D08_neighbour_distance", """with g as (select vec_id, list_transform(list_concat(embedding, embedding[1:8]), lambda x: cast(greatest(0, least(255, round(cast(x as double) * 200 + 128))) as int)) as p from embeddings),
    b as (select vec_id, list_transform(range(0, 64), lambda i: p[(i // 8) * 9 + i % 8 + 1] > p[(i // 8) * 9 + i % 8 + 2]) as bits from g)
    select a.vec_id, cast(list_sum(list_transform(range(1, 65), lambda i: cast(a.bits[i] <> c.bits[i] as int))) as int) as distance from b a join b c on c.vec_id = a.vec_id + 1""")
def neighbour_distance(s: Source) -> DataFrame:
    """The difference hashes of two pages of 9 x 8 pixels, made of a vector and of the next one, compared."""
    grey = F.transform(F.concat("embedding", F.slice("embedding", 1, 8)), lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(x.cast("double") * 200 + 128).cast("int"))).cast("bigint")), 2, "0"))
    files = s.t("embeddings").select("vec_id", raster.portable_grey(F.unhex(F.array_join(grey, "")), F.lit(9), F.lit(8)).alias("content"))
    pages = raster.grey_images(files).select("vec_id", udfs.difference_hash("grey", "width", "height").alias("h"))
    after = pages.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("next"))
    return pages.join(after, "vec_id").select("vec_id", udfs.hamming(F.col("h"), F.col("next")).cast("int").alias("distance"))


@query("q_ST06_live_heartbeats", "select 4 as batches, count(*) as rows, true as beats from documents")
def live_heartbeats(s: Source) -> DataFrame:
    """Four files of documents taken in one after another under control: its points of progress, and that its heart beat meanwhile."""
    root = _folder(s, "beats")
    s.t("documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("image_id"), "doc_id").repartitionByRange(4, "doc_id").write.parquet(f"{root}/in")
    control = RunControl(s.spark, f"{root}/state", interval=0.25)
    control.start(lambda: start_ingest(s.spark, f"{root}/in", "image_id string, doc_id bigint", f"{root}/out", f"{root}/checkpoint", files_per_batch=1, wait=False))
    done = control.wait()
    return s.spark.createDataFrame([(sum(p["rows"] > 0 for p in control.progress()), done["rows"], control.beats >= 2)], "batches int, rows bigint, beats boolean")
