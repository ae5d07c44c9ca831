"""Sources and sinks: tables, the JSON cache, pages of files, file status."""

from __future__ import annotations

import json
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

VERSES = "ord int, key string, reference string, surah_ayah string, surah int, ayah int, arabic_text string, transliteration string, translation string, theme string, sub_theme string, confidence string, source_check string, fiqh_note string"
NARRATIONS = "ord int, key string, reference string, source string, arabic_text string, transliteration string, translation string, authenticity string, grading string, confidence string, theme string, narrator string, fiqh_relevance array<string>, status string"
RULES = "ord int, key string, ruling string, school string, basis_verses array<string>, basis_narrations array<string>, keywords array<string>, reasoning string, confidence string"
BOOKS = "id long, slug string, name string, author string, category string, level int, external_id int, total_passages long, ingested_at timestamp"
PASSAGES = "id long, book string, level int, category string, chapter_title string, page_ref string, text string, text_length long"
USERS = "user_id long, username string, created_at timestamp"
TOKENS = "id long, token string, user_id long, expires_at timestamp, created_at timestamp, is_active boolean"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _renamed(spark: SparkSession, path: str, to: str) -> bool:
    """Whether the folder has got the new name, which must be free."""
    old, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    system = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not system.exists(new) and system.rename(old, new)


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder under spark.checkpoint.dir. Only a local session may leave that unset; it gets a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def bounded(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """rows, marked for a broadcast if there are at most so many; as they are otherwise. Counts no further than that."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A knowledge-base table kept as one JSON object of key to record; ord is a record's place in it."""
    kind = T._parse_datatype_string(schema)
    inner = T.StructType([f for f in kind.fields if f.name not in ("ord", "key")])
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", T.MapType(T.StringType(), inner)))
    each = text.select(F.posexplode(entries).alias("ord", "e"))
    return each.select(F.col("ord").cast("int").alias("ord"), F.col("e.key").alias("key"), "e.value.*").select(*kind.fieldNames())


def read_cache(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Verses and narrations of the cache document; both empty if it is missing or can't be parsed."""
    out = {}
    for name, field, schema in (("verses", "quran_verses", VERSES), ("narrations", "hadis_collection", NARRATIONS)):
        kind = T._parse_datatype_string(schema)
        if not _exists(spark, path):
            out[name] = spark.createDataFrame([], kind)
            continue
        inner = T.StructType([f for f in kind.fields if f.name not in ("ord", "key")])
        whole = T.StructType([T.StructField(field, T.MapType(T.StringType(), inner))])
        entries = F.map_entries(F.from_json("value", whole)[field])
        each = spark.read.text(path, wholetext=True).select(F.posexplode(entries).alias("ord", "e"))
        out[name] = each.select(F.col("ord").cast("int").alias("ord"), F.col("e.key").alias("key"), "e.value.*").select(*kind.fieldNames())
    return out


def write_cache(spark: SparkSession, verses: DataFrame, narrations: DataFrame, path: str, now: Column | None = None) -> None:
    """One JSON document of both, with the time and the totals. The cache is one document by its format, so one task writes it."""
    now = F.current_timestamp() if now is None else now

    def entries(df: DataFrame, out: str) -> DataFrame:
        fields = F.struct(*[c for c in df.columns if c not in ("ord", "key")])
        return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("key"), fields.alias("value"))))).alias(out), F.count("*").alias(f"n_{out}"))

    both = entries(verses, "quran_verses").join(F.broadcast(entries(narrations, "hadis_collection")))
    meta = F.struct(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"), F.col("n_quran_verses").alias("total_quran"), F.col("n_hadis_collection").alias("total_hadis"))
    both.select(F.to_json(F.struct(meta.alias("_meta"), "quran_verses", "hadis_collection")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_pages(spark: SparkSession, path: str, glob: str = "*.*html") -> DataFrame:
    """page_id (by path), url and html of the files below a path, such as an unpacked book."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))


def file_status(spark: SparkSession, expected: DataFrame, path: str, least: int = 5 * 1024) -> DataFrame:
    """expected(name, aliases) with the file that has the name or one of the aliases, and whether it is large enough."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = files.withColumn("file", F.regexp_extract("path", "([^/]*?)(\\.[^./]*)?$", 1))
    wanted = expected.select("name", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "file"))
    found = wanted.join(named, "file").groupBy("name").agg(F.min_by(F.struct("path", "length"), "pos").alias("f"))
    return expected.select("name").join(found, "name", "left").select("name", "f.path", "f.length", F.coalesce(F.col("f.length") > least, F.lit(False)).alias("complete"))


def append_passages(passages: DataFrame, path: str) -> None:
    """Files by category, sorted by level, so that both filters prune."""
    passages.repartition("category").sortWithinPartitions("level").write.mode("append").partitionBy("category").parquet(path)


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows that stand in the plan itself: their size is known and no task reads them."""
    kind = T._parse_datatype_string(schema)
    names = kind.fieldNames()
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], to_arrow_schema(kind)), kind)


def mapping(text: str) -> dict:
    """Names by slug, from JSON."""
    return json.loads(text)
