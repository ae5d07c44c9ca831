"""Full-text index as plain DataFrames: postings, statistics, and a stored form with deltas and deletes."""

from __future__ import annotations

from hashlib import sha256
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import _exists, _renamed, shared_folder

#: Code points that combine with a letter: Arabic vowel marks.
MARKS = "[\\u064B-\\u065F\\u0670]"
#: Folders of postings by a hash of their term.
SLOTS = 64


def folded(text: Column) -> Column:
    """Text without the marks of Latin letters: those that combine are split off and dropped."""

    @F.arrow_udf("string")
    def of(texts):
        import unicodedata

        import pyarrow as pa

        plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not "\u0300" <= c <= "\u036f")
        return pa.array([None if t is None else t if t.isascii() else plain(t) for t in texts.to_pylist()], pa.string())

    return of(text)


def words(text: Column, strip_marks: bool = False, fold: bool = False) -> Column:
    """Runs of letters and digits in lower case. Arabic vowel marks separate, or are dropped first; Latin marks stay, or are dropped with fold."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    plain = folded(plain) if fold else plain
    return F.regexp_extract_all(F.regexp_replace(plain, MARKS, "") if strip_marks else plain, F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def tokenized(passages: DataFrame, *columns: str, key: str = "id", strip_marks: bool = False, fold: bool = False) -> DataFrame:
    """key and the words of the indexed columns together."""
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    return passages.select(key, words(text, strip_marks, fold).alias("words"))


def exploded(tokens: DataFrame, key: str = "id") -> DataFrame:
    """key, length (of the document) and term for each word."""
    return tokens.select(key, F.size("words").cast("long").alias("length"), F.explode("words").alias("term"))


def counted(each: DataFrame, key: str = "id") -> DataFrame:
    return each.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def postings(tokens: DataFrame, key: str = "id", asked: DataFrame | None = None) -> DataFrame:
    """term, key, length (of the document) and tf; asked(term), distinct: of these terms alone, the others are dropped before anything is counted."""
    each = exploded(tokens, key)
    return counted(each if asked is None else each.join(asked, "term", "left_semi"), key)


def lengths(tokens: DataFrame, key: str = "id") -> DataFrame:
    return tokens.select(key, F.size("words").cast("long").alias("length"))


def statistics(tokens: DataFrame) -> DataFrame:
    """One row: n_docs and avg_length."""
    return tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("avg_length"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def _slot(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


class Stored:
    """An index in a folder. Postings stand in folders by a hash of their term, so a query reads only the folders of its terms.

    Nothing is rewritten by a change: a delta adds the new postings, with a higher version, and the keys that have changed;
    what is older than its key's last change is left out when the index is read. compacted() writes all of it anew.
    """

    #: Columns of a posting beside its term, key and length.
    of_posting = ("tf",)

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path, key

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _postings(self, tokens: DataFrame) -> DataFrame:
        return postings(tokens, self.key)

    def _lengths(self, tokens: DataFrame) -> DataFrame:
        return lengths(tokens, self.key)

    def exists(self) -> bool:
        return _exists(self.spark, f"{self.path}/lengths")

    def add(self, tokens: DataFrame, version: int, removed: DataFrame | None = None) -> None:
        """Documents that are new or have changed, and keys(key) of those that have gone. The same version again replaces what it has written."""
        stamp = lambda rows: rows.withColumn("version", F.lit(version).cast("long"))
        gone = tokens.select(self.key) if removed is None else tokens.select(self.key).union(removed.select(self.key))
        put = lambda rows, name, *by: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", *by).parquet(f"{self.path}/{name}")
        own = stamp(self._postings(tokens)).withColumn("slot", _slot())
        # By ranges of term and key, so that a frequent term makes several files, not one large task.
        put(own.repartitionByRange("slot", "term", self.key).sortWithinPartitions("slot", "term"), "postings", "slot")
        if version:
            put(stamp(gone.distinct()), "changed")
        put(stamp(self._lengths(tokens)), "lengths")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows that are not older than the last change of their key."""
        if not _exists(self.spark, f"{self.path}/changed"):
            return rows
        last = self._read("changed").groupBy(F.col(self.key).alias("_key")).agg(F.max("version").alias("_last"))
        return rows.join(last, (F.col(self.key) == F.col("_key")) & (F.col("version") < F.col("_last")), "left_anti")

    def postings(self, asked: DataFrame | None = None) -> DataFrame:
        """term, key, length and tf (of_posting in general); asked(term): only the folders of these terms are read."""
        rows = self._read("postings")
        if asked is not None:
            slots = [r[0] for r in asked.select(_slot()).distinct().collect()]  # no more than SLOTS numbers
            rows = rows.where(F.col("slot").isin(slots)).join(asked, "term", "left_semi")
        return self._live(rows).select("term", self.key, "length", *self.of_posting)

    def statistics(self) -> DataFrame:
        return self._live(self._read("lengths")).agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))

    def compacted(self, path: str) -> Stored:
        """This index without what has gone, in another folder."""
        new = type(self)(self.spark, path, self.key)
        rows = self.postings().withColumn("version", F.lit(0).cast("long")).withColumn("slot", _slot())
        rows.repartitionByRange("slot", "term", self.key).sortWithinPartitions("slot", "term").write.partitionBy("version", "slot").parquet(f"{path}/postings")
        self._live(self._read("lengths")).select(self.key, "length", F.lit(0).cast("long").alias("version")).write.partitionBy("version").parquet(f"{path}/lengths")
        return new


class Fielded(Stored):
    """An index of several fields, with the places of a word in each; tokens are those of placed(). A length is that of all fields."""

    of_posting = ("field", "places")

    def _postings(self, tokens: DataFrame) -> DataFrame:
        fields = tokens.select(self.key, _length().alias("length"), F.posexplode("words").alias("field", "own"))
        each = fields.select(self.key, "length", "field", F.posexplode("own").alias("place", "term"))
        return each.groupBy("term", self.key, "length", "field").agg(F.array_sort(F.collect_list("place")).alias("places"))

    def _lengths(self, tokens: DataFrame) -> DataFrame:
        return tokens.select(self.key, _length().alias("length"))


def _length() -> Column:
    return F.aggregate("words", F.lit(0).cast("long"), lambda n, own: n + F.size(own))


def placed(passages: DataFrame, *columns: str, key: str = "id", strip_marks: bool = False, fold: bool = False) -> DataFrame:
    """key and the words of each indexed column, in an array for each."""
    return passages.select(key, F.array(*[words(F.col(c), strip_marks, fold) for c in columns]).alias("words"))


def write_index(tokens: DataFrame, path: str, key: str = "id", kind: type[Stored] = Stored) -> Stored:
    stored = kind(tokens.sparkSession, path, key)
    stored.add(tokens, 0)
    return stored


def session_index(tokens: DataFrame, name: str, key: str = "id", kind: type[Stored] = Stored) -> Stored:
    """The index of that name in this session's shared folder; the first call writes it, aside, and puts it there by a rename.

    The tables behind a name must not change during the session.
    """
    spark = tokens.sparkSession
    base = f"{shared_folder(spark)}/indexes"
    own = kind(spark, f"{base}/{sha256(name.encode()).hexdigest()}", key)
    if not own.exists():
        aside = f"{base}/_{uuid4().hex}"
        write_index(tokens, aside, key, kind)
        if not _renamed(spark, aside, own.path) and not own.exists():
            raise OSError(f"{aside} could not become {own.path}")
    return own


def changed_postings(post: DataFrame, removed: DataFrame, added: DataFrame, key: str = "id") -> DataFrame:
    """Postings after documents have gone (removed(key)) and others have come or been replaced (added(key, words))."""
    gone = removed.select(key).union(added.select(key)).distinct()
    return post.join(gone, key, "left_anti").unionByName(postings(added, key))
