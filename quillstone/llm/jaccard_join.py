"""N-gram Jaccard join: MinHash banding.

Texts with the same set of word n-grams form a class; classes are hashed to bands, and classes that meet in a bucket are
candidates. Candidates are verified on their full n-gram sets, in blocks of a bounded size: first all pairs of a cluster
(classes that share several buckets with a leader), each pair once however many buckets it shares; then the pairs of a
bucket that no cluster holds together, each in the first band that it shares. Only counts of links and one link to a
root leave a block, never its pairs. Verified links make the groups.

Defined results: a null or empty text, or one of white space alone, has no n-grams, no links and a class of its own. A
text of 1 to 4 words has one n-gram, of all of them. Copies are links of one another. Rows that are repeated are copies.
Class ids are the smallest doc_id of the group; null doc_ids are left out of that. An empty table gives an empty result.
Columns of any name may stand beside doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, table, with_checkpoints, with_code
from .components import components
from .shingles import WORDS, MinHash, choose_bands, set_key, sets, texts_of

#: Pairs are links at this similarity, as a fraction: 4 / 5.
NUMERATOR, DENOMINATOR = 4, 5
#: Share of the pairs at the threshold that banding must find.
RECALL = 0.9999
#: Classes that share so many buckets with a leader form its cluster.
SHARED = 3
#: Classes and n-grams of a block, about.
BLOCK, BLOCK_NGRAMS = 512, 1_000_000
#: N-gram sets with the most documents, and buckets and units with the most classes, that go to every task where documents and classes meet them.
HOT = 1024
#: Columns of a block's table of classes by n-grams that are multiplied at once.
COLUMNS = 2048


def keyed(text: str = "text") -> Column:
    """The 128-bit name of the text's n-gram set; null for an empty one."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([set_key(s) for s in sets(texts_of(texts))], pa.binary())

    return of(text)


def classes_of(documents: DataFrame, bands: int, rows: int) -> DataFrame:
    """A row for each distinct n-gram set: node, key, doc_id (the smallest), copies, n (n-grams), bands and the compressed text of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, press = MinHash(bands, rows), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = texts_of(batch.column(1))
            out: list[tuple] = []
            for doc_id, text, one in zip(batch.column(0).to_pylist(), texts, sets(texts), strict=True):
                if len(one):
                    out.append((set_key(one), doc_id, len(one), hashed(one), press.compress(text)))
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["key", "doc_id", "n", "bands", "text"])

    each = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key binary, doc_id long, n long, bands array<long>, text binary")
    one = each.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first(F.struct("n", "bands", "text")).alias("x"))
    return one.select(F.monotonically_increasing_id().alias("node"), "key", "doc_id", "copies", "x.n", "x.bands", "x.text").checkpoint()


def similar(hashes: list[np.ndarray], numerator: int, denominator: int) -> np.ndarray:
    """Whether each pair of sets has at least the similarity."""
    n = np.array([len(x) for x in hashes], np.int64)
    _, column, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(hashes)), n)
    common = np.zeros((len(hashes), len(hashes)), np.float32)
    kept = count[column] > 1  # what only one set has is in no intersection
    row, column = row[kept], column[kept]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    _, column = np.unique(column, return_inverse=True)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = np.zeros((len(hashes), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - k * COLUMNS] = 1
        common += part @ part.T
    # common / (n + n - common) >= numerator / denominator, in whole numbers
    out = common.astype(np.int64) * (numerator + denominator) >= numerator * (n[:, None] + n[None, :])
    np.fill_diagonal(out, False)
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """For each row the smallest row that it is connected with."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] < 0:
            seen, new = np.zeros(len(links), bool), np.zeros(len(links), bool)
            new[i] = True
            while new.any():
                seen |= new
                new = links[new].any(axis=0) & ~seen
            root[seen] = i
    return root


def verify_unit(unit: pd.DataFrame, hashes: list[np.ndarray], numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row, copies counted, and the row that it hangs on; unit: the rows of one cluster or bucket in one block pair."""
    links = similar(hashes, numerator, denominator)
    side, first = unit["side"].to_numpy(), unit.iloc[0]
    if first["bi"] != first["bj"]:
        links &= side[:, None] != side[None, :]
    if first["bucket"]:
        cluster, bands = unit["cluster"].to_numpy(), np.array(unit["bands"].tolist())
        links &= cluster[:, None] != cluster[None, :]
        # Pairs that share an earlier band are verified there. All rows have this bucket in the same band.
        for k in range(int(np.argmax(bands[0] == first["unit"]))):
            links &= bands[:, k, None] != bands[None, :, k]
    return links @ unit["copies"].to_numpy(), roots(links)


def verified(units: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """node, root and links for each row of units(bin, bi, bj, side, bucket, unit, cluster, node, copies, bands, text)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        expand = zstandard.ZstdDecompressor()
        out = []
        for _, unit in rows.groupby(["bucket", "unit"], sort=False):
            if len(unit) > 1:
                # The order decides which row is a root.
                unit = unit.sort_values("node")
                links, root = verify_unit(unit, list(sets([expand.decompress(t) for t in unit["text"]])), numerator, denominator)
                node = unit["node"].to_numpy()
                out.append(pd.DataFrame({"node": node, "root": node[root], "links": links}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "root": [], "links": []}, dtype="int64")

    return units.groupBy("bin", "bi", "bj").applyInPandas(run, "node long, root long, links long")


def blocked(members: DataFrame, sizes: DataFrame, n_bins: int, block: int, block_ngrams: int) -> DataFrame:
    """members(bucket, unit, node, n, ...) dealt to bins: small units share one, a large one has a bin for each pair of its blocks."""
    # The largest units go to every task, so that the members of one are not all in one; those without a size are alone in their unit.
    named, key = members.withColumn("key", F.struct("bucket", "unit")), F.struct("bucket", "unit").alias("key")
    sized = sizes.select(key, "rows", "ngrams")
    counted = spread_join(named, sized, "key", sized.orderBy(F.desc("rows"), "key").limit(HOT), F.pmod(F.xxhash64("node"), F.lit(1_000_003))).where("rows is not null")
    blocks = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("ngrams") / block_ngrams)).cast("int")
    dealt = counted.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bin_ = F.when(F.col("blocks") > 1, F.xxhash64("bucket", "unit")).otherwise(F.pmod(F.xxhash64("bucket", "unit"), F.lit(n_bins)))
    return pairs.select(bin_.alias("bin"), F.least("b", "other").alias("bi"), F.greatest("b", "other").alias("bj"), F.col("b").alias("side"), "bucket", "unit", "cluster", "node")


def groups(documents: DataFrame, n_words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, recall: float = RECALL, block: int = BLOCK, block_ngrams: int = BLOCK_NGRAMS) -> DataFrame:
    """A row for each distinct n-gram set of documents(doc_id, text): key, doc_id, copies, links (to other sets, copies counted), component and class_id."""
    if n_words != WORDS:
        raise ValueError("n-grams have five words")
    spark = documents.sparkSession
    with_code(spark)
    with_checkpoints(spark)
    bands, rows = choose_bands(numerator / denominator, recall)
    classes = classes_of(documents, bands, rows)

    met = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = met.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("rows")).where("rows > 1").checkpoint()
    # The buckets with the most classes go to every task, so that their classes meet them in many.
    met = spread_join(met, buckets.select("bucket", "leader"), "bucket", buckets.orderBy(F.desc("rows"), "bucket").limit(HOT)).where("leader is not null").checkpoint()
    follows = met.groupBy("node", "leader").agg(F.count("*").alias("n"))
    clusters = components(follows.select(F.col("node").alias("a"), F.when(F.col("n") >= SHARED, F.col("leader")).otherwise(F.col("node")).alias("b")).distinct()).withColumnRenamed("component", "cluster").checkpoint()

    # Units to verify: clusters, and buckets in which several clusters meet.
    sized = clusters.join(classes.select("node", "n"), "node")
    of_cluster = sized.select(F.lit(False).alias("bucket"), F.col("cluster").alias("unit"), "cluster", "node", "n")
    placed = met.select("bucket", "node").join(sized, "node")
    several = placed.groupBy("bucket").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b"), F.count("*").alias("rows")).where("a <> b")
    shared = spread_join(placed, several.select("bucket", "a"), "bucket", several.orderBy(F.desc("rows"), "bucket").limit(HOT), F.pmod(F.xxhash64("node"), F.lit(1_000_003))).where("a is not null")
    of_bucket = shared.select(F.lit(True).alias("_b"), F.col("bucket").alias("unit"), "cluster", "node", "n").withColumnRenamed("_b", "bucket").checkpoint()
    members = of_cluster.unionByName(of_bucket)
    sizes = members.groupBy("bucket", "unit").agg(F.count("*").alias("rows"), F.sum("n").alias("ngrams")).where("rows > 1").checkpoint()
    n_rows, n_grams = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    units = blocked(members, sizes, max(1, -(-n_grams // block_ngrams), -(-n_rows // block)), block, block_ngrams)
    units = units.join(classes.select("node", "copies", "bands", "text"), "node")
    found = verified(units, numerator, denominator).groupBy("node", "root").agg(F.sum("links").alias("links")).checkpoint()

    grouped = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.select("node", "key", "doc_id", "copies").join(links, "node", "left").join(grouped, "node", "left")
    joined = joined.withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return joined.join(least, "component").select("key", "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), "component", "class_id").checkpoint()


def join(documents: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links and n_copies (of its own n-gram set) for each document."""
    found = groups(documents, **options).select(F.col("key").alias("_key"), "copies", "links", "class_id")
    # The n-gram sets with the most documents go to every task, so that their documents are joined in many.
    told = spread_join(documents.select("doc_id", keyed().alias("_key")), found, "_key", found.orderBy(F.desc("copies"), "_key").limit(HOT))
    others = F.coalesce(F.col("copies"), F.lit(1)) - 1
    return told.select("doc_id", F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"), (F.coalesce("links", F.lit(0)) + others).alias("n_links"), others.alias("n_copies"))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One document of each group, with all its columns; documents without n-grams stay."""
    found = groups(documents, **options)
    best = found.groupBy("component").agg(F.min_by("key", F.struct("doc_id", "key")).alias("_key")).select("_key")
    rows = documents.select(F.struct("*").alias("_row"), keyed().alias("_key"), F.col("doc_id").alias("_id"))
    one = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min_by("_row", F.struct(F.col("_id").isNull(), "_id")).alias("_row")).join(best, "_key", "left_semi")
    return one.select("_row.*").unionByName(rows.where(F.col("_key").isNull()).select("_row.*"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
