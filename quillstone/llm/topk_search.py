"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights. Candidates and queries are dealt by a hash of their content to blocks of a
bounded size, and every query block meets every candidate block. For each term (component) the candidate block holds
postings (rows, weights); the block's queries scatter the weighted postings into a dense array of scores. A partition
selection keeps the best of each block, and the blocks' lists are merged by rank.

Defined results: vectors that are null, or hold null or non-finite components, take no part. Vectors of different
lengths are multiplied over the components that both have. A row with a repeated id is a candidate of its own; only the
query's own row is left out. Equal scores go to the smaller id. Products are exact; scores beyond 64-bit integers are held at the ends of
their range, and ranked there. Ids that are null take no part. An empty table gives an empty result. Columns besides the id and the vector are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, with_code

#: Rows of a block of candidates and of queries, about.
CANDIDATE_BLOCK, QUERY_BLOCK = 2048, 512
#: Queries that are scored at once, so that the scores stay in the cache.
CHUNK = 64
LONG = np.iinfo(np.int64)
K, QUERY_EVERY = 20, 20


def postings(block: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term, the rows that have it (None: a weight for every row, as at least a quarter has it) and their weights."""
    out = []
    for column in block.T:
        rows = np.flatnonzero(column)
        out.append((None, np.ascontiguousarray(column)) if 4 * len(rows) >= len(column) else (rows, column[rows]))
    return out


def accumulate(queries: np.ndarray, candidates: list[tuple[np.ndarray | None, np.ndarray]], n: int) -> np.ndarray:
    """Scores by query and candidate, term at a time."""
    scores = np.zeros((len(queries), n), queries.dtype)
    part = np.empty_like(scores)
    for term, (rows, weights) in enumerate(candidates):
        if term >= queries.shape[1]:
            break
        weight = queries[:, term, None]
        if not weight.any() or not len(weights):
            continue
        if rows is None:
            scores += np.multiply(weight, weights, out=part)
        else:
            scores[:, rows] += weight * weights
    return scores


def dense(vectors: pd.Series) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.result_type(np.int64, *{v.dtype for v in vectors}))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if out.dtype == np.int64 or np.abs(out).max(initial=0) < 2**62:
        return out.astype(np.int64)
    most = np.finfo(np.float64).max
    return np.frompyfunc(int, 1, 1)(np.clip(out, -most, most))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], ~scores[kept]))[:k]]  # ~ has the order of -, without its overflow


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> dict[str, list]:
    """The k best candidates of this block for each query of this block."""
    out: dict[str, list] = {"uid": [], "query_id": [], "self_score": [], "vec_ids": [], "scores": []}
    if len(queries) and len(candidates):
        q, c = dense(queries["vector"]), dense(candidates["vector"])
        bound = lambda a: max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))
        squares = (q.astype(object) if bound(q) ** 2 * q.shape[1] > LONG.max else q) ** 2
        most = bound(q) * bound(c) * max(1, min(q.shape[1], c.shape[1]))
        wide = most > LONG.max or object in (q.dtype, c.dtype)
        if wide:
            q, c = q.astype(object), c.astype(object)
        elif most < 2**31:
            q, c = q.astype(np.int32), c.astype(np.int32)
        held = lambda a: np.clip(a, LONG.min, LONG.max).astype(np.int64) if wide else a.astype(np.int64)
        own = np.clip(squares.sum(axis=1), LONG.min, LONG.max).astype(np.int64)
        ids, lists = candidates["vec_id"].to_numpy(np.int64), postings(c)
        for start in range(0, len(q), CHUNK):
            scores = held(accumulate(q[start : start + CHUNK], lists, len(c)))
            for i, row in enumerate(scores, start):
                top = best(ids, row, k)
                out["uid"].append(queries["uid"].iat[i])
                out["query_id"].append(queries["vec_id"].iat[i])
                out["self_score"].append(own[i])
                out["vec_ids"].append(ids[top])
                out["scores"].append(row[top])
    return out


def search(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row of vectors(vec_id long, vector array<long>, or array<double> of whole numbers) whose id is divisible by query_every."""
    spark = vectors.sparkSession
    with_code(spark)
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where("vec_id is not null and vector is not null")
    n, n_queries = vectors.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(query_every)) == 0)).first()
    across, down = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_queries / query_block))
    deal = known.withColumn("at", F.xxhash64("vec_id", "vector"))
    # Both sides' block numbers have one type: Spark hashes an int and a long of the same value to different partitions.
    candidates = deal.select("vec_id", "vector", F.pmod("at", F.lit(across)).cast("int").alias("across"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"))
    # A query row's id within this search: rows are read in the same order whenever a task is tried again.
    asked = deal.where(F.pmod("vec_id", F.lit(query_every)) == 0).withColumn("uid", F.monotonically_increasing_id())
    queries = asked.select("uid", "vec_id", "vector", F.pmod(F.shiftright("at", 20), F.lit(down)).cast("int").alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = search_block(left.to_pandas(), right.to_pandas(), k + 1)
        return pa.table({c: pa.array(rows[c], pa.list_(pa.int64()) if c in ("vec_ids", "scores") else pa.int64()) for c in rows})

    schema = "uid long, query_id long, self_score long, vec_ids array<long>, scores array<long>"
    found = queries.groupBy("across", "down").cogroup(candidates.groupBy("across", "down")).applyInArrow(run, schema)
    each = found.select("uid", "query_id", "self_score", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).select("uid", "query_id", "self_score", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    merged = each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    # The query's own row has its id and its score; of rows that agree in both, any one may be left out.
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self_score")), F.col("at"))).over(Window.partitionBy("uid"))
    ranked = merged.withColumn("own", own).where("own is null or at <> own").withColumn("rank", F.col("at") - F.when(F.col("at") > F.col("own"), 1).otherwise(0))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """floor(scale * x) of each component; vectors that take no part become null."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # As doubles, which hold the whole number for any component; from 2**53 on a double is its own floor.
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)
    return embeddings.select("vec_id", F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: whole(v.cast("double") * scale))).alias("vector"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(integer_vectors(table(spark, sf_dir, "embeddings")))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, 65), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
