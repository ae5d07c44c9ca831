"""Queries with phrases and fields over a stored index that has the places of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import bounded
from .bm25 import B, K1, ranked
from .index import Fielded, words

TOKEN = '(?:[A-Za-z_]+:)?(?:"[^"]*"|[^\\s"]+)'


def parsed(queries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """qid, clause, term, field (its number; null: all) and words of each phrase, for queries(qid, text).

    "a b" is a phrase: its words in this order, side by side, in one field. Any other word is a phrase of one word. field: before
    a word or a phrase asks one field alone; a name that is no field is a word. A clause is all phrases up to the next OR. What
    has no word is left out, so a query without words has no rows, nor has a null text. term names the phrase and its field.
    """
    each = queries.select("qid", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("all")).select("qid", "all", F.posexplode("all").alias("i", "token"))
    clause = F.size(F.filter(F.slice("all", F.lit(1), F.col("i")), lambda t: t == "OR"))
    place = F.array_position(F.array(*map(F.lit, fields)), F.regexp_extract("token", "^([A-Za-z_]+):", 1)).cast("int") - 1
    asked = each.where("token <> 'OR'").select("qid", clause.alias("clause"), F.when(place >= 0, place).alias("field"), "token")
    rest = F.when(F.col("field").isNull(), F.col("token")).otherwise(F.regexp_replace("token", "^[A-Za-z_]+:", ""))
    own = words(rest)
    phrases = F.when(rest.startswith('"'), F.array(own)).otherwise(F.transform(own, lambda w: F.array(w)))
    split = asked.select("qid", "clause", "field", F.explode(phrases).alias("words")).where(F.size("words") > 0)
    return split.select("qid", "clause", F.concat_ws(":", F.coalesce(F.col("field").cast("string"), F.lit("")), F.array_join("words", " ")).alias("term"), "field", "words")


def phrase_postings(phrases: DataFrame, source: Fielded) -> DataFrame:
    """term, key, length and tf of phrases(term, field, words), distinct. Only the folders of their words are read.

    Each word's places, moved back by its place in the phrase, are where the phrase would start; it starts where all agree.
    The places of a document's words meet in one row, whose size is bounded by the document's length.
    """
    parts = phrases.select("term", "field", F.size("words").alias("needed"), F.posexplode("words").alias("offset", "word"))
    found = source.postings(bounded(parts.select(F.col("word").alias("term")).distinct())).withColumnRenamed("term", "word").withColumnRenamed("field", "own")
    met = found.join(bounded(parts), "word").where(F.col("field").isNull() | (F.col("field") == F.col("own")))
    starts = F.collect_list(F.transform("places", lambda p: p - F.col("offset")))
    whole = met.groupBy("term", source.key, "length", "own", "needed").agg(starts.alias("starts")).where(F.size("starts") == F.col("needed"))
    agreed = F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)), lambda so_far, more: F.array_intersect(so_far, more))
    return whole.select("term", source.key, "length", F.size(agreed).cast("long").alias("n")).where("n > 0").groupBy("term", source.key, "length").agg(F.sum("n").alias("tf"))


def phrase_search(queries: DataFrame, source: Fielded, fields: tuple[str, ...], k1: float = K1, b: float = B) -> DataFrame:
    """qid, key and rank for queries(qid, text) by BM25, where a phrase counts like a term. Lengths are those of all fields together."""
    items = parsed(queries, fields)
    found = phrase_postings(items.select("term", "field", "words").distinct(), source)
    return ranked(items.select("qid", "clause", "term"), found, source.statistics(), source.key, k1, b)
