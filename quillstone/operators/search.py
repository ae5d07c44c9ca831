"""Search for batches of queries: query building, candidates, authority re-ranking, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import contains_arabic, search_form
from ..sources import bounded, shared_folder
from .bm25 import bm25
from .index import Stored, tokenized, words


def _quoted(value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


# Constants are given as one expression each: parsing that is faster than a call for every value.
def _array(values, kind: str = "string") -> Column:
    return F.expr(f"cast(array({', '.join(map(_quoted, values))}) AS array<{kind}>)")


def _pairs(rules: list[tuple[str, str]]) -> Column:
    return F.expr(f"array({', '.join(f'named_struct({_quoted("k")}, {_quoted(k)}, {_quoted("v")}, {_quoted(v)})' for k, v in rules)})")


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first rule whose substring the text has, or null."""
    return F.get(F.filter(_pairs(rules), lambda r: text.contains(r["k"])), 0)["v"]


def domain(text: Column) -> Column:
    """Of a query: by substring, then by a domain's keywords, in order."""
    keywords = [(k, name) for name, _, _, words_ in fixed.DOMAINS for k in words_]
    return F.coalesce(first_match(F.trim(F.lower(text)), fixed.DOMAIN_SUBSTRINGS + keywords), F.lit("general"))


def topic_terms(text: Column, topics=fixed.TOPIC_TERMS) -> Column:
    """Of a topic: its own terms, else those of the first topic that contains it or that it contains, or null."""
    plain = F.trim(F.lower(text))
    near = F.get(F.filter(_pairs(topics), lambda t: t["k"].contains(plain) | plain.contains(t["k"])), 0)["v"]
    return F.coalesce(F.get(F.filter(_pairs(topics), lambda t: t["k"] == plain), 0)["v"], near)


def preference(name: Column) -> Column:
    """Authority levels that a domain prefers."""
    levels = F.expr(f"map({', '.join(f'{_quoted(n)}, array({", ".join(map(str, own))})' for n, _, own, _ in fixed.DOMAINS)})")
    return levels[F.coalesce(name, F.lit("general"))]


def with_article(terms: Column) -> Column:
    """Each term, and with the article if it has none."""
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.when(t.startswith("ال"), F.array(t)).otherwise(F.array(t, F.concat(F.lit("ال"), t))))))


def built(queries: DataFrame, topics=fixed.TOPIC_TERMS, fold: bool = False) -> DataFrame:
    """qid, domain and clauses (arrays of terms) for queries(qid, text).

    A topic's own terms, if the query is a topic; else those of the first topic that contains it or that it contains;
    both, and Arabic queries, get the article and the domain's terms as alternatives. Any other query is one clause.
    """
    arabic = F.coalesce(topic_terms(F.col("text"), topics), F.when(contains_arabic(F.col("text")), F.trim("text")))
    extra = F.expr(f"map({', '.join(f'{_quoted(n)}, cast(array({", ".join(map(_quoted, terms))}) AS array<string>)' for n, terms, _, _ in fixed.DOMAINS)})")
    asked = queries.where(F.length(F.trim("text")) > 0).select("qid", "text", domain(F.col("text")).alias("domain"), arabic.alias("arabic"))
    alternatives = F.array_distinct(F.concat(with_article(F.filter(F.split("arabic", "\\s+"), lambda t: t != "")), extra[F.col("domain")]))
    clauses = F.when(F.col("arabic").isNotNull(), F.transform(alternatives, lambda a: words(a))).otherwise(F.array(words(F.col("text"), fold=fold)))
    return asked.select("qid", "domain", F.filter(clauses, lambda c: F.size(c) > 0).alias("clauses"))


def rerank(hits: DataFrame, alpha: float = 0.55, preferred: Column | None = None) -> DataFrame:
    """hits(qid, rank, level, ...) with combined_score: alpha of the rank scaled within the query, the rest of authority.

    Where all ranks of a query are equal, their part is 0. A missing level is 5.
    """
    own = Window.partitionBy("qid")
    width = F.max("rank").over(own) - F.min("rank").over(own)
    by_text = (F.max("rank").over(own) - F.col("rank")) / F.when(width < 1e-9, 1.0).otherwise(width)
    level = F.coalesce(F.col("level").cast("int"), F.lit(5))
    scores = F.create_map(*[F.lit(x) for pair in fixed.AUTHORITY_SCORE.items() for x in pair])
    base = F.coalesce(scores[level], F.lit(fixed.OTHER_AUTHORITY_SCORE))
    authority = F.when(F.array_contains(preferred, level), F.least(F.lit(1.0), base + fixed.PREFERENCE_BOOST)).otherwise(base) if preferred is not None else base
    return hits.withColumn("combined_score", F.round(alpha * by_text + (1 - alpha) * authority, 4))


def candidates(hits: DataFrame, limit: int) -> DataFrame:
    """The first of each query by level, then rank, then id."""
    order = Window.partitionBy("qid").orderBy(F.coalesce("level", F.lit(5)), "rank", "id")
    return hits.withColumn("pool", F.row_number().over(order)).where(F.col("pool") <= limit)


def top(ranked: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("combined_score"), "pool")
    return ranked.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def filtered(passages: DataFrame, category: str | None = None, min_authority: int = 1, max_authority: int = 5) -> DataFrame:
    """Predicates that are at their default leave no trace in the plan."""
    if category is not None:
        passages = passages.where(F.col("category") == category)
    if min_authority > 1:
        passages = passages.where(F.col("level") >= min_authority)
    return passages.where(F.col("level") <= max_authority) if max_authority < 5 else passages


def search(
    queries: DataFrame, passages: DataFrame, limit: int = 5, category: str | None = None, max_authority: int = 5, min_authority: int = 1,
    alpha: float = 0.55, indexed: tuple[str, ...] = ("text",), strip_marks: bool = False, stored: Stored | None = None, fold: bool = False,
) -> DataFrame:
    """The best passages(id, level, category, text, ...) for each of queries(qid, text), by BM25 and authority.

    Blank queries have no hits. The pool of each query is its first 4 * limit by authority, then rank, to nine digits, so
    that ties don't hang on the order of a sum. stored: an index of the passages, which are then not tokenised. fold: Latin
    letters are compared without their marks.
    """
    asked = built(queries, fold=fold)
    terms = asked.select("qid", F.posexplode("clauses").alias("clause", "terms")).select("qid", "clause", F.explode("terms").alias("term"))
    ranks = bm25(terms, stored or tokenized(passages, *indexed, strip_marks=strip_marks, fold=fold)).withColumn("rank", F.round("rank", 9))
    # Hits have the level alone until the best are known; then the rest of their passages is fetched, by all that tells a passage from others.
    known = filtered(passages, category, min_authority, max_authority).withColumn("_row", F.xxhash64(*passages.columns))
    hits = ranks.join(known.select("id", "level", "_row"), "id")
    pool = candidates(hits, 4 * limit).join(asked.select("qid", "domain"), "qid")
    shared_folder(passages.sparkSession)
    best = top(rerank(pool, alpha, preference(F.col("domain"))), limit).drop("level").checkpoint()
    # The best go to every task if they are few, so that no text is shuffled but theirs.
    return bounded(best).join(known, ["id", "_row"]).drop("_row").dropDuplicates(["qid", "position"])


def search_by_authority(queries: DataFrame, passages: DataFrame, limit: int = 5, max_authority: int = 3, **options) -> DataFrame:
    return search(queries, passages, limit=limit, max_authority=max_authority, **options)


def ordered_search(queries: DataFrame, passages: DataFrame, limit: int = 3, school: str = "shafii", least: int = 40, topics=fixed.TOPIC_TERMS) -> DataFrame:
    """The second search, for passages(id, text, school, grade, ...): all terms must match; order is school, grade, rank (to nine digits)."""
    text = F.coalesce(topic_terms(F.col("text"), topics), search_form(F.col("text"), drop_other=False))
    terms = queries.select("qid", F.lit(0).alias("clause"), F.explode(words(text)).alias("term"))
    hits = bm25(terms, tokenized(passages, "text")).join(passages.where(F.length("text") >= least), "id")
    order = Window.partitionBy("qid").orderBy(F.when(F.col("school") == school, 0).otherwise(1), grade_order(F.col("grade")), F.round("rank", 9), "id")
    return hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def grade_order(grade: Column) -> Column:
    return F.coalesce(*[F.when(grade == g, F.lit(i)) for i, g in enumerate(fixed.LEVEL_ORDER)], F.lit(fixed.LEVEL_ORDER_OTHER))


def joined_passages(hits: DataFrame, most: int = 400) -> DataFrame:
    """qid, reasoning (the passages' heads) and confidence for hits(qid, position, book, chapter, text, grade)."""
    head = F.concat(F.lit("["), F.col("book"), F.lit(" — "), F.col("chapter"), F.lit("]\n"), F.substring("text", 1, most))
    each = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("position", head.alias("head"), "grade"))).alias("all"))
    sure = F.col("all")[0]["grade"].isin(fixed.LEVEL_ORDER[:4])
    return each.select("qid", F.array_join(F.transform("all", lambda x: x["head"]), "\n\n---\n\n").alias("reasoning"), F.when(sure, "medium").otherwise("low").alias("confidence"))


def corpus_stats(passages: DataFrame, books: DataFrame | None = None) -> dict[str, DataFrame]:
    """Totals, and counts by category and by level."""
    total = passages.agg(F.count("*").alias("n_passages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("total_chars"))
    out = {
        "total": total,
        "by_category": passages.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category"),
        "by_authority": passages.groupBy("level").agg(F.count("*").alias("n")).orderBy("level"),
    }
    if books is not None:
        out["books"] = books.orderBy("level", "slug")
    return out


def index_available(spark: SparkSession, *tables: str) -> bool:
    return all(spark.catalog.tableExists(t) for t in tables)
