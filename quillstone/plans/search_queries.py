"""Full-text search and re-ranking over documents: source number gives an authority level, lang a category."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import bm25 as B
from ..operators import index, phrases, search
from ..sources import literal_rows, table
from .seeds import sql_rows

# (qid, clause, term): any of, all of, and mixed.
ANY = [(1, 0, "eation"), (1, 1, "hant"), (1, 2, "pathetic"), (2, 0, "unglich"), (2, 1, "verst"), (2, 2, "verst"), (3, 0, "the")]
ALL = [(1, 0, "hein"), (1, 0, "eriner"), (2, 0, "und"), (2, 0, "die"), (3, 0, "tioning"), (3, 0, "nosuchword")]
DNF = [(1, 0, "hein"), (1, 0, "onon"), (1, 1, "pathetic"), (2, 0, "una"), (2, 1, "ouque"), (2, 1, "de"), (2, 1, "ouque")]


def passages(spark: SparkSession, d: str) -> DataFrame:
    level = 1 + F.substring("source", 4, 9).cast("int") % 5
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), level.alias("level"), F.col("lang").alias("category"), "source", "text")


def asked(spark: SparkSession, rows: list) -> DataFrame:
    return literal_rows(spark, rows, "qid int, clause int, term string")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return index.tokenized(passages(spark, d), "text")


def token_stats(spark, d):
    each = index.tokenized(passages(spark, d), "text").join(passages(spark, d).select("id", "category"), "id")
    words = each.select("category", F.explode("words").alias("term")).groupBy("category").agg(F.count("*").alias("n_tokens"), F.count_distinct("term").alias("n_terms"))
    return words.join(each.groupBy("category").agg(F.count("*").alias("n_docs")), "category")


def doc_freq_topk(spark, d):
    return index.document_frequency(index.postings(tokens(spark, d))).orderBy(F.desc("df"), "term").limit(50)


def _rounded(ranks: DataFrame) -> DataFrame:
    return ranks.select("qid", F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


def bm25_or(spark, d):
    return _rounded(B.bm25(asked(spark, ANY), tokens(spark, d)))


def bm25_and(spark, d):
    return _rounded(B.bm25(asked(spark, ALL), tokens(spark, d)))


def bm25_dnf(spark, d):
    return _rounded(B.bm25(asked(spark, DNF), tokens(spark, d)))


def _pool(spark, d, limit=20):
    return search.candidates(B.bm25(asked(spark, ANY), tokens(spark, d)).withColumn("rank", F.round("rank", 6)).join(passages(spark, d), "id"), limit)


def bm25_candidates_by_authority(spark, d):
    return _pool(spark, d).select("qid", F.col("id").alias("doc_id"), "level", "rank", F.col("pool").cast("long").alias("pool"))


def _reranked(alpha):
    def run(spark, d):
        best = search.top(search.rerank(_pool(spark, d), alpha, F.array(F.lit(2), F.lit(3))), 5)
        return best.select("qid", F.col("id").alias("doc_id"), "level", "combined_score", F.col("position").cast("long").alias("position"))

    return run


def authority_filtered_search(spark, d):
    hits = B.bm25(asked(spark, ANY), tokens(spark, d)).join(search.filtered(passages(spark, d), "en", 2, 4), "id")
    return hits.groupBy("qid", "level").agg(F.count("*").alias("n"), F.round(F.min("rank"), 6).alias("best_rank"))


def multi_query_search(spark, d):
    """Any of the words of each benchmark item, among whole documents."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), index.words(F.col("text")).alias("words"))
    hits = B.bm25(B.any_of(queries), tokens(spark, d)).withColumn("rank", F.round("rank", 6)).join(passages(spark, d), "id")
    best = search.top(search.rerank(search.candidates(hits, 20)), 5)
    return best.select("qid", F.col("id").alias("doc_id"), "level", "combined_score", F.col("position").cast("long").alias("position"))


def case_ordered_topk(spark, d):
    """Documents as passages of graded books; the second search's order."""
    n = F.substring("source", 4, 9).cast("int")
    grades = F.element_at(F.array(*map(F.lit, [*fixed.LEVEL_ORDER, "other"])), (n % 7 + 1))
    rows = passages(spark, d).withColumn("school", F.when(n % 2 == 0, "shafii").otherwise("other")).withColumn("grade", grades)
    queries = literal_rows(spark, [(1, "eriner hein"), (2, "und die"), (3, "the and")], "qid int, text string")
    return search.ordered_search(queries, rows).select("qid", F.col("id").alias("doc_id"), "school", "grade", F.col("position").cast("long").alias("position"))


# Documents get Arabic words by their number, for queries that are topics, hold one, are Arabic or are plain.
ARABIC = ["", "باب الوضوء", "كتاب الصلاة", "زكاة الفطر", "النكاح والطلاق", "الطهارة من النجاسة", "البيع", "صوم رمضان"]
KITAB = [(1, "wudhu"), (2, "zakat_fitrah"), (3, " Shalat "), (4, "hukum jual beli"), (5, "الصلاة"), (6, "puasa ramadhan"), (7, "und die"), (8, "nikah siri"), (9, "  "), (10, "زكاة"), (11, "nosuchword")]


def kitab_passages(spark, d):
    word = F.element_at(F.array(*map(F.lit, ARABIC)), (F.pmod("id", F.lit(len(ARABIC))) + 1).cast("int"))
    return passages(spark, d).withColumn("text", F.concat_ws(" ", "text", word))


def _kitab(**options):
    def run(spark, d):
        found = search.search(literal_rows(spark, KITAB, "qid int, text string"), kitab_passages(spark, d), **options)
        return found.select("qid", F.col("id").alias("doc_id"), "level", "combined_score", F.col("position").cast("long").alias("position"))

    return run


def kitab_search_by_authority(spark, d):
    found = search.search_by_authority(literal_rows(spark, KITAB, "qid int, text string"), kitab_passages(spark, d))
    return found.select("qid", F.col("id").alias("doc_id"), "level", "combined_score", F.col("position").cast("long").alias("position"))


def stored_kitab_search(spark, d):
    """kitab_search by a stored index, which the first call in a session writes."""
    stored = index.session_index(index.tokenized(kitab_passages(spark, d), "text"), f"kitab {d}")
    return _kitab(stored=stored)(spark, d)


# (qid, text); the same as (qid, clause, field or None, words), for SQL.
PHRASES = [(1, '"the and"'), (2, '"and the"'), (3, '"of the" is'), (4, '"le de" OR "the is the" OR und die'), (5, '"the the the"'), (6, '"the the" "the the"'), (7, '"nosuchword the"'), (8, '""'), (9, "The, AND?")]
PHRASE_ITEMS = [
    (1, 0, None, "the and"), (2, 0, None, "and the"), (3, 0, None, "of the"), (3, 0, None, "is"), (4, 0, None, "le de"), (4, 1, None, "the is the"), (4, 2, None, "und"), (4, 2, None, "die"),
    (5, 0, None, "the the the"), (6, 0, None, "the the"), (6, 0, None, "the the"), (7, 0, None, "nosuchword the"), (9, 0, None, "the"), (9, 0, None, "and"),
]
FIELDED = [(1, "src7"), (2, "source:src3 the"), (3, "text:src7"), (4, 'category:de OR source:"src5"'), (5, 'text:"of the" category:en'), (6, "category:de source:src1 OR nofield:the"), (7, "en")]
FIELDED_ITEMS = [
    (1, 0, None, "src7"), (2, 0, 1, "src3"), (2, 0, None, "the"), (3, 0, 0, "src7"), (4, 0, 2, "de"), (4, 1, 1, "src5"), (5, 0, 0, "of the"), (5, 0, 2, "en"),
    (6, 0, 2, "de"), (6, 0, 1, "src1"), (6, 1, None, "nofield"), (6, 1, None, "the"), (7, 0, None, "en"),
]
FIELDS = ("text", "source", "category")


def _phrases(queries):
    def run(spark, d):
        stored = index.session_index(index.placed(passages(spark, d), *FIELDS), f"fields {d}", kind=index.Fielded)
        return _rounded(phrases.phrase_search(literal_rows(spark, queries, "qid int, text string"), stored, FIELDS))

    return run


def second_search_passages(spark, d):
    """The second search's hits as one text a query."""
    n = F.substring("source", 4, 9).cast("int")
    grades = F.element_at(F.array(*map(F.lit, [*fixed.LEVEL_ORDER, "other"])), (n % 7 + 1))
    rows = passages(spark, d).withColumn("school", F.when(n % 2 == 0, "shafii").otherwise("other")).withColumn("grade", grades)
    queries = literal_rows(spark, [(1, "eriner hein"), (2, "und die"), (3, "the and")], "qid int, text string")
    hits = search.ordered_search(queries, rows).select("qid", "position", F.col("source").alias("book"), F.col("category").alias("chapter"), "text", "grade")
    return search.joined_passages(hits)


def domain_detect(spark, d):
    said = table(spark, d, "conversations").where("role = 'user'")
    name = F.concat(F.col("text"), F.when(F.col("conv_id") % 3 == 0, " wudhu").when(F.col("conv_id") % 3 == 1, " Nisab sai"). otherwise(""))
    return said.select("conv_id", "turn", search.domain(name).alias("domain"))


def corpus_stats_total(spark, d):
    return search.corpus_stats(passages(spark, d))["total"]


def corpus_stats_by_category(spark, d):
    return search.corpus_stats(passages(spark, d))["by_category"]


def corpus_stats_by_authority(spark, d):
    return search.corpus_stats(passages(spark, d))["by_authority"]


QUERIES = {
    "token_stats": token_stats, "doc_freq_topk": doc_freq_topk, "bm25_or": bm25_or, "bm25_and": bm25_and, "bm25_dnf": bm25_dnf,
    "bm25_candidates_by_authority": bm25_candidates_by_authority, "authority_rerank": _reranked(0.55), "rerank_alpha0": _reranked(0.0), "rerank_alpha1": _reranked(1.0),
    "authority_filtered_search": authority_filtered_search, "multi_query_search": multi_query_search, "case_ordered_topk": case_ordered_topk, "kitab_search": _kitab(), "kitab_search_category": _kitab(category="de", min_authority=2, limit=3), "kitab_search_by_authority": kitab_search_by_authority,
    "stored_kitab_search": stored_kitab_search, "phrase_search": _phrases(PHRASES), "fielded_search": _phrases(FIELDED),
    "second_search_passages": second_search_passages, "domain_detect": domain_detect,
    "corpus_stats_total": corpus_stats_total, "corpus_stats_by_category": corpus_stats_by_category, "corpus_stats_by_authority": corpus_stats_by_authority,
}

_TOK = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents)"
_P = "p AS (SELECT doc_id, 1 + substr(source, 4)::INT % 5 AS level, lang AS category, source, text FROM documents)"
_RANKS = """post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS nd, (SELECT count(*) FROM tok) / (SELECT count(*) FROM documents) AS av),
df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
sc AS (SELECT post.term, post.doc_id, (CASE WHEN ln((nd - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((nd - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len.n / av)) AS s
  FROM post JOIN len USING (doc_id) JOIN df USING (term), st),
need AS (SELECT qid, clause, count(DISTINCT term) AS needed FROM q GROUP BY ALL),
cl AS (SELECT qid, clause, doc_id, count(DISTINCT q.term) AS n, sum(s) AS s FROM q JOIN sc USING (term) GROUP BY ALL),
ranks AS (SELECT qid, doc_id, round(-sum(cl.s), 6) AS rank FROM cl JOIN need USING (qid, clause) WHERE cl.n = needed GROUP BY ALL)"""


def _q(rows: list) -> str:
    return f"WITH {sql_rows('q', 'qid, clause, term', rows)}, {_TOK}, {_RANKS}, {_P}"


_POOL = "pool AS (SELECT qid, doc_id, level, rank, row_number() OVER (PARTITION BY qid ORDER BY level, rank, doc_id) AS pool FROM ranks JOIN p USING (doc_id) QUALIFY pool <= 20)"


def _rerank_sql(head: str, alpha: float, preferred: str) -> str:
    base = "CASE level WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 WHEN 4 THEN 0.55 ELSE 0.4 END::DOUBLE"
    auth = f"CASE WHEN level IN ({preferred}) THEN least(1.0::DOUBLE, {base} + 0.15::DOUBLE) ELSE {base} END" if preferred else base
    return f"""{head}, {_POOL},
rr AS (SELECT *, round({alpha}::DOUBLE * (max(rank) OVER w - rank) / (CASE WHEN max(rank) OVER w - min(rank) OVER w < 1e-9 THEN 1.0 ELSE max(rank) OVER w - min(rank) OVER w END)
  + (1 - {alpha}::DOUBLE) * ({auth}), 4) AS combined_score FROM pool WINDOW w AS (PARTITION BY qid))
SELECT qid, doc_id, level, combined_score, row_number() OVER (PARTITION BY qid ORDER BY combined_score DESC, pool) AS position FROM rr QUALIFY position <= 5"""


_LEVELS = ", ".join(f"'{x}'" for x in [*fixed.LEVEL_ORDER, "other"])
_ORDERED = [(1, 0, "eriner"), (1, 0, "hein"), (2, 0, "und"), (2, 0, "die"), (3, 0, "the"), (3, 0, "and")]


def _first(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains(t, '{k.replace(chr(39), chr(39) * 2)}') THEN '{v}'" for k, v in rules) + " ELSE 'general' END"


def _clauses(text: str) -> list[list[str]]:
    """The clauses of a query, in plain Python."""
    plain = text.strip(" ").lower()
    if not plain:
        return []
    topics = dict(fixed.TOPIC_TERMS)
    near = [t for k, t in fixed.TOPIC_TERMS if plain in k or k in plain]
    terms = topics.get(plain) or (near[0] if near else text.strip() if any("\u0600" <= c <= "\u06ff" for c in text) else None)
    if terms is None:
        return [re.findall(r"[^\W_]+", plain)]
    article = [x for t in terms.split() for x in ([t] if t.startswith("ال") else [t, "ال" + t])]
    more = next(own for n, own, _, _ in fixed.DOMAINS if n == _domain(plain))
    return [re.findall(r"[^\W_]+", a) for a in dict.fromkeys(article + more)]


def _domain(plain: str) -> str:
    keywords = [(k, n) for n, _, _, own in fixed.DOMAINS for k in own]
    return next((v for k, v in fixed.DOMAIN_SUBSTRINGS + keywords if k in plain), "general")


def _pref(domain: str) -> str:
    return f"CASE {domain} {' '.join(f"WHEN '{n}' THEN {own}" for n, _, own, _ in fixed.DOMAINS)} END"


def ranked_sql(limit: int, where: str = "true") -> str:
    """rr: the pool of each query by authority and rank, with its score; for ranks, p(doc_id, level, category, ...) and pref(qid, levels)."""
    base = "CASE level WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 WHEN 4 THEN 0.55 ELSE 0.4 END::DOUBLE"
    return f"""pool AS (SELECT ranks.qid, doc_id, level, rank, levels, row_number() OVER (PARTITION BY ranks.qid ORDER BY level, rank, doc_id) AS pool FROM ranks JOIN p USING (doc_id) JOIN pref USING (qid) WHERE {where} QUALIFY pool <= {4 * limit}),
rr AS (SELECT *, round(0.55::DOUBLE * (max(rank) OVER w - rank) / (CASE WHEN max(rank) OVER w - min(rank) OVER w < 1e-9 THEN 1.0 ELSE max(rank) OVER w - min(rank) OVER w END)
  + (1 - 0.55::DOUBLE) * (CASE WHEN list_contains(levels, level) THEN least(1.0::DOUBLE, {base} + 0.15::DOUBLE) ELSE {base} END), 4) AS combined_score FROM pool WINDOW w AS (PARTITION BY qid)),
best AS (SELECT qid, doc_id, level, combined_score, row_number() OVER (PARTITION BY qid ORDER BY combined_score DESC, pool) AS position FROM rr QUALIFY position <= {limit})"""


def _kitab_sql(limit: int, where: str = "true") -> str:
    rows = [(qid, i, t) for qid, text in KITAB for i, c in enumerate(_clauses(text)) for t in c]
    prefs = [(qid, next(own for n, _, own, _ in fixed.DOMAINS if n == _domain(text.strip().lower()))) for qid, text in KITAB]
    docs = f"p AS (SELECT doc_id, 1 + substr(source, 4)::INT % 5 AS level, lang AS category, text || ' ' || {ARABIC}[doc_id % {len(ARABIC)} + 1] AS text FROM documents)"
    tok = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM p)"
    return f"""WITH {sql_rows('q', 'qid, clause, term', rows)}, {sql_rows('pref', 'qid, levels', prefs)}, {docs}, {tok}, {RANKS_9}, {ranked_sql(limit, where)} SELECT * FROM best"""


RANKS_9 = _RANKS.replace("sum(cl.s), 6)", "sum(cl.s), 9)")
_SECOND = f"""{_q(_ORDERED).replace("sum(cl.s), 6)", "sum(cl.s), 9)")}, g AS (SELECT doc_id, source, category, text, CASE WHEN substr(source, 4)::INT % 2 = 0 THEN 'shafii' ELSE 'other' END AS school, substr(source, 4)::INT % 7 AS o FROM p),
best AS (SELECT qid, source, category, text, o, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN school = 'shafii' THEN 0 ELSE 1 END, CASE WHEN o = 6 THEN 9 ELSE o END, rank, doc_id) AS position FROM ranks JOIN g USING (doc_id) WHERE length(text) >= 40 QUALIFY position <= 3)
SELECT qid, string_agg('[' || source || ' — ' || category || ']' || chr(10) || substr(text, 1, 400), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS reasoning, CASE WHEN arg_min(o, position) < 4 THEN 'medium' ELSE 'low' END AS confidence FROM best GROUP BY qid"""



def _phrases_sql(items: list) -> str:
    """A phrase is sought at every place of each field."""
    rows = ", ".join(f"({q}, {c}, {'NULL' if f is None else f}, '{f}:{p}', {p.split()})" for q, c, f, p in items)
    cut = lambda column: rf"regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}]+')"
    weight = "ln((nd - df + 0.5) / (df + 0.5))"
    return f"""WITH q(qid, clause, fd, term, ph) AS (VALUES {rows}),
f AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS field, {cut(c)} AS w FROM documents" for i, c in enumerate(("text", "source", "lang")))}),
len AS (SELECT doc_id, sum(len(w)) AS n FROM f GROUP BY ALL), st AS (SELECT count(*) AS nd, sum(n) / count(*) AS av FROM len),
post AS (SELECT term, doc_id, sum(len(list_filter(range(1, len(w) - len(ph) + 2), lambda i: w[i:i + len(ph) - 1] = ph))) AS tf FROM (SELECT DISTINCT fd, term, ph FROM q) JOIN f ON fd IS NULL OR fd = field GROUP BY ALL HAVING tf > 0),
df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
sc AS (SELECT term, doc_id, (CASE WHEN {weight} <= 0 THEN 1e-6 ELSE {weight} END) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len.n / av)) AS s FROM post JOIN df USING (term) JOIN len USING (doc_id), st),
need AS (SELECT qid, clause, count(DISTINCT term) AS needed FROM q GROUP BY ALL),
cl AS (SELECT qid, clause, doc_id, count(DISTINCT term) AS n, sum(s) AS s FROM q JOIN sc USING (term) GROUP BY ALL)
SELECT qid, doc_id, round(-sum(cl.s), 6) AS rank FROM cl JOIN need USING (qid, clause) WHERE cl.n = needed GROUP BY ALL"""


ORACLE_SQL = {
    "stored_kitab_search": _kitab_sql(5), "phrase_search": _phrases_sql(PHRASE_ITEMS), "fielded_search": _phrases_sql(FIELDED_ITEMS),
    "kitab_search": _kitab_sql(5), "kitab_search_category": _kitab_sql(3, "category = 'de' AND level >= 2"), "kitab_search_by_authority": _kitab_sql(5, "level <= 3"), "second_search_passages": _SECOND,
    "token_stats": f"WITH {_TOK}, t AS (SELECT lang AS category, term FROM tok JOIN documents USING (doc_id)), n AS (SELECT lang AS category, count(*) AS n_docs FROM documents GROUP BY ALL) SELECT category, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, any_value(n_docs) AS n_docs FROM t JOIN n USING (category) GROUP BY category",
    "doc_freq_topk": f"WITH {_TOK} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term ORDER BY df DESC, term LIMIT 50",
    "bm25_or": f"{_q(ANY)} SELECT qid, doc_id, rank FROM ranks",
    "bm25_and": f"{_q(ALL)} SELECT qid, doc_id, rank FROM ranks",
    "bm25_dnf": f"{_q(DNF)} SELECT qid, doc_id, rank FROM ranks",
    "bm25_candidates_by_authority": f"{_q(ANY)}, {_POOL} SELECT * FROM pool",
    "authority_rerank": _rerank_sql(_q(ANY), 0.55, "2, 3"),
    "rerank_alpha0": _rerank_sql(_q(ANY), 0.0, "2, 3"),
    "rerank_alpha1": _rerank_sql(_q(ANY), 1.0, "2, 3"),
    "authority_filtered_search": f"{_q(ANY)} SELECT qid, level, count(*) AS n, min(rank) AS best_rank FROM ranks JOIN p USING (doc_id) WHERE category = 'en' AND level BETWEEN 2 AND 4 GROUP BY ALL",
    "multi_query_search": _rerank_sql(rf"WITH bw AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark), q AS (SELECT qid, i AS clause, w[i] AS term FROM (SELECT qid, w, unnest(range(1, len(w) + 1)) AS i FROM bw)), {_TOK}, {_RANKS}, {_P}", 0.55, ""),
    "case_ordered_topk": f"""{_q(_ORDERED).replace("sum(cl.s), 6)", "sum(cl.s), 9)")}, g AS (SELECT doc_id, text, CASE WHEN substr(source, 4)::INT % 2 = 0 THEN 'shafii' ELSE 'other' END AS school, substr(source, 4)::INT % 7 AS o, [{_LEVELS}][substr(source, 4)::INT % 7 + 1] AS grade FROM p)
SELECT qid, doc_id, school, grade, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN school = 'shafii' THEN 0 ELSE 1 END, CASE WHEN o = 6 THEN 9 ELSE o END, rank, doc_id) AS position
FROM ranks JOIN g USING (doc_id) WHERE length(text) >= 40 QUALIFY position <= 3""",
    "domain_detect": f"WITH c AS (SELECT conv_id, turn, trim(lower(text || CASE conv_id % 3 WHEN 0 THEN ' wudhu' WHEN 1 THEN ' Nisab sai' ELSE '' END)) AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, {_first(fixed.DOMAIN_SUBSTRINGS + [(k, n) for n, _, _, ks in fixed.DOMAINS for k in ks])} AS domain FROM c",
    "corpus_stats_total": "SELECT count(*) AS n_passages, coalesce(sum(length(text)), 0)::BIGINT AS total_chars FROM documents",
    "corpus_stats_by_category": "SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang",
    "corpus_stats_by_authority": f"WITH {_P} SELECT level, count(*) AS n FROM p GROUP BY level",
}
