"""Knowledge-base operators over conversations, orders, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import answer, evidence, knowledge, reasoning, search
from ..sources import literal_rows, shared_folder, table
from . import search_queries, seeds
from .seeds import sql_rows

# Beside whole questions: topics for each layer of the cascade, the last ones for full text.
TOPICS = [(-1 - i, t) for i, t in enumerate(["und", " Thand ", "que la", "water", "ruta", "nothing here", "the thing is", "rest", "losra", "", "hant", "Pathetic", "eation", "hein eriner", "verst unglich"])]


def kb(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "rules": literal_rows(spark, seeds.RULES, seeds.RULES_SCHEMA),
        "verses": literal_rows(spark, seeds.VERSES, seeds.VERSES_SCHEMA).withColumn("surah_ayah", F.col("reference")),
        "narrations": literal_rows(spark, seeds.NARRATIONS, seeds.NARRATIONS_SCHEMA).withColumns({"reference": F.col("source"), "transliteration": F.lit(None).cast("string"), "translation": F.lit(None).cast("string")}),
        "cached_verses": literal_rows(spark, seeds.CACHED_VERSES, seeds.VERSES_SCHEMA).withColumn("surah_ayah", F.col("reference")),
        "cached_narrations": literal_rows(spark, seeds.CACHED_NARRATIONS, seeds.NARRATIONS_SCHEMA).withColumns({"reference": F.col("source"), "transliteration": F.lit(None).cast("string"), "translation": F.lit(None).cast("string")}),
    }


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")


def topic_parse(spark, d):
    return knowledge.parse_topics(questions(spark, d), kb(spark)["rules"])


def topic_parse_debug(spark, d):
    return knowledge.keyword_scores(questions(spark, d), kb(spark)["rules"]).select("qid", "key", F.col("score").cast("long").alias("score"))


def _topics(spark, d):
    return questions(spark, d).withColumnRenamed("text", "topic").union(literal_rows(spark, TOPICS, "qid long, topic string"))


def first_match_keyword(spark, d):
    return knowledge.first_keyword_match(questions(spark, d).withColumnRenamed("text", "topic"), kb(spark)["rules"])


def _cascade(spark, topics):
    return knowledge.cascade(topics, **kb(spark))


def cascade_retrieve(spark, d):
    keys = lambda c: F.array_join(F.transform(c, lambda x: x["key"]), ",").alias(c)
    return _cascade(spark, _topics(spark, d)).select("qid", "topic", "layer", "source", "ruling", keys("verses"), keys("narrations"), "confidence", "needs_review")


def corpus_hits(spark, d, left):
    """Hits of the full-text layer for the topics that the others leave."""
    found = search.search(left.withColumnRenamed("topic", "text"), search_queries.passages(spark, d))
    named = found.select("qid", "position", F.col("source").alias("book"), "level", F.col("category").alias("chapter"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("page"), "text", F.col("combined_score").alias("score"))
    return knowledge.as_hits(named)


def _corpus_cascade(spark, d, topics):
    """The whole cascade, with its full-text layer; the topics are matched once for all layers."""
    k = kb(spark)
    shared_folder(spark)
    found = knowledge.matched(topics, k["rules"], k["cached_verses"].select(*k["verses"].columns)).checkpoint()
    return knowledge.cascade(topics, **k, hits=corpus_hits(spark, d, knowledge.left_over(found)), found=found)


def cascade_corpus(spark, d):
    """The whole cascade, with its full-text layer."""
    found = _corpus_cascade(spark, d, _topics(spark, d))
    said = F.array_join(F.transform("hits", lambda h: F.concat_ws(" ", h["book"], h["level"].cast("string"), h["chapter"], h["page"], F.round(h["score"] * 10000).cast("long").cast("string"))), ",")
    return found.select("qid", "topic", "layer", "source", "ruling", "school", "confidence", "reasoning", "needs_review", F.coalesce(said, F.lit("")).alias("hits"))


def chat_answer_corpus(spark, d):
    """Questions whose topic the caller gives, in place of a parsed one: answers from rules, cached verses and passages, with citations."""
    topics = _topics(spark, d)
    told = answer.answers(topics.select("qid"), topics, _corpus_cascade(spark, d, topics), has_hits=True)
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["book_name"], c["authority_label"], c["authority_level"].cast("string"), c["chapter_title"], c["page_ref"], c["excerpt"])), "\n")
    none = F.lit("")
    return told.select("qid", "status", F.coalesce("answer", none).alias("answer"), F.coalesce("reason", none).alias("reason"), F.coalesce("disclaimer", none).alias("disclaimer"), F.round(F.col("confidence_score") * 100).cast("long").alias("hundredths"), F.array_join("warnings", "\n").alias("warnings"), "source", F.coalesce(cited, none).alias("citations"))


def answerable_questions(spark, d):
    """Questions validated first, then answered, and whether they could be."""
    known = kb(spark)

    def reply(asked):
        topics = knowledge.parse_topics(asked, known["rules"])
        return answer.answers(asked, topics, _cascade(spark, topics.where("topic is not null")))

    asked = questions(spark, d).withColumn("text", F.when(F.col("qid") % 5 == 0, " ").when(F.col("qid") % 5 == 1, "ok").otherwise(F.col("text")))
    told = answer.is_answerable(answer.ask(asked, reply))
    return told.select("qid", "is_answerable", F.round(F.coalesce("confidence_score", F.lit(0.0)) * 100).cast("long").alias("hundredths"))


def unresolved_topics(spark, d):
    k = kb(spark)
    return knowledge.unresolved(_topics(spark, d), k["rules"], k["cached_verses"]).select("qid", "topic")


def array_fk_resolve(spark, d):
    """Orders with an array of references to parts of their lines, resolved in order; each has a reference more, to a part that doesn't exist."""
    lines = table(spark, d, "lineitem")
    refs = lines.groupBy(F.col("l_orderkey").alias("qid")).agg(F.concat(F.array(F.lit(-1)), F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])).alias("refs"))
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    found = knowledge.resolved(refs, "refs", parts, "p_partkey", "parts")
    return found.select("qid", F.size("parts").cast("long").alias("n"), F.array_join(F.transform("parts", lambda p: p["p_brand"]), ",").alias("brands"))


def broken_refs(spark, d):
    """Labels of documents of some sources are broken references, as those documents are left out."""
    some = table(spark, d, "documents").where("source <> 'src3'").select(F.col("doc_id").alias("key"))
    refs = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.array("doc_id").alias("refs"))
    return knowledge.broken_refs(refs, "refs", some, "key")


def _cached(spark, d):
    """Labels under other keys, some of which no document has."""
    return table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id"), "quality")


def _merge(overwrite):
    def run(spark, d):
        static = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"))
        return knowledge.merge_cache(static, _cached(spark, d), "doc_id", overwrite)

    return run


def cache_merge_counts(spark, d):
    return knowledge.merge_counts(table(spark, d, "documents").select("doc_id"), _cached(spark, d), "doc_id")


def evidence_score(spark, d):
    """An order's lines as evidence: those returned are verses, the status of the others is a grade."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    grade = F.when(F.col("l_returnflag") == "A", "sahih").when(F.col("l_linestatus") == "O", "hasan").otherwise("dhaif")
    own = lines.groupBy("o_orderkey", "o_orderpriority").agg(F.count_if(F.col("l_returnflag") == "R").alias("verses"), F.collect_list(F.when(F.col("l_returnflag") != "R", grade)).alias("grades"))
    scored = own.withColumn("h", evidence.standard_hundredths(F.col("verses"), F.col("grades"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 2 == 0).cast("long"))
    return scored.select("o_orderkey", F.col("h").alias("hundredths"), evidence.label(F.col("h")).alias("label"), (F.col("h") >= evidence.LEAST).alias("is_answerable"))


def corpus_evidence(spark, d):
    """A conversation's turns as hits of the level of their length."""
    hits = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") > 0, F.length("text") % 5 + 1)).alias("levels"))
    return hits.select("conv_id", evidence.corpus_hundredths(F.col("levels")).cast("long").alias("hundredths"))


def gate_labels(spark, d):
    found = evidence.with_gate(evidence.with_evidence(_cascade(spark, _topics(spark, d))))
    return found.select("qid", F.col("hundredths").cast("long").alias("hundredths"), "confidence_label", F.size("warnings").cast("long").alias("n_warnings"), "can_answer")


def value_distribution(spark, d):
    return knowledge.distribution(table(spark, d, "events"), F.nullif(F.col("event_type"), F.lit("error")))


def _records(spark, d):
    """Labels as rules that refer to documents, as verses by their own id and as narrations by the next one; documents of two sources are pending or stubs."""
    rules = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.array("doc_id").alias("basis_verses"), F.array(F.col("doc_id") + 1).alias("basis_narrations"))
    own = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", "text")
    verses = own.select("key", F.when(F.col("source") == "src2", "TEXT_PENDING").otherwise(F.col("text")).alias("arabic_text"))
    return rules, verses, own.select("key", F.when(F.col("source") == "src3", "stub").alias("status"))


def integrity_report(spark, d):
    return knowledge.integrity(*_records(spark, d))


def ingest_skip_loaded(spark, d):
    loaded = table(spark, d, "labels").select("doc_id", F.col("quality").alias("total_passages"))
    return knowledge.skip_loaded(table(spark, d, "documents").select("doc_id"), loaded, "doc_id", "10")


def fetch_plan(spark, d):
    return knowledge.plan_missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


def editions_inner(spark, d):
    pick = lambda r: table(spark, d, "conversations").where(f"role = '{r}'").select(F.col("conv_id").alias("surah"), F.floor(F.col("turn") / 2).alias("ayah"), "text")
    return knowledge.mapped_verses(pick("user"), pick("assistant"), "x").select("surah", "ayah", "reference", "arabic_text", "translation", "theme", "confidence")


def editions_outer(spark, d):
    """Documents as one edition, benchmark items under other numbers as the other."""
    arabic = table(spark, d, "documents").select(F.col("doc_id").alias("number"), "text")
    return knowledge.mapped_narrations(arabic, table(spark, d, "benchmark").select((F.col("item_id") * 30).alias("number"), "text"), "bukhari")


def topics_endpoint(spark, d):
    return knowledge.topic_list(kb(spark)["rules"]).select("key", "ruling", F.array_join("keywords", "|").alias("keywords"))


def registry_reconciliation(spark, d):
    """Sources as a registry, against the names of some of them and of others."""
    names = literal_rows(spark, [("src1",), ("src2",), ("src99",)], "slug string")
    return knowledge.reconciled(table(spark, d, "documents").select(F.col("source").alias("slug")), names)


def loaded_counts(spark, d):
    books = literal_rows(spark, [(f"src{i}", i) for i in range(0, 30, 3)], "slug string, n int")
    return knowledge.loaded_counts(table(spark, d, "documents").select(F.col("source").alias("slug")), books).select("slug", "n", "total_passages")


def health(spark, d):
    return knowledge.health(*_records(spark, d))


def chat_answer(spark, d):
    asked = questions(spark, d)
    topics = knowledge.parse_topics(asked, kb(spark)["rules"])
    told = answer.answers(asked, topics, _cascade(spark, topics.where("topic is not null")))
    return told.select("qid", "status", "topic", F.coalesce(F.col("answer"), F.lit("")).alias("answer"), F.col("confidence_score").cast("double").alias("confidence_score"), "confidence_label", F.size("warnings").cast("long").alias("n_warnings"), "source")


def reasoned_answer(spark, d):
    """The layered answer of questions with words of the lexicon put in; no SQL twin."""
    words = F.element_at(F.array(*map(F.lit, ["hukum zakat fitrah", "apa itu shalat", "cara wudhu", "jual beli riba", "nikah dan waris", "hello"])), (F.col("qid") % 6 + 1).cast("int"))
    asked = questions(spark, d).select("qid", F.concat(words, F.lit(" "), F.col("text")).alias("text"))
    rules = [(i, n, f"ruling {n}", "shafii", ["v1", "v2"], ["n1"], [n], "because", "high") for i, n in enumerate(["zakat", "shalat", "thaharah", "muamalah"])]
    known = kb(spark) | {"rules": literal_rows(spark, rules, seeds.RULES_SCHEMA)}
    out = reasoning.reason(asked, lambda topics: knowledge.cascade(topics, **known), answer.standard_text)
    return out.select("qid", "primary_domain", "context", "strategy", "gate_passed", "gate_reason", "status", "confidence", "risk", "l1", "l2", "l3", "l4", "l5", "l6", "l7")


QUERIES = {
    "topic_parse": topic_parse, "topic_parse_debug": topic_parse_debug, "first_match_keyword": first_match_keyword, "cascade_retrieve": cascade_retrieve, "unresolved_topics": unresolved_topics,
    "array_fk_resolve": array_fk_resolve, "broken_refs": broken_refs, "cache_merge": _merge(False), "cache_merge_overwrite": _merge(True), "cache_merge_counts": cache_merge_counts,
    "evidence_score": evidence_score, "corpus_evidence": corpus_evidence, "gate_labels": gate_labels, "value_distribution": value_distribution, "integrity_report": integrity_report,
    "ingest_skip_loaded": ingest_skip_loaded, "fetch_plan": fetch_plan, "editions_inner": editions_inner, "editions_outer": editions_outer, "topics_endpoint": topics_endpoint,
    "registry_reconciliation": registry_reconciliation, "loaded_counts": loaded_counts, "health": health, "chat_answer": chat_answer, "cascade_corpus": cascade_corpus, "chat_answer_corpus": chat_answer_corpus, "answerable_questions": answerable_questions, "reasoned_answer": reasoned_answer,
}

_RULES = sql_rows("rules", seeds.columns(seeds.RULES_SCHEMA), seeds.RULES)
_KB = ", ".join(
    [
        _RULES,
        sql_rows("verses", seeds.columns(seeds.VERSES_SCHEMA), seeds.VERSES),
        sql_rows("cverses", seeds.columns(seeds.VERSES_SCHEMA), seeds.CACHED_VERSES),
        sql_rows("narrations", seeds.columns(seeds.NARRATIONS_SCHEMA), seeds.NARRATIONS),
        sql_rows("cnarrations", seeds.columns(seeds.NARRATIONS_SCHEMA), seeds.CACHED_NARRATIONS),
    ]
)
_ASKED = "asked AS (SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user')"
_SCORES = r"""kw AS (SELECT key, ord, lower(unnest(keywords)) AS k FROM rules),
w AS (SELECT qid, trim(lower(text)) AS t, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS ws FROM asked),
s AS (SELECT qid, key, ord, (CASE WHEN contains(t, k) THEN 2 ELSE 0 END + len(list_intersect(ws, list_distinct(string_split(k, ' '))))) AS s FROM w, kw),
scores AS (SELECT qid, key, ord, sum(s)::BIGINT AS score FROM s GROUP BY ALL HAVING sum(s) > 0),
parsed AS (SELECT qid, (SELECT key FROM scores x WHERE x.qid = asked.qid ORDER BY score DESC, ord LIMIT 1) AS topic FROM asked)"""
# Layers of the cascade over a table t(qid, topic).
_CASCADE = """t1 AS (SELECT qid, lower(trim(topic)) AS topic FROM t WHERE trim(topic) <> ''),
l1 AS (SELECT qid, topic, key FROM t1 JOIN rules ON key = topic),
l2 AS (SELECT qid, topic, arg_min(key, ord) AS key FROM (SELECT * FROM t1 WHERE qid NOT IN (SELECT qid FROM l1)) x JOIN (SELECT key, ord, unnest(keywords) AS k FROM rules) r ON contains(k, topic) OR contains(topic, k) GROUP BY ALL),
l3 AS (SELECT qid, topic, list(key ORDER BY ord)[1:3] AS vs FROM (SELECT * FROM t1 WHERE qid NOT IN (SELECT qid FROM l1 UNION SELECT qid FROM l2)) x JOIN cverses ON contains(lower(theme), topic) GROUP BY ALL),
hit AS (SELECT qid, topic, 1 AS layer, 'static_rules' AS source, key FROM l1 UNION ALL SELECT qid, key, 2, 'keyword_search', key FROM l2 UNION ALL SELECT qid, topic, 3, 'cache_extended', NULL FROM l3),
full0 AS (SELECT hit.*, CASE WHEN layer = 3 THEN '@THEME@' ELSE r.ruling END AS ruling, coalesce(r.school, 'shafii') AS school, CASE WHEN layer > 2 THEN '' ELSE r.reasoning END AS reasoning, list_filter(coalesce(basis_verses, []), lambda x: list_contains(@VERSES@, x)) AS v0, list_filter(coalesce(basis_narrations, []), lambda x: list_contains(@NARRATIONS@, x)) AS n0,
  list_filter(coalesce(basis_verses, []), lambda x: list_contains(@CACHED_VERSES@, x)) AS vc, list_filter(coalesce(basis_narrations, []), lambda x: list_contains(@CACHED_NARRATIONS@, x)) AS nc,
  CASE WHEN layer > 2 THEN 'medium' ELSE r.confidence END AS confidence FROM hit LEFT JOIN rules r ON hit.key = r.key),
got AS (SELECT f.qid, f.topic, f.layer, f.source, f.ruling, f.school, f.reasoning, f.confidence, CASE WHEN layer = 3 THEN l3.vs WHEN len(v0) < 2 OR len(n0) < 1 THEN list_concat(v0, vc) ELSE v0 END AS vs,
  CASE WHEN len(v0) < 2 OR len(n0) < 1 THEN list_concat(n0, nc) ELSE n0 END AS ns FROM full0 f LEFT JOIN l3 USING (qid)),
nall AS (SELECT key, source, authenticity, arabic_text FROM narrations UNION ALL SELECT key, source, authenticity, arabic_text FROM cnarrations),
g AS (SELECT *, (SELECT count(*) FROM nall WHERE list_contains(ns, key) AND authenticity = 'sahih') AS ns1, (SELECT count(*) FROM nall WHERE list_contains(ns, key) AND authenticity = 'hasan') AS ns2,
  (SELECT count(*) FROM nall WHERE list_contains(ns, key) AND authenticity = 'dhaif') AS ns3 FROM got),
e0 AS (SELECT *, CASE WHEN len(vs) > 0 THEN 40 + 5 * least(len(vs) - 1, 3) ELSE 0 END + CASE WHEN ns1 > 0 THEN 25 + 5 * ns1 ELSE 0 END + 15 * ns2 + CASE WHEN confidence = 'high' THEN 5 ELSE 0 END AS raw FROM g),
e AS (SELECT *, least(100, CASE WHEN confidence = 'high' AND source = 'static_rules' THEN greatest(raw, 55) ELSE raw END)::BIGINT AS h FROM e0)"""
for _n in ("CACHED_VERSES", "CACHED_NARRATIONS", "VERSES", "NARRATIONS"):
    _CASCADE = _CASCADE.replace(f"@{_n}@", seeds.sql_value([r[1] for r in getattr(seeds, _n)]))
_LABEL = "CASE WHEN h >= 70 THEN 'high' WHEN h >= 50 THEN 'medium' ELSE 'insufficient' END"
_TOPICS = f"{_ASKED}, {sql_rows('lit', 'qid, topic', TOPICS)}, t AS (SELECT qid, text AS topic FROM asked UNION ALL SELECT qid, topic FROM lit)"
_CASCADE = _CASCADE.replace("@THEME@", fixed.THEME_RULING)
_EQ = "=" * 70
_ANSWER = f"""concat('{_EQ}', chr(10), 'HUKUM: ', upper(coalesce(ruling, '')), chr(10), 'MADHAB: ', coalesce(school, ''), chr(10), '{_EQ}', chr(10),
  CASE WHEN len(vs) > 0 THEN concat(chr(10), 'DASAR AL-QUR''AN:', chr(10), chr(10), (SELECT string_agg(concat('  [', i, '] QS. ', reference, chr(10), '      ', arabic_text, CASE WHEN translation IS NOT NULL THEN concat(chr(10), '      Terjemahan: ', translation) ELSE '' END, chr(10)), chr(10) ORDER BY i)
    FROM (SELECT generate_subscripts(vs, 1) AS i, unnest(vs) AS k) x JOIN (SELECT * FROM verses UNION ALL SELECT * FROM cverses) v ON v.key = x.k), chr(10)) ELSE '' END,
  CASE WHEN len(ns) > 0 THEN concat(chr(10), 'DASAR HADIS:', chr(10), chr(10), (SELECT string_agg(concat('  [', i, '] ', v.source, chr(10), '      ', v.arabic_text, chr(10)), chr(10) ORDER BY i)
    FROM (SELECT generate_subscripts(ns, 1) AS i, unnest(ns) AS k) x JOIN nall v ON v.key = x.k), chr(10)) ELSE '' END,
  chr(10), 'PENJELASAN:', chr(10), '  ', coalesce(reasoning, ''), chr(10), chr(10), '{_EQ}')"""

# The full-text layer for the topics that the others leave: best(qid, doc_id, level, combined_score, position).
_CORPUS = f"""u AS (SELECT qid, topic FROM t1 WHERE qid NOT IN (SELECT qid FROM hit)),
q AS (SELECT qid, 0 AS clause, unnest(regexp_extract_all(topic, '[\\p{{L}}\\p{{N}}]+')) AS term FROM u),
pref AS (SELECT qid, {search_queries._pref(search_queries._first(fixed.DOMAIN_SUBSTRINGS + [(k, n) for n, _, _, ks in fixed.DOMAINS for k in ks]))} AS levels FROM (SELECT qid, topic AS t FROM u)),
{search_queries._TOK}, {search_queries.RANKS_9}, {search_queries._P}, {search_queries.ranked_sql(5)},
found AS (SELECT b.qid, b.position, b.combined_score, p.* FROM best b JOIN p USING (doc_id))"""

ORACLE_SQL = {
    "cascade_corpus": f"""WITH {_KB}, {_TOPICS}, {_CASCADE}, {_CORPUS}
SELECT qid, topic, layer, source, ruling, school, confidence, reasoning, layer = 3 AS needs_review, '' AS hits FROM got UNION ALL
SELECT qid, u.topic, 4, 'kitab_corpus', '', 'shafii', 'medium', '', false, string_agg(source || ' ' || level || ' ' || category || ' p' || doc_id || ' ' || round(combined_score * 10000)::BIGINT, ',' ORDER BY position) FROM found JOIN u USING (qid) GROUP BY ALL""",
    "answerable_questions": f"""WITH {_KB}, asked AS (SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user' AND (conv_id * 1000 + turn) % 5 > 1), {_SCORES}, t AS (SELECT qid, topic FROM parsed WHERE topic IS NOT NULL), {_CASCADE}
SELECT conv_id * 1000 + turn AS qid, coalesce(h >= 50, false) AS is_answerable, coalesce(h, 0)::BIGINT AS hundredths FROM conversations c LEFT JOIN e ON e.qid = conv_id * 1000 + turn WHERE role = 'user'""",
    "registry_reconciliation": "WITH n(slug) AS (VALUES ('src1'), ('src2'), ('src99')), r AS (SELECT DISTINCT source AS slug FROM documents) SELECT slug, 'names' AS missing_in FROM r WHERE slug NOT IN (SELECT slug FROM n) UNION ALL SELECT slug, 'registry' FROM n WHERE slug NOT IN (SELECT slug FROM r)",
    "loaded_counts": "WITH b AS (SELECT 'src' || i AS slug, i::INT AS n FROM range(0, 30, 3) x(i)) SELECT slug, n, (SELECT count(*) FROM documents WHERE source = slug) AS total_passages FROM b",
    "health": "SELECT 'ok' AS status, (SELECT count(*) FROM labels) AS rules, count(*) AS verses, count(*) AS narrations FROM documents",
    "topic_parse": f"WITH {_RULES}, {_ASKED}, {_SCORES} SELECT qid, topic FROM parsed",
    "topic_parse_debug": f"WITH {_RULES}, {_ASKED}, {_SCORES} SELECT qid, key, score FROM scores",
    "first_match_keyword": f"WITH {_RULES}, c AS (SELECT conv_id * 1000 + turn AS qid, lower(trim(text)) AS topic FROM conversations WHERE role = 'user') SELECT qid, arg_min(key, ord) AS key FROM c JOIN (SELECT key, ord, unnest(keywords) AS k FROM rules) r ON contains(k, topic) OR contains(topic, k) GROUP BY qid",
    "cascade_retrieve": f"WITH {_KB}, {_TOPICS}, {_CASCADE} SELECT qid, topic, layer, source, ruling, array_to_string(vs, ',') AS verses, array_to_string(ns, ',') AS narrations, confidence, layer = 3 AS needs_review FROM got",
    "unresolved_topics": f"WITH {_KB}, {_TOPICS}, {_CASCADE} SELECT qid, topic FROM t1 WHERE qid NOT IN (SELECT qid FROM hit)",
    "array_fk_resolve": "WITH x AS (SELECT l_orderkey AS qid, l_linenumber, p_brand, p_partkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) SELECT qid, count(p_partkey) AS n, coalesce(string_agg(p_brand, ',' ORDER BY l_linenumber, p_partkey) FILTER (WHERE p_partkey IS NOT NULL), '') AS brands FROM x GROUP BY qid",
    "broken_refs": "SELECT doc_id AS key, doc_id AS ref FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src3')",
    "cache_merge": "SELECT doc_id, -1 AS quality FROM documents UNION ALL SELECT doc_id * 2, quality FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
    "cache_merge_overwrite": "SELECT doc_id * 2 AS doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id * 2 FROM labels)",
    "cache_merge_counts": "SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS added, count(*) FILTER (WHERE d.doc_id IS NOT NULL) AS skipped FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 2",
    "evidence_score": f"""WITH x AS (SELECT o_orderkey, o_orderpriority, count(*) FILTER (WHERE l_returnflag = 'R') AS v, count(*) FILTER (WHERE l_returnflag = 'A') AS s, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS g
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
y AS (SELECT *, CASE WHEN v > 0 THEN 40 + 5 * least(v - 1, 3) ELSE 0 END + CASE WHEN s > 0 THEN 25 + 5 * s ELSE 0 END + 15 * g + CASE WHEN o_orderpriority = '1-URGENT' THEN 5 ELSE 0 END AS raw FROM x),
z AS (SELECT o_orderkey, least(100, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN greatest(raw, 55) ELSE raw END)::BIGINT AS h FROM y) SELECT o_orderkey, h AS hundredths, {_LABEL} AS label, h >= 50 AS is_answerable FROM z""",
    "corpus_evidence": "SELECT conv_id, CASE WHEN b IS NULL THEN 0 WHEN b <= 2 THEN 60 WHEN b <= 4 THEN 52 ELSE 50 END::BIGINT AS hundredths FROM (SELECT conv_id, min(CASE WHEN turn > 0 THEN length(text) % 5 + 1 END) AS b FROM conversations GROUP BY conv_id)",
    "gate_labels": f"WITH {_KB}, {_TOPICS}, {_CASCADE} SELECT qid, h AS hundredths, {_LABEL} AS confidence_label, (ns2 + ns3 + CASE WHEN h < 50 THEN 1 ELSE 0 END)::BIGINT AS n_warnings, h >= 50 AS can_answer FROM e",
    "value_distribution": "SELECT coalesce(nullif(event_type, 'error'), '?') AS value, count(*) AS n FROM events GROUP BY ALL",
    "integrity_report": "WITH x AS (SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) + (SELECT count(*) FROM labels WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents)) AS broken_refs, count(*) AS n, count(*) FILTER (WHERE CASE WHEN source = 'src2' THEN 'PENDING' ELSE text END LIKE '%PENDING%') AS pending, count(*) FILTER (WHERE source = 'src3') AS stubs FROM documents) SELECT (SELECT count(*) FROM labels) AS rules, n AS verses, pending, n AS narrations, stubs, broken_refs, CASE WHEN broken_refs > 0 THEN 'WARNINGS' ELSE 'OK' END AS status FROM x",
    "ingest_skip_loaded": "SELECT doc_id FROM documents WHERE doc_id = 10 OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)",
    "fetch_plan": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "editions_inner": "SELECT a.conv_id AS surah, a.turn // 2 AS ayah, a.conv_id || ':' || (a.turn // 2) AS reference, a.text AS arabic_text, b.text AS translation, 'x' AS theme, 'medium' AS confidence FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn // 2 = b.turn // 2 WHERE a.role = 'user' AND b.role = 'assistant'",
    "editions_outer": "SELECT 'Bukhari no. ' || coalesce(doc_id, item_id * 30) AS source, coalesce(d.text, '') AS arabic_text, coalesce(b.text, '') AS translation, 'sahih' AS authenticity FROM documents d FULL JOIN benchmark b ON doc_id = item_id * 30 WHERE coalesce(d.text, '') <> '' OR coalesce(b.text, '') <> ''",
    "topics_endpoint": f"WITH {_RULES} SELECT key, ruling, array_to_string(keywords[1:3], '|') AS keywords FROM rules",
    "chat_answer": f"""WITH {_KB}, {_ASKED}, {_SCORES}, t AS (SELECT qid, topic FROM parsed WHERE topic IS NOT NULL), {_CASCADE}
SELECT p.qid, CASE WHEN p.topic IS NULL THEN 'no_match' WHEN h >= 50 THEN 'ok' ELSE 'rejected' END AS status, p.topic, CASE WHEN h >= 50 THEN {_ANSWER} ELSE '' END AS answer, coalesce(h, 0) / 100.0::DOUBLE AS confidence_score,
  CASE WHEN h IS NULL THEN 'insufficient' ELSE {_LABEL} END AS confidence_label, coalesce(ns2 + ns3 + CASE WHEN h < 50 THEN 1 ELSE 0 END, 0)::BIGINT AS n_warnings, coalesce(source, 'unknown') AS source FROM parsed p LEFT JOIN e USING (qid)""",
}
