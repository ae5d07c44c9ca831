"""Text functions, HTML ingest and perception over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import html, reasoning
from ..sources import table

# Put into questions so that every rule has something to find.
TAILS = ["?", " <b>", " javascript :", " onload=x", "--", "; drop it", " ../etc", "", " & 'quoted' \"x\"", " hukum boleh", " cara langkah", " dan untuk yang"]
HEADS = ["", "apa itu zakat ", "jelaskan shalat ", "how is wudhu ", "nikah mahar wali ", "riba gadai sewa haram ", "waris "]
VOWELS = "[aeiouAEIOU]"
HINTS = [("thing", "(thing|thand)"), ("ion", "(ion|ung)"), ("que", "que"), ("none", "zzzz")]


def _said(spark, d):
    tail = F.element_at(F.array(*map(F.lit, TAILS)), ((F.col("conv_id") * 7 + F.col("turn")) % len(TAILS) + 1).cast("int"))
    head = F.element_at(F.array(*map(F.lit, HEADS)), ((F.col("conv_id") + F.col("turn")) % len(HEADS) + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(head, F.col("text"), tail).alias("text"))


def sanitize_validate(spark, d):
    checked = _said(spark, d).withColumn("clean", text.sanitized(F.col("text")))
    return checked.select("conv_id", "turn", "clean", text.question_error(F.col("text"), F.col("clean")).alias("error"))


def language_detect(spark, d):
    return _said(spark, d).select("conv_id", "turn", text.language(F.col("text")).alias("language"))


def input_type(spark, d):
    return _said(spark, d).select("conv_id", "turn", text.input_type(F.col("text")).alias("input_type"))


def semantic_density(spark, d):
    return _said(spark, d).select("conv_id", "turn", text.density(F.col("text")).alias("density"), F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def domain_scores(spark, d):
    each = _said(spark, d).select("conv_id", "turn", F.posexplode(reasoning.domain_scores(F.col("text"))).alias("pos", "x"))
    return each.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "x.domain", "x.score")


def context_route(spark, d):
    routed = reasoning.route(_said(spark, d).withColumn("qid", F.col("conv_id") * 1000 + F.col("turn")))
    return routed.select("qid", "context", "urgency", "strategy", F.col("min_evidence").cast("long").alias("min_evidence"), "allow_partial", "depth", "clarify", "referral", "cross_domain", F.size("evidence_scope").cast("long").alias("n_scope"))


def excerpt_truncate(spark, d):
    name = F.concat(F.col("source"), F.lit("_of_"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", text.truncated(F.col("text")).alias("cut"), text.excerpt(F.col("text")).alias("excerpt"), text.display_name(name, {"src1_of_en": "First"}).alias("name"), text.level_label((F.col("doc_id") % 7).cast("int")).alias("label"))


def topic_hints(spark, d):
    return table(spark, d, "documents").select("doc_id", text.topic_hints(F.col("text"), HINTS).alias("hints"))


def char_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.char_ratio(F.col("text"), VOWELS), 9).alias("ratio"))


def passage_quality_filter(spark, d):
    return table(spark, d, "documents").where((F.length("text") >= 150) & (text.char_ratio(F.col("text"), VOWELS) >= 0.35)).select("doc_id", F.col("n_chars"))


def normal_forms(spark, d):
    """Both tidy forms; Arabic letters are put in front, as the tables have none."""
    mixed = F.concat(F.lit("أَلْوُضُوءُ إلى آخر "), F.col("text"), F.lit("\n\n\n\n\tx  "))
    rows = table(spark, d, "documents").select("doc_id", mixed.alias("t"))
    return rows.select("doc_id", text.search_form(F.col("t")).alias("index_form"), F.sha2(text.search_form(F.col("t"), False), 256).alias("query_form"), F.sha2(text.tidy(F.col("t")), 256).alias("tidy"), text.contains_arabic(F.col("t")).alias("arabic"), text.arabic_chars(F.col("t")).cast("long").alias("n_arabic"))


def notes_and_tokens(spark, d):
    rows = table(spark, d, "conversations")
    note = text.joined_notes(F.when(F.col("turn") % 2 == 0, F.lit("even")), F.lit(""), F.col("role"))
    return rows.select("conv_id", "turn", note.alias("note"), text.key_hash(F.col("text")).alias("hash"), text.masked(F.col("text")).alias("masked"), text.school(F.when(F.col("turn") == 0, " Shafii ").otherwise(F.col("role"))).alias("school"), text.length_within(F.col("role"), 3, 6).alias("fits"))


def json_fields(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", F.array_join(text.missing_fields(F.col("props"), ["k", "name"]), ",").alias("missing"))


def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", html.first_heading(F.col("html")).alias("text"))


def html_passages(spark, d):
    """Leaf paragraphs with the heading before them; no SQL twin, as a parser reads the pages."""
    found = html.elements(table(spark, d, "pages"))
    titled = html.carried(found.withColumn("text", F.when(F.col("tag") == "h1", F.concat(F.lit("بابالوضوء "), F.col("text"))).otherwise(F.col("text"))))
    return titled.where("tag = 'p' and leaf").select(F.col("page").alias("page_id"), "pos", "chapter_title", F.length("text").alias("n_chars"))


def page_passages(spark, d):
    return html.page_passages(table(spark, d, "pages"), 150, 0.2, VOWELS).select("page_id", "page_ref", "chapter_title", "text_length")


def page_refs(spark, d):
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*?)(\\.[^./]*)?$", 1)
    return table(spark, d, "pages").select("page_id", name.alias("page_ref"))


def title_carry_forward(spark, d):
    """Turns as elements: system turns are headings, carried over the later turns of all conversations of a book."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("book"), F.col("conv_id").alias("page"), F.col("turn").cast("int").alias("pos"), F.when(F.col("role") == "system", "h1").otherwise("p").alias("tag"), F.concat(F.when(F.col("role") == "system", "باب الوضوء ").otherwise(""), F.col("text")).alias("text"), F.lit(None).cast("string").alias("anchor"), F.lit(True).alias("leaf"))
    return html.carried(rows, "book").select("book", "page", F.col("pos").cast("long").alias("pos"), "chapter_title")


QUERIES = {
    f.__name__: f
    for f in (
        sanitize_validate, language_detect, input_type, semantic_density, domain_scores, context_route, excerpt_truncate, topic_hints, char_ratio, passage_quality_filter,
        normal_forms, notes_and_tokens, json_fields, html_headings, html_passages, page_passages, page_refs, title_carry_forward,
    )
}


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_s, xs)) + "]"


_SAID = f"said AS (SELECT conv_id, turn, {_list(HEADS)}[(conv_id + turn) % {len(HEADS)} + 1] || text || {_list(TAILS)}[(conv_id * 7 + turn) % {len(TAILS)} + 1] AS text FROM conversations)"
_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(nfc_normalize(text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '\\s+', ' ', 'g'))"
_BAD = " OR ".join(f"regexp_matches(text, {_s(p)})" for p in fixed.SUSPICIOUS)
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_any = lambda f, words: "(" + " OR ".join(f"{f}(t, {_s(w)})" for w in words) + ")"
_TYPE = f"CASE WHEN t LIKE '%?' OR {_any('starts_with', fixed.QUESTION_STARTS)} THEN 'pertanyaan' WHEN {_any('starts_with', fixed.EXPLAIN_STARTS)} THEN 'permintaan_penjelasan' WHEN {_any('contains', fixed.RULING_WORDS)} THEN 'permintaan_fatwa' WHEN {_any('contains', fixed.PROCEDURE_WORDS)} THEN 'permintaan_prosedur' ELSE 'pernyataan' END"
_SCORES = f"""w AS (SELECT conv_id, turn, lower(trim(text)) AS t, {_WORDS} AS ws FROM said),
k(ord, domain, kw) AS (SELECT o, d, unnest(ks) FROM (VALUES {", ".join(f"({i}, {_s(n)}, {_list(ks)})" for i, (n, ks) in enumerate(fixed.LEXICON))}) x(o, d, ks)),
tk AS (SELECT DISTINCT conv_id, turn, x FROM (SELECT conv_id, turn, unnest(ws) AS x FROM w) WHERE length(x) > 2 AND NOT list_contains({_list(fixed.STOPWORDS)}, x)),
hit AS (SELECT conv_id, turn, ord, domain, count(DISTINCT kw) AS n FROM tk JOIN k ON contains(x, kw) OR contains(kw, x) GROUP BY ALL),
ds AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, ord) - 1 AS pos, domain, round(n / sum(n) OVER (PARTITION BY conv_id, turn), 4) AS score FROM hit
  UNION ALL SELECT conv_id, turn, 0, 'umum', 1.0 FROM w WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM hit))"""
_CONTEXT = ", ".join(f"({_s(a)}, {_s(b)}, {_s(c)}, {e}, {_s(u)})" for a, b, c, e, _, u in fixed.CONTEXTS)
_CLASS = r"[^\x{0600}-\x{06FF}\x{0750}-\x{077F}\s\d،.؟!:]"
_MIXED = "m AS (SELECT doc_id, 'أَلْوُضُوءُ إلى آخر ' || text || chr(10) || chr(10) || chr(10) || chr(10) || chr(9) || 'x  ' AS t FROM documents)"
_PLAIN = r"translate(regexp_replace(t, '[\x{064B}-\x{065F}\x{0670}]', '', 'g'), 'أإآى', 'اااي')"
_REF = r"regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*?)(\.[^./]*)?$', 1)"

ORACLE_SQL = {
    "sanitize_validate": f"WITH {_SAID}, c AS (SELECT *, {_CLEAN} AS clean FROM said) SELECT conv_id, turn, clean, CASE WHEN trim(text) = '' THEN 'blank' WHEN length(clean) < 3 THEN 'short' WHEN length(clean) > 500 THEN 'long' WHEN {_BAD} THEN 'suspicious' END AS error FROM c",
    "language_detect": f"WITH {_SAID}, w AS (SELECT conv_id, turn, {_WORDS} AS ws FROM said) SELECT conv_id, turn, CASE WHEN len(list_intersect(list_distinct(ws), {_list(fixed.ID_MARKERS)})) >= len(list_intersect(list_distinct(ws), {_list(fixed.EN_MARKERS)})) THEN 'id' ELSE 'en' END AS language FROM w",
    "input_type": f"WITH {_SAID}, w AS (SELECT conv_id, turn, lower(trim(text)) AS t FROM said) SELECT conv_id, turn, {_TYPE} AS input_type FROM w",
    "semantic_density": f"WITH {_SAID}, w AS (SELECT conv_id, turn, {_WORDS} AS ws FROM said) SELECT conv_id, turn, CASE WHEN len(ws) = 0 THEN 0.0 ELSE round(len(list_distinct(ws)) / len(ws), 4) END AS density, len(ws) AS n_tokens FROM w",
    "domain_scores": f"WITH {_SAID}, {_SCORES} SELECT conv_id, turn, pos, domain, score FROM ds",
    "context_route": f"""WITH {_SAID}, {_SCORES}, cx(domain, kind, context, needs, urgency) AS (VALUES {_CONTEXT}),
a AS (SELECT w.*, {_TYPE} AS kind, CASE WHEN len(ws) = 0 THEN 0.0 ELSE round(len(list_distinct(ws)) / len(ws), 4) END AS density FROM w),
b AS (SELECT a.conv_id, a.turn, kind, p.domain, round(p.score * 0.6::DOUBLE + density * 0.2::DOUBLE + least(len(ws) / 15, 1.0::DOUBLE) * 0.2::DOUBLE, 4) AS l1,
  EXISTS (SELECT 1 FROM ds s WHERE s.conv_id = a.conv_id AND s.turn = a.turn AND s.pos IN (1, 2) AND s.domain <> 'umum') AS crossed FROM a JOIN ds p ON p.conv_id = a.conv_id AND p.turn = a.turn AND p.pos = 0),
c AS (SELECT b.*, coalesce(context, 'umum_islam') AS context, coalesce(needs, true) AS needs, coalesce(urgency, 'low') AS urgency FROM b LEFT JOIN cx ON cx.domain = b.domain AND cx.kind = b.kind)
SELECT conv_id * 1000 + turn AS qid, context, urgency, CASE WHEN crossed OR urgency = 'high' THEN 'comprehensive' WHEN urgency = 'medium' THEN 'targeted' ELSE 'minimal' END AS strategy,
  CASE WHEN crossed OR urgency = 'high' THEN 3 WHEN urgency = 'medium' THEN 2 ELSE 1 END::BIGINT AS min_evidence, urgency <> 'high' AS allow_partial,
  CASE WHEN l1 < 0.4 THEN 'brief' WHEN urgency = 'high' THEN 'full' WHEN urgency = 'medium' THEN 'standard' ELSE 'brief' END AS depth, l1 < 0.4 AS clarify, context IN {tuple(fixed.SENSITIVE_CONTEXTS)} AS referral, crossed AS cross_domain, CASE WHEN needs THEN 3 ELSE 1 END::BIGINT AS n_scope FROM c""",
    "excerpt_truncate": r"""SELECT doc_id, CASE WHEN length(text) <= 280 THEN text ELSE regexp_replace(substr(text, 1, 280), ' [^ ]*$', '', 's') || ' ...' END AS cut, rtrim(substr(text, 1, 200), ' ' || chr(9) || chr(10)) || CASE WHEN length(text) > 200 THEN '…' ELSE '' END AS excerpt,
  CASE WHEN source || lang = 'src1en' THEN 'First' ELSE upper(source[1]) || source[2:] || ' Of ' || upper(lang[1]) || lang[2:] END AS name, coalesce(['Qawl Imam', 'Qawl Ashhab', 'Mu''tamad', 'Syarh Mu''tamad', 'Tafsir / Qawa''id'][nullif(doc_id % 7, 0)], '—') AS label FROM documents""",
    "topic_hints": "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in HINTS) + ") AS hints FROM documents",
    "char_ratio": "WITH s AS (SELECT doc_id, replace(replace(text, ' ', ''), chr(10), '') AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 0.0 ELSE round((length(t) - length(regexp_replace(t, '[aeiouAEIOU]', '', 'g'))) / length(t), 9) END AS ratio FROM s",
    "passage_quality_filter": "WITH s AS (SELECT *, replace(replace(text, ' ', ''), chr(10), '') AS t FROM documents) SELECT doc_id, n_chars FROM s WHERE length(text) >= 150 AND t <> '' AND (length(t) - length(regexp_replace(t, '[aeiouAEIOU]', '', 'g'))) / length(t) >= 0.35",
    "normal_forms": rf"WITH {_MIXED} SELECT doc_id, trim(regexp_replace(regexp_replace({_PLAIN}, '{_CLASS}', ' ', 'g'), '\s+', ' ', 'g')) AS index_form, sha256(trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g'))) AS query_form, sha256(trim(regexp_replace(regexp_replace(nfc_normalize(t), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) AS tidy, regexp_matches(t, '[\x{{0600}}-\x{{06FF}}]') AS arabic, length(t) - length(regexp_replace(t, '[\x{{0600}}-\x{{06FF}}]', '', 'g')) AS n_arabic FROM m",
    "notes_and_tokens": "SELECT conv_id, turn, concat_ws(chr(10) || chr(10), CASE WHEN turn % 2 = 0 THEN 'even' END, role) AS note, sha256(text) AS hash, substr(text, 1, 16) || '...' AS masked, CASE WHEN turn = 0 THEN 'shafii' END AS school, length(role) BETWEEN 3 AND 6 AS fits FROM conversations",
    "json_fields": "SELECT event_id, concat_ws(',', CASE WHEN coalesce(json_extract_string(props, '$.k'), '') IN ('', '0') THEN 'k' END, CASE WHEN coalesce(json_extract_string(props, '$.name'), '') = '' THEN 'name' END) AS missing FROM events",
    "html_headings": "SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS text FROM pages",
    "page_refs": f"SELECT page_id, {_REF} AS page_ref FROM pages",
    "title_carry_forward": "WITH x AS (SELECT conv_id % 10 AS book, conv_id AS page, turn AS pos, CASE WHEN role = 'system' THEN substr('باب الوضوء ' || text, 1, 200) END AS t FROM conversations) SELECT book, page, pos, last_value(t IGNORE NULLS) OVER (PARTITION BY book ORDER BY page, pos ROWS UNBOUNDED PRECEDING) AS chapter_title FROM x",
}
