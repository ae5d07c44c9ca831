import random
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from quillstone import sources, streaming
from quillstone.functions import text
from quillstone.operators import answer, bm25, evidence, gateway, html, index, knowledge, phrases, reasoning, search


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


# Evidence: verses, grades of narrations, a sure rule, a static one.
@pytest.mark.parametrize(
    ("verses", "grades", "high", "static", "score"),
    [(1, [], False, False, 40), (2, [], False, False, 45), (0, ["sahih"], False, False, 30), (0, ["hasan"], False, False, 15), (0, ["dhaif"], False, False, 0), (1, ["sahih"], False, False, 70),
     (2, ["sahih"], True, False, 80), (5, ["sahih"] * 5, True, False, 100), (0, [], True, True, 55), (1, ["sahih", "sahih"], False, False, 75), (0, ["SAHIH", "hasan"], False, False, 45)],
)
def test_evidence_scores(spark, verses, grades, high, static, score):
    rows = spark.createDataFrame([(verses, grades, high, static)], "v int, g array<string>, h boolean, s boolean")
    assert rows.select(evidence.standard_hundredths(F.col("v"), F.col("g"), F.col("h"), F.col("s"))).first()[0] == score


def test_corpus_evidence(spark):
    cases = {(1,): 60, (2,): 60, (3,): 52, (4,): 52, (5,): 50, (): 0, (1, 5): 60, (3, 5): 52, (None,): 50}
    assert column(spark, [list(k) for k in cases], evidence.corpus_hundredths, "array<int>") == list(cases.values())


def test_labels(spark):
    assert column(spark, [70, 69, 50, 49, 0], evidence.label, "int") == ["high", "medium", "medium", "insufficient", "insufficient"]


def hits(spark, rows):
    return spark.createDataFrame([(1, i, r, lv) for i, (r, lv) in enumerate(rows)], "qid int, id int, rank double, level int")


def test_rerank(spark):
    rows = hits(spark, [(-10.0, 5), (-9.5, 1), (-6.0, 3)])
    scores = {r["id"]: r["combined_score"] for r in search.rerank(rows, 0.55, F.array(*map(F.lit, [1, 2, 3]))).collect()}
    assert scores == {0: 0.73, 1: 0.9313, 2: 0.3825}
    even = search.rerank(hits(spark, [(-5.0, 3)] * 3), 1.0)
    assert {r["combined_score"] for r in even.collect()} == {0.0}
    assert search.rerank(hits(spark, [(-5.0, None)]), 0.0).first()["combined_score"] == 0.4
    ranked = search.top(search.rerank(search.candidates(rows, 99), 1.0), 3)
    assert [r["id"] for r in ranked.orderBy("position").collect()] == [0, 1, 2]


def test_bm25_makes_no_row_for_each_clause_and_posting(spark):
    tokens = spark.createDataFrame([(i, ["the", "of", *(["rare"] if i == 7 else [])]) for i in range(20)], "id int, words array<string>")
    queries = spark.createDataFrame([(1, 0, "the"), (1, 0, "rare"), (2, 0, "the"), (2, 1, "of"), (3, 0, "the"), (3, 0, "none")], "qid int, clause int, term string")
    ranks = bm25.bm25(queries, tokens)
    assert not re.search(r"Aggregate \[qid#\d+L?, clause#\d+L?, id#", ranks._jdf.queryExecution().optimizedPlan().toString())
    assert sorted((r["qid"], r["id"]) for r in ranks.collect()) == [(1, 7)] + [(2, i) for i in range(20)]


def test_search_keeps_texts_of_equal_ids_apart(spark):
    rows = [(1, 2, "en", "plain words"), (1, 2, "en", "plain sand"), (1, 3, "en", "plain stone"), (1, 2, "en", "plain words"), (2, 1, "en", "other")]
    passages = spark.createDataFrame(rows, "id int, level int, category string, text string")
    found = search.search(spark.createDataFrame([(1, "plain")], "qid int, text string"), passages)
    assert sorted((r["id"], r["level"], r["text"]) for r in found.collect()) == [(1, 2, "plain sand"), (1, 2, "plain words"), (1, 2, "plain words"), (1, 3, "plain stone")]
    pool = found._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in pool.split("row_number()", 1)[1].split("Join")[0]


def test_search_finds_by_topic_and_domain(spark):
    passages = spark.createDataFrame([(1, 3, "fiqh", "باب الوضوء"), (2, 1, "fiqh", "كتاب الصلاة"), (3, 2, "other", "plain words here"), (4, 5, "fiqh", "الغسل من الجنابة")], "id int, level int, category string, text string")
    queries = spark.createDataFrame([(1, "wudhu"), (2, "plain words"), (3, "  "), (4, "plain nothing")], "qid int, text string")
    found = {(r["qid"], r["id"]) for r in search.search(queries, passages).collect()}
    assert (1, 1) in found and (2, 3) in found and not any(q in (3, 4) for q, _ in found)
    assert {r["id"] for r in search.search_by_authority(queries.where("qid = 1"), passages).collect()} <= {1, 2, 3}
    assert search.search(queries, passages, category="other").select("id").distinct().collect()[0]["id"] == 3
    built = {r["qid"]: r for r in search.built(queries).collect()}
    assert built[1]["domain"] == "tahara" and built[2]["clauses"] == [["plain", "words"]]


def test_dnf_scores_only_matched_clauses(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "b"), (4, "d"), (5, "d e f")], "id int, text string")
    tokens = index.tokenized(docs, "text")
    asked = spark.createDataFrame([(1, 0, "c"), (1, 1, "a"), (1, 1, "b")], "qid int, clause int, term string")
    assert {r["id"] for r in bm25.bm25(asked, tokens).collect()} == {1, 2}
    alone = spark.createDataFrame([(1, 0, "c")], "qid int, clause int, term string")
    ranks = lambda q: {r["id"]: round(r["rank"], 9) for r in bm25.bm25(q, tokens).collect()}
    assert ranks(asked)[2] == ranks(alone)[2]


def test_index_changes(spark):
    tokens = index.tokenized(spark.createDataFrame([(1, "a b"), (2, "b")], "id int, text string"), "text")
    fresh = index.tokenized(spark.createDataFrame([(2, "z")], "id int, text string"), "text")
    changed = index.changed_postings(index.postings(tokens), spark.createDataFrame([(1,)], "id int"), fresh)
    assert [(r["term"], r["id"]) for r in changed.collect()] == [("z", 2)]


def test_topic_parse_takes_the_first_of_equals(spark):
    rules = spark.createDataFrame([(0, "x", ["wudhu"]), (1, "y", ["wudhu"]), (2, "z", ["shalat lima waktu"])], "ord int, key string, keywords array<string>")
    questions = spark.createDataFrame([(1, "Cara WUDHU"), (2, "hukum shalat lima waktu"), (3, "nothing")], "qid int, text string")
    assert {r["qid"]: r["topic"] for r in knowledge.parse_topics(questions, rules).collect()} == {1: "x", 2: "z", 3: None}
    assert {(r["qid"], r["key"]): r["score"] for r in knowledge.keyword_scores(questions, rules).collect()}[(2, "z")] == 5


def test_text_functions(spark):
    assert column(spark, ["<b>&\"'", "  a \n b "], lambda c: text.sanitized(c)) == ["&lt;b&gt;&amp;&quot;&#x27;", "a b"]
    codes = ["", "ab", "abc", "x" * 500, "x" * 501, "<script>", "JavaScript : x", "onload = 1", "a -- b", "; DROP t", "../etc", None, "' is fine"]
    assert column(spark, codes, lambda c: text.question_error(c, text.sanitized(c))) == ["blank", "short", None, None, "long"] + ["suspicious"] * 6 + ["blank", None]
    assert column(spark, [" Shafii ", "HANAFI", "other", None], text.school) == ["shafii", "hanafi", None, None]
    assert column(spark, ["أإآى", "كَتَبَ x 5"], text.search_form) == ["اااي", "كتب 5"]
    assert column(spark, ["page_1_0265", " page_1_2 ", "باب الطهارة"], text.is_page_anchor) == [True, True, False]
    assert column(spark, ["", "page_1_2", "باب الطهارة", "اب", None], text.is_title) == [False, False, True, False, False]
    assert column(spark, ["باب الوضوء", "بابالوضوء", "كتاب " + "ا" * 130], text.opens_chapter) == [True, False, False]
    assert column(spark, ["apa itu?", "jelaskan x", "hukum x", "cara x", "x", "what"], text.input_type) == ["pertanyaan", "permintaan_penjelasan", "permintaan_fatwa", "permintaan_prosedur", "pernyataan", "pertanyaan"]
    assert column(spark, ["ما", "how is it", "apa yang", "x"], text.language) == ["ar", "en", "id", "id"]
    assert column(spark, ["ab ab", "", "x y"], text.density) == [0.5, 0.0, 1.0]
    assert column(spark, ["وضوء وصلاة", "none"], text.topic_hints) == ["thaharah,shalat", ""]
    assert column(spark, ["ا b", "", " \n"], text.char_ratio) == [0.5, 0.0, 0.0]
    assert column(spark, ["é", "a\u0000b", "a \t b\n\n\n\nc "], text.tidy) == ["é", "ab", "a b\n\nc"]
    assert column(spark, ["a " * 150, "short"], text.truncated) == [("a " * 150)[:280].rsplit(" ", 1)[0] + " ...", "short"]
    assert column(spark, ["x" * 200, "x" * 201, "y" * 199 + " z"], text.excerpt) == ["x" * 200, "x" * 200 + "…", "y" * 199 + "…"]


def test_domain_scores(spark):
    rows = spark.createDataFrame([(1, "hukum zakat fitrah"), (2, "hello")], "qid int, text string")
    seen = {r["qid"]: r for r in reasoning.perceive(rows).collect()}
    assert seen[1]["primary_domain"] == "zakat" and seen[2]["domains"][0]["domain"] == "umum" and seen[2]["l1"] == pytest.approx(0.6 + 0.2 + 0.2 / 15, abs=1e-4)


def test_html_elements_and_carried_titles(spark):
    page = "<html><head><title>x</title></head><nav><p>no</p></nav><h2 id='page_1_0001'>باب الطهارة</h2><p>نص طويل من الكلام العربي</p><div><p>نص آخر طويل من الكلام</p></div><script>var a='</p>'</script><p>باب الغسل<p>نص ثالث طويل من الكلام</p>"
    pages = spark.createDataFrame([(1, "b", page), (2, "b", "<p>نص في صفحة أخرى من الكتاب"), (3, "b", None), (4, "b", "")], "page_id int, book string, html string")
    found = html.passages(pages, "book").orderBy("page", "pos").collect()
    assert [(r["page"], r["chapter_title"], r["page_ref"]) for r in found] == [(1, "باب الطهارة", "page_1_0001"), (1, "باب الطهارة", "page_1_0001"), (1, "باب الغسل", "page_1_0001"), (2, "باب الغسل", "page_1_0001")]
    assert [r["page_order"] for r in html.paragraph_passages(pages, "book").orderBy("page_order").collect()] == list(range(1, html.paragraph_passages(pages, "book").count() + 1))


def test_ingest_skips_loaded_books(spark):
    text = "<p>" + "نص عربي طويل " * 20
    pages = spark.createDataFrame([(1, "a/p1.xhtml", text, "x"), (2, "a/p2.xhtml", text, "y")], "page_id long, url string, html string, slug string")
    books = spark.createDataFrame([("x",), ("y",)], "slug string")
    loaded = spark.createDataFrame([("x", 5), ("y", 0)], "slug string, total_passages int")
    assert [r["slug"] for r in html.ingest(pages, books, loaded).collect()] == ["y"]
    assert {r["slug"] for r in html.ingest(pages, books, loaded, reset="x").collect()} == {"x", "y"}
    assert html.ingest(pages, books, loaded, only="none").count() == 0


def test_cache_round_trip(spark, tmp_path):
    empty = sources.read_cache(spark, str(tmp_path / "missing"))
    assert empty["verses"].count() == 0 and empty["verses"].columns[0] == "ord"
    verses = spark.createDataFrame([(0, "a", "text", "water")], "ord int, key string, arabic_text string, theme string")
    narrations = spark.createDataFrame([(0, "n", "src")], "ord int, key string, source string")
    sources.write_cache(spark, verses, narrations, str(tmp_path / "cache"))
    again = sources.read_cache(spark, str(tmp_path / "cache"))
    assert again["verses"].first()["theme"] == "water" and again["narrations"].first()["source"] == "src"
    document = json.loads(spark.read.text(str(tmp_path / "cache"), wholetext=True).first()[0])
    assert document["_meta"]["total_quran"] == 1
    (tmp_path / "bad").write_text("{not json")
    assert sources.read_cache(spark, str(tmp_path / "bad"))["verses"].count() == 0


def test_sliding_log_keeps_rejected_events_out(spark):
    assert gateway.accepted([0, 1, 2, 10, 11], 2, 10) == [True, True, False, True, True]
    assert gateway.accepted([0, 0, 0], 2, 10) == [True, True, False]


def test_sliding_log_of_null_keys_in_small_batches(spark):
    """One log for all of a null key, whatever the batches; whole ids beside null ones; the wait is until the next pass."""
    large = 2**60 + 1
    at = [(large if i == 3 else None if i == 4 else i, None if i < 30 else 5, i * 1_000_000) for i in range(60)]
    rows = spark.createDataFrame([*at, (99, None, None)], "event_id long, user_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        out = gateway.sliding_log(rows, 3, 10).select("event_id", "user_id", F.unix_micros("ts").alias("us"), "allowed", "retry_after").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    timed = sorted((r for r in out if r["us"] is not None), key=lambda r: r["us"])
    for k, first in ((None, 0), (5, 30)):
        own = [r for r in timed if r["user_id"] == k]
        assert [r["allowed"] for r in own] == gateway.accepted([r["us"] for r in own], 3, 10_000_000)
        assert own[0]["us"] == first * 1_000_000 and [r["retry_after"] for r in own[:11]] == [None] * 3 + [7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0, None]
    assert {r["event_id"] for r in out} >= {large, None} and [(r["allowed"], r["retry_after"]) for r in out if r["us"] is None] == [(False, None)]


def test_stream_equals_batch(spark, data, tmp_path):
    rows = sources.table(spark, data, "events").select("event_id", "user_id", "ts")
    rows.orderBy("ts", "event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streaming.stream_limit(stream, 2, 86_400).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {(r["event_id"], r["allowed"]) for r in gateway.sliding_log(rows, 2, 86_400).collect()}
    assert {(r["event_id"], r["allowed"]) for r in spark.table("limited").collect()} == batch


def test_stream_maintains_index(spark, tmp_path):
    """An insert, an update and a delete; what is read equals an index of the documents that are left."""
    schema = "id int, text string, gone boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: streaming.maintain_index(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "c"), removed="gone").awaitTermination(60)
    stored = index.Stored(spark, str(tmp_path / "index"))
    terms = lambda s: {(r["term"], r["id"], r["tf"], r["length"]) for r in s.postings().collect()}
    put([(1, "a b", None), (2, "b", False)])
    run()
    assert terms(stored) == {("a", 1, 1, 2), ("b", 1, 1, 2), ("b", 2, 1, 1)}
    put([(2, "z", None), (3, "b b c", None)])
    run()
    assert terms(stored) == {("a", 1, 1, 2), ("b", 1, 1, 2), ("z", 2, 1, 1), ("b", 3, 2, 3), ("c", 3, 1, 3)}
    put([(1, None, True), (4, "a", None)])
    run()
    left = index.tokenized(spark.createDataFrame([(2, "z"), (3, "b b c"), (4, "a")], "id int, text string"), "text")
    asked = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "z")], "qid int, clause int, term string")
    ranks = lambda source: {(r["qid"], r["id"], round(r["rank"], 9)) for r in bm25.bm25(asked, source).collect()}
    for s in (stored, stored.compacted(str(tmp_path / "new"))):
        assert terms(s) == {("z", 2, 1, 1), ("b", 3, 2, 3), ("c", 3, 1, 3), ("a", 4, 1, 1)}
        assert ranks(s) == ranks(left) and tuple(s.statistics().first()) == tuple(index.statistics(left).first())


def test_stored_index_reads_only_the_folders_of_its_terms(spark, data, tmp_path):
    from quillstone.plans import search_queries as q

    tokens = q.tokens(spark, data)
    stored = index.write_index(tokens, str(tmp_path))
    asked = q.asked(spark, q.DNF)
    ranks = lambda source: sorted((r["qid"], r["id"], round(r["rank"], 9)) for r in bm25.bm25(asked, source).collect())
    assert ranks(stored) == ranks(tokens) != []
    found = bm25.bm25(asked, stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "slot#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "regexp" not in plan


def test_phrases_and_fields(spark, tmp_path):
    docs = [(1, "a b c a b", "x y"), (2, "b a", "a"), (3, None, "a b"), (4, "a. B! a, a", None), (5, "", ""), (6, "b", "x")]
    rows = spark.createDataFrame(docs, "id int, text string, title string")
    stored = index.write_index(index.placed(rows, "text", "title"), str(tmp_path / "i"), kind=index.Fielded)
    fields = ("text", "title")
    asked = {'"a b"': {1, 3, 4}, '"b a"': {2, 4}, 'text:"a b"': {1, 4}, "title:a": {2, 3}, '"a b a"': {4}, '"a a"': {4}, '"b c" x': {1}, "x b": {1, 6}, '"y a" OR title:x': {1, 6}, '"b x"': set(), "": set(), '"': set(), "no:b": set(), "OR": set(), None: set()}
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, text string")
    out = phrases.phrase_search(queries, stored, fields).collect()
    assert {q: {r["id"] for r in out if r["qid"] == i} for i, q in enumerate(asked)} == asked
    places = {r["id"]: r["tf"] for r in phrases.phrase_postings(spark.createDataFrame([("t", None, ["a", "b"])], "term string, field int, words array<string>"), stored).collect()}
    assert places == {1: 2, 3: 1, 4: 1}
    # A delta: a changed and a removed document; the compacted index says the same.
    stored.add(index.placed(spark.createDataFrame([(3, "b a", None)], rows.schema), *fields), 1, spark.createDataFrame([(1,)], "id int"))
    for s in (stored, stored.compacted(str(tmp_path / "j"))):
        assert isinstance(s, index.Fielded) and {r["id"] for r in phrases.phrase_search(queries.where("qid < 2"), s, fields).collect()} == {2, 3, 4}


def test_folded_letters(spark):
    rows = spark.createDataFrame([(1, "Élève à l'école"), (2, "eleve"), (3, None)], "id int, text string")
    folded = {r["id"]: r["words"] for r in index.tokenized(rows, "text", fold=True).collect()}
    assert folded == {1: ["eleve", "a", "l", "ecole"], 2: ["eleve"], 3: []} and index.tokenized(rows, "text").first()["words"][0] == "élève"


def test_answers_and_citations(spark):
    hit = "array<struct<book:string,level:int,chapter:string,page:string,text:string,score:double>>"
    rows = spark.createDataFrame([(1, [("al_umm", 1, "ch", "p1", "x" * 250, 0.9), ("b", None, None, None, "t", None)] * 2)], f"qid int, hits {hit}")
    found = rows.select(answer.citations(F.col("hits"), {"al_umm": "Al-Umm"}).alias("c"), answer.corpus_text(F.col("hits"), F.lit("shafii")).alias("t")).first()
    assert [c["book_name"] for c in found["c"]] == ["Al-Umm", "b", "Al-Umm"] and found["c"][0]["excerpt"] == "x" * 200 + "…" and found["c"][1]["authority_level"] == 5
    assert "RUJUKAN KITAB: (4 temuan)" in found["t"] and "  [2] B\n" in found["t"]
    asked = spark.createDataFrame([(1, ""), (2, "apa itu zakat")], "qid int, text string")
    told = answer.ask(asked, lambda q: q.select("qid", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason")))
    assert {r["qid"]: (r["status"], r["reason"]) for r in told.collect()} == {1: ("invalid", "blank"), 2: ("ok", None)}


def test_plans_push_filters_down(spark, data):
    rows = search.filtered(sources.table(spark, data, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.lit(1).alias("level")), "en")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_command_line(spark, data, tmp_path, capsys):
    from quillstone.__main__ import main
    from quillstone.plans.search_queries import passages

    passages(spark, data).write.parquet(str(tmp_path / "p"))
    main(["search", str(tmp_path / "p"), "the and", "und die", "--limit", "2"])
    main(["stats", str(tmp_path / "p")])
    assert "total_chars" in capsys.readouterr().out
    text = "<p>" + "نص عربي طويل " * 20
    spark.createDataFrame([(1, "a/p1.xhtml", text, "x")], "page_id long, url string, html string, slug string").write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("x", "fiqh", 1, 0)], "slug string, category string, level int, total_passages int").write.parquet(str(tmp_path / "books"))
    main(["ingest", str(tmp_path / "pages"), str(tmp_path / "books"), str(tmp_path / "out"), "--dry-run"])
    main(["ingest", str(tmp_path / "pages"), str(tmp_path / "books"), str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).first()["category"] == "fiqh"


def test_keywords_meet_topics_as_by_brute_force(spark):
    rng = random.Random(4)
    some = lambda most: "".join(rng.choice("ab ü") for _ in range(rng.randint(0, most)))
    rules = [(i, some(3), [some(7) for _ in range(rng.randint(0, 3))]) for i in range(25)]
    topics = [(i, some(12)) for i in range(60)] + [(60, rules[3][1]), (61, None), (62, "  ")]
    themes = [(i, some(9)) for i in range(20)]
    known = spark.createDataFrame(rules, "ord int, key string, keywords array<string>")
    asked = spark.createDataFrame(topics, "qid int, topic string")
    got = {r["qid"]: r for r in knowledge.matched(asked, known, spark.createDataFrame(themes, "ord int, theme string"), 2).collect()}
    want = {}
    for qid, topic in topics:
        t = (topic or "").strip(" ").lower()
        if t:
            exact = next((k for _, k, _ in rules if k == t), None)
            near = next((k for _, k, words in rules if any(w in t or t in w for w in words)), None) if exact is None else None
            themed = [o for o, theme in themes if t in theme][:2] if exact is None and near is None else []
            want[qid] = (exact, near, themed)
    assert {q: (r["exact"], r["by_keyword"], [v["ord"] for v in r["themed"] or []]) for q, r in got.items()} == want
    scores = {}
    for qid, topic in topics:
        for o, key, words in rules:
            t = topic or ""
            n = sum(2 * (topic is not None and w in t.strip(" ").lower()) + len(set(t.lower().split()) & set(w.split())) for w in words)
            if n:
                scores[(qid, o)] = n
    found = knowledge.keyword_scores(asked.withColumnRenamed("topic", "text"), known).collect()
    assert {(r["qid"], r["ord"]): r["score"] for r in found} == scores
    assert knowledge.keyword_scores(asked.withColumnRenamed("topic", "text"), known.limit(0)).count() == 0
    assert {r["by_keyword"] for r in knowledge.matched(asked, known.limit(0)).collect()} == {None}


def test_keyword_matching_is_equi_joins(spark):
    rules = spark.createDataFrame([(0, "x", ["wudhu"])], "ord int, key string, keywords array<string>")
    plan = knowledge.matched(spark.createDataFrame([(1, "wudhu")], "qid int, topic string"), rules)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan


def test_topics_are_looked_up_once(spark, tmp_path):
    rules = spark.createDataFrame([(0, "x", ["wudhu"])], "ord int, key string, keywords array<string>")
    themes = spark.createDataFrame([(0, "water"), (1, "the water")], "ord int, theme string")
    spark.createDataFrame([(1, "wudhu"), (2, "wat"), (3, "no")], "qid int, topic string").write.parquet(f"{tmp_path}/topics")
    found = knowledge.matched(spark.read.parquet(f"{tmp_path}/topics"), rules, themes, 1)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["qid"]: (r["by_keyword"], r["themed"] and [v["ord"] for v in r["themed"]]) for r in found.collect()} == {1: ("x", None), 2: (None, [0]), 3: (None, None)}


@pytest.mark.parametrize("most", [0, 500])
def test_anchors_that_topics_hold(spark, monkeypatch, most):
    monkeypatch.setattr(knowledge, "MOST_ANCHORS", most)
    keywords = ["a.", "\\E|x", "(?=", "$^", "aa", "aaab", "aab c", "\U0001f600\U0001f601", "[a", "a\nb", "", None]
    topics = ["xa.", "ab", "\\E|x", "z\\e|x", "(?=)", "q$^", "aaab", "caab c", "\U0001f602\U0001f600\U0001f601", "\U0001f601", "x[a", "a\nb."]
    for kept in (keywords, keywords[:-2]):
        known = spark.createDataFrame([(i, f"k{i}", [k]) for i, k in enumerate(kept)], "ord int, key string, keywords array<string>")
        asked = spark.createDataFrame(list(enumerate(topics)), "qid int, topic string")
        want = {q: next((f"k{i}" for i, k in enumerate(kept) if k is not None and (k in t.lower() or t.lower() in k)), None) for q, t in enumerate(topics)}
        assert {r["qid"]: r["by_keyword"] for r in knowledge.matched(asked, known).collect()} == want


@pytest.mark.parametrize("most", [0, 100_000])
def test_clauses_of_several_words_as_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(bm25, "MOST", most)
    monkeypatch.setattr(bm25, "SLICE", 7)
    rng = random.Random(7)
    some = lambda n: [rng.choice("aaabbbccdef") for _ in range(rng.randint(0, n))]
    docs = {f"d{i}": some(9) for i in range(40)} | {"e": []}
    clauses = [(q, c, t) for q in range(30) for c in range(rng.randint(1, 3)) for t in some(4) + rng.choice([[], ["nosuchword"]])] + [(30, 0, "a"), (31, 0, None)]
    tokens = spark.createDataFrame(list(docs.items()), "id string, words array<string>").repartition(3)
    out = bm25.bm25(spark.createDataFrame(clauses, "qid int, clause int, term string"), tokens)
    if most:  # documents are not joined with what they might match
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    df = {t: sum(t in w for w in docs.values()) for t in "abcdef"}
    average = sum(map(len, docs.values())) / len(docs)
    want = {}
    for q, c in {x[:2] for x in clauses}:
        own = [t for x, y, t in clauses if (x, y) == (q, c)]
        for key, words in docs.items():
            if all(t in words for t in own):
                idf = lambda t: max(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)), 0) or 1e-6
                score = lambda t: idf(t) * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / average))
                want[q, key] = want.get((q, key), 0) - sum(map(score, own))
    assert {(r["qid"], r["id"]): r["rank"] for r in out.collect()} == pytest.approx(want)


def test_texts_of_passages_are_not_shuffled(spark):
    rows = [(i, i % 5 + 1, "en", f"some {w} words") for i, w in enumerate(["qqa", "qqb", "qqa qqb", "qqc"])]
    passages = spark.createDataFrame(rows, "id long, level int, category string, text string")
    queries = spark.createDataFrame([(1, "qqa words"), (2, "qqb"), (3, "qqd")], "qid int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = search.search(queries, passages)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r["qid"], r["id"], r["text"]) for r in out.collect()} == {(1, 0, "some qqa words"), (1, 2, "some qqa qqb words"), (2, 1, "some qqb words"), (2, 2, "some qqa qqb words")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
