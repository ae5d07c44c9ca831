import duckdb
import pytest

from quillstone import plans

from .compare import same_rows


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, data, name):
    same_rows(plans.QUERIES[name](spark, data), plans.ORACLE_SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_runs(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() > 0


@pytest.fixture
def folder(spark, tmp_path):
    turns = [(1, 1, "user", "so " * 40 + "zakat zakat"), (7, 1, "user", "good day")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    documents = [(i, f"{w} words of a book", "en", f"src{i}", 20) for i, w in enumerate(["umum", "other", "more umum", "umum"])]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_reasoned_answer_reads_whole_questions(spark, folder):
    out = {x["qid"]: x for x in plans.QUERIES["reasoned_answer"](spark, folder).collect()}
    assert out[1001]["primary_domain"] == "zakat" and out[7001]["primary_domain"] == "umum"


def test_cascade_joins_rules_once(spark, data):
    plan = plans.QUERIES["cascade_retrieve"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("Join ") <= 10


def test_html_headings_on_odd_pages(spark, tmp_path):
    heads = ["<h1>a&amp;&amp</h1>", "<h1>a&#39;b &eacute; &amp;lt; &lt;b&gt; &quot;</h1>", "<h1 class=x>a</h1>", "", None, "<h1>a</h1><h1>b</h1>", "<h1>a <b>b</b> </h1>", "<h1>a\nb</h1> <h1>\u00a0 c\u2003</h1>", "<H1>a</H1>", "<h1>a\rb\r</h1>", "<h1>open",
             "<script><h1>in</h1></script><h1>out</h1>", "<!-- <h1>in</h1> --><h1>out</h1>", "<h1></h1>", "<h1>\ta\u2028b $1 \\1\u0085</h1>"]
    spark.createDataFrame(list(enumerate(heads)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(plans.ORACLE_SQL["html_headings"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    out = plans.QUERIES["html_headings"](spark, str(tmp_path)).select("page_id", "text").collect()
    assert sorted(map(tuple, out)) == sorted(want)


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
