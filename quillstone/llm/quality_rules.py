"""Quality rules: cross-document line frequency.

Normalised lines are hashed; for each host (source) the distinct documents that have a line are counted. Lines in more
documents of the host than the limit are removed, whatever the size of the host. A document that the base rules pass is
rejected if too little of it is left. All is DataFrame functions; documents are made distinct by a shuffle on host, line
and id, so that no line is a hot spot, and lines above the limit are joined back by a salted key.

Defined results: a null text has no words and fails the base rules. A null source is a host of its own. Copies are
documents of their own: where a line is in more of them than the limit, it goes from all. Rows with the same doc_id are
one document of the counts (so are null ids), and are judged each. Texts are read whole, however long. Windows of a text
with fewer than five words don't exist. An empty table gives an empty result. Columns besides doc_id, text and source are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, let, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base limits: least words, and most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: A line is removed if more documents of its host have it.
MOST_DOCUMENTS = 20
#: A document is rejected if fewer words, or a smaller share of its words, are left.
LEAST_LEFT, LEAST_SHARE_LEFT = 10, 0.5
SALTS = 16


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window found twice or more in the text; w: the words.

    Windows are compared by 64-bit hashes of their words' hashes. Only texts whose windows aren't all distinct get the
    sorted list of (hash, place) from which the covered words are counted.
    """
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    last = F.size(w) - window
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[h[i + k] for k in range(window)])))

    def covered(at: Column) -> Column:
        """Of windows at these sorted places: each adds the words up to the next one, five at most."""
        gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(window)))
        return F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(window), lambda a, x: a + x)).otherwise(F.lit(0))

    def places(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda p, i, k: F.coalesce(F.get(p, i + k)["h"] == p[i]["h"], F.lit(False))
        found = let(pairs, lambda p: F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: same(p, i, -1) | same(p, i, 1)), lambda i: p[i]["i"]))
        return let(F.sort_array(found), covered)

    count = let(windows, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(places(hs)))
    return F.when(F.size(w) < window, F.lit(0)).otherwise(count).cast("long")


def has_word(line: Column) -> Column:
    return F.length(F.translate(line, WHITE, "")) > 0


def base(documents: DataFrame) -> DataFrame:
    """documents with the base columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = documents.withColumn("_words", words(F.col("text"))).withColumn("_lines", F.filter(F.split(text, "\n", -1), has_word))
    counted = counted.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.translate(text, WHITE, "")).cast("long"))
    counted = counted.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    counted = counted.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("n_repeat_words", repeated_words(F.col("_words")))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return counted.withColumn("base_failed", failed).drop("_words", "_lines")


def lines_of(text: Column) -> Column:
    """(hash of the normalised line, words) of each line with a word. Normal: lower case, digits as 0, single spaces."""
    plain = lambda line: F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), "[ \\t\\x0B\\f\\r]+", " "))
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), has_word)
    return F.transform(kept, lambda line: let(plain(line), lambda p: F.struct(F.xxhash64(p).alias("line"), (F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) + 1).alias("words"))))


def frequent_lines(documents: DataFrame, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """host and line for the lines above the limit."""
    texts = documents.select(F.coalesce(F.col("source"), F.lit("\0")).alias("host"), "doc_id", F.transform(lines_of(F.col("text")), lambda x: x["line"]).alias("lines"))
    each = texts.select("host", "doc_id", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    return each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most_documents).select("host", "line")


def judge(documents: DataFrame, **limits) -> DataFrame:
    """doc_id, the base columns, n_removed_words (of frequent lines) and kept for each document."""
    frequent = frequent_lines(documents, **limits).select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = base(documents.select("doc_id", "text", F.coalesce(F.col("source"), F.lit("\0")).alias("host")))
    # The base columns go with the first line of a document alone; one without lines gets a line that is none.
    none = F.array(F.struct(F.lit(None).cast("long").alias("line"), F.lit(0).alias("words")))
    lines = judged.select(F.monotonically_increasing_id().alias("uid"), "host", "doc_id", *columns, "base_failed", lines_of(F.col("text")).alias("lines"))
    lines = lines.select("uid", "host", "doc_id", *columns, "base_failed", F.posexplode(F.when(F.size("lines") > 0, F.col("lines")).otherwise(none)).alias("at", "x"))
    first = [F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("doc_id", *columns, "base_failed")]
    lines = lines.select("uid", "host", *first, F.col("x.line").alias("line"), F.col("x.words").alias("words"), F.pmod(F.col("uid") + F.col("at"), F.lit(SALTS)).cast("int").alias("salt"))
    marked = lines.join(frequent.withColumn("frequent", F.lit(True)), ["host", "line", "salt"], "left")
    summed = marked.groupBy("uid").agg(*[F.max(c).alias(c) for c in ("doc_id", *columns, "base_failed")], F.sum(F.when(F.col("frequent"), F.col("words")).otherwise(0)).alias("n_removed_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    kept = ~F.col("base_failed") & (left >= LEAST_LEFT) & (left >= F.col("n_words") * LEAST_SHARE_LEFT)
    return summed.select("doc_id", *columns, "base_failed", kept.alias("kept"), "n_removed_words")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM d),
c AS (SELECT k, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT k, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, gram) > 1),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range(5) AS x(j) GROUP BY k),
l AS (SELECT k, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS line FROM (SELECT k, unnest(lines) AS x FROM c)),
f AS (SELECT d.host, l.line FROM l JOIN d USING (k) GROUP BY ALL HAVING count(DISTINCT d.doc_id) + max((d.doc_id IS NULL)::INT) > {MOST_DOCUMENTS}),
s AS (SELECT l.k, sum(len(string_split(line, ' '))) AS n FROM l JOIN d USING (k) JOIN f USING (host, line) GROUP BY l.k),
o AS (SELECT d.doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(s.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN c USING (k) LEFT JOIN r USING (k) LEFT JOIN s USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND n_words - n_removed_words >= {LEAST_LEFT} AND n_words - n_removed_words >= n_words * {LEAST_SHARE_LEFT} AS kept, n_removed_words FROM o
"""
