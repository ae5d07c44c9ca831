"""The knowledge base: topic parsing, the retrieval cascade, references, integrity, cache merge.

rules(ord, key, ruling, school, basis_verses, basis_narrations, keywords, reasoning, confidence); verses(ord, key,
reference, arabic_text, translation, theme, ...); narrations(ord, key, source, authenticity, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources import bounded


#: Letters of the grams by which texts meet the keywords that they may hold.
GRAM = 4
#: Anchors that one expression looks for.
MOST_ANCHORS = 500


def _grams(text: Column, lengths=range(GRAM + 1)) -> Column:
    """Distinct runs of so many letters: whatever the text holds begins with one, if its anchor has one of these lengths."""
    run = lambda letters, n: F.transform(F.sequence(F.lit(1), F.size(letters) - (n - 1)), lambda i: F.array_join(F.slice(letters, i, n), ""))
    runs = lambda letters, n: F.when(F.size(letters) >= n, run(letters, n)).otherwise(F.array().cast("array<string>"))
    every = lambda letters: F.concat(*[runs(letters, n) if n else F.array(F.lit("")) for n in lengths])
    # A lambda's variable holds the letters, so that they are split once a text however the plan is put together.
    split = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_distinct(F.transform(F.array(split), every)[0])


def _anchor(text: Column) -> Column:
    return F.substring(text, 1, GRAM)


def _lengths(parts: DataFrame, part: str) -> list[int]:
    """Lengths that the anchors have: GRAM + 1 numbers at most."""
    return sorted(r[0] for r in parts.select(F.length(_anchor(F.col(part)))).distinct().collect() if r[0] is not None)


def _held_anchors(text: Column, parts: DataFrame, part: str) -> Column:
    """Distinct anchors of the parts that the text holds; with more than MOST_ANCHORS of them, all of its runs that have their lengths."""
    known = [r[0] for r in parts.select(_anchor(F.col(part)).alias("a")).where("a is not null").distinct().limit(MOST_ANCHORS + 1).collect()]
    if len(known) > MOST_ANCHORS:
        return _grams(text, _lengths(parts, part))
    quoted = lambda a: "\\Q" + a.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    # Anchors of one length: at each place of the text no more than one of them begins. Looking ahead finds those that overlap.
    at = lambda n: "(?=(" + "|".join(quoted(a) for a in known if len(a) == n) + "))"
    found = [F.regexp_extract_all(text, F.lit(at(n)), F.lit(1)) if n else F.array(F.lit("")) for n in sorted({len(a) for a in known})]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def held(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Pairs of rows whose text holds the part: an equi-join of the text's grams with the anchor of the part, and a look at the pairs that meet.

    parts go to every task if they are few; else both sides are shuffled by gram.
    """
    lengths = _lengths(parts, part)
    if not lengths:
        return texts.join(parts.limit(0), F.lit(False))
    # The outer explode spares Spark a filter that would make the grams a second time.
    each = texts.withColumn("_gram", F.explode_outer(_grams(F.col(text), lengths)))
    known = bounded(parts.withColumn("_anchor", _anchor(F.col(part))))
    return each.join(known, (F.col("_gram") == F.col("_anchor")) & F.col(text).contains(F.col(part))).drop("_gram", "_anchor")


def keyword_scores(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """qid, key, ord and score of each question(qid, text) and rule with a match: per keyword 2 if the question holds it, and its words in common.

    Words in common are an equi-join with the table of the keywords' words; keywords that the question holds are found by held().
    """
    words = lambda text: F.array_distinct(F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != ""))
    known = rules.select("key", "ord", F.explode("keywords").alias("keyword"))
    by_word = known.select("key", "ord", F.explode(words(F.col("keyword"))).alias("word")).groupBy("word", "key", "ord").agg(F.count("*").alias("score"))
    common = questions.select("qid", F.explode(words(F.col("text"))).alias("word")).join(bounded(by_word), "word").select("qid", "key", "ord", "score")
    whole = known.groupBy("key", "ord", F.lower("keyword").alias("keyword")).agg((F.count("*") * 2).alias("score"))
    held_ones = held(questions.select("qid", F.lower(F.trim("text")).alias("text")), "text", whole, "keyword").select("qid", "key", "ord", "score")
    return common.union(held_ones).groupBy("qid", "key", "ord").agg(F.sum("score").alias("score"))


def parse_topics(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """qid and topic: the rule of the highest score, the first one of equals; null without a match."""
    best = keyword_scores(questions, rules).groupBy("qid").agg(F.max_by("key", F.struct("score", -F.col("ord"))).alias("topic"))
    return questions.select("qid").join(best, "qid", "left")


def _indexed(rules: DataFrame) -> DataFrame:
    """way, gram, key, ord and keyword: where topics look rules up: '=' by their key, '<' by the anchor of a keyword that the topic may hold, '>' by any gram of a keyword that may hold the topic."""
    each = rules.select("key", "ord", F.explode("keywords").alias("keyword"))
    ways = [
        rules.select(F.lit("=").alias("way"), F.col("key").alias("gram"), "key", "ord", F.col("key").alias("keyword")),
        each.select(F.lit("<").alias("way"), _anchor(F.col("keyword")).alias("gram"), "key", "ord", "keyword"),
        each.select(F.lit(">").alias("way"), F.explode_outer(_grams(F.col("keyword"))).alias("gram"), "key", "ord", "keyword"),
    ]
    return ways[0].union(ways[1]).union(ways[2])


def _looked_up(topics: DataFrame, rules: DataFrame) -> DataFrame:
    """qid, topic, exact (the first rule of that key) and near (the first rule with a keyword that the topic holds or is held by), null without one.

    One equi-join of what the topics may meet with the rules' index: it goes to every task if it is small, else both are shuffled by gram.
    """
    topic = F.col("topic")
    look = lambda way, grams: F.transform(grams, lambda g: F.struct(F.lit(way).alias("way"), g.alias("gram")))
    anchors = _held_anchors(topic, rules.select(F.explode("keywords").alias("keyword")), "keyword")
    ways = F.concat(look("=", F.array(topic)), look(">", F.array(_anchor(topic))), look("<", anchors))
    each = topics.select("qid", "topic", F.explode_outer(ways).alias("_look")).select("qid", "topic", F.col("_look.way").alias("_way"), F.col("_look.gram").alias("_gram"))
    known = _indexed(rules)
    fits = F.when(F.col("way") == "=", F.lit(True)).when(F.col("way") == "<", topic.contains(F.col("keyword"))).otherwise(F.col("keyword").contains(topic))
    met = each.join(bounded(known), (F.col("_way") == F.col("way")) & (F.col("_gram") == F.col("gram")) & fits, "left")
    first = lambda is_exact: F.min(F.when((F.col("way") == "=") == F.lit(is_exact), F.struct("ord", "key")))["key"]
    return met.groupBy("qid", "topic").agg(first(True).alias("exact"), first(False).alias("near"))


def matched(topics: DataFrame, rules: DataFrame, verses: DataFrame | None = None, limit: int = 3) -> DataFrame:
    """qid, topic (trimmed, lower case) and what the first layers find for each topic(qid, topic) that isn't blank; equal rows are one.

    exact: the rule of that key; by_keyword: else the first rule with a keyword that the topic contains or is contained in;
    themed: else the first of the verses whose theme contains the topic. Each is null without a match. Only the first
    verses of each theme can be among the first of all, so a theme takes part once, with at most limit of them.
    """
    found = _looked_up(topics.select("qid", F.lower(F.trim("topic")).alias("topic")).where("topic <> ''"), rules)
    found = found.withColumn("by_keyword", F.when(F.col("exact").isNull(), F.col("near"))).drop("near")
    if verses is None:
        return found
    ranked = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("ord"))
    first = verses.select(F.lower("theme").alias("_theme"), "ord", F.struct(*verses.columns).alias("x")).where("_theme is not null")
    by_theme = first.withColumn("_at", ranked("_theme")).where(F.col("_at") <= limit).groupBy("_theme").agg(F.collect_list(F.struct("ord", "x")).alias("_verses"))
    themes = by_theme.withColumn("_gram", F.explode_outer(_grams(F.col("_theme"))))
    # A left join, grouped by what its rows are dealt by already: the topics are looked up once.
    own, open_ = ["qid", "topic", "exact", "by_keyword"], F.col("exact").isNull() & F.col("by_keyword").isNull()
    fits = (F.col("_anchor") == F.col("_gram")) & open_ & F.col("_theme").contains(F.col("topic"))
    met = found.withColumn("_anchor", _anchor(F.col("topic"))).join(bounded(themes), fits, "left").select(*own, F.explode_outer("_verses").alias("v"))
    best = met.select(*own, "v.*").withColumn("_at", F.row_number().over(Window.partitionBy("qid", "topic").orderBy("ord"))).where(F.col("_at") <= limit)
    each = best.groupBy(*own).agg(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("_at", "x")))).alias("_all"))
    return each.select(*own, F.when(F.size("_all") > 0, F.transform("_all", lambda v: v["x"])).alias("themed"))


def first_keyword_match(topics: DataFrame, rules: DataFrame) -> DataFrame:
    """qid and key: the first rule with a keyword that the topic contains or is contained in, whatever its key."""
    found = _looked_up(topics.select("qid", F.lower(F.trim("topic")).alias("topic")), rules)
    return found.select("qid", F.col("near").alias("key")).where("key is not null")


def resolved(rows: DataFrame, refs: str, table: DataFrame, key: str, out: str) -> DataFrame:
    """rows(qid, refs) with the referred records in the order of the references; those that don't exist are left out."""
    each = rows.select("qid", F.posexplode(refs).alias("pos", "ref"))
    found = each.join(table, each["ref"] == table[key]).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*table.columns).alias("x")))).alias("found"))
    kind = table.schema.simpleString()
    return rows.join(found.select("qid", F.transform("found", lambda f: f["x"]).alias(out)), "qid", "left").withColumn(out, F.coalesce(out, F.array().cast(f"array<{kind}>")))


def broken_refs(rules: DataFrame, refs: str, table: DataFrame, key: str) -> DataFrame:
    """key and ref of references that lead nowhere."""
    each = rules.select(F.col("key").alias("rule"), F.explode(refs).alias("ref"))
    return each.join(table.select(F.col(key).alias("ref")), "ref", "left_anti").select(F.col("rule").alias("key"), "ref")


def evidence_of_rules(rules: DataFrame, verses: DataFrame, narrations: DataFrame, cached_verses: DataFrame, cached_narrations: DataFrame) -> DataFrame:
    """rules with the records that they refer to, in the order of the references, as verses and narrations.

    The cache steps in only where static evidence is thin, for keys that the static tables don't have. This depends on the
    rules alone, so it is computed once, however many questions there are.
    """
    out = rules
    for name, refs, static, cached in (("verses", "basis_verses", verses, cached_verses), ("narrations", "basis_narrations", narrations, cached_narrations)):
        record = F.struct(*static.columns)
        pool = static.select(F.col("key").alias("ref"), record.alias("x"), F.lit(0).alias("late")).unionByName(cached.select(F.col("key").alias("ref"), record.alias("x"), F.lit(1).alias("late")))
        each = rules.select(F.col("key").alias("rule"), F.posexplode(refs).alias("pos", "ref")).join(pool, "ref")
        one = each.groupBy("rule", "pos").agg(F.min_by(F.struct("x", "late"), "late").alias("r"))
        both = one.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("all"))
        of = lambda late: F.transform(F.filter("all", lambda f: f["r"]["late"] == late), lambda f: f["r"]["x"])
        both = both.select("rule", of(0).alias(name), of(1).alias(f"_more_{name}"))
        none = F.array().cast(f"array<{static.schema.simpleString()}>")
        out = out.join(both, F.col("key") == F.col("rule"), "left").drop("rule").withColumns({c: F.coalesce(c, none) for c in (name, f"_more_{name}")})
    thin = (F.size("verses") < 2) | (F.size("narrations") < 1)
    full = {n: F.when(thin, F.concat(n, f"_more_{n}")).otherwise(F.col(n)) for n in ("verses", "narrations")}
    return out.select(*[c for c in rules.columns], *[c.alias(n) for n, c in full.items()])


def cascade(topics: DataFrame, rules: DataFrame, verses: DataFrame, narrations: DataFrame, cached_verses: DataFrame, cached_narrations: DataFrame, hits: DataFrame | None = None, school: str = "shafii", found: DataFrame | None = None) -> DataFrame:
    """Retrieval for topics(qid, topic): by exact key, by keyword, by theme of cached verses, by full text; the first layer with a hit wins.

    hits(qid, hits) are the arrays of full-text hits; give them for unresolved(topics, ...) alone, so that no search runs
    for topics that an earlier layer answers. found: what matched() says of these topics, if that is known. Columns: qid, topic, layer, source, rule_key, ruling, school, verses,
    narrations, confidence, reasoning, keywords, needs_review, hits.
    """
    found = matched(topics, rules, cached_verses.select(*verses.columns)) if found is None else found
    found = found.withColumn("rule_key", F.coalesce("exact", "by_keyword"))
    known = evidence_of_rules(rules, verses, narrations, cached_verses, cached_narrations).drop("ord").withColumnRenamed("key", "_rule").withColumnRenamed("school", "_school")
    layered = found.join(known, F.col("rule_key") == F.col("_rule"), "left")
    layered = layered.join(hits, "qid", "left") if hits is not None else layered.withColumn("hits", F.array().cast("array<string>"))
    layer = F.when(F.col("exact").isNotNull(), 1).when(F.col("by_keyword").isNotNull(), 2).when(F.col("themed").isNotNull(), 3).when(F.size("hits") > 0, 4)
    layered = layered.withColumn("layer", layer).where("layer is not null")
    late = F.col("layer") > 2
    none = lambda df: F.array().cast(f"array<{df.schema.simpleString()}>")
    ruling = F.when(F.col("layer") == 3, fixed.THEME_RULING).when(F.col("layer") == 4, "").otherwise(F.col("ruling"))
    sources = F.element_at(F.array(*map(F.lit, ("static_rules", "keyword_search", "cache_extended", "kitab_corpus"))), F.col("layer"))
    return layered.select(
        "qid", F.when(F.col("layer") == 2, F.col("rule_key")).otherwise(F.col("topic")).alias("topic"), "layer", sources.alias("source"), "rule_key", ruling.alias("ruling"),
        F.coalesce("_school", F.lit(school)).alias("school"), F.coalesce(F.when(F.col("layer") == 3, F.col("themed")).otherwise(F.col("verses")), none(verses)).alias("verses"),
        F.coalesce("narrations", none(narrations)).alias("narrations"), F.when(late, "medium").otherwise(F.col("confidence")).alias("confidence"), F.when(late, "").otherwise(F.col("reasoning")).alias("reasoning"),
        F.when(late, F.array().cast("array<string>")).otherwise(F.col("keywords")).alias("keywords"), (F.col("layer") == 3).alias("needs_review"), "hits",
    )


def unresolved(topics: DataFrame, rules: DataFrame, cached_verses: DataFrame) -> DataFrame:
    """Topics that need the full-text layer."""
    return left_over(matched(topics, rules, cached_verses))


def left_over(found: DataFrame) -> DataFrame:
    """Those of them that matched() has found nothing for."""
    return found.where("exact is null and by_keyword is null and themed is null").select("qid", "topic")


def as_hits(found: DataFrame, limit: int | None = None) -> DataFrame:
    """qid and hits, best first, for a search's result(qid, position, book, level, chapter, page, text, score)."""
    fields = ("book", "level", "chapter", "page", "text", "score")
    each = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias("all"))
    hits = F.transform("all", lambda h: F.struct(*[h[f].alias(f) for f in fields]))
    return each.select("qid", (hits if limit is None else F.slice(hits, 1, limit)).alias("hits"))


def merge_cache(static: DataFrame, cache: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Records of both; of the same key, the static one, or the cache's with overwrite."""
    first, second = (cache, static) if overwrite else (static, cache)
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_counts(static: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """added and skipped records of the cache."""
    known = static.select(key, F.lit(1).alias("_known")).distinct()
    both = cache.join(known, key, "left")
    return both.agg(F.count_if(F.col("_known").isNull()).alias("added"), F.count_if(F.col("_known").isNotNull()).alias("skipped"))


def distribution(rows: DataFrame, column: str | Column) -> DataFrame:
    value = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("?"))
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def integrity(rules: DataFrame, verses: DataFrame, narrations: DataFrame) -> DataFrame:
    """One row: totals, broken references, stubs, records that are pending, and a status that only broken references turn."""
    broken = broken_refs(rules, "basis_verses", verses, "key").union(broken_refs(rules, "basis_narrations", narrations, "key"))
    one = lambda df, *columns: df.agg(*columns)
    parts = [
        one(rules, F.count("*").alias("rules")),
        one(verses, F.count("*").alias("verses"), F.count_if(F.coalesce(F.col("arabic_text").contains("PENDING"), F.lit(False))).alias("pending")),
        one(narrations, F.count("*").alias("narrations"), F.count_if(F.coalesce(F.col("status") == "stub", F.lit(False))).alias("stubs")),
        one(broken, F.count("*").alias("broken_refs")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))  # one row each
    return out.withColumn("status", F.when(F.col("broken_refs") > 0, "WARNINGS").otherwise("OK"))


def plan_missing(plan: DataFrame, cache: DataFrame, key: str, force: bool = False) -> DataFrame:
    """What has still to be fetched."""
    return plan if force else plan.join(cache.select(key), key, "left_anti")


def skip_loaded(items: DataFrame, loaded: DataFrame, key: str, reset: str | None = None) -> DataFrame:
    """Items without passages so far, and the one that is loaded anew."""
    done = loaded.where("total_passages > 0").select(key)
    return items.join(done.where(F.col(key) != reset) if reset is not None else done, key, "left_anti")


def topic_list(rules: DataFrame, most: int = 3) -> DataFrame:
    return rules.select("key", "ruling", F.slice("keywords", 1, most).alias("keywords"))


def mapped_verses(arabic: DataFrame, translated: DataFrame, theme: str) -> DataFrame:
    """Verses that both editions(surah, ayah, text) have."""
    both = arabic.withColumnRenamed("text", "arabic_text").join(translated.withColumnRenamed("text", "translation"), ["surah", "ayah"])
    place = F.concat_ws(":", "surah", "ayah")
    return both.select(place.alias("reference"), "surah", "ayah", "arabic_text", "translation", F.lit(theme).alias("theme"), F.lit("medium").alias("confidence"), F.lit(True).alias("needs_review"))


def mapped_narrations(arabic: DataFrame, translated: DataFrame, collection: str) -> DataFrame:
    """Narrations of either edition(number, text) with a text in one of them."""
    both = arabic.withColumnRenamed("text", "a").join(translated.withColumnRenamed("text", "t"), "number", "full_outer")
    plain = both.select("number", F.coalesce("a", F.lit("")).alias("arabic_text"), F.coalesce("t", F.lit("")).alias("translation")).where("arabic_text <> '' or translation <> ''")
    return plain.select(F.concat(F.initcap(F.lit(collection)), F.lit(" no. "), F.col("number").cast("string")).alias("source"), "arabic_text", "translation", F.lit("sahih" if collection in ("bukhari", "muslim") else "hasan").alias("authenticity"))


def reconciled(registry: DataFrame, names: DataFrame, key: str = "slug") -> DataFrame:
    """key and missing_in: slugs of the registry without a name, and names of slugs that the registry does not have."""
    left, right = registry.select(key).distinct(), names.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("missing_in", F.lit("names")).union(right.join(left, key, "left_anti").withColumn("missing_in", F.lit("registry")))


def loaded_counts(passages: DataFrame, books: DataFrame, key: str = "slug") -> DataFrame:
    """books with the number of their passages and when they were loaded (null: not yet)."""
    counted = passages.groupBy(key).agg(F.count("*").alias("total_passages"))
    joined = books.drop("total_passages", "ingested_at").join(counted, key, "left")
    return joined.withColumn("ingested_at", F.when(F.col("total_passages") > 0, F.current_timestamp())).withColumn("total_passages", F.coalesce("total_passages", F.lit(0)))


def health(rules: DataFrame, verses: DataFrame, narrations: DataFrame) -> DataFrame:
    """One row: status and totals."""
    return integrity(rules, verses, narrations).select(F.lit("ok").alias("status"), "rules", "verses", "narrations")
