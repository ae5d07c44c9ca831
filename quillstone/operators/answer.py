"""Rendering of answers, citations, and the union of all outcomes of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import display_name, excerpt, joined_notes, level_label, sanitized, question_error, truncated
from . import evidence

LINE, RULE = "=" * 70, "-" * 50


def _lines(*parts: Column) -> Column:
    """Those that aren't null, a line each."""
    return F.concat_ws("\n", *parts)


def _say(text: Column, before: str, indent: str = "      ") -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(indent + before), text))


def _records(records: Column, title: str, head) -> Column:
    def one(x: Column, i: Column) -> Column:
        arabic = F.when(x["arabic_text"] != fixed.PLACEHOLDER, x["arabic_text"])
        said = _lines(F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), head(x)), _say(arabic, ""), _say(x["transliteration"], "Transliterasi: "), _say(x["translation"], "Terjemahan: "))
        return F.concat(said, F.lit("\n"))

    return F.when(F.size(records) > 0, _lines(F.lit(f"\n{title}:\n"), F.array_join(F.transform(records, one), "\n")))


def standard_text() -> Column:
    """Of a retrieval with a ruling, verses and narrations."""
    verse_head = lambda v: F.concat(F.lit("QS. "), F.coalesce(v["surah_ayah"], v["reference"], F.lit("")))
    return _lines(
        F.lit(LINE), F.concat(F.lit("HUKUM: "), F.upper(F.coalesce("ruling", F.lit("")))), F.concat(F.lit("MADHAB: "), F.coalesce("school", F.lit(""))), F.lit(LINE),
        _records(F.col("verses"), "DASAR AL-QUR'AN", verse_head), _records(F.col("narrations"), "DASAR HADIS", lambda n: F.coalesce(n["source"], n["reference"], F.lit(""))),
        F.lit("\nPENJELASAN:"), F.concat(F.lit("  "), F.coalesce("reasoning", F.lit(""))), F.lit("\n" + LINE),
    )


def corpus_text(hits: Column, school: Column, n_books: int = 28, names: dict[str, str] | None = None) -> Column:
    """Of passages found by full text: hits(book, level, chapter, page, text)."""

    def one(h: Column, i: Column) -> Column:
        level = F.coalesce(h["level"].cast("int"), F.lit(5))
        text = truncated(h["text"])
        body = F.when(F.coalesce(text, F.lit("")) != "", _lines(F.lit("       " + RULE), F.concat(F.lit("       "), text), F.lit("       " + RULE)))
        label = F.coalesce(F.nullif(level_label(level, ""), F.lit("")), F.concat(F.lit("Level "), level.cast("string")))
        head = F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), display_name(h["book"], names))
        return F.concat(_lines(head, F.concat(F.lit("       "), label, F.lit("  |  Level "), level.cast("string")), _say(h["chapter"], "Bab  : ", "       "), _say(h["page"], "Hal  : ", "       "), body), F.lit("\n"))

    found = F.concat(F.lit("\nRUJUKAN KITAB: ("), F.size(hits).cast("string"), F.lit(" temuan)\n"))
    some = _lines(found, F.array_join(F.transform(hits, one), "\n"))
    body = F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, some).otherwise("\n[Tidak ada teks kitab yang relevan ditemukan.]\n")
    return _lines(F.lit(LINE), F.lit(f"SUMBER: Kitab Korpus Klasik ({n_books} Kitab)"), F.concat(F.lit("MADHAB: "), F.initcap(F.coalesce(school, F.lit("shafii")))), F.lit(LINE), body, F.lit(LINE))


def citations(hits: Column, names: dict[str, str] | None = None, most: int = 3) -> Column:
    """The first hits with a short excerpt; an unknown book keeps its slug."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None

    def one(h: Column) -> Column:
        name = F.coalesce(known[h["book"]], h["book"]) if known is not None else h["book"]
        level = F.coalesce(h["level"].cast("int"), F.lit(5))
        return F.struct(
            name.alias("book_name"), h["book"].alias("book_slug"), level_label(level).alias("authority_label"), level.alias("authority_level"), F.coalesce(h["chapter"], F.lit("")).alias("chapter_title"),
            F.coalesce(h["page"], F.lit("")).alias("page_ref"), excerpt(F.coalesce(h["text"], F.lit(""))).alias("excerpt"), F.coalesce(h["score"], F.lit(0.0)).alias("combined_score"),
        )

    return F.transform(F.slice(hits, 1, most), one)


def answers(questions: DataFrame, topics: DataFrame, retrieved: DataFrame, has_hits: bool = False) -> DataFrame:
    """One row for each of questions(qid, ...): ok, rejected or no_match, with what each of them has.

    topics(qid, topic) is what was parsed, retrieved the cascade over it.
    """
    scored = evidence.with_evidence(retrieved).drop("topic")
    gated = evidence.with_gate(questions.select("qid").join(topics, "qid", "left").join(scored, "qid", "left"))
    corpus = F.col("source") == "kitab_corpus"
    text = F.when(corpus, corpus_text(F.col("hits"), F.col("school"))).otherwise(standard_text()) if has_hits else standard_text()
    status = F.when(F.col("can_answer"), "ok").when(F.col("topic").isNull(), "no_match").otherwise("rejected")
    note = F.when(F.col("can_answer"), joined_notes(F.col("disclaimer"), F.when(corpus, F.lit(fixed.CORPUS_NOTE))))
    out = gated.select(
        "qid", status.alias("status"), "topic", F.when(F.col("can_answer"), text).alias("answer"), F.when(~F.col("can_answer"), F.col("reason")).alias("reason"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"), F.coalesce("confidence_label", F.lit("insufficient")).alias("confidence_label"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), note.alias("disclaimer"), F.coalesce("source", F.lit("unknown")).alias("source"), *(["hits"] if has_hits else []),
    )
    return out.withColumn("citations", F.when(F.col("status") == "ok", citations(F.col("hits")))).drop("hits") if has_hits else out


def is_answerable(answered: DataFrame) -> DataFrame:
    return answered.select("qid", (F.col("status") == "ok").alias("is_answerable"), "confidence_score")


def ask(questions: DataFrame, answer) -> DataFrame:
    """Validated questions(qid, text) answered by answer(questions); invalid ones get status invalid and the code of the rule."""
    checked = questions.withColumn("clean", sanitized(F.col("text"))).withColumn("error", question_error(F.col("text"), F.col("clean")))
    good = answer(checked.where("error is null").select("qid", F.col("clean").alias("text")))
    bad = checked.where("error is not null").select("qid", F.lit("invalid").alias("status"), F.col("error").alias("reason"))
    return good.unionByName(bad, allowMissingColumns=True)
