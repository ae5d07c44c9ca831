"""Evidence scores, labels, warnings and the gate. Scores are whole hundredths until the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

HIGH, LEAST = 70, 50


def standard_hundredths(n_verses: Column, grades: Column, high: Column, static: Column) -> Column:
    """Verses 40 and 5 for each of three more; narrations in order: the first sound one 30, others 5, good ones 15; 5 for a sure rule, which scores 55 at least if static."""
    verses = F.when(n_verses > 0, 40 + 5 * F.least(n_verses - 1, F.lit(3))).otherwise(0)
    n = lambda grade: F.size(F.filter(F.coalesce(grades, F.array().cast("array<string>")), lambda g: F.lower(g) == grade))
    narrations = F.when(n("sahih") > 0, 30 + 5 * (n("sahih") - 1)).otherwise(0) + 15 * n("hasan")
    total = verses + narrations + F.when(high, 5).otherwise(0)
    return F.least(F.lit(100), F.when(high & static, F.greatest(total, F.lit(55))).otherwise(total))


def corpus_hundredths(levels: Column) -> Column:
    best = F.array_min(F.transform(levels, lambda x: F.coalesce(x.cast("int"), F.lit(5))))
    return F.when(best.isNull(), 0).when(best <= 2, 60).when(best <= 4, 52).otherwise(50)


def label(hundredths: Column) -> Column:
    return F.when(hundredths >= HIGH, "high").when(hundredths >= LEAST, "medium").otherwise("insufficient")


def disclaimer(hundredths: Column, corpus: Column) -> Column:
    return F.when(hundredths >= HIGH, "").when(hundredths >= LEAST, F.when(corpus, fixed.MEDIUM_BOOK_NOTE).otherwise(fixed.MEDIUM_NOTE)).otherwise(fixed.INSUFFICIENT_NOTE)


def warnings(narrations: Column, hundredths: Column, corpus: Column, n_hits: Column) -> Column:
    def of(x: Column) -> Column:
        say = lambda text: F.concat(F.lit(text.split("{}")[0]), F.coalesce(x["source"], F.lit("")), F.lit(text.split("{}")[1]))
        return F.when(F.lower(x["authenticity"]) == "hasan", say(fixed.HASAN_WARNING)).when(F.lower(x["authenticity"]) == "dhaif", say(fixed.DHAIF_WARNING))

    own = F.when(corpus, F.array_compact(F.array(F.when(n_hits > 0, fixed.BOOK_WARNING)))).otherwise(F.array_compact(F.transform(narrations, of)))
    return F.concat(own, F.array_compact(F.array(F.when(hundredths < LEAST, fixed.LOW_WARNING))))


def with_evidence(retrieved: DataFrame) -> DataFrame:
    """Score, label, warnings, disclaimer and is_answerable for rows of the cascade."""
    corpus, high = F.col("source") == "kitab_corpus", F.coalesce(F.col("confidence"), F.lit("medium")) == "high"
    n_hits = F.coalesce(F.size("hits"), F.lit(0))
    levels = F.transform("hits", lambda h: h["level"]) if "level" in retrieved.schema["hits"].dataType.simpleString() else F.array().cast("array<int>")
    standard = standard_hundredths(F.size("verses"), F.transform("narrations", lambda n: n["authenticity"]), high, F.col("source") == "static_rules")
    scored = retrieved.withColumn("hundredths", F.when(corpus, corpus_hundredths(levels)).otherwise(standard).cast("int"))
    h = F.col("hundredths")
    return scored.select(
        "*", (h / 100).alias("confidence_score"), label(h).alias("confidence_label"), warnings(F.col("narrations"), h, corpus, n_hits).alias("warnings"),
        disclaimer(h, corpus).alias("disclaimer"), (h >= LEAST).alias("is_answerable"),
    )


def with_gate(evidence: DataFrame) -> DataFrame:
    """can_answer and reason; rows without a retrieval (null source) get the fixed reason."""
    can = F.coalesce(F.col("is_answerable"), F.lit(False))
    return evidence.withColumn("can_answer", can).withColumn("reason", F.when(F.col("source").isNull(), fixed.NO_MATCH).when(can, "").otherwise(F.col("disclaimer")))
