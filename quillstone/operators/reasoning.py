"""Layered classification and routing of questions: perception, context, route, evidence check, governance. Each layer adds columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import content_tokens, density, input_type, language, let, tokens
from . import evidence


def domain_scores(text: Column, lexicon=fixed.LEXICON) -> Column:
    """(domain, score) by score, then order: the share of each domain's keywords that contain a content token or are contained in one."""

    def hits(found: Column) -> Column:
        n = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda k: F.exists(found, lambda t: t.contains(k) | k.contains(t))))
        counted = F.array(*[F.struct((-n(words)).alias("negative"), F.lit(i).alias("ord"), F.lit(name).alias("domain")) for i, (name, words) in enumerate(lexicon)])
        return F.filter(counted, lambda x: x["negative"] < 0)

    return let(let(F.array_distinct(content_tokens(text)), hits), shares)


def shares(raw: Column) -> Column:
    total = F.aggregate(raw, F.lit(0), lambda a, x: a - x["negative"])
    each = F.transform(F.sort_array(raw), lambda x: F.struct(x["domain"].alias("domain"), F.round(-x["negative"] / total, 4).alias("score")))
    return F.when(F.size(raw) == 0, F.array(F.struct(F.lit("umum").alias("domain"), F.lit(1.0).alias("score")))).otherwise(each)


def perceive(questions: DataFrame) -> DataFrame:
    """Layer 1 for questions(qid, text)."""
    text = F.col("text")
    seen = questions.withColumn("domains", domain_scores(text)).withColumn("n_tokens", F.size(tokens(text))).withColumn("density", density(text))
    seen = seen.withColumn("language", language(text)).withColumn("input_type", input_type(text)).withColumn("content_tokens", F.slice(content_tokens(text), 1, 15))
    seen = seen.withColumn("primary_domain", F.col("domains")[0]["domain"]).withColumn("secondary_domains", F.transform(F.slice("domains", 2, 2), lambda x: x["domain"]))
    sure = F.col("domains")[0]["score"] * 0.6 + F.col("density") * 0.2 + F.least(F.col("n_tokens") / 15, F.lit(1.0)) * 0.2
    short = F.when(F.col("n_tokens") < 4, "short")
    unclear = F.when((F.col("primary_domain") == "umum") & (F.col("domains")[0]["score"] < 0.5), "unclear")
    return seen.withColumn("l1", F.round(sure, 4)).withColumn("l1_warnings", F.array_compact(F.array(short, unclear)))


def in_context(seen: DataFrame, contexts=fixed.CONTEXTS) -> DataFrame:
    """Layer 2: a lookup by (domain, input type) with a default."""
    entry = lambda row: F.struct(*[F.lit(v).alias(n) for n, v in zip(("context", "evidence_required", "school", "urgency"), row, strict=True)])
    known = F.create_map(*[x for d, t, *rest in contexts for x in (F.lit(f"{d}|{t}"), entry(rest))])
    placed = seen.withColumn("_x", known[F.concat_ws("|", "primary_domain", "input_type")])
    placed = placed.withColumn("l2", F.when(F.col("_x").isNotNull(), 0.9).otherwise(0.45)).withColumn("_x", F.coalesce("_x", entry(fixed.DEFAULT_CONTEXT)))
    scope = F.when(F.col("_x.evidence_required"), F.array(*map(F.lit, ("quran", "hadis", "shafii_rules")))).otherwise(F.array(F.lit("shafii_rules")))
    cross = F.exists("secondary_domains", lambda d: d != "umum")
    return placed.select("*", "_x.*", scope.alias("evidence_scope"), cross.alias("cross_domain")).drop("_x")


def routed(placed: DataFrame) -> DataFrame:
    """Layer 3."""
    entry = lambda row: F.struct(*[F.lit(v).alias(n) for n, v in zip(("strategy", "min_evidence", "allow_partial", "depth"), row, strict=True)])
    plan = F.create_map(*[x for u, *rest in fixed.STRATEGIES for x in (F.lit(u), entry(rest))])[F.col("urgency")]
    cross, vague = F.col("cross_domain"), F.col("l1") < 0.4
    return placed.withColumn("_p", plan).select(
        "*", F.when(cross, "comprehensive").otherwise(F.col("_p.strategy")).alias("strategy"), F.when(cross, F.greatest("_p.min_evidence", F.lit(3))).otherwise(F.col("_p.min_evidence")).alias("min_evidence"),
        "_p.allow_partial", F.when(vague, "brief").otherwise(F.col("_p.depth")).alias("depth"), vague.alias("clarify"),
        F.col("context").isin(fixed.SENSITIVE_CONTEXTS).alias("referral"), F.round(F.col("l2") * 0.7 + F.col("l1") * 0.3, 4).alias("l3"),
    ).drop("_p")


def route(questions: DataFrame) -> DataFrame:
    return routed(in_context(perceive(questions)))


def lookups(route_: DataFrame) -> DataFrame:
    """qid, pos and topic of what layer 4 retrieves: the primary domain, and two more where the strategy is comprehensive."""
    more = F.when(F.col("strategy") == "comprehensive", F.slice("secondary_domains", 1, 2)).otherwise(F.array().cast("array<string>"))
    return route_.select("qid", F.posexplode(F.concat(F.array("primary_domain"), more)).alias("pos", "topic"))


def answered(route_: DataFrame, found: DataFrame) -> DataFrame:
    """Layers 4 to 7 for the route and found(qid, pos, ruling, verses, narrations, source, hundredths, confidence_label, warnings, answer).

    A question for which nothing was found gets nulls where nothing can be said.
    """
    has_ruling = F.coalesce(F.col("ruling"), F.lit("")) != ""
    pieces = F.size("verses") + F.size("narrations") + F.when(has_ruling, 1).otherwise(0)
    first = F.struct("pos", "hundredths", "confidence_label", "warnings", "answer", "is_answerable", "disclaimer")
    rest = F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "answer")))
    told = found.groupBy("qid").agg(F.sum(pieces).alias("pieces"), F.min(first).alias("best"), F.array_sort(rest).alias("rest"))
    joined = route_.join(told, "qid", "left").withColumn("pieces", F.coalesce("pieces", F.lit(0)))
    joined = joined.withColumn("l4", F.round(F.least(F.col("pieces") / F.greatest(F.col("min_evidence") * 2, F.lit(1)), F.lit(1.0)), 4))
    mean4 = (F.col("l1") + F.col("l2") + F.col("l3") + F.col("l4")) / 4
    score = F.col("best.hundredths") / 100
    enough = F.col("pieces") >= F.col("min_evidence")
    ok = F.coalesce(F.col("best.is_answerable"), F.lit(False))
    reason = F.when(F.col("best").isNull(), "retrieval_empty").when(~ok, F.col("best.disclaimer")).when(~enough & ~F.col("allow_partial"), "evidence_insufficient").otherwise("passed")
    checked = joined.withColumn("gate_reason", reason).withColumn("gate_passed", reason == "passed").withColumn("score", F.coalesce(score, F.lit(0.0)))
    checked = checked.withColumn("mean_confidence", F.when(F.col("best").isNotNull(), F.round(mean4, 4))).withColumn("risk", F.when(F.col("best").isNotNull(), F.round(F.greatest(F.lit(0.0), 0.9 - score - mean4 * 0.3), 4)))
    checked = checked.withColumn("l5", F.when(F.col("best").isNull(), 0.0).otherwise(F.round(score * 0.7 + mean4 * 0.3, 4)))
    checked = checked.withColumn("l6", F.when(F.col("gate_passed"), F.round(F.col("score") * 0.8 + F.col("l4") * 0.2, 4)).otherwise(0.2))
    more = F.when((F.col("depth") == "full") & (F.size("rest") > 0), F.concat(F.lit("\n\nKonteks tambahan: "), F.array_join(F.transform("rest", lambda r: r["answer"]), " "))).otherwise("")
    ask = F.when(F.col("clarify"), CLARIFY).otherwise("")
    refused = F.concat(F.lit(REFUSED[0]), F.col("gate_reason"), F.lit(REFUSED[1]))
    text = F.when(F.col("gate_passed"), F.concat("best.answer", more, ask)).otherwise(refused)
    level = F.when(F.col("gate_passed"), F.col("best.confidence_label")).otherwise("none")
    referral = F.when(F.col("referral") | ~F.col("gate_passed"), REFERRAL).otherwise("")
    note = F.when(level == "medium", MEDIUM).otherwise("")
    governed = checked.withColumn("confidence", level).withColumn("answer", F.trim(F.concat(text, referral, note)))
    governed = governed.withColumn("status", F.when(F.col("gate_passed"), "success").otherwise("limited"))
    return governed.withColumn("l7", F.round((F.col("l1") + F.col("l2") + F.col("l4") + F.col("l5") + F.col("l6")) / 5, 4)).drop("best", "rest")


# Texts of the layered answer.
REFUSED = (
    "Maaf, saya tidak dapat memberikan jawaban yang memadai untuk pertanyaan ini saat ini. Alasan: ",
    ". Silakan konsultasikan dengan ustadz atau ulama terpercaya.",
)
CLARIFY = "\n\nCatatan: Pertanyaan Anda memiliki beberapa kemungkinan interpretasi. Apakah maksud Anda berkaitan dengan [topik spesifik]?"
REFERRAL = (
    "\n\n⚠️ Penting: Jawaban ini adalah panduan awal berdasarkan fiqh mazhab Syafi'i. Untuk keputusan yang bersifat mengikat secara agama — terutama "
    "dalam masalah muamalah, waris, dan pernikahan — konsultasikan dengan ulama atau lembaga fatwa terpercaya (seperti MUI, NU, atau Muhammadiyah)."
)
MEDIUM = "\n\n📌 Catatan: Jawaban ini memiliki tingkat keyakinan sedang. Verifikasi dengan sumber primer dianjurkan."


def reason(questions: DataFrame, retrieved, answer_text) -> DataFrame:
    """All layers. retrieved(topics) is the cascade over topics(qid, topic); answer_text(row columns) renders a retrieval."""
    path = route(questions)
    wanted = lookups(path).withColumn("lookup", F.concat_ws("#", "qid", "pos"))
    found = evidence.with_evidence(retrieved(wanted.select(F.col("lookup").alias("qid"), "topic"))).withColumnRenamed("qid", "lookup")
    rows = wanted.drop("topic").join(found.withColumn("answer", answer_text()), "lookup")
    return answered(path, rows)
