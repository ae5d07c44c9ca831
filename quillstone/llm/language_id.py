"""Language ID: multilingual mixture inference.

Training counts hashed n-grams of letters over all training rows, per language, in one distributed aggregation; the model
is a table of languages by buckets. Inference takes a document as a mixture of languages and estimates its proportions by
expectation-maximisation over the n-gram likelihoods, over all languages or over a set grown from one language until no
other could make the document likelier by more than the cost of a language. Languages leave the set while that lowers the penalised likelihood.

Defined results: a document whose text is null or has no letter is "und" with score 0; so are all where no language was
learned. A letter is a character of category L. Rows with a null language, or an empty or null text, teach nothing. Texts
are used whole; one longer than a chunk is counted chunk by chunk, with the same result. Repeated rows count as often as
they stand. Equal shares go to the language that sorts first. More languages than most_languages stop the training with an error; none is left out. An empty
table gives an empty result. Columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_code

#: Hash buckets of n-grams. The model has as many numbers for each language.
BUCKETS = 1 << 14
#: Languages that a model may hold. Each takes 64 KB (a float for each bucket), so this bounds what reaches the driver and the executors to 64 MB.
MOST_LANGUAGES = 1024
#: Added to each count.
SMOOTHING = 0.5
#: Steps of expectation-maximisation, and the cost of a language in the set as a share of the logarithm of the number of n-grams.
STEPS, PENALTY = 12, 1.0
#: Up to so many languages the set starts with all of them; else it is grown, without a limit, to those that the document needs.
FEW = 8
UNKNOWN = "und"
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 200_000

#: Bytes that no letter has in UTF-8 become a space.
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint64)
#: Numbers such as ½, ² and Ⅳ are no letters.
_has_letter = regex.compile(r"\p{L}").search


def buckets(coded: np.ndarray) -> np.ndarray:
    """The bucket of each byte trigram that has a letter in it."""
    raw = _LETTERS[coded]
    joined = raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]
    mixed = joined * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (BUCKETS.bit_length() - 1))
    return mixed[joined != np.uint64(0x202020)].astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that the text has, and how often."""
    coded = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(coded) - 2, CHUNK_BYTES):
        # A chunk takes the two bytes behind it, so that each trigram is in one chunk.
        total += np.bincount(buckets(coded[start : start + CHUNK_BYTES + 2]), minlength=BUCKETS)
    seen = np.flatnonzero(total)
    return seen, total[seen].astype(np.float64)


def likelihood_of(counts: np.ndarray) -> np.ndarray:
    """Of each bucket in a language with these counts."""
    smooth = counts + SMOOTHING
    return (smooth / smooth.sum()).astype(np.float32)


class Model:
    """Languages and the likelihood of each bucket in each of them."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.know({x: likelihood_of(n) for x, n in counts.items()})

    def know(self, likelihoods: dict[str, np.ndarray]) -> Model:
        self.languages = sorted(likelihoods)
        self.likelihood = np.array([likelihoods[x] for x in self.languages], np.float32).reshape(len(self.languages), BUCKETS)
        return self

    @staticmethod
    def mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the languages (rows of p) and the log-likelihood."""
        share = np.full(len(p), 1 / len(p))
        for _ in range(STEPS if len(p) > 1 else 0):
            mixed = share @ p
            share = share * (p @ (n / mixed)) / n.sum()
        return share, float(n @ np.log(share @ p))

    @classmethod
    def grown(cls, p: np.ndarray, n: np.ndarray, cost: float) -> np.ndarray:
        """Languages that a mixture needs: no mixture of all languages is likelier than theirs by more than cost.

        The log-likelihood is concave in the shares, so no mixture gains more on the present one than the steepest way to
        a single language promises. The steepest language is added until that is at most cost.
        """
        kept = np.array([np.argmax(np.log(p) @ n)])
        while len(kept) < len(p):
            share, _ = cls.mixture(p[kept], n)
            gain = p @ (n / (share @ p[kept])) - n.sum()
            gain[kept] = -np.inf
            if gain.max() <= cost:
                break
            kept = np.append(kept, np.argmax(gain))
        return np.sort(kept)

    def proportions(self, text: str | None) -> dict[str, float]:
        """Of the languages in the set that the penalised likelihood selects."""
        if not text or not self.languages or not _has_letter(text):
            return {}
        seen, n = counted(text)
        if not len(seen):
            return {}
        p = self.likelihood[:, seen].astype(np.float64)
        cost = PENALTY * np.log(n.sum() + 1)
        kept = np.arange(len(self.languages))
        if len(kept) > FEW:
            kept = self.grown(p, n, cost)
        share, fit = self.mixture(p[kept], n)
        while len(kept) > 1:
            order = np.argsort(share, kind="stable")
            fewer = np.delete(kept, order[0])
            next_share, next_fit = self.mixture(p[fewer], n)
            if next_fit < fit - cost:
                break
            kept, share, fit = fewer, next_share, next_fit
        return {self.languages[k]: float(s) for k, s in zip(kept, share, strict=True)}

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.proportions(text)
        if not found:
            return UNKNOWN, 0.0
        language = max(sorted(found), key=found.get)
        return language, min(1.0, max(0.0, found[language]))


def train(labelled: DataFrame, most_languages: int = MOST_LANGUAGES) -> Model:
    """From all rows of labelled(text, lang). Counts are summed and laid out by language on the executors; a language is one array of bytes here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen, n = counted(text.as_py())
                total[seen] += n.astype(np.int64)
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["lang", "bucket", "n"])

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(batch.column(0).to_pylist()):
                own = batch.column(1).slice(i, 1).flatten()
                total = np.zeros(BUCKETS, np.int64)
                total[own.field(0).to_numpy(zero_copy_only=False)] = own.field(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([likelihood_of(total).tobytes()], pa.binary())], names=["lang", "likelihood"])

    with_code(labelled.sparkSession)
    known = labelled.where("text is not null and text <> '' and lang is not null").select("text", "lang")
    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_language = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    rows = by_language.mapInArrow(laid_out, "lang string, likelihood binary").limit(most_languages + 1).toArrow().to_pylist()
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return Model({}).know({r["lang"]: np.frombuffer(r["likelihood"], np.float32) for r in rows})


def predict(documents: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """The columns to keep, then lang_pred and score, for each row of documents(text)."""
    spark = documents.sparkSession
    with_code(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        return pd.DataFrame([known.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score"])

    # Spark takes it for non-deterministic, so that a filter on the result doesn't call it a second time.
    of = of.asNondeterministic()
    told = documents.select(*keep, of("text").alias("_told"))
    return told.select(*[c for c in told.columns if c != "_told"], "_told.lang_pred", "_told.score")


def held_out() -> Column:
    """Of every three documents one is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(documents.where(~held_out()))
    return predict(documents, model, F.col("doc_id"), held_out().alias("held_out"))
