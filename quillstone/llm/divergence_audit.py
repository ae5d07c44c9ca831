"""Source divergence audit: how far the term distribution of each source is from those of the others of its language.

Integer-dictionary encoding. Tasks count the terms of whole texts by language and source. The terms that enough documents of
a language have are its dictionary; it stands sorted by bytes, in chunks that Spark's range partitioning cuts. In a chunk
a sorted array of terms gives each entry its id by searchsorted, and bincount lays the entries of a group out as a dense vector; as
ids keep the order of the bytes, ties between terms are ties between numbers. Chunks carry the sums of their groups, so
totals are had from them; a second pass over the chunks turns counts into scaled shares and sums up divergences, in whole
numbers throughout. No task holds more than a chunk, and nothing that grows with the texts or terms reaches the driver.

Defined results: a null text, language or source is the empty one. Repeated rows count each. A group without kept terms has
count 0 for every term of its language; where a language keeps none, all values of pairs are 0. A source alone in its
language has no pairs. Equal values are ranked by the bytes of their items. Very long texts are counted piece by piece,
whole. An empty table gives an empty result. Columns besides text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, table, with_code

#: Documents of a language that a kept term is in at least, the scale of shares, and terms that are told of each group.
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Entries that a task counts before it hands them on; bytes of a text that are cut into terms at once.
HELD_ENTRIES, PIECE_BYTES = 300_000, 1_000_000
#: Entries, and cells of dense vectors, of a chunk at most (about).
CHUNK_ENTRIES, CHUNK_CELLS = 200_000, 2_000_000
#: Tasks that the chunks of one language are dealt to when they meet the totals of its groups.
DEALT = 64
#: Cells of the matrix of pairs that a task sums up before it hands them on; larger ones are handed on for each chunk.
HELD_PAIRS = 1_000_000
#: Bytes of terms are letters of ASCII and all beyond; A-Z become lower case, all others part terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; no term is cut."""
    at = 0
    while at < len(text):
        stop = at + PIECE_BYTES
        coded = text[at:stop].translate(_TERM)
        while stop < len(text) and (cut := coded.rfind(b" ")) < 0:  # one term so far
            coded += text[stop : stop + PIECE_BYTES].translate(_TERM)
            stop += PIECE_BYTES
        if stop < len(text):
            stop, coded = at + cut + 1, coded[:cut]
        yield coded.split()
        at = stop


def counts(documents: DataFrame) -> DataFrame:
    """lang, source, term (bytes), n (occurrences) and docs (documents), summed up within tasks; a term may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                if n:
                    own = list(n)
                    columns = [[lang] * len(own), [source] * len(own), own, list(n.values()), [docs[t] for t in own]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            groups.clear()

        held = 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for found in terms(text.as_py()):
                    n.update(found)
                    seen.update(found)
                docs.update(seen)
                held += len(n) - before
                if held >= HELD_ENTRIES:
                    yield from handed()
                    held = 0
        yield from handed()

    names, kinds = ["lang", "source", "term", "n", "docs"], [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    with_code(documents.sparkSession)
    plain = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    return documents.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), *plain).mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def kept_entries(counted: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, source and n of the terms that so many documents of the language have. Rows move once, by language and term."""
    by_group = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_group.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("own")).where(F.col("docs") >= least_docs)
    return by_term.select("lang", "term", F.explode("own").alias("x")).select("lang", "term", "x.source", "x.n")


def dense(term: list[bytes], source: list[str], n: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted terms, the sorted groups, and the counts of each group (rows) by the id of the term."""
    given, from_ = np.array(term, object), np.array(source, object)
    dictionary, groups = np.unique(given), np.unique(from_)
    ids, own, n_ = np.searchsorted(dictionary, given), np.searchsorted(groups, from_), np.array(n, np.int64)
    out = np.empty((len(groups), len(dictionary)), np.int64)
    for g in range(len(groups)):
        of = own == g
        # Sums of floats are whole below 2^53; an entry is one number for its term and group, so nothing is rounded.
        out[g] = np.bincount(ids[of], n_[of] >> 30, len(dictionary)).astype(np.int64) << 30
        out[g] += np.bincount(ids[of], n_[of] & (1 << 30) - 1, len(dictionary)).astype(np.int64)
    return dictionary, groups, out


def chunks(entries: DataFrame) -> DataFrame:
    """lang, terms, sources, counts (a dense matrix) and sums (of its rows) of runs of the sorted dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, term, source, n, groups, n_terms = None, [], [], [], set(), 0

        def cut() -> pa.RecordBatch:
            dictionary, own, matrix = dense(term, source, n)
            values = [[lang], [list(dictionary)], [list(own)], [matrix.tobytes()], [matrix.sum(axis=1).tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for lang_, term_, source_, n_ in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if term and (lang_ != lang or term_ != term[-1] and (len(term) >= CHUNK_ENTRIES or n_terms * len(groups) >= CHUNK_CELLS)):
                    yield cut()
                    term, source, n, groups, n_terms = [], [], [], set(), 0
                n_terms += not term or term_ != term[-1]
                lang = lang_
                term.append(term_)
                source.append(source_)
                n.append(n_)
                groups.add(source_)
        if term:
            yield cut()

    names = ["lang", "terms", "sources", "counts", "sums"]
    kinds = [pa.string(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64())]
    ordered = entries.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(run, "lang string, terms array<binary>, sources array<string>, counts binary, sums array<long>")


def shares(n: np.ndarray, total: int, size: int, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (n + 1) / (total + size)), exact: long division, three digits at a time, so that no product leaves 64 bits."""
    whole = total + size
    rest = n + 1 if whole < 1 << 53 else n.astype(object) + 1
    out, rest = rest // whole, rest % whole
    while scale > 1:
        rest = rest * min(scale, 1000)
        out, rest = out * min(scale, 1000) + rest // whole, rest % whole
        scale //= 1000
    return (out + 1).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) for shares up to the scale, whose squares are below 2^63."""
    return (p - q) ** 2 // q


def best(own: list[tuple[int, bytes]], top: int) -> list[tuple[int, bytes]]:
    """(value, item) of the highest values; equal ones by the bytes of their items."""
    return sorted(own, key=lambda x: (-x[0], x[1]))[:top]


PART = "lang string, source string, pairs array<long>, items array<binary>, values array<long>"
_NAMES, _KINDS = [x.split()[0] for x in PART.split(", ")], [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]


def _part(lang: str, source: str, pairs: np.ndarray, own: list[tuple[int, bytes]]) -> pa.RecordBatch:
    values = [lang], [source], [pairs.tolist()], [[item for _, item in own]], [[value for value, _ in own]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, _KINDS, strict=True)], names=_NAMES)


def scored(joined: DataFrame, top: int = TOP) -> DataFrame:
    """A row for each group and task: pairs (its divergence from each group of the language, in their order) and the top terms, of the task's chunks alone.

    For chunks with size (terms of the language) and all (its groups with their totals).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[str], np.ndarray, list[list[tuple[int, bytes]]]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                groups, totals = [x["source"] for x in row["all"]], [x["n"] for x in row["all"]]
                terms_, lang, many = row["terms"], row["lang"], len(row["all"]) ** 2 > HELD_PAIRS
                n = np.zeros((len(groups), len(terms_)), np.int64)
                n[np.searchsorted(np.array(groups, object), np.array(row["sources"], object))] = np.frombuffer(row["counts"], np.int64).reshape(-1, len(terms_))
                p = np.array([shares(own, total, row["size"]) for own, total in zip(n, totals, strict=True)])
                q = shares(n.sum(axis=0), sum(totals), row["size"])
                if not many:
                    _, sums, tops = held.setdefault(lang, (groups, np.zeros((len(groups), len(groups)), np.int64), [[] for _ in groups]))
                for g, own in enumerate(p):
                    pairs = divergence(own, p).sum(axis=1)
                    ids = np.flatnonzero((n[g] > 0) & (own > q))
                    f = divergence(own[ids], q[ids])
                    first = np.lexsort((ids, -f))[:top]
                    found = [(value, terms_[i]) for value, i in zip(f[first].tolist(), ids[first].tolist(), strict=True)]
                    if many:
                        yield _part(lang, groups[g], pairs, found)
                    else:
                        sums[g] += pairs
                        tops[g] = best(tops[g] + found, top)
        for lang, (groups, sums, tops) in held.items():
            for g, source in enumerate(groups):
                yield _part(lang, source, sums[g], tops[g])

    return joined.select("lang", "terms", "sources", "counts", "size", "all").mapInArrow(run, PART)


def merged(parts: DataFrame, top: int = TOP) -> DataFrame:
    """A row for each group: the sums of its pairs and its top terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pairs, own = None, np.zeros(0, np.int64), []
        for batch in batches:
            for row in batch.to_pylist():
                more, found = np.array(row["pairs"], np.int64), list(zip(row["values"], row["items"], strict=True))
                if (row["lang"], row["source"]) == current:
                    pairs, own = pairs + more, best(own + found, top)
                    continue
                if current is not None:
                    yield _part(*current, pairs, own)
                current, pairs, own = (row["lang"], row["source"]), more, found
        if current is not None:
            yield _part(*current, pairs, own)

    return parts.repartition("lang", "source").sortWithinPartitions("lang", "source").mapInArrow(run, PART)


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: the other sources of the language, farthest first, and the terms that a source has more of than its language."""
    tables = Tables(documents.sparkSession)
    entries = tables.kept("entries", kept_entries(counts(documents), least_docs))
    chunked = tables.kept("chunks", chunks(entries))
    tables.drop("entries")

    # Groups by language: as many as the result has rows for a rank, and no texts.
    totals = chunked.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    sizes = chunked.groupBy("lang").agg(F.sum(F.size("terms")).alias("size"))
    found = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    every = found.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("all"))
    every = tables.kept("groups", every.join(sizes, "lang", "left").select("lang", F.coalesce("size", F.lit(0).cast("long")).alias("size"), "all"))

    dealt = every.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    joined = chunked.withColumn("deal", F.pmod(F.xxhash64(F.col("terms")[0]), F.lit(DEALT)).cast("int")).join(dealt, ["lang", "deal"])
    found = merged(scored(joined, top), top)

    # A row for each group and the groups of its language; without terms, all its pairs are 0.
    own = every.select("lang", "all", F.explode("all.source").alias("source")).join(found, ["lang", "source"], "left")
    value = lambda i: F.coalesce(F.get("pairs", i), F.lit(0).cast("long"))
    pairs = F.filter(F.transform("all", lambda x, i: F.struct((-value(i)).alias("less"), x["source"].alias("item"))), lambda x: x["item"] != F.col("source"))
    terms_ = F.transform(F.arrays_zip("values", "items"), lambda x: F.struct((-x["values"]).alias("less"), x["items"].cast("string").alias("item")))
    none = F.array().cast("array<struct<less: bigint, item: string>>")
    each = own.select("lang", "source", F.explode(F.array(F.struct(F.lit("pair").alias("part"), F.array_sort(pairs).alias("all")), F.struct(F.lit("term").alias("part"), F.coalesce(terms_, none).alias("all")))).alias("x"))
    ranked = each.select("lang", "source", "x.part", F.posexplode("x.all").alias("at", "y"))
    return ranked.select("lang", "source", "part", F.col("y.item").alias("item"), (-F.col("y.less")).alias("value"), (F.col("at") + 1).alias("rank"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_UPPER.lower()}') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, c, 1 + {SCALE}::HUGEINT * (c + 1) // (sum(c) OVER (PARTITION BY lang, source) + v) AS p FROM x JOIN v USING (lang)),
y AS (SELECT lang, term, sum(c) AS c FROM x GROUP BY ALL),
q AS (SELECT lang, term, 1 + {SCALE}::HUGEINT * (c + 1) // (sum(c) OVER (PARTITION BY lang) + v) AS q FROM y JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
