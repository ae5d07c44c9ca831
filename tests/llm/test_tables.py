"""Tests of the audit, sharding and alignment operators against plain versions."""

import base64
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quillstone.llm import divergence_audit, registry, sharding, token_alignment

from ..compare import same_rows
from .helpers import DOCS, docs, prose, rng


def test_audit_matches_sql(spark, data):
    same_rows(registry.QUERIES["op11_divergence_audit"](spark, data), registry.ORACLE_SQL["op11_divergence_audit"], data)


def audited(rows, least=3, top=200):
    """The audit of (text, lang, source), in plain Python."""
    counts, in_docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang, source].update(found)
        in_docs[lang].update(set(found))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            more = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", more)):
                ranked = sorted(values, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


CASES = [
    ("Ab ab aB c", "en", "s1"), ("ab c", "en", "s1"), ("AB é É _x`x{", "en", "s2"), ("é é c", "en", None), ("É c ab", "en", None), (None, "en", "s3"), ("", "en", "s4"), ("x y", "de", "s1"),
    ("z", "de", "s2"), ("\x00a\x7fb", None, "s1"), (None, None, None), ("ab c", "en", "s1"), ("ab c", "en", "s1"), ("\U0001f600 ￿ ab", "en", "s2"), ("\U0001f600 ￿", "en", "s1"), ("\U0001f600 ￿", "en", "s5"),
]


@pytest.mark.parametrize("pieces, entries, held, pairs", [(1_000_000, 200_000, 300_000, 1_000_000), (3, 2, 4, 0)])
def test_audit_of_odd_rows(spark, monkeypatch, pieces, entries, held, pairs):
    for name, value in (("CHUNK_ENTRIES", entries), ("HELD_ENTRIES", held), ("HELD_PAIRS", pairs)):
        monkeypatch.setattr(divergence_audit, name, value)
    rows = spark.createDataFrame([(i, *c, 1, "x", 2) for i, c in enumerate(CASES)], "doc_id long, text string, lang string, source string, n int, term string, value int").repartition(3)
    for top in (200, 1):
        assert sorted(map(tuple, divergence_audit.audit(rows, top=top).collect())) == audited(CASES, top=top)


def test_audit_of_random_rows(spark):
    r = rng(3)
    rows = [(prose(r, r.randint(0, 60), "abé"), r.choice(["en", "fr", None]), r.choice(["a", "b", "c", "", None])) for _ in range(300)]
    given = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence_audit.audit(given).collect())) == audited(rows)


def test_audit_of_no_rows(spark):
    assert divergence_audit.audit(docs(spark, [])).count() == 0


def test_terms_of_long_texts(monkeypatch):
    r = rng(4)
    text = prose(r, 300, "abcé") + " " + "y" * 50 + "1" + prose(r, 30)
    whole = [t for piece in divergence_audit.terms(text.encode()) for t in piece]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(divergence_audit, "PIECE_BYTES", size)
        assert [t for piece in divergence_audit.terms(text.encode()) for t in piece] == whole
    assert whole == [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


def test_shares_are_exact():
    import numpy as np

    for n, total, size in [([0, 1, 5], 6, 3), ([7**15, 0], 7**15, 2), ([10**17, 3], 10**17 + 3, 2), ([2**52 - 9, 1], 2**52 - 8, 5)]:
        want = [1 + 10**9 * (x + 1) // (total + size) for x in n]
        assert divergence_audit.shares(np.array(n), total, size).tolist() == want


def sharded(spark, rows, **options):
    found = sharding.shard(rows, "doc_id", "text", **options).select("row.*", "size", "text_crc32", "shard", "slot").collect()
    by_shard = defaultdict(list)
    for r in found:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
        by_shard[r["shard"]].append(r)
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return found, by_shard


def test_shards_are_near_equal(spark):
    r = rng(6)
    texts = [prose(r, r.randint(0, 80)) for _ in range(900)] + ["one text of a third of the rows"] * 700 + [None] * 100 + [prose(r, 3000)]
    rows = docs(spark, texts).repartition(5)
    rows = rows.union(spark.createDataFrame([(None, "a row that stands again", "en", "x", 1)] * 500, DOCS))
    found, by_shard = sharded(spark, rows, shards=7)
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "") for x in found) == sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "") for x in rows.collect())
    sizes = [sum(x["size"] for x in by_shard[i]) for i in range(7)]
    mean = sum(sizes) / 7
    assert all(abs(s - mean) <= max(x["size"] for x in found) + 2 * sharding.TOLERANCE * mean for s in sizes)


def test_splitters_are_the_nearest(spark):
    r = rng(7)
    keys = [(r.choice([r.randrange(1 << 62), 5, 1 << 61]), r.choice([r.randrange(1 << 62), 9]), r.randrange(1 << 62), r.choice([8, 50, 300])) for _ in range(600)]
    rows = spark.createDataFrame(keys, "k0 long, k1 long, k2 long, size long")
    cuts, n = sharding.splitters(rows, 9, 0.0, cells=40)
    total = sum(k[3] for k in keys)
    assert n == 600
    for i, cut in enumerate(cuts, 1):
        below = sum(k[3] for k in keys if k[:3] < cut)
        sums, at = [0], 0
        for k in sorted(keys):
            at += k[3]
            sums.append(at)
        assert abs(below - total * i / 9) == min(abs(s - total * i / 9) for s in sums)


def test_slots_of_one_text(spark):
    """Many rows of one text and one id are numbered in many parts."""
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit(1).alias("size"), F.lit(2).alias("k0"), F.lit(3).alias("row"))
    found, by_shard = sharded(spark, rows, shards=4)
    assert len(by_shard) == 4 and all(abs(len(x) - 750) <= 1 for x in by_shard.values())


def test_shards_of_few_rows(spark):
    assert sharding.shard(docs(spark, [])).count() == 0
    found, _ = sharded(spark, docs(spark, ["a", None]), shards=24)
    assert len(found) == 2 and {x["shard"] for x in found} <= set(range(24))


def plain_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        pieces = {int(i): base64.b64decode(x) for x, i in map(bytes.split, lines)}
    every = []
    for text in texts:
        every.append(None)
        if not text:
            continue
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        bytes_a = [pieces[i] for i in a]
        bytes_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        links, groups, i, j, end_a, end_b, own_a, own_b = [], [], 0, 0, len(bytes_a[0]), len(bytes_b[0]), [a[0]], [b[0]]
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
                own_a, own_b = [], []
            if step_a:
                i += 1
            if step_b:
                j += 1
            if i == len(a) and j == len(b):
                break
            if step_a:
                end_a += len(bytes_a[i])
                own_a.append(a[i])
            if step_b:
                end_b += len(bytes_b[j])
                own_b.append(b[j])
        every[-1] = (len(a), len(b), groups, links)
    n = Counter(x for one in every if one for x in one[3])
    best = Counter()
    for (_, b), k in n.items():
        best[b] = max(best[b], k)
    return [
        (0, 0, 0, 0, 0, 0, "") if one is None else (one[0], one[1], len(one[2]), len(one[3]), sum(n[x] == best[x[1]] for x in one[3]), sum(n[x] for x in one[3]), sha256(";".join(one[2]).encode()).hexdigest())
        for one in every
    ]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "x\n y", "x \n y", "x\n\n y", "\ty", "x \ty", "x\t y", "don't  we'll", "a<|endoftext|>b <s> </s> <unk> <0x0A>", "▁", "a ▁b", "a▁ b", "\x00 x", "x \x00y", "é ½ ﬁ Ⅳ ² x²",
    "é ́x", "日本語 テキスト 12 345", "　x 　y", " x y  z", "\U0001f600 \U0001f468‍\U0001f469", "\r\n x\r\n", "a\u0085 b", "\x1c x \x1cy", "-- -- --", "x" * 300 + " y", "٣ ३ x", "a " * 50, "﻿x", "x​ y",
]


def aligned(spark, texts, **options):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, batch string, cells int").repartition(3)
    names = [x.split()[0] for x in token_alignment.RESULT.split(", ")]
    return [tuple(r[c] for c in names[1:]) for r in token_alignment.align(rows, **options).orderBy("doc_id").collect()]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_odd_texts(spark, monkeypatch, small):
    options = {}
    if small:
        for name in ("BATCH_DOCS", "HELD_PAIRS", "TASK_LINKS"):
            monkeypatch.setattr(token_alignment, name, 7)
        options = {"block_cells": 60_000 * 20}
    r = rng(8)
    texts = ODD + [prose(r, r.randint(1, 40)) for _ in range(60)] + ["the same words, again and again"] * 40
    assert aligned(spark, texts, **options) == plain_alignment(texts)


def test_alignment_of_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = {x["doc_id"]: x for x in registry.QUERIES["op13_token_alignment"](spark, data).collect()}
    names = [x.split()[0] for x in token_alignment.RESULT.split(", ")]
    assert [tuple(found[x["doc_id"]][c] for c in names[1:]) for x in rows] == plain_alignment([x["text"] for x in rows])


def test_alignment_of_no_rows_and_equal_ids(spark):
    assert token_alignment.align(docs(spark, [])).count() == 0
    twice = spark.createDataFrame([(None, "some words"), (None, "some words"), (1, "others"), (1, None)], "doc_id long, text string")
    assert sorted((x["doc_id"] or 0, x["n_a"] > 0) for x in token_alignment.align(twice).collect()) == [(0, True), (0, True), (1, False), (1, True)]
