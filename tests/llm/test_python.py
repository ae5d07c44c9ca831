"""Suffix dedup, Jaccard join, packing, language ID, HTML extraction and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import html_extract, jaccard_join, language_id, packing, substring_dedup
from quillstone.llm.components import components
from quillstone.llm.shingles import MinHash, choose_bands, sets

from .helpers import DOCS, docs, edited, prose, rng, words


def brute_dedup(rows):
    """For (doc_id, text) with strings in the order of id, start and a hash of the row's text."""
    order = lambda d, t, i: (d, i, hashed(t))
    first = {}
    for d, t in rows:
        for i in range(len(t) - 99):
            first[t[i : i + 100]] = min(first.get(t[i : i + 100], order(d, t, i)), order(d, t, i))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] < order(d, t, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def hashed(text):
    """The low bits of Spark's hash of the text."""
    return xxhash.xxh64_intdigest(text, 42) & 0xFFFFFFFF


def odd_texts():
    r = rng()
    base = prose(r, 500)
    return [
        "a" * 500, "ab" * 300, base, base[100:700] + "X" + base[701:2000], "a" * 120, base[:150] + "ab" * 90 + base[400:520], "", None, base[-80:] + base[:99], "x" + base, "é" * 70 + base[:300], base, "short",
        ("abcdefghij" * 9 + "12345") * 8, edited(r, base, 0.05), edited(r, base, 0.05), base[:100], base[1:100] + "~",
    ]


def test_substring_dedup(spark):
    texts = odd_texts()
    rows = docs(spark, texts).withColumn("start", F.lit(1)).withColumn("doc", F.lit("x"))
    out = sorted(tuple(x) for x in substring_dedup.dedup(rows).collect())
    assert out == brute_dedup([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_substring_dedup_in_many_suffix_arrays(spark):
    """A trigger's phrases in suffix arrays of a few phrases each, and few bytes sorted at once."""
    texts = odd_texts()
    r = rng(8)
    shared = prose(r, 30)
    texts += [prose(r, r.randint(5, 30)) + " " + shared + " " + prose(r, r.randint(5, 30)) for _ in range(60)] * 2
    want = brute_dedup([(i, (t or "").encode()) for i, t in enumerate(texts)])
    for options in ({"most": 3}, {"sorted_bytes": 500}, {"most": 1, "sorted_bytes": 1}):
        assert sorted(tuple(x) for x in substring_dedup.dedup(docs(spark, texts), **options).collect()) == want


def test_substring_dedup_of_clashing_ids(spark):
    """Rows of one id with different texts, longer and shorter ones, and rows that are repeated."""
    texts = odd_texts()
    r = rng(9)
    x, a, b = prose(r, 50), prose(r, 120), prose(r, 90)
    rows = [(i % 4 - 1, t) for i, t in enumerate(texts)] + [(1, x), (5, a), (5, b[:200] + x + b[200:]), (6, "tiny"), (6, a), (7, a), (7, a), (7, b), (7, b + a)]
    out = sorted(tuple(v) for v in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == brute_dedup([(d, (t or "").encode()) for d, t in rows])


def test_substring_dedup_of_texts_in_slices(spark, monkeypatch):
    """Texts that are hashed in several slices give what whole ones give; run in this process, as workers keep the size of a slice."""
    from quillstone.llm import repeats

    r = rng(4)
    base = prose(r, 1500)
    texts = [t.encode() for t in (base, base[3000:5200] + prose(r, 100), prose(r, 20) + base[500:], "ab" * 2000)]

    def classes():
        """The first window of each window, by phrases and a suffix array of all of them."""
        slices, places = [], []
        for found in zip(*[np.concatenate(x) for x in zip(*repeats.phrases(texts), strict=True)], strict=True):
            owner, start, windows = found[0], found[4], found[5]
            slices.append(texts[owner][start : start + windows + 99])
            places += [(int(owner), int(start) + k) for k in range(windows)]
        ends = np.cumsum([len(s) for s in slices])
        at = repeats.spread(np.concatenate([[0], ends[:-1]]), np.array([len(s) - 99 for s in slices]))
        rank = repeats.suffix_ranks(np.frombuffer(b"".join(slices), np.uint8), at)
        assert len(set(places)) == len(places) == sum(len(t) - 99 for t in texts)
        return dict(zip(places, rank.tolist(), strict=True))

    whole = classes()
    strings = {p: texts[p[0]][p[1] : p[1] + 100] for p in whole}
    assert sorted(whole, key=whole.get) == sorted(whole, key=strings.get) and len(set(whole.values())) == len(set(strings.values()))
    monkeypatch.setattr(repeats, "SLICE", 700)
    assert classes() == whole
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.array([i for i in range(len(raw) - 99) if i % 3])
    found = list(zip(*repeats.window_hashes(raw, at), strict=True))
    named = {}
    assert all(named.setdefault(bytes(raw[i : i + 100]), h) == h for i, h in zip(at.tolist(), found, strict=True)) and len(set(found)) == len(named)


def test_substring_dedup_of_odd_rows(spark):
    t = prose(rng(), 60)
    rows = spark.createDataFrame([(None, t), (1, t), (1, t), (None, None)], "doc_id long, text string")
    out = sorted(((x["doc_id"] is not None, x["n_bytes"], x["n_removed"]) for x in substring_dedup.dedup(rows).collect()))
    assert out == [(False, 0, 0), (False, len(t), 0), (True, len(t), len(t)), (True, len(t), len(t))]
    assert substring_dedup.dedup(rows.limit(0)).count() == 0


def test_substring_dedup_of_long_texts(spark, monkeypatch):
    from quillstone.llm import repeats

    t = prose(rng(), 3000).encode()
    whole = [np.concatenate(x) for x in zip(*repeats.phrases([t, t[500:]]), strict=True)]
    assert whole[5].sum() == len(t) - 99 + len(t) - 599
    monkeypatch.setattr(repeats, "SLICE", 700)
    cut = [np.concatenate(x) for x in zip(*repeats.phrases([t, t[500:]]), strict=True)]
    assert cut[5].sum() == whole[5].sum()


def shingled(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_links(texts):
    s = [shingled(t) for t in texts]
    return [(i, j) for i in range(len(s)) for j in range(i) if s[i] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]


@pytest.fixture(scope="module")
def copies():
    r = rng()
    bases = [prose(r, n) for n in (5, 30, 80, 200, 400)]
    texts = [None, "", " \n", "one two", "one two", "two one", "one  two\n", "x", prose(r, 5000)]
    for b in bases:
        texts += [b, b, *(edited(r, b, s) for s in (0.005, 0.01, 0.02, 0.04, 0.08))]
    many = prose(r, 150)
    texts += [edited(r, many, 0.006) for _ in range(60)] + [prose(r, 40) + " " + bases[2] for _ in range(10)]
    return texts


def test_jaccard_join(spark, copies):
    links = brute_links(copies)
    n, root = [0] * len(copies), list(range(len(copies)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        n[i], n[j] = n[i] + 1, n[j] + 1
        a, b = sorted((find(i), find(j)))
        root[b] = a
    rows = docs(spark, copies).withColumn("bucket", F.lit(1)).withColumn("node", F.lit(1))
    for options in ({}, {"block": 16, "block_ngrams": 1000}):
        out = {x["doc_id"]: x for x in jaccard_join.join(rows, **options).collect()}
        assert [out[i]["n_links"] for i in range(len(copies))] == n
        assert [out[i]["class_id"] for i in range(len(copies))] == [find(i) for i in range(len(copies))]


def test_keep_one_document_of_each_group(spark, copies):
    rows = docs(spark, copies).withColumn("_key", F.lit("clash"))
    kept = jaccard_join.keep_one(rows.union(rows))
    assert kept.columns == rows.columns
    ids = [x["doc_id"] for x in kept.collect()]
    found = {x["doc_id"]: x["class_id"] for x in jaccard_join.join(rows).collect()}
    full = [i for i in range(len(copies)) if shingled(copies[i])]
    assert sorted(i for i in ids if shingled(copies[i])) == sorted({found[i] for i in full})
    assert sorted(i for i in ids if not shingled(copies[i])) == [0, 0, 1, 1, 2, 2]
    assert jaccard_join.keep_one(rows.limit(0)).count() == 0 and jaccard_join.join(rows.limit(0)).count() == 0


def test_shingles_match_words():
    texts = ["a b c d e f", "", "a b", "  a\tb\nc  d e ", "x", "a b c d e f"]
    found = list(sets([t.encode() for t in texts]))
    assert [len(x) for x in found] == [len(shingled(t)) for t in texts]
    assert (found[0] == found[5]).all() and found[3][0] in found[0] and found[2][0] not in found[0]


def test_bands():
    bands, rows = choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    hashed = MinHash(bands, rows)
    assert (hashed(np.array([1, 2, 3], np.uint64)) == hashed(np.array([1, 2, 3], np.uint64))).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 20), (5, 4), (30, 31), (31, 30)] + [(100 + i, 101 + i) for i in range(40)]
    out = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {out[i] for i in (1, 2, 3, 4, 5)} == {1} and {out[i] for i in (8, 9, 10)} == {8} and out[20] == 20 and out[31] == 30 and out[140] == 100


def test_components_with_large_stars(spark):
    """Two stars that share a leaf, a chain, and a node alone."""
    links = [(0, i) for i in range(1, 400)] + [(5000, i) for i in range(300, 700)] + [(1000 + i, 1001 + i) for i in range(30)] + [(3000, 3000)]
    want = {**dict.fromkeys([*range(700), 5000], 0), **dict.fromkeys(range(1000, 1031), 1000), 3000: 3000}
    frame = spark.createDataFrame(links, "a long, b long")
    assert {x["node"]: x["component"] for x in components(frame).collect()} == want


def pieces_are_whole(out, ids):
    """Every token once; sequences without gaps, full to 2048 or to a power of two."""
    for d, own in enumerate(ids):
        mine = sorted((x for x in out if x["doc_id"] == d), key=lambda x: x["start"])
        assert [x["start"] for x in mine] == [sum(y["length"] for y in mine[:i]) for i in range(len(mine))]
        assert sum(x["length"] for x in mine) == len(own) and {x["doc_tokens"] for x in mine} == {len(own)}
        for x in mine:
            assert x["ids_crc32"] == zlib.crc32(np.array(own[x["start"] : x["start"] + x["length"]], "<u4").tobytes())
    sequences = {}
    for x in out:
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    r = rng()
    texts = [None, "", " ", "a  b\n\n c", "x<|endoftext|>y", "naïve café 日本語 123!!", "it's, I'll", prose(r, 4000)] + [prose(r, r.randint(1, 600)) for _ in range(80)] + ["tie tie"] * 5 + ["a" * 30000, "line.\nNext one.\n\nThird \n"]
    rows = docs(spark, texts).withColumn("start", F.lit("x"))
    out = packing.pack_documents(rows, group_tokens=20_000).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    pieces_are_whole(out, [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts])
    assert packing.pack_documents(rows.limit(0)).count() == 0


def test_packing_balances_cost():
    r = rng()
    lengths = [r.randint(1, 900) for _ in range(800)]
    cost = {}
    for _, _, n, sequence, _ in packing.pack(lengths):
        cost[sequence] = cost.get(sequence, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [c for s, c in cost.items() if s < sum(lengths) // 2048]
    assert np.std(full) < 0.12 * np.mean(full)


def test_language_id(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    out = language_id.op7_language_id(spark, data).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in out) >= 0.97 * len(out) and all(0 <= x["score"] <= 1 for x in out)


def test_language_mixtures_and_odd_rows(spark):
    r = rng()
    rows = docs(spark, [prose(r, 200, "aeiou" * 2 + "lrs") for _ in range(10)] + [prose(r, 200, "aeiou" + "kvzw") for _ in range(10)], lang=["x"] * 10 + ["y"] * 10)
    model = language_id.train(rows.union(docs(spark, ["teaches nothing", None], lang=[None, "x"])))
    assert model.languages == ["x", "y"]
    x, y = prose(r, 300, "aeioulrs"), prose(r, 300, "aeioukvzw")
    assert set(model.proportions(x)) == {"x"} and set(model.proportions(f"{x} {y}")) == {"x", "y"}
    odd = docs(spark, [None, "", "123 !?", "日本", "lar", x * 20]).withColumn("_told", F.lit(1)).withColumn("score", F.lit(1))
    out = [tuple(v) for v in language_id.predict(odd, model, F.col("doc_id")).orderBy("doc_id").collect()]
    assert [v[1] for v in out[:3]] == ["und"] * 3 and out[3][1] in ("x", "y") and out[5][1] == "x" and all(0 <= v[2] <= 1 for v in out)
    none = language_id.train(rows.limit(0))
    assert language_id.predict(odd, none, F.col("doc_id")).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.predict(odd.limit(0), model, F.col("doc_id")).count() == 0


def test_only_letters_count_as_letters(spark):
    model = language_id.train(docs(spark, [prose(rng(), 50)] * 3, lang="x"))
    assert [model.predict(t)[0] for t in ("½", "²", "Ⅳ", "٣ 3", "ª", "ⅷ é", "ª½", "\u0301", None, "")] == ["und"] * 4 + ["x"] * 3 + ["und"] * 3


def test_long_texts_are_counted_chunk_by_chunk(monkeypatch):
    text = prose(rng(), 3000, "aeioué日lrs") + " 12 ß"
    whole = language_id.counted(text)
    for size in (7, 100, 4096):
        monkeypatch.setattr(language_id, "CHUNK_BYTES", size)
        cut = language_id.counted(text)
        assert (cut[0] == whole[0]).all() and (cut[1] == whole[1]).all()


def plain_mixture(likelihood, n, steps=400):
    """Proportions and log-likelihood by expectation-maximisation, n-gram by n-gram."""
    share = [1 / len(likelihood)] * len(likelihood)
    for _ in range(steps):
        got = [0.0] * len(share)
        for i, times in enumerate(n):
            each = [s * p[i] for s, p in zip(share, likelihood, strict=True)]
            got = [g + times * e / sum(each) for g, e in zip(got, each, strict=True)]
        share = [g / sum(n) for g in got]
    return share, sum(times * np.log(sum(s * p[i] for s, p in zip(share, likelihood, strict=True))) for i, times in enumerate(n))


def test_language_sets_against_all_sets(spark):
    """The set has the penalised likelihood of the best of all sets, and proportions as a plain EM gives them."""
    from itertools import combinations

    r = rng()
    letters = {"w": "aeioulrs", "x": "aeioukvzw", "y": "aouytdhg", "z": "bcfpqmnj"}
    trained = [(prose(r, 150, a), x) for x, a in letters.items() for _ in range(4)]
    model = language_id.train(docs(spark, [t for t, _ in trained], lang=[x for _, x in trained]))
    for names in ("w", "z", "wx", "yz", "xyz"):
        text = " ".join(prose(r, 30, letters[x]) for x in names)
        seen, n = language_id.counted(text)
        p, cost = model.likelihood[:, seen].astype(float), language_id.PENALTY * np.log(n.sum() + 1)
        fits = {}
        for size in range(1, 5):
            for some in combinations(range(4), size):
                share, fit = plain_mixture(p[list(some)].tolist(), n.tolist(), 60)
                fits[some] = (fit - cost * size, dict(zip([model.languages[k] for k in some], share, strict=True)))
        found = model.proportions(text)
        best = max(fits.values(), key=lambda f: f[0])
        assert set(found) == set(best[1]) == set(names)
        assert all(abs(found[x] - best[1][x]) < 0.03 for x in found)


def test_language_mixture_with_many_relatives():
    """B is the least likely language alone of a document that is two thirds A, but it is in the mixture."""
    g = np.random.default_rng(3)
    base = g.gamma(0.3, size=language_id.BUCKETS // 2) * 200
    none = np.zeros(language_id.BUCKETS // 2)
    relative = lambda: np.concatenate([base * g.gamma(4, 0.25, len(base)), none])
    counts = {f"a{i:02}": np.floor(relative()).astype(np.int64) for i in range(20)}
    counts["b"] = np.concatenate([none, np.floor(base)]).astype(np.int64)
    model = language_id.Model(counts)
    for share in (0.7, 0.55):
        drawn = share * model.likelihood[0] + (1 - share) * model.likelihood[20]
        n = g.multinomial(3000, drawn / drawn.sum() * (1 - 1e-9)).astype(np.float64)
        seen = np.flatnonzero(n)
        assert np.argmin(np.log(model.likelihood[:, seen]) @ n[seen]) == 20
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(language_id, "counted", lambda text: (seen, n[seen]))
            found = model.proportions("text")
        assert set(found) == {"a00", "b"} and abs(found["a00"] - share) < 0.03


def test_html_share_of_like_siblings_in_long_pages():
    for n in (150, 199, 200, 3000):
        nodes = html_extract.all_nodes(html_extract.parse("<html><body>" + "<p>some text</p>" * n + "<aside>x</aside></body></html>"))
        rows, tags = html_extract.features(nodes), [x.tag for x in nodes]
        for tag, share in (("aside", 1 / (n + 1)), ("p", n / (n + 1))):
            assert rows[tags.index(tag)][14] == np.float32(share)


def every(page):
    return list(html_extract.blocks(html_extract.parse(page), lambda n: True))


@pytest.mark.parametrize(("page", "blocks"), [
    ("<head><title>t</title><p>Hello world", ["Hello world"]), ("<head><meta name=x>Hello <b>w</b>orld<body class=a><p>y", ["Hello world", "y"]), ("<html><head><style>p</style><link></head><body>x", ["x"]),
    ("<h1 title=it's>Big</h1><p>more", ["Big", "more"]), ("<p class=\"a\"id='b'title=x\"y>t", ["t"]), ("a<p \"x\" class=\"q>z\" y>t", ["a", "t"]), ("<a b = 'c>d' e>x</a>", ["x"]), ("x<a b='", ["x"]), ("x<a", ["x"]), ("x</", ["x</"]),
    ("<p>one <button>no</button>two <script>x('</p>')</script>three<select><option>q</select> four<svg><text>s</text><path/></svg></p>", ["one two three four"]), ("<p>a<noscript><p>b</p></noscript>c", ["ac"]),
    ("<ul><li>a<li>b<div>c<li>d</ul>e", ["a", "b", "c", "d", "e"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]), ("<table><tr><td>1<td>2<tr><td>3</div>4</table>5", ["1", "2", "34", "5"]), ("<div><table><tr><td>a</div>b</table>c</div>d", ["ab", "c", "d"]),
    ("<h2>a<h3>b</h3>c", ["a", "b", "c"]), ("a<hr>b<br>c<img>d", ["a", "b cd"]), ("x &lt; y &eacute;&am<b>p;</b> <3 &#8364; &nosuch;", ["x < y é&amp; <3 € &nosuch;"]), ("a<!-- b --!> c -->d<!-->e<!--->f<!DOCTYPE x>g<?php h>i<!--j", ["a c -->defgi"]),
    ("<!-- first -->a", ["a"]), ("<textarea><p>x</textarea>y<title>z</title>", ["y"]), ("<iframe><p>x</iframe>y", ["y"]), ("<p>a</section>b</p></p>c", ["ab", "c"]), ("\u00a0a\t\n b\u2003", ["a b"]), ("<P>A<DIV>B</Div>C", ["A", "B", "C"]),
])
def test_html_as_browsers_read_it(page, blocks):
    assert every(page) == blocks


@pytest.mark.parametrize("unit", ['<a "', "<a b='", "<!--", "<p", "<a b=c ", '<a b="c', "<b/", "< ", "&", "<title>", "</section>", "<p>&am", "<a b=c>"])
def test_html_of_broken_pages_takes_linear_time(unit):
    import time

    took = []
    for size in (100_000, 1_000_000):
        began = time.process_time()
        every(unit * (size // len(unit)))
        took.append(time.process_time() - began)
    assert took[1] < 60 * max(took[0], 0.05)


def test_html_of_deep_pages():
    for page in ("<div>" * 100_000 + "deep text", "<section><table><td>" + "<div>" * 20_000 + "</section>" * 20_000 + "deep text", "<ul>" + "<div>" * 20_000 + "<li>" * 20_000 + "deep text"):
        assert every(page) == ["deep text"]
    model = html_extract.trained()
    assert html_extract.main_texts(["<article>" + "<div>" * 30_000 + "<p>Some words of the text, in a long paragraph here."], model)[0] in ("", "Some words of the text, in a long paragraph here.")


#: Written and labelled by hand: (page, main text).
HAND = [
    ("""<!doctype html><html lang=en><head><meta charset=utf-8><title>How tides work | Sea notes</title><link rel=stylesheet href=/s.css>
<script type="application/ld+json">{"@type":"Article","headline":"<p>no</p>"}</script><body class="single post-template">
<header class=site-header><a class=logo href=/>Sea notes</a><nav class=main-nav><ul><li><a href=/a>Articles</a><li><a href=/b>About us</a></ul></nav></header>
<main id=content><article class=post><h1>How tides work</h1><p>The Moon pulls on the water nearest to it, and the water rises. On the far side of the Earth it rises as well.
<p>Twice a day, on most coasts, the sea comes in &amp; goes out&nbsp;again.<h2>Springs and neaps</h2><p>When Sun and Moon stand in line, their pulls add up, and the tides are high.
</article></main><aside class=sidebar><h3>Most read</h3><ul><li><a href=/x>Ten knots</a><li><a href=/y>Fog</a></ul></aside><footer class=site-footer><p>&copy; 2021 Sea notes. All rights reserved.</footer>""",
     "How tides work\nThe Moon pulls on the water nearest to it, and the water rises. On the far side of the Earth it rises as well.\nTwice a day, on most coasts, the sea comes in & goes out again.\nSprings and neaps\nWhen Sun and Moon stand in line, their pulls add up, and the tides are high."),
    ("""<html><body><div id="menu" class="menu"><a href="/">Home</a> | <a href="/r">Recipes</a> | <a href="/c">Contact</a></div><div class="content"><h1>Bread in an afternoon</h1>
<p>Mix the flour, the salt and the yeast in a wide bowl, then pour in warm water.</p><ol><li>Knead for ten minutes.</li><li>Let it rest for an hour.</li><li>Bake until the crust sounds hollow.</li></ol><p>Eat it warm.</p></div>
<div class="comments"><h3>2 comments</h3><div class="comment"><p>Worked well for me, thank you!</p></div><div class="comment"><p>Mine stayed flat.</p></div></div><div class="footer">Imprint</div></body></html>""",
     "Bread in an afternoon\nMix the flour, the salt and the yeast in a wide bowl, then pour in warm water.\nKnead for ten minutes.\nLet it rest for an hour.\nBake until the crust sounds hollow.\nEat it warm."),
    ("""<body><div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><div class="wrapper"><div class="post-content"><h1>Das alte Haus</h1><p>Am Rand des Dorfes stand ein Haus, in dem seit Jahren niemand mehr wohnte.</p>
<div class="ad"><p>Jetzt g&uuml;nstig kaufen: Fenster und T&uuml;ren!</p></div><p>Die Kinder erz&auml;hlten sich, dass nachts ein Licht darin brannte, und keines traute sich hinein.</p><blockquote>Wer hineingeht, kommt anders heraus.</blockquote></div></div><footer><a href="/i">Impressum</a></footer></body>""",
     "Das alte Haus\nAm Rand des Dorfes stand ein Haus, in dem seit Jahren niemand mehr wohnte.\nDie Kinder erzählten sich, dass nachts ein Licht darin brannte, und keines traute sich hinein.\nWer hineingeht, kommt anders heraus."),
    ("""<html><head><title>x</title></head><body><nav><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></nav><article><h1>Notes on <em>glass</em></h1><p>Glass is made of sand, <b>soda</b> and lime.<script>track()</script> It is melted at great heat.</p>
<form class="newsletter"><p>Get our letter every week</p><input name=e><button>Go</button></form><p>When it cools, it stays clear.</p></article><section id="related"><h2>Related</h2><p>Notes on clay</p><p>Notes on iron</p></section></body>""",
     "Notes on glass\nGlass is made of sand, soda and lime. It is melted at great heat.\nWhen it cools, it stays clear."),
]


@pytest.mark.parametrize("at", range(len(HAND)))
def test_html_extraction_of_pages_labelled_by_hand(at):
    assert html_extract.main_texts([HAND[at][0]], html_extract.trained())[0] == HAND[at][1]


def test_html_extraction_of_generated_pages():
    made, model = html_extract.Pages(99), html_extract.trained()
    right = 0
    for _ in range(100):
        page = made.page()
        want = [b.replace(made.MARK, "") for b in html_extract.blocks(html_extract.parse(page), lambda n: True) if made.MARK in b]
        right += html_extract.main_texts([page.replace(made.MARK, "")], model)[0].split("\n") == want
    assert right >= 95


def test_html_extraction(spark):
    page = "<html><head><title>t</title><script>var a='</p><p>x';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n <b>two</b> three&eacute; words in a longer paragraph.<p>Second paragraph here, with text.<br></article><div class=comments><p>Nice, I think.</p></div><footer>&copy; me</footer>"
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<div class=menu>"), (1, "u", page), (None, "u", page * 3)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract(rows).collect()
    text = "A & B\nOne two threeé words in a longer paragraph.\nSecond paragraph here, with text."
    assert [x["text"] for x in out if x["page_id"] == 1] == [text, text] and all(x["n_chars"] == len(x["text"]) for x in out)
    assert all(x["text"] == "" for x in out if x["page_id"] in (2, 3, 4)) and len(out) == 6
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_decoding_never_contradicts():
    made, model = html_extract.Pages(5), html_extract.trained()
    for _ in range(30):
        nodes = html_extract.all_nodes(html_extract.parse(made.page()))
        kept = html_extract.decode(nodes, model.score(html_extract.features(nodes)))
        assert kept <= {id(n) for n in nodes}


def test_pipeline(spark, tmp_path):
    r = rng()
    base = prose(r, 120)
    texts = [base, base, edited(r, base, 0.004), "12 34", None, "", "has password=abcdef1234 in it " + prose(r, 30), *(prose(r, 60) for _ in range(30))]
    rows = docs(spark, texts, ["a"] * 25 + ["b"] * 12, ["en"] * 30 + [None] * 7).withColumn("row", F.lit("clash"))
    current = rows
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == rows.columns
            out.write.parquet(str(tmp_path / name))
            current = spark.read.parquet(str(tmp_path / name))
            ids = {x["doc_id"] for x in current.collect()}
        if name == "language_id":
            assert ids == set(range(len(texts))) - {3, 4, 5} and current.where("lang is null").count() == 0
        if name == "jaccard_join":
            assert ids == set(range(len(texts))) - {1, 2, 3, 4, 5}
        if name == "secret_scan":
            masked = current.where("doc_id = 6").first()
            assert masked["text"].startswith("has [SECRET] in it") and masked["n_chars"] == len(masked["text"])
    assert {x["doc_id"] for x in out.collect()} == ids
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rows.drop("row").write.parquet(str(tmp_path / "some/documents.parquet"))
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path / "some")).collect()} == ids


@pytest.mark.parametrize("seed", range(12))
def test_decoding_is_the_best_consistent_choice(seed):
    """Against every set of open elements that holds the parents of its elements: none is worth more, and what is kept are its elements with text that speak for it."""
    rng = np.random.default_rng(seed)
    root = html_extract.Node("html", frozenset(), None)
    nodes = [root]
    for _ in range(9):
        up = nodes[rng.integers(len(nodes))]
        child = html_extract.Node("div", frozenset(), up)
        if rng.random() < 0.7:
            child.parts.append("x" * int(rng.integers(1, 80)))
        up.parts.append(child)
        up.children.append(child)
        nodes.append(child)
    nodes = html_extract.all_nodes(root)
    odds = rng.normal(size=len(nodes)) * 3
    own = [sum(len(p) for p in n.parts if isinstance(p, str)) for n in nodes]
    worth = [odd * np.log1p(k) if k else min(odd, 0.0) for odd, k in zip(odds, own, strict=True)]
    place = {id(n): i for i, n in enumerate(nodes)}
    best, chosen = -np.inf, 0
    for bits in range(1, 1 << len(nodes), 2):
        if all(bits >> place[id(n.parent)] & 1 for i, n in enumerate(nodes) if i and bits >> i & 1):
            total = sum(w for i, w in enumerate(worth) if bits >> i & 1)
            if total > best:
                best, chosen = total, bits
    want = {i for i in range(len(nodes)) if chosen >> i & 1 and own[i] and odds[i] > 0}
    assert {place[k] for k in html_extract.decode(nodes, odds)} == want


STORY = ["The first paragraph of the story has some words, and a second clause.", "Another paragraph follows here, with more text, so that the page is read."]
_STORY = "".join(f"<p>{x}</p>" for x in STORY)
_NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>"


@pytest.mark.parametrize(
    "body, titles",
    [
        (f'{_NAV}<main class="ad-free content">{_STORY}</main><footer>&copy; me</footer>', []),
        (f'{_NAV}<article class="cookie-recipe"><h1>Oat cookies</h1>{_STORY}</article><footer>&copy; me</footer>', ["Oat cookies"]),
        (f"<form id=aspnetForm>{_NAV}<article>{_STORY}</article><footer>&copy; me</footer></form>", []),
        (f"<form id=aspnetForm>{_NAV}<div class=content>{_STORY}</div><footer>&copy; me</footer></form>", []),
        (f'{_NAV}<main><div class="header"><h1>Title</h1></div>{_STORY}</main><footer>&copy; me</footer>', ["Title"]),
    ],
)
def test_html_extraction_in_spite_of_misleading_names(body, titles):
    page = f"<html><head><title>x</title></head><body>{body}"
    assert html_extract.main_texts([page], html_extract.trained())[0].split("\n") == titles + STORY
