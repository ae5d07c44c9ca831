"""URL filters: a weighted URL vocabulary.

An Aho-Corasick automaton finds every term of the vocabulary in the lower-cased URL in one pass. A hit counts only if
the characters on both sides of it are no letters or digits. One strict term, or several distinct soft terms, block the URL.
Host rules go before the vocabulary.

Defined results: a null URL, or one without "://", has an empty host and an empty path, fits no rule and is judged by
the vocabulary alone (null: no hit, allow). Null ids stay null and change no other id. URLs are read whole. Repeated rows are judged one by one. An empty table gives an empty result.
Columns besides page_id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_code

#: Host rules (verdict, host, path); the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Vocabulary: one of these blocks.
STRICT = ("spam-farm", "cheap-pills", "xxx", "porn", "porno", "viagra", "cialis", "sexcam", "warez", "payday-loans", "online-casino")
#: Vocabulary: SOFT_LIMIT different ones of these block.
SOFT = ("casino", "poker", "bet", "betting", "pills", "cheap", "loan", "loans", "adult", "dating", "crack", "keygen", "torrent", "jackpot", "escort", "nude", "replica", "pharmacy", "spam", "viagras")
SOFT_LIMIT = 2
SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int"


def parts(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    slash = end if slash < 0 else slash
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:slash]), rest[slash:end]


def fitting(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def automaton(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            found.add_word(term, (term, kind))
    found.make_automaton()
    return found


def hits(url: str | None, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and soft terms that stand between boundaries."""
    low = (url or "").lower()
    found = set()
    for last, (term, kind) in terms.iter(low):
        first = last - len(term) + 1
        if not (first and low[first - 1].isalnum()) and not (last + 1 < len(low) and low[last + 1].isalnum()):
            found.add((term, kind))
    strict = sum(kind == "strict" for _, kind in found)
    return strict, len(found) - strict


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict and the number of hits for each row of pages(page_id, url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                n_strict, n_soft = hits(url, terms)
                rule = fitting(host, path, rules)
                bad = n_strict >= 1 or n_soft >= soft_limit
                rows.append((host, path, rule[0] if rule else None, rule[1] if rule else "block" if bad else "allow", n_strict, n_soft))
            columns = [pa.array([r[i] for r in rows], pa.string() if i < 4 else pa.int32()) for i in range(6)]
            # Ids go through as they are: as floats beside a null they would lose digits.
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    with_code(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, SCHEMA)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_BOUND = "(^|[^\\p{L}\\p{N}])"
_END = "([^\\p{L}\\p{N}]|$)"


def _count(terms) -> str:
    return " + ".join(f"regexp_matches(lower(coalesce(url, '')), '{_BOUND}{t}{_END}')::INT" for t in terms)


ORACLE = f"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(regexp_extract(rest, '^[^?#]*'), '/.*$', 0, 's') AS path FROM u),
q AS (SELECT page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
n AS (SELECT *, ({_count(STRICT)})::INT AS strict_hits, ({_count(SOFT)})::INT AS soft_hits,
  CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
       WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN strict_hits >= 1 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits FROM n
"""
