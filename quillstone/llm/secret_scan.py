"""Secret scans: an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger holds a row for each blob and rule version that has been
scanned, with the spans found, empty ones too. A run scans each blob once, and only for the rule versions that the ledger
does not have for it; then findings are joined back to all paths (rows) that hold the blob. All is DataFrame functions:
the gaps that split() leaves between the matches give their places. The registered query and the pipeline keep a ledger
for each folder of tables in the folder that the setting spark.quillstone.ledger names, for all sessions to come; where
it is unset, in this session's shared folder. A second run over the same texts scans nothing.

A run writes its rows to a folder of its own and commits it by one rename, so what a run that died has left is never read,
and no success mark is asked for. Runs at once over one ledger may both scan a blob; a span that is there twice counts once.
The ledger is written when findings() is called, not when its result is read.

Defined results: a null text is an empty one, without spans. Matches of a rule do not overlap, leftmost first; those that
are too short are dropped. Spans of different rules may overlap. Repeated rows get the same findings each. An empty table
gives an empty result. Places are code points, ends exclusive. Columns of any name may stand beside doc_id and text.
Texts are scanned whole, however long.
"""

from __future__ import annotations

from hashlib import sha256
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_of, let, remove, rename, shared_folder, spread_join, table

ASSIGN = """(?i:(password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PEM_HEAD = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
_B64 = "[A-Za-z0-9+/=]"
_PEM_LINE = f"[ \\t]*+(?:{_B64}{{16,}}+|(?:{_B64}{{4}})+|{_B64}++(?=\\z)|(?:Proc-Type|DEK-Info):[^\\n]*+)[ \\t\\r]*+(?:\\n|\\z)"
#: A private key from BEGIN to the END that comes before any other BEGIN; without one, to the end of the base64 on the line and of the
#: lines of base64 and headers that follow. Single characters are repeated, not groups, as Java's stack would not hold those of a long text.
PEM = (
    f"{PEM_HEAD}(?:(?>[\\s\\S]*?(?=-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----))-----END [A-Z ]*PRIVATE KEY-----"
    f"|(?:[ \\t]*+[A-Za-z0-9+/=\\\\]{{16,}}+)?(?:[ \\t\\r]*+(?=\\n)[\\s\\S]*?(?=\\z|\\r?\\n(?!\\s*+{_PEM_LINE})))?)"
)
#: (kind, version, pattern, group whose length counts, least length). The first three are the base rules.
RULES = (
    ("assign", 1, ASSIGN, 2, 6),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    ("hex", 1, "[0-9a-f]{24,}", 0, 24),
    ("pem", 2, PEM, 0, 1),
    ("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", 1, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("cloud", 1, "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("login", 1, "://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$&*+=-]{6,}@", 0, 1),
)
BASE = 3
#: Blobs with the most paths, and the most spans of each, whose findings go to every task (12 MB at most), so that their paths are joined in many.
HOT, HOT_SPANS = 1024, 256
SPAN = "array<struct<start: int, kind: int, end: int>>"
MASK = "[SECRET]"
#: Names a folder that the driver and all executors share and that outlives the session, for the ledgers.
SETTING = "spark.quillstone.ledger"


def keys(rules=RULES) -> list[str]:
    return [f"{kind}:{version}" for kind, version, *_ in rules]


def spans(text: Column, kind: int, rule: tuple) -> Column:
    """Of the matches of a rule that are long enough."""
    _, _, pattern, group, least = rule
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"), (F.length(F.regexp_extract(hit, pattern, group) if group else hit) >= least).alias("keep")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["hit"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    found = F.aggregate(steps, zero, step, lambda state: state["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


class Ledger:
    """Rows (blob, rule, spans, paths) of all scans so far, in a folder that the driver and all executors share; paths: rows with the blob when it was scanned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def of_tables(cls, spark: SparkSession, sf_dir: str, folder: str | None = None) -> Ledger:
        """The ledger for the tables in a folder: under the given folder, else that of the setting, else this session's own."""
        base = folder or spark.conf.get(SETTING, None) or f"{shared_folder(spark)}/secret-ledger"
        return cls(spark, f"{base}/{sha256(sf_dir.encode()).hexdigest()}")

    def rows(self) -> DataFrame | None:
        """Of all committed runs."""
        runs = f"{self.folder}/run-*"
        return self.spark.read.parquet(runs) if any_of(self.spark, runs) else None

    def add(self, rows: DataFrame) -> None:
        run = uuid4().hex
        pending = f"{self.folder}/_pending-{run}"
        remove(self.spark, pending, at_exit=True)
        rows.write.parquet(pending)
        rename(self.spark, pending, f"{self.folder}/run-{run}")


def addressed(documents: DataFrame, *keep: str) -> DataFrame:
    """row (the columns to keep, or all), text and blob for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.struct(*(keep or ["*"])).alias("row"), text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))


def scan(documents: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """blob, scanned (rule versions), spans and paths, for blobs that have a pair which the ledger(blob, rule, spans) does not have."""
    blobs = addressed(documents).groupBy("blob").agg(F.first("text").alias("text"), F.count("*").alias("paths"))
    wanted = F.array(*[F.lit(k) for k in keys(rules)])
    if ledger is None:
        unseen = blobs.withColumn("scanned", wanted)
    else:
        known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("known"))
        unseen = blobs.join(known, "blob", "left").withColumn("scanned", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))).where(F.size("scanned") > 0)
    found = [F.when(F.array_contains("scanned", key), spans(F.col("text"), i, rule)).otherwise(F.array().cast(SPAN)) for i, (key, rule) in enumerate(zip(keys(rules), rules, strict=True))]
    return unseen.select("blob", "scanned", F.concat(*found).alias("spans"), "paths")


def kind_of(rules) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in keys(rules)]), F.col("rule")).cast("int") - 1


def ledger_rows(scanned: DataFrame, rules=RULES) -> DataFrame:
    """blob, rule, spans and paths for each scanned pair, to be appended to the ledger."""
    each = scanned.select("blob", "spans", "paths", F.explode("scanned").alias("rule"))
    return each.select("blob", "rule", F.filter("spans", lambda s: s["kind"] == kind_of(rules)).alias("spans"), "paths")


def found_in(ledger: DataFrame, rules=RULES) -> DataFrame:
    """blob, spans (sorted by start and kind) and paths for the blobs with findings of these rule versions; those of older ones stay in the ledger.

    A rule's spans of a blob do not overlap, so equal ones are of a pair that the ledger has twice."""
    own = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), kind_of(rules).alias("kind"), s["end"].alias("end")))
    known = ledger.where(F.col("rule").isin(keys(rules)) & (F.size("spans") > 0)).select("blob", own.alias("spans"), "paths")
    return known.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.max("paths").alias("paths"))


def findings(documents: DataFrame, ledger: DataFrame | Ledger | None = None, rules=RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """row (the columns to keep, or all) and spans, sorted by start and kind, for each document. What is scanned is added to a Ledger."""
    if isinstance(ledger, Ledger):
        ledger.add(ledger_rows(scan(documents, ledger.rows(), rules), rules))
        known = ledger.rows()
    else:
        known = ledger_rows(scan(documents, ledger, rules), rules)
        if ledger is not None:
            known = known.unionByName(ledger.select("blob", "rule", "spans", F.lit(0).cast("long").alias("paths")))
    found = found_in(known, rules)
    rows = addressed(documents, *keep).select("row", "blob")
    if isinstance(ledger, Ledger):
        hot = found.where(F.size("spans") <= HOT_SPANS).orderBy(F.desc("paths"), "blob").limit(HOT)
        told = spread_join(rows, found, "blob", hot)
    else:
        told = rows.join(found, "blob", "left")
    return told.select("row", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def joined(found: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r[0]) for r in rules])
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, found: Column, mask: str = MASK) -> Column:
    """The text with each maximal run of overlapping spans replaced by the mask."""

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(found, zero, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, rest).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("row.doc_id", *[count(i).alias(f"n_{RULES[i][0]}") for i in range(BASE)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(findings(table(spark, sf_dir, "documents").select("doc_id", "text"), Ledger.of_tables(spark, sf_dir), keep=("doc_id",)))


def _sql(kind: int, rule: tuple) -> str:
    name, _, pattern, group, least = rule
    quoted = pattern.replace("'", "''")
    length = f"length(regexp_extract(h, '{quoted}', {group}))" if group else "length(h)"
    # The text behind each match is cut off, one match after another.
    return f"""
SELECT k, {kind} AS kind, '{name}' AS name, s AS start, s + length(h) AS "end" FROM (
  WITH RECURSIVE m AS (
    SELECT k, t AS rest, 0 AS pos, -1 AS s, '' AS h FROM d WHERE regexp_matches(t, '{quoted}')
    UNION ALL
    SELECT k, substr(rest, p + length(f)), pos + p - 1 + length(f), pos + p - 1, f
    FROM (SELECT *, strpos(rest, f) AS p FROM (SELECT k, rest, pos, regexp_extract(rest, '{quoted}') AS f FROM m)) WHERE f <> '')
  SELECT * FROM m WHERE s >= 0) WHERE {length} >= {least}"""


# The SQL has the first version of the pem rule, the line of BEGIN alone: the second is not one that its engine can match.
_SQL_RULES = tuple(("pem", 1, PEM_HEAD, 0, 1) if r[0] == "pem" else r for r in RULES)
# A match is found again by its text; that is its first place, as what it starts with cannot match earlier unless the whole does.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_sql(i, r) for i, r in enumerate(_SQL_RULES))}),
g AS (SELECT k, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c,
  string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
  string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) AS spans FROM f GROUP BY k)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)
"""
