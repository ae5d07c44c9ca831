"""Mixing sources to target weights: Pfair scheduling.

Each source's documents form blocks. In the ideal mix all sources run at once, each at a rate in proportion to its target
weight, as it is given and never rounded; a source that has run out leaves its rate to the others in proportion to their
weights. Block j of a source is released in the slot in which the ideal mix comes to j blocks of it, and due by the end of
the slot in which it comes to j + 1; in each slot the released block of the earliest deadline runs. That keeps every source
within one block of the ideal mix in every prefix, however long. All is DataFrame functions: slots are dealt in runs, each
from what earliest deadline first has left at its start, which is had without dealing the slots before (slots_of). The
driver sees the sources alone; a task holds a run of slots and the sources at a time.

Defined results: a null source is a source of its own. Every row is scheduled once, repeated rows too. Sources that the
given weights don't name, and weights that are not positive, get one block in a period. An empty table gives an empty
result. Columns of any name are kept, in a struct.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from itertools import accumulate
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

#: Documents of a block, and blocks of a period: the unit of quotas.
BLOCK, PERIOD = 8, 1000
#: Rows that are numbered in one task, about.
NUMBERED = 1024
#: Slots that are dealt in one row.
RUN = 512
#: The default target weight of a source is its number of documents to this power.
TEMPERATURE = 0.5


def timeline(blocks: list[int], quota: list[float]) -> tuple[list[float], list[int], list[float]]:
    """When sources of the ideal mix end (in periods, sorted), blocks of those that have ended before, and blocks in a period of those left."""
    ends = sorted((b / q, b, q) for b, q in zip(blocks, quota, strict=True))
    gone = [0, *accumulate(e[1] for e in ends)]
    rate = [*accumulate((e[2] for e in reversed(ends)), initial=0.0)][::-1]
    return [e[0] for e in ends], gone, rate


def edf(blocks: list[int], quota: list[float]) -> list[array]:
    """The slots of each source's blocks, in order, for sources of so many blocks and blocks in a period.

    The plain rule, one slot after another: slots_of() gives the same from tables, and is what schedule() takes.
    """
    at, gone, rate = timeline(blocks, quota)

    def time(s: int, j: int) -> float:
        """When the ideal mix comes to j blocks of source s."""
        periods = j / quota[s]
        k = bisect_right(at, periods)
        return gone[k] + periods * rate[k]

    def window(s: int, j: int) -> tuple[int, int, int]:
        """First slot, deadline and source of block j; a time within rounding errors of a whole number is that number."""
        start, end = time(s, j), time(s, j + 1)
        return floor(start + 1e-9 + start * 1e-13), ceil(end - 1e-9 - end * 1e-13), s

    slots = [array("q") for _ in blocks]
    waiting = [window(s, 0) for s, b in enumerate(blocks) if b]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(sum(blocks)):
        while waiting and (waiting[0][0] <= t or not ready):
            _, due, s = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if len(slots[s]) < blocks[s]:
            heapq.heappush(waiting, window(s, len(slots[s])))
    return slots


class Windows:
    """The ideal mix as expressions: windows of blocks, and blocks released before a slot. x: a source, with s, b (its blocks) and q."""

    def __init__(self, blocks: list[int], quota: list[float]):
        at, gone, rate = timeline(blocks, quota)
        each = [F.struct(F.lit(s).alias("s"), F.lit(b).alias("b"), F.lit(float(q)).alias("q")) for s, (b, q) in enumerate(zip(blocks, quota, strict=True))]
        self.n, self.sources = sum(blocks), F.array(*each).cast("array<struct<s:int,b:bigint,q:double>>")
        self.at, self.gone, self.rate, self.ends = (F.lit([float(v) for v in x]).cast("array<double>") for x in (at, gone, rate, [g + a * r for g, a, r in zip(gone, at, rate, strict=False)]))

    def time(self, x: Column, j: Column) -> Column:
        """When the ideal mix comes to j blocks of source x."""
        return let(j / x["q"], lambda p: let(F.size(F.filter(self.at, lambda a: a <= p)), lambda k: self.gone[k] + p * self.rate[k]))

    def release(self, x: Column, j: Column) -> Column:
        """First slot of block j; a time within rounding errors of a whole number is that number."""
        return let(self.time(x, j), lambda t: F.floor(t + 1e-9 + t * 1e-13))

    def due(self, x: Column, j: Column) -> Column:
        """The slot before which block j must have run."""
        return let(self.time(x, j + 1), lambda t: F.ceil(t - 1e-9 - t * 1e-13))

    def released(self, x: Column, t: Column) -> Column:
        """Blocks of source x that are released before slot t: by the rate of the ideal mix, put right by the windows, as it may be one off."""
        periods = let(F.size(F.filter(self.ends, lambda e: e <= t)), lambda k: F.when(self.rate[k] > 0, (t - self.gone[k]) / self.rate[k]))
        about = F.least(x["b"], F.coalesce(F.ceil(x["q"] * periods), x["b"]))
        more = lambda c: F.when((c < x["b"]) & (self.release(x, c) < t), c + 1).when((c > 0) & (self.release(x, c - 1) >= t), c - 1).otherwise(c)
        return let(about, more)


def slots_of(spark: SparkSession, blocks: list[int], quota: list[float], run: int = RUN) -> DataFrame:
    """s, j and slot: what edf() gives, found for runs of slots at once.

    Let late(t) be the blocks released before slot t, less t. When a run starts at slot T, the only blocks in doubt are those
    whose window holds T, one of a source. Of those released in slot t or later, #those - (late(T) - late(t)) at most have
    run, for every t before T, and earliest deadline first runs the most of any list of earliest deadlines within these
    limits. late() needs no schedule; so the least late(t) since each release is a minimum over the runs since then.
    """
    w = Windows(blocks, quota)
    ids = spark.range(-(-w.n // run)).select("id", (F.col("id") * run).alias("start"), F.least((F.col("id") + 1) * run, F.lit(w.n)).alias("stop"))
    block = "struct<slot:bigint,s:int,due:bigint,j:bigint>"

    def job(x: Column, j: Column) -> Column:
        return F.struct(w.release(x, j).alias("slot"), x["s"].alias("s"), w.due(x, j).alias("due"), j.alias("j"))

    def own(x: Column) -> Column:
        return F.struct(x.alias("x"), w.released(x, F.col("start")).alias("lo"), w.released(x, F.col("stop")).alias("hi"))

    runs = ids.withColumn("own", F.transform(w.sources, own))
    jobs = F.transform("own", lambda o: F.when(o["hi"] > o["lo"], F.transform(F.sequence(o["lo"], o["hi"] - 1), lambda j: job(o["x"], j))).otherwise(F.array().cast(f"array<{block}>")))
    runs = runs.withColumn("jobs", F.sort_array(F.flatten(jobs)))
    total = lambda side: F.aggregate("own", F.lit(0).cast("long"), lambda a, o: a + o[side])
    runs = runs.withColumn("late", total("lo") - F.col("start")).withColumn("late_then", total("hi") - F.col("stop"))

    # Blocks whose window holds the end of a run, with the least late(t) since their release.
    open_ = F.filter(F.transform(F.filter("own", lambda o: o["hi"] > 0), lambda o: job(o["x"], o["hi"] - 1)), lambda b: b["due"] > F.col("stop"))
    before = lambda b: F.array_min(F.transform(F.filter(F.col("numbered"), lambda y: y["slot"] > b["slot"]), lambda y: y["late"]))
    numbered = F.transform("jobs", lambda b, i: F.struct(b["slot"].alias("slot"), (F.col("late") + i - b["slot"] + F.col("start")).alias("late")))
    ended = runs.where(F.col("stop") < w.n).withColumn("numbered", numbered).withColumn("open", open_)
    ended = ended.select((F.col("id") + 1).alias("id"), "late_then", F.explode(F.transform("open", lambda b: F.struct(b.alias("b"), F.least(F.col("late_then"), before(b)).alias("least")))).alias("o"))
    since = Window.partitionBy("o.b.s", "o.b.j").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ended.withColumn("least", F.min("o.least").over(since))
    doubt = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("o.b.slot", "o.b.s", "o.b.due", "o.b.j", "least"))).alias("doubt"))

    # Limits of how many from each place of that list on have run, then the earliest deadlines within them; the others wait.
    m = F.size("doubt")
    given = F.transform("doubt", lambda b, i: F.when(i == 0, m - F.col("late")).when(b["slot"] > F.get("doubt", i - 1)["slot"], m - i - F.col("late") + F.get("doubt", i - 1)["least"]).otherwise(m - i))
    falling = F.transform("given", lambda _, i: F.array_min(F.slice("given", 1, i + 1)))
    limits = F.transform("falling", lambda _, i: F.least(m - i, F.array_min(F.transform(F.slice("falling", i + 1, m), lambda c, k: c + k))))
    waiting = lambda b: F.struct(b["due"].alias("due"), b["s"].alias("s"), b["j"].alias("j"))
    pool = "array<struct<due:bigint,s:int,j:bigint>>"

    def in_doubt(acc: Column, i: Column) -> Column:
        all_ = F.concat(acc, F.array(waiting(F.get("doubt", i))))
        left = let(all_, lambda p: let(F.array_min(p), lambda least: F.filter(p, lambda b: b != least)))
        return F.when(F.get("limits", i) > F.coalesce(F.get("limits", i + 1), F.lit(0)), left).otherwise(all_)

    begun = runs.select("id", "start", "stop", "jobs", "late").join(doubt.hint("merge"), "id", "left").withColumn("given", given).withColumn("falling", falling).withColumn("limits", limits)
    places = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    begun = begun.withColumn("waiting", F.aggregate(places, F.array().cast(pool), in_doubt))

    def step(acc: Column, t: Column) -> Column:
        new = F.filter(F.slice("jobs", acc["next"] + 1, len(blocks)), lambda b: b["slot"] == t)
        ready = let(new, lambda n: F.struct((acc["next"] + F.size(n)).alias("next"), F.concat(acc["waiting"], F.transform(n, waiting)).alias("ready")))
        picked = lambda r: let(F.array_min(r["ready"]), lambda b: F.struct(r["next"].alias("next"), F.filter(r["ready"], lambda o: o != b).alias("waiting"), F.concat(acc["out"], F.array(F.struct(b["s"].alias("s"), b["j"].alias("j"), t.alias("slot")))).alias("out")))
        return let(ready, picked)

    none = F.struct(F.lit(0).alias("next"), F.col("waiting").alias("waiting"), F.array().cast("array<struct<s:int,j:bigint,slot:bigint>>").alias("out"))
    dealt = begun.select(F.explode(F.aggregate(F.sequence(F.col("start"), F.col("stop") - 1), none, step, lambda acc: acc["out"])).alias("x"))
    return dealt.select("x.s", "x.j", "x.slot")


def sources_of(rows: DataFrame, weights: dict[str, float] | None, block: int, period: int) -> DataFrame:
    """One row: all sources with their blocks and blocks in a period (a target, not a whole number), sorted."""
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n"), TEMPERATURE)
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.greatest(F.coalesce(given[F.coalesce("source", F.lit("\0"))].cast("double"), F.lit(0.0)), F.lit(0.0))
    weighted = counts.withColumn("weight", weight)
    all_of = weighted.agg(F.sort_array(F.collect_list(F.struct("source", "n", "weight"))).alias("each"), F.sum("weight").alias("total"))
    return all_of.select(F.transform("each", lambda x: F.struct(x["source"].alias("source"), F.ceil(x["n"] / block).cast("long").alias("blocks"), F.when(x["weight"] > 0, x["weight"] / F.col("total") * period).otherwise(F.lit(1.0)).alias("quota"))).alias("each"))


def schedule(documents: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, source: str = "source", key: str = "doc_id") -> DataFrame:
    """row (all columns of documents), block (of its source), slot (of the block) and in_block for each document."""
    name = F.col(source).cast("string")
    own = F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("own")  # never null, so that joins keep the partitioning of windows
    rows = documents.select(F.struct("*").alias("row"), own, F.xxhash64(F.col(key)).alias("at"))
    sources = sources_of(documents.select(name.alias("source")), weights, block, period).first()["each"]
    n = block * sum(x["blocks"] for x in sources)

    # Numbers within a source: counts of small parts of it, summed up, and a number within the part.
    parts = max(1, -(-n // NUMBERED))
    part = lambda at: F.pmod(F.shiftright(at, 17), F.lit(parts)).alias("part")
    sizes = documents.select(own, part(F.xxhash64(F.col(key)))).groupBy("own", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("own").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", F.coalesce(before, F.lit(0)))

    # The slots go to the small parts, so that no row moves for them. Both grow with the rows, so neither is ever broadcast.
    names = F.array(*[F.lit("" if x["source"] is None else "=" + x["source"]) for x in sources]).cast("array<string>")
    dealt = slots_of(documents.sparkSession, [x["blocks"] for x in sources], [x["quota"] for x in sources]).select(F.get(names, F.col("s")).alias("own"), F.col("j").alias("_block"), "slot")
    first_block = F.floor(F.col("before") / block)
    asked = offsets.withColumn("_block", F.explode(F.sequence(first_block, F.floor((F.col("before") + F.col("size") - 1) / block))))
    slotted = asked.join(dealt.hint("merge"), ["own", "_block"])
    offsets = slotted.groupBy("own", "part").agg(F.min("before").alias("before"), F.sort_array(F.collect_list("slot")).alias("slots"))

    within = Window.partitionBy("own", "part").orderBy("at", F.xxhash64("row"))
    numbered = rows.withColumn("part", part(F.col("at"))).withColumn("n", F.row_number().over(within))
    numbered = numbered.join(offsets.hint("merge"), ["own", "part"])
    numbered = numbered.withColumn("n", F.col("n") + F.col("before") - 1).withColumn("block", F.floor(F.col("n") / block))
    slot = F.col("slots")[(F.col("block") - first_block).cast("int")]
    return numbered.select("row", "block", slot.alias("slot"), (F.col("n") - F.col("block") * block).cast("int").alias("in_block"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The same rows and columns in the order of the schedule."""
    return schedule(documents, **options).orderBy("slot", "in_block").select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheduled = schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return scheduled.select("row.doc_id", "row.source", "block", "slot", "in_block")
