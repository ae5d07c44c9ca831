"""Gateway operators over events: a user id stands for a client."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gateway
from ..sources import table

AT = "2024-01-20 00:00:00"
DAY = 86_400


def rate_limit_fixed(spark, d):
    return gateway.fixed_window(table(spark, d, "events"), 2, "1 day").select("event_id", "user_id", "allowed")


def rate_limit_trailing_count(spark, d):
    return gateway.trailing_count(table(spark, d, "events"), DAY).select("event_id", "n")


def rate_limit_sliding_log(spark, d):
    return gateway.sliding_log(table(spark, d, "events"), 2, DAY).select("event_id", "user_id", "allowed")


def rate_limit_retry_after(spark, d):
    """Each seventh user's events have a null key and share one log; the wait in microseconds."""
    rows = table(spark, d, "events").withColumn("user_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    return gateway.sliding_log(rows, 2, DAY).select("event_id", "allowed", F.round(F.col("retry_after") * 1_000_000).cast("long").alias("wait_us"))


def _tokens(spark, d):
    rows = table(spark, d, "events").where("event_type = 'signup'")
    return rows.select("event_id", "user_id", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"), (F.col("event_id") % 5 != 0).alias("is_active"))


def token_ttl(spark, d):
    users = table(spark, d, "events").select("user_id").distinct().withColumn("username", F.concat(F.lit("user"), F.col("user_id")))
    return gateway.valid_tokens(_tokens(spark, d), users, F.lit(AT).cast("timestamp")).select("event_id", "user_id", "username")


def token_expiry(spark, d):
    return gateway.expired(_tokens(spark, d), F.lit(AT).cast("timestamp")).select("event_id", "is_active")


def cache_freshness(spark, d):
    stamp = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", gateway.is_fresh(stamp, F.lit(AT)).alias("fresh"))


def user_issue(spark, d):
    rows = table(spark, d, "events")
    users = rows.where("event_type = 'signup'").select("user_id").distinct().withColumn("username", F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 6, "0")))
    asked = rows.select(F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("username"))
    return gateway.issue(users, asked).select("user_id", "username")


def request_latency(spark, d):
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(gateway.micros(start) + F.col("event_id") * 100)
    return table(spark, d, "events").select("event_id", gateway.latency_ms(start, end).alias("ms"))


QUERIES = {f.__name__: f for f in (rate_limit_fixed, rate_limit_trailing_count, rate_limit_sliding_log, rate_limit_retry_after, token_ttl, token_expiry, cache_freshness, user_issue, request_latency)}

_TOK = "t AS (SELECT event_id, user_id, ts + INTERVAL 24 HOURS AS expires_at, event_id % 5 <> 0 AS is_active FROM events WHERE event_type = 'signup')"


def _sliding(key: str, chosen: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT event_id, {key} AS user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, t, true AS allowed, [t] AS log FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, e.t, len(list_filter(r.log, lambda x: e.t - x < 86400000000)) < 2,
    CASE WHEN len(list_filter(r.log, lambda x: e.t - x < 86400000000)) < 2 THEN list_append(list_filter(r.log, lambda x: e.t - x < 86400000000), e.t) ELSE list_filter(r.log, lambda x: e.t - x < 86400000000) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
{chosen}"""


ORACLE_SQL = {
    "rate_limit_fixed": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events",
    "rate_limit_trailing_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM events",
    # Each step takes the next event of every user; the log holds the accepted times.
    "rate_limit_sliding_log": _sliding("user_id", "SELECT event_id, user_id, allowed FROM r"),
    "rate_limit_retry_after": _sliding("CASE WHEN user_id % 7 <> 0 THEN user_id ELSE -1 END", "SELECT event_id, allowed, CASE WHEN NOT allowed THEN log[1] + 86400000000 - t END AS wait_us FROM r"),
    "token_ttl": f"WITH {_TOK} SELECT event_id, user_id, 'user' || user_id AS username FROM t WHERE is_active AND expires_at >= TIMESTAMP '{AT}'",
    "token_expiry": f"WITH {_TOK} SELECT event_id, is_active AND expires_at >= TIMESTAMP '{AT}' AS is_active FROM t",
    "cache_freshness": f"SELECT event_id, event_id % 7 <> 0 AND epoch_us(TIMESTAMP '{AT}') - epoch_us(date_trunc('second', ts)) < 72 * 3600000000 AS fresh FROM events",
    "user_issue": "WITH u AS (SELECT DISTINCT user_id, 'user' || lpad(user_id::VARCHAR, 6, '0') AS username FROM events), s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') SELECT user_id, username FROM u WHERE user_id IN (SELECT user_id FROM s) UNION ALL SELECT (SELECT max(user_id) FROM s) + row_number() OVER (ORDER BY username), username FROM u WHERE user_id NOT IN (SELECT user_id FROM s)",
    "request_latency": "SELECT event_id, round(event_id * 100 / 1000, 1) AS ms FROM events",
}
