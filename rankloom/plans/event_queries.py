"""Extensions beyond the surveyed pipeline: event windows, as-of and range joins, and a stream that must equal its batch."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.plans.base import query, r6


def _minute(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm").alias("start")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(_minute("w.start"), "event_type", "n", "total")


@query("WITH h AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS b, * FROM events), x AS (SELECT b - INTERVAL 6 HOUR * k AS start, event_type FROM h, (SELECT unnest(range(0, 4)) AS k)) SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM x GROUP BY 1, 2")
def events_sliding(t):
    w = t.events.groupBy(F.window("ts", "24 hours", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(_minute("w.start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def events_session(t):
    w = t.events.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"))
    return w.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


@query("SELECT a.event_id, b.event_id::DOUBLE AS prior, b.value AS prior_value FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def events_asof(t):
    """As-of join as one ordered pass: both sides in one relation, the last view carried forward within the user."""
    e = t.events.filter("event_type IN ('click', 'view')")
    view = F.when(F.col("event_type") == "view", F.struct("event_id", "value"))
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = e.withColumn("last", F.last(view, ignorenulls=True).over(w)).filter("event_type = 'click'")
    return c.select("event_id", F.col("last.event_id").cast("double").alias("prior"), F.col("last.value").alias("prior_value"))


@query("WITH p AS (SELECT user_id, event_id AS pid, ts FROM events WHERE event_type = 'purchase') SELECT p.pid, count(*) AS n, round(sum(e.value), 4) AS total FROM p JOIN events e ON e.user_id = p.user_id AND e.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts GROUP BY 1")
def events_range_join(t):
    """Range join by buckets of the range's width: each purchase meets two buckets, never a whole user."""
    width = 6 * 3600
    bucket = F.floor(F.unix_timestamp("ts") / width)
    e = t.events.select("user_id", F.col("ts").alias("ets"), "value", bucket.alias("b"))
    p = t.events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pid"), "ts", F.explode(F.array(bucket, bucket - 1)).alias("b"))
    j = p.join(e, ["user_id", "b"]).filter("ets <= ts AND ets >= ts - INTERVAL 6 HOURS")
    return j.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_equals_batch(t):
    """The streaming plan on a bounded source; the tests run it as a stream and compare."""
    from rankloom.streaming.windows import daily_counts

    return daily_counts(t.events).select(_minute("start"), "event_type", "n")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def running_pseudobulk(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def events_rolling(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return t.events.select("event_id", r6(F.avg("value").over(w), "rolling"))
