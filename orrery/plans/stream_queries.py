"""Event windows in batch form, the oracle of the streaming form."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.plans.registry import query, table
from orrery.streaming.windows import event_shares, sessions


@query("""WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-02-15', INTERVAL 1 DAY)) AS start), k AS (SELECT start FROM s WHERE date_diff('day', DATE '1970-01-01', start::DATE) % 3 = 0)
SELECT strftime(start, '%Y-%m-%d') AS start, user_id, count(*) AS n, round(sum(value), 4) AS value, count(*) FILTER (event_type = 'purchase') AS purchases FROM events JOIN k ON ts >= start AND ts < start + INTERVAL 12 DAY GROUP BY 1, 2""")
def event_windows(spark, d):
    """Twelve-day windows every three days by user."""
    w = event_shares(table(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "user_id", "n", F.round("value", 4).alias("value"), "purchases")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, s""")
def event_sessions(spark, d):
    """Runs of events without a pause of six hours."""
    return sessions(table(spark, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
