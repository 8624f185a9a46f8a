"""Windows over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomlake import streaming
from roomlake.plans.metrics import rounded
from roomlake.plans.registry import query


def _events(read):
    return read("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT (epoch_us(ts) // 3600000000) * 3600 AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def events_tumbling(read):
    out = streaming.tumbling(_events(read), time="ts", width="1 hour", keys=["event_type"])
    return rounded(out.withColumn("start", F.unix_seconds("start")))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM e ORDER BY user_id, t))
SELECT user_id, min(t) AS start, max(t) + 21600000000 AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def events_session(read):
    out = streaming.sessions(_events(read), time="ts", gap="6 hours", keys=["user_id"])
    return rounded(out.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end")), 4)


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(read):
    return read("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
