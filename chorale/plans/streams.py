"""Streaming queries (extensions), run over the stored events to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale.functions.columns import rounded
from chorale.plans.base import query
from chorale.streaming import blocks

R = rounded


def _us(c):
    return F.unix_micros(c)


@query("SELECT event_type AS chan, epoch_us(date_trunc('day', ts)) AS start, round(stddev_pop(value), 6) + 0.0 AS rms, count(value) AS n FROM events GROUP BY ALL")
def block_rms_stream(s, d):
    out = blocks.finished(blocks.block_rms(blocks.event_stream(s, d)))
    return out.select("chan", _us("start").alias("start"), R("rms").alias("rms"), "n")


@query("SELECT event_type AS chan, epoch_us(TIMESTAMP '2023-12-31') + 43200000000 * k AS start, round(stddev_pop(value), 6) + 0.0 AS rms, count(value) AS n FROM events, (SELECT unnest(range(64)) AS k) WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '2023-12-31') + 43200000000 * k AND epoch_us(ts) < epoch_us(TIMESTAMP '2023-12-31') + 43200000000 * (k + 2) GROUP BY ALL")
def sliding_rms_stream(s, d):
    out = blocks.finished(blocks.block_rms(blocks.event_stream(s, d), "1 day", "12 hours"))
    return out.select("chan", _us("start").alias("start"), R("rms").alias("rms"), "n")


@query("SELECT epoch_us(TIMESTAMP '2024-01-01') + 21600000000 * ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 21600000000) AS start, round(avg(value), 9) + 0.0 AS car, count(value) AS n FROM events GROUP BY ALL")
def car_stream(s, d):
    out = blocks.finished(blocks.average_reference(blocks.event_stream(s, d)))
    return out.select(_us("start").alias("start"), R("car", 9).alias("car"), "n")


@query("WITH o AS (SELECT event_type, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), g AS (SELECT event_type, ts, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT event_type AS chan, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS \"end\", count(*) AS n FROM g GROUP BY event_type, k")
def session_stream(s, d):
    out = blocks.finished(blocks.sessions(blocks.event_stream(s, d)))
    return out.select("chan", _us("start").alias("start"), _us("end").alias("end"), "n")
