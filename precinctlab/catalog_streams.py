"""Registered queries of stateful streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register
from .streaming import registry, tallies

STEP = {"signup": "built", "view": "analyzed", "click": "reported", "error": "invalidate"}


def steps(events):
    """Events as steps of a registry: a label per user, two years, and purchases as a step that is none."""
    step = F.lit("sold")
    for kind, name in STEP.items():
        step = F.when(F.col("event_type") == kind, name).otherwise(step)
    return events.select(F.concat(F.lit("label "), "user_id").alias("label"), (2020 + F.col("event_id") % 2).alias("year"), "event_id", "ts", step.alias("step"))


# analysed holds from its last mark that came after a build, unless an invalidation came between; reported in the same way from analysed
LOG = """
WITH e AS (SELECT 'label ' || user_id AS label, CAST(2020 + event_id % 2 AS VARCHAR) AS year, event_id, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS i,
  CASE event_type WHEN 'signup' THEN 'built' WHEN 'view' THEN 'analyzed' WHEN 'click' THEN 'reported' WHEN 'error' THEN 'invalidate' ELSE 'sold' END AS step FROM events),
b AS (SELECT *, coalesce(max(CASE WHEN step = 'built' THEN i END) OVER w, 0) AS built, coalesce(max(CASE WHEN step = 'invalidate' THEN i END) OVER w, 0) AS stale FROM e WINDOW w AS (PARTITION BY label, year ORDER BY i)),
a AS (SELECT *, coalesce(max(CASE WHEN step = 'analyzed' AND built > 0 THEN i END) OVER w, 0) AS marked FROM b WINDOW w AS (PARTITION BY label, year ORDER BY i)),
r AS (SELECT *, marked > stale AS analyzed, coalesce(max(CASE WHEN step = 'reported' AND marked > stale THEN i END) OVER w, 0) > stale AS reported FROM a WINDOW w AS (PARTITION BY label, year ORDER BY i)),
l AS (SELECT *, CASE WHEN step = 'sold' THEN 'no step: sold' WHEN step = 'analyzed' AND built = 0 THEN 'analyzed before built' WHEN step = 'reported' AND NOT analyzed THEN 'reported before analyzed' END AS problem,
  CASE WHEN reported THEN 'reported' WHEN analyzed THEN 'analyzed' WHEN built > 0 THEN 'built' ELSE 'none' END AS stage FROM r)
"""


@register("label_registry_log", LOG + "SELECT label, year, event_id, step, problem IS NULL AS accepted, problem, stage FROM l", base=False)
def _log(s, d):
    own = registry.own_session(s)
    return tallies.settle(registry.registry_log(steps(tallies.stream(own, f"{d}/events.parquet"))), "append")


@register("label_registry_stages", LOG + "SELECT label, year, arg_max(stage, i) AS stage, count(*) FILTER (problem IS NOT NULL) AS n_problems FROM l GROUP BY 1, 2", base=False)
def _stages(s, d):
    log = _log(s, d)
    order = steps(s.read.parquet(f"{d}/events.parquet")).select("event_id", "ts")
    both = log.join(order, "event_id")
    return both.groupBy("label", "year").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.count_if(F.col("problem").isNotNull()).alias("n_problems"))
