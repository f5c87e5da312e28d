"""Queries over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.plans.registry import query, quoted
from pagemill.runtime import table
from pagemill.streaming import states

#: Steps between the kinds of events that count as legal, in the place of a job's states.
STEPS = {"login": ("view", "click", "logout"), "view": ("view", "click", "purchase", "logout"), "click": ("view", "click", "purchase", "logout"), "purchase": ("view", "logout"), "logout": ("login",)}
_EDGES = "e(a, b) AS (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, bs in STEPS.items() for b in bs) + ")"
_STEPS = f"""WITH {_EDGES}, l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IS NOT NULL),
t AS (SELECT l.*, before IS NULL OR EXISTS (SELECT 1 FROM e WHERE e.a = l.before AND e.b = l.event_type) AS legal FROM l)"""


@query(f"{_STEPS} SELECT * FROM t")
def state_steps(spark: SparkSession, d: str) -> DataFrame:
    """STM-01: each event with the one before and whether the step is legal (kinds of events stand for states)."""
    return states.transitions(table(spark, d, "events"), STEPS, "user_id", ("ts", "event_id"), "event_type").select("event_id", "user_id", "event_type", "before", "legal")


@query(f"{_STEPS} SELECT before, event_type, count(*) AS n FROM t WHERE NOT legal GROUP BY 1, 2")
def illegal_steps(spark: SparkSession, d: str) -> DataFrame:
    """STM-02: illegal steps."""
    return state_steps(spark, d).filter("not legal").groupBy("before", "event_type").agg(F.count("*").alias("n"))


@query()
def follow_states(spark: SparkSession, d: str) -> DataFrame:
    """STM-07: the last state of each reader (tested on a fixture)."""
    return states.follow_state(table(spark, d, "events"))


@query(
    """WITH RECURSIVE o AS (SELECT user_id, min(ts) AS started FROM events WHERE user_id IS NOT NULL GROUP BY 1
      UNION ALL SELECT o.user_id, min(e.ts) FROM o JOIN events e ON e.user_id = o.user_id AND e.ts >= o.started + INTERVAL 1 HOUR GROUP BY o.user_id, o.started)
    SELECT o.user_id, o.started, count(*) AS requests, greatest(count(*) - 3, 0) AS refused FROM o JOIN events e ON e.user_id = o.user_id AND e.ts >= o.started AND e.ts < o.started + INTERVAL 1 HOUR GROUP BY ALL"""
)
def hourly_limit(spark: SparkSession, d: str) -> DataFrame:
    """WIN-24: requests beyond a limit in the hours that the requests of a client open."""
    return states.hourly_limit(table(spark, d, "events"), 3)


@query(
    """WITH g AS (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true) THEN 1 ELSE 0 END AS n FROM events WHERE user_id IS NOT NULL),
    s AS (SELECT *, (sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS events, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1, 2"""
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events with gaps of at most 30 minutes, as in AGG-23."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w)) > F.expr("INTERVAL 30 MINUTE"), F.lit(True))
    e = table(spark, d, "events").filter("user_id is not null").withColumn("n", gap.cast("int"))
    return e.withColumn("session", F.sum("n").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
