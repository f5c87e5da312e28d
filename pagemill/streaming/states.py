"""State machines over events: transitions, follow state and request limits, as batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States of an ingest job and those that may follow (fixed values).
TRANSITIONS = {
    "queued": ("resolving", "failed", "cancelled"),
    "resolving": ("matched", "needs_attention", "failed", "cancelled"),
    "matched": ("acquiring", "needs_attention", "failed", "cancelled"),
    "acquiring": ("clipping", "extracting", "needs_attention", "failed", "cancelled"),
    "clipping": ("validating", "needs_attention", "failed", "cancelled"),
    "extracting": ("validating", "failed", "cancelled"),
    "validating": ("publishing", "failed", "cancelled"),
    "publishing": ("ready", "failed"),
    "ready": (),
    "needs_attention": ("resolving", "acquiring", "cancelled"),
    "failed": (),
    "cancelled": (),
}


def edge_table(spark: SparkSession, edges: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """The transitions as rows: from_state, to_state."""
    return spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs], "from_state string, to_state string")


def transitions(events: DataFrame, edges: dict[str, tuple[str, ...]] = TRANSITIONS, key: str = "job_id", order: tuple[str, ...] = ("ts",), state: str = "state") -> DataFrame:
    """Each event with the state before and whether the step is legal; the first event of a key is legal.

    The window runs within a key; ties of the order are settled by the further
    order columns. Events with a null state are left out.
    """
    w = Window.partitionBy(key).orderBy(*order)
    # the table of steps is fixed and small, so it is an expression
    legal = F.create_map(*[x for a, bs in edges.items() for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))])
    rows = events.filter(F.col(state).isNotNull()).withColumn("before", F.lag(state).over(w))
    ok = F.col("before").isNull() | F.coalesce(F.array_contains(F.try_element_at(legal, F.col("before")), F.col(state)), F.lit(False))
    return rows.withColumn("legal", ok)


FOLLOW = "user_id long, steps long, selected string, following boolean, changes long"


def follow_state(events: DataFrame) -> DataFrame:
    """Last state of a reader who follows or picks: user_id, steps, selected, following, changes.

    ``view`` shows the kind while following; ``click`` picks and stops following;
    ``logout`` clears; all others start following again. As each step depends on the
    one before, a user's events are folded in order; a user has few.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        selected, following, changes = None, True, 0
        for kind, value in pdf.sort_values(["ts", "event_id"])[["event_type", "value"]].itertuples(index=False):
            was = selected
            if kind == "click":
                selected, following = f"{value:.2f}", False
            elif kind == "view" and following:
                selected = f"{value:.2f}"
            elif kind == "logout":
                selected, following = None, True
            elif kind not in ("view", "click"):
                following = True
            changes += was != selected
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "steps": [len(pdf)], "selected": [selected], "following": [following], "changes": [changes]})

    return events.filter("user_id is not null and ts is not null").select("user_id", "ts", "event_id", "event_type", "value").groupBy("user_id").applyInPandas(fold, FOLLOW)


def hourly_limit(events: DataFrame, most: int = 30, key: str = "user_id") -> DataFrame:
    """Requests beyond ``most`` in the hour that a client's request opens: key, started, requests, refused.

    An hour opens with a client's first request and with the first one that comes an
    hour or more after the last opening. The requests of a client are read in order
    and counted as they come, so nothing is held but the open hour.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        client, began, n = None, 0, 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[], [], []]
            made = pa.RecordBatch.from_arrays([pa.array(cols[0], kinds[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["client", "began", "requests"])
            out.clear()
            return made

        kinds = [pa.int64()]
        for b in batches:
            kinds[0] = b.schema.field(0).type
            for c, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c == client and at - began < 3_600_000_000:
                    n += 1
                else:
                    if n:
                        out.append((client, began, n))
                    client, began, n = c, at, 1
            if len(out) > 10_000:
                yield batch()
        if n:
            out.append((client, began, n))
        if out:
            yield batch()

    hours = rows.repartition("client").sortWithinPartitions("client", "at").mapInArrow(run, f"client {kind}, began long, requests long")
    return hours.select(F.col("client").alias(key), F.timestamp_micros("began").cast("timestamp_ntz").alias("started"), "requests", F.greatest(F.col("requests") - most, F.lit(0)).alias("refused"))


def stream_transitions(events: DataFrame, edges: dict[str, tuple[str, ...]] = TRANSITIONS, late: str = "10 minutes", keep_days: float = 30) -> DataFrame:
    """Streaming form of ``transitions`` for (job_id, ts, state): job_id, state, before, legal.

    The last state of a job is kept as the stream's state until the job ends or the
    watermark has passed its last event by ``keep_days``; an event after that counts
    as the first. Events are put in order within a micro-batch; one that comes in a
    later batch than its successor follows it. Rows without a job or time are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    final = {a for a, bs in edges.items() if not bs}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        before = state.get[0] if state.exists else None
        out = []
        for s in rows["state"]:
            if s is None:
                continue
            out.append((key[0], s, before, before is None or s in edges.get(before, ())))
            before = s
        if before is not None and before not in final:
            state.update((before,))
            last = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(keep_days * 86_400_000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["job_id", "state", "before", "legal"])

    timed = events.filter("job_id is not null and ts is not null").withWatermark("ts", late)
    return timed.groupBy("job_id").applyInPandasWithState(step, "job_id string, state string, before string, legal boolean", "last string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming counts by window and kind, with late events up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")
