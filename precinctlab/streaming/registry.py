"""A registry of labels as a stateful stream: built before analysed before reported, invalidation cascades.

Each (label, year) is a key with its own state, so keys spread over the
shuffle.  A key's events of one micro-batch are put in order and applied to
the state that earlier batches left; state lives in RocksDB, which only this
stream's own session asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Steps in order; each needs the one before.
STAGES = ("built", "analyzed", "reported")
INVALIDATE, REMOVE = "invalidate", "remove"

LOG = T.StructType().add("label", T.StringType()).add("year", T.StringType()).add("event_id", T.LongType()).add("step", T.StringType()).add("accepted", T.BooleanType()).add("problem", T.StringType()).add("stage", T.StringType())
ENTRY = Row(*LOG.names)
STATE = T.StructType([T.StructField(s, T.BooleanType()) for s in STAGES])


def applied(done: list[bool], step: str | None) -> tuple[list[bool], str | None]:
    """The state after a step, and what is wrong with it.

    Marking a stage twice changes nothing; a stage without the one before, and
    a step that is none, are problems and change nothing.  Invalidating drops
    all after the build and is fine on an unknown label; removing drops all.
    """
    if step == INVALIDATE:
        return [done[0], False, False], None
    if step == REMOVE:
        return [False] * 3, None
    if step not in STAGES:
        return done, f"no step: {step}"
    i = STAGES.index(step)
    if i and not done[i - 1]:
        return done, f"{step} before {STAGES[i - 1]}"
    return [x or k == i for k, x in enumerate(done)], None


def stage_of(done: list[bool]) -> str:
    return next((s for s, x in zip(STAGES[::-1], done[::-1]) if x), "none")


class Labels(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stages", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        done = list(self.state.get() or [False] * 3)
        log = []
        for e in sorted(rows, key=lambda e: (e.ts is None, e.ts, e.event_id)):
            done, problem = applied(done, e.step)
            log.append(ENTRY(*key, e.event_id, e.step, problem is None, problem, stage_of(done)))
        self.state.update(tuple(done))
        yield from log

    def close(self) -> None:
        pass


def own_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, with the state store that this stream needs."""
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return s


def registry_log(events: DataFrame) -> DataFrame:
    """Every event of a stream (label, year, event_id, ts, step) with what became of it: accepted, problem and the stage reached after it.

    Events count in the order of (ts, event_id) within a micro-batch, batches
    in their own; events without label or year are left out.
    """
    e = events.select(F.col("label").cast("string"), F.col("year").cast("string"), F.col("event_id").cast("long"), "ts", F.col("step").cast("string")).dropna(subset=["label", "year"])
    return e.groupBy("label", "year").transformWithState(statefulProcessor=Labels(), outputStructType=LOG, outputMode="Append", timeMode="None")
