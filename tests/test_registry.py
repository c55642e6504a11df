"""The registry stream over several micro-batches against a plain loop."""

import random

import pytest

from precinctlab.streaming import registry, tallies

SCHEMA = "label string, year int, event_id long, ts timestamp, step string"


def test_rules():
    s, problem = registry.applied([False] * 3, "analyzed")
    assert s == [False] * 3 and problem == "analyzed before built"
    s, problem = registry.applied([True, True, True], "invalidate")
    assert s == [True, False, False] and problem is None and registry.stage_of(s) == "built"
    assert registry.applied([True, True, False], "built") == ([True, True, False], None)
    assert registry.applied([True, True, True], "remove")[0] == [False] * 3
    assert registry.applied([True, False, False], None)[1] == "no step: None"


@pytest.mark.parametrize("batches", [1, 4])
def test_stream(spark, tmp_path, batches):
    r = random.Random(3)
    steps = ["built", "analyzed", "reported", "invalidate", "remove", "odd", None]
    rows = [(r.choice(["x", "y", None]), 2020 + i % 2 if i % 17 else None, i, f"2026-01-01 00:{i // 60:02d}:{i % 60:02d}", r.choices(steps, [4, 4, 4, 1, 1, 1, 1])[0]) for i in range(160)]
    size = len(rows) // batches
    for b in range(batches):  # one file a batch, its rows in any order
        part = rows[b * size : (b + 1) * size]
        r.shuffle(part)
        spark.createDataFrame(part, "label string, year int, event_id long, t string, step string").selectExpr("label", "year", "event_id", "cast(t AS timestamp) AS ts", "step").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    own = registry.own_session(spark)
    events = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {x.event_id: tuple(x) for x in tallies.settle(registry.registry_log(events), "append").collect()}
    state, want = {}, {}
    for label, year, i, _, step in sorted(rows, key=lambda x: x[2]):
        if label and year:
            key = (label, str(year))
            state[key], problem = registry.applied(state.get(key, [False] * 3), step)
            want[i] = (*key, i, step, problem is None, problem, registry.stage_of(state[key]))
    assert got == want and {w[-1] for w in want.values()} == {"none", "built", "analyzed", "reported"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != own.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_rows_of_a_key_need_no_frames():
    """Rows go in and out as they are, in the order of (ts, event_id), with one read and one write of the state."""
    from pyspark.sql import Row

    class State:
        calls = []

        def get(self):
            self.calls.append("get")

        def update(self, value):
            self.calls.append(value)

    labels = registry.Labels()
    labels.state = State()
    rows = [Row(ts=2, event_id=1, step="analyzed"), Row(ts=None, event_id=4, step="reported"), Row(ts=1, event_id=3, step="built"), Row(ts=1, event_id=2, step="analyzed")]
    out = list(labels.handleInputRows(("a", "2020"), iter(rows), None))
    assert [(x.event_id, x.accepted, x.stage) for x in out] == [(2, False, "none"), (3, True, "built"), (1, True, "analyzed"), (4, True, "reported")]
    assert State.calls == ["get", (True, True, True)]
