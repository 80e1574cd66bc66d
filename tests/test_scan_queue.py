"""Queues of scans: the rule, the batch form, and the stream with failing batches and restarts."""

import json

import numpy as np
import pytest

from shelfwise.streaming import queue as Q

SCHEMA = "queue long, seq long, op string, item long, at double, ok boolean"


def log(n, seed, queues=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        q, kind = int(rng.integers(queues)), rng.random()
        rows.append((q, i, "scan", i, float(rng.integers(50)), None) if kind < 0.85 else (q, i, "send", None, None, bool(kind > 0.95)))
    return rows


def brute(rows, rules):
    out, held = [], {}
    for q, seq, op, item, at, ok in rows:
        out += [(q, *x) for x in Q.apply(held.setdefault(q, []), op, item, at, ok, rules)]
    return out, {q: [(i, r) for i, _, r in p] for q, p in held.items()}


def test_rule():
    rules, p = Q.Rules(cap=2, batch=1, tries=2), []
    assert Q.apply(p, "scan", 1, 5.0, None, rules) == [] and Q.apply(p, "scan", 2, 3.0, None, rules) == []
    assert Q.apply(p, "scan", 3, 9.0, None, rules) == [(2, "evicted", 0)]
    assert Q.apply(p, "send", None, None, False, rules) == [] and p == [[1, 5.0, 1], [3, 9.0, 0]]
    assert Q.apply(p, "send", None, None, False, rules) == [(1, "dropped", 2)]
    assert Q.apply(p, "send", None, None, True, rules) == [(3, "sent", 0)] and p == []
    assert Q.apply(p, "send", None, None, True, rules) == []


@pytest.mark.parametrize("rules", [Q.Rules(), Q.Rules(cap=5, batch=2, tries=2)])
def test_batch(spark, rules):
    rows = log(1500, 1)
    extra = [(None, 1, "scan", 1, 1.0, None), (0, 9999, "other", 1, 1.0, None)]
    got = [tuple(r) for r in Q.fates(spark.createDataFrame(rows + extra, SCHEMA).repartition(4), rules).collect()]
    left, held = brute(rows, rules)
    assert sorted(r[:4] for r in got if r[2] != "pending") == sorted(left)
    assert sorted((r[0], r[1], r[3]) for r in got if r[2] == "pending") == sorted((q, i, r) for q, p in held.items() for i, r in p)
    assert len(got) == sum(r[2] == "scan" for r in rows)
    assert Q.fates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def write(folder, name, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    (folder / f"{name}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))


def run(spark, tmp_path, rules, remind=None):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = Q.fates_stream(s, rules, remind).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.schema(Q.FATES).parquet(str(tmp_path / "out")).collect()]


def test_stream_goes_on_after_a_restart(spark, tmp_path, rocks):
    rules, rows = Q.Rules(cap=6, batch=3, tries=2), log(400, 2)
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "0", rows[:150])
    run(spark, tmp_path, rules)
    write(tmp_path / "in", "1", rows[150:260])
    write(tmp_path / "in", "2", rows[260:])
    got = run(spark, tmp_path, rules)
    assert sorted(r[:4] for r in got) == sorted(brute(rows, rules)[0])


def test_timer_reports_what_waits(spark, tmp_path, rocks):
    # else a query with timers goes on in batches without data, and never ends by itself
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "0", [(1, 1, "scan", 7, 1.0, None), (2, 1, "scan", 8, 1.0, None), (2, 2, "send", None, None, True)])
    run(spark, tmp_path, Q.Rules(), 1)
    write(tmp_path / "in", "1", [(3, 1, "scan", 9, 1.0, None)])
    got = run(spark, tmp_path, Q.Rules(), 1)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert (2, 8, "sent", 0, 2) in got and (1, 7, "due", 0, -1) in got and not any(r[1] == 8 and r[2] == "due" for r in got)
