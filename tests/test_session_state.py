"""Sessions over a stream against one batch and against a plain fold, with late and unordered events."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.session import NO_TIME
from corpusloom.streaming import sessions


def _plain(events):
    by = {}
    for c, e, t, k, s in events:
        if None not in (c, e, t) and k in sessions.KINDS:
            by.setdefault(c, []).append((e, t, k, s))
    out = {}
    for c, rows in by.items():
        now = max(r[0] for r in rows)
        rows = [r for r in rows if r[0] == now]
        timed = [(t, s) for _, t, k, s in rows if k == "assistant" and s]
        n, m = (sum(k == w for _, _, k, _ in rows) for w in ("user", "assistant"))
        out[c] = (now, n, m, max(timed)[1] if timed else NO_TIME, n + m == 0, "OK" if c % 2 else "ERR")
    return out


def _shown(df):
    return {r["conv_id"]: tuple(r)[1:] for r in sessions.shown(df, F.col("conv_id") % 2 == 1).collect()}


def _events():
    rows = [(1, 0, 0, "open", None), (2, 0, 0, "open", None), (2, 0, 1, "user", ""), (2, 0, 2, "assistant", "1.5"), (2, 1, 3, "clear", None), (3, 0, 1, "assistant", ""), (3, 0, 2, "assistant", None)]
    rows += [(7, t // 150, t, "clear" if t and t % 150 == 0 else "user" if t % 2 else "assistant", f"{t % 90 / 10:.1f}" if t % 4 else "") for t in range(400)]
    rows += [(None, 0, 1, "user", ""), (3, None, 5, "user", ""), (3, 0, None, "user", ""), (3, 0, 6, "other", ""), (3, 0, 7, None, "")]
    return rows


def test_batch_equals_plain(spark):
    events = _events()
    assert _shown(sessions.batch_states(spark.createDataFrame(events, sessions.EVENTS))) == _plain(events)
    assert sessions.batch_states(spark.createDataFrame([], sessions.EVENTS)).count() == 0


@pytest.mark.parametrize("ordered", [True, False])
def test_stream_equals_batch(spark, tmp_path, ordered):
    events = _events()
    if not ordered:
        random.Random(3).shuffle(events)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    before, seen = spark.conf.get(sessions.PROVIDER), []
    for at in range(0, len(events), 150):
        spark.createDataFrame(events[at : at + 150], sessions.EVENTS).coalesce(1).write.mode("append").parquet(source)
        seen += events[at : at + 150]
        sessions.follow(spark, source, out, mark).awaitTermination()
        assert _shown(sessions.states(spark, out)) == _plain(seen)
    rows = spark.read.parquet(out).count()
    sessions.follow(spark, source, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == rows
    assert spark.conf.get(sessions.PROVIDER) == before


def test_no_python_for_each_session(spark, tmp_path):
    """The stream's state is Spark's own: keys of a micro-batch cost no call of Python each."""
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, 0, "open", None)], sessions.EVENTS).write.parquet(source)
    stream = sessions.session_stream(spark.readStream.schema(sessions.EVENTS).parquet(source))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Python" not in plan and "InPandas" not in plan
