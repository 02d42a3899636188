import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewheel import job, oracles, queries
from tidewheel.operators import detail, replay, windows
from tidewheel.sources import tables
from tidewheel.plans.config import Aggregate, DetailConfig, GroupSchema, JobConfig, Retraction, WindowConfig

HOUR, DAY, ZONE = 3_600_000, 86_400_000, 28_800_000
GROUP = GroupSchema.parse(json.dumps({"field": ["key_0", "endtime_13"], "group": ["count_2", "sum_2", "distinct_long_2"]}))


def config(**kw):
    return WindowConfig(**{"key_fields": (0,), "time_field": 1, "size": 3 * HOUR, "slide": HOUR, "group": GROUP, **kw})


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, t string, v long")


def model(rows, cfg):
    """Replay with a dict of panes."""
    by_key = defaultdict(list)
    for k, t, v in rows:
        by_key[k].append((int(t), v))
    out = {}
    sod = lambda ms: ms - (ms + ZONE) % DAY
    for k, own in by_key.items():
        panes = sorted({t - t % cfg.slide for t, _ in own})
        spans = [[panes[0], panes[0]]]
        for p in panes[1:]:
            if p - spans[-1][1] >= (cfg.split + 2) * cfg.slide:
                spans.append([p, p])
            spans[-1][1] = p
        for a, b in spans:
            for w in range(a + cfg.slide, b + (cfg.split + 2) * cfg.slide + 1, cfg.slide):
                got = [v for t, v in own if w - cfg.reach <= t - t % cfg.slide < w and v is not None and (not cfg.start_zero or sod(w - 1) <= t - t % cfg.slide)]
                out[k, w - 1] = (len(got), float(sum(got)), len(set(got)))
    return out


@pytest.mark.parametrize("kw", [{}, {"size": HOUR}, {"size": 5 * HOUR, "slide": 2 * HOUR}, {"size": 25 * HOUR, "start_zero": True}, {"start_zero": True}])
def test_windows_match_the_model(spark, kw):
    rng = random.Random(str(kw))
    start = 1_704_000_000_000
    rows = [(rng.choice("ab"), str(start + rng.choice([0, 40 * HOUR]) + rng.randrange(30 * HOUR)), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    rows += [("a", str(start - start % DAY + 16 * HOUR + d), 7) for d in (-1, 0, 1)]  # around midnight
    cfg = config(**kw)
    got = {(r[0], r[1]): tuple(r)[2:] for r in windows.windowed(table(spark, rows), cfg).collect()}
    assert got == model(rows, cfg)


def test_empty_table_and_bad_times(spark):
    assert windows.windowed(table(spark, []), config()).count() == 0
    assert windows.windowed(table(spark, [("a", "soon", 1)]), config()).count() == 0
    with pytest.raises(Exception, match="not a time"):
        windows.windowed(table(spark, [("a", "soon", 1)]), config(strict=True)).collect()


def test_null_key_is_a_key(spark):
    got = windows.windowed(table(spark, [(None, "1704000000", 1)]), config()).collect()
    assert got and got[0][0] is None and got[0][2] == 1


def test_late_rows_revise_their_day(spark):
    cfg = config(size=25 * HOUR, start_zero=True, keep_late_zero=HOUR)
    t = 1_704_040_000_000
    df = spark.createDataFrame([("a", str(t), 1, t), ("a", str(t), 2, t + 2 * HOUR), ("a", str(t), 9, t + 30 * HOUR)], "k string, t string, v long, arrival long")
    out = replay.latest(replay.revisions(df, cfg, "arrival"), ["_k0"]).collect()
    assert {r["_a0"] for r in out} == {2}
    assert replay.admitted(df, cfg, "arrival").count() == 2


@pytest.mark.parametrize("bad", ["avg_1", "count", "count_x"])
def test_unknown_aggregates(bad):
    with pytest.raises(ValueError, match="unmatch group type"):
        Aggregate.parse(bad)


def test_parameters():
    p = {"input.table.name": "i", "output.table.name": "o", "window.size": "10", "slide.size": "5", "time.field": "1", "group.string": '{"field":["key"],"group":["count_1"]}', "key.fields": "0,2"}
    job = JobConfig.from_params(p)
    assert job.window.key_fields == (0, 2) and job.window.always and not job.window.recount
    for change in ({"slide.size": "11"}, {"input.table.type": "queue"}, {"output.table.type": "queue"}, {"stream.time.type": "ingestion"}, {"key.fields": ""}):
        with pytest.raises(ValueError):
            JobConfig.from_params({**p, **change})
    assert Retraction.parse_map("0=0;1=1") == ((0, 0), (1, 1))


def test_details(spark, tmp_path):
    df = spark.createDataFrame([("p", "x", None, 1), ("p", "y", 2, 2), ("p", "y", 3, 3)], "k string, pk string, v long, n long")
    cfg = DetailConfig("field_0", 1, (1, 2), ":s")
    built = detail.build(df, cfg, "n")
    assert built.filter("field = 'x'").first()["value"] == "x,null"
    assert detail.resolve(built, True).filter("field = 'y'").first()["value"] == "y,2"
    store = detail.DetailStore(spark, str(tmp_path / "s"))
    detail.write_details(df, cfg, store, "n")
    assert store.hget("p:s", "y") == "y,3" and store.hkeys("p:s").count() == 2 and not store.exists("q")
    with pytest.raises(Exception, match="blank"):
        detail.build(df.withColumn("pk", F.lit(" ")), cfg).collect()


@pytest.mark.parametrize(
    ("name", "group", "kw"),
    [
        ("emit_on_change", ["count_4", "sum_4", "distinct_long_2"], {"size": 3 * HOUR, "always": False}),
        ("always_calculate_grid", ["count_4", "sum_4"], {"size": 3 * HOUR}),
        ("idle_key_islands", ["count_4", "distinct_long_2"], {"size": 6 * HOUR}),
        ("keep_old_data", ["count_4", "distinct_long_2"], {"size": 6 * HOUR, "keep_old": True}),
    ],
)
def test_idle_keys_over_all_events(spark, name, group, kw):
    """The query over all events, and the same windows over a sparse part of them, against SQL."""
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")

    def same(got, sql):
        want = sorted(db.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall())
        have = sorted(map(tuple, got.collect()))
        assert len(have) == len(want) and have
        assert all(x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], abs=1e-3) for x, y in zip(have, want, strict=True))

    same(queries.QUERIES[name](spark, folder), oracles.ORACLE[name])
    sparse = lambda e: e.filter((F.col("event_type") == "error") & (F.dayofmonth("ts") % 5 == 0))
    rows = f"SELECT * FROM ({oracles._EVENTS}) WHERE event_type = 'error' AND day(epoch_ms(t)) % 5 = 0"
    same(queries.window_query(sparse, group=group, slide=HOUR, **kw)(spark, folder), oracles.window_sql(group, rows=rows, **kw))


def test_detail_store_lives_and_compacts(spark, tmp_path):
    now = [1_000.0]
    store = detail.DetailStore(spark, str(tmp_path / "s"), clock=lambda: now[0])
    put = lambda k, f, v, ttl=0: (store.write(spark.createDataFrame([(k, f, v)], detail.SCHEMA), ttl), now.__setitem__(0, now[0] + 1))
    assert store.read().isEmpty() and store.get("none") is None and not store.exists("h")
    put("h", "a", "1", 10)
    put("h", "b", "2", 10)
    put("k", "a", "3")
    put("h", "a", "4")  # a write without a time keeps the hash's end
    assert {tuple(r) for r in store.hgetall("h").collect()} == {("a", "4"), ("b", "2")}
    store.set("name", "x")
    now[0] += 1
    store.lpush("list", "1", "2")
    now[0] += 1
    store.lpush("list", "3")
    for _ in range(2):
        assert store.get("name") == "x" and [r.value for r in store.lrange("list").collect()] == ["3", "2", "1"]
        assert store.hget("h", "b") == "2" and store.exists("k") and store.hkeys("h").count() == 2
        now[0] += 1
        store.compact()
    now[0] = 1_011.5
    assert not store.exists("h") and store.hget("k", "a") == "3"
    put("h", "c", "5")  # a hash that is over starts anew
    assert [tuple(r) for r in store.hgetall("h").collect()] == [("c", "5")]
    names = spark.createDataFrame([("a",), ("z",)], "field string")
    assert [r.value for r in store.hmget("k", names).collect()] == ["3"]


def test_detail_store_tries_again(spark, tmp_path):
    store = detail.DetailStore(spark, str(tmp_path / "s"), wait_s=0.0)
    calls = []

    def missing():
        calls.append(1)
        return spark.read.schema("a long").parquet(str(tmp_path / "none")).collect()

    with pytest.raises(ConnectionError):
        store._again(missing)
    assert len(calls) == 3
    bad = spark.createDataFrame([(" ", "1")], "k string, v string")
    with pytest.raises(Exception, match="blank"):
        store.write(detail.build(bad, DetailConfig("field_0", 1, (1,))))


def test_job_refuses_what_it_can_not_honour(spark):
    p = {"input.table.name": "i", "output.table.name": "o", "window.size": "10", "slide.size": "5", "time.field": "1", "group.string": '{"field":["key"],"group":["count_1"]}', "key.fields": "0"}
    for change in ({"min.idle.state": "1", "max.idle.state": "2"}, {"stream.time.type": "processing"}, {"min.idle.state": "1"}):
        with pytest.raises(ValueError):
            job.run_window_job(spark, {**p, **change})
    for change in ({"output.table.type": "buffer"}, {"hkey.value.map": "0=0"}, {"redis.address": "h"}):
        with pytest.raises(ValueError):
            job.start_window_job(spark, {**p, **change}, "unused")


def test_windows_at_the_edges(spark):
    """Rows a millisecond before a window's end and at it, around midnight, and ahead of the clock."""
    start = 1_704_038_400_000  # midnight at +08:00
    rows = [("a", str(start + d), 1) for d in (-HOUR - 1, -1, 0, 1, HOUR - 1, HOUR, 5 * HOUR)]
    for kw in ({}, {"size": 25 * HOUR, "start_zero": True}):
        cfg = config(**kw)
        assert {(r[0], r[1]): tuple(r)[2:] for r in windows.windowed(table(spark, rows), cfg).collect()} == model(rows, cfg)


def test_stream_fires_by_the_wall_clock(spark, tmp_path):
    """Processing time: windows come though no further row does, and a NaN counts as in a batch."""
    import time

    from tidewheel.streaming.processor import revised_stream

    group = GroupSchema.parse('{"field":["key_0","endtime_13"],"group":["count_2","sum_2"]}')
    cfg = WindowConfig((0,), 1, 2000, 1000, group)
    now = int(time.time() * 1000)
    spark.createDataFrame([("a", str(now), 1.0), ("a", str(now), None), ("b", str(now), float("nan"))], "k string, t string, v double").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, t string, v double").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = str(tmp_path / "out")
    query = revised_stream(source, cfg, processing=True, idle_ms=60_000).writeStream.foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{out}/batch={e}")).option("checkpointLocation", str(tmp_path / "state")).start()
    rows = []
    for _ in range(120):
        time.sleep(0.5)
        if query.lastProgress and len(rows := spark.read.parquet(out).collect()) >= 4:
            break
    query.stop()
    assert {r._a0 for r in rows if r._k0 == "a"} <= {0, 1} and any(r._k0 == "b" for r in rows)
    late = [r for r in rows if r.end > now + 4000]
    assert late or len(rows) >= 4


def test_upsert_survives_a_repeated_batch(spark, tmp_path):
    put = tables.Upsert(str(tmp_path / "u"), ["k"], "tick")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long, tick long")
    put(rows(("a", 1, 1), ("b", 2, 1)), 7)
    put(rows(("a", 3, 2)), 8)
    put(rows(("a", 3, 2)), 8)
    assert {tuple(r) for r in put.read(spark).collect()} == {("a", 3, 2), ("b", 2, 1)}


@pytest.mark.parametrize("kw", [{}, {"keep_old": True}, {"size": 25 * HOUR, "start_zero": True}])
def test_windows_are_made_after_the_last_shuffle(spark, kw):
    """What is shuffled and sorted grows with the rows, not with the windows that are made of them."""
    out = windows.windowed(table(spark, [("a", "1704000000", 1), ("b", "1704900000", 2)]), config(**kw))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate explode(CASE WHEN") < plan.index("Exchange") and out.count() > 6


def test_stream_rows_are_packed():
    """Rows of a key, tick, pane and sign are one row ahead of the shuffle; a null key and null values stay what they are."""
    import pyarrow as pa

    from tidewheel.streaming.processor import _packs

    cfg = config(group=GroupSchema.parse('{"field":["key_0"],"group":["count_2","sum_2","distinct_long_2","distinct_2"]}'))
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), HOUR * rng.randrange(3) + rng.randrange(HOUR), rng.choice([1, 1, -1]), rng.choice([None, 1, 2**60 + 1])) for _ in range(3000)]
    held = {"_k0": [r[0] for r in rows], "t": [r[1] for r in rows], "pane": [r[1] - r[1] % HOUR for r in rows], "clock": [r[1] for r in rows], "sign": pa.array([r[2] for r in rows], pa.int32())}
    held |= {"v0": [r[2] * (r[3] is not None) for r in rows], "v1": [float(r[2] * (r[3] or 0)) for r in rows], "v2": pa.array([r[3] for r in rows], pa.int64()), "v3": [None if r[3] is None else str(r[3]) for r in rows]}
    batch = pa.RecordBatch.from_pydict(held)
    got = [r for b in _packs(cfg, 1, False)(iter([batch.slice(0, 1000), batch.slice(1000)])) for r in b.to_pylist()]
    want = defaultdict(list)
    for k, t, s, v in rows:
        want[k, t - t % HOUR, s].append((t, v))
    assert len(got) == len(want) == 18
    for r in got:
        own = want[r["_k0"], r["pane"], r["sign"]]
        values = [v for _, v in own if v is not None]
        assert (r["tick"], r["low"], r["high"], r["late"]) == (r["pane"] + HOUR, min(t for t, _ in own), max(t for t, _ in own), False)
        assert (r["v0"], r["v1"]) == (r["sign"] * len(values), pytest.approx(r["sign"] * float(sum(values))))
        assert dict(zip(r["v2"], r["n2"], strict=True)) == {v: values.count(v) for v in set(values)}
        assert dict(zip(r["v3"], r["n3"], strict=True)) == {str(v): values.count(v) for v in set(values)}
