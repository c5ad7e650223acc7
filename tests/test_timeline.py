"""Running values in ranges of time, as-of and binned joins, settings and canonical JSON against slow versions."""

import datetime as dt
import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import canonical
from shelfwatch.operators import settings, store, timeline


def test_running_values_equal_a_slow_pass(spark):
    """One hot key, null keys and values, ties of one instant; the number of ranges changes nothing."""
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot"] * 8 + ["b", None]), rnd.randint(0, 50), k, rnd.choice([None, k, -k]), rnd.choice([None, 1, 5])) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, at int, id int, v int, n int")
    want, last, total = {}, {}, {}
    for key, _, i, v, n in sorted(rows, key=lambda r: (r[1], r[2])):
        before = last.get(key)
        last[key] = v if v is not None else before
        total[key] = total.get(key, 0) + (n or 0)
        want[i] = (last[key], before, total[key])
    for ranges in (1, 2, 32):
        got = timeline.running(df, ["key"], "at", ["id"], last={"a": "v"}, before={"b": "v"}, sums={"c": "n"}, ranges=ranges)
        assert {r.id: (r.a, r.b, r.c) for r in got.collect()} == want
    assert timeline.running(df.limit(0), ["key"], "at", ["id"], last={"a": "v"}).count() == 0


def test_a_hot_key_is_spread(spark):
    """No task of the windows holds more than a few ranges' share of one key's rows."""
    df = spark.range(20000).select(F.lit("hot").alias("key"), F.col("id").alias("at"), F.col("id").alias("v"))
    placed = df.withColumn("r", timeline.range_of(df, "at", 32)).groupBy("r").count().collect()
    assert len(placed) == 32 and max(r["count"] for r in placed) < 2 * 20000 / 32
    got = timeline.running(df, ["key"], "at", last={"a": "v"}, sums={"s": "v"})
    assert got.where("a = v and s = v * (v + 1) / 2").count() == 20000


def test_as_of_on_one_key(spark):
    rnd = random.Random(2)
    versions = [("k", rnd.randint(0, 999), f"v{n}") for n in range(60)] + [("other", 5, "x")]
    rows = [(rnd.choice(["k", "k", "k", "none"]), rnd.randint(0, 999), n) for n in range(300)]
    v = spark.createDataFrame(versions, "key string, valid_from int, name string")
    got = timeline.as_of(spark.createDataFrame(rows, "key string, at int, id int"), v, "key", "at", "valid_from", ["name"])
    slow = {n: max(((t, name) for k, t, name in versions if k == key and t <= at), default=(0, None))[1] for key, at, n in rows}
    assert {r.id: r.name for r in got.collect()} == slow


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_windows_of_seconds_to_years(spark, kind):
    rnd = random.Random(9)
    start = dt.datetime(2020, 1, 1)
    lengths = [1, 2, 59, 3600, 86400, 40 * 86400, 3 * 365 * 86400]
    windows = [(rnd.choice(["hot", "hot", "b"]), n, start + dt.timedelta(seconds=rnd.randint(0, 10**7)), rnd.choice(lengths)) for n in range(120)]
    windows = [(k, n, a, a + dt.timedelta(seconds=s) if n % 10 else a, None if n % 7 else a) for n, (k, _, a, s) in enumerate(windows)]
    events = [(rnd.choice(["hot", "hot", "b", None]), n, rnd.choice([a for _, _, a, _, _ in windows]) + dt.timedelta(seconds=rnd.choice([0, 0, 1, 58, 500, 10**6]))) for n in range(300)]
    cut = (lambda t: t.date()) if kind == "date" else (lambda t: t)
    w = spark.createDataFrame(windows, "key string, window_id int, starts_at timestamp, ends_at timestamp, cancelled_at timestamp").select("key", "window_id", F.col("starts_at").cast(kind), F.col("ends_at").cast(kind), "cancelled_at")
    e = spark.createDataFrame(events, "key string, id int, at timestamp").withColumn("at", F.col("at").cast(kind))
    found = store.active_window(e, w, "at", ["key"], ["id"])
    slow = {n: max(((cut(a), i) for k2, i, a, b, c in windows if k2 == k and c is None and cut(a) <= cut(t) < cut(b)), default=(None, None))[1] for k, n, t in events}
    assert {r.id: r.window_id for r in found.collect()} == slow and sum(x is not None for x in slow.values()) > 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan and "w_bin" in plan


def test_windows_that_all_hold_the_same_events(spark):
    """One key, each window inside the one before it: 30,000 of them times 60,000 events are 900 million pairs; an event meets one."""
    n = 30000
    i = F.col("id")
    w = spark.range(0, n, 1, 4).select(F.lit("hot").alias("key"), i.alias("window_id"), i.alias("starts_at"), (2 * n - i).alias("ends_at"), F.lit(None).cast("timestamp").alias("cancelled_at"))
    e = spark.range(0, 2 * n, 1, 4).select("id", F.lit("hot").alias("key"), i.alias("at"), F.lit(3).alias("more"))
    began = time.time()
    found = store.active_window(e, w, "at", ["key"], ["id"])
    assert found.columns == ["id", "key", "at", "more", "window_id"]
    assert found.where(F.col("window_id").eqNullSafe(F.when(i < n, i).otherwise(2 * n - i - 1)) & (F.col("at") == i) & (F.col("more") == 3)).count() == 2 * n
    assert time.time() - began < 15


@pytest.mark.parametrize("ranges", [1, 2, 32])
def test_latest_window_over_ranges(spark, ranges):
    """Null keys and times, ties, empty and backward windows, keys of two columns, wider types of the ends; long windows cover whole ranges."""
    rnd = random.Random(ranges)
    key = lambda: (rnd.choice(["hot", "hot", "b", None]), rnd.choice([1, 1, None]))
    windows = [(*key(), rnd.choice([None, k]) if k % 50 == 0 else k, (a := rnd.randint(0, 300)), rnd.choice([None, a + 0.0, a - 5.0, a + 0.5, a + 1.0, a + 7.0, a + 90.0, a + 250.0])) for k in range(400)]
    points = [(*key(), k, rnd.choice([None, rnd.randint(-5, 600), rnd.randint(0, 300)])) for k in range(500)]
    w = spark.createDataFrame(windows, "a string, b int, w int, s int, e double")
    got = timeline.latest_window(spark.createDataFrame(points, "a string, b int, id int, t long"), w, ["a", "b"], "t", "s", "e", "w", ranges)
    holds = lambda p, v: None not in (p[0], p[1], p[3], v[4]) and p[:2] == v[:2] and v[3] <= p[3] < v[4]
    slow = {p[2]: max(((v[3], v[2] is not None, v[2]) for v in windows if holds(p, v)), default=(0, False, None))[2] for p in points}
    assert {r.id: r.window_id for r in got.collect()} == slow and sum(x is not None for x in slow.values()) > 100


def test_versions_and_freezing(spark):
    fields = {"enabled": "boolean", "level": "int", "muted": "array<string>"}
    updates = [("s", 1, 1, '{"enabled": true, "level": 1, "muted": ["b", "a"]}'), ("s", 5, 2, '{"muted": ["a", "b"]}'), ("s", 5, 3, '{"level": 2}'), ("s", 9, 4, "{}"), ("s", 9, 5, '{"level": 1, "unknown": 3}'), ("t", 2, 1, '{"level": 7}')]
    history = settings.versions(spark.createDataFrame(updates, "store string, at int, n int, patch string"), ["store"], "at", ["n"], fields, "preferences", ["muted"], ranges=3)
    got = {(r.store, r.n): (r.version, r.state, r.settings.level, r.settings.muted) for r in history.collect()}
    assert got == {("s", 1): (1, 1, 1, ["b", "a"]), ("s", 2): (2, 1, 1, ["a", "b"]), ("s", 3): (3, 2, 2, ["a", "b"]), ("s", 4): (4, 2, 2, ["a", "b"]), ("s", 5): (5, 3, 1, ["a", "b"]), ("t", 1): (1, 1, 7, None)}
    first = history.where("store = 's' and n = 1").first().hash
    assert first == hashlib.sha256(b'{"preferences":{"enabled":true,"level":1,"muted":["a","b"]},"version":"alert_preferences_v1"}').hexdigest()

    asked = spark.createDataFrame([("s", "x", 4), ("s", "x", 8), ("s", "y", 6), ("s", "y", 6), ("t", "z", 1), ("s", "w", 9)], "store string, snapshot string, at int")
    values = ["version", "hash"]
    frozen = settings.frozen(asked, history, "store", "snapshot", "at", "at", values)
    assert {r.snapshot: (r.frozen_at, r.version) for r in frozen.collect()} == {"x": (4, 1), "y": (6, 3), "z": (1, None), "w": (9, 5)}
    # a rerun with an earlier evaluation and an edit that comes late changes what is new only
    later = history.unionByName(history.where("store = 's' and n = 5").withColumn("version", F.lit(99).cast("bigint")).withColumn("at", F.lit(3)))
    again = settings.frozen(asked.unionByName(spark.createDataFrame([("s", "x", 0), ("s", "new", 4)], asked.schema)), later, "store", "snapshot", "at", "at", values, held=frozen)
    assert {r.snapshot: r.version for r in again.collect()} == {"x": 1, "y": 3, "z": None, "w": 5, "new": 99}


@pytest.mark.parametrize("ranges", [1, 3, 32])
def test_versions_equal_a_slow_pass_and_read_updates_once(spark, ranges):
    """Random updates of a hot key, of null keys and of none; each text is made once, not once a step and range."""
    rnd = random.Random(7)
    patches = ["{}", None, "{broken", '{"level": 1}', '{"level": 2, "muted": []}', '{"muted": ["b", "a"]}', '{"muted": ["a", "b"]}', '{"level": null, "enabled": false}', '{"enabled": true}']
    rows = [(rnd.choice(["hot"] * 8 + ["b", None]), rnd.choice([1, 1, None]), rnd.randint(0, 60), n, rnd.randrange(len(patches))) for n in range(600)]
    read = spark.sparkContext.accumulator(0)

    def text(k):
        read.add(1)
        return patches[k]

    updates = spark.createDataFrame(rows, "store string, part int, at int, n int, k int").select("store", "part", "at", "n", F.udf(text, "string")("k").alias("patch"))
    fields = {"enabled": "boolean", "level": "int", "muted": "array<string>"}
    got = {r.n: (r.version, r.state, r.settings.asDict(), r.hash) for r in settings.versions(updates, ["store", "part"], "at", ["n"], fields, "preferences", ["muted"], ranges).collect()}
    assert read.value == len(rows) == len(got)
    held = {}
    for store_, part, _, n, k in sorted(rows, key=lambda r: (r[2], r[3])):
        now, version, state, old = held.get((store_, part), ({f: None for f in fields}, 0, 0, None))
        patch = json.loads(patches[k]) if patches[k] not in (None, "{broken") else {}
        now = now | {f: v for f, v in patch.items() if v is not None}
        told = {f: sorted(v) if f == "muted" else v for f, v in now.items() if v is not None}
        code = hashlib.sha256(json.dumps({"preferences": told, "version": "alert_preferences_v1"}, separators=(",", ":")).encode()).hexdigest()
        held[store_, part] = now, version + 1, state + (code != old), code
        assert got[n] == (version + 1, state + (code != old), now, code)


def canonical_slow(v):
    if isinstance(v, dict):
        whole = sorted((k for k in v if k.isdigit()), key=int)
        rest = sorted((k for k in v if not k.isdigit()), key=lambda k: (k.lower(), k.swapcase()))
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical_slow(v[k]) for k in whole + rest) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical_slow, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def random_value(rnd, depth):
    kind = rnd.randint(0, 9) if depth else rnd.randint(4, 9)
    if kind < 2:
        return [random_value(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]
    if kind < 4:
        return {rnd.choice(["a", "B", "b", "Ab", "ab", "zz", "10", "9", "0"]) + rnd.choice(["", "", "x"]): random_value(rnd, depth - 1) for _ in range(rnd.randint(0, 5))}
    return rnd.choice([None, True, False, 3, -17, 0.5, "", 'say "x"\\ \n\t\x01', "ä€🙂", "{[,:]}", 12.25])


def test_canonical_json(spark):
    rnd = random.Random(3)
    values = [random_value(rnd, 6) for _ in range(120)]
    rows = []
    for k, v in enumerate(values):
        rows += [(k, json.dumps(v)), (k, json.dumps(v, ensure_ascii=False, indent=2)), (k, json.dumps(v, separators=(",", ":")).replace("0.5", "5e-1").replace("12.25", "1.225E1"))]
    df = spark.createDataFrame(rows, "k int, j string").repartition(4)
    for r in df.select("k", canonical.canonical_json(F.col("j")).alias("c"), canonical.canonical_hash(F.col("j")).alias("h")).collect():
        want = canonical_slow(values[r.k])
        assert r.c == want and r.h == hashlib.sha256(want.encode()).hexdigest()


def test_canonical_json_of_depth_and_of_what_is_none(spark):
    deep = '{"b":[' * 400 + "1" + '],"a":2}' * 400
    texts = [deep, None, "", "{", "[1", "1 2", '{"a":}', '{"a" 1]', "tru", "01", '{"a":1,"a":2}', "[1E3, -0, 1e400, 1e21, 1.50, 0.000001, 1e-7]"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(texts)), "k int, j string").select("k", canonical.canonical_json(F.col("j")).alias("c")).orderBy("k").collect()]
    assert got[0] == '{"a":2,"b":[' * 400 + "1" + "]}" * 400
    assert got[1:] == [None] * 9 + ['{"a":2}', "[1000,0,null,1e+21,1.5,0.000001,1e-7]"]


def test_plain_json_says_what_the_fold_says(spark):
    """Keys of all signs in the root collation's order, numbers near the bounds, equal keys, halves of characters; Python refuses what it can't say."""
    rnd = random.Random(9)
    signs = "".join(map(chr, range(32, 127)))
    key = lambda: "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 3))) if rnd.random() < 0.8 else rnd.choice(["7", "07", "4294967294", "4294967295", "\u00e4", "a\u0001"])
    texts = ["{" + ",".join(f"{json.dumps(key())}:{k}" for k in range(rnd.randint(0, 12))) + "}" for _ in range(300)]
    texts += ['{"b":1,"a":2,"b":{"token":1,"x":[]}}', '{"a":"\\ud800"}', '{"a":"\\ud83d\\ude42 \\/"}', '{"a":NaN}', '{"a":1,}', '{"a":[1e14,1e15,1e20,1e22,-0.0,-0,0.001,0.00099,1.10,999999999999999,9007199254740993,1E-3,123456.789,1e400]}', " [ ] ", '"x"', "\x0b1"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, j string").repartition(4)
    for ordered, hidden in ((True, None), (False, "(?i)token")):
        plain, fold = canonical._plain(ordered, hidden)(F.col("j")), canonical._folded(F.col("j"), ordered, hidden)
        rows = df.select("k", plain.alias("p"), fold.alias("f")).collect()
        assert [(r.k, r.p, r.f) for r in rows if r.p is not None and r.p != r.f] == []
        assert sum(r.p is not None for r in rows) > 100 and all(r.p is None for r in rows if texts[r.k] in ('{"a":NaN}', '{"a":"\\ud800"}'))


def test_canonical_json_in_time(spark):
    """The fold alone took some 250 microseconds a text of this size on a core; the bound is wide."""
    text = F.concat(F.lit('{"lines":['), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.concat(F.lit('{"quantity":'), (k + F.col("id")).cast("string"), F.lit(',"part":"p"}'))), ","), F.lit('],"Meta":{"2":1.50}}'))
    rows = spark.range(0, 20000, 1, 4).select(canonical.canonical_hash(text).alias("h"))
    began = time.time()
    assert rows.agg(F.count_distinct("h")).first()[0] == 20000
    assert time.time() - began < 20
