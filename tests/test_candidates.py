"""Candidates with a deadline: batch form, stream and slow fold agree; the ladder of a confirmation; deadlines."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import columns as C
from shelfwatch.operators import candidates as K

T0 = dt.datetime(2026, 3, 1)
COLUMNS = [c.split()[0] for c in K.LOG.split(", ")]


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def drop(store, minutes, snapshot, observed=70.0, median=100.0, baseline="b1", abs_=20.0, config="c"):
    return (store, config, at(minutes), "drop", snapshot, observed, baseline, 3, median, 0.2, abs_, 7, "h", None, None, None, None)


def confirm(store, minutes, snapshot, observed=60.0, active="b1", active_config="c", own_config="c", status="success", config="c"):
    return (store, config, at(minutes), "confirm", snapshot, observed, None, None, None, None, None, None, None, active, active_config, own_config, status)


def short(df):
    return sorted((r.store_id, r.opened_at, r.drops, r.first_snapshot_id, r.observed_value, r.expires_at, r.status, r.status_reason, r.confirmation_snapshot_id, r.ended_at) for r in df.collect())


def test_deadline_refresh_and_late_confirmation(spark):
    log = [drop("in_time", 0, "s1"), confirm("in_time", 29, "s2"), drop("on_time", 0, "s1"), confirm("on_time", 30, "s2"), drop("late", 0, "s1"), confirm("late", 31, "s2"),
           drop("put_off", 0, "s1"), drop("put_off", 25, "s2", 60.0), confirm("put_off", 50, "s3"), drop("anew", 0, "s1"), drop("anew", 30, "s2"), confirm("anew", 40, "s3"), confirm("anew", 41, "s4"),
           drop("again", 0, "s1"), confirm("again", 5, "s2", 95.0), drop("again", 6, "s3"), confirm("none", 1, "s1")]
    found = K.candidates(spark.createDataFrame(log, K.LOG), ranges=3)
    got = {(r[0], r[1]): r[2:] for r in short(found)}
    late = "confirmation_window_expired"
    assert got == {
        ("in_time", at(0)): (1, "s1", 60.0, at(30), "confirmed", "confirmation_matched_drop", "s2", at(29)), ("on_time", at(0)): (1, "s1", 70.0, at(30), "expired", late, None, at(30)),
        ("late", at(0)): (1, "s1", 70.0, at(30), "expired", late, None, at(30)), ("put_off", at(0)): (2, "s2", 60.0, at(55), "confirmed", "confirmation_matched_drop", "s3", at(50)),
        ("anew", at(0)): (1, "s1", 70.0, at(30), "expired", late, None, at(30)), ("anew", at(30)): (1, "s2", 60.0, at(60), "confirmed", "confirmation_matched_drop", "s3", at(40)),
        ("again", at(0)): (1, "s1", 95.0, at(30), "dismissed", "confirmation_recovered", "s2", at(5)), ("again", at(6)): (1, "s3", 70.0, at(36), "expired", late, None, at(36))}
    pending = K.candidates(spark.createDataFrame([drop("a", 0, "s1")], K.LOG), now=F.lit(at(29)))
    assert [(r.status, r.status_reason, r.ended_at) for r in pending.collect()] == [("pending_confirmation", None, None)]
    assert [r.status for r in K.candidates(spark.createDataFrame([drop("a", 0, "s1")], K.LOG), now=F.lit(at(30))).collect()] == ["expired"]


def test_rows_of_candidates_and_incidents(spark):
    log = [drop("s", 0, "s1", 79.0, 1000.5), drop("s", 3, "s2", 800.0, 900.0), confirm("s", 9, "s3", 640.0)]
    found = K.candidates(spark.createDataFrame(log, K.LOG))
    (r,) = found.collect()
    assert (r.fingerprint, r.before_value, r.observed_value, r.change_abs, round(r.change_pct, 6), r.due_at) == ("s:catalog_drop:feed.product_count:c", 1000.5, 640.0, 360.5, 0.36032, at(13))
    assert r.evidence == ["feed product count dropped 20.0%", "baseline version 3", "baseline median 1000.5"] and tuple(r.thresholds) == (0.2, 20.0, 7, "h")
    (i,) = K.incidents(found).collect()
    assert (i.summary, i.affected_count, i.opened_snapshot_id, i.severity, i.status) == ("Feed product count dropped from 1000.5 to 640.", 360.5, "s3", "critical", "open")


def test_first_reason_that_applies_ends_a_candidate(spark):
    cases = {"confirmation_matched_drop": {}, "baseline_stale_or_replaced": {"active": "b2", "own_config": "d", "status": "timeout"}, "baseline_configuration_changed": {"active_config": "d", "own_config": "d"},
             "confirmation_configuration_changed": {"own_config": None, "status": "timeout"}, "confirmation_source_check_failed": {"status": "partial", "observed": 99.0}, "confirmation_recovered": {"observed": 81.0}}
    log = [x for name, more in cases.items() for x in (drop(name, 0, "s1"), confirm(name, 5, "s2", **more))] + [drop("none", 0, "s1"), confirm("none", 5, "s2", active=None), drop("count", 0, "s1"), confirm("count", 5, "s2", observed=None)]
    got = {r.store_id: (r.status_reason, r.status) for r in K.candidates(spark.createDataFrame(log, K.LOG)).collect()}
    want = {name: (name, K.REASONS[name]) for name in cases} | {"none": ("baseline_stale_or_replaced", "expired"), "count": ("confirmation_source_check_failed", "source_failure")}
    assert got == want


def random_log(seed, n=240):
    rnd = random.Random(seed)
    out, minute = [], 0
    for k in range(n):
        minute += rnd.choice([0, 1, 5, 9, 10, 15, 20, 30])
        store = rnd.choice("aaab")
        if rnd.random() < 0.6:
            out.append(drop(store, minute, f"s{k:03}", float(rnd.randint(40, 80)), rnd.choice([100.0, 130.0]), config=rnd.choice("cd")))
        else:
            out.append(confirm(store, minute, f"s{k:03}", rnd.choice([50.0, 99.0, None]), rnd.choice(["b1", "b1", "b2"]), status=rnd.choice(["success", "success", "timeout"]), config=rnd.choice("cd")))
    return out


def slow(log):
    """The machine row by row."""
    held, out = {}, []

    def end(key, reason, snapshot, value, when):
        c = held.pop(key)
        observed = value if reason in ("confirmation_recovered", "confirmation_matched_drop") else c["observed"]
        out.append((key[0], c["opened"], c["n"], c["snapshot"], observed, c["expires"], K.REASONS[reason], reason, snapshot, when))

    for row in sorted(log, key=lambda r: (r[2], r[3] == "confirm", r[4])):
        r = dict(zip(COLUMNS, row, strict=True))
        key, now = (r["store_id"], r["config"]), r["at"]
        if key in held and held[key]["expires"] <= now:
            end(key, "confirmation_window_expired", None, None, held[key]["expires"])
        if r["kind"] == "drop":
            c = held.setdefault(key, {"opened": now, "n": 0, "baseline": r["baseline_id"], "median": r["baseline_median"]})
            c |= {"n": c["n"] + 1, "snapshot": r["snapshot_id"], "observed": r["observed"], "expires": now + dt.timedelta(minutes=30)}
        elif key in held:
            c = held[key]
            if r["active_baseline_id"] != c["baseline"]:
                reason = "baseline_stale_or_replaced"
            elif r["active_config"] != key[1]:
                reason = "baseline_configuration_changed"
            elif r["snapshot_config"] != key[1]:
                reason = "confirmation_configuration_changed"
            elif r["source_status"] != "success" or r["observed"] is None:
                reason = "confirmation_source_check_failed"
            else:
                fell = r["observed"] <= c["median"] * 0.8 and c["median"] - r["observed"] >= 20
                reason = "confirmation_matched_drop" if fell else "confirmation_recovered"
            end(key, reason, r["snapshot_id"], r["observed"], now)
    for key in list(held):
        end(key, "confirmation_window_expired", None, None, held[key]["expires"])
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_slow_fold(spark, seed):
    log = random_log(seed)
    want = slow(log)
    assert len(want) > 30 and len({r[7] for r in want}) >= 4
    for ranges in (1, 7):
        assert short(K.candidates(spark.createDataFrame(log, K.LOG), ranges=ranges)) == want


def test_stream_equals_batch(spark, tmp_path):
    from shelfwatch.streaming.candidates import candidate_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = sorted(random_log(3, 120), key=lambda r: r[2])
    end = log[-1][2] + dt.timedelta(days=1)
    batches = [log[k: k + 40] for k in range(0, 120, 40)] + [[("z", "z", end, "confirm", "z", *[None] * 12)]]
    for rows in batches:  # the last one lets time pass: deadlines come without rows of their keys
        spark.createDataFrame(rows, K.LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(K.LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (candidate_stream(stream).writeStream.outputMode("append").format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    assert q.awaitTermination(180)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert short(spark.table("ended")) == slow(log)
    assert sorted(map(str, spark.table("ended").drop("seen_at").collect())) == sorted(map(str, K.candidates(spark.createDataFrame(log, K.LOG)).collect()))


def test_fixed_decimals(spark):
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 1.05, 2.5, 20.65, 21.049999999999997, 99.95, 99.949999, 1000.25, 8.345, 1.005]
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v double").select(C.fixed(F.col("v"), 1), C.fixed(F.col("v"), 2)).collect()]
    assert got == [tuple(str(Decimal(v).quantize(Decimal(q), ROUND_HALF_UP)) for q in ("0.1", "0.01")) for v in values]
