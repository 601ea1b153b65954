"""The sitemap policy as a stream: order, lateness, pauses and one very busy outlet (ST4, H13)."""

from __future__ import annotations

from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from coverline.operators import health
from coverline.streaming import jobs, policy

SCHEMA = "id long, ran_at timestamp, outlet_id long, method string, attempted boolean, ok boolean, status_code int, error string"
DAY = datetime(2024, 1, 1)


def check(i, hours, outlet=1, status=500, ok=False):
    return (i, DAY + timedelta(hours=hours), outlet, "sitemap", True, ok, status, None)


def streamed(spark, tmp_path, *files, late="2 hours"):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs"))
    return jobs.drained(spark, stream, lambda s: policy.policy_stream(s, late), "update", str(tmp_path / "state"))


def folded(rows):
    now = dict(health.NEW_POLICY)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        failure = None if r[5] or r[6] == 418 else f"http_{r[6]}"
        now = health.policy_step(now, SimpleNamespace(ran_at=pd.Timestamp(r[1]), id=r[0], ok=r[5], status_code=r[6], failure=failure, twin=False))
    return now


def test_checks_out_of_order_end_as_in_order(spark, tmp_path):
    rows = [check(1, 0, ok=True, status=200), check(2, 5), check(3, 4.5), check(4, 6, status=404), check(5, 5.5, ok=True, status=200), check(6, 7), check(7, 6.5, status=418), check(8, 30), check(9, 31)]
    out = jobs.last_of(streamed(spark, tmp_path, rows[:2], [rows[5], rows[3]], [rows[4], rows[2], rows[6]], rows[7:]), ["outlet_id"]).first()
    want = folded(rows)
    assert (out.status, out.consecutive_failures, out.updated_at, out.disabled_until) == (want["status"], want["consecutive_failures"], want["updated_at"], want["disabled_until"])


def test_checks_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    table = streamed(spark, tmp_path, [check(1, 0)], [check(2, 50)], [check(3, 60)], [check(4, 1, ok=True, status=200)])
    out = jobs.last_of(table, ["outlet_id"]).first()
    assert out.consecutive_failures == 3 and table.dropped == 1


def test_a_pause_ends_by_a_timer(spark, tmp_path):
    table = streamed(spark, tmp_path, [check(1, 0), check(2, 1)], [check(3, 2, outlet=2)], [check(4, 24 * 9, outlet=2)], [check(5, 24 * 9 + 3, outlet=2)])
    rows = [(r.batch, r.status, r.blocked) for r in table.where("outlet_id = 1").orderBy("batch").collect()]
    assert rows[0][1:] == ("disabled_temporary", True) and rows[-1][1:] == ("disabled_temporary", False) and len(rows) == 2


def test_an_elapsed_pause_begins_anew_with_an_unknown_failure(spark, tmp_path):
    rows = [check(1, 0), check(2, 1), check(3, 24 * 8, status=418), check(4, 24 * 9, status=418), check(5, 24 * 17, status=418)]
    rows += [check(11, 0, 2, 410), check(12, 24 * 29, 2, 418), check(13, 24 * 31, 2, 418)] + [check(21, 0, 3, 418), check(22, 24 * 9, 3, 418)]
    batch = {r.outlet_id: r for r in health.sitemap_policy(spark.createDataFrame(rows, SCHEMA).withColumn("ran_at", F.col("ran_at").cast("timestamp_ntz"))).collect()}
    assert (batch[1].status, batch[1].disabled_until) == ("disabled_temporary", DAY + timedelta(days=24))
    assert (batch[2].status, batch[2].disabled_until) == ("disabled_permanent", DAY + timedelta(days=61))
    assert (batch[3].status, batch[3].disabled_until, batch[3].consecutive_failures) == ("active", None, 2)
    stream = {r.outlet_id: r for r in jobs.last_of(streamed(spark, tmp_path, rows), ["outlet_id"]).drop("blocked").collect()}
    assert stream == batch


@pytest.mark.parametrize("n", [200_000])
def test_one_outlet_with_many_checks(spark, tmp_path, n):
    """No frame holds them all: they wait in the store by hour."""
    k = F.col("id")
    ok = F.pmod(F.xxhash64("id"), F.lit(50)) == 0
    rows = spark.range(n).select("id", (F.lit(DAY).cast("timestamp") + F.make_dt_interval(secs=F.pmod(k * 7919, F.lit(n)) * 13)).alias("ran_at"), F.lit(1).cast("long").alias("outlet_id"), F.lit("sitemap").alias("method"), F.lit(True).alias("attempted"), ok.alias("ok"), F.when(ok, 200).otherwise(F.when(k % 3 == 0, 418).otherwise(500)).cast("int").alias("status_code"), F.lit(None).cast("string").alias("error"))
    rows.write.parquet(str(tmp_path / "runs"))
    stored = spark.read.parquet(str(tmp_path / "runs"))
    want = health.sitemap_policy(stored.withColumn("ran_at", F.col("ran_at").cast("timestamp_ntz"))).collect()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "runs"))
    got = jobs.last_of(jobs.drained(spark, stream, lambda s: policy.policy_stream(s, "40 days"), "update", str(tmp_path / "state")), ["outlet_id"]).drop("blocked").collect()
    assert got == want


class _Store:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        def update(value):
            self.calls += 1
            self.kept[name] = value

        return SimpleNamespace(exists=lambda: name in self.kept, get=lambda: self.kept.get(name), update=update)

    def getMapState(self, name, key, value):  # noqa: N802
        rows = self.kept.setdefault(name, {})

        def call(f):
            def counted(*a):
                self.calls += 1
                return f(*a)

            return counted

        return SimpleNamespace(keys=lambda: list(rows), getValue=call(rows.get), updateValue=call(rows.__setitem__), removeKey=call(rows.pop))

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


def test_outlets_with_a_check_an_hour_share_entries(tmp_path):
    """200 outlets with a check in each of 30 hours: a call for each check and hour would be 6,000 and more."""
    store, job = _Store(), policy.Policy()
    job.init(store)
    rows = [(check(k * 100 + h, h + k / 1000, k, 500 if k % 2 else 418)) for k in range(200) for h in range(30)]
    frame = pd.DataFrame({"id": [r[0] for r in rows], "ran_at": [r[1] for r in rows], "ok": False, "status_code": [r[6] for r in rows], "failure": [f"http_{r[6]}" if r[6] != 418 else None for r in rows], "twin": False, "outlet": [str(r[2]) for r in rows]})
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    first = next(job.handleInputRows((0,), iter([frame]), clock(0)))
    assert len(first) == 200 and store.calls < 200
    # ten hours are over: they leave the store, the rest of their entries waits
    over = int(pd.Timestamp(DAY).value // 1_000_000) + 10 * policy.HOUR_MS
    assert not list(job.handleExpiredTimer((0,), clock(over), None))
    waiting = [c for (text,) in store.kept["waiting"].values() for c in policy.json.loads(text)]
    assert len(waiting) == 200 * 20 and store.calls < 400
    again = next(job.handleInputRows((0,), iter([frame[:0], frame[-1:].assign(id=10**6)]), clock(over)))
    want = folded([r for r in rows if r[2] == 199] + [(10**6, *rows[-1][1:])])
    assert (again["outlet_id"][0], again["consecutive_failures"][0], again["disabled_until"][0]) == (199, 31, want["disabled_until"])
