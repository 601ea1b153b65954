"""Streams that end in exact tables: repeats, crashes and late rows change nothing (ST3, ST6)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coverline.plans import settled as plans
from coverline.plans.views import feeds
from coverline.streaming import exact
from coverline.streaming.store import ARTICLE, Store, settle, settled


def _rows(store):
    return sorted(map(repr, store.read().collect()))


@pytest.fixture(scope="module")
def items(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("items") / "items")
    schema = plans.write_items(spark, small, path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def wanted(spark, items, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plain"))
    store = Store(spark, f"{folder}/store", ARTICLE, slots=4)
    settled(items, store, plans.preferred, f"{folder}/state")
    return _rows(store)


@pytest.mark.parametrize("dies", ["before", "between", "after"])
def test_a_killed_run_goes_on_to_the_same_store(spark, items, wanted, tmp_path, monkeypatch, dies):
    """The second batch dies before its merge, with its rows written but not noted, or after it, and comes again."""
    store = Store(spark, str(tmp_path / "store"), ARTICLE, slots=4)
    step = settle(store, plans.preferred)

    def dying(rows, batch):
        if batch == 1 and dies == "before":
            raise RuntimeError("killed")
        if batch == 1 and dies == "between":
            with monkeypatch.context() as patch:
                patch.setattr(spark, "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("killed")) if "replaced" in str(a) else type(spark).createDataFrame(spark, *a, **b))
                step(rows, batch)
        step(rows, batch)
        if batch == 1:
            raise RuntimeError("killed")

    stream = items.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    with pytest.raises(Exception, match="killed"):
        stream.foreachBatch(dying).start().awaitTermination()
    settled(items, store, plans.preferred, str(tmp_path / "state"))
    assert _rows(store) == wanted
    settled(items, store, plans.preferred, str(tmp_path / "state"))  # nothing new
    assert _rows(store) == wanted


def test_a_batch_rewrites_only_the_slots_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "external_id string, n int", slots=8)
    merged = lambda old, new: old.unionByName(new).groupBy("external_id").agg(F.sum("n").cast("int").alias("n"))
    rows = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "external_id string, n int")
    store.merge(rows(*"abcdefgh"), 0, merged)
    before = store.versions()
    store.merge(rows("a"), 1, merged)
    store.merge(rows("a"), 1, merged)  # again
    after = store.versions()
    assert [s for s in after if after[s][0] != before[s][0]] == [s for s, v in after.items() if v == (1, 0)] and sum(v[0] == 1 for v in after.values()) == 1
    assert {r.external_id: r.n for r in store.read().collect()} == {**dict.fromkeys("bcdefgh", 1), "a": 2}
    store.merge(rows(), 2, merged)
    store.merge(rows("a", "z"), 3, merged)
    assert {r.external_id: r.n for r in store.read().collect()} == {**dict.fromkeys("bcdefgh", 1), "a": 3, "z": 1}
    kept = {(b.name, s.name) for b in (tmp_path / "store" / "rows").iterdir() for s in b.iterdir() if s.is_dir()}
    current = {(f"batch={v}", f"slot={s}") for s, (v, _) in store.versions().items()} | {(f"batch={p}", f"slot={s}") for s, (_, p) in store.versions().items() if p is not None}
    assert kept == current and len(list((tmp_path / "store" / "commits").glob("batch=*"))) == 2


def test_snapshots_count_rows_behind_and_repeat_to_the_same_end(spark, small):
    to = plans.exact_run(spark, small)
    notes = to.notes().orderBy("batch").collect()
    assert [(n.batch, n.behind) for n in notes] == [(0, 0), (1, 0), (2, notes[2].n)] and notes[2].n > 0  # the last file comes days late
    before = sorted(map(repr, to.benchmarks().collect()))
    kept = spark.read.parquet(f"{to.folder}/articles/batch=2")
    last = spark.createDataFrame(kept.collect(), kept.schema)
    to.take(last, 2)
    assert sorted(map(repr, to.benchmarks().collect())) == before
    assert [n.asDict() for n in to.notes().orderBy("batch").collect()] == [n.asDict() for n in notes]


def test_snapshots_of_nothing(spark, small, tmp_path):
    to = exact.Snapshots(spark, str(tmp_path / "none"), feeds(spark, small))
    to.take(spark.createDataFrame([], "external_id string, source string, source_country string, country string, title_original string, title_quality string, url string, publication_datetime timestamp_ntz, created_at timestamp_ntz"), 0)
    assert to.notes().collect()[0].n == 0


def test_no_load_is_written_by_one_task(spark, small, monkeypatch):
    """What feeds the streams is written by as many tasks as hold it, and a slot by several."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []
    plain = DataFrame.coalesce
    monkeypatch.setattr(DataFrame, "coalesce", lambda df, n: (seen.append(df.columns), plain(df, n))[1])
    plans.st3_settled(spark, small)
    plans.exact_run(spark, small)
    assert [c for c in seen if "external_id" in c] == []


def test_hours_are_shuffled_before_they_are_spread(spark):
    """What is shuffled by source are counts of hours, not a row for each article and bucket."""
    from coverline.operators.benchmark import benchmark_hours

    rows = spark.range(20_000).selectExpr("'s' AS source", "'C' AS source_country", "'t' AS title_original", "'u' AS url", "'ok' AS title_quality", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 50 as int)) AS created_at", "timestamp_ntz'2023-12-31 20:10:00' AS publication_datetime")
    registry = spark.createDataFrame([("C", "1", "s")], "country string, code string, source string")
    found = benchmark_hours(rows, registry)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("RepartitionByExpression") and "Aggregate" in plan[plan.index("RepartitionByExpression") :]
    assert [(r.inserted_1h, r.inserted, r.published, r.fresh, r.late) for r in found.orderBy("bucket").collect()] == [(0, 0, 20_000, 0, 0)] * 3 + [(0, 0, 20_000, 0, 0)] + [(20_000, 20_000, 20_000, 20_000, 0)] + [(0, 20_000, 20_000, 20_000, 0)] * 19 + [(0, 20_000, 0, 0, 20_000)] * 4


def test_no_article_is_spread_over_its_buckets(spark):
    """Buckets are running sums of what comes and goes, also for missing times and for articles published after they were stored."""
    import random
    from datetime import datetime, timedelta

    from coverline.operators.benchmark import benchmark_hours

    draw, start, hour = random.Random(5), datetime(2024, 1, 1), timedelta(hours=1)
    moment = lambda spread: None if draw.random() < 0.1 else start + timedelta(minutes=draw.randrange(spread * 60))
    rows = [(draw.choice("abc"), draw.choice(["C", None]), f"a long enough title of {k}", f"https://a.com/{k}", "ok", moment(90), moment(90)) for k in range(120)]
    registry = spark.createDataFrame([("C", "1", "a"), ("D", "2", "b")], "country string, code string, source string")
    found = benchmark_hours(spark.createDataFrame(rows, "source string, source_country string, title_original string, url string, title_quality string, created_at timestamp_ntz, publication_datetime timestamp_ntz"), registry)
    wanted = {}
    for source, country, *_, created, told in rows:
        country = country or {"a": "C", "b": "D"}.get(source, "(unknown)")
        pub = min(t for t in (created, told, datetime.max) if t)
        for k in range(1, 140):
            b = start + k * hour
            day = lambda t: t is not None and b - 24 * hour <= t < b  # noqa: E731, B023
            if not day(created) and not day(told):
                continue
            one = wanted.setdefault((b, country), [0] * 5)
            for n, met in enumerate((day(created) and created >= b - hour, day(created), day(pub), day(created) and day(pub), day(created) and pub < b - 24 * hour)):
                one[n] += met
    assert {(r.bucket, r.country): [r.inserted_1h, r.inserted, r.published, r.fresh, r.late] for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("sequence(") < plan.rindex("Window [")


def test_a_batch_is_copied_once(spark, tmp_path, monkeypatch):
    """Of a batch only the preferred copies are kept, and a merged row goes from its merge into its slot."""
    from pyspark.sql.classic.dataframe import DataFrame

    from coverline.streaming import store as stores

    kept, spread = [], []
    plain, repartition = stores.keep, DataFrame.repartition
    monkeypatch.setattr(stores, "keep", lambda df, name: (kept.append(df.count()), plain(df, name))[1])
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *by: (spread.append(df.columns), repartition(df, *by))[1])
    columns = "external_id string, stable_id string, primary_section string, primary_topic string, source_country string, source string, country string, url string, title_original string, title_quality string, publication_datetime timestamp_ntz, feed_categories array<string>, arrived_at timestamp_ntz"
    rows = spark.sql("SELECT concat('e', id % 40) AS external_id, timestamp_ntz'2024-01-01' AS arrived_at FROM range(100)")
    rows = rows.selectExpr(*(f"CAST({n if n in rows.columns else 'NULL'} AS {t}) AS {n}" for n, t in (c.split(" ") for c in columns.split(", "))))
    to = Store(spark, str(tmp_path / "store"), ARTICLE, slots=4)
    for batch in (0, 1):
        settle(to, lambda items: items.dropDuplicates(["external_id"]))(rows, batch)
    assert kept == [40, 40] and spread == []
    assert to.read().count() == to.read().select("external_id").distinct().count() == 40
