"""Quotas, deduplication and the streaming feed."""

import datetime as d
import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import ingest as ig
from revlens.operators.ranking import SALTS, first_per_key, top_n_per_key
from revlens.session import scratch_path
from revlens.streaming import ingest as si

SCHEMA = "review_id string, app_label string, lang string, full_date timestamp, date date, score int"


def feed(spark, n=600, seed=1, hot=0.4):
    """Reviews of eight months; one app holds a large share of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        app = "hot" if rng.random() < hot else f"app{rng.randrange(4)}"
        at = d.datetime(2025, 9, 1) + d.timedelta(minutes=rng.randrange(60 * 24 * 240))
        rows.append((f"r{i}", app, rng.choice(["en", "fa"]), at, at.date(), rng.randrange(1, 6)))
    return spark.createDataFrame(rows, SCHEMA)


SPINE = ig.spine_keys("2026-04", 6)


def expected_quota(df, target):
    """Brute force over collected rows."""
    groups = {}
    for r in sorted(df.collect(), key=lambda r: (-r.full_date.timestamp(), r.review_id)):
        month = r.date.isoformat()[:7]
        if month in SPINE:
            groups.setdefault((r.app_label, r.lang, month), []).append(r.review_id)
    return {i for ids in groups.values() for i in ids[:target]}


def ids(df):
    out = [r.review_id for r in df.select("review_id").collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_spine():
    assert ig.spine_keys("2026-04", 6) == ["2026-04", "2026-03", "2026-02", "2026-01", "2025-12", "2025-11"]
    assert ig.spine_keys("2026-01", 2) == ["2026-01", "2025-12"]


def test_spine_as_table(spark):
    out = ig.month_spine(spark.createDataFrame([("2026-04-17",)], "start string"), months=6)
    assert [r.month for r in out.orderBy("position").collect()] == SPINE


def test_quota_against_brute_force(spark):
    df = feed(spark)
    assert ids(ig.quota_admit(df, SPINE, 7)) == expected_quota(df, 7)


def test_large_quota_takes_the_salted_way(spark):
    df = feed(spark, 800).repartition(5, "review_id")
    normal = ids(top_n_per_key(df, ["app_label"], ig.newest_first(), 40))
    for salts in (SALTS, (3, 2)):
        salted = top_n_per_key(df, ["app_label"], ig.newest_first(), 40, salts)
        assert "_salt" in salted._jdf.queryExecution().toString()
        assert ids(salted) == normal


def test_small_quota_is_cut_before_the_shuffle(spark):
    plan = ig.quota_admit(feed(spark), SPINE, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize("batches", [2, 5])
def test_resuming_in_batches_equals_one_batch(spark, batches):
    df = feed(spark, 400)
    rows = sorted(df.collect(), key=lambda r: (-r.full_date.timestamp(), r.review_id))
    step = -(-len(rows) // batches)
    stored = spark.createDataFrame([], SCHEMA)
    for start in range(0, len(rows), step):
        new = spark.createDataFrame(rows[start : start + step], SCHEMA)
        stored = stored.unionByName(ig.quota_resume(stored, new, SPINE, 6).select(*stored.columns))
        stored = spark.createDataFrame(stored.collect(), SCHEMA)
    assert ids(stored) == expected_quota(df, 6)


def test_quota_never_above_target_and_overflow_is_the_rest(spark):
    df = feed(spark)
    admitted = ig.quota_admit(df, SPINE, 9)
    assert admitted.groupBy("app_label", "lang", "month").count().agg(F.max("count")).first()[0] <= 9
    inside = sum(1 for r in df.collect() if r.date.isoformat()[:7] in SPINE)
    skipped = ig.quota_overflow(df, SPINE, 9).agg(F.sum("skipped")).first()[0]
    assert admitted.count() + skipped == inside


def test_quota_full(spark):
    rows = [(f"a{m}{i}", "a", "en", None, d.date(int(m[:4]), int(m[5:]), 1), 1) for m in SPINE for i in range(2)]
    rows += [("b", "b", "en", None, d.date(2026, 4, 1), 1), ("c", "c", "en", None, d.date(2020, 1, 1), 1)]
    out = ig.quota_full(spark.createDataFrame(rows, SCHEMA), SPINE, 2).orderBy("app_label").collect()
    assert [(r.app_label, r.is_full, r.months_seen) for r in out] == [("a", True, 6), ("b", False, 1), ("c", False, 0)]


def test_append_dedup_keeps_the_stored_row_and_is_idempotent(spark):
    old = spark.createDataFrame([("1", "old", "en", d.datetime(2025, 1, 1), None, 1)], SCHEMA)
    new = spark.createDataFrame(
        [("1", "new", "en", d.datetime(2026, 1, 1), None, 1), ("2", "x", "en", d.datetime(2026, 1, 1), None, 1),
         ("2", "y", "en", d.datetime(2026, 1, 2), None, 1)], SCHEMA,
    )
    once = ig.append_dedup(old, new)
    assert {(r.review_id, r.app_label) for r in once.collect()} == {("1", "old"), ("2", "y")}
    twice = ig.append_dedup(spark.createDataFrame(once.collect(), SCHEMA), new)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_dedup_with_one_group_of_copies(spark):
    rows = [(f"r{i}", "same user", "same text") for i in range(300)] + [("z", "u", "t"), ("y", "same user", None)]
    df = spark.createDataFrame(rows, "review_id string, user_name string, content string")
    out = ig.dedup_user_text(df, [F.col("review_id")])
    assert sorted(r.review_id for r in out.collect()) == ["r0", "y", "z"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Partial") > plan.index("Exchange")  # printed top down: the cut comes before the shuffle


def test_limit_per_app_and_cut(spark):
    df = feed(spark)
    top = ig.limit_per_app(df, 3, ig.newest_first())
    assert top.groupBy("app_label").count().filter("count <> 3").count() == 0
    assert first_per_key(df, ["app_label"], ig.newest_first()).count() == df.select("app_label").distinct().count()
    oldest = ig.cut_older_than(df, SPINE[-1]).agg(F.min("date")).first()[0]
    assert oldest >= d.date(2025, 11, 1)


def land(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def pages_of(spark, n=500, size=150, overlap=40):
    """Newest-first pages; each repeats the end of the page before it."""
    rows = sorted(feed(spark, n, seed=3).collect(), key=lambda r: (-r.full_date.timestamp(), r.review_id))
    return rows, [rows[max(i - overlap, 0) : i + size] for i in range(0, len(rows), size)]


def run_stream(spark, pages, start, restart_each):
    base = scratch_path(spark, "stream-test")

    def run():
        feed_ = si.review_stream(spark, base + "/in", spark.createDataFrame([], SCHEMA).schema, 1)
        start(feed_, base + "/out", base + "/state").awaitTermination()

    for page in pages:
        land(spark, page, base + "/in")
        if restart_each:
            run()
    if not restart_each:
        run()
    return base + "/out"


@pytest.mark.parametrize("restart_each", [True, False])
def test_stream_ingest_equals_batch(spark, restart_each):
    rows, pages = pages_of(spark)
    out = run_stream(spark, pages, lambda f, o, c: si.stream_ingest(f, o, c, SPINE), restart_each)
    expected = {r.review_id for r in rows if r.date.isoformat()[:7] in SPINE}
    assert ids(spark.read.parquet(out)) == expected


def test_stream_quota_equals_batch(spark):
    rows, pages = pages_of(spark)
    out = run_stream(spark, pages, lambda f, o, c: si.stream_quota(f, o, c, SPINE, 5), True)
    stored = si.read_sink(spark, out, spark.createDataFrame([], SCHEMA).schema)
    assert ids(stored) == expected_quota(spark.createDataFrame(rows, SCHEMA), 5)


def test_replayed_quota_batch_gives_the_same_rows(spark):
    _, pages = pages_of(spark, 300)
    out = run_stream(spark, pages, lambda f, o, c: si.stream_quota(f, o, c, SPINE, 5), True)
    schema = spark.createDataFrame([], SCHEMA).schema
    before = ids(si.read_sink(spark, out, schema))
    # A lost checkpoint replays every page under the same batch numbers.
    base = out.rsplit("/", 1)[0]
    again = si.review_stream(spark, base + "/in", schema, 1)
    si.stream_quota(again, out, base + "/state-new", SPINE, 5).awaitTermination()
    assert ids(si.read_sink(spark, out, schema)) == before


def test_new_checkpoint_adds_to_a_filled_sink(spark):
    def row(i):
        return (f"r{i}", "a", "en", d.datetime(2026, 4, 1, 0, i), d.date(2026, 4, 1), 1)

    base, schema = scratch_path(spark, "two-runs"), spark.createDataFrame([], SCHEMA).schema
    for folder, first in (("one", 0), ("two", 10)):
        land(spark, [row(i) for i in range(first, first + 10)], f"{base}/{folder}")
        feed_ = si.review_stream(spark, f"{base}/{folder}", schema, 1)
        si.stream_quota(feed_, base + "/out", f"{base}/state-{folder}", SPINE, 12).awaitTermination()
    stored = ids(si.read_sink(spark, base + "/out", schema))
    assert len(stored) == 12 and {f"r{i}" for i in range(10)} <= stored


def test_months_that_left_the_spine_stay_stored_and_out_of_the_lookup(spark):
    base, schema = scratch_path(spark, "old-months"), spark.createDataFrame([], SCHEMA).schema
    row = lambda key, month: (key, "a", "en", d.datetime(2026, month, 3), d.date(2026, month, 3), 1)
    land(spark, [row("old", 1), row("new", 4)], base + "/in")
    si.stream_ingest(si.review_stream(spark, base + "/in", schema), base + "/out", base + "/state", ["2026-01", "2026-04"]).awaitTermination()
    land(spark, [row("old", 1), row("late", 1), row("next", 4), row("new", 4)], base + "/in")
    si.stream_ingest(si.review_stream(spark, base + "/in", schema), base + "/out", base + "/state", ["2026-04"]).awaitTermination()
    stored = [r.review_id for r in si.read_sink(spark, base + "/out", schema).collect()]
    assert sorted(stored) == ["new", "next", "old"]
    assert ids(si.read_sink(spark, base + "/out", schema, ["2026-04"])) == {"new", "next"}


@pytest.mark.parametrize("start", [lambda f, o, c: si.stream_ingest(f, o, c), lambda f, o, c: si.stream_ingest(f, o, c, ["2026-01", "2026-04"]),
                                   lambda f, o, c: si.stream_quota(f, o, c, ["2026-01", "2026-04"], 5)])
def test_a_review_that_comes_again_in_another_month_is_stored_once(spark, start):
    base, schema = scratch_path(spark, "edited"), spark.createDataFrame([], SCHEMA).schema
    row = lambda key, month: (key, "a", "en", d.datetime(2026, month, 3), d.date(2026, month, 3), 1)
    for batch in ([row("x", 1), row("y", 1)], [row("x", 4), row("z", 4)], [row("y", 4), row("z", 1)]):
        land(spark, batch, base + "/in")
        start(si.review_stream(spark, base + "/in", schema), base + "/out", base + "/state").awaitTermination()
    stored = [(r.review_id, r.month) for r in si.read_sink(spark, base + "/out", schema).collect()]
    assert sorted(stored) == [("x", "2026-01"), ("y", "2026-01"), ("z", "2026-04")]


def test_reviews_without_a_readable_date_are_stored_once(spark):
    base, schema = scratch_path(spark, "undated"), spark.createDataFrame([], SCHEMA).schema
    row = lambda key, day: (key, "a", "en", d.datetime(2026, 1, 3), day, 1)
    for batch in ([row("x", None), row("y", d.date(2026, 1, 3))], [row("x", None), row("y", None), row("z", None)]):
        land(spark, batch, base + "/in")
        si.stream_ingest(si.review_stream(spark, base + "/in", schema), base + "/out", base + "/state").awaitTermination()
    stored = [(r.review_id, r.month) for r in si.read_sink(spark, base + "/out", schema).collect()]
    assert sorted(stored) == [("x", None), ("y", "2026-01"), ("z", None)]


def test_targets_per_group(spark):
    df = feed(spark)
    groups = [tuple(r) for r in df.select("app_label", "lang").distinct().orderBy("app_label", "lang").collect()]
    quota = {g: 3 + 4 * i for i, g in enumerate(groups[:-1])}
    table = spark.createDataFrame([(*g, n) for g, n in quota.items()], "app_label string, lang string, target int")
    got = ids(ig.quota_admit(df, SPINE, table))
    want = set()
    for g, n in quota.items():
        part = df.filter((F.col("app_label") == g[0]) & (F.col("lang") == g[1]))
        want |= ids(ig.quota_admit(part, SPINE, n))
    assert got == want


def test_empty_sink_reads_as_empty_table(spark):
    assert si.read_sink(spark, scratch_path(spark, "nothing"), feed(spark, 1).schema).count() == 0
