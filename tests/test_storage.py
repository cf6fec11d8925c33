"""Tables by month: pruned reads, and merges that leave the other partitions alone."""
import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from marketlens import catalog
from marketlens.sources import ingest as ing
from marketlens.sources import storage as st
from marketlens.sources.fixtures import Market

SF = "/root/testdata/sf0.001"
SCHEMA = "ticker string, date date, close double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def d(text):
    return dt.date.fromisoformat(text)


@pytest.fixture
def table(spark, tmp_path):
    start = [(f"S{k}", d(f"2020-{m:02}-15"), float(10 * k + m)) for k in range(3) for m in range(1, 13)]
    base = spark.createDataFrame(start, SCHEMA)
    st.write_table(st.by_month().add(base), f"{tmp_path}/base", st.by_month().names)
    return st.PartitionTable(spark, f"{tmp_path}/t", base.schema, st.by_month(), f"{tmp_path}/base"), start


def last_wins(old, new):
    return ing.upsert(old, new, ["ticker", "date"])


def files(root):
    return set(glob.glob(f"{root}/**/*.parquet", recursive=True))


def test_merge_rewrites_the_months_of_the_feed_only(spark, table, tmp_path):
    t, start = table
    before = {f: os.stat(f).st_mtime_ns for f in files(tmp_path / "base")}
    feed = [("S0", d("2020-03-15"), 99.0), ("S9", d("2020-03-20"), 98.0), ("S9", d("2021-01-01"), 97.0)]
    assert t.merge(spark.createDataFrame(feed, SCHEMA), last_wins)
    want = {(k, x): v for k, x, v in start} | {(k, x): v for k, x, v in feed}
    assert rows(st.plain(t.read())) == sorted((*k, v) for k, v in want.items())
    assert {f: os.stat(f).st_mtime_ns for f in files(tmp_path / "base")} == before
    months = {tuple(f.split("/")[-3:-1]) for f in files(tmp_path / "t/data")}
    assert months == {("part_year=2020", "part_month=3"), ("part_year=2021", "part_month=1")}
    assert sum(spark.read.parquet(f).count() for f in files(tmp_path / "t/data")) == 5  # 3 + 1 of March, 1 of January
    # the new state reads the rewritten month from its new place
    scanned = {f for f in st.plain(t.read(["part_year=2020/part_month=3"])).inputFiles()}
    assert all("/t/data/version=1/" in f for f in scanned)


def test_replayed_batch_and_gaps(spark, table):
    t, start = table
    one = spark.createDataFrame([("S0", d("2020-03-15"), 99.0)], SCHEMA)
    assert t.merge(one, last_wins, batch=5) and t.commit().batch == 5
    state, data = t.commit(), rows(t.read())
    assert not t.merge(spark.createDataFrame([("S0", d("2020-03-15"), 1.0)], SCHEMA), last_wins, batch=5)
    assert not t.merge(one, last_wins, batch=3)
    assert t.commit() == state and rows(t.read()) == data
    assert t.merge(spark.createDataFrame([], SCHEMA), last_wins, batch=9) and rows(t.read()) == data
    assert t.commit().batch == 9
    assert not t.merge(spark.createDataFrame([], SCHEMA), last_wins)


def test_a_load_that_dies_leaves_the_table_as_it_was(spark, table):
    t, start = table
    broken = spark.createDataFrame([("S0", d("2020-03-15"), 1.0), ("S0", d("2020-03-15"), 2.0)], SCHEMA)
    with pytest.raises(Exception, match="occurs twice"):
        t.merge(broken, last_wins)
    assert rows(st.plain(t.read())) == sorted(start) and t.commit().number == 0
    assert t.merge(spark.createDataFrame([("S0", d("2020-03-15"), 3.0)], SCHEMA), last_wins)
    assert ("S0", d("2020-03-15"), 3.0) in rows(st.plain(t.read()))


def test_insert_keeps_and_adds(spark, table, tmp_path):
    t, start = table
    extra = [("S7", d("2020-03-01"), 1.0)]
    t.merge(spark.createDataFrame(extra, SCHEMA), lambda old, new: new, keep=True)
    t.merge(spark.createDataFrame(extra, SCHEMA), lambda old, new: new, keep=True)
    assert rows(st.plain(t.read())) == sorted(start + extra * 2)
    t.merge(spark.createDataFrame([("S7", d("2020-03-01"), 5.0)], SCHEMA), last_wins)
    assert [r for r in rows(st.plain(t.read())) if r[0] == "S7"] == [("S7", d("2020-03-01"), 5.0)]


def test_purge_drops_months_and_rewrites_the_edge(spark, table, tmp_path):
    t, start = table
    assert t.purge(d("2020-04-01"))  # whole months: nothing is written
    assert rows(st.plain(t.read())) == sorted(r for r in start if r[1] >= d("2020-04-01")) and not files(tmp_path / "t/data")
    assert t.purge(d("2020-06-16"))
    assert rows(st.plain(t.read())) == sorted(r for r in start if r[1] >= d("2020-06-16"))
    assert not t.purge(d("2020-06-16"))
    assert t.purge(d("2030-01-01")) and t.read().count() == 0
    assert t.merge(spark.createDataFrame(start[:2], SCHEMA), last_wins) and t.read().count() == 2


def test_buckets(spark, tmp_path):
    layout = st.by_bucket("ticker", 4)
    t = st.PartitionTable(spark, f"{tmp_path}/dim", spark.createDataFrame([], "ticker string, name string").schema, layout)
    assert t.read().count() == 0
    t.merge(spark.createDataFrame([(f"S{k}", "a") for k in range(20)], "ticker string, name string"),
            lambda old, new: ing.upsert(old, new, ["ticker"]))
    first = files(tmp_path / "dim/data")
    t.merge(spark.createDataFrame([("S3", "b")], "ticker string, name string"), lambda old, new: ing.upsert(old, new, ["ticker"]))
    assert len(files(tmp_path / "dim/data") - first) == 1
    assert rows(st.plain(t.read())) == sorted((f"S{k}", "b" if k == 3 else "a") for k in range(20))


def test_files_are_cut_by_rows(spark, tmp_path):
    st.write_table(spark.range(1000).coalesce(1), f"{tmp_path}/x", max_records_per_file=300)
    assert len(files(tmp_path / "x")) == 4


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line and "PartitionFilters" in line]


@pytest.mark.parametrize("name", ["retention_purge", "drawdown_1y", "ytd_performance", "price_history", "historical_pe"])
def test_windows_prune_months(spark, name):
    """The scan that the rows come from has a filter on the partition columns."""
    pruned = [s for s in scans(catalog.QUERIES[name](spark, SF)) if "part_month" in s.split("PartitionFilters: [")[1].split("PushedFilters")[0]]
    assert pruned, name


def test_run_time_window_reads_its_months_only(spark):
    m = Market(spark, SF, stored=True)
    p = m.prices_by_month
    recent = st.in_period(p, F.date_sub(st.latest_date(p), 365))
    assert rows(st.plain(recent)) == rows(m.prices.where(F.col("date") >= F.date_sub(m.prices.select(F.max("date")).scalar(), 365)))
    recent.collect()
    plan = recent._jdf.queryExecution().executedPlan()
    scan = next(s for s in _nodes(plan) if s.nodeName().startswith("Scan parquet"))
    read = {k: v for k, v in ((x._1(), x._2().value()) for x in _pairs(scan.metrics()))}
    assert read["numPartitions"] <= 14 < p.select("part_year", "part_month").distinct().count()


def _pairs(m):
    it = m.iterator()
    while it.hasNext():
        yield it.next()


def _nodes(plan):
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStage"):
        yield from _nodes(plan.plan())
    else:
        yield plan
        it = plan.children().iterator()
        while it.hasNext():
            yield from _nodes(it.next())
