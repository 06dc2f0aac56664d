import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import incremental, quality
from quantloom.sources import changelog, tables, vendor
from quantloom.streaming import sync

D = dt.date


def test_contract(spark, tmp_path):
    path = str(tmp_path / "daily.parquet")
    spark.createDataFrame([(D(2024, 1, 2), "a", 1.0)], "trade_date date, symbol string, close double").write.parquet(path)
    with pytest.raises(tables.ContractError, match="missing columns"):
        tables.import_parquet(spark, path, "daily")
    with pytest.raises(tables.ContractError, match="unknown table"):
        tables.import_parquet(spark, path, "nothing")
    root = tables.load_root(spark, str(tmp_path / "none"))
    assert set(root) == set(tables.REQUIRED) and root["status"].count() == 0


def test_filters(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    assert df.where(tables.filter_column(df, [[("x", "<", 2)], [("x", "in", [5, 6]), ("x", "!=", 6)]])).count() == 3
    with pytest.raises(tables.ContractError):
        tables.filter_column(df, [("y", "==", 1)])
    with pytest.raises(tables.ContractError):
        tables.filter_column(df, [("x", "like", 1)])


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).select("id", F.col("id").alias("other"), F.lit(1).alias("third")).write.parquet(path)
    df = tables.read_table(spark.read.parquet(path), ["id"], [("id", ">=", 90)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,90)" in plan and "third" not in plan
    assert df.count() == 10


def log(spark):
    a = changelog.stamp(spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, value long"), 1, "replace")
    b = changelog.stamp(spark.createDataFrame([("b", 3), ("c", 4), ("c", 5)], "symbol string, value long"), 2, "upsert", "value")
    c = changelog.stamp(spark.createDataFrame([("d", 6, 9.0)], "symbol string, value long, volume double"), 3, "upsert")
    return changelog.grow(changelog.grow(a, b), c)


def test_versioned_reads(spark):
    rows = {r["symbol"]: (r["value"], r["volume"]) for r in changelog.read(log(spark), ["symbol"]).collect()}
    assert rows == {"a": (1, None), "b": (3, None), "c": (5, None), "d": (6, 9.0)}
    old = changelog.read(log(spark), ["symbol"], as_of=1).collect()
    assert {r["symbol"]: r["value"] for r in old} == {"a": 1, "b": 2}
    newer = log(spark).unionByName(changelog.stamp(spark.createDataFrame([("z", 0, 0.0)], "symbol string, value long, volume double"), 4, "replace"))
    assert [r["symbol"] for r in changelog.read(newer, ["symbol"]).collect()] == ["z"]
    kept = changelog.read(log(spark), ["symbol"], filters=[("value", ">", 3), ("symbol", "!=", "d")], columns=["symbol"]).collect()
    assert [r["symbol"] for r in kept] == ["c"]


def test_order_comes_from_the_data(spark):
    rows = [("k%d" % (i % 5), i, i * 7 % 10) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, place long, value long")
    reads = [
        sorted(map(tuple, changelog.read(changelog.stamp(df.repartition(n, "value").orderBy(F.desc("value")), 1, "upsert", "place"), ["symbol"]).collect()))
        for n in (1, 7)
    ]
    assert reads[0] == reads[1] == [("k%d" % k, 35 + k, (35 + k) * 7 % 10) for k in range(5)]
    with pytest.raises(tables.ContractError, match="sequence"):
        changelog.check_order(changelog.stamp(df, 1, "upsert"), ["symbol"])


def test_write_modes(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "symbol string, value long"

    def live():
        return {r["symbol"]: r["value"] for r in changelog.read(changelog.open_log(spark, path), ["symbol"]).collect()}

    def put(rows, mode):
        return changelog.publish(spark, path, spark.createDataFrame(rows, schema), ["symbol"], mode)

    assert put([("a", 1)], "upsert") == 0
    assert put([("b", 2)], "replace") == 1 and live() == {"b": 2}
    assert put([("b", 3), ("c", 4)], "upsert") == 2 and live() == {"b": 3, "c": 4}
    with pytest.raises(tables.ContractError, match="live"):
        put([("c", 5), ("d", 6)], "append")
    assert put([("a", 7)], "append") == 3 and live() == {"a": 7, "b": 3, "c": 4}
    with pytest.raises(tables.ContractError, match="unknown mode"):
        put([("a", 7)], "merge")
    with pytest.raises(tables.ContractError, match="sequence"):
        put([("a", 7), ("a", 8)], "upsert")


def test_columns_cannot_be_dropped(spark):
    with pytest.raises(tables.ContractError):
        changelog.grow(log(spark), spark.createDataFrame([("a",)], "symbol string"))
    with pytest.raises(tables.ContractError):
        changelog.check_keys(spark.createDataFrame([(None,)], "k string"), ["k"])


def test_bar_files(spark, tmp_path):
    folder = tmp_path / "SH" / "86400"
    folder.mkdir(parents=True)
    rows = np.zeros(2, dtype=vendor.RECORD)
    rows["seconds"] = 1704124800  # 2024-01-02 00:00 in Shanghai
    rows["open"] = rows["low"] = rows["close"] = 10000
    rows["high"] = [11000, 9000]
    rows["volume"], rows["amount"] = 100, 5000
    (folder / "600000.DAT").write_bytes(b"\0" * 8 + rows.tobytes())
    (folder / "600001.DAT").write_bytes(b"\0" * 8 + rows.tobytes()[:-3])
    (folder / "123456.DAT").write_bytes(b"\0" * 8 + rows.tobytes())
    files = vendor.bar_files(spark, str(tmp_path))
    with pytest.raises(Exception, match="truncated bar file: 600001.SH"):
        vendor.decode_bars(files).collect()
    got = vendor.decode_bars(files.where("symbol <> '600001.SH'")).collect()
    assert [(r["symbol"], r["trade_date"], r["high"]) for r in got] == [("600000.SH", D(2024, 1, 2), 11.0)]
    assert [r["symbol"] for r in vendor.broken_files(files).collect()] == ["600001.SH"]


def test_snapshot_and_frames(spark, tmp_path):
    cal = spark.createDataFrame([(D(2024, 1, 2), True)], "trade_date date, is_open boolean")
    manifest = tables.write_snapshot({"calendar": cal}, str(tmp_path / "snap")).collect()
    assert manifest[0]["rows"] == 1
    assert tables.load_root(spark, str(tmp_path / "snap"))["calendar"].count() == 1
    for name in ("x.csv", "x.parquet"):
        path = str(tmp_path / name)
        tables.write_frame(cal.withColumn("trade_date", F.col("trade_date").cast("string")), path, single_file=True)
        assert tables.read_frame(spark, path).count() == 1


def test_footers_answer_without_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    days = [(D(2024, 1, k + 1), k, f"s{k}", None if k == 3 else k / 2) for k in range(9)]
    spark.createDataFrame(days, "trade_date date, k long, symbol string, x double").repartition(3).write.parquet(path)
    found = tables.footer_summary(spark, path, ["trade_date", "k", "x"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "PushedAggregation: [COUNT(*), MIN(trade_date), MAX(trade_date)" in plan
    r = found.first()
    assert (r["rows"], r["first_trade_date"], r["last_trade_date"], r["first_k"], r["last_k"], r["first_x"], r["last_x"]) == (9, D(2024, 1, 1), D(2024, 1, 9), 0, 8, 0.0, 4.0)
    assert tables.footer_summary(spark, path).first()["rows"] == 9
    with pytest.raises(tables.ContractError, match="symbol"):
        tables.footer_summary(spark, path, ["symbol"])
    with pytest.raises(tables.ContractError, match="unknown"):
        tables.footer_summary(spark, path, ["none"])


def test_listings_and_units(spark):
    part = spark.createDataFrame([("600000.SH", "19991110", None), ("200001.SZ", "19990101", None)], "symbol string, list_date string, delist_date string")
    assert [(r["symbol"], r["list_date"]) for r in vendor.listings([part]).collect()] == [("600000.SH", D(1999, 11, 10))]
    bars = spark.createDataFrame([("600000.SH", D(2024, 1, 2), 1.0)], "symbol string, trade_date date, volume double")
    none = spark.createDataFrame([], "symbol string, trade_date date, adjust_factor double")
    basics = spark.createDataFrame([], "symbol string, trade_date date, turnover double")
    daily, missing = vendor.market_day(bars, none, basics)
    assert daily.first()["volume"] == 100.0
    with pytest.raises(tables.ContractError):
        vendor.require_factors(missing)


def test_sync_is_idempotent(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "log", "cp"))
    schema = "symbol string, trade_date date, close double"
    first = spark.createDataFrame([("a", D(2024, 1, 2), 1.0)], schema)
    first.coalesce(1).write.parquet(f"{src}")
    typed = spark.read.parquet(src).schema
    sync.append_batches(spark, src, typed, ["symbol", "trade_date"], out, cp).awaitTermination()
    spark.createDataFrame([("a", D(2024, 1, 2), 2.0), ("a", D(2024, 1, 3), 3.0)], schema).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        sync.append_batches(spark, src, typed, ["symbol", "trade_date"], out, cp).awaitTermination()
    rows = {r["trade_date"].day: r["close"] for r in changelog.read(changelog.open_log(spark, out), ["symbol", "trade_date"]).collect()}
    assert rows == {2: 2.0, 3: 3.0}
    later = sync.resume(first, "2024-01-08").count(), sync.resume(first, "2024-01-10").count()
    assert later == (1, 0)


def published(log, keys=("symbol",), **kw):
    """The rows at every version."""
    return [sorted(map(tuple, log.read(list(keys), as_of=v, **kw).collect())) for v in range(log.version + 1)]


def test_sync_keeps_what_is_published(spark, tmp_path, monkeypatch):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    log = changelog.Log(spark, str(tmp_path / "log"))
    schema = "symbol string, trade_date date, close double"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    keys = ["symbol", "trade_date"]
    log.publish(rows(("a", D(2024, 1, 1), 1.0)), keys)
    log.publish(rows(("b", D(2024, 1, 1), 2.0)), keys, "replace")
    before = published(log, keys)
    rows(("a", D(2024, 1, 2), 3.0)).coalesce(1).write.parquet(src)
    sync_now = lambda: sync.append_batches(spark, src, rows(("a", D(2024, 1, 2), 3.0)).schema, keys, log.folder, cp, progress="trade_date").awaitTermination()
    sync_now()
    assert published(log, keys)[:2] == before and log.version == 2 and log.through == "2024-01-02"
    # Another writer comes between, then a batch dies after its data and before its entry.
    log.publish(rows(("c", D(2024, 1, 1), 4.0)), keys)
    rows(("a", D(2024, 1, 3), 5.0)).coalesce(1).write.mode("append").parquet(src)
    whole = changelog.Log._commit

    def dies(self, name, entry):
        raise RuntimeError("lost")

    monkeypatch.setattr(changelog.Log, "_commit", dies)
    with pytest.raises(Exception, match="lost"):
        sync_now()
    assert log.version == 3 and log.through == "2024-01-02" and len(published(log, keys)[-1]) == 3

    def dies_later(self, name, entry):
        whole(self, name, entry)
        raise RuntimeError("lost later")

    monkeypatch.setattr(changelog.Log, "_commit", dies_later)
    with pytest.raises(Exception, match="lost later"):
        sync_now()
    monkeypatch.setattr(changelog.Log, "_commit", whole)
    sync_now()
    assert log.version == 4 and log.through == "2024-01-03"
    assert published(log, keys)[-1] == [("a", D(2024, 1, 2), 3.0), ("a", D(2024, 1, 3), 5.0), ("b", D(2024, 1, 1), 2.0), ("c", D(2024, 1, 1), 4.0)]
    assert published(log, keys)[:2] == before


def test_two_writers_of_one_version(spark, tmp_path):
    log = changelog.Log(spark, str(tmp_path / "log"))
    one = spark.createDataFrame([("a", 1)], "symbol string, value long")
    log.publish(one, ["symbol"])
    entry = log.commits()[0]
    with pytest.raises(tables.ContractError, match="another writer"):
        log._commit(f"{0:012d}", entry)
    assert published(log) == [[("a", 1)]]
    with pytest.raises(tables.ContractError, match="type"):
        log.publish(spark.createDataFrame([("a", "x")], "symbol string, value string"), ["symbol"])


@pytest.mark.parametrize("order", ["version", "sequence"])
def test_compaction_changes_no_read(spark, tmp_path, order):
    plain, log = (changelog.Log(spark, str(tmp_path / n)) for n in ("plain", "it's compacted"))
    rng = np.random.default_rng(1)
    by = changelog.ORDERS[order]
    for v in range(7):
        made = [(f"k{k}", int(rng.integers(0, 10**6)), float(v)) for k in rng.choice(30, 12, replace=False)]
        frame = spark.createDataFrame(made, "symbol string, place long, value double")
        if v >= 5:
            frame = frame.withColumn("late column", F.col("value") * 2)
        for target in (plain, log):
            target.publish(frame, ["symbol"], "replace" if v == 3 else "upsert", "place")
        if v in (1, 4, 6):
            assert log.compact(["symbol"], order, buckets=3) == v == log.compact(["symbol"], order)
    assert published(log, by=by) == published(plain, by=by)
    late = dict(filters=[("value", ">=", 4.0), ("symbol", "!=", "k3")], columns=["symbol", "late column"], by=by)
    for v in (5, 6):
        assert sorted(log.read(["symbol"], as_of=v, **late).collect()) == sorted(plain.read(["symbol"], as_of=v, **late).collect())


def test_compacted_base_is_not_shuffled(spark, tmp_path):
    log = changelog.Log(spark, str(tmp_path / "log"))
    rows = spark.range(1000).select(F.col("id").alias("symbol"), F.col("id").alias("value"))
    log.publish(rows, ["symbol"])
    log.compact(["symbol"], buckets=4)
    log.publish(rows.where("symbol % 100 = 0").withColumn("value", F.lit(-1).cast("long")), ["symbol"])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = log.read(["symbol"])
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 1 and "_version=0" not in plan
        # The first child of the join is the base, and reaches it as it lies in the files.
        assert "Exchange" not in plan[plan.index("SortMergeJoin") : plan.index("Bucketed: true")]
        assert read.where("value < 0").count() == 10 and read.count() == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_stored_values_fill_only_gaps(spark, tmp_path):
    path = str(tmp_path / "values")
    asked = []

    def compute(names, window):
        asked.append(names)
        rows = [(n, D(2024, m, 28), "s", float(m)) for n in names for m in (1, 2)]
        return spark.createDataFrame(rows, "factor_name string, signal_date date, symbol string, raw_value double")

    need = spark.createDataFrame([("f", D(2024, 1, 1), D(2024, 2, 1))], "factor_name string, first_month date, last_month date")
    assert incremental.fill_missing(spark, path, need, "r1", compute, None) == ["f"]
    assert incremental.fill_missing(spark, path, need, "r1", compute, spark.read.parquet(path)) == []
    two = need.unionByName(need.withColumn("factor_name", F.lit("g")))
    assert incremental.fill_missing(spark, path, two, "r1", compute, spark.read.parquet(path)) == ["g"]
    assert spark.read.parquet(path).count() == 4 and asked == [["f"], ["g"]]


def test_universe_key_ignores_order():
    assert incremental.universe_key("X", ["a", "b"]) == incremental.universe_key("X", ["b", "a"])
    assert incremental.universe_key("X") != incremental.universe_key("Y")


def test_audit_stops_on_errors(spark):
    spans = spark.createDataFrame([("a", D(2020, 1, 1), None), ("a", D(2021, 1, 1), None)], "symbol string, valid_from date, valid_to date")
    with pytest.raises(ValueError, match="overlapping"):
        quality.require(quality.audit_intervals(spans, "industries"))
