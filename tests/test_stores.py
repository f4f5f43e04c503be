"""Recordings in stores that only Spark's names reach, and in numbers that outgrow their digits."""

import os

import pytest
from pyspark.sql import functions as F

from voltair import shared
from voltair.sources import mat, read_syncs, recordings


def test_files_in_a_mounted_store(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.mounted.link./kept", f"file://{tmp_path}")
    rows = spark.range(6).select(F.lit("rec.0000").alias("file"), F.lit(0).alias("ch"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    recordings.write_signals(rows, "viewfs://mounted/kept/signals", 1000, channels=1)
    assert sorted(r.t for r in recordings.samples(spark, "viewfs://mounted/kept/signals").where("x >= 2").collect()) == [2, 3, 4, 5]
    syncs = spark.range(3).select(F.lit("a").alias("name"), F.col("id").alias("idx"), F.col("id").cast("int").alias("sync"))
    recordings.write_syncs(syncs, "viewfs://mounted/kept/syncs").collect()
    assert sorted(r.sync for r in read_syncs(spark, "viewfs://mounted/kept/syncs").collect()) == [0, 1, 2]


def test_a_local_path_is_taken_as_it_stands(spark, tmp_path):
    folder = f"file://{tmp_path}/a b%20c"
    rows = spark.createDataFrame([("rec", 0, 0, 1.0)], "file string, ch int, t long, x double")
    assert recordings.write_signals(rows, folder, 1000).count() == 1
    assert recordings.headers(spark, folder).first().samples == 1


def test_a_path_without_a_scheme(spark, tmp_path):
    assert shared.located(spark, f"{tmp_path}/x/y") == f"file:{tmp_path}/x/y"


def test_numbers_of_parts_beyond_four_digits(spark):
    samples = spark.range(20_050).select(F.lit("rec").alias("file"), F.lit(0).alias("ch"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    parts = recordings.split_samples(samples, 2)
    assert parts.select("file").distinct().count() == 10_025
    assert recordings.assemble(parts).where("t <> x").isEmpty()


def test_signs_of_zeros_in_shapes(spark, tmp_path):
    """extracted_spikes equals its SQL where a sample is a negative zero."""
    import duckdb

    import __spark_entry__ as entry

    events = spark.range(600).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("ts"), F.lit("a").alias("event_type"),
        F.when(F.col("id") % 100 == 50, 90.0).when(F.col("id") % 7 == 0, 0.0).otherwise((F.col("id") * 37 % 11).cast("double")).alias("value"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(db.execute("SELECT ch, t, shape FROM (" + entry.oracle_sql()["extracted_spikes"] + ")").fetchall())
    got = sorted(tuple(r) for r in entry.queries()["extracted_spikes"](spark, str(tmp_path)).select("ch", "t", "shape").collect())
    assert want == got and any("-0.0" in shape for _, _, shape in got)


@pytest.fixture
def hidden(spark, tmp_path, monkeypatch):
    """The shared folder, in a store that Spark reaches and pyarrow doesn't."""
    conf, name = spark._jsc.hadoopConfiguration(), tmp_path.name.replace("_", "-")
    conf.set("fs.hidden.impl", "org.apache.hadoop.fs.viewfs.ViewFileSystemOverloadScheme")
    conf.set(f"fs.viewfs.mounttable.{name}.link./kept", f"file://{tmp_path}")
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"hidden://{name}/kept")
    return f"hidden://{name}/kept"


def as_its_sql(spark, name, sf):
    """Whether a query has the rows of its SQL."""
    import duckdb

    import __spark_entry__ as entry

    got, db = entry.queries()[name](spark, sf), duckdb.connect()
    for table in ("events", "nation"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(want) == sorted(tuple(r) for r in got.collect()) and bool(want)


def test_sync_files_in_a_store_that_only_spark_opens(spark, sf, hidden, tmp_path):
    """Contents with any last byte, names with any characters; a second job replaces files."""
    ends = {"a =%20.é": -1, "10": 10 << 24, "13": 13 << 24, "0": 0, "128": -128 << 24}
    for factor in (2, 1):
        rows = spark.createDataFrame([(name, i, x // factor) for name, x in ends.items() for i in range(3)], "name string, idx long, sync int")
        assert {r.bytes for r in recordings.write_syncs(rows, f"{hidden}/syncs").collect()} == {312}
    assert not [x for x in os.listdir(tmp_path / "syncs") if x.startswith("_")]
    bodies = {name: (tmp_path / "syncs" / name).read_bytes()[300:] for name in ends}
    assert bodies == {name: x.to_bytes(4, "little", signed=True) * 3 for name, x in ends.items()}
    assert as_its_sql(spark, "sync_files", sf)


def test_signal_files_in_a_store_that_only_spark_opens(spark, sf, hidden):
    rows = spark.createDataFrame([("rec.0001", 0, 0, 1.0), ("rec.0001", 1, 1, -1.0), ("rec.0002", 0, 0, 2.0)], "file string, ch int, t long, x double")
    assert [tuple(r) for r in recordings.write_signals(rows, f"{hidden}/signals", 1000, channels=2).collect()] == [("rec.0001", 98), ("rec.0002", 94)]
    got = recordings.scan(spark, f"{hidden}/signals", per_task=1).select(F.element_at(F.split("file", "/"), -1), "ch", "t0", F.col("x")[0]).collect()
    assert sorted(tuple(r) for r in got) == [("rec.0001", 0, 0, 1), ("rec.0001", 0, 1, 0), ("rec.0001", 1, 0, 0), ("rec.0001", 1, 1, -1), ("rec.0002", 0, 0, 2), ("rec.0002", 1, 0, 0)]
    assert as_its_sql(spark, "signal_files", sf)


def test_signal_headers_in_a_store_that_only_spark_opens(spark, sf, hidden):
    rows = spark.createDataFrame([("b", 0, 1, 1.0), ("a", 0, 0, 2.0)], "file string, ch int, t long, x double")
    recordings.write_signals(rows, f"{hidden}/headers", 30_000, "uei", channels=3)
    got = recordings.headers(spark, f"{hidden}/headers", "uei").orderBy("file").select(F.element_at(F.split("file", "/"), -1), "rate", "channels", "samples")
    assert [tuple(r) for r in got.collect()] == [("a", 29_990, 3, 1), ("b", 29_990, 3, 1)]
    assert as_its_sql(spark, "signal_headers", sf)


def test_spiketrain_files_in_a_store_that_only_spark_opens(spark, sf, hidden):
    trains = spark.createDataFrame([("one", [1.0, 2.5], [[3.0, -4.0]]), ("two", [0.5], [[1.0, 5.0]])], "cell string, ts_ms array<double>, spike_form array<array<double>>")
    mat.write_spiketrains(trains, f"{hidden}/trains")
    got = {(r.file.rsplit("/", 1)[-1], r.name): (r.dims, r.x) for r in mat.read(spark, f"{hidden}/trains").collect()}
    assert got == {("one.mat", "timestamps"): ([1, 2], [1.0, 2.5]), ("one.mat", "spikeForm"): ([1, 2], [3.0, -4.0]), ("two.mat", "timestamps"): ([1, 1], [0.5]), ("two.mat", "spikeForm"): ([1, 2], [1.0, 5.0])}
    assert as_its_sql(spark, "spiketrain_files", sf)


def test_signal_pushdown_in_a_store_that_only_spark_opens(spark, sf, hidden):
    rows = spark.range(400).select(F.lit("rec").alias("file"), (F.col("id") % 2).cast("int").alias("ch"), F.floor(F.col("id") / 2).alias("t"), F.col("id").cast("double").alias("x"))
    recordings.write_signals(rows, f"{hidden}/many", 1000)
    got = recordings.samples(spark, f"{hidden}/many", per_task=50).where("ch = 1 AND t BETWEEN 98 AND 101").select("t", "x").collect()
    assert sorted(tuple(r) for r in got) == [(t, 2.0 * t + 1) for t in range(98, 102)]
    assert as_its_sql(spark, "signal_pushdown", sf)


def test_signal_range_in_a_store_that_only_spark_opens(spark, sf, hidden):
    recordings.write_signals(spark.createDataFrame([("rec", 0, t, float(t)) for t in range(10)], "file string, ch int, t long, x double"), f"{hidden}/ten", 1000)
    got = recordings.scan(spark, f"{hidden}/ten", start=3, stop=8, per_task=2).select("t0", "x").collect()
    assert sorted((r.t0, r.x) for r in got) == [(3, [3, 4]), (5, [5, 6]), (7, [7])]
    with pytest.raises(Exception, match="has 10 samples, none of them 3 to 11"):
        recordings.scan(spark, f"{hidden}/ten", start=3, stop=11).collect()
    assert as_its_sql(spark, "signal_range", sf)


def test_trigger_samples_in_a_store_that_only_spark_opens(spark, sf, hidden):
    recordings.write_signals(spark.createDataFrame([("rec", ch, 0, float(ch)) for ch in range(3)], "file string, ch int, t long, x double"), f"{hidden}/three", 1000)
    descriptor = spark.createDataFrame([(1, "electrode"), (2, "presenter"), (3, "electrode")], "nr int, type string")
    assert [(r.ch, r.x) for r in recordings.triggers(recordings.scan(spark, f"{hidden}/three"), descriptor).collect()] == [(1, [1.0])]
    assert as_its_sql(spark, "trigger_samples", sf)


def test_uei_units_in_a_store_that_only_spark_opens(spark, sf, hidden):
    rows = spark.createDataFrame([("rec", 0, 0, 16384.0), ("rec", 1, 0, -16384.0)], "file string, ch int, t long, x double")
    recordings.write_signals(rows, f"{hidden}/uei", 30_000, "uei", low=-10.0, high=10.0, bits=14)
    got = {u: [r.x for r in recordings.uei(spark, f"{hidden}/uei", [1], u).collect()] for u in ("volts", "millivolts", "daq")}
    assert got == {"volts": [-5.0], "millivolts": [-5000.0], "daq": [-16384.0]}
    assert as_its_sql(spark, "uei_units", sf)


@pytest.fixture
def few(tmp_path):
    """Makes tables of so many events of one type."""
    import duckdb

    def made(n):
        folder = tmp_path / f"few-{n}"
        folder.mkdir()
        duckdb.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * i AS ts, 'a' AS event_type, i * 1.5::DOUBLE AS value FROM range({n}) r(i)) TO '{folder}/events.parquet' (FORMAT parquet)")
        os.symlink("/root/testdata/sf0.001/nation.parquet", folder / "nation.parquet")
        return str(folder)

    return made


def as_its_empty_sql(spark, name, sf):
    """Whether neither a query nor its SQL has a row."""
    import duckdb

    import __spark_entry__ as entry

    got, db = entry.queries()[name](spark, sf), duckdb.connect()
    for table in ("events", "nation"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return got.collect() == db.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall() == []


def test_signal_pushdown_where_predicates_leave_nothing(spark, few, tmp_path):
    """One channel, of which channels 1 and 2 are asked; values that are null."""
    rows = spark.createDataFrame([("rec", ch, t, float(t)) for ch in range(2) for t in range(3)], "file string, ch int, t long, x double")
    recordings.write_signals(rows, f"file://{tmp_path}/nine", 1000)
    found = recordings.samples(spark, f"file://{tmp_path}/nine")
    assert found.where("t >= 3").collect() == found.where("ch IN (2, 3)").collect() == found.where("file = 'none'").collect() == []
    assert sorted((r.ch, r.t) for r in found.where("ch IN (1, NULL)").collect()) == [(1, 0), (1, 1), (1, 2)]
    assert as_its_empty_sql(spark, "signal_pushdown", few(1000))


def test_a_folder_without_mat_files(spark, tmp_path):
    assert mat.read(spark, f"file://{tmp_path}").collect() == []


@pytest.mark.parametrize("n", [0, 1, 89])
def test_signal_range_where_no_file_has_as_many(spark, few, n):
    assert as_its_empty_sql(spark, "signal_range", few(n))


def test_trigger_samples_without_recordings(spark, few):
    assert as_its_empty_sql(spark, "trigger_samples", few(0))


def test_uei_units_without_recordings(spark, few, hidden, tmp_path, monkeypatch):
    """In a store that only Spark opens, and on a local folder."""
    empty = few(0)
    assert as_its_empty_sql(spark, "uei_units", empty)
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert as_its_empty_sql(spark, "uei_units", empty)
