"""Queries that write recordings and read them back, and those that split and assemble them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as v
from ..functions import numeric_suffix
from ..shared import folder
from ..sources import read_syncs, read_waveforms, recordings
from . import query, rounded

INT16 = "greatest(least(round_even(x, 0), 32767), -32768)"
#: Samples of a file.
PART = 1000


def numbered_samples(s, d):
    """(file, ch int, t, x) and the number of channels: the signal's channels numbered by name, in files of PART samples with numbers at the end."""
    sig = v.sig(s, d)
    names = sig.select(F.col("ch").alias("name")).distinct()
    place = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("ch"))  # a row a channel
    rows = sig.withColumnRenamed("ch", "name").join(F.broadcast(place), "name").select(F.lit("rec").alias("file"), "ch", "t", "x")
    return recordings.split_samples(rows, PART), place.count()


def written(s, d, name: str, **options) -> str:
    path = folder(s, name)
    rows, channels = numbered_samples(s, d)
    recordings.write_signals(rows, path, 30_000, channels=channels, **options)
    return path


def put_together(rows):
    """(ch, t, x) of the recording, whose parts are all of the same length but the last."""
    return rows.select("ch", (F.col("t") + numeric_suffix(F.col("file")) * PART).alias("t"), "x")


PLACED = ", c AS (SELECT dense_rank() OVER (ORDER BY ch) - 1 AS ch, t, x FROM sig), n AS (SELECT max(t) + 1 AS n FROM c), full_ AS (SELECT r.ch, u.t FROM (SELECT unnest(range(0, (SELECT max(ch) + 1 FROM c))) AS ch) r, (SELECT unnest(range(0, (SELECT n FROM n))) AS t) u), filled AS (SELECT full_.ch::INT AS ch, full_.t, coalesce(x, 0) AS x FROM full_ LEFT JOIN c USING (ch, t))"


def chunks_of(rows):
    return rows.select("file", "ch", "t0", F.posexplode("x").alias("i", "x")).select("file", "ch", (F.col("t0") + F.col("i")).alias("t"), "x")


@query(PLACED + f" SELECT ch, t, {INT16}::INT AS x FROM filled", "sig")
def signal_files(s, d):
    """Written as numbered signal files, scanned back in parts of 300 samples, put together."""
    back = put_together(chunks_of(recordings.scan(s, written(s, d, "signal-files"), per_task=300)))
    return back.select("ch", "t", F.col("x").cast("int").alias("x"))


@query(PLACED + f" SELECT ch, t, {INT16}::INT AS x FROM filled WHERE t % {PART} >= 20 AND t % {PART} < 90 AND t // {PART} * {PART} + 90 <= (SELECT n FROM n)", "sig")
def signal_range(s, d):
    """Samples 20 to 90 of each file that has as many, read alone."""
    path = folder(s, "signal-range")
    rows, channels = numbered_samples(s, d)
    full = rows.groupBy("file").agg(F.max("t").alias("last")).where("last >= 89").select("file")
    recordings.write_signals(rows.join(full, "file", "left_semi"), path, 30_000, channels=channels)
    back = put_together(chunks_of(recordings.scan(s, path, start=20, stop=90)))
    return back.select("ch", "t", F.col("x").cast("int").alias("x"))


@query(PLACED + f" SELECT ch, t, {INT16}::INT AS x FROM filled WHERE t % {PART} >= 40 AND t % {PART} < 60 AND ch IN (1, 2)", "sig")
def signal_pushdown(s, d):
    """Predicates on channel and time of a row a sample, which the source turns into byte ranges."""
    rows = recordings.samples(s, written(s, d, "signal-pushdown")).where("ch IN (1, 2) AND t >= 40 AND t < 60")
    return put_together(rows).select("ch", "t", F.col("x").cast("int").alias("x"))


@query(PLACED + f", f AS (SELECT t // {PART} AS file, max(t) - min(t) + 1 AS samples FROM filled GROUP BY 1) SELECT file, 30000::BIGINT AS rate, (SELECT max(ch) + 1 FROM c) AS channels, samples FROM f", "sig")
def signal_headers(s, d):
    back = recordings.headers(s, written(s, d, "signal-headers"))
    return back.select(numeric_suffix(F.col("file")).alias("file"), "rate", "channels", "samples")


@query(PLACED + " SELECT ch, t, x FROM filled", "sig")
def npt_files(s, d):
    """Typed files of doubles."""
    return put_together(chunks_of(recordings.scan(s, written(s, d, "npt", layout="npt", code=13), "npt")))


@query(PLACED + f" SELECT ch, t, round(({INT16} * (20.0 / 65536) + 0.0) * 1000, 6) + 0.0 AS x FROM filled WHERE ch <> 0", "sig")
def uei_units(s, d):
    """Counts of a converter from -10 to 10 volts, in millivolts, without channel 0."""
    path = written(s, d, "uei", layout="uei", low=-10.0, high=10.0, bits=14)
    channels = recordings.headers(s, path, "uei").agg(F.max("channels")).first()[0] or 0  # null without files
    chosen = list(range(1, channels))
    return rounded(put_together(recordings.uei(s, path, chosen, "millivolts")), "x")


@query(PLACED + f", d AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ch, n_regionkey FROM nation) SELECT ch, t, {INT16}::INT AS x FROM filled WHERE ch IN (SELECT ch FROM d WHERE n_regionkey = 1)", "sig")
def trigger_samples(s, d):
    """The channels that a descriptor calls triggers."""
    place = F.row_number().over(Window.orderBy("n_nationkey"))  # a row a nation
    descriptor = v.table(s, d, "nation").select(place.alias("nr"), F.when(F.col("n_regionkey") == 1, "presenter").otherwise("electrode").alias("type"))
    found = recordings.triggers(recordings.scan(s, written(s, d, "triggers")), descriptor)
    return put_together(chunks_of(found)).select("ch", "t", F.col("x").cast("int").alias("x"))


@query(" SELECT unit AS cell, us / 1000 AS ts_ms FROM train", "train")
def train_tables(s, d):
    """Spike trains written by cell, and read back."""
    path = folder(s, "trains")
    recordings.write_trains(v.train(s, d).select(F.col("unit").alias("cell"), (F.col("us") / 1000).alias("ts_ms")), path)
    return s.read.schema("ts_ms double, cell string").parquet(path).select("cell", "ts_ms")


@query("SELECT label::VARCHAR AS grp, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS spike, vec_id * 100.0 / 1000 AS ts_ms, list_sum(list_transform(embedding, lambda e: round_even(e * 1000, 0)))::BIGINT AS total FROM embeddings")
def waveform_files(s, d):
    """One waveform file a unit, written and read back."""
    path = folder(s, "waveforms")
    thousand = F.lit(1000).cast("float")  # the product is a float, as in SQL: a double one falls on the other side of some halves
    w = F.array(F.transform("embedding", lambda e: F.bround(e * thousand).cast("short")))
    recordings.write_waveforms(v.table(s, d, "embeddings").select(F.col("label").cast("string").alias("grp"), F.col("vec_id").cast("double").alias("ts"), w.alias("w")), path).collect()
    total = F.aggregate(F.col("w")[0], F.lit(0).cast("long"), lambda a, e: a + e)
    back = read_waveforms(s, path, 1.0)  # stamps in microseconds, as they stand in the file; a factor of 0.001 is rounded, and large stamps show it
    return back.select(F.element_at(F.split("file", "/"), -1).alias("grp"), "spike", (F.col("ts_ms") / 1000).alias("ts_ms"), total.alias("total"))


@query("SELECT n_regionkey::VARCHAR AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS idx, n_nationkey::INT AS sync FROM nation")
def sync_files(s, d):
    path = folder(s, "syncs")
    recordings.write_syncs(v.table(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("name"), F.col("n_nationkey").alias("idx"), F.col("n_nationkey").cast("int").alias("sync")), path).collect()
    return read_syncs(s, path).select(F.element_at(F.split("file", "/"), -1).alias("name"), "idx", "sync")


@query(", p AS (SELECT ch, t, x FROM sig) SELECT 'rec' AS file, ch, t, x FROM p", "sig")
def split_and_assembled(s, d):
    """Numbered parts of 77 samples, put together again."""
    sig = v.sig(s, d).select(F.lit("rec").alias("file"), "ch", "t", "x")
    return recordings.assemble(recordings.split_samples(sig, 77))
