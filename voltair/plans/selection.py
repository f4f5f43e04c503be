"""Queries that choose, number, scale and pool, over the same views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import channels, templates, waves
from . import query, rounded


@query(", o AS (SELECT DISTINCT ch AS src, 'c' || ch AS dst FROM sig WHERE ch <> 'view') SELECT o.dst AS ch, t, x FROM sig JOIN o ON sig.ch = o.src", "sig")
def reordered_channels(s, d):
    sig = v.sig(s, d)
    order = sig.where("ch <> 'view'").select(F.col("ch").alias("src"), F.concat(F.lit("c"), "ch").alias("dst")).distinct()
    return channels.reorder(sig, order)


@query(" SELECT * FROM sig WHERE t >= 20 AND t < 70", "sig")
def limited_range(s, d):
    return channels.limited(v.sig(s, d), 20, 50)


@query(", n AS (SELECT ch, ceil((max(t) + 1) / 3) AS size FROM sig GROUP BY ch) SELECT sig.ch, t, x FROM sig JOIN n ON sig.ch = n.ch WHERE floor(t / size) = 1", "sig")
def file_chunk(s, d):
    return channels.file_chunk(v.sig(s, d), 1, 3)


@query(", sd AS (SELECT ch, stddev_pop(x) AS sd FROM sig GROUP BY ch) SELECT sig.ch, t, x FROM sig JOIN sd ON sig.ch = sd.ch WHERE abs(x) < 1.5 * sd", "sig")
def clipped_samples(s, d):
    return channels.clipped(v.sig(s, d), 1.5)


@query(" SELECT ch, t, round((x * (20.0 / 65536) + 0) * 1000, 6) + 0.0::DOUBLE AS x FROM sig", "sig")
def millivolts(s, d):
    return rounded(v.sig(s, d).withColumn("x", channels.scaled(F.col("x"), -10.0, 10.0, 14, "millivolts")), "x")


@query(" SELECT ch, t // 8 AS t, round(avg(x), 6) + 0.0 AS x FROM sig GROUP BY ALL", "sig")
def decimated(s, d):
    return rounded(channels.decimated(v.sig(s, d), 8), "x")


CLAIMS = ", claims AS (SELECT l_suppkey % 5 AS unit, l_orderkey AS t FROM lineitem)"


def claims(s, d):
    return v.table(s, d, "lineitem").select((F.col("l_suppkey") % 5).alias("unit"), F.col("l_orderkey").alias("t"))


@query("WITH " + CLAIMS[2:] + ", c AS (SELECT t, count(DISTINCT unit) AS units FROM claims GROUP BY t) SELECT units, count(*) AS instants FROM c GROUP BY units")
def unit_memberships(s, d):
    return channels.memberships(claims(s, d))


@query("WITH " + CLAIMS[2:] + " SELECT t, CASE WHEN min(unit) = max(unit) THEN min(unit) ELSE -1 END AS cut FROM claims GROUP BY t")
def cut_column(s, d):
    return channels.cut_column(claims(s, d))


@query("WITH " + CLAIMS[2:] + " SELECT unit, t, row_number() OVER (PARTITION BY unit ORDER BY t) - 1 AS ordinal FROM (SELECT DISTINCT unit, t FROM claims)")
def spike_index(s, d):
    return channels.spike_index(claims(s, d).distinct())


@query(" SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov FROM wave a JOIN wave b ON a.spike = b.spike AND a.pos <= b.pos GROUP BY ALL", "wave", also="noise_cov")
def noise_cov_all(s, d):
    return rounded(waves.position_pairs(v.shapes(s, d)).groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov")), "cov")


@query(", c AS (SELECT a.unit AS part, a.pos AS i, b.pos AS j, count(*) AS n, covar_samp(a.v, b.v) AS cov FROM wave a JOIN wave b ON a.spike = b.spike AND a.pos <= b.pos GROUP BY ALL HAVING count(*) > 1) SELECT i, j, round(sum(n * cov) / sum(n), 6) + 0.0 AS cov FROM c GROUP BY i, j", "wave", also="pooled_cov")
def pooled_cov_all(s, d):
    parts = waves.position_pairs(v.shapes(s, d)).groupBy(F.col("unit").alias("part"), "i", "j").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("cov")).where("n > 1")
    return rounded(templates.pooled_covariance(parts), "cov")


@query(", n AS (SELECT unit, count(DISTINCT spike) AS n FROM wave GROUP BY unit) SELECT unit, n, round(n / (SELECT sum(n) FROM n), 6) AS share FROM n", "wave")
def template_shares(s, d):
    n = waves.remove_sparse(v.wave(s, d), 0.0)
    total = n.agg(F.sum("n").alias("total"))  # one row
    return rounded(n.crossJoin(F.broadcast(total)).select("unit", "n", (F.col("n") / F.col("total")).alias("share")), "share")


@query(" SELECT DISTINCT gr_nr FROM chan WHERE ch_nr IN (0, 1, 2, 3, 7, 20)", "chan")
def listed_groups(s, d):
    return channels.groups_of(v.chan(s, d), "0-3,7, 20")


@query(" SELECT unit, n, CASE WHEN n > 5 THEN round(ln((n - 5) / 30000.0), 9) END AS log_p FROM (SELECT unit, count(DISTINCT spike) // 12 AS n FROM wave GROUP BY unit)", "wave")
def log_rates(s, d):
    """Logarithms of rates, null where the rate is none."""
    from ..functions import guarded_log

    n = v.wave(s, d).groupBy("unit").agg(F.floor(F.count_distinct("spike") / 12).alias("n"))
    log_p = guarded_log((F.col("n") - 5) / 30_000.0)
    return rounded(n.withColumn("log_p", F.when(log_p > float("-inf"), log_p)), "log_p", digits=9)
