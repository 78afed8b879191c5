"""M: statistics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..operators import models as m
from ..operators.likelihood import nbinom_dispersion, replication_likelihood
from ..operators.loess import local_shape
from ..operators.regression import rate_model
from . import query

c = F.col


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({k: F.round(k, to) for k in columns})


_GC = "gcb AS (SELECT b.cell_id, b.chrom, b.bin_n, b.n, (g.gc_fraction * 100)::INT AS gc_index FROM fx_bin_counts b JOIN fx_genome_bins g USING (chrom, bin_n))"


def gc_counts(fx: Fixtures) -> DataFrame:
    return fx.bin_counts.join(fx.genome_bins, ["chrom", "bin_n"]).select("cell_id", "chrom", "bin_n", "n", F.round(c("gc_fraction") * 100).cast("int").alias("gc_index"))


_FIT = f"""{_GC}, st AS (SELECT cell_id, gc_index, count(*) AS n_bins, avg(n) AS mean, var_samp(n) AS v FROM gcb GROUP BY ALL),
 tw AS (SELECT *, CASE WHEN v > mean THEN least(10000.0, mean * mean / (v - mean)) ELSE 10000.0 END AS theta, CASE WHEN n_bins < 5 THEN n_bins / 10 ELSE n_bins END AS w, gc_index::DOUBLE AS x FROM st),
 s AS (SELECT cell_id, sum(w) s0, sum(w * x) s1, sum(w * x * x) s2, sum(w * x * x * x) s3, sum(w * x * x * x * x) s4, sum(w * mean) t0, sum(w * mean * x) t1, sum(w * mean * x * x) t2 FROM tw GROUP BY 1),
 fit AS (SELECT cell_id, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS d,
 t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2) AS d0, s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2) AS d1,
 s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2) AS d2 FROM s)"""


@query("m1", f"WITH {_FIT} SELECT cell_id, gc_index, n_bins, round(mean, 6) AS mean, round(theta, 4) AS theta, round((d0 + d1 * x + d2 * x * x) / d, 3) AS fitted FROM tw JOIN fit USING (cell_id)")
def m1(fx: Fixtures) -> DataFrame:
    x = m.gc_bias_fit(gc_counts(fx), ["cell_id"]).select("cell_id", "gc_index", "n_bins", "mean", F.round("theta", 4).alias("theta"), F.round("fitted", 3).alias("fitted"))
    return rounded(x, "mean")


@query("m2", f"WITH {_FIT} SELECT cell_id, chrom, bin_n, round(n / ((d0 + d1 * gc_index + d2 * gc_index * gc_index) / d / 2), 3) AS cn FROM gcb JOIN fit USING (cell_id)")
def m2(fx: Fixtures) -> DataFrame:
    counts = gc_counts(fx)
    return m.gc_normalize(counts, m.gc_bias_fit(counts, ["cell_id"]), ["cell_id"]).select("cell_id", "chrom", "bin_n", F.round("cn", 3).alias("cn"))


def percentiles(fx: Fixtures) -> DataFrame:
    x = fx.bin_counts.withColumns({"mu": (c("bin_n") % 4 + 1).cast("double"), "theta": F.lit(3.0)})
    return m.count_percentile(x, "n", "mu", "theta")


_PCT = "pct AS (SELECT cell_id, chrom, bin_n, n, (SELECT sum(exp(lgamma(i + 3.0) - lgamma(3.0) - lgamma(i + 1.0) + 3.0 * ln(3.0 / (3.0 + mu)) + i * ln(mu / (3.0 + mu)))) FROM range(0, 200) t(i) WHERE i <= n) AS p FROM (SELECT *, (bin_n % 4 + 1)::DOUBLE AS mu FROM fx_bin_counts))"


@query("m3", f"WITH {_PCT} SELECT cell_id, chrom, bin_n, round(p, 6) AS percentile FROM pct")
def m3(fx: Fixtures) -> DataFrame:
    return rounded(percentiles(fx).select("cell_id", "chrom", "bin_n", "percentile"), "percentile")


_CELLS = "select cell_id, chrom, floor(bin_n / 10) as window_n, cast(floor(sum(n) * 2.0 / 4.0 + 0.5) as int) as cn, cell_id % 3 as power from fx_bin_counts group by cell_id, chrom, floor(bin_n / 10)"


@query("m4", f"""WITH x AS ({_CELLS}), md AS (SELECT chrom, window_n, cn AS mode_cn FROM (SELECT *, row_number() OVER (PARTITION BY chrom, window_n ORDER BY k DESC, abs(cn - 2), cn) AS r FROM (SELECT chrom, window_n, cn, count(*) AS k FROM x GROUP BY ALL)) WHERE r = 1),
 y AS (SELECT x.*, x.cn / mode_cn AS ratio, pow(2.0, -(power - min(power) OVER (PARTITION BY chrom, window_n))) AS w FROM x JOIN md USING (chrom, window_n) WHERE mode_cn > 0),
 z AS (SELECT *, sum(w) OVER (PARTITION BY chrom, window_n ORDER BY ratio, cell_id) AS cw, sum(w) OVER (PARTITION BY chrom, window_n) AS s FROM y) SELECT chrom, window_n, round(greatest(1 / 3, least(3.0, min(ratio))), 6) AS shape FROM z WHERE cw * 2 >= s GROUP BY ALL""")  # fmt: skip
def m4(fx: Fixtures) -> DataFrame:
    x = fx.sql(_CELLS)
    mode = m.sample_profile(x, ["chrom", "window_n"], "cn", 2)
    return rounded(m.batch_shape(x.join(mode, ["chrom", "window_n"]), ["chrom", "window_n"]), "shape")


@query("m5", f"WITH {_PCT} SELECT chrom, bin_n, round(median(p), 6) AS median_percentile, count(*) AS n_samples FROM pct GROUP BY ALL")
def m5(fx: Fixtures) -> DataFrame:
    return rounded(m.batch_median_percentile(percentiles(fx), ["chrom", "bin_n"]), "median_percentile")


@query("m6", f"WITH x AS ({_CELLS}) SELECT chrom, window_n, cn AS mode_cn FROM (SELECT *, row_number() OVER (PARTITION BY chrom, window_n ORDER BY k DESC, abs(cn - 2), cn) AS r FROM (SELECT chrom, window_n, cn, count(*) AS k FROM x GROUP BY ALL)) WHERE r = 1")
def m6(fx: Fixtures) -> DataFrame:
    return m.sample_profile(fx.sql(_CELLS), ["chrom", "window_n"], "cn", 2)


@query("m7", """WITH i AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY chrom * 1000 + bin_n) - 1 AS i FROM fx_bin_counts), w AS (SELECT cell_id, p AS power, i // (1 << p::INT) AS w, sum(n) AS n FROM i, range(0, 6) t(p) GROUP BY ALL),
 s AS (SELECT cell_id, power, avg(n) AS mean, avg((n = 0)::INT) AS z FROM w GROUP BY ALL) SELECT cell_id, coalesce(min(power) FILTER (WHERE mean >= 9 AND z <= 0.1), 5)::INT AS power FROM s GROUP BY cell_id""")  # fmt: skip
def m7(fx: Fixtures) -> DataFrame:
    x = fx.bin_counts.withColumn("o", c("chrom") * 1000 + c("bin_n"))
    return m.window_power(x, ["cell_id"], "o", 5, 1.5, 1.5, 0.1)


@query("m8", "SELECT cell_id, chrom, bin_n, round(avg(n) OVER (PARTITION BY cell_id, chrom ORDER BY bin_n ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / avg(n) OVER (PARTITION BY cell_id, chrom), 6) AS shape FROM fx_bin_counts")
def m8(fx: Fixtures) -> DataFrame:
    return rounded(m.chromosome_shape(fx.bin_counts, ["cell_id", "chrom"], "bin_n", "n", 5).select("cell_id", "chrom", "bin_n", "shape"), "shape")


def _det(m: list[list[str]]) -> str:
    (a, b, c_), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c_} * ({d} * {h} - {e} * {g}))"


_POWERS = [[f"s{i + j}" for j in range(3)] for i in range(3)]


@query("m8_local", f"""WITH p AS (SELECT a.cell_id, a.chrom, a.bin_n, a.n, b.bin_n - a.bin_n AS d, b.n AS y, max(abs(b.bin_n - a.bin_n)) OVER (PARTITION BY a.cell_id, a.chrom, a.bin_n) AS h, avg(b.n) OVER (PARTITION BY a.cell_id, a.chrom, a.bin_n) AS m FROM fx_bin_counts a JOIN fx_bin_counts b USING (cell_id, chrom)),
 u AS (SELECT *, d / h::DOUBLE AS u, pow(1 - pow(abs(d / h::DOUBLE), 3), 3) AS w FROM p),
 s AS (SELECT cell_id, chrom, bin_n, n, m, {', '.join(f'sum(w * pow(u, {k})) AS s{k}' for k in range(5))}, {', '.join(f'sum(w * y * pow(u, {k})) AS t{k}' for k in range(3))}, count(*) AS k FROM u GROUP BY ALL),
 f AS (SELECT cell_id, chrom, bin_n, n, CASE WHEN k >= 10 THEN {_det([[f't{i}' if j == 0 else _POWERS[i][j] for j in range(3)] for i in range(3)])} / {_det(_POWERS)} / m ELSE 1 END AS shape FROM s)
 SELECT cell_id, chrom, bin_n, round(shape, 6) AS shape, round(n / shape * sum(n) OVER w / sum(n / shape) OVER w, 6) AS corrected FROM f WINDOW w AS (PARTITION BY cell_id, chrom)""")  # fmt: skip
def m8_local(fx: Fixtures) -> DataFrame:
    """Trends along chromosomes by local regression, and counts corrected for them."""
    return rounded(local_shape(fx.bin_counts, ["cell_id", "chrom"], "bin_n", "n").drop("n"), "shape", "corrected")


@query("m9", """WITH h AS (SELECT cell_id, n, count(*) AS k FROM fx_bin_counts GROUP BY ALL), d AS (SELECT *, k / sum(k) OVER (PARTITION BY cell_id) AS density, sum(k * n) OVER (PARTITION BY cell_id) / sum(k) OVER (PARTITION BY cell_id) AS mean FROM h), g AS (SELECT *, i / 20 AS f, mean / (1 + i / 20) AS b FROM d, range(0, 20) t(i)),
 q AS (SELECT *, (SELECT sum(CASE j WHEN 0 THEN (1 - f) * (1 - f) WHEN 1 THEN 2 * f * (1 - f) ELSE f * f END * exp(lgamma(n + 20.0) - lgamma(20.0) - lgamma(n + 1.0) + 20 * ln(20 / (20 + b * (1 + j / 2))) + n * ln(b * (1 + j / 2) / (20 + b * (1 + j / 2))))) FROM range(0, 3) u(j)) AS p FROM g),
 r AS (SELECT cell_id, f, sqrt(avg((density - p) * (density - p))) AS rmsd FROM q GROUP BY ALL) SELECT cell_id, round(arg_min(f, rmsd), 6) AS fraction_s, round(min(rmsd), 6) AS rmsd FROM r GROUP BY cell_id""")  # fmt: skip
def m9(fx: Fixtures) -> DataFrame:
    return rounded(m.replication_mixture(fx.bin_counts, "cell_id"), "fraction_s", "rmsd")


@query("m9_likelihood")
def m9_likelihood(fx: Fixtures) -> DataFrame:
    """Shares of replicated alleles by cell, by expectation-maximisation."""
    return replication_likelihood(fx.bin_counts, ["cell_id"], "n")


@query("m1_likelihood")
def m1_likelihood(fx: Fixtures) -> DataFrame:
    """Dispersion of counts by cell and GC percent, by greatest likelihood."""
    return nbinom_dispersion(gc_counts(fx), ["cell_id", "gc_index"], "n")


@query("m10", f"""WITH {_GC}, k AS (SELECT n, gc_index, count(*) AS k FROM gcb WHERE n IN (1, 2, 3) GROUP BY ALL) SELECT n AS state, gc_index, round(k / sum(k) OVER (PARTITION BY n), 6) AS p FROM k""")
def m10(fx: Fixtures) -> DataFrame:
    x = gc_counts(fx).withColumn("state", c("n"))
    return rounded(m.replication_state_gc(x, [1, 2, 3]), "p")


_MIXES = " UNION ALL ".join(
    f"SELECT cell_id, {cn} AS cn, {nar} AS nar, gc_index, {' + '.join(f'p_{j} * {v!r}::DOUBLE' for j, v in mix.items())} AS p, {len(mix) > 1} AS is_mix FROM sh"
    for (cn, nar), mix in m.STATE_MIXES[2].items()
)


@query("m10_tables", f"""WITH {_GC}, k AS (SELECT cell_id, gc_index, n - 1 AS nar FROM gcb WHERE n IN (1, 2, 3)), c AS (SELECT cell_id, gc_index, {', '.join(f'count(*) FILTER (WHERE nar = {j}) AS n_{j}' for j in range(3))}, count(*) AS n_all, count(*) FILTER (WHERE nar > 0) AS n_any FROM k GROUP BY ALL),
 s0 AS (SELECT cell_id, gc_index, {', '.join(f'greatest(0.01::DOUBLE, coalesce(n_{j} / nullif(sum(n_{j}) OVER w, 0), 0)) AS p_{j}' for j in ('0', '1', '2', 'all', 'any'))}, sum(n_1) OVER w AS t_1 FROM c WINDOW w AS (PARTITION BY cell_id)),
 sh AS (SELECT * REPLACE (CASE WHEN t_1 = 0 THEN (p_0 + p_2) / 2 / sum((p_0 + p_2) / 2) OVER (PARTITION BY cell_id) ELSE p_1 END AS p_1) FROM s0), x AS ({_MIXES})
 SELECT cell_id, cn, nar, gc_index, round(CASE WHEN is_mix THEN p / sum(p) OVER (PARTITION BY cell_id, cn, nar) ELSE p END, 6) AS p FROM x""")  # fmt: skip
def m10_tables(fx: Fixtures) -> DataFrame:
    """GC by copy number and replicated alleles of each cell, between the tables of its copy-neutral windows."""
    x = gc_counts(fx).where(c("n").isin(1, 2, 3)).select("cell_id", "gc_index", (c("n") - 1).alias("nar"))
    return rounded(m.replication_state_tables(x, ["cell_id"]), "p")


_RATES = "SELECT sample, chrom1, 'G' || substr(sample, 2)::INT % 2 AS grp, count(*) AS n, 100.0 + 10 * chrom1 AS cov FROM fx_molecules GROUP BY sample, chrom1"


def rates(fx: Fixtures) -> DataFrame:
    x = fx.molecules.groupBy("sample", "chrom1").agg(F.count("*").alias("n"))
    return x.withColumns({"grp": F.concat(F.lit("G"), (F.substr("sample", F.lit(2), F.lit(1)).cast("int") % 2).cast("string")), "cov": F.lit(100.0) + c("chrom1") * 10})


@query("m11", f"""WITH r AS ({_RATES}), g AS (SELECT grp, sum(n) AS n, sum(n) / sum(cov) AS rate FROM r GROUP BY 1), k AS (SELECT sum(pow(r.n - g.rate * cov, 2) / (g.rate * cov)) / (count(*) - 2) AS d FROM r JOIN g USING (grp))
 SELECT grp, round(ln(rate), 6) AS estimate, round(d, 6) AS dispersion, round(sqrt(d / n), 6) AS std_error FROM g, k""")  # fmt: skip
def m11(fx: Fixtures) -> DataFrame:
    return rounded(m.rate_comparison(rates(fx), "grp", "n", "cov"), "estimate", "dispersion", "std_error")


@query("m11_welch", f"""WITH r AS ({_RATES}), g AS (SELECT grp, avg(n / cov) AS m, var_samp(n / cov) AS v, count(*) AS k FROM r GROUP BY 1), x AS (SELECT a.m - b.m AS d, a.v / a.k AS va, b.v / b.k AS vb, a.k AS na, b.k AS nb FROM g a, g b WHERE a.grp = 'G0' AND b.grp = 'G1')
 SELECT round(d, 6) AS difference, round(d / sqrt(va + vb), 6) AS t, round(pow(va + vb, 2) / (va * va / (na - 1) + vb * vb / (nb - 1)), 4) AS df FROM x""")  # fmt: skip
def m11_welch(fx: Fixtures) -> DataFrame:
    x = m.welch_test(rates(fx).withColumn("f", c("n") / c("cov")), "grp", "f")
    return x.select(F.round("difference", 6).alias("difference"), F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


_FACTORS = f"SELECT *, (grp = 'G1')::INT::DOUBLE AS a, (chrom1 % 2)::INT::DOUBLE AS b FROM ({_RATES})"


_NORMAL = [["s0", "sa", "sb"], ["sa", "sa", "sab"], ["sb", "sab", "sb"]]
_RIGHT = ["t0", "ta", "tb"]
_SOLVED = ", ".join(f"{_det([[_RIGHT[i] if j == k else _NORMAL[i][j] for j in range(3)] for i in range(3)])} / {_det(_NORMAL)} AS b{k}" for k in range(3))
_SUMS = "sum(w) AS s0, sum(w * a) AS sa, sum(w * b) AS sb, sum(w * a * b) AS sab, sum(w * z) AS t0, sum(w * z * a) AS ta, sum(w * z * b) AS tb"


def _scoring_sql(rounds: int) -> str:
    """Rounds of a Poisson regression of two factors with two levels each, one table of coefficients a round."""
    out = "f AS MATERIALIZED (SELECT n, cov, a, b, grp, chrom1 FROM x), c0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"
    for k in range(1, rounds + 1):
        eta = "ln((n + 0.1) / cov)" if k == 1 else "(b0 + b1 * a + b2 * b)"
        out += f""", c{k} AS MATERIALIZED (SELECT {_SOLVED} FROM (SELECT {_SUMS} FROM (SELECT a, b, exp(eta) * cov AS w, eta + (n - exp(eta) * cov) / (exp(eta) * cov) AS z
 FROM (SELECT *, {eta} AS eta FROM f, c{k - 1}))))"""
    return out


@query("m11_covariates", f"""WITH x AS ({_FACTORS}), {_scoring_sql(12)}, m AS (SELECT f.*, exp(b0 + b1 * a + b2 * b) * cov AS w FROM f, c12), d AS (SELECT sum((n - w) * (n - w) / w) / (count(*) - 3) AS d, sum(w) AS s0, sum(w * a) AS sa, sum(w * b) AS sb, sum(w * a * b) AS sab FROM m),
 e AS (SELECT *, {_det(_NORMAL)} AS det FROM d)
 SELECT '(intercept)' AS term, NULL AS level, round(b0, 6) AS estimate, round(sqrt(d * (sa * sb - sab * sab) / det), 6) AS std_error, round(d, 6) AS dispersion FROM e, c12
 UNION ALL SELECT 'grp', 'G1', round(b1, 6), round(sqrt(d * (s0 * sb - sb * sb) / det), 6), round(d, 6) FROM e, c12
 UNION ALL SELECT 'project', 'P1', round(b2, 6), round(sqrt(d * (s0 * sa - sa * sa) / det), 6), round(d, 6) FROM e, c12""")  # fmt: skip
def m11_covariates(fx: Fixtures) -> DataFrame:
    """Rates of two groups with the project as a covariate."""
    x = rates(fx).withColumn("project", F.concat(F.lit("P"), (c("chrom1") % 2).cast("string")))
    found = rate_model(x, ["grp", "project"], "n", "cov", "quasipoisson").select("term", "level", "estimate", "std_error", "dispersion")
    return rounded(found, "estimate", "std_error", "dispersion")


@query("m11_negative_binomial")
def m11_negative_binomial(fx: Fixtures) -> DataFrame:
    """The same with negative binomial counts, whose dispersion is estimated too."""
    x = rates(fx).withColumn("project", F.concat(F.lit("P"), (c("chrom1") % 2).cast("string")))
    return rate_model(x, ["grp", "project"], "n", "cov")


@query("m12")
def m12(fx: Fixtures) -> DataFrame:
    """Junction ends classified as adapters by score, bases and place against matched controls."""
    x = fx.nodes_long.select("event_id", (c("event_id") % 2).cast("double").alias("label"), (c("event_id") % 2 * 8 + c("insert_size") % 5).cast("double").alias("score"), (c("pos1") % 30).cast("double").alias("n_bases"), (c("pos2") % 20).cast("double").alias("start"))
    model = m.adapter_classifier(x, ["score", "n_bases", "start"], "label")
    return model.transform(x).select("event_id", c("prediction").cast("int").alias("is_adapter"))


@query("m13", f"""WITH x AS (SELECT node_class AS grp, mol_id, clip_len1 + clip_len2 AS v FROM fx_molecules), b AS (SELECT grp, r, v, ('0x' || substr(md5('0|' || mol_id || '|' || r), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM x, range(1, 21) t(r)),
 k AS (SELECT *, (u > 0.36787944117144233::DOUBLE)::INT + (u > 0.7357588823428847::DOUBLE)::INT + (u > 0.9196986029286058::DOUBLE)::INT + (u > 0.9810118431238462::DOUBLE)::INT AS k FROM b), s AS (SELECT grp, r, v, sum(k) AS k FROM k WHERE k > 0 GROUP BY ALL),
 w AS (SELECT *, sum(k) OVER (PARTITION BY grp, r ORDER BY v) AS c, sum(k) OVER (PARTITION BY grp, r) AS n FROM s), md AS (SELECT grp, r, min(v) AS v FROM w WHERE c * 2 >= n GROUP BY ALL) SELECT grp, quantile_cont(v, 0.025)::DOUBLE AS low, quantile_cont(v, 0.5)::DOUBLE AS median, quantile_cont(v, 0.975)::DOUBLE AS high FROM md GROUP BY grp""")  # fmt: skip
def m13(fx: Fixtures) -> DataFrame:
    x = fx.molecules.select(c("node_class").alias("grp"), "mol_id", (c("clip_len1") + c("clip_len2")).alias("v"))
    return m.bootstrap_median(x, "grp", "mol_id", "v", 20)


@query("m13_ranks", """WITH x AS (SELECT node_class AS grp, clip_len1 + clip_len2 AS v FROM fx_molecules), r AS (SELECT v, count(*) AS k FROM x GROUP BY 1), q AS (SELECT v, coalesce(sum(k) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS mid FROM r)
 SELECT grp, count(*) AS n, sum(mid)::DOUBLE AS rank_sum FROM x JOIN q USING (v) GROUP BY grp""")  # fmt: skip
def m13_ranks(fx: Fixtures) -> DataFrame:
    return m.rank_sum(fx.molecules.select(c("node_class").alias("grp"), (c("clip_len1") + c("clip_len2")).alias("v")), "grp", "v")


@query("m14", """WITH s AS (SELECT cell_id, bin_n % 3 AS a, stddev_samp(n) AS sd, count(*) AS k FROM fx_bin_counts GROUP BY ALL HAVING stddev_samp(n) IS NOT NULL), q AS (SELECT cell_id, sum(sd * k) / sum(k) AS d FROM s GROUP BY 1) SELECT cell_id, round(d, 6) AS cn_sd, d <= 1.4 AS is_kept FROM q""")
def m14(fx: Fixtures) -> DataFrame:
    return rounded(m.cell_quality(fx.bin_counts.select("cell_id", (c("bin_n") % 3).alias("n_alleles"), c("n").alias("cn")), 1.4), "cn_sd")


@query("m15", f"""WITH x AS (SELECT *, cn - 2 AS diff FROM ({_CELLS})), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id, chrom ORDER BY window_n) - row_number() OVER (PARTITION BY cell_id, chrom, diff ORDER BY window_n) AS run FROM x)
 SELECT cell_id, chrom, diff, min(window_n) AS first, max(window_n) AS last, count(*) AS n, CASE WHEN diff > 0 THEN 'gain' ELSE 'loss' END AS type FROM r WHERE diff <> 0 GROUP BY cell_id, chrom, diff, run HAVING count(*) >= 2""")  # fmt: skip
def m15(fx: Fixtures) -> DataFrame:
    return m.cnv_calls(fx.sql(_CELLS).withColumn("ploidy", F.lit(2)), "ploidy", 2)


@query("m16", """WITH a AS (SELECT DISTINCT user_id AS id, user_id % 5 AS k, (user_id * 7) % 900 AS f, (user_id * 7) % 900 + 20 + user_id % 40 AS l FROM events), b AS (SELECT k, i * 60 AS f, i * 60 + 35 AS l FROM range(0, 20) t(i), range(0, 5) u(k)),
 o AS (SELECT a.id, a.f, a.l, coalesce(sum(least(a.l, b.l) - greatest(a.f, b.f) + 1), 0) / (a.l - a.f + 1) AS ov FROM a LEFT JOIN b ON a.k = b.k AND a.f <= b.l AND b.f <= a.l GROUP BY a.id, a.f, a.l)
 SELECT id, round(ov, 6) AS overlap, ov >= 0.6 OR f = 0 OR l - f + 1 > 50 AS is_kept FROM o""")  # fmt: skip
def m16(fx: Fixtures) -> DataFrame:
    a = fx.table("events").select("user_id").distinct().selectExpr("user_id as id", "user_id % 5 as k", "(user_id * 7) % 900 as first", "(user_id * 7) % 900 + 20 + user_id % 40 as last")
    b = fx.spark.range(100).selectExpr("id % 5 as k", "id div 5 * 60 as first", "id div 5 * 60 + 35 as last")
    return rounded(m.suppress_false_cnvs(a, b, ["k"], 0.6, c("first") == 0, 50).select("id", "overlap", "is_kept"), "overlap")


@query("m17", "WITH e AS (SELECT chrom, bin_n, avg(n) AS expected FROM fx_bin_counts GROUP BY ALL) SELECT cell_id, chrom, bin_n, round(2 * n / expected, 6) AS cn FROM fx_bin_counts JOIN e USING (chrom, bin_n)")
def m17(fx: Fixtures) -> DataFrame:
    batch = fx.bin_counts.groupBy("chrom", "bin_n").agg(F.avg("n").alias("expected"))
    return rounded(m.composite_cn(fx.bin_counts, batch, ["chrom", "bin_n"]).select("cell_id", "chrom", "bin_n", "cn"), "cn")
