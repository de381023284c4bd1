"""Registered queries over the driver's tables, and SQL that must give the same rows.

Series: `events`, the daily largest positive value of each event type; `orders`, the monthly largest order of each
priority; `stages`, pairs of monthly revenue and line count of each return flag for rating curves.
Doubles are rounded alike on both sides, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.special import chi2_sf, hash_bits, norm_cdf, norm_ppf, norm_sf2, num, pearson3_factor_steps, pearson3_steps, sql_fold, staged_sql, student_steps, t_ppf_upper
from .operators import battery, candidates, densities, dependence, features, frequency, kernels, learning, lookup, moments, parents, peaks, quality, resampling, series, station, thresholds, trend, uncertainty
from .plans import report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return series.block_maxima(_read(spark, sf, "events"), "event_type", "ts", "value", "day")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return series.block_maxima(_read(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "month")


def stages(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.date_trunc("month", "l_shipdate").alias("block"))
    df = df.agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("q"), F.count(F.lit(1)).cast("double").alias("h"))
    return series.numbered(df).join(df.select("series_id", "block", "h"), ["series_id", "block"])


def base(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").filter("value > 0").select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("x"))


_EVENTS = """s0 AS (SELECT event_type AS series_id, date_trunc('day', ts) AS block, max(value) AS q FROM events WHERE value > 0 AND ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY block) AS t, count(*) OVER (PARTITION BY series_id) AS n,
  row_number() OVER (PARTITION BY series_id ORDER BY q, block) AS rank, avg(q) OVER (PARTITION BY series_id) AS m, stddev_samp(q) OVER (PARTITION BY series_id) AS sd FROM s0)"""
_ORDERS = """s0 AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate) AS block, max(o_totalprice) AS q FROM orders GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY block) AS t, count(*) OVER (PARTITION BY series_id) AS n FROM s0)"""
_STAGES = """p AS (SELECT l_returnflag AS series_id, date_trunc('month', l_shipdate) AS block, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS q, CAST(count(*) AS DOUBLE) AS h FROM lineitem GROUP BY 1, 2),
c AS (SELECT series_id, count(*) AS n, regr_slope(log10(q), log10(h)) AS b, regr_intercept(log10(q), log10(h)) AS a, regr_r2(log10(q), log10(h)) AS r2, regr_sxx(log10(q), log10(h)) AS sxx, regr_syy(log10(q), log10(h)) AS syy, avg(log10(h)) AS mx, min(log10(h)) AS lo, max(log10(h)) AS hi FROM p GROUP BY 1)"""
_BASE = "b AS (SELECT event_type AS series_id, ts, value AS x FROM events WHERE value > 0)"
_PERIODS = "UNNEST([2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 200.0, 500.0, 1000.0]::DOUBLE[])"
_LOGFIT = """y AS (SELECT series_id, n, ln(q) AS y, avg(ln(q)) OVER (PARTITION BY series_id) AS my FROM s),
yc AS (SELECT series_id, n, avg(my) AS mean_log, avg(power(y - my, 2)) AS m2, avg(power(y - my, 3)) AS m3, avg(power(y - my, 4)) AS m4 FROM y GROUP BY series_id, n),
f AS (SELECT series_id, n, mean_log, sqrt(m2 * n / (n - 1)) AS sd_log, CASE WHEN n >= 8 AND m2 > 0 THEN sqrt(CAST(n * (n - 1) AS DOUBLE)) / (n - 2) * m3 / power(m2, 1.5) END AS skew_log, sqrt(6.0::DOUBLE / n) AS se_skew FROM yc)"""
_FITS = f"""lm AS (SELECT series_id, n, avg(q) AS b0, avg(q * (rank - 1) / (n - 1)) AS b1 FROM s GROUP BY series_id, n),
g AS (SELECT series_id, n, avg(q) AS m1, stddev_samp(q) AS s1, avg(ln(q)) AS lq, stddev_pop(ln(q)) AS ls FROM s GROUP BY series_id, n),
fits AS (
  SELECT series_id, n, 'exponential' AS family, 1 AS k, m1 AS p1, CAST(NULL AS DOUBLE) AS p2 FROM g
  UNION ALL SELECT series_id, n, 'ln2', 2, lq, ls FROM g
  UNION ALL SELECT series_id, n, 'gumbel_mom', 2, m1 - {num(0.5772156649015329)} * s1 * sqrt(6.0::DOUBLE) / pi(), s1 * sqrt(6.0::DOUBLE) / pi() FROM g
  UNION ALL SELECT series_id, n, 'gumbel_lmom', 2, b0 - {num(0.5772156649015329)} * (2 * b1 - b0) / ln(2.0::DOUBLE), (2 * b1 - b0) / ln(2.0::DOUBLE) FROM lm)"""
_Q = f"CASE WHEN family = 'exponential' THEN -p1 * ln(1 - (1 - 1 / period)) WHEN family = 'ln2' THEN exp(p1 + p2 * {norm_ppf('1 - 1 / period')}) ELSE p1 - p2 * ln(-ln(1 - 1 / period)) END"


def _wh(skew: str, p: str) -> str:
    z = norm_ppf(p)
    return f"CASE WHEN abs({skew}) < CAST(1e-10 AS DOUBLE) THEN {z} ELSE 2 / {skew} * (power(1 + {skew} * {z} / 6 - {skew} * {skew} / 36, 3) - 1) END"


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles rounded, timestamps as text: what both engines can agree on."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in df.columns])


def query(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None, digits: int = 5, columns: str = "") -> None:
    """Register a query; sql ends in a SELECT whose double columns are listed in `columns` to be rounded alike."""
    QUERIES[name] = lambda spark, sf: rounded(build(spark, sf), digits)
    if sql:
        doubles = [c.strip('"') for c in columns.split()]  # + 0.0 makes a negative zero that rounding leaves a plain one
        ORACLE[name] = f"SELECT * REPLACE ({', '.join(f'round("{c}", {digits}) + 0.0::DOUBLE AS "{c}"' for c in doubles)}) FROM ({sql})" if doubles else sql


_DAY = "strftime(block, '%Y-%m-%d %H:%M:%S')"

query("block_maxima", events, f"WITH {_EVENTS} SELECT series_id, CAST(t AS INTEGER) AS t, {_DAY} AS block, q FROM s", columns="q")
query("block_counts", lambda s, d: series.block_counts(_read(s, d, "events"), "event_type", "ts", "value", "day"), f"SELECT event_type AS series_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS block, count(value) AS n_peaks, max(value) AS q FROM events GROUP BY 1, date_trunc('day', ts)", columns="q")
query(
    "plotting_positions",
    lambda s, d: series.probabilities(events(s, d)),
    f"""WITH {_EVENTS} SELECT series_id, CAST(t AS INTEGER) AS t, {_DAY} AS block, q, CAST(rank AS INTEGER) AS rank, n, rank / (n + 1.0::DOUBLE) AS p_weibull, (rank - 0.5::DOUBLE) / n AS p_hazen, (rank - 0.44::DOUBLE) / (n + 0.12::DOUBLE) AS p_gringorten,
    (rank - 0.4::DOUBLE) / (n + 0.2::DOUBLE) AS p_cunnane, 1 - rank / (n + 1.0::DOUBLE) AS p_exceed, 1 / (1 - rank / (n + 1.0::DOUBLE)) AS return_period, ln(q) AS log_q FROM s""",
    columns="q p_weibull p_hazen p_gringorten p_cunnane p_exceed return_period log_q",
)
query(
    "calendar",
    lambda s, d: series.calendar(orders(s, d)),
    f"""WITH {_ORDERS} SELECT series_id, CAST(t AS INTEGER) AS t, {_DAY} AS block, q, CAST(month(block) AS INTEGER) AS month, CAST(dayofyear(block) AS INTEGER) AS doy,
    CASE WHEN month(block) BETWEEN 6 AND 9 THEN 'southwest_monsoon' WHEN month(block) BETWEEN 10 AND 12 THEN 'post_monsoon' WHEN month(block) BETWEEN 3 AND 5 THEN 'pre_monsoon' ELSE 'winter' END AS season,
    month(block) BETWEEN 6 AND 9 AS is_monsoon, CAST(CAST(floor(year(block) / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS decade FROM s""",
    columns="q",
)
query("ecdf", lambda s, d: series.ecdf(events(s, d)), f"WITH {_EVENTS} SELECT series_id, CAST(rank AS INTEGER) AS rank, q, CAST(rank AS DOUBLE) / n AS f, 1 - CAST(rank AS DOUBLE) / n AS exceed FROM s", columns="q f exceed")
query("order_guard", lambda s, d: series.order_guard(events(s, d)), f"WITH {_EVENTS}, l AS (SELECT *, lag(q) OVER (PARTITION BY series_id ORDER BY t) AS b FROM s) SELECT series_id, count(*) AS n, count(CASE WHEN q < b THEN 1 END) AS n_falls, count(*) >= 4 AND count(CASE WHEN q < b THEN 1 END) = 0 AS looks_sorted FROM l GROUP BY 1")
query(
    "value_classes",
    lambda s, d: series.class_of_value(events(s, d)),
    f"""WITH {_EVENTS}, c AS (SELECT series_id, quantile_cont(q, 0.75) AS a, quantile_cont(q, 0.9) AS b FROM s GROUP BY 1)
    SELECT series_id, CAST(t AS INTEGER) AS t, q, CASE WHEN q >= b THEN 'high' WHEN q >= a THEN 'raised' ELSE 'usual' END AS value_class, (q - m) / sd AS z, CASE WHEN (q - m) / sd >= 1.5 THEN 'extreme' WHEN (q - m) / sd >= 0 THEN 'above' ELSE 'below' END AS anomaly_class,
    abs((q - m) / sd) > 1.645 AS exceeds_90 FROM s JOIN c USING (series_id)""",
    columns="q z",
)
query(
    "summary",
    lambda s, d: moments.summary(events(s, d)),
    f"""WITH {_EVENTS} SELECT series_id, count(*) AS n, min(q) AS min, max(q) AS max, avg(q) AS mean, quantile_cont(q, 0.5) AS median, stddev_samp(q) AS sd, avg(ln(q)) AS log_mean, stddev_samp(ln(q)) AS log_sd,
    strftime(min(block), '%Y-%m-%d %H:%M:%S') AS first_block, strftime(max(block), '%Y-%m-%d %H:%M:%S') AS last_block, stddev_samp(q) / avg(q) AS cv, 100 * stddev_samp(q) / avg(q) AS cv_percent, max(q) / min(q) AS range_ratio FROM s GROUP BY 1""",
    columns="min max mean median sd log_mean log_sd cv cv_percent range_ratio",
)
_MOM = f"""WITH {_EVENTS}, c AS (SELECT series_id, count(*) AS n, avg(q) AS mean, avg(power(q - m, 2)) AS m2, avg(power(q - m, 3)) AS m3, avg(power(q - m, 4)) AS m4 FROM s GROUP BY 1),
e AS (SELECT *, m3 / power(m2, 1.5) AS g1, m4 / power(m2, 2) AS ck FROM c)"""
query(
    "moment_coefficients",
    lambda s, d: moments.moment_coefficients(events(s, d)),
    f"""{_MOM} SELECT series_id, n, mean, sqrt(m2 * n / (n - 1)) AS sd, g1, sqrt(CAST(n * (n - 1) AS DOUBLE)) / (n - 2) * g1 AS skew, ck, ck - 3 AS g2, CAST(n - 1 AS DOUBLE) / ((n - 2) * (n - 3)) * ((n + 1) * (ck - 3) + 6) AS kurtosis_adjusted,
    sqrt(6.0::DOUBLE / n) AS se_skew, sqrt(24.0::DOUBLE / n) AS se_kurtosis FROM e""",
    columns="mean sd g1 skew ck g2 kurtosis_adjusted se_skew se_kurtosis",
)
query(
    "skewness_estimators",
    lambda s, d: moments.skewness_estimators(events(s, d)),
    f"""{_MOM}, r AS (SELECT series_id, {norm_ppf("(rank() OVER (PARTITION BY series_id ORDER BY q) + (count(*) OVER (PARTITION BY series_id, q) - 1) / 2.0::DOUBLE - 0.375::DOUBLE) / (n + 0.25::DOUBLE)")} AS z FROM s),
    rz AS (SELECT series_id, z, avg(z) OVER (PARTITION BY series_id) AS mz FROM r), zs AS (SELECT series_id, avg(power(z - mz, 3)) / power(avg(power(z - mz, 2)), 1.5) AS v FROM rz GROUP BY 1),
    pc AS (SELECT series_id, quantile_cont(q, 0.25) AS a, quantile_cont(q, 0.5) AS b, quantile_cont(q, 0.75) AS c FROM s GROUP BY 1), j AS (SELECT * FROM e JOIN pc USING (series_id))
    SELECT series_id, 'g1' AS estimator, g1 AS value FROM j UNION ALL SELECT series_id, 'skew', sqrt(CAST(n * (n - 1) AS DOUBLE)) / (n - 2) * g1 FROM j UNION ALL SELECT series_id, 'bowley', (c + a - 2 * b) / (c - a) FROM j
    UNION ALL SELECT series_id, 'pearson2', 3 * (mean - b) / sqrt(m2 * n / (n - 1)) FROM j UNION ALL SELECT series_id, 'normal_scores', v FROM zs""",
    columns="value",
)
_LM = "l1 l2 l3 l4 lcv tau3 tau4 b0 b1 b2 b3"
_LMR = """, r AS (SELECT *, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3, 20 * b3 - 30 * b2 + 12 * b1 - b0 AS l4 FROM w), x AS (SELECT *, l2 / l1 AS lcv, l3 / l2 AS tau3, l4 / l2 AS tau4 FROM r)
SELECT *, n >= 20 AND lcv > 0 AND lcv < 2.5 AND abs(tau3) < 1 AND abs(tau4) < 1 AS ratios_reliable FROM x"""
query("lmoments", lambda s, d: moments.lmoments(events(s, d)), f"WITH {_EVENTS}, w AS (SELECT series_id, n, avg(q) AS b0, avg(q * (rank - 1.0::DOUBLE) / (n - 1)) AS b1, avg(q * (rank - 1.0::DOUBLE) / (n - 1) * (rank - 2) / (n - 2)) AS b2, avg(q * (rank - 1.0::DOUBLE) / (n - 1) * (rank - 2) / (n - 2) * (rank - 3) / (n - 3)) AS b3 FROM s GROUP BY 1, 2){_LMR}", columns=_LM)
query("consistent_lmoments", lambda s, d: moments.consistent_lmoments(events(s, d)), f"WITH {_EVENTS}, w AS (SELECT series_id, n, avg(q) AS b0, avg(q * (rank - 0.35::DOUBLE) / n) AS b1, avg(q * power((rank - 0.35::DOUBLE) / n, 2)) AS b2, avg(q * power((rank - 0.35::DOUBLE) / n, 3)) AS b3 FROM s GROUP BY 1, 2){_LMR}", columns=_LM)
query("log_moments", lambda s, d: moments.log_moments(events(s, d)).drop("ck_log"), f"WITH {_EVENTS}, {_LOGFIT} SELECT series_id, n, mean_log, sd_log, skew_log, se_skew FROM f", columns="mean_log sd_log skew_log se_skew")
query("gumbel_moments", lambda s, d: moments.gumbel_moments(events(s, d)), f"WITH {_EVENTS}, g AS (SELECT series_id, avg(q) AS mean, stddev_samp(q) AS sd FROM s GROUP BY 1) SELECT series_id, mean, sd, sd * sqrt(6.0::DOUBLE) / pi() AS beta, mean - {num(0.5772156649015329)} * sd * sqrt(6.0::DOUBLE) / pi() AS mu FROM g", columns="mean sd beta mu")
query(
    "histogram",
    lambda s, d: moments.histogram(events(s, d)),
    f"""WITH {_EVENTS}, g AS (SELECT series_id, min(q) AS lo, CAST(greatest(1, ceil(1 + log2(greatest(count(*), 2)))) AS INTEGER) AS bins, (max(q) - min(q)) / greatest(1, ceil(1 + log2(greatest(count(*), 2)))) AS width FROM s GROUP BY 1),
    c AS (SELECT series_id, CAST(least(floor((q - lo) / width), bins - 1) AS INTEGER) AS bin, count(*) AS count FROM s JOIN g USING (series_id) GROUP BY 1, 2), e AS (SELECT series_id, lo, width, CAST(UNNEST(range(bins)) AS INTEGER) AS bin FROM g)
    SELECT e.series_id, e.bin, lo + e.bin * width AS "left", lo + (e.bin + 1) * width AS "right", coalesce(count, 0) AS count FROM e LEFT JOIN c ON e.series_id = c.series_id AND e.bin = c.bin""",
    columns='"left" "right"',
)
query("percentiles", lambda s, d: moments.percentiles(events(s, d)), " UNION ALL ".join(f"(WITH {_EVENTS} SELECT series_id, {p}::DOUBLE AS p, quantile_cont(q, {p}) AS value FROM s GROUP BY 1)" for p in (0.05, 0.25, 0.5, 0.75, 0.9, 0.95)), columns="p value")
query("season_shape", lambda s, d: moments.group_shape(series.calendar(orders(s, d)), "season"), f"WITH {_ORDERS}, c AS (SELECT *, CASE WHEN month(block) BETWEEN 6 AND 9 THEN 'southwest_monsoon' WHEN month(block) BETWEEN 10 AND 12 THEN 'post_monsoon' WHEN month(block) BETWEEN 3 AND 5 THEN 'pre_monsoon' ELSE 'winter' END AS season FROM s) SELECT series_id, season, count(*) AS n, avg(q) AS mean, stddev_samp(q) AS sd, quantile_cont(q, 0.25) AS q25, quantile_cont(q, 0.5) AS q50, quantile_cont(q, 0.75) AS q75 FROM c GROUP BY 1, 2 HAVING count(*) >= 4", columns="mean sd q25 q50 q75")

_W = "OVER (PARTITION BY series_id ORDER BY t)"
_P5 = "OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_LAGF = f"""x AS (SELECT series_id, CAST(t AS INTEGER) AS t, q, lag(q, 1) {_W} AS lag_1, lag(q, 2) {_W} AS lag_2, lag(q, 3) {_W} AS lag_3, CASE WHEN count(q) {_P5} = 5 THEN avg(q) {_P5} END AS roll_mean, CASE WHEN count(q) {_P5} = 5 THEN stddev_samp(q) {_P5} END AS roll_sd,
CASE WHEN count(q) {_P5} = 5 THEN min(q) {_P5} END AS roll_min, CASE WHEN count(q) {_P5} = 5 THEN max(q) {_P5} END AS roll_max, avg(q) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past_mean FROM s), feat AS (SELECT * FROM x WHERE t >= 6)"""
query("lag_features", lambda s, d: features.lag_features(events(s, d)), f"WITH {_EVENTS}, {_LAGF} SELECT * FROM feat", columns="q lag_1 lag_2 lag_3 roll_mean roll_sd roll_min roll_max past_mean", digits=3)
query("lag_pairs", lambda s, d: features.lag_pairs(events(s, d)), " UNION ALL ".join(f"(WITH {_EVENTS} SELECT series_id, {k} AS lag, CAST(t AS INTEGER) AS t, q AS x, lead(q, {k}) {_W} AS y FROM s QUALIFY y IS NOT NULL)" for k in (1, 2, 3)), columns="x y")
_C5, _C10 = (f"OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)" for a, b in ((2, 2), (5, 4)))
query("centred_rolling", lambda s, d: features.centred(events(s, d)), f"WITH {_EVENTS} SELECT series_id, CAST(t AS INTEGER) AS t, q, CASE WHEN count(q) {_C5} = 5 THEN avg(q) {_C5} END AS mean5, CASE WHEN count(q) {_C5} = 5 THEN stddev_samp(q) {_C5} END AS sd5, CASE WHEN count(q) {_C10} = 10 THEN avg(q) {_C10} END AS mean10, CASE WHEN count(q) {_C10} = 10 THEN var_samp(q) {_C10} END AS var10 FROM s", digits=4, columns="q mean5 sd5 mean10 var10")
query("year_on_year", lambda s, d: features.year_on_year(events(s, d)), f"WITH {_EVENTS} SELECT series_id, CAST(t AS INTEGER) AS t, q, abs(q - coalesce(lag(q) {_W}, q)) / q AS jump FROM s", columns="q jump")
_FEATS = ["q", "lag_1", "lag_2", "lag_3", "roll_mean", "roll_sd", "roll_min", "roll_max", "past_mean"]
query("correlations", lambda s, d: features.correlations(features.lag_features(events(s, d))), f"WITH {_EVENTS}, {_LAGF} " + " UNION ALL ".join(f"SELECT series_id, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM feat GROUP BY 1" for i, a in enumerate(_FEATS) for b in _FEATS[: i + 1]), columns="r")
query("spearman_lag1", lambda s, d: features.spearman_lag1(events(s, d)), f"""WITH {_EVENTS}, l AS (SELECT series_id, q AS x, lead(q) {_W} AS y FROM s QUALIFY y IS NOT NULL),
r AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY x) + (count(*) OVER (PARTITION BY series_id, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY series_id ORDER BY y) + (count(*) OVER (PARTITION BY series_id, y) - 1) / 2.0::DOUBLE AS b FROM l) SELECT series_id, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1""", columns="rho")
query("persistence", lambda s, d: features.persistence(events(s, d)), f"WITH {_EVENTS}, l AS (SELECT series_id, q - lag(q) {_W} AS d FROM s) SELECT series_id, sqrt(avg(d * d)) AS rmse FROM l GROUP BY 1", columns="rmse")
_FOLD = f"""z AS (SELECT series_id, t, q, lag(q) {_W} AS x FROM s QUALIFY x IS NOT NULL), zi AS (SELECT *, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY series_id) AS c FROM z), k AS (SELECT *, UNNEST(range(5)) AS fold FROM zi),
kr AS (SELECT *, c - (5 - fold) * (c // 6) AS beg, c // 6 AS size FROM k), tr AS (SELECT series_id, fold, avg(x) AS mx, avg(q) AS my, covar_pop(x, q) / var_pop(x) AS slope FROM kr WHERE i < beg GROUP BY 1, 2),
te AS (SELECT kr.series_id, CAST(kr.fold AS INTEGER) AS fold, CAST(t AS INTEGER) AS t, q AS y, my + slope * (x - mx) AS p, x AS baseline FROM kr JOIN tr ON kr.series_id = tr.series_id AND kr.fold = tr.fold WHERE i >= beg AND i < beg + size)"""
query("linear_forecast", lambda s, d: features.linear_forecast(events(s, d)), f"WITH {_EVENTS}, {_FOLD} SELECT * FROM te", digits=4, columns="y p baseline")
query("forecast_scores", lambda s, d: features.scores(features.linear_forecast(events(s, d))), f"""WITH {_EVENTS}, {_FOLD}, mm AS (SELECT *, avg(y) OVER (PARTITION BY series_id) AS m FROM te)
SELECT series_id, count(*) AS n, sqrt(avg(power(p - y, 2))) AS rmse, avg(abs(p - y)) AS mae, avg(p - y) AS bias, 1 - sum(power(p - y, 2)) / sum(power(y - m, 2)) AS r2, sqrt(avg(power(p - y, 2))) / stddev_samp(y) AS nrmse, sqrt(avg(power(baseline - y, 2))) AS rmse_baseline,
1 - sqrt(avg(power(p - y, 2))) / sqrt(avg(power(baseline - y, 2))) AS skill FROM mm GROUP BY 1""", digits=4, columns="rmse mae bias r2 nrmse rmse_baseline skill")

_ACF = """a0 AS (SELECT series_id, t, n, q - avg(q) OVER (PARTITION BY series_id) AS d FROM s), a1 AS (SELECT series_id, max(n) AS n, sum(d * d) AS ss FROM a0 GROUP BY 1),
a AS (SELECT x.series_id, x.t - y.t AS lag, a1.n, sum(x.d * y.d) / max(ss) AS rb, sum(x.d * y.d) / max(ss) * a1.n / (a1.n - (x.t - y.t)) AS r FROM a0 x JOIN a0 y ON x.series_id = y.series_id AND x.t > y.t AND x.t - y.t <= 15 JOIN a1 ON x.series_id = a1.series_id WHERE x.t - y.t <= greatest(a1.n // 4, 1) GROUP BY 1, 2, 3)"""
_Z975 = norm_ppf(num(0.975))
query("acf", lambda s, d: dependence.acf_table(events(s, d)), f"WITH {_EVENTS}, {_ACF} SELECT series_id, CAST(lag AS INTEGER) AS lag, n, r, rb AS r_biased, {_Z975} / sqrt(CAST(n AS DOUBLE)) AS band, abs(r) <= {_Z975} / sqrt(CAST(n AS DOUBLE)) AS inside FROM a", columns="r r_biased band")
query(
    "pacf",
    lambda s, d: dependence.pacf(events(s, d)),
    f"""WITH RECURSIVE {_EVENTS}, {_ACF}, l AS (SELECT series_id, list(r ORDER BY lag) AS r FROM a GROUP BY 1), k AS (
      SELECT series_id, 1 AS k, [r[1]] AS phi, r[1] AS p, r FROM l
      UNION ALL SELECT series_id, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - pn * phi[k + 1 - j]), [pn]), pn, r
      FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS pn FROM k WHERE k < len(r))
    ) SELECT series_id, CAST(k AS INTEGER) AS lag, p AS pacf FROM k""",
    columns="pacf",
)
query("effective_size", lambda s, d: dependence.effective_size(events(s, d)), f"""WITH {_EVENTS}, {_ACF}, pr AS (SELECT series_id, (lag - 1) // 2 AS m, sum(r) AS p FROM a GROUP BY 1, 2 HAVING count(*) = 2), st AS (SELECT *, min(CASE WHEN p > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY m) AS on_ FROM pr),
tt AS (SELECT series_id, greatest(1 + 2 * sum(on_ * p), 1) AS tau FROM st GROUP BY 1), o AS (SELECT a.series_id, n, r AS r1, coalesce(tau, 1) AS tau FROM a LEFT JOIN tt USING (series_id) WHERE lag = 1)
SELECT series_id, n, r1, tau, n * (1 - r1) / (1 + r1) AS n_r1, n / tau AS n_tau, least(n * (1 - r1) / (1 + r1), n / tau, n) AS n_effective FROM o""", columns="r1 tau n_r1 n_tau n_effective")
query("first_exceedance", lambda s, d: dependence.first_exceedance(events(s, d)), f"""WITH {_EVENTS}, {_ACF}, e AS (SELECT series_id, min(CASE WHEN abs(r) <= {_Z975} / sqrt(CAST(n AS DOUBLE)) THEN lag END) AS i, min(CASE WHEN r < 0 THEN lag END) AS g, max(lag) AS l FROM a GROUP BY 1)
SELECT e.series_id, CAST(coalesce(i, l + 1) - 1 AS INTEGER) AS exceedance_lag, coalesce(sum(CASE WHEN lag < coalesce(g, l + 1) THEN r END), 0) AS acf_sum FROM e JOIN a USING (series_id) GROUP BY e.series_id, i, l, g""", columns="acf_sum")
query("cross_correlation", lambda s, d: dependence.cross_correlation(events(s, d), events(s, d)), f"""WITH {_EVENTS}, z AS (SELECT series_id, t, q - m AS d FROM s), ss AS (SELECT series_id, sum(d * d) AS v FROM z GROUP BY 1)
SELECT x.series_id, CAST(x.t - y.t AS INTEGER) AS lag, sum(x.d * y.d) / max(v) AS r FROM z x JOIN z y ON x.series_id = y.series_id AND x.t - y.t BETWEEN 0 AND 5 JOIN ss ON x.series_id = ss.series_id GROUP BY 1, 2""", columns="r")
_VG = """z AS (SELECT series_id, t, sum(q - m) OVER (PARTITION BY series_id ORDER BY t) AS x FROM s), v AS (SELECT a.series_id, CAST(b.t - a.t AS INTEGER) AS lag, avg(power(b.x - a.x, 2)) / 2 AS v FROM z a JOIN z b ON a.series_id = b.series_id AND b.t - a.t BETWEEN 1 AND 14 GROUP BY 1, 2)"""
query("variogram", lambda s, d: dependence.variogram(events(s, d)), f"WITH {_EVENTS}, {_VG} SELECT * FROM v", digits=2, columns="v")
query("hurst", lambda s, d: dependence.hurst(events(s, d)), f"WITH {_EVENTS}, {_VG} SELECT series_id, regr_slope(ln(v), ln(lag)) / 2 AS hurst, count(*) AS lags FROM v WHERE lag >= 2 GROUP BY 1", columns="hurst")
query("rescaled_range", lambda s, d: dependence.rescaled_range(events(s, d)), f"""WITH {_EVENTS}, g AS (SELECT series_id, t, q, UNNEST([5, 8, 10, 15]) AS m FROM s), b AS (SELECT *, (t - 1) // m AS g FROM g), c AS (SELECT *, q - avg(q) OVER w AS d, count(*) OVER w AS c, stddev_pop(q) OVER w AS sp FROM b WINDOW w AS (PARTITION BY series_id, m, g)),
y AS (SELECT *, sum(d) OVER (PARTITION BY series_id, m, g ORDER BY t) AS y FROM c WHERE c = m AND sp > 0), o AS (SELECT series_id, m, g, (greatest(max(y), 0) - least(min(y), 0)) / max(sp) AS rs FROM y GROUP BY 1, 2, 3) SELECT series_id, CAST(m AS INTEGER) AS m, avg(rs) AS rs, count(*) AS blocks FROM o GROUP BY 1, 2""", columns="rs")

_MK = """mp AS (SELECT a.series_id, CAST(sum(sign(b.q - a.q)) AS DOUBLE) AS sv FROM s a JOIN s b ON a.series_id = b.series_id AND a.t < b.t GROUP BY 1), tie AS (SELECT series_id, q, CAST(count(*) AS DOUBLE) AS c FROM s GROUP BY 1, 2),
ti AS (SELECT series_id, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS tv, sum(c * (c - 1) / 2) AS tp FROM tie GROUP BY 1), mk AS (SELECT series_id, n, sv AS s, (n * (n - 1) * (2 * n + 5) - tv) / 18 AS var_s, tp FROM ti JOIN mp USING (series_id)),
mz AS (SELECT *, (s - sign(s)) / sqrt(var_s) AS z FROM mk)"""
query("mann_kendall", lambda s, d: trend.mann_kendall(events(s, d)), f"WITH {_EVENTS}, {_MK} SELECT series_id, CAST(n AS BIGINT) AS n, s, var_s, z, {norm_sf2('z')} AS p, s / sqrt((n * (n - 1) / 2 - tp) * (n * (n - 1) / 2)) AS tau FROM mz", columns="s var_s z p tau")
_SEN = f"""sl AS (SELECT a.series_id, (b.q - a.q) / (b.t - a.t) AS b FROM s a JOIN s b ON a.series_id = b.series_id AND a.t < b.t), sg AS (SELECT series_id, count(*) AS pairs, quantile_cont(b, 0.5) AS slope, list_sort(list(b)) AS l FROM sl GROUP BY 1),
sm AS (SELECT series_id, quantile_cont(q, 0.5) AS mq, quantile_cont(t, 0.5) AS mt FROM s GROUP BY 1), sc AS (SELECT series_id, pairs, slope, l, mq - slope * mt AS intercept, CAST(mk.n AS BIGINT) AS n, {_Z975} * sqrt(var_s) AS c FROM sg JOIN sm USING (series_id) JOIN mk USING (series_id))"""
query("theil_sen", lambda s, d: trend.theil_sen(events(s, d)), f"WITH {_EVENTS}, {_MK}, {_SEN} SELECT series_id, n, pairs, slope, intercept, l[CAST(greatest(floor((pairs - c) / 2), 0) AS INTEGER) + 1] AS slope_low, l[CAST(least(ceil((pairs + c) / 2), pairs - 1) AS INTEGER) + 1] AS slope_high FROM sc", columns="slope intercept slope_low slope_high")
query(
    "kendall",
    lambda s, d: trend.kendall(events(s, d)),
    f"""WITH RECURSIVE {_EVENTS}, {_MK}, counts AS (
      SELECT 2 AS m, [CAST(1 AS HUGEINT), CAST(1 AS HUGEINT)] AS c
      UNION ALL SELECT m + 1, list_transform(range(len(c) + m), lambda k: CAST(list_sum(c[greatest(k - m, 0) + 1:least(k, len(c) - 1) + 1]) AS HUGEINT)) FROM counts WHERE m < 30
    ), law AS (
      SELECT m, d, least(1, 2 * CAST(list_sum(c[1:least(d, len(c) - 1 - d) + 1]) AS DOUBLE) / CAST(list_sum(c) AS DOUBLE)) AS p FROM (SELECT m, c, UNNEST(range(len(c))) AS d FROM counts)
    ), k AS (
      SELECT series_id, n, s, tp, var_s, s / sqrt((n * (n - 1) / 2 - tp) * (n * (n - 1) / 2)) AS tau, CAST((n * (n - 1) / 2 - s) / 2 AS BIGINT) AS d, s / sqrt(var_s) AS z FROM mk
    ) SELECT series_id, CAST(n AS BIGINT) AS n, s, tau, CASE WHEN tp = 0 AND law.p IS NOT NULL THEN law.p ELSE {norm_sf2('z')} END AS p, tp = 0 AND law.p IS NOT NULL AS is_exact FROM k LEFT JOIN law ON law.m = k.n AND law.d = k.d""",
    columns="s tau p",
)
query(
    "spearman",
    lambda s, d: trend.spearman(events(s, d)),
    f"""WITH {_EVENTS}, k AS (SELECT series_id, t, q, rank() OVER (PARTITION BY series_id ORDER BY t) + 0.0::DOUBLE AS x, rank() OVER (PARTITION BY series_id ORDER BY q) + (count(*) OVER (PARTITION BY series_id, q) - 1) / 2.0::DOUBLE AS y FROM s),
    g AS (SELECT series_id, count(*) AS n, corr(x, y) AS rho FROM k GROUP BY 1 HAVING count(*) > 8), t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, CAST(n - 2 AS DOUBLE) AS df FROM g)
    SELECT series_id, n, rho, p, false AS is_exact FROM {staged_sql('t', student_steps('t', 'df', 'p', sql_fold))}""",
    columns="rho p",
)
query(
    "hamed_rao",
    lambda s, d: trend.hamed_rao(events(s, d)),
    f"""WITH {_EVENTS}, {_MK}, {_SEN}, y AS (SELECT s.series_id, t, s.n, s.q - slope * t AS y FROM s JOIN sc USING (series_id)),
    k AS (SELECT series_id, t, n, rank() OVER (PARTITION BY series_id ORDER BY y) + (count(*) OVER (PARTITION BY series_id, y) - 1) / 2.0::DOUBLE AS k FROM y), d AS (SELECT *, k - avg(k) OVER (PARTITION BY series_id) AS d FROM k),
    v AS (SELECT series_id, max(n) AS n, sum(d * d) AS ss FROM d GROUP BY 1),
    c AS (SELECT a.series_id, a.t - b.t AS lag, sum(a.d * b.d) / max(ss) AS r FROM d a JOIN d b ON a.series_id = b.series_id AND a.t - b.t BETWEEN 1 AND 10 JOIN v ON v.series_id = a.series_id WHERE a.t - b.t <= greatest(a.n // 4, 1) GROUP BY 1, 2),
    i AS (SELECT c.series_id, greatest(1 + 2.0::DOUBLE / (max(n) * (max(n) - 1) * (max(n) - 2)) * sum(CASE WHEN abs(r) > {_Z975} / sqrt(CAST(n AS DOUBLE)) THEN (n - lag) * (n - lag - 1) * (n - lag - 2) * r ELSE 0 END), 1e-9) AS inflation FROM c JOIN v USING (series_id) GROUP BY 1),
    h AS (SELECT mk.series_id, CAST(mk.n AS BIGINT) AS n, s, inflation, (s - sign(s)) / sqrt(var_s * inflation) AS z FROM mk JOIN i USING (series_id)) SELECT series_id, n, s, inflation, z, {norm_sf2("z")} AS p FROM h""",
    columns="s inflation z p",
)
query(
    "prewhitened",
    lambda s, d: trend.prewhitened(events(s, d)),
    f"""WITH {_EVENTS}, {_MK}, {_SEN}, y AS (SELECT s.series_id, t, block, s.n, slope, s.q - slope * t AS y FROM s JOIN sc USING (series_id)), d AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS d, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS before FROM y),
    r AS (SELECT a.series_id, sum(a.d * b.d) / max(v) * max(a.n) / (max(a.n) - 1) AS r1 FROM d a JOIN d b ON a.series_id = b.series_id AND a.t = b.t + 1 JOIN (SELECT series_id, sum(d * d) AS v FROM d GROUP BY 1) v ON v.series_id = a.series_id GROUP BY 1)
    SELECT series_id, CAST(t AS INTEGER) AS t, {_DAY} AS block, y - r1 * before + slope * t AS q FROM d JOIN r USING (series_id) WHERE before IS NOT NULL""",
    columns="q",
)
query("pettitt", lambda s, d: trend.pettitt(events(s, d)), f"""WITH {_EVENTS}, r AS (SELECT series_id, t, n, rank() OVER (PARTITION BY series_id ORDER BY q) + (count(*) OVER (PARTITION BY series_id, q) - 1) / 2.0::DOUBLE AS k FROM s), u AS (SELECT series_id, t, n, abs(2 * sum(k) OVER (PARTITION BY series_id ORDER BY t) - t * (n + 1)) AS u FROM r)
SELECT series_id, n, CAST(t AS INTEGER) AS change_at, u, least(1, 2 * exp(-6 * u * u / (power(CAST(n AS DOUBLE), 3) + power(CAST(n AS DOUBLE), 2)))) AS p FROM u QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY u DESC, t) = 1""", columns="u p")
query("runs", lambda s, d: trend.runs(events(s, d)), f"""WITH {_EVENTS}, md AS (SELECT series_id, quantile_cont(q, 0.5) AS md FROM s GROUP BY 1), g AS (SELECT series_id, t, sign(q - md) AS g FROM s JOIN md USING (series_id) WHERE q <> md), l AS (SELECT *, CASE WHEN lag(g) {_W} = g THEN 0 ELSE 1 END AS c FROM g),
k AS (SELECT series_id, CAST(sum(CASE WHEN g > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN g < 0 THEN 1 ELSE 0 END) AS DOUBLE) AS b, CAST(sum(c) AS BIGINT) AS runs FROM l GROUP BY 1), e AS (SELECT *, 2 * a * b / (a + b) + 1 AS expected, 2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1)) AS v FROM k),
z AS (SELECT series_id, runs, expected, (runs - expected) / sqrt(v) AS z FROM e) SELECT *, {norm_sf2('z')} AS p FROM z""", columns="expected z p")
query("durbin_watson", lambda s, d: trend.durbin_watson(events(s, d)), f"""WITH {_EVENTS}, l AS (SELECT series_id, q - m AS d, q - lag(q) {_W} AS c FROM s), g AS (SELECT series_id, count(*) AS n, sum(c * c) / sum(d * d) AS dw FROM l GROUP BY 1), z AS (SELECT *, (dw - 2) / sqrt(4.0::DOUBLE / n) AS z FROM g) SELECT *, {norm_sf2('z')} AS p FROM z""", columns="dw z p")
query("ljung_box", lambda s, d: trend.ljung_box(events(s, d), 7), f"""WITH {_EVENTS}, {_ACF}, b AS (SELECT series_id, CAST(lag AS INTEGER) AS lag, n * (n + 2) * sum(rb * rb / (n - lag)) OVER (PARTITION BY series_id ORDER BY lag) AS q FROM a WHERE lag <= 7)
SELECT *, CASE {' '.join(f'WHEN lag = {k} THEN {chi2_sf("q", k)}' for k in range(1, 8))} END AS p FROM b""", columns="q p")
query("jarque_bera", lambda s, d: trend.jarque_bera(events(s, d)), f"{_MOM} SELECT series_id, n, n / 6.0::DOUBLE * (g1 * g1 + power(ck - 3, 2) / 4) AS jb, exp(-n / 6.0::DOUBLE * (g1 * g1 + power(ck - 3, 2) / 4) / 2) AS p FROM e", columns="jb p")
_STD = f"""z0 AS (SELECT series_id, rank, n, (ln(q) - avg(ln(q)) OVER (PARTITION BY series_id)) / stddev_samp(ln(q)) OVER (PARTITION BY series_id) AS z FROM s), z AS (SELECT *, greatest(least({norm_cdf('z')}, 1 - {num(1e-12)}), {num(1e-12)}) AS u FROM z0)"""
query("anderson_darling", lambda s, d: trend.anderson_darling(events(s, d), log=True), f"""WITH {_EVENTS}, {_STD}, g AS (SELECT x.series_id, x.n, -x.n - avg((2 * x.rank - 1) * (ln(x.u) + ln(1 - y.u))) AS a2 FROM z x JOIN z y ON x.series_id = y.series_id AND y.rank = x.n + 1 - x.rank GROUP BY 1, 2)
SELECT series_id, n, a2, a2 * (1 + 0.75::DOUBLE / n + 2.25::DOUBLE / (n * n)) AS a2_adjusted FROM g""", columns="a2 a2_adjusted")
query("kolmogorov_smirnov", lambda s, d: trend.kolmogorov_smirnov(events(s, d), log=True), f"WITH {_EVENTS}, {_STD} SELECT series_id, n, max(greatest(CAST(rank AS DOUBLE) / n - u, u - CAST(rank - 1 AS DOUBLE) / n)) AS d FROM z GROUP BY 1, 2", columns="d")
query(
    "kpss",
    lambda s, d: trend.kpss(events(s, d)),
    f"""WITH {_EVENTS}, {_ACF}, f AS (SELECT series_id, 1 + 2 * sum((1 - lag / (floor(4 * power(n / 100.0::DOUBLE, 0.25::DOUBLE)) + 1)) * rb) AS factor FROM a WHERE lag <= floor(4 * power(n / 100.0::DOUBLE, 0.25::DOUBLE)) AND lag <= 12 GROUP BY 1),
    c AS (SELECT series_id, n, d, sum(d) OVER (PARTITION BY series_id ORDER BY t) AS c FROM a0), g AS (SELECT series_id, max(n) AS n, sum(c * c) AS s2, avg(d * d) AS v FROM c GROUP BY 1),
    k AS (SELECT series_id, n, s2 / nullif(power(CAST(n AS DOUBLE), 2) * v * coalesce(factor, 1), 0) AS stat FROM g LEFT JOIN f USING (series_id))
    SELECT series_id, n, stat, CASE WHEN stat >= 0.739 THEN 0.01::DOUBLE WHEN stat >= 0.463 THEN 0.05::DOUBLE WHEN stat >= 0.347 THEN 0.10::DOUBLE ELSE 1.0::DOUBLE END AS p_at_most FROM k""",
    columns="stat p_at_most",
)
query("adf", lambda s, d: kernels.adf(events(s, d)))

query("rating_curve", lambda s, d: quality.rating_curve(stages(s, d)), f"""WITH {_STAGES}, e AS (SELECT *, greatest(syy * (1 - r2), 0) AS sse FROM c) SELECT series_id, n, b, a, r2, sxx, mx, lo, hi, sqrt(sse / n) AS rmse, sqrt(sse / (n - 2) / sxx) AS se_b, sqrt(sse / (n - 2) * (1.0::DOUBLE / n + mx * mx / sxx)) AS se_a FROM e""", columns="b a r2 sxx mx lo hi rmse se_b se_a")
query("rating_residuals", lambda s, d: quality.rating_residuals(stages(s, d), quality.rating_curve(stages(s, d))), f"""WITH {_STAGES}, e AS (SELECT *, sqrt(greatest(syy * (1 - r2), 0) / n) AS rmse FROM c), x AS (SELECT p.series_id, CAST(row_number() OVER (PARTITION BY p.series_id ORDER BY block) AS INTEGER) AS t, log10(q) - a - b * log10(h) AS residual, 1.0::DOUBLE / n + power(log10(h) - mx, 2) / sxx AS leverage, rmse, n FROM p JOIN e USING (series_id)),
y AS (SELECT series_id, t, residual, leverage, residual / (rmse * sqrt(CAST(n AS DOUBLE) / (n - 2)) * sqrt(1 - leverage)) AS studentised FROM x) SELECT *, abs(studentised) > 2 AS is_outlier FROM y""", columns="residual leverage studentised")
query("quality_checks", lambda s, d: quality.checks(events(s, d)), f"""WITH {_EVENTS}, j AS (SELECT *, abs(q - coalesce(lag(q) {_W}, q)) / q AS jump, epoch(block) - epoch(lag(block) {_W}) AS gap, max(q) OVER (PARTITION BY series_id) AS top FROM s),
g AS (SELECT series_id, count(*) AS n, count(DISTINCT block) AS blocks, count(*) - count(q) AS nulls, min(q) AS least_, stddev_samp(q) / avg(q) AS cv, count(CASE WHEN gap <> 86400 THEN 1 END) AS gaps, count(CASE WHEN jump > 0.75 THEN 1 END) AS jumps, count(CASE WHEN q = top AND isfinite(CAST(top AS DOUBLE)) THEN 1 END) AS places FROM j GROUP BY 1)
SELECT series_id, 'record_length' AS "check", CASE WHEN n >= 30 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(n AS DOUBLE) AS value FROM g UNION ALL SELECT series_id, 'values_numeric', CASE WHEN nulls = 0 THEN 'PASS' ELSE 'FAIL' END, nulls FROM g UNION ALL SELECT series_id, 'record_contiguous', CASE WHEN gaps = 0 THEN 'PASS' ELSE 'FAIL' END, gaps FROM g
UNION ALL SELECT series_id, 'blocks_unique', CASE WHEN blocks = n THEN 'PASS' ELSE 'FAIL' END, n - blocks FROM g UNION ALL SELECT series_id, 'values_positive', CASE WHEN least_ > 0 THEN 'PASS' ELSE 'FAIL' END, least_ FROM g UNION ALL SELECT series_id, 'dispersion_plausible', CASE WHEN cv BETWEEN 0.4 AND 2.5 THEN 'PASS' ELSE 'WARN' END, cv FROM g
UNION ALL SELECT series_id, 'maximum_consistent', CASE WHEN places = 1 THEN 'PASS' ELSE 'FAIL' END, places FROM g UNION ALL SELECT series_id, 'no_extreme_jumps', CASE WHEN jumps = 0 THEN 'PASS' ELSE 'WARN' END, jumps FROM g""", columns="value")
query("grubbs", lambda s, d: quality.grubbs(events(s, d)), f"""WITH {_EVENTS}, b AS (SELECT series_id, CAST(n AS DOUBLE) AS n, abs(q - m) / sd AS g, CAST(t AS INTEGER) AS t, q FROM s QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY abs(q - m) / sd DESC, t) = 1), c AS (SELECT *, {t_ppf_upper('CAST(0.05 AS DOUBLE) / (2 * n)', '(n - 2)')} AS tc FROM b),
d AS (SELECT *, (n - 1) / sqrt(n) * sqrt(tc * tc / (n - 2 + tc * tc)) AS critical FROM c) SELECT series_id, CAST(n AS BIGINT) AS n, g, t, q, critical, g > critical AS is_outlier FROM d""", columns="g q critical")
_R10 = ", ".join(f"({n}, {num(v)})" for n, v in quality.DIXON_R10.items())
query(
    "dixon",
    lambda s, d: quality.dixon(events(s, d)),
    f"""WITH {_EVENTS}, x AS (SELECT series_id, CAST(max(n) AS INTEGER) AS n, max(CASE WHEN rank = 1 THEN q END) AS x1, max(CASE WHEN rank = 2 THEN q END) AS x2, max(q) AS xn FROM s GROUP BY 1), c AS (SELECT * FROM (VALUES {_R10}) t(n, critical))
    SELECT series_id, x.n, (x2 - x1) / nullif(xn - x1, 0) AS r10, critical, CASE WHEN critical IS NOT NULL THEN (x2 - x1) / nullif(xn - x1, 0) > critical END AS is_outlier FROM x LEFT JOIN c ON c.n = x.n""",
    columns="r10 critical",
)
query("order_screen", lambda s, d: quality.order_screen(events(s, d)), f"""WITH {_EVENTS}, z AS (SELECT series_id, CAST(t AS INTEGER) AS t, CAST(rank AS INTEGER) AS rank, n, q, ln(q) AS y, {norm_ppf('rank / (n + CAST(1.0 AS DOUBLE))')} AS z FROM s), l AS (SELECT series_id, regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM z WHERE rank / (n + 1.0::DOUBLE) BETWEEN 0.25 AND 0.75 GROUP BY 1),
r AS (SELECT z.*, y - a - b * z AS residual FROM z JOIN l USING (series_id)), e AS (SELECT *, residual / stddev_samp(residual) OVER (PARTITION BY series_id) AS std_residual FROM r)
SELECT series_id, t, rank, q, z, residual, std_residual, row_number() OVER (PARTITION BY series_id ORDER BY round(abs(std_residual), 9) DESC, rank) <= 2 AS is_candidate FROM e""", columns="q z residual std_residual")
query("lowest", lambda s, d: quality.lowest(events(s, d)), f"WITH {_EVENTS} SELECT series_id, CAST(rank AS INTEGER) AS rank, CAST(t AS INTEGER) AS t, q FROM s WHERE rank <= 3", columns="q")

query("closed_fits", lambda s, d: frequency.closed_fits(events(s, d)), f"WITH {_EVENTS}, {_FITS} SELECT series_id, n, family, k, p1, p2 FROM fits", columns="p1 p2")
query("family_quantiles", lambda s, d: frequency.periods(frequency.closed_fits(events(s, d))).withColumn("q", frequency.quantile()).select("series_id", "family", "period", "q"), f"WITH {_EVENTS}, {_FITS}, t AS (SELECT *, {_PERIODS} AS period FROM fits) SELECT series_id, family, period, {_Q} AS q FROM t", columns="period q")
_LD = f"CASE WHEN family = 'exponential' THEN -ln(p1) - q / p1 WHEN family = 'ln2' THEN -ln(q) - ln(p2) - {num(0.9189385332046727)} - power((ln(q) - p1) / p2, 2) / 2 ELSE -ln(p2) - (q - p1) / p2 - exp(-(q - p1) / p2) END"
_CDF = f"CASE WHEN family = 'exponential' THEN 1 - exp(-q / p1) WHEN family = 'ln2' THEN {norm_cdf('((ln(q) - p1) / p2)')} ELSE exp(-exp(-(q - p1) / p2)) END"
_RANKING = f"""WITH {_EVENTS}, {_FITS}, u AS (SELECT s.series_id, s.rank, s.q, fits.n, family, k, p1, p2, greatest(least({_CDF}, 1 - {num(1e-12)}), {num(1e-12)}) AS u, {_LD} AS ld FROM s JOIN fits ON s.series_id = fits.series_id),
gd AS (SELECT series_id, family, n, k, p1, p2, sum(ld) AS loglik, max(greatest(CAST(rank AS DOUBLE) / n - u, u - CAST(rank - 1 AS DOUBLE) / n)) AS ks, -n - avg((2 * rank - 1) * ln(u) + (2 * n + 1 - 2 * rank) * ln(1 - u)) AS a2, min(u) AS u_min, max(u) AS u_max, max(q) AS q_max FROM u GROUP BY 1, 2, 3, 4, 5, 6),
ic AS (SELECT *, 2 * k - 2 * loglik AS aic, k * ln(n) - 2 * loglik AS bic, 2 * k * ln(ln(n)) - 2 * loglik AS hqic, 2 * k - 2 * loglik + 2.0::DOUBLE * k * (k + 1) / (n - k - 1) AS aicc, 1000.0::DOUBLE AS period FROM gd),
gt AS (SELECT *, NOT (coalesce(p2 <= 0, false) OR (family = 'exponential' AND p1 <= 0) OR u_min < 0.005::DOUBLE / n OR u_max > 1 - 0.005::DOUBLE / n OR {_Q} < q_max * 0.5 OR ks > 1.358 / sqrt(n)) AS accepted FROM ic)
SELECT series_id, family, loglik, ks, a2, aic, bic, hqic, aicc, accepted, CASE WHEN accepted THEN CAST(rank() OVER (PARTITION BY series_id, accepted ORDER BY round(aicc, 9)) AS INTEGER) END AS rank,
CASE WHEN accepted THEN exp(-(aicc - min(aicc) OVER (PARTITION BY series_id, accepted)) / 2) / sum(exp(-(aicc - mn) / 2)) OVER (PARTITION BY series_id, accepted) END AS weight FROM (SELECT *, min(aicc) OVER (PARTITION BY series_id, accepted) AS mn FROM gt)"""
query("ranking", lambda s, d: frequency.ranking(events(s, d)).select("series_id", "family", "loglik", "ks", "a2", "aic", "bic", "hqic", "aicc", "accepted", "rank", "weight"), _RANKING, digits=4, columns="loglik ks a2 aic bic hqic aicc weight")
_LP3 = f"""lt AS (SELECT *, {_PERIODS} AS period FROM f), lk AS (SELECT *, {_wh('skew_log', '(1 - 1 / period)')} AS factor FROM lt), lq AS (SELECT *, exp(mean_log + factor * sd_log) AS q, sd_log * sqrt(greatest(1 + factor * factor / 2 * (1 + 3 * skew_log * skew_log / 4) + factor * skew_log, 0) / n) AS se FROM lk)"""
query("lp3", lambda s, d: frequency.lp3(events(s, d)), f"WITH {_EVENTS}, {_LOGFIT}, {_LP3} SELECT series_id, period, n, mean_log, sd_log, skew_log, factor, q, se, q * exp(-{_Z975} * se) AS q_low, q * exp({_Z975} * se) AS q_high FROM lq", digits=4, columns="period mean_log sd_log skew_log factor q se q_low q_high")
query("skew_decision", lambda s, d: frequency.skew_decision(events(s, d)), f"WITH {_EVENTS}, {_LOGFIT}, z AS (SELECT series_id, skew_log, abs(skew_log) / se_skew AS z FROM f) SELECT series_id, skew_log, z, 1 - {norm_cdf('z')} AS tail, z < 1 AS within, abs(skew_log) >= 0.9 AS kurtosis_governed FROM z", columns="skew_log z tail")
query("skew_band", lambda s, d: frequency.skew_band(events(s, d)), f"""WITH {_EVENTS}, {_LOGFIT}, h AS (SELECT *, 1.96::DOUBLE * se_skew AS h FROM f), g AS (SELECT *, UNNEST(range(CAST(floor(2 * h / 0.05::DOUBLE) AS INTEGER) + 2)) AS i FROM h), k AS (SELECT DISTINCT * EXCLUDE i, round(least(skew_log + h, skew_log - h + 0.05::DOUBLE * i), 6) AS skew FROM g), t AS (SELECT *, {_PERIODS} AS period FROM k)
SELECT series_id, skew, period, exp(mean_log + ({_wh('skew', '(1 - 1 / period)')}) * sd_log) AS q, exp(mean_log + ({_wh('skew', '(1 - 1 / period)')}) * sd_log) / exp(mean_log + ({_wh('skew_log', '(1 - 1 / period)')}) * sd_log) AS ratio FROM t""", digits=3, columns="skew period q ratio")
_DESIGN = f"""WITH {_EVENTS}, {_LOGFIT}, {_LP3}, {_FITS}, fq AS (SELECT series_id, family, period, {_Q} AS q FROM (SELECT *, {_PERIODS} AS period FROM fits)), wide AS (SELECT series_id, period, max(CASE WHEN family = 'gumbel_mom' THEN q END) AS gumbel_mom, max(CASE WHEN family = 'gumbel_lmom' THEN q END) AS gumbel_lmom, max(CASE WHEN family = 'ln2' THEN q END) AS ln2, max(CASE WHEN family = 'exponential' THEN q END) AS exponential FROM fq GROUP BY 1, 2)
SELECT series_id, period, q AS lp3, q * exp(-{_Z975} * se) AS q_low, q * exp({_Z975} * se) AS q_high, gumbel_mom, gumbel_lmom, ln2, exponential, greatest(q, gumbel_mom, ln2) - least(q, gumbel_mom, ln2) AS spread, 100 * (greatest(q, gumbel_mom, ln2) - least(q, gumbel_mom, ln2)) / q AS spread_percent FROM lq JOIN wide USING (series_id, period)"""
query("design_values", lambda s, d: frequency.design_values(events(s, d)), _DESIGN, digits=3, columns="period lp3 q_low q_high gumbel_mom gumbel_lmom ln2 exponential spread spread_percent")
query("design_levels", lambda s, d: frequency.design_levels(frequency.design_values(stages(s, d)), quality.rating_curve(stages(s, d))))
query(
    "gev_lmoments",
    lambda s, d: frequency.gev_lmoments(events(s, d)),
    f"""WITH {_EVENTS}, b AS (SELECT series_id, max(n) AS n, avg(q) AS b0, avg(q * (rank - 1) / (n - 1)) AS b1, avg(q * (rank - 1) * (rank - 2) / ((n - 1) * (n - 2))) AS b2 FROM s GROUP BY 1),
    l AS (SELECT series_id, n, b0 AS l1, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS tau3 FROM b), c AS (SELECT *, 2 / (3 + tau3) - ln(2.0::DOUBLE) / ln(3.0::DOUBLE) AS c FROM l WHERE l2 > 0)
    SELECT series_id, n, l1, l2, tau3, 7.8590::DOUBLE * c + 2.9554::DOUBLE * c * c AS shape FROM c""",
    columns="l1 l2 tau3 shape",
)
query("checklist", lambda s, d: quality.checklist(quality.checks(events(s, d)), moments.log_moments(events(s, d)), frequency.ranking(events(s, d))))

_OVER = f"{_BASE}, th AS (SELECT series_id, quantile_cont(x, 0.9) AS u, count(*) AS n_base FROM b GROUP BY 1), o AS (SELECT b.series_id, x, u, n_base, x - u AS y FROM b JOIN th USING (series_id) WHERE x > u)"
_GPD = "oi AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y, x) AS i, count(*) OVER (PARTITION BY series_id) AS c FROM o), pw AS (SELECT series_id, max(u) AS u, max(n_base) AS n_base, count(*) AS n, avg(y) AS a0, avg(y * (c - i) / (c - 1)) AS a1 FROM oi GROUP BY 1), gp AS (SELECT series_id, u, n_base, n, 2 - a0 / (a0 - 2 * a1) AS xi, 2 * a0 * a1 / (a0 - 2 * a1) AS beta, CAST(n AS DOUBLE) / n_base AS rate FROM pw)"
query("exceedances", lambda s, d: thresholds.exceedances(base(s, d)).select("series_id", "x", "u", "n_base", "y"), f"WITH {_OVER} SELECT series_id, x, u, n_base, y FROM o", columns="x u y")
query(
    "declustered",
    lambda s, d: thresholds.declustered(base(s, d), 50.0),
    f"""WITH {_BASE}, o AS (SELECT series_id, ts, x, CASE WHEN ts >= lag(ts) OVER (PARTITION BY series_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM b WHERE x > 50 AND ts IS NOT NULL),
    r AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT series_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, max(x) AS x, count(*) AS n FROM r GROUP BY series_id, run""",
    columns="x",
)
query("mean_residual_life", lambda s, d: thresholds.mean_residual_life(base(s, d)), f"""WITH {_BASE}, g AS (SELECT series_id, min(x) AS lo, quantile_cont(x, 0.92) AS hi FROM b GROUP BY 1), t AS (SELECT *, CAST(UNNEST(range(40)) AS INTEGER) AS k FROM g), tu AS (SELECT series_id, k, lo + (hi - lo) * k / 39.0::DOUBLE AS u FROM t),
m AS (SELECT tu.series_id, k, u, count(*) AS n, avg(x - u) AS me, stddev_samp(x - u) AS sd FROM tu JOIN b ON tu.series_id = b.series_id AND x > u GROUP BY 1, 2, 3) SELECT series_id, k, u, n, CASE WHEN n >= 5 THEN me END AS mean_excess, CASE WHEN n >= 5 THEN sd END AS sd, CASE WHEN n >= 5 THEN me - {_Z975} * sd / sqrt(n) END AS low, CASE WHEN n >= 5 THEN me + {_Z975} * sd / sqrt(n) END AS high FROM m""", digits=4, columns="u mean_excess sd low high")
query("gpd_pwm", lambda s, d: thresholds.gpd_pwm(thresholds.counted_exceedances(base(s, d))), f"WITH {_OVER}, {_GPD} SELECT * FROM gp", columns="u xi beta rate")
query("return_levels", lambda s, d: thresholds.return_levels(thresholds.gpd_pwm(thresholds.counted_exceedances(base(s, d))), 100.0), f"WITH {_OVER}, {_GPD}, t AS (SELECT *, {_PERIODS} AS period FROM gp) SELECT series_id, period, CASE WHEN abs(xi) < 1e-8 THEN u + beta * ln(period * rate * 100) ELSE u + beta / xi * (power(period * rate * 100, xi) - 1) END AS q FROM t", digits=3, columns="period q")
query(
    "threshold_stability",
    lambda s, d: thresholds.threshold_stability(base(s, d)),
    f"""WITH {_BASE}, u AS (SELECT series_id, UNNEST([0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS "at", UNNEST(quantile_cont(x, [0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS u FROM b GROUP BY series_id),
    o AS (SELECT u.series_id, "at", u, x - u AS y, row_number() OVER (PARTITION BY u.series_id, "at" ORDER BY x) AS i, count(*) OVER (PARTITION BY u.series_id, "at") AS n FROM b JOIN u ON b.series_id = u.series_id AND x > u),
    p AS (SELECT series_id, "at", u, n, avg(y) AS a0, avg(y * (n - i) / (n - 1)) AS a1 FROM o GROUP BY ALL HAVING n >= 10)
    SELECT series_id, "at", u, n, 2 - a0 / (a0 - 2 * a1) AS xi, 2 * a0 * a1 / (a0 - 2 * a1) AS beta, a0 AS mean_excess, a0 + 6 * a0 / sqrt(n) AS penalty FROM p""",
    columns="at u xi beta mean_excess penalty",
)
query(
    "jenkinson_collison",
    lambda s, d: peaks.jenkinson_collison(events(s, d).select("series_id", F.col("q").alias("x"))),
    f"""WITH {_EVENTS}, k AS (SELECT series_id, n, rank AS k, q AS z FROM s WHERE rank BETWEEN greatest(2, CAST(floor(0.05::DOUBLE * n) AS BIGINT)) AND greatest(3, CAST(floor(0.95::DOUBLE * n) AS BIGINT)) AND n - rank >= 3 AND n >= 10),
    y AS (SELECT k.series_id, k.k, k.z, q - k.z AS y, s.rank - k.k AS i, k.n - k.k AS m, avg(q - k.z) OVER (PARTITION BY k.series_id, k.k) AS mean FROM k JOIN s ON s.series_id = k.series_id AND s.rank > k.k),
    d AS (SELECT series_id, k, z, m, sum(power(y + ln(1 - i / (m + 1.0::DOUBLE)) * mean, 2)) AS d FROM y WHERE mean > 0 GROUP BY 1, 2, 3, 4)
    SELECT series_id, CAST(k AS INTEGER) AS k, z AS threshold, CAST(m AS BIGINT) AS n, d AS distance FROM d QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(d, 9), k) = 1""",
    digits=3,
    columns="threshold distance",
)
query("penalty_scan", lambda s, d: peaks.penalty_scan(events(s, d).select("series_id", F.col("q").alias("x"))), digits=3)
query("gated_peaks", lambda s, d: peaks.gated_fit(events(s, d).select("series_id", F.col("q").alias("x"))), digits=2)
query("gpd_profile", lambda s, d: kernels.gpd_profile(thresholds.exceedances(base(s, d), 0.95)))

_SID = "CAST(('0x' || substr(md5(series_id), 1, 7)) AS BIGINT)"
_HASH = hash_bits("rep", "i", f"20250101 + {_SID}", "xor({0}, {1})", "(({0}) >> {1})")
query(
    "bootstrap_moments",
    lambda s, d: resampling.moment_replicates(events(s, d), 50),
    f"""WITH {_EVENTS}, g AS (SELECT series_id, n, UNNEST(range(50)) AS rep FROM (SELECT DISTINCT series_id, n FROM s)), i AS (SELECT *, UNNEST(range(n)) AS i FROM g), r AS (SELECT series_id, rep, ({_HASH}) % n + 1 AS t FROM i),
    x AS (SELECT r.series_id, rep, q, q - avg(q) OVER (PARTITION BY r.series_id, rep) AS c FROM r JOIN s ON r.series_id = s.series_id AND r.t = s.t)
    SELECT series_id, rep, avg(q) AS mean, stddev_samp(q) AS sd, avg(power(c, 3)) / power(avg(c * c), 1.5::DOUBLE) AS skew, avg(power(c, 4)) / power(avg(c * c), 2) - 3 AS kurtosis, stddev_samp(q) / avg(q) AS cv FROM x GROUP BY 1, 2""",
    digits=4,
    columns="mean sd skew kurtosis cv",
)
query("bootstrap_moments_whole", lambda s, d: resampling.moment_replicates(events(s, d)), ORACLE["bootstrap_moments"].replace("range(50)", "range(2000)"), digits=4)
_CASES = f"""cg AS (SELECT series_id, n, UNNEST(range(2000)) AS rep FROM (SELECT DISTINCT series_id, n FROM s)), ci AS (SELECT *, UNNEST(range(n)) AS i FROM cg), cr AS (SELECT series_id, rep, ({_HASH}) % n + 1 AS t FROM ci),
cx AS (SELECT cr.series_id, rep, quantile_cont(q, [1 - 1 / 2.0, 1 - 1 / 5.0, 1 - 1 / 10.0, 1 - 1 / 25.0, 1 - 1 / 50.0, 1 - 1 / 100.0, 1 - 1 / 200.0, 1 - 1 / 500.0, 1 - 1 / 1000.0]) AS p FROM cr JOIN s ON cr.series_id = s.series_id AND cr.t = s.t GROUP BY 1, 2),
cq AS (SELECT series_id, {_PERIODS} AS period, UNNEST(p) AS q FROM cx)"""
query(
    "bootstrap_intervals",
    lambda s, d: resampling.percentile_interval(resampling.quantile_replicates(resampling.case_resamples(events(s, d)))),
    f"WITH {_EVENTS}, {_CASES} SELECT series_id, period, count(*) AS reps, quantile_cont(q, 0.025) AS low, quantile_cont(q, 0.5) AS median, quantile_cont(q, 0.975) AS high FROM cq GROUP BY 1, 2",
    columns="period low median high",
)
_HASH_T = hash_bits("rep", "i", f"20250104 + {_SID}", "xor({0}, {1})", "(({0}) >> {1})")
_ZLEVEL = num(1.959963984540054)
query(
    "ln2_intervals",
    lambda s, d: parents.ln2_intervals(events(s, d)),
    f"""WITH {_EVENTS}, {_CASES}, f AS (SELECT series_id, count(*) AS n, avg(ln(q)) AS p1, stddev_samp(ln(q)) AS p2 FROM s GROUP BY 1), g AS (SELECT *, UNNEST(range(2000)) AS rep FROM f), i AS (SELECT *, UNNEST(range(n)) AS i FROM g), u AS (SELECT *, (({_HASH_T}) + 0.5::DOUBLE) / 2147483648.0::DOUBLE AS u FROM i),
    x AS (SELECT series_id, rep, quantile_cont(exp(p1 + p2 * {norm_ppf("u")}), [1 - 1 / 2.0, 1 - 1 / 5.0, 1 - 1 / 10.0, 1 - 1 / 25.0, 1 - 1 / 50.0, 1 - 1 / 100.0, 1 - 1 / 200.0, 1 - 1 / 500.0, 1 - 1 / 1000.0]) AS p FROM u GROUP BY 1, 2),
    pt AS (SELECT *, {_PERIODS} AS period FROM f), po AS (SELECT series_id, period, exp(p1 + p2 * {norm_ppf("(1 - 1 / period)")}) AS point FROM pt),
    q AS (SELECT series_id, rep, {_PERIODS} AS period, UNNEST(p) AS q FROM x), b AS (SELECT q.*, point, count(*) OVER w AS m, row_number() OVER (PARTITION BY q.series_id, q.period ORDER BY q) AS k, (sum(CASE WHEN q < point THEN 1 ELSE 0 END) OVER w + 0.5::DOUBLE) / (count(*) OVER w + 1) AS share FROM q JOIN po USING (series_id, period) WINDOW w AS (PARTITION BY q.series_id, q.period)),
    z AS (SELECT *, {norm_ppf("share")} AS z0 FROM b), l AS (SELECT *, {norm_cdf(f"(2 * z0 - {_ZLEVEL})")} AS lo, {norm_cdf(f"(2 * z0 + {_ZLEVEL})")} AS hi FROM z),
    e AS (SELECT series_id, period, max(point) AS point, min(CASE WHEN k >= greatest(ceil(lo * m), 1) THEN q END) AS ci_low, min(CASE WHEN k >= greatest(ceil(hi * m), 1) THEN q END) AS ci_high, quantile_cont(q, 0.025) AS percentile_low, quantile_cont(q, 0.975) AS percentile_high FROM l GROUP BY 1, 2),
    c AS (SELECT series_id, period, quantile_cont(q, 0.025) AS case_low, quantile_cont(q, 0.975) AS case_high FROM cq GROUP BY 1, 2)
    SELECT series_id, period, point, ci_low, ci_high, percentile_low, percentile_high, case_low, case_high, (ci_high - ci_low) / greatest(abs(point), 1e-9) AS relative_width FROM e JOIN c USING (series_id, period)""",
    digits=3,
    columns="period point ci_low ci_high percentile_low percentile_high case_low case_high relative_width",
)
query("family_intervals", lambda s, d: parents.intervals(candidates.ranking(events(s, d)).filter("is_best")), digits=2)
query("lp3_intervals", lambda s, d: resampling.lp3_intervals(events(s, d)))
query("monte_carlo_fan", lambda s, d: resampling.fan(events(s, d)))
query("coverage", lambda s, d: resampling.coverage(events(s, d)))
_HASH_B = hash_bits("rep", "(i // 5)", f"20250103 + {_SID}", "xor({0}, {1})", "(({0}) >> {1})")
query(
    "block_bootstrap",
    lambda s, d: resampling.block_resamples(events(s, d)),
    f"""WITH {_EVENTS}, g AS (SELECT series_id, n, UNNEST(range(2000)) AS rep FROM (SELECT DISTINCT series_id, n FROM s)), i AS (SELECT *, UNNEST(range(n)) AS i FROM g), r AS (SELECT series_id, rep, i, (({_HASH_B}) % n + i % 5) % n + 1 AS at FROM i)
    SELECT r.series_id, rep, CAST(i AS INTEGER) AS t, q FROM r JOIN s ON s.series_id = r.series_id AND s.t = r.at""",
    columns="q",
)
_FITTED = ["series_id", "family", "n", "k", "p1", "p2", "p3", "loglik", "aic", "bic", "aicc", "hqic", "ks", "ks_p", "a2", "a2_p", "qq_r2", "accepted", "rank", "weight", "place"]
query("searched_fits", lambda s, d: candidates.ranking(events(s, d)).select(*_FITTED), digits=3)
query("family_curves", lambda s, d: candidates.curves(candidates.ranking(events(s, d))), digits=2)
query("family_matrix", lambda s, d: candidates.quantile_matrix(candidates.ranking(events(s, d))), digits=2)
query("fit_residuals", lambda s, d: candidates.residuals(events(s, d), candidates.ranking(events(s, d))), digits=4)
query(
    "moment_loci",
    lambda s, d: candidates.loci(s).unionByName(moments.moment_coefficients(events(s, d)).select(F.concat(F.lit("record "), "series_id").alias("family"), F.lit(None).cast("double").alias("shape"), F.col("skew").alias("cs"), "ck")),
)
query("nearest_locus", lambda s, d: candidates.nearest_locus(moments.moment_coefficients(events(s, d)).select("series_id", F.col("skew").alias("cs"), "ck"), candidates.loci(s)))
query("test_battery", lambda s, d: battery.tests(events(s, d)), digits=4)
query("test_warnings", lambda s, d: battery.warnings(moments.skewness_estimators(events(s, d)), moments.moment_coefficients(events(s, d))))
query("monte_carlo_refit", lambda s, d: uncertainty.monte_carlo(events(s, d)), digits=3)
query("combined_intervals", lambda s, d: uncertainty.combined_intervals(events(s, d), 500), digits=3)
query("parameter_spread", lambda s, d: uncertainty.parameter_spread(events(s, d)), digits=4)
query("hurst_spread", lambda s, d: uncertainty.hurst_spread(events(s, d)), digits=4)
query(
    "hurst_rs",
    lambda s, d: dependence.hurst_rs(events(s, d)),
    ORACLE["rescaled_range"].split(" FROM (", 1)[1].rsplit(")", 1)[0].replace("SELECT series_id, CAST(m AS INTEGER) AS m, avg(rs) AS rs, count(*) AS blocks FROM o GROUP BY 1, 2", "SELECT series_id, regr_slope(ln(rs), ln(CAST(m AS DOUBLE))) AS hurst, count(*) AS sizes FROM (SELECT series_id, m, avg(rs) AS rs FROM o GROUP BY 1, 2) WHERE rs > 0 GROUP BY 1"),
    columns="hurst",
)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The stages as station records, each month a block of its own year."""
    df = stages(spark, sf).withColumn("block", F.make_timestamp(F.lit(1900) + F.col("t"), F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return df.select("series_id", "t", "block", "q", F.col("h").alias("wl"), F.lit(None).cast("string").alias("label"), F.col("block").cast("date").alias("peak_date"), F.lit(True).alias("is_monsoon"))


def station_meta(spark: SparkSession, sf: str) -> DataFrame:
    top = stages(spark, sf).groupBy("series_id").agg(F.max(F.struct("h", "q")).alias("x"), F.count(F.lit(1)).alias("expected"))
    return top.select("series_id", F.lit(0.0).alias("datum"), F.col("x.h").alias("observed_level"), F.col("x.q").alias("observed_flow"), F.lit(False).alias("is_derived"), "expected")


query("station_checks", lambda s, d: station.checks(records(s, d), station_meta(s, d)), digits=4)
_KDE = """g AS (SELECT series_id, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * power(CAST(count(*) AS DOUBLE), -0.2::DOUBLE) AS h FROM v GROUP BY 1 HAVING stddev_samp(v) > 0),
    p AS (SELECT v.series_id, (v - lo) / (hi - lo) * 4095 AS p, least(floor((v - lo) / (hi - lo) * 4095), 4094) AS c FROM v JOIN g USING (series_id)),
    cells AS (SELECT series_id, c, sum(w) AS w FROM (SELECT series_id, c, 1 - (p - c) AS w FROM p UNION ALL SELECT series_id, c + 1, p - c FROM p) GROUP BY 1, 2),
    gr AS (SELECT *, CAST(UNNEST(range(400)) AS INTEGER) AS i FROM g), gx AS (SELECT *, lo + (hi - lo) * i / 399.0::DOUBLE AS x FROM gr),
    kd AS (SELECT gx.series_id, i, x, sum(w * exp(-0.5::DOUBLE * power((x - (lo + (hi - lo) * c / 4095.0::DOUBLE)) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS density FROM gx JOIN cells ON cells.series_id = gx.series_id GROUP BY 1, 2, 3)"""
query(
    "density",
    lambda s, d: densities.density(events(s, d)),
    f"""WITH {_EVENTS}, v AS (SELECT series_id, ln(q) AS v FROM s), {_KDE}, ec AS (SELECT gx.series_id, i, CAST(count(CASE WHEN v <= x THEN 1 END) AS DOUBLE) / max(n) AS ecdf FROM gx JOIN v ON v.series_id = gx.series_id GROUP BY 1, 2)
    SELECT series_id, i, x, exp(x) AS q, density, ecdf FROM kd JOIN ec USING (series_id, i)""",
    columns="x q density ecdf",
)
query(
    "density_summary",
    lambda s, d: densities.density_summary(events(s, d)),
    f"""WITH {_EVENTS}, v AS (SELECT series_id, ln(q) AS v FROM s), {_KDE}, c AS (SELECT series_id, count(*) AS n, avg(power(v - mv, 2)) AS m2, avg(power(v - mv, 3)) AS m3, avg(power(v - mv, 4)) AS m4 FROM (SELECT *, avg(v) OVER (PARTITION BY series_id) AS mv FROM v) GROUP BY 1),
    md AS (SELECT series_id, x AS mode_log FROM kd QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(density, 9) DESC, i) = 1)
    SELECT series_id, c.n, sqrt(CAST(c.n * (c.n - 1) AS DOUBLE)) / (c.n - 2) * m3 / power(m2, 1.5) AS skew, CAST(c.n - 1 AS DOUBLE) / ((c.n - 2) * (c.n - 3)) * ((c.n + 1) * (m4 / power(m2, 2) - 3) + 6) AS kurtosis, h AS bandwidth, mode_log, exp(mode_log) AS mode
    FROM c JOIN g USING (series_id) JOIN md USING (series_id)""",
    columns="skew kurtosis bandwidth mode_log mode",
)
query(
    "density_comparison",
    lambda s, d: densities.density_comparison(events(s, d)),
    f"""WITH {_EVENTS}, {_LOGFIT}, v AS (SELECT series_id, q AS v FROM s), {_KDE}, o AS (SELECT series_id, avg(q) AS mean, stddev_samp(q) AS sd FROM s GROUP BY 1),
    j AS (SELECT kd.series_id, i, x AS q, density AS kernel, mean, sd, mean_log, sd_log, skew_log, ln(x) AS y FROM kd JOIN o USING (series_id) JOIN f USING (series_id) WHERE x > 0 AND sd_log > 0 AND skew_log IS NOT NULL)
    SELECT series_id, i, q, kernel, w_pdf / q AS log_pearson3, exp(-0.5::DOUBLE * power((q - mean) / sd, 2)) / (sd * sqrt(2 * pi())) AS normal FROM {staged_sql("j", pearson3_steps("y", "mean_log", "sd_log", "skew_log", "w", sql_fold))}""",
    digits=7,
    columns="q kernel log_pearson3 normal",
)
query(
    "implied_periods",
    lambda s, d: frequency.implied_periods(events(s, d), frequency.lp3(events(s, d))).withColumn("implied_period", F.round("implied_period", 2)),
    f"""WITH {_EVENTS}, {_LOGFIT}, {_LP3}, x AS (SELECT f.series_id, f.n, mean_log, sd_log, skew_log, ln(max(q)) AS y, max(q) AS max FROM f JOIN s USING (series_id) WHERE sd_log > 0 AND skew_log IS NOT NULL GROUP BY ALL),
    w AS (SELECT series_id, n, max, w_cdf AS cdf, 1 / greatest(w_sf, {num(1e-12)}) AS implied_period FROM {staged_sql("x", pearson3_steps("y", "mean_log", "sd_log", "skew_log", "w", sql_fold))}),
    b AS (SELECT series_id, count(CASE WHEN period >= w.n AND q <= max THEN 1 END) AS n_below FROM lq JOIN w USING (series_id) GROUP BY 1)
    SELECT series_id, n, max, cdf, round(implied_period, 2) AS implied_period, n_below, n_below = 0 AND implied_period <= 2 * (n + 1) AS passed FROM w JOIN b USING (series_id)""",
    columns="max cdf",
)
query(
    "period_lookup",
    lambda s, d: lookup.close_join(
        frequency.periods(events(s, d).select("series_id").distinct()).select("series_id", (1 / (1 - (1 - 1 / F.col("period")))).alias("asked")), frequency.lp3(events(s, d)).select("series_id", "period", "q"), "asked", "period"
    ),
    f"""WITH {_EVENTS}, {_LOGFIT}, {_LP3}, o AS (SELECT series_id, 1 / (1 - (1 - 1 / period)) AS asked FROM (SELECT series_id, {_PERIODS} AS period FROM (SELECT DISTINCT series_id FROM s)))
    SELECT o.series_id, asked, period, q FROM o JOIN lq ON lq.series_id = o.series_id AND abs(asked - period) <= 1e-8 + 1e-5 * abs(period)""",
    columns="asked period q",
)
query(
    "lp3_distribution",
    lambda s, d: frequency.lp3_distribution(events(s, d)),
    f"""WITH {_EVENTS}, {_LOGFIT}, x AS (SELECT f.*, CAST(t AS INTEGER) AS t, q, ln(q) AS y FROM f JOIN s USING (series_id) WHERE sd_log > 0 AND skew_log IS NOT NULL)
    SELECT series_id, t, n, q, w_cdf AS cdf, w_sf AS sf, w_pdf / q AS density FROM {staged_sql("x", pearson3_steps("y", "mean_log", "sd_log", "skew_log", "w", sql_fold))}""",
    columns="q cdf sf density",
)
query(
    "factor_gap",
    lambda s, d: frequency.factor_gap(events(s, d)),
    f"""WITH {_EVENTS}, {_LOGFIT}, x AS (SELECT series_id, skew_log AS skew, period, 1 - 1 / period AS p FROM (SELECT *, {_PERIODS} AS period FROM f WHERE skew_log IS NOT NULL)),
    k AS (SELECT *, {_wh("skew", "p")} AS approximate FROM {staged_sql("x", pearson3_factor_steps("p", "skew", "exact", sql_fold))})
    SELECT series_id, period, skew, exact, approximate, 100 * (approximate - exact) / nullif(abs(exact), 0) AS gap_percent FROM k""",
    columns="period skew exact approximate gap_percent",
)
query("station_checklist", lambda s, d: station.checklist(events(s, d), design=frequency.design_values(events(s, d)), skew=frequency.skew_decision(events(s, d)), fits=frequency.ranking(events(s, d)), tests=battery.tests(events(s, d)), outliers=quality.grubbs(events(s, d))))
query("exact_factors", lambda s, d: kernels.exact_factors(moments.log_moments(events(s, d)).withColumnRenamed("skew_log", "skew")))
query("posterior", lambda s, d: resampling.posterior(kernels.mcmc(events(s, d)).cache()), digits=3)
query("r_hat", lambda s, d: resampling.split_r_hat(kernels.mcmc(events(s, d))), digits=3)
query("learned_scores", lambda s, d: learning.score_table(learning.forecasts(events(s, d), ("linear", "ridge", "forest", "boosting"))), digits=3)

query("qq_points", lambda s, d: parents.qq_points(events(s, d), candidates.ranking(events(s, d)).filter("place <= 6")), digits=3)
query("residual_acf", lambda s, d: dependence.residual_acf(candidates.residuals(events(s, d), candidates.ranking(events(s, d)).filter("is_best"))))
query("level_stability", lambda s, d: peaks.level_stability(peaks.penalty_scan(events(s, d).select("series_id", F.col("q").alias("x")))), digits=2)
query("moments_difference", lambda s, d: candidates.moments_difference(candidates.ranking(events(s, d)), frequency.lp3(events(s, d))), digits=3)
query(
    "probability_paper",
    lambda s, d: report.probability_paper(events(s, d)),
    f"""WITH {_EVENTS}, p AS (SELECT series_id, rank, q, CAST(rank AS DOUBLE) / (n + 1) AS p FROM s), z AS (SELECT *, {norm_ppf("p")} AS normal, -ln(-ln(p)) AS reduced FROM p)
    SELECT series_id, CAST(rank AS INTEGER) AS rank, q, p, normal, reduced, corr(q, normal) OVER (PARTITION BY series_id) AS r FROM z""",
    columns="q p normal reduced r",
)
query("time_series", lambda s, d: report.time_series(events(s, d)))


def _binned_posterior(spark: SparkSession, sf: str) -> DataFrame:
    chains = kernels.mcmc(events(spark, sf)).select("series_id", "chain", "draw", "parameter", "value")
    return uncertainty.binned(chains.select("series_id", "parameter", "value").unionByName(uncertainty.predictive(chains).select("series_id", "parameter", "value")))


query("posterior_bins", _binned_posterior)
