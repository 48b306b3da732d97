"""Price, return and volatility queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import returns as R
from quantloom.operators import bars
from quantloom.plans.inputs import NS_PER_DAY, NS_PER_HOUR, prices, r6, trades, user_prices

KEYS = ["entity", "day"]
#: Prices of the day's path in SQL.
PATH = """p AS (
  SELECT event_type AS entity, epoch_us(ts) * 1000 AS t, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, event_id AS seq,
    CASE WHEN value > 0 AND value < 'Infinity'::DOUBLE THEN value END AS price
  FROM events
), r0 AS (
  SELECT *, ln(price / lag(price) OVER w) AS r FROM p WINDOW w AS (PARTITION BY entity, day ORDER BY t, seq)
), r AS (
  SELECT *, lag(r) OVER w AS r1, lead(r) OVER w AS next_r FROM r0 WINDOW w AS (PARTITION BY entity, day ORDER BY t, seq)
)"""


def realized_measures_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_returns(prices(spark, sf_dir), KEYS)
    return rows.groupBy(*KEYS).agg(
        F.count("r").alias("n_returns"),
        F.count_if(F.col("price").isNull()).alias("invalid_prices"),
        r6(R.realized_variance()).alias("realized_variance"),
        r6(F.sqrt(R.realized_variance())).alias("realized_volatility"),
        r6(R.semivariance(True)).alias("upside_semivariance"),
        r6(R.semivariance(False)).alias("downside_semivariance"),
        r6(R.bipower_variation()).alias("bipower_variation"),
        r6(R.jump_variation()).alias("jump_variation"),
    )


def return_moments_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_returns(prices(spark, sf_dir), KEYS)
    return rows.groupBy(*KEYS).agg(
        r6(R.skewness()).alias("rolling_skewness"),
        r6(R.excess_kurtosis()).alias("rolling_excess_kurtosis"),
        r6(R.variance_ratio()).alias("variance_ratio"),
        r6(R.autocorrelation()).alias("return_autocorrelation"),
        r6(R.reversal(0.05)).alias("return_reversal"),
    )


def drawdown_runup_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_extremes(prices(spark, sf_dir), KEYS)
    return rows.groupBy(*KEYS).agg(r6(R.maximum_drawdown()).alias("maximum_drawdown"), r6(R.maximum_run_up()).alias("maximum_run_up"))


def ohlc_range_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    bar = prices(spark, sf_dir).groupBy(*KEYS).agg(
        R.first_price().alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), R.last_price().alias("c")
    )
    o, h, low, c = (F.col(x) for x in "ohlc")
    return bar.select(
        *KEYS,
        r6(R.log_return(c, o)).alias("log_return"),
        r6(R.relative(c, o)).alias("cumulative_return"),
        r6(R.relative(h, low)).alias("high_low_range"),
        r6(R.relative(c, o)).alias("open_close_range"),
        r6(R.parkinson(h, low)).alias("parkinson_volatility"),
        r6(R.garman_klass(o, h, low, c)).alias("garman_klass_volatility"),
    )


def trend_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope per hour, and slope of the interval slopes at integer midpoints."""
    w = R.path(KEYS)
    rows = prices(spark, sf_dir)
    rows = rows.withColumn("t0", F.min("t").over(Window.partitionBy(*KEYS)))
    rows = rows.withColumns(
        {"x": (F.col("t") - F.col("t0")) / NS_PER_HOUR, "dt": F.col("t") - F.lag("t").over(w), "dp": F.col("price") - F.lag("price").over(w), "before": F.lag("t").over(w)}
    )
    rows = rows.withColumns(
        {
            "slope": F.col("dp") / (F.when(F.col("dt") > 0, F.col("dt")) / NS_PER_HOUR),
            "mid": (F.col("before") - F.col("t0") + F.expr("dt div 2")) / NS_PER_HOUR,
        }
    )
    return rows.groupBy(*KEYS).agg(r6(F.regr_slope("price", "x")).alias("trend_slope"), r6(F.regr_slope("slope", "mid")).alias("trend_acceleration"))


def ewma_halflife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-life average of each user's values at the last event (6 h)."""
    out = bars.ewma(user_prices(spark, sf_dir), ["entity"], "price", 6 * NS_PER_HOUR)
    return out.select("entity", "n", r6("ewma").alias("ewma"))


def ewma_volatility_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_returns(prices(spark, sf_dir), KEYS).filter("r is not null").withColumn("r2", F.col("r") * F.col("r"))
    out = bars.ewma(rows, KEYS, "r2", NS_PER_HOUR)
    return out.select(*KEYS, r6(F.sqrt("ewma")).alias("exponentially_weighted_volatility"))


def vwap_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier-day's mean price against the volume-weighted price of the
    last seven days with trades and of the anchored month (30-day) so far."""
    day = trades(spark, sf_dir).groupBy("instrument", "day").agg(
        F.sum(F.col("price").cast("decimal(18,2)") * F.col("qty").cast("decimal(18,2)")).cast("double").alias("pq"),
        F.sum("qty").alias("q"),
        F.max("price").alias("last"),
    )
    seven = Window.partitionBy("instrument").orderBy("day").rangeBetween(-6, 0)
    anchored = Window.partitionBy("instrument", F.expr("day div 30")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ratio = lambda w: F.col("last") / (F.sum("pq").over(w) / F.nullif(F.sum("q").over(w), F.lit(0.0))) - 1
    return day.select("instrument", "day", r6(ratio(seven), 9).alias("rolling_vwap_distance"), r6(ratio(anchored), 9).alias("anchored_vwap_distance"))


def interval_gap_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open over the previous day's close; missing unless the days adjoin."""
    bar = prices(spark, sf_dir).groupBy(*KEYS).agg(R.first_price().alias("o"), R.last_price().alias("c"))
    w = Window.partitionBy("entity").orderBy("day")
    gap = F.when(F.lag("day").over(w) == F.col("day") - 1, R.relative(F.col("o"), F.lag("c").over(w)))
    return bar.select(*KEYS, r6(gap).alias("finalized_interval_gap"))


def volatility_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility of volatility, short over long, and UTC hour-of-week factor."""
    rows = R.with_returns(prices(spark, sf_dir), KEYS).filter("r is not null")
    rv = rows.groupBy(*KEYS).agg(F.sqrt(R.realized_variance()).alias("rv"))
    week = Window.partitionBy("entity").orderBy("day").rangeBetween(-6, 0)
    three = Window.partitionBy("entity").orderBy("day").rangeBetween(-2, 0)
    term = F.sqrt(F.avg(F.col("rv") * F.col("rv")).over(three)) / F.nullif(F.sqrt(F.avg(F.col("rv") * F.col("rv")).over(week)), F.lit(0.0))
    # 1970-01-01 was a Thursday; bucket 0 of the week is Monday 00:00 UTC.
    dow = F.pmod(F.col("day") + 3, F.lit(7))
    usual = Window.partitionBy("entity", dow)
    return rv.select(
        *KEYS,
        r6(F.stddev_samp("rv").over(week)).alias("volatility_of_volatility"),
        r6(term).alias("volatility_term_ratio"),
        r6(F.col("rv") / F.nullif(F.avg("rv").over(usual), F.lit(0.0))).alias("seasonality_adjusted_volatility"),
    )


def realized_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncentred covariance and correlation of two entities on an hourly grid."""
    hour = F.floor(F.col("t") / NS_PER_HOUR).cast("long")
    grid = prices(spark, sf_dir).groupBy("entity", "day", hour.alias("hour")).agg(R.last_price().alias("price"))
    w = Window.partitionBy("entity").orderBy("hour")
    grid = grid.withColumn("r", F.when(F.lag("hour").over(w) == F.col("hour") - 1, R.log_return(F.col("price"), F.lag("price").over(w)))).filter("r is not null")
    left = grid.select(F.col("entity").alias("left"), "day", "hour", F.col("r").alias("x"))
    right = grid.select(F.col("entity").alias("right"), "hour", F.col("r").alias("y"))
    pair = left.join(right, "hour").filter("left < right")
    x, y = F.col("x"), F.col("y")
    cov = F.sum(x * y)
    both = F.sqrt(F.sum(x * x) * F.sum(y * y))
    return pair.groupBy("left", "right").agg(
        F.count("*").alias("n"),
        r6(cov).alias("realized_covariance"),
        r6(F.when(both > 0, cov / both)).alias("realized_correlation"),
        r6(F.covar_samp(x, y)).alias("sample_covariance"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        realized_measures_daily,
        return_moments_daily,
        drawdown_runup_daily,
        ohlc_range_vol,
        trend_daily,
        ewma_halflife,
        ewma_volatility_daily,
        vwap_distance,
        interval_gap_daily,
        volatility_structure,
        realized_pairs,
    )
}

_HALF_PI = repr(math.pi / 2)
ORACLE_SQL = {
    "realized_measures_daily": f"""WITH {PATH}, a AS (
  SELECT entity, day, count(r) AS n_returns, count(*) FILTER (price IS NULL) AS invalid_prices, coalesce(sum(r * r), 0) AS rv, sum(CASE WHEN r > 0 THEN r * r ELSE 0 END) AS up,
    sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) AS down, {_HALF_PI} * coalesce(sum(abs(r) * abs(r1)), 0) AS bv
  FROM r GROUP BY entity, day)
SELECT entity, day, n_returns, invalid_prices, round(rv, 6) + 0.0 AS realized_variance, round(sqrt(rv), 6) + 0.0 AS realized_volatility,
  round(up, 6) + 0.0 AS upside_semivariance, round(down, 6) + 0.0 AS downside_semivariance,
  round(bv, 6) + 0.0 AS bipower_variation, round(greatest(rv - bv, 0), 6) + 0.0 AS jump_variation FROM a""",
    "return_moments_daily": f"""WITH {PATH}, m AS (
  SELECT entity, day, avg(r) AS mu FROM r GROUP BY entity, day
), c AS (
  SELECT entity, day, count(r) AS n, avg(power(r - mu, 2)) AS m2, avg(power(r - mu, 3)) AS m3, avg(power(r - mu, 4)) AS m4,
    var_pop(r + r1) AS v2, count(CASE WHEN r IS NOT NULL AND r1 IS NOT NULL THEN 1 END) AS pairs,
    var_pop(CASE WHEN r1 IS NOT NULL THEN r END) AS vx, var_pop(CASE WHEN r IS NOT NULL THEN r1 END) AS vy, covar_pop(r, r1) AS cxy,
    avg(CASE WHEN abs(r) >= 0.05 AND next_r IS NOT NULL THEN -sign(r) * next_r END) AS rev
  FROM r JOIN m USING (entity, day) GROUP BY entity, day
)
SELECT entity, day,
  round(CASE WHEN n >= 3 AND m2 > 0 THEN m3 / power(m2, 1.5) END, 6) + 0.0 AS rolling_skewness,
  round(CASE WHEN n >= 4 AND m2 > 0 THEN m4 / (m2 * m2) - 3 END, 6) + 0.0 AS rolling_excess_kurtosis,
  round(CASE WHEN m2 > 0 THEN v2 / (2 * m2) END, 6) + 0.0 AS variance_ratio,
  round(CASE WHEN pairs >= 3 AND vx > 0 AND vy > 0 THEN cxy / sqrt(vx * vy) END, 6) + 0.0 AS return_autocorrelation,
  round(rev, 6) + 0.0 AS return_reversal FROM c""",
    "drawdown_runup_daily": f"""WITH {PATH}, x AS (
  SELECT entity, day, price, max(price) OVER w AS peak, min(price) OVER w AS trough FROM p
  WINDOW w AS (PARTITION BY entity, day ORDER BY t, seq ROWS UNBOUNDED PRECEDING))
SELECT entity, day, round(max((peak - price) / peak), 6) + 0.0 AS maximum_drawdown, round(max((price - trough) / trough), 6) + 0.0 AS maximum_run_up
FROM x GROUP BY entity, day""",
    "ohlc_range_vol": f"""WITH {PATH}, b AS (
  SELECT entity, day, first(price ORDER BY t, seq) FILTER (price IS NOT NULL) AS o, max(price) AS h, min(price) AS l, last(price ORDER BY t, seq) FILTER (price IS NOT NULL) AS c FROM p GROUP BY entity, day
), g AS (SELECT *, 0.5 * power(ln(h / l), 2) - (2 * ln(2) - 1) * power(ln(c / o), 2) AS v FROM b)
SELECT entity, day, round(ln(c / o), 6) + 0.0 AS log_return, round(c / o - 1, 6) + 0.0 AS cumulative_return, round(h / l - 1, 6) + 0.0 AS high_low_range,
  round(c / o - 1, 6) + 0.0 AS open_close_range, round(sqrt(power(ln(h / l), 2) / (4 * ln(2))), 6) + 0.0 AS parkinson_volatility,
  round(CASE WHEN v >= -1e-12 THEN sqrt(greatest(v, 0)) END, 6) + 0.0 AS garman_klass_volatility FROM g""",
    "trend_daily": f"""WITH {PATH}, a AS (
  SELECT *, min(t) OVER (PARTITION BY entity, day) AS t0, lag(t) OVER w AS before, lag(price) OVER w AS pp FROM p WINDOW w AS (PARTITION BY entity, day ORDER BY t, seq)
), b AS (
  SELECT *, (t - t0) / {float(NS_PER_HOUR)!r} AS x, CASE WHEN t > before THEN (price - pp) / ((t - before) / {float(NS_PER_HOUR)!r}) END AS slope,
    (before - t0 + (t - before) // 2) / {float(NS_PER_HOUR)!r} AS mid FROM a)
SELECT entity, day, round(nullif(regr_slope(price, x), 'nan'::DOUBLE), 6) + 0.0 AS trend_slope, round(nullif(regr_slope(slope, mid), 'nan'::DOUBLE), 6) + 0.0 AS trend_acceleration FROM b GROUP BY entity, day""",
    "ewma_halflife": f"""WITH p AS (
  SELECT user_id AS entity, epoch_us(ts) * 1000 AS t, event_id AS seq, value AS x FROM events
), a AS (
  SELECT *, lag(t) OVER w AS before, max(t) OVER (PARTITION BY entity) AS last FROM p WINDOW w AS (PARTITION BY entity ORDER BY t, seq))
SELECT entity, count(*) AS n, round(sum(x * (CASE WHEN before IS NULL THEN 1 ELSE 1 - power(2, -(t - before) / {float(6 * NS_PER_HOUR)!r}) END) * power(2, -(last - t) / {float(6 * NS_PER_HOUR)!r})), 6) + 0.0 AS ewma
FROM a GROUP BY entity""",
    "ewma_volatility_daily": f"""WITH {PATH}, q AS (SELECT entity, day, t, seq, r * r AS x FROM r WHERE r IS NOT NULL), a AS (
  SELECT *, lag(t) OVER w AS before, max(t) OVER (PARTITION BY entity, day) AS last FROM q WINDOW w AS (PARTITION BY entity, day ORDER BY t, seq))
SELECT entity, day, round(sqrt(sum(x * (CASE WHEN before IS NULL THEN 1 ELSE 1 - power(2, -(t - before) / {float(NS_PER_HOUR)!r}) END) * power(2, -(last - t) / {float(NS_PER_HOUR)!r}))), 6) + 0.0 AS exponentially_weighted_volatility
FROM a GROUP BY entity, day""",
    "vwap_distance": f"""WITH d AS (
  SELECT l_suppkey AS instrument, CAST(floor(epoch_us(l_shipdate) / {NS_PER_DAY // 1000}) AS BIGINT) AS day,
    CAST(sum(CAST(floor(l_extendedprice / l_quantity * 100) / 100 AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS pq, sum(l_quantity) AS q, max(floor(l_extendedprice / l_quantity * 100) / 100) AS last
  FROM lineitem GROUP BY ALL)
SELECT instrument, day,
  round(last / (sum(pq) OVER s / nullif(sum(q) OVER s, 0)) - 1, 9) + 0.0 AS rolling_vwap_distance,
  round(last / (sum(pq) OVER a / nullif(sum(q) OVER a, 0)) - 1, 9) + 0.0 AS anchored_vwap_distance
FROM d WINDOW s AS (PARTITION BY instrument ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW),
  a AS (PARTITION BY instrument, day // 30 ORDER BY day ROWS UNBOUNDED PRECEDING)""",
    "interval_gap_daily": f"""WITH {PATH}, b AS (
  SELECT entity, day, first(price ORDER BY t, seq) FILTER (price IS NOT NULL) AS o, last(price ORDER BY t, seq) FILTER (price IS NOT NULL) AS c FROM p GROUP BY entity, day)
SELECT entity, day, round(CASE WHEN lag(day) OVER w = day - 1 THEN o / lag(c) OVER w - 1 END, 6) + 0.0 AS finalized_interval_gap
FROM b WINDOW w AS (PARTITION BY entity ORDER BY day)""",
    "volatility_structure": f"""WITH {PATH}, v AS (SELECT entity, day, sqrt(sum(r * r)) AS rv FROM r WHERE r IS NOT NULL GROUP BY entity, day)
SELECT entity, day, round(stddev_samp(rv) OVER k, 6) + 0.0 AS volatility_of_volatility,
  round(sqrt(avg(rv * rv) OVER s) / nullif(sqrt(avg(rv * rv) OVER k), 0), 6) + 0.0 AS volatility_term_ratio,
  round(rv / nullif(avg(rv) OVER (PARTITION BY entity, (day + 3) % 7), 0), 6) + 0.0 AS seasonality_adjusted_volatility
FROM v WINDOW k AS (PARTITION BY entity ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), s AS (PARTITION BY entity ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "realized_pairs": f"""WITH {PATH}, g AS (
  SELECT entity, CAST(floor(t / {float(NS_PER_HOUR)!r}) AS BIGINT) AS hour, last(price ORDER BY t, seq) FILTER (price IS NOT NULL) AS price FROM p GROUP BY ALL
), h AS (SELECT *, CASE WHEN lag(hour) OVER w = hour - 1 THEN ln(price / lag(price) OVER w) END AS r FROM g WINDOW w AS (PARTITION BY entity ORDER BY hour))
SELECT a.entity AS "left", b.entity AS "right", count(*) AS n, round(sum(a.r * b.r), 6) + 0.0 AS realized_covariance,
  round(CASE WHEN sum(a.r * a.r) * sum(b.r * b.r) > 0 THEN sum(a.r * b.r) / sqrt(sum(a.r * a.r) * sum(b.r * b.r)) END, 6) + 0.0 AS realized_correlation,
  round(covar_samp(a.r, b.r), 6) + 0.0 AS sample_covariance
FROM h a JOIN h b ON a.hour = b.hour AND a.entity < b.entity AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.entity, b.entity""",
}
