"""Feature-row, venue and operational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import book
from quantloom.operators import feature_rows as FR
from quantloom.operators import market, operations
from quantloom.plans.flow import event_quotes
from quantloom.plans.inputs import NS_PER_DAY, NS_PER_HOUR, prices, r6, user_prices
from quantloom.plans.market import venue_quotes

#: Windows of the grid: steps and names (on an hourly grid here, a minute in production).
SPANS = ((5, "sliding_5"), (15, "sliding_15"), (60, "sliding_60"))
FEATURES = [*FR.PRICE_FEATURES, "volatility_forecast_residual", "consolidated_fair_price_distance"]


def wide_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices(spark, sf_dir).filter("price is not null")
    out = None
    for steps, name in SPANS:
        one = FR.feature_windows(rows, NS_PER_HOUR, steps, name)
        out = one if out is None else out.unionByName(one)
    return out


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price feature of every window of every entity: a value, or the
    reason there is none."""
    rows = FR.long_rows(wide_windows(spark, sf_dir), FEATURES)
    made = FR.canonical(rows, NS_PER_HOUR)
    return made.select(
        F.get_json_object("entity_json", "$.id").alias("entity"), "window_id", "feature_id", "event_time_start_ns", "event_time_end_ns", r6("value").alias("value"), "missing_reason",
        "finality_state", "quality_millionths", "watermark_ns", "as_known_at_ns", (F.get_json_object("datum_json", "$.kind") == "present").alias("present"),
    )


def operations_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the ledger of their type's source: ``props.k`` sets what
    happened, and how long it took."""
    rows = user_prices(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k = F.col("k")
    kind = (
        F.when(k >= 95, "checksum_failure").when(k == 0, "reconnect").when(k == 1, "recovery").when(k.between(2, 4), "correction")
        .when(k.between(5, 6), "revision").when(k == 7, "rejection").when(k == 8, "sequence_gap")
    )
    health = F.when(k >= 97, "quarantined").when(k >= 90, "unhealthy").when(k >= 80, "degraded").otherwise("healthy")
    return rows.select(
        F.col("event_type").alias("source"), "day", "t", "seq", kind.alias("kind"), (k * 1_000_000).alias("latency_ns"), ((k % 7 - 3) * 250_000).alias("skew_ns"),
        (F.col("t") - k * 1_000_000_000).alias("feature_end_ns"), (F.col("t") + k * 2_000_000).alias("computed_ns"), health.alias("health"),
        F.when(F.col("price") > 100, "sampled").otherwise("complete").alias("completeness"), k.cast("double").alias("used"), F.lit(128.0).alias("capacity"),
    )


def operational_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operational features of a source and day from its ledger."""
    end = (F.max("day") + 1) * NS_PER_DAY
    out = operations.ledger_features(operations_ledger(spark, sf_dir), ["source", "day"], end, NS_PER_HOUR)
    return out.withColumn("disk_pressure_fraction", r6("disk_pressure_fraction"))


def _judged_quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = venue_quotes(spark, sf_dir).withColumns({"healthy": F.col("flag") != "R", "reason": F.when(F.col("depth") < 10, "below_liquidity_threshold")})
    fair = market.weighted_median(rows.filter("reason is null"), ["part"], "price", "depth", "venue").withColumnRenamed("weighted_median", "fair_price")
    return rows, fair


def venue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation and depth share of each included venue of a part."""
    each, _ = operations.venue_features(*_judged_quotes(spark, sf_dir), ["part"], "price", "depth")
    return each.select("part", "venue", r6("venue_midprice_deviation", 9).alias("venue_midprice_deviation"), r6("venue_depth_share", 9).alias("venue_depth_share"))


def venue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Healthy fraction, coverage, disagreement and cascade gate of each part."""
    _, out = operations.venue_features(*_judged_quotes(spark, sf_dir), ["part"], "price", "depth")
    return out.select(
        "part", "eligible_venues", "included_venues", *(r6(c, 9).alias(c) for c in ("healthy_venue_fraction", "source_coverage_fraction", "cross_source_disagreement")), "cascade_eligibility_gate"
    )


def book_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quote as a book evaluated some milliseconds later: its age, and why
    its features may not be trusted."""
    rows = event_quotes(spark, sf_dir).join(user_prices(spark, sf_dir).select("seq", "event_type"), "seq")
    k = F.col("bid_qty") - 1
    level = lambda p, q: F.array(F.struct(F.col(p).alias("price"), F.col(q).alias("qty")))
    rows = rows.withColumns({"bids": level("bid", "bid_qty"), "asks": level("ask", "ask_qty"), "book_quote_age_ms": (k * 50).cast("long"), "synchronized": k % 10 != 3})
    product = F.when(F.col("event_type") == "signup", "perpetual").otherwise("spot")
    reason = operations.usable_book(book.classification(), F.col("synchronized"), F.col("book_quote_age_ms"), product)
    return rows.select("seq", "book_quote_age_ms", reason.alias("missing_reason"), F.when(reason.isNull(), book.absolute_spread()).alias("absolute_spread"))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = operations.histogram(user_prices(spark, sf_dir), ["event_type"], "price", [1.0, 5.0, 10.0, 50.0, 100.0, 250.0])
    return out.select("event_type", "upper", "n", "cumulative")


def daily_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event types a user's day has, and which are missing of three."""
    out = operations.source_sets(user_prices(spark, sf_dir), ["entity", "day"], "event_type", ["view", "click", "purchase"])
    return out.select("entity", "day", F.array_join("sources", ",").alias("sources"), F.array_join("missing", ",").alias("missing"), "complete")


QUERIES = {f.__name__: f for f in (feature_rows, operational_features, venue_features, venue_coverage, book_admission, value_histogram, daily_sources)}
ORACLE_SQL = {
    "feature_rows": f"""WITH e AS (SELECT event_type AS entity, epoch_us(ts) * 1000 AS t, event_id AS seq, value AS price FROM events WHERE value > 0 AND value < 'Infinity'::DOUBLE),
c AS (SELECT entity, CAST(floor(t / {float(NS_PER_HOUR)!r}) AS BIGINT) AS g, last(price ORDER BY t, seq) AS price FROM e GROUP BY ALL),
m AS (SELECT entity, max(t) AS wm FROM e GROUP BY entity),
f AS (SELECT g, CASE WHEN count(*) >= 3 THEN median(price) END AS fair FROM c GROUP BY g),
s AS (SELECT entity, unnest(range(min(g), max(g) + 1)) AS eg FROM c GROUP BY entity),
k AS (SELECT * FROM (VALUES (5, 'sliding_5'), (15, 'sliding_15'), (60, 'sliding_60')) v(n, window_id)),
w AS MATERIALIZED (SELECT s.entity, s.eg, n, window_id, count(c.g) AS seen FROM s CROSS JOIN k LEFT JOIN c ON c.entity = s.entity AND c.g BETWEEN s.eg - n AND s.eg GROUP BY ALL),
x AS (SELECT w.entity, w.eg, w.window_id, w.n, c.g - (w.eg - w.n) AS i, c.price AS p FROM w JOIN c ON c.entity = w.entity AND c.g BETWEEN w.eg - w.n AND w.eg WHERE seen = n + 1),
y AS (SELECT *, ln(p / lag(p) OVER o) AS r, p - lag(p) OVER o AS dp, max(p) OVER o AS peak, min(p) OVER o AS trough FROM x WINDOW o AS (PARTITION BY entity, window_id, eg ORDER BY i)),
z AS (SELECT *, lag(r) OVER o AS r1 FROM y WINDOW o AS (PARTITION BY entity, window_id, eg ORDER BY i)),
a AS (SELECT entity, window_id, eg, n, first(p ORDER BY i) AS po, last(p ORDER BY i) AS pc, max(p) AS ph, min(p) AS pl, regr_slope(p, CAST(i AS DOUBLE)) AS trend_slope, regr_slope(dp, i - 0.5::DOUBLE) AS trend_acceleration,
  max((peak - p) / peak) AS maximum_drawdown, max((p - trough) / trough) AS maximum_run_up, coalesce(sum(r * r) FILTER (r > 0), 0) AS upside_semivariance, coalesce(sum(r * r) FILTER (r < 0), 0) AS downside_semivariance,
  sum(r * r) AS rv, pi() / 2 * sum(abs(r) * abs(r1)) AS bv, var_pop(r) AS m2, avg(r) AS mu, var_pop(r + r1) AS v2, covar_pop(r, r1) AS cxy, var_pop(r) FILTER (r1 IS NOT NULL) AS vx, var_pop(r1) AS vy,
  avg(-sign(r1) * r) FILTER (abs(r1) >= 0.05) AS return_reversal FROM z GROUP BY ALL),
q AS (SELECT entity, window_id, eg, avg(power(r - mu, 3)) AS m3, avg(power(r - mu, 4)) AS m4 FROM z JOIN a USING (entity, window_id, eg) GROUP BY ALL),
b AS (SELECT *, 0.5 * power(ln(ph / pl), 2) - (2 * ln(2) - 1) * power(ln(pc / po), 2) AS gk FROM a JOIN q USING (entity, window_id, eg) JOIN m USING (entity) WHERE wm >= eg * {NS_PER_HOUR} + 5000000000),
d AS (SELECT entity, window_id, eg, n, ln(pc / po) AS log_return, pc / po - 1 AS cumulative_return, ph / pl - 1 AS high_low_range, pc / po - 1 AS open_close_range, trend_slope, trend_acceleration, maximum_drawdown, maximum_run_up,
  upside_semivariance, downside_semivariance, CASE WHEN n >= 4 AND vx * vy * (n - 1) * (n - 1) > 1e-18 THEN cxy / sqrt(vx * vy) END AS return_autocorrelation, CASE WHEN m2 > 1e-18 THEN v2 / (2 * m2) END AS variance_ratio,
  CASE WHEN m2 > 1e-18 THEN m3 / power(m2, 1.5) END AS rolling_skewness, CASE WHEN m2 > 1e-18 THEN m4 / (m2 * m2) - 3 END AS rolling_excess_kurtosis, return_reversal, rv AS realized_variance, sqrt(rv) AS realized_volatility,
  sqrt(power(ln(ph / pl), 2) / (4 * ln(2))) AS parkinson_volatility, CASE WHEN gk >= -1e-12 THEN sqrt(greatest(gk, 0)) END AS garman_klass_volatility, bv AS bipower_variation, greatest(rv - bv, 0) AS jump_variation, pc
  FROM b),
h AS (SELECT d.*, d.realized_variance - u.realized_variance AS volatility_forecast_residual,d.pc / fair - 1 AS consolidated_fair_price_distance
  FROM d LEFT JOIN d u ON u.entity = d.entity AND u.window_id = d.window_id AND u.eg = d.eg - d.n JOIN f ON f.g = d.eg),
l AS (SELECT entity, window_id, eg, unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS feature_id, unnest([{', '.join(FEATURES)}]) AS value FROM h),
r AS (SELECT w.entity, w.window_id, w.eg, w.n, seen, wm, feature_id FROM w JOIN m USING (entity), (SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS feature_id))
SELECT entity, window_id, feature_id, (eg - n) * {NS_PER_HOUR} AS event_time_start_ns, eg * {NS_PER_HOUR} AS event_time_end_ns, round(value, 6) + 0.0 AS value,
  CASE WHEN value IS NOT NULL THEN NULL WHEN wm < eg * {NS_PER_HOUR} + 5000000000 THEN 'window_not_final' WHEN seen < n + 1 THEN 'sequence_gap' ELSE 'insufficient_history' END AS missing_reason,
  CASE WHEN wm >= eg * {NS_PER_HOUR} + 5000000000 THEN 'final' ELSE 'provisional' END AS finality_state, CAST(floor(seen * 1000000 / (n + 1)) AS INTEGER) AS quality_millionths,
  least(wm, greatest(eg * {NS_PER_HOUR}, least(wm, eg * {NS_PER_HOUR} + 5000000000)) + 1) AS watermark_ns, greatest(eg * {NS_PER_HOUR}, least(wm, eg * {NS_PER_HOUR} + 5000000000)) AS as_known_at_ns, value IS NOT NULL AS present
FROM r LEFT JOIN l USING (entity, window_id, eg, feature_id)""",
    "operational_features": f"""WITH e AS (SELECT event_type AS source, epoch_us(ts) * 1000 AS t, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
l AS (SELECT *, abs(k * 1000000 - lag(k * 1000000) OVER (PARTITION BY source, day ORDER BY t, seq)) AS ji FROM e),
x AS (SELECT source, day, max(t) AS mt, last(k ORDER BY t, seq) AS lk, last(ji ORDER BY t, seq) AS lj, max(CASE WHEN price > 100 THEN 1 ELSE 0 END)::INTEGER AS cl, {", ".join(f"count(*) FILTER (k BETWEEN {a} AND {b}) AS {n}" for n, a, b in (("sequence_gap_count", 8, 8), ("checksum_failure_count", 95, 999), ("reconnect_count", 0, 0), ("recovery_count", 1, 1), ("correction_count", 2, 4), ("revision_count", 5, 6), ("raw_to_normalized_rejection_count", 7, 7)))} FROM l GROUP BY source, day)
SELECT source, day, sequence_gap_count, checksum_failure_count, reconnect_count, recovery_count, correction_count, revision_count, raw_to_normalized_rejection_count, lk * 1000000 AS source_latency_ns, lj AS feed_jitter_ns, (lk % 7 - 3) * 250000 AS clock_skew_estimate_ns,
  lk * 2000000 + lk * 1000000000 AS feature_age_ns, lk * 2000000 AS local_processing_lag_ns, CASE WHEN (day + 1) * {NS_PER_DAY} - mt > {NS_PER_HOUR} THEN (day + 1) * {NS_PER_DAY} - mt ELSE 0 END AS stale_quote_duration_ns, lk >= 90 AS source_outage_indicator, lk < 80 AS source_health_gate,
  sequence_gap_count = 0 AND checksum_failure_count = 0 AS source_completeness_gate, cl AS liquidation_source_completeness_flag, round(lk / 128.0::DOUBLE, 6) + 0.0 AS disk_pressure_fraction FROM x""",
    "book_admission": """WITH q AS (SELECT event_id AS seq, floor(value) AS b, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type FROM events),
r AS (SELECT seq, CAST(k * 50 AS BIGINT) AS book_quote_age_ms, CASE WHEN event_type = 'signup' THEN 'source_not_supported' WHEN k % 10 = 3 THEN 'untrusted' WHEN k * 50 > 3000 THEN 'stale' END AS missing_reason, 1 + k % 3 AS sp FROM q)
SELECT seq, book_quote_age_ms, missing_reason, CASE WHEN missing_reason IS NULL THEN sp END AS absolute_spread FROM r""",
    "value_histogram": """WITH b AS (SELECT event_type, CASE WHEN value <= 1 THEN 1.0 WHEN value <= 5 THEN 5.0 WHEN value <= 10 THEN 10.0 WHEN value <= 50 THEN 50.0 WHEN value <= 100 THEN 100.0 WHEN value <= 250 THEN 250.0 END::DOUBLE AS upper, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, upper, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY upper NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM b""",
    "daily_sources": """WITH s AS (SELECT user_id AS entity, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, list_sort(list(DISTINCT event_type)) AS v FROM events GROUP BY ALL)
SELECT entity, day, array_to_string(v, ',') AS sources, array_to_string([x FOR x IN ['click', 'purchase', 'view'] IF NOT list_contains(v, x)], ',') AS missing, v = ['click', 'purchase', 'view'] AS complete FROM s""",
}
_QUOTES = """q AS (SELECT l_partkey AS part, l_suppkey AS venue, CAST(max(CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT)) AS DOUBLE) AS price, CAST(sum(l_quantity) AS BIGINT) AS depth, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
i AS (SELECT * FROM q WHERE depth >= 10),
c AS (SELECT *, 2 * sum(depth) OVER w AS cum, sum(depth) OVER (PARTITION BY part) AS tot, coalesce(lead(price) OVER (PARTITION BY part ORDER BY price, venue), price) AS nx FROM i WINDOW w AS (PARTITION BY part ORDER BY price, venue ROWS UNBOUNDED PRECEDING)),
h AS (SELECT part, CASE WHEN cum = tot THEN (price + nx) / 2 ELSE price END AS fp, row_number() OVER (PARTITION BY part ORDER BY cum, price, venue) AS rk FROM c WHERE cum >= tot),
j AS (SELECT i.*, fp FROM i JOIN h ON i.part = h.part AND rk = 1)"""
ORACLE_SQL["venue_features"] = f"""WITH {_QUOTES}
SELECT part, venue, round(price / fp - 1, 9) + 0.0 AS venue_midprice_deviation, round(depth / sum(depth) OVER (PARTITION BY part), 9) + 0.0 AS venue_depth_share FROM j"""
ORACLE_SQL["venue_coverage"] = f"""WITH {_QUOTES}, n AS (SELECT part, count(*) AS ev, count(*) FILTER (depth >= 10) AS iv, count(*) FILTER (depth >= 10 AND flag <> 'R') AS gv FROM q GROUP BY part),
m AS (SELECT part, median(abs(price / fp - 1)) AS d FROM j GROUP BY part)
SELECT part, ev AS eligible_venues, iv AS included_venues, round(gv / ev, 9) + 0.0 AS healthy_venue_fraction, round(iv / ev, 9) + 0.0 AS source_coverage_fraction, round(d, 9) + 0.0 AS cross_source_disagreement, gv = ev AS cascade_eligibility_gate FROM n LEFT JOIN m USING (part)"""
