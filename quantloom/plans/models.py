"""Model, catalogue, book-replay and storage queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import derivatives, registry
from quantloom.functions.returns import log_return, valid_price
from quantloom.models import fitted, scenarios, sequential
from quantloom.models.roots import fold_distances
from quantloom.operators.bars import ewma
from quantloom.plans.inputs import NS_PER_DAY, NS_PER_HOUR, nanos, r6, table, user_prices
from quantloom.plans.market import forecasts
from quantloom.streaming import order_book, sinks


def feature_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by family and role, and how many of them a query computes."""
    out = registry.registry(spark)
    return out.groupBy("family", "role", "emits").agg(F.count("*").alias("features"), F.count("computed_by").alias("computed"))


def unavailable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = user_prices(spark, sf_dir).select(F.col("entity"), (F.col("day") * NS_PER_DAY).alias("window_start_ns"), ((F.col("day") + 1) * NS_PER_DAY).alias("window_end_ns")).distinct()
    out = registry.unavailable_rows(spark, days)
    return out.groupBy("entity", "window_start_ns", "missing_reason").agg(F.count("*").alias("features"), F.count("value").alias("present"))


def operational_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational counters of a source (event type) per day from its ledger."""
    rows = user_prices(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    w = Window.partitionBy("event_type", "day").orderBy("t", "seq")
    latency = F.col("k") * 1_000_000
    rows = rows.withColumns({"latency": latency, "jitter": F.abs(latency - F.lag(latency).over(w)), "gap": F.col("t") - F.lag("t").over(w) > 2 * NS_PER_HOUR})
    return rows.groupBy("event_type", "day").agg(
        F.max_by("latency", F.struct("t", "seq")).alias("source_latency_ns"),
        F.max("jitter").alias("feed_jitter_ns"),
        F.count_if("gap").alias("sequence_gap_count"),
        F.count_if(F.col("k") >= 95).alias("checksum_failure_count"),
        F.count_if(F.col("k") == 0).alias("reconnect_count"),
        ((F.max("day") + 1) * NS_PER_DAY - F.max("t")).alias("stale_quote_duration_ns"),
        (F.max("k") < 99).alias("source_completeness_gate"),
    )


def har_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily, weekly and monthly means of squared returns against the next day."""
    rows = user_prices(spark, sf_dir)
    w = Window.partitionBy("entity").orderBy("t", "seq")
    r = rows.select("entity", "day", log_return(F.col("price"), F.lag("price").over(w)).alias("r")).filter("r is not null")
    rv = r.groupBy("entity", "day").agg(F.sum(F.col("r") * F.col("r")).alias("daily"))
    span = lambda n: Window.partitionBy("entity").orderBy("day").rangeBetween(-(n - 1), 0)
    d = Window.partitionBy("entity").orderBy("day")
    design = rv.select("entity", "daily", F.avg("daily").over(span(7)).alias("weekly"), F.avg("daily").over(span(22)).alias("monthly"), F.lead("daily").over(d).alias("target")).filter("target is not null")
    beta = fitted.har_fit(design, ["daily", "weekly", "monthly"], "target", 1.0)
    rows = [(n, round(float(b), 6)) for n, b in zip(("intercept", "daily", "weekly", "monthly"), beta, strict=True)]
    return spark.createDataFrame(rows, "term string, coefficient double")


def changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lengths of each user's log prices.  A price that is none leaves the
    state as it is and has no result."""
    rows = user_prices(spark, sf_dir).select("entity", "t", "seq", F.log(valid_price(F.col("price"))).alias("x"))

    def start(_):
        model = sequential.RunLengths(1 / 50, (3.5, 1.0, 2.0, 1.0))
        return lambda x: list(model.update(x).T)

    out = sequential.stream_series(rows, "entity", "x", start, "entity long, seq long, p_new double, run double, expected_run double, cut double")
    return out.select("entity", "seq", r6("p_new").alias("p_new"), F.col("run").cast("long").alias("run"), r6("expected_run").alias("expected_run"), r6("cut").alias("cut"))


#: Events that hidden states are fitted on at least.
LEAST_EVENTS = 10


def hidden_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hidden states of each user's log prices.  Events without a valid
    price, and all of a user with fewer than ``LEAST_EVENTS``, have no state
    but a reason."""
    rows = user_prices(spark, sf_dir).select("entity", "t", "seq", F.log(valid_price(F.col("price"))).alias("x"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        good = g["x"].notna().to_numpy()
        state, p = np.full(len(g), np.nan), np.full(len(g), np.nan)
        reason = np.where(good, "insufficient_history", "invalid_price").astype(object)
        if good.sum() >= LEAST_EVENTS:
            x = g.loc[good, ["x"]].to_numpy()
            found, _ = sequential.StudentHMM(2).fit(x, 10).forward(x)
            state[good], p[good], reason[good] = found.argmax(axis=1), found.max(axis=1), None
        return g[["entity", "seq"]].assign(state=pd.array(state, "Float64").astype("Int64"), p=p, missing_reason=reason)

    out = sequential.per_series(rows, "entity", fold, "entity long, seq long, state long, p double, missing_reason string")
    return out.select("entity", "seq", "state", r6(F.nanvl("p", F.lit(None).cast("double"))).alias("p"), "missing_reason")


def ewma_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("t", "seq")
    rows = user_prices(spark, sf_dir).withColumn("r", log_return(F.col("price"), F.lag("price").over(w))).filter("r is not null")

    def start(_):
        return sequential.LambdaVolatility(0.94).update

    steps = sequential.stream_series(rows.select("entity", "t", "seq", "r"), "entity", "r", start, "entity long, seq long, variance double, squares double, n long")
    # The state after the last return of a series is the one with the most residuals.
    last = steps.groupBy("entity").agg(F.max_by("variance", "n").alias("variance"), F.max_by("squares", "n").alias("squares"), F.max("n").alias("n"))
    half = F.when(F.col("n") > 0, 1.96 * F.sqrt(F.col("squares") / F.when(F.col("n") > 0, F.col("n")))).otherwise(0.0)
    v = F.col("variance")
    return last.select("entity", r6(v).alias("variance"), r6(F.greatest(v - half, F.lit(0.0))).alias("low"), r6(v + half).alias("high"), r6(F.sqrt(v)).alias("volatility"))


def calibrators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt, beta and isotonic maps over the distinct predictions (the counts
    behind each are aggregated first, so the fit's size is the number of
    distinct predictions)."""
    rows = forecasts(spark, sf_dir).groupBy("p").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y")).orderBy("p").toPandas()
    p = np.clip(rows["p"].to_numpy(float), 1e-6, 1 - 1e-6)
    z, y, w = np.log(p / (1 - p)), rows["y"].to_numpy(float), rows["w"].to_numpy(float)
    a, b = fitted.platt(z, y, w)
    c = fitted.beta_calibration(z, y, w)
    upper, values = fitted.isotonic(z, y, w)
    at = np.minimum(np.searchsorted(upper, z), len(upper) - 1)
    sig = lambda t: 1 / (1 + np.exp(-t))
    beta = sig(-c[0] * np.logaddexp(0, -z) + c[1] * np.logaddexp(0, z) + c[2])
    out = pd.DataFrame({"p": rows["p"], "platt": sig(a + b * z), "beta": beta, "isotonic": values[at]}).round(6)
    return spark.createDataFrame(out)


def cusp_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topology, barriers and distance to the fold of each event's controls;
    only the distance (a search) leaves the JVM, as whole batches."""
    rows = user_prices(spark, sf_dir)
    a = F.get_json_object("props", "$.k").cast("double") / 50 - 1.013
    b = F.least(F.col("price") / 50, F.lit(4.0)) - 1.007
    rows = rows.select("seq", a.alias("alpha"), b.alias("beta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fold_distances(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["seq", "alpha", "beta", "fold_distance"])

    far = rows.mapInArrow(run, "seq long, alpha double, beta double, fold_distance double")
    alpha, beta = F.col("alpha"), F.col("beta")
    far = far.withColumn("roots", derivatives.cusp_roots(alpha, beta))
    lower, upper = derivatives.cusp_barriers(F.col("roots"))
    return far.select("seq", derivatives.cusp_topology(alpha, beta).alias("topology"), r6("fold_distance").alias("fold_distance"), r6(lower).alias("lower_barrier"), r6(upper).alias("upper_barrier"))


def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios drawn from the prices of all events; the driver gets each
    distinct price (they are in cents) with its count."""
    known = user_prices(spark, sf_dir).filter("price is not null").groupBy("price").agg(F.count("*").alias("n")).orderBy("price").toPandas()
    paths = scenarios.simulate(spark, ((known["price"].astype(float) - 50) / 50).tolist(), 500, 30, 7, known["n"].tolist())
    out = scenarios.summarize(paths, 30, -0.002)
    return out.select(*(r6(c).alias(c) for c in out.columns))


def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as its book's messages: a snapshot each 20 rows, deltas
    between with consecutive sequences (one in 50 skips ahead)."""
    rows = user_prices(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("entity").orderBy("t", "seq")).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = rows.select("entity", "t", "seq", n.alias("n"), k.alias("k"))
    level = lambda price, qty: F.array(F.struct(price.cast("double").alias("price"), qty.cast("double").alias("qty")))
    jump = F.when(F.pmod("seq", F.lit(50)) == 0, 1).otherwise(0)
    return rows.select(
        F.col("entity").cast("string").alias("instrument"),
        "t",
        "seq",
        F.when(F.col("n") % 20 == 1, "snapshot").otherwise("delta").alias("kind"),
        level(1000 - F.col("k") % 10, F.col("k") % 4).alias("bids"),
        level(1001 + F.col("k") % 7, 1 + F.col("k") % 5).alias("asks"),
        (F.col("n") + jump).alias("first_sequence"),
        (F.col("n") + jump).alias("last_sequence"),
        F.lit(None).cast("long").alias("previous_sequence"),
    )


def book_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_book.replay(book_events(spark, sf_dir))


def partition_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_prices(spark, sf_dir).select("event_type", F.lit("sim").alias("venue"), F.col("t").alias("event_time_ns"), "seq", "price")
    out = sinks.manifest(sinks.with_layout(rows))
    return out.select("event_type", "utc_date", F.col("hour").cast("long").alias("hour"), "rows", "first_ns", "last_ns")


def correction_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 2 of the users' daily totals: days with an error are corrected."""
    rows = user_prices(spark, sf_dir)
    base = rows.groupBy("entity", "day").agg(F.round(F.sum("price"), 2).alias("total"))
    fix = rows.groupBy("entity", "day").agg(F.round(F.sum(F.when(F.col("event_type") != "error", F.col("price")).otherwise(0.0)), 2).alias("total"), F.bool_or(F.col("event_type") == "error").alias("bad"))
    out = sinks.corrected(base, fix.filter("bad").drop("bad"), ["entity", "day"], 2)
    return out.select("entity", "day", r6("total", 2).alias("total"), F.col("dataset_version").cast("long").alias("dataset_version"))


QUERIES = {
    f.__name__: f
    for f in (
        feature_catalogue, unavailable_features, operational_quality, har_volatility, changepoints, hidden_regimes, ewma_forecasts, calibrators, cusp_geometry,
        scenario_summary, book_replay, partition_manifest, correction_dataset,
    )
}

_E = "e AS (SELECT user_id AS entity, epoch_us(ts) * 1000 AS t, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, event_id AS seq, value AS price, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
ORACLE_SQL = {
    "unavailable_features": f"""WITH {_E} SELECT entity, day * {NS_PER_DAY} AS window_start_ns, r AS missing_reason, n AS features, CAST(0 AS BIGINT) AS present
FROM (SELECT DISTINCT entity, day FROM e), (VALUES ('model_not_applicable', 28::BIGINT), ('source_not_supported', 2::BIGINT)) v(r, n)""",
    "operational_quality": f"""WITH {_E}, l AS (SELECT *, k * 1000000 AS la, abs(k * 1000000 - lag(k * 1000000) OVER w) AS ji, t - lag(t) OVER w > {2 * NS_PER_HOUR} AS gap FROM e WINDOW w AS (PARTITION BY event_type, day ORDER BY t, seq))
SELECT event_type, day, last(la ORDER BY t, seq) AS source_latency_ns, max(ji) AS feed_jitter_ns, count(*) FILTER (gap) AS sequence_gap_count, count(*) FILTER (k >= 95) AS checksum_failure_count,
  count(*) FILTER (k = 0) AS reconnect_count, (max(day) + 1) * {NS_PER_DAY} - max(t) AS stale_quote_duration_ns, max(k) < 99 AS source_completeness_gate FROM l GROUP BY event_type, day""",
    "partition_manifest": f"""WITH {_E} SELECT event_type, CAST(make_timestamp(t // 1000) AS DATE) AS utc_date, extract(hour FROM make_timestamp(t // 1000)) AS hour, count(*) AS rows, min(t) AS first_ns, max(t) AS last_ns FROM e GROUP BY 1, 2, 3""",
    "correction_dataset": f"""WITH {_E} SELECT entity, day, round(sum(CASE WHEN event_type <> 'error' THEN price ELSE 0 END), 2) + 0.0 AS total, CAST(2 AS BIGINT) AS dataset_version FROM e GROUP BY entity, day""",
}

ORACLE_SQL["feature_catalogue"] = """SELECT * FROM (VALUES
  ('price', 'model_eligible', true, 32::BIGINT), ('book', 'model_eligible', true, 48::BIGINT), ('book', 'model_eligible', false, 2::BIGINT), ('flow', 'model_eligible', true, 27::BIGINT),
  ('venue', 'model_eligible', true, 13::BIGINT), ('venue', 'model_eligible', false, 23::BIGINT), ('venue', 'uncertainty_only', true, 19::BIGINT), ('venue', 'uncertainty_only', false, 4::BIGINT),
  ('venue', 'gating_only', true, 3::BIGINT), ('venue', 'gating_only', false, 1::BIGINT)) t(family, role, emits, features), LATERAL (SELECT CASE WHEN emits THEN features ELSE 0 END AS computed)"""

_NEWTON = "s - CASE WHEN 10 * s ** 4 + 9 * s * s - 2 * a * s - b > 0 THEN (2 * s ** 5 + 3 * s ** 3 - a * s * s - b * s) / (10 * s ** 4 + 9 * s * s - 2 * a * s - b) ELSE 0 END"
ORACLE_SQL["cusp_geometry"] = f"""WITH RECURSIVE {_E}, c AS (SELECT seq, CAST(k AS DOUBLE) / 50 - 1.013 AS a, least(price / 50, 4.0) - 1.007 AS b FROM e),
t AS (SELECT *, 4 * power(b, 3) - 27 * a * a AS disc, 2 * (sqrt(greatest(b, 0) / 3) + cbrt(abs(a) / 2) + 1) AS top FROM c),
g AS (SELECT seq, a, b, disc, top, unnest(range(0, 257)) AS i FROM t), h AS (SELECT *, top * (i - 128) / 128.0 AS s FROM g),
m AS (SELECT seq, any_value(a) AS a, any_value(b) AS b, any_value(disc) AS disc, any_value(top) / 128 AS wide, arg_min(s, (a - 2 * s * s * s) * (a - 2 * s * s * s) + (b - 3 * s * s) * (b - 3 * s * s)) AS s0 FROM h GROUP BY seq),
n AS (SELECT seq, a, b, disc, wide, s0, s0 AS s, 0 AS j FROM m UNION ALL SELECT seq, a, b, disc, wide, s0, greatest(least({_NEWTON}, s0 + wide), s0 - wide), j + 1 FROM n WHERE j < 30),
r AS (SELECT seq, 3 AS nr, 2 * sqrt(b / 3) * cos(acos(greatest(least(3 * a / (2 * b) * sqrt(3 / b), 1.0), -1.0)) / 3 - 2 * pi() * 2 / 3) AS y1, 2 * sqrt(b / 3) * cos(acos(greatest(least(3 * a / (2 * b) * sqrt(3 / b), 1.0), -1.0)) / 3 - 2 * pi() / 3) AS y2,
  2 * sqrt(b / 3) * cos(acos(greatest(least(3 * a / (2 * b) * sqrt(3 / b), 1.0), -1.0)) / 3) AS y3 FROM t WHERE disc > 0),
o AS (SELECT seq, least(y1, y2, y3) AS x, y1 + y2 + y3 - least(y1, y2, y3) - greatest(y1, y2, y3) AS y, greatest(y1, y2, y3) AS z FROM r)
SELECT n.seq, CASE WHEN abs(a) <= 1e-9 AND abs(b) <= 1e-9 THEN 'critical' WHEN abs(disc) <= 1e-9 AND b > 0 THEN 'fold' WHEN disc > 0 THEN 'three' ELSE 'one' END AS topology,
  round(CASE WHEN disc > 0 AND b > 0 THEN -1 ELSE 1 END * sqrt(power(a - 2 * power(s, 3), 2) + power(b - 3 * s * s, 2)), 6) + 0.0 AS fold_distance, round(z * power(y - x, 3) / 4, 6) + 0.0 AS lower_barrier, round(-x * power(z - y, 3) / 4, 6) + 0.0 AS upper_barrier
FROM n LEFT JOIN o ON o.seq = n.seq WHERE j = 30"""

_R = "l AS (SELECT *, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price / lag(price) OVER w) END AS r FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, seq))"
ORACLE_SQL["ewma_forecasts"] = f"""WITH RECURSIVE {_E}, {_R}, o AS (SELECT entity, r * r AS x, row_number() OVER (PARTITION BY entity ORDER BY t, seq) AS rn FROM l WHERE r IS NOT NULL),
f AS (SELECT entity, rn, x AS v, 0.0::DOUBLE AS sq, 0::BIGINT AS n FROM o WHERE rn = 1 UNION ALL SELECT o.entity, o.rn, 0.94::DOUBLE * v + (1 - 0.94::DOUBLE) * x, sq + (x - v) * (x - v), n + 1 FROM f JOIN o ON o.entity = f.entity AND o.rn = f.rn + 1),
z AS (SELECT entity, arg_max(v, rn) AS v, arg_max(sq, rn) AS sq, max(n) AS n FROM f GROUP BY entity), h AS (SELECT *, CASE WHEN n > 0 THEN 1.96::DOUBLE * sqrt(sq / n) ELSE 0 END AS half FROM z)
SELECT entity, round(v, 6) + 0.0 AS variance, round(greatest(v - half, 0), 6) + 0.0 AS low, round(v + half, 6) + 0.0 AS high, round(sqrt(v), 6) + 0.0 AS volatility FROM h"""

_DET = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
_A3 = ["(1 + n)", "dw", "dm", "dw", "(1 + n)", "wm", "dm", "wm", "(1 + n)"]
_COL = [_DET([_A3[i] if i % 3 != j else ("dy", "wy", "my")[i // 3] for i in range(9)]) for j in range(3)]
ORACLE_SQL["har_volatility"] = f"""WITH {_E}, {_R}, v AS (SELECT entity, day, sum(r * r) AS d FROM l WHERE r IS NOT NULL GROUP BY entity, day),
x AS (SELECT d, avg(d) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS w, avg(d) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN 21 PRECEDING AND CURRENT ROW) AS m, lead(d) OVER (PARTITION BY entity ORDER BY day) AS y FROM v),
s AS (SELECT count(*) AS n, avg(d) AS ad, avg(w) AS aw, avg(m) AS am, avg(y) AS ay, stddev_pop(d) AS sd, stddev_pop(w) AS sw, stddev_pop(m) AS sm FROM x WHERE y IS NOT NULL),
c AS (SELECT any_value(n) AS n, any_value(ad) AS ad, any_value(aw) AS aw, any_value(am) AS am, any_value(ay) AS ay, any_value(sd) AS sd, any_value(sw) AS sw, any_value(sm) AS sm, sum((d - ad) * (w - aw) / (sd * sw)) AS dw, sum((d - ad) * (m - am) / (sd * sm)) AS dm, sum((w - aw) * (m - am) / (sw * sm)) AS wm,
  sum((d - ad) * (y - ay) / sd) AS dy, sum((w - aw) * (y - ay) / sw) AS wy, sum((m - am) * (y - ay) / sm) AS my FROM x, s WHERE y IS NOT NULL),
b AS (SELECT *, {_COL[0]} / {_DET(_A3)} / sd AS bd, {_COL[1]} / {_DET(_A3)} / sw AS bw, {_COL[2]} / {_DET(_A3)} / sm AS bm FROM c)
SELECT unnest(['intercept', 'daily', 'weekly', 'monthly']) AS term, round(unnest([ay - bd * ad - bw * aw - bm * am, bd, bw, bm]), 6) + 0.0 AS coefficient FROM b"""

_APPLY = lambda side, p, q: f"list_concat(list_filter({side}, lambda z: z.p <> {p}), CASE WHEN {q} = 0 THEN [] ELSE [{{'p': {p}, 'q': {q}}}] END)"
_ONE = lambda p, q: f"(CASE WHEN {q} = 0 THEN [] ELSE [{{'p': {p}, 'q': {q}}}] END)"
ORACLE_SQL["book_replay"] = f"""WITH RECURSIVE {_E}, n0 AS (SELECT entity, t, seq, k, row_number() OVER (PARTITION BY entity ORDER BY t, seq) AS n FROM e),
u AS (SELECT entity, t, seq, n, n % 20 = 1 AS snap, CAST(1000 - k % 10 AS DOUBLE) AS bp, CAST(k % 4 AS DOUBLE) AS bq, CAST(1001 + k % 7 AS DOUBLE) AS ap, CAST(1 + k % 5 AS DOUBLE) AS aq, n + CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END AS sq FROM n0),
f AS (SELECT entity, n, t, seq, sq AS cur, {_ONE("bp", "bq")} AS b, {_ONE("ap", "aq")} AS a, 0::BIGINT AS waiting, 0::BIGINT AS gaps, 0::BIGINT AS dups, 'applied' AS did FROM u WHERE n = 1
  UNION ALL SELECT u.entity, u.n, u.t, u.seq,
    CASE WHEN snap THEN sq WHEN cur IS NULL THEN NULL WHEN sq <= cur THEN cur WHEN sq = cur + 1 THEN sq END,
    CASE WHEN snap THEN {_ONE("bp", "bq")} WHEN cur IS NULL OR sq <= cur THEN b WHEN sq = cur + 1 THEN {_APPLY("b", "bp", "bq")} ELSE [] END,
    CASE WHEN snap THEN {_ONE("ap", "aq")} WHEN cur IS NULL OR sq <= cur THEN a WHEN sq = cur + 1 THEN {_APPLY("a", "ap", "aq")} ELSE [] END,
    CASE WHEN snap THEN 0 WHEN cur IS NULL THEN waiting + 1 ELSE waiting END, CASE WHEN NOT snap AND sq > cur + 1 THEN gaps + 1 ELSE gaps END,
    CASE WHEN snap THEN dups + waiting WHEN sq <= cur THEN dups + 1 ELSE dups END,
    CASE WHEN snap THEN CASE WHEN waiting > 0 THEN 'duplicate' ELSE 'applied' END WHEN cur IS NULL THEN 'waiting' WHEN sq <= cur THEN 'duplicate' WHEN sq = cur + 1 THEN 'applied' ELSE 'gap' END
  FROM f JOIN u ON u.entity = f.entity AND u.n = f.n + 1),
g AS (SELECT *, list_max(list_transform(b, lambda z: z.p)) AS bb, list_min(list_transform(a, lambda z: z.p)) AS ba FROM f)
SELECT CAST(entity AS VARCHAR) AS instrument, t, seq, CASE WHEN did <> 'applied' THEN did WHEN bb IS NULL OR ba IS NULL THEN 'one_sided' WHEN bb > ba THEN 'crossed' WHEN bb = ba THEN 'locked' ELSE 'normal' END AS status, cur AS last_sequence, bb AS best_bid,
  list_filter(b, lambda z: z.p = bb)[1].q AS best_bid_qty, ba AS best_ask, list_filter(a, lambda z: z.p = ba)[1].q AS best_ask_qty, CAST(len(b) AS BIGINT) AS bid_levels, CAST(len(a) AS BIGINT) AS ask_levels, gaps, dups AS duplicates FROM g"""
