"""Lifecycle, label, selection and snapshot queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import scoring
from quantloom.functions.returns import log_return, valid_price
from quantloom.models import cusp, sequential
from quantloom.operators import labels, lifecycle, triggers
from quantloom.plans.flow import event_quotes
from quantloom.plans.inputs import NS_PER_DAY, NS_PER_HOUR, r6, user_prices
from quantloom.plans.market import book_snapshots, forecasts


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_prices(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def lifecycle_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a window of an order-by-order feed: views place, clicks
    modify, errors cancel, purchases trade; ``props.k`` = 99 breaks the feed."""
    rows = _rows(spark, sf_dir)
    action = F.when(F.col("event_type") == "view", "place").when(F.col("event_type") == "click", "modify").when(F.col("event_type") == "error", "cancel")
    orders = rows.select("entity", "day", action.alias("action"), (F.col("k") != 99).alias("certified")).filter("action is not null")
    out = lifecycle.lifecycle_rates(orders, rows.filter("event_type = 'purchase'").select("entity", "day"), ["entity", "day"], 86_400.0)
    names = ["placement_rate_per_second", "cancellation_rate_per_second", "modification_rate_per_second", "cancellation_to_trade_ratio", "quote_to_trade_ratio"]
    return out.select("entity", "day", *(r6(n, 9).alias(n) for n in names), "missing_reason")


def book_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of displayed depth and spread within a day's session."""
    quotes = event_quotes(spark, sf_dir)
    rows = quotes.select("entity", "t", "seq", F.floor(F.col("t") / NS_PER_DAY).cast("long").alias("session"), F.col("bid_qty").alias("bid_depth"), F.col("ask_qty").alias("ask_depth"), (F.col("ask") - F.col("bid")).alias("absolute_spread"))
    out = lifecycle.book_changes(rows, ["entity"], ["bid_depth", "ask_depth", "absolute_spread"], "session")
    return out.select("seq", "bid_depth_change", "ask_depth_change", "absolute_spread_change")


def depth_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as shocks that halve the displayed depth, against the depths
    of the user's other events within three days."""
    rows = _rows(spark, sf_dir)
    shocks = rows.filter("event_type = 'purchase'").select(F.col("seq").alias("shock_id"), "entity", "t", (F.col("k") + 20.0).alias("pre"), (F.col("k") / 2 + 10.0).alias("post"))
    depths = rows.filter("event_type <> 'purchase'").select("entity", "t", F.col("k").cast("double").alias("depth"))
    out = lifecycle.depth_recovery(shocks, depths, "entity", 3 * NS_PER_DAY)
    return out.select("shock_id", "displayed_depth_recovery_time_ns", "book_half_life_ns", r6("displayed_depth_replenishment_fraction").alias("displayed_depth_replenishment_fraction"))


def multi_horizon_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log returns over 1, 3 and 10 events and the second difference of prices."""
    w = Window.partitionBy("entity").orderBy("t", "seq")
    rows = user_prices(spark, sf_dir).withColumn("price", valid_price(F.col("price")))
    back = lambda n: F.lag("price", n).over(w)
    return rows.select("seq", *(r6(log_return(F.col("price"), back(n))).alias(f"return_{n}") for n in (1, 3, 10)), r6(back(2) - 2 * back(1) + F.col("price")).alias("second_difference"))


LIMITS = {"depth_share": 0.3, "spread_bps": 2.0, "liquidation_notional": 100.0, "oi_drop": 0.5, "volatility_multiple": 3.0}


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a user after their first event, with the origin's state."""
    rows = _rows(spark, sf_dir)
    origin = rows.groupBy("entity").agg(F.min("t").alias("t0"), F.min_by("price", F.struct("t", "seq")).alias("p0"), F.min_by("k", F.struct("t", "seq")).alias("k0"))
    f = rows.join(origin, "entity")
    return f.select(
        "entity", "seq", F.floor((F.col("t") - F.col("t0")) / 1e9).cast("long").alias("offset_s"), log_return(F.col("price"), F.col("p0")).alias("log_return"),
        (F.col("k") / 100.0).alias("volatility"), (F.col("k0") / 100.0).alias("volatility_0"), (F.col("k") + 1.0).alias("depth"), (F.col("k0") + 1.0).alias("depth_0"), (F.col("k") % 7).cast("double").alias("spread_bps"),
        F.when(F.col("event_type") == "error", F.col("price")).otherwise(0.0).alias("liquidation_notional"), (100.0 - F.col("k")).alias("open_interest"), (100.0 - F.col("k0")).alias("open_interest_0"),
    )


def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the five rules each frame meets; the price threshold is the
    larger of a floor and a multiple of the origin's volatility."""
    rows = _frames(spark, sf_dir)
    threshold = labels.price_threshold("combined", 0.5, 1.5, F.col("volatility_0"))
    made = labels.rules(threshold, LIMITS)
    return rows.select("seq", r6(threshold).alias("threshold"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in made.items()), labels.evidence_hash(["seq", "offset_s"]).alias("evidence"))


def _first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir)
    made = labels.rules(labels.price_threshold("absolute", 0.9), LIMITS)
    long = rows.select("entity", F.floor(F.col("offset_s") / 21_600).alias("offset_s"), F.explode(F.array(*(F.struct(F.lit(n).alias("event_type"), F.coalesce(c, F.lit(False)).alias("hit")) for n, c in made.items()))).alias("e"))
    return long.groupBy("entity", "e.event_type").agg(F.when(F.bool_or("e.hit"), "occurred").otherwise("not_occurred").alias("outcome"), F.min(F.when(F.col("e.hit"), F.col("offset_s"))).alias("offset_s"))


def overlap_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First events of each origin (to the quarter day) under the three policies."""
    first, out = _first_events(spark, sf_dir), None
    for policy in ("allow", "primary", "exclude_ties"):
        one = labels.resolve_overlaps(first, ["entity"], policy).select("entity", F.lit(policy).alias("policy"), F.array_join("events", ",").alias("events"), "status")
        out = one if out is None else out.unionByName(one)
    return out


def adaptive_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.adaptive_bins(forecasts(spark, sf_dir), "p", "y", "w", 8)
    return out.select("bin", "weight", r6("mean_predicted").alias("mean_predicted"), r6("mean_observed").alias("mean_observed"))


LAMBDAS = (0.8, 0.9, 0.94, 0.97)


def volatility_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared one-step error of each decay over all users' returns; the
    least is selected, ties to the smaller decay."""
    w = Window.partitionBy("entity").orderBy("t", "seq")
    rows = user_prices(spark, sf_dir).withColumn("r", log_return(F.col("price"), F.lag("price").over(w))).filter("r is not null")
    fan = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(len(LAMBDAS) - 1)))).withColumn("key", F.col("entity") * len(LAMBDAS) + F.col("c"))

    def start(key):
        return sequential.LambdaVolatility(LAMBDAS[int(key) % len(LAMBDAS)]).update

    steps = sequential.stream_series(fan.select("key", "t", "seq", "r"), "key", "r", start, "key long, seq long, variance double, squares double, n long")
    last = steps.groupBy("key").agg(F.max_by("squares", "n").alias("squares"), F.max("n").alias("n"))
    decay = F.element_at(F.array(*map(F.lit, LAMBDAS)), (F.pmod("key", F.lit(len(LAMBDAS))) + 1).cast("int"))
    scored = last.groupBy(decay.alias("decay")).agg((F.sum("squares") / F.sum("n")).alias("mse"), F.sum("n").alias("n"))
    best = scored.agg(F.min_by("decay", F.struct("mse", "decay")).alias("best"))
    return scored.crossJoin(F.broadcast(best)).select("decay", r6("mse").alias("mse"), "n", (F.col("decay") == F.col("best")).alias("selected"))


def normalized_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A return less the mean of the 20 before it, over their deviation or a
    floor, whichever is larger; missing below five."""
    order = Window.partitionBy("entity").orderBy("t", "seq")
    rows = user_prices(spark, sf_dir).withColumn("r", log_return(F.col("price"), F.lag("price").over(order)))
    past = order.rowsBetween(-20, -1)
    z = (F.col("r") - F.avg("r").over(past)) / F.greatest(F.stddev_samp("r").over(past), F.lit(0.1))
    return rows.select("seq", r6(F.when(F.count("r").over(past) >= 5, z)).alias("state"))


def representative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three users whose terminal return is nearest to each quartile of all."""
    ends = user_prices(spark, sf_dir).withColumn("price", valid_price(F.col("price"))).filter("price is not null")
    at = F.struct("t", "seq")
    path = ends.groupBy("entity").agg(log_return(F.max_by("price", at), F.min_by("price", at)).alias("terminal"))
    marks = path.agg(F.percentile("terminal", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(F.posexplode("q").alias("quartile", "mark"))
    near = path.crossJoin(F.broadcast(marks)).withColumn("gap", F.round(F.abs(F.col("terminal") - F.col("mark")), 9))
    place = F.row_number().over(Window.partitionBy("quartile").orderBy("gap", "entity"))
    return near.withColumn("place", place).filter("place <= 3").select(F.col("quartile").cast("long").alias("quartile"), F.col("place").cast("long").alias("place"), "entity", r6("terminal").alias("terminal"))


def base_rate_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rate of each user and hour of the week: from both if there are
    enough events, else from the hour, else from all."""
    rows = user_prices(spark, sf_dir)
    hour = F.pmod(F.floor(F.col("t") / NS_PER_HOUR).cast("long") + 72, F.lit(168))
    rows = rows.select("entity", hour.alias("hour_of_week"), (F.col("price") > 50).cast("long").alias("y"))
    count = lambda *k: rows.groupBy(*k).agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    both, by_hour, every = count("entity", "hour_of_week"), count("hour_of_week"), count()
    named = lambda df, tag: df.withColumnsRenamed({"s": f"s_{tag}", "n": f"n_{tag}"})
    joined = named(both, "both").join(F.broadcast(named(by_hour, "hour")), "hour_of_week").crossJoin(F.broadcast(named(every, "all")))
    enough = lambda tag, least: F.col(f"n_{tag}") >= least
    pick = lambda c: F.when(enough("both", 3), F.col(f"{c}_both")).when(enough("hour", 20), F.col(f"{c}_hour")).otherwise(F.col(f"{c}_all"))
    stratum = F.when(enough("both", 3), "entity_hour").when(enough("hour", 20), "hour").otherwise("all")
    return joined.select("entity", "hour_of_week", stratum.alias("stratum"), r6(scoring.beta_mean(pick("s"), pick("n"), 0.5, 0.5)).alias("base_rate"))


def top_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten levels of each side of a book."""
    rows = book_snapshots(spark, sf_dir)
    side = lambda s: rows.select("part", F.lit(s).alias("side"), F.posexplode(F.slice(s, 1, 10)).alias("pos", "x"))
    return side("bids").unionByName(side("asks")).select("part", "side", (F.col("pos") + 1).cast("long").alias("level"), "x.price", "x.qty")


TRIGGERS = ["depth", "cancel", "dispersion", "open_interest", "price_return"]


def trigger_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day ends with a trigger vector: an input per event type, each
    with its own time to live."""
    rows = _rows(spark, sf_dir)
    kinds = ("view", "error", "click", "purchase", "signup")
    name = F.element_at(F.create_map(*(F.lit(x) for pair in zip(kinds, TRIGGERS, strict=True) for x in pair)), F.col("event_type"))
    inputs = rows.select(
        "entity", ((F.col("day") + 1) * NS_PER_DAY).alias("as_of_ns"), name.alias("input"), F.col("price").alias("value"), F.col("t").alias("event_ns"), (F.col("k") * 15 * 60_000_000_000).alias("ttl_ns"),
        (F.col("k") == 99).alias("source_lost"), (1_000_000 - F.col("k") * 1_100).alias("quality"), F.lit(1_000_000).alias("coverage"),
    )
    out = triggers.trigger_vectors(inputs, ["entity"], TRIGGERS, TRIGGERS[:3])
    return out.select("entity", "as_of_ns", *(r6(n).alias(n) for n in TRIGGERS), F.array_join("missing", ",").alias("missing"), "health")


CONTROLS = [cusp.ControlFeature("price", 50.0, 40.0, 0.2, 0.5, required=True), cusp.ControlFeature("k", 50.0, 25.0, 0.9, -0.3), cusp.ControlFeature("gap_h", 24.0, 12.0, -0.1, 0.4)]


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of each event from its price, ``props.k`` (missing every tenth)
    and the hours since the user's event before."""
    rows = _rows(spark, sf_dir)
    w = Window.partitionBy("entity").orderBy("t", "seq")
    rows = rows.withColumns({"price": valid_price(F.col("price")), "gap_h": (F.col("t") - F.lag("t").over(w)) / NS_PER_HOUR, "k": F.when(F.col("k") % 10 != 0, F.col("k").cast("double"))})
    alpha, beta, missing, reason = cusp.controls(CONTROLS, (0.05, 0.8))
    return rows.select("entity", "t", "seq", (F.col("price") / 50 - 1).alias("state"), alpha.alias("alpha"), beta.alias("beta"), missing.alias("missing"), reason.alias("reason"))


def cusp_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _controls(spark, sf_dir)
    return out.select("seq", r6("alpha").alias("alpha"), r6("beta").alias("beta"), F.array_join("missing", ",").alias("missing"), "reason")


def cusp_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch followed and probability of the cusp region after each event."""
    shifts = cusp.draws(np.zeros(2), np.diag([0.04, 0.02]), 64, 7)
    out = cusp.online(_controls(spark, sf_dir), "entity", shifts)
    return out.select("entity", "seq", r6("p_upper").alias("p_upper"), F.when(F.col("followed") == 1, "upper").when(F.col("followed") == 0, "lower").alias("branch"), r6("region").alias("region"))


POLICY = {"baselines": 3, "improved_ppm": 400_000, "positives": 5, "episodes": 10, "regimes": 2, "recent": -0.5, "slope_low": 0.2, "slope_high": 1.8, "intercept": 0.9, "ece": 0.6, "drift": 99}


def cusp_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's twelve checks of each user as a candidate; folds are fifths
    of the days, scores from the events' values."""
    rows = _rows(spark, sf_dir).withColumns({"fold": F.col("day") % 5, "y": (F.col("price") > 50).cast("double"), "q": F.lit(0.4)})
    rows = rows.withColumn("p", F.least(F.col("price") / 100, F.lit(1.0)))
    more = rows.groupBy("entity", "fold").agg(
        F.max("event_type").alias("regime"), F.count_distinct("day").alias("episodes"), (F.avg("k") / 50).alias("slope"), (F.avg("k") / 100 - 0.5).alias("intercept"), F.abs(F.avg("p") - F.avg("y")).alias("ece"),
        (F.avg("p") - 0.5).alias("alert_delta"), F.max("k").alias("drift"), (F.min("k") >= 0).alias("parity"), F.count_if(F.col("k") > 99).alias("failures"), F.count_distinct("event_type").alias("baselines"),
    )
    folds = cusp.fold_skills(rows, ["entity"], "fold").join(more, ["entity", "fold"])
    return cusp.gate(folds, ["entity"], POLICY).select("entity", F.array_join("failed", ",").alias("failed"), r6("brier_skill").alias("brier_skill"), "folds", "status")


QUERIES = {
    f.__name__: f
    for f in (
        cusp_controls, cusp_online, cusp_gate, lifecycle_rates, book_changes, depth_recovery, multi_horizon_returns, label_rules, overlap_policies, adaptive_calibration, volatility_selection,
        normalized_state, representative_paths, base_rate_forecasts, top_levels, trigger_vectors,
    )
}

D, H = NS_PER_DAY, NS_PER_HOUR
_E = "e AS (SELECT user_id AS entity, epoch_us(ts) * 1000 AS t, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, event_id AS seq, value AS price, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_FR = f"""{_E}, o AS (SELECT entity, min(t) AS t0, first(price ORDER BY t, seq) AS p0, first(k ORDER BY t, seq) AS k0 FROM e GROUP BY entity),
f AS (SELECT e.entity, seq, CAST(floor((t - t0) / 1e9) AS BIGINT) AS offset_s, CASE WHEN price > 0 AND p0 > 0 THEN ln(price / p0) END AS lr, k, k0, price, event_type FROM e JOIN o USING (entity))"""
_HITS = """coalesce(k / 100.0 >= 3 * (k0 / 100.0), false) AS volatility_explosion, (k + 1.0) <= 0.3 * (k0 + 1.0) AND k % 7 >= 2 AS liquidity_vacuum,
  CASE WHEN event_type = 'error' THEN price ELSE 0 END >= 100 AND (100 - k) <= 0.5 * (100 - k0) AS liquidation_cascade"""
_RET = "l AS (SELECT *, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price / lag(price) OVER w) END AS r FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, seq))"
_KINDS = list(zip(("view", "error", "click", "purchase", "signup"), TRIGGERS, strict=True))
ORACLE_SQL = {
    "lifecycle_rates": f"""WITH {_E}, c AS (SELECT entity, day, count(*) FILTER (event_type = 'view') AS p, count(*) FILTER (event_type = 'click') AS m, count(*) FILTER (event_type = 'error') AS c, count(*) FILTER (event_type = 'purchase') AS d,
  bool_and(k <> 99) FILTER (event_type IN ('view', 'click', 'error')) AS ok FROM e GROUP BY entity, day)
SELECT entity, day, CASE WHEN ok THEN round(p / 86400.0::DOUBLE, 9) + 0.0 END AS placement_rate_per_second, CASE WHEN ok THEN round(c / 86400.0::DOUBLE, 9) + 0.0 END AS cancellation_rate_per_second, CASE WHEN ok THEN round(m / 86400.0::DOUBLE, 9) + 0.0 END AS modification_rate_per_second,
  CASE WHEN ok THEN round(c / nullif(d, 0), 9) + 0.0 END AS cancellation_to_trade_ratio, CASE WHEN ok THEN round((p + c + m) / nullif(d, 0), 9) + 0.0 END AS quote_to_trade_ratio, CASE WHEN NOT ok THEN 'sequence_gap' END AS missing_reason FROM c WHERE ok IS NOT NULL""",
    "book_changes": f"""WITH {_E}, q AS (SELECT entity, t, seq, day, 1.0::DOUBLE + k AS b, 100.0::DOUBLE - k AS a, 1.0::DOUBLE + k % 3 AS s FROM e)
SELECT seq, b - lag(b) OVER w AS bid_depth_change, a - lag(a) OVER w AS ask_depth_change, s - lag(s) OVER w AS absolute_spread_change FROM q WINDOW w AS (PARTITION BY entity, day ORDER BY t, seq)""",
    "depth_recovery": f"""WITH {_E}, s AS (SELECT seq AS shock_id, entity, t, k + 20.0::DOUBLE AS pre, k / 2 + 10.0::DOUBLE AS post FROM e WHERE event_type = 'purchase'),
j AS (SELECT shock_id, e.t - s.t AS dt, (e.k - post) / (pre - post) AS back, e.seq FROM s JOIN e ON e.entity = s.entity AND e.event_type <> 'purchase' AND e.t > s.t AND e.t <= s.t + {3 * D} WHERE pre > post),
f AS (SELECT shock_id, min(dt) FILTER (back >= 1) AS r, min(dt) FILTER (back >= 0.5) AS h, arg_max(back, dt) AS z FROM j GROUP BY shock_id)
SELECT s.shock_id, r AS displayed_depth_recovery_time_ns, h AS book_half_life_ns, round(z, 6) + 0.0 AS displayed_depth_replenishment_fraction FROM s LEFT JOIN f USING (shock_id)""",
    "multi_horizon_returns": f"""WITH {_E}, p AS (SELECT entity, t, seq, CASE WHEN price > 0 THEN price END AS p FROM e)
SELECT seq, {", ".join(f"round(ln(p / lag(p, {n}) OVER w), 6) + 0.0 AS return_{n}" for n in (1, 3, 10))}, round(lag(p, 2) OVER w - 2 * lag(p) OVER w + p, 6) + 0.0 AS second_difference FROM p WINDOW w AS (PARTITION BY entity ORDER BY t, seq)""",
    "label_rules": f"""WITH {_FR}, g AS (SELECT *, CASE WHEN greatest(0.5::DOUBLE, k0 / 100.0::DOUBLE * 1.5::DOUBLE) < 1 THEN greatest(0.5::DOUBLE, k0 / 100.0::DOUBLE * 1.5::DOUBLE) END AS th FROM f)
SELECT seq, round(th, 6) + 0.0 AS threshold, coalesce(lr <= -th, false) AS downside, coalesce(lr >= th, false) AS upside, {_HITS}, sha256(concat_ws('|', CAST(seq AS VARCHAR), CAST(offset_s AS VARCHAR))) AS evidence FROM g""",
    "overlap_policies": f"""WITH {_FR}, g AS (SELECT entity, offset_s // 21600 AS q, coalesce(lr <= -0.9, false) AS downside, coalesce(lr >= 0.9, false) AS upside, {_HITS} FROM f),
u AS (SELECT entity, unnest(['liquidity_vacuum', 'liquidation_cascade', 'downside', 'upside', 'volatility_explosion']) AS ev, unnest([1, 2, 3, 4, 5]) AS pr, q, unnest([liquidity_vacuum, liquidation_cascade, downside, upside, volatility_explosion]) AS hit FROM g),
m AS (SELECT entity, ev, any_value(pr) AS pr, min(q) AS q FROM u WHERE hit GROUP BY entity, ev),
a AS (SELECT entity, string_agg(ev, ',' ORDER BY q, pr) AS every, arg_min(ev, q * 10 + pr) AS one, min(q) AS q0 FROM m GROUP BY entity), c AS (SELECT entity, count(*) AS ties FROM m JOIN a USING (entity) WHERE q = q0 GROUP BY entity),
b AS (SELECT DISTINCT entity FROM f)
SELECT b.entity, policy, coalesce(CASE policy WHEN 'allow' THEN every WHEN 'primary' THEN one ELSE CASE WHEN ties > 1 THEN '' ELSE one END END, '') AS events, CASE WHEN one IS NULL THEN 'none' WHEN policy = 'exclude_ties' AND ties > 1 THEN 'excluded' ELSE 'resolved' END AS status
FROM b LEFT JOIN a USING (entity) LEFT JOIN c USING (entity), (SELECT unnest(['allow', 'primary', 'exclude_ties']) AS policy)""",
    "adaptive_calibration": """WITH RECURSIVE f AS (SELECT (doc_id % 97 + 1) / 99.0::DOUBLE AS p, sum(1.0::DOUBLE + quality) AS w, sum((1.0::DOUBLE + quality) * toxic) AS wy FROM labels GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY p) AS rn, sum(w) OVER () / 8 AS target FROM f),
g AS (SELECT rn, 0::BIGINT AS bin, w, w * p AS wp, wy, w >= target AS full_ FROM o WHERE rn = 1
  UNION ALL SELECT o.rn, CASE WHEN full_ THEN bin + 1 ELSE bin END, CASE WHEN full_ THEN 0 ELSE g.w END + o.w, CASE WHEN full_ THEN 0 ELSE g.wp END + o.w * p, CASE WHEN full_ THEN 0 ELSE g.wy END + o.wy, CASE WHEN full_ THEN 0 ELSE g.w END + o.w >= target FROM g JOIN o ON o.rn = g.rn + 1)
SELECT bin, arg_max(w, rn) AS weight, round(arg_max(wp, rn) / arg_max(w, rn), 6) + 0.0 AS mean_predicted, round(arg_max(wy, rn) / arg_max(w, rn), 6) + 0.0 AS mean_observed FROM g GROUP BY bin""",
    "volatility_selection": f"""WITH RECURSIVE {_E}, {_RET}, x AS (SELECT entity, r * r AS x, row_number() OVER (PARTITION BY entity ORDER BY t, seq) AS rn FROM l WHERE r IS NOT NULL), c AS (SELECT unnest([0.8, 0.9, 0.94, 0.97])::DOUBLE AS decay),
f AS (SELECT decay, entity, rn, x AS v, 0.0::DOUBLE AS sq, 0::BIGINT AS n FROM x, c WHERE rn = 1 UNION ALL SELECT decay, x.entity, x.rn, decay * v + (1 - decay) * x, sq + (x - v) * (x - v), n + 1 FROM f JOIN x ON x.entity = f.entity AND x.rn = f.rn + 1),
z AS (SELECT decay, entity, arg_max(sq, rn) AS sq, max(n) AS n FROM f GROUP BY decay, entity), s AS (SELECT decay, sum(sq) / sum(n) AS mse, CAST(sum(n) AS BIGINT) AS n FROM z GROUP BY decay)
SELECT decay, round(mse, 6) + 0.0 AS mse, n, mse = min(mse) OVER () AS selected FROM s""",
    "normalized_state": f"""WITH {_E}, {_RET}
SELECT seq, round(CASE WHEN count(r) OVER p >= 5 THEN (r - avg(r) OVER p) / greatest(stddev_samp(r) OVER p, 0.1::DOUBLE) END, 6) + 0.0 AS state FROM l WINDOW p AS (PARTITION BY entity ORDER BY t, seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "representative_paths": f"""WITH {_E}, p AS (SELECT entity, ln(last(price ORDER BY t, seq) / first(price ORDER BY t, seq)) AS terminal FROM e WHERE price > 0 GROUP BY entity),
m AS (SELECT quantile_cont(terminal, [0.25, 0.5, 0.75]) AS q FROM p), k AS (SELECT unnest([0, 1, 2])::BIGINT AS quartile, unnest(q) AS mark FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY round(abs(terminal - mark), 9), entity) AS place FROM p, k)
SELECT quartile, place, entity, round(terminal, 6) + 0.0 AS terminal FROM n WHERE place <= 3""",
    "base_rate_forecasts": f"""WITH {_E}, h AS (SELECT entity, (CAST(floor(t / {float(H)!r}) AS BIGINT) + 72) % 168 AS hour_of_week, CASE WHEN price > 50 THEN 1 ELSE 0 END AS y FROM e),
b AS (SELECT entity, hour_of_week, sum(y) AS s, count(*) AS n FROM h GROUP BY ALL), w AS (SELECT hour_of_week, sum(y) AS s, count(*) AS n FROM h GROUP BY ALL), a AS (SELECT sum(y) AS s, count(*) AS n FROM h)
SELECT b.entity, b.hour_of_week, CASE WHEN b.n >= 3 THEN 'entity_hour' WHEN w.n >= 20 THEN 'hour' ELSE 'all' END AS stratum, round(CASE WHEN b.n >= 3 THEN (b.s + 0.5) / (b.n + 1) WHEN w.n >= 20 THEN (w.s + 0.5) / (w.n + 1) ELSE (a.s + 0.5) / (a.n + 1) END, 6) + 0.0 AS base_rate FROM b JOIN w USING (hour_of_week), a""",
    "top_levels": """WITH l AS (SELECT l_partkey AS part, l_linenumber % 2 = 0 AS bid, CAST(1000 + l_partkey % 50 + (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) * (1 + l_orderkey % 15) AS DOUBLE) AS price, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY part, bid ORDER BY CASE WHEN bid THEN -price ELSE price END) AS level FROM l)
SELECT part, CASE WHEN bid THEN 'bids' ELSE 'asks' END AS side, level, price, qty FROM r WHERE level <= 10""",
    "trigger_vectors": f"""WITH {_E}, n AS (SELECT entity, (day + 1) * {D} AS as_of_ns, bool_or(k = 99) AS lost, min(1000000 - k * 1100) AS quality, {", ".join(f"arg_max(price, t) FILTER (event_type = '{e}') AS {n}_v, max(t) FILTER (event_type = '{e}') AS {n}_t, arg_max(k, t) FILTER (event_type = '{e}') * 900000000000 AS {n}_l" for e, n in _KINDS)} FROM e GROUP BY entity, day),
r AS (SELECT *, {", ".join(("CASE WHEN lost THEN 'source_disconnected' " if n in TRIGGERS[:3] else "CASE ") + f"WHEN {n}_v IS NULL THEN 'missing' WHEN as_of_ns - {n}_t > {n}_l THEN 'expired' END AS {n}_r" for n in TRIGGERS)} FROM n)
SELECT entity, as_of_ns, {", ".join(f"CASE WHEN {n}_r IS NULL THEN round({n}_v, 6) + 0.0 END AS {n}" for n in TRIGGERS)}, concat_ws(',', {", ".join(f"'{n}:' || {n}_r" for n in TRIGGERS)}) AS missing,
  CASE WHEN lost THEN 'unavailable' WHEN {" OR ".join(f"{n}_r IS NOT NULL" for n in TRIGGERS)} OR quality < 900000 THEN 'degraded' ELSE 'healthy' END AS health FROM r""",
    "cusp_controls": f"""WITH {_E}, c AS (SELECT seq, CASE WHEN price > 0 THEN price END AS p, CASE WHEN k % 10 <> 0 THEN k END AS k, (t - lag(t) OVER (PARTITION BY entity ORDER BY t, seq)) / {float(H)!r}::DOUBLE AS g FROM e),
z AS (SELECT seq, p, k, g, (p - 50) / 40 AS zp, coalesce((k - 50) / 25.0::DOUBLE, 0) AS zk, coalesce((g - 24) / 12, 0) AS zg FROM c)
SELECT seq, round(0.05::DOUBLE + 0.2::DOUBLE * zp + 0.9::DOUBLE * zk - 0.1::DOUBLE * zg, 6) + 0.0 AS alpha, round(0.8::DOUBLE + 0.5::DOUBLE * zp - 0.3::DOUBLE * zk + 0.4::DOUBLE * zg, 6) + 0.0 AS beta,
  concat_ws(',', CASE WHEN k IS NULL THEN 'k' END, CASE WHEN g IS NULL THEN 'gap_h' END) AS missing, CASE WHEN p IS NULL THEN 'required_feature_missing' END AS reason FROM z""",
    "cusp_gate": f"""WITH {_E}, r AS (SELECT *, day % 5 AS fold, CASE WHEN price > 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS y, least(price / 100, 1.0) AS p FROM e),
f AS (SELECT entity, fold, count(*) AS w, avg((0.4::DOUBLE - y) * (0.4::DOUBLE - y)) AS b, avg((p - y) * (p - y)) AS c, sum(y) AS pos, max(event_type) AS regime, count(DISTINCT day) AS ep, avg(k) / 50 AS sl, avg(k) / 100 - 0.5 AS ic, abs(avg(p) - avg(y)) AS ece, avg(p) - 0.5 AS al, max(k) AS dr, count(DISTINCT event_type) AS bl FROM r GROUP BY entity, fold),
g AS (SELECT entity, count(*) AS folds, 1 - sum(w * c) / nullif(sum(w * b), 0) AS skill, min(bl) AS bl, avg(CASE WHEN c < b THEN 1.0 ELSE 0.0 END) * 1000000 AS imp, sum(pos) AS pos, sum(ep) AS ep, count(DISTINCT CASE WHEN c < b THEN regime END) AS rg, arg_max(1 - c / nullif(b, 0), fold) AS rec,
  bool_and(sl BETWEEN 0.2 AND 1.8 AND abs(ic) <= 0.9 AND ece <= 0.6) AS cal, sum(w * al) AS al, max(dr) AS dr FROM f GROUP BY entity),
x AS (SELECT *, concat_ws(',', CASE WHEN bl < 3 THEN 'required_baselines' END, CASE WHEN coalesce(round(skill * 1000000) <= 0, true) THEN 'positive_primary_score' END, CASE WHEN imp < 400000 THEN 'improved_fold_fraction' END, CASE WHEN pos < 5 THEN 'minimum_positive_events' END,
  CASE WHEN ep < 10 THEN 'independent_episodes' END, CASE WHEN rg < 2 THEN 'multi_regime_improvement' END, CASE WHEN coalesce(rec < -0.5, true) THEN 'recent_fold_safety' END, CASE WHEN NOT cal THEN 'calibration' END, CASE WHEN al > 0 THEN 'alert_budget_improvement' END, CASE WHEN dr > 99 THEN 'coefficient_stability' END) AS failed FROM g)
SELECT entity, failed, round(skill, 6) + 0.0 AS brier_skill, folds, CASE WHEN failed = '' THEN 'eligible' ELSE 'research_only' END AS status FROM x""",
}
