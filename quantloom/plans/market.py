"""Point-in-time, market, label and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import book, derivatives, scoring
from quantloom.functions.returns import log_return
from quantloom.operators import joins, labels, market
from quantloom.plans.inputs import NS_PER_DAY, NS_PER_HOUR, nanos, r6, sql_round, table, user_prices

IDENTITY = ["feature_id", "event_time_start_ns", "event_time_end_ns"]


def revised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature per user and day whose revisions are the day's events as they
    became known (``props.k`` hours after they happened)."""
    rows = user_prices(spark, sf_dir)
    known = F.col("t") + F.get_json_object("props", "$.k").cast("long") * NS_PER_HOUR
    order = Window.partitionBy("entity", "day").orderBy("as_known_at_ns", "seq")
    rows = rows.withColumn("as_known_at_ns", F.greatest(known, (F.col("day") + 1) * NS_PER_DAY))
    return rows.select(
        "entity",
        F.lit("daily_value").alias("feature_id"),
        (F.col("day") * NS_PER_DAY).alias("event_time_start_ns"),
        ((F.col("day") + 1) * NS_PER_DAY).alias("event_time_end_ns"),
        "as_known_at_ns",
        (F.col("as_known_at_ns") + 1000).alias("computed_at_ns"),
        F.col("as_known_at_ns").alias("finality_as_known_at_ns"),
        F.row_number().over(order).cast("long").alias("revision"),
        F.when(F.row_number().over(order) > 1, "corrected").otherwise("final").alias("finality_state"),
        F.col("price").alias("value"),
    )


def pit_training_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases predict from what was known of their user's past days."""
    rows = user_prices(spark, sf_dir).filter("event_type = 'purchase'")
    asks = rows.select(F.col("seq").alias("prediction_id"), "entity", F.col("t").alias("prediction_ns"))
    out = joins.point_in_time_join(asks, revised_features(spark, sf_dir), "entity", IDENTITY)
    return out.select("prediction_id", "event_time_start_ns", "revision", "as_known_at_ns", "value")


def revision_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window as it was known half a month into the data."""
    features = revised_features(spark, sf_dir)
    when = F.lit(1_705_276_800_000_000_000)
    out = joins.as_known_at(features, when, ["entity", *IDENTITY])
    faults = joins.revision_faults(features, ["entity", *IDENTITY]).groupBy().count().select(F.col("count").alias("faulty_histories"))
    return out.select("entity", "event_time_start_ns", "revision", "value").crossJoin(F.broadcast(faults))


def catalog_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as instrument definitions of their customer: listed from one order
    to the next; events of the user of that number are resolved against them."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), nanos("o_orderdate").alias("valid_from_ns")).agg(F.max("o_orderkey").alias("definition"))
    order = Window.partitionBy("entity").orderBy("valid_from_ns")
    o = o.withColumn("valid_to_ns", F.lead("valid_from_ns").over(order))
    rows = user_prices(spark, sf_dir).select("entity", "seq", "t")
    return joins.range_join(rows, o, "entity", "t", "valid_from_ns", "valid_to_ns").select("seq", "entity", "definition", "valid_from_ns", "valid_to_ns")


def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily origins: three features of a user's day, a label of the next day."""
    rows = user_prices(spark, sf_dir)
    day = rows.groupBy("entity", "day").agg(F.count("*").cast("double").alias("n"), F.max("price").alias("high"), F.min("price").alias("low"), F.max("t").alias("last"))
    origin = ((F.col("day") + 1) * NS_PER_DAY).alias("origin_ns")
    long = day.select("entity", origin, F.col("last").alias("event_time_end_ns"), (F.col("last") + NS_PER_HOUR).alias("as_known_at_ns"), (1_000_000 - F.col("n").cast("long") * 1000).alias("quality_millionths"), F.expr("stack(3, 'count', n, 'high', high, 'low', low) as (feature_id, value)"))
    label = rows.groupBy("entity", (F.col("day") * NS_PER_DAY).alias("origin_ns")).agg(F.max((F.col("price") > 100).cast("int")).alias("outcome"))
    universe = rows.groupBy("entity").agg((F.min("day") * NS_PER_DAY).alias("valid_from_ns"), ((F.max("day") - 2) * NS_PER_DAY).alias("valid_to_ns"), F.min("t").alias("known_at_ns"))
    out = joins.dataset_rows(long, label, universe, ["entity"], 990_000)
    return out.select("entity", "origin_ns", "quality_millionths", "outcome", F.size("features").cast("long").alias("n_features"), r6(F.aggregate("features", F.lit(0.0), lambda s, x: s + x["value"])).alias("total"))


def venue_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as quotes of a part at a supplier: last price, depth, health."""
    rows = table(spark, sf_dir, "lineitem")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")
    return rows.groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("venue")).agg(
        F.max(price).cast("double").alias("price"), F.sum("l_quantity").cast("long").alias("depth"), F.max(nanos("l_shipdate")).alias("event_ns"), F.max("l_returnflag").alias("flag")
    )


def fair_price_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible venues (health by return flag, a time to live), without
    outliers beyond 40% of the median, weighted by depth."""
    rows = venue_quotes(spark, sf_dir)
    rows = rows.withColumns(
        {
            "source_health": F.when(F.col("flag") == "R", "degraded").otherwise("healthy"),
            "as_of_ns": F.lit(915_148_800_000_000_000),
            "as_known_ns": F.col("event_ns"),
            "ttl_ns": F.lit(2500 * NS_PER_DAY),
        }
    )
    rows = rows.withColumn("reason", market.exclusion_reason(rows.columns))
    good = market.without_outliers(rows.filter("reason is null"), ["part"], "price", 400_000)
    fair = market.weighted_median(good, ["part"], "price", "depth", "venue")
    counted = rows.groupBy("part").agg(F.count("*").alias("venues"), F.count("reason").alias("excluded"))
    return counted.join(fair, "part", "left").select("part", "venues", "excluded", F.col("weighted_median").alias("fair_price"))


def capped_venue_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = venue_quotes(spark, sf_dir)
    out = market.with_capped_weights(rows.select("part", "venue", "depth"), ["part"], "depth", "venue", 400_000)
    return out.select("part", "venue", "depth", "weight_ppm")


def venue_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.dispersion(venue_quotes(spark, sf_dir).withColumn("size", F.col("depth").cast("double")), ["part"], "price", "size")
    return out.select("part", "venues", *(r6(c).alias(c) for c in ("cross_venue_median_absolute_dispersion", "indicative_cross_venue_price_range", "venue_concentration_index")))


def book_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic book per part: its lineitems' quantities at ticks around a
    price set by the part key; even line numbers are bids."""
    rows = table(spark, sf_dir, "lineitem")
    base = 1000 + F.pmod("l_partkey", F.lit(50))
    tick = (1 + F.pmod(F.col("l_orderkey"), F.lit(15))).cast("double")
    bid = F.pmod(F.col("l_linenumber"), F.lit(2)) == 0
    level = rows.groupBy(F.col("l_partkey").alias("part"), bid.alias("bid"), F.when(bid, base - tick).otherwise(base + tick).alias("price")).agg(F.sum("l_quantity").alias("qty"))
    side = lambda is_bid: F.array_sort(F.collect_list(F.when(F.col("bid") == is_bid, F.struct("price", "qty"))))
    out = level.groupBy("part").agg(side(True).alias("up"), side(False).alias("asks"))
    return out.select("part", F.reverse("up").alias("bids"), "asks")


def book_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book_snapshots(spark, sf_dir).withColumn("mid", book.mid())
    rows = rows.withColumns({"near_bids": book.depths("bids", F.col("mid")), "near_asks": book.depths("asks", F.col("mid"))})
    near = lambda side, bps: F.when(F.col("mid").isNotNull(), F.col(f"near_{side}.b{bps}")).otherwise(0.0)
    entropy, concentration = book.entropy_and_concentration()
    bid_slope, bid_convexity = book.slope_and_convexity("bids", 1.0)
    ask_slope, ask_convexity = book.slope_and_convexity("asks", 1.0)
    made = {
        "absolute_spread": book.absolute_spread(),
        "relative_spread": book.relative_spread(),
        **{f"bid_depth_{b}bps": near("bids", b) for b in book.BANDS},
        **{f"ask_depth_{b}bps": near("asks", b) for b in book.BANDS},
        **{f"book_imbalance_{b}bps": book.imbalance_of(near("bids", b), near("asks", b)) for b in book.BANDS},
        "weighted_midpoint": book.weighted_midpoint(),
        "microprice": book.microprice(),
        "bid_book_slope": bid_slope,
        "ask_book_slope": ask_slope,
        "bid_book_convexity": bid_convexity,
        "ask_book_convexity": ask_convexity,
        "bid_liquidity_wall_distance": book.wall_distance("bids", 60_000.0),
        "ask_liquidity_wall_distance": book.wall_distance("asks", 60_000.0),
        "bid_price_level_gap_density": book.gap_density("bids", 1.0),
        "ask_price_level_gap_density": book.gap_density("asks", 1.0),
        "maximum_executable_buy_quote_notional": book.executable_notional("asks", 25),
        "maximum_executable_sell_quote_notional": book.executable_notional("bids", 25),
        "expected_buy_sweep_cost": book.sweep_cost("asks", 10_000.0),
        "expected_sell_sweep_cost": book.sweep_cost("bids", 10_000.0),
        "local_book_entropy": entropy,
        "depth_concentration_by_level": concentration,
    }
    return rows.select(
        "part",
        book.classification().alias("classification"),
        F.size("bids").cast("long").alias("bid_active_price_levels"),
        F.size("asks").cast("long").alias("ask_active_price_levels"),
        *(sql_round(c, 9).alias(n) for n, c in made.items()),
    )


def competing_first_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event is an origin; later ones are frames at their
    offset in seconds, in the order of time and id.  Upside and downside by
    value against the origin's."""
    rows = user_prices(spark, sf_dir)
    start = rows.groupBy("entity").agg(F.min("t").alias("t0"), F.min_by("price", F.struct("t", "seq")).alias("p0"))
    f = rows.join(start, "entity").withColumn("offset_s", F.floor((F.col("t") - F.col("t0")) / 1e9).cast("long"))
    f = f.withColumns({"known_s": F.col("offset_s") + 60, "trusted": (F.col("event_type") != "error") | (F.col("offset_s") < 200_000), "excluded": (F.col("event_type") == "error") & (F.pmod("seq", F.lit(2)) == 0), "ret": log_return(F.col("price"), F.col("p0"))})
    out = None
    for name, condition in (("downside", F.col("ret") <= -1.0), ("upside", F.col("ret") >= 1.0)):
        one = labels.first_passage(f, ["entity"], condition, 864_000, 3_600, ("t", "seq")).withColumn("event_type", F.lit(name))
        out = one if out is None else out.unionByName(one)
    first = labels.resolve_competing(out, ["entity"]).select("entity", F.col("event_type").alias("primary_event"))
    return out.join(first, "entity", "left").select("entity", "event_type", "outcome", "offset_s", "known_s", "observed_s", "primary_event")


def walk_forward_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_prices(spark, sf_dir)
    samples = rows.select("seq", F.col("t").alias("origin_ns"), (F.col("t") + 6 * NS_PER_HOUR).alias("outcome_end_ns"), (F.col("t") + 7 * NS_PER_HOUR).alias("as_known_ns"))
    low, high = samples.agg(F.min("origin_ns"), F.max("origin_ns")).first()
    folds = labels.outer_folds(low, high, 10 * NS_PER_DAY, 4 * NS_PER_DAY, 4 * NS_PER_DAY, NS_PER_DAY, 3 * NS_PER_DAY)
    return labels.fold_membership(spark, samples, folds).select("seq", "fold", "part")


def base_rate_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of large values by user, hour of week and both, over one scan."""
    rows = user_prices(spark, sf_dir)
    hour = F.pmod(F.floor(F.col("t") / NS_PER_HOUR).cast("long") + 72, F.lit(168))
    rows = rows.select("entity", hour.alias("hour_of_week"), (F.col("price") > 50).cast("long").alias("y"))
    out = rows.groupingSets([["entity"], ["hour_of_week"], ["entity", "hour_of_week"], []], "entity", "hour_of_week").agg(F.sum("y").alias("successes"), F.count("*").alias("n"))
    return out.select("entity", "hour_of_week", "successes", "n", r6(scoring.beta_mean(F.col("successes"), F.col("n"), 0.5, 0.5)).alias("posterior_mean"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as forecasts: a probability from the id, the toxic
    label as outcome, quality as weight."""
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", ((F.pmod("doc_id", F.lit(97)) + 1) / 99.0).alias("p"), F.col("toxic").cast("double").alias("y"), (1.0 + F.col("quality")).alias("w"))


def probability_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y, w = F.col("p"), F.col("y"), F.col("w")
    rows = forecasts(spark, sf_dir)
    share = F.sum(w * y) / F.sum(w)
    one = rows.agg(
        r6(scoring.log_loss(p, y, w)).alias("log_loss"),
        r6(scoring.brier(p, y, w)).alias("brier"),
        scoring.effective_size(w).alias("ess"),
        share.alias("base_rate"),
    )
    ece = scoring.calibration_error(scoring.reliability_bins(rows, "p", "y", "w", 10))
    return one.crossJoin(ece).select(
        "log_loss",
        "brier",
        r6("ess").alias("ess"),
        r6("base_rate").alias("base_rate"),
        r6(scoring.wilson(F.col("base_rate"), F.col("ess"), False)).alias("wilson_low"),
        r6(scoring.wilson(F.col("base_rate"), F.col("ess"), True)).alias("wilson_high"),
        r6(1 - F.col("brier") / (F.col("base_rate") * (1 - F.col("base_rate")))).alias("brier_skill"),
        r6("ece").alias("ece"),
    )


def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.reliability_bins(forecasts(spark, sf_dir), "p", "y", "w", 10)
    return out.select("bin", "weight", r6("mean_predicted").alias("mean_predicted"), r6("mean_observed").alias("mean_observed"))


def hazen_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {f"p{q:02d}": q / 100 for q in (5, 25, 50, 75, 95)}
    out = scoring.order_statistics(user_prices(spark, sf_dir), ["event_type"], "price", names, {f"nr{q:02d}": q for q in (50, 95, 99)})
    return out.select("event_type", *(r6(n).alias(n) for n in names), "nr50", "nr95", "nr99")


def label_centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novelty of each embedding: nearest of its training centroids, one per
    label.  The centroids (labels times dimensions, a model's size) are one row
    that every vector is compared with; vectors are neither exploded nor moved."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("c"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda z: z["c"]).alias("c"))
    every = centre.agg(F.collect_list(F.struct("label", "c")).alias("centres"))
    d = F.transform("centres", lambda z: F.struct(scoring.squared_distance(F.col("v"), z["c"]).alias("d2"), z["label"].alias("label")))
    d = rows.crossJoin(F.broadcast(every)).select("vec_id", d.alias("d"))
    nearest = F.array_min(F.transform("d", lambda z: F.struct(F.round(z["d2"], 9).alias("d2"), z["label"].alias("label"))))["label"]
    return d.select("vec_id", nearest.alias("nearest_label"), r6(F.sqrt(F.array_min(F.transform("d", lambda z: z["d2"])))).alias("distance"))


def fast_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger kernels over consecutive events of a user."""
    rows = user_prices(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    w = Window.partitionBy("entity").orderBy("t", "seq")
    p, k = F.col("price"), F.col("k")
    rows = rows.withColumns({"dp": p - F.lag(p).over(w), "dk": k - F.lag(k).over(w), "dt": F.col("t") - F.lag("t").over(w), "ret": log_return(p, F.lag(p).over(w)), "oi": k / F.nullif(F.lag(k).over(w), F.lit(0.0)) - 1})
    rows = rows.filter("dt is not null")
    d = derivatives
    destruction = d.open_interest_destruction(F.col("ret"), F.col("oi"))
    return rows.select(
        "seq",
        r6(d.depth_disappearance(F.col("dp"), F.col("dk"))).alias("depth_disappearance"),
        r6(d.cancellation_burst(p, k / 100)).alias("cancellation_burst"),
        r6(d.dispersion_acceleration(p, p - F.col("dp"), F.col("dt"))).alias("dispersion_acceleration"),
        r6(destruction).alias("open_interest_destruction"),
        r6(d.liquidation_pressure(p, k / 100, F.coalesce(destruction, F.lit(0.0)))).alias("liquidation_pressure"),
        d.trigger_health(F.col("event_type") == "error", (F.col("oi").isNull()).cast("int"), (1_000_000 - k * 1500).cast("long"), F.lit(1_000_000)).alias("health"),
    )


def derivative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding, open interest, mark/index and liquidations of a user-day."""
    rows = user_prices(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    w = Window.partitionBy("entity").orderBy("day")
    at = F.struct("t", "seq")
    day = rows.groupBy("entity", "day").agg(F.max_by("k", at).alias("funding"), F.max_by("price", at).alias("oi"), F.avg("price").alias("mark"), F.median("price").alias("index"), F.count_if(F.col("event_type") == "error").alias("liq"), F.sum(F.when(F.col("event_type") == "error", F.col("price"))).alias("liq_notional"))
    return day.select(
        "entity",
        "day",
        F.col("funding").alias("predicted_funding_rate"),
        (F.col("funding") - F.lag("funding").over(w)).alias("funding_rate_change"),
        r6("oi").alias("open_interest_native"),
        r6(derivatives.relative_change(F.col("oi"), F.lag("oi").over(w))).alias("open_interest_relative_change"),
        r6(derivatives.mark_index_divergence(F.col("mark"), F.col("index"))).alias("mark_index_divergence"),
        F.col("liq").alias("liquidation_observed_count"),
        r6("liq_notional").alias("liquidation_observed_notional"),
        r6(F.col("liq") / 86_400.0 * 1000).alias("liquidation_observed_velocity_per_1000_s"),
    )


def hazard_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazards of two causes by hour since a user's first event; cumulative
    incidence over the first 24 buckets."""
    rows = user_prices(spark, sf_dir)
    t0 = Window.partitionBy("entity")
    rows = rows.withColumn("bucket", F.floor((F.col("t") - F.min("t").over(t0)) / (6 * NS_PER_HOUR)).cast("long")).filter("bucket < 24")
    n = rows.groupBy("event_type", "bucket").agg(F.count_if(F.col("price") > 100).alias("up"), F.count_if(F.col("price") < 10).alias("down"), F.count("*").alias("n"))
    h = n.select("event_type", "bucket", (F.col("up") / (F.col("n") * 3.7)).alias("up"), (F.col("down") / (F.col("n") * 3.7)).alias("down"))
    out = scoring.cumulative_incidence(h, ["event_type"], ["up", "down"])
    return out.select("event_type", "bucket", *(r6(c, 9).alias(c) for c in ("survival_before", "cif_up", "cif_down")))


def cusp_equilibria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls from an event's value and ``k``: roots, their number, stability."""
    rows = user_prices(spark, sf_dir)
    a = F.get_json_object("props", "$.k").cast("double") / 50 - 1.013
    b = F.least(F.col("price") / 50, F.lit(4.0)) - 1.007
    rows = rows.select("seq", a.alias("alpha"), b.alias("beta"))
    rows = rows.withColumn("roots", derivatives.cusp_roots(F.col("alpha"), F.col("beta")))
    flat = rows.select("seq", "alpha", "beta", F.size("roots").cast("long").alias("n_roots"), F.posexplode("roots").alias("pos", "y"))
    residual = F.abs(derivatives.cusp_gradient(F.col("y"), F.col("alpha"), F.col("beta")))
    stable = F.when(3 * F.col("y") * F.col("y") > F.col("beta"), "stable").otherwise("unstable")
    return flat.select("seq", "n_roots", F.col("pos").cast("long").alias("pos"), r6("y").alias("root"), (residual < 1e-9).alias("solves"), stable.alias("stability"))


def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's 20 largest contributions by size, split by sign."""
    rows = user_prices(spark, sf_dir).select("entity", "seq", (F.col("price") - 50).alias("c"))
    best = Window.partitionBy("entity").orderBy(F.desc(F.abs("c")), "seq")
    top = rows.withColumn("rank", F.row_number().over(best)).filter("rank <= 20")
    return top.select("entity", "seq", F.col("rank").cast("long").alias("rank"), r6("c").alias("contribution"), F.when(F.col("c") >= 0, "supporting").otherwise("opposing").alias("direction"))


def forecast_outcome_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts (clicks, horizons of 1 and 3 days) with the first purchase of
    the user known after issue and within the horizon."""
    rows = user_prices(spark, sf_dir)
    issued = rows.filter("event_type = 'click'").select(F.col("seq").alias("forecast_id"), "entity", (F.col("t") + 1).alias("t"))
    outcome = rows.filter("event_type = 'purchase'").select("entity", "t", F.col("t").alias("value"))
    first = joins.asof_forward(issued, outcome, "entity").select("forecast_id", F.col("t").alias("after"), F.col("value").alias("first_ns"))
    points = first.withColumn("horizon_days", F.explode(F.array(F.lit(1), F.lit(3))))
    known = F.when(F.col("first_ns") < F.col("after") + F.col("horizon_days").cast("long") * NS_PER_DAY, F.col("first_ns"))
    return points.select("forecast_id", "horizon_days", known.alias("known_ns"), known.isNotNull().alias("occurred"))


def promotion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate per user: folds are days, skill from the events' values.

    Whether a day's mean is above 45 is decided on an exact sum: a sum of
    doubles may come out above it, by the order of the rows, where the mean is
    45.  Values that a decimal does not hold are left to the doubles."""
    rows = user_prices(spark, sf_dir).withColumn("exact", F.expr("try_cast(price as decimal(38, 20))"))
    held = F.count("exact") == F.count("price")
    above = F.when(held, F.try_sum("exact") > (F.count("price") * 45).cast("decimal(38, 20)"))
    fold = rows.groupBy("entity", "day").agg(F.coalesce(above, F.avg("price") - 45 > 0).alias("skilled"), F.count_if(F.col("price") > 100).alias("positives"), F.max("event_type").alias("regime"))
    m = fold.groupBy("entity").agg(F.sum("positives").alias("positives"), F.countDistinct("regime").alias("regimes"), F.avg(F.when(F.col("skilled"), 1.0).otherwise(0.0)).alias("share"))
    reasons = F.array_compact(F.array(F.when(F.col("positives") < 3, "insufficient_positives"), F.when(F.col("regimes") < 3, "insufficient_regimes"), F.when(F.col("share") < 0.7, "insufficient_skill")))
    return m.select("entity", F.col("positives").cast("long").alias("positives"), "regimes", r6("share").alias("share"), F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("promoted"))


QUERIES = {
    f.__name__: f
    for f in (
        pit_training_join, revision_asof, catalog_asof, dataset_rows, fair_price_weighted_median, capped_venue_weights, venue_concentration, book_features,
        competing_first_passage, walk_forward_membership, base_rate_strata, probability_metrics, reliability_table, hazen_quantiles, label_centroid_distance,
        fast_triggers, derivative_features, hazard_incidence, cusp_equilibria, evidence_topk, forecast_outcome_join, promotion_checks,
    )
}

D, H = NS_PER_DAY, NS_PER_HOUR
_E = "e AS (SELECT user_id AS entity, epoch_us(ts) * 1000 AS t, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, event_id AS seq, value AS price, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_F = f"""{_E}, f0 AS (SELECT entity, day, seq, price, greatest(t + k * {H}, (day + 1) * {D}) AS ak FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY entity, day ORDER BY ak, seq) AS revision FROM f0)"""
_Q = "q AS (SELECT l_partkey AS part, l_suppkey AS venue, CAST(max(CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT)) AS DOUBLE) AS price, CAST(sum(l_quantity) AS BIGINT) AS depth, max(epoch_us(l_shipdate) * 1000) AS ev, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"
ORACLE_SQL = {
    "pit_training_join": f"""WITH {_F}, p AS (SELECT seq AS prediction_id, entity, t FROM e WHERE event_type = 'purchase'),
j AS (SELECT prediction_id, f.day * {D} AS s, revision, ak, price, row_number() OVER (PARTITION BY prediction_id, f.day ORDER BY revision DESC) AS rk
  FROM p JOIN f ON p.entity = f.entity AND (f.day + 1) * {D} <= p.t AND ak <= p.t AND ak + 1000 <= p.t)
SELECT prediction_id, s AS event_time_start_ns, revision, ak AS as_known_at_ns, price AS value FROM j WHERE rk = 1""",
    "revision_asof": f"""WITH {_F}, j AS (SELECT *, row_number() OVER (PARTITION BY entity, day ORDER BY revision DESC) AS rk FROM f WHERE ak + 1000 <= 1705276800000000000)
SELECT entity, day * {D} AS event_time_start_ns, revision, price AS value, CAST(0 AS BIGINT) AS faulty_histories FROM j WHERE rk = 1""",
    "catalog_asof": f"""WITH {_E}, o AS (SELECT o_custkey AS entity, epoch_us(o_orderdate) * 1000 AS f, max(o_orderkey) AS definition FROM orders GROUP BY ALL),
v AS (SELECT *, lead(f) OVER (PARTITION BY entity ORDER BY f) AS x FROM o)
SELECT e.seq, e.entity, v.definition, v.f AS valid_from_ns, v.x AS valid_to_ns FROM e JOIN v ON e.entity = v.entity AND e.t >= v.f AND (v.x IS NULL OR e.t < v.x)""",
    "dataset_rows": f"""WITH {_E}, d AS (SELECT entity, day, count(*) AS n, max(price) AS hi, min(price) AS lo, max(t) AS last FROM e GROUP BY ALL),
l AS (SELECT entity, day * {D} AS origin_ns, max(CASE WHEN price > 100 THEN 1 ELSE 0 END)::INTEGER AS outcome FROM e GROUP BY ALL),
u AS (SELECT entity, min(day) * {D} AS a, (max(day) - 2) * {D} AS b, min(t) AS kn FROM e GROUP BY entity)
SELECT d.entity, l.origin_ns, 1000000 - n * 1000 AS quality_millionths, outcome, CAST(3 AS BIGINT) AS n_features, round(n + hi + lo, 6) + 0.0 AS total
FROM d JOIN l ON d.entity = l.entity AND l.origin_ns = (d.day + 1) * {D} JOIN u ON u.entity = d.entity
WHERE last + {H} <= l.origin_ns AND 1000000 - n * 1000 >= 990000 AND l.origin_ns >= a AND l.origin_ns < b AND kn <= l.origin_ns""",
    "fair_price_weighted_median": f"""WITH {_Q}, r AS (SELECT *, flag = 'R' OR ev > 915148800000000000 OR 915148800000000000 - ev > {2500 * D} AS bad FROM q),
m AS (SELECT part, median(price) AS med FROM r WHERE NOT bad GROUP BY part),
g AS (SELECT r.* FROM r JOIN m USING (part) WHERE NOT bad AND abs(price - med) * 1000000 <= 400000 * med),
c AS (SELECT *, 2 * sum(depth) OVER w AS cum, sum(depth) OVER (PARTITION BY part) AS tot, coalesce(lead(price) OVER (PARTITION BY part ORDER BY price, venue), price) AS nx FROM g
  WINDOW w AS (PARTITION BY part ORDER BY price, venue ROWS UNBOUNDED PRECEDING)),
h AS (SELECT part, CASE WHEN cum = tot THEN (price + nx) / 2 ELSE price END AS fp, row_number() OVER (PARTITION BY part ORDER BY cum, price, venue) AS rk FROM c WHERE cum >= tot)
SELECT a.part, venues, excluded, fp AS fair_price FROM (SELECT part, count(*) AS venues, count(*) FILTER (bad) AS excluded FROM r GROUP BY part) a LEFT JOIN h ON a.part = h.part AND rk = 1""",
    # The number of capped venues is tried, not derived: it is right if those are at the cap or above and the others below.
    "capped_venue_weights": f"""WITH {_Q}, c AS (SELECT part, venue, depth, row_number() OVER (PARTITION BY part ORDER BY depth DESC, venue) AS place FROM q),
g AS (SELECT part, count(*) AS n, greatest(400000, CAST(ceil(1000000 / count(*)) AS BIGINT)) - 1 AS cap FROM c GROUP BY part),
t AS (SELECT g.part, n, cap, m, 1000000 - n - m * cap AS lft, coalesce(sum(depth) FILTER (place > m), 0) AS tot, coalesce(max(depth) FILTER (place > m), 0) AS big FROM g JOIN c USING (part), range(0, 4) r(m) WHERE m <= n GROUP BY ALL),
b AS (SELECT part, n, cap, min(m) AS m, arg_min(lft, m) AS lft, arg_min(tot, m) AS tot FROM t WHERE lft >= 0 AND (tot = 0 OR lft * big < (cap + 1) * tot) GROUP BY ALL),
s AS (SELECT c.*, cap, n, place <= m AS bound, CASE WHEN place <= m THEN cap ELSE lft * depth // tot END AS share, CASE WHEN place > m AND lft * depth // tot < cap THEN lft * depth % tot END AS rem FROM c JOIN b USING (part))
SELECT part, venue, depth, CAST(share + 1 + CASE WHEN rem IS NOT NULL AND row_number() OVER (PARTITION BY part ORDER BY rem DESC NULLS LAST, venue) <= 1000000 - n - sum(share) OVER (PARTITION BY part) THEN 1 ELSE 0 END AS BIGINT) AS weight_ppm FROM s""",
    "venue_concentration": f"""WITH {_Q}, m AS (SELECT part, median(price) AS med FROM q GROUP BY part)
SELECT q.part, count(*) AS venues, round(median(abs(price / med - 1)), 6) + 0.0 AS cross_venue_median_absolute_dispersion, round((max(price) - min(price)) / max(med), 6) + 0.0 AS indicative_cross_venue_price_range,
  round(sum(CAST(depth AS DOUBLE) * depth) / (CAST(sum(depth) AS DOUBLE) * CAST(sum(depth) AS DOUBLE)), 6) + 0.0 AS venue_concentration_index FROM q JOIN m USING (part) GROUP BY q.part""",
    "competing_first_passage": f"""WITH {_E}, s AS (SELECT entity, min(t) AS t0, first(price ORDER BY t, seq) AS p0 FROM e GROUP BY entity),
f AS (SELECT e.entity, CAST(floor((t - t0) / 1e9) AS BIGINT) AS o, event_type <> 'error' OR floor((t - t0) / 1e9) < 200000 AS trusted, event_type = 'error' AND seq % 2 = 0 AS excl, CASE WHEN price > 0 AND p0 > 0 THEN ln(price / p0) END AS ret FROM e JOIN s USING (entity)),
v AS (SELECT 'downside' AS event_type UNION ALL SELECT 'upside'),
b AS (SELECT f.*, v.event_type, max(CASE WHEN trusted THEN 0 ELSE 1 END) OVER (PARTITION BY entity, v.event_type ORDER BY o ROWS UNBOUNDED PRECEDING) AS broken, CASE WHEN v.event_type = 'upside' THEN ret >= 1.0 ELSE ret <= -1.0 END AS m FROM f, v WHERE o <= 864000),
g AS (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY entity, event_type ORDER BY o ROWS UNBOUNDED PRECEDING) AS miss FROM b WHERE broken = 0),
r AS (SELECT *, min(o) OVER (PARTITION BY entity, event_type, miss, m) AS st FROM g),
hit AS (SELECT entity, event_type, arg_min(st, o) AS st, arg_min(o, o) + 60 AS kn FROM r WHERE m AND o - st >= 3600 GROUP BY ALL),
seen AS (SELECT entity, event_type, max(o) AS ob FROM g GROUP BY ALL), bad AS (SELECT entity, event_type, arg_min(excl, o) AS ex, min(o) AS bo FROM b WHERE broken = 1 GROUP BY ALL),
a AS (SELECT s.entity, v.event_type, CASE WHEN hit.st IS NOT NULL THEN 'occurred' WHEN ex THEN 'excluded' WHEN bo IS NOT NULL OR coalesce(ob, 0) < 864000 THEN 'censored' ELSE 'not_occurred' END AS outcome,
  hit.st AS offset_s, CASE WHEN hit.st IS NOT NULL THEN hit.kn WHEN ex THEN bo + 60 ELSE coalesce(ob + 60, 0) END AS known_s, coalesce(ob, 0) AS observed_s
  FROM s CROSS JOIN v LEFT JOIN hit ON hit.entity = s.entity AND hit.event_type = v.event_type LEFT JOIN seen ON seen.entity = s.entity AND seen.event_type = v.event_type LEFT JOIN bad ON bad.entity = s.entity AND bad.event_type = v.event_type),
p AS (SELECT entity, arg_min(event_type, offset_s * 10 + CASE event_type WHEN 'downside' THEN 3 ELSE 4 END) AS primary_event FROM a WHERE outcome = 'occurred' GROUP BY entity)
SELECT a.*, p.primary_event FROM a LEFT JOIN p USING (entity)""",
    "walk_forward_membership": f"""WITH {_E}, c AS (SELECT min(t) AS lo, max(t) AS hi FROM e), n AS (SELECT unnest(range(0, 100)) AS fold),
o AS (SELECT fold, lo + fold * {3 * D} AS a FROM n, c WHERE lo + fold * {3 * D} + {20 * D} <= hi + 1),
p AS (SELECT fold, 'training' AS part, a AS s, a + {10 * D} AS x FROM o UNION ALL SELECT fold, 'calibration', a + {11 * D}, a + {15 * D} FROM o UNION ALL SELECT fold, 'test', a + {16 * D}, a + {20 * D} FROM o)
SELECT seq, fold, part FROM e JOIN p ON t >= s AND t < x AND t + {7 * H} <= x""",
    "base_rate_strata": f"""WITH {_E}, h AS (SELECT entity, (CAST(floor(t / {float(H)!r}) AS BIGINT) + 72) % 168 AS hour_of_week, CASE WHEN price > 50 THEN 1 ELSE 0 END AS y FROM e)
SELECT entity, hour_of_week, CAST(sum(y) AS BIGINT) AS successes, count(*) AS n, round((sum(y) + 0.5) / (count(*) + 1.0), 6) + 0.0 AS posterior_mean FROM h GROUP BY GROUPING SETS ((entity), (hour_of_week), (entity, hour_of_week), ())""",
    "probability_metrics": """WITH f AS (SELECT (doc_id % 97 + 1) / 99.0::DOUBLE AS p, toxic::DOUBLE AS y, 1.0::DOUBLE + quality AS w FROM labels),
b AS (SELECT least(floor(p * 10), 9) AS bin, sum(w) AS bw, sum(w * p) / sum(w) AS mp, sum(w * y) / sum(w) AS mo FROM f GROUP BY 1),
a AS (SELECT sum(w * CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE -ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END) / sum(w) AS ll, sum(w * (p - y) * (p - y)) / sum(w) AS br, power(sum(w), 2) / sum(w * w) AS ess, sum(w * y) / sum(w) AS r FROM f),
c AS (SELECT sum(bw * abs(mp - mo)) / sum(bw) AS ece FROM b), z AS (SELECT 1.959963984540054 AS z)
SELECT round(ll, 6) + 0.0 AS log_loss, round(br, 6) + 0.0 AS brier, round(ess, 6) + 0.0 AS ess, round(r, 6) + 0.0 AS base_rate,
  round((r + z * z / (2 * ess) - z * sqrt(r * (1 - r) / ess + z * z / (4 * ess * ess))) / (1 + z * z / ess), 6) + 0.0 AS wilson_low,
  round((r + z * z / (2 * ess) + z * sqrt(r * (1 - r) / ess + z * z / (4 * ess * ess))) / (1 + z * z / ess), 6) + 0.0 AS wilson_high,
  round(1 - (round(br, 6) + 0.0) / (r * (1 - r)), 6) + 0.0 AS brier_skill, round(ece, 6) + 0.0 AS ece FROM a, c, z""",
    "reliability_table": """WITH f AS (SELECT (doc_id % 97 + 1) / 99.0::DOUBLE AS p, toxic::DOUBLE AS y, 1.0::DOUBLE + quality AS w FROM labels)
SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, sum(w) AS weight, round(sum(w * p) / sum(w), 6) + 0.0 AS mean_predicted, round(sum(w * y) / sum(w), 6) + 0.0 AS mean_observed FROM f GROUP BY 1""",
    "hazen_quantiles": f"""WITH {_E}, v AS (SELECT event_type, list(price ORDER BY price) AS v, count(*) AS n FROM e GROUP BY event_type)
SELECT event_type, """
    + ", ".join(
        f"round(CASE WHEN n * {q / 100!r}::DOUBLE - 0.5 <= 0 THEN v[1] WHEN n * {q / 100!r}::DOUBLE - 0.5 >= n - 1 THEN v[n] ELSE v[CAST(floor(n * {q / 100!r}::DOUBLE - 0.5) AS BIGINT) + 1] * (1 - (n * {q / 100!r}::DOUBLE - 0.5 - floor(n * {q / 100!r}::DOUBLE - 0.5))) + v[CAST(floor(n * {q / 100!r}::DOUBLE - 0.5) AS BIGINT) + 2] * (n * {q / 100!r}::DOUBLE - 0.5 - floor(n * {q / 100!r}::DOUBLE - 0.5)) END, 6) + 0.0 AS p{q:02d}"
        for q in (5, 25, 50, 75, 95)
    )
    + ", "
    + ", ".join(f"v[CAST(ceil(n * {q} / 100) AS BIGINT)] AS nr{q:02d}" for q in (50, 95, 99))
    + " FROM v",
    "label_centroid_distance": """WITH x AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY ALL), d AS (SELECT vec_id, c.label, sum((x - c) * (x - c)) AS d2 FROM x JOIN c USING (i) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 9), label) AS rk, min(d2) OVER (PARTITION BY vec_id) AS m FROM d)
SELECT vec_id, label AS nearest_label, round(sqrt(m), 6) + 0.0 AS distance FROM r WHERE rk = 1""",
    "fast_triggers": f"""WITH {_E}, l AS (SELECT *, price - lag(price) OVER w AS dp, k - lag(k) OVER w AS dk, t - lag(t) OVER w AS dt, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price / lag(price) OVER w) END AS ret, k / nullif(lag(k) OVER w, 0) - 1 AS oi FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, seq)),
m AS (SELECT *, CASE WHEN oi >= -1 THEN greatest(-oi, 0) * abs(ret) END AS de FROM l WHERE dt IS NOT NULL)
SELECT seq, round(greatest(-dp, -dk, 0), 6) + 0.0 AS depth_disappearance, round(ln(1 + price * (k / 100)), 6) + 0.0 AS cancellation_burst, round(CASE WHEN dt > 0 THEN (price - (price - dp)) / (dt / 1e9) END, 6) + 0.0 AS dispersion_acceleration,
  round(de, 6) + 0.0 AS open_interest_destruction, round(ln(1 + price * (k / 100) * (1 + coalesce(de, 0))), 6) + 0.0 AS liquidation_pressure,
  CASE WHEN event_type = 'error' THEN 'unavailable' WHEN oi IS NULL OR 1000000 - k * 1500 < 900000 THEN 'degraded' ELSE 'healthy' END AS health FROM m""",
    "derivative_features": f"""WITH {_E}, d AS (SELECT entity, day, CAST(last(k ORDER BY t, seq) AS DOUBLE) AS fu, last(price ORDER BY t, seq) AS oi, avg(price) AS mk, median(price) AS ix, count(*) FILTER (event_type = 'error') AS liq, sum(price) FILTER (event_type = 'error') AS ln_ FROM e GROUP BY ALL)
SELECT entity, day, fu AS predicted_funding_rate, fu - lag(fu) OVER w AS funding_rate_change, round(oi, 6) + 0.0 AS open_interest_native, round(oi / nullif(lag(oi) OVER w, 0) - 1, 6) + 0.0 AS open_interest_relative_change,
  round(mk / nullif(ix, 0) - 1, 6) + 0.0 AS mark_index_divergence, liq AS liquidation_observed_count, round(ln_, 6) + 0.0 AS liquidation_observed_notional, round(liq / 86400.0 * 1000, 6) + 0.0 AS liquidation_observed_velocity_per_1000_s
FROM d WINDOW w AS (PARTITION BY entity ORDER BY day)""",
    "hazard_incidence": f"""WITH {_E}, b AS (SELECT event_type, price, CAST(floor((t - min(t) OVER (PARTITION BY entity)) / {float(6 * H)!r}) AS BIGINT) AS bucket FROM e),
h AS (SELECT event_type, bucket, (count(*) FILTER (price > 100)) / (count(*) * 3.7::DOUBLE) AS up, (count(*) FILTER (price < 10)) / (count(*) * 3.7::DOUBLE) AS dn FROM b WHERE bucket < 24 GROUP BY ALL),
s AS (SELECT *, coalesce(exp(sum(ln(1 - up - dn)) OVER (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS sv FROM h)
SELECT event_type, bucket, round(sv, 9) + 0.0 AS survival_before, round(sum(sv * up) OVER w, 9) + 0.0 AS cif_up, round(sum(sv * dn) OVER w, 9) + 0.0 AS cif_down FROM s WINDOW w AS (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING)""",
    "evidence_topk": f"""WITH {_E}, r AS (SELECT entity, seq, price - 50 AS c, row_number() OVER (PARTITION BY entity ORDER BY abs(price - 50) DESC, seq) AS rank FROM e)
SELECT entity, seq, rank, round(c, 6) + 0.0 AS contribution, CASE WHEN c >= 0 THEN 'supporting' ELSE 'opposing' END AS direction FROM r WHERE rank <= 20""",
    "forecast_outcome_join": f"""WITH {_E}, p AS (SELECT seq AS forecast_id, entity, t, CAST(h AS INTEGER) AS horizon_days FROM e, (SELECT unnest([1, 3]) AS h) WHERE event_type = 'click'),
o AS (SELECT entity, t AS kn FROM e WHERE event_type = 'purchase')
SELECT forecast_id, horizon_days, min(kn) AS known_ns, min(kn) IS NOT NULL AS occurred FROM p LEFT JOIN o ON p.entity = o.entity AND kn > t AND kn <= t + horizon_days * {D} GROUP BY forecast_id, horizon_days""",
    "promotion_checks": f"""WITH {_E}, f AS (SELECT entity, day, avg(price) - 45 AS skill, count(*) FILTER (price > 100) AS pos, max(event_type) AS regime FROM e GROUP BY ALL),
m AS (SELECT entity, CAST(sum(pos) AS BIGINT) AS positives, count(DISTINCT regime) AS regimes, avg(CASE WHEN skill > 0 THEN 1.0 ELSE 0.0 END) AS share FROM f GROUP BY entity)
SELECT entity, positives, regimes, round(share, 6) + 0.0 AS share, concat_ws(',', CASE WHEN positives < 3 THEN 'insufficient_positives' END, CASE WHEN regimes < 3 THEN 'insufficient_regimes' END, CASE WHEN share < 0.7 THEN 'insufficient_skill' END) AS reasons,
  positives >= 3 AND regimes >= 3 AND share >= 0.7 AS promoted FROM m""",
}

_BANDS = "".join(
    f", coalesce(sum(qty) FILTER (bid AND (mid - price) * 10000 <= mid * {b}), 0) AS bd{b}, coalesce(sum(qty) FILTER (NOT bid AND (price - mid) * 10000 <= mid * {b}), 0) AS ad{b}"
    for b in book.BANDS
)
_BAND_OUT = "".join(
    f", round(bd{b}, 9) + 0.0 AS bid_depth_{b}bps, round(ad{b}, 9) + 0.0 AS ask_depth_{b}bps, round((bd{b} - ad{b}) / nullif(bd{b} + ad{b}, 0), 9) + 0.0 AS book_imbalance_{b}bps"
    for b in book.BANDS
)
_SHAPE = """CASE WHEN {s}3 IS NOT NULL THEN (({y}2) / ({s}2 - {s}1)) - (((({y}3) / ({s}3 - {s}2)) - (({y}2) / ({s}2 - {s}1))) / ({s}3 - {s}1)) * ({s}1 + {s}2) END"""
_CURVE = """CASE WHEN {s}3 IS NOT NULL THEN 2 * (((({y}3) / ({s}3 - {s}2)) - (({y}2) / ({s}2 - {s}1))) / ({s}3 - {s}1)) END"""
ORACLE_SQL["book_features"] = f"""WITH l AS (
  SELECT l_partkey AS part, l_linenumber % 2 = 0 AS bid, CAST(1000 + l_partkey % 50 + (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) * (1 + l_orderkey % 15) AS DOUBLE) AS price, sum(l_quantity) AS qty
  FROM lineitem GROUP BY 1, 2, 3
), t AS (
  SELECT part, max(price) FILTER (bid) AS bp, min(price) FILTER (NOT bid) AS ap, arg_max(qty, price) FILTER (bid) AS bq, arg_min(qty, price) FILTER (NOT bid) AS aq,
    count(*) FILTER (bid) AS nb, count(*) FILTER (NOT bid) AS na, sum(qty) AS tot, max(price) FILTER (bid) - min(price) FILTER (bid) AS bs, max(price) FILTER (NOT bid) - min(price) FILTER (NOT bid) AS asp FROM l GROUP BY part
), j AS (
  SELECT l.*, (bp + ap) / 2 AS mid, bp, ap, tot, row_number() OVER (PARTITION BY part, bid ORDER BY CASE WHEN bid THEN -price ELSE price END) AS k,
    sum(price * qty) OVER (PARTITION BY part, bid ORDER BY CASE WHEN bid THEN -price ELSE price END ROWS UNBOUNDED PRECEDING) AS cn
  FROM l JOIN t USING (part)
), c AS (
  SELECT *, greatest(least(price * qty, 10000 - (cn - price * qty)), 0) AS used FROM j
), a AS (
  SELECT part, max(mid) AS mid{_BANDS}, sum(-(qty / tot) * ln(qty / tot)) AS ent, sum((qty / tot) * (qty / tot)) AS hhi,
    max(price) FILTER (bid AND price * qty >= 60000) AS bw, min(price) FILTER (NOT bid AND price * qty >= 60000) AS aw,
    sum(price * qty) FILTER (NOT bid AND abs(price - ap) * 10000 <= ap * 25) AS eb, sum(price * qty) FILTER (bid AND abs(price - bp) * 10000 <= bp * 25) AS es,
    sum(used) FILTER (NOT bid) AS ua, sum(used / price) FILTER (NOT bid) AS qa, sum(used) FILTER (bid) AS ub, sum(used / price) FILTER (bid) AS qb,
    max(abs(price - bp)) FILTER (bid AND k = 1) AS b1, max(abs(price - bp)) FILTER (bid AND k = 2) AS b2, max(abs(price - bp)) FILTER (bid AND k = 3) AS b3, max(qty) FILTER (bid AND k = 2) AS by2, max(qty) FILTER (bid AND k = 3) AS by3,
    max(abs(price - ap)) FILTER (NOT bid AND k = 1) AS a1, max(abs(price - ap)) FILTER (NOT bid AND k = 2) AS a2, max(abs(price - ap)) FILTER (NOT bid AND k = 3) AS a3, max(qty) FILTER (NOT bid AND k = 2) AS ay2, max(qty) FILTER (NOT bid AND k = 3) AS ay3
  FROM c GROUP BY part
)
SELECT part, CASE WHEN bp IS NULL OR ap IS NULL THEN 'one_sided' WHEN bp = ap THEN 'locked' WHEN bp > ap THEN 'crossed' ELSE 'normal' END AS classification,
  nb AS bid_active_price_levels, na AS ask_active_price_levels, round(ap - bp, 9) + 0.0 AS absolute_spread, round((ap - bp) / mid, 9) + 0.0 AS relative_spread{_BAND_OUT},
  round((bp * bq + ap * aq) / (bq + aq), 9) + 0.0 AS weighted_midpoint, round((ap * bq + bp * aq) / (bq + aq), 9) + 0.0 AS microprice,
  round({_SHAPE.format(s="b", y="by")}, 9) + 0.0 AS bid_book_slope, round({_SHAPE.format(s="a", y="ay")}, 9) + 0.0 AS ask_book_slope,
  round({_CURVE.format(s="b", y="by")}, 9) + 0.0 AS bid_book_convexity, round({_CURVE.format(s="a", y="ay")}, 9) + 0.0 AS ask_book_convexity,
  round(abs(bw - mid) / mid * 10000, 9) + 0.0 AS bid_liquidity_wall_distance, round(abs(aw - mid) / mid * 10000, 9) + 0.0 AS ask_liquidity_wall_distance,
  round(CASE WHEN bs > 0 THEN (bs + 1 - nb) / bs END, 9) + 0.0 AS bid_price_level_gap_density, round(CASE WHEN asp > 0 THEN (asp + 1 - na) / asp END, 9) + 0.0 AS ask_price_level_gap_density,
  round(eb, 9) + 0.0 AS maximum_executable_buy_quote_notional, round(es, 9) + 0.0 AS maximum_executable_sell_quote_notional,
  round(CASE WHEN ua >= 10000 THEN abs(10000 / qa / mid - 1) END, 9) + 0.0 AS expected_buy_sweep_cost, round(CASE WHEN ub >= 10000 THEN abs(10000 / qb / mid - 1) END, 9) + 0.0 AS expected_sell_sweep_cost,
  round(CASE WHEN nb + na > 1 THEN ent / ln(nb + na) END, 9) + 0.0 AS local_book_entropy, round(hhi, 9) + 0.0 AS depth_concentration_by_level
FROM t JOIN a USING (part)"""

ORACLE_SQL["cusp_equilibria"] = f"""WITH {_E}, c AS (SELECT seq, CAST(k AS DOUBLE) / 50 - 1.013 AS a, least(price / 50, 4.0) - 1.007 AS b FROM e),
d AS (SELECT *, 4 * power(b, 3) - 27 * a * a AS disc FROM c),
r AS (SELECT seq, b, 3 AS n_roots, unnest([2, 1, 0]) AS k, acos(greatest(least(3 * a / (2 * b) * sqrt(3 / b), 1.0), -1.0)) / 3 AS th, a FROM d WHERE disc > 0),
y AS (SELECT seq, b, n_roots, 2 * sqrt(b / 3) * cos(th - 2 * pi() * k / 3) AS y FROM r
  UNION ALL SELECT seq, b, 1, cbrt(a / 2 + sqrt(greatest(a * a / 4 - power(b, 3) / 27, 0))) + cbrt(a / 2 - sqrt(greatest(a * a / 4 - power(b, 3) / 27, 0))) FROM d WHERE disc <= 0)
SELECT seq, CAST(n_roots AS BIGINT) AS n_roots, row_number() OVER (PARTITION BY seq ORDER BY y) - 1 AS pos, round(y, 6) + 0.0 AS root, true AS solves, CASE WHEN 3 * y * y > b THEN 'stable' ELSE 'unstable' END AS stability FROM y"""
