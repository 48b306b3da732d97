"""Feature rows: sliding windows over an exact price grid, finality, and one
canonical row per feature in which every missing value carries a reason.

A window of ``n`` steps needs the ``n`` grid prices from its start on and the
one at its end.  An incomplete grid is missing (``sequence_gap``), never a
shorter window; a window whose source has not passed its end and the lateness
is missing too (``window_not_final``).  A complete window whose measure is not
defined (no variance, no qualifying move) is ``insufficient_history``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.returns import valid_price

#: Reasons of a missing value (fixed values).
REASONS = (
    "insufficient_history", "window_not_final", "sequence_gap", "stale", "source_disconnected", "source_not_supported",
    "privacy_or_license_restriction", "below_liquidity_threshold", "model_not_applicable", "unknown",
)
LATENESS_NS = 5_000_000_000


def price_grid(prices: DataFrame, step_ns: int) -> DataFrame:
    """``entity``, ``g`` (grid number), ``price``: the last valid price of each
    step of ``entity``, ``t``, ``seq``, ``price``, with empty steps between an
    entity's first and last as null prices."""
    g = F.floor(F.col("t") / step_ns).cast("long")
    at = F.when(valid_price(F.col("price")).isNotNull(), F.struct("t", "seq"))
    closes = prices.groupBy("entity", g.alias("g")).agg(F.max_by("price", at).alias("price"))
    spans = closes.groupBy("entity").agg(F.explode(F.sequence(F.min("g"), F.max("g"))).alias("g"))
    return spans.join(closes, ["entity", "g"], "left")


def windows_over(grid: DataFrame, steps: int) -> DataFrame:
    """Every window that ends on a grid step: ``p`` (prices, nulls left out),
    ``observed`` (how many) and ``start_g``."""
    frame = Window.partitionBy("entity").orderBy("g").rowsBetween(-steps, 0)
    return grid.select("entity", "g", (F.col("g") - steps).alias("start_g"), F.collect_list("price").over(frame).alias("p"), F.count("price").over(frame).alias("observed"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(values: Column, make) -> Column:
    """``make(before, after)`` of neighbours."""
    n = F.size(values)
    return F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), make)


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / F.when(denominator > 0, denominator))


def _about_mean(values: Column, names: list[str], add) -> Column:
    """Means of powers about the mean, which is computed once and carried."""
    start = F.struct((_sum(values) / F.size(values)).alias("mean"), *(F.lit(0.0).alias(n) for n in names))
    done = F.aggregate(values, start, lambda s, x: F.struct(s["mean"].alias("mean"), *((s[n] + add(x - s["mean"], k + 2)).alias(n) for k, n in enumerate(names))))
    return F.transform(F.array(done), lambda d: F.struct(*((d[n] / F.size(values)).alias(n) for n in names)))[0]


def _together(x: Column, y: Column) -> Column:
    """Sums ``xx``, ``xy`` and ``yy`` of two arrays about their means."""
    start = F.struct((_sum(x) / F.size(x)).alias("mx"), (_sum(y) / F.size(y)).alias("my"), *(F.lit(0.0).alias(n) for n in ("xx", "xy", "yy")))

    def add(s: Column, z: Column) -> Column:
        a, b = z["x"] - s["mx"], z["y"] - s["my"]
        return F.struct(s["mx"].alias("mx"), s["my"].alias("my"), (s["xx"] + a * a).alias("xx"), (s["xy"] + a * b).alias("xy"), (s["yy"] + b * b).alias("yy"))

    return F.aggregate(F.arrays_zip(x.alias("x"), y.alias("y")), start, add)


#: What ``price_features`` makes.
PRICE_FEATURES = """
log_return cumulative_return high_low_range open_close_range trend_slope trend_acceleration maximum_drawdown maximum_run_up upside_semivariance downside_semivariance
return_autocorrelation variance_ratio rolling_skewness rolling_excess_kurtosis return_reversal realized_variance realized_volatility parkinson_volatility
garman_klass_volatility bipower_variation jump_variation
""".split()
#: The least price move (as a log return) that a reversal is measured after.
LEAST_MOVE = 0.05
#: A zero variance in exact arithmetic leaves at most this much.
NOTHING = 1e-18


def with_parts(rows: DataFrame, step_hours: float) -> DataFrame:
    """Adds what several features of a window are made of, so that each part is
    computed once: ``p`` has n + 1 prices and ``r`` n returns."""
    p, r = F.col("p"), F.col("r")
    rows = rows.withColumns(
        {
            "__before": F.slice(r, F.lit(1), F.size(r) - 1),
            "__after": F.slice(r, F.lit(2), F.size(r) - 1),
            "__hours": F.transform(p, lambda x, k: k * F.lit(step_hours)),
            "__rates": _pairs(p, lambda a, b: (b - a) / F.lit(step_hours)),
            "__middles": F.transform(r, lambda x, k: (k + 0.5) * F.lit(step_hours)),
            "__two": _pairs(r, lambda a, b: a + b),
        }
    )
    power = lambda d, k: F.pow(d, F.lit(float(k)))
    return rows.withColumns(
        {
            "__m": _about_mean(r, ["m2", "m3", "m4"], power),
            "__v": _about_mean(F.col("__two"), ["m2"], power),
            "__lag": _together(F.col("__before"), F.col("__after")),
            "__trend": _together(F.col("__hours"), p),
            "__bend": _together(F.col("__middles"), F.col("__rates")),
            "__rv": _sum(F.transform(r, lambda x: x * x)),
            "__bv": F.lit(math.pi / 2) * _sum(_pairs(r, lambda a, b: F.abs(a) * F.abs(b))),
            "__moves": F.filter(F.arrays_zip(F.col("__before").alias("a"), F.col("__after").alias("b")), lambda z: F.abs(z["a"]) >= LEAST_MOVE),
            "__high": F.array_max(p),
            "__low": F.array_min(p),
            "__first": F.element_at(p, 1),
            "__last": F.element_at(p, -1),
        }
    )


def price_features() -> dict[str, Column]:
    """Features of one complete window from its prices, returns and parts;
    slopes are per hour."""
    p, r, rv, bv = F.col("p"), F.col("r"), F.col("__rv"), F.col("__bv")
    first, last, high, low = (F.col(f"__{n}") for n in ("first", "last", "high", "low"))
    half = lambda up: F.aggregate(r, F.lit(0.0), lambda s, x: F.when(x > 0 if up else x < 0, s + x * x).otherwise(s))
    m2, m3, m4, v2 = (F.col(n) for n in ("__m.m2", "__m.m3", "__m.m4", "__v.m2"))
    worst = lambda better, gap: F.aggregate(
        p, F.struct(first.alias("mark"), F.lit(0.0).alias("most")),
        lambda s, x: F.struct(better(s["mark"], x).alias("mark"), F.greatest(s["most"], gap(better(s["mark"], x), x)).alias("most")),
    )["most"]
    spread = F.col("__lag.xx") * F.col("__lag.yy")
    moves = F.col("__moves")
    back = _sum(F.transform(moves, lambda z: -F.signum(z["a"]) * z["b"]))
    garman = 0.5 * F.pow(F.log(high / low), F.lit(2.0)) - (2 * math.log(2) - 1) * F.pow(F.log(last / first), F.lit(2.0))
    return {
        "log_return": F.log(last / first),
        "cumulative_return": last / first - 1,
        "high_low_range": high / low - 1,
        "open_close_range": last / first - 1,
        "trend_slope": _safe(F.col("__trend.xy"), F.col("__trend.xx")),
        "trend_acceleration": _safe(F.col("__bend.xy"), F.col("__bend.xx")),
        "maximum_drawdown": worst(F.greatest, lambda mark, x: (mark - x) / mark),
        "maximum_run_up": worst(F.least, lambda mark, x: (x - mark) / mark),
        "upside_semivariance": half(True),
        "downside_semivariance": half(False),
        "return_autocorrelation": F.when(F.size(r) >= 4, _safe(F.col("__lag.xy"), F.sqrt(F.when(spread > NOTHING, spread)))),
        "variance_ratio": _safe(v2, F.when(m2 > NOTHING, 2 * m2)),
        "rolling_skewness": F.when(F.size(r) >= 3, _safe(m3, F.pow(F.when(m2 > NOTHING, m2), F.lit(1.5)))),
        "rolling_excess_kurtosis": F.when(F.size(r) >= 4, _safe(m4, F.when(m2 > NOTHING, m2 * m2)) - 3),
        "return_reversal": F.when(F.size(moves) > 0, back / F.when(F.size(moves) > 0, F.size(moves))),
        "realized_variance": rv,
        "realized_volatility": F.sqrt(rv),
        "parkinson_volatility": F.sqrt(F.pow(F.log(high / low), F.lit(2.0)) / (4 * math.log(2))),
        "garman_klass_volatility": F.when(garman >= -1e-12, F.sqrt(F.greatest(garman, F.lit(0.0)))),
        "bipower_variation": bv,
        "jump_variation": F.when(rv.isNotNull(), F.greatest(rv - bv, F.lit(0.0))),
    }


def feature_windows(prices: DataFrame, step_ns: int, steps: int, window_id: str, lateness_ns: int = LATENESS_NS) -> DataFrame:
    """Windows of ``steps`` grid steps of every entity with their features, what
    the grid held, and finality by the entity's own watermark (its last time).

    Besides the measures of one window: ``volatility_forecast_residual``
    (realised variance less that of the window that ends where this one starts,
    known by then) and ``consolidated_fair_price_distance`` (closing price over
    the median of all entities' closing prices of the step, of three or more).
    """
    grid = price_grid(prices, step_ns)
    fair = grid.groupBy("g").agg(F.when(F.count("price") >= 3, F.median("price")).alias("fair"))
    marks = prices.groupBy("entity").agg(F.max("t").alias("watermark_ns"))
    rows = windows_over(grid, steps).join(F.broadcast(marks), "entity").join(fair, "g")
    start, end = F.col("start_g") * step_ns, F.col("g") * step_ns
    whole = F.col("observed") == steps + 1
    rows = rows.withColumns(
        {
            "window_id": F.lit(window_id),
            "event_time_start_ns": start,
            "event_time_end_ns": end,
            "whole": whole,
            "finality_state": F.when(F.col("watermark_ns") >= end + lateness_ns, "final").otherwise("provisional"),
            "quality_millionths": F.floor(F.least(F.col("observed"), F.lit(steps + 1)) * 1_000_000 / (steps + 1)).cast("int"),
            "r": F.when(whole, _pairs(F.col("p"), lambda a, b: F.log(b / a))),
        }
    )
    ready = F.col("whole") & (F.col("finality_state") == "final")
    rows = rows.withColumns({"close": F.try_element_at("p", F.lit(-1)), "p": F.when(ready, F.col("p")), "r": F.when(ready, F.col("r"))})
    rows, made = with_parts(rows, step_ns / 3_600_000_000_000), price_features()
    rows = rows.select("entity", "g", "window_id", "event_time_start_ns", "event_time_end_ns", "whole", "finality_state", "watermark_ns", "quality_millionths", "fair", "close", *(c.alias(n) for n, c in made.items()))
    before = F.lag("realized_variance", steps).over(Window.partitionBy("entity").orderBy("g"))
    return rows.withColumns(
        {
            "volatility_forecast_residual": F.col("realized_variance") - before,
            "consolidated_fair_price_distance": F.when(F.col("realized_variance").isNotNull(), F.col("close") / F.col("fair") - 1),
        }
    ).drop("g", "fair", "close")


def long_rows(wide: DataFrame, features: list[str]) -> DataFrame:
    """One row per window and feature with its value or the reason it has none."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    keep = [c for c in wide.columns if c not in features]
    rows = wide.select(*keep, F.expr(f"stack({len(features)}, {pairs}) as (feature_id, value)"))
    reason = (
        F.when(F.col("value").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("finality_state") != "final", "window_not_final")
        .when(~F.col("whole"), "sequence_gap")
        .otherwise("insufficient_history")
    )
    return rows.withColumn("missing_reason", reason)


def canonical(rows: DataFrame, step_ns: int, versions: dict[str, str] | None = None, code: str = "quantloom", known_after_ns: int = 1) -> DataFrame:
    """The canonical feature row of each of ``long_rows``: identity, datum,
    times (start <= end <= known <= computed), finality, coverage, quality and
    digests; revision 1."""
    version = F.lit("1.0.0")
    for feature, v in (versions or {}).items():
        version = F.when(F.col("feature_id") == feature, v).otherwise(version)
    entity = F.to_json(F.struct(F.lit("asset").alias("kind"), F.col("entity").cast("string").alias("id")))
    known = F.greatest(F.col("event_time_end_ns"), F.least(F.col("watermark_ns"), F.col("event_time_end_ns") + LATENESS_NS))
    datum = F.to_json(F.struct(F.when(F.col("value").isNull(), "missing").otherwise("present").alias("kind"), "value", F.col("missing_reason").alias("reason")))
    formula = F.sha2(F.concat_ws("\u0001", "feature_id", version, F.lit(str(step_ns))), 256)
    evidence = F.concat_ws("\u0001", "feature_id", version, entity, "window_id", F.col("event_time_start_ns").cast("string"), F.col("event_time_end_ns").cast("string"), datum, F.col("quality_millionths").cast("string"))
    return rows.select(
        F.col("event_time_end_ns").alias("effective_event_time_ns"),
        F.lit(None).cast("long").alias("exchange_event_time_ns"),
        known.alias("receive_wall_time_ns"),
        F.lit("feature_observation").alias("event_type"),
        F.lit("consolidated").alias("venue"),
        F.lit(1).alias("instrument_generation"),
        F.lit(1).cast("long").alias("connection_epoch"),
        F.lit(1).cast("long").alias("subscription_epoch"),
        F.xxhash64(evidence).alias("wal_record_sequence"),
        "feature_id",
        version.alias("feature_version"),
        entity.alias("entity_json"),
        "window_id",
        F.lit(step_ns).cast("long").alias("resolution_ns"),
        datum.alias("datum_json"),
        F.lit("float64").alias("value_type"),
        "event_time_start_ns",
        "event_time_end_ns",
        known.alias("as_known_at_ns"),
        (known + known_after_ns).alias("computed_at_ns"),
        F.least("watermark_ns", known + known_after_ns).alias("watermark_ns"),
        known.alias("finality_as_known_at_ns"),
        "finality_state",
        F.lit(1).alias("revision"),
        F.to_json(F.struct(F.array(F.col("entity").cast("string")).alias("expected"), F.array(F.col("entity").cast("string")).alias("observed"))).alias("source_coverage_json"),
        "quality_millionths",
        F.lit("identity-1").alias("normalization_version"),
        formula.alias("formula_hash"),
        F.lit(code).alias("code_commit"),
        F.sha2(evidence, 256).alias("lineage_hash"),
        F.col("value"),
        "missing_reason",
    )
