"""The feature catalogue: every named feature with its window, role and whether
present values are emitted.  A feature that is registered but not emitted
gives explicit missing rows with a reason, never an invented value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, roles and emission of the catalogue, in its order.

PRICE_FEATURES = """
log_return cumulative_return high_low_range open_close_range rolling_vwap_distance anchored_vwap_distance consolidated_fair_price_distance trend_slope
trend_acceleration maximum_drawdown maximum_run_up upside_semivariance downside_semivariance return_autocorrelation variance_ratio rolling_skewness
rolling_excess_kurtosis return_reversal finalized_interval_gap realized_variance realized_volatility exponentially_weighted_volatility parkinson_volatility
garman_klass_volatility bipower_variation jump_variation volatility_of_volatility volatility_term_ratio seasonality_adjusted_volatility realized_covariance
realized_correlation volatility_forecast_residual
""".split()

BAND_BPS = (1, 2, 5, 10, 25, 50, 100)
BOOK_FEATURES = [
    "absolute_spread",
    "relative_spread",
    *(f"bid_depth_{b}bps" for b in BAND_BPS),
    *(f"ask_depth_{b}bps" for b in BAND_BPS),
    *(f"book_imbalance_{b}bps" for b in BAND_BPS),
    *"""
weighted_midpoint microprice bid_book_slope ask_book_slope bid_book_convexity ask_book_convexity bid_liquidity_wall_distance ask_liquidity_wall_distance
bid_price_level_gap_density ask_price_level_gap_density expected_buy_sweep_cost_usd_10000 expected_sell_sweep_cost_usd_10000
maximum_executable_buy_quote_notional maximum_executable_sell_quote_notional book_quote_age_ms bid_stale_side_duration_ns ask_stale_side_duration_ns
bid_active_price_levels ask_active_price_levels local_book_entropy depth_concentration_by_level bid_depth_change ask_depth_change absolute_spread_change
displayed_depth_replenishment_fraction displayed_depth_recovery_time_ns book_half_life_ns
""".split(),
]
FLOW_FEATURES = """
aggressive_buy_count aggressive_sell_count aggressive_buy_quantity aggressive_sell_quantity aggressive_buy_notional aggressive_sell_notional
signed_trade_count_imbalance signed_trade_quantity_imbalance signed_trade_notional_imbalance top_of_book_ofi placement_rate_per_second
cancellation_rate_per_second modification_rate_per_second cancellation_to_trade_ratio quote_to_trade_ratio trade_intensity_per_second
trade_interarrival_coefficient_of_variation signed_volume_at_price trade_shock_midprice_impact trade_effective_spread trade_realized_spread
trade_adverse_selection_proxy trade_print_sweep_direction large_trade_cluster_count clustered_large_trade_count clustered_large_trade_notional
large_trade_cluster_activity_rate
""".split()

#: Cross-venue, derivative and operational features: name, role, + if emitted.
VENUE_FEATURES = """
venue_midprice_deviation model +
cross_venue_median_absolute_dispersion model +
indicative_cross_venue_price_range model +
executable_price_dispersion model -
spot_perpetual_disagreement model -
venue_lead_lag model -
venue_volume_share model -
venue_depth_share model +
venue_concentration_index model +
stale_quote_indicator uncertainty -
crossed_market_indicator uncertainty -
cross_venue_liquidity_synchronization model -
healthy_venue_fraction uncertainty +
local_move_classifier_input model -
systemic_move_classifier_input model -
transfer_friction_flag gating -
predicted_funding_rate model +
realized_funding_rate model -
funding_rate_change model +
funding_rate_percentile model -
funding_rate_robust_zscore model -
funding_rate_mad model -
cross_venue_funding_dispersion model -
open_interest_native model +
open_interest_usd_notional model -
open_interest_relative_change model +
open_interest_change_conditioned_on_price model -
mark_index_divergence model +
perpetual_spot_basis model -
dated_future_basis model -
annualized_dated_future_basis model -
futures_curve_slope model -
futures_curve_curvature model -
liquidation_observed_count model +
liquidation_observed_notional model +
liquidation_observed_velocity model +
liquidation_observed_acceleration model -
liquidation_to_volume_ratio model -
liquidation_to_open_interest_ratio model -
open_interest_destruction model -
insurance_fund_state uncertainty -
adl_state uncertainty -
liquidation_source_completeness_flag uncertainty +
source_latency_ns uncertainty +
feed_jitter_ns uncertainty +
clock_skew_estimate_ns uncertainty +
sequence_gap_count uncertainty +
checksum_failure_count uncertainty +
reconnect_count uncertainty +
recovery_count uncertainty +
stale_quote_duration_ns uncertainty +
source_coverage_fraction uncertainty +
feature_age_ns uncertainty +
cross_source_disagreement uncertainty +
correction_count uncertainty +
revision_count uncertainty +
raw_to_normalized_rejection_count uncertainty +
disk_pressure_fraction uncertainty +
local_processing_lag_ns uncertainty +
source_outage_indicator uncertainty +
source_health_gate gating +
source_completeness_gate gating +
cascade_eligibility_gate gating +
""".split("\n")

#: The query that computes each emitted feature (as a column, or as rows of ``feature_rows``).
COMPUTED_BY = {
    **dict.fromkeys(
        """log_return cumulative_return high_low_range open_close_range consolidated_fair_price_distance trend_slope trend_acceleration maximum_drawdown maximum_run_up upside_semivariance
        downside_semivariance return_autocorrelation variance_ratio rolling_skewness rolling_excess_kurtosis return_reversal realized_variance realized_volatility parkinson_volatility
        garman_klass_volatility bipower_variation jump_variation volatility_forecast_residual""".split(),
        "feature_rows",
    ),
    **dict.fromkeys(["rolling_vwap_distance", "anchored_vwap_distance"], "vwap_distance"),
    "finalized_interval_gap": "interval_gap_daily",
    "exponentially_weighted_volatility": "ewma_volatility_daily",
    **dict.fromkeys(["volatility_of_volatility", "volatility_term_ratio", "seasonality_adjusted_volatility"], "volatility_structure"),
    **dict.fromkeys(["realized_covariance", "realized_correlation"], "realized_pairs"),
    **dict.fromkeys(BOOK_FEATURES, "book_features"),
    "book_quote_age_ms": "book_admission",
    **dict.fromkeys(["bid_stale_side_duration_ns", "ask_stale_side_duration_ns", "top_of_book_ofi"], "top_of_book_ofi"),
    **dict.fromkeys(["bid_depth_change", "ask_depth_change", "absolute_spread_change"], "book_changes"),
    **dict.fromkeys(["displayed_depth_replenishment_fraction", "displayed_depth_recovery_time_ns", "book_half_life_ns"], "depth_recovery"),
    **dict.fromkeys([f"aggressive_{s}_{k}" for k in ("count", "quantity", "notional") for s in ("buy", "sell")], "trade_flow_imbalance"),
    **dict.fromkeys([f"signed_trade_{k}_imbalance" for k in ("count", "quantity", "notional")], "trade_flow_imbalance"),
    **dict.fromkeys("placement_rate_per_second cancellation_rate_per_second modification_rate_per_second cancellation_to_trade_ratio quote_to_trade_ratio".split(), "lifecycle_rates"),
    **dict.fromkeys(["trade_intensity_per_second", "trade_interarrival_coefficient_of_variation"], "interarrival_cv"),
    "signed_volume_at_price": "signed_volume_at_price",
    **dict.fromkeys("trade_shock_midprice_impact trade_effective_spread trade_realized_spread trade_adverse_selection_proxy".split(), "trade_shock_response"),
    "trade_print_sweep_direction": "sweep_episodes",
    **dict.fromkeys("large_trade_cluster_count clustered_large_trade_count clustered_large_trade_notional large_trade_cluster_activity_rate".split(), "trade_clusters"),
    **dict.fromkeys(["venue_midprice_deviation", "venue_depth_share"], "venue_features"),
    **dict.fromkeys(["cross_venue_median_absolute_dispersion", "indicative_cross_venue_price_range", "venue_concentration_index"], "venue_concentration"),
    **dict.fromkeys(["healthy_venue_fraction", "source_coverage_fraction", "cross_source_disagreement", "cascade_eligibility_gate"], "venue_coverage"),
    **dict.fromkeys(
        """predicted_funding_rate funding_rate_change open_interest_native open_interest_relative_change mark_index_divergence liquidation_observed_count
        liquidation_observed_notional liquidation_observed_velocity""".split(),
        "derivative_features",
    ),
    **dict.fromkeys(
        """liquidation_source_completeness_flag source_latency_ns feed_jitter_ns clock_skew_estimate_ns sequence_gap_count checksum_failure_count reconnect_count recovery_count
        stale_quote_duration_ns feature_age_ns correction_count revision_count raw_to_normalized_rejection_count disk_pressure_fraction local_processing_lag_ns source_outage_indicator
        source_health_gate source_completeness_gate""".split(),
        "operational_features",
    ),
}

ROLES = {"model": "model_eligible", "uncertainty": "uncertainty_only", "gating": "gating_only"}
#: Lifecycle features need certified order-by-order data; sweep costs need a conversion to dollars.
NOT_SUPPORTED = {"expected_buy_sweep_cost_usd_10000", "expected_sell_sweep_cost_usd_10000"}


@dataclass(frozen=True)
class Feature:
    feature_id: str
    family: str
    role: str
    emits: bool
    extent_ns: int
    advance_ns: int
    lateness_ns: int = 5_000_000_000

    @property
    def missing_reason(self) -> str | None:
        if self.emits:
            return None
        return "source_not_supported" if self.feature_id in NOT_SUPPORTED else "model_not_applicable"


_SECOND = 1_000_000_000


def catalogue() -> list[Feature]:
    out = [Feature(n, "price", "model_eligible", True, 300 * _SECOND, 60 * _SECOND) for n in PRICE_FEATURES]
    out += [Feature(n, "book", "model_eligible", n not in NOT_SUPPORTED, _SECOND, _SECOND) for n in BOOK_FEATURES]
    out += [Feature(n, "flow", "model_eligible", True, 60 * _SECOND, _SECOND) for n in FLOW_FEATURES]
    for line in filter(None, VENUE_FEATURES):
        name, role, mark = line.split()
        out.append(Feature(name, "venue", ROLES[role], mark == "+", 60 * _SECOND, _SECOND))
    return out


def registry(spark: SparkSession) -> DataFrame:
    """The catalogue as a table (172 rows)."""
    rows = [(f.feature_id, f.family, f.role, f.emits, f.missing_reason, f.extent_ns, f.advance_ns, f.lateness_ns, COMPUTED_BY.get(f.feature_id) if f.emits else None) for f in catalogue()]
    return spark.createDataFrame(rows, "feature_id string, family string, role string, emits boolean, missing_reason string, extent_ns long, advance_ns long, lateness_ns long, computed_by string")


def unavailable_rows(spark: SparkSession, windows: DataFrame) -> DataFrame:
    """A missing row per window (``entity``, ``window_start_ns``,
    ``window_end_ns``) and feature that emits none.  The features are a fixed
    table of some dozens of rows, so this is a broadcast product with it."""
    none = registry(spark).filter("not emits").select("feature_id", "missing_reason")
    return windows.crossJoin(F.broadcast(none)).withColumn("value", F.lit(None).cast("double"))


def admit(features: DataFrame, spark: SparkSession, least_quality: int, role: str = "model_eligible") -> tuple[DataFrame, DataFrame]:
    """Observations that pass the registry's gate (known id, role, quality, a
    value or a reason but not both), and the others with ``rejected``."""
    known = registry(spark).select("feature_id", F.col("role").alias("__role"))
    rows = features.join(F.broadcast(known), "feature_id", "left")
    reason = (
        F.when(F.col("__role").isNull(), "unknown_feature")
        .when(F.col("__role") != role, "role_not_admitted")
        .when(F.col("quality_millionths") < least_quality, "quality_below_minimum")
        .when(F.col("value").isNull() == F.col("missing_reason").isNull(), "value_and_reason")
        .when(F.isnan("value"), "not_finite")
    )
    marked = rows.withColumn("rejected", reason).drop("__role")
    return marked.filter("rejected is null").drop("rejected"), marked.filter("rejected is not null")
