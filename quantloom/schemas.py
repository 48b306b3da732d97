"""Explicit schemas.  Nothing is inferred: bronze rows are text, silver rows
have these types, and rows that do not fit go to quarantine with a reason."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE, QUANTITY, NOTIONAL, RATE = T.DecimalType(18, 8), T.DecimalType(18, 8), T.DecimalType(38, 16), T.DecimalType(18, 12)

LEVELS = T.ArrayType(T.StructType([T.StructField("price", PRICE), T.StructField("quantity", QUANTITY)]))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Raw messages with what ties them to the log they were written to first.
BRONZE = _struct(
    stream_id=T.LongType(), connection_epoch=T.LongType(), record_sequence=T.LongType(), receive_wall_time_ns=T.LongType(), venue=T.StringType(), market=T.StringType(), raw=T.StringType()
)

#: One normalised event; the payload's columns that its kind lacks are null.
EVENT = _struct(
    event_id=T.StringType(),
    event_type=T.StringType(),
    venue=T.StringType(),
    symbol=T.StringType(),
    event_time_ns=T.LongType(),
    receive_wall_time_ns=T.LongType(),
    stream_id=T.LongType(),
    connection_epoch=T.LongType(),
    record_sequence=T.LongType(),
    price=PRICE,
    quantity=QUANTITY,
    side=T.StringType(),
    trade_id=T.StringType(),
    bids=LEVELS,
    asks=LEVELS,
    first_sequence=T.LongType(),
    last_sequence=T.LongType(),
    previous_sequence=T.LongType(),
    mark_price=PRICE,
    index_price=PRICE,
    funding_rate=RATE,
    next_funding_time_ns=T.LongType(),
    open_interest=QUANTITY,
    state=T.StringType(),
    completeness=T.StringType(),
)

#: Kinds of payload (fixed values).
EVENT_TYPES = (
    "trade", "top_of_book", "book_snapshot", "book_delta", "instrument_definition", "funding_observation", "open_interest_observation",
    "liquidation_observation", "mark_index_observation", "future_basis_observation", "option_ticker", "option_trade", "venue_status",
    "chain_block", "chain_transaction_aggregate", "chain_mempool_observation", "chain_metric", "external_market_observation",
    "structured_event", "data_quality_observation", "prediction_record", "alert_event",
)

#: A materialised feature row.
FEATURE = T.StructType(
    [
        T.StructField(name, kind, nullable)
        for name, kind, nullable in (
            ("effective_event_time_ns", T.LongType(), False), ("exchange_event_time_ns", T.LongType(), True), ("receive_wall_time_ns", T.LongType(), False),
            ("event_type", T.StringType(), False), ("venue", T.StringType(), False), ("instrument_generation", T.IntegerType(), False),
            ("connection_epoch", T.LongType(), False), ("subscription_epoch", T.LongType(), False), ("wal_record_sequence", T.LongType(), False),
            ("feature_id", T.StringType(), False), ("feature_version", T.StringType(), False), ("entity_json", T.StringType(), False),
            ("window_id", T.StringType(), False), ("resolution_ns", T.LongType(), False), ("datum_json", T.StringType(), False),
            ("value_type", T.StringType(), False), ("event_time_start_ns", T.LongType(), False), ("event_time_end_ns", T.LongType(), False),
            ("as_known_at_ns", T.LongType(), False), ("computed_at_ns", T.LongType(), False), ("watermark_ns", T.LongType(), True),
            ("finality_as_known_at_ns", T.LongType(), False), ("finality_state", T.StringType(), False), ("revision", T.IntegerType(), False),
            ("source_coverage_json", T.StringType(), False), ("quality_millionths", T.IntegerType(), False), ("normalization_version", T.StringType(), False),
            ("formula_hash", T.StringType(), False), ("code_commit", T.StringType(), False), ("lineage_hash", T.StringType(), False), ("float_bits", T.LongType(), True),
        )
    ]
)
