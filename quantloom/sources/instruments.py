"""Instrument metadata messages (JSON text) to instrument definitions.

Each venue's listing message explodes to one row per instrument.  Ticks and
steps are decimals read as text.  A row that lacks a symbol, a positive tick or
a positive step is rejected with a reason, never repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "decimal(38,18)"
MS = 1_000_000

#: What the venues' listing messages are read as (field names are wire format).
SHAPES = {
    "binance": "symbols array<struct<symbol: string, status: string, contractType: string, baseAsset: string, quoteAsset: string, marginAsset: string, onboardDate: long, "
    "filters array<struct<filterType: string, tickSize: string, stepSize: string>>>>",
    "bybit": "result struct<category: string, nextPageCursor: string, list array<struct<symbol: string, contractType: string, status: string, baseCoin: string, quoteCoin: string, settleCoin: string, "
    "launchTime: string, deliveryTime: string, priceFilter: struct<tickSize: string>, lotSizeFilter: struct<qtyStep: string, basePrecision: string>>>>",
    "deribit": "result array<struct<instrument_name: string, kind: string, instrument_type: string, state: string, base_currency: string, quote_currency: string, settlement_currency: string, "
    "tick_size: string, min_trade_amount: string, contract_size: string, strike: string, option_type: string, creation_timestamp: long, expiration_timestamp: long, settlement_period: string>>",
    "kraken": "channel string, type string, data struct<pairs: array<struct<symbol: string, base: string, quote: string, status: string, price_increment: string, qty_increment: string>>>",
}
SHAPES = {venue: shape.replace("filters array", "filters: array").replace("list array", "list: array") for venue, shape in SHAPES.items()}

COLUMNS = ("venue", "symbol", "product", "base", "quote", "settlement", "tick", "step", "multiplier", "strike", "option_side", "listed_ns", "expires_ns", "trading")


def number(text: Column) -> Column:
    """An exact decimal, also from exponent notation; null if it is none."""
    return text.try_cast(NUMBER)


def _row(symbol, product, base, quote, settlement, tick, step, listed_ms, expires_ms, trading, multiplier=None, strike=None, side=None) -> list[Column]:
    nothing = F.lit(None)
    after = lambda ms: F.when(ms > 0, ms * MS)
    return [
        symbol.alias("symbol"), product.alias("product"), base.alias("base"), quote.alias("quote"), settlement.alias("settlement"), number(tick).alias("tick"), number(step).alias("step"),
        (number(multiplier) if multiplier is not None else F.lit(1).cast(NUMBER)).alias("multiplier"), (number(strike) if strike is not None else nothing.cast(NUMBER)).alias("strike"),
        (side if side is not None else nothing.cast("string")).alias("option_side"), after(listed_ms).alias("listed_ns"), after(expires_ms).alias("expires_ns"), F.coalesce(trading, F.lit(False)).alias("trading"),
    ]


def _filter(kind: str, field: str) -> Column:
    return F.get(F.filter("x.filters", lambda f: f["filterType"] == kind), F.lit(0))[field]


def definitions(messages: DataFrame, venue: str) -> DataFrame:
    """``raw`` messages of one venue to rows of ``COLUMNS``."""
    c = F.col
    read = messages.select(F.from_json("raw", SHAPES[venue]).alias("m"))
    none, no_time = F.lit(None).cast("string"), F.lit(None).cast("long")
    if venue == "binance":
        rows = read.select(F.explode("m.symbols").alias("x"))
        perpetual = c("x.contractType") == "PERPETUAL"
        made = _row(c("x.symbol"), F.when(perpetual, "perpetual").when(c("x.contractType").isNull(), "spot").otherwise("future"), c("x.baseAsset"), c("x.quoteAsset"), F.coalesce("x.marginAsset", "x.quoteAsset"),
                    _filter("PRICE_FILTER", "tickSize"), _filter("LOT_SIZE", "stepSize"), c("x.onboardDate"), no_time, c("x.status") == "TRADING")
    elif venue == "bybit":
        rows = read.select(c("m.result.category").alias("category"), F.explode("m.result.list").alias("x"))
        product = F.when(c("category") == "spot", "spot").when(c("x.contractType").endswith("Perpetual"), "perpetual").otherwise("future")
        made = _row(c("x.symbol"), product, c("x.baseCoin"), c("x.quoteCoin"), F.coalesce("x.settleCoin", "x.quoteCoin"), c("x.priceFilter.tickSize"), F.coalesce("x.lotSizeFilter.qtyStep", "x.lotSizeFilter.basePrecision"),
                    c("x.launchTime").try_cast("long"), c("x.deliveryTime").try_cast("long"), c("x.status") == "Trading")
    elif venue == "deribit":
        rows = read.select(F.explode("m.result").alias("x"))
        product = F.when(c("x.kind") == "option", "option").when(c("x.settlement_period") == "perpetual", "perpetual").when(c("x.kind") == "future", "future").otherwise(c("x.kind"))
        ends = F.when(c("x.settlement_period") != "perpetual", c("x.expiration_timestamp"))
        made = _row(c("x.instrument_name"), product, c("x.base_currency"), c("x.quote_currency"), c("x.settlement_currency"), c("x.tick_size"), c("x.min_trade_amount"), c("x.creation_timestamp"), ends,
                    c("x.state") == "open", c("x.contract_size"), c("x.strike"), c("x.option_type"))
    else:
        rows = read.filter("m.channel = 'instrument'").select(F.explode("m.data.pairs").alias("x"))
        made = _row(c("x.symbol"), F.lit("spot"), c("x.base"), c("x.quote"), c("x.quote"), c("x.price_increment"), c("x.qty_increment"), no_time, no_time, c("x.status") == "online", strike=none, side=none)
    return rows.select(F.lit(venue).alias("venue"), *made)


def judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted definitions, and the others with the reason."""
    reason = (
        F.when(F.coalesce(F.col("symbol") == "", F.lit(True)), "no_symbol")
        .when(F.col("base").isNull() | F.col("quote").isNull(), "no_asset")
        .when(F.coalesce(F.col("tick") <= 0, F.lit(True)), "bad_tick")
        .when(F.coalesce(F.col("step") <= 0, F.lit(True)), "bad_step")
        .when((F.col("product") == "option") & (F.coalesce(F.col("strike") <= 0, F.lit(True)) | ~F.coalesce(F.col("option_side").isin("call", "put"), F.lit(False))), "bad_option")
        .when(F.col("expires_ns") <= F.col("listed_ns"), "expires_before_listing")
    )
    marked = rows.withColumn("rejected", reason)
    return marked.filter("rejected is null").drop("rejected"), marked.filter("rejected is not null")


#: Option tickers carry their venue's greeks (wire format).
OPTION_TICKER = (
    "params struct<channel: string, data: struct<instrument_name: string, timestamp: long, mark_price: string, mark_iv: string, underlying_price: string, open_interest: string, "
    "greeks: struct<delta: string, gamma: string, vega: string, theta: string, rho: string>>>"
)


def option_tickers(messages: DataFrame) -> DataFrame:
    """Deribit option tickers with the source's greeks; one without an
    instrument or a time is left out."""
    d = "m.params.data"
    rows = messages.select(F.from_json("raw", OPTION_TICKER).alias("m")).filter(F.col("m.params.channel").startswith("ticker."))
    greeks = [F.col(f"{d}.greeks.{g}").try_cast("double").alias(g) for g in ("delta", "gamma", "vega", "theta", "rho")]
    out = rows.select(F.col(f"{d}.instrument_name").alias("symbol"), (F.col(f"{d}.timestamp") * MS).alias("t"), *(number(F.col(f"{d}.{n}")).alias(n) for n in ("mark_price", "mark_iv", "underlying_price", "open_interest")), *greeks)
    return out.filter("symbol is not null and t is not null and delta is not null")


def venue_status(messages: DataFrame) -> DataFrame:
    """Kraken status messages: the system's state as a venue status."""
    rows = messages.select(F.from_json("raw", "channel string, data array<struct<system: string, api_version: string, version: string>>").alias("m")).filter("m.channel = 'status'")
    state = F.col("x.system")
    known = F.when(state == "online", "trading").when(state == "maintenance", "maintenance").when(state.isin("cancel_only", "post_only", "limit_only"), "restricted").otherwise("unknown")
    return rows.select(F.explode("m.data").alias("x")).select(state.alias("system"), known.alias("venue_status"))
