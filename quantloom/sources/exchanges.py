"""Native exchange messages (JSON text) to normalised events.

A message is parsed after its raw text is in the bronze table.  Each venue has
one schema per message kind and one projection per kind; decimals are read as
text and cast to DECIMAL, never through DOUBLE.  Batched messages explode to
one row per event; a ticker may give several kinds of event.  ``normalize``
returns events; ``quarantine`` the rows no projection accepts, with a reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.schemas import EVENT, EVENT_TYPES, LEVELS, PRICE, QUANTITY, RATE

PAIRS = "array<array<string>>"
MS = 1_000_000

#: What venues' messages are read as.  Binance and Bybit use field names that
#: differ only in case, which a struct cannot hold; they are read as VARIANT.
SHAPES = {
    "bybit": "topic string, type string, ts long, data string",
    "deribit": "method string, params struct<channel: string, data: string>",
    "deribit_book": f"type string, timestamp long, instrument_name string, change_id long, prev_change_id long, bids {PAIRS}, asks {PAIRS}",
    "deribit_trades": "array<struct<trade_id: string, timestamp: long, price: string, amount: string, direction: string, instrument_name: string, iv: string>>",
    "deribit_ticker": "instrument_name string, timestamp long, mark_price string, index_price string, open_interest string, current_funding string, state string, mark_iv string",
    "kraken": "channel string, type string, data string, feed string, product_id string, side string, seq long, price string, qty string, timestamp long, time long, uid string, bids array<struct<price: string, qty: string>>, asks array<struct<price: string, qty: string>>",
    "kraken_book": "array<struct<symbol: string, bids: array<struct<price: string, qty: string>>, asks: array<struct<price: string, qty: string>>, checksum: long, timestamp: string>>",
    "kraken_trades": "array<struct<symbol: string, side: string, price: string, qty: string, ord_type: string, trade_id: string, timestamp: string>>",
}


def _reader(column: str):
    """Fields of a VARIANT column by path: text, integers, flags, pairs."""

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col(column), f"$.{path}", kind)

    return get


def _decimal(column: Column, kind: T.DecimalType) -> Column:
    """Exact; text with an exponent is accepted, anything else is null."""
    return column.try_cast(kind)


def _levels(column: Column) -> Column:
    """Pairs of [price, quantity] (or [action, price, quantity])."""
    at = lambda x, k: F.get(x, F.size(x) - k)
    return F.transform(column, lambda x: F.struct(_decimal(at(x, 2), PRICE).alias("price"), _decimal(at(x, 1), QUANTITY).alias("quantity")))


def _level_structs(column: Column) -> Column:
    return F.transform(column, lambda x: F.struct(_decimal(x["price"], PRICE).alias("price"), _decimal(x["qty"], QUANTITY).alias("quantity")))


def _iso_ns(column: Column) -> Column:
    """RFC 3339 to nanoseconds (digits beyond microseconds kept as text digits)."""
    digits = F.rpad(F.regexp_extract(column, r"\.(\d{1,9})", 1), 9, "0")
    whole = F.unix_seconds(F.to_timestamp(F.regexp_replace(column, r"\.\d+", "")))
    return whole * 1_000_000_000 + F.coalesce(digits.try_cast("long"), F.lit(0))


def _project(rows: DataFrame, event_type: str, **columns: Column) -> DataFrame:
    """Rows of the event schema; columns a kind lacks are null."""
    if event_type not in EVENT_TYPES:
        raise ValueError(event_type)
    base = {c: F.col(c) for c in ("venue", "receive_wall_time_ns", "stream_id", "connection_epoch", "record_sequence")}
    base |= columns | {"event_type": F.lit(event_type)}
    payload = [base[f.name].cast(f.dataType).alias(f.name) if f.name in base else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT.fields[1:]]
    out = rows.select(*payload)
    # Content identity: every field in order, nulls marked, so equal events collide and others do not.
    text = F.concat_ws("\u0001", F.lit("event-v1"), *(F.coalesce(F.to_json(F.struct(c)), F.lit("null")) for c in out.columns))
    return out.select(F.sha2(text, 256).alias("event_id"), *out.columns)


def _side(buy: Column) -> Column:
    return F.when(buy, "buy").otherwise("sell")


def _binance(rows: DataFrame) -> list[DataFrame]:
    r, m = rows.withColumn("j", F.try_parse_json("raw")), _reader("j")
    kind = m("e")
    trade, delta, mark, forced = (r.filter(kind.isin(*k)) for k in (("aggTrade", "trade"), ("depthUpdate",), ("markPriceUpdate",), ("forceOrder",)))
    snapshot = r.filter(m("lastUpdateId").isNotNull())
    ticker = r.filter(kind.isNull() & m("B").isNotNull() & m("A").isNotNull())
    interest = r.filter(m("openInterest").isNotNull())
    status = r.filter(m("status").isNotNull() & m("msg").isNotNull())
    at = m("E", "long") * MS
    return [
        _project(trade, "trade", symbol=m("s"), event_time_ns=m("T", "long") * MS, price=_decimal(m("p"), PRICE), quantity=_decimal(m("q"), QUANTITY), trade_id=m("a"), side=_side(~m("m", "boolean"))),
        _project(delta, "book_delta", symbol=m("s"), event_time_ns=at, bids=_levels(m("b", PAIRS)), asks=_levels(m("a", PAIRS)), first_sequence=m("U", "long"), last_sequence=m("u", "long"), previous_sequence=m("pu", "long")),
        _project(snapshot, "book_snapshot", event_time_ns=F.col("receive_wall_time_ns"), bids=_levels(m("bids", PAIRS)), asks=_levels(m("asks", PAIRS)), last_sequence=m("lastUpdateId", "long")),
        _project(ticker, "top_of_book", symbol=m("s"), event_time_ns=F.col("receive_wall_time_ns"), bids=_levels(F.array(F.array(m("b"), m("B")))), asks=_levels(F.array(F.array(m("a"), m("A")))), last_sequence=m("u", "long")),
        _project(mark, "mark_index_observation", symbol=m("s"), event_time_ns=at, mark_price=_decimal(m("p"), PRICE), index_price=_decimal(m("i"), PRICE)),
        _project(mark, "funding_observation", symbol=m("s"), event_time_ns=at, funding_rate=_decimal(m("r"), RATE), next_funding_time_ns=m("T", "long") * MS),
        _project(interest, "open_interest_observation", symbol=m("symbol"), event_time_ns=m("time", "long") * MS, open_interest=_decimal(m("openInterest"), QUANTITY)),
        _project(forced, "liquidation_observation", symbol=m("o.s"), event_time_ns=m("o.T", "long") * MS, price=_decimal(m("o.p"), PRICE), quantity=_decimal(m("o.q"), QUANTITY), side=F.lower(m("o.S")), completeness=F.lit("sampled")),
        _project(status, "venue_status", event_time_ns=F.col("receive_wall_time_ns"), state=F.when(m("status", "int") == 0, "trading").otherwise("maintenance")),
    ]


def _bybit(rows: DataFrame) -> list[DataFrame]:
    r, d = rows.withColumn("m", F.from_json("raw", SHAPES["bybit"])), _reader("d")
    one = lambda topic: r.filter(F.col("m.topic").startswith(topic)).withColumn("d", F.try_parse_json("m.data"))
    many = lambda topic: r.filter(F.col("m.topic").startswith(topic)).withColumn("one", F.explode(F.from_json("m.data", "array<string>"))).withColumn("d", F.try_parse_json("one"))
    book, deal, tick, forced = one("orderbook."), many("publicTrade."), one("tickers."), many("allLiquidation.")
    at = F.col("m.ts") * MS
    levels = {"symbol": d("s"), "event_time_ns": at, "bids": _levels(d("b", PAIRS)), "asks": _levels(d("a", PAIRS)), "last_sequence": d("u", "long")}
    ticker = {"symbol": d("symbol"), "event_time_ns": at}
    print_ = {"symbol": d("s"), "event_time_ns": d("T", "long") * MS, "price": _decimal(d("p"), PRICE), "quantity": _decimal(d("v"), QUANTITY), "side": F.lower(d("S"))}
    return [
        _project(book.filter("m.type = 'snapshot'"), "book_snapshot", **levels),
        _project(book.filter("m.type = 'delta'"), "book_delta", first_sequence=d("u", "long"), **levels),
        _project(deal, "trade", trade_id=d("i"), **print_),
        _project(tick.filter(d("markPrice").isNotNull()), "mark_index_observation", mark_price=_decimal(d("markPrice"), PRICE), index_price=_decimal(d("indexPrice"), PRICE), **ticker),
        _project(tick.filter(d("fundingRate").isNotNull()), "funding_observation", funding_rate=_decimal(d("fundingRate"), RATE), next_funding_time_ns=d("nextFundingTime").try_cast("long") * MS, **ticker),
        _project(tick.filter(d("openInterest").isNotNull()), "open_interest_observation", open_interest=_decimal(d("openInterest"), QUANTITY), **ticker),
        _project(forced, "liquidation_observation", completeness=F.lit("venue_reported_all"), **print_),
    ]


def _deribit(rows: DataFrame) -> list[DataFrame]:
    r = rows.withColumn("m", F.from_json("raw", SHAPES["deribit"]))
    book = r.filter("m.params.channel like 'book.%'").withColumn("d", F.from_json("m.params.data", SHAPES["deribit_book"]))
    deal = r.filter("m.params.channel like 'trades.%'").withColumn("d", F.explode(F.from_json("m.params.data", SHAPES["deribit_trades"])))
    tick = r.filter("m.params.channel like 'ticker.%'").withColumn("d", F.from_json("m.params.data", SHAPES["deribit_ticker"]))
    levels = {"symbol": F.col("d.instrument_name"), "event_time_ns": F.col("d.timestamp") * MS, "bids": _levels(F.col("d.bids")), "asks": _levels(F.col("d.asks")), "last_sequence": F.col("d.change_id")}
    ticker = {"symbol": F.col("d.instrument_name"), "event_time_ns": F.col("d.timestamp") * MS}
    print_ = ticker | {"price": _decimal(F.col("d.price"), PRICE), "quantity": _decimal(F.col("d.amount"), QUANTITY), "side": F.lower("d.direction"), "trade_id": F.col("d.trade_id")}
    option = F.col("d.instrument_name").rlike("-[CP]$")
    return [
        _project(book.filter("d.type = 'snapshot'"), "book_snapshot", **levels),
        _project(book.filter("d.type = 'change'"), "book_delta", first_sequence=F.col("d.change_id"), previous_sequence=F.col("d.prev_change_id"), **levels),
        _project(deal.filter(~option), "trade", **print_),
        _project(deal.filter(option), "option_trade", **print_),
        _project(tick.filter(option), "option_ticker", mark_price=_decimal(F.col("d.mark_price"), PRICE), open_interest=_decimal(F.col("d.open_interest"), QUANTITY), **ticker),
        _project(tick.filter(~option & F.col("d.index_price").isNotNull()), "mark_index_observation", mark_price=_decimal(F.col("d.mark_price"), PRICE), index_price=_decimal(F.col("d.index_price"), PRICE), **ticker),
        _project(tick.filter(~option & F.col("d.current_funding").isNotNull()), "funding_observation", funding_rate=_decimal(F.col("d.current_funding"), RATE), **ticker),
        _project(tick.filter(F.col("d.open_interest").isNotNull()), "open_interest_observation", open_interest=_decimal(F.col("d.open_interest"), QUANTITY), **ticker),
    ]


def _kraken(rows: DataFrame) -> list[DataFrame]:
    r = rows.withColumn("m", F.from_json("raw", SHAPES["kraken"]))
    book = r.filter("m.channel = 'book'").withColumn("d", F.explode(F.from_json("m.data", SHAPES["kraken_book"])))
    deal = r.filter("m.channel = 'trade'").withColumn("d", F.explode(F.from_json("m.data", SHAPES["kraken_trades"])))
    at = F.coalesce(_iso_ns(F.col("d.timestamp")), F.col("receive_wall_time_ns"))
    levels = {"symbol": F.col("d.symbol"), "event_time_ns": at, "bids": _level_structs(F.col("d.bids")), "asks": _level_structs(F.col("d.asks"))}
    future = {"symbol": F.col("m.product_id"), "last_sequence": F.col("m.seq")}
    one = F.array(F.struct(_decimal(F.col("m.price"), PRICE).alias("price"), _decimal(F.col("m.qty"), QUANTITY).alias("quantity")))
    none = F.array().cast(LEVELS)
    buy = F.col("m.side") == "buy"
    return [
        _project(book.filter("m.type = 'snapshot'"), "book_snapshot", **levels),
        _project(book.filter("m.type = 'update'"), "book_delta", **levels),
        _project(deal, "trade", symbol=F.col("d.symbol"), event_time_ns=_iso_ns(F.col("d.timestamp")), price=_decimal(F.col("d.price"), PRICE), quantity=_decimal(F.col("d.qty"), QUANTITY), side=F.col("d.side"), trade_id=F.col("d.trade_id")),
        _project(r.filter("m.feed = 'book_snapshot'"), "book_snapshot", event_time_ns=F.col("m.timestamp") * MS, bids=_level_structs(F.col("m.bids")), asks=_level_structs(F.col("m.asks")), **future),
        _project(r.filter("m.feed = 'book'"), "book_delta", event_time_ns=F.col("m.timestamp") * MS, first_sequence=F.col("m.seq"), bids=F.when(buy, one).otherwise(none), asks=F.when(buy, none).otherwise(one), **future),
        _project(r.filter("m.feed = 'trade'"), "trade", event_time_ns=F.col("m.time") * MS, price=_decimal(F.col("m.price"), PRICE), quantity=_decimal(F.col("m.qty"), QUANTITY), side=F.col("m.side"), trade_id=F.col("m.uid"), symbol=F.col("m.product_id")),
    ]


VENUES = {"binance": _binance, "bybit": _bybit, "deribit": _deribit, "kraken": _kraken}


def normalize(bronze: DataFrame, venues: tuple[str, ...] = tuple(VENUES)) -> DataFrame:
    """Events of all the given venues (batch or stream)."""
    parts = [p for v in venues for p in VENUES[v](bronze.filter(F.col("venue") == v))]
    return reduce(DataFrame.unionByName, parts)


def invalid_reason() -> Column:
    """First invariant an event breaks; null if it is sound."""
    positive = F.col("event_type").isin("trade", "option_trade", "liquidation_observation")
    return (
        F.when(F.col("event_time_ns").isNull() | (F.col("event_time_ns") <= 0), "invalid_time")
        .when(positive & (F.col("price").isNull() | (F.col("price") <= 0)), "invalid_price")
        .when(positive & (F.col("quantity").isNull() | (F.col("quantity") <= 0)), "invalid_quantity")
        .when((F.col("event_type") == "book_delta") & (F.col("first_sequence") > F.col("last_sequence")), "invalid_sequence")
        .when((F.col("event_type") == "book_delta") & (F.col("previous_sequence") >= F.col("last_sequence")), "invalid_sequence")
        .when(F.exists(F.coalesce("bids", F.array().cast(LEVELS)), lambda x: x["price"].isNull() | (x["price"] <= 0) | x["quantity"].isNull()), "invalid_level")
        .when(F.exists(F.coalesce("asks", F.array().cast(LEVELS)), lambda x: x["price"].isNull() | (x["price"] <= 0) | x["quantity"].isNull()), "invalid_level")
    )


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound events, and the others with ``reason``."""
    marked = events.withColumn("reason", invalid_reason())
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def quarantine(bronze: DataFrame, events: DataFrame) -> DataFrame:
    """Bronze rows that gave no event."""
    keys = ["stream_id", "connection_epoch", "record_sequence"]
    return bronze.join(events.select(*keys).distinct(), keys, "left_anti").withColumn("reason", F.lit("no_projection"))


def top_level_text_crc(levels: Column, depth: int = 10) -> Column:
    """The text a spot book's CRC-32 runs over: for each level price and
    quantity as raw decimal text, without the point and leading zeros."""
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"\.", ""), "^0+", "")
    return F.array_join(F.transform(F.slice(levels, 1, depth), lambda x: F.concat(bare(x["price"]), bare(x["qty"]))), "")


def book_crc(asks: Column, bids: Column) -> Column:
    """CRC-32 of the ten best asks, then bids (raw text levels)."""
    return F.crc32(F.concat(top_level_text_crc(asks), top_level_text_crc(bids)))


LEVEL3 = "array<struct<symbol: string, checksum: long, timestamp: string, bids: array<struct<order_id: string, limit_price: string, order_qty: string, timestamp: string, event: string>>, asks: array<struct<order_id: string, limit_price: string, order_qty: string, timestamp: string, event: string>>>>"


def level3(bronze: DataFrame) -> DataFrame:
    """Kraken order-by-order messages: one row per order event, in the shape of
    ``lifecycle.l3_levels``, with the message's checksum."""
    r = bronze.withColumn("m", F.from_json("raw", "channel string, type string, data string")).filter("m.channel = 'level3'")
    d = r.select("record_sequence", F.col("m.type").alias("type"), F.posexplode(F.from_json("m.data", LEVEL3)).alias("at", "d"))
    every = lambda side: F.transform(F.coalesce(F.col(f"d.{side}s"), F.array()), lambda o, k: F.struct(F.lit(side).alias("side"), k.alias("place"), o.alias("o")))
    rows = d.select("record_sequence", "type", F.col("d.symbol").alias("symbol"), F.col("d.checksum").alias("checksum"), F.explode(F.concat(every("bid"), every("ask"))).alias("x"))
    action = F.coalesce("x.o.event", F.when(F.col("type") == "snapshot", "add"))
    return rows.select(
        "symbol", "checksum", F.col("x.side").alias("side"), F.col("x.o.order_id").alias("order_id"), action.alias("action"), _decimal(F.col("x.o.limit_price"), PRICE).alias("price"), _decimal(F.col("x.o.order_qty"), QUANTITY).alias("qty"),
        F.col("x.o.limit_price").alias("price_text"), F.col("x.o.order_qty").alias("qty_text"), _iso_ns(F.col("x.o.timestamp")).alias("t"), (F.col("record_sequence") * 1_000_000 + F.col("x.place")).alias("seq"),
    )


def level3_crc(orders: DataFrame, keys: list[str], depth: int = 10) -> DataFrame:
    """CRC-32 of each group's open orders: the ten best asks, then bids, each
    level's orders in queue order, as raw decimal text without point and
    leading zeros."""
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"\.", ""), "^0+", "")
    text = F.concat(bare(F.col("price_text")), bare(F.col("qty_text")))
    queue = F.transform(F.array_sort(F.collect_list(F.struct("t", "seq", text.alias("text")))), lambda x: x["text"])
    level = orders.groupBy(*keys, "side", "price").agg(F.array_join(queue, "").alias("text"))
    signed = F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))
    side = level.groupBy(*keys, "side").agg(F.array_sort(F.collect_list(F.struct(signed.alias("at"), "text"))).alias("all"))
    joined = F.array_join(F.transform(F.slice("all", 1, depth), lambda x: x["text"]), "")
    return side.groupBy(*keys).agg(F.crc32(F.concat(F.coalesce(F.max(F.when(F.col("side") == "ask", joined)), F.lit("")), F.coalesce(F.max(F.when(F.col("side") == "bid", joined)), F.lit("")))).alias("crc"))
