"""Instrument listings and tickers of made-up messages."""

import json
from decimal import Decimal

from quantloom.sources import instruments

LISTINGS = {
    "binance": {"symbols": [
        {"symbol": "QAQB", "status": "TRADING", "baseAsset": "QA", "quoteAsset": "QB", "filters": [{"filterType": "LOT_SIZE", "stepSize": "0.25"}, {"filterType": "PRICE_FILTER", "tickSize": "0.05"}]},
        {"symbol": "QAP", "status": "BREAK", "contractType": "PERPETUAL", "baseAsset": "QA", "quoteAsset": "QB", "marginAsset": "QB", "onboardDate": 7, "filters": [{"filterType": "LOT_SIZE", "stepSize": "2"}, {"filterType": "PRICE_FILTER", "tickSize": "1e-3"}]},
        {"symbol": "BAD", "status": "TRADING", "baseAsset": "QA", "quoteAsset": "QB", "filters": [{"filterType": "LOT_SIZE", "stepSize": "2"}]},
    ]},
    "bybit": {"result": {"category": "linear", "list": [
        {"symbol": "QAQB", "contractType": "LinearPerpetual", "status": "Trading", "baseCoin": "QA", "quoteCoin": "QB", "settleCoin": "QB", "launchTime": "9", "deliveryTime": "0", "priceFilter": {"tickSize": "0.5"}, "lotSizeFilter": {"qtyStep": "0.1"}},
        {"symbol": "", "contractType": "LinearPerpetual", "status": "Trading", "baseCoin": "QA", "quoteCoin": "QB", "priceFilter": {"tickSize": "0.5"}, "lotSizeFilter": {"qtyStep": "0.1"}},
    ]}},
    "deribit": {"result": [
        {"instrument_name": "QA-50-C", "kind": "option", "state": "open", "base_currency": "QA", "quote_currency": "USD", "settlement_currency": "QA", "tick_size": 5e-4, "min_trade_amount": 0.1, "contract_size": 1, "strike": 50, "option_type": "call", "creation_timestamp": 3, "expiration_timestamp": 8, "settlement_period": "month"},
        {"instrument_name": "QA-P", "kind": "future", "state": "open", "base_currency": "QA", "quote_currency": "USD", "settlement_currency": "QA", "tick_size": 0.5, "min_trade_amount": 10, "contract_size": 10, "creation_timestamp": 3, "expiration_timestamp": 99, "settlement_period": "perpetual"},
        {"instrument_name": "QA-X", "kind": "option", "state": "open", "base_currency": "QA", "quote_currency": "USD", "settlement_currency": "QA", "tick_size": 0.5, "min_trade_amount": 10, "contract_size": 10, "strike": 0, "option_type": "call", "settlement_period": "day"},
    ]},
    "kraken": {"channel": "instrument", "type": "snapshot", "data": {"pairs": [{"symbol": "QA/QB", "base": "QA", "quote": "QB", "status": "online", "price_increment": "0.1", "qty_increment": "0.00000001"}]}},
}


def test_listings(spark):
    good, bad = {}, {}
    for venue, message in LISTINGS.items():
        raw = spark.createDataFrame([(json.dumps(message),), ("not json",)], "raw string")
        rows = instruments.definitions(raw, venue)
        assert tuple(rows.columns) == instruments.COLUMNS
        fine, lost = instruments.judged(rows)
        good |= {(venue, r["symbol"]): r for r in fine.collect()}
        bad |= {(venue, r["symbol"]): r["rejected"] for r in lost.collect()}
    assert bad == {("binance", "BAD"): "bad_tick", ("bybit", ""): "no_symbol", ("deribit", "QA-X"): "bad_option"}
    assert {k: r["product"] for k, r in good.items()} == {
        ("binance", "QAQB"): "spot", ("binance", "QAP"): "perpetual", ("bybit", "QAQB"): "perpetual", ("deribit", "QA-50-C"): "option", ("deribit", "QA-P"): "perpetual", ("kraken", "QA/QB"): "spot",
    }
    perp, option = good["binance", "QAP"], good["deribit", "QA-50-C"]
    assert (perp["tick"], perp["listed_ns"], perp["trading"]) == (Decimal("0.001"), 7_000_000, False)
    assert (option["tick"], option["strike"], option["option_side"], option["expires_ns"]) == (Decimal("0.0005"), 50, "call", 8_000_000)
    assert good["deribit", "QA-P"]["expires_ns"] is None and good["kraken", "QA/QB"]["step"] == Decimal("1e-8")


def test_tickers_and_status(spark):
    ticker = {"params": {"channel": "ticker.QA-50-C.100ms", "data": {"instrument_name": "QA-50-C", "timestamp": 5, "mark_price": 2.5e-7, "greeks": {"delta": 0.4, "gamma": 0.1}}}}
    status = {"channel": "status", "data": [{"system": "cancel_only", "version": "2"}]}
    raw = spark.createDataFrame([(json.dumps(ticker),), (json.dumps(status),), ("{}",)], "raw string")
    row = instruments.option_tickers(raw).collect()
    assert [(r["symbol"], r["t"], r["mark_price"], r["delta"], r["vega"]) for r in row] == [("QA-50-C", 5_000_000, Decimal("2.5e-7"), 0.4, None)]
    assert [tuple(r) for r in instruments.venue_status(raw).collect()] == [("cancel_only", "restricted")]
