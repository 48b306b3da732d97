"""Parsers, books and batch/stream parity."""

import json

from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.sources import exchanges
from quantloom.streaming import order_book, sinks

MESSAGES = [
    ("binance", {"e": "aggTrade", "E": 1, "s": "AB", "a": 7, "p": "20441.25", "q": "0.031", "T": 1700000012345, "m": True}),
    ("binance", {"e": "depthUpdate", "E": 5, "s": "AB", "U": 301, "u": 304, "b": [["20441.20", "4.5"], ["20441.15", "0"]], "a": [["20441.25", "0.6"]]}),
    ("binance", {"lastUpdateId": 300, "bids": [["20441.20", "1.00"]], "asks": [["20441.25", "1.00"]]}),
    ("binance", {"u": 4, "s": "AB", "b": "1.5", "B": "1", "a": "1.6", "A": "2"}),
    ("binance", {"e": "markPriceUpdate", "E": 9, "s": "AB", "p": "10", "i": "11", "r": "0.0001", "T": 99}),
    ("binance", {"openInterest": "88123.75", "symbol": "AB", "time": 12}),
    ("binance", {"e": "forceOrder", "E": 3, "o": {"s": "AB", "S": "SELL", "q": "0.6", "p": "20333", "T": 4}}),
    ("bybit", {"topic": "publicTrade.AB", "type": "snapshot", "ts": 5, "data": [{"T": 4, "s": "AB", "S": "Buy", "v": "2", "p": "5", "i": "x"}, {"T": 5, "s": "AB", "S": "Sell", "v": "1", "p": "6", "i": "y"}]}),
    ("bybit", {"topic": "orderbook.50.AB", "type": "delta", "ts": 6, "data": {"s": "AB", "b": [["31415.5", "2.75"]], "a": [], "u": 77, "seq": 9}}),
    ("deribit", {"method": "subscription", "params": {"channel": "book.AB.100ms", "data": {"type": "change", "timestamp": 7, "instrument_name": "AB", "change_id": 101, "prev_change_id": 100, "bids": [["change", 30999.5, 350]], "asks": [["delete", 31002, 0]]}}}),
    ("kraken", {"feed": "trade", "product_id": "AB", "side": "sell", "seq": 5, "time": 8, "qty": 17, "price": 30111, "uid": "u"}),
    ("kraken", {"channel": "book", "type": "snapshot", "data": [{"symbol": "A/B", "bids": [{"price": "1888.4", "qty": "7.25000000"}], "asks": [{"price": "1889.1", "qty": "0.40000000"}], "checksum": 1, "timestamp": "2024-02-03T04:05:06.123456789Z"}]}),
    ("binance", "not json"),
]


def bronze(spark):
    rows = [(1, 1, k, 10**15 + k, v, "spot", m if isinstance(m, str) else json.dumps(m)) for k, (v, m) in enumerate(MESSAGES)]
    return spark.createDataFrame(rows, schemas.BRONZE)


def test_parsers(spark):
    events = exchanges.normalize(bronze(spark))
    assert events.schema.names == schemas.EVENT.names
    by = {}
    for r in events.collect():
        by.setdefault((r["record_sequence"], r["event_type"]), []).append(r)
    trade = by[0, "trade"][0]
    assert (str(trade["price"]), str(trade["quantity"]), trade["side"], trade["event_time_ns"]) == ("20441.25000000", "0.03100000", "sell", 1700000012345000000)
    delta = by[1, "book_delta"][0]
    assert (delta["first_sequence"], delta["last_sequence"], len(delta["bids"]), str(delta["bids"][1]["quantity"])) == (301, 304, 2, "0E-8")
    assert by[2, "book_snapshot"][0]["last_sequence"] == 300 and (3, "top_of_book") in by
    assert {k[1] for k in by if k[0] == 4} == {"mark_index_observation", "funding_observation"}
    assert by[6, "liquidation_observation"][0]["completeness"] == "sampled"
    assert [r["side"] for r in sorted(by[7, "trade"], key=lambda r: r["event_time_ns"])] == ["buy", "sell"]
    assert by[9, "book_delta"][0]["previous_sequence"] == 100
    assert by[11, "book_snapshot"][0]["event_time_ns"] % 10**9 == 123456789
    lost = exchanges.quarantine(bronze(spark), events).collect()
    assert [r["record_sequence"] for r in lost] == [12]
    good, bad = exchanges.validate(events)
    assert good.count() == events.count() and bad.count() == 0


def test_book_crc(spark):
    rows = spark.createDataFrame([([("0.05005", "0.00000500")], [("0.05000", "0.00000500")])], "asks array<struct<price: string, qty: string>>, bids array<struct<price: string, qty: string>>")
    import zlib

    assert rows.select(exchanges.book_crc(F.col("asks"), F.col("bids"))).first()[0] == zlib.crc32(b"5005500" + b"5000500")


def messages(spark):
    s = lambda p, q: [(float(p), float(q))]
    rows = [
        ("x", 1, 1, "snapshot", s(100, 1), s(101, 2), None, 10, None),
        ("x", 2, 2, "delta", s(100, 2.5), [], 11, 11, None),
        ("x", 3, 3, "delta", s(100, 9), [], 11, 11, None),
        ("x", 4, 4, "delta", [], s(101, 0), 12, 12, None),
        ("x", 5, 5, "delta", [], s(102, 1), 15, 15, None),
        ("x", 6, 6, "delta", [], s(103, 1), 21, 21, None),
        ("x", 7, 7, "snapshot", s(99, 1), s(102, 1), None, 20, None),
        ("y", 1, 8, "snapshot", s(5, 1), s(4, 2), None, 1, None),
    ]
    level = "array<struct<price: double, qty: double>>"
    return spark.createDataFrame(rows, f"instrument string, t long, seq long, kind string, bids {level}, asks {level}, first_sequence long, last_sequence long, previous_sequence long")


def test_book_replay(spark):
    got = {(r["instrument"], r["seq"]): r for r in order_book.replay(messages(spark)).collect()}
    assert [got["x", k]["status"] for k in range(1, 8)] == ["normal", "normal", "duplicate", "one_sided", "gap", "waiting", "normal"]
    last = got["x", 7]
    assert (last["best_bid"], last["best_ask"], last["ask_levels"], last["last_sequence"], last["gaps"]) == (99.0, 102.0, 2, 21, 1)
    assert got["y", 8]["status"] == "crossed"
    assert {r["instrument"]: r["seq"] for r in order_book.latest(order_book.replay(messages(spark))).collect()} == {"x": 7, "y": 8}


def test_sequence_policies():
    assert order_book.follows("exact_next", 5, 6, 9, None, False) and not order_book.follows("exact_next", 5, 5, 9, None, False)
    assert order_book.follows("range_contains_next", 5, 3, 6, None, False)
    assert order_book.follows("previous_final", 5, 9, 9, 5, False) and not order_book.follows("previous_final", 5, 6, 9, 4, False)


def test_stream_equals_batch(spark, tmp_path):
    """The same projection over files read as a stream gives the same table."""
    bronze(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.BRONZE).parquet(str(tmp_path / "in"))
    query = sinks.write_stream(exchanges.normalize(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id").collect()
    want = exchanges.normalize(spark.read.parquet(str(tmp_path / "in"))).select("event_id").collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in want) and want


def test_corrections_and_chain(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    fix = spark.createDataFrame([(2, 5.0)], "k long, v double")
    assert sorted((r["k"], r["v"]) for r in sinks.corrected(base, fix, ["k"], 2).collect()) == [(1, 1.0), (2, 5.0)]
    log = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b"), ("c", 3, "c")], "chain string, n long, body string")
    good = sinks.chained(log, "n", ["body"])
    assert sinks.chain_faults(good, "n", ["body"]).count() == 0
    broken = good.withColumn("body", F.when(F.col("n") == 2, "z").otherwise(F.col("body")))
    assert sorted(r["n"] for r in sinks.chain_faults(broken, "n", ["body"]).collect()) == [2, 3]
    assert sinks.append_new(spark, base, spark.createDataFrame([(2, 9.0), (3, 9.0), (3, 9.0)], "k long, v double"), "k").count() == 1
