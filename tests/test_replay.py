"""Logs, manifests, recordings and order-by-order books."""

import hashlib
import json
import zlib

import pytest

from quantloom import schemas
from quantloom.operators import lifecycle
from quantloom.sources import exchanges, log, replay
from quantloom.streaming import order_book

MAGIC = b"FRAMELOG"


def test_crc_is_castagnoli():
    assert log.crc32c(b"123456789") == 0xE3069283 and log.crc32c(b"") == 0


def test_segments(spark, tmp_path):
    some = [log.Frame(1, 2, k, 10 + k, k, b"payload %d" % k) for k in range(5)]
    whole = b"".join(log.encode(f, MAGIC) for f in some)
    (tmp_path / "a.seg").write_bytes(whole)
    (tmp_path / "b.seg").write_bytes(whole + log.encode(some[0], MAGIC)[:30])
    broken = bytearray(whole)
    broken[len(whole) // 2] ^= 1
    (tmp_path / "c.seg").write_bytes(bytes(broken))
    (tmp_path / "d.seg").write_bytes(b"")
    rows = log.read_segments(spark, str(tmp_path), MAGIC).collect()
    by = {n: sorted((r for r in rows if r["path"].endswith(n)), key=lambda r: r["offset"]) for n in ("a.seg", "b.seg", "c.seg", "d.seg")}
    assert [(r["record_sequence"], bytes(r["payload"]), r["fault"]) for r in by["a.seg"]] == [(f.record_sequence, f.payload, None) for f in some]
    assert [r["fault"] for r in by["b.seg"]] == [None] * 5 + ["incomplete"]
    assert [r["fault"] for r in by["c.seg"]][:2] == [None, None] and by["c.seg"][-1]["fault"] in ("frame_checksum", "header_checksum") and not by["d.seg"]


def test_manifest(spark, tmp_path):
    body = json.dumps({"lastUpdateId": 5, "bids": [["7.5", "1"]], "asks": [["8", "2"]]})
    (tmp_path / "one.json").write_text(body)
    digest = hashlib.sha256(body.encode()).hexdigest()
    text = f'venue = "binance"\nmarket = "spot"\nconnection_epoch = 3\nmax_total_input_bytes = 4096\n[[record]]\nstream_id = 1\npath = "one.json"\nsha256 = "{digest}"\nrecord_sequence = 1\nreceive_wall_time_ns = 50\n'
    (tmp_path / "m.toml").write_text(text)
    manifest, records = replay.read_manifest(str(tmp_path / "m.toml"), str(tmp_path))
    events = exchanges.normalize(replay.bronze(spark, manifest, records)).collect()
    assert [(e["event_type"], e["last_sequence"]) for e in events] == [("book_snapshot", 5)]
    assert replay.bronze(spark, manifest, records, until_ns=49).count() == 0
    for bad in (text.replace(digest, "0" * 64), text.replace("one.json", "../one.json"), text.replace("4096", "4")):
        (tmp_path / "m.toml").write_text(bad)
        with pytest.raises((ValueError, FileNotFoundError)):
            replay.read_manifest(str(tmp_path / "m.toml"), str(tmp_path))


def test_recorded_book(spark, tmp_path):
    lines = [
        {"kind": "snapshot", "source": "v", "symbol": "AB", "generation": 1, "event_unix_nanos": 1, "sequence": 9, "bids": [["70.5", "1"]], "asks": [["71", "4"]]},
        {"kind": "delta", "source": "v", "symbol": "AB", "generation": 1, "event_unix_nanos": 2, "first_sequence": 10, "last_sequence": 10, "bids": [["70.5", "3"]], "asks": []},
        {"kind": "delta", "source": "v", "symbol": "AB", "generation": 1, "event_unix_nanos": 3, "first_sequence": 11, "last_sequence": 11, "bids": [], "asks": [["71", "0"], ["72", "5"]]},
    ]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, lines)))
    out = order_book.replay(replay.recorded_books(spark, str(tmp_path / "b.jsonl"))).orderBy("t").collect()
    assert [(r["status"], r["best_bid_qty"], r["best_ask"], r["last_sequence"]) for r in out] == [("normal", 1.0, 71.0, 9), ("normal", 3.0, 71.0, 10), ("normal", 3.0, 72.0, 11)]


def test_round_trip_receipts_and_baselines(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "S", 10, 12, 0.5), ("e2", "S", 30, 31, None), ("e3", "T", 10, 12, 1.0)], "event_id string, symbol string, event_time_ns long, receive_wall_time_ns long, v double")
    for kind in ("parquet", "json"):
        assert replay.round_trip(spark, rows, str(tmp_path / kind), kind).count() == 3
    catalogue = spark.createDataFrame([("S", 1, 0, 20, 0), ("S", 2, 0, 20, 11), ("S", 3, 0, 20, 99), ("S", 4, 20, None, 0)], "symbol string, revision int, valid_from_ns long, valid_to_ns long, known_at_ns long")
    got = {r["event_id"]: r["catalogue_revision"] for r in replay.with_receipts(rows, catalogue, "1").collect()}
    assert got == {"e1": 2, "e2": 4, "e3": None}
    base = spark.createDataFrame([("e1", 0.1), ("e2", 0.2), ("e3", 0.3)], "event_id string, b double")
    assert replay.aligned(base, rows, "event_id").count() == 3
    for bad in (base.filter("event_id <> 'e1'"), base.union(base)):
        with pytest.raises(ValueError):
            replay.aligned(bad, rows, "event_id")


def test_level3(spark):
    side = lambda *orders: [{"order_id": i, "limit_price": p, "order_qty": q, "timestamp": f"2024-02-03T04:05:06.00000000{k}Z"} for k, (i, p, q) in enumerate(orders)]
    message = {"channel": "level3", "type": "snapshot", "data": [{"symbol": "A/B", "checksum": 1, "bids": side(("b1", "20.5", "0.40")), "asks": side(("a1", "20.75", "1.50"), ("a2", "20.75", "0.25"), ("a3", "21.00", "2"))}]}
    bronze = spark.createDataFrame([(1, 1, 7, 5, "kraken", "spot", json.dumps(message))], schemas.BRONZE)
    orders = exchanges.level3(bronze)
    levels = {(r["side"], float(r["price"])): (float(r["qty"]), r["orders"]) for r in lifecycle.l3_levels(orders, ["symbol"]).collect()}
    assert levels == {("bid", 20.5): (0.4, 1), ("ask", 20.75): (1.75, 2), ("ask", 21.0): (2.0, 1)}
    want = zlib.crc32(b"2075" b"150" b"2075" b"025".replace(b"025", b"25") + b"2100" b"2" + b"205" b"40")
    assert exchanges.level3_crc(orders, ["symbol"]).first()["crc"] == want
