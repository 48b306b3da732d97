"""Results that must not depend on the order in which rows arrive."""

import datetime
import functools

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from quantloom.plans import catalogue


def compared(spark, folder, name, table, columns):
    """The query's rows over one made table, and its SQL's."""
    pq.write_table(pa.table(columns), folder / f"{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    return [r.asDict() for r in entry.queries()[name](spark, str(folder)).collect()], rows


def book(part, bids, asks):
    """Lineitems of a part: quantities at 1, 2, ... ticks from its base."""
    levels = [(part, tick, line, float(q)) for line, side in ((2, bids), (1, asks)) for tick, q in enumerate(side) if q]
    return dict(zip(("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), map(list, zip(*levels, strict=True)), strict=True))


def test_book_index_is_exact(spark, tmp_path):
    """The index is 249/1024, a half of its tenth digit; the sum of squared
    shares is below it."""
    got, _ = compared(spark, tmp_path, "book_features", "lineitem", book(1, [43, 49], [3, 48, 49]))
    assert [r["depth_concentration_by_level"] for r in got] == [0.243164063]


def test_book_prices_are_rounded_as_in_sql(spark, tmp_path):
    """Best prices 1024 and 1027: the microprice is 1024.2279296875."""
    got, want = compared(spark, tmp_path, "book_features", "lineitem", book(25, [389], [None, 4731]))
    assert got == want and [r["microprice"] for r in got] == [1024.227929687]


def test_first_passage_follows_time_within_a_second(spark, tmp_path):
    """A purchase four tenths of a second before an error counts, wherever it
    stands in the file; the SQL leaves their order open."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(0, 0.0, "view"), (3, 300_000.5, "error"), (2, 300_000.1, "purchase")]
    columns = {
        "event_id": [i for i, _, _ in rows],
        "ts": [start + datetime.timedelta(seconds=s) for _, s, _ in rows],
        "user_id": [1] * 3,
        "event_type": [k for _, _, k in rows],
        "value": [10.0] * 3,
        "props": ['{"k": 1}'] * 3,
    }
    got, _ = compared(spark, tmp_path, "competing_first_passage", "events", columns)
    assert [(r["outcome"], r["observed_s"], r["known_s"]) for r in got] == [("censored", 300_000, 300_060)] * 2


def test_promotion_mean_is_exact(spark, tmp_path):
    """Five values of mean 45 whose sum of doubles, in this order, is above 225."""
    values = [79.04, 66.06, 25.67, 38.99, 15.24]
    assert functools.reduce(float.__add__, values) > 225
    n = len(values)
    day = datetime.datetime(2024, 1, 1, 12)
    columns = {"event_id": list(range(n)), "ts": [day] * n, "user_id": [1] * n, "event_type": ["view"] * n, "value": values, "props": ['{"k": 1}'] * n}
    got, _ = compared(spark, tmp_path, "promotion_checks", "events", columns)
    assert [r["share"] for r in got] == [0.0]
