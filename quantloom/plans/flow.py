"""Trade-flow, bar and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import bars, flow, windows
from quantloom.operators.joins import asof_backward
from quantloom.plans.inputs import NS_PER_DAY, NS_PER_HOUR, nanos, r6, table, trades, user_prices

MONEY, SIZE = "decimal(18,2)", "decimal(12,2)"


def exact_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades(spark, sf_dir)
    return rows.withColumns({"price": F.col("price").cast(MONEY), "qty": F.col("qty").cast(SIZE)})


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades of a user: the side is set by the event type."""
    rows = user_prices(spark, sf_dir)
    side = F.when(F.col("event_type").isin("click", "purchase"), "buy").otherwise("sell")
    return rows.select("entity", "t", "seq", side.alias("side"), F.col("price").alias("notional"))


def trade_flow_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = flow.side_totals(exact_trades(spark, sf_dir), ["instrument"])
    return total.select(
        "instrument",
        "aggressive_buy_count",
        "aggressive_sell_count",
        *(F.col(f"aggressive_{s}_{k}").cast("double").alias(f"aggressive_{s}_{k}") for k in ("quantity", "notional") for s in ("buy", "sell")),
        *(r6(flow.imbalance(k)).alias(f"signed_trade_{k}_imbalance") for k in ("count", "quantity", "notional")),
    )


def signed_volume_at_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flow.volume_at_price(exact_trades(spark, sf_dir), ["part"])
    return out.select("part", F.col("price").cast("double").alias("price"), F.col("signed_volume_at_price").cast("double").alias("signed_volume_at_price"))


def trade_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flow.large_trade_clusters(event_trades(spark, sf_dir), ["entity"], 50.0, 12 * NS_PER_HOUR)
    rate = F.col("large_trade_cluster_count") / F.lit(30 * 86_400.0)  # clusters of a window of 30 days
    return out.select("entity", "large_trade_cluster_count", r6(rate, 12).alias("large_trade_cluster_activity_rate"), F.col("clustered_large_trade_count").cast("long").alias("clustered_large_trade_count"), r6("clustered_large_trade_notional").alias("clustered_large_trade_notional"))


def sweep_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_trades(spark, sf_dir)
    sweep = flow.sweep_direction(rows, ["entity"], 24 * NS_PER_HOUR, 2).select("entity", "episodes", r6("trade_print_sweep_direction").alias("trade_print_sweep_direction"))
    return flow.longest_side_run(rows, ["entity"]).join(sweep, "entity", "left")


def interarrival_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flow.interarrival_cv(event_trades(spark, sf_dir), ["entity"])
    return out.select("entity", "n", r6("trade_interarrival_coefficient_of_variation").alias("trade_interarrival_coefficient_of_variation"), r6(F.col("n") / 60.0).alias("trade_intensity_per_second"))


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote stream per user: bid, sizes and ask from value and ``props.k``."""
    rows = user_prices(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("double")
    return rows.select("entity", "t", "seq", F.floor("price").cast("double").alias("bid"), (1 + k).alias("bid_qty"), (F.floor("price") + 1 + F.pmod(k, F.lit(3.0))).alias("ask"), (100 - k).alias("ask_qty"))


def top_of_book_ofi(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = event_quotes(spark, sf_dir)
    out = flow.order_flow_imbalance(quotes, ["entity"])
    for side in ("bid", "ask"):
        stale = flow.last_change(quotes, ["entity"], [side, f"{side}_qty"])
        out = out.join(stale.select("entity", (F.col("last_t") - F.col("changed_t")).alias(f"{side}_stale_side_duration_ns")), "entity")
    return out.select("entity", r6("top_of_book_ofi").alias("top_of_book_ofi"), "bid_stale_side_duration_ns", "ask_stale_side_duration_ns")


def trade_shock_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as shocks against the mids of all other events of the user."""
    rows = user_prices(spark, sf_dir)
    shocks = rows.filter("event_type = 'purchase'").select("entity", "t", "seq", "price", F.lit(1.0).alias("sign"))
    mids = rows.filter("event_type <> 'purchase'").select("entity", "t", F.col("price").alias("mid"))
    out = flow.shock_response(shocks, mids, "entity", 6 * NS_PER_HOUR, 2 * NS_PER_DAY, 5 * NS_PER_DAY)
    names = ["trade_shock_midprice_impact", "trade_effective_spread", "trade_realized_spread", "trade_adverse_selection_proxy"]
    return out.select("seq", "mid0", "mid1", *(r6(n).alias(n) for n in names))


def asof_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_prices(spark, sf_dir)
    ask = rows.filter("event_type = 'error'").select("entity", "t", "seq")
    ref = rows.filter("event_type = 'purchase'").select("entity", "t", F.col("price").alias("value"))
    return asof_backward(ask, ref, "entity").select("entity", "seq", "value_t", "value")


def sliding_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_prices(spark, sf_dir).select("t", "price", "event_type")
    out = windows.sliding(rows, 6 * NS_PER_HOUR, 2 * NS_PER_HOUR)
    return out.groupBy("event_type", "window_start_ns", "window_end_ns").agg(F.count("*").alias("n"), r6(F.sum("price")).alias("total"))


def tumbling_and_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hour windows and sessions of a UTC day that starts at 08:00."""
    rows = user_prices(spark, sf_dir)
    t = F.col("t")
    hour, session = windows.tumbling_start(t, NS_PER_HOUR), windows.tumbling_start(t, NS_PER_DAY, 8 * NS_PER_HOUR)
    return rows.groupBy(hour.alias("hour_start_ns"), session.alias("session_start_ns")).agg(F.count("*").alias("n"))


def event_count_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_prices(spark, sf_dir).withColumn("value", F.col("price"))
    out = bars.event_count_bars(rows, ["entity"], 10, 5)
    return out.select("entity", "bar", "first_t", "close_t", r6("total").alias("total"))


def notional_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_prices(spark, sf_dir).withColumn("amount", F.col("price"))
    out = bars.threshold_bars(rows, "entity", 500.0)
    return out.select("entity", "bar", "n", r6("total").alias("total"), "close_t")


def rolling_hour_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in the hour that ends with the event."""
    rows = user_prices(spark, sf_dir).select("event_type", "seq", F.floor(F.col("t") / 1_000_000_000).cast("long").alias("sec"))
    return windows.rolling_count(rows, ["event_type"], "sec", 3600).select("event_type", "seq", F.col("rolling").alias("last_hour"))


def window_finality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of all events; the sources are the event types, with the
    watermark a source had on its 25th day and bad health for ``error`` after
    the 20th window."""
    rows = user_prices(spark, sf_dir)
    first = rows.agg(F.min("day").alias("d0"))
    spans = rows.select(F.lit("all").alias("scope"), (F.col("day") * NS_PER_DAY).alias("window_start_ns"), ((F.col("day") + 1) * NS_PER_DAY).alias("window_end_ns")).distinct()
    marks = rows.crossJoin(F.broadcast(first)).filter(F.col("day") < F.col("d0") + 25)
    marks = marks.groupBy(F.lit("all").alias("scope"), F.col("event_type").alias("source")).agg(F.max("t").alias("watermark_ns"), (F.max("t") + 1_000_000).alias("as_known_ns"))
    marks = marks.withColumns({"required": F.col("source") != "view", "health": F.lit("healthy")})
    out = windows.finality(spans, marks, ["scope"], 5_000_000_000)
    frontier = windows.effective_frontier(marks, ["scope"], 5_000_000_000)
    return out.join(frontier, "scope").drop("scope")


def window_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's daily values as they became known (``props.k`` minutes later),
    final from the third emission on."""
    rows = user_prices(spark, sf_dir)
    lag_ns = F.get_json_object("props", "$.k").cast("long") * 60_000_000_000
    order = Window.partitionBy("entity", "day").orderBy("as_known_ns", "seq")
    emitted = rows.select("entity", "day", "seq", (F.col("t") + lag_ns).alias("as_known_ns"), F.floor(F.col("price") / 100).cast("long").alias("value"))
    emitted = emitted.withColumn("final", F.row_number().over(order) >= 3)
    out = windows.revisions(emitted, ["entity", "day"])
    return out.select("entity", "day", "seq", F.col("revision").cast("long").alias("revision"), "finality_state", "value")


QUERIES = {
    f.__name__: f
    for f in (
        trade_flow_imbalance,
        signed_volume_at_price,
        trade_clusters,
        sweep_episodes,
        interarrival_cv,
        top_of_book_ofi,
        trade_shock_response,
        asof_quotes,
        sliding_window_counts,
        tumbling_and_session,
        event_count_bars,
        notional_bars,
        rolling_hour_counters,
        window_finality,
        window_revisions,
    )
}

_T = "t AS (SELECT l_suppkey AS instrument, l_partkey AS part, CAST(floor(l_extendedprice / l_quantity * 100) / 100 AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(12,2)) AS qty, l_linestatus = 'F' AS buy FROM lineitem)"
_E = "e AS (SELECT user_id AS entity, epoch_us(ts) * 1000 AS t, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, event_id AS seq, value AS price, event_type, props, event_type IN ('click', 'purchase') AS buy FROM events)"
_HOUR = NS_PER_HOUR
ORACLE_SQL = {
    "trade_flow_imbalance": f"""WITH {_T}, a AS (
  SELECT instrument, count(*) FILTER (buy) AS bc, count(*) FILTER (NOT buy) AS sc, CAST(coalesce(sum(qty) FILTER (buy), 0) AS DOUBLE) AS bq, CAST(coalesce(sum(qty) FILTER (NOT buy), 0) AS DOUBLE) AS sq,
    CAST(coalesce(sum(price * qty) FILTER (buy), 0) AS DOUBLE) AS bn, CAST(coalesce(sum(price * qty) FILTER (NOT buy), 0) AS DOUBLE) AS sn FROM t GROUP BY instrument)
SELECT instrument, bc AS aggressive_buy_count, sc AS aggressive_sell_count, bq AS aggressive_buy_quantity, sq AS aggressive_sell_quantity, bn AS aggressive_buy_notional, sn AS aggressive_sell_notional,
  round((bc - sc) / nullif(bc + sc, 0), 6) + 0.0 AS signed_trade_count_imbalance, round((bq - sq) / nullif(bq + sq, 0), 6) + 0.0 AS signed_trade_quantity_imbalance,
  round((bn - sn) / nullif(bn + sn, 0), 6) + 0.0 AS signed_trade_notional_imbalance FROM a""",
    "signed_volume_at_price": f"WITH {_T} SELECT part, CAST(price AS DOUBLE) AS price, CAST(sum(CASE WHEN buy THEN qty ELSE -qty END) AS DOUBLE) AS signed_volume_at_price FROM t GROUP BY part, t.price",
    "trade_clusters": f"""WITH {_E}, l AS (
  SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > {12 * _HOUR}, true) THEN 1 ELSE 0 END AS s FROM e WHERE price >= 50 WINDOW w AS (PARTITION BY entity ORDER BY t, seq)
), i AS (SELECT *, sum(s) OVER (PARTITION BY entity ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS island FROM l),
c AS (SELECT entity, island, count(*) AS n, sum(price) AS v FROM i GROUP BY entity, island HAVING count(*) >= 2)
SELECT entity, count(*) AS large_trade_cluster_count, round(count(*) / {30 * 86_400.0!r}::DOUBLE, 12) + 0.0 AS large_trade_cluster_activity_rate, CAST(sum(n) AS BIGINT) AS clustered_large_trade_count, round(sum(v), 6) + 0.0 AS clustered_large_trade_notional FROM c GROUP BY entity""",
    "sweep_episodes": f"""WITH {_E}, l AS (
  SELECT *, CASE WHEN coalesce(lag(buy) OVER w <> buy, true) THEN 1 ELSE 0 END AS r, CASE WHEN coalesce(lag(buy) OVER w <> buy OR t - lag(t) OVER w > {24 * _HOUR}, true) THEN 1 ELSE 0 END AS s
  FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, seq)
), i AS (SELECT *, sum(s) OVER w AS ep, sum(r) OVER w AS rn FROM l WINDOW w AS (PARTITION BY entity ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT entity, ep, buy, count(*) AS n FROM i GROUP BY ALL HAVING count(*) >= 2),
q AS (SELECT entity, count(*) AS episodes, sum(CASE WHEN buy THEN 1 ELSE -1 END) / count(*) AS d FROM c GROUP BY entity),
m AS (SELECT entity, max(n) AS longest FROM (SELECT entity, rn, count(*) AS n FROM i GROUP BY ALL) GROUP BY entity)
SELECT m.entity, longest AS longest_side_run, episodes, round(d, 6) + 0.0 AS trade_print_sweep_direction FROM m LEFT JOIN q USING (entity)""",
    "interarrival_cv": f"""WITH {_E}, g AS (SELECT entity, CAST(t - lag(t) OVER (PARTITION BY entity ORDER BY t, seq) AS DOUBLE) AS dt FROM e)
SELECT entity, count(*) AS n, round(CASE WHEN count(*) >= 3 AND avg(dt) > 0 THEN stddev_pop(dt) / avg(dt) END, 6) + 0.0 AS trade_interarrival_coefficient_of_variation, round(count(*) / 60.0, 6) + 0.0 AS trade_intensity_per_second FROM g GROUP BY entity""",
    "top_of_book_ofi": f"""WITH {_E}, k AS (SELECT entity, t, seq, floor(price) AS b, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM e),
q AS (SELECT entity, t, seq, b, 1 + k AS bq, b + 1 + k % 3 AS a, 100 - k AS aq FROM k),
l AS (SELECT *, lag(b) OVER w AS b0, lag(bq) OVER w AS bq0, lag(a) OVER w AS a0, lag(aq) OVER w AS aq0 FROM q WINDOW w AS (PARTITION BY entity ORDER BY t, seq)),
o AS (SELECT entity, sum((CASE WHEN b >= b0 THEN bq ELSE 0 END - CASE WHEN b <= b0 THEN bq0 ELSE 0 END) - (CASE WHEN a <= a0 THEN aq ELSE 0 END - CASE WHEN a >= a0 THEN aq0 ELSE 0 END)) AS ofi FROM l WHERE b0 IS NOT NULL GROUP BY entity),
s AS (SELECT entity, max(t) - max(CASE WHEN b IS DISTINCT FROM b0 OR bq IS DISTINCT FROM bq0 THEN t END) AS stale,
  max(t) - max(CASE WHEN a IS DISTINCT FROM a0 OR aq IS DISTINCT FROM aq0 THEN t END) AS stale_a FROM l GROUP BY entity)
SELECT entity, round(ofi, 6) + 0.0 AS top_of_book_ofi, stale AS bid_stale_side_duration_ns, stale_a AS ask_stale_side_duration_ns FROM o JOIN s USING (entity)""",
    "trade_shock_response": f"""WITH {_E}, m AS (SELECT entity, t, max(price) AS hi, min(price) AS lo FROM e WHERE event_type <> 'purchase' AND price > 0 GROUP BY entity, t),
s AS (SELECT entity, t, seq, price FROM e WHERE event_type = 'purchase'),
x AS (SELECT s.*, CASE WHEN s.t - m.t <= {5 * NS_PER_DAY} THEN m.hi END AS mid0 FROM s ASOF LEFT JOIN m ON s.entity = m.entity AND s.t >= m.t),
y AS (SELECT x.*, CASE WHEN n.t - (x.t + {6 * _HOUR}) <= {2 * NS_PER_DAY} THEN n.lo END AS mid1 FROM x ASOF LEFT JOIN m n ON x.entity = n.entity AND x.t + {6 * _HOUR} <= n.t)
SELECT seq, mid0, mid1, round((mid1 - mid0) / mid0, 6) + 0.0 AS trade_shock_midprice_impact, round(2 * (price - mid0) / mid0, 6) + 0.0 AS trade_effective_spread,
  round(2 * (price - mid1) / mid0, 6) + 0.0 AS trade_realized_spread, round(2 * (price - mid0) / mid0 - 2 * (price - mid1) / mid0, 6) + 0.0 AS trade_adverse_selection_proxy FROM y""",
    "asof_quotes": f"""WITH {_E} SELECT a.entity, a.seq, b.t AS value_t, b.price AS value
FROM (SELECT * FROM e WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') b ON a.entity = b.entity AND a.t >= b.t""",
    "sliding_window_counts": f"""WITH {_E}, w AS (SELECT event_type, price, t, t - t % {2 * _HOUR} - k * {2 * _HOUR} AS s FROM e, (SELECT unnest([0, 1, 2]) AS k))
SELECT event_type, s AS window_start_ns, s + {6 * _HOUR} AS window_end_ns, count(*) AS n, round(sum(price), 6) + 0.0 AS total FROM w WHERE s >= 0 AND t < s + {6 * _HOUR} GROUP BY event_type, s""",
    "tumbling_and_session": f"""WITH {_E} SELECT t - t % {_HOUR} AS hour_start_ns, t - (t - {8 * _HOUR}) % {NS_PER_DAY} AS session_start_ns, count(*) AS n FROM e GROUP BY ALL""",
    "event_count_bars": f"""WITH {_E}, x AS (SELECT entity, t, seq, row_number() OVER w AS rn, min(t) OVER f AS first_t, sum(price) OVER f AS total FROM e
  WINDOW w AS (PARTITION BY entity ORDER BY t, seq), f AS (PARTITION BY entity ORDER BY t, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT entity, (rn - 10) // 5 AS bar, first_t, t AS close_t, round(total, 6) + 0.0 AS total FROM x WHERE rn >= 10 AND (rn - 10) % 5 = 0""",
    "notional_bars": f"""WITH RECURSIVE {_E}, o AS (SELECT entity, t, price, row_number() OVER (PARTITION BY entity ORDER BY t, seq) AS rn FROM e),
f AS (SELECT entity, rn, t, 0::BIGINT AS bar, 1::BIGINT AS n, price AS total FROM o WHERE rn = 1
  UNION ALL SELECT o.entity, o.rn, o.t, CASE WHEN f.total >= 500 THEN f.bar + 1 ELSE f.bar END, CASE WHEN f.total >= 500 THEN 1 ELSE f.n + 1 END, CASE WHEN f.total >= 500 THEN o.price ELSE f.total + o.price END
  FROM f JOIN o ON o.entity = f.entity AND o.rn = f.rn + 1)
SELECT entity, bar, n, round(total, 6) + 0.0 AS total, t AS close_t FROM f WHERE total >= 500""",
    "rolling_hour_counters": f"""WITH {_E}, s AS (SELECT event_type, seq, CAST(floor(t / 1000000000) AS BIGINT) AS sec FROM e)
SELECT event_type, seq, count(*) OVER (PARTITION BY event_type ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS last_hour FROM s""",
    "window_finality": f"""WITH {_E}, m AS (SELECT event_type AS source, max(t) AS wm FROM e WHERE day < (SELECT min(day) FROM e) + 25 AND event_type <> 'view' GROUP BY event_type),
w AS (SELECT DISTINCT day * {NS_PER_DAY} AS s, (day + 1) * {NS_PER_DAY} AS x FROM e)
SELECT s AS window_start_ns, x AS window_end_ns, CASE WHEN bool_and(wm >= x + 5000000000) THEN 'final' ELSE 'provisional' END AS finality_state, min(wm) AS watermark_ns,
  max(wm + 1000000) AS finality_as_known_at_ns, count(*) AS required_sources, count(*) FILTER (wm >= x + 5000000000) AS sources_past, min(wm) - 5000000000 AS frontier_ns FROM w, m GROUP BY s, x""",
    "window_revisions": f"""WITH {_E}, a AS (SELECT entity, day, seq, t + CAST(json_extract_string(props, '$.k') AS BIGINT) * 60000000000 AS ak, CAST(floor(price / 100) AS BIGINT) AS value FROM e),
b AS (SELECT *, row_number() OVER w AS rn, lag(value) OVER w AS was FROM a WINDOW w AS (PARTITION BY entity, day ORDER BY ak, seq)),
c AS (SELECT *, rn >= 3 AS fin, row_number() OVER w AS rev, coalesce(bool_or(rn >= 3) OVER (PARTITION BY entity, day ORDER BY ak, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before
  FROM b WHERE rn = 1 OR value <> was WINDOW w AS (PARTITION BY entity, day ORDER BY ak, seq))
SELECT entity, day, seq, rev AS revision, CASE WHEN before THEN 'corrected' WHEN fin THEN 'final' WHEN rev > 1 THEN 'revised' ELSE 'provisional' END AS finality_state, value FROM c""",
}
