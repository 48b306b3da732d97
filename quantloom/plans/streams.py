"""Watermark, late-data, timer and conversion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import market, windows
from quantloom.operators.bars import ewma
from quantloom.plans.inputs import NS_PER_DAY, NS_PER_HOUR, NS_PER_MINUTE, r6, user_prices
from quantloom.plans.market import venue_quotes


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


def watermark_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as watermark updates of their user: ``props.k`` minutes before the
    event, known some minutes after it."""
    rows = user_prices(spark, sf_dir).withColumn("k", _k())
    known = F.col("t") + (F.col("k") % 13 - 2) * 30 * NS_PER_MINUTE
    return rows.select("entity", "seq", (F.col("t") - F.col("k") * 20 * NS_PER_MINUTE).alias("event_time_ns"), known.alias("as_known_ns"))


def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.watermark_history(watermark_updates(spark, sf_dir), ["entity"])
    return out.select("entity", "seq", "watermark_ns", "fault")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in the order they were known (``props.k`` times 10 minutes late)."""
    rows = user_prices(spark, sf_dir).withColumn("known", F.col("t") + _k() * 10 * NS_PER_MINUTE)
    return rows.select("entity", "t", "seq", F.struct("known", "seq").alias("arrival"), F.col("price").alias("x"))


def late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.late_arrivals(arrivals(spark, sf_dir), ["entity"], 6 * NS_PER_HOUR)
    return out.select("entity", "seq", "frontier_ns", "route")


def ewma_late_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-life average once every event that came before its frontier has
    been put in its place; those compacted away are counted, not used."""
    routed = windows.late_arrivals(arrivals(spark, sf_dir), ["entity"], 6 * NS_PER_HOUR)
    value = ewma(routed.filter("route <> 'correction'"), ["entity"], "x", 6 * NS_PER_HOUR)
    counted = routed.groupBy("entity").agg(F.count_if(F.col("route") == "replayed").alias("replayed"), F.count_if(F.col("route") == "correction").alias("corrections"))
    return value.join(counted, "entity").select("entity", "n", r6("ewma").alias("ewma"), "replayed", "corrections")


def correction_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as corrections of a window of their user near their day; a window
    is final if it ends before the user's 25th day."""
    rows = user_prices(spark, sf_dir).withColumn("k", _k())
    first = rows.groupBy("entity").agg(F.min("day").alias("d0"))
    days = rows.select("entity", "day").distinct().join(first, "entity")
    spans = days.select(
        "entity", (F.col("day") * NS_PER_DAY).alias("window_start_ns"), ((F.col("day") + 1) * NS_PER_DAY).alias("window_end_ns"),
        F.when(F.col("day") < F.col("d0") + 24, "final").otherwise("provisional").alias("finality_state"),
    )
    fixes = rows.filter("event_type = 'error'").select(
        "entity", "seq", ((F.col("day") - F.col("k") % 2) * NS_PER_DAY).alias("window_start_ns"), F.col("t").alias("corrected_t"), F.when(F.col("k") > 80, "degraded").otherwise("healthy").alias("health")
    )
    out = windows.correction_decisions(fixes, spans, ["entity"])
    return out.select("entity", "seq", "accepted", "fault")


def scheduler_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of four seconds from the first event of each user and day on."""
    day = user_prices(spark, sf_dir).groupBy("entity", "day").agg(F.min("t").alias("from_ns"))
    spans = day.filter("day % 10 = 0").withColumn("to_ns", F.col("from_ns") + 4_000_000_000)
    return windows.ticks(spans).select("entity", "day", "sequence", "at_ns", "kind")


def logical_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers set by events, due ``props.k`` hours on; signups cancel theirs
    after 40 hours; the clock stands at the user's last event."""
    rows = user_prices(spark, sf_dir).withColumn("k", _k())
    timers = rows.select("entity", F.col("seq").alias("timer"), (F.col("t") + F.col("k") * NS_PER_HOUR).alias("due_ns"), F.when(F.col("event_type") == "signup", F.col("t") + 40 * NS_PER_HOUR).alias("cancelled_ns"))
    clock = rows.groupBy("entity").agg(F.max("t").alias("now_ns"))
    return windows.fired(timers, clock, ["entity"]).select("entity", "timer", "due_ns", F.col("place").cast("long").alias("place"))


LIMITS = {"ttl_ns": 400 * NS_PER_DAY, "sources": 2, "quality": 900_000, "width_ppm": 20_000}
ASSETS = ("USD", "USDA", "USDB", "USDC", "EUR", "XXX")


def _asset_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = venue_quotes(spark, sf_dir)
    asset = F.element_at(F.array(*map(F.lit, ASSETS)), (F.pmod("venue", F.lit(len(ASSETS))) + 1).cast("int"))
    return rows.withColumns({"quote_asset": asset, "as_of_ns": F.lit(915_148_800_000_000_000)})


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small fixed table: one row per asset that has a conversion."""
    at = 915_148_800_000_000_000
    rows = [("USDA", 0.999, 0.998, 1.001, at - NS_PER_DAY, at, 3, 990_000, "normal"), ("USDB", 1.002, 0.95, 1.05, at - NS_PER_DAY, at, 3, 990_000, "normal"),
            ("USDC", 0.9, 0.9, 0.9, at - NS_PER_DAY, at, 3, 990_000, "liquidity_failure"), ("EUR", 1.1, 1.1, 1.1, at - 500 * NS_PER_DAY, at, 3, 990_000, "normal")]
    return spark.createDataFrame(rows, "quote_asset string, rate double, low double, high double, rate_event_ns long, rate_known_ns long, sources int, rate_quality int, dislocation string")


def converted_fair_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fair price of a part in dollars over quotes in several assets."""
    rows = market.converted(_asset_quotes(spark, sf_dir), F.broadcast(conversions(spark, sf_dir)), "USD", LIMITS)
    good = rows.filter("conversion_reason is null").withColumn("weight", F.floor(F.col("depth_reference") * 1000).cast("long"))
    fair = market.weighted_median(good, ["part"], "price_reference", "weight", "venue")
    count = lambda name: F.count_if(F.col("conversion_reason") == name).alias(name)
    counted = rows.groupBy("part").agg(F.count("*").alias("venues"), *(count(f"conversion_{n}") for n in ("unavailable", "stale", "dislocated", "uncertain")))
    return counted.join(fair, "part", "left").withColumn("fair_price", r6("weighted_median")).drop("weighted_median")


def stable_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' lines of a part as quotes of a stable-value asset near 1."""
    rows = venue_quotes(spark, sf_dir)
    rows = rows.select(
        "part", "venue", "depth", (F.lit(1.0) + (F.pmod(F.col("price"), F.lit(101.0)) - 50) / 5000).alias("price"), (F.pmod("venue", F.lit(11)) != 0).alias("same_asset"),
        F.when(F.col("flag") == "R", "degraded").otherwise("healthy").alias("source_health"), F.col("event_ns"), F.col("event_ns").alias("as_known_ns"), F.lit(915_148_800_000_000_000).alias("as_of_ns"),
        F.lit(2500 * NS_PER_DAY).alias("ttl_ns"), (1_000_000 - F.pmod("venue", F.lit(7)) * 30_000).alias("quality"), F.lit(850_000).alias("minimum_quality"), F.lit(1).alias("freshness"), F.lit(1).alias("minimum_freshness"),
        (F.pmod(F.col("venue") + F.col("part"), F.lit(5)) == 0).alias("reserve"), (F.pmod(F.col("venue") + F.col("part"), F.lit(3)) == 0).alias("liquidity"), (F.col("depth") > 25).alias("persistent"),
    )
    out = market.stable_reference(rows, ["part"], 1.0, 8_000, 4_000, 3)
    return out.select("part", "venues", "excluded", "included", "dislocation", *(r6(c).alias(c) for c in ("rate", "low", "high")))


QUERIES = {
    f.__name__: f
    for f in (watermark_advance, late_arrivals, ewma_late_replay, correction_decisions, scheduler_ticks, logical_timers, converted_fair_price, stable_reference)
}

_E = "e AS (SELECT user_id AS entity, epoch_us(ts) * 1000 AS t, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, event_id AS seq, value AS price, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_A = f"""a AS (SELECT entity, t, seq, price AS x, max(t) OVER (PARTITION BY entity ORDER BY t + k * {10 * NS_PER_MINUTE}, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM e),
r AS (SELECT *, most - {6 * NS_PER_HOUR} AS frontier_ns, CASE WHEN most IS NULL OR t >= most THEN 'in_order' WHEN t > most - {6 * NS_PER_HOUR} THEN 'replayed' ELSE 'correction' END AS route FROM a)"""
_Q = "q AS (SELECT l_partkey AS part, l_suppkey AS venue, CAST(max(CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT)) AS DOUBLE) AS price, CAST(sum(l_quantity) AS BIGINT) AS depth, max(epoch_us(l_shipdate) * 1000) AS ev, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"


def _median_sql(source: str, price: str, weight: str) -> str:
    return f"""c AS (SELECT *, 2 * sum({weight}) OVER w AS cum, sum({weight}) OVER (PARTITION BY part) AS tot, coalesce(lead({price}) OVER (PARTITION BY part ORDER BY {price}, venue), {price}) AS nx FROM {source} WINDOW w AS (PARTITION BY part ORDER BY {price}, venue ROWS UNBOUNDED PRECEDING)),
h AS (SELECT part, CASE WHEN cum = tot THEN ({price} + nx) / 2 ELSE {price} END AS fp, row_number() OVER (PARTITION BY part ORDER BY cum, {price}, venue) AS rk FROM c WHERE cum >= tot)"""


ORACLE_SQL = {
    "watermark_advance": f"""WITH RECURSIVE {_E}, u AS (SELECT entity, seq, t - k * {20 * NS_PER_MINUTE} AS w, t + (k % 13 - 2) * {30 * NS_PER_MINUTE} AS kn, row_number() OVER (PARTITION BY entity ORDER BY seq) AS rn FROM e),
f AS (SELECT entity, rn, seq, CASE WHEN kn >= w THEN w END AS mark, CASE WHEN kn >= w THEN kn END AS known, CASE WHEN kn < w THEN 'invalid_watermark' END AS fault FROM u WHERE rn = 1
  UNION ALL SELECT u.entity, u.rn, u.seq, CASE WHEN kn >= w AND (mark IS NULL OR (w >= mark AND kn >= known)) THEN w ELSE mark END, CASE WHEN kn >= w AND (mark IS NULL OR (w >= mark AND kn >= known)) THEN kn ELSE known END,
  CASE WHEN kn < w THEN 'invalid_watermark' WHEN w < mark THEN 'regression' WHEN kn < known THEN 'invalid_watermark' END FROM f JOIN u ON u.entity = f.entity AND u.rn = f.rn + 1)
SELECT entity, seq, mark AS watermark_ns, fault FROM f""",
    "late_arrivals": f"WITH {_E}, {_A} SELECT entity, seq, frontier_ns, route FROM r",
    "ewma_late_replay": f"""WITH {_E}, {_A}, w AS (SELECT *, lag(t) OVER o AS before, max(t) OVER (PARTITION BY entity) AS last FROM r WHERE route <> 'correction' WINDOW o AS (PARTITION BY entity ORDER BY t, seq)),
v AS (SELECT entity, count(*) AS n, sum(x * (CASE WHEN before IS NULL THEN 1 ELSE 1 - power(2, -(t - before) / {float(6 * NS_PER_HOUR)!r}) END) * power(2, -(last - t) / {float(6 * NS_PER_HOUR)!r})) AS s FROM w GROUP BY entity),
c AS (SELECT entity, count(*) FILTER (route = 'replayed') AS replayed, count(*) FILTER (route = 'correction') AS corrections FROM r GROUP BY entity)
SELECT entity, n, round(s, 6) + 0.0 AS ewma, replayed, corrections FROM v JOIN c USING (entity)""",
    "correction_decisions": f"""WITH {_E}, w AS (SELECT DISTINCT entity, day, min(day) OVER (PARTITION BY entity) AS d0 FROM e), x AS (SELECT entity, seq, day, day - k % 2 AS wd, k FROM e WHERE event_type = 'error'),
y AS (SELECT x.entity, x.seq, CASE WHEN w.day IS NULL THEN 'unknown_window' WHEN x.day <> x.wd THEN 'invalid_correction_time' WHEN k > 80 OR w.day >= d0 + 24 THEN 'invalid_correction_state' END AS fault FROM x LEFT JOIN w ON w.entity = x.entity AND w.day = x.wd)
SELECT entity, seq, fault IS NULL AS accepted, fault FROM y""",
    "scheduler_ticks": f"""WITH {_E}, s AS (SELECT entity, day, min(t) AS f, min(t) + 4000000000 AS o FROM e WHERE day % 10 = 0 GROUP BY entity, day),
k AS (SELECT entity, day, unnest(range(f // 100000000 + 1, o // 100000000 + 1)) * 100000000 AS at_ns, 0 AS r, 'internal' AS kind FROM s UNION ALL SELECT entity, day, unnest(range(f // 1000000000 + 1, o // 1000000000 + 1)) * 1000000000, 1, 'published' FROM s)
SELECT entity, day, row_number() OVER (PARTITION BY entity, day ORDER BY at_ns, r) AS sequence, at_ns, kind FROM k""",
    "logical_timers": f"""WITH {_E}, c AS (SELECT entity, max(t) AS now FROM e GROUP BY entity), d AS (SELECT entity, seq AS timer, t + k * {NS_PER_HOUR} AS due_ns FROM e JOIN c USING (entity) WHERE t + k * {NS_PER_HOUR} <= now AND NOT (event_type = 'signup' AND k > 40))
SELECT entity, timer, due_ns, row_number() OVER (PARTITION BY entity ORDER BY due_ns, timer) AS place FROM d""",
    "converted_fair_price": f"""WITH {_Q}, a AS (SELECT *, ['USD', 'USDA', 'USDB', 'USDC', 'EUR', 'XXX'][venue % 6 + 1] AS qa FROM q),
v AS (SELECT *, CASE qa WHEN 'USD' THEN 1.0::DOUBLE WHEN 'USDA' THEN 0.999::DOUBLE END AS rate FROM a),
g AS (SELECT part, venue, price * rate AS pr, CAST(floor(depth * rate * 1000) AS BIGINT) AS wt FROM v WHERE rate IS NOT NULL), {_median_sql("g", "pr", "wt")},
n AS (SELECT part, count(*) AS venues, count(*) FILTER (qa = 'XXX') AS conversion_unavailable, count(*) FILTER (qa = 'EUR') AS conversion_stale, count(*) FILTER (qa = 'USDC') AS conversion_dislocated, count(*) FILTER (qa = 'USDB') AS conversion_uncertain FROM a GROUP BY part)
SELECT n.*, round(fp, 6) + 0.0 AS fair_price FROM n LEFT JOIN h ON h.part = n.part AND rk = 1""",
    "stable_reference": f"""WITH {_Q}, s AS (SELECT part, venue, depth, 1.0::DOUBLE + (price % 101 - 50) / 5000 AS p, venue % 11 = 0 OR flag = 'R' OR ev > 915148800000000000 OR 915148800000000000 - ev > {2500 * NS_PER_DAY} OR 1000000 - venue % 7 * 30000 < 850000 AS bad,
  (venue + part) % 5 = 0 AS rs, (venue + part) % 3 = 0 AS lq, depth > 25 AS ps FROM q),
m AS (SELECT part, median(p) AS med FROM s WHERE NOT bad GROUP BY part), g AS (SELECT s.* FROM s JOIN m USING (part) WHERE NOT bad AND abs(p - med) * 1000000 <= 8000 * med), {_median_sql("g", "p", "depth")},
d AS (SELECT part, count(*) AS inc, min(p) AS lo, max(p) AS hi, count(*) FILTER (rs) AS r, count(*) FILTER (lq) AS l, count(*) FILTER (abs(p - 1.0::DOUBLE) * 1000000 > 4000) AS dv, count(*) FILTER (abs(p - 1.0::DOUBLE) * 1000000 > 4000 AND ps) AS pv FROM g GROUP BY part),
n AS (SELECT part, count(*) AS venues, count(*) FILTER (bad) AS excluded FROM s GROUP BY part)
SELECT n.part, venues, excluded, coalesce(inc, 0) AS included, CASE WHEN coalesce(inc, 0) < 3 THEN 'insufficient_evidence' WHEN r >= 3 THEN 'reserve_impairment' WHEN l >= 3 THEN 'liquidity_failure' WHEN dv = 0 THEN 'normal' WHEN dv = 1 THEN 'venue_local' WHEN pv >= 3 THEN 'sustained' ELSE 'transient' END AS dislocation,
  round(CASE WHEN inc >= 3 THEN fp END, 6) + 0.0 AS rate, round(CASE WHEN inc >= 3 THEN lo END, 6) + 0.0 AS low, round(CASE WHEN inc >= 3 THEN hi END, 6) + 0.0 AS high FROM n LEFT JOIN d USING (part) LEFT JOIN h ON h.part = n.part AND rk = 1""",
}
