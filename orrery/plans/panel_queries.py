"""Queries on panels: supplier by month by part type from line items, orders by customer, events by user and day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import relational as rl
from orrery.operators import series
from orrery.operators import timewin as tw
from orrery.operators import transform as tf
from orrery.plans.registry import query, r6, rounded, table

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FIRST, LAST = 1995 * 12, 2001 * 12 + 10


def panel(spark, d: str, *keys: str) -> DataFrame:
    """Sales by supplier, month, part type (or by other keys of these)."""
    li = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("id"), tw.month_number("l_shipdate").alias("m"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("cat"))
    return li.join(part, "l_partkey").groupBy(*(keys or ("id", "m", "cat"))).agg(F.sum("v").alias("v"))


P = """f AS (SELECT l_suppkey AS id, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m, p_type AS cat, sum(l_extendedprice * (1 - l_discount)) AS v
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"""
WIDE = ", ".join(f"sum(CASE WHEN cat = '{t}' THEN v ELSE 0 END) AS {t}" for t in TYPES)
CLR = " + ".join(f"ln(greatest({t} / total, 1e-4))" for t in TYPES)


@query(f"""WITH {P}, w AS (SELECT id, m // 12 AS year, {WIDE}, sum(v) AS total FROM f GROUP BY 1, 2)
SELECT id, year, {', '.join(f'round({t} / total, 6) AS share_{t}' for t in TYPES)},
{', '.join(f'round(ln(greatest({t} / total, 1e-4)) - ({CLR}) / 6, 6) AS clr_{t}' for t in TYPES)} FROM w""")
def spending_shares_clr(spark, d):
    w = rl.wide(panel(spark, d).withColumn("year", F.floor(F.col("m") / 12)), ["id", "year"], "cat", TYPES, F.sum("v"))
    w = w.withColumn("total", sum((F.col(t) for t in TYPES), F.lit(0.0)))
    s = rl.shares(w, TYPES, "total")
    clr = tf.centred_log_ratio(TYPES)
    return s.select("id", "year", *(r6(t).alias(f"share_{t}") for t in TYPES), *(r6(c).alias(f"clr_{t}") for t, c in zip(TYPES, clr, strict=True)))


@query(f"""WITH {P}, w AS (SELECT id, m, {WIDE} FROM f GROUP BY 1, 2) SELECT id, m, {', '.join(f'round({t}, 4) AS {t}' for t in TYPES)} FROM w""")
def monthly_panel(spark, d):
    return rounded(rl.wide(panel(spark, d), ["id", "m"], "cat", TYPES, F.sum("v")), *TYPES, digits=4)


@query("""WITH p AS (SELECT s_nationkey AS region, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m, avg(l_extendedprice / l_quantity) AS price FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT region, m, round(price / median(price) OVER (PARTITION BY m), 6) AS ratio FROM p""")
def price_ratio(spark, d):
    """Price of a region over the median of all regions in the month."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("region"))
    p = table(spark, d, "lineitem").select("l_suppkey", tw.month_number("l_shipdate").alias("m"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p")).join(s, "l_suppkey").groupBy("region", "m").agg(F.avg("p").alias("price"))
    return p.select("region", "m", r6(F.col("price") / F.median("price").over(Window.partitionBy("m"))).alias("ratio"))


ROLL = f"""WITH {P}, e AS (SELECT unnest(range({FIRST + 11}, {LAST + 1})) AS w), k AS (SELECT w FROM e WHERE w % 3 = 2),
r AS (SELECT id, w, {WIDE}, sum(v) AS total, count(DISTINCT m) AS months FROM f JOIN k ON m BETWEEN w - 11 AND w GROUP BY 1, 2)"""


@query(ROLL + f""" SELECT id, CAST(w // 12 AS VARCHAR) || 'Q' || CAST(w % 12 // 3 + 1 AS VARCHAR) AS period, months, months = 12 AS complete,
{', '.join(f'round({t} / total, 6) AS {t}' for t in TYPES)}, round(total / 12, 6) AS level, round(ln(total / median(total) OVER (PARTITION BY w)), 6) AS rel FROM r""")
def rolling_year(spark, d):
    """Twelve-month windows at quarter ends: shares of sums, mean level, level relative to the window's median."""
    p = tw.in_windows(panel(spark, d), "m", tw.window_ends(FIRST, LAST))
    w = p.groupBy("id", "window").agg(*[F.sum(F.when(F.col("cat") == t, F.col("v")).otherwise(0.0)).alias(t) for t in TYPES], F.sum("v").alias("total"), F.countDistinct("m").alias("months"))
    w = tw.with_relative_level(w, "total", ["window"])
    return rl.shares(w, TYPES, "total").select("id", tw.quarter_key(F.col("window")).alias("period"), "months", (F.col("months") == 12).alias("complete"), *(r6(t).alias(t) for t in TYPES), F.round(F.col("total") / 12, 6).alias("level"), r6("rel").alias("rel"))


@query(f"""WITH {P}, w AS (SELECT id, m, {WIDE}, sum(v) AS total FROM f GROUP BY 1, 2)
SELECT id, CAST(m // 12 AS VARCHAR) || 'Q' || CAST(m % 12 // 3 + 1 AS VARCHAR) AS period, count(*) AS months, {', '.join(f'round(avg({t} / total), 6) AS {t}' for t in TYPES)} FROM w GROUP BY 1, 2""")
def quarter_shares(spark, d):
    w = rl.wide(panel(spark, d), ["id", "m"], "cat", TYPES, F.sum("v")).withColumn("total", sum((F.col(t) for t in TYPES), F.lit(0.0)))
    s = rl.shares(w, TYPES, "total")
    return s.groupBy("id", tw.quarter_key(F.col("m")).alias("period")).agg(F.count(F.lit(1)).alias("months"), *[r6(F.avg(t)).alias(t) for t in TYPES])


YTD = """q AS (SELECT c_mktsegment AS seg, year(o_orderdate) AS y, quarter(o_orderdate) AS q, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
h AS (SELECT seg, y, q, sum(v) OVER (PARTITION BY seg, y ORDER BY q) / (3 * q) AS ytd FROM q)"""


def ytd(spark, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    q = table(spark, d, "orders").join(c, "o_custkey").groupBy("seg", F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q")).agg(F.sum("o_totalprice").alias("v"))
    return q.select("seg", "y", "q", (F.sum("v").over(Window.partitionBy("seg", "y").orderBy("q")) / (3 * F.col("q"))).alias("ytd"))


TRAIL = """t AS (SELECT a.*, CASE WHEN a.q = 4 THEN a.ytd ELSE coalesce((3 * a.q * a.ytd + 12 * f.ytd - 3 * a.q * s.ytd) / 12, a.ytd) END AS ttm, a.q <> 4 AND (f.ytd IS NULL OR s.ytd IS NULL) AS fallback
FROM h a LEFT JOIN h s ON s.seg = a.seg AND s.y = a.y - 1 AND s.q = a.q LEFT JOIN h f ON f.seg = a.seg AND f.y = a.y - 1 AND f.q = 4)"""


@query(f"WITH {YTD}, {TRAIL} SELECT seg, y, q, round(ttm, 4) AS ttm, fallback FROM t")
def trailing_year_from_ytd(spark, d):
    return tw.trailing_year(ytd(spark, d), ["seg"], "y", "q", "ytd").select("seg", "y", "q", F.round("trailing", 4).alias("ttm"), "fallback")


@query(f"""WITH {YTD}, {TRAIL}, x AS (SELECT *, greatest(ttm, 0) AS v FROM t)
SELECT y, q, seg, round(v / sum(v) OVER (PARTITION BY y, q), 6) AS share FROM x""")
def sector_shares_trailing(spark, d):
    """Sector shares of the trailing year; negative values count as none."""
    t = tw.trailing_year(ytd(spark, d), ["seg"], "y", "q", "ytd").withColumn("v", F.greatest("trailing", F.lit(0.0)))
    return t.select("y", "q", "seg", r6(F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("y", "q")))).alias("share"))


@query("""WITH n AS (SELECT c_mktsegment AS seg, year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS closed, sum(o_totalprice) AS pay FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)
SELECT seg, CAST(y AS VARCHAR) || 'Q' || CAST(q AS VARCHAR) AS period, orders, round(closed / orders, 6) AS closed_share, round(pay / orders, 4) AS wage, round(orders / sum(orders) OVER (PARTITION BY y, q), 6) AS share FROM n""")
def quarterly_labor(spark, d):
    """Quarterly totals, a sector's part in them and pay per head."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    n = table(spark, d, "orders").join(c, "o_custkey").groupBy("seg", F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q")).agg(F.count(F.lit(1)).alias("orders"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("closed"), F.sum("o_totalprice").alias("pay"))
    return n.select("seg", F.concat(F.col("y").cast("string"), F.lit("Q"), F.col("q").cast("string")).alias("period"), "orders", r6(F.try_divide("closed", "orders")).alias("closed_share"), F.round(F.try_divide("pay", "orders"), 4).alias("wage"), r6(F.col("orders") / F.sum("orders").over(Window.partitionBy("y", "q"))).alias("share"))


@query("""WITH n AS (SELECT c_nationkey AS id, year(o_orderdate) AS y, count(*) AS pop, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS young, count(*) FILTER (o_orderpriority = '5-LOW') AS old FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT a.id, a.y, round(CASE WHEN a.young + a.old < a.pop THEN a.young / a.pop END, 6) AS young, round(CASE WHEN a.young + a.old < a.pop THEN a.old / a.pop END, 6) AS old, round(1000.0 * (b.young - b.old) / a.pop, 4) AS migration
FROM n a LEFT JOIN n b ON b.id = a.id AND b.y = a.y - 1""")
def yearly_demography(spark, d):
    """Shares that are invalid when they leave no middle group, and last year's balance per thousand."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("id"))
    n = table(spark, d, "orders").join(c, "o_custkey").groupBy("id", F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("pop"), F.count(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1)).alias("young"), F.count(F.when(F.col("o_orderpriority") == "5-LOW", 1)).alias("old"))
    last = n.select("id", (F.col("y") + 1).alias("y"), (F.col("young") - F.col("old")).alias("b"))
    valid = F.col("young") + F.col("old") < F.col("pop")
    return n.join(last, ["id", "y"], "left").select("id", "y", r6(F.when(valid, F.col("young") / F.col("pop"))).alias("young"), r6(F.when(valid, F.col("old") / F.col("pop"))).alias("old"), F.round(1000.0 * F.col("b") / F.col("pop"), 4).alias("migration"))


@query(f"""WITH s AS (SELECT c_nationkey AS id, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE (c_nationkey + year(o_orderdate)) % 5 <> 0 GROUP BY 1, 2),
e AS (SELECT unnest(range({FIRST + 11}, {LAST + 1})) AS w), k AS (SELECT n_nationkey AS id, w, floor((w - 5.5) / 12)::INT AS y, least(1, greatest(0, ((w - 5.5) - 12 * floor((w - 5.5) / 12)) / 12)) AS p FROM e, nation WHERE w % 3 = 2)
SELECT k.id, w AS "end", round(coalesce(a.v, b.v) + p * (coalesce(b.v, a.v) - coalesce(a.v, b.v)), 2) AS v FROM k LEFT JOIN s a ON a.id = k.id AND a.y = k.y LEFT JOIN s b ON b.id = k.id AND b.y = k.y + 1""")
def interpolate_stock(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("id"))
    s = table(spark, d, "orders").join(c, "o_custkey").groupBy("id", F.year("o_orderdate").cast("long").alias("y")).agg(F.sum("o_totalprice").alias("v")).filter((F.col("id") + F.col("y")) % 5 != 0)
    ends = F.explode(F.array(*[F.lit(e).cast("long") for e in tw.window_ends(FIRST, LAST)])).alias("end")
    k = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), ends)
    return tw.interpolate_stock(s, k, "id", "y", "v").select("id", "end", F.round("v", 2).alias("v"))


DAYS = "WITH x AS (SELECT user_id, day(ts) AS d, sum(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT u.user_id, d.d FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(1, 31)) AS d) d)"


def day_grid(spark, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    x = ev.groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(F.sum("value").alias("v"))
    g = ev.select("user_id").distinct().withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(30))))
    return g.join(x, ["user_id", "d"], "left")


@query(DAYS + """, j AS (SELECT g.*, v FROM g LEFT JOIN x ON x.user_id = g.user_id AND x.d = g.d)
SELECT user_id, d::INT AS d, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS v FROM j""")
def ffill_bfill(spark, d):
    return rounded(rl.fill_along(day_grid(spark, d), "user_id", "d", ["v"]), "v", digits=4)


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS s, CASE WHEN c_custkey % 3 = 0 OR c_nationkey < 4 OR c_nationkey = 7 AND c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS x FROM customer),
a AS (SELECT id, n, s, coalesce(x, median(x) OVER (PARTITION BY n, s)) AS x FROM c), b AS (SELECT id, n, s, coalesce(x, median(x) OVER (PARTITION BY n)) AS x FROM a)
SELECT id, round(coalesce(x, (SELECT median(x) FROM b)), 4) AS x FROM b""")
def peer_impute(spark, d):
    """Nulls from peers: nation and segment, then nation, then all."""
    hole = (F.col("c_custkey") % 3 == 0) | (F.col("c_nationkey") < 4) | ((F.col("c_nationkey") == 7) & (F.col("c_mktsegment") == "BUILDING"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"), F.when(~hole, F.col("c_acctbal")).alias("x"))
    return rl.fill_from_peers(c, "x", [["n", "s"], ["n"], []]).select("id", F.round("x", 4).alias("x"))


@query("SELECT o_custkey AS id, o_orderkey AS version, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_version(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), "o_orderdate")
    return rl.latest(o, ["id"], [F.desc("o_orderdate"), F.desc("version")])


@query("""SELECT o_orderkey, coalesce(a.n_nationkey, b.n_nationkey) AS id, CASE WHEN a.n_nationkey IS NOT NULL THEN 'direct' ELSE 'stable' END AS matched
FROM orders LEFT JOIN nation a ON a.n_nationkey = o_custkey % 40 LEFT JOIN nation b ON b.n_nationkey = o_orderkey % 30 WHERE coalesce(a.n_nationkey, b.n_nationkey) IS NOT NULL""")
def match_fallback(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("direct"), (F.col("o_orderkey") % 30).alias("stable"))
    codes = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_nationkey").alias("id"))
    return rl.match_fallback(o, codes, "direct", "stable").select("o_orderkey", "id", "matched")


@query("""WITH a AS (SELECT c_custkey AS id, c_acctbal AS x, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS y FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_custkey AS id, -c_acctbal AS x, -c_acctbal AS y FROM customer WHERE c_custkey % 5 <> 0) SELECT id, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y FROM a FULL JOIN b USING (id)""")
def mutual_fill(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    a = c.filter("id % 3 <> 0").withColumn("y", F.when(F.col("id") % 7 != 0, F.col("x")))
    b = c.filter("id % 5 <> 0").select("id", (-F.col("x")).alias("x"), (-F.col("x")).alias("y"))
    return rl.mutual_fill(a, b, ["id"], ["x", "y"])


@query("WITH x AS (SELECT user_id, count(DISTINCT day(ts)) AS n FROM events GROUP BY 1) SELECT user_id, day(ts)::INT AS d, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM x WHERE n >= 28) GROUP BY 1, 2")
def complete_series(spark, d):
    """Entities with (nearly) every period: distinct days by user, kept by a semi join."""
    ev = table(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("d"))
    ok = ev.groupBy("user_id").agg(F.countDistinct("d").alias("n")).filter("n >= 28").select("user_id")
    return ev.join(ok, "user_id", "left_semi").groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P}, s AS (SELECT DISTINCT id, m // 12 AS y FROM f), k AS (SELECT id FROM s GROUP BY id HAVING count(*) = (SELECT count(DISTINCT y) FROM s)) SELECT id, y FROM s WHERE id IN (SELECT id FROM k)")
def balanced_panel(spark, d):
    s = panel(spark, d, "id", "m").select("id", F.floor(F.col("m") / 12).alias("y")).distinct()
    return rl.complete(s, "id", "y", s.agg(F.countDistinct("y")).first()[0])


@query("""SELECT c_nationkey AS id, round(sum(CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal * c_custkey END) / sum(CASE WHEN c_custkey % 6 <> 0 THEN c_custkey END), 6) AS balance, sum(c_custkey % 10)::BIGINT AS emp, sum(c_custkey)::BIGINT AS weight, count(*) AS children,
round(sum(c_custkey % 10) / sum(c_custkey), 6) AS rate, coalesce(sum(CASE WHEN c_custkey % 6 <> 0 THEN c_custkey END) >= 0.84 * sum(c_custkey), false) AS complete FROM customer GROUP BY 1""")
def merge_children(spark, d):
    """Customers into nations: weighted mean, sums, ratio computed anew, coverage flag."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("weight"), (F.col("c_custkey") % 10).alias("emp"), (F.col("c_custkey") % 6 != 0).alias("ok"))
    out = rl.merge_children(c, ["id"], "weight", ["balance"], ["emp"], "ok", 0.84)
    return out.select("id", r6("balance").alias("balance"), "emp", "weight", "children", r6(F.try_divide("emp", "weight")).alias("rate"), "complete")


QSUM = f"{P}, q AS (SELECT id, m // 3 AS t, sum(v) AS v FROM f GROUP BY 1, 2)"


def quarters(spark, d: str) -> DataFrame:
    return panel(spark, d, "id", "m").groupBy("id", F.floor(F.col("m") / 3).alias("t")).agg(F.sum("v").alias("v"))


@query(f"WITH {QSUM}, x AS (SELECT id, t, ln(v) - lag(ln(v)) OVER (PARTITION BY id ORDER BY t) AS g FROM q) SELECT id, t, round(g - median(g) OVER (PARTITION BY t), 6) AS growth FROM x WHERE g IS NOT NULL")
def residual_growth(spark, d):
    return tw.residual_growth(quarters(spark, d), "id", "t", "v").select("id", "t", r6("growth").alias("growth"))


@query(f"WITH {QSUM} SELECT id, t, round(ln(v) - median(ln(v)) OVER (PARTITION BY t), 6) AS level FROM q")
def residual_level(spark, d):
    return tw.residual_level(quarters(spark, d), "t", "v").select("id", "t", r6("level").alias("level"))


@query(f"WITH {QSUM} SELECT id, t, round((v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-12), 6) AS z FROM q WINDOW w AS (PARTITION BY id)")
def standardized_series(spark, d):
    return tw.standardized(quarters(spark, d), "id", "v").select("id", "t", r6("z").alias("z"))


@query(f"""WITH {QSUM}, x AS (SELECT id, t, ln(v) - lag(ln(v)) OVER (PARTITION BY id ORDER BY t) AS g FROM q), r AS (SELECT id, t, g - median(g) OVER (PARTITION BY t) AS g FROM x WHERE g IS NOT NULL)
SELECT a.id AS i, b.id AS j, round(corr(a.g, b.g), 6) AS corr FROM r a JOIN r b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2""")
def growth_correlation(spark, d):
    r = tw.residual_growth(quarters(spark, d), "id", "t", "v").select("id", "t", "growth")
    return series.correlations(r, "id", "t", "growth").select("i", "j", r6("corr").alias("corr"))


TYPE_DAYS = """g AS (SELECT event_type AS i, day(ts)::INT - 1 AS t, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2), z AS (SELECT i, t, (v - avg(v) OVER (PARTITION BY i)) / greatest(stddev_pop(v) OVER (PARTITION BY i), 1e-12) AS z FROM g)"""


@query(f"""WITH {TYPE_DAYS}, l AS (SELECT unnest(range(-3, 4)) AS lag), c AS (SELECT a.i, b.i AS j, lag, round(sum(a.z * b.z) / (30 - abs(lag)), 9) AS c FROM z a, l, z b WHERE b.t = a.t - lag AND a.i <> b.i GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY c DESC, abs(lag), sign(lag) DESC) AS r FROM c) SELECT i, j, round(c, 6) AS corr, lag::INT AS lag FROM r WHERE r = 1""")
def lagged_correlation(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("i"), (F.dayofmonth("ts") - 1).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return tw.lagged_correlation(tw.standardized(g, "i", "v"), "i", "t", 3, 30).select("i", "j", r6("corr").alias("corr"), "lag")


COLS = TYPES + ["rel"]


@query(ROLL + f""", y AS (SELECT id, w, {', '.join(f'ln(greatest({t} / total, 1e-4)) - ({CLR}) / 6 AS {t}' for t in TYPES)}, ln(total / median(total) OVER (PARTITION BY w)) AS rel FROM r),
qq AS (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}' for c in COLS)} FROM y),
kk AS (SELECT id, w, {', '.join(f'least(greatest({c}, lo_{c}), hi_{c}) AS {c}' for c in COLS)} FROM y, qq),
s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in COLS)} FROM kk)
SELECT id, w AS "window", {', '.join(f'round(({c} - m_{c}) / s_{c} / sqrt({6 if c in TYPES else 1}), 6) AS {c}' for c in COLS)} FROM kk, s""")
def feature_transform(spark, d):
    """Log ratios and level, clipped to their 1 and 99 percent quantiles, scaled over all windows, blocks of equal weight."""
    p = tw.in_windows(panel(spark, d), "m", tw.window_ends(FIRST, LAST))
    w = p.groupBy("id", "window").agg(*[F.sum(F.when(F.col("cat") == t, F.col("v")).otherwise(0.0)).alias(t) for t in TYPES], F.sum("v").alias("total"))
    w = tw.with_relative_level(w, "total", ["window"])
    s = rl.shares(w, TYPES, "total")
    s = s.select("id", F.col("window").cast("long").alias("window"), *(c.alias(t) for t, c in zip(TYPES, tf.centred_log_ratio(TYPES), strict=True)), "rel")
    z = tf.clipped_scores(s, COLS)
    return rounded(tf.block_weighted(z, [TYPES, ["rel"]]), *COLS)


@query(ROLL + """, a AS (SELECT id, w, sqrt(greatest(PROMO / total, 0)) AS s FROM r) SELECT id, w AS "window", round(s, 6) AS s FROM a""")
def root_shares(spark, d):
    p = tw.in_windows(panel(spark, d), "m", tw.window_ends(FIRST, LAST))
    w = p.groupBy("id", F.col("window").cast("long").alias("window")).agg(F.sum(F.when(F.col("cat") == "PROMO", F.col("v")).otherwise(0.0)).alias("p"), F.sum("v").alias("total"))
    return w.select("id", "window", r6(F.sqrt(F.greatest(F.try_divide("p", "total"), F.lit(0.0)))).alias("s"))


@query(f"""WITH {P}, t AS (SELECT id, m, sum(v) AS v FROM f GROUP BY 1, 2), x AS (SELECT id, m % 12 AS mon, m // 12 AS y, v - avg(v) OVER (PARTITION BY id) AS dev FROM t), n AS (SELECT mon, y, median(dev) AS c FROM x GROUP BY 1, 2)
SELECT round(1 - sum((dev - c) ** 2) / sum(dev ** 2), 6) AS common_share FROM x JOIN n ON n.mon = x.mon AND n.y = x.y""")
def seasonal_share(spark, d):
    """Share of deviations from the entity's mean that is common to all entities in the month."""
    t = panel(spark, d, "id", "m").withColumn("dev", F.col("v") - F.avg("v").over(Window.partitionBy("id")))
    c = t.withColumn("c", F.median("dev").over(Window.partitionBy("m")))
    return c.agg(r6(1 - F.sum(F.pow(F.col("dev") - F.col("c"), 2)) / F.sum(F.pow("dev", 2))).alias("common_share"))


DOM = """n AS (SELECT user_id AS id, (day(ts) - 1) // 3 AS t, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3),
x AS (SELECT id, t, event_type AS type FROM (SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY n DESC, event_type) AS r FROM n) WHERE r = 1)"""


def dominant(spark, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.floor((F.dayofmonth("ts") - 1) / 3).alias("t"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rl.latest(n, ["id", "t"], [F.desc("n"), F.col("event_type")]).select("id", "t", F.col("event_type").alias("type"))


@query(f"WITH {DOM}, c AS (SELECT *, lag(type) OVER (PARTITION BY id ORDER BY t) AS was FROM x) SELECT t, count(was) AS n, round(avg(CASE WHEN type <> was THEN 1.0 ELSE 0.0 END) FILTER (was IS NOT NULL), 6) AS changed FROM c GROUP BY t")
def monthly_change_flags(spark, d):
    c = dominant(spark, d).withColumn("was", F.lag("type").over(Window.partitionBy("id").orderBy("t")))
    return c.groupBy("t").agg(F.count("was").alias("n"), r6(F.avg(F.when(F.col("was").isNotNull(), (F.col("type") != F.col("was")).cast("double")))).alias("changed"))


@query(f"""WITH {DOM}, c AS (SELECT *, lag(type) OVER w AS was, lead(type, 1) OVER w AS n1, lead(type, 2) OVER w AS n2 FROM x WINDOW w AS (PARTITION BY id ORDER BY t))
SELECT count(*) AS changes, count(*) FILTER (n1 = was OR n2 = was) AS back, round(count(*) FILTER (n1 = was OR n2 = was) / count(*), 6) AS flip_back FROM c WHERE was <> type AND n2 IS NOT NULL""")
def flip_back(spark, d):
    """Of changes with two later periods, the share that returns within them."""
    w = Window.partitionBy("id").orderBy("t")
    c = dominant(spark, d).withColumns({"was": F.lag("type").over(w), "n1": F.lead("type", 1).over(w), "n2": F.lead("type", 2).over(w)}).filter((F.col("was") != F.col("type")) & F.col("n2").isNotNull())
    back = F.count(F.when((F.col("n1") == F.col("was")) | (F.col("n2") == F.col("was")), 1))
    return c.agg(F.count(F.lit(1)).alias("changes"), back.alias("back"), r6(F.try_divide(back.cast("double"), F.count(F.lit(1)).cast("double"))).alias("flip_back"))


@query(f"WITH {DOM}, c AS (SELECT id, type, first_value(type) OVER (PARTITION BY id ORDER BY t) AS was FROM x) SELECT id, max(CASE WHEN type <> was THEN 1 ELSE 0 END) AS ever FROM c GROUP BY id")
def ever_changed(spark, d):
    c = dominant(spark, d).withColumn("was", F.first("type").over(Window.partitionBy("id").orderBy("t")))
    return c.groupBy("id").agg(F.max((F.col("type") != F.col("was")).cast("int")).alias("ever"))


ENDS = f"{DOM}, k AS (SELECT id, arg_min(type, t) AS a, arg_max(type, t) AS b, count(*) AS n FROM x GROUP BY id)"


def ends(spark, d: str) -> DataFrame:
    return dominant(spark, d).groupBy("id").agg(F.min_by("type", "t").alias("a"), F.max_by("type", "t").alias("b"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENDS} SELECT a, b, count(*) AS n FROM k WHERE n = 10 GROUP BY 1, 2")
def transition_matrix(spark, d):
    return ends(spark, d).filter("n = 10").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOM} SELECT a.t, a.type AS a, b.type AS b, count(*) AS n FROM x a JOIN x b ON a.id = b.id AND b.t = a.t + 1 GROUP BY 1, 2, 3")
def type_flows(spark, d):
    x = dominant(spark, d)
    nxt = x.select("id", (F.col("t") - 1).alias("t"), F.col("type").alias("b"))
    return x.join(nxt, ["id", "t"]).groupBy("t", F.col("type").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))


RUNS = "r AS (SELECT user_id AS id, t, run, CASE WHEN (user_id * 7 + t * 5 + run * 3) % 11 < 8 THEN user_id % 4 ELSE (user_id + run) % 4 END AS label FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 1]) AS t), (SELECT unnest(range(0, 12)) AS run) WHERE (user_id + run) % 10 <> 0)"


def runs(spark, d: str) -> DataFrame:
    u = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    r = u.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(11)))).filter((F.col("id") + F.col("run")) % 10 != 0)
    label = F.when((F.col("id") * 7 + F.col("t") * 5 + F.col("run") * 3) % 11 < 8, F.col("id") % 4).otherwise((F.col("id") + F.col("run")) % 4)
    return r.withColumn("label", label)


@query(f"WITH {RUNS} SELECT id, t, round(avg(CASE WHEN label = id % 4 THEN 1.0 ELSE 0.0 END), 6) AS confidence, count(*) AS runs FROM r GROUP BY 1, 2")
def confidence_from_runs(spark, d):
    """Share of the runs that hold a node in which it has its reference type."""
    return runs(spark, d).groupBy("id", "t").agg(r6(F.avg((F.col("label") == F.col("id") % 4).cast("double"))).alias("confidence"), F.count(F.lit(1)).alias("runs"))


MOVED = f"{RUNS}, w AS (SELECT id, run, max(CASE WHEN t = 0 THEN label END) AS a, max(CASE WHEN t = 1 THEN label END) AS b FROM r GROUP BY 1, 2), m AS (SELECT id, avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END) AS moved, count(*) AS runs FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY id)"


def moved(spark, d: str) -> DataFrame:
    w = runs(spark, d).groupBy("id", "run").agg(F.max(F.when(F.col("t") == 0, F.col("label"))).alias("a"), F.max(F.when(F.col("t") == 1, F.col("label"))).alias("b")).dropna(subset=["a", "b"])
    return w.groupBy("id").agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("moved"), F.count(F.lit(1)).alias("runs"))


@query(f"WITH {MOVED} SELECT id, round(moved, 6) AS moved, runs FROM m")
def moved_share(spark, d):
    return rounded(moved(spark, d), "moved")


@query(f"WITH {MOVED}, {ENDS} SELECT a, b, count(*) AS n FROM k JOIN m ON m.id = k.id WHERE moved >= 0.25 AND a <> b GROUP BY 1, 2")
def robust_transitions(spark, d):
    """Changes of type of nodes that moved in enough runs."""
    return ends(spark, d).filter("a <> b").join(moved(spark, d).filter("moved >= 0.25").select("id"), "id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT user_id AS id, m, CASE m WHEN 0 THEN user_id % 3 WHEN 1 THEN user_id % 3 ELSE user_id % 4 END AS c FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 1, 2]) AS m))
SELECT a.id AS i, b.id AS j, round(count(*) / 3, 6) AS share FROM l a JOIN l b ON a.m = b.m AND a.c = b.c AND a.id < b.id GROUP BY 1, 2""")
def coassociation(spark, d):
    """Share of partitions that put two nodes together."""
    u = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    lab = u.withColumn("c", F.when(F.col("m") < 2, F.col("id") % 3).otherwise(F.col("id") % 4))
    a, b = lab.select(F.col("id").alias("i"), "m", "c"), lab.select(F.col("id").alias("j"), "m", "c")
    return a.join(b, ["m", "c"]).filter("i < j").groupBy("i", "j").agg(r6(F.count(F.lit(1)) / 3).alias("share"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
