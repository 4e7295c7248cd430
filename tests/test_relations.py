"""Panels, statistics, rankings, rules."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import ranking as rk
from orrery.operators import relational as rl
from orrery.operators import stats as st
from orrery.operators import timewin as tw
from orrery.plans.catalogue import QUERIES
from tests.conftest import DATA


def test_lag_of_a_leader(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=60)
    x = np.column_stack([a, np.roll(a, 2) + rng.normal(scale=0.1, size=60), rng.normal(size=60)])[2:]
    rows = [(k, t, float(x[t, k])) for k in range(3) for t in range(len(x))]
    z = tw.standardized(spark.createDataFrame(rows, "id long, t long, v double"), "id", "v")
    got = {(r["i"], r["j"]): r for r in tw.lagged_correlation(z, "id", "t", 3, len(x)).collect()}
    assert got[(1, 0)]["corr"] > 0.9 and got[(1, 0)]["lag"] == 2 and got[(0, 1)]["lag"] == -2 and abs(got[(2, 0)]["corr"]) < 0.5


def test_windows_hold_twelve_months(spark):
    df = spark.range(0, 40).select(F.col("id").alias("m"))
    ends = tw.window_ends(0, 39)
    got = {r["window"]: r["n"] for r in tw.in_windows(df, "m", ends).groupBy("window").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert ends[0] == 11 and got == {e: 12 for e in ends}
    assert spark.range(1).select(tw.quarter_key(F.lit(2024 * 12 + 11))).first()[0] == "2024Q4"


def test_trailing_year_fallback(spark):
    rows = [("a", 2023, q, 10.0 + q) for q in (1, 2, 4)] + [("a", 2024, q, 20.0 + q) for q in (1, 2, 3, 4)]
    got = {(r["y"], r["q"]): r for r in tw.trailing_year(spark.createDataFrame(rows, "id string, y int, q int, v double"), ["id"], "y", "q", "v").collect()}
    assert got[(2024, 2)]["trailing"] == pytest.approx((6 * 22 + 12 * 14 - 6 * 12) / 12) and not got[(2024, 2)]["fallback"]
    assert got[(2024, 3)]["trailing"] == 23 and got[(2024, 3)]["fallback"] and got[(2024, 4)]["trailing"] == 24 and got[(2023, 1)]["fallback"]


def test_fills(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([None, 1.0, None, 3.0, None])], "id long, t int, v double")
    assert [r["v"] for r in rl.fill_along(df, "id", "t", ["v"]).orderBy("t").collect()] == [1.0, 1.0, 1.0, 3.0, 3.0]
    peers = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 1, None), ("a", 2, None), ("b", 3, None)], "g string, h int, x double")
    assert sorted(r["x"] for r in rl.fill_from_peers(peers, "x", [["g", "h"], ["g"], []]).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_merge_weights_only_complete_children(spark):
    df = spark.createDataFrame([(1, 99.0, 10.0, True), (1, 1.0, 50.0, False), (2, 50.0, 1.0, False), (2, 50.0, None, True)], "p long, w double, x double, ok boolean")
    got = {r["p"]: r for r in rl.merge_children(df, ["p"], "w", ["x"], [], "ok", 0.99).collect()}
    assert got[1]["x"] == 10 and got[1]["complete"] and got[1]["w"] == 100 and got[2]["x"] is None and not got[2]["complete"]


def test_round_cut(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1234.5, 2.375, 0.0123456, -2.5)], "x double")
    assert [r[0] for r in df.select(rl.round_cut(F.col("x"))).collect()] == pytest.approx([0.0, 1234.0, 2.38, 0.0123, -2.5])


def test_eta_squared_closed_form(spark):
    rng = np.random.default_rng(1)
    lab = np.repeat([0, 1, 2], 50)
    make = lambda v: spark.createDataFrame([(int(c), float(x)) for c, x in zip(lab, v, strict=True)], "g int, x double")
    h = 12 / (150 * 151) * (50 * np.array([25.5, 75.5, 125.5]) ** 2).sum() - 3 * 151
    assert st.kruskal_wallis(make(lab * 10 + rng.normal(size=150)), "g", "x").first()["eta2"] == pytest.approx((h - 2) / 147)
    assert abs(st.kruskal_wallis(make(rng.normal(size=150)), "g", "x").first()["eta2"]) < 0.06


def test_tails():
    assert st.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and st.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05) and st.chi2_sf(0, 3) == 1
    assert st.normal_sf(1.959963984540054) == pytest.approx(0.025)


def test_auc_brute_force(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 12, 80)
    got = st.roc_auc(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double"), "y", "s").first()
    pairs = [(a > b) + 0.5 * (a == b) for a, b in itertools.product(s[y == 1], s[y == 0])]
    assert got["auc"] == pytest.approx(np.mean(pairs)) and got["u"] == pytest.approx(sum(pairs))


def test_ranking_order(spark):
    cols = ["SW", "CH", "S_Dbw", "AVI", "AVU", "MQ"]
    rows = [("a", 0.3, 300.0, 0.5, 0.9, 0.1, 0.6), ("b", 0.2, 200.0, 0.7, 0.8, 0.2, 0.5), ("c", 0.1, 100.0, 0.9, 0.7, 0.3, 0.4)]
    df = spark.createDataFrame(rows, "name string, " + ", ".join(f"{c} double" for c in cols))
    got = rk.tercile_ranking(df, "name", dict(zip(cols, (1, 1, -1, 1, -1, 1), strict=True))).orderBy("place", F.desc("borda")).collect()
    assert [r["name"] for r in got] == ["a", "b", "c"] and got[0]["worst"] == 0 and got[2]["worst"] == 6 and got[0]["borda"] == 18


def test_rule_search_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.random((200, 3)).round(3)
    y = (x[:, 0] > 0.5) & (x[:, 1] <= 0.6)
    df = spark.createDataFrame([(*map(float, v), bool(t)) for v, t in zip(x, y, strict=True)], "a double, b double, c double, y boolean")
    qs = [0.25, 0.5, 0.75]
    rule = rk.rule_search(df, ["a", "b", "c"], F.col("y"), qs, depth=2)
    cuts = {c: sorted({float(f"{v:.3g}") for v in np.quantile(x[:, i], qs)}) for i, c in enumerate("abc")}
    masks = {(c, sign, v): (x[:, i] <= v) if sign == "<=" else (x[:, i] > v) for i, c in enumerate("abc") for v in cuts[c] for sign in ("<=", ">")}
    f1 = lambda m: 2 * (m & y).sum() / (m.sum() + y.sum())
    best = max(f1(masks[p] & masks[q]) for p, q in itertools.product(masks, masks) if p[0] != q[0])
    assert rule[-1][2] == pytest.approx(best) and {r[0] for r in rule[:-1]} == {"a", "b"} and not math.isnan(best)


def test_type_rules_of_every_region(spark, duck):
    """Each region that has customers has a rule; its scores are what its conditions give there and on the suppliers."""
    rows = {side: duck(f"SELECT n_regionkey AS type, {p}_acctbal AS balance, {p}_nationkey::DOUBLE AS code FROM {t} JOIN nation ON n_nationkey = {p}_nationkey") for side, t, p in (("", "customer", "c"), ("_other", "supplier", "s"))}
    got = QUERIES["type_rules"](spark, DATA).toPandas()
    assert sorted(got["type"]) == sorted(rows[""]["type"].unique()) == list(range(5))
    for r in got.itertuples():
        for side, df in rows.items():
            hit = df.eval(r.rule)
            y = df["type"] == r.type
            assert getattr(r, f"precision{side}") == pytest.approx((hit & y).sum() / max(1, hit.sum()), abs=2e-6)
            assert getattr(r, f"recall{side}") == pytest.approx((hit & y).sum() / max(1, y.sum()), abs=2e-6)
            assert getattr(r, f"f1{side}") == pytest.approx(2 * (hit & y).sum() / max(1, hit.sum() + y.sum()), abs=2e-6)


def test_graded_against(spark):
    base = spark.createDataFrame([(float(i), float(-i)) for i in range(1, 10)], "a double, b double")
    df = spark.createDataFrame([(0.5, 0.0), (9.5, -9.5), (5.0, -5.0)], "a double, b double")
    got = {r["a"]: (r["worst"], r["best"]) for r in rk.graded_against(df, base, {"a": 1, "b": -1}).collect()}
    assert got == {0.5: (2, 0), 9.5: (0, 2), 5.0: (0, 0)}


def test_two_sided_tail(spark):
    z = [0.0, 0.1, -1.0, 1.96, 3.0, 6.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(st.two_sided(F.col("z")).alias("p"), "z").collect()
    assert all(r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), abs=3e-7) for r in got)
