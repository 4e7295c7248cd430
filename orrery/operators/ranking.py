"""Threshold aggregation, Borda counts and rule mining."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.relational import average_rank, round_cut


def thirds(value: Column, cuts: Column) -> Column:
    """3 from the upper tercile on, 2 from the lower, else 1."""
    return F.when(value >= cuts[1], 3).when(value >= cuts[0], 2).otherwise(1)


def tercile_ranking(df: DataFrame, key: str, signs: dict[str, int]) -> DataFrame:
    """Counts of worst and middle thirds over signed indices, place by 10 * worst + middle (least rank), and Borda points."""
    signed = df.select(key, *((F.col(c) * s).alias(c) for c, s in signs.items()))
    cuts = signed.agg(*[F.percentile(c, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias(f"_{c}") for c in signs])
    g = signed.crossJoin(F.broadcast(cuts)).withColumns({f"g_{c}": thirds(F.col(c), F.col(f"_{c}")) for c in signs})
    count = lambda v: sum((F.when(F.col(f"g_{c}") == v, 1).otherwise(0) for c in signs), F.lit(0))
    out = g.withColumns({"worst": count(1), "middle": count(2), "best": count(3), **{f"r_{c}": average_rank(c) for c in signs}})
    out = out.withColumn("borda", sum((F.col(f"r_{c}") for c in signs), F.lit(0.0)))
    return out.withColumn("place", F.rank().over(Window.orderBy(10 * F.col("worst") + F.col("middle")))).select(key, "worst", "middle", "best", "borda", "place")


def rule_conditions(df: DataFrame, cols: list[str], quantiles: list[float]) -> DataFrame:
    """(feature, cut, sign): rounded quantile cuts, each as <= and >."""
    q = df.agg(*[F.percentile(c, F.array(*[F.lit(x) for x in quantiles])).alias(c) for c in cols])
    rows = q.unpivot([], cols, "feature", "cuts").select("feature", F.explode("cuts").alias("cut")).withColumn("cut", round_cut(F.col("cut")))
    return rows.distinct().select("feature", "cut", F.explode(F.array(F.lit("<="), F.lit(">"))).alias("sign"))


def rule_scores(df: DataFrame, rules: DataFrame, cols: list[str], target: Column) -> DataFrame:
    """precision, recall, f1 of one-condition rules: rules are few, so each row meets the rules of its features only."""
    long = df.withColumn("_y", target.cast("int")).unpivot(["_y"], cols, "feature", "x")
    hit = F.when(F.col("sign") == "<=", F.col("x") <= F.col("cut")).otherwise(F.col("x") > F.col("cut"))
    n = long.join(F.broadcast(rules), "feature").withColumn("_h", hit.cast("int")).groupBy("feature", "cut", "sign").agg(F.sum("_h").alias("hits"), F.sum(F.col("_h") * F.col("_y")).alias("good"), F.sum("_y").alias("all"))
    p, r = F.coalesce(F.try_divide("good", "hits"), F.lit(0.0)), F.coalesce(F.try_divide("good", "all"), F.lit(0.0))
    return n.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def rule_search(df: DataFrame, cols: list[str], target: Column, quantiles: list[float], depth: int = 3, beam: int = 25, gain: float = 0.01) -> list[tuple[tuple[str, str, float], ...]]:
    """The best conjunction of conditions on distinct features by beam search: each level is one aggregation over the data
    with all candidates of the level; a longer rule is taken only if its F1 is better by more than `gain`. Returns
    [(feature, sign, cut), ...] of the best rule, with its F1 last."""
    singles = [(r["feature"], r["sign"], r["cut"]) for r in rule_conditions(df, cols, quantiles).orderBy("feature", "cut", "sign").collect()]
    test = lambda c: (F.col(c[0]) <= c[2]) if c[1] == "<=" else (F.col(c[0]) > c[2])
    y = target.cast("int")
    total = df.agg(F.sum(y).alias("n")).first()["n"] or 0
    best, best_f1, level = (), 0.0, [()]
    for _ in range(depth):
        grown = {tuple(sorted({*rule, c})) for rule, c in itertools.product(level, singles) if c[0] not in {x[0] for x in rule}}
        scored = []
        for part in itertools.batched(sorted(grown), 200):
            aggs = []
            for i, rule in enumerate(part):
                ok = test(rule[0])
                for c in rule[1:]:
                    ok = ok & test(c)
                aggs += [F.sum(ok.cast("int")).alias(f"h{i}"), F.sum(ok.cast("int") * y).alias(f"g{i}")]
            got = df.agg(*aggs).first()
            for i, rule in enumerate(part):
                h, g = got[f"h{i}"] or 0, got[f"g{i}"] or 0
                scored.append((2 * g / (h + total) if g else 0.0, rule))
        scored.sort(key=lambda x: (-x[0], x[1]))
        if not scored:
            break
        level = [r for _, r in scored[:beam]]
        if scored[0][0] > best_f1 + gain:
            best_f1, best = scored[0]
    return [*best, ("f1", "=", best_f1)]


def rule_test(rule: list[tuple[str, str, float]]) -> Column:
    """All conditions (feature, sign, cut) of a rule; the entry with its F1 says nothing."""
    out = F.lit(True)
    for f, sign, cut in rule:
        if f != "f1":
            out = out & ((F.col(f) <= cut) if sign == "<=" else (F.col(f) > cut))
    return out


def rule_score(df: DataFrame, rule: list[tuple[str, str, float]], target: Column) -> tuple[float, float, float]:
    """Precision, recall and F1 of a rule on rows it may not have been made for."""
    hit, y = rule_test(rule).cast("int"), target.cast("int")
    got = df.agg(F.sum(hit).alias("h"), F.sum(hit * y).alias("g"), F.sum(y).alias("n")).first()
    h, good, n = got["h"] or 0, got["g"] or 0, got["n"] or 0
    return good / h if h else 0.0, good / n if n else 0.0, 2 * good / (h + n) if good else 0.0


def rule_text(rule: list[tuple[str, str, float]]) -> str:
    return " and ".join(f"{f} {sign} {cut:g}" for f, sign, cut in rule if f != "f1")


def graded_against(df: DataFrame, base: DataFrame, signs: dict[str, int]) -> DataFrame:
    """df with worst and best: in how many columns (by sign) a row stands in the lowest or highest third of base's rows."""
    cuts = base.agg(*[F.percentile(F.col(c) * s, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias(f"_{c}") for c, s in signs.items()])
    joined = df.crossJoin(F.broadcast(cuts))  # one row
    grade = {c: thirds(F.col(c) * s, F.col(f"_{c}")) for c, s in signs.items()}
    count = lambda v: sum((F.when(g == v, 1).otherwise(0) for g in grade.values()), F.lit(0))
    return joined.withColumns({"worst": count(1), "best": count(3)}).drop(*(f"_{c}" for c in signs))
