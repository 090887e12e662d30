"""Statistics: intervals, projections, agreement, reliability, resampling, logistic regression, clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from citeloom.plans.scratch import Tables

RATIO_VALUES = 20_000  # distinct values that the ratio metric compares with each other
Z95 = 1.959963984540054  # fixed value: the 97.5 % point of the normal distribution


def wilson(k: Column, n: Column, z: float = Z95) -> dict[str, Column]:
    """Rate and Wilson interval of k of n; all zero where n is zero."""
    p = k / F.nullif(n, F.lit(0))
    wide = 1 + z * z / F.nullif(n, F.lit(0))
    middle = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / wide
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) * F.nullif(n, F.lit(0)))) / wide
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {"rate": zero(p), "ci_low": zero(F.greatest(F.lit(0.0), middle - half)), "ci_high": zero(F.least(F.lit(1.0), middle + half))}


def wilson_value(k: int, n: int, confidence: float = 0.95) -> tuple[float, float, float]:
    """The interval for one pair of numbers; raises for impossible ones."""
    from statistics import NormalDist

    if n <= 0 or k < 0 or k > n or not 0 < confidence < 1:
        raise ValueError("need 0 <= k <= n, n > 0 and a confidence between 0 and 1")
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    p, d = k / n, 1 + z * z / n
    half = z * ((p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / d
    middle = (p + z * z / (2 * n)) / d
    return p, max(0.0, middle - half), min(1.0, middle + half)


def projection(cells: DataFrame) -> DataFrame:
    """Expected yields of a census from strata (stratum, population, attempted, yielded): points and bounds summed."""
    w = wilson(F.col("yielded"), F.col("attempted"))
    return cells.agg(
        F.sum("population").alias("population"),
        F.round(F.sum(w["rate"] * F.col("population")), 4).alias("projected"),
        F.round(F.sum(w["ci_low"] * F.col("population")), 4).alias("projected_low"),
        F.round(F.sum(w["ci_high"] * F.col("population")), 4).alias("projected_high"),
    )


def projection_borrowed(cells: DataFrame, borrow_when: Column) -> DataFrame:
    """As ``projection``; cells without attempts where ``borrow_when`` holds take the pooled rate of such cells."""
    pool = cells.where(borrow_when).agg(F.sum("yielded").alias("pool_k"), F.sum("attempted").alias("pool_n"))
    own, pooled = wilson(F.col("yielded"), F.col("attempted")), wilson(F.col("pool_k"), F.col("pool_n"))
    use = (F.col("attempted") == 0) & borrow_when
    both = cells.crossJoin(F.broadcast(pool))  # one row
    pick = {c: F.when(use, pooled[c]).otherwise(own[c]) for c in own}
    return both.agg(
        F.count_if(use).alias("borrowed_cells"),
        F.round(F.sum(pick["rate"] * F.col("population")), 4).alias("projected"),
        F.round(F.sum(pick["ci_low"] * F.col("population")), 4).alias("projected_low"),
        F.round(F.sum(pick["ci_high"] * F.col("population")), 4).alias("projected_high"),
    )


def mean_interval(rows: DataFrame, value: str, z: float = Z95) -> DataFrame:
    """Mean with a normal interval from the population standard deviation."""
    half = z * F.stddev_pop(value) / F.sqrt(F.count(value))
    return rows.agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"),
        F.round(F.avg(value) - half, 6).alias("low"), F.round(F.avg(value) + half, 6).alias("high"),
    )


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def precision_recall(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """For each label: TP, FP, FN, precision and recall (null without a denominator)."""
    tall = rows.select(F.explode(F.array_distinct(F.array(truth, predicted))).alias("label"), truth, predicted)
    same = lambda c: F.col(c) == F.col("label")
    n = tall.groupBy("label").agg(
        F.count_if(same(truth) & same(predicted)).alias("tp"),
        F.count_if(~same(truth) & same(predicted)).alias("fp"),
        F.count_if(same(truth) & ~same(predicted)).alias("fn"),
    )
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return n.select("label", "tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement over the pairs that both sides labelled."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    same = F.when(both, (F.col(a) == F.col(b)).cast("double"))
    return rows.agg(F.count_if(both).alias("n_pairs"), F.round(F.avg(same), 6).alias("agreement"))


def krippendorff(ratings: DataFrame, metric: str = "nominal", by: tuple[str, ...] = ()) -> DataFrame:
    """Krippendorff's alpha of rows (by..., unit, coder, value): one row (by..., n_units, n_values, alpha).

    Coincidences come from counts of values per unit, so no pairs of coders are made. The expected disagreement of nominal and
    interval values follows from counts and moments; the ordinal difference of two values is that of their mid-ranks, so
    ordinal data are interval data of mid-ranks. Only for ratios are distinct values joined with themselves, up to
    ``RATIO_VALUES`` of them; more raise. Units with one rating don't count; alpha is null where no disagreement is expected.
    """
    g = ["_k", *by]
    per, sizes, weights = _coincidences(ratings, metric, by)
    marginal = per.groupBy(*g, "value").agg(F.sum("n_uv").alias("n_c"))
    o = weights.groupBy(*g, "c", "k").agg(F.sum("w").alias("o"))
    return _alpha(marginal, o, sizes.groupBy(*g).agg(F.count("*").alias("n_units")), metric, by)


def _coincidences(ratings: DataFrame, metric: str, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each unit with two ratings or more: its values' counts, its size, and its coincidences."""
    keys = [F.lit(0).alias("_k"), *by]
    v = ratings.where("value is not null").select(*keys, "unit", F.col("value").cast("double" if metric != "nominal" else "string").alias("value"))
    g = ["_k", *by]
    per = v.groupBy(*g, "unit", "value").agg(F.count("*").alias("n_uv"))
    sizes = per.groupBy(*g, "unit").agg(F.sum("n_uv").alias("m")).where("m >= 2")
    per = per.join(sizes, [*g, "unit"])
    # values of a unit against each other: as many rows as it has distinct values, squared
    left = per.select(*g, "unit", "m", F.col("value").alias("c"), F.col("n_uv").alias("nc"))
    right = per.select(*g, "unit", F.col("value").alias("k"), F.col("n_uv").alias("nk"))
    weight = F.col("nc") * (F.col("nk") - F.when(F.col("c") == F.col("k"), 1).otherwise(0)) / (F.col("m") - 1)
    return per, sizes, left.join(right, [*g, "unit"]).select(*g, "unit", "c", "k", weight.alias("w"))


def _alpha(marginal: DataFrame, o: DataFrame, units: DataFrame, metric: str, by: tuple[str, ...]) -> DataFrame:
    g = ["_k", *by]
    total = marginal.groupBy(*g).agg(F.sum("n_c").alias("n"))
    c, k = F.col("c"), F.col("k")
    if metric == "ordinal":
        ranks = mid_ranks(marginal, g)
        for side in ("c", "k"):
            o = o.join(ranks.select(*g, F.col("value").alias(side), F.col("mid").alias(f"mid_{side}")), [*g, side])
        o = o.select(*g, F.col("mid_c").alias("c"), F.col("mid_k").alias("k"), "o")
        marginal = ranks.select(*g, F.col("mid").alias("value"), "n_c")
    if metric in ("nominal", "interval", "ordinal"):
        # closed forms from counts and moments: no two values meet that no unit holds together
        m = lambda e: F.sum(F.col("n_c").cast("double") * e)
        if metric == "nominal":
            delta, expected = (c != k).cast("double"), m(F.lit(1.0)) * m(F.lit(1.0)) - m(F.col("n_c"))
        else:
            x = F.col("value") - F.col("_mean")
            delta, expected = (c - k) * (c - k), 2 * (m(F.lit(1.0)) * m(x * x) - m(x) * m(x))
            mean = marginal.groupBy(*g).agg((F.sum(F.col("n_c") * F.col("value")) / F.sum("n_c")).alias("_mean"))
            marginal = marginal.join(mean, g)
        expected = marginal.groupBy(*g).agg(expected.alias("expected"))
        observed = o.groupBy(*g).agg(F.sum(F.col("o") * delta).alias("observed"))
        sums = expected.join(observed, g, "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    elif metric == "ratio":
        # no closed form: the distinct values are joined with themselves
        most = marginal.groupBy(*g).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most > RATIO_VALUES:
            raise ValueError(f"{most} distinct values are too many for the ratio metric")
        a = marginal.select(*g, F.col("value").alias("c"), F.col("n_c").alias("n_c"))
        b = marginal.select(*g, F.col("value").alias("k"), F.col("n_c").alias("n_k"))
        delta = F.when(c + k == 0, 0.0).otherwise(((c - k) / (c + k)) * ((c - k) / (c + k)))
        pairs = a.join(b, g).withColumn("delta", delta).join(o, [*g, "c", "k"], "left")
        sums = pairs.groupBy(*g).agg(
            F.sum(F.coalesce("o", F.lit(0.0)) * F.col("delta")).alias("observed"), F.sum(F.col("n_c") * F.col("n_k") * F.col("delta")).alias("expected")
        )
    else:
        raise ValueError(metric)
    out = sums.join(total, g).join(units, g)
    alpha = 1 - F.col("observed") * (F.col("n") - 1) / F.nullif(F.col("expected"), F.lit(0.0))
    return out.select(*by, "n_units", F.col("n").alias("n_values"), F.round(alpha, 6).alias("alpha"))


def mid_ranks(counts: DataFrame, g: list[str]) -> DataFrame:
    """``counts`` (g..., value, n_c) with ``mid``: how many values of the group are smaller, and half of its own number.

    Values are sorted in ranges; each range's sums are added up within it, and the ranges' totals before it come on top.
    """
    tables = Tables(counts.sparkSession, "ranks")
    laid = counts.repartitionByRange(*g, "value").withColumn("_p", F.spark_partition_id())
    laid = tables.write(laid)  # the ranges stay as they are
    before = lambda by, *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = laid.groupBy(*g, "_p").agg(F.sum("n_c").alias("_s"))  # a row for each range that a group is in
    starts = totals.select(*g, "_p", zero(F.sum("_s").over(before(g, "_p"))).alias("_start"))
    own = laid.withColumn("_own", zero(F.sum("n_c").over(before([*g, "_p"], "value"))))
    return own.join(starts, [*g, "_p"]).select(*counts.columns, (F.col("_start") + F.col("_own") + F.col("n_c") / 2).alias("mid"))


def per_class_alpha(ratings: DataFrame, classes: list[str]) -> DataFrame:
    """Alpha of each class against the rest."""
    tall = ratings.where("value is not null").select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"), "unit", "coder", "value")
    return krippendorff(tall.withColumn("value", (F.col("value") == F.col("class")).cast("int")), "nominal", ("class",))


def axis_alpha(both: DataFrame, key: str, axes: dict[str, tuple[str, list[str] | None]]) -> DataFrame:
    """Alpha of each coded axis over the items that both coders labelled: (axis, method, n, alpha, threshold).

    ``both`` has columns ``<axis>_A`` and ``<axis>_B``; blank labels are none. ``axes``: the metric and, for an ordinal axis,
    the order of its labels. Fewer than two such items are INSUFFICIENT_DATA.
    """
    tall = []
    for axis, (method, order) in axes.items():
        left, right = (F.nullif(F.trim(F.col(f"{axis}_{side}").cast("string")), F.lit("")) for side in "AB")
        x = both.select(F.col(key).alias("unit"), left.alias("A"), right.alias("B")).where("A is not null and B is not null")
        if order:
            known = F.create_map(*[F.lit(v) for i, label in enumerate(order) for v in (label, i)])
            x = x.withColumns({side: F.try_element_at(known, F.col(side)).cast("string") for side in "AB"}).where("A is not null and B is not null")
        ratings = x.unpivot(["unit"], ["A", "B"], "coder", "value")
        alpha = krippendorff(ratings, method)
        named = x.agg(F.count("*").alias("n")).crossJoin(F.broadcast(x.sparkSession.createDataFrame([(axis, method)], "axis string, method string")))
        tall.append(named.join(alpha.select("alpha"), F.lit(True), "left"))  # one row each
    out = reduce(DataFrame.unionByName, tall)
    enough = F.col("n") >= 2
    return out.select("axis", "method", F.col("n").alias("n_units_both_labeled"), F.when(enough, F.round("alpha", 4)).alias("alpha_point"), F.when(enough, alpha_band(F.col("alpha"))).otherwise("INSUFFICIENT_DATA").alias("threshold"))


def estimator_comparison(cells: DataFrame, stratum: str, known: str) -> DataFrame:
    """Projected totals under three estimators: (estimator, point, low, high).

    ``cells``: a row for each cell with census, n (tried), k (yielded), a stratum and a marginal. The naive one takes
    one rate for all, the others a rate and its Wilson interval for each stratum or marginal.
    """

    def projected(by: list[str], name: str) -> DataFrame:
        sums = cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("census", "n", "k")]) if by else cells.agg(*[F.sum(c).alias(c) for c in ("census", "n", "k")])
        w = wilson(F.col("k"), F.col("n"))
        p, low, high = w["rate"], w["ci_low"], w["ci_high"]
        out = sums.where("n > 0").agg(*[F.round(F.sum(F.col("census") * c), 4).alias(x) for c, x in ((p, "point"), (low, "low"), (high, "high"))])
        return out.select(F.lit(name).alias("estimator"), "point", "low", "high")

    return projected([], "naive_overall_rate").unionByName(projected([stratum], "stratified")).unionByName(projected([known], "marginal_only"))


def validation_comparison(rows: DataFrame, human: dict[str, str], model: dict[str, str], fallback: dict[str, str], review: Column) -> dict[str, DataFrame]:
    """All tables that compare human, model and fallback labels: the dicts name a task's column on each side.

    summary and fallback_summary (metric, value), confusion and human_fallback_confusion (comparison, truth,
    predicted, n), metrics and human_fallback_metrics (task, label, ...), disagreements (rows). Blank labels are none; rows
    count as labelled with any human label.
    """
    clean = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for side in (human, model, fallback) for c in side.values()}
    rows = rows.withColumns(clean).withColumn("_review", F.coalesce(review, F.lit(False)))
    some = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in human.values()))
    labelled = rows.where(some)
    rate = lambda a, b: F.round(F.avg(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (F.col(a) == F.col(b)).cast("double"))), 6)

    def metrics(df: DataFrame, values: dict[str, Column]) -> DataFrame:
        one = df.agg(*[v.cast("double").alias(n) for n, v in values.items()])
        return one.unpivot([], list(values), "metric", "value")

    def tables(left: dict[str, str], right: dict[str, str], df: DataFrame, each) -> DataFrame:
        tasks = [t for t in left if t in right]
        return reduce(DataFrame.unionByName, [each(df.select(F.col(left[t]).alias("truth"), F.col(right[t]).alias("predicted")), t) for t in tasks])

    def counts(df: DataFrame, task: str) -> DataFrame:
        return confusion(df.where("truth is not null and predicted is not null"), "truth", "predicted").withColumn("comparison", F.lit(task))

    def scores(df: DataFrame, task: str) -> DataFrame:
        return precision_recall(df.where("truth is not null and predicted is not null"), "truth", "predicted").withColumn("task", F.lit(task))

    differ = reduce(lambda a, b: a | b, (F.coalesce(F.col(human[t]) != F.col(model[t]), F.lit(False)) for t in human if t in model))
    shared = [t for t in fallback if t in model]
    return {
        "summary": metrics(labelled, {"human_labels_available": F.count(F.lit(1))} | {f"{t}_agreement_rate": rate(human[t], model[t]) for t in human if t in model} | {"llm_abstention_or_review_rate_labeled": F.round(F.avg(F.col("_review").cast("double")), 6)}),
        "fallback_summary": metrics(rows, {"fallback_llm_rows_available": F.count(model[shared[0]])} | {f"fallback_llm_{t}_agreement_rate": rate(fallback[t], model[t]) for t in shared} | {"fallback_llm_llm_review_rate": F.round(F.avg(F.col("_review").cast("double")), 6)}),
        "disagreements": labelled.where(differ).drop("_review"),
        "confusion": tables(human, model, labelled, counts),
        "metrics": tables(human, model, labelled, scores),
        "fallback_confusion": tables(fallback, model, rows, counts),
        "human_fallback_confusion": tables(human, fallback, labelled, counts),
        "human_fallback_metrics": tables(human, fallback, labelled, scores),
    }


def alpha_band(alpha: Column) -> Column:
    return F.when(alpha.isNull(), "undefined").when(alpha >= 0.8, "reliable").when(alpha >= 0.667, "tentative").otherwise("unreliable")


def bootstrap_alpha(ratings: DataFrame, metric: str = "nominal", resamples: int = 1000, seed: int = 1) -> DataFrame:
    """Percentile interval of alpha over resampled units.

    Units whose values agree in kinds and numbers are one pattern. Each unit would draw its multiplicity from a Poisson law with mean 1; the sum of a
    pattern's n draws has the Poisson law with mean n, so a resample costs a draw for each pattern and not for each unit. Draws
    follow from seed and pattern, whatever the partitions; only patterns and sums are shuffled.
    """
    g = ["_k"]
    per, sizes, _ = _coincidences(ratings, metric, ())
    shape = per.groupBy(*g, "unit").agg(F.array_sort(F.collect_list(F.struct("value", "n_uv"))).alias("pattern"))
    patterns = shape.groupBy(*g, "pattern").agg(F.count("*").alias("n"))

    @pandas_udf("array<long>")
    def draws(n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, k & (2**64 - 1)]).poisson(m, resamples).tolist() for m, k in zip(n.tolist(), key.tolist(), strict=True)])

    drawn = patterns.select(*g, "pattern", draws("n", F.xxhash64("pattern")).alias("times"))
    drawn = drawn.select(*g, "pattern", F.posexplode("times").alias("rep", "times")).where("times > 0")
    value = drawn.select(*g, "rep", "times", F.explode("pattern").alias("v")).select(*g, "rep", F.col("v.value").alias("value"), (F.col("v.n_uv") * F.col("times")).alias("n"))
    marginal = value.groupBy(*g, "rep", "value").agg(F.sum("n").alias("n_c"))
    m = F.aggregate("pattern", F.lit(0).cast("long"), lambda s, v: s + v["n_uv"])
    same = lambda c, k: F.when(c["value"] == k["value"], 1).otherwise(0)
    pairs = F.flatten(
        F.transform("pattern", lambda c: F.transform("pattern", lambda k: F.struct(c["value"].alias("c"), k["value"].alias("k"), (c["n_uv"] * (k["n_uv"] - same(c, k))).alias("n"))))
    )
    o = drawn.select(*g, "rep", F.explode(pairs).alias("p"), (F.col("times") / (m - 1)).alias("w"))
    o = o.groupBy(*g, "rep", F.col("p.c").alias("c"), F.col("p.k").alias("k")).agg(F.sum(F.col("p.n") * F.col("w")).alias("o"))
    units = drawn.groupBy(*g, "rep").agg(F.sum("times").alias("n_units"))
    alphas = _alpha(marginal, o, units, metric, ("rep",))
    return alphas.agg(
        F.count("alpha").alias("resamples"), F.expr("percentile(alpha, 0.025)").alias("low"), F.expr("percentile(alpha, 0.975)").alias("high")
    )


def logistic(rows: DataFrame, y: Column, features: dict[str, Column], ridge: float = 1e-4, steps: int = 25, tolerance: float = 1e-9) -> list[dict]:
    """Logistic regression by Newton steps with a ridge on all coefficients: estimate, error, Wald interval, odds ratio.

    Each step is one distributed aggregate of X'WX and X'(y - p): p(p + 3) / 2 sums, whatever the rows.
    """
    names = ["intercept", *features]
    x = rows.select(y.cast("double").alias("_y"), F.lit(1.0).alias("x0"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(features.values(), 1)])
    # equal rows of the design count once, with their number: steps read this small aggregate
    x = x.groupBy(*x.columns).agg(F.count("*").alias("_w")).persist()
    p = len(names)
    beta, info = np.zeros(p), np.eye(p)
    for _ in range(steps):
        eta = reduce(lambda a, b: a + b, (F.lit(float(beta[i])) * F.col(f"x{i}") for i in range(p)))
        mu = 1 / (1 + F.exp(-eta))
        grid = [(i, j) for i in range(p) for j in range(i, p)]
        sums = x.withColumn("_m", mu).agg(
            *[F.sum(F.col("_w") * F.col("_m") * (1 - F.col("_m")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in grid],
            *[F.sum(F.col("_w") * (F.col("_y") - F.col("_m")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(p)],
        ).first()
        info = np.eye(p) * ridge
        for i, j in grid:
            info[i, j] += sums[f"h{i}_{j}"] or 0.0
            info[j, i] = info[i, j]
        step = np.linalg.solve(info, np.array([sums[f"g{i}"] or 0.0 for i in range(p)]) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    x.unpersist()
    error = np.sqrt(np.diag(np.linalg.inv(info)))
    return [
        {"term": n, "beta": float(b), "se": float(s), "low": float(b - Z95 * s), "high": float(b + Z95 * s), "odds_ratio": float(np.exp(b))}
        for n, b, s in zip(names, beta, error, strict=True)
    ]
