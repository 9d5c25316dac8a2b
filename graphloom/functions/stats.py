"""Statistics that compare measured run times with expected complexity, as SQL aggregates."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MATCH_R2 = 0.90
SLACK = 1.75


def _terms(n: Column, m: Column, log: Callable[[Column], Column]) -> dict[str, Column]:
    ln = lambda c: log(F.greatest(c, F.lit(2.0)))
    return {"O(n)": n, "O(n log n)": n * ln(n), "O(n^2)": n * n, "O(V+E)": n + m, "O(E log V)": m * ln(n), "O(E log E)": m * ln(m), "O(V E^2)": n * m * m, "O(k(V+E))": n + m}


def complexity_models(n: Column, m: Column) -> dict[str, Column]:
    return _terms(n, m, F.log)


def graph_terms(v: Column, e: Column) -> dict[str, Column]:
    return _terms(v, e, F.log2)


def run_benchmark(spark: SparkSession, algorithm: Callable, make: Callable, sizes: Iterable[int], repeats: int = 3) -> DataFrame:
    """size, edges, rep, ms of timed runs of ``algorithm(make(size))``."""
    rows = []
    for size in sizes:
        graph = make(size)
        edges = graph.num_edges()
        for rep in range(repeats):
            began = time.perf_counter()
            algorithm(graph)
            rows.append((size, edges, rep, 1000 * (time.perf_counter() - began)))
    return spark.createDataFrame(rows, "size bigint, edges bigint, rep int, ms double")


def summarize_runs(samples: DataFrame) -> DataFrame:
    """mean, median, population deviation and variance flag by size."""
    s = samples.groupBy("size").agg(F.max("edges").alias("edges"), F.avg("ms").alias("mean"), F.median("ms").alias("median"), F.stddev_pop("ms").alias("std"), F.count("*").alias("reps"))
    return s.withColumn("high_variance", F.col("std") > 0.30 * F.col("mean"))


def _checked(points: DataFrame) -> DataFrame:
    r = points.agg(F.count("*").alias("n"), F.min(F.least("size", "ms")).alias("low")).first()
    if r["n"] < 2:
        raise ValueError("need at least two points")
    if r["low"] <= 0:
        raise ValueError("sizes and times must be positive")
    return points.select(F.col("size").cast("double").alias("n"), F.col("edges").cast("double").alias("m"), F.col("ms").cast("double").alias("t"))


def fit_complexity_curve(points: DataFrame, candidates: list[str]) -> DataFrame:
    """name, param, residual, rmse, best for one-parameter fits of ``points(size, edges, ms)``."""
    p = _checked(points)
    models = complexity_models(F.col("n"), F.col("m"))
    if unknown := [c for c in candidates if c not in models]:
        raise ValueError(f"unknown complexity candidate {unknown[0]!r}")
    long = p.select("t", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(i).alias("nth"), models[c].alias("f")) for i, c in enumerate(candidates)])).alias("e")).select("t", "e.*")
    fit = long.groupBy("name", "nth").agg(F.greatest(F.sum(F.col("f") * F.col("t")) / F.sum(F.col("f") * F.col("f")), F.lit(0.0)).alias("param"))
    err = long.join(F.broadcast(fit), ["name", "nth"]).groupBy("name", "nth", "param").agg(F.sum((F.col("t") - F.col("param") * F.col("f")) ** 2).alias("residual"), F.count("*").alias("k"))
    best = err.agg(F.min(F.struct("residual", "nth")).alias("b"))
    return err.join(F.broadcast(best)).select("name", "param", "residual", F.sqrt(F.col("residual") / F.col("k")).alias("rmse"), (F.col("nth") == F.col("b.nth")).alias("best"))


def loglog_exponent(points: DataFrame) -> DataFrame:
    """exponent, intercept and label of the line through ln t over ln n."""
    p = _checked(points)
    fit = p.agg(F.regr_slope(F.log("t"), F.log("n")).alias("exponent"), F.regr_intercept(F.log("t"), F.log("n")).alias("intercept"))
    return fit.withColumn("label", F.format_string("O(n^%.2f)", "exponent"))


def fit_against_term(points: DataFrame, term: Column) -> DataFrame:
    """slope, intercept, r_squared, match of time over a term of ``n`` and ``m``; a constant term explains nothing."""
    p = _checked(points).select("t", term.alias("x"))
    a = p.agg(F.stddev_pop("x").alias("spread"), F.avg("t").alias("mean"), F.regr_slope("t", "x").alias("slope"), F.regr_intercept("t", "x").alias("intercept"), F.regr_r2("t", "x").alias("r2"))
    flat = F.col("spread") <= 0
    r2 = F.when(flat, 0.0).otherwise(F.least(F.greatest(F.coalesce("r2", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return a.select(F.when(flat, 0.0).otherwise(F.col("slope")).alias("slope"), F.when(flat, F.col("mean")).otherwise(F.col("intercept")).alias("intercept"), r2.alias("r_squared"), (r2 >= MATCH_R2).alias("match"))


def fit_flow_work(points: DataFrame) -> DataFrame:
    """The fits of a flow's time over V E^2 and over paths times E, for ``points(size, edges, ms, paths)``."""
    worst = fit_against_term(points, F.col("n") * F.col("m") * F.col("m")).withColumn("term", F.lit("V E^2"))
    seen = points.withColumn("edges", F.col("paths") * F.col("edges"))
    return worst.unionByName(fit_against_term(seen, F.col("m")).withColumn("term", F.lit("paths E")))


def evaluate_claim(fits: DataFrame, claimed: str, slack: float = SLACK) -> DataFrame:
    """claimed, match, best_fit and both residuals; a claim holds within ``slack`` times the best residual."""
    every = Window.partitionBy()
    row = fits.withColumn("best_residual", F.min("residual").over(every)).withColumn("best_fit", F.max(F.when(F.col("best"), F.col("name"))).over(every)).where(F.col("name") == claimed)
    return row.select(F.col("name").alias("claimed"), (F.col("residual") <= slack * F.col("best_residual")).alias("match"), "best_fit", F.col("residual").alias("claimed_residual"), "best_residual")


def predict_curve(points: DataFrame, name: str, param: float) -> DataFrame:
    n, m = F.col("size").cast("double"), F.col("edges").cast("double")
    return points.withColumn("predicted", F.lit(float(param)) * complexity_models(n, m)[name])


def side_by_side(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("kruskals", "prims")) -> DataFrame:
    """Mean times of two algorithms by size, and the faster one."""
    both = left.select("size", F.col("mean").alias("a")).join(right.select("size", F.col("mean").alias("b")), "size")
    return both.select("size", F.col("a").alias(names[0]), F.col("b").alias(names[1]), F.when(F.col("a") <= F.col("b"), names[0]).otherwise(names[1]).alias("faster"))


def sparse_probability(n: int, average_degree: float = 6.0, most: float = 0.5) -> float:
    """Edge probability for about ``average_degree`` neighbours of a node."""
    return min(most, average_degree / (n - 1)) if n > 1 else 0.0
