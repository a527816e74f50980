"""How well a ranking agrees with labels: tie-aware ranks, correlations, inversions, precision, intervals, gates.

Inputs are rows (job, item, score, human). Pairwise measures join within a job by value groups, not by rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of pair_counts(): as many squared are the cells of its grid.
MOST_SLICES = 1000
SAMPLES, SEED, TRIALS, TRIAL_SEED = 2000, 20260728, 200, 7
TOLERANCE, LEAST_VALIDITY = 0.05, 0.90


def average_ranks(rows: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """1-based ranks, ties at their mean, by aggregated values: a job with few different values sorts few rows."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("_c").over(before), F.lit(0)) + (F.col("_c") + 1) / 2.0)
    return rows.join(ranks.drop("_c"), [*keys, value])


def correlation(x: Column, y: Column) -> Column:
    """Pearson as an aggregate; 0 for fewer than two rows or without variance."""
    n = F.count(x)
    top = F.covar_pop(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.when((n >= 2) & (spread > 0), top / spread), F.lit(0.0))


def pearson(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.round(correlation(F.col("score"), F.col("human")), 6).alias("pearson"), F.count("*").alias("n"))


def spearman(rows: DataFrame, *keys: str) -> DataFrame:
    ranked = average_ranks(average_ranks(rows, "score", "_x", *keys), "human", "_y", *keys)
    return ranked.groupBy(*keys).agg(F.round(correlation(F.col("_x"), F.col("_y")), 6).alias("spearman"), F.count("*").alias("n"))


def less_before(codes: np.ndarray, weights: np.ndarray) -> int:
    """Sum of weights[i] * weights[j] over i < j with codes[i] < codes[j]; codes are whole numbers from 0.

    By bits, the highest first: among numbers that agree in the bits before, one with the bit set has all those before it
    without the bit below it. Then the numbers are dealt by that bit, keeping their order.
    """
    total, group = 0, np.zeros(len(codes), np.int64)
    for bit in range(int(codes.max()).bit_length() - 1 if len(codes) else -1, -1, -1):
        one = (codes >> bit & 1).astype(bool)
        zeros = np.cumsum(np.where(one, 0, weights))
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        base = np.repeat(np.where(first > 0, zeros[first - 1], 0), np.diff(np.append(first, len(group))))
        total += int((weights[one] * (zeros - base)[one]).sum())
        group = group * 2 + one
        order = np.argsort(group, kind="stable")
        codes, weights, group = codes[order], weights[order], np.unique(group[order], return_inverse=True)[1]
    return total


def _agreeing(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[int, int]:
    """Weighted pairs that x and y order alike, and those that they order differently; ties in either are neither."""
    code = np.unique(y, return_inverse=True)[1]
    up, down = np.lexsort((-code, x)), np.lexsort((code, x))
    return less_before(code[up], weights[up]), less_before((code.max() - code)[down], weights[down])


def _within(rows: DataFrame, keys: list[str], part: list[str], x: str, y: str) -> DataFrame:
    """(keys, up, down): the pairs within each part of (keys, part..., x, y, c)."""

    def run(table: pa.Table) -> pa.Table:
        up, down = _agreeing(*(table.column(c).to_numpy() for c in (x, y, "c")))
        return pa.table([*(table.column(k).slice(0, 1) for k in keys), pa.array([up]), pa.array([down])], names=[*keys, "up", "down"])

    schema = rows.select(*keys).schema.add("up", "long").add("down", "long")
    return rows.select(*keys, *part, x, y, "c").groupBy(*keys, *part).applyInArrow(run, schema)


def _sliced(rows: DataFrame, column: str, out: str, bounds: str) -> DataFrame:
    """rows with the slice of a value among sorted bounds: odd for a bound itself, even between two; found in two steps."""
    b, step = F.col(bounds), 32
    upto = lambda a: F.size(F.filter(a, lambda z: z <= F.col(column)))
    blocks = upto(F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / step).cast("int")), lambda k: F.get(b, k * step)))
    low = F.greatest(blocks - 1, F.lit(0)) * step
    k = F.when(F.size(b) > 0, low + upto(F.slice(b, low + 1, step))).otherwise(0)
    return rows.withColumn("_k", k).withColumn(out, F.col("_k") * 2 - F.coalesce((F.get(b, F.col("_k") - 1) == F.col(column)).cast("int"), F.lit(0))).drop("_k")


def pair_counts(rows: DataFrame, *keys: str, slice_rows: int = 50_000) -> DataFrame:
    """Concordant, discordant and tied pairs of each key.

    Merge counting over slices. Score and human are each cut into slices of about `slice_rows` rows (at most MOST_SLICES), at
    approximate quantiles; values equal to a bound are slices of their own, so no slice holds much besides one value.
    Pairs in one slice of the score are counted within it, those in one slice of human but in two of the score within
    that one, and all others from the counts of the grid of slices. So no row meets all others, however many levels both have.
    """
    k = list(keys)
    cells = rows.groupBy(*k, F.col("score").cast("double").alias("x"), F.col("human").cast("double").alias("y")).agg(F.count("*").alias("c")).where("x IS NOT NULL AND y IS NOT NULL")
    per_key = cells.groupBy(*k).agg(F.sum("c").alias("n"))
    most = per_key.agg(F.max("n")).first()[0] or 0
    slices = min(MOST_SLICES, max(1, -(-most // slice_rows)))
    at = [i / slices for i in range(1, slices)]
    quantiles = lambda c: F.array_sort(F.array_distinct(F.percentile_approx(c, at, F.lit(10 * slices)))) if at else F.array().cast("array<double>")
    bounds = cells.groupBy(*k).agg(quantiles("x").alias("bx"), quantiles("y").alias("by"))
    cells = cells.join(bounds, k) if k else cells.crossJoin(bounds)
    cells = _sliced(_sliced(cells, "x", "sx", "bx"), "y", "sy", "by").drop("bx", "by")
    several = lambda part, v: cells.join(cells.groupBy(*k, part).agg((F.min(v) < F.max(v)).alias("_s")).where("_s").drop("_s"), [*k, part], "left_semi")
    found = _within(several("sx", "x"), k, ["sx"], "x", "y")
    if at:
        found = found.unionByName(_within(several("sy", "y"), k, ["sy"], "sx", "y"))
        found = found.unionByName(_within(cells.groupBy(*k, "sx", "sy").agg(F.sum("c").alias("c")), k, [], "sx", "sy"))
    sums = found.groupBy(*k).agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    two = lambda c: F.sum(c * (c - 1) / 2).cast("long")
    tied = lambda by, name: cells.groupBy(*k, by).agg(F.sum("c").alias("c")).groupBy(*k).agg(two(F.col("c")).alias(name))
    both = cells.groupBy(*k).agg(two(F.col("c")).alias("tied_both"), F.sum("c").alias("n"))
    for part, how in ((tied("x", "tx"), "inner"), (tied("y", "ty"), "inner"), (sums, "left")):
        both = both.join(part, k, how) if k else both.crossJoin(part)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.select(
        *k, zero(F.col("up")).alias("concordant"), zero(F.col("down")).alias("discordant"), (F.col("ty") - F.col("tied_both")).alias("tied_human_only"), (F.col("tx") - F.col("tied_both")).alias("tied_score_only"), "tied_both", "n"
    )


def kendall(rows: DataFrame, *keys: str) -> DataFrame:
    """tau as the evaluation defines it (pairs tied in both count in both tie terms) and textbook tau-b; inversion rate."""
    p = pair_counts(rows, *keys)
    c, d = F.col("concordant"), F.col("discordant")
    def tau(x: Column, y: Column) -> Column:
        below = F.sqrt((c + d + x).cast("double") * (c + d + y))  # in doubles: pairs times pairs are beyond a long
        return F.round(F.when(below > 0, (c - d) / below).otherwise(0.0), 6)

    both = F.col("tied_both")
    comparable = c + d + F.col("tied_score_only")
    return p.select(
        *keys, "n", "concordant", "discordant", tau(F.col("tied_score_only") + both, F.col("tied_human_only") + both).alias("kendall"), tau(F.col("tied_score_only"), F.col("tied_human_only")).alias("tau_b"),
        F.round(F.when(comparable > 0, d / comparable).otherwise(0.0), 6).alias("inversion_rate"),
    )


def top_k_precision(rows: DataFrame, k: int, item: str, *keys: str) -> DataFrame:
    """Share of our k best that are at least as good, to the human, as the human's k-th best."""
    ours = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), item))
    theirs = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("human"), item))
    best = rows.withColumns({"_o": ours, "_t": theirs}).where((F.col("_o") <= k) | (F.col("_t") <= k))
    bar = best.where(F.col("_t") <= k).groupBy(*keys).agg(F.min("human").alias("_bar"), F.count("*").alias("_k"))
    hit = best.where(F.col("_o") <= k).join(bar, [*keys]).groupBy(*keys).agg(F.round(F.count_if(F.col("human") >= F.col("_bar")) / F.first("_k"), 6).alias("precision"), F.first("_k").alias("k"))
    return hit


def mean_absolute_error(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.round(F.coalesce(F.avg(F.abs(F.col("score") - F.col("human"))), F.lit(0.0)), 6).alias("mae"))


def distribution(value: Column) -> list[Column]:
    """mean, p50, p95 (linear), min, max, n; zeros for no rows."""
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return [z(F.avg(value)).alias("mean"), z(F.percentile(value, 0.5)).alias("p50"), z(F.percentile(value, 0.95)).alias("p95"), z(F.min(value)).alias("min"), z(F.max(value)).alias("max"), F.count(value).alias("n")]


def z_scores(rows: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """(value - mean) / population deviation within each key; 0 for one row or without variance. By an aggregate and a join."""
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n"))
    z = F.when((F.col("_n") >= 2) & (F.col("_s") > 0), (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return rows.join(stats, [*keys]).withColumn(out, F.round(z, 6)).drop("_m", "_s", "_n")


#: A replicate takes a row k times if its hash, as a share, is below the k-th number: shares of a Poisson distribution of mean 1.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


#: Replicates that are drawn in one place.
BLOCK = 100


def _weighted(x: Column, y: Column, w: Column) -> Column:
    """Pearson's coefficient of rows that count w times; null without variance."""
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    xx, yy, xy = (F.sum(w * a * b) * n - sa * sb for a, b, sa, sb in ((x, x, sx, sx), (y, y, sy, sy), (x, y, sx, sy)))
    return F.when((xx > 1e-9) & (yy > 1e-9), xy / F.sqrt(xx * yy))


def weighted_pearson(draws: DataFrame, by: list[str]) -> DataFrame:
    return draws.groupBy(*by).agg(_weighted(F.col("x"), F.col("y"), F.col("w")).alias("value"))


def weighted_spearman(draws: DataFrame, by: list[str]) -> DataFrame:
    cells = draws.groupBy(*by, "x", "y").agg(F.sum("w").alias("w")).where("w > 0")
    rank = lambda c: F.sum("w").over(Window.partitionBy(*by).orderBy(c)) - (F.sum("w").over(Window.partitionBy(*by, c)) - 1) / 2
    return weighted_pearson(cells.select(*by, "w", rank("x").alias("x"), rank("y").alias("y")), by)


def weighted_mae(draws: DataFrame, by: list[str]) -> DataFrame:
    return draws.groupBy(*by).agg(F.try_divide(F.sum(F.col("w") * F.abs(F.col("x") - F.col("y"))), F.sum("w")).alias("value"))


def weighted_top_k(draws: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """top_k_precision where a row that was drawn w times stands w times."""
    taken = lambda order: F.least(F.col("w"), F.greatest(F.lit(0), k - F.coalesce(F.sum("w").over(Window.partitionBy(*by).orderBy(order, "item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    rows = draws.select(*by, "y", taken(F.desc("x")).alias("ours"), taken(F.desc("y")).alias("theirs")).where("ours > 0 OR theirs > 0")
    rows = rows.withColumn("bar", F.min(F.when(F.col("theirs") > 0, F.col("y"))).over(Window.partitionBy(*by)))  # 2 k rows
    return rows.groupBy(*by).agg((F.sum(F.when(F.col("y") >= F.col("bar"), F.col("ours")).otherwise(0)) / F.sum("ours")).alias("value"))


#: Statistics of draws (by..., item, x, y, w), null where there is none; and the widest interval of each.
STATISTICS = {"spearman": (weighted_spearman, -1.0, 1.0), "pearson": (weighted_pearson, -1.0, 1.0), "mae": (weighted_mae, 0.0, float("inf")), "top_k": (weighted_top_k, 0.0, 1.0)}


def bootstrap(rows: DataFrame, key: str, samples: int = SAMPLES, seed: int = SEED, statistic: str = "spearman") -> DataFrame:
    """(key, value, low, high, n): interval of a statistic (a name of STATISTICS) by resampling.

    Each replicate takes each row as often as a hash of (item, replicate, seed) says, by a Poisson distribution, so no job
    is gathered in one place and reruns agree. Replicates without a value (no variance) are left out. Fewer than three rows
    have the widest interval.
    """
    measure, least, most = STATISTICS[statistic]
    share = (F.xxhash64("item", "replicate", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / F.lit(float(1 << 52))
    times = reduce(Column.__add__, [(share >= p).cast("int") for p in POISSON])
    plain = rows.select(key, "item", F.col("score").cast("double").alias("x"), F.col("human").cast("double").alias("y"))
    # Equal pairs come together before they are drawn, a block of replicates at a time: what is summed up by pair needn't move.
    blocks = plain.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // BLOCK))))
    blocks = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "x", "y", "_block")
    numbers = F.sequence(F.col("_block") * BLOCK + 1, F.least(F.col("_block") * BLOCK + BLOCK, F.lit(samples)))
    drawn = blocks.withColumn("replicate", F.explode(numbers)).withColumn("w", times)
    each = measure(drawn, [key, "replicate"])
    got = each.groupBy(key).agg(F.array_sort(F.collect_list("value")).alias("_v"))  # as many as there are replicates
    whole = rows.groupBy(key).agg(F.count("*").alias("n")).join(measure(plain.withColumn("w", F.lit(1)), [key]), key, "left")
    at = lambda share: F.get("_v", F.least(F.size("_v") - 1, F.floor(F.size("_v") * F.lit(share)).cast("int")))
    wide = (F.col("n") < 3) | (F.coalesce(F.size("_v"), F.lit(0)) <= 0)
    ends = [F.round(F.when(wide, F.lit(default)).otherwise(at(p)), 6).alias(c) for c, p, default in (("low", 0.025, least), ("high", 0.975, most))]
    return whole.join(got, key, "left").select(key, F.round(F.coalesce("value", F.lit(0.0)), 6).alias("value"), *ends, "n")


def chance_ceiling(rows: DataFrame, trials: int = TRIALS, seed: int = TRIAL_SEED, *keys: str) -> DataFrame:
    """95th percentile, over trials, of Spearman's coefficient between random scores and the labels; order statistic.

    Scores come from a hash of item and trial, so reruns agree and each trial is a group of its own.
    """
    t = rows.select(*keys, "item", "human", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial")).withColumn("score", F.xxhash64("item", "trial", F.lit(seed)).cast("double"))
    each = spearman(t, *keys, "trial")
    got = each.groupBy(*keys).agg(F.array_sort(F.collect_list("spearman")).alias("_v"))
    return got.select(*keys, F.round(F.get("_v", F.floor((F.size("_v") - 1) * 0.95).cast("int")), 6).alias("ceiling"))


def gate(run: DataFrame, stored: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Pass or fail of (run, spearman, best_baseline, ceiling, validity, agreement), against stored numbers if given.

    One row per run: failures as a comma-joined list, passed.
    """
    fails = [
        F.when(F.col("spearman") <= F.col("best_baseline"), "baseline"),
        F.when(F.col("spearman") <= F.col("ceiling"), "noise"),
        F.when(F.col("validity") < LEAST_VALIDITY, "validity"),
    ]
    if stored is not None:
        run = run.join(stored.select("run", F.col("spearman").alias("_s"), F.col("agreement").alias("_a")), "run", "left")
        fails += [F.when(F.col("_s") - F.col("spearman") > tolerance, "drop"), F.when(F.col("_a") - F.col("agreement") > tolerance, "consistency")]
    said = F.concat_ws(",", *fails)
    return run.select("run", said.alias("failures"), (said == "").alias("passed"))
