"""Target-balanced splits, cross-validation folds and their report."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import weighted_mean
from ..session import stage
from .ordered import exact_quantiles, ordered_prefix, plain_zero, tie_hash

#: Rows above this share of their group's total are dealt one by one: 10,000 a group at most.
TOLERANCE = 1e-4
GOLDEN = 0.6180339887498949
REPORT_QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999]
TOP_VALUES = 6


def size_proportion(size: float | int, n_rows: int) -> float:
    """A float is a share, an int a number of rows."""
    return float(size) if isinstance(size, float) else size / n_rows


def _largest_remainder(shares: list[float], total: int) -> list[int]:
    """Whole counts summing to ``total``, as close to the shares as possible."""
    exact = [max(0.0, s) for s in shares]
    norm = sum(exact)
    exact = [s * total / norm for s in exact] if norm > 0 else [total / len(exact)] * len(exact)
    counts = [math.floor(s) for s in exact]
    for b in sorted(range(len(exact)), key=lambda b: counts[b] - exact[b])[:total - sum(counts)]:
        counts[b] += 1
    return counts


def _deal_head(amounts: list[tuple[int, float]], sums: list[float],
               goals: list[float]) -> dict[int, int]:
    """The largest rows, one by one, to the bin that is emptiest relative to its goal."""
    fill = [(s / g, b) for b, (s, g) in enumerate(zip(sums, goals))]
    heapq.heapify(fill)
    chosen = {}
    for rank, amount in amounts:
        _, b = heapq.heappop(fill)
        chosen[rank] = b
        sums[b] += amount
        heapq.heappush(fill, (sums[b] / goals[b], b))
    return chosen


def balanced_labels(df: DataFrame, key: str, target: str, proportions: list[float],
                    w: str | None = None, seed: int = 0, by: list[str] | None = None,
                    label: str = "label", tolerance: float = TOLERANCE,
                    rows_per_bucket: float | None = None) -> DataFrame:
    """Bin label per row so that bins share the sum of ``target*w`` in the given proportions.

    Rows with more than ``tolerance`` of their group's total (fewer than
    ``1 / tolerance`` by arithmetic) decide the balance one by one; they are dealt
    on the driver.  All smaller positive rows follow a golden-ratio sequence of
    their rank, and zero rows fill each bin up to the same mean.  Returns ``df``
    with an integer ``label``.
    """
    if abs(sum(proportions) - 1) > 1e-9 or min(proportions) <= 0:
        raise ValueError("proportions must be positive and sum to 1")
    by, k = list(by or []), len(proportions)
    amount = F.col(target).cast("double") * (F.col(w).cast("double") if w else F.lit(1.0))
    base = df.withColumn("_neg", plain_zero(-amount))
    ranked = ordered_prefix(base, by, "_neg", "_tie", rank="_rank", key=key,
                            rows_per_bucket=rows_per_bucket, late={"_tie": tie_hash(key, seed)})
    ranked = stage(ranked.select(*df.columns, "_rank"), "balance").withColumn(
        "_t", plain_zero(amount))

    cuts = F.array(*[F.lit(c) for c in _running(proportions)[:-1]])
    turn = F.col("_rank") * GOLDEN
    tail_bin = F.size(F.filter(cuts, lambda c: c <= turn - F.floor(turn)))
    positive = F.col("_t") > 0
    totals = ranked.groupBy(*by).agg((F.sum("_t") * tolerance).alias("_large"))
    ranked = (ranked.join(F.broadcast(totals), by) if by
              else ranked.crossJoin(F.broadcast(totals)))
    in_head = F.col("_t") > F.col("_large")
    facts = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("n_pos"),
        F.sum("_t").alias("total"), F.min("_t").alias("lowest"),
        *[F.sum(F.when(~in_head & positive & (tail_bin == b), F.col("_t")).otherwise(0.0))
          .alias(f"s{b}") for b in range(k)],
        *[F.count_if(~in_head & positive & (tail_bin == b)).alias(f"c{b}")
          for b in range(k)]).collect()
    heads: dict[tuple, list[tuple[int, float]]] = {}
    for row in ranked.where(in_head & positive).select(*by, "_rank", "_t").collect():
        heads.setdefault(tuple(row[c] for c in by), []).append((row["_rank"], row["_t"]))

    head_rows_out, zero_rows_out = [], []
    for f in facts:
        group = tuple(f[c] for c in by)
        if f["lowest"] < 0:
            raise ValueError("targets must not be negative")
        if 0 < f["n_pos"] < k:
            raise ValueError("fewer positive targets than bins")
        sums = [f[f"s{b}"] for b in range(k)]
        counts = [f[f"c{b}"] for b in range(k)]
        goals = [p * (f["total"] or 1.0) for p in proportions]
        dealt = _deal_head(sorted(heads.get(group, [])), sums, goals)
        for rank, b in dealt.items():
            counts[b] += 1
            head_rows_out.append((*group, rank, b))
        if f["total"] > 0:
            wanted = [f["n"] * s / f["total"] - c for s, c in zip(sums, counts)]
        else:
            wanted = list(proportions)
        zeros = _largest_remainder(wanted, f["n"] - f["n_pos"])
        zero_rows_out.append((*group, f["n_pos"], [int(c) for c in _running(zeros)]))

    spark = df.sparkSession
    keys = [f.simpleString().split(":", 1) for f in ranked.select(*by).schema]
    fields = "".join(f"`{name}` {kind}, " for name, kind in keys)
    head_table = spark.createDataFrame(head_rows_out, f"{fields}_rank long, _head int")
    zero_table = spark.createDataFrame(zero_rows_out, f"{fields}_npos long, _ends array<long>")
    out = ranked.join(F.broadcast(head_table), [*by, "_rank"], "left")
    out = out.join(F.broadcast(zero_table), by) if by else out.crossJoin(F.broadcast(zero_table))
    zero_bin = F.size(F.filter("_ends", lambda e: e < F.col("_rank") - F.col("_npos")))
    chosen = F.coalesce(F.col("_head"), F.when(positive, tail_bin).otherwise(zero_bin))
    return out.select(*df.columns, chosen.cast("int").alias(label))


def _needed(df: DataFrame, *columns: str | None) -> DataFrame:
    return df.select(*dict.fromkeys(c for c in columns if c))


def _running(values: list) -> list:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def _as_role(label: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), label)


def split_train_test(df: DataFrame, key: str, target: str, test_size: float | int,
                     w: str | None = None, seed: int = 0, by: list[str] | None = None,
                     rows_per_bucket: float | None = None) -> DataFrame:
    """``(*by, key, role)`` with roles train and test."""
    share = test_size if isinstance(test_size, float) else size_proportion(test_size, df.count())
    if not 0 < share < 1:
        raise ValueError("test size must leave rows on both sides")
    out = balanced_labels(_needed(df, *(by or []), key, target, w), key, target,
                          [1 - share, share], w, seed, by, rows_per_bucket=rows_per_bucket)
    return out.select(*(by or []), key, _as_role(F.col("label"), ["train", "test"]).alias("role"))


def split_train_calib_test(df: DataFrame, key: str, target: str, test_size: float | int,
                           calib_size: float | int | None = None, shared: bool = False,
                           w: str | None = None, seed: int = 0) -> DataFrame:
    """``(key, role)``; a shared calibration set repeats the train rows, none leaves it empty."""
    if shared or calib_size is None:
        out = split_train_test(df, key, target, test_size, w, seed)
        return with_shared_calib(out) if shared else out
    n = None if isinstance(test_size, float) and isinstance(calib_size, float) else df.count()
    test, calib = size_proportion(test_size, n), size_proportion(calib_size, n)
    if test + calib >= 1:
        raise ValueError("test and calibration sizes must sum below 1")
    out = balanced_labels(_needed(df, key, target, w), key, target, [1 - test - calib, calib, test],
                          w, seed)
    return out.select(key, _as_role(F.col("label"), ["train", "calib", "test"]).alias("role"))


def with_shared_calib(assignment: DataFrame) -> DataFrame:
    roles = F.when(F.col("role") == "train", F.array(F.lit("train"), F.lit("calib"))).otherwise(
        F.array("role"))
    return assignment.withColumn("role", F.explode(roles))


def stratified_sample(df: DataFrame, key: str, target: str, size: float | int,
                      w: str | None = None, seed: int = 0,
                      rows_per_bucket: float | None = None) -> DataFrame:
    """Keys of a target-balanced sample; all keys when the size covers the data."""
    share = size if isinstance(size, float) else size_proportion(size, df.count())
    if share >= 1:
        return df.select(key)
    out = balanced_labels(_needed(df, key, target, w), key, target, [1 - share, share], w, seed,
                          rows_per_bucket=rows_per_bucket)
    return out.where("label = 1").select(key)


def balanced_folds(df: DataFrame, key: str, target: str, k: int, w: str | None = None,
                   seed: int = 0) -> DataFrame:
    out = balanced_labels(_needed(df, key, target, w), key, target, [1 / k] * k, w, seed,
                          label="fold")
    return out.select(key, "fold")


def block_folds(df: DataFrame, key: str, target: str, k: int, seed: int = 1,
                shuffle: bool = True, rows_per_bucket: float | None = None) -> DataFrame:
    """Fold labels by dealing each block of k neighbours in target order to k folds."""
    base = df.select(key, plain_zero(-F.col(target).cast("double")).alias("_neg"),
                     tie_hash(key).alias("_tie"))
    ranked = ordered_prefix(base, [], "_neg", "_tie", rank="_rank",
                            rows_per_bucket=rows_per_bucket, key=key)
    place = (F.col("_rank") - 1) % k
    if shuffle:
        blocks = ranked.withColumn("_block", F.floor((F.col("_rank") - 1) / k))
        inside = Window.partitionBy("_block").orderBy(tie_hash(key, seed))
        return blocks.select(key, (F.row_number().over(inside) - 1).alias("fold"))
    return ranked.select(key, place.cast("int").alias("fold"))


def cv_assignment(folds: DataFrame, key: str, k: int, calib: str | None = "next") -> DataFrame:
    """``(part, key, role)`` for every part; ``calib`` is 'next', 'shared' or None."""
    part, fold = F.col("_part"), F.col("fold")
    role = F.when(fold == part, F.lit("test"))
    if calib == "next":
        role = role.when(fold == (part + 1) % k, F.lit("calib"))
    out = folds.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    out = out.select(part.cast("string").alias("part"), key,
                     role.otherwise(F.lit("train")).alias("role"))
    return with_shared_calib(out) if calib == "shared" else out


def split_assignment(df: DataFrame, key: str, target: str, settings, w: str | None = None
                     ) -> DataFrame:
    """``(part, key, role)`` under a ``config.Split``: folds, or a single part "0"."""
    target = settings.stratify_column or target
    calib_on = settings.calib_enabled
    if settings.cv_folds:
        folds = balanced_folds(df, key, target, settings.cv_folds, w, settings.seed)
        mode = None if not calib_on else ("shared" if settings.shared_train_calib else "next")
        return cv_assignment(folds, key, settings.cv_folds, mode)
    single = split_train_calib_test(
        df, key, target, settings.test_size,
        settings.calib_size if calib_on else None,
        calib_on and settings.shared_train_calib, w, settings.seed)
    return single.select(F.lit("0").alias("part"), key, "role")


def split_report(df: DataFrame, by: list[str], target: str, w: str) -> DataFrame:
    """Distribution of the target per dataset and part.

    Values are rounded to whole numbers if the mean of the whole target exceeds
    1000; otherwise only the top values are rounded, to two digits.
    """
    y, wt = F.col(target).cast("double"), F.col(w).cast("double")
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"),
        weighted_mean(y, wt).alias("weighted_mean"), F.min(y).alias("min"))
    quantiles = exact_quantiles(df, by, target, REPORT_QUANTILES).groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == q, F.col("quantile"))).alias(_q_name(q))
          for q in REPORT_QUANTILES])
    place = Window.partitionBy(*by).orderBy(F.col("_y").desc())
    top = (df.select(*by, y.alias("_y")).withColumn("_k", F.row_number().over(place))
           .where(F.col("_k") <= TOP_VALUES).groupBy(*by).agg(
        *[F.max(F.when(F.col("_k") == i, F.col("_y"))).alias(f"top_{i}")
          for i in range(1, TOP_VALUES + 1)]))
    overall = df.agg(F.avg(y).alias("_overall"))
    out = base.join(quantiles, by).join(top, by).crossJoin(F.broadcast(overall))
    large = F.col("_overall") > 1000
    tops = [f"top_{i}" for i in range(1, TOP_VALUES + 1)]
    plain = ["weighted_mean", "min", *[_q_name(q) for q in REPORT_QUANTILES]]
    return out.select(
        *by, "n", F.when(large, F.round("mean", 0)).otherwise(F.col("mean")).alias("mean"),
        *[F.when(large, F.round(c, 0)).otherwise(F.col(c)).alias(c) for c in plain],
        *[F.when(large, F.round(c, 0)).otherwise(F.round(c, 2)).alias(c) for c in tops])


def _q_name(q: float) -> str:
    return "q" + f"{q:g}".replace("0.", "_")


def default_quantile_bins(n: int, test_size: float, calib_size: float | None = None) -> int:
    """Bin count that leaves each bin enough rows for every side of the split."""
    sides = [test_size, 1 - test_size] if calib_size is None else [
        test_size, calib_size, 1 - test_size - calib_size]
    least = math.ceil(1 / min(sides))
    return min(max(2, n // least), int(n * test_size / least))


def _merge_small_bins(edges: list[float], counts: dict[int, int], least: int) -> list[int]:
    """Target bin of each bin: small bins go to the nearest large one by midpoint."""
    mids = [(a + b) / 2 for a, b in zip(edges[:-1], edges[1:])]
    large = [b for b in range(len(mids)) if counts.get(b, 0) >= least]
    at = [mids[b] for b in large]
    target = list(range(len(mids)))
    for b in range(len(mids)):
        if counts.get(b, 0) >= least or not large:
            continue
        i = bisect_left(at, mids[b])
        near = [j for j in (i - 1, i) if 0 <= j < len(large)]
        target[b] = large[min(near, key=lambda j: abs(at[j] - mids[b]))]
    return target


def quantile_bins(df: DataFrame, target: str, n_bins: int, least: int = 2,
                  rows_per_bucket: float | None = None) -> DataFrame:
    """``df`` with a ``bin``: right-closed quantile bins, small ones merged.

    ``n_bins`` edges and counts pass through the driver.
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = sorted({r["quantile"] for r in exact_quantiles(
        df, [], target, probs, rows_per_bucket).collect()})
    if len(edges) < 2:
        return df.withColumn("bin", F.lit(0))
    inner = [math.nextafter(e, math.inf) for e in edges[1:-1]]
    binned = df.withColumn("_y", plain_zero(F.col(target)))
    if inner:
        binned = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="_y",
                            outputCol="_bin").transform(binned)
    else:
        binned = binned.withColumn("_bin", F.lit(0.0))
    counts = {int(r["_bin"]): r["count"] for r in binned.groupBy("_bin").count().collect()}
    merged = F.array(*[F.lit(b) for b in _merge_small_bins(edges, counts, least)])
    return binned.withColumn("bin", F.get(merged, F.col("_bin").cast("int"))).drop("_y", "_bin")


def quantile_split(df: DataFrame, key: str, target: str, test_size: float, n_bins: int,
                   calib_size: float | None = None, seed: int = 0,
                   rows_per_bucket: float | None = None) -> DataFrame:
    """``(key, role)``: each quantile bin is split in the same shares, in hash order."""
    rows = quantile_bins(df, target, n_bins, rows_per_bucket=rows_per_bucket).select(
        key, "bin", F.lit(0.0).alias("_v"), tie_hash(key, seed).alias("_tie"))
    ranked = ordered_prefix(rows, ["bin"], "_v", "_tie", rank="_rank", count="_n",
                            rows_per_bucket=rows_per_bucket, key=key)
    n_test = F.round(F.col("_n") * test_size)
    role = F.when(F.col("_rank") <= n_test, F.lit("test"))
    if calib_size is not None:
        n_calib = F.round(F.col("_n") * calib_size)
        role = role.when(F.col("_rank") <= n_test + n_calib, F.lit("calib"))
    return ranked.select(key, role.otherwise(F.lit("train")).alias("role"))
