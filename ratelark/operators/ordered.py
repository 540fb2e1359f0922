"""Global ranks, running sums and exact quantiles without a one-task window.

Rows are cut into value buckets whose edges come from a small hash sample.  A
value that fills several buckets by itself (targets are mostly zero) gets a
bucket of its own, which is cut again along its tie-break hash.  Each bucket is
ordered in its own task; the offsets between buckets come from a table with one
row per bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 16_384
SAMPLE_PER_BUCKET = 100
_SAMPLE_GRAIN = 1 << 24


def tie_hash(key: str, seed: str | int = "") -> Column:
    """Order of equal values: hex SHA-256 of ``seed-key``."""
    return F.sha2(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")), 256)


def plain_zero(value: Column) -> Column:
    """-0.0 and 0.0 sort apart in a binary search, so keep one of them."""
    return F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double"))


@dataclass(frozen=True)
class Buckets:
    """Split points and, per bucket, how many sub-buckets its one value needs."""

    splits: list[float] = field(default_factory=list)
    shares: list[int] = field(default_factory=list)

    @property
    def single(self) -> bool:
        return not self.splits

    def cut(self, tie: str | None) -> bool:
        """Whether some buckets are cut again."""
        return tie is not None and max(self.shares, default=1) > 1


def plan_buckets(df: DataFrame, value: str, mix: list[str],
                 rows_per_bucket: float | None = None) -> Buckets:
    """Choose bucket edges from a deterministic sample of at most ~100 rows per bucket.

    ``mix`` names the columns hashed for sampling; together they should be
    (nearly) unique so that heavy values are sampled in proportion.
    """
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    if rows_per_bucket == math.inf:
        return Buckets()
    n = df.count()
    n_buckets = min(MAX_BUCKETS, math.ceil(n / rows_per_bucket))
    if n_buckets <= 1:
        return Buckets()
    share = SAMPLE_PER_BUCKET * n_buckets / n
    sample = df
    if share < 1:
        limit = max(1, int(share * _SAMPLE_GRAIN))
        sample = df.where(F.pmod(F.xxhash64(*mix), F.lit(_SAMPLE_GRAIN)) < limit)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    edges = sample.agg(
        F.percentile_approx(value, probs, max(10_000, 10 * n_buckets)).alias("e")
    ).first()["e"]
    if not edges:
        return Buckets()
    splits, shares = [-math.inf], [1]
    for edge, run in groupby(edges):
        repeats = len(list(run))
        if edge == splits[-1]:
            shares[-1] = repeats if repeats > 1 else 1
        else:
            splits.append(edge)
            shares.append(repeats + 1 if repeats > 1 else 1)
        if repeats > 1:
            splits.append(math.nextafter(edge, math.inf))
            shares.append(1)
    return Buckets(splits + [math.inf], shares)


def bucket_size(df: DataFrame, rows_per_bucket: float | None = None, factor: int = 1) -> float:
    """Infinity when ``factor`` times ``df`` fits one bucket, else the given size.

    Saves the counting and staging of frames derived from a small one.
    """
    limit = rows_per_bucket or ROWS_PER_BUCKET
    return math.inf if limit == math.inf or df.count() * factor <= limit else limit


def assign_bucket(df: DataFrame, value: str, tie: str | None, buckets: Buckets,
                  bucket_col: str, sub_col: str) -> DataFrame:
    if buckets.single:
        return df.withColumn(bucket_col, F.lit(0)).withColumn(sub_col, F.lit(0))
    out = Bucketizer(splits=buckets.splits, inputCol=value, outputCol=bucket_col,
                     handleInvalid="keep").transform(df)
    out = out.withColumn(bucket_col, F.coalesce(F.col(bucket_col).cast("int"), F.lit(-1)))
    if not buckets.cut(tie):
        return out.withColumn(sub_col, F.lit(0))
    shares = F.array(*[F.lit(s) for s in buckets.shares])
    share = F.coalesce(F.get(shares, F.col(bucket_col)), F.lit(1))
    lead = F.conv(F.substring(tie, 1, 8), 16, 10).cast("long")
    # the hash is only worked out for rows of a heavy value
    return out.withColumn(sub_col, F.when(
        share > 1, F.shiftright(lead * share, 32).cast("int")).otherwise(F.lit(0)))


def derived(df: DataFrame, rows_per_bucket: float | None) -> DataFrame:
    """An aggregated frame as a stage table, since ordering reads it several times.

    Left as it is when known to fit one bucket.
    """
    return df if rows_per_bucket == math.inf else stage(df, "derived")


def ordered_prefix(
    df: DataFrame,
    by: list[str],
    value: str,
    tie: str | None = None,
    sums: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
    rank: str | None = "rank",
    count: str | None = None,
    rows_per_bucket: float | None = None,
    key: str | None = None,
    following: str | None = None,
    late: dict[str, Column] | None = None,
) -> DataFrame:
    """Rank and running sums of each row inside ``by``, ascending in ``(value, tie)``.

    ``sums`` maps output name to summed column (inclusive running sums),
    ``totals`` maps output name to a column summed over the whole of ``by``.
    ``tie`` is a hex hash column that makes the order total; leave it out only
    when ``value`` is unique inside ``by``.  ``value`` is a non-null double.
    ``key`` names the column behind ``tie``, which is cheaper to sample by.
    ``following`` is the output name of the next row's ``value``, null in the last row.
    ``late`` are further columns (such as ``tie``), worked out of ``df`` after rows were dealt to
    buckets, so that they are not shuffled; they follow those of ``df``.
    """
    sums, totals, late = sums or {}, totals or {}, late or {}
    df = df.withColumns(late) if late else df
    order = [F.col(value)] + ([F.col(tie)] if tie else [])
    buckets = plan_buckets(df, value, [*by, value] + ([key or tie] if tie else []),
                           rows_per_bucket)

    if buckets.single:
        run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*by)
        cols = {name: F.sum(col).over(run) for name, col in sums.items()}
        cols.update({name: F.sum(col).over(whole) for name, col in totals.items()})
        if rank:
            cols[rank] = F.count(F.lit(1)).over(run)
        if count:
            cols[count] = F.count(F.lit(1)).over(whole)
        if following:
            cols[following] = F.lead(value).over(Window.partitionBy(*by).orderBy(*order))
        return df.withColumns(cols)

    keyed = assign_bucket(df, value, tie, buckets, "_bkt", "_sub")
    group = [*by, "_bkt", "_sub"]
    dealt = keyed
    if late:
        # by the very columns that the windows are cut by, else these shuffle again; a constant isn't
        # one.  Rows grow behind the shuffle, so its bytes must not decide how many a task sorts.
        dealt = (keyed.drop(*late)
                 .repartition(sum(buckets.shares), *(group if buckets.cut(tie) else group[:-1]))
                 .withColumns(late).select(*keyed.columns))
    inner = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_bkt", "_sub").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)

    needed = sorted(set(sums.values()) | set(totals.values()))
    per_bucket = keyed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in needed],
        *([F.min(value).alias("_lowest")] if following else []))
    offsets = per_bucket.select(
        *group,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0.0)).alias(f"_off_{name}")
          for name, c in sums.items()],
        *[F.sum(f"_s_{c}").over(whole).alias(name) for name, c in totals.items()],
        *([F.sum("_n").over(whole).alias(count)] if count else []),
        *([F.lead("_lowest").over(Window.partitionBy(*by).orderBy("_bkt", "_sub"))
           .alias("_off_next")] if following else []),
    )
    running = {f"_in_{name}": F.sum(c).over(inner) for name, c in sums.items()}
    if rank:
        running["_in_n"] = F.count(F.lit(1)).over(inner)
    if following:
        running["_in_next"] = F.lead(value).over(Window.partitionBy(*group).orderBy(*order))
    out = (dealt.withColumns(running) if running else dealt).join(offsets, group)
    result = [F.col(c) for c in df.columns]
    result += [(F.col(f"_in_{name}") + F.col(f"_off_{name}")).alias(name) for name in sums]
    result += [F.col(name) for name in totals]
    if rank:
        result.append((F.col("_in_n") + F.col("_off_n")).alias(rank))
    if count:
        result.append(F.col(count))
    if following:
        result.append(F.coalesce("_in_next", "_off_next").alias(following))
    return out.select(*result)


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float],
                    rows_per_bucket: float | None = None) -> DataFrame:
    """Linear-interpolation quantiles per ``by``: rows ``(*by, prob, quantile)``.

    Equal values are counted together first, so no task ever holds a whole group.
    """
    rows_per_bucket = bucket_size(df, rows_per_bucket)
    counted = derived(
        df.where(F.col(value).isNotNull())
        .select(*by, plain_zero(F.col(value)).alias("_v"))
        .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), rows_per_bucket)
    ranked = ordered_prefix(counted, by, "_v", sums={"_cum": "_n"}, totals={"_tot": "_n"},
                            rank=None, rows_per_bucket=rows_per_bucket)
    first, last = F.col("_cum") - F.col("_n"), F.col("_cum") - 1

    def place(p: Column) -> Column:
        h = (F.col("_tot") - 1) * p
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("_tot") - 1)
        return F.struct(p.alias("prob"), (h - lo).alias("frac"),
                        lo.between(first, last).alias("at_lo"),
                        hi.between(first, last).alias("at_hi"))

    wanted = F.array(*[F.lit(float(p)) for p in probs])
    hits = F.filter(F.transform(wanted, place), lambda s: s["at_lo"] | s["at_hi"])
    found = ranked.select(*by, "_v", F.explode(hits).alias("s"))
    return found.groupBy(*by, F.col("s.prob").alias("prob")).agg(
        (F.max(F.when(F.col("s.at_lo"), F.col("_v")))
         + F.max("s.frac")
         * (F.max(F.when(F.col("s.at_hi"), F.col("_v")))
            - F.max(F.when(F.col("s.at_lo"), F.col("_v"))))).alias("quantile"))


def rank_lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str,
                total: str, max_hot: int = 1000, how: str = "inner") -> DataFrame:
    """Join (inner or left) ``rows`` to a one-row-per-key ``table`` when some keys are hot.

    A key is hot when its ``weight`` (row count) exceeds ``1/max_hot`` of its
    group's ``total``, so a group has at most ``max_hot`` hot keys and they can
    be broadcast; the remaining keys are light and go through an ordinary join.
    """
    is_hot = F.col(weight) * max_hot > F.col(total)
    hot = F.broadcast(table.where(is_hot).drop(weight, total))
    light = table.where(~is_hot).drop(weight, total)
    cold_rows = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold_rows.join(light, keys, how))


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], max_hot: int = 1000,
             how: str = "inner") -> DataFrame:
    """Join (inner or left) to a one-row-per-key ``table`` when the row counts per key are not known
    yet.

    Keys holding more than ``1/max_hot`` of all rows (at most ``max_hot`` of
    them) are looked up by broadcast, the others by an ordinary join.
    """
    limit = rows.count() / max_hot
    hot_keys = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                     .where(F.col("_n") > limit).select(*keys), "hot")
    if hot_keys.isEmpty():
        return rows.join(table, keys, how)
    hot_keys = F.broadcast(hot_keys)
    hot_table = F.broadcast(table.join(hot_keys, keys, "left_semi"))
    cold = rows.join(hot_keys, keys, "left_anti").join(table, keys, how)
    hot = rows.join(hot_keys, keys, "left_semi").join(hot_table, keys, how)
    return hot.unionByName(cold)


def value_neighbours(queries: DataFrame, table: DataFrame, by: list[str], at: str, value: str,
                     rows_per_bucket: float | None = None) -> DataFrame:
    """For each distinct ``at`` of ``queries`` the entries (at, v) of ``table`` on both sides.

    Both frames are merged in value order: ``prev`` is the last table row up to ``at``, ``next`` the
    first one from it on (null beyond the ends).
    """
    entry = F.struct(F.col(at).alias("at"), F.col(value).alias("v"))
    merged = (table.select(*by, F.col(at).alias("_at"), entry.alias("_e"), F.lit(False).alias("_q"))
              .unionByName(queries.select(*by, F.col(at).alias("_at"),
                                          F.lit(None).cast(_entry_type(table, at, value)).alias("_e"),
                                          F.lit(True).alias("_q")).distinct())
              .groupBy(*by, "_at").agg(F.max("_e").alias("_e"), F.max("_q").alias("_q")))
    merged = derived(merged, rows_per_bucket)
    buckets = plan_buckets(merged, "_at", [*by, "_at"], rows_per_bucket)
    keyed = assign_bucket(merged, "_at", None, buckets, "_bkt", "_sub")
    # looking ahead is looking back in descending order: frames that only grow stay linear
    bucket = Window.partitionBy(*by, "_bkt")
    upto = bucket.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    onward = bucket.orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumns({"_prev": F.last("_e", ignorenulls=True).over(upto),
                               "_next": F.last("_e", ignorenulls=True).over(onward)})
    ends = keyed.groupBy(*by, "_bkt").agg(F.max("_e").alias("_hi"), F.min("_e").alias("_lo"))
    order = Window.partitionBy(*by)
    earlier = order.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    later = order.orderBy(F.col("_bkt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_bkt", F.max("_hi").over(earlier).alias("_before"),
                       F.min("_lo").over(later).alias("_after"))
    found = keyed.where("_q").join(ends, [*by, "_bkt"])
    return found.select(*by, F.col("_at").alias(at),
                        F.coalesce(F.col("_prev"), F.col("_before")).alias("prev"),
                        F.coalesce(F.col("_next"), F.col("_after")).alias("next"))


def nearest_value(queries: DataFrame, table: DataFrame, by: list[str], at: str, value: str,
                  rows_per_bucket: float | None = None) -> DataFrame:
    """For each distinct ``at`` of ``queries`` the ``value`` of the nearest ``at`` in ``table``.

    The smaller ``at`` wins a draw.
    """
    found = value_neighbours(queries, table, by, at, value, rows_per_bucket)
    prev, nxt = F.col("prev"), F.col("next")
    pick = F.when(prev.isNull(), nxt["v"]).when(nxt.isNull(), prev["v"]).when(
        F.col(at) - prev["at"] <= nxt["at"] - F.col(at), prev["v"]).otherwise(nxt["v"])
    return found.select(*by, at, pick.alias(value))


def _entry_type(table: DataFrame, at: str, value: str):
    return table.select(F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("e")) \
        .schema["e"].dataType
