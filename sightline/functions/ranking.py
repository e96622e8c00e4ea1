"""Exact ranks that never gather a whole group in one task.

A cross-section (a month, a run, a sector) may hold a large share of all rows,
so no window here is partitioned by the group alone. Two plans do the work:

``value_ladder``
    Counts per distinct value first (partial aggregation), then running counts
    inside narrow value buckets plus one small table of bucket totals. The
    bucket of a value is a fixed monotone function of the double itself, so it
    needs no sampling and is the same in every branch and retry.

``positions``
    Row numbers for a total order over several keys. Each group is cut by keys
    picked through a hash (about ``SLOTS`` per group), rows are numbered inside
    their cut, and the totals of the cuts before are added.

With ``sized`` both first count the rows of each group (combined before the shuffle): groups of at most ``GATHER`` rows are
ranked by a window each, so their rows are shuffled once; larger ones take the plans above. The input is read three times
then, so it should be a stored stage.

``in_groups`` goes further where a whole plan stays inside groups: rows of groups of at most ``DEALT`` rows are dealt to
tasks once, and every step of the plan with ``dealt`` ranks them where they are.

Both need keys that are reproducible across branches: stored, or rounded.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.scalars import finite, half_even

STEPS_PER_OCTAVE = 1024
SLOTS = 48
#: Rows of a group that one task may rank.
GATHER = 200_000
#: Rows of a group that ``in_groups`` deals to one task; its plans make a few dozen narrow rows of each.
DEALT = 100_000


def magnitude_bucket(value: str | Column) -> Column:
    """A monotone integer bucket of a finite double: 1024 steps per power of two."""
    number = F.col(value) if isinstance(value, str) else value
    size = F.abs(number)
    exponent = F.floor(F.log2(size)).cast("double")
    step = F.floor(size / F.pow(F.lit(2.0), exponent) * STEPS_PER_OCTAVE)
    index = (exponent * (2 * STEPS_PER_OCTAVE) + step + 4_000_000).cast("bigint")
    return F.when(number > 0, index).when(number < 0, -index).otherwise(F.lit(0).cast("bigint"))


def grouped(frame: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add ``__g``, the group as one struct: it is never null, so rows with null groups meet in joins as in ``groupBy``."""
    return frame.withColumn("__g", F.struct(*[F.col(name) for name in groups] or [F.lit(0).alias("all")]))


def join_groups(left: DataFrame, right: DataFrame, groups: Sequence[str], how: str = "inner", also: Sequence[str] = ()) -> DataFrame:
    """Join two frames on their groups, null groups included, and on the ``also`` columns as usual."""
    return grouped(left, groups).join(grouped(right, groups).drop(*groups), ["__g", *also], how).drop("__g")


def _running(frame: DataFrame, bucket: str, weight: str) -> DataFrame:
    """Per (__g, bucket): weight before it and the group's total weight.

    The window sees one row per bucket, never one per data row.
    """
    sizes = frame.groupBy("__g", bucket).agg(F.sum(weight).alias("__size"))
    whole = Window.partitionBy("__g")
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "__g", bucket,
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"),
        F.sum("__size").over(whole).alias("total"),
    )


def value_ladder(frame: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """One row per (group, distinct value): ``n`` rows hold it, ``below`` are smaller, of ``total``.

    Null, NaN and infinite values have no rung. A null group is a group.
    """
    counts = (
        grouped(frame, groups).where(finite(value).isNotNull())
        .groupBy("__g", value).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("__b", magnitude_bucket(F.col(value).cast("double")))
    )
    fences = _running(counts, "__b", "n")
    inside = Window.partitionBy("__g", "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(fences, ["__g", "__b"]).select(
        *[F.col(f"__g.{name}") for name in groups], value, "n",
        (F.col("__start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"),
        "total",
    )


def by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of groups ``__g`` of at most ``GATHER`` rows, whole groups to a task, and all other rows.

    There is at most one large group for every ``GATHER`` rows, so their list is short and is broadcast.
    """
    large = F.broadcast(rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > GATHER).select("__g"))
    return rows.join(large, "__g", "left_anti").repartition("__g"), rows.join(large, "__g", "left_semi")


def in_groups(rows: DataFrame, groups: Sequence[str], plan: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``plan(part, dealt)`` of stored ``rows``: of groups of at most ``DEALT`` rows, dealt whole to tasks, and of all others.

    The plan keeps to the groups, so with ``dealt`` none of its steps shuffles rows again; a part without rows has no plan.
    The groups are counted first. There are enough tasks that most have a group or two, whatever the settings.
    """
    spark = rows.sparkSession
    keyed = grouped(rows, groups)
    sizes = keyed.groupBy("__g").agg(F.count(F.lit(1)).alias("__size"))
    most, number, total = sizes.agg(F.max("__size"), F.count(F.lit(1)), F.sum("__size")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * number, (total or 0) // 25_000))
    if (most or 0) <= DEALT:
        return plan(rows.repartition(parts, *groups), True)
    large = F.broadcast(sizes.where(F.col("__size") > DEALT).select("__g"))
    small = keyed.join(large, "__g", "left_anti").drop("__g").repartition(parts, *groups)
    return plan(small, True).unionByName(plan(keyed.join(large, "__g", "left_semi").drop("__g"), False))


def ladder_over(groups: Sequence[str | Column], value: str | Column) -> tuple[Column, Column, Column]:
    """n, below and total of the finite ``value`` by one window; null where the value is none. For dealt rows."""
    # Adding zero makes one value of 0.0 and -0.0.
    number = finite(value) + 0.0
    own = Window.partitionBy(*groups, number.isNotNull()).orderBy(number)
    below = F.rank().over(own).cast("bigint") - 1
    until = F.count(F.lit(1)).over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return tuple(F.when(number.isNotNull(), column) for column in (until - below, below, total))


def attach_ladders(frame: DataFrame, groups: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """``attach_ladder`` of several columns, values[prefix]; the groups are counted first (see ``sized`` above)."""
    others = [name for name in frame.columns if name not in groups]
    names = [prefix + name for prefix in values for name in ("n", "below", "total")]
    small, large = by_size(grouped(frame, groups).select("__g", *others))
    for prefix, value in values.items():
        # Adding zero makes one value of 0.0 and -0.0.
        small = small.withColumn("__v", finite(value) + 0.0).withColumn("__known", F.col("__v").isNotNull())
        known = Window.partitionBy("__g", "__known")
        found = {
            "n": F.count(F.lit(1)).over(Window.partitionBy("__g", "__known", "__v")),
            "below": F.rank().over(known.orderBy("__v")).cast("bigint") - 1,
            "total": F.count(F.lit(1)).over(known),
        }
        small = small.select("__g", "__known", *[c for c in small.columns if c not in ("__g", "__known", "__v")], *[
            column.alias(f"__{name}") for name, column in found.items()])
        small = small.withColumns({prefix + name: F.when(F.col("__known"), F.col(f"__{name}")) for name in found}).drop(
            "__known", *[f"__{name}" for name in found])
    whole = [F.col("__g")[name].alias(name) if name in groups else F.col(name) for name in frame.columns]
    rest = large.select(*whole)
    for prefix, value in values.items():
        rest = attach_ladder(rest, groups, value, prefix)
    return small.select(*whole, *names).unionByName(rest)


def attach_ladder(frame: DataFrame, groups: Sequence[str], value: str, prefix: str = "", sized: bool = False) -> DataFrame:
    """Rows with their ladder columns; rows without a finite value get nulls."""
    if sized and groups:
        return attach_ladders(frame, groups, {prefix: value})
    rungs = value_ladder(frame, groups, value)
    rungs = rungs.select(
        *groups, value,
        *[F.col(name).alias(prefix + name) for name in ("n", "below", "total")],
    )
    return join_groups(frame, rungs, groups, "left", [value]).select(
        *frame.columns, *[prefix + name for name in ("n", "below", "total")])


# Percentile conventions. They differ on purpose; each names its formula.

def _average_rank(n: str, below: str) -> Column:
    return F.col(below) + (F.col(n) + 1) / 2.0


def percent_spread(n: str = "n", below: str = "below", total: str = "total", *,
                   alone: float = 50.0, digits: int | None = None) -> Column:
    """(average rank - 1) / (count - 1) * 100; ``alone`` when the group has one row."""
    value = (_average_rank(n, below) - 1.0) / F.nullif(F.col(total) - 1, F.lit(0)) * 100.0
    value = F.when(F.col(total) == 1, F.lit(alone)).otherwise(value)
    return half_even(value, digits) if digits is not None else value


def percent_at_or_below(n: str = "n", below: str = "below", total: str = "total") -> Column:
    """(count at or below - 1) / (count - 1) * 100, rounded 2; 100 when alone."""
    value = (F.col(below) + F.col(n) - 1) / F.nullif(F.col(total) - 1, F.lit(0)) * 100.0
    return half_even(F.when(F.col(total) == 1, F.lit(100.0)).otherwise(value), 2)


def rank_share(n: str = "n", below: str = "below", total: str = "total") -> Column:
    """Average rank over count, in (0, 1]."""
    return _average_rank(n, below) / F.col(total)


def percent_half_ties(below: Column, equal: Column, total: Column) -> Column:
    """(below + half of equal) / total * 100 against a list that leaves the subject out."""
    return half_even((below + equal / 2.0) / F.nullif(total, F.lit(0)) * 100.0, 1)


def descending_minimum_rank(n: str = "n", below: str = "below", total: str = "total") -> Column:
    """Rank 1 for the largest value; ties share the smallest rank."""
    return (F.col(total) - F.col(below) - F.col(n) + 1).cast("bigint")


def positions(frame: DataFrame, groups: Sequence[str], order: Sequence[Column], *,
              name: str = "position", total: str | None = None, sized: bool = False, dealt: bool = False) -> DataFrame:
    """Add 1-based row numbers of a total order inside each group.

    ``order`` lists ascending keys (negate numbers for descending order); the
    last one must be unique inside a group.
    """
    columns = frame.columns
    if dealt:
        own = Window.partitionBy(*groups).orderBy(*order)
        members = F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return frame.select(*columns, F.row_number().over(own).cast("bigint").alias(name), *[members.alias(total)] * bool(total))
    if sized and groups:
        small, large = by_size(grouped(frame, groups))
        whole = Window.partitionBy("__g")
        numbered = small.withColumn("__p", F.row_number().over(whole.orderBy(*order)).cast("bigint")).withColumn(
            "__n", F.count(F.lit(1)).over(whole))
        numbered = numbered.select(*columns, F.col("__p").alias(name), *[F.col("__n").alias(total)] * bool(total))
        return numbered.unionByName(positions(large.select(*columns), groups, order, name=name, total=total))
    rows = grouped(frame, groups).withColumn("__k", F.struct(*[key.alias(f"k{i}") for i, key in enumerate(order)]))
    picked = rows.groupBy("__g", F.pmod(F.xxhash64("__k"), F.lit(SLOTS)).alias("__slot")).agg(
        F.min_by("__k", F.xxhash64("__k", F.lit(17))).alias("__k"),
    )
    cuts = picked.groupBy("__g").agg(F.array_sort(F.collect_list("__k")).alias("__cuts"))
    if not groups:  # one row of at most SLOTS keys
        cuts = F.broadcast(cuts)
    placed = rows.join(cuts, "__g").withColumn(
        "__b", F.size(F.filter("__cuts", lambda edge: edge < F.col("__k"))),
    ).drop("__cuts")
    fences = _running(placed.withColumn("__one", F.lit(1)), "__b", "__one")
    if not groups:  # at most SLOTS + 1 rows
        fences = F.broadcast(fences)
    inside = Window.partitionBy("__g", "__b").orderBy("__k")
    numbered = placed.join(fences, ["__g", "__b"]).withColumn(
        name, (F.col("__start") + F.row_number().over(inside)).cast("bigint"),
    )
    kept = [*columns, name]
    if total:
        numbered = numbered.withColumnRenamed("total", total)
        kept.append(total)
    return numbered.select(*kept)


def leading(frame: DataFrame, groups: Sequence[str], order: Sequence[Column], limit: int,
            name: str = "position") -> DataFrame:
    """The first ``limit`` rows per group.

    The rank filter sits directly on the window, so Spark keeps at most
    ``limit`` rows per group and task before it shuffles.
    """
    window = Window.partitionBy("__g").orderBy(*order)
    kept = grouped(frame, groups).withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)
    return kept.drop("__g")


def first_rows(frame: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the first in ``order``, then by all other columns, so the result never depends on partitions.

    A combined ``min_by``: a key with many rows is no hot group.
    """
    rest = [name for name in frame.columns if name != key]
    rank = F.struct(*[part.alias(f"k{i}") for i, part in enumerate(order)], *[F.col(name).alias(f"r{i}") for i, name in enumerate(rest)])
    return frame.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("x")).select(key, "x.*").select(*frame.columns)


# Bucket conventions.

def edge_bucket(order_value: Column, total: Column, quantiles: int) -> Column:
    """Quantile-cut bucket of 1..n order values: 0 for the lowest fifth and so on."""
    scaled = (order_value - 1) * quantiles / F.nullif(total - 1, F.lit(0))
    return F.greatest(F.ceil(scaled) - 1, F.lit(0)).cast("int")


def floor_bucket(position: Column, total: Column, quantiles: int) -> Column:
    """floor(index * q / n) of a 1-based position, counted from 0."""
    return F.least(F.floor((position - 1) * quantiles / total), F.lit(quantiles - 1)).cast("int")
