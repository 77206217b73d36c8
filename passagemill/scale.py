"""Size checks and hot-group handling shared by the operators.

Three decisions are taken from measured sizes instead of being assumed:

* ``broadcast_if_small`` broadcasts a side only after counting it;
* ``spread`` re-partitions an input only when it has fewer partitions than the cluster has slots;
* ``OrderedGroups`` cuts groups that are too big for one task into ordered blocks, so that running
  sums, look-backs and look-aheads inside a group never need the whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window, WindowSpec

from .session import checkpointed

# Largest row count that is broadcast; the rows broadcast here are short (ids, terms, counters).
BROADCAST_ROWS = 1_000_000
# Groups above this many rows are cut into blocks.
GROUP_ROWS = 2_000_000
# Parts of a group of which only the first rows are wanted.
FIRST_PARTS = 32

BLOCK = "_block"
CONTEXT = "_context"


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when df has at most max_rows rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a count; a bigger side is left to a shuffled join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a narrow input (one small file) as many partitions as there are slots.

    Inputs of cluster size already have more partitions than slots and pass unchanged.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often later expressions read them.

    The optimizer merges neighbouring projections, which repeats an expression at every place that reads
    it (inside lambdas once per element). A one-element explode keeps the projections apart.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(packed)).alias("_computed")).select(*kept, "_computed.*")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows numbered from 0 without gaps in the order of a unique key: ranges are numbered side by side, and only their
    row counts are added up in one place."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    ranged = checkpointed(df.repartitionByRange(max(slots, df.rdd.getNumPartitions()), key)
                          .withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return (ranged.withColumn(name, inside).join(F.broadcast(before), "_range")
            .withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: Column, name: str,
               parts: int = FIRST_PARTS) -> DataFrame:
    """The first ``limit`` rows of every group, numbered from 1 in the column ``name``.

    ``limit`` may read the keys. A group is cut in parts by a hash of its rows and each part to ``limit`` rows before
    they meet, so no task holds a hot group, whatever the limit. ``order`` must leave no ties.
    """
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(parts))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    some = df.withColumn("_part", part).withColumn("_n", F.row_number().over(inside)).filter(F.col("_n") <= limit)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return some.drop("_part", "_n").withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= limit)


def order_number(column: Column, data_type: T.DataType) -> Column:
    """Ordering column as a double, so that quantiles can cut it."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return column.cast("double")


class OrderedGroups:
    """Rows grouped by ``keys`` and ordered by ``order`` (a unique order inside the group).

    A group of more than ``group_rows`` rows is cut into blocks of about half as many, so cut points are fewer than
    four per ``group_rows`` rows of input. Without hot groups all methods reduce to plain windows.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 group_rows: int = GROUP_ROWS):
        self.keys = list(keys)
        self.order = list(order)
        cuts = self._cut_points(df, group_rows)
        self.is_cut = cuts is not None
        self.df = self._with_block(df, cuts) if self.is_cut else df

    def _cut_points(self, df: DataFrame, group_rows: int) -> DataFrame | None:
        sizes = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        hot = checkpointed(sizes.filter(F.col("_n") > group_rows))
        largest = hot.agg(F.max("_n")).first()[0]
        if largest is None:
            return None
        parts = lambda n: F.ceil(n * 2 / F.lit(group_rows)).cast("int")
        finest = -(-2 * largest // group_rows)
        leading = self.order[0]
        number = order_number(F.col(leading), df.schema[leading].dataType)
        shares = [i / finest for i in range(1, finest)]
        # Quantiles as fine as the largest group needs; smaller groups keep every so many of them.
        quantiles = (df.join(broadcast_if_small(hot), self.keys).groupBy(*self.keys, "_n")
                     .agg(F.percentile_approx(number, shares, max(10_000, 10 * finest)).alias("_all")))
        step = F.lit(finest) / parts(F.col("_n"))
        kept = F.transform(F.sequence(F.lit(1), parts(F.col("_n")) - 1),
                           lambda i: F.element_at("_all", F.floor(i * step).cast("int")))
        return checkpointed(quantiles.select(*self.keys, F.array_distinct(kept).alias("_cuts")))

    def _with_block(self, df: DataFrame, cuts: DataFrame) -> DataFrame:
        leading = self.order[0]
        number = order_number(F.col(leading), df.schema[leading].dataType)
        block = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < number)), F.lit(0))
        return (
            df.join(broadcast_if_small(cuts), self.keys, "left")
            .withColumn(BLOCK, F.when(F.col("_cuts").isNull(), 0).otherwise(block))
            .withColumn("_hot", F.col("_cuts").isNotNull())
            .drop("_cuts")
        )

    def replace(self, df: DataFrame) -> "OrderedGroups":
        """Same cuts over derived rows that kept the helper columns."""
        clone = object.__new__(OrderedGroups)
        clone.__dict__.update(self.__dict__)
        clone.df = df
        return clone

    def window(self) -> WindowSpec:
        """Window over one block of one group."""
        parts = [*self.keys, BLOCK] if self.is_cut else self.keys
        return Window.partitionBy(*parts).orderBy(*self.order)

    def plain(self) -> DataFrame:
        """Rows without the helper columns."""
        return self.df.drop(BLOCK, "_hot", CONTEXT)

    def running(self, name: str, value: Column, how: str = "sum") -> "OrderedGroups":
        """Running ``sum`` or ``max`` of value from the start of the group to the current row."""
        fold = {"sum": F.sum, "max": F.max}[how]
        df = self.df.withColumn("_v", value)
        to_here = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = fold("_v").over(to_here)
        if not self.is_cut:
            return self.replace(df.withColumn(name, local).drop("_v"))
        before = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            df.filter("_hot")
            .groupBy(*self.keys, BLOCK)
            .agg(fold("_v").alias("_t"))
            .select(*self.keys, BLOCK, fold("_t").over(before).alias("_carried"))
        )
        joined = df.withColumn(name, local).join(broadcast_if_small(carried), [*self.keys, BLOCK], "left")
        if how == "sum":
            total = F.col(name) + F.coalesce(F.col("_carried"), F.lit(0))
            total = F.coalesce(total, F.col("_carried"))
        else:
            total = F.greatest(F.col(name), F.col("_carried"))
        return self.replace(joined.withColumn(name, total).drop("_v", "_carried"))

    def with_neighbours(self, before: int = 0, after: int = 0) -> "OrderedGroups":
        """Add to every block the rows just outside it, flagged in CONTEXT, so that frames of that many
        rows are complete. Use ``own_rows`` after the window to drop them."""
        if not self.is_cut:
            return self.replace(self.df.withColumn(CONTEXT, F.lit(False)))
        hot = self.df.filter("_hot")
        extra = []
        for rows, ahead in ((before, False), (after, True)):
            if rows:
                extra.append(self._edge_rows(hot, rows, ahead))
        base = self.df.withColumn(CONTEXT, F.lit(False))
        return self.replace(reduce(lambda a, b: a.unionByName(b), extra, base))

    def _edge_rows(self, hot: DataFrame, rows: int, ahead: bool) -> DataFrame:
        # The nearest `rows` rows of each block are enough for its neighbours: an edge is at most `rows` long,
        # and the last `rows` non-empty blocks hold at least that many rows.
        columns = hot.columns
        reverse = [F.col(c) if ahead else F.col(c).desc() for c in self.order]
        near = Window.partitionBy(*self.keys, BLOCK).orderBy(*reverse)
        edge = hot.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= rows)
        packed = edge.groupBy(*self.keys, BLOCK).agg(
            F.collect_list(F.struct(*[F.col(c) for c in self.order],
                                    F.struct(*[F.col(c).alias(c) for c in columns]).alias("_row"))).alias("_edge"))
        blocks = Window.partitionBy(*self.keys).orderBy(BLOCK)
        frame = blocks.rowsBetween(1, rows) if ahead else blocks.rowsBetween(-rows, -1)
        gathered = F.array_sort(F.flatten(F.collect_list("_edge").over(frame)))
        wanted = F.slice(gathered, 1, rows) if ahead else F.when(
            F.size(gathered) > rows, F.slice(gathered, -rows, rows)).otherwise(gathered)
        target = F.col(BLOCK).alias("_target")
        return (
            packed.select(target, wanted.alias("_edge"))
            .select("_target", F.explode("_edge").alias("_e"))
            .select("_target", "_e._row.*")
            .withColumn(BLOCK, F.col("_target"))
            .drop("_target")
            .withColumn(CONTEXT, F.lit(True))
        )

    def own_rows(self) -> "OrderedGroups":
        """Drop the rows that with_neighbours added."""
        return self.replace(self.df.filter(~F.col(CONTEXT)).drop(CONTEXT))

