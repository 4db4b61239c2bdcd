"""Exact percentiles of all groups at once by selection: histograms narrow down where a rank lies, and only that cell is ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.workspace import written

CELLS = 1_024  # cells of a histogram
SMALL = 4_096  # values of a cell that one task may rank


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & a[c].eqNullSafe(b[f"__r_{c}"])
    return on


def exact_percentiles(rows: DataFrame, by: list[str], value: str | Column, shares: dict[str, float], cells: int = CELLS, small: int = SMALL) -> DataFrame:
    """``by`` and, for each name of ``shares``, the percentile of that share (0 to 1), linearly interpolated between the two values
    beside it, as ``percentile`` gives it. Null and NaN values take no part; a group without values has no row.

    A percentile needs the values of one or two ranks. Each round counts the values between a rank's bounds in a histogram of
    ``cells`` cells (combined before it is shuffled) and takes the least and greatest value of the cell that holds the rank for its new bounds;
    all groups and ranks have their rounds together. When no cell that is left has more than ``small`` values, or these are
    all equal, the few values between the bounds are ranked. So no task holds a group, and each round reads two columns.
    """
    v = value if isinstance(value, Column) else F.col(value)
    base = rows.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.lit(0).alias("__all"), v.cast("double").alias("__v"))
    base = written(base.where(F.col("__v").isNotNull() & ~F.isnan("__v")), "values")
    keys = [*[f"__b{i}" for i in range(len(by))], "__all"]
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.lit(up).alias("up")) for name, p in shares.items() for up in (False, True)])
    groups = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    at = (F.col("n") - 1) * F.col("t.p")
    targets = groups.select(*keys, "n", "lo", "hi", F.explode(ranks).alias("t")).withColumn("pos", at).withColumn("rank", F.when(F.col("t.up"), F.ceil("pos")).otherwise(F.floor("pos")))
    targets = written(targets.select(*keys, "t.name", "t.up", "pos", "rank", "lo", "hi", F.lit(0).cast("bigint").alias("before"), F.col("n").alias("inside")), "ranks")
    by_size = False
    while not (wide := targets.where((F.col("lo") < F.col("hi")) & (F.col("inside") > small))).isEmpty():
        counts = _between(base, wide, keys).withColumn("cell", _cell(cells, by_size)).groupBy(*keys, "lo", "hi", "cell").agg(F.count("*").alias("c"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        upto = Window.partitionBy(*keys, "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over at most ``cells`` rows
        counts = counts.withColumn("upto", F.sum("c").over(upto))
        right = counts.select(*[F.col(c).alias(f"__r_{c}") for c in (*keys, "lo", "hi")], "c", "least", "most", "upto")
        met = wide.join(right, _same(wide, right, [*keys, "lo", "hi"])).where((F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("c")))
        narrower = met.select(*keys, "name", "up", "pos", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("upto") - F.col("c")).alias("before"), F.col("c").alias("inside"))
        targets = written(targets.where(~((F.col("lo") < F.col("hi")) & (F.col("inside") > small))).unionByName(narrower), "ranks")
        by_size = not by_size
    few = targets.where("lo < hi")
    order = Window.partitionBy(*keys, "lo", "hi").orderBy("__v")  # over at most ``small`` rows
    placed = _between(base, few, keys).withColumn("r", F.row_number().over(order) - 1)
    right = placed.select(*[F.col(c).alias(f"__r_{c}") for c in (*keys, "lo", "hi")], "__v", "r")
    found = few.join(right, _same(few, right, [*keys, "lo", "hi"])).where("r = rank - before").select(*keys, "name", "up", "pos", "rank", "__v")
    found = found.unionByName(targets.where("lo = hi").select(*keys, "name", "up", "pos", "rank", F.col("lo").alias("__v")))
    out = []
    for name in shares:
        low, high = (F.max(F.when((F.col("name") == name) & (F.col("up") == up), F.struct("__v", "rank", "pos"))) for up in (False, True))
        between = (high["rank"] - low["pos"]) * low["__v"] + (low["pos"] - low["rank"]) * high["__v"]
        out.append(F.when(low["rank"] == high["rank"], low["__v"]).otherwise(between).alias(name))
    return found.groupBy(*keys).agg(*out).select(*[F.col(f"__b{i}").alias(c) for i, c in enumerate(by)], *shares)


def _between(base: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The values within the bounds of each group's targets, once for each pair of bounds."""
    bounds = targets.select(*[F.col(c).alias(f"__r_{c}") for c in keys], "lo", "hi").distinct()
    return base.join(bounds, _same(base, bounds, keys)).where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))).select(*keys, "__v", "lo", "hi")


def _cell(cells: int, by_size: bool) -> Column:
    """The cell of a value between its bounds, in equal steps of the value, or of its order of magnitude: so neither even nor very
    uneven values need many rounds. Halves keep the widest bounds finite."""

    def place(x: Column) -> Column:
        return F.signum(x) * (F.coalesce(F.log2(F.nullif(F.abs(x), F.lit(0.0))), F.lit(0.0)) + 1100) if by_size else x / 2

    low, high = place(F.col("lo")), place(F.col("hi"))
    part = F.coalesce(F.try_divide(place(F.col("__v")) - low, high - low), F.lit(0.0))
    return F.least(F.floor(part * cells), F.lit(cells - 1)).cast("int")
