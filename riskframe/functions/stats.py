"""Distributed statistics helpers."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import PARTITION_BYTES, range_partitions


def percentiles(df: DataFrame, col: str, probs: dict, group=None, approx: bool = False,
                accuracy: int = 100000) -> DataFrame:
    """Linear-interpolated percentiles (NumPy/DuckDB ``quantile_cont`` semantics).

    Exact mode uses Spark's ``percentile`` aggregate, whose buffer is a
    value -> count map merged map-side, so its size is the number of *distinct*
    values per group, not rows.  ``approx=True`` switches to the mergeable
    ``percentile_approx`` sketch for unbounded-cardinality columns.
    """
    keys = [group] if isinstance(group, str) else list(group or [])
    names = list(probs)
    ps = [float(probs[n]) for n in names]
    c = F.col(col).cast("double")
    arr = F.percentile_approx(c, ps, accuracy) if approx else F.percentile(c, F.array(*[F.lit(p) for p in ps]))
    agg = df.groupBy(*keys).agg(arr.alias("_q")) if keys else df.agg(arr.alias("_q"))
    return agg.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def median(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.percentile(c.cast("double"), F.lit(0.5))


#: Size of the sketches, and the share of ranks by which brackets are wider than the wanted ranks on both
#: sides: twice the sketch's rank error at 99 % (2.296 / k ** 0.9021).
SKETCH_K = 4096
MARGIN = 2 * 2.296 / SKETCH_K ** 0.9021
#: Buckets per octave of the first pass without a sketch, and per range of the later ones.
OCTAVE, RANGE = 256, 1 << 16


def _coarse(x):
    """Bucket of the first pass: sign and logarithm; zero and the infinities have their own."""
    inf = F.lit(float("inf"))
    return (F.when(x == 0, 0).when(F.abs(x) == inf, F.signum(x) * 600000)
            .otherwise(F.signum(x) * (F.floor(F.log2(F.abs(x)) * OCTAVE) + 300000))).cast("int")


def _ranks(n, probs):
    """The 0-based ranks around each probability's position."""
    low = [F.floor(F.lit(float(p)) * (n - 1)).cast("long") for p in probs]
    return F.array_distinct(F.array(*low, *[F.least(r + 1, n - 1) for r in low]))


def _holding(hist: DataFrame, keys, order) -> DataFrame:
    """Buckets that hold a wanted rank, with the rows before them and the ranks they hold."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = hist.withColumn("below", F.col("below") + F.coalesce(F.sum("c").over(running), F.lit(0)))
    held = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c")))
    return placed.withColumn("ranks", held).where(F.size("ranks") > 0)


def _interpolated(at: DataFrame, probs: dict) -> DataFrame:
    """The quantiles of each group from its wanted ranks: ``at`` holds g, n, ranks and x."""
    at = at.select("g", "n", F.explode("ranks").alias("r"), "x").groupBy("g").agg(
        F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("v"))

    def value(p):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(pos).cast("long")
        a, b = F.col("v")[low], F.col("v")[F.least(low + 1, F.col("n") - 1)]
        return F.when((a == b) | (pos == low), a).otherwise(a + (pos - low) * (b - a))

    return at.select("g", *[value(p).alias(k) for k, p in probs.items()])


def _quantiles_by_buckets(x: DataFrame, probs: dict, few_groups: bool) -> DataFrame:
    """Exact quantiles of ``x(g, x)`` per group in four scans, whatever the distribution.

    Every pass counts rows per group and bucket (a partial + final aggregate) and keeps the buckets
    that hold a wanted rank: buckets of the logarithm, then twice equal-width buckets between the
    least and the greatest value of the bucket kept.  After that a bucket spans fewer than 2**13
    neighbouring doubles, whose distinct values are counted and put in order.
    """
    count = [F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    hist = x.groupBy("g", _coarse(F.col("x")).alias("b")).agg(*count)
    n = F.sum("c").over(Window.partitionBy("g"))
    hist = hist.withColumn("n", n).withColumn("below", F.lit(0).cast("long")) \
               .withColumn("ranks", _ranks(F.col("n"), probs.values()))
    kept = _holding(hist, ["g"], "b")
    keys = ["g", "n", "rlo", "rhi", "below", "ranks"]

    def rows():
        ranges = kept.select("g", "n", F.col("lo").alias("rlo"), F.col("hi").alias("rhi"), "below", "ranks")
        return x.join(F.broadcast(ranges) if few_groups else ranges, "g").where("x >= rlo and x <= rhi")

    for _ in range(2):
        width = F.when(F.col("rhi") == F.col("rlo"), 0).otherwise(
            F.least(F.floor((F.col("x") - F.col("rlo")) / (F.col("rhi") - F.col("rlo")) * RANGE), F.lit(RANGE - 1)))
        kept = _holding(rows().groupBy(*keys, width.cast("int").alias("b")).agg(*count), ["g", "rlo"], "b")
    return _interpolated(_holding(rows().groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c")), ["g", "rlo"], "x"), probs)


def _brackets(x: DataFrame, probs) -> DataFrame:
    """Per group a range of values around each probability, from one mergeable KLL sketch.

    Groups of a few rows, whose neighbouring ranks are further apart than the margin, lie inside as a whole.
    """
    s = x.groupBy("g").agg(F.kll_sketch_agg_double("x", SKETCH_K).alias("s"), F.count(F.lit(1)).alias("n"))

    def bound(rank, end):
        if not 0 < rank < 1:
            return F.lit(end)
        return F.when(F.col("n") < 4 / MARGIN, F.lit(end)).otherwise(F.kll_sketch_get_quantile_double("s", F.lit(rank)))

    inf = float("inf")
    return s.select("g", *[c for i, p in enumerate(probs) for c in (bound(p - MARGIN, -inf).alias(f"lo{i}"),
                                                                    bound(p + MARGIN, inf).alias(f"hi{i}"))])


def _quantiles(x: DataFrame, probs: dict, few_groups: bool) -> DataFrame:
    """Exact linear-interpolated quantiles of ``x(g, x)`` per group, in two scans at any size.

    The first scan builds a KLL sketch per group, which brackets every wanted rank.  The second counts
    the rows before, between and after the brackets, one row per group and gap, and the distinct values
    inside them (about ``2 * MARGIN`` of the rows per probability), which are range-partitioned and
    stored.  Ranks are then counted over that table alone, so the result is exact whatever the sketch
    drew.  If a rank lies outside its bracket, the groups concerned take four scans instead.
    ``few_groups`` says that the number of groups is fixed, so that brackets and offsets may be broadcast.
    """
    ps = sorted({float(p) for p in probs.values()})
    small = F.broadcast if few_groups else (lambda df: df)
    # a sketch that is computed again may differ, so brackets that Spark could recompute are stored
    brackets = _brackets(x, ps)
    brackets = F.broadcast(brackets) if few_groups else _stored(brackets, "brackets")
    seg = F
    for i in range(len(ps)):
        seg = seg.when(F.col("x") < F.col(f"lo{i}"), 2 * i).when(F.col("x") <= F.col(f"hi{i}"), 2 * i + 1)
    counted = x.join(brackets, "g").select("g", "x", seg.otherwise(2 * len(ps)).alias("seg")) \
               .groupBy("g", "seg", F.when(F.col("seg") % 2 == 1, F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    parts = range_partitions(counted, int(PARTITION_BYTES / (2 * MARGIN * len(ps))))
    counted = _stored(counted.repartitionByRange(parts, "g", "seg", "x").withColumn("pid", F.spark_partition_id()), "bracketed")
    totals = counted.groupBy("g", "pid", "seg").agg(F.sum("c").alias("c")) \
                    .withColumn("n", F.sum("c").over(Window.partitionBy("g"))).withColumn("below", F.lit(0).cast("long")) \
                    .withColumn("ranks", _ranks(F.col("n"), probs.values()))
    kept = _holding(totals, ["g"], F.struct("pid", "seg")).drop("c")
    missed = kept.where("seg % 2 = 0").select("g")
    last = _holding(counted.join(small(kept), ["g", "pid", "seg"]), ["g", "pid", "seg"], "x")
    if missed.isEmpty():
        return _interpolated(last, probs)
    missed = _stored(missed.distinct(), "missed")
    again = _quantiles_by_buckets(x.join(small(missed), "g", "left_semi"), probs, few_groups)
    return _interpolated(last.join(small(missed), "g", "left_anti"), probs).unionByName(again)


def _valued(df: DataFrame, group, col) -> DataFrame:
    return df.select(group.alias("g"), F.col(col).cast("double").alias("x")).where(
        F.col("g").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))


def exact_percentiles(df: DataFrame, col: str, probs: dict, materialize_input: bool = True) -> DataFrame:
    """Exact linear-interpolated percentiles of a column: one row, one column per entry of ``probs``.

    Nulls and NaN are left out; an infinite value counts as the least or greatest.  An empty input
    gives nulls.  Equal to NumPy / DuckDB ``quantile_cont``.  The column is written once because
    every pass reads it; callers whose ``df`` is a stored table pass ``materialize_input=False``.
    """
    x = _valued(df, F.lit(0), col)
    if materialize_input:
        x = _stored(x, "selection")
    out = _quantiles(x, probs, True)
    return df.sparkSession.range(1).select(F.lit(0).alias("g")).join(out, "g", "left").drop("g")


def exact_group_percentiles(df: DataFrame, group: str, col: str, probs: dict, materialize_input: bool = True,
                            few_groups: bool = False) -> DataFrame:
    """Exact linear-interpolated percentiles per group, for any number and size of groups.

    Null groups, nulls and NaN are left out, as a group-by in pandas does.  One row per group left.
    """
    x = _valued(df, F.col(group), col)
    if materialize_input:
        x = _stored(x, "group-selection")
    out = _quantiles(x, probs, few_groups)
    return out.select(F.col("g").alias(group), *probs)


def _stored(df: DataFrame, name: str) -> DataFrame:
    from ..session import materialize
    return materialize(df, name)


def exact_column_percentiles(df: DataFrame, cols, probs: dict, group_name: str = "column") -> DataFrame:
    """Exact percentiles of several columns at once; one row per column that has a value.

    The table is stored wide, once; each pass unpivots it on the fly in front of its aggregate.
    """
    cols = list(cols)
    wide = _stored(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]), "columns")
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("g"), F.col(f"c{i}").alias("x"))
                                           for i, c in enumerate(cols)])).alias("_kv")).select("_kv.g", "_kv.x") \
               .where(F.col("x").isNotNull() & ~F.isnan("x"))
    return _quantiles(long, probs, True).select(F.col("g").alias(group_name), *probs)


def exact_medians_row(df: DataFrame, cols, prefix: str = "") -> DataFrame:
    """One row with the exact median of each column (null when a column has no values)."""
    spark = df.sparkSession
    long = exact_column_percentiles(df, cols, {"m": 0.5})
    names = spark.createDataFrame([(c,) for c in cols], "column string")
    wide = names.join(long, "column", "left").groupBy().pivot("column", list(cols)).agg(F.first("m"))
    return wide.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in cols])
