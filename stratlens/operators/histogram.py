"""The value histogram of one variable, from which every other number follows.

One shuffle groups the rows by value.  The ordered form adds, to each distinct value, the rows and
positives before it and the next value.  It is made without a single-partition window: approximate
quantiles cut the value range into slices, windows run inside slices, and the slices' totals (at most
``SLICES`` rows) give the offsets.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import clean, interval_index, literals, named

SLICES = 128
#: Combinations of values that variables grouped together may be expected to have.
CELLS = 4096
NUMERIC = (T.NumericType, T.BooleanType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def persisted(df: DataFrame) -> DataFrame:
    """Persist in as many partitions as the rows need, not as many as shuffles have: the plan is adapted to their size,
    which Spark does for cached tables only if it is told to while it makes the plan."""
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return df.persist()
    finally:
        conf.set(name, before)


def packs(sizes: dict[str, int]) -> list[list[str]]:
    """Columns in groups of at most ``CELLS`` combinations of their values (so many each, or missing), or of one column."""
    out, cells = [], CELLS + 1
    for c in sorted(sizes, key=lambda c: sizes[c]):
        cells *= sizes[c] + 1
        if cells > CELLS:
            out.append([])
            cells = sizes[c] + 1
        out[-1].append(c)
    return out


def require_column(df: DataFrame, *names: str | None) -> None:
    for n in names:
        if n is not None and n not in df.columns:
            raise ValueError(f"no column {n!r}")
        if n is not None and isinstance(df.schema[n].dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"column {n!r} has a nested type")


@dataclass
class Histogram:
    """Rows, positives and weighted sums of each value; ``value`` keeps the variable's type unless ``as_double``.

    ``keep`` persists what is used more than once, until ``release``.  ``shared`` is a table of values made
    together with other variables' (``histograms``).
    """

    df: DataFrame
    variable: str
    target: str
    pred: str | None = None
    weights: str | None = None
    as_double: bool = False
    one_slice: int = 200_000
    keep: bool = True
    shared: DataFrame | None = None
    kept: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        require_column(self.df, self.variable, self.target, self.pred, self.weights)

    @cached_property
    def values(self) -> DataFrame:
        if self.shared is not None:
            return self.shared

        def number(c: str):
            return clean(named(c).cast("double"), True)

        kind = self.df.schema[self.variable].dataType
        x = named(self.variable)
        x = clean(x, isinstance(kind, (T.DoubleType, T.FloatType)))
        if self.as_double:
            x = clean(x.cast("double"), True)
        y, w = number(self.target), number(self.weights) if self.weights else F.lit(1.0)
        p = number(self.pred) if self.pred else F.lit(None).cast("double")
        rows = self.df.select(x.alias("value"), y.alias("y"), w.alias("w"), p.alias("p"))
        out = rows.groupBy("value").agg(
            F.count(F.lit(1)).alias("cnt"), F.sum((F.col("y") > 0).cast("long")).alias("pos"), F.sum(F.col("y").isNull().cast("long")).alias("bad"),
            F.sum("w").alias("sum_w"), F.sum(F.col("y") * F.col("w")).alias("sum_wy"), F.sum(F.col("p") * F.col("w")).alias("sum_wp"),
        )
        if self.keep:
            self.kept.append(persisted(out))
        return out

    @cached_property
    def totals(self):
        """One pass over the histogram; raises for missing targets."""
        present = F.col("value").isNotNull()
        row = self.values.agg(
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum(F.when(present, F.col("cnt"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(present, F.col("pos"))), F.lit(0)).alias("pos"),
            F.count("value").alias("distinct"), F.min("value").alias("low"), F.max("value").alias("high"),
            F.sum("sum_wy").alias("t"), F.sum("sum_w").alias("w"), F.sum("sum_wp").alias("p"),
        ).first()
        if row["bad"]:
            raise ValueError(f"the target {self.target!r} has missing values")
        return row

    @cached_property
    def ordered(self) -> DataFrame:
        """value, cnt, pos, before, before_pos and next, of the values that are not missing."""
        h = self.values.where("value is not null").select(F.col("value").cast("double").alias("value"), "cnt", "pos")
        slices = min(SLICES, -(-self.totals["distinct"] // max(1, self.one_slice)))
        if slices > 1:
            cuts = h.agg(F.percentile_approx("value", [i / slices for i in range(1, slices)], 10_000)).first()[0]
            cuts = sorted({float(c) for c in cuts})
        else:
            cuts = []
        edges = [float("-inf"), *(c for c in cuts if c not in (float("inf"), float("-inf"))), float("inf")]
        h = h.withColumn("slice", interval_index("value", edges))
        sums = sorted(h.groupBy("slice").agg(F.sum("cnt"), F.sum("pos"), F.min("value")).collect())
        before, before_pos, follow, n, p = {}, {}, {}, 0, 0
        for k, (s, cnt, pos, _) in enumerate(sums):
            before[s], before_pos[s] = n, p
            follow[s] = sums[k + 1][3] if k + 1 < len(sums) else None
            n, p = n + cnt, p + pos

        def pick(table: dict, kind: str):
            return F.element_at(literals([table.get(s) for s in range(1, len(edges))], kind), F.col("slice"))

        w = Window.partitionBy("slice").orderBy("value")
        up = w.rowsBetween(Window.unboundedPreceding, -1)
        out = persisted(h.select(
            "value", "cnt", "pos", (pick(before, "long") + F.coalesce(F.sum("cnt").over(up), F.lit(0))).alias("before"), (pick(before_pos, "long") + F.coalesce(F.sum("pos").over(up), F.lit(0))).alias("before_pos"),
            F.coalesce(F.lead("value").over(w), pick(follow, "double")).alias("next"),
        ))
        self.kept.append(out)
        return out

    def at_ranks(self, ranks: list[int]) -> dict[int, float]:
        """The values at 0-based ranks of the sorted variable."""
        want = sorted(set(ranks))
        if not want:
            return {}
        bounds = [-1, *want, self.totals["n"]]
        hit = interval_index("before", bounds) != interval_index("(before + cnt)", bounds)
        found = sorted((b, c, v) for v, b, c in self.ordered.where(hit).select("value", "before", "cnt").collect())
        return {r: next(v for b, c, v in found if b <= r < b + c) for r in want}

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept.clear()


def histograms(df: DataFrame, names: list[str], target: str) -> tuple[dict[str, Histogram], DataFrame]:
    """Histograms of numeric variables as doubles, all from one scan and one shuffle by (variable, value), and the
    table they share, persisted: unpersist it when done."""
    for n in names:
        require_column(df, n, target)
    pairs = F.array(*(F.struct(F.lit(i).alias("k"), clean(named(n).cast("double"), True).alias("value")) for i, n in enumerate(names)))
    rows = df.select(clean(named(target).cast("double"), True).alias("y"), F.explode(pairs).alias("v")).select("v.k", "v.value", "y")
    table = persisted(_unweighted(rows.groupBy("k", "value").agg(*_counts())))
    return {n: Histogram(df, n, target, as_double=True, shared=table.where(F.col("k") == i).drop("k")) for i, n in enumerate(names)}, table


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("cnt"), F.sum((F.col("y") > 0).cast("long")).alias("pos"), F.sum(F.col("y").isNull().cast("long")).alias("bad"), F.sum("y").alias("sum_wy")]


def _unweighted(table: DataFrame) -> DataFrame:
    return table.withColumns({"sum_w": F.col("cnt").cast("double"), "sum_wp": F.lit(None).cast("double")})


def level_histograms(df: DataFrame, levels: dict[str, int], target: str) -> tuple[dict[str, Histogram], list[DataFrame]]:
    """Histograms of variables of few values (so many each), in their own types, and the tables they share, persisted:
    unpersist them when done.

    The rows are grouped by the combinations of several variables at once, and each variable's values follow from these.
    The numbers of values only decide which are grouped together.
    """
    for n in levels:
        require_column(df, n, target)
    out, tables = {}, []
    for group in packs(levels):
        x = [clean(named(n), isinstance(df.schema[n].dataType, (T.DoubleType, T.FloatType))).alias(f"c{i}") for i, n in enumerate(group)]
        cells = persisted(df.select(clean(named(target).cast("double"), True).alias("y"), *x).groupBy(*(f"c{i}" for i in range(len(x)))).agg(*_counts()))
        tables.append(cells)
        for i, n in enumerate(group):
            values = cells.groupBy(F.col(f"c{i}").alias("value")).agg(*(F.sum(c).alias(c) for c in ("cnt", "pos", "bad", "sum_wy")))
            h = Histogram(df, n, target, shared=persisted(_unweighted(values)))
            h.kept.append(h.shared)
            out[n] = h
    return {n: out[n] for n in levels}, tables


def gini(df: DataFrame, variable: str, target: str) -> float | None:
    """2 AUC - 1, signed and unweighted, ties counting half; None with one class.  Missing values are left out."""
    h = Histogram(df, variable, target, as_double=True)
    try:
        return gini_of(h)
    finally:
        h.release()


def gini_of(h: Histogram) -> float | None:
    n, p = h.totals["n"], h.totals["pos"]
    if not p or p == n:
        return None
    ranks = h.ordered.agg(F.sum(F.col("pos") * (F.col("before") + (F.col("cnt") + 1) / 2))).first()[0]
    return 2 * (ranks - p * (p + 1) / 2) / (p * (n - p)) - 1


def gini_of_rates(rows: list[tuple[float, int, int]]) -> float | None:
    """Gini of bins as a score: (score, rows, positives) of each bin."""
    by: dict[float, list[int]] = {}
    for s, n, p in rows:
        if s is not None:
            c = by.setdefault(s, [0, 0])
            c[0] += n
            c[1] += p
    n, p = sum(c[0] for c in by.values()), sum(c[1] for c in by.values())
    if not p or p == n:
        return None
    before = total = 0.0
    for s in sorted(by):
        total += by[s][1] * (before + (by[s][0] + 1) / 2)
        before += by[s][0]
    return 2 * (total - p * (p + 1) / 2) / (p * (n - p)) - 1
