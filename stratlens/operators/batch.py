"""Automatic dispatch, all variables at once, and report objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import clean, interval_index, named, value_label
from ..sources.tables import ColumnTypes, distinct_counts, guess_type
from .histogram import Histogram, gini_of, gini_of_rates, histograms, level_histograms
from .scoring import without_total
from .stats import discrete_stats, interval_stats
from .tree import grow, leaf_bounds

WARNING = "Too many categorical levels"


def warning(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(WARNING,)], "warning string")


def is_warning(table: DataFrame) -> bool:
    return table.columns == ["warning"]


def calc(df: DataFrame, variable: str, target: str, pred: str | None = None, weights: str | None = None, bins=50, total: bool = True, min_info: bool = False, sort_by: str | None = None, ascending: bool = True, discrete_threshold: int = 20, categorical_max_levels: int = 20, analytical_type: str | None = None, plot: bool = False):
    """Statistics of a variable by its type; a one-row ``warning`` table if it has too many levels.

    With ``plot`` the table and an SVG of its shares and rates.
    """
    if plot:
        from ..plans.report import two_series

        table = calc(df, variable, target, pred, weights, bins, total, False, sort_by, ascending, discrete_threshold, categorical_max_levels, analytical_type)
        return table, "" if is_warning(table) else two_series(table, variable)
    n = distinct_counts(df, [variable])[variable]
    kind = analytical_type or guess_type(df, variable, discrete_threshold, n)
    options = {"pred": pred, "weights": weights, "total": total, "min_info": min_info, "sort_by": sort_by, "ascending": ascending}
    if kind in ("discrete", "categorical"):
        return warning(df) if n > categorical_max_levels else discrete_stats(df, variable, target, **options)
    if kind == "continuous":
        return interval_stats(df, variable, target, bins=bins, **options)
    raise ValueError(f"unknown analytical type {kind!r}")


def gen_tables(df: DataFrame, types: ColumnTypes, categorical_max_levels: int = 20) -> dict[str, DataFrame]:
    """A table of statistics for every explanatory variable; all continuous ones come from one scan, others from one for several."""
    target, out = types.target, {}
    shared, kept = _continuous(df, types)
    levels, cells = _discrete(df, types, categorical_max_levels)
    for v in types.types.values():
        if v.role in ("skipped", "target"):
            continue
        if v.analytical_type in ("discrete", "categorical"):
            out[v.column_name] = warning(df) if v.distinct > categorical_max_levels else discrete_stats(df, v.column_name, target, histogram=levels[v.column_name])
        elif v.analytical_type == "continuous":
            out[v.column_name] = interval_stats(df, v.column_name, target, histogram=shared[v.column_name])
        else:
            raise ValueError(f"unknown analytical type {v.analytical_type!r}")
    _release(shared | levels, [*kept, *cells])
    return out


def _continuous(df: DataFrame, types: ColumnTypes) -> tuple[dict[str, Histogram], list[DataFrame]]:
    names = [v.column_name for v in types.types.values() if v.role not in ("skipped", "target") and v.analytical_type == "continuous"]
    if not names:
        return {}, []
    shared, table = histograms(df, names, types.target)
    return shared, [table]


def _discrete(df: DataFrame, types: ColumnTypes, max_levels: int) -> tuple[dict[str, Histogram], list[DataFrame]]:
    few = {v.column_name: v.distinct for v in types.types.values() if v.role not in ("skipped", "target") and v.analytical_type != "continuous" and v.distinct <= max_levels}
    return level_histograms(df, few, types.target)


def _release(shared: dict[str, Histogram], kept: list[DataFrame]) -> None:
    for h in shared.values():
        h.release()
    for table in kept:
        table.unpersist()


def level_stats(df: DataFrame, types: ColumnTypes, categorical_max_levels: int = 20) -> DataFrame:
    """One long table (variable, bin, sum_target, n_obs, avg_target) of all variables with few levels,
    from one scan and one shuffle: columns are unpivoted and grouped together."""
    target = types.target
    few = [v for v in types.types.values() if v.role == "explanatory" and v.analytical_type != "continuous" and v.distinct <= categorical_max_levels]
    if not few:
        return df.sparkSession.createDataFrame([], "variable string, bin string, sum_target double, n_obs double, avg_target double")
    label = F.array(*(F.struct(F.lit(v.column_name).alias("variable"), F.coalesce(value_label(clean(named(v.column_name), v.dtype in ("double", "float")), v.dtype), F.lit("<NA>")).alias("bin")) for v in few))
    rows = df.select(named(target).cast("double").alias("y"), F.explode(label).alias("v"))
    out = rows.groupBy("v.variable", "v.bin").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("sum_target"), F.count(F.lit(1)).cast("double").alias("n_obs"))
    return out.withColumn("avg_target", F.try_divide("sum_target", "n_obs"))


@dataclass
class VariableReport:
    variable: str
    gini: float | None
    gini_binned: float | None
    table: DataFrame
    chart: list[dict] | None
    warned: bool = False


def chart_data(table: DataFrame) -> DataFrame:
    """x (median, or the bin where there is none), avg_target and marker size, without the total."""
    rows = without_total(table)
    middle, mean = rows.agg(F.count("median"), F.avg("n_obs")).first()
    x = F.col("median").cast("string") if middle else F.col("bin")
    return rows.orderBy("nr").select(x.alias("x"), F.col("median").alias("x_num"), "avg_target", F.try_divide(F.col("n_obs") * 25, F.lit(mean)).alias("size"))


def _rates(h: Histogram, edges: list[float]) -> list[tuple]:
    """(rate, rows, positives) of each interval, missing values being a bin of their own."""
    slot = F.when(F.col("value").isNull(), -1).otherwise(interval_index("value", edges))
    rows = h.values.groupBy(slot.alias("slot")).agg(F.sum("cnt").alias("n"), F.sum("pos").alias("p")).collect()
    return [(r["p"] / r["n"], r["n"], r["p"]) for r in rows if r["slot"] is not None]


def gen_report_objects(df: DataFrame, types: ColumnTypes, max_levels: int = 20, max_depth: int = 3, min_samples_leaf: int = 100) -> dict[str, VariableReport]:
    """Ginis, table and chart of every variable; continuous ones show their tree's intervals and chart
    their quantiles.  Everything of a variable comes from one histogram."""
    target, out = types.target, {}
    shared, kept_tables = _continuous(df, types)
    levels, cells = _discrete(df, types, max_levels)
    for v in types.types.values():
        name = v.column_name
        if v.role in ("skipped", "target"):
            continue
        if v.analytical_type != "continuous":
            if v.distinct > max_levels:
                out[name] = VariableReport(name, None, None, warning(df), None, True)
                continue
            h = levels[name]
            table = discrete_stats(df, name, target, histogram=h)
            g = gini_of_rates([(r["pos"] / r["cnt"], r["cnt"], r["pos"]) for r in h.values.select("cnt", "pos").collect()])
            kept = table.collect()
            table = df.sparkSession.createDataFrame(kept, table.schema)
            out[name] = VariableReport(name, g, g, table, [r.asDict() for r in chart_data(table).collect()])
            h.release()
            continue
        h = shared[name]
        try:
            if h.totals["n"]:
                edges = [h.totals["low"] - 1, *leaf_bounds(grow(h, max_depth, min_samples_leaf)), h.totals["high"] + 1]
            else:
                edges = []
            table = interval_stats(df, name, target, bins=edges, histogram=h)
            quantiles = interval_stats(df, name, target, histogram=h)
            out[name] = VariableReport(name, gini_of(h), gini_of_rates(_rates(h, edges)) if edges else None, table, [r.asDict() for r in chart_data(quantiles).collect()])
        finally:
            h.release()
    _release({}, [*kept_tables, *cells])
    return out


def ranking(spark, report: dict[str, VariableReport]) -> DataFrame:
    rows = sorted(((r.variable, r.gini, r.gini_binned) for r in report.values()), key=lambda x: (x[2] is None, -(x[2] or 0.0), x[0]))
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], T.StructType.fromDDL("place int, variable string, gini double, gini_binned double"))
