"""Outcome statistics by distinct value and by interval.

Result columns: nr, bin, discrete, od, srodek, do, mean, median, sum_target, n_obs, avg_target,
pct_obs and, with predictions, avg_pred; ``row_kind`` tells NA, VALUE, INTERVAL, OUT and TOTAL rows
apart where ``with_kind`` is set.  Missing values come first, the total last, whatever the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from numbers import Integral

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import NA, OUT, TOTAL, interval_index, interval_labels, quantile_ranks, value_label
from .histogram import Histogram, is_numeric

ORDER = ["nr", "bin", "discrete", "od", "srodek", "do", "mean", "median", "sum_target", "n_obs", "avg_target", "pct_obs"]
SHORT = ["bin", "sum_target", "n_obs", "avg_target", "pct_obs"]


def _finish(rows: DataFrame, sort_by, ascending, default, min_info, pred, with_kind) -> DataFrame:
    """Number the rows in their final order and project."""
    place = F.when(F.col("row_kind") == "NA", -1).when(F.col("row_kind") == "OUT", 1).when(F.col("row_kind") == "TOTAL", 2).otherwise(0)
    if sort_by is not None and sort_by not in rows.columns and sort_by != "nr":
        raise ValueError(f"cannot sort by {sort_by!r}")
    keys = [F.asc("_tie")] if sort_by in (None, "nr") else [(F.asc_nulls_last if ascending else F.desc_nulls_last)(sort_by), F.asc("_tie")]
    if sort_by is None:
        keys = default
    rows = rows.withColumn("nr", F.row_number().over(Window.orderBy(place, *keys)).cast("int"))
    cols = list(SHORT if min_info else ORDER) + ["avg_pred"] * bool(pred) + ["row_kind"] * bool(with_kind)
    return rows.orderBy("nr").select(*cols)


def discrete_stats(df: DataFrame, variable: str, target: str, pred: str | None = None, total: bool = True, min_info: bool = False, sort_by: str | None = None, ascending: bool = True, weights: str | None = None, with_kind: bool = False, histogram: Histogram | None = None) -> DataFrame:
    """One row for each value of the variable: weighted target, weight, rate and share."""
    own = histogram or Histogram(df, variable, target, pred, weights, keep=False)
    whole = own.totals  # raises for missing targets
    kind = df.schema[variable].dataType
    number = isinstance(kind, (T.NumericType, T.BooleanType))
    base = own.values.select("value", F.coalesce("sum_wy", F.lit(0.0)).alias("sum_target"), F.coalesce("sum_w", F.lit(0.0)).alias("n_obs"), F.coalesce("sum_wp", F.lit(0.0)).alias("sum_pred"))
    label = F.coalesce(value_label(F.col("value"), kind.simpleString()), F.lit(NA))
    typed = F.col("value").cast("double") if number else label
    rows = base.select(F.when(F.col("value").isNull(), "NA").otherwise("VALUE").alias("row_kind"), label.alias("bin"), typed.alias("discrete"), "sum_target", "n_obs", "sum_pred")
    if total:
        last = df.sparkSession.range(1).select(
            F.lit("TOTAL").alias("row_kind"), F.lit(TOTAL).alias("bin"), (F.lit(None).cast("double") if number else F.lit(TOTAL)).alias("discrete"),
            F.lit(whole["t"] or 0.0).alias("sum_target"), F.lit(whole["w"] or 0.0).alias("n_obs"), F.lit(whole["p"] or 0.0).alias("sum_pred"),
        )
        rows = rows.unionByName(last)
    rows = rows.withColumns(
        {"avg_target": F.try_divide("sum_target", "n_obs"), "avg_pred": F.try_divide("sum_pred", "n_obs"), "pct_obs": F.try_divide(F.col("n_obs"), F.lit(whole["w"] or 0.0)), "_tie": F.col("bin")}
        | {c: F.lit(None).cast("double") for c in ("od", "srodek", "do", "mean", "median")}
    )
    return _finish(rows, sort_by, ascending, [F.asc("bin")], min_info, pred, with_kind)


def _require_numeric(df: DataFrame, variable: str, target: str) -> None:
    for c in (variable, target):
        if not is_numeric(df, c):
            raise TypeError(f"column {c!r} must be numeric, not {df.schema[c].dataType.simpleString()}")


def quantile_edges(h: Histogram, bins: int) -> list[float]:
    """Distinct lower quantiles i / bins, i = 0..bins: observed values, exact."""
    if bins < 1:
        raise ValueError("bins must be 1 at least")
    if not h.totals["n"]:
        return []
    ranks = quantile_ranks(h.totals["n"], bins)
    at = h.at_ranks(ranks)
    return sorted({at[r] for r in ranks})


def resolve_edges(h: Histogram, bins) -> list[float]:
    if isinstance(bins, Integral) and not isinstance(bins, bool):
        return quantile_edges(h, int(bins))
    if isinstance(bins, (str, bytes)) or not hasattr(bins, "__iter__"):
        raise ValueError("bins must be a whole number or a list of edges")
    return sorted({float(b) for b in bins})


def interval_stats(df: DataFrame, variable: str, target: str, pred: str | None = None, weights: str | None = None, bins: int | Sequence[float] = 50, total: bool = True, min_info: bool = False, sort_by: str | None = None, ascending: bool = True, legacy_edges: bool = False, keep_empty: bool = False, with_kind: bool = False, histogram: Histogram | None = None) -> DataFrame:
    """One row for each interval (od, do] of the variable; mean and median are unweighted.

    Values outside given edges are in an ``<OUT>`` row; empty intervals are left out unless ``keep_empty``.
    ``legacy_edges`` writes the edges in the order of the rows, whatever that is sorted by.
    """
    _require_numeric(df, variable, target)
    h = histogram or Histogram(df, variable, target, pred, weights, as_double=True)
    try:
        n = h.totals["n"]
        edges = resolve_edges(h, bins)
        index = interval_index("value", edges) if edges else F.lit(None).cast("int")
        slot = F.when(F.col("value").isNull(), -1).otherwise(F.coalesce(index, F.when(F.col("value") < (edges[0] if edges else 0.0), 0).otherwise(9_999_999)))
        sums = h.values.groupBy(slot.alias("slot")).agg(
            F.sum("cnt").alias("cnt"), F.sum("pos").alias("pos"), F.sum("sum_wy").alias("t"), F.sum("sum_w").alias("w"), F.sum("sum_wp").alias("p"), F.sum(F.col("value") * F.col("cnt")).alias("x"),
        ).collect()
        by = {r["slot"]: r for r in sums}
        # intervals are contiguous in the sorted variable, so medians are values at known ranks
        spans, start = {}, 0
        for s in sorted(k for k in by if k >= 0):
            spans[s] = (start, by[s]["cnt"])
            start += by[s]["cnt"]
        outside = [spans[s] for s in (0, 9_999_999) if s in spans]
        middle = {s: (a + (c - 1) // 2, a + c // 2) for s, (a, c) in spans.items() if c}
        if n:
            middle["all"] = ((n - 1) // 2, n // 2)
        out_n = sum(c for _, c in outside)
        if out_n:
            below = spans.get(0, (0, 0))[1]

            def outer(k):  # the k-th of the values outside
                return k if k < below else n - out_n + k

            middle["out"] = (outer((out_n - 1) // 2), outer(out_n // 2))
        at = h.at_ranks([r for pair in middle.values() for r in pair])
        med = {k: (at[a] + at[b]) / 2 for k, (a, b) in middle.items()}
        whole = {k: sum((r[k] or 0.0) for r in sums) for k in ("t", "w", "p", "x")}
        cnt = sum(r["cnt"] for k, r in by.items() if k >= 0)

        def row(kind, label, tie, parts, lo=None, hi=None, median=None):
            c = sum(r["cnt"] for r in parts)
            t, w, p, x = (float(sum((r[k] or 0.0) for r in parts)) for k in ("t", "w", "p", "x"))
            mean = x / c if c and kind != "NA" else None
            if kind == "TOTAL":
                mean = whole["x"] / cnt if cnt else None
            mid = (lo + hi) / 2 if lo is not None else None
            return (kind, label, lo, mid, hi, mean, median, t, w, p, tie)

        rows = []
        if -1 in by:
            rows.append(row("NA", NA, 0, [by[-1]]))
        labels = interval_labels(edges) if edges else []
        pairs = list(zip(edges, edges[1:])) or [(e, e) for e in edges]
        for i, (lo, hi) in enumerate(pairs, 1):
            if i in by or keep_empty:
                rows.append(row("INTERVAL", labels[i - 1], i, [by[i]] if i in by else [], lo, hi, med.get(i)))
        if out_n:
            rows.append(row("OUT", OUT, 10**7, [by[s] for s in (0, 9_999_999) if s in by], median=med.get("out")))
        if total:
            rows.append(row("TOTAL", TOTAL, 10**8, list(by.values()), median=med.get("all")))
        spec = "row_kind string, bin string, od double, srodek double, do double, mean double, median double, sum_target double, n_obs double, sum_pred double, _tie int"
        out = df.sparkSession.createDataFrame(rows, spec)
        out = out.withColumns({"discrete": F.lit(None).cast("double"), "avg_target": F.try_divide("sum_target", "n_obs"), "avg_pred": F.try_divide("sum_pred", "n_obs"), "pct_obs": F.try_divide(F.col("n_obs"), F.lit(float(whole["w"])))})
        done = _finish(out, sort_by, ascending, [F.asc("_tie")], min_info, pred, with_kind)
        if legacy_edges and not min_info:
            k = F.row_number().over(Window.orderBy("nr")) - F.lit(1 if -1 in by else 0)
            inside = done.where(F.col("od").isNotNull()).select("nr", k.alias("k"))
            lows, highs = F.array(*map(F.lit, [p[0] for p in pairs])), F.array(*map(F.lit, [p[1] for p in pairs]))
            rank = inside.select("nr", F.row_number().over(Window.orderBy("nr")).alias("k"))
            done = done.drop("od", "srodek", "do").join(rank, "nr", "left").withColumn("od", F.get(lows, F.col("k") - 1)).withColumn("do", F.get(highs, F.col("k") - 1)).withColumn("srodek", (F.col("od") + F.col("do")) / 2)
            done = done.orderBy("nr").select(*ORDER, *["avg_pred"] * bool(pred), *["row_kind"] * bool(with_kind))
        return done
    finally:
        if histogram is None:
            h.release()
