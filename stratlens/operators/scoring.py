"""Map rows to a value of their bin; stateless, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import NA, TOTAL, clean, interval_index, named


def _kinds(table: DataFrame) -> DataFrame:
    """The table with ``row_kind``.  Without it, the last row called TOTAL is the total and the first called <NA> are the
    missing values; tables made ``with_kind`` tell apart levels that have these names."""
    for c in ("bin", "discrete", "od", "do", "nr"):
        if c not in table.columns:
            table = table.withColumn(c, F.lit(None).cast("int" if c == "nr" else "double" if c in ("od", "do") else "string"))
    if "row_kind" in table.columns:
        return table
    ends = table.agg(F.max(F.when(F.col("bin") == TOTAL, F.coalesce("nr", F.lit(0)))).alias("last"), F.min(F.when(F.col("bin") == NA, F.coalesce("nr", F.lit(0)))).alias("first")).first()
    at = F.coalesce("nr", F.lit(0))
    kind = F.when((F.col("bin") == TOTAL) & (at == F.lit(ends["last"])), "TOTAL").when((F.col("bin") == NA) & (at == F.lit(ends["first"])), "NA")
    return table.withColumn("row_kind", kind.when(F.col("od").isNotNull(), "INTERVAL").when(F.col("discrete").isNull() & F.col("od").isNull() & (F.col("bin") == "<OUT>"), "OUT").otherwise("VALUE"))


def without_total(table: DataFrame) -> DataFrame:
    return _kinds(table).where("row_kind <> 'TOTAL'")


def assign(df: DataFrame, variable: str, bins: DataFrame | list, val: str, output: str = "score", on_unseen: str = "null") -> DataFrame:
    """Adds ``output``: column ``val`` of the row's bin.  Missing values get the ``<NA>`` bin's value.

    Values in no bin get null, or fail with ``on_unseen="error"``.  ``bins`` has one row a bin.  Intervals, as many as
    were asked for, become an expression; levels, however many, are joined on their typed values (Spark broadcasts
    them by their size, or shuffles).
    """
    spark = df.sparkSession
    if not isinstance(bins, DataFrame):
        rows = [dict(r) for r in bins]
        if not rows:
            raise ValueError("there are no bins")
        names = list(dict.fromkeys(k for r in rows for k in r))
        bins = spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], T.StructType([_field(k, [r.get(k) for r in rows]) for k in names]))
    table = _kinds(bins).where("row_kind <> 'TOTAL'")
    x = clean(named(variable), isinstance(df.schema[variable].dataType, (T.DoubleType, T.FloatType)))
    few = [r.asDict() for r in table.where("row_kind in ('NA', 'INTERVAL')").select("row_kind", "od", "do", named(val).alias("v")).collect()]
    missing = next((r["v"] for r in few if r["row_kind"] == "NA"), None)
    spans = sorted((r for r in few if r["row_kind"] == "INTERVAL"), key=lambda r: r["od"])
    kind = bins.schema[val].dataType
    if spans:
        if any(a["do"] != b["od"] for a, b in zip(spans, spans[1:])):
            raise ValueError("intervals must follow each other without gaps")
        edges = [spans[0]["od"], *(s["do"] for s in spans)] if spans[0]["od"] != spans[0]["do"] else [spans[0]["od"]]
        source, score = df, F.get(F.array(*(F.lit(s["v"]) for s in spans)), interval_index(x.cast("double"), edges) - 1)
    else:
        number = not isinstance(bins.schema["discrete"].dataType, T.StringType) if "discrete" in bins.columns else False
        key = "double" if number else "string"
        level = table.where("row_kind = 'VALUE'").select(F.coalesce(F.col("discrete").cast(key), F.col("bin").cast(key)).alias("_level"), named(val).alias("_value"))
        source = df.join(level, x.cast(key) == F.col("_level"), "left")
        score = F.col("_value")
    out = F.when(x.isNull(), F.lit(missing).cast(kind)).otherwise(score.cast(kind))
    if on_unseen == "error":
        out = F.when(x.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit(f"no bin of {variable} holds "), x.cast("string")))).otherwise(out)
    keep = [named(c) for c in df.columns if c != output]
    return source.select(*keep, out.alias(output))


def _field(name: str, values: list) -> T.StructField:
    known = [v for v in values if v is not None]
    if known and all(isinstance(v, bool) for v in known):
        return T.StructField(name, T.BooleanType())
    if known and all(isinstance(v, int) for v in known):
        return T.StructField(name, T.LongType())
    return T.StructField(name, T.StringType() if not known or isinstance(known[0], str) else T.DoubleType())
