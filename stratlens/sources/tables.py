"""Readers and the variable catalogue (types and roles of columns)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import clean, named
from ..operators.histogram import NUMERIC, packs

#: Rows that tell which columns may have few values, and how many are few.
HEAD, FEW = 20_000, 100


def read(spark: SparkSession, path: str, columns: list[str] | None = None, casts: dict[str, str] | None = None, schema=None) -> DataFrame:
    """A CSV file with a header, or Parquet; columns are pruned at the scan, casts follow."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    else:
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    df = df.select(*map(named, columns)) if columns else df
    return df.withColumns({c: named(c).cast(t) for c, t in (casts or {}).items()}) if casts else df


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def distinct_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Exact distinct counts without missing values.

    Columns that have few values in ``HEAD`` rows are grouped several at a time and counted in the combinations
    that are left, the others by a shuffle of their distinct values.  Either way is exact, however many there are.
    """
    if not names:
        return {}

    def x(c):
        return clean(named(c), isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)))

    def columns(group):
        return df.select(*(x(c).alias(f"c{i}") for i, c in enumerate(group)))

    def counts(rows, group):
        row = rows.agg(*(F.count_distinct(f"c{i}").alias(f"c{i}") for i in range(len(group)))).first()
        return {c: int(row[f"c{i}"]) for i, c in enumerate(group)}

    rough = counts(columns(names).limit(HEAD), names)
    few = {c: n for c, n in rough.items() if n <= FEW}
    many, out = [c for c in names if c not in few], {}
    for group in packs(few):
        out |= counts(columns(group).distinct(), group)
    if many:
        out |= counts(columns(many), many)
    return {c: out[c] for c in names}


def guess_type(df: DataFrame, name: str, discrete_threshold: int = 20, distinct: int | None = None) -> str:
    if not isinstance(df.schema[name].dataType, NUMERIC):
        return "categorical"
    n = distinct_counts(df, [name])[name] if distinct is None else distinct
    return "discrete" if n < discrete_threshold else "continuous"


@dataclass
class Variable:
    column_name: str
    dtype: str
    analytical_type: str
    role: str
    distinct: int


class ColumnTypes:
    """Types and roles of a table's columns; roles come from names and can be set."""

    def __init__(self, df: DataFrame, discrete_threshold: int = 20, id_prefix: str = "id", date_word: str = "date", target_name: str = "target"):
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        counts = distinct_counts(df, plain)
        self.types: dict[str, Variable] = {}
        for f in df.schema.fields:
            role = "target" if f.name == target_name else "explanatory"
            if f.name not in counts or f.name.startswith(id_prefix) or date_word in f.name.lower():
                role = "skipped"
            kind = guess_type(df, f.name, discrete_threshold, counts.get(f.name, 0))
            self.types[f.name] = Variable(f.name, f.dataType.simpleString(), kind, role, counts.get(f.name, 0))

    @property
    def target(self) -> str:
        names = [v.column_name for v in self.types.values() if v.role == "target"]
        if len(names) != 1:
            raise ValueError(f"one target is needed, not {len(names)}")
        return names[0]

    @target.setter
    def target(self, name: str) -> None:
        for v in self.types.values():
            if v.role == "target":
                v.role = "explanatory"
        self.set_role(name, "target")

    def _each(self, names):
        for n in [names] if isinstance(names, str) else names:
            if n not in self.types:
                raise ValueError(f"no column {n!r}")
            yield self.types[n]

    def set_role(self, names: str | list[str], role: str) -> None:
        for v in self._each(names):
            v.role = role

    set = set_role

    def set_type(self, names: str | list[str], analytical_type: str) -> None:
        for v in self._each(names):
            v.analytical_type = analytical_type

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(v.column_name, v.dtype, v.analytical_type, v.role) for v in self.types.values()]
        return spark.createDataFrame(rows, "column_name string, dtype string, analytical_type string, role string")
