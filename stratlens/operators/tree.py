"""A decision tree of one variable, grown on its ordered histogram.

With prefix counts in the histogram, the best split of every node of a level is one aggregate over
it; thresholds are midpoints of neighbouring values, the lowest wins ties, missing values are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import literals
from .histogram import Histogram
from .stats import _require_numeric, interval_stats


@dataclass
class Node:
    lower: float | None
    upper: float | None
    before: int
    before_pos: int
    n: int
    pos: int
    threshold: float | None = None
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else [*self.left.leaves(), *self.right.leaves()]


def _impurity(n, p):
    return 2.0 * p * (n - p) / n


def _level(h: Histogram, nodes: list[Node], least: int) -> None:
    """Split every node that gains by it."""
    number = F.lit(None).cast("int")
    for i, x in enumerate(nodes):
        inside = F.lit(True)
        if x.lower is not None:
            inside &= F.col("value") > x.lower
        if x.upper is not None:
            inside &= F.col("value") <= x.upper
        number = F.when(inside, F.lit(i)).otherwise(number)

    def of(numbers: list[int]):
        return F.get(literals(numbers, "long"), F.col("node"))

    # one step a select, and the condition inside the aggregate: expressions are not copied into each other
    rows = h.ordered.where("next is not null").select(number.alias("node"), "value", "next", (F.col("before") + F.col("cnt")).alias("cn"), (F.col("before_pos") + F.col("pos")).alias("cp"))
    rows = rows.select("node", "value", "next", (F.col("cn") - of([x.before for x in nodes])).alias("cn"), (F.col("cp") - of([x.before_pos for x in nodes])).alias("cp"), of([x.n for x in nodes]).alias("n"), of([x.pos for x in nodes]).alias("p"))
    cn, cp, n, p = (F.col(c).cast("double") for c in ("cn", "cp", "n", "p"))
    cost = F.when((F.col("cn") >= least) & (F.col("n") - F.col("cn") >= least), 2 * cp * (cn - cp) / cn + 2 * (p - cp) * ((n - cn) - (p - cp)) / (n - cn))
    rows = rows.select("node", "value", "next", "cn", "cp", cost.alias("cost"))
    best = rows.groupBy("node").agg(F.min(F.when(F.col("cost").isNotNull(), F.struct("cost", "value", "next", "cn", "cp"))).alias("b")).collect()
    for r in best:
        if r["node"] is None or r["b"] is None:
            continue
        x, b = nodes[r["node"]], r["b"]
        if b["cost"] < _impurity(x.n, x.pos) - 1e-12 * x.n:
            x.threshold = (b["value"] + b["next"]) / 2
            x.left = Node(x.lower, x.threshold, x.before, x.before_pos, b["cn"], b["cp"])
            x.right = Node(x.threshold, x.upper, x.before + b["cn"], x.before_pos + b["cp"], x.n - b["cn"], x.pos - b["cp"])


def grow(h: Histogram, max_depth: int = 3, min_samples_leaf: int = 50) -> Node:
    root = Node(None, None, 0, 0, h.totals["n"], h.totals["pos"])
    nodes = [root] if root.n else []
    for _ in range(max_depth):
        nodes = [x for x in nodes if x.n >= 2 * max(1, min_samples_leaf) and 0 < x.pos < x.n]
        if not nodes:
            break
        _level(h, nodes, max(1, min_samples_leaf))
        nodes = [c for x in nodes if x.left for c in (x.left, x.right)]
    return root


def make_tree(df: DataFrame, variable: str, target: str, max_depth: int = 3, min_samples_leaf: int = 50) -> Node:
    _require_numeric(df, variable, target)
    h = Histogram(df, variable, target, as_double=True)
    try:
        return grow(h, max_depth, min_samples_leaf)
    finally:
        h.release()


def leaf_bounds(tree: Node) -> list[float]:
    """Sorted thresholds between the leaves."""
    return sorted({b for x in tree.leaves() for b in (x.lower, x.upper) if b is not None})


def leaf_info(spark, tree: Node, feature: str, classes: tuple[str, str] = ("0", "1")) -> DataFrame:
    """One row a leaf: bounds, rows, readable intervals along its path, class counts and shares."""
    rows = []

    def walk(x: Node, path: list[str]) -> None:
        if x.left is None:
            counts = {classes[0]: x.n - x.pos, classes[1]: x.pos}
            rows.append((x.lower, x.upper, x.n, path, counts, {k: v / x.n if x.n else 0.0 for k, v in counts.items()}))
        else:
            walk(x.left, [*path, f"{feature} <= {x.threshold:.2f}"])
            walk(x.right, [*path, f"{feature} > {x.threshold:.2f}"])

    walk(tree, [])
    return spark.createDataFrame(rows, "lower_bound double, upper_bound double, samples long, intervals array<string>, class_stats map<string,long>, class_probs map<string,double>")


def tree_stats(df: DataFrame, variable: str, target: str, max_depth: int = 3, min_samples_leaf: int = 2, histogram: Histogram | None = None, **options) -> DataFrame:
    """Interval statistics on the tree's leaves; the outer edges are min - 1 and max + 1."""
    _require_numeric(df, variable, target)
    h = histogram or Histogram(df, variable, target, as_double=True)
    try:
        if not h.totals["n"]:
            return interval_stats(df, variable, target, bins=[], histogram=h, **options)
        edges = [h.totals["low"] - 1, *leaf_bounds(grow(h, max_depth, min_samples_leaf)), h.totals["high"] + 1]
        return interval_stats(df, variable, target, bins=edges, histogram=h, **options)
    finally:
        if histogram is None:
            h.release()
