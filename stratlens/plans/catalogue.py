"""The library's own queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import batch, scoring, stats, tree
from ..operators.histogram import Histogram, gini
from ..sources.tables import ColumnTypes, distinct_counts, read

TARGETS = {"lineitem": "l_returnflag = 'R'", "orders": "o_orderstatus = 'F'", "events": "event_type = 'purchase'"}
NUMBERS = ["sum_target", "n_obs", "avg_target", "pct_obs"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table with its 0/1 outcome ``y``."""
    df = read(spark, f"{sf_dir}/{name}.parquet")
    return df.select(*(F.expr(c) for c in columns), F.expr(f"cast({TARGETS[name]} as int)").alias("y")) if name in TARGETS else df.select(*(F.expr(c) for c in columns))


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns if c in df.columns})


def _levels(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return _round(df, *NUMBERS, *extra).select("nr", "bin", *NUMBERS, *extra)


def _levels_sql(source: str, label: str, weight: str = "1.0", pred: str | None = None, order: str = "bin", total: bool = True) -> str:
    p = f", sum(({pred}) * ({weight})) AS sp" if pred else ""
    out = ", round(sp / n, 6) AS avg_pred" if pred else ""
    last = f"UNION ALL SELECT 'TOTAL', 2, sum(t), sum(n){', sum(sp)' if pred else ''} FROM g" if total else ""
    return f"""WITH s AS ({source}), g AS (SELECT coalesce({label}, '<NA>') AS bin, CASE WHEN {label} IS NULL THEN 0 ELSE 1 END AS place, CAST(sum(y * ({weight})) AS DOUBLE) AS t, CAST(sum({weight}) AS DOUBLE) AS n{p} FROM s GROUP BY 1, 2),
a AS (SELECT * FROM g {last})
SELECT CAST(row_number() OVER (ORDER BY place, {order}) AS INT) AS nr, bin, round(t, 6) AS sum_target, round(n, 6) AS n_obs, round(t / n, 6) AS avg_target, round(n / (SELECT sum(n) FROM g), 6) AS pct_obs{out} FROM a"""


def _source(name: str, columns: str) -> str:
    return f"SELECT {columns}, CAST({TARGETS[name]} AS INT) AS y FROM {name}"


def q01_discrete(spark, d):
    return _levels(stats.discrete_stats(table(spark, d, "lineitem", "l_linestatus"), "l_linestatus", "y"))


def q02_numeric(spark, d):
    return _levels(stats.discrete_stats(table(spark, d, "lineitem", "l_linenumber"), "l_linenumber", "y"), ("discrete",))


def q03_weighted(spark, d):
    return _levels(stats.discrete_stats(table(spark, d, "lineitem", "l_linestatus", "l_quantity"), "l_linestatus", "y", weights="l_quantity"))


def q04_prediction(spark, d):
    return _levels(stats.discrete_stats(table(spark, d, "lineitem", "l_linestatus", "l_discount * 10 AS p", "l_quantity"), "l_linestatus", "y", pred="p", weights="l_quantity"), ("avg_pred",))


def q05_missing(spark, d):
    return _levels(stats.discrete_stats(table(spark, d, "lineitem", "if(l_linenumber = 3, null, l_linenumber) AS v"), "v", "y"))


def q06_sorted(spark, d):
    return _levels(stats.discrete_stats(table(spark, d, "lineitem", "l_linenumber"), "l_linenumber", "y", sort_by="avg_target", ascending=False))


def q07_short(spark, d):
    return _round(stats.discrete_stats(table(spark, d, "lineitem", "l_linestatus"), "l_linestatus", "y", min_info=True, total=False), *NUMBERS)


INTERVAL = ["nr", "row_kind", "od", "srodek", "do", "mean", "median", *NUMBERS]


def _intervals(df: DataFrame, *extra: str) -> DataFrame:
    return _round(df, "od", "srodek", "do", "mean", "median", *NUMBERS, *extra).select(*INTERVAL, *extra)


def _ranks_sql(bins: int) -> str:
    """Edges of ``bins`` lower quantiles: 0-based ranks floor(((i / bins) * 100 / 100) * (n - 1))."""
    rank = f"CAST(floor(((CAST(i AS DOUBLE) / {bins}) * 100.0 / 100.0) * (n - 1)) AS BIGINT)"
    return f"""r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM s WHERE v IS NOT NULL), c AS (SELECT count(*) AS n FROM r),
e AS (SELECT DISTINCT v AS edge FROM r WHERE k IN (SELECT {rank} FROM c, range(0, {bins + 1}) t(i)))"""


def _intervals_sql(source: str, edges: str, weight: str = "1.0", pred: str | None = None, order: str = "lo") -> str:
    p = f", sum(({pred}) * ({weight})) AS sp" if pred else ""
    out = ", round(sp / n, 6) AS avg_pred" if pred else ""
    agg = f"avg(v) AS mean, median(v) AS median, CAST(sum(y * ({weight})) AS DOUBLE) AS t, CAST(sum({weight}) AS DOUBLE) AS n{p}"
    return f"""WITH s AS ({source}), {edges}, i AS (SELECT edge AS lo, lead(edge) OVER (ORDER BY edge) AS hi, row_number() OVER (ORDER BY edge) AS j FROM e),
b AS (SELECT s.*, i.lo, i.hi, CASE WHEN v IS NULL THEN 0 WHEN i.hi IS NULL THEN 2 ELSE 1 END AS place FROM s LEFT JOIN i ON i.hi IS NOT NULL AND (v > lo OR (j = 1 AND v = lo)) AND v <= hi),
g AS (SELECT place, lo, hi, {agg} FROM b GROUP BY 1, 2, 3 UNION ALL SELECT 3, NULL, NULL, {agg} FROM b)
SELECT CAST(row_number() OVER (ORDER BY place, {order}) AS INT) AS nr, CASE place WHEN 0 THEN 'NA' WHEN 1 THEN 'INTERVAL' WHEN 2 THEN 'OUT' ELSE 'TOTAL' END AS row_kind,
round(lo, 6) AS od, round((lo + hi) / 2, 6) AS srodek, round(hi, 6) AS "do", round(mean, 6) AS mean, round(median, 6) AS median, round(t, 6) AS sum_target, round(n, 6) AS n_obs, round(t / n, 6) AS avg_target, round(n / (SELECT sum(n) FROM g WHERE place < 3), 6) AS pct_obs{out} FROM g"""


def q08_quantiles(spark, d):
    return _intervals(stats.interval_stats(table(spark, d, "orders", "o_totalprice"), "o_totalprice", "y", bins=10, with_kind=True))


def q09_duplicate_edges(spark, d):
    return _intervals(stats.interval_stats(table(spark, d, "lineitem", "l_quantity"), "l_quantity", "y", bins=50, with_kind=True))


EDGES = [1000.0, 20000.0, 40000.0, 60000.0]


def q10_manual_edges(spark, d):
    return _intervals(stats.interval_stats(table(spark, d, "lineitem", "l_extendedprice"), "l_extendedprice", "y", bins=EDGES, with_kind=True))


def q11_missing_intervals(spark, d):
    return _intervals(stats.interval_stats(table(spark, d, "events", "if(event_id % 7 = 0, null, value) AS v"), "v", "y", bins=20, with_kind=True))


def q12_full_intervals(spark, d):
    df = table(spark, d, "lineitem", "l_extendedprice", "l_quantity", "l_discount * 10 AS p")
    return _intervals(stats.interval_stats(df, "l_extendedprice", "y", pred="p", weights="l_quantity", bins=20, with_kind=True), "avg_pred")


def q13_edges(spark, d):
    h = Histogram(table(spark, d, "orders", "o_totalprice"), "o_totalprice", "y", as_double=True)
    edges = stats.quantile_edges(h, 50)
    h.release()
    return spark.createDataFrame([(i + 1, e) for i, e in enumerate(edges)], "nr int, edge double")


def _auc_sql(source: str) -> str:
    return f"""WITH s AS ({source}), h AS (SELECT v, count(*) AS n, sum(y) AS p FROM s WHERE v IS NOT NULL GROUP BY v),
c AS (SELECT n, p, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM h), t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(p * (b + (n + 1) / 2.0)) AS DOUBLE) AS r FROM c)
SELECT round(2 * (r - p * (p + 1) / 2) / (p * (n - p)) - 1, 9) AS gini FROM t"""


def q14_gini(spark, d):
    g = gini(table(spark, d, "lineitem", "l_quantity"), "l_quantity", "y")
    return spark.createDataFrame([(round(g, 9),)], "gini double")


def _scored(spark, d) -> DataFrame:
    df = table(spark, d, "lineitem", "l_extendedprice")
    bins = stats.interval_stats(df, "l_extendedprice", "y", bins=10)
    return scoring.assign(df, "l_extendedprice", bins, "avg_target")


def q15_gini_binned(spark, d):
    return spark.createDataFrame([(round(gini(_scored(spark, d), "score", "y"), 9),)], "gini double")


def q16_score_intervals(spark, d):
    out = _scored(spark, d).groupBy(F.round("score", 6).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("pos"))
    return out


def q17_score_levels(spark, d):
    df = table(spark, d, "lineitem", "l_linenumber")
    bins = stats.discrete_stats(df.where("l_linenumber < 5"), "l_linenumber", "y")
    out = scoring.assign(df, "l_linenumber", bins, "avg_target")
    return out.groupBy("l_linenumber").agg(F.round(F.max("score"), 6).alias("score"), F.count(F.lit(1)).alias("n"))


def q18_catalogue(spark, d):
    types = ColumnTypes(read(spark, f"{d}/lineitem.parquet"))
    return types.frame(spark).select("column_name", "analytical_type", "role")


def q19_split(spark, d):
    root = tree.make_tree(table(spark, d, "orders", "o_totalprice"), "o_totalprice", "y", max_depth=1, min_samples_leaf=100)
    return spark.createDataFrame([(root.threshold, root.left.n, root.right.n)] if root.left else [], "threshold double, n_left long, n_right long")


def q20_tree(spark, d):
    return _intervals(tree.tree_stats(table(spark, d, "orders", "o_totalprice"), "o_totalprice", "y", max_depth=1, min_samples_leaf=100, with_kind=True))


def q20b_tree_deep(spark, d):
    return _intervals(tree.tree_stats(table(spark, d, "orders", "o_totalprice"), "o_totalprice", "y", max_depth=3, min_samples_leaf=100, with_kind=True))


def _types(spark, d):
    df = table(spark, d, "lineitem", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    types = ColumnTypes(df)
    types.set_role("y", "target")
    return df, types


def q21_batch(spark, d):
    df, types = _types(spark, d)
    return _round(batch.level_stats(df, types), "sum_target", "n_obs", "avg_target")


def q22_ranking(spark, d):
    df, types = _types(spark, d)
    out = batch.ranking(spark, batch.gen_report_objects(df, types))
    return _round(out, "gini", "gini_binned")


def q23_join(spark, d):
    docs, labels = read(spark, f"{d}/documents.parquet", ["doc_id", "n_chars"]), read(spark, f"{d}/labels.parquet", ["doc_id", "quality"])
    return _intervals(stats.interval_stats(docs.join(labels, "doc_id"), "n_chars", "quality", bins=10, with_kind=True))


def q24_chart(spark, d):
    return _round(batch.chart_data(stats.discrete_stats(table(spark, d, "lineitem", "l_linenumber"), "l_linenumber", "y")), "avg_target", "size").select("x", "avg_target", "size")


def q25_auto(spark, d):
    return _levels(batch.calc(table(spark, d, "lineitem", "l_tax"), "l_tax", "y"))


def q26_warning(spark, d):
    return batch.calc(table(spark, d, "lineitem", "l_linenumber", "cast(l_orderkey % 40 as string) AS v"), "v", "y")


def q27_leaves(spark, d):
    root = tree.make_tree(table(spark, d, "orders", "o_totalprice"), "o_totalprice", "y", max_depth=1, min_samples_leaf=100)
    out = tree.leaf_info(spark, root, "o_totalprice")
    return out.select("lower_bound", "upper_bound", "samples", F.col("class_stats")["1"].alias("positives"))


def q28_labels(spark, d):
    out = stats.interval_stats(table(spark, d, "lineitem", "l_quantity"), "l_quantity", "y", bins=8)
    return out.select("nr", "bin", F.round("n_obs", 6).alias("n_obs"))


def q29_level_scores(spark, d):
    """Scores of a variable of many levels, joined by their values."""
    df = table(spark, d, "lineitem", "l_partkey")
    bins = stats.discrete_stats(df.where("l_partkey % 3 > 0"), "l_partkey", "y", with_kind=True)
    out = scoring.assign(df, "l_partkey", bins, "avg_target")
    return out.groupBy(F.round("score", 6).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("levels"))


def q30_leaf_paths(spark, d):
    root = tree.make_tree(table(spark, d, "orders", "o_totalprice"), "o_totalprice", "y", max_depth=1, min_samples_leaf=100)
    out = tree.leaf_info(spark, root, "o_totalprice")
    return out.select(F.array_join("intervals", " and ").alias("path"), "samples", F.round(F.col("class_probs")["1"], 6).alias("rate"))


def q31_distinct(spark, d):
    names = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    counts = distinct_counts(read(spark, f"{d}/lineitem.parquet", names), names)
    return spark.createDataFrame(list(counts.items()), "column_name string, n long")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("q") and k[1].isdigit()}


SPLIT = """h AS (SELECT o_totalprice AS v, count(*) AS n, sum(CAST(o_orderstatus = 'F' AS INT)) AS p FROM orders GROUP BY 1),
c AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) AS cn, CAST(sum(p) OVER (ORDER BY v) AS DOUBLE) AS cp, CAST((SELECT sum(n) FROM h) AS DOUBLE) AS n, CAST((SELECT sum(p) FROM h) AS DOUBLE) AS p FROM h),
k AS (SELECT *, 2 * cp * (cn - cp) / cn + 2 * (p - cp) * ((n - cn) - (p - cp)) / (n - cn) AS cost FROM c WHERE nx IS NOT NULL AND cn >= 100 AND n - cn >= 100),
best AS (SELECT (v + nx) / 2 AS threshold, cn, n, cp, p FROM k WHERE cost < 2 * p * (n - p) / n - 1e-12 * n ORDER BY cost, v LIMIT 1)"""


def _tree_sql(p: str, source: str, depth: int, least: int) -> str:
    """CTEs of a tree's growth over the values and positives of ``source``; the thresholds are in {p}t."""
    out = [f"{p}h0 AS (SELECT v, '' AS node, count(*) AS n, sum(y) AS p FROM ({source}) WHERE v IS NOT NULL GROUP BY v)"]
    for k in range(depth):
        out.append(
            f"""{p}c{k} AS (SELECT node, v, lead(v) OVER w AS nx, CAST(sum(n) OVER w AS DOUBLE) AS cn, CAST(sum(p) OVER w AS DOUBLE) AS cp, CAST(sum(n) OVER (PARTITION BY node) AS DOUBLE) AS n, CAST(sum(p) OVER (PARTITION BY node) AS DOUBLE) AS p FROM {p}h{k} WINDOW w AS (PARTITION BY node ORDER BY v)),
{p}k{k} AS (SELECT *, 2 * cp * (cn - cp) / cn + 2 * (p - cp) * ((n - cn) - (p - cp)) / (n - cn) AS cost FROM {p}c{k} WHERE nx IS NOT NULL AND cn >= {least} AND n - cn >= {least} AND p > 0 AND p < n),
{p}b{k} AS (SELECT node, (v + nx) / 2 AS cut FROM {p}k{k} WHERE cost < 2 * p * (n - p) / n - 1e-12 * n QUALIFY row_number() OVER (PARTITION BY node ORDER BY cost, v) = 1),
{p}h{k + 1} AS (SELECT v, CASE WHEN cut IS NULL THEN h.node WHEN v <= cut THEN h.node || 'L' ELSE h.node || 'R' END AS node, n, p FROM {p}h{k} h LEFT JOIN {p}b{k} b ON h.node = b.node)"""
        )
    return ",\n".join(out) + f",\n{p}t AS (" + " UNION ".join(f"SELECT cut FROM {p}b{k}" for k in range(depth)) + ")"


def _gini_sql(p: str, scores: str) -> str:
    """A CTE {p}g of the Gini of a score: ``scores`` gives v, n and p of each value."""
    return f"""{p}o AS (SELECT n, p, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT v, sum(n) AS n, sum(p) AS p FROM ({scores}) GROUP BY v)),
{p}g AS (SELECT 2 * (r - p * (p + 1) / 2) / (p * (n - p)) - 1 AS gini FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(p * (b + (n + 1) / 2.0)) AS DOUBLE) AS r FROM {p}o))"""


def _ranking_sql() -> str:
    parts, rows = [], []
    for i, c in enumerate(("l_linenumber", "l_discount", "l_tax", "l_linestatus")):
        source = _source("lineitem", f"{c} AS v")
        parts.append(_gini_sql(f"d{i}", f"SELECT rate AS v, n, p FROM (SELECT sum(y) / CAST(count(*) AS DOUBLE) AS rate, count(*) AS n, sum(y) AS p FROM ({source}) GROUP BY v)"))
        rows.append(f"SELECT '{c}' AS variable, gini, gini AS gini_binned FROM d{i}g")
    for i, c in enumerate(("l_quantity", "l_extendedprice")):
        source = _source("lineitem", f"{c} AS v")
        parts.append(_tree_sql(f"t{i}", source, 3, 100))
        parts.append(_gini_sql(f"r{i}", f"SELECT v, count(*) AS n, sum(y) AS p FROM ({source}) GROUP BY v"))
        parts.append(_gini_sql(f"n{i}", f"SELECT sum(p) / CAST(sum(n) AS DOUBLE) AS v, sum(n) AS n, sum(p) AS p FROM t{i}h3 GROUP BY node"))
        rows.append(f"SELECT '{c}', r{i}g.gini, n{i}g.gini FROM r{i}g, n{i}g")
    return "WITH " + ",\n".join(parts) + f" SELECT CAST(row_number() OVER (ORDER BY gini_binned DESC, variable) AS INT) AS place, variable, round(gini, 6) AS gini, round(gini_binned, 6) AS gini_binned FROM ({' UNION ALL '.join(rows)})"


def oracle_sql() -> dict[str, str]:
    line = _source("lineitem", "l_linestatus, l_linenumber, l_quantity, l_discount * 10 AS p, l_extendedprice, l_tax")
    manual = "e AS (SELECT unnest([" + ", ".join(map(str, EDGES)) + "]) AS edge)"
    price = _source("orders", "o_totalprice AS v")
    number = "CAST(l_linenumber AS VARCHAR)"
    scored = f"WITH s AS ({_source('lineitem', 'l_extendedprice AS v')}), {_ranks_sql(10)}, i AS (SELECT edge AS lo, lead(edge) OVER (ORDER BY edge) AS hi, row_number() OVER (ORDER BY edge) AS j FROM e), b AS (SELECT s.v, s.y, i.lo FROM s JOIN i ON i.hi IS NOT NULL AND (v > lo OR (j = 1 AND v = lo)) AND v <= hi), z AS (SELECT b.y, sum(b.y) OVER (PARTITION BY lo) / CAST(count(*) OVER (PARTITION BY lo) AS DOUBLE) AS score FROM b)"
    levels = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {'printf(%s, %s)' % (chr(39) + '%s' + chr(39), c) if c == 'l_linestatus' else f'CAST({c} AS VARCHAR)'} AS bin, CAST(sum(y) AS DOUBLE) AS sum_target, CAST(count(*) AS DOUBLE) AS n_obs, round(sum(y) / CAST(count(*) AS DOUBLE), 6) AS avg_target FROM s GROUP BY 2"
        for c in ("l_linenumber", "l_discount", "l_tax", "l_linestatus")
    )
    return {
        "q01_discrete": _levels_sql(line, "l_linestatus"),
        "q02_numeric": _levels_sql(line, number).replace(" FROM a", ", TRY_CAST(bin AS DOUBLE) AS discrete FROM a"),
        "q03_weighted": _levels_sql(line, "l_linestatus", "l_quantity"),
        "q04_prediction": _levels_sql(line, "l_linestatus", "l_quantity", "p"),
        "q05_missing": _levels_sql(line, "CAST(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS VARCHAR)"),
        "q06_sorted": _levels_sql(line, number, order="t / n DESC, bin"),
        "q07_short": "SELECT bin, sum_target, n_obs, avg_target, pct_obs FROM (" + _levels_sql(line, "l_linestatus", total=False) + ")",
        "q08_quantiles": _intervals_sql(price, _ranks_sql(10)),
        "q09_duplicate_edges": _intervals_sql(_source("lineitem", "l_quantity AS v"), _ranks_sql(50)),
        "q10_manual_edges": _intervals_sql(_source("lineitem", "l_extendedprice AS v"), manual),
        "q11_missing_intervals": _intervals_sql(_source("events", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v"), _ranks_sql(20)),
        "q12_full_intervals": _intervals_sql(_source("lineitem", "l_extendedprice AS v, l_quantity, l_discount * 10 AS p"), _ranks_sql(20), "l_quantity", "p"),
        "q13_edges": f"WITH s AS ({price}), {_ranks_sql(50)} SELECT CAST(row_number() OVER (ORDER BY edge) AS INT) AS nr, edge FROM e",
        "q14_gini": _auc_sql(_source("lineitem", "l_quantity AS v")),
        "q15_gini_binned": _auc_sql(f"SELECT score AS v, y FROM ({scored} SELECT score, y FROM z)"),
        "q16_score_intervals": f"{scored} SELECT round(score, 6) AS score, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM z GROUP BY 1",
        "q17_score_levels": f"WITH s AS ({line}) SELECT l_linenumber, round(CASE WHEN l_linenumber < 5 THEN sum(y) / CAST(count(*) AS DOUBLE) END, 6) AS score, count(*) AS n FROM s GROUP BY l_linenumber",
        "q18_catalogue": "SELECT * FROM (VALUES "
        + ", ".join(f"('{c}', CASE WHEN (SELECT count(DISTINCT {c}) FROM lineitem) < 20 THEN 'discrete' ELSE 'continuous' END, 'explanatory')" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
        + ", ('l_returnflag', 'categorical', 'explanatory'), ('l_linestatus', 'categorical', 'explanatory'), ('l_shipdate', 'categorical', 'skipped')) t(column_name, analytical_type, role)",
        "q19_split": f"WITH {SPLIT} SELECT threshold, CAST(cn AS BIGINT) AS n_left, CAST(n - cn AS BIGINT) AS n_right FROM best",
        "q20_tree": _intervals_sql(price, SPLIT + ", e AS (SELECT threshold AS edge FROM best UNION SELECT min(v) - 1 FROM s UNION SELECT max(v) + 1 FROM s)"),
        "q20b_tree_deep": _intervals_sql(price, _tree_sql("x", price, 3, 100) + ", e AS (SELECT cut AS edge FROM xt UNION SELECT min(v) - 1 FROM s UNION SELECT max(v) + 1 FROM s)"),
        "q22_ranking": _ranking_sql(),
        "q28_labels": f"""WITH s AS ({_source("lineitem", "l_quantity AS v")}), {_ranks_sql(8)}, i AS (SELECT edge AS lo, lead(edge) OVER (ORDER BY edge) AS hi, row_number() OVER (ORDER BY edge) AS j FROM e),
b AS (SELECT '(' || CAST(CASE WHEN j = 1 THEN round(lo - 0.001, 3) ELSE lo END AS VARCHAR) || ', ' || CAST(hi AS VARCHAR) || ']' AS bin, lo FROM s JOIN i ON i.hi IS NOT NULL AND (v > lo OR (j = 1 AND v = lo)) AND v <= hi),
g AS (SELECT bin, lo, CAST(count(*) AS DOUBLE) AS n_obs FROM b GROUP BY 1, 2 UNION ALL SELECT 'TOTAL', 1e9, count(*) FROM s) SELECT CAST(row_number() OVER (ORDER BY lo) AS INT) AS nr, bin, n_obs FROM g""",
        "q29_level_scores": f"WITH s AS ({_source('lineitem', 'l_partkey')}), g AS (SELECT l_partkey, CASE WHEN l_partkey % 3 > 0 THEN round(sum(y) / CAST(count(*) AS DOUBLE), 6) END AS score, count(*) AS n FROM s GROUP BY 1) SELECT score, CAST(sum(n) AS BIGINT) AS n, count(*) AS levels FROM g GROUP BY 1",
        "q30_leaf_paths": f"WITH {SPLIT} SELECT printf('o_totalprice <= %.2f', threshold) AS path, CAST(cn AS BIGINT) AS samples, round(cp / cn, 6) AS rate FROM best UNION ALL SELECT printf('o_totalprice > %.2f', threshold), CAST(n - cn AS BIGINT), round((p - cp) / (n - cn), 6) FROM best",
        "q31_distinct": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n FROM lineitem" for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")),
        "q21_batch": f"WITH s AS ({_source('lineitem', 'l_linenumber, l_discount, l_tax, l_linestatus')}) {levels}",
        "q23_join": _intervals_sql("SELECT n_chars AS v, quality AS y FROM documents JOIN labels USING (doc_id)", _ranks_sql(10)),
        "q24_chart": f"WITH s AS ({line}), g AS (SELECT {number} AS x, round(sum(y) / CAST(count(*) AS DOUBLE), 6) AS avg_target, count(*) AS n FROM s GROUP BY 1) SELECT x, avg_target, round(n * 25 / (SELECT avg(n) FROM g), 6) AS size FROM g",
        "q25_auto": _levels_sql(line, "CAST(l_tax AS VARCHAR)"),
        "q26_warning": "SELECT 'Too many categorical levels' AS warning",
        "q27_leaves": f"WITH {SPLIT} SELECT NULL AS lower_bound, threshold AS upper_bound, CAST(cn AS BIGINT) AS samples, CAST(cp AS BIGINT) AS positives FROM best UNION ALL SELECT threshold, NULL, CAST(n - cn AS BIGINT), CAST(p - cp AS BIGINT) FROM best",
    }


