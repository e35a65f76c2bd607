import numpy as np
import pandas as pd
import pytest

from stratlens.functions.binning import interval_labels, quantile_ranks
from stratlens.operators import batch, scoring, stats, tree
from stratlens.operators.histogram import Histogram, gini
from stratlens.plans import report
from stratlens.sources.tables import ColumnTypes

NUM = ["sum_target", "n_obs", "avg_target", "pct_obs"]


@pytest.fixture(scope="module")
def f1(spark):
    rows = zip("aaadbbc", [1, 1, 0, 0, 1, 0, 1], [2.0, 1, 1, 1, 1, 1, 1])
    return spark.createDataFrame([(x, y, float(w)) for x, y, w in rows], "x string, y int, w double").cache()


@pytest.fixture(scope="module")
def f2(spark):
    return spark.createDataFrame(list(zip([1, 1, 1, 8, 2, 2, 3], [1, 1, 0, 0, 1, 0, 1])), "x long, y int").cache()


@pytest.fixture(scope="module")
def f3(spark):
    return spark.createDataFrame(list(zip(map(float, [1, 1, 1, 8, 2, 2, 3, "nan"]), [1, 1, 0, 0, 1, 0, 1, 1])), "x double, y int").cache()


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_categorical(f1):
    out = stats.discrete_stats(f1, "x", "y")
    assert out.columns == stats.ORDER
    assert rows(out, "nr", "bin", "discrete", "sum_target", "n_obs") == [(1, "a", "a", 2, 3), (2, "b", "b", 1, 2), (3, "c", "c", 1, 1), (4, "d", "d", 0, 1), (5, "TOTAL", "TOTAL", 4, 7)]


def test_weights_and_short(f1):
    out = stats.discrete_stats(f1, "x", "y", weights="w", min_info=True)
    assert out.columns == ["bin", *NUM]
    assert rows(out, *NUM) == [(3, 4, 0.75, 0.5), (1, 2, 0.5, 0.25), (1, 1, 1, 0.125), (0, 1, 0, 0.125), (5, 8, 0.625, 1)]


def test_sorted_with_missing(f3, f2):
    out = stats.discrete_stats(f3, "x", "y", sort_by="avg_target")
    assert rows(out, "bin", "discrete") == [("<NA>", None), ("8.0", 8), ("2.0", 2), ("1.0", 1), ("3.0", 3), ("TOTAL", None)]
    assert [r[0] for r in rows(stats.discrete_stats(f2, "x", "y", sort_by="avg_target", ascending=False), "bin")] == ["3", "1", "2", "8", "TOTAL"]


def test_intervals(f3):
    out = rows(stats.interval_stats(f3, "x", "y", bins=2), "bin", "od", "do", "mean", "median", "n_obs")
    assert out[0] == ("<NA>", None, None, None, None, 1) and out[1] == ("(0.999, 2.0]", 1, 2, 1.4, 1, 5) and out[2] == ("(2.0, 8.0]", 2, 8, 5.5, 5.5, 2)
    assert out[3][3] == pytest.approx(18 / 7) and out[3][4] == 2
    old = rows(stats.interval_stats(f3, "x", "y", bins=2, sort_by="avg_target", legacy_edges=True), "bin", "od", "do")
    assert old[1:3] == [("(2.0, 8.0]", 1, 2), ("(0.999, 2.0]", 2, 8)]
    assert rows(stats.interval_stats(f3, "x", "y", bins=2, sort_by="avg_target"), "bin", "od")[1] == ("(2.0, 8.0]", 2)


def test_guards(spark, f1, f2):
    with pytest.raises(TypeError):
        stats.interval_stats(f1, "x", "y")
    with pytest.raises(ValueError):
        stats.discrete_stats(spark.createDataFrame([(1, None), (1, 1)], "x int, y int"), "x", "y")
    with pytest.raises(ValueError):
        stats.interval_stats(f2, "x", "y", bins="5")


@pytest.mark.parametrize("slices", [1, 1_000_000])
def test_edges_equal_pandas(spark, slices):
    rng = np.random.default_rng(0)
    x = pd.Series(np.round(rng.normal(size=500), 2))
    df = spark.createDataFrame([(float(v), int(v > 0)) for v in x], "x double, y int")
    h = Histogram(df, "x", "y", as_double=True, one_slice=slices)
    want = x.quantile([i / 20 for i in range(21)], interpolation="lower").drop_duplicates().tolist()
    assert stats.quantile_edges(h, 20) == want
    h.release()
    assert quantile_ranks(4, 3)[1] == 0


def test_labels_equal_pandas():
    rng = np.random.default_rng(1)
    for _ in range(50):
        e = sorted({float(v) for v in rng.normal(size=5) * 10.0 ** rng.integers(-3, 4)})
        assert interval_labels(e) == [str(i) for i in pd.cut(pd.Series(e), e, include_lowest=True).cat.categories]


def test_gini_tree_score(f2):
    assert gini(f2, "x", "y") == pytest.approx(-0.25)
    root = tree.make_tree(f2, "x", "y", 1, 1)
    assert root.threshold == 5.5 and tree.make_tree(f2, "x", "y", 1, 2).threshold == 1.5
    table = stats.discrete_stats(f2.where("x < 8"), "x", "y")
    got = {r["x"]: r["score"] for r in scoring.assign(f2, "x", table, "avg_target").collect()}
    assert got[8] is None and got[3] == 1
    spans = stats.interval_stats(f2, "x", "y", bins=[0, 2, 5, 10])
    assert {r["x"]: r["score"] for r in scoring.assign(f2, "x", spans, "avg_target").collect()}[2] == 0.6
    with pytest.raises(ValueError):
        scoring.assign(f2, "x", [{"bin": "a", "od": 0.0, "do": 1.0, "v": 1}, {"bin": "b", "od": 2.0, "do": 3.0, "v": 1}], "v")


def test_outside_constant_empty(spark, f2):
    out = rows(stats.interval_stats(f2, "x", "y", bins=[1, 2], with_kind=True), "row_kind", "n_obs")
    assert out == [("INTERVAL", 5), ("OUT", 2), ("TOTAL", 7)]
    same = spark.createDataFrame([(5.0, 1), (5.0, 0)], "x double, y int")
    assert rows(stats.interval_stats(same, "x", "y"), "od", "do", "n_obs")[0] == (5, 5, 2)
    none = spark.createDataFrame([], "x double, y int")
    assert rows(stats.interval_stats(none, "x", "y"), "bin", "n_obs") == [("TOTAL", 0)]


def test_report(spark, f2, tmp_path):
    df = f2.withColumnRenamed("y", "target").selectExpr("*", "cast(x + 0.5 as double) as z", "'<b>' as `k<`")
    types = ColumnTypes(df, discrete_threshold=4)
    assert types.target == "target" and types.types["z"].analytical_type == "continuous"
    text = report.generate_report(batch.gen_report_objects(df, types, min_samples_leaf=2))
    report.save(text, str(tmp_path / "r.html"))
    assert "<svg" in text and "k&lt;" in text and "<h2>z</h2>" in text
    assert batch.is_warning(batch.calc(f2, "x", "y", categorical_max_levels=2))


def test_stream(spark, f2, tmp_path):
    from stratlens.streaming.scoring import score_stream

    f2.write.parquet(str(tmp_path / "in"))
    table = stats.discrete_stats(f2, "x", "y")
    stream = spark.readStream.schema(f2.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, "x", table).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").where("score is null").count() == 0


def test_oracle_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "q01_discrete" in e.queries()


def test_levels_named_like_special_rows(spark):
    """A level called TOTAL, <NA> or <OUT> is a level where the table has row_kind."""
    df = spark.createDataFrame([(x, y) for x, y in zip(["TOTAL", "TOTAL", "<NA>", "a", None, "<OUT>"], [1, 0, 1, 0, 1, 1])], "`x.y` string, y int")
    table = stats.discrete_stats(df, "x.y", "y", with_kind=True)
    got = {r["x.y"]: r["score"] for r in scoring.assign(df, "x.y", table, "avg_target").collect()}
    assert got == {"TOTAL": 0.5, "<NA>": 1.0, "a": 0.0, None: 1.0, "<OUT>": 1.0}
    assert sorted(r["x"] for r in batch.chart_data(table).collect()) == ["<NA>", "<NA>", "<OUT>", "TOTAL", "a"]
    plain = stats.discrete_stats(df, "x.y", "y")
    assert {r["x.y"]: r["score"] for r in scoring.assign(df, "x.y", plain, "avg_target").collect()}["TOTAL"] == 0.5
    with pytest.raises(Exception, match="no bin of"):
        scoring.assign(df, "x.y", table.where("bin <> 'a'"), "avg_target", on_unseen="error").collect()


def test_counts_and_labels(spark):
    df = spark.range(3000).selectExpr("id", "id % 1500 as many", "cast(0.1 as float) as f", "cast(id % 2 as boolean) as b", "cast(if(id % 3 = 0, 'inf', '1') as double) as i", "cast(id % 2 as int) as y", "if(id % 5 = 0, null, id % 19) as nineteen", "id % 20 as twenty", "id % 21 as level")
    types = ColumnTypes(df).types
    assert (types["many"].distinct, types["id"].distinct, types["nineteen"].distinct) == (1500, 3000, 19)
    assert types["nineteen"].analytical_type == "discrete" and types["twenty"].analytical_type == "continuous"
    assert rows(stats.discrete_stats(df, "f", "y"), "bin")[0] == ("0.1",)
    assert [r[0] for r in rows(stats.discrete_stats(df, "b", "y"), "bin")] == ["False", "True", "TOTAL"]
    assert rows(stats.discrete_stats(df, "i", "y"), "n_obs") == [(2000,), (1000,), (3000,)]
    as_text = df.selectExpr("cast(level as string) as v21", "cast(twenty as string) as v20", "y")
    assert batch.is_warning(batch.calc(as_text, "v21", "y")) and not batch.is_warning(batch.calc(as_text, "v20", "y"))


def test_one_class_and_weights(spark):
    df = spark.createDataFrame([(1.0, 0, 0.0), (2.0, 0, 0.0), (3.0, 0, None)], "x double, y int, w double")
    assert gini(df, "x", "y") is None and tree.make_tree(df, "x", "y", 2, 1).left is None
    out = rows(stats.discrete_stats(df, "x", "y", weights="w"), "n_obs", "avg_target", "pct_obs")
    assert out[-1] == (0.0, None, None) and len(out) == 4


def test_shared_scan_and_charts(spark, f2):
    df = f2.selectExpr("y as target", "cast(x as double) + 0.5 as a", "cast(x * 2 as double) as `b.c`", "x as d")
    types = ColumnTypes(df, discrete_threshold=3)
    tables = batch.gen_tables(df, types)
    for name in ("a", "b.c", "d"):
        assert rows(tables[name], *NUM) == rows(stats.interval_stats(df, name, "target"), *NUM)
    table, svg = batch.calc(df, "a", "target", discrete_threshold=3, plot=True)
    assert svg.count("<rect") == table.count() - 1 and "polyline" in svg
    root = tree.make_tree(df, "a", "target", 2, 1)
    assert report.tree_svg(root, "a<b").count("<rect") == 2 * len(root.leaves()) - 1 and "a&lt;b" in report.tree_svg(root, "a<b")
    assert report.markdown(table).splitlines()[0].startswith("| nr | bin |")
    two = report.variable_sections(batch.gen_report_objects(df, types, min_samples_leaf=2))
    assert two[2].index("a (") < two[2].index("b.c (") < two[2].index("d (")
