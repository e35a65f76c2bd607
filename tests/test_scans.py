"""Variables share scans, and cached histograms have partitions for their rows."""

from stratlens.operators.histogram import Histogram, level_histograms, packs
from stratlens.sources.tables import HEAD, distinct_counts


def test_cached_partitions_follow_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        h = Histogram(spark.range(3000).selectExpr("cast(id % 300 as double) as x", "cast(id % 2 as int) as y"), "x", "y", one_slice=100)
        assert h.values.count() == 300 and h.values.rdd.getNumPartitions() < 8
        assert h.ordered.count() == 300 and h.ordered.rdd.getNumPartitions() < 8
        assert h.at_ranks([0, 9, 10, 1505, 2999]) == {0: 0, 9: 0, 10: 1, 1505: 150, 2999: 299}
        h.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_levels_of_several_variables_at_once(spark):
    df = spark.range(5000).selectExpr("if(id % 7 = 0, null, id % 7) as a", "if(id % 5 = 0, 'NaN', cast(id % 5 as string)) as b", "if(id % 3 = 0, double('NaN'), double(id % 3)) as `c.d`", "cast(id % 2 as int) as y")
    assert packs({"a": 6, "b": 5, "c.d": 2}) == [["c.d", "b", "a"]] and packs({"a": 100, "b": 100}) == [["a"], ["b"]] and packs({}) == []
    found, tables = level_histograms(df, {"a": 6, "b": 5, "c.d": 2}, "y")
    assert len(tables) == 1 and list(found) == ["a", "b", "c.d"]
    for name, h in found.items():
        own = Histogram(df, name, "y", keep=False)
        columns = own.values.columns
        assert h.values.select("value").dtypes == own.values.select("value").dtypes
        assert sorted(map(str, h.values.select(columns).collect())) == sorted(map(str, own.values.collect()))
        h.release()
    for t in tables:
        t.unpersist()


def test_counts_where_the_first_rows_mislead(spark):
    df = spark.range(4 * HEAD, numPartitions=1).selectExpr(f"if(id < {2 * HEAD}, 1, id) as late", f"if(id < {2 * HEAD}, null, cast(id % 3000 as double)) as none", "id % 3 as three")
    assert distinct_counts(df, ["late", "none", "three"]) == {"late": 2 * HEAD + 1, "none": 3000, "three": 3}
