"""Nulls, empty inputs, and plans."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import relational as R
from sparkloom.plans import frontdoor, stats
from sparkloom.sources.tables import table


def test_null_keys_join_nothing(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "j int, w string")
    assert [tuple(r) for r in R.equi_join(a, b, {"k": "j"}).collect()] == [(1, "x", 1, "p")]
    assert sorted((r.v, r.w) for r in R.equi_join(a, b, {"k": "j"}, "left").collect()) == [("x", "p"), ("y", None)]
    with pytest.raises(ValueError):
        R.equi_join(a, b, {"k": "j"}, "full")


def test_dml_keeps_rows_with_null_predicates(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -5)], "k int, v int")
    assert sorted(r.k for r in R.deleted(df, F.col("v") < 0).collect()) == [1, 2]
    assert sorted((r.k, r.v) for r in R.updated(df, F.col("v") < 0, v=F.lit(0)).collect()) == [(1, 5), (2, None), (3, 0)]
    assert R.inserted(df, df).count() == 6


def test_partial_and_final_equal_direct(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(100)] + [(5, None)], "g int, v double")
    two = {r.g: (r.total, r.n, r["mean"]) for r in R.final(R.partial(df, ["g"], F.col("v").cast("int") % 4, "v"), ["g"]).collect()}
    one = {r.g: (r.s, r.c, r.a) for r in df.groupBy("g").agg(F.sum("v").alias("s"), F.count("v").alias("c"), F.avg("v").alias("a")).collect()}
    assert two == one


def test_empty_group_and_offset(spark):
    df = spark.createDataFrame([], "k int")
    assert df.agg(F.count("*").alias("n"), F.max("k").alias("m")).first() == (0, None)
    assert R.top(spark.range(10).toDF("k"), [F.asc("k")], 3, 8).count() == 2


def test_pushdown_and_pruning(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_quantity") > F.lit(18) + 2).select("l_orderkey")
    plan = frontdoor.explained(rows)
    assert "GreaterThan(l_quantity,20.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_partial_aggregate_and_top_in_plan(spark, sf):
    orders = table(spark, sf, "orders")
    assert "partial_count" in frontdoor.explained(orders.groupBy("o_custkey").count())
    assert "TakeOrderedAndProject" in frontdoor.explained(R.top(orders.select("o_orderkey"), [F.asc("o_orderkey")], 5, 2))


def test_sql_and_ddl(spark, sf):
    assert frontdoor.sql(spark, sf, "select count(*) as n from nation").first().n == 25
    frontdoor.create_table(spark, "made", "k int, v string", key="k", buckets=4)
    spark.sql("insert into made values (1, 'a'), (2, 'b')")
    assert spark.table("made").count() == 2
    frontdoor.drop_table(spark, "made")
    assert not spark.catalog.tableExists("made")


def test_index_copy(spark, sf, tmp_path):
    found = frontdoor.create_index(table(spark, sf, "orders"), str(tmp_path / "index"), "o_orderkey")
    assert found.where("o_orderkey = 42").count() == frontdoor.index_lookup(found, "o_orderkey", 42).count() == 1
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,100), LessThan(o_orderkey,200)]" in frontdoor.explained(frontdoor.index_lookup(found, "o_orderkey", 100, 200))
    frontdoor.drop_index(spark, str(tmp_path / "index"))
    assert not (tmp_path / "index").exists()


def test_dml_in_sql(spark, sf):
    made = frontdoor.sql(spark, sf, "update nation set n_name = concat(n_name, ',x'), n_regionkey = n_regionkey + 1 where n_nationkey in (1, 2)")
    assert made.where("n_name like '%,x'").count() == 2 and made.count() == 25
    assert frontdoor.sql(spark, sf, "update nation set n_regionkey = 9").where("n_regionkey = 9").count() == 25
    assert frontdoor.sql(spark, sf, "delete from nation where n_regionkey = 0 or null").count() == 20


def test_histogram_with_ties_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, i) for i in range(5)], "v double, t int")
    got = sorted((r.b, r.cnt) for r in stats.equi_depth(df, "v", "t", 3).collect())
    assert got == [(1, 2), (2, 2), (3, 1)]
    assert sorted((r.b, r.cnt) for r in stats.equi_depth(df, "v", "t", 8).collect()) == [(i, 1) for i in range(1, 6)]
    assert stats.equi_depth(df.limit(0), "v", "t", 3).count() == 0


def test_selectivity_and_cost():
    assert stats.equal_selectivity(4) == 0.25 and stats.equal_selectivity(0) == 0
    assert stats.greater_selectivity(75, 0, 100) == 0.25 and stats.greater_selectivity(-1, 0, 100) == 1
    c = stats.Costs()
    assert c.index(3, 1e6, 1e-6) < c.scan(10_000, 1e6) < c.index(3, 1e6, 0.5)


def test_hit_ratio_and_analyze(spark):
    df = spark.createDataFrame([("a", 3, 1), ("b", 0, 0)], "g string, h int, m int")
    assert {r.g: r.hit_ratio for r in stats.hit_ratio(df, "g", "h", "m").collect()} == {"a": 0.75, "b": None}
    spark.range(100).selectExpr("id as k").write.mode("overwrite").saveAsTable("counted")
    stats.analyze(spark, "counted", ["k"])
    assert "distinct_count" in str(spark.sql("describe extended counted k").collect())
    spark.sql("drop table counted")
    spark.conf.unset("spark.sql.cbo.enabled")
