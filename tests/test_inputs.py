"""Inputs derived from the star-schema tables."""

from pyspark.sql import functions as F

from panelflow.plans import inputs
from panelflow.registry import modelling, rollups


def test_orders_are_spread_before_they_are_sorted(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    plain = inputs.snapshots(spark, d).orderBy("id", "anio").collect()
    monkeypatch.setattr(inputs, "ORDERS", 20)
    n = inputs.table(spark, d, "orders").count()
    spread = inputs.snapshots(spark, d)
    plan = spread._jdf.queryExecution().toString()
    assert "RepartitionByExpression [id" in plan and f", {-(-n // 20)}" in plan and n > 20 * 16
    assert spread.orderBy("id", "anio").collect() == plain


def test_models_read_the_dataset_without_surroundings(spark):
    d = "/root/testdata/sf0.001"
    core, whole = modelling.core(spark, d), modelling.data(spark, d)
    assert not {"n_150m", "same_brand", "income"} & set(core.columns) and {"n_150m", "same_brand", "income"} <= set(whole.columns)
    columns = [c for c in core.columns]
    assert core.orderBy("row_id").collect() == whole.select(columns).orderBy("row_id").collect()
    assert modelling.part(spark, d, "train").count() == whole.where(F.col("use") == "train").count()


def test_growing_tables_are_not_broadcast(spark):
    for df in (inputs.snapshots(spark, "/root/testdata/sf0.001"), rollups._requests(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") >= 2 and "SortMergeJoin [pk" in plan.replace("partkey", "pk")
