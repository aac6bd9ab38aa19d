"""What plans must not do: build layers nobody asks, or work before rows are dealt."""

from conftest import SF
from pyspark.sql import functions as F

from parcelspark.operators.skew import spread
from parcelspark.queries import domain as D
from parcelspark.queries import feasibility as Q


def test_rules_are_merged_without_layers(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a layer was asked for")

    monkeypatch.setattr(D, "layer", never)
    local = Q.merged(spark, SF).where("origin = 'local'").count()
    assert local > 0 and Q.compliance_flags(spark, SF).agg(F.sum("n")).first()[0] <= local


def test_conditions_stay_behind_the_deal(spark):
    rows = spread(spark.range(100)).withColumn("heavy", F.sha2(F.col("id").cast("string"), 256)).where("heavy > '8'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2") < plan.index("Repartition") and "sha2" not in plan[plan.index("Repartition") :]
    assert 0 < rows.count() < 100 and spread(spark.range(100)).count() == 100
