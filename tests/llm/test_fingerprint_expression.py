import re

from pyspark.sql import functions as F

from tessera.llm.decontamination import simhash


def test_tasks_compile_few_aggregates_for_a_fingerprint(spark):
    df = spark.createDataFrame([], "h array<bigint>").select(simhash(F.col("h")).alias("fp"))
    expression = df._jdf.queryExecution().analyzed().expressions().head().toString()
    assert len(re.findall(r"\baggregate\(", expression)) < 10
