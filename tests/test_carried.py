from pyspark.sql import functions as F

from groundwork.operators import ledgers as G
from groundwork.operators import threads as H

N = 30_000


def test_hot_keys_pass_in_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    r = spark.range(N).select(F.lit("k").alias("k"), (F.lit(N) - F.col("id")).alias("at"), F.lit(1).alias("units"), F.lit("x").alias("text"))
    r = r.unionByName(r.filter("at <= 3").withColumn("k", F.lit(None).cast("string")))
    ledger, packed = G.quota_ledger(r, ["k"], ["at"], 20_000), H.pack_batches(r, "k", "at", chars=10, items=7)
    for df, alone in ((ledger, "collect_list"), (packed, "FlatMapGroupsInPandas")):
        assert alone not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(x["k"], x["at"]): (x["allowed"], x["used_after"]) for x in ledger.collect()}
    assert got == {(k, i): (i <= 20_000, min(i, 20_000)) for k, n in (("k", N), (None, 3)) for i in range(1, n + 1)}
    got = {(x["k"], x["at"]): x["batch"] for x in packed.collect()}
    assert got == {(k, i): (i - 1) // 7 + 1 for k, n in (("k", N), (None, 3)) for i in range(1, n + 1)}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
