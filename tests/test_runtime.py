from pyspark.sql import functions as F

from corpusloom import runtime


def test_durable_rounds_forget_sizes(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    for _ in range(6):
        df = runtime.durable_round(df.join(df.select(F.col("k").alias("k2")).distinct(), F.col("k") == F.col("k2")).drop("k2"))
    assert df.count() == 10 and df.columns == ["id", "k"]
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64


def test_checkpoint_folder_is_the_sessions(spark):
    runtime.ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()
