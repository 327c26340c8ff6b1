"""What was fitted on a batch scores a stream unchanged."""

from pyspark.sql import functions as F

from veta.operators import ols
from veta.operators.design import ModelSpec


def test_scoring_a_stream(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") % 11).cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    df = df.withColumn("y", 2 * F.col("x") + F.when(F.col("c") == "c1", 5).otherwise(0))
    fit = ols.ols_fit(df, ModelSpec.of(["x"], ["c"]), "y")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = ols.ols_predict(stream, fit, "y").writeStream.format("memory").queryName("scored").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    row = spark.sql("select count(*) n, max(abs(residual)) e from scored").first()
    assert row["n"] == 200 and row["e"] < 1e-9
