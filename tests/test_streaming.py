from pyspark.sql import functions as F

from holdfast.operators.predict import apply_frozen
from holdfast.streaming.frozen import score_stream


def test_stream_equals_table_and_resumes(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_quantity", "l_discount").repartition(3)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    table.write.parquet(source)
    model = spark.createDataFrame([("one", 1.0), ("q", 2.0)], "term string, value double")
    terms = {"one": F.lit(1.0), "q": F.col("l_quantity")}
    stream = spark.readStream.schema(table.schema).parquet(source)
    score_stream(stream, model, terms, out, mark).awaitTermination(120)
    want = apply_frozen(table, model, terms)
    assert spark.read.parquet(out).exceptAll(want).count() == 0 and spark.read.parquet(out).count() == table.count()
    table.limit(10).write.mode("append").parquet(source)
    score_stream(stream, model, terms, out, mark).awaitTermination(120)
    assert spark.read.parquet(out).count() == table.count() + 10
