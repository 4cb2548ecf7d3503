import random

from pyspark.sql import functions as F

from holdfast.llm import common, quality
from holdfast.llm.stats import NAMES, measure, text_stats

from .cases import docs, none


def table(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        words = [rnd.choice("the of and tree river stone house light with from".split()) for _ in range(60)]
        bad = i % 4 == 0
        rows.append((i, " | ".join(words) if bad else " ".join(words) + ".", 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_accuracy_and_compiled_rules(spark):
    rows = table(spark)
    got = quality.score_quality(rows.drop("quality"), rows.select("doc_id", "quality")).join(rows, "doc_id").collect()
    assert len(got) == 400
    out = [r for r in got if r["held_out"]]
    assert out and all(r["predicted"] == r["quality"] for r in out)
    model = quality.fit_rules(rows.select(text_stats(F.col("text")).alias("stats"), F.col("quality").alias("label")))
    assert 0 < len(model.rules) < 60
    for r in rows.select(text_stats(F.col("text")).alias("stats"), model.score("stats").alias("score")).limit(40).collect():
        assert abs(r["score"] - model.score_row(r["stats"].asDict())) < 1e-12


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = table(spark)
    turned = rows.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score_quality(rows.drop("quality"), x.select("doc_id", "quality")).collect())) for x in (rows, turned))
    assert a == b


def test_rows_in_any_order_and_partitions_give_equal_scores(spark):
    rows = table(spark).withColumn("text", F.concat("text", F.lit(" "), F.repeat(F.lit("x|"), (F.col("doc_id") * 7 % 11).cast("int"))))
    noisy = rows.withColumn("quality", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    found = []
    for n in (1, 7):
        d, k = rows.drop("quality").repartition(n, F.xxhash64("doc_id", F.lit(n))), noisy.select("doc_id", "quality").repartition(n + 2)
        found.append(sorted(map(tuple, quality.score_quality(d, k).collect())))
    assert found[0] == found[1] and len({r[2] for r in found[0]}) > 3


def test_odd_rows(spark):
    known = table(spark)
    labels = known.select("doc_id", "quality")
    for df in (docs(spark), none(spark)):
        got = quality.score_quality(df, labels).collect()
        assert len(got) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
        assert quality.keep_good(df, labels).columns == df.columns
    assert len(quality.score_quality(docs(spark), labels.limit(0)).collect()) == docs(spark).count()
    assert measure(b"") == [0.0] * len(NAMES) and len(measure(b"a b")) == len(NAMES)


def test_of_two_labels_the_lower_counts(spark):
    rows = table(spark)
    both = rows.select("doc_id", "quality").union(rows.where("doc_id < 40").select("doc_id", F.lit(0)))
    low = rows.select("doc_id", F.when(F.col("doc_id") < 40, 0).otherwise(F.col("quality")).cast("int").alias("quality"))
    a, b, c = (sorted(map(tuple, quality.learnt_from(x).collect())) for x in (both, both.orderBy(F.desc("quality")), low))
    assert a == b == c
    assert 0.7 * 20 < common.bounded_sample(spark.range(100_000), 20, "id").count() < 1.5 * 20
    assert common.bounded_sample(spark.range(2_000_000), 1, "id").count() < 8  # a share under one in a million isn't none
