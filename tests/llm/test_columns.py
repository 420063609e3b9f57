from pyspark.sql import functions as F

from recordgauge.llm.columns import bucket, per_text, with_columns


def test_columns_are_replaced_in_any_case(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "`a.b` int, SCORE string, `q``c` double")
    out = with_columns(df, score=F.length("SCORE"), more=F.lit(3))
    assert out.columns == ["a.b", "q`c", "score", "more"]
    assert out.first()[:4] == (1, 2.0, 1, 3)


def test_bucket_is_crc32_of_the_decimal_text(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 7, -12, 10**15, None)], "doc_id long")
    for r in df.select("doc_id", bucket("doc_id", 5).alias("b")).collect():
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.b == zlib.crc32(text.encode()) % 5


def test_a_function_of_a_text_runs_once_a_row(spark):
    count = spark.sparkContext.accumulator(0)

    def size(text):
        count.add(1)
        return len(text or "")

    df = spark.createDataFrame([("a",), (None,), ("abc",)], "t string")
    counted = df.select(per_text(size, "int")("t").alias("n"))
    assert counted.where("n > 0").select("n", (F.col("n") + 1).alias("m")).count() == 2
    assert count.value == 3
