from pagelight.operators import correction, tokens
from pagelight.streaming.texts import run_available, run_batches, stream_table


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"word {i} wlth don’t") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_table(spark, str(tmp_path / "in"), df.schema, 1)
    run_available(tokens.tokenize(stream, "id", "text"), str(tmp_path / "out"), f"tokens-{tmp_path.name}").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, tokens.tokenize(df, "id", "text").collect()))


def test_micro_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, "go wlth me") for i in range(10)], "id long, text string")
    words = spark.createDataFrame([("with", 9), ("go", 5)], "term string, frequency long")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = stream_table(spark, str(tmp_path / "in"), df.schema, 1)
    run_batches(stream, lambda rows: correction.correct_texts(rows, "id", "text", words), str(tmp_path / "out"), f"texts-{tmp_path.name}").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 10 and {r.corrected_text for r in out.collect()} == {"go with me"}
