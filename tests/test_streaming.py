from lexiloom.streaming import words as S


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return q


def test_counts_and_pieces_over_a_stream(spark, rows, tmp_path):
    spark.createDataFrame([("a b a", "2024-01-01 00:10:00"), ("b", "2024-01-01 01:10:00"), (None, None)], "text string, at string").selectExpr("text", "cast(at as timestamp) at").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("text string, at timestamp").parquet(str(tmp_path / "in"))
    run(S.word_counts(stream()), "complete", "counts")
    assert rows(spark.table("counts")) == [("a", 2), ("b", 2)]
    run(S.windowed_word_counts(stream(), "at"), "complete", "windows")
    assert rows(spark.table("windows").select("word", "freq")) == [("a", 2), ("b", 1), ("b", 1)]
    run(S.tokenized(stream(), [("a", "_", "a_")], ["a", "b"]), "append", "pieces")
    assert rows(spark.table("pieces").select("pieces")) == [(["a_", "b", "_", "a_"],), (["b", "_"],), ([],)]
