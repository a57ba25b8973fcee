import json

from lexiloom.sources import corpus as C


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_corpus_lines(spark, rows):
    df = spark.createDataFrame([(3, " third line  "), (1, "short"), (2, "= A heading ="), (4, None), (5, ""), (6, "the fourth one")], "i bigint, text string")
    assert [tuple(r) for r in C.corpus_lines(df, "i", 2).collect()] == [(2, "= A heading ="), (3, "third line")]
    assert rows(C.corpus_lines(df, "i", drop_headings=True)) == [(3, "third line"), (6, "the fourth one")]


def test_gold(spark, rows, tmp_path):
    path = write(tmp_path / "g.tsv", "cats\tcat:cat_N s:+PL, c:x ats:y\naides\taides:aide_N ~:+PL\ndog\td:x og:y\ndog\tdog:z\nnone\t~:x +:y\n")
    assert rows(C.gold(C.gold_tsv(spark, path))) == [("aides", ["aides"]), ("cats", ["cat", "s"]), ("dog", ["dog"])]
    odd = spark.createDataFrame([(1, None, "a:b"), (2, "", "a:b"), (3, "w", None), (4, "v", "")], "line_no bigint, word string, analyses string")
    assert rows(C.gold(odd)) == []


def test_word_counts_and_ranks(spark, rows, tmp_path):
    path = write(tmp_path / "f.json", json.dumps({"b": 2, "a": 3}))
    assert rows(C.word_counts_json(spark, path).select("word", "freq", "first_pos")) == [("a", 3, 1), ("b", 2, 0)]
    assert rows(C.ranked_words(spark, write(tmp_path / "r.txt", "the\n of \n"))) == [(0, "the"), (1, "of")]


def test_vocabulary_and_merges_round_trip(spark, rows, tmp_path):
    v = spark.createDataFrame([("b",), ("a",), ("a",)], "token string")
    C.write_vocabulary(v, str(tmp_path / "v"))
    assert rows(C.vocabulary(spark, str(tmp_path / "v"))) == [("a",), ("b",)]
    m = spark.createDataFrame([(0, "a", "b", "ab")], "rank int, a string, b string, merged string")
    C.write_merges(m, str(tmp_path / "m"))
    assert rows(C.merges(spark, str(tmp_path / "m"))) == [(0, "a", "b", "ab")]


def test_books_and_splits(spark, rows, tmp_path):
    books = spark.createDataFrame([(1, " a \n\nb\r\n"), (2, "c"), (3, None)], "id bigint, text string")
    assert rows(C.book_lines(books, "id")) == [(1, 0, "a"), (1, 2, "b"), (2, 0, "c")]
    C.write_books(books, "id", str(tmp_path / "b"), 2, 1)
    assert rows(spark.read.text(str(tmp_path / "b/subset"))) == [("a",), ("b",)]
    assert spark.read.text(str(tmp_path / "b/all")).count() == 3
    C.write_splits({"train": books, "test": books.limit(0)}, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).where("split = 'train'").count() == 4


def test_logs_examples_and_counts(spark, rows, tmp_path):
    s = spark.createDataFrame([("ab", ["a", "##b"])], "word string, pieces array<string>")
    C.write_examples(s, str(tmp_path / "e"))
    assert rows(spark.read.csv(str(tmp_path / "e"), header=True)) == [("ab", "a ##b")]
    record = spark.createDataFrame([("bpe", (1.0,))], "type string, r struct<f1:double>")
    for _ in range(2):
        C.append_log(record, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    C.write_json(record, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().r.f1 == 1.0
    C.write_word_counts(spark.createDataFrame([("a", 1), ("b", 2)], "word string, freq bigint"), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["2 b", "1 a"]
    assert C.text_lines(spark, str(tmp_path / "c")).count() == 2
