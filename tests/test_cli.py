import pytest

from lexiloom.__main__ import main
from lexiloom.plans import experiments as X
from lexiloom.plans import store


@pytest.fixture
def files(spark, tmp_path):
    texts = ["the cat sat and the hat that", "a hen then sang and ran", None, "that hat sat"]
    spark.createDataFrame([(i, t, "wiki") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, "a line\nanother"), (2, "third")], "book_id bigint, text string").write.parquet(str(tmp_path / "books"))
    (tmp_path / "gold.tsv").write_text("cats\tcat:cat_N s:+PL\nhats\that:hat_N s:s_N\n")
    for name in ("wiki", "guten"):
        (tmp_path / f"{name}.txt").write_text("the cat sat \nand ran\n")
    return tmp_path


def run(spark, files, line):
    main([x.replace("@", str(files) + "/") for x in line.split()], spark)


def test_train_use_and_evaluate(spark, files):
    run(spark, files, "prepare --books @books --out @lines --first 2 --subset 1")
    assert spark.read.text(str(files / "lines/subset")).count() == 2
    run(spark, files, "train --learner bpe --docs @docs --models @models --data wiki --size 24")
    run(spark, files, "train --learner wpc --docs @docs --models @models --data wiki --size 30")
    run(spark, files, "tokenize --kind f_wpc --docs @docs --models @models --data wiki --size 30 --out @pieces")
    assert spark.read.parquet(str(files / "pieces")).count() > 10
    for kind, size in (("bpe", 24), ("bpe_long", 24)):
        run(spark, files, f"evaluate --kind {kind} --models @models --data wiki --size {size} --gold @gold.tsv --docs @docs --wiki @wiki.txt --guten @guten.txt --log @log --examples cats")
    assert spark.read.json(str(files / "log")).count() == 2
    run(spark, files, "compare --kinds bpe,bpe_long --models @models --data wiki --size 24 --docs @docs --log @agree")
    row = spark.read.json(str(files / "agree")).first()
    assert (row.a.type, row.b.type, row.a.vocab_size, row.a.train_data) == ("bpe", "bpe_long", 24, "wiki") and 0 <= row.result.f1 <= 1
    run(spark, files, "ambiguity --docs @docs --size 20 --words 5")


def test_saved_models_come_back(spark, files):
    run(spark, files, "train --learner naive_bpe --docs @docs --models @models --data x --size 24")
    t = store.load(spark, store.place(str(files / "models"), "bpe", "x", 24), "bpe")
    assert t.end_marker is None and t.merges[0][2] == t.merges[0][0] + t.merges[0][1]


def test_matrix_runs_every_configuration(spark, files):
    runs = spark.createDataFrame([("bpe", "wiki", 22, None), ("wpc", "wiki", 30, 1), ("wpc", "other", 30, 2)], "type string, train_data string, vocab_size int, min_pair_freq int")
    seen = []
    X.run_matrix(spark, lambda d: spark.read.parquet(str(files / "docs")), lambda t, d, c: seen.append((c["train_data"], t.kind, len(t.vocab))), str(files / "models"), runs)
    assert sorted(s[:2] for s in seen) == [("other", "wpc"), ("wiki", "bpe"), ("wiki", "wpc")]


def test_training_sets_of_the_grid(spark, monkeypatch):
    lines = spark.createDataFrame([(1, "a line of wiki text"), (1, "a line of wiki text"), (2, "short")], "row_id bigint, text string")
    books = spark.createDataFrame([(i, f"book {i}\n\nits end") for i in (3, 1, 2, 1)], "book_id bigint, text string")
    monkeypatch.setattr(X, "BOOKS", {"guten600": 1, "guten1k2": 2})
    assert [r.text for r in X.training_corpus("wiki", lines, books).collect()] == ["a line of wiki text"]
    assert sorted(r.text for r in X.training_corpus("guten600", lines, books).collect()) == ["book 1", "its end"]
    assert sorted({r.doc_id for r in X.training_corpus("guten1k2", lines, books).collect()}) == [1, 2]
    with pytest.raises(ValueError):
        X.training_corpus("other", lines, books)
