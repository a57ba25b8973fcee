import pytest

from lexiloom.operators import metrics as M
from lexiloom.operators.segment import Tokenizer
from lexiloom.plans import experiments as X


def segs(spark, **pieces):
    return spark.createDataFrame([(w, p.split()) for w, p in pieces.items()], "word string, pieces array<string>")


def first(df):
    return df.first().asDict(recursive=True)


def test_type_and_text_metrics(spark):
    s = segs(spark, ab="a ##b", a="a", z="[UNK]")
    m = first(M.type_metrics(s))
    assert (m["n_pieces"], m["unk_rate"], m["single_rate"], m["single_known_rate"]) == (4, 1 / 3, 2 / 3, 1 / 3)
    f = spark.createDataFrame([("ab", 3), ("a", 1), ("other", 9)], "word string, freq bigint")
    m = first(M.text_metrics(f, s))
    assert (m["n_tokens"], m["n_pieces"], m["avg_pieces"]) == (4, 7, 7 / 4)


def test_empty_metrics_are_zero(spark):
    none = segs(spark, a="a").where("word = 'b'")
    assert first(M.type_metrics(none))["avg_pieces"] == 0.0
    assert first(M.gold_scores(none.withColumnRenamed("pieces", "surfaces"), none))["f1"] == 0.0
    a = first(M.agreement(none, none))
    assert a["kappa"] is None and a["per_word_f1"] == 0.0


def test_gold_scores(spark):
    gold = segs(spark, undoing="un do ing", cats="cat s", a="a").withColumnRenamed("pieces", "surfaces")
    m = first(M.gold_scores(gold, segs(spark, undoing="un doing", cats="ca ts")))
    assert (m["precision"], m["recall"]) == (1 / 2, 1 / 3)
    assert m["f1"] == 2 / 5 and m["avg_spw_pred"] == 5 / 3 and m["avg_spw_gold"] == 2.0
    assert m["per_word_f1"] == round((2 / 3) / 3, 9)


def test_agreement_by_hand(spark):
    a, b = segs(spark, abcd="a b cd", xy="xy", pq="pq"), segs(spark, abcd="a bc d", xy="xy", pq="p q")
    m = first(M.agreement(a, b))
    # vectors 110 0 0 and 101 0 1
    n, sx, sy, i = 5, 2, 3, 1
    po, pe = (n - (sx + sy - 2 * i)) / n, (sx * sy + (n - sx) * (n - sy)) / n**2
    assert m["kappa"] == pytest.approx((po - pe) / (1 - pe))
    assert m["f1"] == 2 / 5 and m["per_word_kappa"] == pytest.approx((-0.5 + 1 + 0) / 3, abs=1e-6)


def test_same_outputs(spark):
    assert first(M.same_outputs(segs(spark, a="a"), segs(spark, a="a")))["same_outputs"] is True
    assert first(M.same_outputs(segs(spark, a="a"), segs(spark, a="b", c="c"))) == {"n_words": 2, "n_different": 2, "same_outputs": False}


def test_freq_words_and_bands(spark):
    ranked = spark.createDataFrame([(0, "a"), (1, "ab"), (2, "b")], "rank int, word string")
    m = first(M.freq_words_metrics(ranked, segs(spark, a="a", ab="a b", b="b"), band=2))
    assert m == {"avg_fertility_1k": 1.5, "avg_fertility_10k": 4 / 3, "n_preserved_1k": 1, "n_preserved_10k": 2}


def test_numbers_cost_nothing_in_bpe_and_one_piece_in_wordpiece(spark):
    lines = spark.createDataFrame([("wiki", "in 1999"), ("wiki", None)], "domain string, text string")
    bpe = first(M.domain_fertility(lines, Tokenizer("bpe", ["i", "n", "_"], [("i", "n", "in")])))
    wp = first(M.domain_fertility(lines, Tokenizer("wpc", ["in"])))
    assert (bpe["n_words"], bpe["n_pieces"], wp["n_pieces"]) == (2, 1, 2)


def test_domains(spark):
    f = spark.createDataFrame([("wiki", 2.0), ("guten", 3.0)], "domain string, fertility double")
    assert first(M.in_out_domain(f, "guten600")) == {"in_domain": 3.0, "out_domain": 2.0}
    with pytest.raises(ValueError):
        M.in_out_domain(f, "news")


def test_matrix_and_ambiguity(spark):
    m = X.experiment_matrix(spark)
    assert m.count() == 18 and m.where("min_pair_freq IS NULL").count() == 6
    types = spark.createDataFrame([("abab", 5, 0, 0), ("bab", 2, 0, 1), ("cab", 1, 0, 2)], "word string, freq bigint, first_doc bigint, first_pos int")
    rate, examples = X.ambiguity_report(types, 9)
    assert first(rate)["n_words"] == 3 and examples.columns == ["word", "freq", "standard", "longest"]


def test_whole_runs(spark):
    docs = spark.createDataFrame([(1, "the cat and the hat"), (2, None)], "doc_id bigint, text string")
    row = X.wordpiece_experiment(docs, docs, vocab_size=20, race_types=3).first()
    assert row.tokenization_comparison.same_outputs and row.corpus_statistics.tokens == 5
    gold = spark.createDataFrame([("cats", ["cat", "s"])], "word string, surfaces array<string>")
    ranked = spark.createDataFrame([(0, "the")], "rank int, word string")
    tok = Tokenizer("wpc", ["c", "##a", "##t", "##s", "the"])
    lines = spark.createDataFrame([("wiki", "the cats"), ("guten", "cats")], "domain string, text string")
    row = X.evaluate(tok, gold, ranked, ranked.select("word"), lines, {"type": "wpc", "train_data": "wiki", "vocab_size": 5, "min_pair_freq": 1}).first()
    assert row.on_freq_words.n_preserved_1k == 1 and row.avg_fert_per_wt.out_domain == 4.0
    other = X.evaluate(tok, gold, ranked, ranked.select("word"), lines, {"type": "wpc", "train_data": "news", "vocab_size": 5}).first()
    assert other.avg_fert_per_wt is None and other.min_pair_freq is None
    assert X.compare(tok, tok, ranked).first().per_word_f1 == 0.0
