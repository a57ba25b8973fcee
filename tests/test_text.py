from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.functions import tokens as T
from lexiloom.operators import metrics as M
from lexiloom.operators import words as W


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_words(spark):
    assert one(spark, "Don't stop, 3 cafés 'quoted' rock-n-roll's", X.words) == ["don't", "stop", "caf", "s", "quoted", "rock", "n", "roll's"]
    assert one(spark, None, X.words) is None
    assert one(spark, "", X.words) == []


def test_fertility_words_keep_case_digits_and_underscores(spark):
    assert one(spark, "In 1999, a_b!", X.fertility_words) == ["In", "1999", "a_b"]


def test_rare_words_keep_hyphens(spark):
    assert one(spark, " Rock-n-roll isn't ", X.rare_words) == ["rock-n-roll", "isn't"]


def test_initial_splits(spark):
    assert one(spark, "word", T.wordpiece_split) == "|w||##o||##r||##d|"
    assert one(spark, "", T.wordpiece_split) == ""
    assert one(spark, "ab", T.chars_split) == "|a||b||_|"
    assert one(spark, "ab", lambda x: T.chars_split(x, None)) == "|a||b|"


def test_merge_replaces_from_left_without_overlap(spark):
    assert one(spark, "|a||a||a||a||a|", lambda x: T.merge(x, "a", "a", "aa")) == "|aa||aa||a|"
    assert one(spark, "|a||b||a||b|", lambda x: T.merge(x, "a", "b", "ab")) == "|ab||ab|"


def test_merged_names(spark):
    assert T.merge_name("h", "##a") == "ha" and T.merge_name("##p", "##y") == "##py"
    df = spark.createDataFrame([("h", "##a"), ("##p", "##y"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(T.merged_name(F.col("a"), F.col("b"))).collect()] == ["ha", "##py", "ab"]


def test_pairs_overlap(spark):
    assert [tuple(p) for p in one(spark, ["a", "a", "a"], T.pairs, "array<string>")] == [("a", "a"), ("a", "a")]
    assert one(spark, ["a"], T.pairs, "array<string>") == [] and one(spark, [], T.pairs, "array<string>") == []


def test_boundaries(spark, rows):
    df = spark.createDataFrame([("undoing", ["un", "do", "ing"]), ("a", ["a"]), ("", []), ("abc", ["<unk>", "c"])], "word string, pieces array<string>")
    assert rows(M.boundary_vectors(df)) == [("", []), ("a", []), ("abc", [0, 0]), ("undoing", [0, 1, 0, 1, 0, 0])]


def test_plain_drops_markers(spark):
    assert one(spark, ["a", "_"], T.plain, "array<string>") == ["a"]
    assert one(spark, ["ab_"], T.plain, "array<string>") == ["ab"]
    assert one(spark, ["a", "##b"], T.plain, "array<string>") == ["a", "b"]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, word string")


def test_word_types_have_first_places(spark, rows):
    types = W.word_types(docs(spark, "b a b", None, "", "c A"))
    assert rows(types) == [("a", 2, 0, 1), ("b", 2, 0, 0), ("c", 1, 3, 0)]
    assert [r.word for r in W.top_words(types, 2).collect()] == ["b", "a"]
    assert W.top_words(types, 0).count() == 3


def test_rarest_words_with_ties_last_seen_first(spark):
    types = W.word_types(docs(spark, "x y z"))
    assert [r.word for r in W.rarest_words(types, 2).collect()] == ["z", "y"]


def test_empty_corpus(spark, rows):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert rows(W.corpus_stats(none)) == [(0, 0, 0)]
    assert rows(W.word_types(none)) == [] and rows(W.fertility_tokens(none)) == []


def test_first_tokens_in_order(spark):
    assert [tuple(r) for r in W.first_tokens(docs(spark, "a b", "c d"), 3).collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
