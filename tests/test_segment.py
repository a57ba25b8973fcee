import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.operators import metrics as M
from lexiloom.operators.segment import Tokenizer, Trie, longest_match, ranks_of, replay, replay_rows, replay_word, tokenize_texts, trie_match


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def vocab(spark, *ts):
    return spark.createDataFrame([(t,) for t in ts], "token string")


def got(df):
    return {r.word: r.pieces for r in df.collect()}


MERGES = [("b", "c", "bc"), ("a", "b", "ab")]


def test_replay_differs_from_longest(spark):
    v = ["a", "b", "c", "_", "bc", "ab"]
    assert got(Tokenizer("bpe", v, MERGES).segment(words(spark, "abc"))) == {"abc": ["a", "bc", "_"]}
    assert got(Tokenizer("bpe_long", v).segment(words(spark, "abc"))) == {"abc": ["ab", "c", "_"]}


def test_unknown_characters(spark):
    v = ["a", "b", "_", "ab"]
    assert got(Tokenizer("bpe_long", v).segment(words(spark, "abz", ""))) == {"abz": ["ab", "<unk>", "_"], "": ["_"]}
    assert got(Tokenizer("bpe", v, [("a", "b", "ab")]).segment(words(spark, "abz", ""))) == {"abz": ["ab", "<unk>", "_"], "": ["_"]}
    for kind in ("wpc", "f_wpc"):
        assert got(Tokenizer(kind, ["[UNK]", "a", "##b"]).segment(words(spark, "abz", "AB", "", None, "ab"))) == {"abz": ["[UNK]"], "AB": ["a", "##b"], "": [], "ab": ["a", "##b"]}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=0, max_size=8), min_size=1, max_size=6), st.permutations([("a", "b"), ("b", "a"), ("ab", "c"), ("a", "a"), ("aa", "b"), ("c", "_"), ("b", "c"), ("a", "bc")]))
def test_rank_table_replays_in_order(ws, order):
    order = [*order, *order[2:5]]  # pairs may come again
    ranks = ranks_of([(a, b, a + b) for a, b in order])
    for w in ws:
        split = [*w, "_"]
        for a, b in order:
            out, i = [], 0
            while i < len(split):
                hit = split[i : i + 2] == [a, b]
                out.append(a + b if hit else split[i])
                i += 1 + hit
            split = out
        assert replay_word(w, ranks, {*"abc"}, "_") == split


def test_engines_of_replay_agree(spark):
    ws = words(spark, "abcab", "cab", "zab", "")
    by_expression = ws.select("word", replay(MERGES, ["a", "b", "c"])(F.col("word")).alias("pieces"))
    assert got(by_expression) == got(replay_rows(ws, MERGES, ["a", "b", "c"]))


def test_engines_of_replay_agree_on_repeated_pairs(spark):
    again = [("ab", "c", "abc"), ("a", "b", "ab"), ("ab", "c", "abc"), ("b", "c", "bc"), ("a", "b", "ab")]
    ws = words(spark, "abc", "cabcab", "bcb", "")
    by_expression = ws.select("word", replay(again, ["a", "b", "c"])(F.col("word")).alias("pieces"))
    assert got(by_expression) == got(replay_rows(ws, again, ["a", "b", "c"])) and got(by_expression)["abc"] == ["abc", "_"]


def test_texts_of_all_kinds(spark, rows):
    docs = spark.createDataFrame([(1, "ab abz a"), (None, "ab"), (3, None), (4, ""), (1, "ab abz a")], "doc_id bigint, text string")
    for t in (Tokenizer("bpe", ["a", "b", "_", "ab"], [("a", "b", "ab")]), Tokenizer("bpe_long", ["a", "b", "_", "ab"])):
        got_ = {r.doc_id: r.pieces for r in t.texts(docs).collect()}
        assert got_ == {1: [["ab", "_"], ["ab", "<unk>", "_"], ["a", "_"]], None: [["ab", "_"]], 3: None, 4: []}
        assert rows(tokenize_texts(docs.where("doc_id is null"), t)) == [(None, 0, 0, "ab"), (None, 0, 1, "_")]


def test_joins_and_tries_agree(spark, rows):
    ws = words(spark, *{"".join(x) for x in __import__("itertools").product("abz", repeat=4)}, "a", "")
    for kind, v in (("bpe", ["a", "b", "ab", "ba_", "bab", "_"]), ("wordpiece", ["[UNK]", "a", "b", "ab", "##ab", "##b", "[ab]"])):
        a, b = longest_match(ws, vocab(spark, *v), kind), trie_match(ws, v, kind)
        assert [r[1:] for r in rows(M.same_outputs(a, b))] == [(0, True)]


def test_a_large_vocabulary_is_joined_over_salts(spark, monkeypatch):
    ws, v = words(spark, "abab", "zab", "b", ""), vocab(spark, "a", "b", "ab", "ba", "_")
    want = got(longest_match(ws, v))
    monkeypatch.setattr("lexiloom.operators.segment.MAX_BROADCAST", 0)
    assert got(longest_match(ws, v)) == want and want["abab"] == ["ab", "ab", "_"]


def test_pieces_make_the_word():
    trie = Trie(["a", "b", "ab", "_", "b_"])
    for w in ("abab", "ba", "b", ""):
        assert "".join(trie.pieces(w)) == w + "_"


def test_guards():
    for kind, v, m in (("bpe", ["a"], []), ("bpe_long", [], None), ("what", ["a"], None)):
        with pytest.raises(ValueError):
            Tokenizer(kind, v, m)
    with pytest.raises(ValueError):
        replay([], ["a"])


def test_no_words_and_empty_vocabulary(spark):
    none = words(spark, "a").where("word = 'b'")
    assert got(trie_match(none, ["a"])) == {} and got(longest_match(none, vocab(spark, "a"))) == {}
    assert got(longest_match(words(spark, "ab"), vocab(spark, "a").where("token = 'b'"))) == {"ab": ["<unk>"] * 3}


def test_texts(spark, rows):
    docs = spark.createDataFrame([(1, "ab a"), (2, None), (3, "")], "doc_id bigint, text string")
    assert rows(tokenize_texts(docs, Tokenizer("wpc", ["a", "##b"]))) == [(1, 0, 0, "a"), (1, 0, 1, "##b"), (1, 1, 0, "a")]


def test_surfaces_split_words_as_in_training(spark):
    t = Tokenizer("bpe", ["a", "b", "_"], [("b", "_", "b_")])
    assert got(t.surfaces(words(spark, "a-b", "1999", "B"))) == {"a-b": ["a", "b"], "1999": [], "B": ["b"]}
    assert got(Tokenizer("wpc", ["a", "##b"]).surfaces(words(spark, "ab", "1999"))) == {"ab": ["a", "b"], "1999": ["[UNK]"]}
