import os
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_learn import slow

import __spark_entry__ as E
from lexiloom import whole
from lexiloom.operators.learn import Learner, learn_rows
from lexiloom.operators.segment import MAX_EXPRESSION, Trie

TEXTS = ["The café\u2019s rock-n-roll isn't x\u00b2 cafe\u0301 old", "old \u2014 \u201cnew\u201d na\u00efve", "plain new 'words'", None, "", "\u00e9t\u00e9 -old- straße a_b \u216b-day", "plain"]


def stored(spark, path, name, df):
    df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_rare_words_of_all_texts(spark, tmp_path):
    counts = Counter(w for t in TEXTS if t for w in re.findall(r"\b[a-z'-]+\b", t.strip().lower()))
    path = stored(spark, tmp_path, "documents", spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"))
    got = [tuple(r) for r in E.queries()["rare_words"](spark, path).collect()]
    assert got == counts.most_common()[:-1001:-1] and ("old", 3) in got and ("new", 2) in got and ("x", 1) not in got


@pytest.mark.parametrize("name, learner", [("bpe_merges_lex", whole.BPE), ("bpe_merges_naive", whole.NAIVE), ("wp_merges_lex", whole.WP), ("wp_merges_first_seen", whole.WP_SLOW)])
def test_learners_go_on_until_nothing_is_left_to_merge(spark, tmp_path, name, learner):
    texts = ["the other mother gathers feathers", "another weather, whether or not; the banana bandana", "it's rather a matter of the leather's letters"]
    path = stored(spark, tmp_path, "documents", spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    merges = slow(Counter(w for t in texts for w in re.findall(r"[a-z]+(?:'[a-z]+)?", t.lower())), learner)[0]
    got = sorted(tuple(r) for r in E.queries()[f"{name}_whole"](spark, path).collect())
    assert got == merges and len(merges) > 20


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=9), st.integers(1, 4), min_size=1, max_size=14), st.sampled_from([("bpe", "_", "append"), ("wordpiece", None, "stop"), ("wordpiece", None, "skip")]), st.sampled_from(["lex", "first_seen"]))
def test_long_runs_equal_the_plain_learner(freqs, how, tie):
    kind, end, duplicate = how
    learner = Learner(kind, 200, tie, end, duplicate)
    steps, split = learn_rows(list(freqs.items()), learner)
    merges, vocab, slow_split = slow(freqs, learner)
    assert steps.merges == merges and steps.vocab == vocab and split == list(slow_split.values())


DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def learned(spark):
    return whole._learned(spark, DATA, "bpe", "wp")


@needs_data
def test_segmenters_use_a_learned_model(spark, learned):
    bpe, wp = learned
    assert len(bpe.merges) > MAX_EXPRESSION and len(wp.vocab) > 1000
    got = {r.word: r.pieces for r in E.queries()["bpe_tokenize_whole"](spark, DATA).collect()}
    known = set(bpe.vocab)
    for word in sorted(got)[::40]:
        split = "".join(f"|{c if c in known else '<unk>'}|" for c in word) + "|_|"
        for a, b, m in bpe.merges:
            split = split.replace(f"|{a}||{b}|", f"|{m}|")
        assert got[word].split(" ") == [x for x in split.split("|") if x]
    trie = Trie(wp.vocab, "wordpiece")
    assert all(r.pieces.split(" ") == trie.pieces(r.word) for r in E.queries()["wp_encode_whole"](spark, DATA).collect())


@needs_data
def test_the_record_is_of_a_model_learned_from_wiki(spark, learned):
    row = E.queries()["eval_run_whole"](spark, DATA).first()
    small = E.queries()["eval_run"](spark, DATA).first()
    assert row.train_data == "wiki" and row.vocab_size == len(learned[0].vocab) > small.vocab_size
    assert 1 <= row["avg_fertility_1k"] < small["avg_fertility_1k"]


@needs_data
def test_both_wordpiece_learners_are_compared_at_full_size(spark):
    assert E.queries()["learner_comparison_whole"](spark, DATA).first().n_merges > 120
