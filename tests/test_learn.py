import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexiloom.functions import tokens as T
from lexiloom.operators import pairs as P
from lexiloom.operators.learn import Learner, _Counts, _Heap, _next_merges, _Steps, fast_bpe, fast_wordpiece, learn, learn_distributed, learn_rows, naive_bpe, wordpiece
from lexiloom.plans import experiments as X


def types(spark, freqs):
    return spark.createDataFrame([(w, n, 0, i) for i, (w, n) in enumerate(freqs.items())], "word string, freq bigint, first_doc bigint, first_pos int")


WORDS = {"banana": 3, "bandana": 2, "nab": 5, "aaaa": 4, "abab": 1, "q": 7, "it's": 2}
LEARNERS = [fast_bpe(30, max_merges=12), naive_bpe(30, max_merges=12), wordpiece(40, max_merges=12), fast_wordpiece(40, max_merges=12), fast_wordpiece(40, min_pair_freq=4)]


def slow(freqs, learner):
    """A learner written plainly: all counts anew at each step."""
    if learner.kind == "wordpiece":
        split = {w: [w[0], *("##" + c for c in w[1:])] for w in freqs}
    else:
        split = {w: [*w, *([learner.end_marker] if learner.end_marker else [])] for w in freqs}
    vocab = learner.specials() + [s for s in sorted({t for s in split.values() for t in s}) if s not in learner.specials()]
    merges, skipped = [], set()
    while len(vocab) < learner.vocab_size and len(merges) < (learner.max_merges or 10**9):
        pairs, symbols = {}, Counter()
        for w, s in split.items():
            for t in s:
                symbols[t] += freqs[w]
            for p in zip(s, s[1:]):
                pairs[p] = pairs.get(p, 0) + freqs[w]
        if learner.kind == "wordpiece":
            pairs = {p: n / (symbols[p[0]] * symbols[p[1]]) for p, n in pairs.items() if n >= learner.min_pair_freq}
        pairs = {p: n for p, n in pairs.items() if p not in skipped}
        if not pairs:
            break
        best = max(pairs, key=pairs.get) if learner.tie == "first_seen" else min(pairs, key=lambda p: (-pairs[p], p))
        merged = learner.name(*best)
        if merged in vocab and learner.on_duplicate == "skip":
            skipped.add(best)
            continue
        for w, s in split.items():
            out, i = [], 0
            while i < len(s):
                hit = tuple(s[i : i + 2]) == best
                out.append(merged if hit else s[i])
                i += 1 + hit
            split[w] = out
        if merged in vocab and learner.on_duplicate == "stop":
            break
        merges.append((len(merges), *best, merged))
        vocab.append(merged)
    return merges, vocab, split


@pytest.mark.parametrize("learner", LEARNERS, ids=range(len(LEARNERS)))
def test_both_engines_equal_the_plain_learner(spark, learner):
    merges, vocab, split = slow(WORDS, learner)
    for engine in (learn, learn_distributed):
        model = engine(types(spark, WORDS), learner)
        assert model.merges == merges and model.vocab == vocab
        assert {r.word: T_tokens(r.sp) for r in model.splits.collect()} == split


def T_tokens(sp):
    return [t for t in sp.split("|") if t]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("abc", min_size=1, max_size=7), st.integers(1, 9), min_size=1, max_size=8), st.sampled_from([("bpe", "lex", "_", "append"), ("bpe", "first_seen", None, "append"), ("wordpiece", "lex", None, "skip"), ("wordpiece", "first_seen", None, "stop")]))
def test_incremental_counts_equal_the_plain_learner(freqs, how):
    kind, tie, end, duplicate = how
    learner = Learner(kind, 60, tie, end, duplicate, max_merges=15)
    steps, split = learn_rows(list(freqs.items()), learner)
    merges, vocab, slow_split = slow(freqs, learner)
    assert steps.merges == merges and steps.vocab == vocab and split == list(slow_split.values())


def test_ties(spark):
    freqs = {"ba": 1, "ab": 1}
    assert learn(types(spark, freqs), Learner("bpe", 9, "lex", None, max_merges=1)).merges == [(0, "a", "b", "ab")]
    assert learn(types(spark, freqs), naive_bpe(9, max_merges=1)).merges == [(0, "b", "a", "ba")]


def test_small_vocabulary(spark):
    with pytest.raises(ValueError):
        learn(types(spark, WORDS), fast_bpe(3))
    assert learn(types(spark, WORDS), fast_wordpiece(3)).merges == []


def test_no_words(spark):
    none = types(spark, {"x": 1}).where("freq > 1")
    model = learn(none, fast_bpe(10))
    assert model.merges == [] and model.vocab == [T.UNK, T.END]


def test_rows_that_do_not_count(spark):
    odd = spark.createDataFrame([("ab", 2), (None, 5), ("", 5), ("ba", 0), ("ba", None)], "word string, freq bigint")
    assert learn(odd, Learner("bpe", 9, "lex", None)).merges == [(0, "a", "b", "ab")]
    with pytest.raises(ValueError):
        learn(odd, naive_bpe(9))


def test_pair_and_symbol_counts(spark, rows):
    s = spark.createDataFrame([("|a||a||a||_|", 3)], "sp string, freq bigint")
    assert rows(P.pair_freq(s)) == [("a", "_", 3), ("a", "a", 6)]
    assert rows(P.symbol_freq(s)) == [("_", 3), ("a", 9)]


def test_scores_tie_and_threshold(spark, rows):
    s = spark.createDataFrame([("|a||##b|", 2), ("|a||##c|", 1)], "sp string, freq bigint")
    assert rows(P.pair_scores(s)) == [("a", "##b", 2, 1 / 3), ("a", "##c", 1, 1 / 3)]
    assert rows(P.pair_scores(s, 2)) == [("a", "##b", 2, 1 / 3)]
    assert rows(P.pair_score(s, "a", "##c")) == [(1 / 3,)] and rows(P.pair_score(s, "a", "##c", 2)) == [(0.0,)] and rows(P.pair_score(s, "x", "y")) == [(0.0,)]


def test_learner_race(spark):
    row, seconds = X.learner_comparison(types(spark, WORDS), 20)
    assert row.count() == 1 and set(seconds) == {"baseline", "fast"}
    assert X.engine_comparison(types(spark, WORDS), fast_bpe(20))


@pytest.mark.parametrize("kind, end, duplicate", [("bpe", "_", "append"), ("wordpiece", None, "skip")])
def test_merges_of_one_job_are_those_of_single_steps(spark, kind, end, duplicate):
    rnd = random.Random(8)
    freqs = {"".join(rnd.choices("abcdefgh", weights=[9, 7, 5, 4, 3, 2, 1, 1], k=rnd.randint(1, 9))): rnd.randint(1, 40) for _ in range(60)}
    learner = Learner(kind, 10**6, "lex", end, duplicate, max_merges=40)
    merges, vocab, split = slow(freqs, learner)
    model = learn_distributed(types(spark, freqs), learner)
    assert model.merges == merges and model.vocab == vocab
    assert {r.word: T_tokens(r.sp) for r in model.splits.collect()} == split


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=9), st.integers(1, 30), min_size=1, max_size=12), st.sampled_from([None, "_"]))
def test_no_batch_takes_a_merge_too_early(freqs, end):
    learner = Learner("bpe", 10**6, "lex", end, max_merges=30)
    merges, vocab, _ = slow(freqs, learner)
    split = {w: [*w, *([end] if end else [])] for w in freqs}
    steps = _Steps(learner, sorted({x for s in split.values() for x in s}))
    counted = lambda: Counter(p for w, s in split.items() for p in zip(s, s[1:]) for _ in range(freqs[w]))
    counts = _Counts(dict(counted()), {})
    heap, touched = _Heap(steps, counts.pairs, {}, lambda p: ()), set(counts.pairs)
    while got := _next_merges(steps, heap, counts, touched):
        before = counted()
        for a, b, m in got:
            split = {w: T.merged_tokens(s, a, b, m) for w, s in split.items()}
        after = counted()
        touched |= counts.change((*p, after[p] - before[p]) for p in before | after if after[p] != before[p])
    assert steps.merges == merges
