import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import mixing as M

SIZES = "doc_id bigint, source string, tokens bigint"
TARGETS = "mix_id int, source string, target_share double, max_repeats int, tokens bigint"


def sizes(spark, **n):
    data = [(1000 * k + i, s, 10 + i % 7) for k, (s, c) in enumerate(n.items()) for i in range(c)]
    return spark.createDataFrame(data, SIZES), data


def targets(spark, *rows):
    return spark.createDataFrame([(*r, 5) for r in rows], TARGETS)


def test_shares_are_met_within_the_caps(spark):
    df, data = sizes(spark, big=900, mid=300, small=20)
    mix = M.Mix(df, targets(spark, (1, "big", 0.5, 1), (1, "mid", 0.3, 2), (1, "small", 0.2, 4), (2, "big", 3.0, None), (2, "small", 1.0, None)), shard_tokens=500)
    got = {(r.mix_id, r["source"]): r for r in mix.shares().collect()}
    for r in got.values():
        assert abs(r.reached_share - r.target_share) < 0.02 and not r.short
    assert got[1, "small"].uses <= 4 and got[1, "big"].uses == 1 and got[2, "small"].uses > 4
    rows = mix.selection().collect()
    assert len({(r.mix_id, r.doc_id, r.copy) for r in rows}) == len(rows)
    for key, r in got.items():
        assert sum(x.tokens for x in rows if (x.mix_id, x["source"]) == key) == r.tokens
    shards = {}
    for r in rows:
        shards.setdefault((r.mix_id, r.shard), []).append(r.position)
    assert len(shards) > 4 and all(sorted(p) == list(range(len(p))) for p in shards.values())
    # each copy of a source spreads over the shards as its part of all does
    assert max(map(len, shards.values())) < 4 * min(map(len, shards.values()))


def test_a_given_total_puts_shares_out_of_reach(spark):
    df, data = sizes(spark, big=900, small=20)
    have = sum(n for _, s, n in data if s == "small")
    got = {r["source"]: r for r in M.Mix(df, targets(spark, (1, "big", 1.0, None), (1, "small", 1.0, 2), (1, "none", 1.0, 3)), total=6000).shares().collect()}
    assert got["small"].tokens == 2 * have and got["small"].short and got["small"].uses == 2
    assert got["none"].tokens == 0 and got["none"].reached_share == 0.0 and got["none"].short
    assert abs(got["big"].tokens - 2000) <= 8 and not got["big"].short


def test_selection_does_not_depend_on_partitions(spark, rows):
    df, _ = sizes(spark, a=200, b=50)
    t = targets(spark, (1, "a", 1.0, 1), (1, "b", 1.0, 3))
    make = lambda d: rows(M.Mix(d, t, shard_tokens=700).selection())
    assert make(df.repartition(1)) == make(df.repartition(9))


def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 0), (None, "a", 5), (3, None, 5), (4, "b", 5), (5, "b", 5)], SIZES)
    t = targets(spark, (1, "a", 1.0, 1), (1, "a", None, 1), (1, None, 1.0, 1), (None, "a", 1.0, 1), (1, "b", -2.0, 1), (2, "b", 1.0, 0), (3, "b", 1.0, -4))
    mix = M.Mix(df, t)
    assert [(r.mix_id, r["source"], r.tokens) for r in sorted(mix.shares().collect(), key=lambda r: r.mix_id)] == [(1, "a", 5), (2, "b", 0), (3, "b", 0)]
    assert [(r.doc_id, r.copy) for r in mix.selection().collect()] == [(1, 0)]


def test_repeated_target_rows_add_up(spark):
    df, _ = sizes(spark, a=50, b=50)
    got = {r["source"]: r for r in M.Mix(df, targets(spark, (1, "a", 1.0, 9), (1, "a", 1.0, 2), (1, "b", 2.0, None))).shares().collect()}
    assert got["a"].target_share == 0.5 and got["b"].target_share == 0.5


def test_empty_tables(spark, rows):
    df, _ = sizes(spark, a=5)
    t = targets(spark, (1, "a", 1.0, 1))
    none = M.Mix(df.where("doc_id < 0"), t)
    assert rows(none.selection()) == [] and [r.reached_share for r in none.shares().collect()] == [0.0]
    none = M.Mix(df, t.where("mix_id = 9"))
    assert rows(none.selection()) == [] and rows(none.shares()) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 5))
def test_splitting_tree_is_exact(counts, shards, seed):
    counts = np.array(counts, np.int64)
    parts = [M.split_counts(counts, shards, k, seed, 1) for k in range(shards)]
    at = np.zeros_like(counts)
    for k, (first, n) in enumerate(parts):
        assert (first == at).all() and (n >= 0).all()
        total = int(counts.sum())
        assert n.sum() == (k + 1) * total // shards - k * total // shards
        at = at + n
    assert (at == counts).all()


@pytest.mark.skipif(not os.path.exists(M.RANKS), reason="no vocabulary")
def test_token_sizes(spark, rows):
    docs = spark.createDataFrame([(1, "a", "Hello world"), (2, "a", None), (3, None, ""), (4, "b", "<|endoftext|>")], "doc_id bigint, source string, text string")
    assert rows(M.token_sizes(docs)) == [(1, "a", 2), (2, "a", 0), (3, None, 0), (4, "b", 7)]
    assert M.mix(docs, targets(spark, (1, "a", 1.0, 1))).selection().count() == 1


@pytest.mark.parametrize("n", [1, 2, 7, 60, 1000])
def test_units_are_permuted(spark, n):
    rows = spark.range(n).selectExpr("id", "1 as mix_id", "'s' as source")
    assert sorted(r.u for r in rows.select(M._permuted(rows.id, M.F.lit(n), 8).alias("u")).collect()) == list(range(n))


def test_many_targets_are_joined_over_salts(spark, rows, monkeypatch):
    df, _ = sizes(spark, a=200, b=50)
    t = targets(spark, (1, "a", 1.0, 1), (1, "b", 1.0, 3), (2, "a", 1.0, 2))
    want = rows(M.Mix(df, t, shard_tokens=700).selection())
    monkeypatch.setattr(M, "MAX_SIDE", 0)
    monkeypatch.setattr(M, "SHARDS_A_ROW", 2)
    assert rows(M.Mix(df, t, shard_tokens=700).selection()) == want and want
