import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import heavy as H
from lexiloom.llm import terms as Q

SCHEMA = "row_id bigint, chunk_id bigint, word string, freq bigint, term string, total bigint"


def table(spark, data):
    return spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA)


def sample(n=3000, seed=1):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        w = rnd.choice(["the", "The ", "\tTHE"]) if rnd.random() < 0.3 else rnd.choice(["w%d" % int(rnd.paretovariate(0.7)), None, " ", "", "Rare%d" % i])
        data.append((i, rnd.choice([*range(40), None]), w, rnd.choice([None, 0, -3, 1, 2, 7])))
    return data + rnd.sample(data, n // 10)


def brute(data):
    total, chunks, all_chunks = Counter(), defaultdict(set), set()
    for _, c, w, f in set(data):
        w = (w or "").strip(" \t").lower()
        if w and f and f > 0:
            total[w] += f
            if c is not None:
                chunks[w].add(c)
                all_chunks.add(c)
    return total, chunks, len(all_chunks)


def test_counts_and_marks(spark, rows):
    data = sample()
    total, chunks, n = brute(data)
    df = table(spark, data).repartition(7)
    assert rows(Q.term_counts(Q.clean_rows(df))) == sorted(((w, t, len(chunks[w])) for w, t in total.items()), key=repr)
    marks = [(w, "rare") for w, t in total.items() if t < 5 or len(chunks[w]) <= 1] + [(w, "common") for w in total if len(chunks[w]) >= 0.3 * n and chunks[w]]
    assert rows(Q.found(df)) == sorted(marks, key=repr)


def test_one_hot_term_over_many_tasks(spark, rows):
    data = [(i, i % 50, "hot", 1) for i in range(25_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert rows(Q.term_counts(Q.clean_rows(table(spark, data)))) == [("hot", 25_000, 50)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def grams(docs, max_n):
    want, where = Counter(), defaultdict(set)
    for d, t in enumerate(docs):
        t = [x for x in t or [] if x is not None]
        for n in range(1, max_n + 1):
            for i in range(len(t) - n + 1):
                g = (n, " ".join(t[i : i + n]))
                want[g] += 1
                where[g].add(d)
    return sorted(((*g, c, len(where[g])) for g, c in want.items()), key=repr)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_ngrams(spark, rows, batch):
    rnd = random.Random(batch)
    docs = [["a", "b", "a", "b", "a"], ["a", "b"], [], ["c", None, "a"], None, ["a"] * 40, ["b\tx", "b", "a", "b\tx"]]
    docs += [rnd.choices(["a", "b", "c", "ab", "b!", "\u00e9"], k=rnd.randint(0, 30)) for _ in range(40)]
    df = spark.createDataFrame([(t, 9, "x") for t in docs], "toks array<string>, n int, term string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for n in (1, 2, 3, 5):
            assert rows(Q.ngram_counts(df, "toks", n)) == grams(docs, n)
        assert rows(Q.ngram_counts(df.where("n = 1"), "toks")) == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_record_over_many_tasks(spark, rows):
    # one word of one chunk holds most rows: its rows spread, its chunk counts once
    data = [(i, 1, "hot", 1) for i in range(9000)] + [(i, 2, "hot", 1) for i in range(9000, 9100)] + [(i, None, "hot", 1) for i in range(9100, 9200)]
    assert rows(Q.term_counts(Q.clean_rows(table(spark, data + data[:500])))) == [("hot", 9200, 2)]


def test_no_rows(spark, rows):
    none = table(spark, [(1, 1, None, 1)])
    for f in (Q.found, Q.marked_terms, H.found):
        assert rows(f(none)) == [] and rows(f(none.where("row_id = 9"))) == []


def test_rows_without_ids(spark, rows):
    data = [(None, None, "a", 1), (None, None, "a", 1), (1, None, "a", 2), (1, None, "a", 2)]
    assert rows(Q.term_counts(Q.clean_rows(table(spark, data)))) == [("a", 4, 0)]


def test_heavy_hitters_are_exact(spark, rows):
    data = sample(6000, 2)
    total, *_ = brute(data)
    least = sum(total.values()) / 500
    want = sorted(((w, t) for w, t in total.items() if t >= least), key=repr)
    clean = Q.clean_rows(table(spark, data))
    assert rows(H.heavy_hitters(clean).select("term", "total")) == want
    # a sketch and heaps that are far too small go the exact way
    assert rows(H.heavy_hitters(clean, bits=3, capacity=2, rows_a_block=50).select("term", "total")) == want


def test_threshold_is_met_with_equality(spark, rows):
    data = [(i, 1, f"w{i}", 1) for i in range(500)]
    assert len(rows(H.found(table(spark, data)))) == 500


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=30), min_size=1, max_size=8), st.integers(2, 6))
def test_sketch_never_counts_too_little(batches, bits):
    sketch, true = H.Sketch(bits), Counter()
    for b in batches:
        own = Counter()
        for v, w in b:
            own[v] += w
        true.update(own)
        keys = np.array([(v * 0x9E3779B97F4A7C15 + 1) & 0x7FFFFFFFFFFFFFFF for v in own], np.int64)
        est = sketch.add(keys, np.array(list(own.values()), np.int64))
        assert all(e >= true[v] for v, e in zip(own, est))
