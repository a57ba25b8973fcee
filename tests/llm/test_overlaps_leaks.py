import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import leaks as L
from lexiloom.llm import overlaps as O


def words(t):
    return re.findall(r"[a-z]+(?:'[a-z]+)?", t.lower())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def near(a, b):
    longer = max(len(a), len(b))
    return min(len(a), len(b)) >= 10 and 100 * distance(a, b) <= 15 * longer


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 5))
def test_banded_distance(a, b, k):
    assert O.within(a, b, k) == (distance(a, b) <= k)
    if abs(len(a) - len(b)) <= k:
        assert O._by_diagonals(a, b, k) == (distance(a, b) <= k)
    if a and b:
        assert O._by_bits(a, b, k) == (distance(a, b) <= k)


def test_long_rows_are_compared_in_seconds():
    rnd = random.Random(2)
    a = [str(rnd.randrange(5000)) for _ in range(60_000)]
    b = list(a)
    for _ in range(400):
        b[rnd.randrange(len(b))] = "x"
    del b[100:150]
    assert O.within(a, b, 9000) and not O.within(a, b, 300)


def edited(rnd, w, k, names):
    w = list(w)
    for _ in range(k):
        i = rnd.randrange(len(w))
        how = rnd.random()
        if how < 0.4:
            w[i] = rnd.choice(names)
        elif how < 0.7:
            w.insert(i, rnd.choice(names))
        elif len(w) > 1:
            del w[i]
    return w


def corpus(seed, n=60):
    """Rows with few words and with repeated ones, and edits of them from none to too many."""
    rnd = random.Random(seed)
    names = ["".join(rnd.choices("abcdefgh", k=3)) for _ in range(40)]
    base = [rnd.choices(names[: rnd.choice([3, 8, 40])], k=rnd.randint(8, 45)) for _ in range(n)]
    evals = [edited(rnd, rnd.choice(base), rnd.choice([0, 1, 2, 4, 7]), names) for _ in range(n)]
    return [" ".join(x) for x in base], [" ".join(x) for x in evals]


def test_index_loses_no_case():
    for seed in range(12):
        base, evals = corpus(seed)
        index = O.Index([("e", i, words(t)) for i, t in enumerate(evals) if len(words(t)) >= 10], 0.15, 10)
        got = {(i, j) for j, t in enumerate(base) for _, i in index.matches(words(t))}
        assert got == {(i, j) for i, a in enumerate(evals) for j, b in enumerate(base) if near(words(a), words(b))}
        assert got


def test_overlaps(spark, rows):
    schema = "row_id bigint, text string, source string, eval_split string"
    make = lambda texts, first: spark.createDataFrame([(first + i, t, "s", "x") for i, t in enumerate(texts)], schema)
    base, evals = corpus(99)
    base, evals = [*base, None, "", base[0], base[0].upper() + " !"], [*evals, None, " ", base[0]]
    train, valid, test = make(base, 1000), make(evals, 1).unionByName(make(evals[:5], 1)), make(evals[:10], 500)
    want = {(s, first + i, 1000 + j) for s, first, e in (("valid", 1, evals), ("test", 500, evals[:10])) for i, a in enumerate(e) for j, b in enumerate(base) if a and b and near(words(a), words(b))}
    splits = {"valid": valid, "test": test}
    assert {tuple(r) for r in O.overlaps(train, splits).collect()} == want
    many = O.overlaps(train, splits, max_words=60)  # a block for every few rows
    assert {tuple(r) for r in many.collect()} == want and many.count() == len(want)
    report = O.report(train, splits).collect()
    assert sum(r.pairs for r in report) == len(want) and {r["source"] for r in report} == {"s"}
    none = train.where("row_id = 0")
    assert rows(O.overlaps(none, splits)) == [] and rows(O.overlaps(train, {"valid": none})) == [] and rows(O.report(none, splits)) == []


def test_patterns_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        run = rnd.randint(1, 5)
        items = [(i, rnd.choices("abc", k=rnd.randint(0, 9))) for i in range(5)]
        text = rnd.choices("abcd", k=rnd.randint(0, 40))
        has = {tuple(text[i : i + run]) for i in range(len(text) - run + 1)}
        want = {i for i, w in items if any(tuple(w[k : k + run]) in has for k in range(len(w) - run + 1))}
        assert L.Patterns(items, run).search(text) == want


def test_leaked(spark, rows):
    rnd = random.Random(3)
    passage = [f"w{chr(97 + k)}" for k in range(20)]
    filler = lambda n: " ".join(rnd.choices(["x", "y", "z"], k=n))
    items = spark.createDataFrame([(1, " ".join(passage), None), (2, " ".join(passage[:11]), "s"), (3, None, "s"), (4, "", "s"), (5, "Wa! " + ", ".join(passage), "s"), (1, " ".join(passage), None)], "item_id bigint, line string, set_name string")
    texts = [filler(50) + "\n" + ",\r\n".join(passage[4:16]) + "." + filler(9), filler(9) + " ".join(passage[4:15]), None, "", " ".join(passage).upper(), filler(200_000) + " " + " ".join(passage[8:])]
    books = spark.createDataFrame([(100 + i, t, 7) for i, t in enumerate(texts)] + [(100, texts[0], 7), (None, texts[0], 7)], "book_id bigint, text string, item_id bigint")
    assert rows(L.found(books, items)) == [(i, b) for i in (1, 5) for b in (100, 104, 105)]
    assert rows(L.leaked(books, "book_id", "text", items, "item_id", "line", max_words=5)) == [(i, b) for i in (1, 5) for b in (100, 104, 105)]
    assert rows(L.report(books, items)) == [(b, 2, [1, 5]) for b in (100, 104, 105)]
    assert rows(L.found(books.where("book_id = 0"), items)) == [] and rows(L.found(books, items.where("item_id = 0"))) == []
