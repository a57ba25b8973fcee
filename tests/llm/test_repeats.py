import random
import re
from collections import defaultdict

from lexiloom.llm import repeats as R

SCHEMA = "book_id bigint, source string, text string, line string, pattern string"


def books(spark, *rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, least=5):
    at = defaultdict(set)
    for b, s, t in set(rows):
        s = (s or "").strip().lower()
        for i, x in enumerate((t or "").split("\n")):
            letters = "".join(c for c in x if c.isalpha()).lower()
            if s and b is not None and len(x.strip()) >= 10 and letters:
                at[s, letters].add((b, i))
    return sorted({p for v in at.values() if len({b for b, _ in v}) >= least for p in v})


NOTICE = "All rights are held by the shelf, see note {}"


def test_found_equals_brute_force(spark, rows):
    data = [(i, " Shelf " if i % 2 else "SHELF", f"A line of book {chr(97 + i)} alone\n\n  {NOTICE.format(i)}\r\nShare | Print | Save\nText") for i in range(7)]
    data += [(i, "other", NOTICE.format(i)) for i in range(20, 24)]  # four books are too few
    data += [data[0], data[0], (30, None, NOTICE.format(1)), (31, " ", NOTICE.format(1)), (32, "shelf", None), (33, "shelf", ""), (None, "shelf", NOTICE.format(1))]
    data += [(34, "shelf", "123456789012\n123456789012")]
    df = books(spark, *data)
    assert rows(R.found(df)) == brute(data) and len(brute(data)) == 14


def test_lines_return_within_one_book(spark, rows):
    data = [(1, "s", "\n".join(["the same old line"] * 9)), *[(i, "s", "the same old line") for i in range(2, 6)]]
    assert rows(R.found(books(spark, *data))) == brute(data)
    assert len(brute(data[:-1])) == 0 and rows(R.found(books(spark, *data[:-1]))) == []


def test_sequences_grow(spark):
    text = "first notice line\n\nsecond notice line\nthird notice line"
    df = books(spark, *[(i, "s", text if i < 5 else "first notice line\nsecond notice line\nnothing else here") for i in range(6)])
    got = {(r.lines, r.books) for r in R.sequences(df).collect()}
    assert got == {(1, 6), (1, 5), (2, 6), (2, 5), (3, 5)}
    longest = R.prefix_span(df).where("lines = 3").select("book_id", "start_no", "end_no").distinct().collect()
    assert [tuple(r) for r in longest] == [(0, 0, 3)]
    assert R.prefix_span(df, max_lines=2).where("lines > 2").count() == 0
    assert R.prefix_span(df, max_gap=1).where("lines = 3").count() == 0


def test_cleaned_drops_the_lines_only(spark, rows):
    text = "a line to share with all\nkeep {}\r\n\nend"
    df = books(spark, *[(i, "s", text.format(i)) for i in range(5)], (9, "s", None), (10, None, "a line to share with all"))
    got = dict(rows(R.cleaned(df)))
    assert got[0] == "keep 0\r\n\nend" and got[9] is None and got[10] == "a line to share with all"


def test_no_books(spark, rows):
    none = books(spark, (1, "s", "x")).where("book_id = 2")
    assert rows(R.found(none)) == [] and rows(R.sequences(none)) == [] and rows(R.cleaned(none)) == []


def test_long_text_and_letters_of_all_scripts(spark, rows):
    line = "Все права принадлежат полке, смотри {}"
    data = [(i, "s", "\n".join(f"{re.sub('0', 'x', bin(i))} {j} own words" for j in range(3000)) + "\n" + line.format(i)) for i in range(5)]
    assert [p for p in rows(R.found(books(spark, *data))) if p[1] == 3000] == [(i, 3000) for i in range(5)]


def all_sequences(docs, least=5):
    """(lines, books, places) of all frequent sequences of lines, in any distance."""
    counts, level = [], {(): [(b, None, -1) for b in range(len(docs))]}
    while level:
        longer = defaultdict(list)
        for p, places in level.items():
            for b, start, end in places:
                for x in set(docs[b][end + 1 :]):
                    at = [i for i in range(end + 1, len(docs[b])) if docs[b][i] == x]
                    longer[(*p, x)] += [(b, i if start is None else start, i) for i in (at if start is None else at[:1])]
        level = {p: v for p, v in longer.items() if len({b for b, *_ in v}) >= least}
        counts += [(len(p), len({b for b, *_ in v}), len(v)) for p, v in level.items()]
    return sorted(counts)


def test_sequences_may_be_long_and_wide_apart(spark):
    long = [f"{'abcdefghi'[i] * 12} of the notice" for i in range(9)]
    docs = [[*long, "a byline between"] if b < 5 else [long[0], "a line of one book " + "xyzuv"[b % 5] * b, *["a byline between"] * 2, long[1], long[0]] for b in range(10)]
    df = books(spark, *[(b, "s", "\n\n\n".join(x)) for b, x in enumerate(docs)])
    got = sorted((r.lines, r.books, r.places) for r in R.sequences(df).collect())
    assert got == all_sequences(docs) and max(got)[0] == 10
    # databases over the bound are extended as tables instead
    for bound in (25,):
        assert sorted((r.lines, r.books, r.places) for r in R.prefix_span(df, max_load=bound).collect()) == got


def test_support_of_lines_with_others_between(spark):
    a, b, c = "alpha is the first line", "beta is the second line", "gamma is the third line"
    df = books(spark, *[(i, "s", "\n".join([a, b, c] if i < 6 else [a, c, b])) for i in range(12)])
    pair = R.lines(df).where("line_no = 0 or line_no = 2").where("book_id = 0").orderBy("line_no").collect()
    wide = {bytes(r.prefix): r.books for r in R.prefix_span(df, max_gap=2).collect()}
    assert wide[bytes(pair[0].line) + bytes(pair[1].line)] == 12
    near = {bytes(r.prefix): r.books for r in R.prefix_span(df, max_gap=1).collect()}
    assert near[bytes(pair[0].line) + bytes(pair[1].line)] == 6


def gapped(docs, gap, least=5):
    """(lines, books, places) of the sequences whose lines follow each other within ``gap`` lines."""
    out, level = [], {(x,): {(b, i, i) for b, d in enumerate(docs) for i, y in enumerate(d) if y == x} for x in {x for d in docs for x in d}}
    while level := {p: v for p, v in level.items() if len({b for b, *_ in v}) >= least}:
        out += [(len(p), len({b for b, *_ in v}), len(v)) for p, v in level.items()]
        longer = defaultdict(set)
        for p, v in level.items():
            for b, s, e in v:
                for i in range(e + 1, min(e + gap, len(docs[b]) - 1) + 1):
                    longer[(*p, docs[b][i])].add((b, s, i))
        level = longer
    return sorted(out)


def test_gaps_equal_brute_force(spark):
    rnd = random.Random(5)
    names = [f"{w} words make a line" for w in ("alder", "birch", "cedar", "douglas")]
    docs = [rnd.choices(names, k=rnd.randint(1, 5)) for _ in range(14)]
    df = books(spark, *[(b, "s", "\n".join(x)) for b, x in enumerate(docs)])
    for gap in (1, 2, None):
        want = all_sequences(docs) if gap is None else gapped(docs, gap)
        for bound in (0, R.MAX_LOAD):
            assert sorted((r.lines, r.books, r.places) for r in R.prefix_span(df, max_gap=gap, max_load=bound).collect()) == want


def test_many_frequent_lines_are_spread(spark, rows, monkeypatch):
    data = [(i, "s", "\n".join(f"{w} stands in every book" for w in ("one", "two", "three"))) for i in range(6)]
    monkeypatch.setattr(R, "MAX_LINES", 0)
    assert rows(R.found(books(spark, *data))) == brute(data)
    assert len(R.prefix_span(books(spark, *data), max_load=0).collect()) == 7


def test_two_texts_of_one_book(spark, rows):
    texts = ["the line that all books share\nown {}", "own {}\nand nothing of the others"]
    data = [(i, "s", texts[0].format(i)) for i in range(5)] + [(0, "s", texts[1].format(9)), (0, " S ", texts[0].format(0))]
    assert sorted(t for b, t in rows(R.cleaned(books(spark, *data))) if b == 0) == ["own 0", "own 9\nand nothing of the others"]
