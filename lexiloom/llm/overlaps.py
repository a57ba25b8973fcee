"""Problem 4: rows of evaluation splits that stand, the same or nearly, in the training split.

A weighted cosine join. A row is the vector of its words with weight sqrt(tf), divided by its norm, sqrt(length). If
one word sequence turns into the other by at most ``k`` changes, their word bags share at least ``longer - k`` words, and
because sqrt(a * b) >= min(a, b), their cosine is at least ``(longer - k) / sqrt(longer * shorter) >= 1 - share``: the
join at this threshold loses no case. The evaluation rows, the query set, are taken in blocks of bounded size; each
block is an inverted index by length class, sent to all tasks, and one pass over the training rows, which are never
shuffled. A training row reads the lists of its rarest words first and stops to take candidates once the rest of its
vector can't reach the threshold: by the largest weights in the lists, or by the norm that is left. A candidate is
dropped once what it has and the product of both residual norms are too little; for the others the exact dot product
and then the word edit distance, by bit vectors or for long rows by diagonals, decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lexiloom.functions.text import WORD
from lexiloom.llm.blocks import in_blocks

#: Cosines are sums of doubles; this much is left for their rounding.
EPS = 1e-9
#: Rows of more words are compared by diagonals.
BITS = 2048
PAIRS = "eval_split string, eval_id bigint, train_id bigint"


def within(a: list[str], b: list[str], k: int) -> bool:
    """Whether at most ``k`` words changed, added or dropped turn ``a`` into ``b``."""
    if abs(len(a) - len(b)) > k:
        return False
    i, m, n = 0, len(a), len(b)
    while i < min(m, n) and a[i] == b[i]:
        i += 1
    while m > i and n > i and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[i:m], b[i:n]
    if not a or not b:
        return True
    return _by_bits(a, b, k) if len(a) <= BITS else _by_diagonals(a, b, k)


def _by_bits(a: list[str], b: list[str], k: int) -> bool:
    """Myers' bit vectors: a column of the table of distances is two whole numbers, of its steps up and down."""
    at: dict[str, int] = defaultdict(int)
    for i, x in enumerate(a):
        at[x] |= 1 << i
    all_, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = all_, 0, len(a), len(b)
    for y in b:
        eq, left = at.get(y, 0), left - 1
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(across | up)) & all_, up & across
        score += bool(more & last) - bool(less & last)
        if score - left > k:
            return False
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(vertical | more)) & all_, more & vertical & all_
    return score <= k


def _by_diagonals(a: list[str], b: list[str], k: int) -> bool:
    """For long rows: how far each diagonal gets with 0, 1, ... edits. The time is that of the words and of the square of
    the edits, the memory that of the edits."""
    m, n = len(a), len(b)
    goal, reach = n - m, {0: 0}
    for e in range(k + 1):
        new = {}
        for d in range(max(-e, goal - (k - e), -m), min(e, goal + (k - e), n) + 1):
            i = reach.get(d, -2) + (e > 0)
            i = min(max(i, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1), m, n - d)
            if i < max(0, -d):
                continue
            while i < m and i + d < n and a[i] == b[i + d]:
                i += 1
            new[d] = i
        if new.get(goal) == m:
            return True
        reach = new
    return False


class Index:
    """Inverted lists over a block of query rows (split, id, words), by length class."""

    def __init__(self, rows: list[tuple[str, int, list[str]]], share: float, min_words: int) -> None:
        self.share, self.min_words, self.least = share, min_words, 1 - share
        self.rows = [(split, i, words, Counter(words)) for split, i, words in rows]
        seen = Counter(t for *_, tf in self.rows for t in tf)
        #: Rarest first; the words themselves settle ties.
        self.rank = {t: k for k, t in enumerate(sorted(seen, key=lambda t: (seen[t], t)))}
        self.lists: dict[int, dict[int, list[tuple[int, float, float]]]] = defaultdict(lambda: defaultdict(list))
        for y, (_, _, words, tf) in enumerate(self.rows):
            n, left, own = len(words), len(words), self.lists[self._class(len(words))]
            for k, f in sorted((self.rank[t], f) for t, f in tf.items()):
                left -= f
                own[k].append((y, math.sqrt(f / n), math.sqrt(left / n)))
        self.most = {c: {k: max(w for _, w, _ in p) for k, p in own.items()} for c, own in self.lists.items()}
        self.lists = {c: dict(own) for c, own in self.lists.items()}

    def _class(self, n: float) -> int:
        return math.floor(math.log(n) / -math.log(self.least) + EPS)

    def matches(self, words: list[str]) -> list[tuple[str, int]]:
        """The query rows within the edit share of ``words``."""
        n, least = len(words), self.least
        tf = Counter(words)
        known = [(self.rank[t], f) for t, f in tf.items() if t in self.rank]
        if n < self.min_words or sum(f for _, f in known) < (least * least - EPS) * n:
            return []
        known.sort()
        out = []
        for c in range(self._class(math.ceil(n * least - EPS)), self._class(n / least) + 1):
            if own := self.lists.get(c):
                out += [(split, i) for split, i, there in self._candidates(own, self.most[c], known, tf, n) if self._case(words, there)]
        return out

    def _candidates(self, own: dict, most: dict, known: list[tuple[int, float]], tf: Counter, n: int) -> Iterator[tuple[str, int, list[str]]]:
        least = self.least - EPS
        there = [(k, f) for k, f in known if k in own]
        mass = sum([f for _, f in there])
        if mass < least * least * n - EPS:  # the words of this class aren't enough, as at the first step below
            return
        terms = [(k, math.sqrt(f / n), f) for k, f in there]
        by_weight = sum([w * most[k] for k, w, _ in terms])
        has: dict[int, float] = defaultdict(float)
        for k, w, f in terms:
            opens = min(by_weight, math.sqrt(mass / n)) >= least
            if not opens and not has:
                return
            by_weight, mass = by_weight - w * most[k], mass - f
            rest, bound = math.sqrt(max(mass, 0) / n), max(by_weight, 0.0)
            if opens:
                for y, v, after in own[k]:
                    has[y] += w * v
                    if has[y] + min(bound, rest * after) < least:
                        del has[y]
            else:
                break
        for y in has:
            split, i, words, other = self.rows[y]
            small, large = (tf, other) if len(tf) < len(other) else (other, tf)
            if sum(math.sqrt(f * large[t]) for t, f in small.items() if t in large) / math.sqrt(n * len(words)) >= least:
                yield split, i, words

    def _case(self, a: list[str], b: list[str]) -> bool:
        return within(a, b, math.floor(self.share * max(len(a), len(b)) + EPS))


def _match(index: Broadcast):
    find = re.compile(WORD).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = index.value.matches
        for b in batches:
            splits, evals, trains = [], [], []
            for train, text in zip(b.column(0), b.column(1).to_pylist()):
                for split, i in matches(find(text.lower())):
                    splits.append(split)
                    evals.append(i)
                    trains.append(train.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(splits, pa.string()), pa.array(evals, pa.int64()), pa.array(trains, pa.int64())], names=["eval_split", "eval_id", "train_id"])

    return run


def overlaps(train: DataFrame, evals: dict[str, DataFrame], share: float = 0.15, min_words: int = 10, max_words: int = 500_000) -> DataFrame:
    """(eval_split, eval_id, train_id), distinct: the pairs within the edit share.

    Both rows hold at least ``min_words`` words, and changing, adding or dropping at most ``share`` times the words of
    the longer row turns one into the other. Tables: row_id, text. Null and short texts and null ids have no pair,
    repeated rows give their pair once, copies under other ids each their own. An empty table gives no rows.
    """
    spark = train.sparkSession
    corpus = train.where(F.col("row_id").isNotNull() & (F.length("text") >= 2 * min_words - 1)).select(F.col("row_id").cast("bigint"), "text")
    parts = [df.where(F.col("row_id").isNotNull() & F.col("text").isNotNull()).select(F.lit(split).alias("eval_split"), F.col("row_id").cast("bigint").alias("row_id"), "text").distinct() for split, df in evals.items()]

    def search(block: list[Row]) -> tuple[DataFrame, Broadcast]:
        index = spark.sparkContext.broadcast(Index([(r.eval_split, r.row_id, r.words) for r in block], share, min_words))
        return corpus.mapInArrow(_match(index), PAIRS), index

    pairs = in_blocks(reduce(DataFrame.unionAll, parts), min_words, max_words, search)
    return spark.createDataFrame([], PAIRS) if pairs is None else pairs.distinct()


def report(train: DataFrame, evals: dict[str, DataFrame]) -> DataFrame:
    """(eval_split, source, pairs, eval_rows, train_rows): the overlaps of each split by the evaluation row's source."""
    rows = reduce(DataFrame.unionAll, [df.select(F.lit(split).alias("eval_split"), F.col("row_id").alias("eval_id"), "source") for split, df in evals.items()]).distinct()
    return overlaps(train, evals).join(rows, ["eval_split", "eval_id"]).groupBy("eval_split", "source").agg(F.count("*").alias("pairs"), F.count_distinct("eval_id").alias("eval_rows"), F.count_distinct("train_id").alias("train_rows"))
