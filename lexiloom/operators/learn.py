"""Learners of subword vocabularies: byte-pair encoding and WordPiece.

Both repeat one step: pick the best adjacent pair of the current splits, merge it everywhere. The splits of the word
types are written once and stay a DataFrame; the driver holds only counts by pair and symbol, whose number the vocabulary
bounds, and a heap of the pairs. A step is one job over the words that contain the pair; it returns how the counts
change. One job takes all the next merges of byte-pair encoding of which none can be changed by those before: they
share no token, and no new pair can get as frequent. Every ``CUT_EVERY`` jobs the splits are checkpointed. Ties are settled
by the pair itself (``lex``) or by the first place in corpus order (``first_seen``, where the distributed engine counts
anew at each step, as a first place can't be kept up by differences).

Small type tables (at most ``max_local`` rows, checked) are learned in a single task with an index from pairs to words;
the steps and results are the same.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import tokens as T
from lexiloom.operators.pairs import pair_freq, symbol_freq
from lexiloom.plans.lineage import cut, written

CUT_EVERY = 10
#: Most merges of one job.
BATCH = 32
MERGES = "rank int, a string, b string, merged string"


@dataclass(frozen=True)
class Learner:
    """What to learn. ``kind``: bpe (pair frequency) or wordpiece (association score). ``on_duplicate``: what follows if
    the best pair makes a token the vocabulary has: append it again, stop, or skip the pair for good."""

    kind: str = "bpe"
    vocab_size: int = 1000
    tie: str = "lex"
    end_marker: str | None = T.END
    on_duplicate: str = "append"
    min_pair_freq: int = 1
    max_merges: int | None = None

    def split(self, word):
        return T.wordpiece_split(word) if self.kind == "wordpiece" else T.chars_split(word, self.end_marker)

    def specials(self) -> list[str]:
        return [T.WP_UNK] if self.kind == "wordpiece" else [T.UNK, *([self.end_marker] if self.end_marker else [])]

    def name(self, a: str, b: str) -> str:
        return T.merge_name(a, b) if self.kind == "wordpiece" else a + b


def fast_bpe(vocab_size: int, **more) -> Learner:
    """With an end marker and lexical ties."""
    return Learner("bpe", vocab_size, **more)


def naive_bpe(vocab_size: int, **more) -> Learner:
    """Without a marker, ties by corpus order."""
    return Learner("bpe", vocab_size, "first_seen", None, **more)


def wordpiece(vocab_size: int, **more) -> Learner:
    """Ties by corpus order, ends at the first duplicate."""
    return Learner("wordpiece", vocab_size, "first_seen", None, "stop", **more)


def fast_wordpiece(vocab_size: int, **more) -> Learner:
    """Lexical ties, duplicates are skipped."""
    return Learner("wordpiece", vocab_size, "lex", None, "skip", **more)


@dataclass
class Model:
    """What was learned: the merges in order, the vocabulary in order, and the splits of the types."""

    learner: Learner
    merges: list[tuple[int, str, str, str]]
    vocab: list[str]
    splits: DataFrame = field(repr=False)

    def merges_df(self, spark: SparkSession) -> DataFrame:
        """(rank, a, b, merged)."""
        return spark.createDataFrame(self.merges, MERGES)

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        """(id, token)."""
        return spark.createDataFrame(list(enumerate(self.vocab)), "id int, token string")


class _Steps:
    """The loop's bookkeeping on the driver or in a task: what to merge next, and when to stop."""

    def __init__(self, learner: Learner, initial: list[str]) -> None:
        self.learner, self.merges = learner, []
        self.vocab = [*learner.specials(), *(s for s in initial if s not in learner.specials())]
        self.have, self.stopped, self.skipped = set(self.vocab), False, set()
        if learner.kind == "bpe" and learner.vocab_size <= len(self.vocab):
            raise ValueError(f"vocab_size must be over the {len(self.vocab)} tokens of the start")

    def open(self) -> bool:
        most = self.learner.max_merges
        return not self.stopped and len(self.vocab) < self.learner.vocab_size and (most is None or len(self.merges) < most)

    def score(self, n: int, fa: int, fb: int) -> float:
        return n / (float(fa) * float(fb)) if self.learner.kind == "wordpiece" else n

    def best(self, pairs: dict, symbols: dict, first: dict | None) -> tuple[str, str] | None:
        least = self.learner.min_pair_freq if self.learner.kind == "wordpiece" else 1
        ranked = ((-self.score(n, symbols.get(p[0], 1), symbols.get(p[1], 1)), first[p] if first else p, p) for p, n in pairs.items() if n >= least and p not in self.skipped)
        return min(ranked, default=(0, 0, None))[2]

    def take(self, a: str, b: str) -> str | None:
        """Notes the merge and gives its token, null for a skipped pair. A learner that stops at a duplicate still
        rewrites its splits, but not the lists."""
        merged = self.learner.name(a, b)
        if merged in self.have and self.learner.on_duplicate != "append":
            if self.learner.on_duplicate == "skip":
                self.skipped.add((a, b))
                return None
            self.stopped = True
            return merged
        self.merges.append((len(self.merges), a, b, merged))
        self.vocab.append(merged)
        self.have.add(merged)
        return merged


def _initial(types: DataFrame, learner: Learner) -> DataFrame:
    columns = ["word", "freq", *[c for c in ("first_doc", "first_pos") if c in types.columns]]
    good = types.where((F.length("word") > 0) & (F.col("freq") > 0))
    return good.select(*columns, learner.split(F.col("word")).alias("sp"))


def _counts(splits: DataFrame, learner: Learner) -> tuple[dict, dict, dict | None]:
    first = None
    if learner.tie == "first_seen":
        place = F.struct("first_doc", "first_pos", "i")
        rows = splits.select("freq", "first_doc", "first_pos", F.posexplode(T.pairs(T.tokens(F.col("sp")))).alias("i", "p"))
        got = rows.groupBy("p.a", "p.b").agg(F.sum("freq").alias("n"), F.min(place).alias("at")).collect()
        pairs, first = {(r.a, r.b): r.n for r in got}, {(r.a, r.b): tuple(r["at"]) for r in got}
    else:
        pairs = {(r.a, r.b): r.n for r in pair_freq(splits).collect()}
    symbols = {r.tok: r.f for r in symbol_freq(splits).collect()} if learner.kind == "wordpiece" else {}
    return pairs, symbols, first


def _changes(splits: DataFrame, after, learner: Learner) -> Iterator[tuple[str, str | None, int]]:
    """(a, b, n) by which the counts of the affected words change; b is null for a single token."""
    def signed(sp, sign: int):
        toks = T.tokens(sp)
        rows = F.transform(T.pairs(toks), lambda p: F.struct(p.a.alias("a"), p.b.alias("b"), F.lit(sign).alias("s")))
        if learner.kind != "wordpiece":
            return rows
        return F.concat(rows, F.transform(toks, lambda t: F.struct(t.alias("a"), F.lit(None).cast("string").alias("b"), F.lit(sign).alias("s"))))

    each = splits.select("freq", F.explode(F.concat(signed(after, 1), signed(F.col("sp"), -1))).alias("c"))
    rows = each.groupBy("c.a", "c.b").agg(F.sum(F.col("freq") * F.col("c.s")).alias("n")).where("n <> 0")
    return ((r.a, r.b, r.n) for r in rows.collect())


class _Counts:
    """The driver's counts by pair and symbol, and which pairs stand beside a token."""

    def __init__(self, pairs: dict, symbols: dict) -> None:
        self.pairs, self.symbols = pairs, symbols
        self.ending, self.starting = defaultdict(set), defaultdict(set)
        for p in pairs:
            self._note(p)

    def _note(self, p: tuple[str, str]) -> None:
        self.starting[p[0]].add(p)
        self.ending[p[1]].add(p)

    def beside(self, token: str) -> set[tuple[str, str]]:
        return self.starting[token] | self.ending[token]

    def most_new(self, a: str, b: str) -> int:
        """No pair that the merge of a and b makes is more frequent than this: it takes the place of a pair that ended
        with a or began with b."""
        around = [self.pairs.get(p, 0) for p in (self.ending[a] | self.starting[b]) if p != (a, b) or a == b]
        return min(self.pairs.get((a, b), 0), max(around, default=0))

    def change(self, rows: Iterator[tuple[str, str | None, int]]) -> set[tuple[str, str]]:
        """Adds the differences; gives the pairs whose counts are others now."""
        touched = set()
        for x, y, n in rows:
            table, key = (self.symbols, x) if y is None else (self.pairs, (x, y))
            table[key] = table.get(key, 0) + n
            if table[key] <= 0:
                del table[key]
            if y is not None:
                touched.add(key)
                self._note(key)
        return touched


def _next_merges(steps: _Steps, heap: _Heap, counts: _Counts, touched: set) -> list[tuple[str, str, str]]:
    """The next merge, and those that surely follow it whatever it changes; empty if nothing is left to merge."""
    out, used, bound = [], set(), 0
    while steps.open() and len(out) < BATCH:
        best = heap.best(touched)
        touched.clear()
        if not best:
            break
        a, b = best
        merged = steps.learner.name(a, b)
        if out and (used & {a, b, merged} or counts.pairs[best] <= bound):
            break
        alone = steps.learner.kind != "bpe" or merged in steps.have
        if out and alone:
            break
        new = counts.most_new(a, b)
        if (token := steps.take(a, b)) is None:
            continue
        out.append((a, b, token))
        heap.drop(best)
        used |= {a, b, merged}
        bound = max(bound, new)
        if alone:
            break
    for a, b, _ in out:  # what is left of them comes back with the differences
        touched.add((a, b))
    return out


def _distributed(start: DataFrame, learner: Learner) -> Model:
    """The loop over a distributed table of splits."""
    splits, since = start, 0
    steps = _Steps(learner, [r.tok for r in splits.select(F.explode(T.tokens(F.col("sp"))).alias("tok")).distinct().orderBy("tok").collect()])
    pairs, symbols, first = _counts(splits, learner)
    counts = _Counts(pairs, symbols)
    heap, touched = _Heap(steps, pairs, symbols, lambda p: ()), set(pairs)
    while steps.open():
        if learner.tie == "lex":
            merges = _next_merges(steps, heap, counts, touched)
        else:
            best = steps.best(pairs, symbols, first)
            token = steps.take(*best) if best else None
            if best and token is None:
                continue
            merges = [(*best, token)] if best else []
        if not merges:
            break
        has, after = F.lit(False), F.col("sp")
        for a, b, merged in merges:
            has, after = has | F.contains("sp", F.lit(f"|{a}||{b}|")), T.merge(after, a, b, merged)
        if learner.tie == "lex":
            touched |= counts.change(_changes(splits.where(has), after, learner))
            if learner.kind == "wordpiece":  # the scores of all pairs with these tokens are others now
                touched.update(*(counts.beside(t) for m in merges for t in m))
        splits, since = splits.withColumn("sp", after), since + 1
        if since == CUT_EVERY:
            splits, since = cut(splits), 0
        if learner.tie != "lex" and steps.open():
            pairs, symbols, first = _counts(splits, learner)
    return Model(learner, steps.merges, steps.vocab, splits)


def learn_distributed(types: DataFrame, learner: Learner) -> Model:
    """As :func:`learn`, with the distributed engine at any size."""
    return learn(types, learner, max_local=0)


class _Heap:
    """The best pair without a look at all: each pair whose score or place may have changed is pushed again, and an entry
    counts only while both are the pair's own. ``place`` gives what settles ties before the pair itself."""

    def __init__(self, steps: _Steps, pairs: dict, symbols: dict, place) -> None:
        self.steps, self.pairs, self.symbols, self.place, self.entries, self.gone = steps, pairs, symbols, place, [], set()

    def _score(self, p: tuple[str, str]) -> float | None:
        n = self.pairs.get(p, 0)
        if n < (self.steps.learner.min_pair_freq if self.steps.learner.kind == "wordpiece" else 1) or p in self.steps.skipped:
            return None
        return self.steps.score(n, self.symbols.get(p[0], 1), self.symbols.get(p[1], 1))

    def drop(self, p: tuple[str, str]) -> None:
        """Leaves out a pair until it is given as changed."""
        self.gone.add(p)

    def best(self, changed: set) -> tuple[str, str] | None:
        self.gone -= changed
        for p in changed:
            if (score := self._score(p)) is not None:
                heapq.heappush(self.entries, (-score, self.place(p), p))
        while self.entries:
            score, place, p = self.entries[0]
            if p not in self.gone and self._score(p) == -score and self.place(p) == place:
                return p
            heapq.heappop(self.entries)
        return None


def learn_rows(words: list[tuple[str, int]], learner: Learner) -> tuple[_Steps, list[list[str]]]:
    """The same loop over (word, freq) in corpus order within one process, with an index from pairs to words."""
    if learner.kind == "wordpiece":
        split = [[w[0], *(T.CONT + c for c in w[1:])] for w, _ in words]
    else:
        split = [[*w, *([learner.end_marker] if learner.end_marker else [])] for w, _ in words]
    steps = _Steps(learner, sorted({t for s in split for t in s}))
    pairs: dict = defaultdict(int)
    symbols: dict = defaultdict(int)
    where: dict = defaultdict(set)
    beside: dict = defaultdict(set)
    seen: dict = defaultdict(list)  # heaps of the words of each pair, for ties by corpus order
    touched: set = set()

    scored = learner.kind == "wordpiece"

    def add(k: int, s: list[str], sign: int) -> None:
        """Counts the tokens and pairs of ``s``, a part of word ``k``."""
        n = sign * words[k][1]
        for p in zip(s, s[1:]):
            pairs[p] += n
            touched.add(p)
            if sign > 0:
                where[p].add(k)
                if learner.tie != "lex":
                    heapq.heappush(seen[p], k)
                if scored:
                    beside[p[0]].add(p)
                    beside[p[1]].add(p)
            elif pairs[p] == 0:
                del pairs[p]
        if scored:
            for x in s:
                symbols[x] += n

    def place(p: tuple[str, str]) -> tuple[int, ...]:
        """The first word that has the pair now, and where in it."""
        if learner.tie == "lex":
            return ()
        while True:
            k = seen[p][0]
            if (i := next((i for i, q in enumerate(zip(split[k], split[k][1:])) if q == p), None)) is not None:
                return k, i
            heapq.heappop(seen[p])

    for k in range(len(split)):
        add(k, split[k], 1)
    heap = _Heap(steps, pairs, symbols, place)
    while steps.open():
        best = heap.best(touched)
        touched.clear()
        if not best:
            break
        a, b = best
        if (merged := steps.take(a, b)) is None:
            continue
        for k in sorted(where.pop(best)):
            old = split[k]
            if not any(p == best for p in zip(old, old[1:])):
                continue
            split[k] = new = T.merged_tokens(old, a, b, merged)
            lo = end = 0
            if learner.tie == "lex":  # only what has changed, with one neighbour; places move in all the word
                while old[lo] == new[lo] and lo + 1 < len(new):
                    lo += 1
                while end < len(new) - lo and old[-1 - end] == new[-1 - end]:
                    end += 1
                lo, end = max(lo - 1, 0), max(end - 1, 0)
            add(k, old[lo : len(old) - end], -1)
            add(k, new[lo : len(new) - end], 1)
        if learner.kind == "wordpiece":  # only these three symbols have another frequency now
            touched.update(*(beside[t] for t in (a, b, merged)))
    return steps, split


def _in_task(learner: Learner):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        order = frame.sort_values([c for c in ("first_doc", "first_pos", "word") if c in frame])
        steps, split = learn_rows(list(zip(order["word"], order["freq"])), learner)
        out = [("m", r, a, b, m) for r, a, b, m in steps.merges] + [("v", i, t, None, None) for i, t in enumerate(steps.vocab)]
        out += [("s", int(n), w, "".join(f"|{t}|" for t in s), None) for w, n, s in zip(order["word"], order["freq"], split)]
        return pd.DataFrame(out, columns=["kind", "n", "x", "y", "z"])

    return run


def learn(types: DataFrame, learner: Learner, max_local: int = 200_000) -> Model:
    """The vocabulary of ``types`` (word, freq, and first_doc, first_pos for ties by corpus order).

    Words without a character or a frequency over 0 don't count; the same word in two rows counts as two. BPE raises
    ValueError if ``vocab_size`` leaves no room for a merge, WordPiece then has none. Null words are dropped.
    """
    if learner.tie != "lex" and "first_doc" not in types.columns:
        raise ValueError("ties by corpus order need first_doc and first_pos")
    start = written(_initial(types, learner))  # one pass over the corpus
    if not 0 < start.limit(max_local + 1).count() <= max_local:
        return _distributed(start, learner)
    # the bound of the vocabulary is checked here, where its error can be caught
    _Steps(learner, [r.tok for r in start.select(F.explode(T.tokens(F.col("sp"))).alias("tok")).distinct().collect()])
    good = start.drop("sp")
    rows = cut(good.groupBy().applyInPandas(_in_task(learner), "kind string, n bigint, x string, y string, z string"))
    lists = sorted(map(tuple, rows.where("kind <> 's'").collect()))
    splits = rows.where("kind = 's'").select(F.col("x").alias("word"), F.col("n").alias("freq"), F.col("y").alias("sp"))
    return Model(learner, [(int(n), x, y, z) for k, n, x, y, z in lists if k == "m"], [x for k, _, x, *_ in lists if k == "v"], splits)
