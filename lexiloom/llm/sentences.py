"""Problem 8: sentence units of texts in many languages and scripts.

Whether a period ends a sentence is settled document by document. A short token is an abbreviation where the same
document has it, with its period, before a small letter; a capitalised word behind one is the start of a sentence if the
document also has the word in small letters, a proper name if it also has it capitalised within a sentence. What a
document leaves open is decided by counts over the whole corpus: tokens that hardly ever stand without a period are
abbreviations, an abbreviation whose decided cases mostly ended sentences is taken to end them, and numbers behind words
whose decided cases didn't are ordinals. Marks that can't be mistaken close by the rules of their script: Thai is parted by
white space, Greek also by its question mark, and the period is no mark within scripts that have their own.

The corpus counts are one scan with partial sums per task and a small shuffle; their tables go to the tasks as a
broadcast if they are within ``MAX_EVIDENCE`` rows, else each text gets by joins all rows that its periods can ask for,
wherever its units begin: both ways give the same units. What a document tells of its own words is gathered in one pass
over it, so the time grows with its length alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.lineage import bounded_rows, cut, spread_join

MAX_EVIDENCE = 200_000

# Marks, signs and letters.
STRONG = "!?。！？｡।॥።፧؟۔‽⁇⁈⁉"
GREEK_QUESTION = ";;"
MARKS = ".…．" + STRONG
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "〈": "〉", "“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", '"': '"'}
#: The signs that each closing sign can close.
OPENERS = {c: [o for o, own in PAIRS.items() if c in own] for c in set("".join(PAIRS.values()))}
QUOTES = "“„«‹「『\""
CLOSERS = "".join(sorted(set("".join(PAIRS.values())))) + "’"
NOTES = "¹²³⁰⁴⁵⁶⁷⁸⁹*†‡"
LIST_SIGNS = "-*•‣◦▪–"
#: Scripts whose own marks leave the period to abbreviations and numbers.
OWN_MARKS = "ऀ-෿฀-໿က-႟ሀ-᎟぀-ヿ㐀-鿿"
THAI = "ก-ฮะ-๎"
SMALL = "a-zß-öø-ÿāăąćčďđēęěğįłńňőœřśşšťūůűźżžα-ωά-ώа-яё"

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_ITEM = re.compile(rf"^[^\S\n]*(?:([{re.escape(LIST_SIGNS)}])|(\d{{1,3}})([.)]))[^\S\n]+(?=\S)", re.M)
_EVENT = re.compile(f"[{re.escape(MARKS + GREEK_QUESTION)}]+|[{re.escape(''.join(sorted(set(''.join(PAIRS) + ''.join(PAIRS.values())))))}]")
_INNER = re.compile(r"[^\W\d_]{1,2}(?:\.[^\W\d_]{1,2})+$")
_NUMBERING = re.compile(r"(?:\d+(?:\.\d+)*|[IVXLCDM]+|[^\W\d_])$")
_NOTE = re.compile(r"\[\d{1,4}\]")
_NEXT = re.compile(r"[^\W_]+")
_ADDRESS = re.compile(r"[\w-]*[./_@:][\w./_@:-]*\w")
_OWN = re.compile(f"[{OWN_MARKS}]")
_THAI = re.compile(f"[{THAI}]")
_LETTER = re.compile(r"[^\W\d_]")
_LOWER_AFTER = re.compile(rf"\.\s+(?=[{SMALL}])|\.(?=,)")
_SHORT = re.compile(r"(?<![\w.])[^\W\d_]{1,6}(?![\w.])")
_PERIOD = re.compile(r"(?<=[^\W_])\.(?![.\w])")
_ASKS = re.compile(rf"(?<=[^\W_])[{re.escape(MARKS)}]")
_SOLID = re.compile(r"\S")
# words by themselves that may begin with a small letter, those that begin with no small ASCII letter behind a space, and single letters before small words
_ALONE = re.compile(r"(?<![\w.@/])[^\W_A-Z\d][^\W_]*+(?![\w@/])")
_CAPITAL = re.compile(r"(?<=[\w,] )[^\W\d_a-z][^\W_]*+(?![\w@/])")
_ONE_LETTER = re.compile(rf"(?<![\w.])([^\W\d_]) (?=[{SMALL}])")
_OPEN = "“„«\"(¿¡ \n\r\t\xa0"
_BEFORE_NUMBER = re.compile(r"([^\W\d_]+)\s+\d{1,4}$")
#: The keys under which all single initials and all rows of three and more are counted.
INITIAL, INITIALS = "A.", "A.A.A"
#: Logarithms of how much likelier a decided start, and a possible name, make a place where sentences never end than one
#: where they do. Assumed: there one capital in 50 is seen as a start by chance; here a document decides about a quarter.
START, NAME = -2.5, 0.27
#: What is counted of each token.
COUNTS = ("bare", "period", "small", "final", "starts", "names")
#: A token and the word before it are looked for in so many characters before a period.
BACK = 48


class Evidence:
    """The corpus tables: ``ends`` has each abbreviation with whether it may end a sentence (None: unknown), and
    ``ordinal`` the words behind which a number with a period goes on."""

    def __init__(self, ends: dict[str, bool | None], ordinal: set[str]) -> None:
        self.ends, self.ordinal = ends, ordinal


class Document:
    """What one text itself tells of its words: tables of one pass each, made when a period first asks for them."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._before_small: set[str] | None = None
        self._alone: set[str] | None = None
        self._within: set[str] | None = None
        self._letters: set[str] | None = None
        self._looks = 0

    def before_small(self, token: str) -> bool:
        """Whether the token stands with its period before a small letter or a comma."""
        if self._before_small is None:
            self._before_small = {_token(self.text, 0, m.start()) for m in _LOWER_AFTER.finditer(self.text)}
        return token in self._before_small

    def letter_word(self, letter: str) -> bool:
        """Whether the letter stands by itself before a small word."""
        if self._letters is None:
            self._letters = set(_ONE_LETTER.findall(self.text))
        return letter in self._letters

    def starts(self, word: str) -> bool | None:
        """True if the capitalised word also stands in small letters, False if also capitalised within a sentence: behind
        a small letter or comma and a space."""
        small, text = word[0].lower() + word[1:], self.text
        if self._alone is None and self._looks < 8:  # a few looks at the text are cheaper than its table
            self._looks += 1
            if small in text:
                self._alone = set(_ALONE.findall(text))
        elif self._alone is None:
            self._alone = set(_ALONE.findall(text))
        if self._alone is not None and small in self._alone:
            return True
        if self._within is None:
            self._within = {m[0] for m in _CAPITAL.finditer(text) if (c := text[m.start() - 2]) == "," or c.islower()}
        return False if word in self._within else None


def _token(text: str, low: int, i: int) -> str:
    """The letters, digits and periods right before ``i``, from ``low`` on and at most ``BACK`` of them."""
    j, low = i, max(low, i - BACK)
    while j > low and ((c := text[j - 1]).isalnum() or c == "."):
        j -= 1
    return text[j:i].lstrip(".")


def _is_inner(token: str) -> bool:
    return "." in token and bool(_INNER.match(token))


def _abbreviation(token: str, doc: Document, ev: Evidence) -> bool:
    if token in ev.ends or _is_inner(token):
        return True
    if len(token) == 1 and token.isalpha():
        if token == token.lower() == token.upper():
            return True
        if token.isupper():  # an initial, unless it is a word of its own here
            return not doc.letter_word(token)
    return len(token) <= 6 and token.isalpha() and doc.before_small(token)


def _open_case(token: str, before: str) -> str | None:
    """The key under which the corpus decides a period between ``token`` and a capital; None where nothing is open."""
    if token.isdigit():
        return f"{m[1]} 0" if len(token) <= 4 and (m := _BEFORE_NUMBER.search(before)) else None
    if len(token) == 1 and token.isupper():
        return INITIAL
    if _is_inner(token):
        return INITIALS if token.isupper() and len(token) > 3 else token
    return token if len(token) <= 6 and token.isalpha() else None


class Splitter:
    """The units of one text."""

    def __init__(self, text: str, ev: Evidence) -> None:
        self.text, self.ev, self.doc, self.marked, self.tail = text, ev, Document(text), False, (0, 0)

    def units(self) -> list[tuple[int, int]]:
        text, out = self.text, []
        segments = list(self._segments())
        for a, b, words in segments:
            out += self._thai(a, b) if self._is_thai(a, b) else self._parted(a, b, words)
        if not self.marked and "\n" in text.strip():
            out = []
            for a, b, _ in segments:
                if self._is_thai(a, b):
                    out += self._thai(a, b)
                else:
                    out += [(a + m.start(), a + m.end()) for m in re.finditer(r"\S(?:[^\n]*\S)?", text[a:b])]
        return out

    def _segments(self) -> Iterator[tuple[int, int, int]]:
        """(start, end, start of the words) of what blank lines and list items part, trimmed."""
        text, at = self.text, 0
        for m in [*_BLANK.finditer(text), None]:
            a, b = at, m.start() if m else len(text)
            at = m.end() if m else b
            items: list[tuple[int, int]] = []
            number = {}
            for i in _ITEM.finditer(text, a, b):
                if i[2]:
                    # a number that opens a wrapped line is an item only in its turn
                    n, style = int(i[2]), i[3]
                    if style == "." and n != 1 and number.get(style) != n - 1 and i.start() != a:
                        continue
                    number[style] = n
                items.append((i.start(), i.end()))
            cuts = [(a, a)] if not items or items[0][0] > a else []
            cuts += items
            for (s, w), e in zip(cuts, [*(c[0] for c in cuts[1:]), b]):
                part = text[s:e]
                if body := part.strip():
                    start = s + len(part) - len(part.lstrip())
                    yield start, start + len(body), max(w, start)

    def _is_thai(self, a: int, b: int) -> bool:
        # the first Thai letter is found at once; other texts pay one search
        if not (m := _THAI.search(self.text, a, b)):
            return False
        part = self.text[m.start() : b]
        return 2 * len(_THAI.findall(part)) > len(_LETTER.findall(self.text, a, b))

    def _thai(self, a: int, b: int) -> list[tuple[int, int]]:
        text, out, start = self.text, [], a
        for m in re.finditer(r"\s+", text[a:b]):
            i, j = a + m.start(), a + m.end()
            if "\n" not in m[0] and (text[i - 1].isdigit() or text[j].isdigit()):
                continue
            out.append((start, i))
            start = j
        return [*out, (start, b)]

    def _pairs(self, events: list[re.Match]) -> dict[int, int]:
        """Outer quotations and brackets of a segment: place of the opening sign to place of the closing one."""
        stack: list[tuple[str, int]] = []
        levels: dict[str, list[int]] = {c: [] for c in PAIRS}  # where in the stack each opening sign is
        found: list[tuple[int, int]] = []
        for m in events:
            c = m[0]
            if c[0] in MARKS or c[0] in GREEK_QUESTION:
                continue
            k = max((levels[o][-1] for o in OPENERS.get(c, ()) if levels[o]), default=-1)
            if k >= 0:
                found.append((stack[k][1], m.start()))
                for o, _ in stack[k:]:
                    levels[o].pop()
                del stack[k:]
            elif c in PAIRS:
                levels[c].append(len(stack))
                stack.append((c, m.start()))
        outer, end = {}, -1
        for o, c in sorted(found):
            if o > end:
                outer[o], end = c, c
        return outer

    def _tail(self, e: int, b: int, pairs: dict[int, int]) -> int:
        """The end of the closing and note signs from ``e`` on."""
        text, begin = self.text, e
        if self.tail[0] < e <= self.tail[1]:  # a mark within the signs behind the last one
            return self.tail[1]
        while e < b:
            if (c := text[e]) in NOTES or c in MARKS or c in CLOSERS and e not in pairs:
                e += 1
            elif c == "[" and (m := _NOTE.match(text, e, b)):
                e = m.end()
            elif c in "  " and text[e + 1 : e + 2] in ("»", "”") and e + 1 < b and e + 1 not in pairs:
                e += 2
            else:
                break
        self.tail = (begin, e)
        return e

    def _parted(self, a: int, b: int, words: int) -> list[tuple[int, int]]:
        text, out, start = self.text, [], a
        events = list(_EVENT.finditer(text, a, b))
        pairs = self._pairs(events)
        skip = -1
        for m in events:
            i, c = m.start(), m[0][0]
            if i < skip:
                continue
            if c in MARKS or c in GREEK_QUESTION:
                end = self._tail(m.end(), b, pairs)
                if not self._closes(m, start, words, end, b):
                    continue
            elif i in pairs:
                skip = j = pairs[i]
                inside = text[i + 1 : j].rstrip()
                if not inside or inside[-1] not in MARKS and not (inside[-1] in GREEK_QUESTION and _greek(inside, len(inside) - 1)):
                    continue
                self.marked = True
                if (c in QUOTES) == (i == words):
                    continue
                end = self._tail(j + 1, b, pairs)
                follows = _after(text, end, b)
                if follows and (follows.islower() or _ellipsis(inside) and not follows.isupper()):
                    continue
            else:
                continue
            self.marked = True
            out.append((start, end))
            skip = end
            start = words = n.start() if (n := _SOLID.search(text, end, b)) else b
        if start < b:
            out.append((start, b))
        return out

    def _closes(self, m: re.Match, start: int, words: int, end: int, b: int) -> bool:
        text, run, i = self.text, m[0], m.start()
        if all(c in GREEK_QUESTION for c in run):
            return _greek(text, i)
        if i <= words:  # nothing to close yet, or the list sign's own period
            return False
        near = text[end : end + 1] if end < b else ""
        if any(c in STRONG for c in run):
            return not (near and end == m.end() and (near.islower() or near.isdigit() or near in "=&/"))
        follows = _after(text, end, b)
        if not follows:
            return True
        if _ellipsis(run):
            return follows.isupper()
        if run in ("．",):
            return not near.isdigit()
        return self._period(i, start, words, end, b, near, follows)

    def _period(self, i: int, start: int, words: int, end: int, b: int, near: str, follows: str) -> bool:
        text, prev = self.text, self.text[i - 1]
        token = _token(text, start, i)
        if near and not near.isspace():  # no space behind
            if not near.isalpha() and near not in PAIRS:
                return False
            around = text[max(start, i - BACK) : i].split()[-1:]
            if near.islower() or not token or len(token) == 1 or "." in token or any(c in "/@_" or c.isdigit() for c in "".join(around)):
                return False
            if not follows.isupper() and (_OWN.match(prev) or not _caseless(prev)):
                return False
            return not _abbreviation(token, self.doc, self.ev)
        if _OWN.match(prev):
            return False
        if _NUMBERING.match(text, words, i) and words >= start:
            return False
        n = _NEXT.search(text, end, min(b, end + 200))
        word = n[0] if n else ""
        if follows.islower():
            tail = _ADDRESS.match(text, n.start(), b) if n else None
            return bool(tail) and not (token and _abbreviation(token, self.doc, self.ev))
        if not token:
            return True
        if token.isdigit():
            if follows.isdigit():
                return False
            if follows.isupper() and not (case := self.doc.starts(word)):
                key = _open_case(token, text[max(start, i - BACK) : i])
                return case is None and key not in self.ev.ordinal
            return True
        if not _abbreviation(token, self.doc, self.ev):
            return True
        if not follows.isupper():
            return False
        ends = self.ev.ends.get(_open_case(token, "") or token)
        return ends if ends is not None else self.doc.starts(word) is True


def _greek(text: str, i: int) -> bool:
    before = text[max(0, i - 8) : i].rstrip(" " + CLOSERS)[-1:]
    return "Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿"


def _ellipsis(run: str) -> bool:
    """Whether the text ends with an ellipsis and no other mark."""
    tail = run[len(run.rstrip("".join(MARKS))) :]
    return ("…" in tail or ".." in tail) and not any(c in STRONG for c in tail)


def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _after(text: str, end: int, b: int) -> str:
    """The next letter or sign of the segment behind white space and opening signs; empty at its end."""
    for k in range(end, b):
        c = text[k]
        if not c.isspace() and c not in PAIRS and c not in "¿¡":
            return c
    return ""


def _clues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial corpus counts of each token: its places without and with a period, and of the latter those before a small
    letter, digit or comma, at the end of a block, and before a capital that starts a sentence or may be a name."""
    bare, period, small, final, starts, names = counts = [Counter() for _ in COUNTS]
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            bare.update(short := _SHORT.findall(text))
            doc, short = Document(text), {*short}
            for m in _PERIOD.finditer(text):
                i = m.start()
                if _OWN.match(text[i - 1]):  # no mark there
                    continue
                if not (key := _open_case(_token(text, 0, i), text[max(0, i - BACK) : i])):
                    continue
                period[key] += 1
                if key in short:  # also a word of its own here: its cases tell nothing of an abbreviation
                    continue
                n = _NEXT.search(text, i + 1, i + 40)
                gap = text[i + 1 : n.start() if n else i + 40]
                # a digit on the next line may number an item
                if gap.startswith(",") or n and not gap.strip(_OPEN) and (gap.count("\n") < 2 and n[0][0].islower() or "\n" not in gap and n[0][0].isdigit()):
                    small[key] += 1
                elif gap.count("\n") > 1 or not n:
                    final[key] += 1
                elif n[0][0].isupper() and not gap.strip(_OPEN):
                    (starts if doc.starts(n[0]) else names)[key] += 1
    keys = list(bare.keys() | period.keys())
    yield pa.RecordBatch.from_pydict({"token": keys} | {c: [n[k] for k in keys] for c, n in zip(COUNTS, counts)}, schema=pa.schema([("token", pa.string()), *((c, pa.int64()) for c in COUNTS)]))


def evidence(docs: DataFrame, usual: float = 0.1, least_z: float = 7.0, share: float = 0.5) -> DataFrame:
    """(token, ends): the corpus tables. ``ends`` is whether sentences may end with an abbreviation, by the capitals that
    follow, null if none does; tokens that close with `` 0`` are words before ordinal numbers.

    An abbreviation stands with its period in at least ``share`` of its places, and so often that chance at the
    ``usual`` share of words before a period is ruled out by ``least_z`` standard deviations. In one of twenty of these
    places a sentence goes on, or it behaves like a title: next to never at a block's end, and before names.
    A few places are enough for a token that never stands without its period and mostly has the sentence go on.
    Tokens with inner periods are abbreviations by their shape; they are here for their ``ends``.
    """
    counts = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(_clues, ", ".join(["token string", *(f"{c} bigint" for c in COUNTS)]))
    total = counts.groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS])
    seen, n = F.col("starts") + F.col("names"), F.col("period") + F.col("bare")
    goes = START * F.col("starts") + NAME * F.col("names")
    number = F.col("token").endswith(" 0") & (goes > 2.6)
    short = ~F.col("token").endswith(" 0") & (F.col("period") >= share * n) & (F.col("period") - usual * n >= least_z * F.sqrt(n * usual * (1 - usual)))
    goes_on = F.contains("token", F.lit(".")) | (20 * F.col("small") >= F.col("period")) | ((goes > 0) & (20 * F.col("final") <= F.col("period")))
    never_bare = ~F.col("token").endswith(" 0") & (F.col("bare") == 0) & (F.col("small") >= 2) & (2 * F.col("small") >= F.col("period"))
    return total.where((F.col("period") > 0) & (number | short & goes_on | never_bare)).select("token", F.when(seen > 0, goes < 0).alias("ends"))


def _tables(rows: list) -> Evidence:
    return Evidence({t: e for t, e in rows if not t.endswith(" 0")}, {t for t, _ in rows if t.endswith(" 0")})


def _emit(docs: list, units: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    ids = [d for d, u in zip(docs, units) for _ in u]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s for u in units for s, _ in u], pa.int64()), pa.array([e for u in units for _, e in u], pa.int64())], names=["doc_id", "start_pos", "end_pos"])


def _split_all(tables: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ev = tables.value
        for b in batches:
            yield _emit(b.column(0).to_pylist(), [Splitter(t, ev).units() for t in b.column(1).to_pylist()])

    return run


def _split_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [[(x["token"], x["ends"]) for x in rows or []] for rows in b.column("own").to_pylist()]
        yield _emit(b.column("doc_id").to_pylist(), [Splitter(t, _tables(rows)).units() for t, rows in zip(b.column("text").to_pylist(), own)])


def asked(text: str) -> set[str]:
    """All keys of the corpus tables that a splitter of this text can look up, wherever its units begin: a unit may begin
    within a token, behind an inner period and the note signs that follow it."""
    out = set()
    for m in _ASKS.finditer(text):
        i = m.start()
        token, before = _token(text, 0, i), text[max(0, i - BACK) : i]
        while token:
            for t in {token, token.lstrip(NOTES)} - {""}:
                out.update(k for k in (t, _open_case(t, before)) if k)
            token = token.partition(".")[2].lstrip(".")
    return out


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [sorted(asked(x)) for x in b.column("text").to_pylist()]
        at = pa.array([i for i, k in enumerate(keys) for _ in k], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("h1").take(at), b.column("h2").take(at), pa.array([t for k in keys for t in k], pa.string())], names=["h1", "h2", "token"])


UNITS = "doc_id bigint, start_pos bigint, end_pos bigint"


def sentences(docs: DataFrame, max_evidence: int = MAX_EVIDENCE) -> DataFrame:
    """(doc_id, start_pos, end_pos): one row for each sentence unit, in code points, the end exclusive.

    Null, empty and blank texts have no unit, all others at least one; a row that repeats a document repeats its units.
    Null doc_ids keep their units. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length(F.trim("text")) > 0)
    known = cut(evidence(docs))
    rows = bounded_rows(known, max_evidence)
    if rows is not None:
        tables = docs.sparkSession.sparkContext.broadcast(_tables([tuple(r) for r in rows]))
        return texts.mapInArrow(_split_all(tables), UNITS)
    # evidence is a matter of the text: rows find theirs by its hash, whatever their doc_id
    key = ["h1", "h2"]
    texts = texts.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(7), "text"))
    tokens = texts.select(*key, "text").mapInArrow(_asked, "h1 bigint, h2 bigint, token string").distinct()
    own = spread_join(tokens, known, ["token"], max_evidence).groupBy(*key).agg(F.collect_list(F.struct("token", "ends")).alias("own"))
    return texts.join(own, key, "left").select("doc_id", "text", "own").mapInArrow(_split_each, UNITS)
