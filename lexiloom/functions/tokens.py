"""Expressions over splits of words.

A split is a string in which each token stands between two bars, ``|t||h||e|``: a merge is then one ``replace``, exact
for overlapping pairs too, because every token owns both of its bars. Words never contain a bar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The end marker, the unknown tokens of both families, and the sign of a continuation.
END, UNK, WP_UNK, CONT = "_", "<unk>", "[UNK]", "##"


def chars_split(word: Column, end_marker: str | None = END) -> Column:
    """Each character a token, then the end marker if there is one; the empty word has only the marker."""
    bars = F.regexp_replace(word, "(?s)(.)", "|$1|")
    return F.concat(bars, F.lit(f"|{end_marker}|")) if end_marker else bars


def wordpiece_split(word: Column) -> Column:
    """The first character, then each other one as a continuation; the empty word has no token."""
    return F.when(word == "", "").otherwise(F.concat(F.lit("|"), F.substring(word, 1, 1), F.lit("|"), F.regexp_replace(word.substr(F.lit(2), F.length(word)), "(?s)(.)", f"|{CONT}$1|")))


def tokens(split: Column) -> Column:
    """The tokens of a split."""
    return F.filter(F.split(split, "[|]+"), lambda x: x != "")


def pairs(toks: Column) -> Column:
    """Adjacent pairs, overlapping ones too; fewer than two tokens have none."""
    return F.transform(F.slice(toks, F.lit(2), F.greatest(F.size(toks), F.lit(1))), lambda b, i: F.struct(F.get(toks, i).alias("a"), b.alias("b")))


def merged_name(a: Column, b: Column) -> Column:
    """The token that two tokens make: a continuation loses its sign behind another token."""
    return F.concat(a, F.when(b.startswith(CONT), b.substr(F.lit(len(CONT) + 1), F.length(b))).otherwise(b))


def merge_name(a: str, b: str) -> str:
    """As :func:`merged_name`, for strings."""
    return a + b.removeprefix(CONT)


def merge(split: Column, a: str, b: str, merged: str) -> Column:
    """The split with the pair replaced from left to right, without overlap."""
    return F.replace(split, F.lit(f"|{a}||{b}|"), F.lit(f"|{merged}|"))


def merged_tokens(split: list[str], a: str, b: str, merged: str) -> list[str]:
    """As :func:`merge`, for a list of tokens."""
    out, i, n = [], 0, len(split)
    while i < n:
        hit = i + 1 < n and split[i] == a and split[i + 1] == b
        out.append(merged if hit else split[i])
        i += 1 + hit
    return out


def plain(pieces: Column) -> Column:
    """Pieces without markers: the end marker's own piece is dropped, other markers and continuation signs cut out."""
    return F.transform(F.filter(pieces, lambda x: x != END), lambda x: F.replace(F.replace(x, F.lit(END), F.lit("")), F.lit(CONT), F.lit("")))


def boundaries(pieces: Column, length: Column) -> Column:
    """0/1 for each inner position of a word of ``length`` characters: 1 where a piece but the last ends.

    Ends outside the word are ignored; words under two characters have an empty array.
    """
    sums = F.aggregate(pieces, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.length(x))))
    ends = F.slice(sums, F.lit(1), F.greatest(F.size(sums) - 1, F.lit(0)))
    return F.when(length < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), lambda i: F.when(F.array_contains(ends, i), 1).otherwise(0)))
