"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word of learning (ASCII letters, one inner apostrophe each), of the rare-word list, the characters
# that part words for fertility, and white space.
WORD = r"[a-z]+(?:'[a-z]+)?"
_BOUND = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"  # Java's own \b differs by version
RARE_WORD = rf"{_BOUND}[a-z'-]+{_BOUND}"
NO_WORD = r"[^\p{L}\p{N}_]+"
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column | str) -> Column:
    """A text without white space at its ends; null stays null."""
    return F.btrim(text, F.lit(SPACE))


def words(text: Column | str) -> Column:
    """The words of a text, in order; a null text has null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def rare_words(text: Column | str) -> Column:
    """The words of the rare-word list: inner and outer hyphens and apostrophes are kept, Unicode word bounds."""
    return F.regexp_extract_all(F.lower(stripped(text)), F.lit(RARE_WORD), F.lit(0))


def fertility_words(text: Column | str) -> Column:
    """Runs of letters, digits and underscores with their case."""
    return F.filter(F.split(text, NO_WORD), lambda x: x != "")
