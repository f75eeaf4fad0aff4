"""Whitespace, counting and membership helpers with Unicode-aware text rules.

Spark's ``trim`` knows only U+0020 and Java's ``\\s`` only ASCII, so the whitespace class is
spelled out once here. Everything below stays within whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace, as a string and as a regex class.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The first operand of && lets letters and digits fail after one comparison.
WS = (
    r"[[\x00-\x20\x{85}-\x{3000}]&&[\x20\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
# A whitespace run other than a single space. A printable ASCII character fails in the first comparison.
ODD_RUN = rf"(?![!-~])(?: {WS}++|(?! ){WS}++)"
# The complement, spelled out with the common range first.
NON_WS = (
    r"[\x21-\x{84}\x00-\x08\x0e-\x1b\x{86}-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}"
    r"\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]"
)


def computed_once(col: Column) -> Column:
    """The same value, fenced off from filter pushdown.

    A filter on a computed column is normally moved below its projection, with the whole
    expression copied in for every mention. For cheap expressions that is right; for a chain of
    text rules it multiplies the work. The partition id makes the projection non-deterministic in
    the optimizer's eyes, which keeps later filters above it. Filter on source columns first.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def strip_column(col: Column) -> Column:
    """``strip`` of a column that is at hand: ends that are printable ASCII are seen without going through it."""
    first, last = F.substring(col, 1, 1), F.substring(col, -1, 1)
    return F.when(first.between("!", "~") & last.between("!", "~"), col).otherwise(strip(col))


def collapse(col: Column) -> Column:
    """Every whitespace run becomes one space, the ends are stripped."""
    return F.trim(single_spaced(col))


def single_spaced(col: Column) -> Column:
    """Every whitespace run becomes one space; the runs that are one already are not touched."""
    return F.regexp_replace(col, ODD_RUN, " ")


def is_blank(col: Column) -> Column:
    return strip(or_empty(col)) == ""


def word_count(col: Column) -> Column:
    return clean_word_count(collapse(or_empty(col)))


def clean_word_count(col: Column) -> Column:
    """Words of a text whose whitespace runs are single spaces already: its inner spaces plus one."""
    text = F.trim(col)
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(or_empty(text) == "", 0).otherwise(spaces + 1)


def occurrences(col: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    rest = F.octet_length(F.replace(col, F.lit(word), F.lit("")))
    return ((F.octet_length(col) - rest) / len(word.encode())).cast("int")


def contains_any(col: Column, words: Sequence[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(col, F.lit(w))
    return cond


def found_words(col: Column, words: Sequence[str]) -> Column:
    """Those of ``words`` that occur as substrings, in list order.

    ``array_remove`` is code-generated; ``filter`` with a lambda is not.
    """
    if not words:
        return F.array().cast("array<string>")
    hits = [F.when(F.contains(col, F.lit(w)), F.lit(w)).otherwise(F.lit("")) for w in words]
    return F.array_remove(F.array(*hits), "")


def word_mask(col: Column, words: Sequence[str]) -> Column:
    """Bit i is set when ``words[i]`` occurs as a substring (at most 63 words)."""
    bits = F.lit(0).cast("long")
    for i, w in enumerate(words):
        bits = bits + F.when(F.contains(col, F.lit(w)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return bits
