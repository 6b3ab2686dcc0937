"""Column functions for text, with Unicode white space where Spark's own know ASCII only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode knows it, with the four separators U+001C to U+001F.
WS = r"(?U)[\s\x1c-\x1f]"
#: The same class for DuckDB, whose \s is ASCII.
WS_SQL = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: Its characters one by one.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ustrip(c: Column) -> Column:
    """Strip Unicode white space from both ends; null stays null."""
    return F.btrim(c, F.lit(WS_CHARS))


def tokens(c: Column) -> Column:
    """White-space separated tokens; none of a null or blank text."""
    s = ustrip(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{WS}+"))


def word_count(c: Column) -> Column:
    """Number of tokens; what has been stripped splits into nothing else."""
    s = ustrip(F.coalesce(c, F.lit("")))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, f"{WS}+"))).cast("long")


def without_punctuation(c: Column) -> Column:
    """Letters, digits, underscores and white space only, stripped."""
    return ustrip(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", ""))


def blank_to_null(c: Column) -> Column:
    s = ustrip(c)
    return F.when(s != "", s)


def first_sentence(c: Column, cap: int = 280) -> Column:
    """Collapsed text up to the first '. ', else '! ', else '? ', at most ``cap`` characters."""

    def pick(t: Column) -> Column:
        def cut(mark: str) -> Column:
            i = F.instr(t, mark)
            return F.when(i > 0, F.substring(t, F.lit(1), F.least(i, F.lit(cap))))

        return F.coalesce(cut(". "), cut("! "), cut("? "), F.substring(t, F.lit(1), F.lit(cap)))

    return let(ustrip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " ")), pick)


def month(c: Column) -> Column:
    """YYYY-MM (UTC) of unix seconds; null if null."""
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM")


def shorten(c: Column, n: int) -> Column:
    """Line breaks to spaces, cut at n characters, with an ellipsis if cut."""
    t = F.regexp_replace(c, "\n", " ")
    return F.when(F.length(t) > n, F.concat(F.substring(t, F.lit(1), F.lit(n)), F.lit("…"))).otherwise(t)


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    """part of whole in percent; 0 where there is no whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(part / whole * 100, digits))
