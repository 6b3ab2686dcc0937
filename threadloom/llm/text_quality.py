"""Per-document text statistics that tell prose from lists, tables and junk.

Every line of a text is put into one kind by combined rules: its form (bullets,
cells), the share of its characters in tokens that are neither words nor
numbers, and how likely its letters follow each other in the common words.  The
shares of the kinds, by non-blank characters, say what the text mostly is.  A
text that mostly repeats itself (duplicate lines and paragraphs, coverage by
the commonest n-gram, words in n-grams that came before) is not prose either.
The usual counts stand beside them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WORD

PROSE, LIST, TABLE, JUNK = range(4)
#: A text needs this many characters to be judged at all.
LEAST_CHARS = 40
NOT_TEXT = {"[deleted]", "[removed]"}

_BULLET = re.compile(r"\s*(?:[-*+•·‣◦–—▪►→✅❌✔✗☐☑]\s*|\[[ xX✓]?\]\s*|\(?\d{1,3}[.)]\s+|\(?[a-zA-Z][.)]\s+)\S")
_BOLD = re.compile(r"\s*(?:#{1,6}\s+\S.*|\*\*[^*]+\*\*:?\s*|__[^_]+__:?\s*)$")
_RULE = re.compile(r"[\s|:+=-]{3,}$")
_COLUMNS = re.compile(r"(?<=\S) {2,}(?=\S)")
_END = re.compile(r"[.!?…。！？:;\"'”’)\]]\s*$")
#: Punctuation that may stand around a word; signs of reckoning are none.
_EDGE = "!\"#&'()*,-./:;?@[]_{}¡¿«»\u2010\u2011\u2012\u2013\u2014\u2015\u2018\u2019\u201a\u201c\u201d\u201e\u2026\u3001\u3002\u300c\u300d\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_JOINED = re.compile(r"[^\W\d_]+(?:['’./&-][^\W\d_]+)*")
_NUMBER = re.compile(r"[-+~<>≈]?\d[\d.,:/+-]*[a-zA-Zµ°%]{0,4}|\d+(?:st|nd|rd|th)")
#: ASCII letters in a row that are still a word.
LONGEST_WORD = 40
_LATIN = re.compile(r"[a-z]+")
_VOWELS = set("aeiouy")
_RARE = set("jqxzwvk")


def letter_pairs(common: frozenset[str]) -> frozenset[str]:
    """Neighbouring letters, word edges included, that the common words show."""
    return frozenset(a + b for w in common for a, b in zip(" " + w, w + " ", strict=True))


class _KnownPairs(dict):
    """Word to (its letter pairs, those that are known), for one list; -1 pairs for words of other scripts."""

    def __init__(self, pairs: frozenset[str]) -> None:
        self.pairs = pairs

    def __missing__(self, w: str) -> tuple[int, int]:
        v = (len(w) + 1, sum(a + b in self.pairs for a, b in zip(" " + w, w + " ", strict=True))) if _LATIN.fullmatch(w) else (-1, 0)
        if len(self) < 500_000:
            self[w] = v
        return v


_KNOWN: list[_KnownPairs] = []


def _known_pairs(pairs: frozenset[str]) -> _KnownPairs:
    if not _KNOWN or _KNOWN[0].pairs is not pairs:
        _KNOWN[:] = [_KnownPairs(pairs)]
    return _KNOWN[0]


def gibberish(word_list: list[str], pairs: frozenset[str]) -> bool:
    """Whether words of Latin letters are strung together at random.

    Letters drawn at random make few of the pairs that the common words of any
    listed language show; without a list, vowels and rare letters decide.
    """
    every = sum(map(len, word_list))
    if every < 24:
        return False
    table = _known_pairs(pairs)
    latin = [v for v in map(table.__getitem__, word_list) if v[0] > 0]
    total = sum(v[0] for v in latin)
    letters = total - len(latin)
    if letters < 24 or letters < 0.8 * every:
        return False
    if len(pairs) >= 100:
        return sum(v[1] for v in latin) < 0.64 * total
    joined = "".join(w for w in word_list if table[w][0] > 0)
    return sum(c in _VOWELS for c in joined) < 0.34 * letters and sum(c in _RARE for c in joined) > 0.12 * letters


def written(token: str) -> bool:
    """Whether a token is a word of some script: letters with their marks, joined by punctuation of the script."""
    for c in token:
        k = unicodedata.category(c)
        # symbols and controls of Latin-1 inside a word are a broken encoding
        if k[0] not in "LM" and k != "Cf" and not (k[0] == "P" and ord(c) >= 0x300) and c not in "'-./&":
            return False
    return True


def token_shares(line: str) -> tuple[int, int, int]:
    """Characters of a line in words, in numbers and in other tokens; lone punctuation and pictographs count as nothing."""
    words = numbers = other = 0
    for t in line.split():
        n = len(t)
        e = t if t.isalpha() else t.strip(_EDGE)
        if not e:
            other += n if n > 3 else 0
        elif e.isascii() and len(e) > LONGEST_WORD:
            other += n
        elif e.isalpha() or (_JOINED.fullmatch(e) if e.isascii() else written(e)):
            words += n
        elif _NUMBER.fullmatch(e):
            numbers += n
        elif n > 3 or not all(unicodedata.category(c) in ("So", "Mn", "Cf", "Sk") for c in e):
            other += n
    return words, numbers, other


def line_kind(line: str, pairs: frozenset[str] = frozenset()) -> int:
    """The kind of one non-blank line, looked at alone."""
    text = line.strip()
    n = len(text)
    if text.count("|") >= 2 or (text.count("|") == 1 and n < 40):
        return TABLE
    if _RULE.match(text) and n >= 3:
        return TABLE
    if "\t" in text and all(len(c) <= 24 for c in text.split("\t")):
        return TABLE
    cells = _COLUMNS.split(text)
    if len(cells) >= 3 and sum(map(len, cells)) <= 12 * len(cells):
        return TABLE
    for sep in (",", ";"):
        cells = text.split(sep)
        if len(cells) >= 3 and max(map(len, cells)) <= 12 and not any(" " in c.strip() for c in cells):
            return TABLE
    if _BULLET.match(line) or _BOLD.match(line):
        return LIST
    w = WORD.findall(text.lower())
    if len(w) >= 3 and sum(x.isdigit() for x in w) >= 0.6 * len(w):
        return TABLE
    plain, numbers, other = token_shares(text)
    if other > plain + numbers:
        return JUNK
    if gibberish(w, pairs):
        return JUNK
    parts = [p for p in re.split(r"[;•·]", text) if p.strip()]
    if len(parts) >= 4 and sum(len(p.split()) <= 8 for p in parts) >= 0.8 * len(parts) and not _END.search(text.rstrip(";")):
        return LIST
    return PROSE


def kind_shares(text: str, pairs: frozenset[str] = frozenset()) -> tuple[float, float, float]:
    """Shares of list, table and junk lines in a text, by non-blank characters.

    Three or more short lines in a row without an end of sentence are a list
    without bullets.
    """
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return 0.0, 0.0, 0.0
    kinds = [line_kind(x, pairs) for x in lines]
    sizes = [len("".join(x.split())) for x in lines]
    short = [k == PROSE and len(x) <= 60 and len(x.split()) <= 8 and not x.rstrip().endswith((".", "!", "?", "…", "。")) for k, x in zip(kinds, lines, strict=True)]
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and short[j]:
            j += 1
        # a heading (with a colon) before a list belongs to it only if it is one of several
        if j - i >= 3:
            kinds[i:j] = [LIST] * (j - i)
        i = max(j, i + 1)
    total = sum(sizes)
    shares = [sum(s for s, k in zip(sizes, kinds, strict=True) if k == want) / total for want in (LIST, TABLE, JUNK)]
    if shares[0] + shares[1] < 0.5 and len(lines) > 1 and gibberish(WORD.findall(text.lower()), pairs):
        shares[2] = 1.0
    return shares[0], shares[1], shares[2]


def top_gram(w: list[str], n: int) -> tuple[float, int]:
    """Share of the words' characters that the commonest n-gram covers, if it comes more than once, and how often it comes."""
    if len(w) < 2 * n:
        return 0.0, 0
    grams = Counter(zip(*(w[i:] for i in range(n)), strict=False))
    gram, count = max(grams.items(), key=lambda x: (x[1], x[0]))
    return min(1.0, count * sum(map(len, gram)) / sum(map(len, w))) if count > 1 else 0.0, count


def repeat_share(parts: list[str]) -> float:
    """Share of characters in parts that have come before."""
    if len(parts) < 2:
        return 0.0
    seen, twice, total = set(), 0, 0
    for p in parts:
        total += len(p)
        twice += len(p) if p in seen else 0
        seen.add(p)
    return twice / total if total else 0.0


def repeated_words(w: list[str], n: int = 6) -> float:
    """Share of the words' characters in n-grams that have come before; of a single word without blanks, in its n-grams of letters."""
    if len(w) < n + 2:
        w = list("".join(w))
        n = 8
        if len(w) < 4 * n:
            return 0.0
    seen: set[tuple[str, ...]] = set()
    covered, upto, total = 0, 0, sum(map(len, w))
    for i, g in enumerate(zip(*(w[k:] for k in range(n)), strict=False)):
        if g in seen:
            covered += sum(map(len, w[max(i, upto) : i + n]))
            upto = i + n
        else:
            seen.add(g)
    return covered / total


def repetition(text: str, w: list[str]) -> tuple[tuple[float, ...], bool]:
    """Shares of duplicate lines and paragraphs, of the commonest 2-, 3- and 4-gram and of words in repeated n-grams; whether the text mostly repeats itself.

    It does if more than half of it is lines or paragraphs that come twice or
    more, one 3- or 4-gram that comes three times or more, or words in n-grams
    that came before.
    """
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()] if len(lines) > 1 else lines
    twice = repeat_share(lines), repeat_share(paragraphs)
    grams = [top_gram(w, n) for n in (2, 3, 4)]
    again = repeated_words(w)
    repeats = again > 0.5 or any(share > 0.5 and count > 2 for share, count in grams[1:]) or max(twice) > 0.3 and max(map(copied_share, (lines, paragraphs))) > 0.5
    return (*twice, *(share for share, _ in grams), again), repeats


def copied_share(parts: list[str]) -> float:
    """Share of characters in parts that come twice or more."""
    count = Counter(parts)
    return sum(len(p) for p in parts if count[p] > 1) / max(1, sum(map(len, parts)))


FIELDS = ("n_chars", "n_tokens", "n_words", "mean_word_len", "symbol_ratio", "end_punct_share", "common_share", "dup_line_share", "dup_paragraph_share", "top_2gram", "top_3gram", "top_4gram", "repeated_words", "list_share", "table_share", "junk_share", "is_prose")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 13, pa.bool_())
SCHEMA = "table_name string, row_key string, " + ", ".join(f"{f} {'long' if t == pa.int64() else 'boolean' if t == pa.bool_() else 'double'}" for f, t in zip(FIELDS, _TYPES, strict=True))


def statistics(text: str | None, common: frozenset[str], pairs: frozenset[str] = frozenset()) -> tuple:
    """The statistics of one text, in the order of FIELDS; of a null text as of an empty one.

    A text is not prose if it has LEAST_CHARS characters and more than half of
    its non-blank ones are in list, table or junk lines, or if it mostly repeats
    itself.
    """
    text = text or ""
    judged = len(text) >= LEAST_CHARS and text not in NOT_TEXT
    shares = kind_shares(text, pairs)
    tokens = text.split()
    w = WORD.findall(text.lower())
    repeats, repeated = repetition(text, w)
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    letters, solid = sum(map(len, w)), sum(map(len, tokens))
    return (
        len(text),
        len(tokens),
        len(w),
        letters / len(w) if w else 0.0,
        (solid - letters) / solid if solid else 0.0,
        sum(x[-1] in ".!?…。！？\"'”’)" for x in lines) / len(lines) if lines else 0.0,
        sum(x in common for x in w) / len(w) if w else 0.0,
        *repeats,
        *shares,
        not (judged and (sum(shares) > 0.5 or repeated)),
    )


def text_statistics(df: DataFrame, common_words: DataFrame, *, most_words: int = 1_000_000) -> DataFrame:
    """Statistics of every row of (table_name, row_key, text).

    ``common_words``: (word), a list of bounded size (more than ``most_words``
    raises).  Null, empty and blank texts have zero counts and shares and count
    as prose, as no rule speaks against them; repeated rows give repeated rows.
    No shuffle.
    """
    listed = common_words.where("word is not null").select(F.lower("word")).distinct().limit(most_words + 1).collect()
    if len(listed) > most_words:
        raise ValueError("too many common words")
    common = frozenset(r[0] for r in listed)
    pairs = letter_pairs(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t, common, pairs) for t in b.column(2).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))], names=["table_name", "row_key", *FIELDS])

    return df.select("table_name", "row_key", "text").mapInArrow(run, SCHEMA)


def text_tokens(df: DataFrame, *, carry: str) -> DataFrame:
    """(table_name, row_key, carry, n_tokens): tokens of each text beside a recorded number; 0 of a null text."""
    kind = df.schema[carry].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64())], names=["table_name", "row_key", carry, "n_tokens"])

    return df.select("table_name", "row_key", "text", carry).mapInArrow(run, f"table_name string, row_key string, {carry} {kind}, n_tokens long")
