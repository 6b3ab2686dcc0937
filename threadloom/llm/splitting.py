"""Splitting oversized texts at natural boundaries, by byte range.

A text is a stretch of bytes: a cell of a table, or a file of any size.  It is
processed in ranges with halos.  Each range finds its own units (tokens; slices
of very long ones) from local context alone.  A unit weighs the larger of its
share of the token limit and its share of the character limit, in whole
numbers, so one prefix sum stands for both limits.  Cuts are chosen on a grid
of that sum: the best boundary in a window before each grid point.  A range
therefore needs nothing of its neighbours but the sums before it; windows that
span two ranges are stitched by a maximum, and pieces are read by offset.

The ranges of a table's cell follow each other in the task that holds the cell.
Those of files are rows of a job of their own and are read from storage one by
one; no task holds a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import TOKEN
from threadloom.runtime import stored

MAX_TOKENS, MAX_CHARS, OVERLAP = 300, 2400, 30
#: A token is sliced where a byte offset divisible by SLICE has as many token characters on either side.
SLICE = 64
#: White space longer than this is never inside a piece.
GAP = 400
#: Bytes of a range: of a cell, of a file.
RANGE, FILE_RANGE = 1 << 16, 1 << 22
#: Bytes seen before and after a range: more than GAP characters, a unit and an overlap can take.
HALO = 4096
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’)\]]*$")
_CLAUSE = re.compile(r"[,;:—，；、]$")


class Limits(NamedTuple):
    """The limits in whole numbers: a piece weighs at most ``whole``."""

    max_tokens: int
    max_chars: int
    overlap: int

    @property
    def whole(self) -> int:
        return self.max_tokens * self.max_chars

    # shares of the limits: grid step, window before a grid point, most of an overlap; together 1
    @property
    def step(self) -> int:
        return self.whole * 55 // 100

    @property
    def slack(self) -> int:
        return self.whole * 25 // 100

    @property
    def lap(self) -> int:
        return self.whole * 20 // 100


class Units(NamedTuple):
    """Units of a range and of the halo before it, by character from the range's first one."""

    start: np.ndarray
    end: np.ndarray
    strong: np.ndarray  # boundary before it: 9 a long gap, 4 blank line, 3 line break, 2 sentence, 1 clause, 0 word, -1 inside a token
    first: np.ndarray  # starts a token
    weight: np.ndarray
    own: int  # number of units that begin in the halo
    chars: int  # characters of the range
    offset: np.ndarray  # byte offset of each character of the stretch seen
    before: int  # characters of the stretch before the range

    def byte(self, at: int) -> int:
        return int(self.offset[at + self.before])


def decode(part: bytes) -> str:
    """Bytes that start and end between characters; each invalid one is a character of its own."""
    return part.decode("utf-8", "surrogateescape")


def byte_offsets(text: str, base: int) -> np.ndarray:
    """Byte offset of each character, and of the end."""
    if text.isascii():
        return np.arange(base, base + len(text) + 1)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (c >= 0x80) + (c >= 0x800).astype(np.int64) + (c >= 0x10000)
    width[(c >= 0xDC80) & (c <= 0xDCFF)] = 1
    return base + np.concatenate([[0], np.cumsum(width)])


def stretch(lo: int, hi: int, size: int) -> tuple[int, int]:
    """The bytes to be seen for the range [lo, hi)."""
    return max(0, lo - HALO), min(size, hi + HALO)


def range_units(part: bytes, base: int, lo: int, hi: int, size: int, limits: Limits) -> Units:
    """Units that begin in bytes [lo, hi) of a text of ``size`` bytes; ``part`` are its bytes from ``base`` on, as :func:`stretch` says."""
    s, e = 0, len(part)
    if base:  # the halo may begin and end inside a character
        while s < min(3, e) and part[s] & 0xC0 == 0x80:
            s += 1
    if base + e < size:
        k = e - 1
        while k > max(s, e - 4) and part[k] & 0xC0 == 0x80:
            k -= 1
        if k >= s and part[k] >= 0xC0 and k + (2 + (part[k] >= 0xE0) + (part[k] >= 0xF0)) > e:
            e = k
    text = decode(part[s:e])
    offset = byte_offsets(text, base + s)
    starts, ends, strong, first = [], [], [], []
    end, last = None, ""
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if offset[a] >= hi + HALO // 2:
            break
        gap = text[end:a] if end is not None else ""
        if end is None:
            # nothing but white space in the halo: the gap is longer than it
            kind = 9 if base and offset[a] >= lo else 0
        else:
            kind = 9 if a - end > GAP else 4 if gap.count("\n") > 1 else 3 if "\n" in gap else 2 if _SENTENCE.search(last) else 1 if _CLAUSE.search(last) else 0
        cut_off = a == 0 and base > 0  # began before the halo
        starts.append(a)
        strong.append(kind)
        first.append(True)
        if b - a >= 2 * SLICE or cut_off and b - a >= SLICE:
            points = np.searchsorted(offset, np.arange(-(-int(offset[a]) // SLICE) * SLICE, int(offset[b]), SLICE))
            for p in points[(points - a >= (1 if cut_off else SLICE)) & (b - points >= SLICE)].tolist():
                ends.append(p)
                starts.append(p)
                strong.append(-1)
                first.append(False)
        ends.append(b)
        end, last = b, text[max(a, b - 6) : b]
    st, en = np.array(starts, np.int64), np.array(ends, np.int64)
    kinds, new = np.array(strong, np.int8), np.array(first, bool)
    if base and len(st) and st[0] == 0:  # the rest of a unit that began before the halo
        st, en, kinds, new = st[1:], en[1:], kinds[1:], new[1:]
    gap = np.append(st[1:], en[-1:]) - en
    weight = np.maximum(limits.max_chars, (en - st + np.where(gap > GAP, 0, gap)) * limits.max_tokens)
    at = offset[st]
    keep = at < hi
    c0, c1 = np.searchsorted(offset[:-1], (lo, hi))
    return Units(st[keep] - c0, en[keep] - c0, kinds[keep], new[keep], weight[keep], int((at < lo).sum()), int(c1 - c0), offset, int(c0))


class Cut(NamedTuple):
    cell: int  # grid window, or the place of a cut at a long gap
    forced: int
    strength: int
    at: int
    lap_char: int
    lap_byte: int
    end_char: int  # end of the unit before the cut
    end_byte: int


def range_cuts(u: Units, chars: int, weight: int, end: tuple[int, int], limits: Limits) -> Iterator[Cut]:
    """Candidate cuts of a range: the strongest, then latest, boundary in each grid window, and every long gap.

    ``chars``, ``weight``: sums before the range; ``end``: (character, byte) where
    the last unit before it ends.  Every window holds a unit, as none weighs more.
    """
    before = np.concatenate([[0], np.cumsum(u.weight)])[:-1].astype(np.int64)
    if u.own >= len(before):
        return
    before += weight - before[u.own]
    cell = -(-before // limits.step)
    fit = (cell >= 1) & (before > cell * limits.step - limits.slack) & (np.arange(len(before)) >= u.own)
    best: dict[int, int] = {}
    for i in np.flatnonzero(fit).tolist():
        j = best.get(int(cell[i]))
        if j is None or u.strong[i] >= u.strong[j]:
            best[int(cell[i])] = i
    gaps = (i for i in np.flatnonzero(u.strong == 9).tolist() if i >= u.own and before[i] > 0)
    for at, forced, i in [*((c, 0, i) for c, i in best.items()), *((int(u.start[i]) + chars, 1, i) for i in gaps)]:
        # the piece that follows begins ``overlap`` units earlier, as far as they weigh no more than the lap
        j = i
        while j > 0 and i - j < limits.overlap and u.strong[j] != 9 and before[i] - before[j - 1] <= limits.lap:
            j -= 1
        ended = (int(u.end[i - 1]) + chars, u.byte(int(u.end[i - 1]))) if i else end
        yield Cut(at, forced, int(u.strong[i]), int(u.start[i]) + chars, int(u.start[j]) + chars, u.byte(int(u.start[j])), *ended)


class Summary(NamedTuple):
    """Of a range: its sums, and where its first unit begins and its last one ends, by character from the range's first one and by byte."""

    tokens: int
    weight: int
    chars: int
    first_char: int | None
    first_byte: int | None
    last_char: int | None
    last_byte: int | None


def summary(u: Units) -> Summary:
    own = slice(u.own, None)
    if u.own >= len(u.start):
        return Summary(0, 0, u.chars, None, None, None, None)
    a, b = int(u.start[u.own]), int(u.end[-1])
    return Summary(int(u.first[own].sum()), int(u.weight[own].sum()), u.chars, a, u.byte(a), b, u.byte(b))


class Piece(NamedTuple):
    start_char: int
    end_char: int
    start_byte: int
    end_byte: int


def split_bytes(body: bytes, limits: Limits = Limits(MAX_TOKENS, MAX_CHARS, OVERLAP), range_bytes: int = RANGE) -> tuple[list[Piece], int, int]:
    """The pieces of one text, and its tokens and characters.

    A blank text has no piece (one of length 0 if it is longer than the limit,
    so that it is seen); a text within both limits is one piece.
    """
    tokens = weight = chars = 0
    begin = end = None
    best: dict[tuple[int, int], Cut] = {}
    for lo in range(0, len(body), range_bytes):
        hi = min(lo + range_bytes, len(body))
        s, e = stretch(lo, hi, len(body))
        u = range_units(body[s:e], s, lo, hi, len(body), limits)
        for c in range_cuts(u, chars, weight, end, limits):
            old = best.get((c.forced, c.cell))
            if old is None or (c.strength, c.at) > (old.strength, old.at):
                best[c.forced, c.cell] = c
        got = summary(u)
        if got.first_char is not None:
            begin = begin or (got.first_char + chars, got.first_byte)
            end = (got.last_char + chars, got.last_byte)
        tokens, weight, chars = tokens + got.tokens, weight + got.weight, chars + got.chars
    if begin is None:
        return [Piece(0, 0, 0, 0)] if chars > limits.max_chars else [], 0, chars
    if tokens <= limits.max_tokens and chars <= limits.max_chars:
        return [Piece(0, chars, 0, len(body))], tokens, chars
    cuts = sorted({c.at: c for c in best.values()}.items())
    begins = [begin, *((c.lap_char, c.lap_byte) for _, c in cuts)]
    stops = [*((c.end_char, c.end_byte) for _, c in cuts), end]
    return [Piece(b[0], x[0], b[1], x[1]) for b, x in zip(begins, stops, strict=True)], tokens, chars


_COUNTS = (("piece_index", pa.int32(), "int"), ("n_pieces", pa.int32(), "int"), ("start_char", pa.int64(), "long"), ("end_char", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("n_chars", pa.int64(), "long"), ("piece", pa.string(), "string"))
PIECE_FIELDS = [("table_name", pa.string()), ("row_key", pa.string()), *((n, t) for n, t, _ in _COUNTS)]
PIECE_SCHEMA = "table_name string, row_key string, " + ", ".join(f"{n} {t}" for n, _, t in _COUNTS)
#: Characters of pieces in one batch.
BATCH_CHARS = 8 << 20


def _pieces(limits: Limits, range_bytes: int):
    schema = pa.schema(PIECE_FIELDS)

    def batch(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, PIECE_FIELDS, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in PIECE_FIELDS]
            held = 0
            for name, key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if not body:
                    continue
                if len(body) <= limits.max_chars and len(words := decode(body).split()) <= limits.max_tokens:
                    # one range, one piece: its sums say all
                    spans, tokens, chars = [Piece(0, 0, 0, len(body))] if words else [], len(words), len(decode(body))
                    spans = [s._replace(end_char=chars) for s in spans]
                else:
                    spans, tokens, chars = split_bytes(body, limits, range_bytes)
                for i, p in enumerate(spans):
                    for c, v in zip(cols, (name, key, i, len(spans), p.start_char, p.end_char, tokens, chars, body[p.start_byte : p.end_byte].decode("utf-8", "replace")), strict=True):
                        c.append(v)
                    held += p.end_char - p.start_char
                if held >= BATCH_CHARS:
                    yield batch(cols)
                    cols, held = [[] for _ in PIECE_FIELDS], 0
            yield batch(cols)

    return run


def split_texts(df: DataFrame, *, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, range_bytes: int = RANGE) -> DataFrame:
    """Pieces of every text of (table_name, row_key, text), each within both limits.

    Result: one row per piece with its offsets in code points and the whole
    text's counts; repeated rows are split again each time.  A text within the
    limits is one piece.  Null, empty and blank texts give no piece; a blank one
    beyond the character limit gives one of length 0.  Consecutive pieces
    overlap by ``overlap`` words, or as many as fit in a fifth of the limits;
    never across white space of more than 400 characters, at which a text is
    always cut.  No shuffle; the result does not depend on ``range_bytes``.
    """
    return df.select("table_name", "row_key", "text").mapInArrow(_pieces(Limits(max_tokens, max_chars, overlap), range_bytes), PIECE_SCHEMA)


# files ------------------------------------------------------------------


class _Reader:
    """Byte ranges of files; the last file stays open."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def __call__(self, path: str, lo: int, hi: int) -> bytes:
        if path != self.path:
            if self.file:
                self.file.close()
            system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file://" + path.removeprefix("file:"))
            self.path, self.file = path, system.open_input_file(name)
        return self.file.read_at(hi - lo, lo)


_SUMS = "path string, size long, rng long, tokens long, weight long, chars long, first_char long, first_byte long, last_char long, last_byte long"
_CUTS = "path string, cell long, forced long, strength long, at long, lap_char long, lap_byte long, end_char long, end_byte long"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split() for f in schema.split(",")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _weigh(limits: Limits, range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader()
        for b in batches:
            out = []
            for path, size, rng in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                lo, hi = rng * range_bytes, min((rng + 1) * range_bytes, size)
                s, e = stretch(lo, hi, size)
                out.append((path, size, rng, *summary(range_units(read(path, s, e), s, lo, hi, size, limits))))
            yield _table(out, _SUMS)

    return run


def _cut(limits: Limits, range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader()
        for b in batches:
            out = []
            for path, size, rng, chars, weight, end_char, end_byte in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                lo, hi = rng * range_bytes, min((rng + 1) * range_bytes, size)
                s, e = stretch(lo, hi, size)
                u = range_units(read(path, s, e), s, lo, hi, size, limits)
                out += [(path, *c) for c in range_cuts(u, chars, weight, (end_char, end_byte), limits)]
            yield _table(out, _CUTS)

    return run


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = _Reader()
    for b in batches:
        text = [read(p, s, e).decode("utf-8", "replace") for p, s, e in zip(b.column("path").to_pylist(), b.column("start_byte").to_pylist(), b.column("end_byte").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, "piece"])


def split_files(spark: SparkSession, paths: str | list[str], *, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, range_bytes: int = FILE_RANGE) -> DataFrame:
    """Pieces of text files of any size, as :func:`split_texts` would give them for the files' texts.

    ``paths``: files or folders that every worker can read.  A file is read
    three times, in ranges: for the sums, for the cuts, and piece by piece; no
    task holds more than a range.  Result: (path, piece_index, n_pieces,
    start_char, end_char, start_byte, end_byte, n_tokens, n_chars, piece).
    Bytes that are not UTF-8 count as a character each and read as U+FFFD.
    """
    limits = Limits(max_tokens, max_chars, overlap)
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size")).where("size > 0")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {range_bytes}"))).alias("rng")).repartition(F.col("path"), F.col("rng") % 4096)
    sums = stored(ranges.mapInArrow(_weigh(limits, range_bytes), _SUMS))
    # one row a range
    upto = Window.partitionBy("path").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    total = {c: F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in ("chars", "weight")}
    placed = sums.select("path", "size", "rng", "tokens", "chars", "weight", "first_char", "first_byte", "last_char", "last_byte", total["chars"].alias("chars_before"), total["weight"].alias("weight_before"))
    last = F.max(F.when(F.col("last_char").isNotNull(), F.struct("rng", (F.col("last_char") + F.col("chars_before")).alias("c"), F.col("last_byte").alias("b")))).over(upto)
    placed = placed.withColumn("end", last)
    cuts = placed.select("path", "size", "rng", F.col("chars_before"), "weight_before", "end.c", "end.b").repartition(F.col("path"), F.col("rng") % 4096).mapInArrow(_cut(limits, range_bytes), _CUTS)
    best = cuts.groupBy("path", "forced", "cell").agg(F.max(F.struct("strength", "at", "lap_char", "lap_byte", "end_char", "end_byte")).alias("c")).select("path", "c.*").dropDuplicates(["path", "at"])
    seen = F.col("first_char").isNotNull()
    whole = placed.groupBy("path").agg(
        F.sum("tokens").alias("n_tokens"), F.sum("chars").alias("n_chars"), F.max("size").alias("size"),
        F.min(F.when(seen, F.struct("rng", (F.col("first_char") + F.col("chars_before")).alias("c"), F.col("first_byte").alias("b")))).alias("begin"),
        F.max(F.when(seen, F.struct("rng", (F.col("last_char") + F.col("chars_before")).alias("c"), F.col("last_byte").alias("b")))).alias("stop"),
    )
    fits = F.expr(f"n_tokens <= {max_tokens} and n_chars <= {max_chars}")
    one = whole.where(fits & F.col("begin").isNotNull()).select("path", F.lit(0).alias("at"), F.lit(0).alias("sc"), F.lit(0).alias("sb"), F.lit(None).cast("long").alias("ec"), F.lit(None).cast("long").alias("eb"))
    head = whole.where(~fits).select("path", F.coalesce("begin.c", F.lit(0)).alias("at"), F.coalesce("begin.c", F.lit(0)).alias("sc"), F.coalesce("begin.b", F.lit(0)).alias("sb"), F.lit(None).cast("long").alias("ec"), F.lit(None).cast("long").alias("eb"))
    tail = best.join(whole.where(~fits).select("path"), "path", "left_semi").select("path", "at", F.col("lap_char").alias("sc"), F.col("lap_byte").alias("sb"), F.col("end_char").alias("ec"), F.col("end_byte").alias("eb"))
    order = Window.partitionBy("path").orderBy("at")
    pieces = one.unionByName(head).unionByName(tail).withColumn("piece_index", (F.row_number().over(order) - 1).cast("int")).withColumn("nc", F.lead("ec").over(order)).withColumn("nb", F.lead("eb").over(order)).withColumn("n_pieces", F.count("*").over(Window.partitionBy("path")).cast("int"))
    pieces = pieces.join(whole, "path").select(
        "path", "piece_index", "n_pieces", F.col("sc").cast("long").alias("start_char"), F.coalesce("nc", F.when(fits, F.col("n_chars")), "stop.c", F.lit(0)).alias("end_char"), F.col("sb").cast("long").alias("start_byte"), F.coalesce("nb", F.when(fits, F.col("size")), "stop.b", F.lit(0)).alias("end_byte"), "n_tokens", "n_chars",
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(_emit, fields + ", piece string")
