"""Long exact spans shared between records, by recompression.

Rounds rename runs of equal symbols and then pairs of neighbours; a name is a
64-bit hash of what it stands for, so it is global: the same in every task,
without a dictionary that a round would have to gather.  Only short symbols are
joined, up to a bound that grows with the rounds.  What a round does at a place depends on that
bound's worth of context; so inside equal substrings, further than EROSION
characters from their ends, all symbols and their borders are equal.

Neighbouring symbols of at least WINDOW characters form a high-level symbol.
Of those that start within any SELECT characters the least is kept, which
again depends on the text alone.  Two records that share MIN_CHARS characters
share a kept symbol.  Shared symbols give candidate pairs with their offset;
the texts around it give the exact span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.runtime import small_or_shuffled, spread, stored

MIN_CHARS = 300
#: Longest symbol that is joined in each round; a joined one has at most twice that.
BOUNDS = (1, 2, 3, 4, 6, 8)
EROSION = 2 * sum(BOUNDS)
LONGEST = 2 * BOUNDS[-1]
SELECT = 44
WINDOW = MIN_CHARS - 2 * EROSION - SELECT - LONGEST
#: Classes of exact copies up to this size are written out as pairs; larger ones as pairs with their first member.
EXPAND = 32
BATCH_CHARS = 1 << 18

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_FAR = 1 << 30


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def name_runs(sym: np.ndarray, size: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace each maximal run of equal symbols by one, where the run is no longer than the bound."""
    equal = np.flatnonzero(sym[1:] == sym[:-1])
    if not len(equal):
        return sym, size
    first = np.append(True, np.diff(equal) > 1)
    start = equal[first]
    last = equal[np.append(first[1:], True)] + 1
    ok = (last - start + 1) * size[start] <= bound
    start, last = start[ok], last[ok]
    if not len(start):
        return sym, size
    n = (last - start + 1).astype(np.uint64)
    keep = np.ones(len(sym) + 1, np.int8)
    # mark what lies inside the runs by their borders
    step = np.zeros(len(sym) + 1, np.int32)
    step[start + 1] -= 1
    step[last + 1] += 1
    keep = np.cumsum(step)[:-1] == 0
    sym, size = sym.copy(), size.copy()
    sym[start] = _mix(sym[start] * _B + n * _C)
    size[start] *= (last - start + 1).astype(size.dtype)
    return sym[keep], size[keep]


def name_pairs(sym: np.ndarray, size: np.ndarray, bound: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace each left symbol followed by a right one; a symbol's side is a bit of its hash in this round."""
    right = (sym * (_C + np.uint64(2 * level)) >> np.uint64(63)).astype(bool)
    small = size <= bound
    at = np.flatnonzero(~right[:-1] & right[1:] & small[:-1] & small[1:])
    if not len(at):
        return sym, size
    keep = np.ones(len(sym), bool)
    keep[at + 1] = False
    sym, size = sym.copy(), size.copy()
    sym[at] = _mix(sym[at] * _B + (sym[at + 1] ^ (sym[at + 1] >> np.uint64(31))) * _A + np.uint64(1))
    size[at] += size[at + 1]
    return sym[keep], size[keep]


def parse(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and sizes of concatenated texts; ``ends``: places of the separators, which are never joined."""
    sym = _mix(codes.astype(np.uint64) * _B + _C)
    size = np.ones(len(sym), np.int32)
    size[ends] = _FAR
    for level, bound in enumerate(BOUNDS):
        sym, size = name_runs(sym, size, bound)
        sym, size = name_pairs(sym, size, bound, level)
    return sym, np.where(size == _FAR, 1, size)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of x[i : i + width], by doubling; the tail takes what there is."""
    op = np.minimum if least else np.maximum
    x, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        x[:-step] = op(x[:-step], x[step:])
        have += step
    return x


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, offset, name) of the kept high-level symbols of each text."""
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    sym, size = parse(codes, ends)
    start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    start, stop = start[:-1], int(start[-1])
    # names of windows: sums of symbols times powers, divided by the first power (odd numbers have inverses)
    powers = np.ones(len(sym) + 1, np.uint64)
    powers[1:] = _B
    powers = np.cumprod(powers)
    inverse = np.ones(len(sym) + 1, np.uint64)
    inverse[1:] = np.uint64(pow(int(_B), -1, 1 << 64))
    inverse = np.cumprod(inverse)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(sym * powers[:-1])])
    text = np.searchsorted(ends, start)
    j = np.searchsorted(start, start + WINDOW)
    end = np.append(start, stop)[np.minimum(j, len(start))]
    fine = (end <= ends[np.minimum(text, len(ends) - 1)]) & (end - start >= WINDOW)
    i = np.flatnonzero(fine)
    names = _mix((sums[j[i]] - sums[i]) * inverse[i])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    flat = np.full(stop, top, np.uint64)
    flat[start[i]] = np.minimum(names, top - np.uint64(1))
    least = _sliding(flat, SELECT, True)
    # greatest of the windows that hold a place: the windows start up to SELECT - 1 before it
    best = _sliding(least[::-1], SELECT, False)[::-1]
    kept = np.flatnonzero((flat == best) & (flat != top))
    name, of = flat[kept], np.searchsorted(ends, kept)
    # equal neighbours are one periodic stretch: its first and last place stand for all
    same_as_next = np.append((name[1:] == name[:-1]) & (of[1:] == of[:-1]), False)
    same_as_last = np.append(False, same_as_next[:-1])
    ok = ~(same_as_next & same_as_last)
    kept, name, of = kept[ok], name[ok], of[ok]
    return of, kept - (ends[of] - sizes[of]), name


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["name", "doc", "pos"]
    ids, texts, n = [], [], 0

    def flush():
        of, pos, name = anchors(texts)
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.array(ids, np.int64)[of]), pa.array(pos.astype(np.int32))], names=names)

    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(d)
            texts.append(t)
            n += len(t)
            if n >= BATCH_CHARS:
                yield flush()
                ids, texts, n = [], [], 0
    if texts:
        yield flush()


def _agree(x: str, i: int, y: str, j: int) -> int:
    """How many characters agree from x[i:] and y[j:] on."""
    most = min(len(x) - i, len(y) - j)
    n, step = 0, 64
    while n < most:
        s = min(step, most - n)
        if x[i + n : i + n + s] == y[j + n : j + n + s]:
            n += s
            step *= 2
        elif s == 1:
            return n
        else:
            step = max(1, s // 2)
    return n


def _agree_back(x: str, i: int, y: str, j: int) -> int:
    """How many characters agree before x[i] and y[j]."""
    most = min(i, j)
    n, step = 0, 64
    while n < most:
        s = min(step, most - n)
        if x[i - n - s : i - n] == y[j - n - s : j - n]:
            n += s
            step *= 2
        elif s == 1:
            return n
        else:
            step = max(1, s // 2)
    return n


def _periodic_alignments(x: str, p: int, y: str, shift: int) -> list[tuple[int, int]]:
    """(place in x, shift) of the other alignments of the periodic stretches around x[p] and y[p - shift], if they are such.

    Only the first and last symbol of a stretch were kept, so the alignment met
    need not be the longest.  Of those that differ by whole periods the longest
    has the stretches' starts, or their ends, less than a period apart.
    """
    w = x[p : p + WINDOW]
    period = x.find(w, p + 1, p + len(w) + SELECT + LONGEST) - p
    at = p - shift
    if period <= 0 or y[at + period : at + period + len(w)] != w:
        return []
    from_x, to_x = p - _agree_back(x, p + period, x, p), p + period + _agree(x, p + period, x, p)
    from_y, to_y = at - _agree_back(y, at + period, y, at), at + period + _agree(y, at + period, y, at)
    out = []
    for apart in (from_x - from_y, to_x - to_y):
        below = shift + (apart - shift) // period * period
        out += [(max(from_x, from_y + z), z) for z in (below, below + period) if z != shift]
    return [(q, z) for q, z in dict.fromkeys(out) if q < min(to_x, to_y + z)]


def _verify(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, c, shift, pos, x, y in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                covered = -1
                for p in sorted(pos):
                    if p < covered:
                        continue
                    fore, back = _agree(x, p, y, p - shift), _agree_back(x, p, y, p - shift)
                    covered = p + fore
                    if fore + back >= min_chars:
                        out.append((a, c, p - back, p - back - shift, fore + back))
                    for q, other in _periodic_alignments(x, p, y, shift):
                        fore, back = _agree(x, q, y, q - other), _agree_back(x, q, y, q - other)
                        if fore + back >= min_chars:
                            out.append((a, c, q - back, q - back - other, fore + back))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_a", "doc_b", "from_a", "from_b", "n_chars"])

    return run


def copy_classes(df: DataFrame) -> DataFrame:
    """(doc, rep, copies) of each text that others have too; (doc, text) as input.

    Texts are told apart by two independent 64-bit hashes and their length.
    """
    h = df.select("doc", F.xxhash64("text").alias("h1"), F.xxhash64(F.reverse("text"), F.lit(7)).alias("h2"), F.length("text").alias("n"))
    g = h.groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    return h.join(g, ["h1", "h2", "n"]).select("doc", "rep", "copies", F.col("n").cast("long").alias("n_chars"))


def shared_runs(df: DataFrame, *, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Spans shared between different texts, and the classes of equal texts.

    ``df``: (doc long, text string), doc unique.  First result: (doc_a, doc_b,
    from_a, from_b, n_chars), doc_a < doc_b, one row for each maximal common
    span that was met, between the first members of their classes; second:
    (doc, rep, copies, n_chars).  Null ids and texts, and texts under the
    length, share nothing.  ``min_chars`` may be greater than the constant the
    symbols are laid out for, not less.
    """
    if min_chars < MIN_CHARS:
        raise ValueError(f"spans under {MIN_CHARS} characters need other bounds")
    texts = df.where(f"doc is not null and length(text) >= {min_chars}").select("doc", "text")
    classes = stored(copy_classes(texts))
    extra = small_or_shuffled(classes.where("doc <> rep").select("doc"))
    single = texts.join(extra, "doc", "left_anti")
    marks = stored(spread(single).mapInArrow(_emit, "name long, doc long, pos int"))
    # names of one document fall away before any pair is made; they are counted where they are before they move
    names = marks.groupBy("name").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("name")
    both = stored(marks.join(small_or_shuffled(stored(names)), "name", "left_semi"))
    a, b = both.select("name", F.col("doc").alias("doc_a"), F.col("pos").alias("pos_a")), both.select("name", F.col("doc").alias("doc_b"), F.col("pos").alias("pos_b"))
    # a name that very many documents share is cut by the join itself, as any skewed key
    pairs = stored(a.join(b, "name").where("doc_a < doc_b").groupBy("doc_a", "doc_b", (F.col("pos_a") - F.col("pos_b")).alias("shift")).agg(F.collect_set("pos_a").alias("pos")))
    met = pairs.select(F.col("doc_a").alias("doc")).unionByName(pairs.select(F.col("doc_b").alias("doc"))).distinct()
    met = small_or_shuffled(stored(met))
    held = single.join(met, "doc", "left_semi")
    ta, tb = held.select(F.col("doc").alias("doc_a"), F.col("text").alias("x")), held.select(F.col("doc").alias("doc_b"), F.col("text").alias("y"))
    full = pairs.join(ta, "doc_a").join(tb, "doc_b").select("doc_a", "doc_b", "shift", "pos", "x", "y")
    runs = full.mapInArrow(_verify(min_chars), "doc_a long, doc_b long, from_a long, from_b long, n_chars long").distinct()
    return stored(runs), classes


def shared_pairs(df: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_a, doc_b) of the texts that share a span, doc_a < doc_b.

    Copies of one text are written out as pairs with each other and with what
    their text shares, in classes of at most EXPAND; a larger class is given by
    the pairs of its first member with the others, and shares what that shares.
    """
    runs, classes = shared_runs(df, min_chars=min_chars)
    pairs = runs.select("doc_a", "doc_b").distinct()
    small = classes.where(f"copies <= {EXPAND}").select(F.col("rep").alias("r"), "doc")
    out = pairs.join(small, pairs.doc_a == small.r, "left").select(F.coalesce("doc", "doc_a").alias("a"), "doc_b")
    out = out.join(small, out.doc_b == small.r, "left").select("a", F.coalesce("doc", "doc_b").alias("b"))
    mine = small.alias("m").join(small.alias("o"), "r").where("m.doc < o.doc").select(F.col("m.doc").alias("a"), F.col("o.doc").alias("b"))
    star = classes.where(f"copies > {EXPAND} and doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    every = out.unionByName(mine).unionByName(star)
    return every.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def shared_share(df: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, n_chars, shared_chars, shared_share) of every text that shares a span; overlapping spans count once."""
    runs, classes = shared_runs(df, min_chars=min_chars)
    spans = runs.select(F.col("doc_a").alias("doc"), F.col("from_a").alias("s"), (F.col("from_a") + F.col("n_chars")).alias("e")).unionByName(runs.select(F.col("doc_b").alias("doc"), F.col("from_b").alias("s"), (F.col("from_b") + F.col("n_chars")).alias("e")))
    before = Window.partitionBy("doc").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.distinct().withColumn("reach", F.coalesce(F.max("e").over(before), F.lit(0)))
    cover = fresh.groupBy("doc").agg(F.sum(F.greatest(F.col("e") - F.greatest("s", "reach"), F.lit(0))).alias("c"))
    # a text with copies is shared as a whole
    whole = classes.select("doc", F.col("n_chars").alias("c"))
    best = cover.unionByName(whole).groupBy("doc").agg(F.max("c").alias("shared_chars"))
    sizes = df.select("doc", F.length("text").cast("long").alias("n_chars"))
    return best.join(sizes, "doc").select("doc", "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("shared_share"))
