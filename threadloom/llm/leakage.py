"""Evaluation texts leaking into training text, found by an FM-index per shard.

Each task concatenates whole documents into shards of words, sorts their
suffixes, keeps the Burrows-Wheeler transform in a wavelet matrix and searches
all test phrases backward at once.  Positions come from sampled suffixes by
walking to the last sampled one.  Overlapping hits of an item in a document are
merged into one span.  The test phrases are a table of blocks in the shared
folder; a shard is searched for one block after the other.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WORD, read_blobs, words
from threadloom.runtime import drop_at_end, shared_folder, spread

MIN_WORDS = 13
SHARD_WORDS = 1_000_000
#: Bytes of item texts in a block.
BLOCK_BYTES = 4 << 20
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; each round sorts only those still tied."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    ordered = text[sa]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    rank = np.empty(n, np.int64)
    rank[sa] = head
    h = 1
    while True:
        single = new & np.append(new[1:], True)
        tied = np.flatnonzero(~single)
        if not len(tied):
            return sa
        at = sa[tied]
        after = at + h
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        order = np.argsort(rank[at] * (n + 1) + nxt + 1, kind="stable")
        sa[tied] = at = at[order]
        key_a, key_b = rank[at], nxt[order]
        starts = np.empty(len(tied), bool)
        starts[0] = True
        starts[1:] = (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])
        new[tied] = starts
        rank[at] = np.maximum.accumulate(np.where(starts, tied, 0))
        h *= 2


class WaveletMatrix:
    """Rank of any symbol in O(levels) array look-ups, for many queries at once."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        self.split: list[int] = []
        seq = seq.astype(np.int32)
        self.bits: list[np.ndarray] = []
        for level in range(self.levels - 1, -1, -1):
            one = (seq >> level) & 1
            z = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(1 - one, out=z[1:], dtype=np.int32)
            self.zeros.append(z)
            self.split.append(int(z[-1]))
            self.bits.append(one.astype(bool))
            seq = np.concatenate([seq[one == 0], seq[one == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        i, o = at.astype(np.int64), np.zeros(len(at), np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbols >> level) & 1).astype(bool)
            zi, zo = self.zeros[k][i], self.zeros[k][o]
            i = np.where(one, self.split[k] + i - zi, zi)
            o = np.where(one, self.split[k] + o - zo, zo)
        return i - o

    def access(self, at: np.ndarray) -> np.ndarray:
        i, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for k in range(self.levels):
            one = self.bits[k][i]
            z = self.zeros[k][i]
            i = np.where(one, self.split[k] + i - z, z)
            out = out * 2 + one
        return out


class FMIndex:
    """Count and locate phrases in a sequence of symbols 1..sigma-1 (0 is added as its end)."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        text = np.append(seq, 0)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.matrix = WaveletMatrix(bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.n = len(text)
        self.sampled = sa % SAMPLE == 0
        self.samples = np.cumsum(self.sampled)
        self.values = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval [lo, hi) of each phrase (rows of equal length)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.before[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.before[c] + self.matrix.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking back to a sampled one."""
        rows, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            c = self.matrix.access(rows[open_])
            rows[open_] = self.before[c] + self.matrix.rank(c, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.values[self.samples[rows] - 1] + steps


class Phrases:
    """All runs of n words of a block of items: their words as numbers, and the item of each run."""

    def __init__(self, vocab: list[str], runs: np.ndarray, owner: np.ndarray) -> None:
        self.vocab, self.runs, self.owner = vocab, runs, owner

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], n: int) -> Phrases:
        ids: dict[str, int] = defaultdict()
        ids.default_factory = ids.__len__
        runs, owner = [np.zeros((0, n), np.int32)], [np.zeros(0, np.int64)]
        for item, text in items:
            w = np.fromiter(map(ids.__getitem__, words(text)), np.int32)
            if len(w) >= n:
                runs.append(np.lib.stride_tricks.sliding_window_view(w, n))
                owner.append(np.full(len(w) - n + 1, item, np.int64))
        return cls(list(ids), np.concatenate(runs), np.concatenate(owner))

    def blob(self) -> bytes:
        named = "\0".join(self.vocab).encode("utf-8", "surrogatepass")
        return b"".join((np.array([len(named), *self.runs.shape], np.int64).tobytes(), named, self.runs.astype(np.int32).tobytes(), self.owner.tobytes()))

    @classmethod
    def read(cls, blob: bytes) -> Phrases:
        size, rows, n = np.frombuffer(blob, np.int64, 3).tolist()
        at = 24 + size
        runs = np.frombuffer(blob[at : at + 4 * rows * n], np.int32).reshape(rows, n)
        return cls(blob[24:at].decode("utf-8", "surrogatepass").split("\0"), runs, np.frombuffer(blob[at + 4 * rows * n :], np.int64))


class Shard:
    """Documents, as numbers of words, in one index."""

    def __init__(self, docs: list[tuple[int, list[int]]], vocab: dict[str, int]) -> None:
        self.docs, self.vocab = docs, vocab
        lengths = np.array([len(w) + 1 for _, w in docs], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        seq = np.ones(int(lengths.sum()), np.int64)  # symbol 1 ends each document
        for (_, w), b in zip(docs, self.begins, strict=True):
            seq[b : b + len(w)] = w
        self.index = FMIndex(seq, len(vocab) + 2)

    def search(self, phrases: Phrases, n: int) -> list[tuple[int, int, int, int]]:
        """(item, doc, first word, end word) of the merged spans."""
        number = np.array([self.vocab.get(w, -1) for w in phrases.vocab] or [-1], np.int64)
        runs = number[phrases.runs]
        known = np.flatnonzero((runs >= 0).all(axis=1))
        if not len(known):
            return []
        unique, back = np.unique(runs[known], axis=0, return_inverse=True)
        lo, hi = self.index.search(unique)
        count = hi - lo
        if not count.any():
            return []
        which = np.repeat(np.arange(len(unique)), count)
        rows = np.repeat(lo, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        pos = self.index.locate(rows)
        doc = np.searchsorted(self.begins, pos, side="right") - 1
        items_of: dict[int, set[int]] = defaultdict(set)
        for r, u in zip(known.tolist(), back.ravel().tolist(), strict=True):
            if count[u]:
                items_of[u].add(int(phrases.owner[r]))
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for u, d, p in zip(which.tolist(), doc.tolist(), (pos - self.begins[doc]).tolist(), strict=True):
            for item in items_of[u]:
                hits[item, d].append(p)
        out = []
        for (item, d), places in hits.items():
            places = sorted(set(places))
            start = last = places[0]
            for p in places[1:]:
                if p > last + n:
                    out.append((item, self.docs[d][0], start, last + n))
                    start = p
                last = p
            out.append((item, self.docs[d][0], start, last + n))
        return out


def phrase_blocks(items: DataFrame, key: str, text: str, min_words: int, block_bytes: int) -> str:
    """The folder of the items' phrases, in blocks of about so many bytes of text; items of one id stay together."""
    spark = items.sparkSession
    asked = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("item"), F.col(text).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        bytes_ = 0
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and bytes_ >= block_bytes and item != held[-1][0]:
                    yield pa.RecordBatch.from_arrays([pa.array([Phrases.of(held, min_words).blob()], pa.binary())], names=["blob"])
                    held, bytes_ = [], 0
                held.append((item, t))
                bytes_ += len(t)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([Phrases.of(held, min_words).blob()], pa.binary())], names=["blob"])

    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    asked.repartition(max(1, -(-size // block_bytes)), "item").sortWithinPartitions("item").mapInArrow(pack, "blob binary").write.option("compression", "zstd").parquet(folder)
    drop_at_end(spark, folder)
    return folder


def find_leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, doc_id, word_from, word_to, char_from, char_to) of every leaked span.

    A span is a stretch of the document covered by runs of ``min_words`` words
    of the item; ends are exclusive.  The items are the stated query set: every
    shard is searched for all of them, in blocks, so their number is not bound.
    Null and empty texts, on either side, and items of fewer words give no
    rows; an item id that comes twice counts as one item with both texts.  No
    shuffle of the corpus.
    """
    folder = phrase_blocks(items, item_key, item_text, min_words, block_bytes)

    def flush(docs: list, raw: list, vocab: dict[str, int]) -> Iterator[tuple]:
        shard = Shard(docs, vocab)
        for blob in read_blobs(folder):
            for item, d, a, b in shard.search(Phrases.read(blob), min_words):
                yield item, d, a, b, raw[d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            docs, raw, n = [], [], 0
            vocab: dict[str, int] = defaultdict()
            vocab.default_factory = lambda: len(vocab) + 2
            for b in batches:
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not t or d is None:
                        continue
                    w = WORD.findall(t.lower())
                    if len(w) < min_words:
                        continue
                    docs.append((len(raw), list(map(vocab.__getitem__, w))))
                    raw.append((d, t))
                    n += len(w) + 1
                    if n >= shard_words:
                        yield from flush(docs, raw, vocab)
                        docs, raw, n = [], [], 0
                        vocab.clear()
            if docs:
                yield from flush(docs, raw, vocab)

        rows = []
        for item, _, a, b, (d, t) in found():
            low = t.lower()
            if len(low) == len(t):
                spans = [m.span() for m in WORD.finditer(low)]
                rows.append((item, d, a, b, spans[a][0], spans[b - 1][1]))
            else:  # lower-casing has changed the length: no offsets, but the words stand
                rows.append((item, d, a, b, None, None))
            if len(rows) >= 10_000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)

    return spread(documents.select(key, text)).mapInArrow(run, "item_id long, doc_id long, word_from long, word_to long, char_from long, char_to long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id", "word_from", "word_to", "char_from", "char_to"])
