"""Encoding a corpus with a public byte-level BPE vocabulary.

The merges are compiled into a finite-state transducer that is determinised
lazily.  A sequence of tokens is the one the merges give if and only if every
two neighbours are what the merges give for the two alone; so after each byte
exactly one token can end the text read so far, and a reader only has to follow
the tokens still growing.  A state is the set of those, each as the trie node
it has reached, the token before it and what is not yet emitted.  A token is
emitted as soon as all open readings agree on it, which bounds the lookahead by
the longest token.  States and transitions are made on first use and kept for
the life of the worker.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("THREADLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# fixed value: the published split pattern of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern with its classes written out for ASCII, whose commonest case stands first.
ASCII_PATTERN = re.compile(r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")
#: Piece results kept per worker; beyond it the transducer runs again, with the same result.
MEMO = 500_000
#: States kept per worker; beyond it the determinised part is dropped and rebuilt.
STATES = 400_000


class Transducer:
    """Byte sequence to token ids, one transition a byte."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for b, i in ranks.items():
            node = 0
            for x in b:
                nxt = self.children[node].get(x)
                if nxt is None:
                    nxt = self.children[node][x] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self._valid: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.states = [start]
        self.ids = {start: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merged(self, data: bytes) -> list[int]:
        """What the merges give, lowest rank first; used only to decide about two neighbours."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def valid(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side (left -1: the start)."""
        key = (left, right)
        v = self._valid.get(key)
        if v is None:
            a = self.bytes_of[left] if left >= 0 else b""
            v = self._valid[key] = self.merged(a + self.bytes_of[right]) == ([left] if left >= 0 else []) + [right]
        return v

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        threads, ended = [], None
        for node, left, pending in self.states[state]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if ended is None and token >= 0 and self.valid(left, token):
                ended = (0, token, (*pending, token))
            if self.children[nxt]:
                threads.append((nxt, left, pending))
        if ended is None:
            raise ValueError("the vocabulary lacks a single-byte token")
        threads.append(ended)
        agreed = os.path.commonprefix([t[2] for t in threads])
        n = len(agreed)
        new = tuple((node, left, pending[n:]) for node, left, pending in threads)
        at = self.ids.get(new)
        if at is None:
            at = self.ids[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        out = self.moves[state][byte] = (at, tuple(agreed))
        return out

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece of text, as bytes."""
        if len(self.states) > STATES:
            self._reset()
        state, out, moves = 0, [], self.moves
        for x in data:
            step = moves[state].get(x) or self._move(state, x)
            state = step[0]
            if step[1]:
                out.extend(step[1])
        # the reading that stands at the root ends with the text
        out.extend(next(p for node, _, p in self.states[state] if node == 0))
        return out


def load_ranks(path: str = VOCABULARY, data: bytes | None = None) -> dict[bytes, int]:
    """Token to id, of a vocabulary file or of what was read of one."""
    lines = (Path(path).read_bytes() if data is None else data).splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def shipped(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> Broadcast:
    """A vocabulary file of the driver, for the workers; no public one is near the bound, beyond which this raises."""
    if os.path.getsize(path) > most_bytes:
        raise ValueError(f"{path} is no vocabulary")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


class Encoder:
    """Split pattern, transducer and memo of pieces."""

    def __init__(self, path: str = VOCABULARY, data: bytes | None = None) -> None:
        self.fst = Transducer(load_ranks(path, data))
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = ASCII_PATTERN.findall
        self.memo: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.split_ascii(text) if text.isascii() else self.split(text)
        memo = self.memo
        try:
            return list(chain.from_iterable(map(memo.__getitem__, pieces)))
        except KeyError:
            own: dict[str, list[int]] = {}
            for piece in pieces:
                if piece not in memo and piece not in own:
                    (own if len(memo) >= MEMO else memo)[piece] = self.fst.encode(piece.encode("utf-8", "surrogatepass"))
            return list(chain.from_iterable(own[p] if p in own else memo[p] for p in pieces))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY, data: Broadcast | None = None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, data.value if data else None)
    return _ENCODERS[path]


class StreamDecoder:
    """Ids to text as they come: bytes that do not yet end a character wait."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.utf8.decode(b"".join(self.bytes_of[i] for i in ids))

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row, without special tokens.

    Null and empty texts have the empty list; each row is encoded whole; a key
    that comes twice gives two rows.  No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    data = shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, data)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [enc(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", *, vocabulary: str = VOCABULARY, window: int = 4096) -> DataFrame:
    """(key, text) of encoded rows, decoded as a stream of ``window`` ids at a time; null ids give null."""
    kind = df.schema[key].dataType.simpleString()
    data = shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = encoder(vocabulary, data).fst.bytes_of
        for b in batches:
            texts = []
            for row in b.column(1).to_pylist():
                if row is None:
                    texts.append(None)
                    continue
                dec = StreamDecoder(back)
                texts.append("".join(dec.feed(row[i : i + window]) for i in range(0, len(row), window)) + dec.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} {kind}, text string")
