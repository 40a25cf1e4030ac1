"""Byte-level BPE by replaying the merges over all words of a block at once.

A block is some megabytes of whole texts. Its distinct words, less those the Python
worker has seen, are laid out as one array of symbols, and the merges are replayed over
it in rank order from an inverted index (``merging.py``). Texts are then put together
from their words.

Words in which a rank order over the corpus could differ from the order inside the
word (the pair overlaps itself, or a merge makes a pair of lower rank) are set aside
and encoded one by one from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.llm.common import Recent, blocks
from voxtally.llm.merging import Pairs, replay

# Bytes of the words that a Python worker remembers in one generation.
MEMORY_BYTES = 96 << 20
BLOCK_BYTES = 16 << 20


class Merges:
    """The ranks of a vocabulary file, and the words encoded so far."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        left, right, ranks = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    ranks.append(rank)
        self.pairs = Pairs(left, right, ranks)
        # Of each word: its ids as text, how many they are, and the bytes they decode to.
        self.known = Recent(None, MEMORY_BYTES)

    def one_word(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first."""
        n, ranks = len(word), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or ranks.get(word[i : end[j]]) != rank:
                continue
            end[i], end[j] = end[j], -1
            if end[i] < n:
                before[end[i]] = i
                if (r := ranks.get(word[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := ranks.get(word[before[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word (none of them empty), by merges over all of them."""
        lengths = np.array([len(w) for w in words], np.int64)
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        left, counts, apart = replay(token, lengths, self.pairs)
        ids, ends = left.tolist(), np.cumsum(counts).tolist()
        out, start = [], 0
        for i, end in enumerate(ends):
            out.append(self.one_word(words[i]) if apart[i] else ids[start:end])
            start = end
        return out

    def entries(self, words: list[str]) -> list[tuple[str, int, bytes]]:
        """Ids joined by commas, their number and what they decode to, for distinct words."""
        recall, keep = self.known.recall, self.known.keep
        found = [recall(w, _bytes) for w in words]
        new = [i for i, entry in enumerate(found) if entry is None]
        spelled = [words[i].encode() for i in new]
        whole = [self.ranks.get(b) for b in spelled]
        rest = [b for b, r in zip(spelled, whole) if r is None]
        parts = iter(self.replay(rest)) if rest else iter(())
        for i, r in zip(new, whole):
            ids = [r] if r is not None else next(parts)
            entry = ",".join(map(str, ids)), len(ids), b"".join(map(self.bytes_of.__getitem__, ids))
            found[i] = keep(words[i], entry, len(words[i]) + _bytes(entry))
        return found


def _bytes(entry: tuple[str, int, bytes]) -> int:
    return len(entry[0]) + len(entry[2]) + 150


_MERGES: dict = {}


def merges(path: str, pattern: str) -> Merges:
    """The merges of a file, once per Python worker."""
    if (path, pattern) not in _MERGES:
        _MERGES[path, pattern] = Merges(path, pattern)
    return _MERGES[path, pattern]


def _encoder(key: str, text: str, path: str, pattern: str, with_ids: bool):
    def encode(batches):
        m = merges(path, pattern)
        for block in blocks(batches, text, BLOCK_BYTES):
            # First the words of all texts, as numbers of the block's distinct words.
            coded, words, number = [], [], {}
            for text_value in block.column(text).to_pylist():
                numbers = []
                for word in m.split(text_value or ""):
                    c = number.get(word)
                    if c is None:
                        c = number[word] = len(words)
                        words.append(word)
                    numbers.append(c)
                coded.append(np.array(numbers, np.int32))
            entries = m.entries(words)
            ids, decoded = [e[0] for e in entries], [e[2] for e in entries]
            count = np.array([e[1] for e in entries], np.int64)
            lists, n, hashes, texts = [], [], [], []
            for c in coded:
                numbers = c.tolist()
                joined = ",".join([ids[k] for k in numbers])
                n.append(int(count[c].sum()))
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(b"".join([decoded[k] for k in numbers])).hexdigest())
                if with_ids:
                    lists.append([int(x) for x in joined.split(",")] if joined else [])
            columns = [block.column(key), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return encode


def bpe_encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]), one per document.

    ``pattern`` splits a text into words and ``path`` names the file of ranks, which
    every Python worker reads. The digests are those of the decimal ids joined by
    commas and of the bytes the ids decode to. A NULL text is an empty one and has no
    ids. An empty table gives no rows; other columns are not read. Nothing is shuffled.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return source.mapInArrow(
        _encoder(key, text, path, pattern, with_ids), schema + (", ids array<int>" if with_ids else "")
    )


def bpe_decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of a list of ids; NULL for NULL or an unknown id."""

    def decode(batches):
        bytes_of = merges(path, pattern).bytes_of
        for batch in batches:
            out = []
            for numbers in batch.column(ids).to_pylist():
                parts = None if numbers is None else [bytes_of.get(i) for i in numbers]
                out.append(None if parts is None or None in parts else b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"]
            )

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(decode, schema)
