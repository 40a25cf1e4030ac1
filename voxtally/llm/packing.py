"""Best-fit packing of token pieces into sequences, with several capacities.

Documents become pieces of at most one sequence; only longer documents are cut. The
pieces are dealt by hash into groups of about ``GROUP_PIECES``, and each group is
packed in one task by vector best-fit decreasing. A bin has three residual
capacities: tokens, documents, and attention cost (the sum of squared lengths). Of
the bins that can still take a piece under every capacity, the one with the smallest
weighted residual norm is chosen. That norm is a weighted sum, so what a piece takes
off it is the same in every bin: bins keep a fixed order until they are touched, and
the best one is found without looking at all of them. A group leaves at most a few
bins half full, a vanishing share of its sequences.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import Recent, blocks, written

GROUP_PIECES = 60_000
# Bytes of the words that a Python worker remembers in one generation.
MEMORY_BYTES = 48 << 20
END_ID = 0

_WORDS: dict = {}


class Words:
    """Ids of the words of a text (as little-endian 32-bit numbers), encoded when first asked for.

    The vocabulary drops white space and never joins what it separates, and lower-cases
    letter by letter, so a word of letters with one comma or full stop after it is the
    letters and the mark, and a word with capitals is that without. Letters go to the merges
    directly; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters: dict[str, str | None] = {}
        self.number = [np.uint32(i).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.ids = Recent(self._word, MEMORY_BYTES)

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        stem, mark = (word[:-1], word[-1]) if word[-1] in ".," else (word, "")
        # Below U+0300 no two letters compose to a third.
        if stem.isalpha() and max(stem) < "\u0300":
            known = self.letters
            spelled = [known[c] if c in known else self._letter(c) for c in stem]
            if None not in spelled:
                if mark:
                    return self.ids[stem] + self.ids[mark]
                if stem.isascii() and not stem.islower():
                    return self.ids[stem.lower()]
                return b"".join([self.number[t.id] for t in self.merge("".join(spelled))])
        [encoded] = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)
        return b"".join([self.number[i] for i in encoded.ids])

    def _letter(self, letter: str) -> str | None:
        """How the tokenizer spells a letter, None unless that is one lower-cased letter."""
        lower = self.tokenizer.normalizer.normalize_str(letter)
        spelled = None
        if len(lower) == 1 and lower.isalpha():
            spelled = "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(lower))
        self.letters[letter] = spelled
        return spelled


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit numbers, words remembered per worker."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    look = _WORDS[path].ids.__getitem__
    return [b"".join(map(look, t.replace("\n", " ").split(" "))) for t in texts]


def _pieces(key: str, text: str, path: str, size: int, block_bytes: int = 4 << 20):
    def cut(batches):
        end = np.uint32(END_ID).tobytes()
        for block in blocks(batches, text, block_bytes):
            ids = [x + end for x in encoded(block.column(text).fill_null("").to_pylist(), path)]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            n = -(-counts // size)
            doc = np.repeat(np.arange(len(ids)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * size
            length = np.minimum(counts[doc] - start, size)
            crc = [
                zlib.crc32(ids[d][4 * s : 4 * (s + m)])
                for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(key).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def best_fit(
    lengths: list[int],
    tokens: int,
    documents: int,
    cost: int,
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001),
) -> list[int]:
    """The bin of each length, by vector best-fit decreasing.

    ``documents`` and ``cost`` bound the pieces and the squared lengths in a bin. An
    empty bin takes any piece of at most ``tokens``. Equal norms go to the bin that was opened first.
    """
    wt, wd, wc = (w / c for w, c in zip(weights, (tokens, documents, cost)))
    # Open bins by residual tokens, each list in the order of the residual norm.
    bins: list[list[tuple[float, int, int, int]]] = [[] for _ in range(tokens + 1)]
    best = np.full(tokens + 1, np.inf)
    placed, opened = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        need = n * n
        room = best[n:]
        found = None
        at = int(room.argmin()) if n <= tokens else 0
        if room[at] < np.inf:
            if bins[n + at][0][3] >= need:
                found = (n + at, 0)
            else:
                # Some bins are short of cost: look on in the order of the norm.
                options = (
                    (b, t, j)
                    for t in range(n, tokens + 1)
                    for j, b in enumerate(bins[t])
                    if b[3] >= need
                )
                found = min(options, default=None)
                found = found and found[1:]
        if found is None:
            number, left, docs, cap = opened, tokens, documents, cost
            opened += 1
        else:
            t, j = found
            _, number, docs, cap = bins[t].pop(j)
            best[t] = bins[t][0][0] if bins[t] else np.inf
            left = t
        placed[i] = number
        left, docs, cap = left - n, docs - 1, cap - need
        if left and docs:
            bisect.insort(bins[left], (wt * left + wd * docs + wc * cap, number, docs, cap))
            best[left] = bins[left][0][0]
    return placed


def _packer(tokens: int, documents: int, cost: int, groups: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        lengths = np.asarray(group.column("length"))
        number = np.array(best_fit(lengths.tolist(), tokens, documents, cost), np.int64)
        order = np.argsort(number, kind="stable")
        upto = np.cumsum(lengths[order])
        first = np.r_[True, number[order][1:] != number[order][:-1]]
        base = np.maximum.accumulate(np.where(first, upto - lengths[order], 0))
        offset = np.empty(len(order), np.int64)
        offset[order] = upto - lengths[order] - base
        sequence = number * groups + group.column("_group")[0].as_py()
        return (
            group.drop_columns(["_group"])
            .append_column("sequence_id", pa.array(sequence))
            .append_column("offset", pa.array(offset))
        )

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    tokens: int = 2048,
    documents: int | None = None,
    cost: int | None = None,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    A document is its ids and the id 0 that ends it; a NULL or empty text is that id
    alone. ``documents`` and ``cost`` default to what a full sequence can hold at the
    most, so that the token capacity alone decides how few sequences there are. Keys
    are unique; rows without a key are left out. An empty table gives no rows. Every
    Python worker reads the vocabulary file at the path ``tokenizer``.
    """
    documents = documents or tokens
    cost = cost or tokens * tokens
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    source = source.filter(F.col(key).isNotNull())
    pieces = written(
        source.mapInArrow(
            _pieces(key, text, tokenizer, tokens),
            "doc_id long, piece int, start long, length long, ids_crc32 long",
        ),
        "pack-pieces",
    )
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(
        _packer(tokens, documents, cost, groups),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
