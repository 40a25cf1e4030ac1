"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period q, repeated at least three times, that
no neighbouring word extends. Whole documents are laid out one after another, a mark
of its own between any two, and searched together, block by block.

Runs of periods up to ``SMALL`` are found by comparing the words with themselves moved
by the period. For longer periods there is one round per dyadic scale t, which finds
the periods above 2t and up to 4t:

* A position i is synchronising if, of the hashes of the t words from i to i + t, the
  least is that of the first or of the last. Whether it is depends on the 2t words from i
  alone, any t positions in a row hold one, and there are about 2 n / t of them.
* Positions whose context is highly periodic (a known run of a period up to t / 3 covers
  it) are left out. They could only propose that small period again, and runs of small
  periods are known from earlier rounds.
* Contexts of 3t words (for periods up to 3t) and of 4t words (above) are hashed. In a
  run, a context as long as the period stands exactly one period further on, and nowhere
  in between; so two neighbouring positions of equal context propose their distance.
* A proposal is decided by comparing words: the stretch in which the words equal those one
  distance further on is extended both ways, must cover two distances, and the distance
  must not be a multiple of a smaller period.

That no run is missed: a run [s, e) of period p in (2t, 4t] has a synchronising position
in [s, s + t), and its context, that one p further on and the steps between fit into
3p words. If that context is highly periodic up to u, u < s + p + t / 3 (else the run
itself had the small period), and a position among the first t whose contexts reach
beyond u serves as well. Hashes have 64 bits and are mixed at every doubling; they choose
what is compared, and equality itself is always that of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import blocks, mixed, text_bytes, word_bounds

SMALL = 8
BLOCK_BYTES = 4 << 20
# Words compared at once when a proposal is extended; doubled as long as they agree.
FIRST_COMPARED = 64


def _prime_factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return [*out, n] if n > 1 else out


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal stretch of True."""
    edges = np.flatnonzero(np.diff(np.r_[False, equal, False].view(np.int8)))
    return edges[::2], edges[1::2]


def _small(t: np.ndarray, times: int) -> list[np.ndarray]:
    """Runs of periods up to ``SMALL`` that are repeated ``times`` times, as rows (start, length, period)."""
    equal = {q: t[:-q] == t[q:] for q in range(1, min(SMALL, len(t) - 1) + 1)}
    found = []
    for q, e in equal.items():
        a, b = _stretches(e)
        fine = b - a >= (times - 1) * q
        a, b = a[fine], b[fine]
        for r in _prime_factors(q):
            if len(a):
                # One period that repeats a shorter one makes the whole stretch do so.
                agree = np.r_[0, np.cumsum(equal[q // r])]
                own = agree[a + q - q // r] - agree[a] < q - q // r
                a, b = a[own], b[own]
        found.append(np.stack([a, b - a + q, np.full(len(a), q)], axis=1))
    return found


def _extended(t: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The maximal [a, b) around i in which every word equals that ``d`` further on."""
    b, step = i, FIRST_COMPARED
    while b + d < len(t):
        end = min(b + step, len(t) - d)
        differ = t[b:end] != t[b + d : end + d]
        if differ.any():
            b += int(differ.argmax())
            break
        b, step = end, step * 2
    a, step = i, FIRST_COMPARED
    while a > 0:
        start = max(a - step, 0)
        differ = t[start:a] != t[start + d : a + d]
        if differ.any():
            a -= int(differ[::-1].argmax())
            break
        a, step = start, step * 2
    return a, b


def _proposals(key: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of neighbouring positions with equal context, ``low`` < distance <= ``high``."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    distance = at[1:] - at[:-1]
    near = (key[1:] == key[:-1]) & (distance > low) & (distance <= high)
    return at[:-1][near], distance[near]


def find_runs(t: np.ndarray, starts: np.ndarray, lengths: np.ndarray, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs repeated at least ``times`` (3 or more) times.

    ``t`` holds the words of all texts as numbers, with a number of its own behind each
    text; text k begins at ``starts[k]`` and has ``lengths[k]`` words.
    """
    found = _small(t, times) if len(t) > 1 else []
    scale = max(SMALL // 2, 1)
    keep = None
    while len(lengths) and int(lengths.max()) >= times * (2 * scale + 1):
        # Only texts that can hold a run of this scale go on.
        long = lengths >= times * (2 * scale + 1)
        if keep is None or not long.all():
            starts, lengths = starts[long], lengths[long]
            size = lengths + 1
            first = np.cumsum(size) - size
            place = np.repeat(starts - first, size) + np.arange(int(size.sum()))
            words = mixed(t[place].astype(np.uint64))
            hashes, width = words, 1
            keep = True
        n = len(place)
        while width < scale:
            hashes, width = _doubled(hashes, width), width * 2
        least, reach = hashes, 1
        while reach < scale:
            least, reach = np.minimum(least[: n - reach], least[reach:]) if n > reach else least[:0], reach * 2
            least = np.r_[least, np.full(n - len(least), np.uint64(0xFFFFFFFFFFFFFFFF))]
        if n > scale:
            window = np.minimum(least[:-1], least[1:])[: n - scale]
            chosen = np.flatnonzero((window == hashes[: n - scale]) | (window == hashes[scale:]))
        else:
            chosen = np.zeros(0, np.int64)
        twice = _doubled(hashes, scale)
        seen: dict[int, int] = {}
        rows = []
        periodic = [r[(r[:, 2] <= scale / 3) & (r[:, 1] >= 3 * scale)] for r in found]
        periodic = np.concatenate(periodic) if periodic else np.zeros((0, 3), np.int64)
        for context, tail in ((3 * scale, hashes), (4 * scale, twice)):
            at = chosen[chosen + context <= n]
            if len(periodic):
                cover = np.zeros(len(t) + 1, np.int64)
                inside = periodic[periodic[:, 1] >= context]
                np.add.at(cover, inside[:, 0], 1)
                np.add.at(cover, inside[:, 0] + inside[:, 1] - context + 1, -1)
                at = at[np.cumsum(cover)[place[at]] == 0]
            key = mixed(twice[at] ^ mixed(tail[at + 2 * scale] + np.uint64(context)))
            low = 2 * scale if context == 3 * scale else 3 * scale
            i, distance = _proposals(key, place[at], low, context)
            order = np.lexsort((i, distance))
            for p, d in zip(i[order].tolist(), distance[order].tolist()):
                if p < seen.get(d, 0):
                    continue
                a, b = _extended(t, p, d)
                seen[d] = b + 1
                if b - a < (times - 1) * d:
                    continue
                if any(np.array_equal(t[a : a + d - d // r], t[a + d // r : a + d]) for r in _prime_factors(d)):
                    continue
                rows.append((a, b - a + d, d))
        if rows:
            found.append(np.array(rows, np.int64))
        scale *= 2
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _doubled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of twice as many words; behind the last whole ones, anything."""
    if len(hashes) <= width:
        return mixed(hashes)
    moved = np.r_[hashes[width:], hashes[:width]]
    return mixed(hashes + mixed(moved + np.uint64(width)))


def _numbered(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The words as numbers, equal for equal words."""
    if not len(first):
        return np.zeros(0, np.int64)
    sizes = last - first
    offsets = np.r_[0, np.cumsum(sizes)]
    place = np.repeat(first - offsets[:-1], sizes) + np.arange(int(offsets[-1]))
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[place]))]
    words = pa.Array.from_buffers(pa.large_binary(), len(first), buffers)
    return np.asarray(words.dictionary_encode().indices).astype(np.int64)


def _joined(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each with a blank behind it, and where each begins."""
    sizes = last - first + 1
    offsets = np.r_[0, np.cumsum(sizes)]
    place = np.repeat(first - offsets[:-1], sizes) + np.arange(int(offsets[-1]))
    # The byte behind a word may be that of the next text, or none.
    out = data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    out[offsets[1:] - 1] = 0x20
    return out, offsets


def _finder(key: str, text: str, shortest: int, times: int, with_text: bool):
    def find(batches):
        for block in blocks(batches, text, BLOCK_BYTES):
            data, bounds = text_bytes(block.column(text))
            first, last, word_at = word_bounds(data, bounds)
            counts = np.diff(word_at)
            texts = len(counts)
            # Words and, behind each text, a number that no other place has.
            starts = word_at[:-1] + np.arange(texts)
            t = np.empty(len(first) + texts, np.int64)
            behind = starts + counts
            inner = np.ones(len(t), bool)
            inner[behind] = False
            t[inner] = _numbered(data, first, last)
            t[behind] = -1 - np.arange(texts)
            runs = find_runs(t, starts, counts, times)
            runs = runs[runs[:, 1] >= shortest]
            doc = np.searchsorted(starts, runs[:, 0], "right") - 1
            order = np.lexsort((runs[:, 2], runs[:, 0]))
            runs, doc = runs[order], doc[order]
            dropped = np.zeros(len(t) + 1, np.int64)
            np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
            np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
            kept = (np.cumsum(dropped[:-1]) == 0)[inner]
            struct = pa.StructArray.from_arrays(
                [pa.array(runs[:, 0] - starts[doc]), pa.array(runs[:, 1]), pa.array(runs[:, 2])],
                ["start", "length", "period"],
            )
            offsets = np.searchsorted(doc, np.arange(texts + 1)).astype(np.int32)
            columns = [
                block.column(key),
                pa.array(counts),
                pa.ListArray.from_arrays(pa.array(offsets), struct),
            ]
            names = ["doc_id", "n_words", "runs"]
            if with_text:
                joined, at = _joined(data, first, last)
                if not kept.all():
                    joined = joined[np.repeat(kept, np.diff(at))]
                upto = np.r_[0, np.cumsum(np.diff(at) * kept)][word_at].tolist()
                whole = joined.tobytes()
                collapsed = [whole[a : b - 1].decode() if b > a else "" for a, b in zip(upto, upto[1:])]
                columns.append(pa.array(collapsed, pa.string()))
                names.append("collapsed_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return find


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shortest: int = 24,
    times: int = 3,
    with_text: bool = True,
) -> DataFrame:
    """Rows (doc_id, n_words, runs[, collapsed_text]), one per document.

    Words are runs without ASCII white space. ``runs`` lists (start, length, period) of
    every run of at least ``shortest`` words that is repeated at least ``times`` (3 or
    more) times, by start, then period. ``collapsed_text`` holds the words but those that
    a run covers after its first period, joined by one blank.

    A NULL, empty or blank text has no words and no runs. Rows come out as they are:
    repeated ones are repeated, and a NULL key stays. An empty table gives no rows;
    other columns are not read. Nothing is shuffled; a text is never split, and a
    task holds some hundred bytes for each word of a block or of one longer text.
    """
    if times < 3:
        raise ValueError("runs must be repeated at least three times")
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>"
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return source.mapInArrow(
        _finder(key, text, shortest, times, with_text), schema + (", collapsed_text string" if with_text else "")
    )
