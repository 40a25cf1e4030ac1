"""SentencePiece encoding that keeps the place of every piece in the source, and decoding.

A text is first normalised: at every position the longest prefix that the compiled
character map of the model knows is replaced, all other characters stand for
themselves, and blanks become a visible mark. The map is a double-array trie inside
the model file; it is unfolded once per worker. What a normalised character came
from is kept as runs (normalised byte, source byte, one to one or not), so that every
piece is projected to the bytes of the source that it stands for.

Pieces are merged as in byte-level BPE, highest score first. No piece holds the mark
behind another character, so the words between marks are independent; the distinct
words of a block that the worker does not remember are merged together
(``merging.py``). Words with a run of marks, whose pieces may have equal scores, are
merged on their own.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.llm.common import Recent, blocks
from voxtally.llm.merging import Pairs, replay

# Fixed values of the model format -----------------------------------------------
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
MARK = "▁"
UNKNOWN_SHOWN = " ⁇ "
# ----------------------------------------------------------------------------------
# Bytes of the words that a Python worker remembers in one generation.
MEMORY_BYTES = 96 << 20
BLOCK_BYTES = 8 << 20


def _fields(data: bytes):
    """Field numbers and values of a protocol buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = varint(i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def unfolded(compiled: bytes) -> dict[str, str]:
    """The replacements of a compiled character map: a double-array trie and the texts it points to."""
    if not compiled:
        return {}
    (size,) = struct.unpack_from("<I", compiled)
    units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
    texts = compiled[4 + size :]
    found: dict[str, str] = {}
    todo = [(0, b"")]
    while todo:
        at, key = todo.pop()
        unit = units[at]
        below = at ^ ((unit >> 10) << ((unit & 512) >> 6))
        if unit >> 8 & 1:
            start = units[below] & 0x7FFFFFFF
            found[key.decode()] = texts[start : texts.index(b"\0", start)].decode()
        for byte in range(1, 256):
            child = below ^ byte
            if child < len(units) and units[child] & 0x800000FF == byte:
                todo.append((child, key + bytes([byte])))
    return found


class Alignment:
    """Where normalised bytes come from: runs (normalised start, source start), one to one or not."""

    def __init__(self, starts: list[int], sources: list[int], exact: list[bool], size: int, source_size: int):
        self.starts, self.sources = np.array(starts, np.int64), np.array(sources, np.int64)
        self.exact = np.array(exact, bool)
        self.size, self.source_size = size, source_size

    def source(self, at: np.ndarray) -> np.ndarray:
        """Source byte of each normalised byte position; the end of the text maps to its end."""
        run = np.searchsorted(self.starts, at, "right") - 1
        out = self.sources[run] + np.where(self.exact[run], at - self.starts[run], 0)
        return np.where(at >= self.size, self.source_size, out)


class Plain:
    """The same where every character stands for itself and blanks alone become marks."""

    def __init__(self, source: bytes, prefix: int, mark: int):
        blanks = np.flatnonzero(np.frombuffer(source, np.uint8) == 0x20)
        self.blanks = blanks + prefix + np.arange(len(blanks)) * (mark - 1)
        self.prefix, self.wider, self.source_size = prefix, mark - 1, len(source)

    def source(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(at - self.prefix - self.wider * np.searchsorted(self.blanks, at, "left"), 0)


class Model:
    """What a model file says, and the words encoded so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        rules = dict(_fields(next((v for k, v in top if k == 3), b"")))
        self.pieces, scores, kinds = [], [], []
        for number, value in top:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
        if trainer.get(3, 1) != BPE or USER_DEFINED in kinds or UNUSED in kinds or trainer.get(24, 0):
            raise ValueError("only BPE models without own symbols and with marks as prefixes")
        self.unknown = kinds.index(UNKNOWN)
        self.end = trainer.get(42, 2)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.mark = MARK if rules.get(5, 1) else " "
        self.rules = unfolded(rules.get(2, b""))
        # The characters at which a replacement may begin, and the longest key.
        starters = {k[0] for k in self.rules}
        self.starter = re.compile(f"[{re.escape(''.join(sorted(starters)))}]") if starters else None
        self.longest = max(map(len, self.rules), default=0)

        # Ranks by score; equal scores share a turn, in which the leftmost pair comes first.
        usable = sorted((i for i, k in enumerate(kinds) if k == NORMAL), key=lambda i: (-scores[i], i))
        self.rank = {self.pieces[i]: r for r, i in enumerate(usable)}
        self.id_of = np.array([*usable, self.unknown], np.int32)
        turns = {s: t for t, s in enumerate(sorted({scores[i] for i in usable}, reverse=True))}
        self.turn = [turns[scores[i]] for i in usable]
        left, right, ranks = [], [], []
        for piece, r in self.rank.items():
            for cut in range(1, len(piece)):
                a, b = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    ranks.append(r)
        self.pairs = Pairs(left, right, ranks)
        # By rank: the id as text, the bytes of the piece, and what it shows.
        self.text_of = [str(i) for i in self.id_of.tolist()]
        spelled = [self.pieces[i] for i in self.id_of.tolist()]
        self.size_of = np.array([len(p.encode()) for p in spelled], np.int32)
        self.shown_of = [p.replace(MARK, " ") for p in spelled]
        self.rank_of_point = np.full(0x110000, len(usable), np.int32)
        for piece, r in self.rank.items():
            if len(piece) == 1:
                self.rank_of_point[ord(piece)] = r
        self.merged = {(a, b): r for a, b, r in zip(left, right, ranks)}
        # Merges of equal score come leftmost first, which a replay over all words does not know.
        # As a rule only runs of marks have such; else every word is merged on its own.
        marks = re.escape(self.mark)
        count = np.bincount(self.turn)
        tied = any(count[t] > 1 and len(p) > 1 and p.strip(self.mark) for p, t in zip(self.rank, self.turn))
        self.own_way = re.compile("" if tied else marks + marks).search
        inside = {c for p in self.rank if len(p) > 1 for c in p}
        if not inside <= self.rank.keys():
            raise ValueError("a piece has a character that is no piece")
        if any(self.mark in p.lstrip(self.mark) for p in self.rank):
            self.words = None
        else:
            # Of the characters that no longer piece holds, line ends and tabs cut best.
            cuts = re.escape("".join(c for c in "\t\n\x0b\x0c\r" if c not in inside))
            apart = f"|[{cuts}]+" if cuts else ""
            self.words = re.compile(f"{marks}+[^{marks}{cuts}]*|[^{marks}{cuts}]+{apart}").findall
        self.known = Recent(None, MEMORY_BYTES)

    # Normalisation ------------------------------------------------------------------
    def normalised(self, text: str) -> tuple[str, Alignment | Plain | None]:
        """The normalised text and where its bytes come from; None for no text."""
        if self.squeeze:
            return self._squeezed(text)
        if not text:
            return "", None
        if self.starter is None:
            before, mark = self.mark if self.prefix else "", len(self.mark.encode())
            aligned = Plain(text.encode(), len(before.encode()), mark)
            return before + text.replace(" ", self.mark), aligned
        parts, runs = [], []
        at = source = 0

        def put(piece: str, from_bytes: int, exact: bool) -> None:
            nonlocal at, source
            parts.append(piece)
            runs.append((at, source, exact))
            at += len(piece.encode())
            source += from_bytes

        if self.prefix:
            put(self.mark, 0, False)
        for kind, piece, from_bytes in self._replaced(text):
            # A blank is one byte, its mark may be more: each blank is a run of its own.
            for k, stretch in enumerate(piece.split(" ") if self.mark != " " else [piece]):
                if k:
                    put(self.mark, 1 if kind else 0, False)
                if stretch:
                    put(stretch, len(stretch.encode()) if kind else 0, kind)
            if not kind:
                source += from_bytes
        if not runs:
            return "", None
        return "".join(parts), Alignment(*map(list, zip(*runs)), at, source)

    def _replaced(self, text: str):
        """(whether as it stands, what stands there now, source bytes), by the longest key at each place."""
        if self.starter is None:
            yield True, text, len(text.encode())
            return
        at = 0
        while at < len(text):
            hit = self.starter.search(text, at)
            here = hit.start() if hit else len(text)
            if here > at:
                yield True, text[at:here], len(text[at:here].encode())
            if not hit:
                return
            for n in range(min(self.longest, len(text) - here), 0, -1):
                key = text[here : here + n]
                if key in self.rules:
                    yield False, self.rules[key], len(key.encode())
                    break
            else:
                n, key = 1, text[here]
                yield True, key, len(key.encode())
            at = here + n

    def _squeezed(self, text: str) -> tuple[str, Alignment | None]:
        """As :meth:`normalised`, with outer blanks gone and runs of blanks as one."""
        out, sources, source = [], [], 0
        heading = behind_blank = True

        def put(piece: str, from_bytes: int) -> None:
            nonlocal source, heading, behind_blank
            if heading and piece != " ":
                heading = False
                if self.prefix:
                    out.append(self.mark)
                    sources.append(source)
            if not heading and (piece := piece.lstrip(" ") if behind_blank else piece):
                out.extend(piece.replace(" ", self.mark))
                sources.extend([source] * len(piece))
                behind_blank = piece.endswith(" ")
            source += from_bytes

        for kind, piece, from_bytes in self._replaced(text):
            if kind:
                for c in piece:
                    put(c, len(c.encode()))
            else:
                put(piece, from_bytes)
        end = source
        # Marks that stood in the text itself go as well.
        while out and out[-1] == self.mark:
            out.pop()
            end = sources.pop()
        if not out:
            return "", None
        sizes = np.array([len(c.encode()) for c in out])
        starts = (np.cumsum(sizes) - sizes).tolist()
        return "".join(out), Alignment(starts, sources, [False] * len(out), int(sizes.sum()), end)

    # Merging ------------------------------------------------------------------------
    def one_word(self, symbols: list[int]) -> list[int]:
        """Merge by turn, leftmost first."""
        merged, turn, n = self.merged, self.turn, len(symbols)
        token, end, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i, j):
            r = merged.get((token[i], token[j]))
            if r is not None:
                heapq.heappush(heap, (turn[r], i, token[i], token[j], r))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, r = heapq.heappop(heap)
            j = end[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = r, -1
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
                offer(i, end[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [t for t in token if t >= 0]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, and where those of each word end.

        Symbols are named by rank; a character that is no piece keeps the last number.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        token = self.rank_of_point[points]
        left, counts, apart = replay(token, lengths, self.pairs)
        apart |= np.fromiter((self.own_way(w) is not None for w in words), bool, len(words))
        if not apart.any():
            return left, np.cumsum(counts)
        upto, ends = np.cumsum(lengths), np.cumsum(counts)
        parts = np.split(left, ends[:-1])
        for i in np.flatnonzero(apart):
            parts[i] = np.array(self.one_word(token[upto[i] - lengths[i] : upto[i]].tolist()), np.int32)
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def entries(self, words: list[str]) -> list[tuple[str, bytes, str]]:
        """Of each distinct word: ids as text, the bytes of the source each piece stands for (32-bit), what the ids show."""
        recall, keep = self.known.recall, self.known.keep
        found = [recall(w, _held) for w in words]
        new = [i for i, entry in enumerate(found) if entry is None]
        if not new:
            return found
        none = len(self.id_of) - 1
        symbols, ends = self._merged([words[i] for i in new])
        odd = np.logical_or.reduceat(symbols == none, np.r_[0, ends[:-1]])
        sizes = self.size_of[symbols].tobytes()
        numbers = symbols.tolist()
        texts = list(map(self.text_of.__getitem__, numbers))
        shown = list(map(self.shown_of.__getitem__, numbers))
        start = 0
        for i, end, unknown in zip(new, ends.tolist(), odd.tolist()):
            if unknown:
                entry = self._with_bytes(words[i], numbers[start:end])
            else:
                entry = " ".join(texts[start:end]), sizes[4 * start : 4 * end], "".join(shown[start:end])
            found[i] = keep(words[i], entry, len(words[i]) + _held(entry))
            start = end
        return found

    def _with_bytes(self, word: str, symbols: list[int]) -> tuple[str, bytes, str]:
        """An entry of :meth:`entries` for a word with characters that are no pieces."""
        ids, sizes, at = [], [], 0
        for s in symbols:
            if s != len(self.id_of) - 1:
                piece = self.pieces[self.id_of[s]]
                ids.append(int(self.id_of[s]))
                sizes.append(len(piece.encode()))
                at += len(piece)
                continue
            char = word[at].encode()
            at += 1
            if self.byte_ids:
                # All bytes but the last stand for nothing; the last for the character.
                ids += [self.byte_ids[b] for b in char]
                sizes += [0] * (len(char) - 1) + [len(char)]
            else:
                ids.append(self.unknown)
                sizes.append(len(char))
        return " ".join(map(str, ids)), np.array(sizes, np.int32).tobytes(), self.shown(ids)

    def cut(self, text: str) -> list[str]:
        """Words that are merged independently of each other; together they are the text."""
        if self.words is None:
            return [text] if text else []
        return self.words(text)

    # Decoding -----------------------------------------------------------------------
    def shown(self, ids: list[int]) -> str:
        """The pieces of some ids with blanks for marks; bytes that are no UTF-8 show as U+FFFD each."""
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i is None or i in self.control:
                continue
            out.append(UNKNOWN_SHOWN if i == self.unknown else self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def leading(self, ids: Iterable[int]) -> int:
        """Blanks at the front of what some ids show that are no part of the text.

        The first piece loses the mark that was put before the text. Where runs of blanks
        are squeezed, every piece loses a mark until one has shown something.
        """
        marks = 0
        for i in ids:
            if i in self.control:
                continue
            marked = (self.prefix or self.squeeze) and i not in self.byte_of and self.pieces[i].startswith(MARK)
            marks += marked
            if not (marked and self.squeeze and self.pieces[i] == MARK):
                break
        return marks

    def decode(self, ids: list[int]) -> str:
        """The text of some ids."""
        return self.shown(ids)[self.leading(ids) :]


def _held(entry: tuple[str, bytes, str]) -> int:
    return len(entry[0]) + len(entry[1]) + len(entry[2]) + 200


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of a file, once per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _encoder(key: str, text: str, path: str, with_pieces: bool):
    def encode(batches):
        m = model(path)
        end = str(m.end)
        end_id = np.array([m.end], np.int32).tobytes()
        for block in blocks(batches, text, BLOCK_BYTES):
            # First the words of all texts, as numbers of the block's distinct words.
            number: dict[str, int] = {}
            coded, aligned = [], []
            for value in block.column(text).to_pylist():
                norm, alignment = m.normalised(value or "")
                coded.append([number.setdefault(w, len(number)) for w in m.cut(norm)])
                aligned.append(alignment)
            entries = m.entries(list(number))
            texts, sizes_of, shown = ([e[k] for e in entries] for k in range(3))
            out = {c: [] for c in ("n", "ids_sha", "text_sha", "crc", "ids", "first", "last", "decoded")}
            for words, alignment in zip(coded, aligned):
                joined = " ".join([*[texts[w] for w in words], end])
                out["ids_sha"].append(hashlib.sha256(joined.encode()).hexdigest())
                front = (int(i) for w in words for i in texts[w].split(" "))
                decoded = "".join([shown[w] for w in words])[m.leading(front) :]
                out["text_sha"].append(hashlib.sha256(decoded.encode()).hexdigest())
                # Pieces to source bytes; the end id stands behind the last one.
                sizes = np.frombuffer(b"".join([sizes_of[w] for w in words]), np.int32)
                out["n"].append(len(sizes) + 1)
                bounds = np.zeros(len(sizes) + 2, np.int64)
                np.cumsum(sizes, out=bounds[1:-1])
                if alignment is not None:
                    bounds[:-1] = alignment.source(bounds[:-1])
                    bounds[-1] = bounds[-2]
                spans = np.stack([bounds[:-1], bounds[1:]], axis=1).astype("<u4")
                out["crc"].append(zlib.crc32(spans))
                if with_pieces:
                    out["ids"].append([int(i) for i in joined.split(" ")])
                    out["first"].append(bounds[:-1].tolist())
                    out["last"].append(bounds[1:].tolist())
                    out["decoded"].append(decoded)
            columns = [
                block.column(key),
                pa.array(out["n"], pa.int64()),
                pa.array(out["ids_sha"], pa.string()),
                pa.array(out["text_sha"], pa.string()),
                pa.array(out["crc"], pa.int64()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]
            if with_pieces:
                columns += [
                    pa.array(out["ids"], pa.list_(pa.int32())),
                    pa.array(out["first"], pa.list_(pa.int64())),
                    pa.array(out["last"], pa.list_(pa.int64())),
                    pa.array(out["decoded"], pa.string()),
                ]
                names += ["ids", "starts", "ends", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return encode


def encode_pieces(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_pieces: bool = True
) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32[, ids, starts, ends, decoded]).

    One row per document, with its ids and the end id of the model file at ``path``,
    which every Python worker reads. ``starts`` and ``ends`` are the bytes of the source
    (UTF-8) that each piece stands for: pieces cover the source without a gap, a mark
    put before the text covers nothing, of the bytes of an unknown character the last
    one covers it, and the end id stands behind everything. ``spans_crc32`` is the
    checksum of all (start, end) as little-endian 32-bit numbers. The digests are those
    of the decimal ids joined by blanks and of the text the ids decode to.

    A NULL text is an empty one and has the end id alone. Rows come out as they are:
    repeated ones are repeated, and a NULL key stays. An empty table gives no rows;
    other columns are not read. Nothing is shuffled. A model that is not BPE, or has
    own or unused symbols, is refused.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    more = ", ids array<int>, starts array<long>, ends array<long>, decoded string" if with_pieces else ""
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return source.mapInArrow(_encoder(key, text, path, with_pieces), schema + more)


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded_text``: the text of a list of ids; NULL for NULL, or if an id is unknown."""

    def decode(batches):
        m = model(path)
        for batch in batches:
            out = []
            for numbers in batch.column(ids).to_pylist():
                fine = numbers is not None and all(i is not None and 0 <= i < len(m.pieces) for i in numbers)
                out.append(m.decode(numbers) if fine else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded_text"]
            )

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded_text", T.StringType())])
    return encoded.mapInArrow(decode, schema)
