"""Piece encoding against the sentencepiece library, with models of other character maps."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_corpus import random_texts, table

from voxtally.llm import pieces as module
from voxtally.llm.pieces import Model, decode_pieces, encode_pieces, unfolded

PATH = public_tokenizers.path("piece_bpe_32k.model")
RULES = {
    "ﬁ": "fi", "①": "1", "é": "é", "\n": " ", " ": " ", "\t": " ", "㍻": "平成", "ab": "X", "abc": "yz ", "Z": "",
    "e": "e", "ẞ": "ss", "--": " - ", "…": "...",
}


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def compiled(rules):
    """A double-array trie over the keys, and the texts they point to."""
    texts, tree = bytearray(), {}
    for key, value in rules.items():
        node = tree
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[0] = len(texts)
        texts += value.encode() + b"\0"
    # Every node has a base of its own: only then does a label tell whose child a unit is.
    units, used, bases, todo = {0: 0}, {0}, set(), [(0, 0, tree)]
    while todo:
        at, label, node = todo.pop(0)
        base = next(b for b in range(1, 1 << 20) if b not in bases and all(b ^ c not in used for c in node))
        bases.add(base)
        units[at] = (at ^ base) << 10 | (0 in node) << 8 | label
        for c in node:
            used.add(base ^ c)
            if c == 0:
                units[base] = node[0] | 1 << 31
            else:
                todo.append((base ^ c, c, node[c]))
    size = -(-(max(units) + 256) // 256) * 256
    trie = struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size)))
    return struct.pack("<I", len(trie)) + trie + bytes(texts)


def with_map(tmp_path, rules, prefix, squeeze):
    """The public model with another character map."""
    with open(PATH, "rb") as f:
        data = f.read()
    out = bytearray()
    for number, value in module._fields(data):
        if number != 3:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    charmap = compiled(rules)
    spec = b"\x0a\x03own\x12" + varint(len(charmap)) + charmap + b"\x18" + varint(prefix) + b"\x20" + varint(squeeze)
    out += b"\x1a" + varint(len(spec)) + spec
    path = tmp_path / f"own-{prefix}-{squeeze}.model"
    path.write_bytes(out)
    return str(path)


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = [*"abcdeio nst", "  ", " " * 7, " " * 15, " " * 40, "\n", "\t", "▁", "é", "漢字", "😀", "ﬁ", "①", "İ", "é"]
    parts += ["<s>", "</s>", "<unk>", "<0x0A>", "\0", "\r\n", " the", " and", "ing", " ", "㍻", "abc", "ab", "Z", "--"]
    fixed = ["", " ", "  ", "▁", "\n", " a", "a ", "Z", "ZZ", "</s>", "a" * 500, " " * 130, " ", "abc", "ẞ…", "x--y"]
    return fixed + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(n)]


def encoded(m, text):
    norm, alignment = m.normalised(text)
    entries = [m.entries([w])[0] for w in m.cut(norm)]
    ids = [int(i) for e in entries for i in e[0].split(" ")]
    sizes = np.frombuffer(b"".join(e[1] for e in entries), np.int32).astype(np.int64)
    if alignment is None:
        return ids, [], []
    upto = np.cumsum(sizes)
    return ids, alignment.source(upto - sizes).tolist(), alignment.source(upto).tolist()


@pytest.mark.parametrize(
    "rules, prefix, squeeze", [(None, 1, 0), (RULES, 1, 0), (RULES, 0, 0), (RULES, 1, 1), (RULES, 0, 1)]
)
def test_same_pieces_and_spans_as_the_library(tmp_path, rules, prefix, squeeze):
    path = PATH if rules is None else with_map(tmp_path, rules, prefix, squeeze)
    library, m = sentencepiece.SentencePieceProcessor(model_file=path), Model(path)
    for text in odd_texts(7, 1500):
        # The small trie above has free units that a zero byte would be looked up in.
        text = text if rules is None else text.replace("\0", "0")
        ids, starts, ends = encoded(m, text)
        proto = library.encode(text, return_type="proto")
        assert ids == [p.id for p in proto.pieces], text
        assert (starts, ends) == ([p.begin for p in proto.pieces], [p.end for p in proto.pieces]), text
        assert m.decode([*ids, m.end]) == library.decode([*ids, m.end]), text


def test_character_map_is_unfolded():
    assert unfolded(compiled(RULES)) == RULES
    assert unfolded(b"") == {}


def test_decoding_any_ids():
    library, m = sentencepiece.SentencePieceProcessor(model_file=PATH), Model(PATH)
    rng = random.Random(3)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3, 259), 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        assert m.decode(ids) == library.decode(ids), ids


def test_encode_pieces(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = random_texts(9, 150) + [(5000 + k, t) for k, t in enumerate(odd_texts(2, 60))]
    rows += [(1, "again"), (1, "again"), (None, "no key"), (8000, "long word " + "x" * 30_000), (8001, "word " * 20_000)]
    encoded = encode_pieces(table(spark, rows), PATH)
    out = decode_pieces(encoded, PATH).collect()
    assert len(out) == len(rows)
    by_key = {}
    for r in out:
        by_key.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        text = text or ""
        want = library.encode(text, add_eos=True)
        for r in by_key[i] if i is not None else []:
            assert r["ids"] == want and r["n_tokens"] == len(want)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            shown = library.decode(want)
            assert r["decoded"] == r["decoded_text"] == shown
            assert r["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
            # Pieces cover the text without a gap.
            edges = [0, *r["ends"]]
            assert r["starts"] == edges[:-1] and edges[-1] == len(text.encode())
    assert encode_pieces(table(spark, []), PATH).count() == 0


def test_memory_is_bounded_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(module, "MEMORY_BYTES", 2000)
    library, m = sentencepiece.SentencePieceProcessor(model_file=PATH), Model(PATH)
    for text in odd_texts(11, 300):
        assert encoded(m, text)[0] == library.encode(text)
        assert m.known.size <= 2000 or len(m.known) <= 1
