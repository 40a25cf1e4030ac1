"""The operators against plain Python over small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from voxtally.llm import simhash as simhash_module
from voxtally.llm.bpe import bpe_decode, bpe_encode
from voxtally.llm.common import components
from voxtally.llm.exact import exact_duplicates
from voxtally.llm.packing import best_fit, pack_documents
from voxtally.llm.sharding import schedule, shard_by_bytes
from voxtally.llm.simhash import keep_one_of_each, simhash_components
from voxtally.llm.substrings import remove_repeats

SCHEMA = "doc_id long, text string, lang string, n long, bytes string, a int"


def table(spark, rows):
    """Rows of (doc_id, text) with more columns, some named as the operators' own are."""
    return spark.createDataFrame([(i, t, None, 1, "x", None) for i, t in rows], SCHEMA)


def random_texts(seed: int, n: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma.", "é", "漢字", "x", "the", "THE", "😀", "a-b", "İ"]
    gaps = [" ", "  ", "\n", "\t", "\x0b", " ", "\x1c", " "]

    def text(k):
        return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(k))

    base = [text(rng.randint(0, 120)) for _ in range(n // 3)]
    out: list[str | None] = [None, "", " ", "\n\t", "A", "a", "word", "two words", None, ""]
    while len(out) < n:
        kind, t = rng.randint(0, 5), rng.choice(base)
        if kind == 0:
            out.append(t)
        elif kind == 1:
            out.append(t.swapcase() if t.isascii() else t.replace("T", "t"))
        elif kind == 2:
            out.append(text(rng.randint(0, 60)) + t + text(rng.randint(0, 60)))
        elif kind == 3:
            out.append(t[: rng.randint(0, len(t))] + text(rng.randint(0, 80)))
        elif kind == 4:
            parts = t.split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            out.append(" ".join(parts))
        else:
            out.append(t + " tail" * rng.randint(0, 2))
    ids = rng.sample(range(-5, 10 * n), n)
    return list(zip(ids, out))


def got(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_exact_duplicates(spark):
    rows = random_texts(1, 300)
    long = "Long text. " * 9000
    rows += [(90_001, long), (90_002, long[:-1] + "!"), (90_003, long.upper()), (90_004, long[:5000] + "?" + long[5001:])]
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    found = got(exact_duplicates(table(spark, rows + [(None, "no key")])))
    assert len(found) == len(rows)
    for i, t in rows:
        body = (t or "").translate(LOWER)
        same = groups[body]
        assert found[i] == {
            "doc_id": i,
            "keep_id": max(same),
            "group_size": len(same),
            "kept": i == max(same),
            "text_sha256": hashlib.sha256(body.encode()).hexdigest(),
        }


def substring_reference(rows, length):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(split):
        for p in range(len(split[i]) - length + 1):
            first.setdefault(tuple(split[i][p : p + length]), i)
    out = {}
    for i, words in split.items():
        gone = set()
        for p in range(len(words) - length + 1):
            if first[tuple(words[p : p + length])] < i:
                gone.update(range(p, p + length))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("length,gram", [(50, 20), (12, 5), (3, 2)])
def test_substring_repeats(spark, length, gram):
    rows = random_texts(2, 240)
    rng = random.Random(5)
    filler = [f"w{k}" for k in range(400)]
    shared = [f"s{k}" for k in range(80)]
    for d in range(40):  # passages in changing surroundings, cut at changing places
        a = rng.randint(0, 20)
        words = rng.choices(filler, k=rng.randint(0, 70)) + shared[a : a + rng.randint(40, 60)] + rng.choices(filler, k=rng.randint(0, 70))
        rows.append((50_000 - d, " ".join(words)))
    rows += [(60_000 + d, "again " * 130) for d in range(3)]
    found = got(remove_repeats(table(spark, rows), length=length, gram=gram))
    want = substring_reference(rows, length)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in found.items()} == want
    assert sum(n for _, n, _ in want.values()) > 0


def test_substring_long_texts_in_parts(spark, monkeypatch):
    from voxtally.llm import substrings

    rng = random.Random(9)
    words = [f"w{rng.randint(0, 3000)}" for _ in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x"] * 7 + words[100:2500])), (3, " ".join(words[2000:2049]))]
    whole = substrings._parts
    # Plain function so that tasks see the small parts as well.
    import numpy as np

    n = np.array([3000])
    parts = list(whole(n, np.array([0, 3000]), 50, 1000))
    assert parts[0] == (0, 1, 0, 1000) and parts[1][2] == 951 and parts[-1][3] == 3000
    found = got(remove_repeats(table(spark, rows)))
    want = substring_reference(rows, 50)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in found.items()} == want


def fingerprint_reference(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_reference(links, ids):
    root = {i: i for i in ids}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {i: up(i) for i in ids}


def test_simhash(spark):
    rows = random_texts(3, 260)
    rng = random.Random(8)
    base = [f"word{k}" for k in rng.choices(range(500), k=400)]
    for d in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(400)] = f"new{d}"
        rows.append((70_000 + d, " ".join(words)))
    prints = {i: fingerprint_reference(t) for i, t in rows}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert any(prints[a] != prints[b] for a, b in links)
    roots = component_reference(links, ids)
    found = got(simhash_components(table(spark, rows)))
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in found.items()} == roots
    kept = keep_one_of_each(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))


def test_simhash_hot_segments(spark, monkeypatch):
    """Many fingerprints with one segment value: split variants give the same components."""
    import numpy as np

    rng = np.random.default_rng(4)
    low = rng.integers(0, 1 << 32, 3000, dtype=np.uint64)
    fps = np.unique(np.r_[(np.uint64(7) << np.uint64(32)) | low, (np.uint64(5) << np.uint64(32)) | (low[:500] ^ np.uint64(3))])
    near = fps[:200] ^ np.uint64(1 << 9)
    fps = np.unique(np.r_[fps, near])
    ids = list(range(len(fps)))
    forest = simhash_module._Forest(len(fps))
    distance = np.bitwise_count(fps[:, None] ^ fps[None, :])
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(distance <= 3)) if a < b]
    want = component_reference(links, ids)
    # All variants in one task, with long runs.
    for variant in range(64):
        half = fps >> np.uint64(32) if variant < 32 else fps & np.uint64(0xFFFFFFFF)
        masked = half & ~np.uint64(1 << (variant & 31))
        for value in np.unique(masked):
            at = np.flatnonzero(masked == value)
            if len(at) > 1:
                simhash_module._compare(fps, variant, forest, at)
    assert component_reference(forest.edges, ids) == want
    monkeypatch.setattr(simhash_module, "HOT_SEGMENT", 100)
    monkeypatch.setattr(simhash_module, "_fingerprinter", lambda key, text, size: _from_text(key, text))
    docs = table(spark, [(i, str(int(np.int64(np.uint64(f).view(np.int64))))) for i, f in zip(ids, fps)])
    found = got(simhash_components(docs))
    assert {i: r["component_id"] for i, r in found.items()} == want


def _from_text(key, text):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [int(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return run


def test_sharding(spark):
    rows = random_texts(4, 300) + [(80_000 + d, "same text in many rows") for d in range(90)]
    found = got(shard_by_bytes(table(spark, rows), 7))
    assert len(found) == len(rows)
    shard_of, slots, loads, sizes = {}, defaultdict(list), Counter(), Counter()
    for i, t in rows:
        r, data = found[i], (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(t or "", r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        sizes[t or ""] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # A loaded shard is above the mean by its last group at the most.
    assert max(loads.values()) <= sum(loads.values()) / 7 + max(sizes.values())
    plain = [0] * 7
    for size in sorted(sizes.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert max(loads.values()) <= max(plain) * 1.01


def test_schedule_rounds_equal_plain_heap():
    rng = random.Random(2)
    for _ in range(200):
        shards = rng.randint(1, 6)
        classes = [(s, n, s * n) for s, n in {rng.randint(1, 40): rng.randint(1, 60) for _ in range(8)}.items()]
        plan = {name: (users, upto) for name, users, upto in schedule(classes, shards)}
        loads, plain = [0] * shards, [0] * shards
        for s, n, _ in sorted(classes, reverse=True):
            users, upto = plan[s]
            assert upto[-1] == n
            for j, k in zip(users, [upto[0], *(b - a for a, b in zip(upto, upto[1:]))]):
                loads[j] += k * s
            for _ in range(n):
                plain[plain.index(min(plain))] += s
        assert sorted(loads) == sorted(plain)


def check_bins(lengths, placed, tokens, documents, cost):
    bins = defaultdict(list)
    for n, b in zip(lengths, placed):
        bins[b].append(n)
    for b in bins.values():
        assert sum(b) <= tokens and len(b) <= documents
        assert len(b) == 1 or sum(n * n for n in b) <= cost
    return len(bins)


def test_best_fit():
    rng = random.Random(6)
    for documents, cost in ((100, 10_000), (3, 10_000), (100, 3_000), (4, 2_500)):
        lengths = [rng.randint(1, 100) for _ in range(400)]
        n = check_bins(lengths, best_fit(lengths, 100, documents, cost), 100, documents, cost)
        assert n >= sum(lengths) / 100
        if documents == 100 and cost == 10_000:
            room = []  # plain best-fit decreasing, over all bins
            for x in sorted(lengths, reverse=True):
                at = min((k for k in range(len(room)) if room[k] >= x), key=lambda k: room[k], default=None)
                if at is None:
                    room.append(100 - x)
                else:
                    room[at] -= x
            assert n <= len(room)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = random_texts(7, 150) + [(95_000, "many words here, " * 900), (95_001, "x" * 3000), (95_002, "A <|endoftext|> b")]
    found = pack_documents(table(spark, rows), path, tokens=256).collect()
    pieces = defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == {i for i, _ in rows}
    sequences = defaultdict(list)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(range(0, len(ids), 256))
        for k, r in enumerate(mine):
            part = ids[256 * k : 256 * (k + 1)]
            data = b"".join(x.to_bytes(4, "little") for x in part)
            assert (r["piece"], r["length"], r["ids_crc32"]) == (k, len(part), zlib.crc32(data))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in found)
    assert len(sequences) <= total / 256 * 1.1 + 1


def test_bpe(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rng = random.Random(11)
    alphabet = "aaab  \n\t=--0123456789éüßña。漢字​\x1c\x85　😀ſK'sTheING"
    rows = random_texts(5, 80) + [
        (30_000 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))) for k in range(200)
    ]
    rows += [(40_000, "a" * 5000), (40_001, " " * 3000 + "x"), (40_002, "ab" * 4000), (40_003, "<|endoftext|>")]
    from voxtally.llm.bpe import Merges

    ranks = Merges(path, public_tokenizers.PATTERN).ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe_encode(table(spark, rows), path, public_tokenizers.PATTERN)
    found = got(bpe_decode(encoded, path, public_tokenizers.PATTERN))
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        r = found[i]
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), (t or "").encode())
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    unknown = spark.createDataFrame([([1, 99_999_999],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe_decode(unknown, path, public_tokenizers.PATTERN).collect()] == [None, None, b""]


def test_empty_tables(spark):
    empty = table(spark, [])
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    for df in (
        exact_duplicates(empty),
        remove_repeats(empty),
        simhash_components(empty),
        shard_by_bytes(empty, 3),
        pack_documents(empty, public_tokenizers.path("word_bpe_49k.json")),
        bpe_encode(empty, path, pattern),
    ):
        assert df.filter(F.lit(True)).count() == 0


# Components -------------------------------------------------------------------
def reachable(edges):
    """Smallest node reachable from each node that has an edge to another one."""
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out[start] = min(seen)
    return out


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(3, 3)],
        [(1, 2), (2, 1), (1, 2), (4, 4)],
        [(i, i + 1) for i in range(70)],
        [(0, i) for i in range(1, 40)] + [(99, i) for i in range(20, 60)],
        [((i * 37) % 90, (i * 53 + 11) % 90) for i in range(70)],
    ],
    ids=["empty", "loop", "repeats", "chain", "two hubs", "mixed"],
)
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted(reachable(edges).items())
