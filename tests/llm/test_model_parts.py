"""What the trained operators compute, step by step, and how they do on rows they have not seen."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxtally.llm import resampling, secrets
from voxtally.llm.common import text_bytes

FOLDER = "/root/testdata/sf0.1"
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+")


def shape(word: bytes) -> tuple:
    first = word[:1]
    if not (first.isalnum() or first[0] >= 0x80):
        return "mark", first, min(len(word), 3)
    upper = sum(0x41 <= c <= 0x5A for c in word)
    case = 0 if not upper else 1 if upper == len(word) else 2 if upper == 1 else 3
    return case, min(sum(0x30 <= c <= 0x39 for c in word), 3), min(len(word) // 3, 7)


def plain_grams(text: str | None) -> list[tuple]:
    """Words, pairs of words, and triples of shapes with repetitions, one after another."""
    words = TOKEN.findall((text or "").encode())
    lower = [bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in w) for w in words]
    shapes = []
    for i, w in enumerate(words):
        again = sum(lower[i] == lower[i - lag] for lag in (1, 2, 3, 4) if lag <= i)
        shapes.append((*shape(w), again))
    one = [("one", w) for w in lower]
    pair = [("pair", *p) for p in zip(lower, lower[1:])]
    return one + pair + [("three", *t) for t in zip(shapes, shapes[1:], shapes[2:])]


TEXTS = [
    None, "", " \n", "Word", "A b C d e", "!!! What ??? 12345 ÄÖ ü a-b", "the the the The THE cat the", "x" * 40 + " y",
    "MIXed Case1 2 33 444 5555", "漢字 kana, kana. kana; kana", "a.b.c.d\te\x0bf",
]


def buckets_of(texts):
    bucket, upto = resampling.grams(*text_bytes(pa.array(texts, pa.string())))
    return [bucket[a:b].tolist() for a, b in zip(upto, upto[1:])]


def test_grams_equal_plain_python():
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "1", "22", "x9", "!", "??", "é", "...", "beta"]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(200)]
    named: dict[tuple, int] = {}
    for text, buckets in zip(texts, buckets_of(texts)):
        grams = plain_grams(text)
        assert len(grams) == len(buckets)
        for gram, bucket in zip(grams, buckets):
            # A gram has one bucket, wherever it stands.
            assert named.setdefault(gram, bucket) == bucket
    # Different grams share a bucket about as seldom as chance has it.
    assert len(set(named.values())) > len(named) * (1 - len(named) / resampling.BUCKETS)


def test_weights_equal_plain_python(spark):
    rng = random.Random(5)
    good, bad = ["tree", "river", "stone", "cloud"], ["BUY", "now", "!!!", "cheap"]
    rows = [(i, " ".join(rng.choices(good if i % 3 else bad, k=rng.randint(1, 30)))) for i in range(120)] + [(500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)] + [(7, None)], "doc_id long, quality int")
    model, table = resampling.fit_resampler(docs, labels, seed=11)
    held = labels.select("doc_id", (F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(3)) == 0).alias("held"))
    held = {r["doc_id"] for r in held.collect() if r["held"]}
    of = dict(zip([i for i, _ in rows], buckets_of([t for _, t in rows])))
    raw = Counter(b for buckets in of.values() for b in buckets)
    target = Counter(b for i in range(0, 120, 2) if i % 3 and i not in held for b in of[i])
    n_raw, n_target = sum(raw.values()) + resampling.BUCKETS, sum(target.values()) + resampling.BUCKETS
    weight = lambda b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw)
    for r in table.collect():
        want = sum(round(weight(b) * resampling.UNIT) for b in of[r["doc_id"]])
        assert abs(r["weight"] - want) <= len(of[r["doc_id"]])
    assert model.weights.shape == (resampling.BUCKETS,)


def test_documents_with_labels_that_were_not_shown(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    shown = F.pmod(F.xxhash64(F.lit(99), "doc_id"), F.lit(2)) == 0
    kept = {r["doc_id"] for r in resampling.resample(docs, labels.filter(shown)).select("doc_id").collect()}
    rows = labels.filter(~shown).select("doc_id", "quality").collect()
    good = np.mean([r["doc_id"] in kept for r in rows if r["quality"] == 1])
    bad = np.mean([r["doc_id"] in kept for r in rows if r["quality"] == 0])
    assert good > 0.98 and bad < 0.2, (good, bad)


WIDE = string.ascii_letters + string.digits

# Shapes that the training values are not made of (the last two are close to some), and the
# share of them that is to be found. Hex in groups of 8, 4, 4, 4 and 12 is that of plain ids.
SHAPES = {
    "prefix and base 62": (0.8, lambda r: "AIza" + "".join(r.choices(WIDE + "_-", k=35))),
    "dotted": (0.8, lambda r: "SG." + "".join(r.choices(WIDE, k=22)) + "." + "".join(r.choices(WIDE, k=43))),
    "base 32": (0.8, lambda r: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=52))),
    "long prefix": (0.8, lambda r: "glpat-" + "".join(r.choices(WIDE, k=20))),
    "small letters and digits": (0.4, lambda r: "".join(r.choices(string.ascii_lowercase + string.digits, k=32))),
}


@pytest.fixture(scope="module")
def network(spark):
    return secrets.fit_network(spark.read.parquet(f"{FOLDER}/documents.parquet"))


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_recall_on_shapes_that_were_not_made(network, name):
    rng, (share, make) = random.Random(name), SHAPES[name]
    found = asked = 0
    for _ in range(200):
        text = f"please use {make(rng)} for the service"
        for a, b in secrets.candidates(text, secrets.base_spans(text)):
            asked += 1
            row = (text[max(0, a - secrets.CONTEXT) : a], text[a:b], text[b : b + secrets.CONTEXT])
            found += secrets.scores(network, [row])[0] >= network.threshold
    # Values that a base pattern takes are not asked about.
    assert asked >= 150 and found >= share * asked, (found, asked)


def test_ordinary_runs_of_other_documents_stay(spark, network):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id > 5000").limit(1500)
    texts = [r["text"] or "" for r in docs.collect()]
    rows = []
    for t in texts:
        for a, b in secrets.candidates(t, secrets.base_spans(t)):
            rows.append((t[max(0, a - secrets.CONTEXT) : a], t[a:b], t[b : b + secrets.CONTEXT]))
    assert rows and (secrets.scores(network, rows) >= network.threshold).mean() < 0.05


def test_a_very_long_value_is_read_in_pieces(network, monkeypatch):
    sizes = []
    original = secrets._windows
    monkeypatch.setattr(secrets, "_windows", lambda net, codes, parts: sizes.append(codes.size) or original(net, codes, parts))
    rng = random.Random(1)
    value = "".join(rng.choices(WIDE, k=300_000))
    assert secrets.scores(network, [("", value, "")])[0] >= network.threshold
    assert max(sizes) <= 2 * secrets.READ_AT_ONCE
