"""Periodic runs against a search of every period in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from test_corpus import got, random_texts, table

from voxtally.llm.queries import op11_periodic_runs, with_periodic_tails
from voxtally.llm.runs import find_runs, periodic_runs

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_run(words, shortest=24, times=3):
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)
    out = []
    for q in range(1, len(w) // times + 1):
        same = np.r_[False, w[:-q] == w[q:], False].view(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            part = w[a : b + q]
            if len(part) < max(shortest, times * q):
                continue
            if not any(np.array_equal(part[:-r], part[r:]) for r in range(1, q)):
                out.append((a, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(rng, longest):
    letters = rng.choice([1, 2, 3, 50])
    draw = lambda n: [rng.randrange(letters + 1) for _ in range(n)]
    out = draw(rng.randint(0, 40))
    for _ in range(rng.randint(0, 5)):
        p = rng.randint(1, longest)
        root = draw(p)
        kind = rng.random()
        if kind < 0.3:
            root = [0] * rng.randint(0, p) + root[: max(1, p // 4)]
        elif kind < 0.6:
            root = (root[: rng.randint(1, 6)] * longest)[:p] + [rng.randrange(9)]
        n = 3 * len(root) + rng.randint(-2, 2) if rng.random() < 0.5 else rng.randint(len(root), 5 * len(root) + 3)
        out += (root * 8)[: max(n, 0)] + draw(rng.randint(0, 5))
    return (out * 4)[:900] if rng.random() < 0.1 else out


def test_every_run_is_found():
    rng = random.Random(4)
    for _ in range(25):
        docs = [repeating(rng, 70) for _ in range(20)]
        lengths = np.array([len(d) for d in docs])
        starts = np.cumsum(lengths + 1) - lengths - 1
        laid = np.concatenate([np.r_[np.array(d, np.int64), -1 - k] for k, d in enumerate(docs)])
        runs = find_runs(laid, starts, lengths)
        runs = runs[runs[:, 1] >= 24]
        doc = np.searchsorted(starts, runs[:, 0], "right") - 1
        for k, d in enumerate(docs):
            mine = sorted((int(s - starts[k]), int(n), int(q)) for s, n, q in runs[doc == k])
            assert mine == sorted(every_run(d)), d


def test_words_that_hash_badly():
    # Words of the Thue-Morse sequence collide under polynomial hashes modulo powers of two.
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    d = (morse[:1500] * 4)[:4700] + morse
    laid = np.r_[np.array(d, np.int64), -1]
    runs = find_runs(laid, np.array([0]), np.array([len(d)]))
    assert sorted(map(tuple, runs[runs[:, 1] >= 24].tolist())) == sorted(every_run(d))


def test_periodic_runs(spark):
    rng = random.Random(8)
    rows = random_texts(5, 60)
    rows += [(1000 + k, rng.choice([" ", "\n"]).join(f"w{x}" for x in repeating(rng, 40))) for k in range(60)]
    rows += [(2000, "same " * 30_000), (2001, " ".join(["x y z é"] * 4000)), (2002, "a " * 23), (2003, "a " * 24)]
    rows += [(2004, "ab " * 24 + "\x1c"), (2005, " ".join(f"u{k}" for k in range(3000)))]
    found = got(periodic_runs(table(spark, rows)))
    assert len(found) == len(rows)
    for i, text in rows:
        words = WORD.findall(text or "")
        want = every_run(words) if i not in (2000, 2001) else [(0, len(words), 1 if i == 2000 else 4)]
        assert [tuple(r) for r in found[i]["runs"]] == want, i
        assert found[i]["n_words"] == len(words)
        assert found[i]["collapsed_text"] == collapsed(words, want)


def test_periodic_runs_of_odd_rows(spark):
    assert periodic_runs(table(spark, [])).count() == 0
    rows = [(1, "a " * 30), (1, "a " * 30), (None, None), (None, "b " * 40), (2, None)]
    found = sorted((r["doc_id"] or 0, len(r["runs"])) for r in periodic_runs(table(spark, rows)).collect())
    assert found == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]


def test_query_over_whole_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    tailed = {r["doc_id"]: r["text"] for r in with_periodic_tails(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    found = got(op11_periodic_runs(spark, FOLDER))
    assert len(found) == len(docs)
    planted = 0
    for i, text in docs.items():
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            planted += 1
        assert WORD.findall(tailed[i] or "") == words
        runs = every_run(words)
        row = found[i]
        assert row["n_runs"] == len(runs)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        best = None
        for s, m, q in runs:
            if best is None or m * best[2] > best[1] * q:
                best = (s, m, q)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == want
    assert planted > 5
