"""Trained operators, vectors, archives and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxtally.llm import resampling, secrets, vectors, warc

FOLDER = "/root/testdata/sf0.01"


def brute_spans(text):
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    )
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def random_secrets(n):
    rng = random.Random(1)
    bits = ["token", "secret", "=", ":", " ", '"', "'", "a", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef" * 3, "abc"]
    bits += ["ſecret", "toKen", "api_key", "apikey", "passwd", "é", ".", "-", "0123456789abcdef", "\n", "😀"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_base_spans():
    for text in random_secrets(5000):
        assert secrets.base_spans(text) == brute_spans(text)


def sample_texts(spark, n, skip=0):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id")
    return [r["text"] for r in docs.filter(F.col("doc_id") >= skip).limit(n).collect()]


@pytest.fixture(scope="module")
def network(spark):
    return secrets.train(*secrets.labelled_findings(sample_texts(spark, 500)), epochs=6)


def test_network_on_held_out_findings(spark, network):
    rows, labels = secrets.labelled_findings(sample_texts(spark, 300, 600), seed=99)
    p, labels = secrets.scores(network, rows), np.array(labels)
    assert (p[labels == 1] >= network.threshold).mean() > 0.85
    assert (p[labels == 0] >= network.threshold).mean() < 0.02


def test_long_values_are_scored_whole(network):
    rng = random.Random(3)
    value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(3000))
    one = secrets.scores(network, [("before it ", value, " after it")])[0]
    old = secrets.CHUNK
    try:
        secrets.CHUNK = 5000
        assert secrets.scores(network, [("before it ", value, " after it")])[0] == pytest.approx(one, abs=1e-5)
    finally:
        secrets.CHUNK = old


def test_scan_and_redact(spark, network):
    texts = [None, "", "nothing", *random_secrets(200), "see ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5" + " there"]
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = {r["doc_id"]: r for r in secrets.scan_secrets(docs, network).collect()}
    clean = {r["doc_id"]: r for r in secrets.redact_secrets(docs, network).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = found[i]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("model")] == (joined.split(",") if joined else [])
        if t is None:
            assert clean[i]["text"] is None
        else:
            assert brute_spans(clean[i]["text"].replace("[SECRET]", "\n")) == []
        assert clean[i]["spans"] == t
    assert "model" in found[len(texts) - 1]["spans"]


def test_training_without_both_labels():
    assert secrets.train([("a", "bcdefghijklmnopqrst", "c")] * 5, [0] * 5).threshold > 1
    assert secrets.train([("a", "", "c")] * 6, [1] * 6).threshold > 1


def labelled(spark, folder=FOLDER):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, spark.read.parquet(f"{folder}/labels.parquet")


def test_resampling_keeps_good_documents(spark):
    # The target model needs some thousand labelled rows to know the words of the language.
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    kept = {r["doc_id"] for r in resampling.resample(docs, labels).collect()}
    rows = labels.collect()
    good = [r["doc_id"] in kept for r in rows if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.05
    stage = resampling.keep_resampled(docs, labels)
    assert stage.schema == docs.schema
    assert {r["doc_id"] for r in stage.collect()} == kept


def test_resampling_draws_the_largest_keys(spark):
    docs, labels = labelled(spark)
    model, scored = resampling.fit_resampler(docs, labels)
    rows = scored.collect()
    k = sum(r["weight"] >= model.cutoff for r in rows)
    want = {r["doc_id"] for r in sorted(rows, key=lambda r: (-r["key"], r["doc_id"]))[:k]}
    assert {r["doc_id"] for r in resampling.resample(docs, labels).collect()} == want


def test_kth_key(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([-(1 << 62), -5, 0, 3, 3, 3, 1 << 61, rng.randint(-100, 100)])) for i in range(-50, 300)]
    scored = spark.createDataFrame(rows, "doc_id long, key long")
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 2, 40, 120, 200, 349, 350):
        key, last = resampling.kth_key(scored, k)
        assert {r[0] for r in rows if r[1] > key or (r[1] == key and r[0] <= last)} == {r[0] for r in ordered[:k]}


def test_resampling_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (3, "some words", None), (4, "x " * 20_000, ""), (None, "no key", "")],
        "doc_id long, text string, weight string",
    )
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (99, 0)], "doc_id long, quality int")
    for labels in (none, odd):
        assert {r["doc_id"] for r in resampling.resample(docs, labels).collect()} == {1, 2, 3, 4}
        assert resampling.keep_resampled(docs, labels).count() == 4
        assert resampling.resample(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("leaf", [64, 100_000])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, monkeypatch, leaf, kind):
    monkeypatch.setattr(vectors, "LEAF", leaf)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x[:60] = x[0] + 0.05 * rng.normal(size=(60, 16))
    for i in range(100, 200):
        x[i] = x[i - 1] + rng.normal(size=16) * 0.25
    x[300:320] = x[299]
    rows = [(i * 7, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    rows += [(10_000 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links int")
    found = {r["vec_id"]: r for r in vectors.linked_vectors(df).collect()}
    assert len(found) == len(rows)
    unit = np.array([r for _, r in rows[:900]], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(900)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 900).min(1))
        if (new == label).all():
            break
        label = new
    for i in range(900):
        assert (found[7 * i]["n_links"], found[7 * i]["component_id"]) == (near[i].sum(), 7 * label[i])
        assert found[7 * i]["kept"] == (label[i] == i)
    for i in range(6):
        assert (found[10_000 + i]["n_links"], found[10_000 + i]["component_id"]) == (0, 10_000 + i)
    assert found[10_007]["component_id"] == 10_006
    assert vectors.linked_vectors(df.limit(0)).count() == 0


def test_warc(spark):
    rng = random.Random(6)
    urls = [None, "", "http://a.example.com/x y?q=1#f", "https://www.b.org", "http://[bad", "ftp://c.net:21/z", "no scheme", "http://ü.de/é"]
    bodies = [None, "", "<p>same</p>", "<p>\r\n\r\nsplit</p>", "é漢😀", "x" * 300_000]
    rows = [(i, rng.choice(urls), rng.choice(bodies + [f"<p>{i}</p>"]), "x") for i in range(-20, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(5)
    for least in (0, 5):
        first = {}
        for i, _, h, _ in sorted(rows):
            first.setdefault(h or "", i)
        found = {r["page_id"]: r for r in warc.archived_pages(spark, pages, least_bytes=least).collect()}
        assert len(found) == len(rows)
        for i, _, h, _ in rows:
            data = (h or "").encode()
            refers = first[h or ""] if len(data) >= least and first[h or ""] != i else None
            kind = "response" if refers is None else "revisit"
            r = found[i]
            assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (
                len(data), warc.base32_sha1(data), kind, refers)
    assert warc.archived_pages(spark, pages.limit(0)).count() == 0


def test_warc_lookup_and_standard_reading(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "DIRECTORY_ENTRIES", 5)
    rows = [(i, f"http://h{i % 7}.example.com/p{i}", f"<p>{i}</p>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archive = warc.write_archive(pages, root=str(tmp_path / "w"), archive_bytes=5000, block_lines=10)
    assert archive.stride > 1 and len(archive.directory) <= 5
    wanted = spark.createDataFrame(
        [(5, rows[5][1]), (5, rows[5][1]), (6, "http://other/"), (299, rows[299][1]), (1, None), (None, "x")],
        "page_id long, url string",
    )
    places = warc.lookup(archive, wanted)
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_records(archive, places).collect()}
    assert got == {5: b"<p>5</p>", 299: b"<p>299</p>"}
    # Every archive is a run of gzip members that each hold one record.
    import gzip

    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert whole.count(b"WARC/1.1\r\n") == 300
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 3
    assert warc.search_key("http://www.Example.com:80/a?b=c#d") == "com,example,www)/a?b=c"


def test_pipeline_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == docs.columns and after.schema == docs.schema, name
        rows = after.collect()
        ids = [r["doc_id"] for r in rows]
        assert len(ids) == len(set(ids)), name
        if name == "exact dedup":
            last = {}
            for r in before.collect():
                body = r["text"].translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
                last[body] = max(last.get(body, -1), r["doc_id"])
            assert set(ids) == set(last.values())
        if name == "secret scans":
            assert len(ids) == before.count()
            for r in rows:
                assert brute_spans(r["text"].replace("[SECRET]", "\n")) == []
                assert r["n_chars"] == len(r["text"])
        before = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in before.collect()}


def test_pipeline_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, None), (3, "a b " * 40_000, None, "s", 1, ""), (4, "", "en", "s", 0, "x")]
    rows += [(None, "no key", None, None, None, None), (5, "token = abcdefgh", None, None, 16, "y")]
    for name, part in (("rows", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        ids = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
        # 1, 2 and 4 are equal; 5 may only go if its fingerprint is near another one.
        assert ids == ({3, 4, 5} if part else set())
