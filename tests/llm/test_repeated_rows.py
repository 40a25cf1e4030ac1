"""Rows that were delivered twice, and rows that share a key: as many rows out as in."""

from __future__ import annotations

import heapq
import random
import time
from collections import Counter

import pytest
from test_corpus import table

import corpus_pipeline
from voxtally.llm.exact import exact_duplicates, keep_one_of_equal
from voxtally.llm.secrets import fit_network
from voxtally.llm.sharding import schedule, shard_by_bytes
from voxtally.llm.simhash import keep_one_of_each, simhash_components
from voxtally.llm.substrings import remove_repeats
from voxtally.llm.vectors import linked_vectors
from voxtally.llm.warc import archived_pages

LONG = " ".join(f"w{k}" for k in range(80))
ROWS = [(1, LONG), (1, LONG), (2, LONG.upper()), (3, "short"), (3, "short"), (4, "own"), (4, "other"), (None, LONG)]


def test_exact_duplicates(spark):
    rows = exact_duplicates(table(spark, ROWS)).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 2, 2: 1, 3: 2, 4: 2}
    for r in rows:
        keep, size = {1: (2, 3), 2: (2, 3), 3: (3, 2), 4: (4, 1)}[r["doc_id"]]
        assert (r["keep_id"], r["group_size"]) == (keep, size)
    assert sorted(r["doc_id"] for r in rows if r["kept"]) == [2, 3, 4, 4]


@pytest.mark.parametrize("stage", [corpus_pipeline.exact, lambda s, d, f: keep_one_of_equal(d)])
def test_one_of_equal_rows_goes_on(spark, stage):
    docs = table(spark, ROWS)
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [
        (2, LONG.upper()), (3, "short"), (4, "other"), (4, "own"),
    ]


def test_near_stage_keeps_one_of_a_component(spark):
    near = LONG + " w80"
    rows = [(5, LONG), (5, LONG), (5, "quite another text about other things"), (7, LONG), (9, near)]
    components = {}
    for r in simhash_components(table(spark, rows)).collect():
        components.setdefault(r["doc_id"], []).append(r["component_id"])
    assert len(components[5]) == 3 and set(components[5]) == {5} and components[7] == [5]
    for stage in (corpus_pipeline.near, lambda s, d, f: keep_one_of_each(d)):
        kept = sorted((r["doc_id"], r["text"]) for r in stage(spark, table(spark, rows), "").collect())
        found = [x for x in kept if x[0] != 9]
        assert found == [(5, "quite another text about other things"), (5, LONG)]


def test_remove_repeats(spark):
    lead = " ".join(f"x{k}" for k in range(10))
    rows = [(1, LONG), (2, f"{lead} {LONG}"), (2, f"{lead} {LONG}"), (3, lead), (3, None), (3, "")]
    found = remove_repeats(table(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in found) == [
        (1, 80, 0), (2, 90, 80), (2, 90, 80), (3, 0, 0), (3, 0, 0), (3, 10, 0),
    ]


def test_archived_pages(spark):
    pages = [(1, "a.com", "x" * 50), (1, "a.com", "x" * 50), (2, "b.com", "y"), (2, "c.com", "z"), (3, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archived_pages(spark, df).collect())
    assert rows == [
        (1, 50, "response", None), (1, 50, "revisit", 1), (2, 1, "response", None), (2, 1, "response", None), (3, 0, "response", None),
    ]


def test_linked_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (3, [0.1, 1.0]), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in linked_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert found == [
        (1, 1, 1, False), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, False), (3, 1, 3, True), (4, 0, 4, False), (4, 0, 4, True),
    ]


def test_shards_of_repeated_rows(spark):
    rows = shard_by_bytes(table(spark, ROWS), 3).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 2, 2: 1, 3: 2, 4: 2}


def test_sample_of_the_network_is_bounded(spark):
    text = "password = hunter2hunter " + LONG
    net = fit_network(table(spark, [(1, text)] * 300 + [(2, text + " more"), (2, None)]), sample=2, stretch=200)
    assert net.threshold > 0


def test_schedule_equals_a_plain_heap():
    rng = random.Random(8)
    for _ in range(400):
        shards = rng.randint(1, 9)
        sizes = [rng.randint(16, rng.choice([40, 5000])) for _ in range(rng.randint(1, 10))]
        classes = [(k, n, n * s) for k, s in enumerate(sizes) for n in [rng.choice([1, 2, 30, 200])]]
        plan = {name: dict(zip(users, upto)) for name, users, upto in schedule(classes, shards)}
        heap = [(0.0, j) for j in range(shards)]
        for name, count, total in sorted(classes, key=lambda c: -c[2] / c[1]):
            taken = Counter()
            for _ in range(count):
                load, j = heap[0]
                heapq.heapreplace(heap, (load + total / count, j))
                taken[j] += 1
            upto, want = 0, {}
            for j in sorted(taken):
                upto += taken[j]
                want[j] = upto
            assert plan[name] == want


def test_schedule_next_to_a_hot_group_is_quick():
    start = time.perf_counter()
    [_, (_, users, upto)] = schedule([(0, 1, 10**12), (1, 10**9, 10**11)], 40)
    assert time.perf_counter() - start < 1
    assert len(users) == 39 and upto[-1] == 10**9
