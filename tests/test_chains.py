"""Pages put in order by their tokens, against a walk along every chain."""

from __future__ import annotations

import random

from voxtally.operators import chains
from voxtally.operators.chains import linked_pages, page_numbers

SCHEMA = "video_id string, page_token string, next_token string, body string"


def walked(pages):
    """Numbers and states by following the predecessors of each page, one by one."""
    nodes, named = {}, {}
    for video, token, following, _ in pages:
        if video is None:
            continue
        key = (video, token or "")
        nodes.setdefault(key, set()).add(following or None)
    nodes = {k: min((n for n in v if n), default=None) for k, v in nodes.items()}
    for (video, token), following in nodes.items():
        if following:
            named.setdefault((video, following), set()).add(token)
    out = {}
    for video, token in nodes:
        at, n, seen = token, 0, set()
        while at != "" and (video, at) in named and at not in seen:
            seen.add(at)
            at, n = min(named[video, at]), n + 1
        loop = at in seen
        state = "LOOP" if loop else "LINKED" if at == "" else "BROKEN"
        out[video, token or None] = (None if loop else n, state)
    return {(v, t or None): x for (v, t), x in out.items()}


def table(spark, pages):
    return spark.createDataFrame(pages, SCHEMA)


def chain(video, n, first=None):
    tokens = [first, *(f"{video}-{k}" for k in range(1, n))]
    return [(video, t, tokens[k + 1] if k + 1 < n else None, f"body {k}") for k, t in enumerate(tokens)]


def numbers(df):
    return {(r["video_id"], r["page_token"]): (r["page"], r["page_state"]) for r in df.collect()}


def test_chains_of_every_kind(spark):
    rng = random.Random(3)
    pages = []
    for v in range(40):
        video, part = f"v{v}", chain(f"v{v}", rng.choice([1, 2, 3, 5, 8, 17]))
        kind = v % 5
        if kind == 1 and len(part) > 2:
            part.pop(rng.randrange(1, len(part)))  # a page never landed
        if kind == 2:
            part[-1] = (video, part[-1][1], rng.choice(part)[1], "closed")  # the last page names an earlier one
        if kind == 3:
            part += [rng.choice(part), (video, part[0][1], "", "again")]  # pages that landed twice
        if kind == 4:
            part += [(video, "x", "y", ""), (video, "y", "x", ""), (video, "z", "z", "")]
        pages += part
    pages += [(None, "t", "u", "no video"), ("empty", "", "", "")]
    rng.shuffle(pages)
    assert numbers(page_numbers(table(spark, pages))) == walked(pages)
    rows = linked_pages(table(spark, pages)).collect()
    assert len(rows) == len(pages)
    want = walked(pages)
    for r in rows:
        key = (r["video_id"], r["page_token"] or None)
        assert (r["page"], r["page_state"]) == (want[key] if r["video_id"] else (None, None))
    assert page_numbers(table(spark, [])).count() == linked_pages(table(spark, [])).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    original = chains.written
    monkeypatch.setattr(chains, "written", lambda df, purpose: rounds.append(purpose) or original(df, purpose))
    pages = chain("v", 1000)
    random.Random(1).shuffle(pages)
    found = numbers(page_numbers(table(spark, pages)))
    assert {t: n for (_, t), (n, _) in found.items()} == {None: 0, **{f"v-{k}": k for k in range(1, 1000)}}
    # One table of pages and one of pointers, then log2(1000) rounds and the one that finds the last.
    assert len(rounds) <= 2 + 11
