"""Token ids of words, put together from remembered words, against the tokenizer itself."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from voxtally.llm import packing as module
from voxtally.llm.common import Recent
from voxtally.llm.packing import encoded

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"abcdefghij ABCé ÀÉ ß İı.,;:!? 0123\n\t漢😀ŉǰΐſﬁ", "́", "̀", ". ", ",", " The", " and", "'s ", "<|endoftext|>", "..", ",,"]


def test_ids_equal_the_tokenizer(monkeypatch):
    rng = random.Random(2)
    texts = ["İ.", "é́.", "THE, The. the", "..", ",", ".,", "Á.", "I. i, I"]
    texts += ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for limit in (module.MEMORY_BYTES, 3000):
        monkeypatch.setattr(module, "MEMORY_BYTES", limit)
        monkeypatch.setattr(module, "_WORDS", {})
        assert [np.frombuffer(x, np.uint32).tolist() for x in encoded(texts, PATH)] == want


def test_memory_keeps_what_is_asked_for_again():
    made = []

    def make(key):
        made.append(key)
        return key * 2

    known = Recent(make, 10 * (Recent.ENTRY_BYTES + 6))
    for k in range(100):
        assert known["ab"] == "abab" and known[f"{k:02}"] == f"{k:02}" * 2
        assert known.size <= known.limit and len(known) <= 10 and len(known.old) <= 10
    # The common key was made once, every rare one as well.
    assert len(made) == 101
