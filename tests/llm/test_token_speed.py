"""What op3 spares itself: words that are one run aren't searched, and ids' hashes are looked up."""

import gc

import numpy as np
import public_tokenizers

from lodestone.llm import token_store

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_word_of_letters_is_not_searched(monkeypatch):
    class None_:
        def __getattr__(self, name):
            raise AssertionError("searched")

    encoder = token_store.WordEncoder(PATH)
    words = ["river", "River", "RIVERSTONE", "q", "unbelievably"]
    whole = [np.array(encoder.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    mixed = "café x1y2 a-b don't <|x 中文 K"
    other = np.array(encoder.tokenizer.encode(mixed, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(mixed.encode()) == other
    monkeypatch.setattr(token_store, "PLAIN", None_())
    monkeypatch.setattr(token_store, "RUNS", None_())
    assert [encoder.encode(w.encode()) for w in words] == whole


def test_hashes_are_looked_up_and_chunks_stay(monkeypatch):
    rng = np.random.default_rng(1)
    for top in (1 << 16, 1 << 20):
        ids = rng.integers(0, top, 60_000).astype("<u4")
        h = token_store.mixed(ids)
        ends, last = [], 0
        rolled = [sum(int(h[i - k]) << k for k in range(32) if i >= k) % (1 << 64) for i in range(3000)]
        for end in [i + 1 for i in range(3000) if rolled[i] >> (64 - token_store.CHUNK_BITS) == 0]:
            if end - last >= token_store.MIN_CHUNK:
                ends.append(end)
                last = end
        assert [e for e in token_store.chunk_ends(ids) if e <= 3000] == ends
    assert token_store.chunk_ends(ids[:0]) == []
    monkeypatch.setattr(token_store, "mixed", None)
    token_store.mixed_small()
    assert token_store.chunk_ends(np.arange(100, dtype="<u4"))[-1] == 100


def test_the_collector_is_put_back():
    for wanted in (gc.enable, gc.disable):
        wanted()
        before = gc.isenabled()
        try:
            with token_store.no_collection():
                assert not gc.isenabled()
                raise ValueError
        except ValueError:
            pass
        assert gc.isenabled() == before
    gc.enable()
