"""The byte-level encoder works out each match of the pattern once, whatever units it stands in."""

import numpy as np
import public_tokenizers as P
import tiktoken

from lodestone.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_known_matches_in_new_units_cost_no_merging():
    bpe, done = byte_bpe.ByteBpe(PATH, P.PATTERN), []
    whole = bpe.matches.work
    bpe.matches.work = lambda piece: done.append(piece) or whole(piece)
    bpe.encode([" wordlyish. othering, wordlyish othering ! 12"])
    seen = len(done)
    assert bpe.encode([" wordlyish, othering."]) and len(done) == seen


def test_code_points_between_letters_digits_and_spaces():
    bpe = byte_bpe.ByteBpe(PATH, P.PATTERN)
    exact = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    texts = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}, {chr(c)}{chr(c)} x" for c in [*range(0x500), *range(0x2000, 0x2100), *range(0x10000, 0x10FFFF, 997)]]
    for text, ids in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(text)


def test_a_full_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_UNITS", 2)
    bpe = byte_bpe.ByteBpe(PATH, P.PATTERN)
    first = bpe.encode(["one two three four"])
    assert bpe.encode(["five"]) and len(bpe.memo) == 1 and bpe.memo.size < 50
    assert bpe.encode(["one two three four"]) == first
