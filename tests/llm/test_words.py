"""Hashes of words and runs, taken in pieces, against plain sums."""

import tracemalloc

import numpy as np

from quarrion.llm import words as W

M64 = (1 << 64) - 1


def plain(values, mult):
    total, power = 0, 1
    for v in values:
        total, power = (total + v * power) & M64, power * mult & M64
    return int(W.mix(np.array([total], dtype=np.uint64))[0])


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = [b"one two  three", b"", b"a" * 300 + b" b", "漢字 zwei".encode(), b" x " * 40]
    for hashed in (1, 7, 64, 1 << 16):
        monkeypatch.setattr(W, "HASHED", hashed)
        w = W.split(texts, W.BLANKS)
        for which in (0, 1):
            h = w.hashes(which)
            assert h.tolist() == [plain([x + 1 for x in w.raw[a:b]], W.WORD_MULT[which]) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
            for k in (1, 3, len(h)):
                assert W.run_hashes(h, k, which).tolist() == [plain(h[i : i + k].tolist(), W.RUN_MULT[which]) for i in range(len(h) - k + 1)]
    assert not len(W.split([], W.BLANKS).hashes()) and not len(W.run_hashes(h, len(h) + 1))


def test_hashing_holds_little_beside_the_text():
    w = W.split([b"word and more " * 150_000], W.BLANKS)
    W._powers.cache_clear()
    tracemalloc.start()
    h = w.hashes()
    W.run_hashes(h, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24_000_000  # two rows of 450 000 hashes, and tables and pieces of fixed size
