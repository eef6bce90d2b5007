"""Hashes of words and of runs of words."""

import random

import numpy as np
import pyarrow as pa

from kinspan.llm.words import chunk_of, span_hashes, window_hashes


def hashes(*texts):
    chunk = chunk_of(pa.array(texts))
    return chunk, span_hashes(chunk.buf, chunk.start, chunk.end)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_structured_words_do_not_collide():
    for n in (64, 1024, 2048, 4096):
        word = thue_morse(n)
        _, (a, b) = hashes(word, word.translate(str.maketrans("ab", "ba")))
        assert a != b
    _, found = hashes(*(c * n for c in "a\x00b" for n in range(1, 40)))
    assert len(set(found.tolist())) == 3 * 39


def test_structured_runs_do_not_collide():
    for n in (16, 32, 50):
        run = thue_morse(n)
        chunk, words = hashes(" ".join(run), " ".join(run.translate(str.maketrans("ab", "ba"))))
        _, (a, b) = window_hashes(words, chunk.ptr, n)
        assert a != b


def test_equal_words_and_runs_have_equal_hashes():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abé中\x00") for _ in range(rng.randint(1, 25))) for _ in range(40)]
    texts = [rng.choice(("", " ", "\t")) + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, ""]
    chunk, words = hashes(*texts)
    spelled = [w for t in texts for w in (t or "").split()]
    by_hash = {}
    for w, h in zip(spelled, words.tolist(), strict=True):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(spelled))
    for size in (1, 2, 3, 5, 25, 50):
        first, run = window_hashes(words, chunk.ptr, size)
        want = [i for a, b in zip(chunk.ptr, chunk.ptr[1:]) for i in range(a, b - size + 1)]
        assert first.tolist() == want
        seen = {}
        for i, h in zip(first.tolist(), run.tolist(), strict=True):
            assert seen.setdefault(h, tuple(spelled[i : i + size])) == tuple(spelled[i : i + size])
        assert len(seen) == len({tuple(spelled[i : i + size]) for i in first.tolist()})
    assert len(window_hashes(np.zeros(0, np.uint64), np.zeros(1, np.int64), 3)[0]) == 0
