"""What Python workers hold: encoders of an earlier task go before the next task's work, and pairs of words are gathered a part at a time."""

import gc
import tracemalloc
import weakref
from collections import Counter

import numpy as np

from phaseloom.llm import toxicity
from phaseloom.llm.textscan import lean_worker
from phaseloom.llm.tokens import encoder, vocabulary


def test_kept_encoder_is_gone_before_the_next_task_works():
    kept = encoder(vocabulary())
    kept.packed(b"some words of a text")
    there = weakref.ref(kept)
    del kept
    gc.disable()
    try:
        with lean_worker():
            assert there() is None  # its caches refer to it, so clearing the cache alone would leave all of it
    finally:
        gc.enable()


def run_of(rng, words, n):
    pair = np.unique(rng.integers(0, words, n) << 32 | rng.integers(0, words + 1, n))
    return pair, *(rng.integers(0, 5, len(pair)).astype(np.uint32) for _ in range(2))


def test_pairs_of_several_runs_add_up():
    rng = np.random.default_rng(3)
    for words in (1, 2, 15, 16, 17, 40):
        runs = [run_of(rng, words, n) for n in (1, 30, 300)]
        sums = [Counter(), Counter()]
        for pair, *counts in runs:
            for total, c in zip(sums, counts, strict=True):
                total.update(dict(zip(pair.tolist(), c.tolist(), strict=True)))
        word, place, counts = toxicity._met(runs, words)
        found = (word.astype(np.int64) << 32 | place).tolist()
        assert found == sorted({p for r in runs for p in r[0].tolist()})
        for total, c in zip(sums, counts, strict=True):
            assert c.tolist() == [total[p] for p in found]


def test_pairs_are_sorted_a_part_at_a_time():
    rng = np.random.default_rng(4)
    runs = [run_of(rng, 50_000, 100_000) for _ in range(8)]
    n = sum(len(r[0]) for r in runs)
    tracemalloc.start()
    try:
        toxicity._met(runs, 50_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 * n  # 16 bytes a pair are the result; sorted whole it was over 40
