"""Padding where many pieces share a length."""

import random
from collections import Counter

import pytest

from gridair.llm import packing


def excess(histogram, size=2048):
    found = packing.patterns(histogram, size)
    placed = Counter()
    for count, lengths in found:
        assert count > 0 and sum(lengths) <= size
        for n in lengths:
            placed[n] += count
    assert placed == Counter(histogram)
    # Beside the least number of sequences: all tokens, or the pieces of which no two fit together.
    least = max(sum(n * k for n, k in histogram.items()) / size, sum(k for n, k in histogram.items() if 2 * n > size))
    return sum(c for c, _ in found) / least - 1


@pytest.mark.parametrize("length", [100, 150, 300, 700, 1100])
def test_a_third_of_rows_of_one_length(length):
    rnd = random.Random(1)
    lengths = Counter(min(2048, int(rnd.lognormvariate(5.8, 0.7)) + 5) for _ in range(20_000))
    lengths[length] += 10_000
    assert excess(dict(lengths)) < 0.02


def test_one_length_only():
    for length in (1, 2, 300, 683, 1024, 1025, 2047, 2048):
        for n in (1, 5, 6, 7, 10_000):
            assert len(packing.patterns({length: n})) <= 2
            assert sum(c for c, _ in packing.patterns({length: n})) == -(-n // (2048 // length))
            excess({length: n})
