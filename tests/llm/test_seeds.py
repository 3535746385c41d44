"""Seeds of benchmark passages: every window that is accepted has one."""

import random
from itertools import combinations

import pytest

from corvane.llm import decontam


@pytest.mark.parametrize("size", range(5, 21))
def test_masks_cover_every_substitution_set(size):
    wrong, span = decontam.allowed(size, 0.8), decontam.span_for(size, 20, 0.8)
    read = [{k for k, bit in enumerate(m) if bit == "1"} for m in decontam.masks(span, wrong)]
    for bad in combinations(range(size), wrong):
        assert any(not places & set(bad) for places in read)


@pytest.mark.parametrize("size", [*range(5, 22), 40])
def test_passages_at_the_threshold_are_found(size):
    rng = random.Random(size)
    words = [f"t{k}" for k in range(size)]
    tests = decontam.index([(1, " ".join(words).encode())])
    window, wrong = min(size, 20), decontam.allowed(min(size, 20), 0.8)
    sets = list(combinations(range(window), wrong))
    for bad in sets if len(sets) <= 500 else rng.sample(sets, 500):
        start = rng.randrange(size - window + 1)
        passage = ["x" if k in bad else w for k, w in enumerate(words[start : start + window])]
        hits = decontam.find_hits(" ".join(["y"] * rng.randrange(3) + passage + ["y"] * rng.randrange(3)).encode(), tests)
        assert [h["matched"] for h in hits] == [window - wrong], bad
    # at the edges the words outside the text count as different
    for cut in (words[wrong:window], words[-window : size - wrong]):
        assert len(decontam.find_hits(" ".join(cut).encode(), tests)) == 1
    one_more = [w if k > wrong else "x" for k, w in enumerate(words[:window])]
    assert not decontam.find_hits(" ".join(one_more).encode(), tests)
