"""Every character of a text can be read by a sample of its fingerprint."""

import numpy as np

from usagelens.llm import fingerprints as FP
from usagelens.llm.common import mix


def codes_of(text):
    return mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))


def test_walks_end_behind_the_last_character():
    rng = np.random.default_rng(3)
    size = np.sort(np.concatenate([rng.integers(1, FP.LONGEST + 1, 500), [1, 2, FP.LONGEST]]))[::-1].copy()
    codes, starts = mix(rng.integers(0, 2**32, int(size.sum()), dtype=np.uint64)), np.cumsum(size) - size
    reach = FP._reach(size)
    written, begins = FP._walks(codes, starts, size, reach)
    for c in range(0, len(size), 25):  # the same walk, one step after the other
        at, passed = 0, False
        for j in range(int(reach[c])):
            seen = (int(codes[starts[c] + at]) + j) * int(FP._STEP[j]) % 2**64
            assert written[begins[j] + c] == seen >> 60
            at += seen >> 40 & 1
            if at == size[c]:
                at, passed = 0, True
        assert passed


def test_text_behind_the_first_steps_counts():
    a = "ab" * 500
    for lo in (150, 400, 700, 900):
        b = a[:lo] + "cd" * 50 + a[lo + 100 :]
        assert all(len(FP._chunks(codes_of(x), np.array([0, len(x)]))) == 1 for x in (a, b))
        x, y = FP.digits_of([a, b])
        assert (x != y).any()


def test_likeness():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), int(n))) for n in rng.integers(2, 9, 4000)]
    a, other = " ".join(words[:1500]), " ".join(words[2000:3500])
    x, small, same, far = FP.digits_of([a, a[:3000] + "x" + a[3000:], a, other])
    assert (x == same).all()
    assert FP.likeness(x[None], small[None])[0] > 0.85
    assert FP.likeness(x[None], far[None])[0] < 0.3
    # A fingerprint does not depend on the texts beside it.
    assert (FP.digits_of([a])[0] == x).all() and (FP.digits_of(["", other])[1] == far).all() and not FP.digits_of([""]).any()
