"""Operators learn from all they are given, not from a part of fixed size."""

import numpy as np

from wordweft.llm import bilinear_lm


def test_every_counted_cell_is_fitted():
    c = bilinear_lm.CLASSES
    at = np.arange(c)
    liked = (at * 5 + 3) % c
    table = bilinear_lm.train((c * (c + 1) + at) * c + liked, np.full(c, 3.0), steps=40, batch=1)
    # A context that never enters the fit keeps its class at about its share, 1 / CLASSES.
    assert (10.0 ** table[c, at, liked] > 1.5 / c).all()


def test_an_epoch_holds_every_count_once():
    rng = np.random.default_rng(1)
    counts = np.append(rng.integers(1, 9, 5000), [10**6, 10**5]).astype(float)
    got = np.zeros(len(counts))
    parts = list(bilinear_lm._dealt(counts, 75, rng))
    for i, m in parts:
        np.add.at(got, i, m)
    assert len(parts) == 75 and np.allclose(got, counts)
