"""What the driver holds while the toxicity machine is trained."""

import tracemalloc

import numpy as np

from graphloom.llm import toxicity


def test_newton_steps_copy_no_features():
    """Steps over blocks give the solution over all rows, and take far less than another copy of the features."""
    rng = np.random.default_rng(3)
    rows, positives = rng.normal(size=(20_000, 100)), 700
    rows[:positives] += 0.3
    blocks = [rows[low : low + 1000] for low in range(0, len(rows), 1000)]
    tracemalloc.start()
    w = toxicity._machine_weights(blocks, positives)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows.nbytes / 4
    x, y = np.column_stack([rows, np.ones(len(rows))]), np.where(np.arange(len(rows)) < positives, 1.0, -1.0)
    active = y * (x @ w) < 1
    cost = np.where(y > 0, 1 / positives, 1 / (len(x) - positives))[active, None]
    gradient = (x[active] * cost).T @ (x[active] @ w - y[active]) + toxicity.RIDGE * w
    assert np.abs(gradient).max() < 1e-6
