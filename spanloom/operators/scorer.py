"""A convolutional scorer of every base, from the window about it, and per-sequence summaries.

The net is three convolutions, two poolings and two dense layers over a window of ``WINDOW`` bases with circular padding.
Since a window only moves by one base, the net runs once over the whole sequence with dilated kernels: after a pooling of
width p the taps lie p bases further apart.  Cost is in proportion to the sequence, not to the sequence times the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases in a window, poolings after the first and second convolution, and the rolling summary's width.
WINDOW, POOLS, ROLL = 101, (4, 3, 1), 50


class Net(NamedTuple):
    """Kernels (width, in, out) with biases, then dense weights (in, out) with biases."""

    convolutions: list[tuple[np.ndarray, np.ndarray]]
    dense: list[tuple[np.ndarray, np.ndarray]]

    def positions(self) -> int:
        """Places of the last convolution inside one window."""
        n = WINDOW
        for (kernel, _), pool in zip(self.convolutions, POOLS, strict=True):
            n = (n - len(kernel) + 1) // pool
        return n


def random_net(seed: int, channels: tuple[int, int, int] = (4, 8, 8), widths: tuple[int, int, int] = (6, 3, 3), hidden: int = 16) -> Net:
    rng, before, convolutions = np.random.default_rng(seed), 4, []
    for c, w in zip(channels, widths, strict=True):
        convolutions.append((rng.normal(0, 0.5, (w, before, c)), rng.normal(0, 0.1, c)))
        before = c
    flat = Net(convolutions, []).positions() * before
    return Net(convolutions, [(rng.normal(0, 0.3, (flat, hidden)), rng.normal(0, 0.1, hidden)), (rng.normal(0, 0.3, (hidden, 1)), rng.normal(0, 0.1, 1))])


def one_hot(seq: str) -> np.ndarray:
    """Rows of A, C, G, T; all zero for anything else."""
    return (np.frombuffer(seq.upper().encode("ascii", "replace"), np.uint8)[:, None] == np.frombuffer(b"ACGT", np.uint8)).astype(float)


def per_base(seq: str, net: Net) -> np.ndarray:
    """A probability for each base of a non-empty sequence."""
    half, n = WINDOW // 2, len(seq)
    tiled = seq * -(-half // n)
    x, step = one_hot(tiled[-half:] + seq + tiled[:half]), 1
    for (kernel, bias), pool in zip(net.convolutions, POOLS, strict=True):
        m = len(x) - (len(kernel) - 1) * step
        x = np.maximum(sum(x[k * step : k * step + m] @ kernel[k] for k in range(len(kernel))) + bias, 0)
        m = len(x) - (pool - 1) * step
        x = np.maximum.reduce([x[j * step : j * step + m] for j in range(pool)])
        step *= pool
    x = np.concatenate([x[j * step : j * step + n] for j in range(net.positions())], axis=1)
    (w1, b1), (w2, b2) = net.dense
    return 1 / (1 + np.exp(-(np.maximum(x @ w1 + b1, 0) @ w2 + b2)[:, 0]))


def summary(p: np.ndarray) -> tuple[float, float, float, float, float | None, int]:
    """mean, max, share over one half, best rolling mean, and mean and size of the core that no padding touches."""
    w, half, n = min(ROLL, len(p)), WINDOW // 2, len(p)
    total = np.r_[0, np.cumsum(p)]
    core = p[half : n - half] if n > WINDOW else p[:0]
    return float(p.mean()), float(p.max()), float((p > 0.5).mean()), float((total[w:] - total[:-w]).max() / w) if n >= ROLL else float(p.mean()), float(core.mean()) if len(core) else None, len(core)


def score_sequences(rows: DataFrame, key: str, seq: str, net: Net) -> DataFrame:
    """key and the summary of each sequence; nulls for a null or empty one."""
    held = rows.sparkSession.sparkContext.broadcast(net)
    names = ["mean", "max", "frac_gt50", "best50", "core_mean", "core_n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [summary(per_base(s, held.value)) if isinstance(s, str) and s else (None,) * 6 for s in frame["seq"]]
            out = pd.DataFrame(found, columns=names, dtype=object)
            yield pd.concat([frame[["id"]].reset_index(drop=True), out[names[:5]].astype("Float64"), out[["core_n"]].astype("Int64")], axis=1)

    kind = rows.schema[key].dataType.simpleString()
    chosen = rows.select(F.col(key).alias("id"), F.col(seq).alias("seq"))
    return chosen.mapInPandas(run, f"id {kind}, {', '.join(f'{n} double' for n in names[:5])}, core_n long").withColumnRenamed("id", key)
