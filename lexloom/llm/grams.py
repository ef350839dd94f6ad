"""Hashed byte n-grams of whole texts as normalised vectors, and bounded samples of them for fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: ASCII letters to lower case, other ASCII to spaces; bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def counts(raw: bytes, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Numbers of n-grams of the given sizes by hashed slot."""
    total = np.zeros(1 << bits, dtype=np.float32)
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, max(sizes) + 1):
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :] + np.uint32(1)
        if n in sizes:
            slot = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
            total += np.bincount(slot, minlength=1 << bits)
    return total


def letters(text: str, sizes: tuple[int, ...] = (2, 3, 4), bits: int = 12) -> np.ndarray:
    """The text's letters without case: square roots of counts, length 1."""
    x = np.sqrt(counts(b" " + text.lower().encode().translate(LETTERS) + b" ", sizes, bits))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def gathered(rows: DataFrame, features: Callable[[str], np.ndarray], label: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a bounded sample, for a fit on the driver; the features are made by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "").astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.binary())], names=["label", "x"])

    kind = rows.schema[label].dataType.simpleString()
    got = rows.selectExpr("text", f"{label} AS label").mapInArrow(run, f"label {kind}, x binary").toArrow()
    x = [np.frombuffer(b, np.float16) for b in got.column("x").to_pylist()]
    labels = np.array(got.column("label").to_pylist(), dtype=object)
    # The order of rows depends on the order of tasks; a fit must not.
    order = sorted(range(len(x)), key=lambda k: (str(labels[k]), x[k].tobytes()))
    return np.array([x[k] for k in order], dtype=np.float32).reshape(len(x), len(x[0]) if x else 0), labels[order]


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a m + b))) fits y (0 or 1), by Newton steps with Platt's softened targets."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.std(margin)) or 1.0
    m = np.stack([margin / scale, np.ones_like(margin)], axis=1).astype(np.float64)
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), m.T @ (p - t))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
