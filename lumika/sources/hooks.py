"""Models and pixel code are functions that a caller brings; these apply them to whole tables.

A hook is called once per worker to load its model and then with batches. `fake_encoder` and `fake_detector` are
deterministic stand-ins for tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encode = Callable[[list[bytes]], np.ndarray]
Detect = Callable[[bytes], list[dict]]


def normalise(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def encode_files(files: DataFrame, load: Callable[[], Encode], batch: int = 16) -> DataFrame:
    """(path, embedding): the unit vector of each file; null for a file the model can't read, which is not encoded at all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                raw = [bytes(c) if c is not None else b"" for c in part["content"]]
                good = [i for i, c in enumerate(raw) if c]
                out: list = [None] * len(raw)
                if good:
                    for i, v in zip(good, normalise(np.asarray(encode([raw[i] for i in good]), np.float32))):
                        out[i] = v if np.isfinite(v).all() else None
                yield pd.DataFrame({"path": part["path"].to_numpy(), "embedding": out})

    return files.select("path", "content").mapInPandas(run, "path string, embedding array<float>")


def detect_faces(files: DataFrame, load: Callable[[], Detect]) -> DataFrame:
    """(path, x, y, w, h, score, embedding): one row per face; a file that can't be read has none. Corners become sizes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                for face in detect(bytes(content)) if content else []:
                    x1, y1, x2, y2 = face["corners"]
                    rows.append((path, x1, y1, x2 - x1, y2 - y1, face["score"], face["embedding"]))
            yield pd.DataFrame(rows, columns=["path", "x", "y", "w", "h", "score", "embedding"])

    return files.select("path", "content").mapInPandas(run, "path string, x int, y int, w int, h int, score double, embedding array<float>")


def fake_vector(data: bytes, dim: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(data).digest()[:8], "little")
    return normalise(np.random.default_rng(seed).standard_normal((1, dim)))[0].astype(np.float32)


def fake_encoder(dim: int = 768) -> Encode:
    return lambda items: np.stack([fake_vector(c, dim) for c in items])


def perceptual_hash(gray: np.ndarray, size: int = 8, factor: int = 4) -> str:
    """64-bit hash of a grey picture: signs of the low frequencies against their median, as 16 hex digits."""
    n = size * factor
    # means of boxes; where a picture has fewer pixels than boxes, a box is one pixel
    edges = [np.linspace(0, size_, n + 1).astype(int) for size_ in gray.shape]
    total = np.add.reduceat(np.add.reduceat(gray.astype(np.float64), edges[0][:-1], axis=0), edges[1][:-1], axis=1)
    small = total / (np.maximum(np.diff(edges[0]), 1)[:, None] * np.maximum(np.diff(edges[1]), 1)[None, :])
    k = np.arange(n)
    cosine = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (cosine @ small @ cosine.T)[:size, :size]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"
