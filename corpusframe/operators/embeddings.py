"""Embeddings of texts by an exchangeable encoder, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
DIMENSION = 384


def hashing_encoder(dimension: int = DIMENSION) -> Encoder:
    """Words and their pairs hashed to signed places, scaled to length 1; needs no model."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for row, text in enumerate(texts):
            w = re.findall(r"\w+", text.lower())
            for token in [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                out[row, (h >> 1) % dimension] += 1 if h & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode


def embedded(text: Column, make: Callable[[], Encoder] = hashing_encoder, batch: int = 64) -> Column:
    """array<float> of each text; the encoder is made once a worker task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for s in parts:
            texts = s.fillna("").tolist()
            found = [encode(texts[at : at + batch]) for at in range(0, len(texts), batch)]
            yield pd.Series(list(np.concatenate(found)) if found else [], dtype=object)

    return run(text)
