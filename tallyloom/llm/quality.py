"""Compression bands: zstandard ratios of the whole text and of its fixed chunks, with limits by length.

Every byte of every text lies in a chunk. A text shorter than a chunk is one chunk, with the limits of its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.util import bounded, encoded, slices, words

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"{COUNTS}, base_failed boolean, whole_ratio double, n_chunks long, low_chunks long, high_chunks long, kept boolean"


@dataclass(frozen=True)
class Bands:
    """Accepted ratio of compressed to plain bytes, (length below which it holds, least, most); prose needs more bytes of context to compress, so short texts get higher limits."""

    whole: tuple = ((128, 0.45, 2.0), (256, 0.40, 1.20), (512, 0.38, 0.92), (1024, 0.34, 0.80), (2048, 0.32, 0.72), (4096, 0.30, 0.68), (16384, 0.27, 0.62), (1 << 62, 0.24, 0.60))
    chunk: tuple = (0.28, 0.75)
    chunk_bytes: int = 2048
    bad_share: float = 0.34  # of the bytes, by chunks, beyond which the text is rejected
    level: int = 3

    def verdict(self, raw: bytes, z: zstandard.ZstdCompressor) -> tuple[float, int, int, int, bool]:
        n = len(raw)
        ratio = len(z.compress(raw)) / n if n else 0.0
        least, most = next((lo, hi) for top, lo, hi in self.whole if n < top)
        size = self.chunk_bytes
        if n < size:  # one chunk, with the limits of its length
            low, high = int(0 < n and ratio < least), int(ratio > most)
            return ratio, int(n > 0), low, high, bool(n and not low + high)
        spans = [(i, size) for i in range(0, n - size + 1, size)]
        if n % size:  # the last chunk is a full one up to the end, and weighs what it adds
            spans.append((n - size, n % size))
        parts = [(len(z.compress(raw[i : i + size])) / size, new) for i, new in spans]
        low, high = (sum(test(r) for r, _ in parts) for test in (lambda r: r < self.chunk[0], lambda r: r > self.chunk[1]))
        bad = sum(new for r, new in parts if not self.chunk[0] <= r <= self.chunk[1])
        return ratio, len(parts), low, high, least <= ratio <= most and bad <= self.bad_share * n


SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True


def base_counts(raw: list[bytes]) -> pd.DataFrame:
    """Words, code points in words, symbols, repeated lines and words in repeated 3-word windows of each text."""
    h, counts, chars = words(raw)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    upto = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    ends = np.cumsum([0] + [len(x) for x in raw])
    symbols = upto[ends[1:]] - upto[ends[:-1]]
    lines = []
    for x in raw:
        own = [y for y in x.split(b"\n") if y.strip(b" \t\n\x0b\x0c\r")]
        lines.append(len(own) - len(set(own)))
    repeats, at = np.zeros(len(raw), np.int64), 0
    for i, n in enumerate(counts):
        w = h[at : at + n]
        at += n
        if n >= 4:
            key = w[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (w[1:-1] + (w[:-2] >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (w[2:] * np.uint64(0x165667B19E3779F9) + (w[2:] >> np.uint64(29)))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            if same.any():
                hit = np.zeros(n, bool)
                for ends in (order[1:][same], order[:-1][same]):
                    for k in range(3):
                        hit[ends + k] = True
                repeats[i] = int(hit.sum())
    return pd.DataFrame({"n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeats})


def judge(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, the ratios and counts behind the verdict, and kept.

    Null and empty text: no words, base_failed, not kept. Equal texts get equal results. Columns of
    docs keep their values; one named like a result column is replaced by it. An empty table gives
    an empty table.
    """

    @F.pandas_udf(SCHEMA)
    def run(x: pd.Series) -> pd.DataFrame:
        raw, z = encoded(x), zstandard.ZstdCompressor(level=bands.level)
        out = pd.concat([base_counts(raw[a:b]) for a, b in slices(raw)], ignore_index=True) if raw else base_counts([])
        out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        v = pd.DataFrame([bands.verdict(r, z) for r in raw], columns=["whole_ratio", "n_chunks", "low_chunks", "high_chunks", "kept"])
        out = pd.concat([out, v], axis=1)
        out["kept"] = ~out["base_failed"] & out["kept"].astype(bool)
        return out

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return bounded(docs).withColumn("__r", run(F.col(text))).withColumns({k: F.col(f"__r.{k}") for k in names}).drop("__r")
