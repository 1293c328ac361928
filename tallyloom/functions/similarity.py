"""SimHash signatures and the Ratcliff-Obershelp ratio."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+")
JOINER = "␟"
SMALL = 1 << 14  # below this product of lengths the standard library is faster
SEED, SEED_PAIRS = 8, 1 << 20  # characters of a seed of common blocks; pairs of like seeds above which longer seeds are taken


def blake2b_64(x: str) -> bytes:
    return hashlib.blake2b(x.encode(), digest_size=8).digest()


def sha2_64(x: str) -> bytes:
    return hashlib.sha256(x.encode()).digest()[:8]


def features(norm: str) -> set[str]:
    """Distinct tokens and adjacent pairs of tokens."""
    words, pairs = features_apart(norm)
    return words | pairs


def features_apart(norm: str) -> tuple[set[str], set[str]]:
    t = TOKEN.findall(norm)
    return set(t), set(map(JOINER.join, zip(t, t[1:])))


_BYTES = 256 * np.arange(8)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def simhash(norms, digest: Callable[[str], bytes] = blake2b_64) -> list[int]:
    """Signed 64-bit signatures; a bit is set if at least half of the distinct features set it (so all are for a text without any)."""
    known: dict[str, bytes] = {}
    out = []
    for x in norms:
        words, pairs = features_apart(x)
        for f in words.difference(known):
            known[f] = digest(f)
        own = [*map(known.__getitem__, words), *map(digest, pairs)]  # most pairs are new: looking for them takes longer than hashing them again
        digests = np.frombuffer(b"".join(own), np.uint8).reshape(-1, 8)
        if len(known) > 100_000:
            known.clear()
        # bits are counted by the values of the eight bytes
        values = np.bincount((digests + _BYTES).ravel(), minlength=2048).reshape(8, 256)
        ones = (values @ _BITS).ravel()
        out.append(int(np.packbits(2 * ones >= len(own)).view(">i8")[0]))
    return out


def signature_of(norm: Column, digest: Callable[[str], bytes] = blake2b_64) -> Column:
    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(simhash(x, digest), dtype="int64")

    return run(norm)


def trigrams(x: str) -> np.ndarray:
    """Distinct code-point trigrams as sorted numbers; a shorter text is its own only one, an empty text has none."""
    c = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.array([-1 - int.from_bytes(c.astype("<u4").tobytes(), "little")], np.int64) if len(c) else c
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 0.0


def jaccard_of(first: Column, second: Column) -> Column:
    """Jaccard similarity of two texts' trigrams; a text that comes again within a batch is cut once."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}
        for t in (*x, *y):
            if t not in known:
                known[t] = trigrams(t)
        return pd.Series([jaccard(known[a], known[b]) for a, b in zip(x, y)], dtype="float64")

    return run(first, second)


def _prefix(codes: np.ndarray) -> np.ndarray:
    base = np.full(len(codes) + 1, 0x9E3779B97F4A7C15, np.uint64)
    base[0] = 1
    power = np.multiply.accumulate(base)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1], out=out[1:])
    return out


_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class LongestMatch:
    """Longest common block of stretches of two texts, earliest in the first, then in the second; by binary search over rolling hashes."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = a, b
        self.pa, self.pb = (_prefix(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)) for x in (a, b))
        down = np.full(max(len(a), len(b)) + 1, _INVERSE, np.uint64)
        down[0] = 1
        self.down = np.multiply.accumulate(down)

    def hashes(self, p: np.ndarray, lo: int, hi: int, size: int) -> np.ndarray:
        return (p[lo + size : hi + 1] - p[lo : hi + 1 - size]) * self.down[lo : hi + 1 - size]

    def find(self, alo: int, ahi: int, blo: int, bhi: int, most: int | None = None) -> tuple[int, int, int]:
        """most: a length that no common block exceeds, if one is known."""
        low, high = 0, min(ahi - alo, bhi - blo)
        if most is not None:
            high = min(high, most)
        while low < high:
            size = (low + high + 1) // 2
            if np.isin(self.hashes(self.pa, alo, ahi, size), self.hashes(self.pb, blo, bhi, size)).any():
                low = size
            else:
                high = size - 1
        if not low:
            return alo, blo, 0
        hb = self.hashes(self.pb, blo, bhi, low)
        ha = self.hashes(self.pa, alo, ahi, low)
        i = int(np.isin(ha, hb).argmax())
        return alo + i, blo + int((hb == ha[i]).argmax()), low

    def blocks(self) -> tuple[int, np.ndarray]:
        """(size, [starts in a, starts in b, lengths]) of all common blocks of at least `size` characters that can't be made longer.

        They come from pairs of like seeds, of which runs on a diagonal are blocks. Seeds are made longer while there are too many
        pairs; at the length of the shorter text, size is one more and there are no blocks.
        """
        n, m, size = len(self.a), len(self.b), SEED
        while size <= min(n, m):
            ha, hb = self.hashes(self.pa, 0, n, size), self.hashes(self.pb, 0, m, size)
            order = np.argsort(hb, kind="stable")
            hb = hb[order]
            first = np.searchsorted(hb, ha, "left")
            count = np.searchsorted(hb, ha, "right") - first
            pairs = int(count.sum())
            if pairs <= SEED_PAIRS:
                i = np.repeat(np.arange(len(ha)), count)
                j = order[np.arange(pairs) - np.repeat(np.cumsum(count) - count - first, count)]
                by = np.lexsort((i, j - i))
                i, j = i[by], j[by]
                new = np.ones(pairs, bool)
                new[1:] = (np.diff(j - i) != 0) | (np.diff(i) != 1)
                at = np.flatnonzero(new)
                return size, np.stack([i[at], j[at], np.diff(np.append(at, pairs)) + size - 1])
            size *= 2
        return min(n, m) + 1, np.zeros((3, 0), np.int64)


def by_difflib(a: str, b: str) -> int:
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def sequence_ratio(a: str, b: str) -> float:
    """2M/T of recursive longest matching blocks, as difflib without its junk heuristic; not symmetric."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    matched, stack, finder, size = 0, [(0, len(a), 0, len(b), None)], None, 0
    while stack:
        alo, ahi, blo, bhi, known = stack.pop()
        if alo == ahi or blo == bhi:
            continue
        if finder is None and (ahi - alo) * (bhi - blo) <= SMALL:
            matched += by_difflib(a[alo:ahi], b[blo:bhi])
            continue
        if finder is None:
            finder = LongestMatch(a, b)
            size, known = finder.blocks()
        # the long blocks, cut to this stretch: its longest common block is one of them, or shorter than all long ones
        at, to, length = known
        off = np.maximum(np.maximum(alo - at, blo - to), 0)
        length = np.minimum(np.minimum(length - off, ahi - at - off), bhi - to - off)
        near = length >= size
        at, to, length = at[near] + off[near], to[near] + off[near], length[near]
        if len(length):
            k = int(length.max())
            best = np.flatnonzero(length == k)
            best = best[np.lexsort((to[best], at[best]))[0]]
            i, j, known = int(at[best]), int(to[best]), np.stack([at, to, length])
        elif (ahi - alo) * (bhi - blo) <= SMALL:
            matched += by_difflib(a[alo:ahi], b[blo:bhi])
            continue
        else:
            i, j, k = finder.find(alo, ahi, blo, bhi, size - 1)
            known = np.zeros((3, 0), np.int64)
        if k:
            matched += k
            stack += [(alo, i, blo, j, known), (i + k, ahi, j + k, bhi, known)]
    return 2.0 * matched / total


def sequence_ratio_of(first: Column, second: Column, most: int | None = None) -> Column:
    """Null where either text is longer than `most`."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if most is not None and max(len(a), len(b)) > most else sequence_ratio(a, b) for a, b in zip(x, y)], dtype="float64")

    return run(first, second)
