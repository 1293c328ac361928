"""Removal of repeated byte strings by an enhanced suffix array over anchored contexts.

Two equal strings of `length` bytes have the same minimizer (least hash of their k-byte substrings,
the leftmost of equals) at the same offset. So the windows of a text fall into runs with a common
minimizer, the anchor, and only runs with equal anchors can hold equal windows. Anchors are counted
over the corpus first; for those that occur again, the run's bytes (its context) go to the partition
of the anchor's hash. There the contexts of one anchor are sorted by what follows the anchor: an
enhanced suffix array of the places where it occurs. A stack scan of the common-prefix lengths gives
the interval tree; in each interval the members are told apart by how far they agree to the left
(left-extension diversity), which gives the maximal repeats around the anchor with all occurrences,
and the windows that lie in one. Anchors that occur more than `hot` times are not gathered: their
windows are counted by 128-bit digests, spread over all partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.util import U64, chunked, encoded, key_partitions, mix, pack, serve, slices, unpack

LENGTH, GRAM, HOT, CHUNK_BYTES, PLACE_BITS = 200, 32, 20_000, 8 << 20, 24
LOWEST = -(1 << 63)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@dataclass
class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, for rolling hashes."""

    up: np.ndarray
    down: np.ndarray


_powers: dict[int, Powers] = {}


def powers(base: int, n: int) -> Powers:
    p = _powers.get(base)
    if p is None or len(p.up) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        p = Powers(np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 1 << 24:
            _powers[base] = p
    return p


def prefix_hash(buf: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(base, len(buf) + 1).up[: len(buf)], out=out[1:])
    return out


def window_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    return mix((s[end] - s[start]) * powers(base, len(s)).down[start])


def runs(raw: list[bytes], length: int, gram: int) -> Iterator[tuple]:
    """Per slice of texts: (buffer, its place, first window, last window, anchor, anchor's hash, prefix hashes) of the runs, as places in the buffer."""
    ends = np.cumsum([0] + [len(x) for x in raw])
    for a, b in slices(raw, 1 << 20):
        whole, size = b"".join(raw[a:b]), np.diff(ends[a : b + 1])
        if len(whole) <= 1 << PLACE_BITS:
            yield from runs_of(np.frombuffer(whole, np.uint8), int(ends[a]), size, length, gram)
            continue
        step = (1 << PLACE_BITS) - length + 1  # one very long text: by stretches that share no window
        for at in range(0, len(whole) - length + 1, step):
            part = np.frombuffer(whole, np.uint8, min(len(whole) - at, 1 << PLACE_BITS), at)
            yield from runs_of(part, int(ends[a]) + at, np.array([len(part)]), length, gram)


def runs_of(buf: np.ndarray, place: int, size: np.ndarray, length: int, gram: int) -> Iterator[tuple]:
    """runs() of the texts of one buffer. A window's minimizer is the leftmost of those whose hashes agree in the bits kept, which are the same everywhere: equal windows have equal anchors."""
    n = len(buf)
    if n >= length:
        s = prefix_hash(buf)
        m = n - gram + 1
        h = mix((s[gram:] - s[:m]) * powers(BASES[0], n + 1).down[:m])
        low = U64((1 << PLACE_BITS) - 1)
        v = h & ~low | np.arange(m, dtype=U64)
        span, width = 1, length - gram + 1
        while span * 2 <= width:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        if span < width:
            v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
        first = np.cumsum(size) - size
        inside = np.zeros(n + 1, np.int32)
        long = size >= length
        np.add.at(inside, first[long], 1)
        np.add.at(inside, (first + size - length + 1)[long], -1)
        start = np.flatnonzero(np.cumsum(inside[: len(v)]) > 0)
        if not len(start):
            return
        anchor = (v[start] & low).astype(np.int64)
        edge = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
        lo, hi = start[np.concatenate([[0], edge])], start[np.concatenate([edge - 1, [len(start) - 1]])]
        at = anchor[np.concatenate([[0], edge])]
        yield buf, place, lo, hi, at, mix(h[at]), s  # mixed again: minima crowd the low end


def make_chunk(rows: pd.DataFrame) -> list[tuple[int, bytes]]:
    raw = encoded(rows["text"])
    return [(0, pack(rows["doc_id"].to_numpy(np.int64), np.array([len(x) for x in raw], np.int64), b"".join(raw)))]


def texts_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    return tuple(unpack(blob))


def split(sizes: np.ndarray, body: bytes) -> list[bytes]:
    ends = np.cumsum(np.concatenate([[0], sizes]))
    return [body[a:b] for a, b in zip(ends, ends[1:])]


def bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(((keys >> U64(32)) * U64(parts)) >> U64(32), np.arange(parts + 1, dtype=U64))


# First round: which anchors occur again.


def ask_anchors(it, parts: int, length: int, gram: int):
    for pdf in it:
        for chunk, blob in zip(pdf["chunk"], pdf["blob"]):
            _, sizes, body = texts_of(blob)
            found = [r[5] for r in runs(split(sizes, body), length, gram)]
            keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)
            at = bounds(keys, parts)
            rows = [(i, chunk, pack(keys[a:b], n[a:b].astype(np.uint32))) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b]
            yield pd.DataFrame(rows, columns=["part", "chunk", "blob"])


def answer_anchors(pdf: pd.DataFrame, hot: int) -> pd.DataFrame:
    asks = [unpack(b) for b in pdf["blob"]]
    every, place = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
    total = np.bincount(place, np.concatenate([a[1] for a in asks]))
    state = ((total > 1).astype(np.uint8) + (total > hot)).astype(np.uint8)  # 0 once, 1 again, 2 hot
    ends = np.cumsum([0] + [len(a[0]) for a in asks])
    rows = [(p, c, pack(state[place[a:b]])) for p, c, a, b in zip(pdf["part"], pdf["chunk"], ends, ends[1:])]
    return pd.DataFrame(rows, columns=["part", "chunk", "blob"])


# Second round: the contexts of those anchors.


def hot_windows(body: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first digest, second digest, place) of the windows of the given runs, in digest order."""
    out = []
    for k in range(0, len(lo), 1000):  # neighbouring runs share a stretch of the text
        a, b = lo[k : k + 1000], hi[k : k + 1000]
        start, end = int(a.min()), int(b.max()) + length
        if end - start > 64 * (int((b - a + length).sum())):
            parts = list(zip(a.tolist(), b.tolist()))
        else:
            parts = [(start, end - length)]
        for x, y in parts:
            buf = np.frombuffer(body, np.uint8, y + length - x, x)
            own = (a >= x) & (b <= y)
            n = b[own] - a[own] + 1
            w = np.repeat(a[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((*(window_hash(prefix_hash(buf, base), w - x, w - x + length, base) for base in BASES), w))
    if not out:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)
    w1, w2, wp = (np.concatenate(x) for x in zip(*out))
    o = np.lexsort((w2, w1))
    return w1[o], w2[o], wp[o]


def ask_contexts(left: pd.DataFrame, right: pd.DataFrame, parts: int, length: int, gram: int) -> pd.DataFrame:
    rows: list = []
    if len(left) and len(right):
        _, sizes, body = texts_of(left["blob"].iloc[0])
        state = np.concatenate([unpack(b)[0] for b in right.sort_values("part")["blob"]])
        # of a slice only its runs are kept, not its hashes
        found = [tuple(np.asarray(x) for x in (r[2] + r[1], r[3] + r[1], r[4] + r[1], r[5])) for r in runs(split(sizes, body), length, gram)]
        lo, hi, at, h = (np.concatenate(x) for x in zip(*found))
        del found
        own = state[np.searchsorted(np.unique(h), h)]
        cold: dict[tuple, list] = {}  # (anchor's hash, offset, context) -> places
        k = np.flatnonzero(own == 1)
        for x, a, b, p in zip(h[k].tolist(), lo[k].tolist(), hi[k].tolist(), at[k].tolist()):
            cold.setdefault((x, p - a, body[a : b + length]), []).append(a)
        w1, w2, wp = hot_windows(body, lo[own == 2], hi[own == 2], length)
        order = sorted(cold)
        ck = np.array([x[0] for x in order], U64)
        cb, wb = bounds(ck, parts), bounds(w1, parts)
        for i in range(parts):
            own = order[cb[i] : cb[i + 1]]
            x, y = wb[i], wb[i + 1]
            if own or x < y:
                blob = pack(
                    ck[cb[i] : cb[i + 1]], np.array([e[1] for e in own], np.uint16), np.array([len(e[2]) for e in own], np.uint16), np.array([len(cold[e]) for e in own], np.uint32),
                    np.array([p for e in own for p in cold[e]], np.uint32), b"".join(e[2] for e in own), w1[x:y], w2[x:y], wp[x:y].astype(np.uint32),
                )
                rows.append((i, left["chunk"].iloc[0], blob))
    return pd.DataFrame(rows, columns=["part", "chunk", "blob"])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    return np.where((a != b).any(1), (a != b).argmax(1), a.shape[1])


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the lcp-intervals of at least that length, by a stack scan; lcp[i] is between suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []  # (length, first)
    for i, x in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > x:
            size, first = stack.pop()
            if size >= least:
                yield size, first, i
        if x and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def repeats_at_anchor(contexts: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes before the anchor, bytes from it on, members) of the maximal repeats of at least `length` bytes around an anchor.

    contexts: (offset of the anchor, bytes); all are different. A member may see more of a repeat
    than its own context holds: its bytes count up to its ends only.
    """
    if len(contexts) == 2:  # one interval
        (o, x), (p, y) = contexts
        a, b = (np.frombuffer(z, np.uint8) for z in (x, y))
        k = min(len(a) - o, len(b) - p)
        differ = np.flatnonzero(a[o : o + k] != b[p : p + k])
        after, k = int(differ[0]) if len(differ) else k, min(o, p)
        differ = np.flatnonzero(a[o - k : o] != b[p - k : p])
        before = k - 1 - int(differ[-1]) if len(differ) else k
        if before + after >= length:
            yield before, after, np.arange(2)
        return
    offs = np.array([o for o, _ in contexts])
    sizes = np.array([len(x) for _, x in contexts])
    n, right, left = len(contexts), int((sizes - offs).max()), int(offs.max())
    ra, la = np.zeros((n, right), np.uint8), np.zeros((n, max(1, left)), np.uint8)
    for i, (o, x) in enumerate(contexts):
        b = np.frombuffer(x, np.uint8)
        ra[i, : len(x) - o] = b[o:]
        la[i, :o] = b[:o][::-1]
    rsize = sizes - offs
    order = np.lexsort((rsize, np.unique(ra.view(f"V{right}")[:, 0], return_inverse=True)[1]))
    rs, sz = ra[order], rsize[order]
    lcp = np.minimum(common(rs[:-1], rs[1:]), np.minimum(sz[:-1], sz[1:]))
    for size, a, b in intervals(lcp, max(1, length - left)):
        members = order[a : b + 1]
        block = la[members]
        lo = np.lexsort((offs[members], np.unique(np.ascontiguousarray(block).view(f"V{block.shape[1]}")[:, 0], return_inverse=True)[1]))
        ls, lz = block[lo], offs[members][lo]
        llcp = np.minimum(common(ls[:-1], ls[1:]), np.minimum(lz[:-1], lz[1:]))
        if size >= length:  # the anchor onwards alone is a repeat of all members
            yield 0, size, members
        for before, x, y in intervals(llcp, max(1, length - size)):
            yield before, size, members[lo[x : y + 1]]


def answer_contexts(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Per chunk, the places of first and last windows that occur again."""
    asks = [unpack(b) for b in pdf["blob"]]
    seen: dict[tuple, int] = {}
    keys: list[int] = []
    contexts: list[tuple[int, bytes]] = []
    times: list[int] = []
    local: list[list[int]] = []
    for key, off, size, n, _, body, *_ in asks:
        at, own = 0, []
        for k, o, z, t in zip(key.tolist(), off.tolist(), size.tolist(), n.tolist()):
            x = body[at : at + z]
            at += z
            i = seen.setdefault((k, o, x), len(contexts))
            if i == len(contexts):
                keys.append(k)
                contexts.append((o, x))
                times.append(0)
            times[i] += t
            own.append(i)
        local.append(own)
    del seen
    spans: list[list[tuple[int, int]]] = [[(0, len(x) - length)] if t > 1 else [] for (_, x), t in zip(contexts, times)]
    karr = np.array(keys, U64)
    order = np.argsort(karr, kind="stable")
    edge = np.flatnonzero(np.diff(karr[order])) + 1
    for a, b in zip([0, *edge], [*edge, len(order)]):
        if b - a < 2:
            continue
        group = order[a:b]
        if all(times[i] > 1 for i in group):
            continue
        for before, after, members in repeats_at_anchor([contexts[i] for i in group], length):
            for m in members:
                i = group[m]
                if times[i] == 1:
                    o = contexts[i][0]
                    spans[i].append((o - before, o + after - length))
    # windows of hot anchors, by digest
    w1, w2 = (np.concatenate([a[k] for a in asks]) for k in (6, 7))
    o = np.lexsort((w2, w1))
    same = (w1[o][1:] == w1[o][:-1]) & (w2[o][1:] == w2[o][:-1])
    again = np.zeros(len(w1), bool)
    again[o[1:][same]] = True
    again[o[:-1][same]] = True
    rows, at = [], 0
    for part, chunk, own, (_, _, _, n, places, _, x1, _, wp) in zip(pdf["part"], pdf["chunk"], local, asks):
        first, last, p = [], [], 0
        for i, t in zip(own, n.tolist()):
            if spans[i]:
                where = places[p : p + t].astype(np.int64)
                for a, b in spans[i]:
                    first.append(where + a)
                    last.append(where + b)
            p += t
        hit = wp[again[at : at + len(x1)]].astype(np.int64)
        at += len(x1)
        first, last = (np.concatenate([*x, hit]) for x in (first, last))
        if len(first):
            rows.append((part, chunk, pack(first.astype(np.uint32), last.astype(np.uint32))))
    return pd.DataFrame(rows, columns=["part", "chunk", "blob"])


def digest(left: pd.DataFrame, right: pd.DataFrame, length: int) -> pd.DataFrame:
    rows = []
    for blob in left["blob"]:
        ids, sizes, body = texts_of(blob)
        cover = np.zeros(len(body) + 1, np.int32)
        for b in right["blob"]:
            first, last = unpack(b)
            np.add.at(cover, first, 1)
            np.add.at(cover, last.astype(np.int64) + length, -1)
        gone = np.cumsum(cover, dtype=np.int32)[: len(body)] > 0
        buf, ends = np.frombuffer(body, np.uint8), np.cumsum(np.concatenate([[0], sizes]))
        for d, a, b in zip(ids.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            g = gone[a:b]
            n = int(np.count_nonzero(g))
            kept = buf[a:b][~g].tobytes() if n else body[a:b]
            rows.append((d if d != LOWEST else None, b - a, n, int(g[:1].sum() + np.count_nonzero(g[1:] & ~g[:-1])) if n else 0, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its bytes, those covered by a string of `length` bytes that also starts elsewhere in the table, the maximal runs of these, and the SHA-256 of the rest.

    Matches lie within a document; overlaps count; all strings are judged on the input. Null text
    counts as empty; a text shorter than `length` keeps all. Rows that repeat, or share an id, are
    documents of their own. A null id is returned as null. Other columns are ignored; an empty table
    gives an empty table.
    """
    rows = "part int, chunk string, blob binary"
    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("doc_id"), F.col(text).alias("text"))
    chunks = chunked(slim, make_chunk, "text", chunk_bytes).select("chunk", "blob")
    parts = key_partitions(chunks)
    again = serve(chunks.mapInPandas(lambda it: ask_anchors(it, parts, length, gram), rows), lambda p: answer_anchors(p, hot), rows, parts)
    asks = chunks.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInPandas(lambda a, b: ask_contexts(a, b, parts, length, gram), rows)
    found = serve(asks, lambda p: answer_contexts(p, length), rows, parts)
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(lambda a, b: digest(a, b, length), SCHEMA)
