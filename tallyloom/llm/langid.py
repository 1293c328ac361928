"""Language identification by nearest centroid.

A text is the TF-IDF vector of its hashed byte 1- to 3-grams (letters lower-cased, everything else a
blank), scaled to length one. Each language has several centroids, found by spherical k-means on a
bounded sample of labelled texts; a text gets the language of the centroid nearest by cosine, and is
rejected if that cosine lies far below what sample texts of its length reach against centroids that
they had no part in: a low quantile of those that got their own language, so that no outlier sets it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.util import bounded, crc_of_id, encoded, pack, slices, unpack

DIMS, PER_LANGUAGE, CENTROIDS, SLACK = 4096, 400, 4, 0.7
FOLDS, QUANTILE, LONG_CLASS = 4, 0.02, 12  # texts of 4 KB and more are one class of length: the longest are few
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[:128] = [i if 97 <= i <= 122 else 32 for i in range(128)]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row per centroid, of length one
    owner: np.ndarray  # index of each centroid's language
    floor: np.ndarray  # least accepted cosine by log2 of the number of bytes


def vectors(raw: list[bytes]) -> np.ndarray:
    """log(1 + count) of the hashed n-grams, a row per text; raw is lower-cased."""
    sizes = np.array([len(x) for x in raw])
    buf = _BLANK[np.frombuffer(b"".join(x + b"  " for x in raw), np.uint8)].astype(np.uint32)
    row = np.repeat(np.arange(len(raw), dtype=np.int64), sizes + 2)
    if len(buf) < 3:
        return np.zeros((len(raw), DIMS), np.float32)
    one, two, three = buf, buf[:-1] | buf[1:] << 8, buf[:-2] | buf[1:-1] << 8 | buf[2:] << 16
    total = np.zeros(len(raw) * DIMS, np.int64)
    for salt, gram in enumerate((one, two, three)):
        n = len(gram)
        keep = np.flatnonzero((row[:n] == row[len(buf) - n :]) & (gram != int("20" * (salt + 1), 16)))
        slot = ((gram[keep] + np.uint32(salt << 28)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        total += np.bincount(row[keep] * DIMS + slot, minlength=len(total))
    return np.log1p(total.reshape(len(raw), DIMS).astype(np.float32))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def lowered(texts) -> list[bytes]:
    return encoded([x.lower() if isinstance(x, str) else "" for x in texts])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centres of length one; they start at equal steps along the order of likeness to the mean, so that no outlier founds a cluster."""
    k = min(k, len(x))
    order = np.argsort(x @ x.mean(0), kind="stable")
    c = x[order[(np.arange(k) * 2 + 1) * len(x) // (2 * k)]]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = unit(np.array([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


def left_out(x: np.ndarray, lang: np.ndarray, good: np.ndarray, centroids: int) -> tuple[np.ndarray, np.ndarray]:
    """(cosine of the nearest centroid, whether that is of the text's language) by folds, each against centroids of the others; a fold without which a language has no text left is measured against all."""
    best, right = np.zeros(len(x)), np.zeros(len(x), bool)
    fold = np.arange(len(x)) % FOLDS
    for f in range(FOLDS):
        rest = good & (fold != f)
        if len(np.unique(lang[rest])) < len(np.unique(lang)):
            rest = good
        parts = [spherical_kmeans(x[rest & (lang == i)], centroids) for i in range(lang.max() + 1)]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        sim = x[fold == f] @ np.concatenate(parts).T
        best[fold == f], right[fold == f] = sim.max(1), owner[sim.argmax(1)] == lang[fold == f]
    return best, right & good


def fit_texts(texts: list[str], langs: list[str], centroids: int = CENTROIDS, slack: float = SLACK) -> Model:
    raw = lowered(texts)
    tf = np.concatenate([vectors(raw[a:b]) for a, b in slices(raw, rows=256)]) if raw else np.zeros((0, DIMS), np.float32)
    return fit_vectors(tf, np.array([len(r) for r in raw], np.int64), langs, centroids, slack)


def fit_vectors(tf: np.ndarray, size: np.ndarray, langs: list[str], centroids: int = CENTROIDS, slack: float = SLACK) -> Model:
    """Fit on vectors() of sample texts, with their numbers of bytes and languages."""
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))).astype(np.float32) + 1
    x, names = unit(tf * idf), sorted(set(langs))
    lang = np.array([names.index(y) for y in langs], int)
    if len(names) > 1:  # a sample text that is nearer to another language's mean is mislabelled or mixed: no centroid is drawn from it
        means = unit(np.array([x[lang == i].mean(0) for i in range(len(names))]))
        good = (x @ means.T).argmax(1) == lang
        good |= ~np.isin(lang, lang[good])
    else:
        good = np.ones(len(x), bool)
    parts = [spherical_kmeans(x[good & (lang == i)], centroids) for i in range(len(names))]
    c = np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32)
    owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    floor = np.full(40, 1.0)
    if len(x):
        best, right = left_out(x, lang, good, centroids)
        klass = np.minimum(np.log2(size + 1).astype(int), LONG_CLASS)
        for i in range(40):
            own = best[right & (klass == min(i, LONG_CLASS))]
            floor[i] = np.quantile(own, QUANTILE) if len(own) else 1.0
        floor = np.minimum.accumulate(floor[::-1])[::-1]  # a longer text never needs less
        floor[floor == 1.0] = floor[floor < 1.0].max(initial=0.0)
    return Model(names, idf, c.astype(np.float32), owner, slack * floor)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, text: str = "text", lang: str = "lang") -> Model:
    """Fit on about `per_language` distinct texts of each language, those with the lowest hashes; ids have no part in it.

    A row's text is turned into its vector where it lies; the vectors of the sample, which don't grow with the texts, are the
    only thing collected. Rows without text or language are left out; a text that repeats counts once in its language.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    h = F.pmod(F.xxhash64(F.lit(9), F.col("text")), F.lit(1 << 40))
    counts = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"))).collect()  # a row per language
    if not counts:
        return fit_texts([], [])
    share: Column = F.lit(0)
    for name, n in counts:
        share = F.when(F.col("lang") == name, F.lit(int(min(1.0, 1.25 * per_language / max(1, n)) * (1 << 40)))).otherwise(share)

    def run(it):
        for pdf in it:
            raw = lowered(pdf["text"])
            for a, b in slices(raw, rows=256):
                blobs = [pack(np.flatnonzero(v).astype("<u2"), v[v != 0]) for v in vectors(raw[a:b])]
                yield pd.DataFrame({"lang": pdf["lang"].iloc[a:b], "h": pdf["h"].iloc[a:b], "size": [len(r) for r in raw[a:b]], "blob": blobs})

    sample = bounded(known).withColumn("h", h).where(F.col("h") < share).dropDuplicates(["lang", "h"])
    rows = sample.mapInPandas(run, "lang string, h long, size long, blob binary").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    seen: dict[str, int] = {}
    kept = []
    for name, _, size, blob in rows:
        seen[name] = seen.get(name, 0) + 1
        if seen[name] <= per_language:
            kept.append((name, size, blob))
    tf = np.zeros((len(kept), DIMS), np.float32)
    for i, (_, _, blob) in enumerate(kept):
        slot, value = unpack(blob)
        tf[i, slot] = value
    return fit_vectors(tf, np.array([n for _, n, _ in kept], np.int64), [x for x, _, _ in kept], centroids)


def predict_texts(model: Model, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language or und, cosine of the nearest centroid, rejected) of each text."""
    texts = [x if isinstance(x, str) else "" for x in texts]
    raw = lowered(texts)
    best, owner = np.zeros(len(raw)), np.zeros(len(raw), int)
    if len(model.centroids):
        for a, b in slices(raw, rows=256):
            sim = unit(vectors(raw[a:b]) * model.idf) @ model.centroids.T
            best[a:b], owner[a:b] = sim.max(1), model.owner[sim.argmax(1)]
    letters = np.array([x.isalpha() or any(map(str.isalpha, x)) for x in texts], bool) & (len(model.centroids) > 0)
    best = np.clip(np.where(letters, best, 0.0), 0, 1)
    size = np.array([len(r) for r in raw], float)
    rejected = ~letters | (best < model.floor[np.minimum(np.log2(size + 1).astype(int), 39)])
    return [model.languages[o] if y else "und" for o, y in zip(owner, letters)], best, rejected


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected, from the text alone.

    Null text, and text without a letter: `und`, score 0, rejected. A text too far from every
    centroid keeps the nearest language and is rejected. Equal texts get equal results. Columns of
    docs keep their values; one named like a result column is replaced by it. With a model of no
    language every row is `und`. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # DIMS * centroids * languages floats

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(x: pd.Series) -> pd.DataFrame:
        a, b, c = predict_texts(held.value, x)
        return pd.DataFrame({"lang_pred": a, "score": b.astype(float), "rejected": c})

    out = bounded(docs).withColumn("__r", predict(F.col(text)))
    return out.withColumns({k: F.col(f"__r.{k}") for k in ("lang_pred", "score", "rejected")}).drop("__r")


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 4 == 2
