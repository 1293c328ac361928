"""Each operator against a brute-force version and on awkward rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import fingerprint, langid, linededup, lm, mixing, nearcopies, packing, quality, repeats, util
from tallyloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, kept int, id long, th long, key string, count long, list int, rep int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma " * 20_000 + "x" * 50_000


def rows(*items):
    """(doc_id, text, lang, source) with columns whose names clash with those of the operators."""
    return [(d, t, g, s, None if t is None else len(t), 7, "s", 1, 5, 6, "k", 9, 3, 2) for d, t, g, s in items]


AWKWARD = rows(
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, LONG, "en", "b"), (5, "one two three\nfour five six seven eight nine", "en", None), (5, "one two three\nfour five six seven eight nine", "en", None),
    (5, "the same id but another text", "en", "b"), (None, "no id at all", None, "c"), (None, None, None, None), (9, "été ÉTÉ 😊 日本語 ###", "fr", "a"), (10, "12345 67890 !!!", None, "a"),
)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def text_of(corpus):
    return {r.doc_id: r.text for r in corpus.collect()}


# packing


def check_packing(pdf, docs, with_ids=False):
    encode = packing.encoder(tokenizer_path())
    want = collections.Counter()
    for d, t in docs:
        ids = np.array([*(encode(t) if t else []), 0], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    g = pdf.sort_values(["sequence_id", "offset"])
    assert (g["offset"] == g.groupby("sequence_id")["length"].cumsum() - g["length"]).all()
    used = g.groupby("sequence_id")["length"].sum()
    assert used.max() <= 1024
    padded = g.groupby("sequence_id")["padded_length"].first()
    assert ((padded == 1024) | ((used & (used - 1)) == 0)).all() and (padded >= used).all()
    assert pdf["length"].sum() == sum(n * c for (_, n, _), c in want.items())
    return used, padded


def test_packing(spark, corpus):
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    pdf = packing.harmonic_pack(corpus, tokenizer_path(), with_ids=True).toPandas()
    used, padded = check_packing(pdf, docs)
    assert (padded - used).sum() / used.sum() < 0.02
    encode = packing.encoder(tokenizer_path())
    by = dict(list(pdf.sort_values("start").groupby("doc_id")))
    for d, t in docs:
        own = by[d]
        assert np.concatenate(own["ids"].tolist()).tolist() == [*encode(t), 0]
        assert (own["start"] == own["length"].cumsum() - own["length"]).all() and (own["doc_tokens"] == own["length"].sum()).all()
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own["ids"]] == own["ids_crc32"].tolist()


def test_packing_encoder_gives_the_ids_of_tokenizers(corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    planted = ["", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n <|endoftext|", "x<|ENDOFTEXT|>y", "é \n\n  x", "日本語😊"]
    for as_text in (False, True):
        t.encode_special_tokens = as_text
        encode = packing.encoder(tokenizer_path(), as_text)
        for x in [x or "" for x in text_of(corpus).values()] + planted:
            assert encode(x) == t.encode(x, add_special_tokens=False).ids
    assert packing.encoder(tokenizer_path())("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_packing_awkward(awkward, nothing):
    pdf = packing.harmonic_pack(awkward, tokenizer_path()).toPandas()
    check_packing(pdf, [(r[0], r[1]) for r in AWKWARD])
    assert (pdf["doc_id"] == 1).sum() == 1 and pdf["doc_id"].isna().sum() == 2 and (pdf["doc_id"] == 5).sum() == 3
    assert packing.harmonic_pack(nothing, tokenizer_path()).count() == packing.harmonic_pack(nothing, tokenizer_path(), with_ids=True).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 1023, 1024, 1025, 5000])
def test_cuts(n):
    c = packing.cuts(n, 1024, 64)
    assert sum(c) == n and all(0 < x <= 1024 for x in c)


def test_best_fit():
    rng = random.Random(2)
    items = [(rng.randint(1, 100), i) for i in range(500)]
    got = packing.best_fit(items, 100)
    load = collections.Counter()
    for size, i in items:
        load[got[i][0]] += size
    assert max(load.values()) <= 100 and len(load) <= sum(s for s, _ in items) / 100 * 1.05 + 1


# quality


def test_base_counts(corpus):
    texts = [*text_of(corpus).values()] + [r[1] or "" for r in AWKWARD]
    got = quality.base_counts(util.encoded(texts))
    for x, r in zip(texts, got.itertuples(index=False)):
        w = WORD.findall(x)
        c, hit = collections.Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if c[w[i], w[i + 1], w[i + 2]] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [y for y in x.split("\n") if WORD.search(y)]
        assert tuple(r) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(hit))


def test_bands(spark, awkward, nothing):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = " ".join(rng.choice(vocabulary) if rng.random() < 0.6 else "the" for _ in range(700))
    noise = " ".join("".join(chr(rng.randint(33, 0x2FF)) for _ in range(9)) for _ in range(700))
    half = prose + " " + " ".join(f"again and again {i % 7}" for i in range(1500))
    code = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(60))
    df = spark.createDataFrame([(0, prose), (1, "buy now " * 900), (2, noise), (3, half), (4, code)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[0].kept and not got[1].kept and got[1].base_failed
    assert not got[2].kept and got[2].whole_ratio > 0.7
    assert not got[3].kept and got[3].low_chunks > 0
    assert not got[4].kept and not got[4].base_failed
    out = quality.judge(awkward).collect()
    assert len(out) == len(AWKWARD) and not any(r.kept for r in out) and all(r.n_words == 0 and r.base_failed for r in out if not (r.text or "").strip())
    assert quality.judge(nothing).count() == 0


def test_bands_test_every_byte(spark):
    """Noise in the second half of a text of under two chunks, and in a last partial chunk."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = " ".join(rng.choice(vocabulary) if rng.random() < 0.6 else "the" for _ in range(2000))
    code = " ".join(base64.b64encode(rng.randbytes(75)).decode() for _ in range(60))
    cases = {0: prose[:2000] + code[:2000], 1: prose[:2048] + code[:2000], 2: prose[:2000] + code[:2100], 3: prose[:4000], 4: prose[:1500], 5: prose[:2100], 6: prose[:6200]}
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert {d: got[d].n_chunks for d in cases} == {0: 2, 1: 2, 2: 3, 3: 2, 4: 1, 5: 2, 6: 4}
    assert all(not got[d].kept and not got[d].base_failed and got[d].high_chunks for d in (0, 1, 2))
    assert all(0.30 <= got[d].whole_ratio <= 0.68 for d in (0, 1)) and all(got[d].kept for d in (3, 4, 5, 6))


# repeats


def brute_repeats(docs, length):
    c = collections.Counter(b[i : i + length] for b in docs for i in range(len(b) - length + 1))
    out = []
    for b in docs:
        g = [0] * len(b)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                g[i : i + length] = [1] * length
        out.append((len(b), sum(g), sum(1 for i in range(len(b)) if g[i] and not (i and g[i - 1])), hashlib.sha256(bytes(y for y, z in zip(b, g) if not z)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,gram,hot", [(40, 16, 20_000), (40, 16, 3), (200, 32, 20_000), (25, 25, 4)])
def test_repeats(spark, length, gram, hot):
    rng = random.Random(length + hot)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(300))
    docs = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 70))) * rng.randint(1, 9) for _ in range(25)]
    docs += ["".join(rng.choice("xyz ") for _ in range(60)) + passage[rng.randint(0, 60) :] + str(i) for i in range(12)] + [passage, passage, "", None, "é" * 300]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(df, length, gram, hot, chunk_bytes=2000).collect()
    assert sorted(tuple(r[1:]) for r in got) == brute_repeats([(x or "").encode() for x in docs], length)


def test_runs_do_not_depend_on_the_buffer(monkeypatch):
    """A text's windows have the same anchors alone, after another text, and cut into stretches as one too long for a buffer."""
    rng = random.Random(7)
    text = "".join(rng.choice("abc de") for _ in range(9000)).encode()

    def anchors(raw, skip):
        out = {}
        for _, place, lo, hi, at, h, _ in repeats.runs(raw, 200, 32):
            for a, b, p, x in zip((lo + place - skip).tolist(), (hi + place - skip).tolist(), (at + place - skip).tolist(), h.tolist()):
                out.update({w: (p, x) for w in range(a, b + 1) if w >= 0})
        return out

    want = anchors([text], 0)
    assert len(want) == 9000 - 200 + 1 and anchors([b"z" * 5000, text], 5000) == want
    monkeypatch.setattr(repeats, "PLACE_BITS", 11)
    got = anchors([text], 0)
    # with fewer bits for places more of the hash decides, but each window has one anchor inside it in either case
    assert got.keys() == want.keys() and all(w <= p <= w + 168 for w, (p, _) in got.items())
    assert sum(got[w] == want[w] for w in want) > 0.99 * len(want)


def test_a_hot_anchor_is_counted_over_all_chunks(spark):
    """Over 255 times in each chunk: the count that makes an anchor hot is whole, whatever the chunks."""
    import pandas as pd

    key = np.array([5], np.uint64)
    asks = pd.DataFrame({"part": 0, "chunk": [f"{i}" for i in range(3)], "blob": [util.pack(key, np.array([300], np.uint32)) for _ in range(3)]})
    state = lambda hot: [util.unpack(b)[0].tolist() for b in repeats.answer_anchors(asks, hot)["blob"]]
    assert state(899) == [[2]] * 3 and state(900) == [[1]] * 3


def test_repeats_awkward(awkward, nothing):
    got = repeats.remove_repeats(awkward).collect()
    assert len(got) == len(AWKWARD) and sum(r.doc_id is None for r in got) == 2
    long = next(r for r in got if r.doc_id == 4)
    assert long.n_bytes == len(LONG) and long.n_removed == len(LONG) and long.n_spans == 1 or long.n_removed > 0.99 * len(LONG)
    assert repeats.remove_repeats(nothing).count() == 0


def test_interval_tree_gives_maximal_repeats_with_all_occurrences():
    rng = random.Random(8)
    for n in (2, 3, 9, 40):
        every = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))), "ANCHOR" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for _ in range(n)]
        for length in (7, 9, 11):
            # a context reaches as far as windows that hold the whole anchor do
            contexts = sorted({(min(len(x), length - 6), (x[max(0, len(x) - length + 6) :] + y[:length]).encode()) for x, y in every})
            found = [(b, a, sorted(map(int, m))) for b, a, m in repeats.repeats_at_anchor(contexts, length)]
            for b, a, m in found:  # all members agree, nobody else does
                o, x = contexts[m[0]]
                s = x[o - b : o + a]
                assert m == [i for i, (p, y) in enumerate(contexts) if p >= b and y[p - b : p + a] == s]
            got = {(i, w) for b, a, m in found for i in m for w in range(contexts[i][0] - b, contexts[i][0] + a - length + 1)}
            c = collections.defaultdict(set)
            for i, (o, x) in enumerate(contexts):
                for w in range(max(0, o + 6 - length), min(o, len(x) - length) + 1):
                    c[o - w, x[w : w + length]].add((i, w))
            assert got == {e for v in c.values() if len(v) > 1 for e in v}


# line dedup


def brute_lines(docs, rules):
    docs = sorted(docs)
    first, df = {}, collections.Counter()
    for d, x in docs:
        for _, n, k, _ in linededup.lines_of(x):
            first.setdefault(k, (d, n))
            df[k] += 1
    out = {}
    for d, x in docs:
        by = collections.defaultdict(list)
        for _, n, k, s in linededup.lines_of(x):
            if first[k][0] != d:
                by[first[k][0]].append((first[k][1], n, s, df[k]))
        gone = set()
        for v in by.values():
            best = []  # longest increasing run by trying all ends
            runs = []
            for i, p in enumerate(v):
                before = max((runs[j] for j in range(i) if v[j][0] < p[0]), key=len, default=[])
                runs.append(before + [p])
            best = max(runs, key=len)
            block = []
            for p in [*best, None]:
                if block and (p is None or p[0] != block[-1][0] + 1 or p[1] != block[-1][1] + 1):
                    if any(q[2] >= rules.min_chars and q[3] <= rules.rare_docs for q in block) or (len(block) >= rules.min_lines and max(q[2] for q in block) >= rules.min_chars):
                        gone |= {q[1] for q in block}
                    block = []
                if p is not None:
                    block.append(p)
        n, kept = -1, []
        for y in x.split("\n"):
            n += bool(y.strip())
            if not (y.strip() and n in gone):
                kept.append(y)
        out[d] = x if not gone else "\n".join(kept) if any(y.strip() for y in kept) else ""
    return out


def test_line_dedup(spark, corpus):
    texts = text_of(corpus)
    out = {r.doc_id: r.text for r in linededup.dedup_lines(corpus).collect()}
    want = brute_lines(texts.items(), linededup.Rules())
    assert sum(out[d] == want[d] for d in want) >= 0.98 * len(want)  # a longest run need not be unique
    rng = random.Random(6)
    lines = [f"line number {i} of some length {'x' * (i % 9)}" if i % 5 else f"s{i}" for i in range(30)] + [""]
    docs = []
    for i in range(40):  # shared lines keep their order, so that the longest run is unique
        own = [(rng.random() * 30, f"own {i} {j} {rng.random()}") for j in range(rng.randint(0, 9))]
        docs.append((i, "\n".join(x for _, x in sorted(own + [(float(k), lines[k]) for k in sorted(rng.sample(range(31), rng.randint(1, 20)))]))))
    rules = linededup.Rules(rare_docs=15)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), rules).collect()}
    assert got == brute_lines(docs, rules)


def test_aligned_is_a_longest_increasing_run():
    rng = random.Random(9)
    for _ in range(200):
        a = [rng.randint(0, 20) for _ in range(rng.randint(0, 25))]
        best = []
        for i, x in enumerate(a):
            best.append(1 + max((best[j] for j in range(i) if a[j] < x), default=0))
        got = linededup.aligned(a, list(range(len(a))))
        assert len(got) == max(best, default=0) and all(a[i] < a[j] and i < j for i, j in zip(got, got[1:]))


def all_pairs(docs, least):
    """Texts after every run of lines that an earlier document also has, of so many characters as a whole, is gone. Patience alignment with each earlier document must delete no more."""
    out, before = {}, []
    for d, x in sorted(docs):
        own = [(k, s) for _, _, k, s in linededup.lines_of(x)]
        gone, once = set(), set()
        for at in before:
            place = [at.get(k) for k, _ in own]
            both = [i for i, p in enumerate(place) if p is not None]
            for picked, into in ((both, gone), ([both[i] for i in linededup.aligned([place[i] for i in both], both)], once)):
                run = []
                for i in [*picked, None]:
                    if run and (i is None or i != run[-1] + 1 or place[i] != place[run[-1]] + 1):
                        if sum(own[j][1] for j in run) >= least:
                            into |= set(run)
                        run = []
                    if i is not None:
                        run.append(i)
        before.append({k: i for i, (k, _) in enumerate(own)})
        n, kept = -1, []
        for y in x.split("\n"):
            n += bool(y.strip())
            if not (y.strip() and n in gone):
                kept.append(y)
        out[d] = x if not gone else "\n".join(kept) if any(y.strip() for y in kept) else ""
        assert once <= gone
    return out


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(8)
    lines = [f"line number {i} of some length {'x' * (i % 9)}" if i % 3 else f"short {i}" for i in range(60)]
    docs = []
    for i in range(60):  # blocks in any order, whose single lines occur elsewhere first
        own = [f"own {i} {j} {rng.random()}" for j in range(rng.randint(0, 3))]
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(60)
            own += lines[a : a + rng.randint(1, 9)] + [""] * rng.randint(0, 1)
        docs.append((i, "\n".join(own)))
    x, y = "\n".join(f"block x line {i} and more of it" for i in range(4)), "\n".join(f"block y line {i} and more of it" for i in range(3))
    docs += [(100, "tail"), (101, x + "\n" + y + "\ntail"), (102, y + "\n" + x + "\ntail"), (103, y + "\n" + x + "\ntail"), (104, x + "\n" + y + "\ntail")]
    want = all_pairs(docs, linededup.MIN_CHARS)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and got[104] == "" and got[103] == "" and got[101] == docs[-4][1]


def test_line_dedup_verdict_does_not_depend_on_the_table(spark):
    """A line in more than a thousand documents goes like one in two."""
    line = "a passage of one line that stands in very many documents"
    docs = [(i, f"{line}\nown {i}") for i in range(1100)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1] and all(got[i] == f"own {i}" for i in range(1, 1100))


def test_line_dedup_awkward(awkward, nothing):
    out = linededup.dedup_lines(awkward).collect()
    assert len(out) == len(AWKWARD)
    assert [r.text for r in out if r.doc_id == 1] == [None]
    assert all(r.n_deleted == 0 for r in out)  # rows alike in id and text are one document
    assert {c: sum(getattr(r, c) is not None for r in out) for c in ("size", "th", "key")} == {"size": 11, "th": 11, "key": 11}
    assert linededup.dedup_lines(nothing).count() == 0


# fingerprints


def plain_phrases(raw):
    """Phrases of the parse, the unfinished one included."""
    seen, at = set(), b""
    for c in raw:
        at += bytes([c])
        if at not in seen:
            seen.add(at)
            at = b""
    return seen | ({at} if at else set())


def test_fingerprint_estimates_phrase_overlap(corpus):
    texts = [*text_of(corpus).values()]
    texts = [x for x in texts if len(x) > 1500][:30]
    for x, y in zip(texts, texts[1:]):
        k = len(x) // 3
        edited = x[: len(x) - k] + y[:k]
        a, b = (fingerprint.from_text(f) for f in fingerprint.fingerprint([x, edited]))
        p, q = plain_phrases(x.encode()), plain_phrases(edited.encode())
        assert abs(fingerprint.likeness(a, b) - len(p & q) / len(p | q)) < 0.2
        raw, keep = x.encode(), len(x[: len(x) - k].encode())
        own, other = fingerprint.fingerprints(raw, keep, y[:k].encode())
        assert (own == a).all() and (other == b).all()  # the shared part is parsed once


def test_edited_likeness(spark, corpus, awkward, nothing):
    for df in (corpus, corpus.limit(1), corpus.limit(2)):
        docs = sorted(((r.doc_id, r.text) for r in df.collect()), reverse=True)
        got = {r.doc_id: r for r in fingerprint.edited_likeness(df.repartition(3)).collect()}
        assert len(got) == len(docs)
        for (d, x), (_, y) in zip(docs, docs[1:] + docs[:1]):
            edited = x[: len(x) - len(x) // 3] + y[: len(x) // 3]
            a, b, c = fingerprint.fingerprint([x, edited, y])
            r = got[d]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(x), hashlib.sha256(edited.encode()).hexdigest(), a, b)
            f = fingerprint.from_text
            assert r.near_edited == fingerprint.likeness(f(a), f(b)) and r.near_next == fingerprint.likeness(f(a), f(c))
    out = fingerprint.edited_likeness(awkward).collect()
    assert len(out) == len(AWKWARD) and len({r.fingerprint for r in out if r.n_chars == 0}) == 1
    assert fingerprint.edited_likeness(nothing).count() == 0


def test_edited_likeness_with_hot_ids(spark):
    """Most rows without an id or with one id: these are split by a hash of the text, and each still meets its successor."""
    rows = [(None, f"no id {i} " * 5) for i in range(60)] + [(7, f"seven {i} " * 4) for i in range(40)] + [(i, f"own {i} " * 3) for i in range(12)] + [(7, "seven 1 " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parts, n = fingerprint.with_next(df)
    size = collections.Counter(r[0] for r in parts.select("__bucket").collect())
    assert n == 8 and len(size) > 5 and max(size.values()) < 40
    order = sorted(df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (-(r.doc_id if r.doc_id is not None else fingerprint.LOWEST), -r.h, r.text))
    want = collections.Counter()
    for r, s in zip(order, order[1:] + order[:1]):
        edited = r.text[: len(r.text) - len(r.text) // 3] + s.text[: len(r.text) // 3]
        want[r.doc_id, hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in fingerprint.edited_likeness(df).collect()) == want


# language model


def test_language_model(spark, corpus, awkward, nothing):
    lower = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x)
    texts = text_of(corpus)
    tokens = {d: [*WORD.findall(lower(x)), None] for d, x in texts.items()}
    crc = {d: zlib.crc32(str(d).encode()) for d in texts}
    train = [d for d in texts if crc[d] % 7 != 2]
    uni = collections.Counter(w for d in train for w in tokens[d])
    n, v = sum(uni.values()), len(uni)
    got = {r.doc_id: r for r in lm.score_documents(corpus, chunk_bytes=60_000).collect()}
    for d, t in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc[d] % 7 == 2, len(t), sum(uni[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t))
    # the model itself, with weights learnt from exact events
    pairs = collections.Counter(p for d in train for p in zip([None, *tokens[d]], tokens[d]))
    main = [d for d in train if crc[d] // 7 % lm.DELETED]
    mu, mp = collections.Counter(w for d in main for w in tokens[d]), collections.Counter(p for d in main for p in zip([None, *tokens[d]], tokens[d]))
    mn, mv = sum(mu.values()), len(mu)
    bucket = lambda c: min(math.ceil(math.log2(c + 1)), lm.BUCKETS - 1)
    events = collections.defaultdict(list)
    for d in set(train) - set(main):
        for a, b in zip([None, *tokens[d]], tokens[d]):
            events[bucket(mu[a])].append((mp[a, b] / mu[a] if mu[a] else 0.0, mu[b] / mn, 1 / (mv + 1)))
    weight = {}
    for k, e in events.items():
        p, w = np.array(e), np.full(3, 1 / 3)
        for _ in range(60):
            q = p * w
            w = (q / q.sum(1, keepdims=True)).mean(0)
        weight[k] = w
    total = hand = 0.0
    for d, t in tokens.items():
        if got[d].held_out:
            total += got[d].score
            for a, b in zip([None, *t], t):
                w = weight.get(bucket(uni[a]), weight[min(weight, key=lambda k: abs(k - bucket(uni[a])))])
                w = w if uni[a] else np.array([0, w[1] / (w[1] + w[2]), w[2] / (w[1] + w[2])])
                hand += math.log10(w[0] * (pairs[a, b] / uni[a] if uni[a] else 0) + w[1] * uni[b] / n + w[2] / (v + 1))
    assert total == pytest.approx(hand, rel=0.01)
    assert total > sum(r.base_score for r in got.values() if r.held_out)
    out = lm.score_documents(awkward).collect()
    assert len(out) == len(AWKWARD) and all(r.n_tokens == 1 for r in out if r.doc_id in (1, 2, 3)) and all(r.score < 0 for r in out)
    assert lm.score_documents(nothing).count() == 0


def test_em_finds_the_mixture():
    rng = np.random.default_rng(0)
    p2, p1 = rng.random(4000) * 0.5, rng.random(4000) * 0.01
    steps = lambda x: int(-math.log2(x) * lm.STEPS) if x > 0 else -1
    hist = collections.Counter((4, steps(a) if a > 0.1 else -1, steps(b)) for a, b in zip(p2, p1))
    w = lm.em([(*k, n) for k, n in hist.items()], 1000)
    assert w[4, 0] > 0.6 and np.allclose(w.sum(1), 1) and (w[9] == w[4]).all()


# mixing


def brute_mix(docs):
    size = {i: len(WORD.findall(x or "")) for i, (_, x, _) in enumerate(docs)}
    sources = sorted({s for *_, s in docs if s is not None}) + [None] * any(s is None for *_, s in docs)
    total = {s: sum(size[i] for i, (*_, t) in enumerate(docs) if t == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, left, open_ = {}, float(sum(total.values())), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * total[s] < level * weight[s]}
        for s in over or open_:
            target[s] = 3.0 * total[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return size, total, target


def test_mixing(spark, corpus, awkward, nothing):
    docs = [(r.doc_id, r.text, r.source) for r in corpus.collect()]
    skewed = [(d, x, "big" if i % 3 else (None if i % 9 == 0 else s)) for i, (d, x, s) in enumerate(docs)]
    for case in (docs, skewed):
        df = spark.createDataFrame(case, "doc_id long, text string, source string")
        got = mixing.mix_sources(df).collect()
        size, total, target = brute_mix(case)
        taken = collections.Counter()
        for r in got:
            assert r.target == pytest.approx(target[r.source]) and r.source_size == total[r.source] and 0 <= r.taken <= 3 * r.size
            assert r.size == 0 or r.taken % r.size == 0
            taken[r.source] += r.taken
        largest = max(size.values())
        assert all(abs(taken[s] - target[s]) <= largest / 2 for s in total)
        assert sorted(map(tuple, mixing.mix_sources(df.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)
        assert mixing.copies(mixing.mix_sources(df)).count() == sum(r.taken // r.size for r in got if r.size)
    out = mixing.mix_sources(awkward).collect()
    assert len(out) == len(AWKWARD) and all(r.size == 0 and r.taken == 0 for r in out if not (r.text or "").strip())
    assert mixing.mix_sources(nothing).count() == 0


# language ID


def test_language_id(spark, corpus, awkward, nothing):
    train = corpus.where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(train)
    assert len(model.languages) == corpus.select("lang").distinct().count()
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(big.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(big.where(langid.held_out(F.col("doc_id"))), model).collect()
    assert sum(r.lang_pred == r.lang for r in out) > 0.97 * len(out)
    assert sum(r.rejected for r in out) < 0.02 * len(out) and all(0 <= r.score <= 1 for r in out)
    far = langid.identify(spark.createDataFrame([("zqxj wvkk " * 30,), ("日本語のテキスト" * 30,)], "text string"), model).collect()
    assert all(r.rejected for r in far)
    got = {r.doc_id: r for r in langid.identify(awkward, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 10)] == ["und"] * 4 and got[1].rejected and got[4].lang_pred != "und"
    assert langid.identify(nothing, model).count() == 0
    empty = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(awkward, empty).collect()} == {"und"}


def nearest_by_hand(model, text):
    """(language, cosine) of the nearest centroid, gram by gram in plain Python."""
    raw = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode())
    raw += b"  "
    counts = collections.Counter()
    for k in (1, 2, 3):
        for i in range(len(raw) - k + 1):
            gram = raw[i : i + k]
            if gram != b" " * k:
                counts[((int.from_bytes(gram, "little") + ((k - 1) << 28)) * 0x9E3779B1) % (1 << 32) >> 20] += 1
    v = {s: math.log1p(n) * float(model.idf[s]) for s, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    cos = [sum(x * float(c[s]) for s, x in v.items()) / norm for c in model.centroids]
    best = max(range(len(cos)), key=cos.__getitem__)
    return model.languages[model.owner[best]], cos[best]


def test_language_id_against_brute_force(spark, corpus):
    model = langid.fit(corpus.where(~langid.held_out(F.col("doc_id"))), per_language=30)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    texts = [r.text for r in corpus.collect() if r.text and any(map(str.isalpha, r.text)) and len(r.text) < 5000]
    names, score, _ = langid.predict_texts(model, texts)
    for x, name, s in zip(texts, names, score):
        want, cos = nearest_by_hand(model, x)
        assert abs(cos - s) < 1e-4 and want == name


def test_language_id_learns_without_ids_and_from_repeated_rows(spark):
    """Ids have no part in the sample, and a text that repeats counts once."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(big.where("lang IS NOT NULL"), per_language=50)
    other = langid.fit(big.withColumn("doc_id", F.lit(None).cast("long")).union(big.where("doc_id < 100")).repartition(5), per_language=50)
    assert model.languages == other.languages and np.allclose(model.centroids, other.centroids) and len(model.languages) == 4
    hot = big.where("doc_id = 7").crossJoin(spark.range(3000).select()).union(big)
    assert langid.fit(hot, per_language=50).languages == model.languages


def test_language_id_rejects_what_was_not_learnt(spark):
    """Random letters, base64 and Latin-script languages without samples, at many lengths; clean held-out texts stay."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(big.where(~langid.held_out(F.col("doc_id"))))
    rng = random.Random(1)
    fi = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    vi = "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. "
    far = []
    for n in (162, 300, 1400, 4000, 14000):
        far += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)), base64.b64encode(rng.randbytes(n * 3 // 4)).decode(), (fi * 100)[:n], (vi * 100)[:n]]
    assert langid.predict_texts(model, far)[2].all()
    clean = [r.text for r in big.where(langid.held_out(F.col("doc_id"))).collect() if r.text]
    assert langid.predict_texts(model, clean)[2].mean() < 0.02


# near copies


def brute_links(texts, radius):
    f = nearcopies.simhash(texts)
    return {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if np.bitwise_count(f[i] ^ f[j]).sum() <= radius}


def test_near_copies(spark, corpus, awkward, nothing):
    docs = sorted((r.doc_id, r.text) for r in corpus.collect())
    links = brute_links([x for _, x in docs], nearcopies.RADIUS)
    from tallyloom.operators.graph import union_find

    want = dict(union_find([(docs[i][0], docs[j][0]) for i, j in links]))
    got = {r.doc_id: r for r in nearcopies.near_copies(corpus).collect()}
    assert {d: r.class_id for d, r in got.items()} == {d: want.get(d, d) for d, _ in docs}
    assert all(r.class_size == collections.Counter(x.class_id for x in got.values())[r.class_id] for r in got.values())
    assert nearcopies.drop_near_copies(corpus).count() == len({r.class_id for r in got.values()})
    out = nearcopies.near_copies(awkward).collect()
    assert len(out) == len(AWKWARD)
    kept = nearcopies.drop_near_copies(awkward)
    assert kept.columns == awkward.columns and kept.where("text LIKE 'one two%'").count() == 1 and kept.where("text LIKE 'the same id%'").count() == 1
    assert nearcopies.near_copies(nothing).count() == nearcopies.drop_near_copies(nothing).count() == 0


@pytest.mark.parametrize("list_size,list_most,depths", [(4, 10_000, 3), (1_000_000, 40, 3), (1_000_000, 20, 1)])
def test_near_copies_by_recursion(spark, list_size, list_most, depths):
    """Small lists, hot lists that are recursed into, and ones that stay hot: recall on planted copies of many distances."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    docs, pairs = [], []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for k in range(3):
            x = base[:]
            for _ in range(k * 2):
                x[rng.randrange(150)] = rng.choice(vocabulary)
            docs.append((3 * i + k, " ".join(x)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    links = brute_links([x for _, x in docs], nearcopies.RADIUS)
    got = {r.doc_id: r for r in nearcopies.near_copies(df, list_size=list_size, list_most=list_most, depths=depths).collect()}
    found = sum(got[i].class_id == got[j].class_id for i, j in links)
    assert len(links) > 150 and found >= 0.95 * len(links)
    assert all(len({got[3 * i + k].class_id // 3 for k in range(3)}) == 1 for i in range(60))  # no stranger in a class
    if list_most > 1000:
        assert 0.9 * 2 * len(links) <= sum(r.n_links for r in got.values()) <= 2 * len(links)


@pytest.mark.parametrize("list_size,list_most", [(1_000_000, 40), (100, 40)])
def test_links_are_counted_once_in_lists_recursed_into(spark, list_size, list_most):
    """Every pair counts once, whichever outer and inner lists it meets in."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    docs = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for k in range(4):
            x = base[:]
            for _ in range(k):
                x[rng.randrange(150)] = rng.choice(vocabulary)
            docs.append((4 * i + k, " ".join(x)))
    links = brute_links([x for _, x in docs], nearcopies.RADIUS)
    want = collections.Counter(k for pair in links for k in pair)
    got = {r.doc_id: r.n_links for r in nearcopies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), list_size=list_size, list_most=list_most).collect()}
    assert len(links) > 200 and all(got[d] <= want[d] for d in got)
    assert sum(got.values()) >= 0.98 * 2 * len(links)


def test_lists_that_stay_too_large_are_searched_whole_in_blocks(spark):
    """No recursion at all: every link is found, and counted once, in pairs of blocks."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = []
    for i in range(150):
        x = base[:]
        for _ in range(rng.randint(1, 59)):
            x[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(x)))
    links = brute_links([x for _, x in docs], nearcopies.RADIUS)
    want = collections.Counter(k for pair in links for k in pair)
    got = {r.doc_id: r.n_links for r in nearcopies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), list_size=1_000_000, list_most=20, depths=0).collect()}
    assert len(links) > 400 and got == {i: want[i] for i in range(150)}


@pytest.mark.parametrize("list_most", [10_000, 2])
def test_links_are_counted_once_in_parts_of_lists(spark, list_most):
    """Lists that their tasks search in parts, as they are or, being hot, after more strips: every pair counts once, and few are missed."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    docs = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for k in range(4):
            x = base[:]
            for _ in range(k):
                x[rng.randrange(150)] = rng.choice(vocabulary)
            docs.append((4 * i + k, " ".join(x)))
    assert [nearcopies.plan(len(docs), list_size=n)[2] for n in (240, 10, 0.5)] == [0, 1, 2]
    links = brute_links([x for _, x in docs], nearcopies.RADIUS)
    want = collections.Counter(k for pair in links for k in pair)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for list_size in (10, 0.5):
        got = {r.doc_id: r.n_links for r in nearcopies.near_copies(df, list_size=list_size, list_most=list_most, depths=1).collect()}
        assert len(links) > 300 and all(got[d] <= want[d] for d in got)
        assert sum(got.values()) >= 0.95 * 2 * len(links)
    kept = {r.doc_id for r in nearcopies.drop_near_copies(df, list_size=10).collect()}
    assert kept == {4 * i for i in range(60)}


@pytest.mark.parametrize("radius", [nearcopies.RADIUS, 70])
def test_the_search_of_a_list_does_little_more_than_its_pairs(monkeypatch, radius):
    """Unrelated fingerprints are told apart by three words at most, at either radius of the repository, and only members of a found pair are asked whether they met before."""
    rng = np.random.default_rng(8)
    f = rng.integers(0, 1 << 63, (1000, 4), dtype=np.uint64)
    f[1] = f[0] ^ np.uint64(1)
    done, count = [], np.bitwise_count
    monkeypatch.setattr(nearcopies.np, "bitwise_count", lambda x: done.append(x.size) or count(x))
    assert [(i.tolist(), j.tolist()) for i, j in nearcopies.close_pairs(f, radius)] == [([0], [1])]
    monkeypatch.undo()
    assert sum(done) < 3.5 * (1000**2 / 2 + 128 * 1000 / 2)
    asked, lists = [], nearcopies.lists
    monkeypatch.setattr(nearcopies, "lists", lambda bits, *a: asked.append(len(bits)) or lists(bits, *a))
    met = nearcopies.met_before((150,), 3, [], [])
    ids = np.arange(1000)
    out = nearcopies.search_parts(ids, f, np.zeros(1000, np.int64), radius, (150,), 0, 1, met)
    assert out["id"].tolist() == [0, 1] and out["root"].tolist() == [0, 0] and sum(asked) < 1000 + 2 * 151


def test_repetitions_grow_little_with_the_table():
    """At the fingerprints of 6 and 30 GB each is sent out so often that the lists are under 4 x the input, and two at the radius still meet with probability 0.95."""
    for n, most in ((2_760_000, 60), (14_000_000, 180)):
        for radius in (nearcopies.RADIUS, 70):
            levels, reps, strips, passes = nearcopies.plan(n, radius)
            assert reps <= most and n / 16 ** (levels + strips) <= nearcopies.LIST_SIZE
            assert 1 - (1 - nearcopies.meeting(radius, levels) * (1 - (1 - nearcopies.meeting(radius, strips)) ** passes)) ** reps >= nearcopies.RECALL


def test_near_copies_in_scripts_without_blanks():
    rng = random.Random(4)
    zh = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(800))
    code = base64.b64encode(rng.randbytes(3000)).decode()
    other = ["".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(800)), base64.b64encode(rng.randbytes(3000)).decode()]
    f = nearcopies.simhash([zh, zh[:300] + "一二" + zh[301:], other[0], code, code[:500] + "QQQ" + code[501:], other[1]])
    d = lambda i, j: int(np.bitwise_count(f[i] ^ f[j]).sum())
    assert d(0, 1) < 30 and d(3, 4) < 30 and min(d(0, 2), d(3, 5), d(0, 3)) > 80
    assert nearcopies.parted(["plain words", "x" * 64, ""]) == ["plain words", "x" * 64, ""]


def test_meeting_odds():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2, (400, 256), dtype=np.uint8)
    b = a.copy()
    for row in b:
        row[rng.permutation(256)[:40]] ^= 1
    met = np.mean([(nearcopies.lists(a, (s,), 1) == nearcopies.lists(b, (s,), 1)).mean() for s in range(60)])
    assert abs(met - nearcopies.meeting(40, 1)) < 0.03
    assert len(np.unique(nearcopies.decoder(), return_counts=True)[1]) == 16


def test_pack_round_trip():
    x = [np.array([], np.uint32), np.arange(5, dtype=np.int64), b"", b"abc" * 9, np.array([1.5]), np.arange(9, dtype=np.uint16)]
    for a, b in zip(x, util.unpack(util.pack(*x))):
        assert a == b if isinstance(a, bytes) else (a == b).all() and a.dtype == b.dtype
