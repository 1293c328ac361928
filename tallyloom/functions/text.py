"""Text normalisation, counts and previews with Unicode-aware character classes."""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.split sees it: Java's \s stops at ASCII.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = "[^" + WS[1:]
WORD = r"[\p{L}\p{N}_]"
# Decimal digits, and what str.isdigit adds to them.
DIGIT = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
PATTERNS = {
    "url": rf"(?i)(?<!{WORD})(?:www\.|http(?:s|)://){NOT_WS}+",
    "emoji_like": r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{20E3}]",
    "tab": r"\t",
    "line_break": r"\r\n|\r|\n",
    "repeated_whitespace": r"[ \t]{2,}",
    "non_breaking_space": r"[\x{A0}\x{202F}]",
    "zero_width_character": r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]",
    "punctuation_character": r"\p{P}",
    "repeated_punctuation": r"[!?.,;:]{2,}",
    "digit_character": DIGIT,
}
PRODUCT_CODE = rf"(?<!{WORD})(?=[A-Z-]*[0-9])(?=[0-9-]*[A-Z])[0-9A-Z]+(?:-[0-9A-Z]+)*(?!{WORD})"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
# What the patterns are in Python, where regular expressions have no Unicode classes: \w and \s are WORD and WS.
_WORDS = re.compile(r"\w+")
_URL = re.compile(r"(?<!\w)(?:[wW]{3}\.|[hH][tT][tT][pP](?:[sS]|)://)\S+")
STEP = 256  # rows whose texts are Python objects at a time


def duplicate_key(x: str) -> str:
    """NFKC, no zero-width characters, single blanks, trimmed, case folded."""
    if x.isascii():
        return " ".join(x.split()).lower()
    x = unicodedata.normalize("NFKC", x)
    for c in ZERO_WIDTH:
        x = x.replace(c, "")
    return " ".join(x.split()).casefold()


def review_text(x: str) -> str:
    """NFKC, single blanks, trimmed; case and zero-width characters stay."""
    return " ".join((x if x.isascii() else unicodedata.normalize("NFKC", x)).split())


def _columns(kind: str, fn: Callable[[list[str]], list[list]]) -> Callable[[Column], Column]:
    """A function of text columns, whose fields fn gives as lists for a list of texts; null texts have null fields. It goes through a batch in short steps, so that few texts are Python objects at a time."""
    names = [f.split(" ")[0] for f in kind.split(", ")]
    types = [pa.string() if f.endswith(" string") else pa.int64() for f in kind.split(", ")]

    @F.arrow_udf(f"struct<{', '.join(f.replace(' ', ': ') for f in kind.split(', '))}>")
    def run(x: pa.Array) -> pa.Array:
        parts: list[list] = [[] for _ in names]
        for at in range(0, len(x), STEP):
            texts = x.slice(at, STEP).to_pylist()
            got = fn([t for t in texts if t is not None])
            for part, values, of in zip(parts, got, types):
                own = iter(values)
                part.append(pa.array([None if t is None else next(own) for t in texts], of))
        return pa.StructArray.from_arrays([pa.concat_arrays(p) if p else pa.array([], of) for p, of in zip(parts, types)], names)

    return run


def duplicate_key_of(text: Column) -> Column:
    return _columns("norm string", lambda texts: [[duplicate_key(t) for t in texts]])(text)["norm"]


def duplicate_key_digest_of(text: Column) -> Column:
    """SHA-256 of duplicate_key_of(), made where the key is: no second text goes back."""
    return _columns("digest string", lambda texts: [[hashlib.sha256(duplicate_key(t).encode()).hexdigest() for t in texts]])(text)["digest"]


def _keys_and_words(texts: list[str]) -> list[list]:
    keys = [duplicate_key(t) for t in texts]
    return [keys, [len(_WORDS.findall(k)) for k in keys]]


def keyed_of(text: Column) -> Column:
    """(norm, tokens): the duplicate key and how many runs of WORD it has."""
    return _columns("norm string, tokens long", _keys_and_words)(text)


def review_text_of(text: Column) -> Column:
    return _columns("text string", lambda texts: [[review_text(t) for t in texts]])(text)["text"]


def sizes_of(text: Column) -> Column:
    """(tokens, lines): runs of NOT_WS; line breaks and one."""
    return _columns("tokens long, lines long", lambda texts: [[len(t.split()) for t in texts], [t.count("\n") + t.count("\r") - t.count("\r\n") + 1 for t in texts]])(text)


@functools.cache
def _classes() -> np.ndarray:
    """A byte of flags per code point, for the patterns that are character classes or runs of them."""
    out = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0x1F1E6, 0x1F1FF), (0x1F300, 0x1FAFF), (0x2600, 0x27BF), (0xFE0F, 0xFE0F), (0x20E3, 0x20E3)):
        out[lo : hi + 1] |= 1
    for flag, chars in ((2, "\t"), (4, "\xa0\u202f"), (8, ZERO_WIDTH), (64, " \t"), (128, "!?.,;:")):
        for c in chars:
            out[ord(c)] |= flag
    for i in range(0x20000):  # beyond lie neither punctuation nor digits
        c = chr(i)
        out[i] |= 16 * unicodedata.category(c).startswith("P") + 32 * c.isdigit()
    return out


def pattern_counts(texts: list[str]) -> list[list[int]]:
    """How often each of PATTERNS occurs in each text, as regular expressions find them, from one look at each character."""
    if not texts:
        return [[] for _ in PATTERNS]
    c = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    f = _classes()[c]

    def per_text(hits: np.ndarray) -> list[int]:
        return np.bincount(np.searchsorted(ends, np.flatnonzero(hits), "right"), minlength=len(texts)).tolist()

    def runs(flag: int) -> list[int]:
        """Runs of two and more; the last character is always a separator."""
        own = np.concatenate([[False], (f & flag) != 0])
        return per_text(own[1:-1] & own[2:] & ~own[:-2])

    feed = c == 10
    feed[1:] &= c[:-1] != 13
    return [
        [len(_URL.findall(t)) if "://" in t or "www." in t.lower() else 0 for t in texts],
        per_text(f & 1), per_text(f & 2), per_text(feed | (c == 13)), runs(64), per_text(f & 4), per_text(f & 8), per_text(f & 16), runs(128), per_text(f & 32),
    ]


def pattern_counts_of(text: Column) -> Column:
    """A field for each of PATTERNS."""
    return _columns(", ".join(f"{n} long" for n in PATTERNS), pattern_counts)(text)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def token_count(text: Column) -> Column:
    return count_of(text, NOT_WS + "+")


def line_count(text: Column) -> Column:
    return count_of(text, PATTERNS["line_break"]) + 1


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_WS)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def preview(text: Column, most: int = 160, strip: bool = False) -> Column:
    """White space collapsed; beyond `most` characters cut to most - 3 (trailing blanks stripped if asked) and an ellipsis."""
    short = collapsed(text)
    head = F.substring(short, 1, most - 3)
    return F.when(F.length(short) > most, F.concat(F.rtrim(head) if strip else head, F.lit("..."))).otherwise(short)

