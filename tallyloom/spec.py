"""What a labelled text table looks like, and the fixed numbers of the analyses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ASPECTS = tuple("material design size price service".split())
LABEL_NAMES = dict(enumerate("not_mentioned negative neutral positive".split()))
SEED = 42
SPLITS = tuple("train validation test".split())
RATIOS = dict(zip(SPLITS, (0.70, 0.15, 0.15)))
PERCENTILES = tuple(p / 100 for p in (0, 1, 5, 25, 50, 75, 90, 95, 99, 100))
MISSING = "missing"


@dataclass(frozen=True)
class LabelSpec:
    """Label columns with their valid values and those that count as a mention."""

    columns: tuple[str, ...] = ASPECTS
    valid: tuple[int, ...] = (0, 1, 2, 3)
    mention: tuple[int, ...] = (1, 2, 3)


@dataclass(frozen=True)
class TableSpec:
    """Names of the id, text, source-split and row-order columns of a table; null labels are unlabelled, never 0."""

    id: str = "source_id"
    text: str = "text"
    split: str = "source_split"
    row: str = "row_index"
    labels: LabelSpec = field(default_factory=LabelSpec)


@dataclass(frozen=True)
class NearSpec:
    """Blocking and verification of near-duplicate pairs."""

    bands: int = 4
    band_bits: int = 16
    max_hamming: int = 16
    min_chars: int = 30
    min_tokens: int = 6
    min_length_ratio: float = 0.65
    review: tuple[float, float] = (0.60, 0.75)  # Jaccard, sequence ratio
    high: tuple[float, float] = (0.72, 0.82)
    max_sequence_chars: int | None = None  # None: no text is too long for the sequence ratio


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_STR, _LONG, _INT, _BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
RAW = _s(("source_id", _LONG), ("text", _STR), *((a, T.DoubleType()) for a in ASPECTS))
INTERIM = _s(
    ("review_id", _STR), ("group_id", _STR), ("source_split", _STR), ("source_id", _LONG), ("source_text", _STR), ("text", _STR), *((a, _INT) for a in ASPECTS),
    ("group_has_label_conflict", _BOOL), ("group_conflicting_label_columns", T.ArrayType(_STR)), ("group_has_mixed_missing_labels", _BOOL), ("group_mixed_missing_label_columns", T.ArrayType(_STR)),
    ("group_conflict_policy", _STR), ("retain_for_processing", _BOOL), ("requires_manual_review", _BOOL),
)
MEMBERSHIP = _s(("review_id", _STR), ("group_id", _STR), ("split", _STR))
