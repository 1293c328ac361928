"""The reports of the single commands as one summary, and that summary as a document."""

from __future__ import annotations

from tallyloom.operators.eda import require_aligned, table
from tallyloom.spec import LABEL_NAMES

PARTS = ("validate", "profile-labels", "profile-text", "duplicates", "near-duplicates", "eda")
INVALID = ("non_integer_label", "label_out_of_range", "invalid_label_type")

POLICY = {
    "Text": "Compare and store texts in NFKC with single blanks, beside the source text as it came. Case, diacritics, digits, punctuation and emoji stay: they may carry meaning. Long texts are looked at, not dropped.",
    "Missing labels": "A null is never read as label 0. It takes a row out of the aspect concerned, and of no other one.",
    "Groups": "Exact duplicates and high-confidence near duplicates form one group, transitively; every other row is a group of its own. Group ids follow from the members alone.",
    "Splits": "Groups are assigned whole and in a fixed order to train, validation and test, and the label shares of each are checked afterwards.",
    "Conflicts": "Members that disagree keep their labels and stay together until somebody has decided between them.",
}
LIMITS = (
    "Near duplicates are found by bands of a SimHash and then verified: a paraphrase in other words is not among them.",
    "A product code is any word of upper-case letters and digits; no dictionary is used.",
)


def summarize(reports: dict[str, dict]) -> dict:
    """One summary of the reports of PARTS, which must all speak of the same rows; raises ValueError if they don't, or if one is missing."""
    missing = [p for p in PARTS if p not in reports]
    if missing:
        raise ValueError(f"reports are missing: {', '.join(missing)}")
    require_aligned({p: reports[p]["source"] for p in PARTS})
    t = {p: reports[p]["tables"] for p in PARTS}
    issues = t["validate"]["issues"]
    nulls: dict[str, int] = {}
    for i in issues:
        if i["code"] == "null_label":
            nulls[i["column"]] = nulls.get(i["column"], 0) + i["count"]
    labels: dict[tuple, list] = {}
    for r in t["profile-labels"]["labels"]:
        labels.setdefault((r["split"], r["aspect"]), []).append(r)
    balance = {(r["split"], r["aspect"]): r for r in t["eda"]["balance"]}
    aspects = []
    for r in t["profile-labels"]["label_summary"]:
        key = (r["split"], r["aspect"])
        most = balance.get(key, {})
        name = LABEL_NAMES.get(most.get("dominant_label"))
        aspects.append({k: r[k] for k in ("split", "aspect", "missing_count", "mentioned_count", "mentioned_proportion")} | {"dominant_label": most.get("dominant_label"), "dominant_name": name, "dominant_count": most.get("dominant_count"), "imbalance": most.get("imbalance"), "labels": labels.get(key, [])})
    return {
        "dataset": reports["validate"]["source"] | {"input": reports["validate"].get("input")},
        "quality": {"valid": reports["validate"].get("valid"), "null_labels": nulls, "null_label_cells": sum(nulls.values()), "invalid_labels": sum(i["count"] for i in issues if i["code"] in INVALID), "issues": issues},
        "labels": {"aspects": aspects, "mentions": t["profile-labels"]["mentions"]},
        "text": {k: t["profile-text"][k] for k in ("statistics", "percentiles", "thresholds", "patterns")},
        "duplicates": {"exact_raw": t["duplicates"]["raw_summary"], "exact": t["duplicates"]["normalized_summary"], "near": t["near-duplicates"]["summary"]},
        "samples": {k: t["eda"][k] for k in ("median_samples", "mixed_samples", "product_codes")},
        "policy": POLICY,
        "limits": list(LIMITS),
    }


def document(s: dict) -> str:
    """The summary in Markdown: data, quality, labels, texts, duplicates, samples, policy, limits."""
    q = s["quality"]
    aspects = [{k: v for k, v in a.items() if k != "labels"} for a in s["labels"]["aspects"]]
    parts = [
        "# Exploratory report\n",
        f"## Data\n\n{s['dataset']['rows']} rows, splits: {s['dataset']['split']}; digest {s['dataset']['digest']}.\n",
        f"## Quality\n\nValidation {'passed' if q['valid'] else 'failed'}; {q['null_label_cells']} cells without a label, {q['invalid_labels']} invalid labels.\n\n{table(q['issues'])}",
        f"## Labels\n\n{table(aspects)}\n### Distribution\n\n{table([r for a in s['labels']['aspects'] for r in a['labels']])}\n### Aspects mentioned\n\n{table(s['labels']['mentions'])}",
        f"## Text lengths\n\n{table(s['text']['statistics'])}\n{table(s['text']['percentiles'])}\n{table(s['text']['thresholds'])}",
        f"## Patterns in texts\n\n{table(s['text']['patterns'])}",
        f"## Duplicates\n\n### Same text\n\n{table(s['duplicates']['exact_raw'])}\n### Same text after normalisation\n\n{table(s['duplicates']['exact'])}\n### Near duplicates\n\n{table(s['duplicates']['near'])}",
        *[f"## Samples: {name.replace('_', ' ')}\n\n{table(rows)}" for name, rows in s["samples"].items()],
        "## Policy\n\n" + "\n".join(f"* **{k}.** {v}" for k, v in s["policy"].items()) + "\n",
        "## Limits\n\n" + "\n".join(f"* {x}" for x in s["limits"]) + "\n",
    ]
    return "\n".join(parts)
