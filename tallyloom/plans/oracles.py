"""DuckDB SQL for the queries of the catalogue that SQL can express."""

from __future__ import annotations

from tallyloom.functions.text import DIGIT, NOT_WS, PATTERNS, WORD, WS
from tallyloom.spec import ASPECTS, MISSING, PERCENTILES, SPLITS

R = """r AS (
  SELECT d.doc_id AS source_id, d.lang AS source_split, d.text, (quality + 2 * toxic)::INT AS material,
         (CASE WHEN d.doc_id % 7 <> 0 THEN d.doc_id % 4 END)::INT AS design, ((d.doc_id // 4) % 4)::INT AS size,
         (length(d.text) % 4)::INT AS price, (CASE WHEN d.doc_id % 5 <> 4 THEN d.doc_id % 5 END)::INT AS service
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
DIRTY = f"""{R}, x AS (
  SELECT CASE WHEN source_id % 47 <> 5 THEN source_id END AS source_id, source_id AS row_index, source_split,
         CASE WHEN source_id % 41 = 1 THEN NULL WHEN source_id % 43 = 2 THEN ' ' || chr(9) || chr(10) ELSE text END AS text,
         CASE WHEN source_id % 37 = 3 THEN 1.5 WHEN source_id % 31 = 4 THEN 7.0 ELSE material END::DOUBLE AS material, design, size, price, service FROM r)"""


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def norm(c: str) -> str:
    return f"replace(lower({squeezed(c)}), 'ß', 'ss')"


def n_of(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def preview(c: str, most: int = 160, strip: bool = False) -> str:
    head = f"substr({squeezed(c)}, 1, {most - 3})"
    return f"CASE WHEN length({squeezed(c)}) > {most} THEN {f'rtrim({head})' if strip else head} || '...' ELSE {squeezed(c)} END"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def both(a: str) -> tuple[str, str]:
    """(conflict, mixed-missing) tests of an aspect over a group."""
    return f"count(DISTINCT {a}) > 1", f"count({a}) > 0 AND count({a}) < count(*)"


def listed(which: int) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {both(a)[which]} THEN '{a}' END" for a in ASPECTS) + ")"


def any_of(which: int) -> str:
    return "(" + " OR ".join(f"({both(a)[which]})" for a in ASPECTS) + ")"


CELLS = [(a, x) for a in ASPECTS for x in ("0", "1", "2", "3", MISSING)]


def cell(a: str, x: str) -> str:
    return f"count(*) FILTER ({a} IS NULL)" if x == MISSING else f"count(*) FILTER ({a} = {x})"


def raw_issues() -> str:
    tests = [("null_identifier", "error", "source_id", "source_id IS NULL"), ("null_review", "error", "text", "text IS NULL"), ("empty_review", "error", "text", f"text IS NOT NULL AND NOT regexp_matches(text, '{NOT_WS}')"), ("unexpected_columns", "warning", "note", "TRUE")]
    for a in ASPECTS:
        tests += [("null_label", "error", a, f"{a} IS NULL"), ("non_integer_label", "error", a, f"{a} % 1 <> 0"), ("label_out_of_range", "error", a, f"{a} NOT IN (0, 1, 2, 3)")]
    return union([f"SELECT source_split AS split, '{c}' AS code, '{s}' AS severity, '{k}' AS column_name, count(*) AS n FROM x WHERE {t} GROUP BY source_split" for c, s, k, t in tests])


def processed() -> str:
    tests = [("null_review_id", "error", "review_id", "review_id IS NULL"), ("empty_review_id", "error", "review_id", f"NOT regexp_matches(review_id, '{NOT_WS}')"), ("null_group_id", "error", "group_id", "group_id IS NULL"), ("empty_group_id", "error", "group_id", f"NOT regexp_matches(group_id, '{NOT_WS}')")]
    tests += [("null_text", "error", "text", "text IS NULL"), ("empty_text", "error", "text", f"NOT regexp_matches(text, '{NOT_WS}')"), ("invalid_split", "error", "split", "split IS NULL OR split NOT IN ('train', 'validation', 'test')")]
    for a in ASPECTS:
        tests += [("missing_label", "warning", a, f"{a} IS NULL"), ("non_integer_label", "error", a, f"{a} % 1 <> 0"), ("label_out_of_range", "error", a, f"{a} % 1 = 0 AND {a} NOT IN (0, 1, 2, 3)")]
    p = """p AS (SELECT 'r' || CASE WHEN source_id % 29 = 1 THEN source_id - 1 ELSE source_id END AS review_id,
        CASE WHEN source_id % 23 <> 2 THEN 'g' || source_id ELSE ' ' END AS group_id,
        CASE WHEN source_id % 19 = 3 THEN 'dev' WHEN source_id % 3 = 0 THEN 'train' ELSE 'test' END AS split, text,
        CASE WHEN source_id % 37 = 3 THEN 1.5 WHEN source_id % 31 = 4 THEN 7.0 ELSE material END::DOUBLE AS material, design, size, price, service FROM r)"""
    rows = [f"SELECT '{c}' AS code, '{s}' AS severity, '{k}' AS column_name, count(*) AS n FROM p WHERE {t}" for c, s, k, t in tests]
    rows.append("SELECT 'duplicate_review_id', 'error', 'review_id', sum(k)::BIGINT FROM (SELECT count(*) AS k FROM p GROUP BY review_id HAVING count(*) > 1)")
    return f"WITH {R}, {p} SELECT * FROM ({union(rows)}) WHERE n > 0"


def lengths(source: str = "r", split: str = "source_split", id_: str = "source_id", row: str = "source_id") -> str:
    return f"""s AS (SELECT {split} AS split, {id_} AS id, {row} AS row, text, length(text)::BIGINT AS characters, {n_of('text', NOT_WS + '+')}::BIGINT AS tokens,
       ({n_of('text', PATTERNS['line_break'])} + 1)::BIGINT AS lines FROM {source} WHERE regexp_matches(text, '{NOT_WS}'))"""


UNPIVOT = "u AS (SELECT split, 'characters' AS metric, characters AS value FROM s UNION ALL SELECT split, 'tokens', tokens FROM s UNION ALL SELECT split, 'lines', lines FROM s)"


def percentiles() -> str:
    return union([f"SELECT split, metric, 'p{round(p * 100):02d}' AS percentile, round(quantile_cont(value, {p}), 6) AS value FROM u GROUP BY ALL" for p in PERCENTILES])


RE2 = dict(PATTERNS) | {"url": rf"(?i)\b(?:www\.|http(?:s|)://){NOT_WS}+", "digit_character": DIGIT}
SIGNATURES = f"""n AS (SELECT source_split AS split, {norm('text')} AS norm, min(source_id) AS row, count(*) AS n FROM r GROUP BY 1, 2),
e AS (SELECT *, regexp_extract_all(norm, '{WORD}+') AS w FROM n),
el AS (SELECT * FROM e WHERE length(norm) >= 30 AND len(w) >= 6),
f AS (SELECT split, row, n, unnest(list_distinct(list_concat(w, [w[i] || '␟' || w[i + 1] for i in range(1, len(w))]))) AS f FROM el),
h AS (SELECT split, row, n, ('0x' || substr(sha256(f), 1, 16))::UBIGINT AS v FROM f),
b AS (SELECT split, row, n, k, 2 * sum((v >> (63 - k)) & 1) >= count(*) AS one FROM h, (SELECT unnest(range(64))::INT AS k) GROUP BY ALL),
sg AS (SELECT split, row, n, sum(CASE WHEN one THEN (1::HUGEINT << (63 - k)) ELSE 0 END)::UBIGINT AS sig FROM b GROUP BY ALL),
bd AS (SELECT split, row, n, sig, band, (sig >> (16 * band)) & 65535 AS key FROM sg, (SELECT unnest(range(4))::INT AS band)),
m AS (SELECT a.split, a.row AS first_row, c.row AS second_row, a.n AS n_1, c.n AS n_2, bit_count(xor(a.sig, c.sig))::BIGINT AS distance
      FROM bd a JOIN bd c ON a.split = c.split AND a.band = c.band AND a.key = c.key AND a.row < c.row),
cd AS (SELECT DISTINCT * FROM m WHERE distance <= 16)"""
INTERIM = f"""i AS (SELECT 'review_' || sha256('{{"dataset_name":"documents","dataset_revision":"r1","schema_version":"v1","source_id":"' || source_id || '","source_split":"' || source_split || '"}}') AS review_id,
  source_split, source_id, text AS source_text, {squeezed('text')} AS text, {', '.join(ASPECTS)} FROM r)"""
EXACT_EDGES = f"""k AS (SELECT i.review_id, source_split, sha256({norm('source_text')}) AS g FROM i),
ee AS (SELECT min(review_id) OVER (PARTITION BY source_split, g) AS a, review_id AS b FROM k)"""
REACH = """ed AS (SELECT a, b FROM al WHERE a <> b UNION SELECT b, a FROM al WHERE a <> b),
rc AS (SELECT review_id AS a, review_id AS b FROM i UNION SELECT rc.a, ed.b FROM rc JOIN ed ON rc.b = ed.a),
co AS (SELECT a AS review_id, min(b) AS root FROM rc GROUP BY a)"""
NATIVE = f"""{R}, {SIGNATURES}, {INTERIM}, {EXACT_EDGES},
ne AS (SELECT x.review_id AS a, y.review_id AS b FROM cd JOIN i x ON x.source_id = first_row JOIN i y ON y.source_id = second_row WHERE distance <= 3),
al AS (SELECT * FROM ee UNION SELECT * FROM ne), {REACH}"""
EXACT_ONLY = f"{R}, {INTERIM}, {EXACT_EDGES}, al AS (SELECT * FROM ee), {REACH}"
GROUPS = f"""gr AS (SELECT root, count(*) AS group_size, {any_of(0)} AS c, {any_of(1)} AS m, {listed(0)} AS cl, {listed(1)} AS ml,
  'group_' || sha256('{{"member_review_ids":["' || string_agg(review_id, '","' ORDER BY review_id) || '"],"schema_version":"v1"}}') AS group_id FROM i JOIN co USING (review_id) GROUP BY root)"""
GROUPED = f"{R}, {INTERIM}, eg AS (SELECT *, sha256(text) AS group_id FROM i)"


def order_key(c: str) -> str:
    return f"sha256('v1:42:' || {c})"


MERGED = f"""{GROUPED}, hu AS (SELECT *, ('0x' || substr({order_key('group_id')}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM eg),
mg AS (SELECT *, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM hu)"""
LEAKY = f"{GROUPED}, lk AS (SELECT *, CASE WHEN source_id % 3 = 0 THEN 'train' WHEN source_id % 3 = 1 THEN 'validation' ELSE 'test' END AS split FROM eg)"
FAULTY = f"""{MERGED}, fm AS (SELECT CASE WHEN source_id % 53 = 1 THEN 'x' || source_id ELSE review_id END AS review_id, CASE WHEN source_id % 59 = 2 THEN 'g' ELSE group_id END AS group_id,
  CASE WHEN source_id % 61 = 3 THEN 'dev' ELSE split END AS split FROM mg)"""
NEAR = f"""{R}, {SIGNATURES}, rr AS (SELECT *, {norm('text')} AS norm FROM r), tg AS (SELECT split, row, norm, list_distinct([substr(norm, j, 3) for j in range(1, length(norm) - 1)]) AS g FROM n),
tp AS (SELECT cd.split, distance, a.norm AS na, b.norm AS nb, least(length(a.norm), length(b.norm)) / greatest(length(a.norm), length(b.norm)) AS lr, len(list_intersect(a.g, b.g)) AS x, len(a.g) + len(b.g) AS y
  FROM cd JOIN tg a ON a.split = cd.split AND a.row = first_row JOIN tg b ON b.split = cd.split AND b.row = second_row),
rp AS (SELECT tp.split, distance, lr AS length_ratio, x / (y - x) AS jaccard, least(p.source_id, q.source_id) AS first_row, greatest(p.source_id, q.source_id) AS second_row,
  CASE WHEN p.source_id < q.source_id THEN na ELSE nb END AS n1, CASE WHEN p.source_id < q.source_id THEN nb ELSE na END AS n2,
  concat_ws('|', {', '.join(f"CASE WHEN p.{a} <> q.{a} THEN '{a}' END" for a in ASPECTS)}) AS conflicting, concat_ws('|', {', '.join(f"CASE WHEN (p.{a} IS NULL) <> (q.{a} IS NULL) THEN '{a}' END" for a in ASPECTS)}) AS mixed_missing
  FROM tp JOIN rr p ON p.source_split = tp.split AND p.norm = na JOIN rr q ON q.source_split = tp.split AND q.norm = nb WHERE lr >= 0.65 AND x / (y - x) >= 0.60),
ws AS (SELECT *, len(list_intersect(list_distinct(string_split(n1, ' ')), list_distinct(string_split(n2, ' ')))) / len(list_distinct(string_split(n1, ' '))) AS ratio FROM rp),
np AS (SELECT *, CASE WHEN jaccard >= 0.72 AND ratio >= 0.82 THEN 'high_confidence' WHEN ratio >= 0.75 THEN 'needs_review' END AS confidence FROM ws WHERE ratio >= 0.75)"""
CLUSTERS = """hp AS (SELECT split, first_row AS a, second_row AS b FROM np WHERE confidence = 'high_confidence'), he AS (SELECT split, a, b FROM hp UNION SELECT split, b, a FROM hp),
hr AS (SELECT split, a, a AS b FROM he UNION SELECT hr.split, hr.a, he.b FROM hr JOIN he ON hr.split = he.split AND hr.b = he.a),
mb AS (SELECT split, a AS row, min(b) AS root FROM hr GROUP BY split, a),
ec AS (SELECT np.split, root, count(*) AS edge_count, min(jaccard) AS min_jaccard, min(ratio) AS min_ratio FROM np JOIN mb ON mb.split = np.split AND mb.row = first_row WHERE confidence = 'high_confidence' GROUP BY ALL)"""
CLUSTER_ROWS = f"""cl AS (SELECT mb.split, root, sha256(string_agg(source_id::VARCHAR, '|' ORDER BY source_id)) AS cluster_id, count(*) AS member_count, {listed(0)} AS conflicting, {listed(1)} AS mixed_missing FROM mb JOIN r ON source_id = mb.row GROUP BY ALL)"""
GRID = "gd AS (SELECT s.split, c.aspect, c.label FROM (VALUES " + ", ".join(f"('{s}')" for s in SPLITS) + ") s(split), (VALUES " + ", ".join(f"('{a}', '{x}')" for a, x in CELLS) + ") c(aspect, label))"
CODES = f"""{R}, cs AS (SELECT source_id, text || CASE source_id % 9 WHEN 1 THEN ' AB-' || source_id WHEN 2 THEN ' ABC' WHEN 3 THEN ' 12-34' WHEN 4 THEN ' A1x' ELSE '' END AS text FROM r),
wd AS (SELECT source_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_-]+')) AS w FROM cs),
pt AS (SELECT source_id, w FROM wd WHERE regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[0-9]')),
pc AS (SELECT DISTINCT source_id FROM pt WHERE regexp_matches(w, '(^|-)[A-Z0-9]+(-[A-Z0-9]+)*(-|$)') AND regexp_matches(w, '^[A-Z0-9-]+$'))"""

ORACLES = {
    "validate_issue_counts": f"WITH {DIRTY} SELECT * FROM ({raw_issues()}) WHERE n > 0",
    "validate_issue_samples": f"""WITH {DIRTY}, h AS (SELECT source_split AS split, 'null_review' AS code, row_index FROM x WHERE text IS NULL
        UNION ALL SELECT source_split, 'empty_review', row_index FROM x WHERE text IS NOT NULL AND NOT regexp_matches(text, '{NOT_WS}')
        UNION ALL SELECT source_split, 'non_integer_label', row_index FROM x WHERE material % 1 <> 0),
      k AS (SELECT *, row_number() OVER (PARTITION BY split, code ORDER BY row_index) AS n FROM h)
      SELECT split, code, string_agg(row_index::VARCHAR, '|' ORDER BY row_index) AS sample_rows FROM k WHERE n <= 10 GROUP BY ALL""",
    "validate_status": f"""WITH {R}, d AS (SELECT source_split, source_id, text, {', '.join(ASPECTS)}, count(*) AS k FROM r GROUP BY ALL), t AS (SELECT source_split, text, count(*) AS k FROM r GROUP BY ALL),
      e AS ({union([f"SELECT source_split, '{a}' AS c FROM r WHERE {a} IS NULL GROUP BY source_split" for a in ASPECTS])}),
      w AS (SELECT DISTINCT source_split, 1 AS c FROM d WHERE k > 1 UNION ALL SELECT DISTINCT source_split, 2 FROM t WHERE k > 1)
      SELECT (SELECT count(*) FROM e) AS errors, (SELECT count(*) FROM w) AS warnings, (SELECT count(*) FROM e) = 0 AS valid""",
    "validate_duplicate_rows": "SELECT l_returnflag, sum(k)::BIGINT AS n FROM (SELECT l_returnflag, count(*) AS k FROM lineitem GROUP BY l_returnflag, l_linestatus, l_shipdate, l_quantity HAVING count(*) > 1) GROUP BY 1",
    "validate_duplicate_text": f"WITH {R} SELECT source_split, sum(k)::BIGINT AS n FROM (SELECT source_split, count(*) AS k FROM r GROUP BY source_split, text HAVING count(*) > 1) GROUP BY 1",
    "processed_contract": processed(),
    "label_rollup": f"WITH {DIRTY}, q AS ({raw_issues()}) SELECT coalesce(sum(n) FILTER (code = 'null_label'), 0)::BIGINT AS null_labels, coalesce(sum(n) FILTER (code IN ('non_integer_label', 'label_out_of_range')), 0)::BIGINT AS invalid_labels FROM q",
    "label_distribution": f"WITH {R}, q AS ("
    + union([f"SELECT source_split AS split, '{a}' AS aspect, '{x}' AS label, {cell(a, x)} AS count, count({a}) AS valid_count, count(*) AS total FROM r GROUP BY 1" for a, x in CELLS])
    + f") SELECT *, round(count / total, 6) AS proportion, CASE WHEN label = '{MISSING}' THEN NULL WHEN valid_count = 0 THEN 0.0 ELSE round(count / valid_count, 6) END AS proportion_among_valid FROM q",
    "label_missing": f"WITH {R}, q AS ("
    + union([f"SELECT source_split AS split, '{a}' AS aspect, count(*) AS total, count({a}) AS valid_count, count(*) - count({a}) AS missing_count, count(*) FILTER ({a} IN (1, 2, 3)) AS mentioned_count FROM r GROUP BY 1" for a in ASPECTS])
    + ") SELECT *, round(mentioned_count / total, 6) AS mentioned_proportion, CASE WHEN valid_count = 0 THEN 0.0 ELSE round(mentioned_count / valid_count, 6) END AS mentioned_among_valid FROM q",
    "mentioned_aspects": f"""WITH {R}, q AS (SELECT source_split AS split, {' + '.join(f'(coalesce({a}, 0) IN (1, 2, 3))::INT' for a in ASPECTS)} AS k, ({' OR '.join(f'{a} IS NULL' for a in ASPECTS)}) AS gap FROM r),
      t AS (SELECT split, count(*) AS n, avg(k) AS mean_mentioned, count(*) FILTER (gap) AS rows_with_missing FROM q GROUP BY 1)
      SELECT t.split, v.k AS mentioned, count(q.k) AS rows, round(count(q.k) / any_value(n), 6) AS proportion, round(any_value(mean_mentioned), 6) AS mean_mentioned, any_value(rows_with_missing) AS rows_with_missing
      FROM t CROSS JOIN (SELECT unnest(range(6))::INT AS k) v LEFT JOIN q ON q.split = t.split AND q.k = v.k GROUP BY 1, 2""",
    "text_availability": f"WITH {DIRTY} SELECT source_split AS split, count(*) AS total, count(*) - count(text) AS null_text, count(*) FILTER (text IS NOT NULL AND NOT regexp_matches(text, '{NOT_WS}')) AS empty_text, count(*) FILTER (regexp_matches(text, '{NOT_WS}')) AS profiled FROM x GROUP BY 1",
    "length_percentiles": f"WITH {R}, {lengths()}, {UNPIVOT} {percentiles()}",
    "length_fences": f"""WITH {R}, {lengths()}, {UNPIVOT}, q AS (SELECT split, metric, count(*) AS rows, min(value) AS minimum, max(value) AS maximum, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM u GROUP BY ALL),
      z AS (SELECT *, greatest(0.0, q1 - 1.5 * (q3 - q1)) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
      SELECT z.split, z.metric, rows, minimum, maximum, round(mean, 6) AS mean, round(q3 - q1, 6) AS iqr, round(lo, 6) AS lower_fence, round(hi, 6) AS upper_fence, round(sd, 6) AS standard_deviation, count(*) FILTER (value < lo) AS lower_outliers, count(*) FILTER (value > hi) AS upper_outliers
      FROM z JOIN u ON z.split = u.split AND z.metric = u.metric GROUP BY ALL""",
    "threshold_counts": f"""WITH {R}, {lengths()}, p AS (SELECT split, quantile_cont(characters, 0.99) AS pc, quantile_cont(tokens, 0.99) AS pt FROM s GROUP BY 1)
      SELECT s.split, count(*) FILTER (characters <= 10) AS short_characters, count(*) FILTER (tokens <= 3) AS short_tokens, count(*) FILTER (characters >= pc) AS long_characters, count(*) FILTER (tokens >= pt) AS long_tokens FROM s JOIN p USING (split) GROUP BY 1""",
    "longest_documents": f"WITH {R}, {lengths()}, k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY characters DESC, tokens DESC, row) AS rank FROM s) SELECT split, rank::INT AS rank, id, row, characters, tokens, lines, {preview('text')} AS preview FROM k WHERE rank <= 10",
    "pattern_signals": f"WITH {R}, {lengths()}, q AS ("
    + union([f"SELECT split, '{n}' AS pattern, {n_of('text', p)} AS k FROM s" for n, p in RE2.items()])
    + ") SELECT split, pattern, count(*) FILTER (k > 0) AS rows, round(count(*) FILTER (k > 0) / count(*), 6) AS proportion, sum(k)::BIGINT AS occurrences FROM q GROUP BY ALL",
    "conversation_lengths": f"WITH {lengths('conversations', 'role', 'conv_id', 'turn')}, {UNPIVOT} {percentiles()}",
    "exact_raw_summary": f"WITH {R}, g AS (SELECT source_split AS split, count(*) AS n FROM r GROUP BY source_split, text) SELECT split, count(*) AS unique_texts, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS members, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS redundant FROM g GROUP BY 1",
    "exact_norm_summary": f"""WITH {R}, g AS (SELECT source_split AS split, {norm('text')} AS k, count(*) AS n, count(DISTINCT text) AS variants, {any_of(0)} AS c, {any_of(1)} AS m FROM r GROUP BY 1, 2)
      SELECT split, count(*) AS unique_texts, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS members, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS redundant, count(*) FILTER (n > 1 AND variants > 1) AS merged_groups,
        count(*) FILTER (n > 1 AND c) AS conflict_groups, count(*) FILTER (n > 1 AND m) AS mixed_missing_groups, count(*) FILTER (n > 1 AND NOT c AND NOT m) AS consistent_groups FROM g GROUP BY 1""",
    "exact_groups": f"WITH {R} SELECT source_split AS split, sha256({norm('text')}) AS group_id, count(*) AS member_count, count(*) - 1 AS redundant, count(DISTINCT text) AS raw_variants, {listed(0)} AS conflicting, {listed(1)} AS mixed_missing, min(source_id) AS first_row FROM r GROUP BY 1, 2 HAVING count(*) > 1",
    "exact_members": f"WITH {R}, k AS (SELECT source_split AS split, sha256({norm('text')}) AS group_id, source_id FROM r) SELECT split, group_id, source_id AS row_no, source_id AS id FROM (SELECT *, count(*) OVER (PARTITION BY split, group_id) AS n FROM k) WHERE n > 1",
    "exact_label_conflicts": f"WITH {R}, k AS (SELECT *, {norm('text')} AS g FROM r), q AS ("
    + union([f"SELECT source_split AS split, '{a}' AS aspect FROM k GROUP BY source_split, g HAVING {both(a)[0]}" for a in ASPECTS])
    + ") SELECT split, aspect, count(*) AS groups FROM q GROUP BY ALL",
    "near_signatures": f"WITH {R}, {SIGNATURES} SELECT split, row AS row_no, n, CASE WHEN sig >= 9223372036854775808 THEN (sig::HUGEINT - 18446744073709551616)::BIGINT ELSE sig::BIGINT END AS sig FROM sg",
    "near_band_matches": f"WITH {R}, {SIGNATURES}, z AS (SELECT split, sum(n)::BIGINT AS m FROM bd GROUP BY split, band, key) SELECT split, sum(m * (m - 1) // 2)::BIGINT AS raw_matches FROM z GROUP BY 1",
    "near_candidates": f"WITH {R}, {SIGNATURES} SELECT split, first_row, second_row, n_1, n_2, distance FROM cd",
    "near_candidate_counts": f"WITH {R}, {SIGNATURES}, z AS (SELECT split, n_1 * n_2 AS w FROM cd UNION ALL SELECT split, n * (n - 1) // 2 FROM sg) SELECT split, sum(w)::BIGINT AS candidate_pairs FROM z GROUP BY 1",
    "near_jaccard": f"""WITH {R}, {SIGNATURES}, tg AS (SELECT split, row, norm, list_distinct([substr(norm, j, 3) for j in range(1, length(norm) - 1)]) AS g FROM n),
      p AS (SELECT cd.split, first_row, second_row, least(length(a.norm), length(b.norm)) / greatest(length(a.norm), length(b.norm)) AS lr, len(list_intersect(a.g, b.g)) AS x, len(a.g) + len(b.g) AS y
        FROM cd JOIN tg a ON a.split = cd.split AND a.row = first_row JOIN tg b ON b.split = cd.split AND b.row = second_row)
      SELECT split, first_row, second_row, round(lr, 6) AS length_ratio, round(x / (y - x), 6) AS jaccard FROM p WHERE lr >= 0.65 AND x / (y - x) >= 0.60""",
    "near_pairs_native": f"""WITH {NEAR} SELECT sha256(sha256(n1) || ':' || sha256(n2)) AS pair_id, split, first_row, second_row, first_row AS first_id, second_row AS second_id, distance, round(length_ratio, 6) AS length_ratio, round(jaccard, 6) AS jaccard, round(ratio, 6) AS sequence_ratio, confidence, conflicting, mixed_missing FROM np""",
    "near_clusters_native": f"""WITH RECURSIVE {NEAR}, {CLUSTERS}, {CLUSTER_ROWS} SELECT cluster_id, split, root AS first_row, member_count, edge_count, round(min_jaccard, 6) AS min_jaccard, round(min_ratio, 6) AS min_sequence_ratio, conflicting, mixed_missing FROM cl JOIN ec USING (split, root)""",
    "near_summary_native": f"""WITH RECURSIVE {NEAR}, {CLUSTERS}, {CLUSTER_ROWS}, t AS (SELECT source_split AS split, count(*) AS rows FROM r GROUP BY 1), e1 AS (SELECT split, sum(n)::BIGINT AS eligible FROM el GROUP BY 1),
      bm AS (SELECT split, sum(m * (m - 1) // 2)::BIGINT AS raw_matches FROM (SELECT split, sum(n)::BIGINT AS m FROM bd GROUP BY split, band, key) GROUP BY 1),
      cp AS (SELECT split, sum(w)::BIGINT AS candidate_pairs FROM (SELECT split, n_1 * n_2 AS w FROM cd UNION ALL SELECT split, n * (n - 1) // 2 FROM sg) GROUP BY 1),
      vp AS (SELECT split, count(*) AS verified_pairs, count(*) FILTER (confidence = 'high_confidence') AS high_pairs, count(*) FILTER (confidence = 'needs_review') AS review_pairs, count(*) FILTER (conflicting <> '') AS conflict_pairs FROM np GROUP BY 1),
      cs AS (SELECT split, count(*) AS clusters, count(*) FILTER (conflicting <> '') AS conflict_clusters, sum(member_count)::BIGINT AS clustered_rows FROM cl GROUP BY 1)
      SELECT t.split, rows, coalesce(eligible, 0) AS eligible, coalesce(raw_matches, 0) AS raw_matches, coalesce(candidate_pairs, 0) AS candidate_pairs, coalesce(verified_pairs, 0) AS verified_pairs, coalesce(high_pairs, 0) AS high_pairs, coalesce(review_pairs, 0) AS review_pairs, coalesce(conflict_pairs, 0) AS conflict_pairs,
        coalesce(clusters, 0) AS clusters, coalesce(conflict_clusters, 0) AS conflict_clusters, coalesce(clustered_rows, 0) AS clustered_rows, rows - coalesce(eligible, 0) AS excluded
      FROM t LEFT JOIN e1 USING (split) LEFT JOIN bm USING (split) LEFT JOIN cp USING (split) LEFT JOIN vp USING (split) LEFT JOIN cs USING (split)""",
    "split_check": f"WITH {LEAKY}, t AS (SELECT split, count(*) AS n FROM lk GROUP BY 1), q AS ("
    + union([f"SELECT split, '{a}' AS aspect, '{x}' AS label, {cell(a, x)} AS k FROM lk GROUP BY 1" for a, x in CELLS])
    + f"""), o AS (SELECT aspect, label, sum(k) / (SELECT count(*) FROM lk) AS a FROM q GROUP BY ALL),
      z AS (SELECT 'group_id_crosses_splits' AS code, count(*) AS n FROM (SELECT 1 FROM lk GROUP BY group_id HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'normalized_exact_duplicate_crosses_splits', count(*) FROM (SELECT 1 FROM lk GROUP BY {squeezed('text')} HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'label_distribution_drift_exceeds_tolerance', count(*) FROM q JOIN t USING (split) JOIN o USING (aspect, label) WHERE abs(q.k / t.n - o.a) > 0.02)
      SELECT code, n FROM z WHERE n > 0""",
    "table_metadata": """SELECT lang AS split, count(*) AS rows, sum(('0x' || substr(sha256(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), coalesce(text, chr(0)), coalesce(source, chr(0)), coalesce(n_chars::VARCHAR, chr(0)))), 1, 15))::BIGINT)::VARCHAR AS digest,
      'documents' AS dataset_name, 'r1' AS dataset_revision FROM documents GROUP BY 1""",
    "interim_projection": f"WITH {R}, {INTERIM} SELECT review_id, source_split, source_id, sha256(text) AS text_sha256, {', '.join(ASPECTS)} FROM i",
    "review_ids": f"WITH {R}, {INTERIM} SELECT source_id, review_id FROM i",
    "order_keys": f"WITH {R}, {INTERIM} SELECT review_id, {order_key('review_id')} AS order_key FROM i",
    "group_components": f"WITH RECURSIVE {NATIVE} SELECT review_id, root FROM co",
    "group_ids": f"""WITH RECURSIVE {NATIVE}, {GROUPS}, ev AS (SELECT a, 'exact' AS k FROM ee WHERE a <> b UNION SELECT a, 'high_confidence_near' FROM ne),
      er AS (SELECT root, string_agg(DISTINCT k, '|' ORDER BY k) AS evidence FROM ev JOIN co ON ev.a = co.review_id GROUP BY root)
      SELECT review_id, group_id, group_size, coalesce(evidence, '') AS evidence FROM co JOIN gr USING (root) LEFT JOIN er USING (root)""",
    "group_conflicts": f"WITH RECURSIVE {NATIVE}, {GROUPS} SELECT review_id, c AS group_has_label_conflict, m AS group_has_mixed_missing_labels, cl AS group_conflicting_label_columns, ml AS group_mixed_missing_label_columns FROM co JOIN gr USING (root) WHERE group_size > 1",
    "group_policy_flags": f"""WITH RECURSIVE {NATIVE}, {GROUPS}, q AS (SELECT sum(group_size) FILTER (c) AS bad, sum(group_size) AS n FROM gr)
      SELECT 'retain' AS policy, n::BIGINT AS retained, 0::BIGINT AS held, 0::BIGINT AS excluded FROM q UNION ALL SELECT 'exclude', (n - coalesce(bad, 0))::BIGINT, 0, coalesce(bad, 0)::BIGINT FROM q UNION ALL SELECT 'manual_review', (n - coalesce(bad, 0))::BIGINT, coalesce(bad, 0)::BIGINT, 0 FROM q""",
    "group_summary": f"WITH RECURSIVE {NATIVE}, {GROUPS} SELECT sum(group_size)::BIGINT AS rows, count(*) AS groups, count(*) FILTER (group_size > 1) AS multi_member_groups, count(*) FILTER (c) AS conflict_groups, count(*) FILTER (m) AS mixed_missing_groups, coalesce(sum(group_size) FILTER (c), 0)::BIGINT AS excluded_rows, 0::BIGINT AS manual_review_rows FROM gr",
    "preprocess_audit": f"""WITH RECURSIVE {EXACT_ONLY}, {GROUPS}, mc AS (SELECT sum({' + '.join(f'({a} IS NULL)::INT' for a in ASPECTS)})::BIGINT AS missing FROM i)
      SELECT sum(group_size)::BIGINT AS input_rows, coalesce(sum(group_size) FILTER (NOT c), 0)::BIGINT AS written_rows, coalesce(sum(group_size) FILTER (c), 0)::BIGINT AS removed_rows, 0::BIGINT AS held_rows, any_value(missing) AS missing_label_cells, count(*) AS groups, count(*) FILTER (group_size > 1) AS candidate_groups, count(*) FILTER (c OR m) AS noteworthy_groups FROM gr, mc""",
    "interim_table": f"""WITH RECURSIVE {EXACT_ONLY}, {GROUPS} SELECT review_id, group_id, source_split, source_id, {', '.join(ASPECTS)}, c AS group_has_label_conflict, cl AS group_conflicting_label_columns, m AS group_has_mixed_missing_labels, ml AS group_mixed_missing_label_columns,
      'manual_review' AS group_conflict_policy, NOT c AS retain_for_processing, c AS requires_manual_review FROM i JOIN co USING (review_id) JOIN gr USING (root)""",
    "hash_split": f"WITH {MERGED} SELECT review_id, group_id, split FROM mg",
    "split_summary": f"WITH {MERGED}, q AS (SELECT split, count(*) AS rows, count(DISTINCT group_id) AS groups FROM mg GROUP BY 1), s AS (SELECT v.split, coalesce(rows, 0) AS rows, coalesce(groups, 0) AS groups FROM (VALUES ('train'), ('validation'), ('test')) v(split) LEFT JOIN q USING (split)) SELECT *, round(rows / sum(rows) OVER (), 6) AS ratio FROM s",
    "split_labels": f"WITH {MERGED}, t AS (SELECT split, count(*) AS split_rows FROM mg GROUP BY 1), q AS (" + union([f"SELECT split, '{a}' AS aspect, '{x}' AS label, {cell(a, x)} AS count FROM mg GROUP BY 1" for a, x in CELLS]) + ") SELECT split, split_rows, aspect, label, count FROM q JOIN t USING (split)",
    "split_drift": f"WITH {MERGED}, {GRID}, t AS (SELECT split, count(*) AS n FROM mg GROUP BY 1), q AS ("
    + union([f"SELECT split, '{a}' AS aspect, '{x}' AS label, {cell(a, x)} AS k FROM mg GROUP BY 1" for a, x in CELLS])
    + """), o AS (SELECT aspect, label, sum(k) AS k FROM q GROUP BY ALL), z AS (SELECT gd.split, gd.aspect, gd.label, coalesce(q.k, 0) AS count, coalesce(q.k / t.n, 0.0) AS p, o.k / (SELECT count(*) FROM mg) AS a
        FROM gd LEFT JOIN q USING (split, aspect, label) LEFT JOIN t USING (split) JOIN o USING (aspect, label))
      SELECT split, aspect, label, count, round(p, 6) AS proportion, round(a, 6) AS overall_proportion, round(abs(p - a), 6) AS drift, abs(p - a) > 0.01 AS violation FROM z""",
    "group_leakage": f"WITH {LEAKY} SELECT group_id, count(DISTINCT split) AS splits, count(*) AS rows, string_agg(DISTINCT split, '|' ORDER BY split) AS split_names FROM lk GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "text_leakage": f"WITH {LEAKY} SELECT sha256({squeezed('text')}) AS text_sha256, count(DISTINCT split) AS splits, count(*) AS rows FROM lk GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "split_contract_issues": f"""WITH {FAULTY}, q AS (SELECT 'duplicate_split_review_id' AS code, coalesce(sum(k), 0)::BIGINT AS n FROM (SELECT count(*) AS k FROM fm GROUP BY review_id HAVING count(*) > 1)
      UNION ALL SELECT 'invalid_split_name', count(*) FROM fm WHERE split NOT IN ('train', 'validation', 'test')
      UNION ALL SELECT 'missing_split_review_id', count(*) FROM eg WHERE review_id NOT IN (SELECT review_id FROM fm)
      UNION ALL SELECT 'unknown_split_review_id', count(*) FROM fm WHERE review_id NOT IN (SELECT review_id FROM eg)
      UNION ALL SELECT 'split_group_id_mismatch', count(*) FROM eg JOIN fm USING (review_id) WHERE eg.group_id <> fm.group_id)
      SELECT * FROM q WHERE n > 0""",
    "missing_split_ids": f"WITH {FAULTY} SELECT review_id FROM eg WHERE review_id NOT IN (SELECT review_id FROM fm)",
    "median_sample": f"WITH {R}, q AS ("
    + union([f"SELECT '{a}' AS aspect, {a} AS label, source_id AS id, length(text)::BIGINT AS characters, text FROM r WHERE {a} IS NOT NULL" for a in ASPECTS])
    + f"), md AS (SELECT aspect, label, median(characters) AS md FROM q GROUP BY ALL), k AS (SELECT q.*, row_number() OVER (PARTITION BY aspect, label ORDER BY abs(characters - md), id) AS n FROM q JOIN md USING (aspect, label)) SELECT aspect, label, id, characters, {preview('text', 180, True)} AS preview FROM k WHERE n = 1",
    "mixed_sentiment_samples": f"""WITH {R}, q AS (SELECT *, [v for v in [{', '.join(ASPECTS)}] if v IN (1, 2, 3)] AS said FROM r)
      SELECT source_id AS id, len(said)::BIGINT AS mentioned, len(list_distinct(said))::BIGINT AS variety, {', '.join(ASPECTS)}, {preview('text', 180, True)} AS preview FROM q WHERE len(said) >= 3 AND len(list_distinct(said)) >= 2 ORDER BY mentioned DESC, variety DESC, id LIMIT 5""",
    "product_code_rows": f"WITH {CODES} SELECT source_id FROM pc",
    "product_code_samples": f"WITH {CODES} SELECT source_id AS id, {preview('text', 180, True)} AS preview FROM cs JOIN pc USING (source_id) ORDER BY source_id LIMIT 10",
    "class_balance": f"WITH {R}, q AS ("
    + union([f"SELECT source_split AS split, '{a}' AS aspect, {x} AS label, {cell(a, x)} AS k FROM r GROUP BY 1" for a, x in CELLS if x != MISSING])
    + "), z AS (SELECT *, row_number() OVER (PARTITION BY split, aspect ORDER BY k DESC, label) AS n, min(k) FILTER (k > 0) OVER (PARTITION BY split, aspect) AS lo FROM q) SELECT split, aspect, label::INT AS dominant_label, k AS dominant_count, round(k / lo, 6) AS imbalance FROM z WHERE n = 1",
    "length_histogram": f"""WITH {R}, {lengths()}, u AS (SELECT split, 'characters' AS metric, characters AS value FROM s UNION ALL SELECT split, 'tokens', tokens FROM s),
      p AS (SELECT split, metric, quantile_cont(value, 0.99) AS p FROM u GROUP BY ALL), k AS (SELECT u.* FROM u JOIN p USING (split, metric) WHERE value <= p), e AS (SELECT split, metric, min(value) AS lo, max(value) AS hi, greatest(max(value) - min(value), 1) AS w FROM k GROUP BY ALL),
      c AS (SELECT k.split, k.metric, least(((value - lo) * 50) // w, 49)::INT AS bin, count(*) AS n FROM k JOIN e USING (split, metric) GROUP BY ALL)
      SELECT e.split, e.metric, b.bin, round(lo + b.bin * (w / 50), 6) AS low, round(lo + (b.bin + 1) * (w / 50), 6) AS high, coalesce(n, 0) AS n FROM e CROSS JOIN (SELECT unnest(range(50))::INT AS bin) b LEFT JOIN c ON c.split = e.split AND c.metric = e.metric AND c.bin = b.bin""",
    "label_chart": f"WITH {R}, q AS (" + union([f"SELECT source_split AS split, '{a}' AS aspect, '{x}' AS label, {cell(a, x)} AS k, count({a}) AS n FROM r GROUP BY 1" for a, x in CELLS if x != MISSING]) + ") SELECT split, aspect, label, CASE WHEN n = 0 THEN 0.0 ELSE round(k / n, 6) END AS proportion FROM q",
    "even_sample": "WITH c AS (SELECT count(*) AS n FROM documents), w AS (SELECT DISTINCT CASE WHEN 37 >= n THEN NULL ELSE least(floor(i * (n / 37::DOUBLE))::BIGINT, n - 1) END AS doc_id FROM c, (SELECT unnest(range(37)) AS i)) SELECT doc_id AS source_id FROM documents, c WHERE 37 >= n OR doc_id IN (SELECT doc_id FROM w)",
}
