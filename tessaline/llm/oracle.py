"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

import string

from tessaline.llm.licenses import BLOCK, PHRASES, STEP, TEMPLATES, needed

LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def license_sql(threshold: float = 0.8) -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    starts = []
    for phrase in PHRASES:
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"list_filter(range(0, greatest(len(w) - {len(parts) - 1}, 0)), lambda i: {same})")
    shares = []
    for _, template in TEMPLATES:
        ws = sorted(set(template.split()))
        shares.append((needed(len(ws), threshold), len(ws), f"list_max(list_transform(blocks, lambda b: len(list_intersect({quoted(ws)}, b))))"))
    text = LOWER.format("coalesce(text, '')")
    words = f"list_filter(regexp_split_to_array({text}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    p_cols = ", ".join(f"{s} AS p{i}" for i, s in enumerate(starts))
    t_cols = ", ".join(f"{e} AS c{i}" for i, (_, _, e) in enumerate(shares))
    own = "[" + ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values())) + "]"
    more = "[" + ", ".join(f"CASE WHEN c{i} >= {need} THEN '{label}' END" for i, ((label, _), (need, _, _)) in enumerate(zip(TEMPLATES, shares, strict=True))) + "]"
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({x}, lambda v: v IS NOT NULL))), ','), '')"
    best = "greatest(" + ", ".join(f"CASE WHEN c{i} >= {need} THEN c{i} / {m}::DOUBLE ELSE 0 END" for i, (need, m, _) in enumerate(shares)) + ")"
    every = " || ".join(f"p{i}" for i in range(len(starts)))
    return f"""
SELECT doc_id, len(w)::BIGINT AS n_words, len(s)::BIGINT AS n_base, list_min(s)::BIGINT AS first_word, list_max(s)::BIGINT AS last_word,
  {joined(own)} AS base_labels, {joined(f"list_concat({own}, {more})")} AS labels, CASE WHEN len(s) > 0 THEN 1e0 ELSE {best} END AS score
FROM (SELECT *, {every} AS s FROM (SELECT doc_id, w, {p_cols}, {t_cols} FROM (
  SELECT *, list_transform(range(0, greatest(ceil((len(w) - {BLOCK}) / {STEP}e0), 0)::BIGINT + 1), lambda k: w[k * {STEP} + 1 : k * {STEP} + {BLOCK}]) AS blocks
  FROM (SELECT doc_id, {words} AS w FROM documents))))"""


def url_sql(rules: list[tuple[str, str, str]]) -> str:
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    name = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    host = LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
    return f"""
SELECT page_id, host, path, CASE {name} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict
FROM (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)"""


def mix_sql(cap: int = 3, seed: int = 9) -> str:
    return f"""
WITH d AS (SELECT d.doc_id, d.source, d.size, coalesce(l.weight, 1) AS weight,
    (('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || size), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656e0 AS u
  FROM (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents) d LEFT JOIN (SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 2.0 ELSE 0.5 END AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) l ON d.doc_id = l.doc_id),
s AS (SELECT *, source_size * {cap}::DOUBLE AS most FROM (SELECT source, source_size, [1e0, 2e0, 3e0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source))),
v AS (SELECT *, row_number() OVER (ORDER BY most / w, source IS NULL, source) AS turn, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least((SELECT arg_min(level, turn) FROM v WHERE level * w < most) * w, most), most) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget, sum(d.size) OVER (PARTITION BY e.source ORDER BY -ln(d.u) / d.weight, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (least(epochs + CASE WHEN reach <= budget OR reach - budget <= budget - (reach - size) THEN 1 ELSE 0 END, {cap}) * size)::BIGINT AS taken FROM r"""


def middle_sql(percent: int = 100, spm_percent: int = 50, seed: int = 7) -> str:
    draw = lambda k: f"('0x' || substr(h, {8 * k - 7}, 8))::BIGINT"
    joined = lambda x: f"coalesce(array_to_string({x}, ''), '')"
    marked = " OR ".join(f"contains(t, '{m}')" for m in ("<P>", "<S>", "<M>"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l, sha256('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
c AS (SELECT *, len(l)::BIGINT AS n, least({draw(1)} % (len(l) + 1), {draw(2)} % (len(l) + 1)) AS a, greatest({draw(1)} % (len(l) + 1), {draw(2)} % (len(l) + 1)) AS b,
  CASE WHEN t = '' OR {marked} OR {draw(3)} % 100 >= {percent} THEN 'plain' WHEN {draw(4)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, {joined("l[1:a]")} AS prefix, {joined("l[a + 1:b]")} AS middle, {joined("l[b + 1:n]")} AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
