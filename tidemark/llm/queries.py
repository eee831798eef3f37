"""Registered queries of the corpus operators, with their SQL where there is one."""

from __future__ import annotations

from itertools import permutations

from . import audit, licenses, mixing
from .audit import op13_filter_audit
from .bpe import op11_bpe
from .decontam import op8_decontamination
from .langid import op9_language_id
from .licenses import op2_licenses
from .mixing import op4_mixing
from .pii import op5_pii
from .quality import op7_quality
from .simhash import op10_simhash
from .substring import op3_substring_dedup
from .tokens import op6_token_counts
from .toxicity import op1_toxicity
from .whitening import op12_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_licenses, op3_substring_dedup, op4_mixing, op5_pii, op6_token_counts, op7_quality, op8_decontamination, op9_language_id, op10_simhash,
        op11_bpe, op12_whitening, op13_filter_audit,
    )
}  # fmt: skip


def _templates() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()  # noqa: E731
    rows = ", ".join(f"({', '.join(map(text, row))})" for row in licenses.grams())
    return f"(VALUES {rows}) AS t(template, label, kind, at_, n, k, drift, must, w0, w1, w2, w3)"


_LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}') AS w FROM documents),
g AS (SELECT rid, i - 1 AS i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, w[i + 3] AS e FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w)))) AS i FROM d)),
v AS (SELECT *, i - at_ AS diagonal FROM g JOIN {_templates()} ON a = w0 AND b = w1 AND (w2 IS NULL OR c = w2) AND (w3 IS NULL OR e = w3)),
s AS (SELECT *, unnest(range(diagonal - drift, diagonal + 1)) AS start FROM v),
o AS (SELECT rid, template, start FROM s WHERE diagonal = start GROUP BY ALL),
m AS (SELECT rid, template, label, kind, n, k, start, at_, must, min(i) AS i FROM s SEMI JOIN o USING (rid, template, start) GROUP BY ALL),
x AS (SELECT * FROM m QUALIFY coalesce(i > max(i) OVER (PARTITION BY rid, template, start ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)),
y AS (SELECT *, least(k, coalesce(at_ - lag(at_) OVER (PARTITION BY rid, template, start ORDER BY at_), k)) AS fresh FROM x),
r AS (SELECT rid, template, label, kind, n, start, sum(fresh) / CAST(n AS DOUBLE) AS share, bool_or(must) AS must FROM y GROUP BY rid, template, label, kind, n, start),
f AS (SELECT * FROM r WHERE CASE WHEN kind = 'notice' THEN share >= {licenses.SHARE} AND must ELSE share = 1 END),
q AS (SELECT * FROM f QUALIFY kind <> 'short' OR coalesce(max(start + n) OVER (PARTITION BY rid, kind ORDER BY start, n DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < start + n)
SELECT d.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE kind = 'base') AS n_base, CAST(min(start) FILTER (WHERE kind = 'base') AS BIGINT) AS first_word,
  CAST(max(start) FILTER (WHERE kind = 'base') AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE kind = 'base')), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels, coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN q USING (rid) GROUP BY d.rid, d.doc_id"""

_MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS place FROM documents),
u AS (SELECT *, size * copies AS words FROM (SELECT doc_id, source, size, place, count(*) AS copies FROM d GROUP BY ALL)),
p AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w, 2.0::DOUBLE * source_size AS cap
  FROM (SELECT source, sum(words) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM u GROUP BY source)),
q AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
  sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM p),
v AS (SELECT *, first_value((total - full_) / rest_w) OVER (ORDER BY CASE WHEN (total - full_) / rest_w * w <= cap THEN 0 ELSE 1 END, cap / w, rk) AS level FROM q),
t AS (SELECT source, rk, CAST(source_size AS BIGINT) AS source_size, least(cap, level * w) AS target FROM v),
b AS (SELECT CAST(floor(least(1.5::DOUBLE * sum(source_size), sum(cap))) AS BIGINT) AS budget FROM p),
c AS (SELECT u.*, t.rk, t.source_size, t.target, CAST(ceil(t.target / {mixing.PACKETS}) AS BIGINT) AS packet,
  coalesce(sum(words) OVER (PARTITION BY u.source ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
i AS (SELECT *, begin_ + pass * source_size AS at_, unnest(range(CAST(ceil(words / packet) AS BIGINT))) AS slice FROM c CROSS JOIN (VALUES (0), (1)) AS x(pass) WHERE words > 0 AND target > 0),
k AS (SELECT *, least(packet, words - slice * packet) AS n_words, (at_ + slice * packet + least(packet, words - slice * packet)) / target AS vf FROM i),
o AS (SELECT *, coalesce(sum(n_words) OVER (ORDER BY vf, rk, place, doc_id NULLS FIRST, pass, slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mix_start FROM k),
g AS (SELECT doc_id, source, size, place, sum(least(n_words, budget - mix_start)) AS taken, min(mix_start) AS first_start FROM o CROSS JOIN b WHERE mix_start < budget GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(words_ // copies + CASE WHEN copy < words_ % copies THEN 1 ELSE 0 END AS BIGINT) AS taken, CAST(first_start AS BIGINT) AS first_start
FROM (SELECT c.doc_id, c.size, c.source_size, c.target, c.copies, coalesce(g.taken, 0) AS words_, g.first_start, unnest(range(c.copies)) AS copy
  FROM c LEFT JOIN g ON c.doc_id IS NOT DISTINCT FROM g.doc_id AND c.source IS NOT DISTINCT FROM g.source AND c.size = g.size AND c.place = g.place)"""


def _steps() -> str:
    """Every order and step: its filter's bit and the bits of those before it."""
    rows = []
    for order in permutations(audit.FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            own = 1 << audit.FILTERS.index(f)
            rows.append(f"('{''.join(order)}', {step}, {own}, {before})")
            before |= own
    return f"(VALUES {', '.join(rows)}) AS s(filter_order, step, own, before)"


_AUDIT = rf"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
f AS (SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), d.doc_id IS NULL AND min(d.doc_id) OVER (PARTITION BY t) IS NOT NULL) THEN 16 ELSE 0 END AS bits
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f GROUP BY ALL),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE bits & (before | own) = 0) AS kept, sum(n) FILTER (WHERE bits & own > 0 AND bits & before = 0) AS removed,
  sum(n) FILTER (WHERE bits & own > 0 AND bits & before > 0) AS redundant, sum(n) FILTER (WHERE bits = own) AS unique_fails,
  sum(g) FILTER (WHERE bits & own > 0 AND bits & before = 0) AS good_lost, sum(x) FILTER (WHERE bits & own > 0 AND bits & before = 0) AS toxic_lost
  FROM c CROSS JOIN {_steps()} GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in audit.REPORT[:-1])},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r"""

ORACLE: dict[str, str] = {"op2_licenses": _LICENSES, "op4_mixing": _MIXING, "op13_filter_audit": _AUDIT}
