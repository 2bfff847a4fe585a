"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from quillsift.llm.chat import op5_chat_formatting
from quillsift.llm.hyperplanes import op9_embedding_near_dedup
from quillsift.llm.lengths import op4_token_counts
from quillsift.llm.licenses import op1_license_scans
from quillsift.llm.mixing import op10_mix_sources
from quillsift.llm.packing import op7_best_fit_packing
from quillsift.llm.quality import op2_quality_classifier
from quillsift.llm.simhash import op3_simhash_near_dedup
from quillsift.llm.sketches import op8_document_fingerprints
from quillsift.llm.urls import op6_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans, op2_quality_classifier, op3_simhash_near_dedup, op4_token_counts, op5_chat_formatting, op6_url_filters,
        op7_best_fit_packing, op8_document_fingerprints, op9_embedding_near_dedup, op10_mix_sources,
    )
}

#: op5: the turns and replies themselves; what is formatted is each prefix that ends in a reply, and a last one without.
CHAT_SQL = r"""WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (SELECT *, 12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11 AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM said),
upto AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN prefix ELSE 0 END) AS BIGINT) AS formatted_chars FROM upto GROUP BY conv_id"""
#: op9: all pairs of one label, and the smallest id over links, followed to the end.
VECTOR_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND list_dot_product(x, x) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b AS node, r.root FROM reach r JOIN links l ON l.a = r.node),
found AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT f.node AS vec_id, coalesce(n.n, 0) AS n_links, f.component_id, f.node = f.component_id AS kept FROM found f LEFT JOIN n ON n.a = f.node"""
#: op10: targets by the order in which sources fill up, then documents in order of their hash.
MIX_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(source, '') || chr(31) || coalesce(text, '')), 1, 15) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, place, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2.0 * CAST(source_size AS DOUBLE) AS most FROM s),
b AS (SELECT least(1.5 * CAST(sum(source_size) AS DOUBLE), sum(most)) AS budget FROM w),
r AS (SELECT weight, most, most / weight AS full_at, row_number() OVER (ORDER BY most / weight, source_size, place) AS k FROM w),
f AS (SELECT k, full_at, (budget - (sum(most) OVER (ORDER BY k) - most)) / (sum(weight) OVER () - sum(weight) OVER (ORDER BY k) + weight) AS level FROM r, b),
l AS (SELECT arg_min(level, k) FILTER (level < full_at) AS level FROM f),
t AS (SELECT w.source, w.source_size, CASE WHEN l.level IS NULL OR l.level * w.weight >= w.most THEN w.most ELSE l.level * w.weight END AS target FROM w, l),
u AS (SELECT t.*, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
o AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.base, u.target - u.base * u.source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
CAST(size * least(2, base + CASE WHEN upto <= rest OR (upto - size <= rest AND 2 * (rest - upto + size) >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o"""
SQL: dict[str, str] = {"op10_mix_sources": MIX_SQL, "op5_chat_formatting": CHAT_SQL, "op9_embedding_near_dedup": VECTOR_SQL}
