"""The same queries as SQL, for DuckDB over the given tables."""

from __future__ import annotations

import re

from quillsift.functions import vocabulary as V
from quillsift.plans.queries import FIXED_WEIGHTS, SEARCHES

SQL: dict[str, str] = {}


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def rows(values: list[tuple], names: str, kinds: str) -> str:
    """A table of constants, also of none."""
    cast = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names.split(), kinds.split(), strict=True))
    body = ", ".join("(" + ", ".join(text(v) if isinstance(v, str) or v is None else str(v) for v in r) + ")" for r in values)
    empty = ", ".join("NULL" for _ in names.split())
    return f"(SELECT {cast} FROM (VALUES {body or f'({empty})'}) t({', '.join(names.split())}){'' if body else ' WHERE false'})"


def tokens(value: str, most: int | None = None, stop: tuple[str, ...] = (), least: int = 1) -> list[str]:
    return list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", value.lower()) if len(t) >= least and t not in stop))[:most]


def words(column: str) -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+')"


TERMS = rows([(q, t) for q, said, *_ in SEARCHES for t in tokens(said, 40, V.QUERY_STOPWORDS, 2)], "query_id term", "BIGINT VARCHAR")
SLOTS = rows([(q, a, v, conf.get(a, -1.0), turns.get(a, 1), turn) for q, _, slots, conf, turns, _, _, _, turn, _ in SEARCHES for a, v in slots.items()], "query_id attribute value confidence slot_turn turn", "BIGINT VARCHAR VARCHAR DOUBLE BIGINT BIGINT")
AGAINST = rows([(q, a, v) for q, _, _, _, _, negative, *_ in SEARCHES for a, vs in negative.items() for v in vs], "query_id attribute value", "BIGINT VARCHAR VARCHAR")
def expanded(tags: list[str]) -> list[str]:
    own = tokens(" ".join(tags))
    return list(dict.fromkeys([*own, *(w for o in own for w in V.PROFILE_SYNONYMS.get(o, ()))]))


TAGS = rows([(q, t) for q, *_, tags, _, _ in SEARCHES for t in expanded(tags)], "query_id tag", "BIGINT VARCHAR")
STATE = rows([(q, len(slots), slots.get("category"), slots.get("budget"), track) for q, _, slots, *_, track in SEARCHES], "query_id n_slots category budget track", "BIGINT BIGINT VARCHAR VARCHAR VARCHAR")

PROD = "prod AS (SELECT p_partkey AS doc_id, coalesce(p_name, '') AS title, coalesce(p_type, '') AS categories, coalesce(p_brand, '') AS store, p_retailprice AS price FROM part)"


def bm25(docs: str, fields: dict[str, float], terms: str, weights: str | None = None) -> str:
    """CTEs up to scored(query_id, doc_id, score). weights: a table query_id, field, weight instead of fixed numbers."""
    union = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, unnest({words(f)}) AS term FROM {docs}" for f in fields)
    fixed = ", ".join(f"('{f}', {w})" for f, w in fields.items())
    weight = weights or f"(SELECT q.query_id, w.field, CAST(w.weight AS DOUBLE) AS weight FROM (SELECT DISTINCT query_id FROM {terms}) q CROSS JOIN (VALUES {fixed}) w(field, weight))"
    return f"""tok AS ({union}),
    lens AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id),
    corpus AS (SELECT (SELECT count(*) FROM {docs}) AS n, (SELECT sum(len) FROM lens) * 1.0 / (SELECT count(*) FROM {docs}) AS avg_len),
    tf AS (SELECT term, doc_id, field, count(*) AS tf FROM tok GROUP BY term, doc_id, field),
    df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term),
    wanted AS (SELECT query_id, term FROM {terms}),
    weights AS (SELECT * FROM {weight}),
    hits AS (SELECT q.query_id, t.doc_id, t.term, sum(w.weight * t.tf) AS f FROM wanted q JOIN tf t ON t.term = q.term JOIN weights w ON w.query_id = q.query_id AND w.field = t.field GROUP BY q.query_id, t.doc_id, t.term),
    scored AS (SELECT h.query_id, h.doc_id, round(sum(CASE WHEN ln((c.n - d.df + 0.5) / (d.df + 0.5)) > 0 THEN ln((c.n - d.df + 0.5) / (d.df + 0.5)) ELSE {V.IDF_FLOOR} END * h.f * 2.2 / (h.f + 1.2 * (0.25 + 0.75 * l.len / c.avg_len))), 9) AS score
      FROM hits h JOIN df d ON d.term = h.term JOIN lens l ON l.doc_id = h.doc_id CROSS JOIN corpus c GROUP BY h.query_id, h.doc_id)"""


def ranked(source: str, most: int, name: str = "ranked", order: str = "score DESC, doc_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) - 1 AS rank FROM {source}) r WHERE rank < {most})"


PART_FIELDS = {"title": 6.0, "categories": 4.0, "store": 1.5}
PART_BM25 = f"{PROD}, {bm25('prod', PART_FIELDS, TERMS)}"
SHOWN = "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked"


def pool(most: int) -> str:
    return f"{PART_BM25}, {ranked('scored', most, 'pool')}"


SQL["bm25_part_topk"] = f"WITH {PART_BM25}, {ranked('scored', 10)} {SHOWN}"

STOP = "(" + ", ".join(map(text, V.QUERY_STOPWORDS)) + ")"


def first_terms(source: str, key: str, column: str) -> str:
    """key columns, term, place: distinct terms in order of first occurrence."""
    return f"""(SELECT {key}, term, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS place FROM (
      SELECT {key}, term, min(pos) AS pos FROM (SELECT {key}, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT {key}, {words(column)} AS w FROM {source})) x
      WHERE length(term) > 1 AND term NOT IN {STOP} GROUP BY {key}, term) y)"""


DOC_TERMS = f"(SELECT item_id AS query_id, term FROM {first_terms('benchmark', 'item_id', 'text')} WHERE place <= 40)"
DOC_BM25 = f"docs AS (SELECT doc_id, text, source, lang FROM documents), {bm25('docs', {'text': 6.0, 'source': 1.5, 'lang': 1.0}, DOC_TERMS)}"
SQL["bm25_docs_topk"] = f"WITH {DOC_BM25}, {ranked('scored', 10)} {SHOWN}"
SQL["index_term_stats"] = f"""WITH {PROD}, tok AS ({" UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, unnest({words(f)}) AS term FROM prod" for f in PART_FIELDS)})
SELECT term, count(DISTINCT doc_id) AS df, {", ".join(f"count(CASE WHEN field = '{f}' THEN 1 END) AS tf_{f}" for f in PART_FIELDS)} FROM tok GROUP BY term"""


def session_weights(slots: dict, confidence: dict) -> dict[str, float]:
    c = {a: confidence.get(a, 0.75) if slots.get(a) else 0.0 for a in ("category", "brand", "material", "color", "size", "style", "use_case", "feature")}
    return {"title": 6.0 * (1 + 0.65 * (0.25 * c["category"] + 0.15 * c["brand"])), "categories": 4.0 * (1 + 0.65 * c["category"]), "store": 1.5 * (1 + 0.65 * c["brand"])}


DYNAMIC = rows([(q, f, w) for q, _, slots, conf, *_ in SEARCHES for f, w in session_weights(slots, conf).items()], "query_id field weight", "BIGINT VARCHAR DOUBLE")
DYNAMIC_BM25 = f"{PROD}, {bm25('prod', PART_FIELDS, TERMS, DYNAMIC)}"
SQL["bm25_dynamic_weights"] = f"WITH {DYNAMIC_BM25}, {ranked('scored', 10)} {SHOWN}"
SQL["bm25_conjunctive"] = f"""WITH {PROD}, tok AS ({" UNION ALL ".join(f"SELECT doc_id, unnest({words(f)}) AS term FROM prod" for f in PART_FIELDS)}),
q AS (SELECT * FROM {rows([(q, t) for q, said, *_ in SEARCHES for t in tokens(said, 6, V.QUERY_STOPWORDS, 2)], "query_id term", "BIGINT VARCHAR")} x), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id HAVING count(*) >= 2)
SELECT q.query_id, t.doc_id FROM q JOIN tok t ON t.term = q.term JOIN n ON n.query_id = q.query_id GROUP BY q.query_id, t.doc_id, n.n HAVING count(DISTINCT t.term) = n.n"""
SQL["clean_query_terms"] = f"""SELECT c.conv_id, c.turn, coalesce(t.terms, '') AS terms, coalesce(t.n, 0) AS n_terms FROM conversations c LEFT JOIN
(SELECT conv_id, turn, string_agg(term, ' ' ORDER BY place) AS terms, count(*) AS n FROM {first_terms('conversations', 'conv_id, turn', 'text')} WHERE place <= 40 GROUP BY conv_id, turn) t ON t.conv_id = c.conv_id AND t.turn = c.turn"""
SQL["match_expressions"] = f"""SELECT b.item_id, coalesce(t.e, '') AS expression FROM benchmark b LEFT JOIN
(SELECT item_id, string_agg('"' || term || '"', ' OR ' ORDER BY place) AS e FROM {first_terms('benchmark', 'item_id', 'text')} WHERE place <= 40 GROUP BY item_id) t ON t.item_id = b.item_id"""
ALL_TEXT = "concat_ws(' ', p_name, p_type, p_brand)"
DIVERSE = "(" + ", ".join(map(text, V.DIVERSITY_STOPWORDS)) + ")"
SQL["token_sets"] = f"""SELECT p.p_partkey, count(DISTINCT CASE WHEN length(t) > 1 AND t NOT IN {DIVERSE} THEN t END) AS diversity, count(DISTINCT CASE WHEN length(t) > 1 THEN t END) AS value, count(DISTINCT t) AS profile
FROM part p LEFT JOIN (SELECT p_partkey, unnest({words(ALL_TEXT)}) AS t FROM part) x ON x.p_partkey = p.p_partkey GROUP BY p.p_partkey"""


#: Before and after a word; \\b would not see letters beyond ASCII.
BEFORE, AFTER = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"


def named(attribute: str, column: str) -> str:
    return f"nullif(lower(regexp_extract({column}, '(?i){BEFORE}({V.CATALOG_VALUES[attribute]}){AFTER}', 1)), '')"


def sized(column: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({column}, '(?i){BEFORE}{p[2:-2]}{AFTER}', 1), '')" for p in V.SIZE_PATTERNS) + ")"


def bucket(column: str) -> str:
    return f"CASE WHEN {column} < 20 THEN '<$20' WHEN {column} < 50 THEN '$20-$50' WHEN {column} < 100 THEN '$50-$100' WHEN {column} IS NOT NULL THEN '>$100' END"


def attributes(searchable: str, features: str, price: str) -> str:
    return f"{named('material', searchable)} AS material, {named('color', searchable)} AS color, {sized(searchable)} AS size, {named('style', searchable)} AS style, {named('use_case', searchable)} AS use_case, {named('feature', features)} AS feature, {bucket(price)} AS budget"


SQL["catalog_attrs"] = f"SELECT p_partkey AS doc_id, {attributes('p_name', text(''), 'p_retailprice')} FROM part"
SQL["attributes_of_text"] = f"SELECT doc_id, {attributes(chr(116) + 'ext', 'text', 'CAST(n_chars AS DOUBLE) / 100')} FROM documents"
IDENTITY, DESCRIBED = "concat_ws('. ', nullif(p_name, ''), nullif(p_type, ''), nullif(p_brand, ''))", "substr(concat_ws('. ', nullif(p_brand, ''), 'size ' || p_size, nullif(p_type, '')), 1, 1200)"
SQL["product_texts"] = f"SELECT p_partkey, substr(p_name, 1, 120) AS title120, {IDENTITY} AS identity, {DESCRIBED} AS attribute, concat_ws('. ', {IDENTITY}, substr({DESCRIBED}, 1, 300)) AS \"both\" FROM part"
SQL["budget_bucket_counts"] = f"SELECT {bucket('value')} AS bucket, count(*) AS n FROM events GROUP BY 1"
SQL["parsed_numbers"] = "SELECT event_id, CASE WHEN event_id % 7 > 2 THEN round(value, 2) END AS price, CASE WHEN event_id % 7 > 2 THEN CAST(trunc(round(value, 2)) AS BIGINT) END AS count FROM events"


def slot_filtered(source: str) -> str:
    """CTE kept: rows of source (query_id, doc_id, rank, ...) that fit category and budget of their query."""
    share = f"len(list_filter({words('p.categories')}, lambda t: list_contains(list_filter({words('s.category')}, lambda u: length(u) >= 3), t))) > 0"
    return f"""marked AS (SELECT r.*, s.budget, p.price AS p_price, {share} AS fits, len(list_filter({words('s.category')}, lambda u: length(u) >= 3)) = 0 AS open FROM {source} r JOIN {STATE} s ON s.query_id = r.query_id JOIN prod p ON p.doc_id = r.doc_id),
    kept AS (SELECT * FROM (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS any_fits FROM marked) m WHERE (open OR fits OR NOT any_fits) AND (try_cast(budget AS DOUBLE) IS NULL OR p_price IS NULL OR p_price <= try_cast(budget AS DOUBLE)))"""


SQL["slot_filters"] = f"WITH {pool(300)}, {slot_filtered('pool')} SELECT query_id, doc_id, rank FROM kept"

ATTRS = f"attrs AS (SELECT p_partkey AS doc_id, coalesce(p_type, '') AS query_id, {attributes('p_name', text(''), 'p_retailprice')} FROM part)"
LONG = "long AS (" + " UNION ALL ".join(f"SELECT query_id, doc_id, {k} AS ord, '{a}' AS attribute, nullif({a}, '') AS value FROM attrs" for k, a in enumerate(V.ATTRIBUTES)) + ")"
GLOBAL = "CASE attribute " + " ".join(f"WHEN '{a}' THEN {e}" for a, e in V.GLOBAL_ENTROPY.items()) + " ELSE 0.5 END"


def entropies(source: str, keys: str, value: str) -> str:
    return f"""(SELECT {keys}, sum(c) AS n, CASE WHEN sum(c) < 2 THEN 0.0 ELSE 1 - sum(c * log2(c)) / sum(c) / log2(sum(c)) END AS entropy FROM (SELECT {keys}, {value}, count(*) AS c FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}, {value}) x GROUP BY {keys})"""


def blend(n: str, entropy: str, overall: str) -> str:
    share = f"least({n} / 10.0, 1.0)"
    return f"(CASE WHEN {n} = 0 THEN {overall} ELSE {share} * (CASE WHEN {n} >= 2 THEN {entropy} ELSE {overall} END) + (1 - {share}) * {overall} END)"


ATTR_SCORES = f"""{ATTRS}, {LONG}, sizes AS (SELECT query_id, attribute, ord, count(*) AS pool, count(value) AS n FROM long GROUP BY query_id, attribute, ord),
ent AS (SELECT query_id, attribute, entropy FROM {entropies('long', 'query_id, attribute', 'value')} e),
scores AS (SELECT query_id, attribute, ord, n, n * 1.0 / pool AS coverage, n * 1.0 / pool * {blend('n', 'coalesce(entropy, 0.0)', GLOBAL)} AS score FROM (SELECT s.*, e.entropy FROM sizes s LEFT JOIN ent e ON e.query_id = s.query_id AND e.attribute = s.attribute) j)"""
SQL["attr_entropy"] = f"WITH {ATTR_SCORES} SELECT query_id, attribute, n, round(coverage, 6) AS coverage, round(score, 6) AS score FROM scores"
SQL["normalized_entropy"] = f"SELECT user_id, n, round(entropy, 6) AS entropy FROM {entropies('events', 'user_id', 'event_type')} e"
DAYS = "(SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)"
SQL["blended_entropy_by_day"] = f"SELECT user_id, day, n, round({blend('n', 'entropy', '0.73')}, 6) AS entropy FROM {entropies(DAYS + ' g', 'user_id, day', 'event_type')} e"
LEFT = f"""asking AS (SELECT DISTINCT p_type AS query_id FROM part), left_ AS (SELECT a.query_id, s.attribute, s.ord, s.score FROM asking a JOIN scores s ON s.query_id = a.query_id
WHERE NOT (length(a.query_id) % 2 = 0 AND s.attribute = 'color') AND NOT (length(a.query_id) % 3 = 0 AND s.attribute = 'size')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS k FROM left_) x WHERE k = 1)"""
SQL["ask_attribute"] = f"WITH {ATTR_SCORES}, {LEFT} SELECT query_id, attribute AS ask, round(score, 6) AS ask_score FROM best"
SQL["early_stop"] = f"WITH {ATTR_SCORES}, {LEFT} SELECT query_id, CASE WHEN score < 0.55 THEN 'other' ELSE attribute END AS ask FROM best"
SQL["pool_truncation"] = f"WITH {pool(100)}, sized AS (SELECT p.query_id, p.rank, s.n_slots, count(*) OVER (PARTITION BY p.query_id) AS n FROM pool p JOIN {STATE} s ON s.query_id = p.query_id) SELECT query_id, count(*) AS n FROM sized WHERE rank < CASE WHEN n_slots < 2 AND n >= 50 THEN 20 ELSE n END GROUP BY query_id"

VECTORS = "v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def near(most: int, product: str, name: str = "ranked") -> str:
    return f"{name}_s AS (SELECT q.doc_id AS query_id, d.doc_id, {product} AS score FROM v q JOIN v d ON q.doc_id % 100 = 0), {ranked(name + '_s', most, name)}"


FIRST, SECOND = "list_dot_product(q.x[1:32], d.x[1:32])", "list_dot_product(q.x[33:64], d.x[33:64])"
SQL["dense_topk"] = f"WITH {VECTORS}, {near(10, 'list_dot_product(q.x, d.x)')} {SHOWN}"
SQL["dense_two_field"] = f"WITH {VECTORS}, {near(10, f'0.35 * {FIRST} + 0.65 * {SECOND}')} {SHOWN}"


def two_weights(slots: dict, confidence: dict) -> tuple[float, float]:
    units = sum(confidence.get(s, 0.75) for s, v in slots.items() if v and s not in ("category", "brand", "budget"))
    own = min(0.78, 0.35 + 0.10 * units)
    own = own if slots.get("category") else max(own, 0.50)
    return round(1 - own, 6), round(own, 6)


SQL["dense_field_weights"] = "SELECT * FROM " + rows([(q, *two_weights(slots, conf)) for q, _, slots, conf, *_ in SEARCHES], "query_id w_identity w_attribute", "BIGINT DOUBLE DOUBLE") + " x"


def confidence(source: str) -> str:
    return f"(SELECT query_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE greatest(0.0, least(1.0, (max(score) - min(score)) / (abs(max(score)) + 1e-9))) END AS confidence FROM {source} WHERE rank < 10 GROUP BY query_id)"


SQL["source_confidence"] = f"WITH {DOC_BM25}, {ranked('scored', 100)} SELECT query_id, round(confidence, 6) AS confidence FROM {confidence('ranked')} c"
LISTS = f"{VECTORS}, {near(30, FIRST, 'a')}, {near(30, SECOND, 'b')}"


def fused(weights: str, most: int) -> str:
    """weights: query_id, lw, dw."""
    return f"""w AS ({weights}), both_ AS (SELECT query_id, doc_id, min(l) AS l, min(d) AS d FROM (SELECT query_id, doc_id, rank AS l, NULL AS d FROM a UNION ALL SELECT query_id, doc_id, NULL AS l, rank AS d FROM b) u GROUP BY query_id, doc_id),
    mixed AS (SELECT x.query_id, x.doc_id, x.l, x.d, coalesce(w.lw * (1.0 / (61 + x.l)), 0.0) + coalesce(w.dw * (1.0 / (61 + x.d)), 0.0) AS score FROM both_ x JOIN w ON w.query_id = x.query_id), {ranked('mixed', most, order='score DESC, l NULLS LAST, d NULLS LAST')}"""


SQL["rrf_fuse"] = f"WITH {LISTS}, {fused('SELECT DISTINCT query_id, 0.75 AS lw, 0.25 AS dw FROM a', 20)} {SHOWN}"
SLOT_N = "(ca.query_id // 100) % 4"
STAGE = f"(CASE {SLOT_N} WHEN 0 THEN 0.50 WHEN 1 THEN 0.60 ELSE 0.75 END)"
LEX = f"greatest(0.35, least(0.90, (CASE {SLOT_N} WHEN 0 THEN {STAGE} WHEN 1 THEN greatest({STAGE}, 0.60) ELSE 0.75 END) + 0.10 * (ca.confidence - cb.confidence)))"
SQL["adaptive_fuse"] = f"WITH {LISTS}, {fused(f'SELECT ca.query_id, {LEX} AS lw, 1 - {LEX} AS dw FROM {confidence(chr(97))} ca JOIN {confidence(chr(98))} cb ON cb.query_id = ca.query_id', 20)} {SHOWN}"
SQL["dense_gate"] = f"""WITH {pool(100)} SELECT s.query_id, coalesce(n.n, 0) AS rows, (coalesce(n.n, 0) < 20) OR ((coalesce(s.category, '') = '') AND s.n_slots <= 1 AND coalesce(c.confidence, 0.0) <= 0.12) AS dense
FROM {STATE} s LEFT JOIN (SELECT query_id, count(*) AS n FROM pool GROUP BY query_id) n ON n.query_id = s.query_id LEFT JOIN {confidence('pool')} c ON c.query_id = s.query_id"""

# what compatibility reads of a part: all its text, its type, its attributes
FULL = f"full_ AS (SELECT p.doc_id, list_distinct(list_filter({words(chr(112) + '.title || ' + text(' ') + ' || p.categories || ' + text(' ') + ' || p.title || ' + text(' ') + ' || p.store')}, lambda t: length(t) > 1)) AS every, list_distinct(list_filter({words('p.categories')}, lambda t: length(t) > 1)) AS cats, p.price, b.* EXCLUDE (doc_id, query_id) FROM prod p JOIN attrs b ON b.doc_id = p.doc_id)"
OWN = "CASE x.attribute " + " ".join(f"WHEN '{a}' THEN f.{a}" for a in V.ATTRIBUTES) + " END"
WANT = f"list_distinct(list_filter({words('x.value')}, lambda t: length(t) > 1))"
HAVE = f"(CASE WHEN x.attribute = 'category' THEN f.cats ELSE list_concat(f.every, list_filter({words(OWN)}, lambda t: length(t) > 1)) END)"
MATCH = f"""(CASE WHEN x.attribute = 'budget' THEN (CASE WHEN try_cast(x.value AS DOUBLE) IS NULL THEN 0.0 WHEN f.price IS NULL THEN 0.25 WHEN f.price <= try_cast(x.value AS DOUBLE) THEN 1.0 ELSE greatest(0.0, try_cast(x.value AS DOUBLE) / f.price - 0.25) END)
WHEN len({WANT}) = 0 THEN 0.0 ELSE least(1.0, 1.25 * len(list_filter({WANT}, lambda t: list_contains({HAVE}, t))) / len({WANT})) END)"""


def said() -> str:
    """query_id, attribute, value, strength: what each session says anything about."""
    out = []
    for q, _, slots, conf, turns, negative, without, _, turn, _ in SEARCHES:
        for a in sorted(({*slots} | {a for a, v in negative.items() if v}) - {*without}):
            trust = conf.get(a, 0.80 if slots.get(a) else 0.70)
            out.append((q, a, slots.get(a) or None, trust * max(0.75, 1 - 0.04 * max(0, turn - turns.get(a, 1))) * V.ATTRIBUTE_PRIORS.get(a, 1.0)))
    return rows(out, "query_id attribute value strength", "BIGINT VARCHAR VARCHAR DOUBLE")


def evidence(source: str, n: str = "") -> str:
    """CTEs evidence and compat, their names followed by n: query_id, doc_id, attribute, matched, violated, weight."""
    first = "" if n else f"{ATTRS}, {FULL}, "
    return f"""{first}m{n} AS (SELECT c.query_id, c.doc_id, x.attribute, x.value, x.strength, CASE WHEN x.value IS NULL THEN 1.0 ELSE {MATCH} END AS matched FROM {source} c JOIN {said()} x ON x.query_id = c.query_id JOIN full_ f ON f.doc_id = c.doc_id),
    bad{n} AS (SELECT c.query_id, c.doc_id, x.attribute, max({MATCH}) AS violated FROM {source} c JOIN {AGAINST} x ON x.query_id = c.query_id JOIN full_ f ON f.doc_id = c.doc_id GROUP BY c.query_id, c.doc_id, x.attribute),
    evidence{n} AS (SELECT m.query_id, m.doc_id, m.attribute, m.matched, coalesce(bad.violated, 0.0) AS violated, m.strength * (0.55 + 0.45 * CASE WHEN m.value IS NULL THEN 0.65 ELSE 1 - avg(CASE WHEN m.matched >= 0.60 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY m.query_id, m.attribute) END) AS weight
      FROM m{n} m LEFT JOIN bad{n} bad ON bad.query_id = m.query_id AND bad.doc_id = m.doc_id AND bad.attribute = m.attribute),
    compat{n} AS (SELECT query_id, doc_id, sum(weight * matched * (1 - violated)) / sum(weight) AS compatibility, sum(weight * violated) / sum(weight) AS risk FROM evidence{n} GROUP BY query_id, doc_id)"""


SQL["attr_match"] = f"WITH {pool(50)}, {evidence('pool')} SELECT query_id, doc_id, attribute, round(matched, 6) AS matched, round(violated, 6) AS violated, round(weight, 6) AS weight FROM evidence"
SQL["attr_compat"] = f"WITH {pool(50)}, {evidence('pool')} SELECT query_id, doc_id, round(compatibility, 6) AS compatibility, round(risk, 6) AS risk FROM compat"
E_WEIGHT = rows([(q, min(0.52, 0.18 + 0.10 * (sum(conf.get(s, 0.75) for s in slots) + 0.70 * sum(bool(v) for v in negative.values())))) for q, _, slots, conf, _, negative, *_ in SEARCHES], "query_id e", "BIGINT DOUBLE")


def rescored(source: str, name: str = "re") -> str:
    return f"""{name} AS (SELECT p.query_id, p.doc_id, p.rank AS before_, p.score AS lexical_score, round(CASE WHEN c.compatibility IS NULL THEN p.score ELSE (1 - w.e) * p.score / coalesce(nullif(max(p.score) OVER (PARTITION BY p.query_id), 0.0), 1.0) + w.e * (c.compatibility - c.risk) END, 9) AS score
    FROM {source} p LEFT JOIN compat c ON c.query_id = p.query_id AND c.doc_id = p.doc_id LEFT JOIN {E_WEIGHT} w ON w.query_id = p.query_id)"""


SQL["rescore"] = f"WITH {pool(50)}, {evidence('pool')}, {rescored('pool')} SELECT query_id, doc_id, round(lexical_score, 6) AS lexical_score, round(score, 6) AS score FROM re"
N_TAGS = f"(SELECT query_id, count(*) AS n FROM {TAGS} t GROUP BY query_id)"
PROFILE_TEXT = words("p.title || ' ' || p.categories || ' ' || p.title")


def boosted(source: str) -> str:
    """query_id, doc_id, rank, score with the profile's share."""
    return f"""(SELECT r.query_id, r.doc_id, r.rank, r.score + coalesce(0.15 * count(t.tag) / max(n.n), 0.0) AS score FROM {source} r JOIN prod p ON p.doc_id = r.doc_id LEFT JOIN {N_TAGS} n ON n.query_id = r.query_id
    LEFT JOIN {TAGS} t ON t.query_id = r.query_id AND list_contains({PROFILE_TEXT}, t.tag) GROUP BY r.query_id, r.doc_id, r.rank, r.score)"""


SQL["profile_boost"] = f"WITH {pool(50)} SELECT query_id, doc_id, round(score, 6) AS score FROM {boosted('pool')} b"

DIVERSE_TOKENS = f"list_distinct(list_filter({words(chr(112) + '.title || ' + text(' ') + ' || p.categories')}, lambda t: length(t) > 1 AND t NOT IN {DIVERSE}))"
SLOT_TOKENS = rows([(q, t) for q, _, slots, *_ in SEARCHES for t in tokens(" ".join(slots.values()), None, V.DIVERSITY_STOPWORDS, 2)], "query_id token", "BIGINT VARCHAR")
N_SLOT_TOKENS = rows([(q, len(tokens(" ".join(slots.values()), None, V.DIVERSITY_STOPWORDS, 2))) for q, _, slots, *_ in SEARCHES], "query_id n", "BIGINT BIGINT")
SOLD = "(SELECT l_partkey, count(*) AS sold FROM lineitem GROUP BY l_partkey)"
BASE = "r.score / coalesce(nullif(max(r.score) OVER (PARTITION BY r.query_id), 0.0), 1.0)"
POPULAR = "ln(1 + coalesce(o.sold, 0)) / coalesce(nullif(max(ln(1 + coalesce(o.sold, 0))) OVER (PARTITION BY r.query_id), 0.0), 1.0)"


def static(source: str) -> str:
    """CTE rel: query_id, doc_id, rank, score, relevance, tokens."""
    cover = f"(SELECT r.query_id, r.doc_id, count(t.token) AS c FROM {source} r JOIN prod p ON p.doc_id = r.doc_id LEFT JOIN {SLOT_TOKENS} t ON t.query_id = r.query_id AND list_contains({DIVERSE_TOKENS}, t.token) GROUP BY r.query_id, r.doc_id)"
    anchor = "lower(trim(split_part(s.category, '/', 1)))"
    budget = "try_cast(s.budget AS DOUBLE)"
    return f"""rel AS (SELECT r.query_id, r.doc_id, r.rank, r.score, {DIVERSE_TOKENS} AS tokens, {BASE} + 0.8 * v.c / greatest(n.n, 1) + 1.0 * CASE WHEN coalesce({anchor}, '') <> '' AND contains(lower(p.categories), {anchor}) THEN 1.0 ELSE 0.0 END
    + 0.15 * {POPULAR} + 0.4 * CASE WHEN {budget} IS NULL OR p.price IS NULL THEN 0.0 ELSE greatest(0.0, 1 - abs(p.price - {budget}) / greatest({budget}, 1.0)) END AS relevance
    FROM {source} r JOIN prod p ON p.doc_id = r.doc_id JOIN {STATE} s ON s.query_id = r.query_id JOIN {cover} v ON v.query_id = r.query_id AND v.doc_id = r.doc_id JOIN {N_SLOT_TOKENS} n ON n.query_id = r.query_id LEFT JOIN {SOLD} o ON o.l_partkey = r.doc_id)"""


def dynamic(source: str, n: str = "") -> str:
    return f"""rel AS (SELECT r.query_id, r.doc_id, r.rank, r.score, {DIVERSE_TOKENS} AS tokens, round({BASE} + 1.6 * coalesce(c.compatibility, 0.0) - 1.4 * coalesce(c.risk, 0.0) + 0.15 * {POPULAR}, 9) AS relevance
    FROM {source} r JOIN prod p ON p.doc_id = r.doc_id LEFT JOIN compat{n} c ON c.query_id = r.query_id AND c.doc_id = r.doc_id LEFT JOIN {SOLD} o ON o.l_partkey = r.doc_id)"""


SQL["feature_score"] = f"WITH {pool(20)}, {static('pool')} SELECT query_id, doc_id, round(relevance, 6) AS relevance FROM rel"
SQL["feature_score_dynamic"] = f"WITH {pool(20)}, {evidence('pool')}, {dynamic('pool')} SELECT query_id, doc_id, round(relevance, 6) AS relevance FROM rel"


def jaccard(a: str, b: str) -> str:
    common = f"len(list_filter({a}, lambda t: list_contains({b}, t)))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE {common} * 1.0 / (len({a}) + len({b}) - {common}) END)"


def greedy(k: int) -> str:
    """CTEs pick0 to pick(k-1), one greedy choice each."""
    out = ["pick0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS n FROM rel) x WHERE n = 1)"]
    for j in range(1, k):
        before = " UNION ALL ".join(f"SELECT query_id, doc_id, tokens FROM pick{i}" for i in range(j))
        worst = f"SELECT r.query_id, r.doc_id, max({jaccard('r.tokens', 'b.tokens')}) AS worst, max(CASE WHEN r.doc_id = b.doc_id THEN 1 ELSE 0 END) AS taken FROM rel r JOIN ({before}) b ON b.query_id = r.query_id GROUP BY r.query_id, r.doc_id"
        out.append(f"pick{j} AS (SELECT query_id, doc_id, rank, score, relevance, tokens, n FROM (SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY 0.7 * r.relevance - (1 - 0.7) * w.worst DESC, r.rank) AS n FROM rel r JOIN ({worst}) w ON w.query_id = r.query_id AND w.doc_id = r.doc_id WHERE w.taken = 0) x WHERE n = 1)")
    return ", ".join(out)


ROUNDED = "rel0 AS (SELECT query_id, doc_id, rank, score, tokens, round(relevance, 6) AS relevance FROM relx)"
SQL["mmr_topk"] = f"WITH {pool(20)}, {static('pool').replace('rel AS', 'relx AS', 1)}, {ROUNDED.replace('rel0', 'rel')}, {greedy(3)} " + " UNION ALL ".join(f"SELECT query_id, doc_id, {j} AS rank, round(score, 6) AS score FROM pick{j}" for j in range(3))
PICKED = " UNION ALL ".join(f"SELECT query_id, doc_id, {j} AS rank, round(score, 6) AS score FROM pick{j}" for j in range(10))
#: From re, the rescored candidates, to the ten that are shown.
RERANKED = f"{ranked('re', 20, 'head', 'score DESC, before_')}, lifted AS (SELECT * FROM {boosted('head')} b), {evidence('lifted', '2')}, {dynamic('lifted', '2')}, {greedy(10)} {PICKED}"
SQL["rerank_topk"] = f"WITH {pool(50)}, {evidence('pool')}, {rescored('pool')}, {RERANKED}"
TRACKED = f"kept2 AS (SELECT k.query_id, k.doc_id, k.rank, k.score FROM kept k JOIN {STATE} s ON s.query_id = k.query_id AND s.track = 'buying' UNION ALL SELECT p.query_id, p.doc_id, p.rank, p.score FROM pool p JOIN {STATE} s ON s.query_id = p.query_id AND s.track <> 'buying')"
FILTERED = f"{slot_filtered('pool')}, {TRACKED}, cut AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1 AS rank FROM kept2)"
SQL["hybrid_search"] = f"WITH {DYNAMIC_BM25}, {ranked('scored', 300, 'pool')}, {FILTERED}, {evidence('cut')}, {rescored('cut')}, {RERANKED}"
TURN = f"{DYNAMIC_BM25}, {ranked('scored', 300, 'pool')}, {FILTERED}, {evidence('cut')}, {rescored('cut')}, {ranked('re', 100, 'a0', 'score DESC, before_')}"


def encoded_turn(product: str, opened: str, weights: str, two: str = "SELECT NULL AS query_id, 0.0 AS w_identity, 0.0 AS w_attribute") -> str:
    """opened: when a search that browses needs vectors. weights: lexical and dense, of state. two: query_id, w_identity, w_attribute."""
    return f"""WITH {TURN}, {VECTORS}, two AS ({two}),
    state AS (SELECT s.*, coalesce(n.n, 0) AS found, coalesce(c.confidence, 0.0) AS sure FROM {STATE} s LEFT JOIN (SELECT query_id, count(*) AS n FROM a0 GROUP BY query_id) n ON n.query_id = s.query_id LEFT JOIN {confidence('a0')} c ON c.query_id = s.query_id),
    opened AS (SELECT * FROM state s WHERE track <> 'buying' AND ({opened})),
    near AS (SELECT o.query_id, d.doc_id, {product} AS score FROM opened o JOIN v q ON q.doc_id = 10 * o.query_id LEFT JOIN two t ON t.query_id = o.query_id JOIN (SELECT v.* FROM v JOIN prod p ON p.doc_id = v.doc_id) d ON true), {ranked('near', 100, 'b')},
    a AS (SELECT query_id, doc_id, rank FROM a0 WHERE query_id IN (SELECT query_id FROM opened)),
    {fused(f"SELECT s.query_id, {weights} FROM opened s LEFT JOIN {confidence('b')} cb ON cb.query_id = s.query_id", 100)}
    {SHOWN} UNION ALL SELECT query_id, doc_id, rank, round(score, 6) AS score FROM a0 WHERE query_id NOT IN (SELECT query_id FROM opened)"""


BOTH_VECTORS = rows([(q, *two_weights(slots, conf)) for q, _, slots, conf, *_ in SEARCHES], "query_id w_identity w_attribute", "BIGINT DOUBLE DOUBLE")
EVIDENT = "greatest(0.35, least(0.90, (CASE s.n_slots WHEN 0 THEN 0.50 WHEN 1 THEN 0.60 ELSE 0.75 END) + 0.10 * (s.sure - coalesce(cb.confidence, 0.0))))"
SQL["hybrid_dense_search"] = encoded_turn(
    f"t.w_identity * {FIRST} + t.w_attribute * {SECOND}", "found < 20 OR (coalesce(category, '') = '' AND n_slots <= 1 AND sure <= 0.12)", f"{EVIDENT} AS lw, 1 - {EVIDENT} AS dw", f"SELECT * FROM {BOTH_VECTORS} x"
)
GIVEN = [f"(CASE s.n_slots {' '.join(f'WHEN {n} THEN {pair[k]}' for n, pair in enumerate(FIXED_WEIGHTS['browsing_weights']))} ELSE {FIXED_WEIGHTS[base]} END)" for k, base in enumerate(("bm25_base", "dense_base"))]
SQL["hybrid_dense_fixed"] = encoded_turn("list_dot_product(q.x, d.x)", "true", f"{GIVEN[0]} AS lw, {GIVEN[1]} AS dw")
SQL["merge_named_order"] = f"""WITH {pool(20)} SELECT query_id, doc_id, new AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 3 = 2 THEN -rank END NULLS LAST, rank) - 1 AS new FROM pool) x WHERE new < 10"""
BUDGET_ONLY = f"kept AS (SELECT r.*, r.rank AS before_ FROM ranked300 r JOIN {STATE} s ON s.query_id = r.query_id JOIN prod p ON p.doc_id = r.doc_id WHERE try_cast(s.budget AS DOUBLE) IS NULL OR p.price IS NULL OR p.price <= try_cast(s.budget AS DOUBLE))"
SQL["variant_search"] = f"WITH {PART_BM25}, {ranked('scored', 30, 'ranked300')}, {BUDGET_ONLY}, again AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY before_) - 1 AS rank FROM kept) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM again WHERE rank < 10"
LATE = "SELECT DISTINCT query_id, CASE (query_id // 100) % 3 WHEN 0 THEN 0.50 WHEN 1 THEN 0.60 ELSE 0.75 END AS lw, CASE (query_id // 100) % 3 WHEN 0 THEN 0.50 WHEN 1 THEN 0.40 ELSE 0.25 END AS dw FROM a WHERE query_id % 200 = 0"
SQL["variant_fuse"] = f"WITH {LISTS}, {fused(LATE, 20)} {SHOWN} UNION ALL SELECT query_id, doc_id, rank, round(score, 6) AS score FROM a WHERE query_id % 200 <> 0"
WEAK_TOO = LEFT.replace("s.attribute = 'color')", "s.attribute = 'color') AND NOT (length(a.query_id) % 2 = 1 AND s.attribute = 'size')")
SQL["variant_ask"] = f"WITH {ATTR_SCORES}, {WEAK_TOO} SELECT query_id, attribute AS ask FROM best"
SQL["starter_topk"] = SQL["bm25_part_topk"]
SQL["pass_through_topk"] = SQL["bm25_part_topk"]
SQL["history_window"] = """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
b AS (SELECT a.conv_id, a.turn, count(p.k) AS n, coalesce(sum(length(p.text)), 0) + greatest(count(p.k) - 1, 0) AS chars FROM t a LEFT JOIN t p ON p.conv_id = a.conv_id AND p.k BETWEEN a.k - 3 AND a.k - 1 AND NOT contains(p.text, ' no ') GROUP BY a.conv_id, a.turn)
SELECT conv_id, turn, n AS n_useful, CAST(chars AS BIGINT) AS chars FROM b"""
SESSIONS = """turns AS (SELECT o_orderkey, o_custkey AS sample_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn FROM orders),
shown AS (SELECT t.sample_id, t.turn, l.l_partkey AS doc_id, l.l_linenumber AS rank FROM turns t JOIN lineitem l ON l.l_orderkey = t.o_orderkey WHERE t.turn <= 12),
target AS (SELECT sample_id, max(doc_id) AS target FROM shown WHERE turn BETWEEN 1 AND 11 GROUP BY sample_id),
samples AS (SELECT c.c_custkey AS sample_id, c.c_mktsegment AS scenario_type, t.target, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 3 ELSE 1 END AS credit_from FROM customer c JOIN target t ON t.sample_id = c.c_custkey),
hits AS (SELECT s.sample_id, h.turn, h.rank, row_number() OVER (PARTITION BY s.sample_id ORDER BY h.turn, h.rank) AS k FROM samples s JOIN shown h ON h.sample_id = s.sample_id AND h.doc_id = s.target WHERE h.turn <= 10 AND h.rank <= 10 AND h.turn >= s.credit_from),
sessions AS (SELECT s.sample_id, s.scenario_type, h.turn IS NOT NULL AS hit, h.turn AS first_hit_turn, h.rank AS best_rank, coalesce(1.0 / h.rank, 0.0) AS reciprocal_rank FROM samples s LEFT JOIN hits h ON h.sample_id = s.sample_id AND h.k = 1)"""
SQL["first_hit"] = f"WITH {SESSIONS} SELECT sample_id, hit, first_hit_turn, best_rank, round(reciprocal_rank, 6) AS reciprocal_rank FROM sessions"


def scores(group: str | None) -> str:
    by = f"GROUP BY {group}" if group else ""
    name = "scenario_type" if group else "'overall'"
    inner = f"SELECT {name} AS scenario_type, count(*) AS sample_count, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_10, round(avg(reciprocal_rank), 6) AS mrr, round(avg(coalesce(first_hit_turn, 11)), 6) AS mttc FROM sessions {by}"
    good = "greatest(0.0, least(1.0, (11.0 - mttc) / 10.0))"
    return f"SELECT scenario_type, sample_count, hit_rate_at_10, mrr, mttc, round({good}, 6) AS efficiency, round(0.5 * hit_rate_at_10 + 0.3 * mrr + 0.2 * {good}, 6) AS score FROM ({inner}) m"


SQL["scenario_metrics"] = f"WITH {SESSIONS} {scores('scenario_type')} UNION ALL {scores(None)}"
SQL["session_metrics"] = f"WITH {SESSIONS} SELECT sample_count, hit_rate_at_10, mrr, mttc, efficiency, score FROM ({scores(None)}) o"
SQL["near_misses"] = f"WITH {SESSIONS} SELECT sample_id, 'near miss' AS kind FROM sessions WHERE hit AND best_rank BETWEEN 4 AND 10 UNION ALL SELECT sample_id, 'complete miss' AS kind FROM sessions WHERE NOT hit"
SQL["token_usage"] = "SELECT CAST(coalesce(sum(CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 OR event_id = 0 THEN event_id END), 0) AS BIGINT) AS prompt_tokens, CAST(0 AS BIGINT) AS completion_tokens FROM events"
SQL["scenario_counts"] = "SELECT c_mktsegment AS scenario_type, count(*) AS n FROM customer GROUP BY 1"
SQL["valid_recommendations"] = """WITH named AS (SELECT l_orderkey AS query_id, l_linenumber AS position, trim(CASE WHEN l_partkey % 11 = 0 THEN ' ' WHEN l_partkey % 7 = 0 THEN 'none' WHEN l_partkey % 5 = 0 THEN ' ' || l_partkey || ' ' ELSE CAST(l_partkey % 50 AS VARCHAR) END) AS doc_id FROM lineitem),
first_ AS (SELECT query_id, doc_id, min(position) AS position FROM named WHERE doc_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY position, doc_id) AS rank FROM first_) x WHERE rank <= 3"""
SQL["eligible_targets_by_quantity"] = """SELECT p_partkey AS doc_id FROM part WHERE coalesce(p_name, '') <> '' AND coalesce(p_type, '') <> ''
AND NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity = 50 AND l_partkey = p_partkey)
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_partkey = p_partkey)"""


def kind(column: str, colors: tuple[str, ...]) -> str:
    low = f"lower(coalesce({column}, ''))"
    any_of = lambda ws: "(" + " OR ".join(f"contains({low}, '{w}')" for w in ws) + ")"
    return f"CASE WHEN regexp_matches({low}, '{V.BUDGET_HINT}') THEN 'budget' WHEN {any_of(V.MATERIALS)} THEN 'material' WHEN {any_of(('color', *colors))} THEN 'color' WHEN {any_of(V.SIZE_HINTS)} THEN 'size' WHEN {any_of(V.STYLE_HINTS)} THEN 'style' WHEN {any_of(V.USE_HINTS)} THEN 'use_case' ELSE 'feature' END"


SQL["classify_constraints"] = f"SELECT p_partkey, {kind(ALL_TEXT, V.COLORS)} AS kind, {kind('p_type', V.SHORT_COLORS)} AS type_kind FROM part"
SQL["coarse_category"] = "SELECT p_partkey, p_brand || ' ' || p_type AS category, 'clothing item' AS root_only FROM part WHERE false OR (p_brand <> '' AND p_type <> '')"
CARD = f"""c AS (SELECT p_partkey AS doc_id, p_type, {named('material', 'concat_ws(chr(32), p_name, p_brand, p_type, p_size, p_type, p_brand)')} AS material, {named('color', 'concat_ws(chr(32), p_name, p_brand, p_type, p_size, p_type, p_brand)')} AS color, p_brand, 'size: ' || p_size AS size, 'budget around $' || CAST(trunc(p_retailprice) AS INTEGER) AS budget FROM part),
w AS (SELECT doc_id, p_type, CASE WHEN material IS NOT NULL AND color IS NOT NULL THEN [material, 'color: ' || color, p_brand, p_type] WHEN material IS NOT NULL THEN [material, p_brand, p_type, size] WHEN color IS NOT NULL THEN [p_brand, 'color: ' || color, p_type, size] ELSE [p_brand, p_type, size, budget] END AS w FROM c)"""
SQL["intent_cards"] = f"""WITH {CARD} SELECT doc_id, w[1] || '|' || w[2] AS hard, w[3] || '|' || w[4] AS soft, 'I''m looking for ' || p_type || CASE doc_id % 3 WHEN 0 THEN '. A key requirement is: ' || w[1] || '.' WHEN 1 THEN '. ' || w[4] ELSE ', but I''m still exploring.' END AS message FROM w"""
SQL["event_streaks"] = """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events),
r AS (SELECT user_id, event_type, run, count(*) AS n FROM e GROUP BY user_id, event_type, run) SELECT user_id, max(n) AS longest FROM r GROUP BY user_id"""
