"""SQL for the rows of the opN_ queries, where SQL can express them, in DuckDB's dialect."""

from __future__ import annotations

from stratum.llm import quality

SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: A-Z in lower case only.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Groups of links (a, b): the smallest id reachable from each node.
REACH = """reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a AS id, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""

NEAR_DUP = f"""WITH RECURSIVE words AS (SELECT doc_id, {SPLIT.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
flat AS (SELECT doc_id, hash(unnest(s)) AS h FROM sets), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM flat x JOIN flat y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
{REACH}
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM sizes LEFT JOIN groups ON id = doc_id"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
WHERE list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.98),
{REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM embeddings LEFT JOIN groups ON id = vec_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), k AS (SELECT body, max(page_id) AS keeper FROM p WHERE strlen(body) >= 1000 GROUP BY body),
j AS (SELECT page_id, p.body, keeper FROM p LEFT JOIN k ON p.body = k.body)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM j"""

CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(12 + length(regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>', 'g')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of numbers."""
    share = lambda h: f"list_transform({h}, lambda v: v / list_sum({h}))"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(list_zip({share(p)}, {share(q)}), lambda z: ({part('z[1]')} + {part('z[2]')}) / 2)))) END"


_COUNT = r"length(t) - length(regexp_replace(t, '{}', '', 'g'))"
QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents),
h AS (SELECT doc_id, t, lang, {SPLIT.format("t")} AS w, {SPLIT.format("lower(t)")} AS lw, length(t) AS len, {_COUNT.format(r'\p{Ll}+')} AS lo, {_COUNT.format(r'\p{Lu}+')} AS up, {_COUNT.format(r'\p{Nd}+')} AS di,
{_COUNT.format(r'[\x20\x09-\x0D]+')} AS sp, {_COUNT.format('[' + quality.SYMBOLS + ']+')} AS sy FROM d),
wc AS (SELECT lang, word, count(*) AS c FROM (SELECT lang, unnest(lw) AS word FROM h) GROUP BY lang, word),
ranked AS (SELECT lang, word, c, row_number() OVER (PARTITION BY lang ORDER BY regexp_matches(word, '\\p{{L}}') DESC, c DESC, word) AS r, sum(c) OVER (PARTITION BY lang) AS total FROM wc),
cw AS (SELECT lang AS cl, list(word ORDER BY r) AS common FROM ranked WHERE r <= {quality.N_COMMON} AND {quality.COMMON_PART} * c >= total AND regexp_matches(word, '\\p{{L}}') GROUP BY lang),
f AS (SELECT *, [lo, up, di, sp, sy, len - lo - up - di - sp - sy] AS chars, CASE WHEN len(lw) >= {quality.LEAST_COMPARED_WORDS} AND common IS NOT NULL THEN list_transform(common, lambda c: len(list_filter(lw, lambda x: x = c))) END AS hits FROM h LEFT JOIN cw ON h.lang IS NOT DISTINCT FROM cw.cl),
g AS (SELECT *, CASE WHEN hits IS NOT NULL THEN list_append(hits, CAST(len(lw) - list_sum(hits) AS BIGINT)) END AS wh FROM f),
s AS (SELECT lang, CASE WHEN len > 0 THEN list_transform(chars, lambda c: round(1000 * c / len)) END AS c, list_transform(wh, lambda c: round(1000 * c / len(lw))) AS w FROM g),
every AS (SELECT [{', '.join(f'median(c[{i}])' for i in range(1, 7))}] AS ac FROM s),
refs AS (SELECT lang AS rl, count(c) AS n, [{', '.join(f'median(c[{i}])' for i in range(1, 7))}] AS rc, list_filter([{', '.join(f'median(w[{i}])' for i in range(1, quality.N_COMMON + 2))}], lambda v: v IS NOT NULL) AS rw, count(w) / (count(w) + {quality.PRIOR_DOCS}) AS trust FROM s GROUP BY lang),
drawn AS (SELECT rl, rw, trust, list_transform(list_zip(rc, ac), lambda z: (n * coalesce(z[1], 0.0) + {quality.PRIOR_DOCS} * z[2]) / (n + {quality.PRIOR_DOCS})) AS rc FROM refs, every),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM h),
win AS (SELECT doc_id, i, CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN word || ' ' || {" || ' ' || ".join(f'lead(word, {k}) OVER o' for k in range(1, 8))} END AS win FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 THEN 1 ELSE 0 END AS d FROM win),
rep AS (SELECT doc_id, sum(c) AS n FROM (SELECT doc_id, max(d) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM dup) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
a AS (SELECT g.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len - sp AS BIGINT) AS word_chars, CAST(sy AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
CASE WHEN len >= {quality.LEAST_CHARS} THEN {_distance('chars', 'rc')} END AS cd, trust * {_distance('wh', 'rw')} AS wd
FROM g JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN drawn ON g.lang IS NOT DISTINCT FROM drawn.rl),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 0) <= {quality.MOST_CHAR_DISTANCE} AND coalesce(wd, 0) <= {quality.MOST_WORD_DISTANCE} AS kept FROM b"""

ORACLES = {"op3_near_dup": NEAR_DUP, "op5_vector_dedup": VECTORS, "op7_warc": WARC, "op8_chat": CHAT, "op9_quality": QUALITY}
