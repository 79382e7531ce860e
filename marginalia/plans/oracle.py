"""SQL with the same results as the core's queries, for DuckDB."""

from __future__ import annotations

_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


def _blank(c: str) -> str:
    return f"({c} IS NULL OR {_strip(c)} = '')"


def _normalized(c: str) -> str:
    return rf"replace(regexp_replace({_strip(f'lower({c})')}, '\.(md|canvas|pdf|png|jpg|jpeg|gif|svg|webp)$', ''), ' ', '-')"


def _stem(c: str) -> str:
    name = f"regexp_extract({c}, '[^/]*$')"
    return rf"CASE WHEN substring({name}, 2) LIKE '%.%' THEN regexp_replace({name}, '\.[^.]*$', '') ELSE {name} END"


ORPHANS = f"""
WITH notes AS (SELECT DISTINCT path, first_seen_at s, deleted_at d FROM note_catalog WHERE NOT {_blank("path")}),
named AS (
  SELECT {_normalized("path")} AS name, path FROM notes
  UNION SELECT {_normalized(_stem("path"))}, path FROM notes
  UNION SELECT alias_normalized, note_path FROM aliases WHERE NOT {_blank("alias_normalized")} AND NOT {_blank("note_path")}),
lives AS (
  SELECT 'p' || path AS k, s, d FROM notes
  UNION SELECT 'n' || name, s, d FROM named JOIN notes USING (path)),
refs AS (
  SELECT 'links' AS src_table, 'from_note_path' AS ref_field, link_id AS row_id, 'p' || from_note_path AS k, recorded_at AS t FROM links WHERE NOT {_blank("from_note_path")}
  UNION ALL SELECT 'links', 'target', link_id, CASE WHEN NOT {_blank("to_note_path")} THEN 'p' || to_note_path WHEN NOT {_blank("link_target_normalized")} THEN 'n' || link_target_normalized END, recorded_at FROM links WHERE link_type IS DISTINCT FROM 'external'
  UNION ALL SELECT 'aliases', 'note_path', alias_id, 'p' || note_path, recorded_at FROM aliases WHERE NOT {_blank("note_path")}
  UNION ALL SELECT 'chunks', 'note_path', chunk_id, 'p' || note_path, indexed_at FROM chunks WHERE NOT {_blank("note_path")})
SELECT src_table, ref_field, row_id,
  CASE WHEN count(s) = 0 THEN 'missing' WHEN coalesce(bool_or(s > t), false) THEN 'late' ELSE 'deleted' END AS reason,
  strftime(t, '%Y-%m') AS period_month
FROM refs LEFT JOIN lives USING (k) WHERE k IS NOT NULL
GROUP BY src_table, ref_field, row_id, t
HAVING NOT coalesce(bool_or(s <= t AND (d IS NULL OR d > t)), false)
"""


def _knn(metric: str) -> str:
    d = {"cosine": "1 - list_cosine_similarity(q.v, r.v)", "l2": "list_distance(q.v, r.v) ** 2", "dot": "1 - list_dot_product(q.v, r.v)"}[metric]
    return f"""
WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round({d}, 9) AS x FROM r q JOIN r ON q.vec_id % 100 = 0)
SELECT query_id, id, round(x, 6) + 0.0 AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS rank FROM d) WHERE rank <= 10"""


_FOLD = "translate(lower(text), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy')"
_TERMS = f"""
tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array({_FOLD}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ts FROM documents WHERE text IS NOT NULL),
inv AS (SELECT term, id, count(*) AS tf, any_value(n) AS length FROM (SELECT id, len(ts) AS n, unnest(ts) AS term FROM tok) GROUP BY term, id),
asked AS (SELECT DISTINCT doc_id AS query_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array({_FOLD.replace("text", "title")}, '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents WHERE doc_id % 100 = 0) WHERE term <> ''),
stats AS (SELECT count(*) AS nd, avg(len(ts)) AS avgdl FROM tok WHERE len(ts) > 0),
df AS (SELECT term, count(*) AS df FROM inv GROUP BY term),
scored AS (
  SELECT query_id, id, sum(ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))) AS score
  FROM asked JOIN inv USING (term) JOIN df USING (term), stats GROUP BY query_id, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored)"""

_INNER = "link_type IS DISTINCT FROM 'external'"
_LIVING = f"living AS (SELECT path, max(struct_pack(m := mtime_ns, f := folder, e := extension, t := title, s := size)) AS r FROM note_catalog WHERE deleted_at IS NULL AND NOT {_blank('path')} GROUP BY path)"
_TAGS = f"list_filter(list_transform(string_split(tags, ','), lambda t: {_strip('t')}), lambda t: t <> '')"
_EDGES = f"SELECT DISTINCT from_note_path AS source, to_note_path AS target FROM links WHERE {_INNER} AND is_resolved AND NOT {_blank('from_note_path')} AND NOT {_blank('to_note_path')}"


def _clusters(edges: str) -> str:
    return f"""
WITH RECURSIVE e AS ({edges}),
p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM e WHERE source <> target),
ends AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT DISTINCT u AS root, u AS node FROM ends UNION SELECT root, v FROM reach JOIN ends ON node = u WHERE root <= v),
label AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
size AS (SELECT component, count(*) AS size FROM label GROUP BY component),
inside AS (SELECT component, count(*) AS n_edges FROM p JOIN label ON node = a GROUP BY component)
SELECT component, size, n_edges, round(n_edges / (size * (size - 1) / 2), 3) AS density FROM size JOIN inside USING (component) WHERE size >= 3"""


_NAMES = f"""
names AS (
  SELECT {_normalized("path")} AS name, path, 1 AS priority FROM note_catalog WHERE NOT {_blank("path")}
  UNION SELECT {_normalized(_stem("path"))}, path, 2 FROM note_catalog WHERE NOT {_blank("path")}
  UNION SELECT alias_normalized, note_path, 3 FROM aliases WHERE NOT {_blank("alias_normalized")} AND NOT {_blank("note_path")})"""
_BACK = f"""
paths AS (SELECT DISTINCT path FROM note_catalog WHERE NOT {_blank("path")}),
own AS (SELECT {_normalized("path")} AS name, path FROM paths UNION SELECT {_normalized(_stem("path"))}, path FROM paths),
meet AS (
  SELECT to_note_path AS path, from_note_path, link_id, link_type, context FROM links WHERE to_note_path IN (SELECT path FROM paths)
  UNION SELECT path, from_note_path, link_id, link_type, context FROM links JOIN own ON link_target_normalized = name AND name <> ''),
back AS (SELECT path, from_note_path, min(link_id) AS link_id, arg_min(link_type, link_id) AS link_type, arg_min(coalesce(context, chr(1)), link_id) AS c FROM meet WHERE from_note_path <> path GROUP BY path, from_note_path)"""
_PAIR = r"\[([^\]]+)\]\(([^)]+)\)"
_NO_BRACKET = r"\[\[[^\]]+\]\]"

ORACLE: dict[str, str] = {
    "p4_found": ORPHANS,
    "p4_report": f"""
WITH o AS ({ORPHANS}),
gone AS (SELECT row_id FROM o WHERE src_table = 'aliases'),
named AS (SELECT alias_id, alias_normalized AS name FROM aliases WHERE NOT {_blank("alias_normalized")}),
held AS (
  SELECT name FROM named WHERE alias_id NOT IN (SELECT row_id FROM gone)
  UNION SELECT {_normalized("path")} FROM note_catalog WHERE NOT {_blank("path")}
  UNION SELECT {_normalized(_stem("path"))} FROM note_catalog WHERE NOT {_blank("path")}),
lost AS (SELECT name FROM named WHERE alias_id IN (SELECT row_id FROM gone) AND name NOT IN (SELECT name FROM held)),
inherited AS (
  SELECT link_id, strftime(recorded_at, '%Y-%m') AS period_month FROM links
  WHERE link_type IS DISTINCT FROM 'external' AND NOT ({_blank("to_note_path")} AND {_blank("link_target_normalized")})
    AND (link_id IN (SELECT row_id FROM o WHERE ref_field = 'from_note_path') OR ({_blank("to_note_path")} AND link_target_normalized IN (SELECT name FROM lost)))
    AND link_id NOT IN (SELECT row_id FROM o WHERE ref_field = 'target'))
SELECT src_table, ref_field, period_month, 'direct' AS kind, reason, count(*) AS n_references FROM o GROUP BY src_table, ref_field, period_month, reason
UNION ALL SELECT 'links', 'target', period_month, 'inherited', 'inherited', count(*) FROM inherited GROUP BY period_month""",
    "duplicate_note_links": """
WITH c AS (SELECT embedding AS e, min(vec_id) AS class_id FROM embeddings GROUP BY embedding),
v AS (SELECT class_id, e::DOUBLE[] AS v FROM c),
near AS (SELECT a.class_id, count(*) AS n_links FROM v a JOIN v b ON a.class_id <> b.class_id WHERE list_cosine_similarity(a.v, b.v) >= 0.4 GROUP BY a.class_id)
SELECT vec_id, class_id, coalesce(n_links, 0) AS n_links FROM embeddings JOIN c ON embedding = e LEFT JOIN near USING (class_id)""",
    "refused_attempts": """
WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (
  SELECT user_id, k, ts AS first, 1 AS used FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, CASE WHEN o.ts - r.first > INTERVAL 86400 SECOND THEN o.ts ELSE r.first END, CASE WHEN o.ts - r.first > INTERVAL 86400 SECOND THEN 1 ELSE r.used + 1 END
  FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id::VARCHAR AS path, count(*) AS attempts, count(*) FILTER (used > 3) AS refused FROM r GROUP BY user_id""",
    **{f"knn_{m}": _knn(m) for m in ("cosine", "l2", "dot")},
    "knn_other_labels": """
WITH r AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(1 - list_cosine_similarity(q.v, r.v), 9) AS x FROM r q JOIN r ON q.vec_id % 100 = 0 AND r.label <> q.label)
SELECT query_id, id, round(x, 6) AS distance, rank, round(round(1 / (1 + x), 4), 3) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS rank FROM d) WHERE rank <= 5""",
    "mean_vectors_by_label": "SELECT label, i - 1 AS i, round(avg(embedding[i]::DOUBLE), 6) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i",
    "similar_labels": """
WITH m AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
d AS (SELECT m.label AS query_id, e.label AS other, vec_id, round(1 - list_cosine_similarity(m.v, e.embedding::DOUBLE[]), 9) AS x FROM m JOIN embeddings e ON m.label <> e.label),
b AS (SELECT query_id, other, min(x) AS x FROM d GROUP BY query_id, other)
SELECT query_id, other, round(x, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, other) AS rank FROM b) WHERE rank <= 5""",
    "fts_terms": f"WITH {_TERMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM inv GROUP BY term",
    "bm25_topk": f"WITH {_TERMS} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10",
    "exclude_after_topk": f"WITH {_TERMS} SELECT query_id, id, rank FROM ranked JOIN documents ON doc_id = id WHERE rank <= 50 AND NOT contains(lower(text), 'ledger') AND NOT contains(lower(text), 'puzzle')",
    "hybrid_rrf": f"""
WITH {_TERMS},
r AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(1 - list_cosine_similarity(q.v, r.v), 9) AS x FROM r q JOIN r ON q.vec_id % 100 = 0),
near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS rank FROM d),
lists AS (SELECT query_id, id, rank FROM near WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM ranked WHERE rank <= 50),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best_rank FROM lists GROUP BY query_id, id)
SELECT query_id, id, round(score, 9) AS score, best_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best_rank, id) AS rank FROM f) WHERE rank <= 10""",
    "highlighted": r"SELECT doc_id, regexp_replace(text, '(\(draft\)|sensor|panel)', '<mark>\1</mark>', 'gi') AS marked FROM documents",
    "wikilinks": rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '!?{_NO_BRACKET}')) AS raw FROM documents),
i AS (SELECT doc_id, raw[3:-3] AS inn, split_part(split_part(split_part(raw[3:-3], '|', 1), '^', 1), '#', 1) AS t FROM m WHERE raw[1] <> '!'),
k AS (SELECT doc_id, CASE WHEN {_strip("t")} <> '' THEN {_strip("t")} ELSE inn END AS target FROM i)
SELECT doc_id, count(DISTINCT lower(target)) AS n_links, min(target) AS first_target FROM k GROUP BY doc_id""",
    "external_links": r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[[^\]]+\]\([^)]+\)')) AS raw FROM documents),
a AS (SELECT doc_id, trim(regexp_extract(raw, '\]\(([^)]+)\)$', 1)) AS url FROM m),
b AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^(\[])(https?://[^\s)>\]"'']+)', 1)) AS url FROM documents)
SELECT DISTINCT doc_id, url FROM (SELECT * FROM a WHERE regexp_matches(url, '^(https?://|mailto:|tel:|ftp://)') UNION ALL SELECT * FROM b)""",
    "embedded_files": rf"""
WITH m AS (SELECT link_id, unnest(regexp_extract_all(context, '!{_NO_BRACKET}')) AS raw FROM links),
t AS (SELECT DISTINCT link_id, {_strip("split_part(raw[4:-3], '|', 1)")} AS link_target FROM m)
SELECT link_id, link_target, {_normalized("link_target")} AS link_target_normalized FROM t WHERE link_target <> ''""",
    "markdown_links": f"""
WITH m AS (SELECT link_id, unnest(regexp_extract_all(context, '{_PAIR}')) AS raw FROM links),
n AS (SELECT link_id, {_strip(f"regexp_extract(raw, '{_PAIR}', 2)")} AS href, regexp_extract(raw, '{_PAIR}', 1) AS alias FROM m),
t AS (SELECT link_id, alias, {_strip("split_part(href, '#', 1)")} AS link_target FROM n WHERE NOT regexp_matches(href, '^(https?://|mailto:|tel:|ftp://)'))
SELECT link_id, link_target, alias FROM t WHERE link_target <> ''""",
    "link_parts": f"""
WITH w AS (SELECT link_id, link_target AS i, split_part(link_target, '|', 1) AS a FROM links WHERE link_type = 'wikilink'),
x AS (SELECT *, split_part(a, '^', 1) AS b FROM w), y AS (SELECT *, {_strip("split_part(b, '#', 1)")} AS t FROM x)
SELECT link_id, CASE WHEN t <> '' THEN t ELSE i END AS target, nullif({_strip("i[length(a) + 2:]")}, '') AS alias, nullif({_strip("b[length(split_part(b, '#', 1)) + 2:]")}, '') AS heading, nullif({_strip("a[length(b) + 2:]")}, '') AS block_ref FROM y""",
    "links_that_match_paths": f"""
WITH w AS (SELECT link_id, {_normalized("link_target")} AS t, {_normalized("to_note_path")} AS p, {_normalized(_stem("to_note_path"))} AS s FROM links WHERE to_note_path <> '')
SELECT link_id, t = s OR t = p OR suffix(p, '/' || t) OR suffix(p, '/' || replace(t, '-', '')) AS matches FROM w""",
    "note_labels": f"SELECT DISTINCT path, {_stem('path')} AS stem FROM note_catalog WHERE NOT {_blank('path')}",
    "coalesced_changes": """
WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)
SELECT user_id::VARCHAR AS path, arg_max(event_type = 'error', ts) AS deleted, max(ts) AS ts, count(*) AS n FROM b GROUP BY user_id, burst""",
    "valid_frontmatter": f"""
WITH e AS (SELECT chunk_id, CASE WHEN {_blank("status")} OR lower({_strip("status")}) NOT IN ('draft', 'review', 'published', 'archived') THEN 1 ELSE 0 END
  + CASE WHEN NOT {_blank("id")} AND NOT regexp_matches(lower({_strip("id")}), '^[0-9a-f]{{8}}-([0-9a-f]{{4}}-){{3}}[0-9a-f]{{12}}$') THEN 1 ELSE 0 END
  + CASE WHEN NOT {_blank("created_at")} AND try_cast({_strip("created_at")} AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END
  + CASE WHEN NOT {_blank("tags")} AND len(list_filter(list_transform(CASE WHEN json_valid(tags) AND tags LIKE '[%' THEN CAST(CAST(tags AS JSON) AS VARCHAR[]) ELSE string_split(tags, ',') END, lambda t: {_strip("t")}), lambda t: t <> '')) > 5 THEN 1 ELSE 0 END
  + CASE WHEN NOT {_blank("description")} AND length(description) > 80 THEN 1 ELSE 0 END AS n FROM chunks)
SELECT chunk_id, n = 0 AS valid, n AS n_errors FROM e""",
    "coerced_numbers": """
WITH e AS (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN k BETWEEN 10 AND 90 THEN k END AS k, CASE WHEN k < 10 THEN 'below_minimum' WHEN k > 90 THEN 'above_maximum' END AS problem FROM e""",
    "coerced_dates": f"""
WITH e AS (SELECT chunk_id, created_at, {_strip("created_at")} AS s FROM chunks),
d AS (SELECT *, CASE WHEN regexp_matches(s[1:10], '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(s[1:10] AS DATE)::VARCHAR END AS day FROM e)
SELECT chunk_id, day, CASE WHEN day IS NULL AND created_at IS NOT NULL THEN 'not_a_date' END AS problem, CASE WHEN day IS NOT NULL AND length(s) > 10 THEN 'truncated' END AS warning FROM d""",
    "normalized_targets": f"SELECT link_id, {_normalized('link_target')} AS normalized FROM links",
    "resolve_links": f"""
WITH {_NAMES},
best AS (SELECT name, arg_min(path, (priority, path)) AS resolved_path FROM names WHERE NOT {_blank("name")} GROUP BY name)
SELECT link_id, resolved_path FROM links LEFT JOIN best ON name = link_target_normalized WHERE {_INNER} AND {_blank("to_note_path")}""",
    "backlinks": f"WITH {_BACK} SELECT path, from_note_path, link_id, link_type, nullif(c, chr(1)) AS context FROM back",
    "backlink_counts": f"WITH {_BACK} SELECT path, count(*) AS backlinks FROM back GROUP BY path",
    "outlink_counts": """
SELECT from_note_path, count(*) FILTER (link_type = 'wikilink') AS wikilinks, count(*) FILTER (link_type = 'markdown') AS markdown_links, count(*) FILTER (link_type = 'embed') AS embeds,
  count(*) FILTER (link_type = 'external') AS external, count(*) FILTER (link_type IN ('wikilink', 'markdown') AND is_resolved IS NOT TRUE) AS broken
FROM links WHERE from_note_path IS NOT NULL GROUP BY from_note_path""",
    "broken_links": f"""
WITH c AS (SELECT from_note_path, count(*) AS broken_count FROM links WHERE {_INNER} AND is_resolved = false GROUP BY from_note_path)
SELECT from_note_path, broken_count, (SELECT sum(broken_count)::BIGINT FROM c) AS total_broken, (SELECT count(*) FROM c) AS total_notes FROM c ORDER BY broken_count DESC, from_note_path NULLS FIRST LIMIT 100""",
    "broken_links_in_folder": f"""
WITH c AS (SELECT from_note_path, count(*) AS broken_count FROM links WHERE {_INNER} AND is_resolved = false AND starts_with(from_note_path, 'projects/') GROUP BY from_note_path)
SELECT from_note_path, broken_count, (SELECT sum(broken_count)::BIGINT FROM c) AS total_broken, (SELECT count(*) FROM c) AS total_notes FROM c""",
    "broken_link_details": f"""
WITH b AS (SELECT * FROM links WHERE {_INNER} AND is_resolved = false),
c AS (SELECT from_note_path, count(*) AS n FROM b GROUP BY from_note_path ORDER BY n DESC, from_note_path NULLS FIRST LIMIT 100)
SELECT link_id, from_note_path, link_type, link_target FROM b WHERE from_note_path IN (SELECT from_note_path FROM c)""",
    "link_totals": f"""
SELECT count(*) AS total, count(*) FILTER ({_INNER} AND is_resolved) AS resolved, count(*) FILTER ({_INNER} AND is_resolved = false) AS broken, count(*) FILTER (link_type = 'external') AS external,
  count(*) FILTER ({_INNER} AND is_resolved) * 100 / count(*) FILTER ({_INNER}) AS resolution_rate, count(DISTINCT from_note_path) AS sources,
  count(DISTINCT to_note_path) FILTER (is_resolved AND NOT {_blank("to_note_path")}) AS targets FROM links""",
    "link_rankings": f"""
WITH s AS (SELECT from_note_path AS path, count(*) AS n FROM links WHERE from_note_path IS NOT NULL GROUP BY 1),
t AS (SELECT to_note_path AS path, count(*) AS n FROM links WHERE {_INNER} AND is_resolved AND NOT {_blank("to_note_path")} GROUP BY 1),
u AS (SELECT 'source' AS side, * FROM s UNION ALL SELECT 'target', * FROM t)
SELECT side, path, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, path) AS rank FROM u) WHERE rank <= 50""",
    "orphan_notes": f"""
WITH n AS (SELECT path, max(struct_pack(m := mtime_ns, f := folder, t := title)) AS r FROM note_catalog WHERE extension = '.md' AND NOT {_blank("path")} GROUP BY path),
i AS (SELECT * FROM links WHERE {_INNER})
SELECT path, r.f AS folder, r.t AS title, r.m AS mtime_ns FROM n WHERE path NOT IN (SELECT to_note_path FROM i WHERE to_note_path IS NOT NULL)
  AND {_normalized("path")} NOT IN (SELECT link_target_normalized FROM i WHERE link_target_normalized IS NOT NULL)
  AND {_normalized(_stem("path"))} NOT IN (SELECT link_target_normalized FROM i WHERE link_target_normalized IS NOT NULL)""",
    "corpus_totals": "SELECT count(*) AS passages, count(DISTINCT note_path) AS notes, max(modified_at) AS last_modified FROM chunks",
    "notes_by_extension": "SELECT extension, count(DISTINCT path) AS notes FROM note_catalog WHERE deleted_at IS NULL GROUP BY extension",
    "tag_counts": f"""
WITH p AS (SELECT DISTINCT note_path, tag FROM (SELECT note_path, unnest({_TAGS}) AS tag FROM chunks))
SELECT tag, count(*) AS notes, (SELECT count(DISTINCT tag) FROM p) AS total_tags, (SELECT count(DISTINCT note_path) FROM p) AS tagged_notes FROM p GROUP BY tag""",
    "tag_counts_top": f"""
WITH p AS (SELECT DISTINCT note_path, tag FROM (SELECT note_path, unnest({_TAGS}) AS tag FROM chunks WHERE folder = 'projects' OR starts_with(folder, 'projects/')))
SELECT tag, count(*) AS notes, (SELECT count(DISTINCT tag) FROM p) AS total_tags, (SELECT count(DISTINCT note_path) FROM p) AS tagged_notes FROM p GROUP BY tag ORDER BY notes DESC, tag LIMIT 50""",
    "notes_with_any_tag": f"SELECT note_path, min(chunk_id) AS chunk_id, arg_min(tags, chunk_id) AS tags FROM chunks WHERE list_has_any(list_transform({_TAGS}, lambda t: lower(t)), ['ops', 'todo']) GROUP BY note_path",
    "notes_with_all_tags": f"SELECT note_path, min(chunk_id) AS chunk_id, arg_min(tags, chunk_id) AS tags FROM chunks WHERE list_has_all(list_transform({_TAGS}, lambda t: lower(t)), ['field notes', 'home-lab']) GROUP BY note_path",
    "folder_counts": "SELECT split_part(coalesce(folder, ''), '/', 1) AS folder, count(DISTINCT path) AS notes FROM note_catalog WHERE deleted_at IS NULL GROUP BY 1",
    "folder_tree": """
WITH n AS (SELECT DISTINCT path, array_to_string(string_split(folder, '/')[1:10], '/') AS f FROM note_catalog WHERE deleted_at IS NULL AND coalesce(folder, '') <> ''),
u AS (SELECT path, f, unnest(range(1, len(string_split(f, '/')) + 1)) AS depth FROM n)
SELECT array_to_string(string_split(f, '/')[1:depth], '/') AS folder, depth, count(*) AS notes FROM u GROUP BY 1, 2""",
    "folders": f"SELECT DISTINCT folder FROM note_catalog WHERE deleted_at IS NULL AND NOT {_blank('folder')}",
    "list_notes": f"""
WITH {_LIVING}, o AS (SELECT path, r.m AS mtime_ns FROM living WHERE (r.f = 'projects' OR starts_with(r.f, 'projects/')) AND r.e = '.md')
SELECT path, mtime_ns, (SELECT count(*) FROM o) AS total, 60 < (SELECT count(*) FROM o) AS has_more FROM o ORDER BY mtime_ns DESC NULLS LAST, path LIMIT 50 OFFSET 10""",
    "recent_notes": f"WITH {_LIVING} SELECT path, r.m AS mtime_ns, (1735689600000000000 - r.m) // 86400000000000 AS days_ago FROM living WHERE r.m BETWEEN 1735689600000000000 - 365 * 86400000000000 AND 1735689600000000000",
    "daily_note": f"WITH {_LIVING} SELECT 'daily/2024-05-01.md' AS path, count(*) > 0 AS found FROM living WHERE path = 'daily/2024-05-01.md'",
    "capped_passages": "SELECT chunk_id, note_path FROM (SELECT *, row_number() OVER (PARTITION BY note_path ORDER BY chunk_no NULLS FIRST, chunk_id) AS n FROM chunks) WHERE n <= 20",
    "facet_search": f"""
SELECT chunk_id, note_path, modified_at FROM chunks WHERE contains(tags, 'o') AND lower({_strip("status")}) = 'draft' AND note_path LIKE '%.md'
  AND replace(modified_at, ' ', 'T') BETWEEN '2023-06-01' AND '2024-12-31T23:59:59.999999'""",
    "recent_passages": "SELECT chunk_id, modified_at FROM chunks WHERE replace(modified_at, ' ', 'T') >= '2024-01-02T00:00:00'",
    "sync_diff": f"""
WITH {_LIVING}, v AS (SELECT path, make_timestamp(r.m // 1000) AS mtime FROM living),
i AS (SELECT note_path AS path, max(modified_at) AS m FROM chunks WHERE NOT {_blank("note_path")} GROUP BY 1),
j AS (SELECT coalesce(v.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'new' WHEN v.path IS NULL THEN 'deleted'
  WHEN try_cast(m AS TIMESTAMP) IS NULL OR mtime > try_cast(m AS TIMESTAMP) + INTERVAL 1 SECOND THEN 'modified' END AS change FROM v FULL JOIN i ON v.path = i.path)
SELECT * FROM j WHERE change IS NOT NULL""",
    "catalog_reconcile": f"""
WITH {_LIVING}, f AS (SELECT path, min(struct_pack(m := mtime_ns, s := size)) AS r FROM note_catalog GROUP BY path),
j AS (SELECT coalesce(living.path, f.path) AS path, CASE WHEN living.path IS NULL THEN 'delete' WHEN f.path IS NULL OR living.r.m IS DISTINCT FROM f.r.m OR living.r.s IS DISTINCT FROM f.r.s THEN 'upsert' END AS action FROM living FULL JOIN f ON living.path = f.path)
SELECT * FROM j WHERE action IS NOT NULL""",
    "latest_lives": "SELECT path, r.f AS first_seen_at, r.m AS mtime_ns, r.s AS size FROM (SELECT path, max(struct_pack(f := first_seen_at, m := mtime_ns, s := size)) AS r FROM note_catalog GROUP BY path)",
    "latency_by_type": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "graph_nodes": f"""
WITH o AS (SELECT from_note_path AS path, count(*) AS n FROM links WHERE {_INNER} AND NOT {_blank("from_note_path")} GROUP BY 1),
i AS (SELECT to_note_path AS path, count(*) AS n FROM links WHERE {_INNER} AND is_resolved AND NOT {_blank("to_note_path")} GROUP BY 1)
SELECT coalesce(o.path, i.path) AS path, coalesce(o.n, 0) AS outlinks, coalesce(i.n, 0) AS backlinks FROM o FULL JOIN i ON o.path = i.path""",
    "graph_edges": _EDGES,
    "unlinked_notes": f"""
SELECT DISTINCT path FROM note_catalog WHERE deleted_at IS NULL AND NOT {_blank("path")}
  AND path NOT IN (SELECT from_note_path FROM links WHERE {_INNER} AND NOT {_blank("from_note_path")})
  AND path NOT IN (SELECT to_note_path FROM links WHERE {_INNER} AND is_resolved AND NOT {_blank("to_note_path")})""",
    "link_clusters": _clusters(_EDGES),
    "matched_clusters": _clusters("SELECT trim(source) AS source, trim(target) AS target FROM graph_edges WHERE trim(source) <> '' AND trim(target) <> ''"),
}
_ASKED = "list_distinct(list_filter(regexp_split_to_array(lower(q.title), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))"
ORACLE["reranked"] = f"""
WITH {_TERMS},
pool AS (SELECT query_id, id, rank, {_ASKED} AS asked, regexp_split_to_array(lower(coalesce(d.text, '')), '[^\\p{{L}}\\p{{N}}]+') AS own FROM ranked JOIN documents q ON q.doc_id = query_id JOIN documents d ON d.doc_id = id WHERE rank <= 10),
scores AS (SELECT query_id, id, rank, CASE WHEN len(asked) > 0 THEN round(len(list_intersect(asked, own)) / len(asked), 4) ELSE 0 END AS rerank_score FROM pool)
SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS position FROM scores"""
ORACLE["orphan_totals"] = f"""
WITH o AS ({ORACLE["orphan_notes"]}), n AS (SELECT count(DISTINCT path) AS notes FROM note_catalog WHERE extension = '.md' AND NOT {_blank("path")})
SELECT (SELECT count(*) FROM o) AS orphans, notes, round((SELECT count(*) FROM o) / greatest(notes, 1) * 100, 1) AS percentage FROM n"""
