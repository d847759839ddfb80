"""The registered queries in SQL, written without looking at trees or encoders: spans
come from arithmetic, vectors from token counts, neighbours from brute force."""

from __future__ import annotations

_PATH = """'{root}' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js'
  WHEN 'de' THEN '.go' ELSE '.rs' END"""
_DOC_PATH = _PATH.format(root="/proj/")

_SRC = f"""src AS (SELECT doc_id, source, {_DOC_PATH} AS path,
  CASE WHEN doc_id % 2 = 0 THEN '    ' || replace(text, chr(10), chr(10) || '    ') ELSE text END AS content,
  (1704067200 + doc_id) * 1000000 AS micros FROM documents)"""

_SNAPSHOTS = f"""{_SRC},
v1 AS (SELECT doc_id, path, content, md5(content) AS md5, micros FROM src),
v2 AS (SELECT doc_id, path, content, md5(content) AS md5, micros FROM (
  SELECT doc_id,
    CASE WHEN doc_id % 10 = 9 THEN '/proj/moved' || substr(path, 6) ELSE path END AS path,
    CASE WHEN doc_id % 10 <> 9 AND doc_id % 7 = 0 THEN content || chr(10) || 'end' ELSE content END AS content,
    micros + CASE WHEN doc_id % 10 = 9 THEN 0 WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 60000000
      WHEN doc_id % 3 = 0 THEN 50000 ELSE 0 END AS micros FROM src)),
plan AS (SELECT v2.*, CASE WHEN v1.path IS NULL THEN 'new'
  WHEN v1.md5 <> v2.md5 OR abs(v2.micros - v1.micros) > 100000 THEN 'changed' ELSE 'unchanged' END AS status
  FROM v2 LEFT JOIN v1 USING (path))"""


def _functions(files: str, name: str = "fn") -> str:
    """Spans and texts of the functions of ``files (doc_id, path, content)``."""
    return f"""{name}_lines AS (SELECT doc_id, path, string_split(content, chr(10)) AS ls,
    len(string_split(content, chr(10))) AS n FROM {files}),
{name}_blocks AS (SELECT doc_id, path, ls, n, i, 3 * i AS s, least(3 * i + 2, n - 1) AS e
  FROM {name}_lines, unnest(range(0, (n - 1) // 3 + 1)) AS t(i) WHERE doc_id % 11 <> 0),
{name}_spans AS (
  SELECT doc_id, path, ls, n, i, 0 AS nest, 'function_definition' AS type,
    CASE WHEN doc_id % 17 = 0 AND i = 0 THEN 0 ELSE s END AS line,
    CASE WHEN doc_id % 17 = 0 AND i = 0 THEN 0 ELSE e END AS end_line FROM {name}_blocks
  UNION ALL
  SELECT doc_id, path, ls, n, i, 1, 'method_definition', s + 1, e FROM {name}_blocks WHERE i % 2 = 0 AND e > s),
{name}_cut AS (SELECT *, [CASE WHEN regexp_full_match(x, '[ \\t]+') THEN '' ELSE x END
  FOR x IN ls[line + 1 : least(end_line + 1, n)]] AS part FROM {name}_spans),
{name} AS (SELECT doc_id, path, type, line, end_line, ls, n,
  row_number() OVER (PARTITION BY doc_id ORDER BY i, nest) - 1 AS ord,
  {_dedented('part')} AS text FROM {name}_cut)"""


def _dedented(part: str) -> str:
    margin = f"coalesce(list_min([len(x) - len(ltrim(x, ' ')) FOR x IN {part} IF x <> '']), 0)"
    return f"array_to_string([substr(x, {margin} + 1) FOR x IN {part}], chr(10))"


_USABLE = "doc_id % 23 <> 0 AND doc_id % 19 <> 0"
_EXTRACT = f"WITH {_SRC}, files AS (SELECT * FROM src WHERE {_USABLE}), {_functions('files')}"


def _readable(lines: str) -> str:
    """Number of lines without the empty one after a last newline."""
    return f"(CASE WHEN {lines}[-1] = '' THEN len({lines}) - 1 ELSE len({lines}) END)"


def _rstrip(text: str) -> str:
    return f"regexp_replace({text}, '\\s+$', '')"


_TEXT50 = "array_to_string(ls[line + 1 : least(line + 50, {n})], chr(10))"

_LIVE_VIEW = f"""{_SNAPSHOTS}, {_functions('v1', 'f1')},
todo AS (SELECT doc_id, path, content, md5, status FROM plan WHERE status <> 'unchanged'),
{_functions('todo', 'f2')},
ids1 AS (SELECT path, ord, line, row_number() OVER (ORDER BY path, ord) - 1 AS vector_id FROM f1),
ids2 AS (SELECT path, ord, line, (SELECT count(*) FROM ids1) + row_number() OVER (ORDER BY path, ord) - 1 AS vector_id FROM f2),
live AS (SELECT vector_id, path, ord, line FROM ids1 WHERE path NOT IN (SELECT path FROM todo)
  UNION ALL SELECT vector_id, path, ord, line FROM ids2)"""

_VECTORS = f"""vectors AS (SELECT vec_id AS vector_id, embedding::DOUBLE[] AS e,
  coalesce(d.path, '/proj/none/' || vec_id || '.txt') AS path, coalesce(vec_id % d.n, 0)::INT AS line
  FROM embeddings LEFT JOIN (SELECT doc_id, {_DOC_PATH} AS path, len(string_split(text, chr(10))) AS n FROM documents) d
  ON vec_id = d.doc_id)"""
_ALLOWED = f"SELECT {_DOC_PATH} AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"
_ONE_QUERY = "asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_QUERIES = """asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings
  WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))"""


def _ranked(asked: str, where: str = "true") -> str:
    return f"""{_VECTORS}, {asked},
scored AS (SELECT query_id, vector_id, path, line, list_dot_product(e, q) AS score FROM vectors, asked WHERE {where}),
hits AS (SELECT query_id, rank, score, vector_id, path, line FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vector_id) AS rank FROM scored) WHERE rank <= 5)"""


def _top(asked: str, where: str = "true") -> str:
    return f"WITH {_ranked(asked, where)} SELECT query_id, rank, round(score, 6) AS score, vector_id, path, line FROM hits"


_EXT = "lower(regexp_extract(path, '[^/.][^/]*\\.([^./]*)$', 1))"

_SNIPPETS = f"""WITH {_ranked(_QUERIES)}, {_SRC},
opened AS (SELECT h.*, string_split(content, chr(10)) AS ls FROM hits h JOIN src USING (path)),
around AS (SELECT *, greatest(line - 2, 0) + 1 AS start_line, least(line + 3, {_readable('ls')}) AS end_line FROM opened),
shown AS (SELECT query_id, rank, score, path, line, start_line, end_line,
  {_rstrip("array_to_string(ls[start_line : end_line], chr(10))")} AS snippet FROM around)"""

_LANG = """CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.ts' THEN 'typescript'
  WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.java' THEN 'java'
  WHEN path LIKE '%.rb' THEN 'ruby' WHEN path LIKE '%.php' THEN 'php' WHEN path LIKE '%.c' OR path LIKE '%.h' THEN 'c'
  WHEN path LIKE '%.cpp' OR path LIKE '%.hpp' THEN 'cpp'
  WHEN path LIKE '%.kt' OR path LIKE '%.kts' OR path LIKE '%.ktm' THEN 'kotlin'
  WHEN path LIKE '%.vala' OR path LIKE '%.vapi' THEN 'vala' ELSE '' END"""


def _encoded(table: str, key: str, out: str) -> str:
    """Sparse unit vectors ``(key, bucket, value)`` from token counts."""
    return f"""{out}_tokens AS (SELECT {key}, unnest(string_split(replace(lower(text), chr(10), ' '), ' ')) AS w FROM {table}),
{out}_counts AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS bucket, count(*) AS c FROM {out}_tokens WHERE w <> '' GROUP BY ALL),
{out} AS (SELECT {key}, bucket, (c / sqrt(sum(c * c) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS value FROM {out}_counts)"""


_POINTS = f"""{_encoded('documents', 'doc_id', 'enc')},
whole AS (SELECT doc_id, list((bucket, value) ORDER BY bucket) AS vec FROM enc GROUP BY doc_id),
points AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY vec) AS cluster_id, count(*) OVER (PARTITION BY vec) AS size FROM whole)"""

_PAIRS = """pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 1.2)"""


def _identical(condition: str) -> str:
    """Clusters of copies with their members and member texts."""
    return f"""WITH {_POINTS},
opened AS (SELECT p.*, {_DOC_PATH} AS path, 0 AS line, string_split(text, chr(10)) AS ls FROM points p JOIN documents USING (doc_id) WHERE size > 1),
texts AS (SELECT *, {_rstrip(_TEXT50.format(n=_readable('ls')))} AS text FROM opened),
counted AS (SELECT *, len(string_split(text, chr(10))) AS line_count FROM texts),
kept AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS cluster_no FROM counted GROUP BY cluster_id HAVING {condition}),
members AS (SELECT k.cluster_no, c.* FROM counted c JOIN kept k USING (cluster_id))"""


def _ward(points: str, height: float) -> str:
    """Rounds of mutual merges over all pairs of clusters, until no pair is below ``height``."""
    return f"""WITH RECURSIVE {points},
state(step, id, w, c, members) AS (
  SELECT 0, id, w, v, [{{'id': id, 'leaf': 0.0::DOUBLE}}] FROM pts
  UNION ALL
  (WITH near AS (SELECT a.id AS lo, b.id AS hi, a.w AS wa, b.w AS wb,
      2.0 * a.w * b.w / (a.w + b.w) * power(list_distance(a.c, b.c), 2) AS h2 FROM state a JOIN state b ON a.id < b.id),
    ends AS (SELECT lo AS id, lo, hi, h2 FROM near WHERE h2 < {height * height!r} UNION ALL SELECT hi, lo, hi, h2 FROM near WHERE h2 < {height * height!r}),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h2, lo, hi) AS r FROM ends) WHERE r = 1),
    merges AS (SELECT lo, hi, any_value(h2) AS h2 FROM best GROUP BY lo, hi HAVING count(*) = 2)
  SELECT a.step + 1, a.id, a.w + b.w, [(x[1] * a.w + x[2] * b.w) / (a.w + b.w) FOR x IN list_zip(a.c, b.c)],
    CASE WHEN a.w = 1 AND b.w = 1 THEN [{{'id': a.id, 'leaf': sqrt(h2)}}, {{'id': b.id, 'leaf': sqrt(h2)}}]
      ELSE list_concat(a.members, b.members) END
  FROM merges JOIN state a ON a.id = lo JOIN state b ON b.id = hi
  UNION ALL
  SELECT s.step + 1, s.id, s.w, s.c, s.members FROM state s
  WHERE s.id NOT IN (SELECT lo FROM merges UNION ALL SELECT hi FROM merges) AND EXISTS (SELECT 1 FROM merges))),
last AS (SELECT id AS cluster_id, w AS size, unnest(members) AS m FROM state WHERE step = (SELECT max(step) FROM state))"""


_DENSE = f"""{_encoded('documents', 'doc_id', 'enc')},
dense AS (SELECT doc_id, list(coalesce(value, 0.0) ORDER BY b) AS v FROM (SELECT DISTINCT doc_id FROM enc)
  CROSS JOIN (SELECT unnest(range(256)) AS b) LEFT JOIN (SELECT doc_id, bucket AS b, value FROM enc) USING (doc_id, b) GROUP BY doc_id),
pts AS (SELECT min(doc_id) AS id, count(*) AS w, v FROM dense GROUP BY v)"""

_WARD = f"""{_ward(_DENSE, 0.2)},
points AS (SELECT cluster_id, size, m.id AS id, m.leaf AS leaf FROM last WHERE size > 1),
found AS (SELECT cluster_id, any_value(size) AS size, max(leaf) FILTER (WHERE p.id = cluster_id) AS first_merge_distance,
  sum(b.w * list_distance(a.v, b.v)) / (any_value(size) - 1) AS avg_distance
  FROM points p JOIN pts a ON a.id = cluster_id JOIN pts b ON b.id = p.id GROUP BY cluster_id)"""


def _merges(points: str, height: float) -> str:
    """The same rounds, with every merge written down: (id, into, h, size)."""
    return _ward(points, height).replace(
        "[{'id': id, 'leaf': 0.0::DOUBLE}]", "[]::STRUCT(id BIGINT, \"into\" BIGINT, h DOUBLE, size BIGINT)[]"
    ).replace(
        "CASE WHEN a.w = 1 AND b.w = 1 THEN [{'id': a.id, 'leaf': sqrt(h2)}, {'id': b.id, 'leaf': sqrt(h2)}]\n      ELSE list_concat(a.members, b.members) END",
        "list_concat(list_concat(a.members, b.members), [{'id': b.id, 'into': a.id, 'h': sqrt(h2), 'size': a.w + b.w}])",
    )


_ENTRY = """'    ' || path || ':' || line || chr(10)
        || array_to_string([CASE WHEN regexp_full_match(x, '\\s*') THEN x ELSE '    ' || x END FOR x IN string_split(text, chr(10))], chr(10)) || chr(10)"""
_EMBEDDED = "pts AS (SELECT vec_id AS id, 1 AS w, embedding::DOUBLE[] AS v FROM embeddings)"


SQL: dict[str, str] = {
    "merge_tree": f"""{_merges(_EMBEDDED, 1.2)}
        SELECT row_number() OVER (ORDER BY round(m.h, 9), m."into", m.id) - 1 AS step, m."into" AS "left", m.id AS "right",
          round(m.h, 6) AS height, m.size AS size FROM last""",
    "cut_tree": " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS max_distance, vector_id, cluster_id FROM ({_ward(_EMBEDDED, t)} SELECT m.id AS vector_id, cluster_id FROM last)" for t in (1.0, 1.1, 1.2)
    ),
    "tree_clusters": " UNION ALL ".join(
        f"""SELECT {t}::DOUBLE AS max_distance, cluster_id, size, first_merge_distance FROM ({_ward(_DENSE, t)}
        SELECT cluster_id, any_value(size) AS size, round(max(m.leaf) FILTER (WHERE m.id = cluster_id), 6) AS first_merge_distance FROM last WHERE size > 1 GROUP BY cluster_id)"""
        for t in (0.2, 0.1)
    ),
    "clusters_after_upsert": f"""{_WARD.replace(_encoded('documents', 'doc_id', 'enc'), """edited AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 13 <> 0
          UNION ALL SELECT doc_id + 1000000, text || chr(10) || 'end' FROM documents WHERE doc_id % 7 = 0), """ + _encoded('edited', 'doc_id', 'enc'))}
        SELECT cluster_id, size, round(first_merge_distance, 6) AS first_merge_distance, round(avg_distance, 6) AS avg_distance FROM found""",
    "manifest_scan": f"""SELECT {_DOC_PATH} AS path, CASE WHEN doc_id % 19 <> 0 THEN {_DOC_PATH} || '.tree' END AS tree_path
        FROM documents WHERE doc_id % 23 <> 0
        UNION ALL SELECT '/proj/' || source || '/gone.py', '/proj/' || source || '/gone.py.tree' FROM (SELECT DISTINCT source FROM documents)""",
    "manifest_rejects": f"""SELECT CASE WHEN doc_id % 23 <> 0 THEN {_DOC_PATH} END AS path,
        CASE WHEN doc_id % 19 <> 0 THEN {_DOC_PATH} || '.tree' END AS tree_path,
        CASE WHEN doc_id % 23 = 0 THEN 'no path' ELSE 'no tree path' END AS reason
        FROM documents WHERE doc_id % 23 = 0 OR doc_id % 19 = 0
        UNION ALL SELECT '/proj/' || source || '/gone.py', '/proj/' || source || '/gone.py.tree', 'source not found'
        FROM (SELECT DISTINCT source FROM documents)""",
    "manifest_summary": """SELECT (SELECT count(*) FROM documents WHERE doc_id % 23 <> 0) + (SELECT count(DISTINCT source) FROM documents) AS entries,
        (SELECT count(*) FROM documents WHERE doc_id % 23 <> 0) + (SELECT count(DISTINCT source) FROM documents) AS files,
        (SELECT count(*) FROM documents WHERE doc_id % 23 <> 0 AND doc_id % 19 <> 0) + (SELECT count(DISTINCT source) FROM documents) AS with_tree""",
    "manifest_config": """SELECT CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, 'token-hash-256') ELSE 'token-hash-256' END AS model_name,
        CASE WHEN doc_id % 4 = 0 THEN (doc_id % 64)::INT ELSE 32 END AS batch_size, count(*) AS manifests FROM documents GROUP BY 1, 2""",
    "source_decode": f"""SELECT {_DOC_PATH} AS path, text AS content, (1704067200 + doc_id) * 1000000 AS mtime_micros,
        md5(CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13)) ELSE text END) AS md5
        FROM documents WHERE doc_id % 29 <> 0""",
    "listed_files": f"""SELECT CASE WHEN doc_id % 23 <> 0 THEN {_DOC_PATH} END AS path, CASE WHEN doc_id % 19 <> 0 THEN {_DOC_PATH} || '.tree' END AS tree_path,
        CASE WHEN doc_id % 23 <> 0 AND doc_id % 29 <> 0 THEN text END AS content,
        CASE WHEN doc_id % 23 <> 0 AND doc_id % 29 <> 0 THEN md5(CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10))
          WHEN 1 THEN replace(text, chr(10), chr(13)) ELSE text END) END AS md5,
        doc_id % 23 <> 0 AND doc_id % 29 <> 0 AND doc_id % 19 <> 0 AS has_tree,
        CASE WHEN doc_id % 23 = 0 THEN 'no path' WHEN doc_id % 29 = 0 THEN 'not valid UTF-8' WHEN doc_id % 19 = 0 THEN 'no tree path' END AS reason
        FROM documents
        UNION ALL SELECT '/proj/' || source || '/gone.py', '/proj/' || source || '/gone.py.tree', NULL, NULL, false, 'source not found'
        FROM (SELECT DISTINCT source FROM documents)""",
    "source_rejects": f"SELECT {_DOC_PATH} AS path, 'not valid UTF-8' AS reason FROM documents WHERE doc_id % 29 = 0",
    "model_encode": """WITH raw AS (SELECT doc_id, [length(text), length(text) - length(replace(text, ' ', '')), 1]::DOUBLE[] AS v FROM documents),
        unit AS (SELECT doc_id, [(x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE FOR x IN v] AS u FROM raw)
        SELECT doc_id AS vector_id, 3 AS dim, round(u[1], 5) AS v0, round(u[2], 5) AS v1, round(u[3], 5) AS v2 FROM unit""",
    "search_blank": f"""WITH asked AS (SELECT item_id, text FROM benchmark WHERE item_id % 3 <> 0), {_encoded('asked', 'item_id', 'ask')}
        SELECT item_id AS query_id, count(*)::INT AS buckets FROM ask GROUP BY item_id""",
    "search_mismatch": f"""WITH {_SNAPSHOTS}, {_functions('v1')}
        SELECT 'table was built with token-hash-256, not token-hash-64' AS refused, count(*) AS vectors FROM fn""",
    "cluster_report_near": f"""{_WARD},
        owners AS (SELECT p.cluster_id, d.doc_id FROM points p JOIN pts ON pts.id = p.id JOIN dense d ON d.v = pts.v),
        opened AS (SELECT o.cluster_id, doc_id, {_DOC_PATH} AS path, 0 AS line, string_split(text, chr(10)) AS ls FROM owners o JOIN documents USING (doc_id)),
        texts AS (SELECT *, {_rstrip(_TEXT50.format(n=_readable('ls')))} AS text FROM opened),
        kept AS (SELECT cluster_id, first_merge_distance AS d, row_number() OVER (ORDER BY cluster_id) - 1 AS cluster_no FROM found WHERE first_merge_distance <> 0)
        SELECT cluster_no, -1 AS vector_id, 'Cluster #' || cluster_no || ': avg_distance: ' || printf('%.3g', d) || ' ' || repeat('=', 48) || chr(10) AS text FROM kept
        UNION ALL SELECT cluster_no, doc_id, {_ENTRY} FROM texts JOIN kept USING (cluster_id)""",
    "cluster_build": f"""WITH {_SNAPSHOTS}, {_functions('v1', 'f1')},
        ids AS (SELECT row_number() OVER (ORDER BY path, ord) - 1 AS vector_id, path, line, ls, text FROM f1), {_encoded('ids', 'vector_id', 'enc')},
        whole AS (SELECT vector_id, list((bucket, value) ORDER BY bucket) AS vec FROM enc GROUP BY vector_id),
        points AS (SELECT vector_id, min(vector_id) OVER (PARTITION BY vec) AS cluster_id, count(*) OVER (PARTITION BY vec) AS size FROM whole),
        texts AS (SELECT cluster_id, vector_id, path, line, {_rstrip(_TEXT50.format(n=_readable('ls')))} AS text FROM points JOIN ids USING (vector_id) WHERE size > 1),
        kept AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS cluster_no FROM (SELECT DISTINCT cluster_id FROM texts))
        SELECT cluster_no, -1 AS vector_id, 'Cluster #' || cluster_no || ': avg_distance: 0.0 ' || repeat('=', 48) || chr(10) AS text FROM kept
        UNION ALL SELECT cluster_no, vector_id, {_ENTRY} FROM texts JOIN kept USING (cluster_id)""",
    "path_normalize": """SELECT page_id,
        '/srv/' || split_part(url, '/', 3) || rtrim('/' || substr(url, len(split_part(url, '://', 1) || '://' || split_part(url, '/', 3)) + 2), '/') AS path,
        '/root/dir/' || split_part(url, '/', 3) || '/x' AS below_root FROM pages""",
    "file_fingerprint": f"""WITH {_SRC} SELECT path, substr(sha256(path), 1, 16) AS file_key, md5(content) AS md5, micros AS mtime_micros FROM src""",
    "ext_and_language": f"""SELECT path, {_EXT} AS ext, {_LANG} AS lang_tag
        FROM (SELECT {_DOC_PATH} AS path FROM documents UNION ALL SELECT url FROM pages)""",
    "ext_list": """SELECT doc_id, array_to_string(list_sort(list_distinct([lang, source, 'py'])), '|') AS exts FROM documents""",
    "change_plan": f"WITH {_SNAPSHOTS} SELECT path, md5, status FROM plan",
    "change_plan_counts": f"WITH {_SNAPSHOTS} SELECT status, count(*) AS files FROM plan GROUP BY status",
    "change_plan_force": f"""WITH {_SNAPSHOTS} SELECT CASE status WHEN 'unchanged' THEN 'forced' ELSE status END AS status,
        count(*) AS files FROM plan GROUP BY 1""",
    "deleted_files": f"WITH {_SNAPSHOTS} SELECT path FROM v1 WHERE path NOT IN (SELECT path FROM v2)",
    "extract_functions": f"{_EXTRACT} SELECT path, ord, line, end_line, text FROM fn",
    "extract_in_pieces": f"{_EXTRACT} SELECT path, ord, line, end_line, text FROM fn",
    "extract_nested": f"""{_EXTRACT} SELECT path, row_number() OVER (PARTITION BY path ORDER BY ord) - 1 AS ord, line, end_line, text
        FROM fn WHERE type = 'method_definition'""",
    "extract_malformed": f"""{_EXTRACT} SELECT path, count(fn.path) AS functions FROM files LEFT JOIN fn USING (path) GROUP BY path""",
    "dedent_text": f"""WITH {_SRC}, parts AS (SELECT path, [CASE WHEN regexp_full_match(x, '[ \\t]+') THEN '' ELSE x END
        FOR x IN string_split(content, chr(10))] AS part FROM src) SELECT path, {_dedented('part')} AS text FROM parts""",
    "function_text_50": f"""{_EXTRACT}, texts AS (SELECT path, ord, line, {_rstrip(_TEXT50.format(n=_readable('ls')))} AS text FROM fn)
        SELECT *, len(string_split(text, chr(10))) AS line_count FROM texts""",
    "function_text_ranges": f"""{_EXTRACT}, texts AS (SELECT path, ord, line, {_rstrip(_TEXT50.format(n=_readable('ls')))} AS text FROM fn)
        SELECT *, len(string_split(text, chr(10))) AS line_count FROM texts""",
    "vector_normalize": """SELECT vec_id, pos, round((x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE, 6) AS value FROM (
        SELECT vec_id, [(y * 3)::FLOAT::DOUBLE FOR y IN embedding] AS v FROM embeddings) t, unnest(v) WITH ORDINALITY AS u(x, p), LATERAL (SELECT p - 1 AS pos)""",
    "hash_encode": f"WITH {_encoded('documents', 'doc_id', 'enc')} SELECT doc_id AS vector_id, bucket, round(value, 6) AS value FROM enc",
    "assign_vector_ids": f"{_EXTRACT} SELECT path, ord, row_number() OVER (ORDER BY path, ord) - 1 AS vector_id FROM fn",
    "assign_vector_ids_levels": f"{_EXTRACT} SELECT path, ord, row_number() OVER (ORDER BY path, ord) - 1 AS vector_id FROM fn",
    "files_arrays": f"""WITH {_SRC}, {_functions('src')}, numbered AS (SELECT *, row_number() OVER (ORDER BY path, ord) - 1 AS vector_id FROM fn)
        SELECT src.path, substr(sha256(src.path), 1, 16) AS file_key, md5(any_value(content)) AS md5,
        coalesce(string_agg(vector_id::VARCHAR, ',' ORDER BY ord), '') AS vector_ids,
        coalesce(string_agg(line::VARCHAR, ',' ORDER BY ord), '') AS function_lines
        FROM src LEFT JOIN numbered USING (path) GROUP BY src.path""",
    "upsert_current_view": f"WITH {_LIVE_VIEW} SELECT vector_id, path, ord, line FROM live",
    "delete_missing": f"WITH {_LIVE_VIEW} SELECT vector_id, path, ord, line FROM live WHERE path IN (SELECT path FROM v2)",
    "remove_files": f"""WITH {_SNAPSHOTS}, {_functions('v1', 'f1')}, allowed AS ({_ALLOWED}),
        ids AS (SELECT path, line, row_number() OVER (ORDER BY path, ord) - 1 AS vector_id FROM f1)
        SELECT path, line, vector_id FROM ids WHERE NOT (starts_with(path, '/proj/src1') AND path IN (SELECT path FROM allowed))""",
    "compacted_view": f"WITH {_LIVE_VIEW} SELECT path, line, vector_id FROM live WHERE path IN (SELECT path FROM v2)",
    "model_switch": f"""WITH {_SNAPSHOTS}, {_functions('v2')} SELECT 'token-hash-64' AS model_name, 64 AS dim, count(*) AS next_vector_id,
        count(*) AS vectors, 0 AS first_id, count(*) - 1 AS last_id FROM fn""",
    "stream_ingest": f"WITH {_LIVE_VIEW} SELECT path, ord, line FROM live",
    "stream_changes": f"""WITH RECURSIVE {_SNAPSHOTS},
        arrived AS (SELECT 1 AS start, path, md5, micros FROM v2 WHERE doc_id % 4 = 0 UNION ALL SELECT 1, path, md5, micros FROM v1 WHERE doc_id % 4 <> 0
          UNION ALL SELECT 2, path, md5, micros FROM v1 WHERE doc_id % 4 = 0 UNION ALL SELECT 2, path, md5, micros FROM v2 WHERE doc_id % 4 <> 0
          UNION ALL SELECT 3, path, md5, micros FROM v2),
        turns AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start) AS n FROM arrived),
        judged AS (SELECT path, n, md5, micros, 'new' AS status, 1 AS version, md5 AS kept_md5, micros AS kept_micros FROM turns WHERE n = 1
          UNION ALL SELECT path, n, md5, micros, status, version + CASE status WHEN 'changed' THEN 1 ELSE 0 END,
            CASE status WHEN 'changed' THEN md5 ELSE kept_md5 END, CASE status WHEN 'changed' THEN micros ELSE kept_micros END
          FROM (SELECT t.*, j.version, j.kept_md5, j.kept_micros, CASE WHEN t.micros < j.kept_micros - 100000 THEN 'late'
              WHEN t.md5 = j.kept_md5 AND t.micros <= j.kept_micros + 100000 THEN 'unchanged' ELSE 'changed' END AS status
            FROM judged j JOIN turns t ON t.path = j.path AND t.n = j.n + 1))
        SELECT path, md5, micros, status, version FROM judged""",
    "encode_once": f"""WITH {_SNAPSHOTS}, {_functions('v1', 'f1')},
        todo AS (SELECT doc_id, path, content, md5, status FROM plan WHERE status <> 'unchanged'), {_functions('todo', 'f2')},
        batches AS (SELECT text, min(batch) AS batch FROM (SELECT text, 0 AS batch FROM f1 UNION ALL SELECT text, 1 FROM f2) GROUP BY text),
        seen AS (SELECT text, sha256(text) AS digest, batch FROM batches), {_encoded('seen', 'digest', 'enc')},
        whole AS (SELECT digest, coalesce(list((bucket, value) ORDER BY bucket) FILTER (bucket IS NOT NULL), []) AS vec,
          count(bucket) AS buckets, coalesce(sum(value), 0) AS total FROM seen LEFT JOIN enc USING (digest) GROUP BY digest),
        live AS (SELECT text FROM f1 WHERE path NOT IN (SELECT path FROM todo) UNION ALL SELECT text FROM f2),
        used AS (SELECT vec, count(*) AS functions FROM live JOIN whole ON digest = sha256(text) GROUP BY vec)
        SELECT digest, batch, buckets, round(total, 6) AS total, coalesce(functions, 0) AS functions
        FROM whole JOIN seen USING (digest) LEFT JOIN used USING (vec)""",
    "orphan_vectors": f"WITH {_VECTORS} SELECT vector_id, path FROM vectors WHERE vector_id NOT IN (SELECT doc_id FROM labels)",
    "orphan_prune": f"WITH {_VECTORS} SELECT vector_id, path, line FROM vectors WHERE vector_id IN (SELECT doc_id FROM labels)",
    "index_counts": """SELECT count(*) AS vectors, count(*) FILTER (WHERE vec_id NOT IN (SELECT doc_id FROM labels)) AS orphans FROM embeddings""",
    "list_functions": f"""SELECT path, l AS line, doc_id * 1000 + l AS vector_id
        FROM (SELECT doc_id, {_DOC_PATH} AS path, unnest(range(0, least(len(string_split(text, chr(10))), doc_id % 5 + 1))) AS l FROM documents)""",
    "vectors_by_id": """SELECT vec_id AS vector_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings
        WHERE vec_id IN (SELECT item_id FROM benchmark)""",
    "vector_ids_of_files": f"WITH {_VECTORS} SELECT path, vector_id FROM vectors WHERE path IN ({_ALLOWED})",
    "search_topk": _top(_ONE_QUERY),
    "search_topk_ext": _top(_ONE_QUERY, f"{_EXT} IN ('py', 'js')"),
    "search_topk_files": _top(_ONE_QUERY, f"path IN ({_ALLOWED})"),
    "search_topk_both": _top(_ONE_QUERY, f"path IN ({_ALLOWED}) AND {_EXT} = 'py'"),
    "search_live": _top(_QUERIES, "vector_id IN (SELECT doc_id FROM labels)"),
    "search_batch": _top(_QUERIES),
    "search_all_pairs_of_blocks": _top("asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings)"),
    "search_cells": f"""WITH {_encoded('documents', 'doc_id', 'enc')},
        dots AS (SELECT a.doc_id AS query_id, b.doc_id AS vector_id, sum(a.value * b.value) AS dot FROM enc a JOIN enc b USING (bucket) GROUP BY ALL),
        scored AS (SELECT q.doc_id AS query_id, d.doc_id AS vector_id, coalesce(dot, 0) AS score
          FROM documents q CROSS JOIN documents d LEFT JOIN dots ON dots.query_id = q.doc_id AND dots.vector_id = d.doc_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vector_id) AS rank FROM scored)
        SELECT query_id, rank, round(score, 6) AS score, vector_id, path, 0 AS line
        FROM ranked JOIN (SELECT doc_id, {_DOC_PATH} AS path FROM documents) ON doc_id = vector_id WHERE rank <= 5""",
    "text_search": f"""WITH {_encoded('documents', 'doc_id', 'enc')}, {_encoded('benchmark', 'item_id', 'ask')},
        scored AS (SELECT item_id, doc_id, sum(enc.value * ask.value) AS score FROM ask JOIN enc USING (bucket) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
        SELECT item_id AS query_id, rank, round(score, 6) AS score, doc_id AS vector_id, {_DOC_PATH} AS path, 0 AS line
        FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5""",
    "stored_search": f"""WITH {_SNAPSHOTS}, {_functions('v1')},
        ids AS (SELECT row_number() OVER (ORDER BY path, ord) - 1 AS vector_id, path, line, text FROM fn),
        {_encoded('ids', 'vector_id', 'enc')}, {_encoded('benchmark', 'item_id', 'ask')},
        wanted AS (SELECT item_id, vector_id FROM ids, (SELECT DISTINCT item_id FROM ask) WHERE {_EXT} IN ('py', 'js')),
        dots AS (SELECT item_id, vector_id, sum(enc.value * ask.value) AS dot FROM ask JOIN enc USING (bucket) GROUP BY ALL),
        scored AS (SELECT item_id, vector_id, coalesce(dot, 0) AS score FROM wanted LEFT JOIN dots USING (item_id, vector_id)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, vector_id) AS rank FROM scored)
        SELECT item_id AS query_id, rank, round(score, 6) AS score, vector_id, path, line FROM ranked JOIN ids USING (vector_id) WHERE rank <= 5""",
    "hit_snippets": f"{_SNIPPETS} SELECT query_id, rank, path, start_line, end_line, snippet FROM shown",
    "hit_snippet_ranges": f"{_SNIPPETS} SELECT query_id, rank, path, start_line, end_line, snippet FROM shown",
    "search_markdown": f"""{_SNIPPETS}, blocks AS (SELECT query_id, string_agg(
        '## Result ' || rank || ' (score: ' || printf('%.3f', score) || ')' || chr(10) || '**File:** `' || path || ':' || (line + 1) || '`'
        || chr(10) || chr(10) || '```' || {_LANG} || ':' || start_line || ':' || end_line || chr(10) || snippet || chr(10) || '```' || chr(10),
        chr(10) ORDER BY rank) AS body FROM shown GROUP BY query_id)
        SELECT query_id, '# Search Results' || chr(10) || coalesce(chr(10) || body, '') AS markdown FROM asked LEFT JOIN blocks USING (query_id)""",
    "eps_join": f"WITH {_PAIRS} SELECT a, b, round(distance, 6) AS distance FROM pairs",
    "eps_join_tree": f"WITH {_PAIRS} SELECT a, b, round(distance, 6) AS distance FROM pairs",
    "connected_components": f"""WITH RECURSIVE {_PAIRS}, edges AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach(node, other) AS (SELECT u, u FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.other = e.u)
        SELECT node, min(other) AS component FROM reach GROUP BY node""",
    "nearest_neighbour": f"""WITH {_PAIRS}, each AS (SELECT a AS id, b AS partner, distance FROM pairs UNION ALL SELECT b, a, distance FROM pairs)
        SELECT id, partner, round(distance, 6) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, partner) AS r FROM each) WHERE r = 1""",
    "dup_vectors": f"WITH {_POINTS} SELECT cluster_id AS vector_id, any_value(size) AS copies FROM points GROUP BY cluster_id",
    "ward_labels": f"""{_ward("pts AS (SELECT vec_id AS id, 1 AS w, embedding::DOUBLE[] AS v FROM embeddings)", 1.2)}
        SELECT m.id AS vector_id, cluster_id FROM last""",
    "ward_clusters": f"""{_WARD} SELECT cluster_id, size, round(first_merge_distance, 6) AS first_merge_distance,
        round(avg_distance, 6) AS avg_distance FROM found""",
    "cluster_filters": f"""{_WARD},
        owners AS (SELECT p.cluster_id, d.doc_id FROM points p JOIN pts ON pts.id = p.id JOIN dense d ON d.v = pts.v),
        opened AS (SELECT o.cluster_id, doc_id, {_DOC_PATH} AS path, 0 AS line, string_split(text, chr(10)) AS ls FROM owners o JOIN documents USING (doc_id)),
        texts AS (SELECT *, len(string_split({_rstrip(_TEXT50.format(n=_readable('ls')))}, chr(10))) AS line_count FROM opened),
        kept AS (SELECT f.cluster_id, f.size, f.first_merge_distance, row_number() OVER (ORDER BY f.cluster_id) - 1 AS cluster_no FROM found f
          WHERE first_merge_distance <> 0 AND (SELECT min(line_count) FROM texts t WHERE t.cluster_id = f.cluster_id) > 2)
        SELECT cluster_no, cluster_id, size, round(first_merge_distance, 6) AS avg_distance, doc_id AS vector_id, path, line, line_count
        FROM kept JOIN texts USING (cluster_id)""",
    "identical_clusters": f"""{_identical("count(*) >= 3 AND min(line_count) > 3")}
        SELECT cluster_no, cluster_id, doc_id AS vector_id, path, line, line_count FROM members""",
    "cluster_report": f"""{_identical("min(line_count) > 0")}
        SELECT cluster_no, -1 AS vector_id, 'Cluster #' || cluster_no || ': avg_distance: 0.0 ' || repeat('=', 48) || chr(10) AS text FROM kept
        UNION ALL SELECT cluster_no, doc_id, '    ' || path || ':' || line || chr(10)
        || array_to_string([CASE WHEN regexp_full_match(x, '\\s*') THEN x ELSE '    ' || x END FOR x IN string_split(text, chr(10))], chr(10)) || chr(10) FROM members""",
}

# the same result by other routes
SQL |= {name: SQL["ward_labels"] for name in ("ward_labels_rounds", "ward_labels_levels")}
