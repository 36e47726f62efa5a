"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark implementation: patterns are matched with
DuckDB's GLOB per path component, orders with window functions over
list-of-struct keys, trees with string_agg -- so a shared bug in the library's
glob compiler or ordered scan would show up as a mismatch.
"""

from __future__ import annotations

from sheaf.functions.patterns import sql_str

# Fixed values, typed here once more so that a wrong table in the library shows.
LANGUAGE_BY_EXT = {
    "rs": "rust", "js": "javascript", "ts": "typescript", "py": "python", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "go": "go", "rb": "ruby", "php": "php",
    "swift": "swift", "kt": "kotlin", "scala": "scala", "r": "r", "m": "objective-c", "pl": "perl", "lua": "lua",
    "sh": "bash", "bash": "bash", "sql": "sql", "html": "html", "htm": "html", "css": "css", "xml": "xml",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown",
}
DEFAULT_PATTERNS = [".*", "node_modules", "__pycache__", "target", "build", "dist", "_*"]
ROOT_PROFILES = {"src0": [".*", "node_modules"], "src1": [], "src2": ["*.rs", "d?c_1*"]}

# ---------------------------------------------------------------- CTE library
CTE = {}

CTE["files"] = """files AS (
  SELECT source AS root_id,
    concat(CASE (doc_id // 20) % 8 WHEN 0 THEN 'src' WHEN 1 THEN 'tests' WHEN 2 THEN 'docs'
             WHEN 3 THEN 'node_modules' WHEN 4 THEN '.cache' WHEN 5 THEN '_gen' WHEN 6 THEN 'Src' ELSE 'lib' END,
      '/', lang, '/', CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END,
      CASE WHEN doc_id % 13 = 0 THEN 'Doc_' ELSE 'doc_' END, CAST(doc_id AS VARCHAR),
      CASE (doc_id // 20) % 7 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.js' WHEN 3 THEN '.md'
             WHEN 4 THEN '.TXT' WHEN 5 THEN '.tar.gz' ELSE '' END) AS rel_path,
    text AS content, doc_id
  FROM documents)"""

CTE["fanc"] = """fanc AS (
  SELECT root_id, rel_path, i AS anc_depth,
         CASE WHEN i = 0 THEN '' ELSE array_to_string(string_split(rel_path, '/')[1:i], '/') END AS ancestor
  FROM (SELECT root_id, rel_path, unnest(range(0, len(string_split(rel_path, '/')))) AS i FROM files))"""

CTE["entries"] = """raw_entries AS (
  SELECT root_id, rel_path, FALSE AS is_dir, CAST(strlen(content) AS BIGINT) AS size FROM files
  UNION ALL SELECT DISTINCT root_id, ancestor, TRUE, CAST(NULL AS BIGINT) FROM fanc),
entries AS (
  SELECT root_id, rel_path,
    CASE WHEN rel_path = '' THEN NULL ELSE regexp_replace(rel_path, '/?[^/]+$', '') END AS parent,
    nm AS name, regexp_extract(nm, '^.+\\.([^.]*)$', 1) AS ext,
    CAST(CASE WHEN rel_path = '' THEN 0 ELSE len(string_split(rel_path, '/')) END AS BIGINT) AS depth,
    is_dir, size
  FROM (SELECT *, CASE WHEN rel_path = '' THEN root_id ELSE string_split(rel_path, '/')[-1] END AS nm
        FROM raw_entries))"""


def _profile_values() -> str:
    rows = [f"(NULL, {i}, {sql_str(p)})" for i, p in enumerate(DEFAULT_PATTERNS)]
    for root, pats in ROOT_PROFILES.items():
        rows += [f"({sql_str(root)}, {i}, {sql_str(p)})" for i, p in enumerate(pats)] or [f"({sql_str(root)}, 0, NULL)"]
    return ", ".join(rows)


CTE["prof"] = f"""prof AS (SELECT * FROM (VALUES {_profile_values()}) t(root_id, ord, pattern)),
roots AS (SELECT DISTINCT root_id FROM files),
eff AS (
  SELECT r.root_id, p.pattern FROM roots r JOIN prof p ON p.root_id = r.root_id WHERE p.pattern IS NOT NULL
  UNION ALL
  SELECT r.root_id, g.pattern FROM roots r JOIN prof g ON g.root_id IS NULL
  WHERE r.root_id NOT IN (SELECT root_id FROM prof WHERE root_id IS NOT NULL))"""

CTE["pruned"] = """ecomp AS (SELECT root_id, rel_path, unnest(string_split(rel_path, '/')) AS c FROM entries WHERE rel_path <> ''),
ign AS (SELECT DISTINCT x.root_id, x.rel_path FROM ecomp x JOIN eff e ON e.root_id = x.root_id AND x.c GLOB e.pattern),
pruned AS (SELECT e.* FROM entries e ANTI JOIN ign i ON i.root_id = e.root_id AND i.rel_path = e.rel_path)"""

CTE["picks"] = """picks AS (
  SELECT f.root_id, f.rel_path FROM files f SEMI JOIN labels l ON l.doc_id = f.doc_id AND l.quality = 1
  UNION ALL
  SELECT root_id, 'tests' FROM (SELECT DISTINCT root_id FROM files)
  WHERE CAST(regexp_extract(root_id, '(\\d+)$', 1) AS INTEGER) % 2 = 0)"""

CTE["states"] = """panc AS (
  SELECT root_id, rel_path, i AS anc_depth,
         CASE WHEN i = 0 THEN '' ELSE array_to_string(string_split(rel_path, '/')[1:i], '/') END AS ancestor
  FROM (SELECT root_id, rel_path, unnest(range(0, CAST(depth AS INTEGER) + 1)) AS i FROM pruned)),
hit AS (SELECT DISTINCT a.root_id, a.rel_path FROM panc a JOIN picks p ON p.root_id = a.root_id AND p.rel_path = a.ancestor),
chk AS (SELECT e.*, h.rel_path IS NOT NULL AS checked FROM pruned e LEFT JOIN hit h USING (root_id, rel_path)),
leafs AS (SELECT c.* FROM chk c WHERE NOT EXISTS (SELECT 1 FROM chk k WHERE k.root_id = c.root_id AND k.parent = c.rel_path)),
lagg AS (SELECT a.root_id, a.ancestor AS rel_path, bool_and(l.checked) AS all_c, bool_and(NOT l.checked) AS none_c
         FROM leafs l JOIN panc a ON a.root_id = l.root_id AND a.rel_path = l.rel_path AND a.ancestor <> l.rel_path
         GROUP BY 1, 2),
states AS (
  SELECT c.*, CASE WHEN g.all_c IS NULL THEN (CASE WHEN c.checked THEN 'checked' ELSE 'unchecked' END)
                   WHEN g.all_c THEN 'checked' WHEN g.none_c THEN 'unchecked' ELSE 'indeterminate' END AS state
  FROM chk c LEFT JOIN lagg g USING (root_id, rel_path))"""

CTE["selected"] = """selected AS (
  SELECT s.* FROM states s
  WHERE NOT s.is_dir AND s.state = 'checked'
    AND NOT EXISTS (SELECT 1 FROM panc a JOIN states d ON d.root_id = a.root_id AND d.rel_path = a.ancestor
                    WHERE a.root_id = s.root_id AND a.rel_path = s.rel_path AND a.ancestor <> s.rel_path
                      AND d.state = 'unchecked'))"""

# sort keys: F1 (dirs first, lower(name), name) and F2 (dirs first, name) per component
SK_CI = ("(CASE WHEN rel_path = '' THEN [] ELSE list_transform(string_split(rel_path, '/'), lambda x, i: "
         "{'f': CASE WHEN i = len(string_split(rel_path, '/')) AND NOT is_dir THEN 1 ELSE 0 END, "
         "'l': lower(x), 'n': x}) END)")
SK_RAW = ("(CASE WHEN rel_path = '' THEN [] ELSE list_transform(string_split(rel_path, '/'), lambda x, i: "
          "{'f': CASE WHEN i = len(string_split(rel_path, '/')) AND NOT is_dir THEN 1 ELSE 0 END, 'n': x}) END)")

CTE["ordered"] = f"""ordered AS (
  SELECT root_id, rel_path, ext, row_number() OVER (PARTITION BY root_id ORDER BY {SK_CI}) AS seq FROM selected)"""

LANG_CASE = "CASE ext " + " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in LANGUAGE_BY_EXT.items()) + \
    " ELSE '' END"


def tree_ctes(profiled: bool = True, ci: bool = False, max_depth: int | None = 10) -> str:
    """Tree lines in SQL: window last-sibling + string_agg of ancestor pads."""
    eff = "eff" if profiled else "(SELECT NULL AS root_id, NULL AS pattern WHERE FALSE)"
    depth = f"AND e.depth <= {max_depth}" if max_depth is not None else ""
    order = "CASE WHEN is_dir THEN 0 ELSE 1 END DESC, lower(name) DESC, name DESC" if ci else \
        "CASE WHEN is_dir THEN 0 ELSE 1 END DESC, name DESC"
    sk = SK_CI if ci else SK_RAW
    return f"""tcomp AS (SELECT root_id, rel_path, unnest(list_prepend(root_id,
                 CASE WHEN rel_path = '' THEN [] ELSE string_split(rel_path, '/') END)) AS c FROM entries),
tign AS (SELECT DISTINCT x.root_id, x.rel_path FROM tcomp x JOIN {eff} e ON e.root_id = x.root_id AND x.c GLOB e.pattern),
tvis AS (SELECT e.* FROM entries e ANTI JOIN tign i ON i.root_id = e.root_id AND i.rel_path = e.rel_path
         WHERE TRUE {depth}),
tlast AS (SELECT *, parent IS NULL OR row_number() OVER (PARTITION BY root_id, parent ORDER BY {order}) = 1 AS is_last
          FROM tvis),
tanc AS (SELECT root_id, rel_path, i AS anc_depth,
                CASE WHEN i = 0 THEN '' ELSE array_to_string(string_split(rel_path, '/')[1:i], '/') END AS ancestor
         FROM (SELECT root_id, rel_path, unnest(range(0, CAST(depth AS INTEGER))) AS i FROM tvis)),
tpre AS (SELECT a.root_id, a.rel_path,
                string_agg(CASE WHEN l.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.anc_depth) AS prefix
         FROM tanc a JOIN tlast l ON l.root_id = a.root_id AND l.rel_path = a.ancestor GROUP BY 1, 2),
tree AS (SELECT t.root_id,
                row_number() OVER (PARTITION BY t.root_id ORDER BY {sk}) AS pos,
                concat(coalesce(p.prefix, ''), CASE WHEN t.is_last THEN '└── ' ELSE '├── ' END,
                       CASE WHEN t.is_dir THEN '📁' ELSE '📄' END, ' ', t.name, chr(10)) AS line
         FROM tlast t LEFT JOIN tpre p USING (root_id, rel_path))"""


def with_(*names: str, extra: str = "") -> str:
    parts = [CTE[n] for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


BASE = ("files", "fanc", "entries")
PRUNED = BASE + ("prof", "pruned")
SELECTED = PRUNED + ("picks", "states", "selected")

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- 2A
SQL["scan_entries"] = with_(*BASE) + "SELECT * FROM entries"
SQL["list_children"] = with_(*PRUNED) + """SELECT root_id, parent, rel_path,
  row_number() OVER (PARTITION BY root_id, parent ORDER BY CASE WHEN is_dir THEN 0 ELSE 1 END, lower(name), name)
    AS sibling_rank
FROM pruned WHERE parent IS NOT NULL"""
SQL["read_contents"] = with_(*SELECTED) + """SELECT s.root_id, s.rel_path, CAST(strlen(f.content) AS BIGINT) AS n_bytes,
  CASE WHEN f.content IS NULL THEN 'Failed to read file: not found' END AS error
FROM selected s LEFT JOIN files f USING (root_id, rel_path)"""
SQL["read_contents_secure"] = with_("files") + """, wanted AS (
  SELECT root_id, CASE WHEN rel_path LIKE '%/en/%' THEN '../x/' ELSE '' END || rel_path AS rel_path FROM files)
SELECT w.root_id, w.rel_path,
  CASE WHEN starts_with(w.rel_path, '../') THEN NULL ELSE CAST(length(f.content) AS BIGINT) END AS n_chars,
  CASE WHEN starts_with(w.rel_path, '../') THEN 'Security error: path traversal detected'
       WHEN f.content IS NULL THEN 'Failed to read file: not found' END AS error
FROM wanted w LEFT JOIN files f USING (root_id, rel_path)"""
SQL["entry_metadata"] = with_(*BASE) + "SELECT root_id, rel_path, is_dir, size FROM entries"
SQL["full_workflow"] = with_("files") + """SELECT root_id, count(*) AS n_files,
  CAST(sum(strlen(frag)) AS BIGINT) AS out_bytes, CAST((sum(length(frag)) + 3) // 4 AS BIGINT) AS out_tokens
FROM (SELECT root_id, '## /corpus/' || root_id || '/' || rel_path || chr(10) || '```' || chr(10) || content
             || chr(10) || '```' || chr(10) AS frag FROM files) GROUP BY root_id"""

# ---------------------------------------------------------------- 2B
SQL["relative_path"] = with_("files") + """SELECT root_id, rel_path, rel_path AS rel_own,
  CASE WHEN substr('/corpus/' || root_id, 1, 11) = '/corpus/' || root_id THEN rel_path
       WHEN starts_with('/corpus/' || root_id || '/' || rel_path, substr('/corpus/' || root_id, 1, 11) || '/')
         THEN substr('/corpus/' || root_id || '/' || rel_path, 13)
       ELSE '/corpus/' || root_id || '/' || rel_path END AS rel_other
FROM files"""
NORM = ("list_reduce(string_split({p}, '/'), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') "
        "WHEN x = '' OR x = '.' THEN acc ELSE acc || '/' || x END, '')")


def _inside(p: str, r: str) -> str:
    np_, nr = NORM.format(p=p), NORM.format(p=r)
    return f"(({np_}) = ({nr}) OR starts_with({np_}, ({nr}) || '/'))"


SQL["contained_in_root"] = with_("files") + f"""SELECT root_id, rel_path,
  {_inside("'/corpus/' || root_id || '/' || rel_path", "'/corpus/' || root_id")} AS inside,
  {_inside("'/corpus/' || root_id || '/../' || rel_path", "'/corpus/' || root_id")} AS escape_inside,
  {_inside("'/corpus/' || root_id || 'x/' || rel_path", "'/corpus/' || root_id")} AS sibling_inside
FROM files"""
SQL["parent_path"] = with_(*BASE) + "SELECT root_id, rel_path, parent FROM entries"
SQL["file_name"] = with_(*BASE) + "SELECT root_id, rel_path, name FROM entries"
SQL["depth_limit"] = with_(*BASE) + "SELECT root_id, rel_path, depth FROM entries WHERE depth <= 2"
SQL["files_only"] = with_(*BASE) + "SELECT root_id, rel_path, size FROM entries WHERE NOT is_dir"
SQL["extension"] = with_(*BASE) + "SELECT root_id, rel_path, ext FROM entries"
SQL["language_of"] = with_(*BASE) + f"SELECT root_id, rel_path, {LANG_CASE} AS lang FROM entries WHERE NOT is_dir"
SQL["file_category"] = with_(*BASE) + """SELECT root_id, rel_path, CASE
  WHEN lower(ext) IN ('rs','py','js','ts','jsx','tsx','go','cpp','c','h','java','kt','swift') THEN 'Code'
  WHEN lower(ext) IN ('toml','json','yaml','yml','xml','ini','cfg','conf') THEN 'Config'
  WHEN lower(ext) IN ('md','txt','rst','adoc') THEN 'Document'
  WHEN lower(ext) IN ('png','jpg','jpeg','gif','svg','webp') THEN 'Image'
  WHEN lower(ext) IN ('zip','tar','gz','rar','7z') THEN 'Archive' ELSE 'File' END AS category
FROM entries WHERE NOT is_dir"""
SQL["size_class"] = with_(*BASE) + """SELECT root_id, rel_path, size,
  CASE WHEN size < 262144 THEN 'small' ELSE 'large' END AS size_class FROM entries WHERE NOT is_dir"""
SQL["tokens_chars"] = with_("files") + \
    "SELECT root_id, rel_path, CAST((length(content) + 3) // 4 AS BIGINT) AS tokens FROM files"
SQL["tokens_bytes"] = with_(*BASE) + \
    "SELECT root_id, rel_path, CAST(size // 4 AS BIGINT) AS tokens FROM entries WHERE NOT is_dir"
SQL["token_level"] = with_("files") + """SELECT root_id, rel_path,
  CASE WHEN t < 1000 THEN 'Low' WHEN t < 10000 THEN 'Medium' ELSE 'High' END AS level_type,
  CASE WHEN t < 10000 THEN 'Low' WHEN t < 50000 THEN 'Medium' ELSE 'High' END AS level_footer,
  CASE WHEN t < 8000 THEN 'Low' WHEN t < 32000 THEN 'Medium' ELSE 'High' END AS level_docs
FROM (SELECT *, (length(content) + 3) // 4 AS t FROM files)"""
SQL["ignore_filter"] = with_(*BASE) + f"""SELECT e.root_id, e.rel_path FROM entries e
WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT unnest(CASE WHEN e.rel_path = '' THEN [] ELSE string_split(e.rel_path, '/') END) AS c) x,
                (SELECT unnest([{", ".join(sql_str(p) for p in DEFAULT_PATTERNS)}]) AS pattern) p
  WHERE x.c GLOB p.pattern)"""
SQL["ignore_by_profile"] = with_(*PRUNED) + "SELECT root_id, rel_path, is_dir FROM pruned"

# ---------------------------------------------------------------- 2H
SQL["expand_selection"] = with_(*PRUNED, "picks", "states") + \
    "SELECT root_id, rel_path, is_dir FROM chk WHERE checked"
SQL["tristate_rollup"] = with_(*PRUNED, "picks", "states") + "SELECT root_id, rel_path, state FROM states WHERE is_dir"
SQL["collect_selected"] = with_(*SELECTED) + "SELECT root_id, rel_path FROM selected"
SQL["selected_flat"] = with_(*PRUNED, "picks", "states") + \
    "SELECT root_id, rel_path FROM states WHERE NOT is_dir AND state = 'checked'"
SQL["selected_count"] = with_(*SELECTED) + """SELECT root_id, count(*) AS n_selected,
  CAST(sum(size // 4) AS BIGINT) AS est_tokens FROM selected GROUP BY root_id"""
SQL["selection_tokens"] = with_(*SELECTED) + \
    "SELECT root_id, CAST(sum(size // 4) AS BIGINT) AS est_tokens FROM selected GROUP BY root_id"

# ---------------------------------------------------------------- 2E/2F
SQL["preorder_position"] = with_(*PRUNED) + f"""SELECT root_id, rel_path,
  row_number() OVER (PARTITION BY root_id ORDER BY {SK_CI}) AS pos FROM pruned WHERE rel_path <> ''"""
SQL["document_order"] = with_(*SELECTED, "ordered") + "SELECT root_id, rel_path, seq FROM ordered"

# ---------------------------------------------------------------- 2D render
TREE = tree_ctes()


def _doc_sql(fmt: str) -> str:
    xml = fmt == "xml"
    if xml:
        frag = ("'    <file path=\"' || o.rel_path || '\">' || chr(10) || '<![CDATA[' || chr(10) || body "
                "|| ']]>' || chr(10) || '    </file>' || chr(10)")
        head = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<codebase>' || chr(10)"
        tree_open = "'  <directory_tree>' || chr(10) || '<![CDATA[' || chr(10)"
        tree_close = "']]>' || chr(10) || '  </directory_tree>' || chr(10) || chr(10)"
        files_open = "'  <files>' || chr(10)"
        footer = "'  </files>' || chr(10) || '</codebase>'"
    else:
        lang = LANG_CASE.replace("CASE ext", "CASE o.ext")
        frag = ("'### ' || o.rel_path || chr(10) || chr(10) || '```' || " + lang +
                " || chr(10) || body || '```' || chr(10) || chr(10)")
        head = "'# Codebase Export' || chr(10) || chr(10)"
        tree_open = "'## Directory Structure' || chr(10) || chr(10) || '```' || chr(10)"
        tree_close = "'```' || chr(10) || chr(10)"
        files_open = "'## Files' || chr(10) || chr(10)"
        footer = None
    sql = with_(*SELECTED, "ordered", extra=TREE) + f""", droots AS (SELECT DISTINCT root_id FROM ordered),
troots AS (SELECT DISTINCT root_id FROM tree SEMI JOIN droots USING (root_id)),
doc AS (
  SELECT root_id, 0 AS section, CAST(0 AS BIGINT) AS seq, {head} AS fragment FROM droots
  UNION ALL SELECT root_id, 1, 0, {tree_open} FROM troots
  UNION ALL SELECT t.root_id, 2, t.pos, t.line FROM tree t SEMI JOIN droots USING (root_id)
  UNION ALL SELECT root_id, 3, 0, {tree_close} FROM troots
  UNION ALL SELECT root_id, 4, 0, {files_open} FROM droots
  UNION ALL SELECT o.root_id, 5, o.seq, {frag}
    FROM ordered o JOIN (SELECT root_id, rel_path,
          CASE WHEN ends_with(content, chr(10)) THEN content ELSE content || chr(10) END AS body FROM files) f
    USING (root_id, rel_path)"""
    if footer:
        sql += f"\n  UNION ALL SELECT root_id, 6, 0, {footer} FROM droots"
    return sql + ")\n"


SQL["render_tree"] = with_(*PRUNED, extra=TREE) + "SELECT root_id, pos, line FROM tree"
SQL["assemble_markdown"] = _doc_sql("markdown") + "SELECT * FROM doc"
SQL["assemble_xml"] = _doc_sql("xml") + "SELECT * FROM doc"
SQL["output_tokens"] = _doc_sql("markdown") + """SELECT root_id, count(*) AS n_fragments,
  CAST(sum(length(fragment)) AS BIGINT) AS n_chars, CAST(sum(strlen(fragment)) AS BIGINT) AS n_bytes,
  CAST((sum(length(fragment)) + 3) // 4 AS BIGINT) AS output_tokens FROM doc GROUP BY root_id"""

# ================================================================ part 2
CTE["changes"] = """changes AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS root_id, CAST(ts AS TIMESTAMP) AS ts,
    CASE event_type WHEN 'click' THEN 'modify' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'remove'
                    WHEN 'error' THEN 'error' WHEN 'view' THEN 'access' END AS kind,
    'u' || CAST(user_id AS VARCHAR) || '/k' || json_extract_string(props, '$.k') AS path,
    CASE WHEN event_type = 'error' THEN 'watch error ' || CAST(event_id AS VARCHAR) END AS message, event_id
  FROM events)"""
CTE["samples"] = """samples AS (
  SELECT user_id AS key, ts, epoch_us(ts) AS ts_us, value AS elapsed, 10.0 AS budget, event_id FROM events)"""
CTE["gaps"] = """gaps AS (
  SELECT key, event_id, ts_us, gap_us FROM (
    SELECT key, event_id, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY key ORDER BY ts_us, event_id) AS gap_us
    FROM samples) WHERE gap_us > 0)"""
FULL = "'/corpus/' || root_id || '/' || rel_path"
SIB_CI = "CASE WHEN is_dir THEN 0 ELSE 1 END, lower(name), name"
SIB_RAW = "CASE WHEN is_dir THEN 0 ELSE 1 END, name"

SQL["pattern_type"] = with_(*BASE) + """SELECT DISTINCT pattern,
  CASE WHEN contains(pattern, '*') OR contains(pattern, '?') THEN 'glob'
       WHEN starts_with(pattern, '^') OR ends_with(pattern, '$') THEN 'regex' ELSE 'exact' END AS ptype
FROM (SELECT unnest([name, '*.' || ext, '^' || name, name || '$', name || '?']) AS pattern
      FROM entries WHERE rel_path <> '')"""
SQL["match_exact"] = with_(*BASE) + f"""SELECT e.root_id, e.rel_path, p.pattern
FROM entries e, (VALUES ('doc_1'), ('/en/')) p(pattern) WHERE contains({FULL.replace('root_id', 'e.root_id').replace('rel_path', 'e.rel_path')}, p.pattern)"""
SQL["match_glob"] = with_(*BASE) + """SELECT e.root_id, e.rel_path, p.pattern
FROM entries e, (VALUES ('*.rs'), ('d?c_1*'), ('[!d]oc_*'), ('*.TXT')) p(pattern)
WHERE e.rel_path <> '' AND e.name GLOB p.pattern"""
SQL["match_regex"] = with_(*BASE) + """SELECT e.root_id, e.rel_path, p.pattern
FROM entries e, (VALUES ('^/corpus/src1/'), ('doc_[0-9]+[.]rs$'), ('/(en|fr)/')) p(pattern)
WHERE regexp_matches('/corpus/' || e.root_id || '/' || e.rel_path, p.pattern)"""
SQL["pattern_cache_match"] = with_(*BASE) + """SELECT root_id, rel_path FROM entries
WHERE ends_with(rel_path, '.rs') OR starts_with(rel_path, 'target/') OR ends_with(rel_path, '.{txt,md}')
   OR regexp_matches(rel_path, '^[^/]*[.](txt|md)$')"""
SQL["override_filter"] = with_(*BASE) + """SELECT root_id, rel_path FROM entries
WHERE rel_path = '' OR NOT (list_contains(string_split(rel_path, '/'), 'node_modules')
   OR rel_path = 'src/en' OR starts_with(rel_path, 'src/en/')
   OR len(list_filter(string_split(rel_path, '/'), lambda c: c GLOB '*.md')) > 0)"""
SQL["parse_patterns"] = with_(*BASE) + """SELECT root_id, rel_path, array_to_string(parts, '|') AS patterns,
  CAST(len(parts) AS BIGINT) AS n_patterns
FROM (SELECT root_id, rel_path, list_filter(list_transform(string_split(
        ' *.' || ext || ' ,' || name || ',, *.{js,ts}', ','), lambda x: trim(x)), lambda x: x <> '') AS parts
      FROM entries WHERE NOT is_dir)"""
# What the grammar says of each made pattern: a name before '**' and an extension after a lone '[' break it, an
# extension after '*.' and a name after '**/' do not (the corpus names hold no '*' and no bracket).
SQL["drop_invalid_patterns"] = with_(*BASE) + """SELECT DISTINCT pattern, valid FROM (
  SELECT name || '**' AS pattern, FALSE AS valid FROM entries WHERE NOT is_dir
  UNION ALL SELECT '[' || ext, FALSE FROM entries WHERE NOT is_dir
  UNION ALL SELECT '*.' || ext, TRUE FROM entries WHERE NOT is_dir
  UNION ALL SELECT '**/' || name, TRUE FROM entries WHERE NOT is_dir
  UNION ALL SELECT p, v FROM (VALUES ('a[b]c[d', FALSE), ('[]', FALSE), ('[!]', FALSE), ('[]]', TRUE), ('[!]]', TRUE),
    ('[**]', TRUE), ('[z-a]', TRUE), ('***', FALSE), ('**', TRUE), ('a/**/b', TRUE), ('a**/b', FALSE), ('**b', FALSE),
    ('[a/]**', FALSE)) e(p, v))"""
SQL["preset_patterns"] = with_(*BASE) + """SELECT DISTINCT root_id, pattern FROM (
  SELECT r.root_id, p.pattern FROM (SELECT DISTINCT root_id FROM files) r,
    (VALUES ('.*'), ('node_modules'), ('__pycache__'), ('target'), ('build'), ('dist')) p(pattern)
  UNION ALL SELECT root_id, trim('  *.' || ext || ' ') FROM entries WHERE NOT is_dir AND ext = 'TXT')
WHERE pattern <> 'dist'"""
SQL["fuzzy_filter"] = with_(*BASE) + \
    "SELECT root_id, rel_path FROM entries WHERE rel_path <> '' AND regexp_matches(name, 'D.*c.*1')"
SQL["pattern_match_matrix"] = with_(*BASE) + """SELECT pattern, CAST(glob_matches AS BIGINT) AS glob_matches,
  CAST(regex_matches AS BIGINT) AS regex_matches FROM (
  SELECT '*.rs' AS pattern, CAST(count_if(regexp_matches(rel_path, '^.*\\.rs$')) AS BIGINT) AS glob_matches,
         CAST(count_if(regexp_matches(rel_path, '^[^/]*\\.rs$')) AS BIGINT) AS regex_matches FROM entries WHERE rel_path <> ''
  UNION ALL SELECT '**/*.txt', CAST(count_if(regexp_matches(rel_path, '^(.*/)?.*\\.txt$')) AS BIGINT),
         CAST(count_if(regexp_matches(rel_path, '^[^/]*[^/]*/[^/]*\\.txt$')) AS BIGINT) FROM entries WHERE rel_path <> ''
  UNION ALL SELECT '**/target/**', CAST(count_if(regexp_matches(rel_path, '^(.*/)?target/.*$')) AS BIGINT),
         CAST(count_if(regexp_matches(rel_path, '^[^/]*[^/]*/target/[^/]*[^/]*$')) AS BIGINT) FROM entries WHERE rel_path <> ''
  UNION ALL SELECT 'node_modules/**', CAST(count_if(regexp_matches(rel_path, '^node_modules/.*$')) AS BIGINT),
         CAST(count_if(regexp_matches(rel_path, '^node_modules/[^/]*[^/]*$')) AS BIGINT) FROM entries WHERE rel_path <> ''
  UNION ALL SELECT '*.{js,ts,jsx,tsx}', CAST(count_if(ends_with(rel_path, '.{js,ts,jsx,tsx}')) AS BIGINT),
         CAST(count_if(regexp_matches(rel_path, '^[^/]*\\.(js|ts|jsx|tsx)$')) AS BIGINT) FROM entries WHERE rel_path <> '')"""

# ---- joins
SQL["children_join"] = with_(*PRUNED) + """SELECT c.root_id, c.parent, c.rel_path, p.depth AS parent_depth
FROM pruned c JOIN pruned p ON p.root_id = c.root_id AND p.rel_path = c.parent AND p.is_dir"""
SQL["ancestor_join"] = with_(*PRUNED, "picks", "states") + \
    "SELECT root_id, rel_path, ancestor, CAST(anc_depth AS BIGINT) AS anc_depth FROM panc WHERE ancestor <> rel_path"
SQL["restore_selection"] = with_(*PRUNED, "picks") + \
    "SELECT root_id, rel_path, is_dir FROM pruned SEMI JOIN picks USING (root_id, rel_path)"
SQL["language_join"] = with_(*BASE) + f"SELECT root_id, rel_path, {LANG_CASE} AS lang FROM entries WHERE NOT is_dir"
SQL["selected_metadata"] = with_(*BASE, "picks") + """SELECT p.root_id, p.rel_path, e.size,
  CAST(e.size // 4 AS BIGINT) AS tokens FROM picks p JOIN entries e USING (root_id, rel_path) WHERE NOT e.is_dir"""
SQL["selected_contents"] = with_("files", "picks") + """SELECT w.root_id, w.rel_path,
  CAST(length(f.content) AS BIGINT) AS n_chars,
  CASE WHEN f.content IS NULL THEN 'Failed to read file: not found' END AS error
FROM (SELECT DISTINCT root_id, rel_path FROM picks) w LEFT JOIN files f USING (root_id, rel_path)"""
SQL["dirty_roots"] = with_("changes") + """SELECT m.root_id, count(*) AS n_after FROM changes m
JOIN (SELECT root_id, max(ts) AS last_gen FROM changes WHERE kind = 'create' GROUP BY 1) g
  ON g.root_id = m.root_id AND m.ts > g.last_gen
WHERE m.kind = 'modify' GROUP BY 1"""

# ---- aggregations
SQL["children_by_parent"] = with_(*PRUNED) + f"""SELECT root_id, parent,
  row_number() OVER (PARTITION BY root_id, parent ORDER BY {SIB_CI}) AS child_rank, name AS child
FROM pruned WHERE parent IS NOT NULL"""
SQL["failed_summary"] = with_("files", "picks") + f""", w AS (
  SELECT root_id, rel_path, FALSE AS is_dir FROM (SELECT DISTINCT root_id, rel_path FROM picks)),
wo AS (SELECT w.*, row_number() OVER (PARTITION BY root_id ORDER BY {SK_CI}) AS seq FROM w),
bad AS (SELECT wo.root_id, wo.seq, wo.rel_path FROM wo ANTI JOIN files f USING (root_id, rel_path))
SELECT root_id, CAST(0 AS BIGINT) AS seq, 'Warning: Failed to read ' || CAST(count(*) AS VARCHAR) || ' file(s): ' AS item
FROM bad GROUP BY root_id
UNION ALL SELECT root_id, seq, rel_path || ': Failed to read file: not found' FROM bad"""
SQL["render_tree_unfiltered"] = with_(*BASE, extra=tree_ctes(profiled=False)) + "SELECT root_id, pos, line FROM tree"
SQL["render_tree_ci"] = with_(*PRUNED, extra=tree_ctes(profiled=True, ci=True, max_depth=None)) + \
    "SELECT root_id, pos, line FROM tree"
SQL["node_counts"] = with_(*PRUNED, "picks", "states") + """SELECT a.root_id, a.ancestor AS dir, count(*) AS n_nodes,
  CAST(sum(e.size) AS BIGINT) AS bytes, CAST(sum(e.size // 4) AS BIGINT) AS tokens
FROM panc a JOIN pruned e USING (root_id, rel_path)
WHERE (a.root_id, a.ancestor) IN (SELECT (root_id, rel_path) FROM pruned WHERE is_dir)
GROUP BY 1, 2"""
SQL["bytes_read"] = with_(*SELECTED) + """SELECT s.root_id, CAST(sum(strlen(f.content)) AS BIGINT) AS bytes_read
FROM selected s JOIN files f USING (root_id, rel_path) GROUP BY 1"""
SQL["match_count"] = with_("files") + """SELECT root_id, rel_path,
  CAST((length(lower(content)) - length(replace(lower(content), 'the', ''))) // 3 AS BIGINT) AS n FROM files"""
SQL["progress_pct"] = with_(*SELECTED) + """, a AS (SELECT s.root_id, count(*) AS total,
    count(f.content) AS current FROM selected s LEFT JOIN files f USING (root_id, rel_path) GROUP BY 1)
SELECT r.root_id, CAST(coalesce(a.current, 0) AS BIGINT) AS current, CAST(coalesce(a.total, 0) AS BIGINT) AS total,
  CASE WHEN coalesce(a.total, 0) = 0 THEN 100.0 ELSE round(a.current * 100.0 / a.total, 4) END AS pct,
  coalesce(a.current, 0) >= coalesce(a.total, 0) AS complete
FROM (SELECT DISTINCT root_id FROM entries) r LEFT JOIN a USING (root_id)"""

# ---- windows
SQL["is_last_sibling"] = with_(*PRUNED) + """SELECT root_id, rel_path, parent IS NULL OR row_number() OVER (
  PARTITION BY root_id, parent ORDER BY CASE WHEN is_dir THEN 0 ELSE 1 END DESC, name DESC) = 1 AS is_last
FROM pruned"""
SQL["sibling_rank"] = with_(*PRUNED) + f"""SELECT root_id, rel_path,
  row_number() OVER (PARTITION BY root_id, parent ORDER BY {SIB_CI}) AS sibling_rank FROM pruned WHERE parent IS NOT NULL"""
SQL["event_gap"] = with_("samples", "gaps") + "SELECT key, event_id, gap_us FROM gaps"
SQL["last_n_samples"] = with_("samples", "gaps") + """SELECT key, event_id, gap_us FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us DESC, event_id DESC) AS rn FROM gaps) WHERE rn <= 120"""
SQL["running_progress"] = with_(*SELECTED) + f"""SELECT root_id, rel_path,
  row_number() OVER (PARTITION BY root_id ORDER BY {SK_CI}) AS current, count(*) OVER (PARTITION BY root_id) AS total
FROM selected"""
SQL["match_navigation"] = with_("files") + """, pieces AS (
  SELECT root_id, rel_path, string_split(lower(content), 'the') AS ps FROM files),
ex AS (SELECT root_id, rel_path, len(ps) - 1 AS n, unnest(range(1, len(ps) + 1)) AS k, unnest(ps) AS piece FROM pieces),
cum AS (SELECT *, sum(length(piece)) OVER (PARTITION BY root_id, rel_path ORDER BY k
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before FROM ex)
SELECT root_id, rel_path, CAST(k - 1 AS BIGINT) AS match_idx, CAST(before + (k - 1) * 3 AS BIGINT) AS char_offset,
  CAST(k % n AS BIGINT) AS next_idx, CAST((k - 2 + n) % n AS BIGINT) AS prev_idx, CAST(n AS BIGINT) AS match_count
FROM cum WHERE k - 1 < n"""
SQL["history_cap"] = """SELECT session_id, event_id FROM (
  SELECT user_id AS session_id, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type IN ('click', 'view', 'signup')) WHERE rn <= 20"""

# ---- sorts
SQL["sort_dirs_first_ci"] = with_(*BASE) + f"""SELECT root_id, rel_path,
  row_number() OVER (PARTITION BY root_id, parent ORDER BY {SIB_CI}) AS sibling_rank FROM entries WHERE parent IS NOT NULL"""
SQL["sort_dirs_first_raw"] = with_(*BASE) + f"""SELECT root_id, rel_path,
  row_number() OVER (PARTITION BY root_id, parent ORDER BY {SIB_RAW}) AS sibling_rank FROM entries WHERE parent IS NOT NULL"""
SQL["sort_paths"] = with_("changes") + """SELECT root_id, path, row_number() OVER (PARTITION BY root_id ORDER BY path) AS pos
FROM (SELECT DISTINCT root_id, path FROM changes WHERE kind IN ('modify', 'create', 'remove'))"""

# ---- sets
CTE["sel_ab"] = """picks_f AS (SELECT * FROM picks SEMI JOIN files USING (root_id, rel_path)),
sel_b AS (SELECT DISTINCT a.root_id, a.rel_path FROM panc a JOIN picks_f p ON p.root_id = a.root_id AND p.rel_path = a.ancestor
          JOIN pruned e ON e.root_id = a.root_id AND e.rel_path = a.rel_path WHERE NOT e.is_dir),
sel_a AS (SELECT DISTINCT a.root_id, a.rel_path FROM panc a JOIN picks p ON p.root_id = a.root_id AND p.rel_path = a.ancestor
          JOIN pruned e ON e.root_id = a.root_id AND e.rel_path = a.rel_path WHERE NOT e.is_dir)"""
SQL["selection_diff"] = with_(*PRUNED, "picks", "states", "sel_ab") + """
SELECT root_id, rel_path, 'added' AS change FROM sel_a ANTI JOIN sel_b USING (root_id, rel_path)
UNION ALL SELECT root_id, rel_path, 'removed' FROM sel_b ANTI JOIN sel_a USING (root_id, rel_path)"""
SQL["select_all"] = with_(*PRUNED) + "SELECT root_id, rel_path, 'checked' AS state FROM pruned"
SQL["deselect_all"] = with_(*PRUNED) + "SELECT root_id, rel_path, 'unchecked' AS state FROM pruned"
SQL["selection_union"] = with_(*SELECTED) + """SELECT DISTINCT root_id, rel_path FROM (
  SELECT root_id, rel_path FROM selected
  UNION ALL SELECT f.root_id, f.rel_path FROM files f SEMI JOIN labels l ON l.doc_id = f.doc_id AND l.toxic = 1)"""
SQL["merge_change_batches"] = with_("changes") + """SELECT DISTINCT root_id, path AS item, FALSE AS is_error
FROM changes WHERE kind IN ('modify', 'create', 'remove')
UNION ALL SELECT root_id, message, TRUE FROM changes WHERE kind = 'error'"""
SQL["capture_snapshot"] = with_(*PRUNED, "picks", "states") + """SELECT root_id,
  CASE WHEN is_dir THEN 'dir' ELSE 'file' END AS kind, rel_path FROM chk WHERE checked"""
SQL["selection_intersect"] = with_(*PRUNED, "picks") + """SELECT DISTINCT root_id, rel_path FROM picks
SEMI JOIN pruned USING (root_id, rel_path)"""

# ---- selection
SQL["search_visible"] = with_(*PRUNED) + """, hits AS (SELECT root_id, rel_path, depth FROM pruned
  WHERE rel_path <> '' AND regexp_matches(name, 'D.*c.*1'))
SELECT DISTINCT root_id, rel_path FROM (
  SELECT root_id, rel_path FROM hits
  UNION ALL SELECT root_id, array_to_string(string_split(rel_path, '/')[1:i], '/')
  FROM (SELECT root_id, rel_path, unnest(range(1, CAST(depth AS INTEGER))) AS i FROM hits))"""
SQL["reload_with_patterns"] = with_(*BASE, "picks") + """, mcomp AS (
  SELECT root_id, rel_path, unnest(string_split(rel_path, '/')) AS c FROM entries WHERE rel_path <> ''),
mign AS (SELECT DISTINCT root_id, rel_path FROM mcomp WHERE c GLOB '.*' OR c = 'node_modules'),
mpr AS (SELECT e.* FROM entries e ANTI JOIN mign USING (root_id, rel_path)),
manc AS (SELECT root_id, rel_path,
   CASE WHEN i = 0 THEN '' ELSE array_to_string(string_split(rel_path, '/')[1:i], '/') END AS ancestor
   FROM (SELECT root_id, rel_path, unnest(range(0, CAST(depth AS INTEGER) + 1)) AS i FROM mpr WHERE NOT is_dir))
SELECT DISTINCT a.root_id, a.rel_path FROM manc a JOIN picks p ON p.root_id = a.root_id AND p.rel_path = a.ancestor"""

# ================================================================ part 3
CTE["acc"] = """acc AS (SELECT * FROM changes WHERE kind IN ('modify', 'create', 'remove', 'error'))"""
CTE["batches"] = """bflag AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR
                            THEN 1 ELSE 0 END AS nb
  FROM acc WINDOW w AS (PARTITION BY root_id ORDER BY ts, event_id)),
bat AS (SELECT *, CAST(sum(nb) OVER (PARTITION BY root_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS batch_id
  FROM bflag),
bsum AS (SELECT root_id, batch_id, min(ts) AS batch_start, max(ts) AS batch_last, count(*) AS n_events,
    count(DISTINCT CASE WHEN kind <> 'error' THEN path END) AS n_paths, CAST(count_if(kind = 'error') AS BIGINT) AS n_errors
  FROM bat GROUP BY 1, 2)"""
CHG = ("files", "changes", "acc", "batches")

SQL["changes_source"] = with_("changes", "acc") + "SELECT root_id, ts, kind, path, event_id FROM acc"
SQL["change_batches"] = with_("changes", "acc", "batches") + """SELECT root_id, batch_start, batch_last, n_events,
  n_paths, n_errors, CASE WHEN n_errors > 0 THEN 'error' ELSE 'changed' END AS outcome FROM bsum"""
SQL["change_message"] = with_("changes", "acc", "batches") + """SELECT root_id, batch_start,
  CASE WHEN n_paths = 1 THEN '1 file changed in the watched directory'
       ELSE CAST(n_paths AS VARCHAR) || ' files changed in the watched directory' END AS message
FROM bsum WHERE n_errors = 0"""
SQL["distinct_changed_paths"] = with_("changes") + \
    "SELECT DISTINCT root_id, path FROM changes WHERE kind IN ('modify', 'create', 'remove')"
SQL["change_throttle"] = "WITH RECURSIVE " + with_("changes", "acc")[5:] + """, nx AS (
  SELECT a.root_id, a.event_id, a.ts, b.event_id AS next_id
  FROM acc a ASOF LEFT JOIN acc b ON a.root_id = b.root_id AND b.ts >= a.ts + INTERVAL 1 HOUR),
r AS (
  SELECT root_id, event_id, ts, next_id FROM (
    SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY ts, event_id) AS rn FROM nx) WHERE rn = 1
  UNION ALL
  SELECT n.root_id, n.event_id, n.ts, n.next_id FROM r JOIN nx n ON n.event_id = r.next_id)
SELECT root_id, event_id, ts FROM r"""
SQL["error_priority"] = with_("changes", "acc", "batches") + """, errs AS (
  SELECT root_id, batch_id, message,
         row_number() OVER (PARTITION BY root_id, batch_id ORDER BY ts, event_id) AS seq
  FROM bat WHERE kind = 'error')
SELECT DISTINCT root_id, batch_id, CAST(0 AS BIGINT) AS seq, 'Watcher error: ' AS item FROM errs
UNION ALL SELECT root_id, batch_id, seq, message FROM errs"""
SQL["dirty_flag"] = with_("changes", "acc") + """SELECT root_id, last_change, last_gen,
  last_change IS NOT NULL AND (last_gen IS NULL OR last_change > last_gen) AS dirty
FROM (SELECT root_id, max(CASE WHEN kind IN ('modify', 'remove') THEN ts END) AS last_change,
             max(CASE WHEN kind = 'create' THEN ts END) AS last_gen FROM acc GROUP BY 1)"""
SQL["progress_stream"] = with_(*SELECTED) + """, tot AS (SELECT root_id, count(*) AS total FROM selected GROUP BY 1)
SELECT root_id, 'scanning' AS stage, CAST(1 AS BIGINT) AS n_events, CAST(0 AS BIGINT) AS max_current,
       CAST(total AS BIGINT) AS total FROM tot
UNION ALL SELECT root_id, 'reading', total, total, total FROM tot
UNION ALL SELECT root_id, 'building', 2, 1, 1 FROM tot"""
SQL["active_alerts"] = """WITH al AS (
  SELECT user_id % 10 AS key, event_id, epoch_us(ts) AS us,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'success' END AS severity
  FROM events),
al2 AS (SELECT *, CASE severity WHEN 'error' THEN 240000000 WHEN 'warning' THEN 180000000 ELSE 120000000 END AS ttl,
           lead(us) OVER (PARTITION BY key ORDER BY us, event_id) AS nxt FROM al)
SELECT key, event_id, severity,
  CASE WHEN nxt IS NULL THEN ttl ELSE least(us + ttl, nxt) - us END AS shown_us,
  nxt IS NOT NULL AND nxt < us + ttl AS replaced
FROM al2"""
SQL["alerts_at"] = """WITH al AS (SELECT user_id % 10 AS key, event_id, epoch_us(ts) AS us,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'success' END AS severity FROM events),
now AS (SELECT max(us) AS t FROM al),
newest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us DESC, event_id DESC) AS rn FROM al)
SELECT key, event_id, severity, us + ttl - t AS left_us FROM (
  SELECT *, CASE severity WHEN 'error' THEN 240000000 WHEN 'warning' THEN 180000000 ELSE 120000000 END AS ttl FROM newest, now WHERE rn = 1)
WHERE t < us + ttl"""
SQL["job_state"] = """SELECT job_id,
  arg_max(state, CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id) FILTER (WHERE state <> 'error') AS state,
  CAST(count_if(state = 'error') AS BIGINT) AS n_errors
FROM (SELECT user_id AS job_id, ts, event_id,
        CASE event_type WHEN 'click' THEN 'generating' WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'error'
                        WHEN 'signup' THEN 'cancelled' END AS state FROM events)
WHERE state IS NOT NULL GROUP BY job_id"""

# ---- workflows
CTE["items"] = """items AS (
  SELECT o.root_id, o.rel_path, o.ext, o.seq, CAST((length(f.content) + 3) // 4 AS BIGINT) AS tokens
  FROM ordered o JOIN files f USING (root_id, rel_path))"""
SQL["pack_by_budget"] = "WITH RECURSIVE " + with_(*SELECTED, "ordered", "items")[5:] + """, r AS (
  SELECT root_id, seq, tokens, tokens AS load, CAST(0 AS BIGINT) AS session FROM items WHERE seq = 1
  UNION ALL
  SELECT i.root_id, i.seq, i.tokens,
    CASE WHEN r.load > 0 AND r.load + i.tokens > 8000 THEN i.tokens ELSE r.load + i.tokens END,
    CASE WHEN r.load > 0 AND r.load + i.tokens > 8000 THEN r.session + 1 ELSE r.session END
  FROM r JOIN items i ON i.root_id = r.root_id AND i.seq = r.seq + 1)
SELECT root_id, CAST(seq AS BIGINT) AS seq, tokens, session FROM r"""
SQL["budget_shares"] = with_(*SELECTED, "ordered", "items") + """, cl AS (
  SELECT *, CASE WHEN starts_with(rel_path, 'tests/') THEN 'tests'
      WHEN lower(ext) IN ('rs','py','js','ts','jsx','tsx','go','cpp','c','h','java','kt','swift') THEN 'code'
      WHEN lower(ext) IN ('md','txt','rst','adoc') THEN 'docs' ELSE 'other' END AS cls FROM items),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY root_id, cls ORDER BY seq ROWS UNBOUNDED PRECEDING) AS running,
         CASE cls WHEN 'code' THEN 12000 WHEN 'tests' THEN 4000 WHEN 'docs' THEN 4000 ELSE 0 END AS cap FROM cl)
SELECT root_id, cls, CAST(seq AS BIGINT) AS seq, tokens, CAST(running AS BIGINT) AS running, cap
FROM run WHERE running <= cap"""
SQL["model_fit"] = _doc_sql("markdown") + """, st AS (SELECT root_id, (sum(length(fragment)) + 3) // 4 AS t
  FROM doc GROUP BY 1)
SELECT root_id, m.model, st.t <= m.lim AS fits
FROM st, (VALUES ('8k', 8000), ('32k', 32000), ('128k', 128000), ('200k', 200000)) m(model, lim)"""
CTE["versions"] = """versions AS (SELECT source AS root_id, lang || '.md' AS path, doc_id, text AS content FROM documents),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_id, path ORDER BY doc_id DESC) AS rn
                      FROM versions) WHERE rn <= 2),
chs AS (SELECT coalesce(n.root_id, o.root_id) AS root_id, coalesce(n.path, o.path) AS path,
    CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'removed'
         WHEN n.content = o.content THEN 'unchanged' ELSE 'changed' END AS status
  FROM (SELECT * FROM lt WHERE rn = 1) n FULL OUTER JOIN (SELECT * FROM lt WHERE rn = 2) o
  ON n.root_id = o.root_id AND n.path = o.path)"""
SQL["changed_sections"] = with_("versions") + "SELECT root_id, path, status FROM chs"
SQL["changed_files_prompt"] = with_("versions") + """SELECT l.root_id, l.path,
  '### ' || l.path || chr(10) || chr(10) || '```markdown' || chr(10) ||
  CASE WHEN ends_with(l.content, chr(10)) THEN l.content ELSE l.content || chr(10) END || '```' || chr(10) || chr(10)
  AS fragment
FROM lt l JOIN chs c USING (root_id, path) WHERE l.rn = 1 AND c.status IN ('changed', 'added')"""
SQL["content_search"] = with_("files") + """SELECT root_id, rel_path,
  CAST(len(regexp_extract_all(content, '[0-9]{3}-[0-9]{4}')) AS BIGINT) AS n_matches,
  regexp_extract(content, '[0-9]{3}-[0-9]{4}', 0) AS first_match
FROM files WHERE regexp_matches(content, '[0-9]{3}-[0-9]{4}')"""
SQL["multi_root_prompt"] = """WITH t AS (SELECT 'conv' || CAST(conv_id AS VARCHAR) AS root_id,
    CAST(turn AS VARCHAR) || '_' || role || '.md' AS rel_path, CAST(length(text) AS BIGINT) AS n_chars FROM conversations)
SELECT row_number() OVER (ORDER BY root_id, lower(rel_path), rel_path) AS doc_pos, root_id, rel_path, n_chars FROM t"""
CTE["conv_files"] = """files AS (SELECT 'conv' || CAST(conv_id AS VARCHAR) AS root_id,
    CAST(turn AS VARCHAR) || '_' || role || '.md' AS rel_path, text AS content, conv_id AS doc_id FROM conversations)"""
SQL["multi_root_document"] = with_("conv_files", "fanc", "entries", extra=tree_ctes(profiled=False)) + f""", ordered AS (
  SELECT root_id, rel_path, row_number() OVER (PARTITION BY root_id ORDER BY {SK_CI}) AS seq FROM entries WHERE NOT is_dir),
body AS (SELECT o.root_id, o.seq, '### ' || o.rel_path || chr(10) || chr(10) || '```markdown' || chr(10) ||
    CASE WHEN ends_with(content, chr(10)) THEN content ELSE content || chr(10) END || '```' || chr(10) || chr(10) AS f
  FROM ordered o JOIN files USING (root_id, rel_path)),
r AS (SELECT DISTINCT root_id FROM files)
SELECT root_id, 0 AS section, CAST(0 AS BIGINT) AS seq, '# Codebase Export' || chr(10) || chr(10) AS fragment FROM r
UNION ALL SELECT root_id, 1, 0, '## Directory Structure' || chr(10) || chr(10) || '```' || chr(10) FROM r
UNION ALL SELECT root_id, 2, pos, line FROM tree
UNION ALL SELECT root_id, 3, 0, '```' || chr(10) || chr(10) FROM r
UNION ALL SELECT root_id, 4, 0, '## Files' || chr(10) || chr(10) FROM r
UNION ALL SELECT root_id, 5, seq, f FROM body"""
SQL["incremental_tokens"] = """WITH v AS (SELECT source AS root_id, lang || '.md' AS path, doc_id,
    CAST((length(text) + 3) // 4 AS BIGINT) AS tokens FROM documents)
SELECT root_id, path, doc_id, tokens,
  tokens - lag(tokens) OVER (PARTITION BY root_id, path ORDER BY doc_id) AS delta,
  tokens - first(tokens) OVER (PARTITION BY root_id, path ORDER BY doc_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS running_delta
FROM v"""
SQL["project_profiles"] = with_(*BASE) + f""", known(ext, t) AS (VALUES ('rs', 'rust'), ('js', 'node'), ('ts', 'node'), ('py', 'python'), ('java', 'java')),
cnt AS (SELECT root_id, t, count(*) AS n FROM entries JOIN known USING (ext) WHERE NOT is_dir GROUP BY 1, 2),
typ AS (SELECT r.root_id, coalesce(x.t, 'default') AS project_type FROM (SELECT DISTINCT root_id FROM entries) r
        LEFT JOIN (SELECT root_id, first(t ORDER BY n DESC, t DESC) AS t FROM cnt GROUP BY 1) x USING (root_id)),
pre(t, pats) AS (VALUES ('node', ['node_modules', 'dist', 'build', 'coverage', '*.log', '.nyc_output', 'npm-debug.log*']),
  ('rust', ['target', 'Cargo.lock', '*.pdb', '*.exe', '*.so', '*.dylib']),
  ('python', ['__pycache__', '*.pyc', '*.pyo', 'venv', 'env', '.pytest_cache', 'dist', 'build']),
  ('java', ['target', '*.class', '*.jar', '*.war', '*.ear', '*.iml']),
  ('default', [{", ".join(sql_str(x) for x in DEFAULT_PATTERNS)}]))
SELECT root_id, project_type, CAST(i - 1 AS BIGINT) AS ord, pats[i] AS pattern
FROM (SELECT root_id, project_type, pats, unnest(range(1, len(pats) + 1)) AS i FROM typ JOIN pre ON t = project_type)"""
SQL["include_patterns"] = with_(*BASE) + """SELECT root_id, rel_path FROM entries
WHERE NOT is_dir AND (name GLOB '*.rs' OR name GLOB '*.py' OR name GLOB 'Doc_*')"""
SQL["max_file_size"] = with_(*SELECTED) + f"""SELECT root_id, rel_path, size, rank FROM (
  SELECT root_id, rel_path, size, row_number() OVER (PARTITION BY root_id ORDER BY {SK_CI}) AS rank
  FROM selected WHERE size <= 4096) WHERE rank <= 10"""
SQL["pattern_suggestions"] = with_(*BASE) + """SELECT component, CAST(sum(size // 4) AS BIGINT) AS tokens,
  count(*) AS n_files
FROM (SELECT size, unnest(list_distinct(string_split(rel_path, '/')[1:-2])) AS component FROM entries WHERE NOT is_dir)
GROUP BY component ORDER BY tokens DESC, component LIMIT 10"""
SQL["render_audit"] = with_(*BASE) + f"""SELECT e.root_id,
  CAST(count_if(regexp_matches(e.name, '[&"<>]')) AS BIGINT) AS special_names, CAST(count_if(contains(f.content, '```')) AS BIGINT) AS fences,
  CAST(count_if(contains(f.content, ']]>')) AS BIGINT) AS cdata_ends, CAST(count_if(({LANG_CASE.replace('CASE ext', 'CASE e.ext')}) = '') AS BIGINT) AS unknown_ext,
  CAST(count_if(f.content IS NULL) AS BIGINT) AS read_errors
FROM entries e LEFT JOIN files f USING (root_id, rel_path) WHERE NOT e.is_dir GROUP BY 1"""
SQL["utf8_errors"] = with_("files") + """SELECT root_id, rel_path,
  CASE WHEN contains(rel_path, '/.') THEN 'Failed to read file: stream did not contain valid UTF-8' END AS error
FROM files"""
SQL["export_prompt"] = _doc_sql("markdown") + """SELECT root_id, 'codebase_export.md' AS file_name,
  CAST(sum(strlen(fragment)) AS BIGINT) AS n_bytes FROM doc GROUP BY 1"""
SQL["load_profiles"] = with_("files") + f"""SELECT root_id, CAST(i - 1 AS BIGINT) AS ord, pats[i] AS pattern FROM (
  SELECT root_id, pats, unnest(range(1, len(pats) + 1)) AS i FROM (
    SELECT root_id, CASE CAST(regexp_extract(root_id, '(\\d+)$', 1) AS INTEGER) % 4
        WHEN 1 THEN ['*.TXT', 'tests'] WHEN 3 THEN [CAST(NULL AS VARCHAR)]
        ELSE [{", ".join(sql_str(x) for x in DEFAULT_PATTERNS)}] END AS pats
    FROM (SELECT DISTINCT root_id FROM files)))"""

# the stacks as lists, one step a row number for all sessions at once
SQL["history_replay"] = """WITH RECURSIVE ops AS (
  SELECT user_id AS session_id, event_id, 'u' || CAST(user_id AS VARCHAR) || '/k' || json_extract_string(props, '$.k') AS snap,
    CASE event_type WHEN 'purchase' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'push' END AS op,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
r AS (
  SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS event_id, '' AS op, FALSE AS applied,
    '' AS cur, CAST([] AS VARCHAR[]) AS past, CAST([] AS VARCHAR[]) AS fut FROM ops
  UNION ALL
  SELECT o.session_id, o.rn, o.event_id, o.op, o.op = 'push' OR (o.op = 'undo' AND len(past) > 0) OR (o.op = 'redo' AND len(fut) > 0),
    CASE WHEN o.op = 'push' THEN o.snap WHEN o.op = 'undo' AND len(past) > 0 THEN past[-1]
         WHEN o.op = 'redo' AND len(fut) > 0 THEN fut[-1] ELSE cur END,
    CASE WHEN o.op = 'push' THEN list_append(past, o.snap)[-20:] WHEN o.op = 'undo' AND len(past) > 0 THEN past[1:len(past) - 1]
         WHEN o.op = 'redo' AND len(fut) > 0 THEN list_append(past, cur)[-20:] ELSE past END,
    CASE WHEN o.op = 'push' THEN CAST([] AS VARCHAR[]) WHEN o.op = 'undo' AND len(past) > 0 THEN list_append(fut, cur)[-20:]
         WHEN o.op = 'redo' AND len(fut) > 0 THEN fut[1:len(fut) - 1] ELSE fut END
  FROM r JOIN ops o ON o.session_id = r.session_id AND o.rn = r.rn + 1)
SELECT session_id, event_id, op, applied, CAST(len(past) AS BIGINT) AS past_len, CAST(len(fut) AS BIGINT) AS future_len,
  cur AS current FROM r WHERE rn > 0"""
SQL["latency_stats"] = with_("samples", "gaps") + """, ring AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us DESC, event_id DESC) AS rn FROM gaps) WHERE rn <= 120),
st AS (SELECT key, count(*) AS n, sum(gap_us) AS s, list_sort(list(gap_us)) AS xs FROM ring GROUP BY 1)
SELECT key, n AS n_samples, round(CASE WHEN s > 0 THEN n * 1000000.0 / s ELSE 0.0 END, 6) AS avg_rate,
  round(xs[n * 50 // 100 + 1] / 1000.0, 6) AS p50_ms, round(xs[n * 95 // 100 + 1] / 1000.0, 6) AS p95_ms,
  round(xs[n * 99 // 100 + 1] / 1000.0, 6) AS p99_ms, round(xs[n] / 1000.0, 6) AS max_ms
FROM st"""
SQL["rolling_latency"] = with_("samples", "gaps") + """, st AS (
  SELECT key, event_id, count(*) OVER w AS n, sum(gap_us) OVER w AS s, list_sort(list(gap_us) OVER w) AS xs FROM gaps
  WINDOW w AS (PARTITION BY key ORDER BY ts_us, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))
SELECT key, event_id, n AS n_samples, round(CASE WHEN s > 0 THEN n * 1000000.0 / s ELSE 0.0 END, 6) AS avg_rate,
  round(xs[n * 50 // 100 + 1] / 1000.0, 6) AS p50_ms, round(xs[n * 95 // 100 + 1] / 1000.0, 6) AS p95_ms,
  round(xs[n * 99 // 100 + 1] / 1000.0, 6) AS p99_ms, round(xs[n] / 1000.0, 6) AS max_ms
FROM st"""
SQL["budget_breaches"] = with_("samples") + """SELECT key, event_id, elapsed, round(elapsed / budget, 6) AS ratio
FROM samples WHERE elapsed > budget"""
SQL["metric_growth"] = """SELECT user_id AS key, round(greatest(
    arg_max(CAST(round(value * 1048576) AS BIGINT), CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id) -
    arg_min(CAST(round(value * 1048576) AS BIGINT), CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id), 0)
    / 1048576.0, 6) AS growth_mb
FROM events GROUP BY 1"""

SQL["hierarchy_rollup"] = """WITH hfiles AS (
  SELECT r.r_name AS root_id,
    n.n_name || '/c' || CAST(c.c_custkey AS VARCHAR) || '/o' || CAST(o.o_orderkey AS VARCHAR)
      || '/l' || CAST(l.l_linenumber AS VARCHAR) AS rel_path,
    l.l_returnflag = 'R' AS picked
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
hleaf AS (  -- a tree node is its path: repeated (order, line) rows are one leaf, picked if any row is
  SELECT root_id, rel_path, bool_or(picked) AS picked FROM hfiles GROUP BY 1, 2),
hanc AS (
  SELECT root_id, picked,
         CASE WHEN i = 0 THEN '' ELSE array_to_string(string_split(rel_path, '/')[1:i], '/') END AS ancestor
  FROM (SELECT *, unnest(range(0, len(string_split(rel_path, '/')))) AS i FROM hleaf))
SELECT root_id, ancestor AS rel_path,
  CASE WHEN bool_and(picked) THEN 'checked' WHEN bool_and(NOT picked) THEN 'unchecked'
       ELSE 'indeterminate' END AS state
FROM hanc GROUP BY 1, 2"""

CTE["page_files"] = """files AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS root_id,
    p || CASE WHEN p = '' OR ends_with(p, '/') THEN 'index' ELSE '' END || '~' || CAST(page_id AS VARCHAR) || '.html' AS rel_path,
    html AS content, page_id AS doc_id
  FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) AS p FROM pages))"""
SQL["page_tree"] = with_("page_files", "fanc", "entries", "prof", extra=TREE) + "SELECT root_id, pos, line FROM tree"
