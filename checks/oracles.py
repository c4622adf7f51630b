"""The same queries in SQL for DuckDB.

They are written from the rules, with windows and recursion where the Spark
side has groupings and sort keys, so the two sides share no algorithm.
"""

from __future__ import annotations

# Blanks that are stripped, as an RE2 class; without 0x1c-0x1f for records.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MODEL_BLANK = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _strip(x: str, blank: str = BLANK) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{blank}+', ''), '{blank}+\z', '')"


def _summary(x: str) -> str:
    t = _strip(x)
    heading = rf"regexp_extract({t}, '\A#{{1,6}}{BLANK}+([^\n]+)', 1)"
    sentence = rf"regexp_extract({t}, '(?s)\A(.*?[.!?]){BLANK}', 1)"
    return f"""CASE WHEN {heading} <> '' THEN {heading}
      WHEN length({sentence}) BETWEEN 1 AND 160 THEN {sentence}
      WHEN length({t}) > 160 THEN left({t}, 160) || '…' ELSE {t} END"""


def _latin(b: str) -> str:
    chars = f"list_transform(regexp_extract_all(hex({b}), '..'), lambda h: chr(CAST('0x' || h AS INTEGER)))"
    return f"replace(replace(array_to_string({chars}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _decoded(b: str) -> str:
    return f"coalesce(TRY(decode({b})), {_latin(b)})"


def _binary(b: str) -> str:
    sample = f"regexp_extract_all(hex({b}[1:1024]), '..')"
    control = f"len(list_filter({sample}, lambda x: x < '09' OR (x > '0D' AND x < '20')))"
    return f"""CASE WHEN {b} IS NULL THEN true WHEN octet_length({b}) = 0 THEN false
      ELSE CAST({control} AS DOUBLE) / len({sample}) > 0.3 END"""


def _name(p: str) -> str:
    return f"string_split({p}, '/')[-1]"


def _ext(name: str) -> str:
    return rf"lower(regexp_extract({name}, '(?s)\A(.+)([.][^.]+)\z', 2))"


def _stem(name: str) -> str:
    s = rf"regexp_extract({name}, '(?s)\A(.+)([.][^.]+)\z', 1)"
    return f"lower(CASE WHEN {s} = '' THEN {name} ELSE {s} END)"


def _parent(p: str) -> str:
    return f"coalesce(array_to_string(string_split({p}, '/')[:-2], '/'), '')"


SCORE = """CAST(CASE WHEN stem IN ('readme','license','setup','pyproject','package','requirements',
  'dockerfile','compose','makefile','main','app') THEN 100
  WHEN ext IN ('.py','.js','.json','.yml','.yaml','.toml','.sh') THEN 80
  WHEN ext IN ('.md','.rst','.txt') THEN 70 ELSE 10 END AS INTEGER)"""

ASSETS = "('.png','.jpg','.jpeg','.gif','.pdf','.mp4','.ico')"

KIND = f"""CASE WHEN ext IN ('.py','.pyi') THEN 'python'
  WHEN ext IN ('.js','.jsx','.mjs','.cjs') THEN 'javascript' WHEN ext IN ('.ts','.tsx') THEN 'typescript'
  WHEN ext = '.json' THEN 'json' WHEN ext IN ('.yml','.yaml') THEN 'yaml'
  WHEN ext IN ('.md','.markdown') THEN 'markdown' WHEN ext IN ('.rst','.adoc') THEN 'documentation'
  WHEN ext IN ('.toml','.ini','.cfg','.conf','.env','.properties') THEN 'config'
  WHEN ext = '.txt' THEN 'text' WHEN ext IN {ASSETS} THEN 'asset'
  WHEN stem IN ('dockerfile','makefile','.env','.gitignore','.dockerignore','.editorconfig') THEN 'config'
  WHEN stem IN ('readme','license','changelog','contributing','authors','notice') THEN 'documentation'
  ELSE 'unknown' END"""

def _escaped(t: str) -> str:
    """A text as the inside of a quoted JSON or Python string."""
    s = f"replace(replace({t}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    for code, letter in ((10, "n"), (13, "r"), (9, "t")):
        s = f"replace({s}, chr({code}), chr(92) || '{letter}')"
    return s


NUMBERED = """numbered AS (SELECT *, source AS project_id, CAST(floor(doc_id / 20) AS BIGINT) AS n,
  CAST(doc_id % 4 AS INTEGER) AS flavour FROM documents)"""

RAW = """raw AS (SELECT *, n AS seq, CASE WHEN n = 0 THEN 'README.md'
  WHEN n = 5 AND flavour = 0 THEN 'pyproject.toml' WHEN n = 5 AND flavour = 1 THEN 'package.json'
  WHEN n = 5 AND flavour = 2 THEN 'Dockerfile' WHEN n = 5 THEN 'sub/go.mod'
  WHEN n % 10 = 0 THEN concat('docs/guide_', n, '.md') WHEN n % 10 = 1 THEN concat('src/mod_', n, '.py')
  WHEN n % 10 = 2 THEN concat('src/', lang, '/util_', n, '.JS')
  WHEN n % 20 = 13 THEN concat('config/ci_', n, '.yml') WHEN n % 10 = 3 THEN concat('config/conf_', n, '.json')
  WHEN n % 10 = 4 THEN concat('data/', lang, '/notes_', n, '.txt')
  WHEN n % 10 = 5 THEN concat('build/script_', n, '.sh') WHEN n % 10 = 6 THEN concat('assets/logo_', n, '.png')
  WHEN n % 10 = 7 THEN concat('src/pkg_', n % 3, '/main.py') WHEN n % 10 = 8 THEN concat('misc/blob_', n, '.bin')
  ELSE concat('cfg/.env_', n) END AS rel_path FROM numbered)"""

FILES = f"""files AS (SELECT project_id, seq, rel_path, n, doc_id, lang, encode(CASE
  WHEN n % 10 = 8 THEN repeat(chr(1), 400) || text
  WHEN rel_path LIKE '%.yml' THEN concat('doc_id: ', doc_id, chr(10), 'lang: ', lang, chr(10), 'n: ', n, chr(10), 'text: "', {_escaped('text')}, '"', chr(10))
  WHEN rel_path LIKE '%.json' THEN concat('{{"doc_id": ', doc_id, ', "lang": "', lang, '", "n": ', n, ', "text": "', {_escaped('text')}, '"}}')
  WHEN rel_path LIKE '%.py' THEN concat('import os', chr(10), 'TEXT = "', {_escaped('text')}, '"', chr(10), 'class Doc_', n, ':', chr(10), '    pass', chr(10),
    'def load_', n, '():', chr(10), '    pass', chr(10)) ELSE text END) AS content FROM raw)"""

UNIQUE = """uniq AS (SELECT * FROM files QUALIFY
  row_number() OVER (PARTITION BY project_id, rel_path ORDER BY seq DESC) = 1)"""


def _described(source: str) -> str:
    """Triage, kind, summary and metrics of every row of ``source``."""
    text = _decoded("content")
    return f"""named AS (SELECT *, {_name('rel_path')} AS name FROM {source}),
parted AS (SELECT *, {_stem('name')} AS stem, {_ext('name')} AS ext FROM named),
triaged AS (SELECT *, CASE WHEN {_binary('content')} OR ext IN {ASSETS} THEN 'binary/asset' END AS skip_reason,
  {SCORE} AS raw_score, {_binary('content')} AS is_binary, {text} AS txt FROM parted),
described AS (SELECT *, CASE WHEN skip_reason IS NULL THEN raw_score END AS score,
  CASE WHEN ext IN {ASSETS} THEN 'asset' WHEN ext = '.json' THEN 'json' WHEN ext = '.yml' THEN 'yaml' WHEN ext = '.py' THEN 'python'
    ELSE 'text' END AS kind,
  CASE WHEN ext IN {ASSETS} THEN '(binary skipped)' WHEN ext = '.json' THEN 'JSON with keys: doc_id, lang, n, text'
    WHEN ext = '.yml' THEN 'YAML with keys: doc_id, lang, n, text'
    WHEN ext = '.py' THEN concat('Python; classes=Doc_', n, '; funcs=load_', n)
    ELSE {_summary('txt')} END AS summary,
  CAST(octet_length(content) AS BIGINT) AS size_bytes,
  CAST(len(list_filter(regexp_extract_all(hex(content), '..'), lambda h: h = '0A'))
    + CASE WHEN octet_length(content) > 0 AND right(hex(content), 2) <> '0A' THEN 1 ELSE 0 END AS BIGINT) AS lines,
  CASE WHEN {KIND} IN ('python','javascript','typescript') THEN {KIND} END AS language
  FROM triaged),
results AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, seq) AS rank
  FROM described WHERE skip_reason IS NULL)"""


BASE = [NUMBERED, RAW, FILES, UNIQUE]
ANALYSED = [*BASE, _described("uniq")]

MEMBERS = """members AS (SELECT project_id, n AS seq, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, CASE
  WHEN doc_id % 20 = 3 AND n % 13 = 4 THEN concat('a/../../evil_', n)
  WHEN doc_id % 20 = 7 AND n % 11 = 2 THEN '/etc/x'
  WHEN n % 4 = 0 THEN concat('./pkg//mod_', n % 7, '.py') WHEN n % 4 = 1 THEN concat('a/../b/', n % 5, '.txt')
  WHEN n % 4 = 2 THEN concat('docs/', lang, '/', n, '.md') ELSE concat('x\\y_', n) END AS member_name FROM numbered)"""

_STEPS = """list_transform(string_split(member_name, '/'),
  lambda s: CASE WHEN s = '..' THEN -1 WHEN s IN ('', '.') THEN 0 ELSE 1 END)"""
ESCAPES = f"""(member_name LIKE '/%' OR list_min(list_transform(range(1, len({_STEPS}) + 1),
  lambda i: list_sum(({_STEPS})[1:i]))) < 0)"""
STORED = "array_to_string(list_filter(string_split(member_name, '/'), lambda s: s NOT IN ('', '.', '..')), '/')"
MEMBER_LIMIT = 16384

JOBS = """job_msgs AS (SELECT user_id AS job_id, event_id, ts, CASE
  WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'close'
  WHEN event_type = 'purchase' AND event_id % 7 = 1 THEN 'event:ANALYSIS_COMPLETED'
  WHEN event_type = 'error' AND event_id % 5 = 0 THEN concat('error:', props)
  WHEN event_type = 'signup' THEN 'event:NewUpload'
  WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'event:TreeBuilt'
  WHEN event_type = 'view' AND event_id % 3 = 1 THEN 'event:AnalysisComplete'
  WHEN event_type = 'view' THEN 'event:FileDiscovered'
  WHEN event_type = 'click' THEN 'event:FileAnalysed'
  ELSE concat('note:', event_type) END AS msg FROM events)"""

UNTIL_CLOSE = """placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS pos FROM job_msgs),
flagged AS (SELECT *, min(CASE WHEN msg = 'close' THEN pos END) OVER (PARTITION BY job_id) AS close_pos FROM placed),
until_close AS (SELECT * FROM flagged WHERE close_pos IS NULL OR pos < close_pos)"""

STAGE = """CASE WHEN msg IN ('event:ANALYSIS_STARTED','event:NewUpload') THEN 'validating'
  WHEN msg IN ('event:ZipValid','event:FileDiscovered') THEN 'extracting'
  WHEN msg IN ('event:ExtractionDone','event:FileSkipped') THEN 'triaging'
  WHEN msg IN ('event:FileForAnalysis','event:TriageComplete','event:FileAnalysed') THEN 'analyzing'
  WHEN msg IN ('event:AnalysisComplete','event:TreeBuilt','event:ProjectDraft','event:SummaryPolished') THEN 'synthesizing'
  WHEN msg IN ('event:WORKFLOW_DONE','event:ANALYSIS_COMPLETED') THEN 'completed'
  WHEN msg IN ('event:ZipInvalid','event:ExtractionFailed') THEN 'failed' END"""

STATUS = f"""outcomes AS (SELECT job_id, pos, ts, CASE WHEN msg LIKE 'error:%' THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN msg LIKE 'error:%' THEN substr(msg, 7) END AS error FROM until_close
  WHERE msg LIKE 'error:%' OR msg IN ('event:WORKFLOW_DONE', 'event:ANALYSIS_COMPLETED')
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY pos DESC) = 1),
stages AS (SELECT job_id, {STAGE} AS stage FROM until_close WHERE {STAGE} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY pos DESC) = 1),
all_jobs AS (SELECT job_id, min(ts) AS created_at FROM job_msgs GROUP BY job_id),
job_states AS (SELECT j.job_id, coalesce(o.status, 'pending') AS status, o.error,
    coalesce(s.stage, 'pending') AS latest_stage, j.created_at, o.ts AS completed_at
  FROM all_jobs j LEFT JOIN outcomes o USING (job_id) LEFT JOIN stages s USING (job_id))"""

STATES = [JOBS, UNTIL_CLOSE, STATUS]

FLAGS = """flags AS (SELECT project_id,
  bool_or(lower(rel_path) LIKE '%setup.py' OR lower(rel_path) LIKE '%pyproject.toml') AS has_packaging,
  bool_or(lower(rel_path) LIKE '%package.json') AS has_package_json,
  bool_or(lower(rel_path) LIKE '%dockerfile') AS has_dockerfile,
  bool_or(lower(rel_path) LIKE '%go.mod') AS has_go_mod,
  bool_or(lower(rel_path) LIKE '%pom.xml') AS has_pom FROM results GROUP BY project_id)"""
STACK = """CASE WHEN has_packaging THEN 'Python package' WHEN has_package_json THEN 'Node.js project'
  WHEN has_dockerfile THEN 'Containerized service' WHEN has_go_mod THEN 'Go module'
  WHEN has_pom THEN 'Java Maven project' ELSE 'Unknown or mixed‐language project' END"""
DOMINANT = """dominant AS (SELECT project_id, kind AS dominant_kind, n AS dominant_count FROM (
  SELECT project_id, kind, count(*) AS n, min(rank) AS first FROM results GROUP BY project_id, kind)
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, first) = 1)"""
README = """readmes AS (SELECT project_id, regexp_replace(summary, '[.]+\\z', '') || '.' AS readme_line FROM results
  WHERE lower(rel_path) LIKE 'readme%' AND kind LIKE 'text%'
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY rank) = 1)"""
OVERVIEW = f"""paragraphs AS (SELECT f.project_id, d.dominant_kind, d.dominant_count, {STACK} AS stack, concat_ws(' ', readme_line,
    concat('The dominant file type is *', dominant_kind, '* (count: ', dominant_count, ').'),
    concat('Inferred tech stack: ', {STACK}, '.'),
    CASE WHEN has_dockerfile THEN 'Presence of a Dockerfile suggests containerized deployment.' END,
    CASE WHEN has_packaging THEN 'Packaging metadata indicates a Python package.' END,
    CASE WHEN has_package_json THEN 'Including ''package.json'' reveals a Node.js component.' END) AS p
  FROM flags f JOIN dominant d USING (project_id) LEFT JOIN readmes USING (project_id)),
overview AS (SELECT project_id, dominant_kind, dominant_count, stack, CASE WHEN length(p) > 300
    THEN regexp_replace(left(p, 299), '{BLANK}+\\z', '') || '…' ELSE p END AS project_summary FROM paragraphs)"""
SUMMARY = [FLAGS, DOMINANT, README, OVERVIEW]

NODES = """placed_files AS (SELECT project_id, seq, rel_path, string_split(rel_path, '/') AS parts,
    len(string_split(rel_path, '/')) AS depth, string_split(rel_path, '/')[-1] AS name FROM uniq),
ordered_files AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY depth, name, seq) AS ord FROM placed_files),
nodes AS (SELECT project_id, array_to_string(parts[1:k], '/') AS node,
    CASE WHEN k = 1 THEN '' ELSE array_to_string(parts[1:k-1], '/') END AS parent, parts[k] AS name,
    CAST(k AS INTEGER) AS depth, bool_and(k < depth) AS is_dir, min(ord) AS first
  FROM ordered_files, unnest(range(1, len(parts) + 1)) AS t(k) GROUP BY ALL),
siblings AS (SELECT *, row_number() OVER (PARTITION BY project_id, parent ORDER BY first) AS sibling_rank,
    row_number() OVER (PARTITION BY project_id, parent ORDER BY first DESC) = 1 AS is_last FROM nodes)"""
NODES = NODES.replace("GROUP BY ALL", "GROUP BY project_id, parts[1:k], parts[1:k-1], parts[k], k")

LINES = """walk AS (
  SELECT project_id, node, parent, depth, is_dir, [sibling_rank] AS path, CASE WHEN is_last THEN '    ' ELSE '│   ' END AS below,
    CASE WHEN is_last THEN '└── ' ELSE '├── ' END || name || CASE WHEN is_dir THEN '/' ELSE '' END AS line
  FROM siblings WHERE depth = 1
  UNION ALL
  SELECT s.project_id, s.node, s.parent, s.depth, s.is_dir, list_append(w.path, s.sibling_rank),
    w.below || CASE WHEN s.is_last THEN '    ' ELSE '│   ' END,
    w.below || CASE WHEN s.is_last THEN '└── ' ELSE '├── ' END || s.name || CASE WHEN s.is_dir THEN '/' ELSE '' END
  FROM walk w JOIN siblings s ON s.project_id = w.project_id AND s.parent = w.node),
tree_rows AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY path) AS line_no, node, parent, depth, is_dir, line FROM walk
  UNION ALL SELECT DISTINCT project_id, 0, '', NULL, 0, true, project_id || '/' FROM uniq),
tree AS (SELECT project_id, string_agg(line, chr(10) ORDER BY line_no) AS tree_text FROM tree_rows GROUP BY project_id)"""


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


FILE_STRINGS = """string_agg(concat_ws(' | ', rel_path, kind, summary, lines, size_bytes, coalesce(language, '-')), chr(10) ORDER BY rank)"""
ARTIFACTS = f"""arrays AS (SELECT project_id, {FILE_STRINGS} AS file_summaries FROM results GROUP BY project_id),
artifacts AS (SELECT t.project_id, CAST(0 AS BIGINT) AS part, tree_text, coalesce(file_summaries, '') AS file_summaries, project_summary
  FROM tree t JOIN overview USING (project_id) LEFT JOIN arrays USING (project_id))"""

# Archives of at most 64 members; sizes follow from the stored (uncompressed) layout.
PACKED = """packed_rows AS (SELECT *, project_id AS source_project, concat(project_id, '_', CAST(floor(seq / 64) AS BIGINT)) AS archive,
    seq % 64 AS entry, (CAST(regexp_extract(project_id, '(\\d+)$', 1) AS BIGINT) + CAST(floor(seq / 64) AS BIGINT)) % 5 AS fault FROM files),
archive_sizes AS (SELECT archive, any_value(fault) AS fault, min_by(rel_path, seq) AS first_path,
    CAST(sum(76 + 2 * octet_length(encode(rel_path)) + octet_length(content)) + 22 AS BIGINT) AS zip_bytes FROM packed_rows GROUP BY archive)"""
ARCHIVE_MEMBERS = """archive_files AS (SELECT archive AS project_id, entry AS seq, rel_path, n, doc_id, lang, content, fault FROM packed_rows
  QUALIFY row_number() OVER (PARTITION BY archive, rel_path ORDER BY seq DESC) = 1)"""
ARCHIVES = [NUMBERED, RAW, FILES, PACKED, ARCHIVE_MEMBERS]


# Per job: where both signals are there, before which message it was silent for over a day, and files up to either.
SILENCES = """placed_msgs AS (SELECT job_id, msg, epoch_ms(ts) AS ms, row_number() OVER w AS p, epoch_ms(lag(ts) OVER w) AS before_ms,
    max(epoch_ms(ts)) OVER () - 600000 AS now_ms FROM job_msgs WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
bounds AS (SELECT job_id, CASE WHEN bool_or(msg = 'event:TreeBuilt') AND bool_or(msg = 'event:AnalysisComplete')
      THEN greatest(min(p) FILTER (msg = 'event:TreeBuilt'), min(p) FILTER (msg = 'event:AnalysisComplete')) END AS done_pos,
    min(p) FILTER (ms - before_ms > 86400000) AS silent_pos, max(ms) AS last_ms, any_value(now_ms) AS now_ms FROM placed_msgs GROUP BY job_id),
ends_without_silence AS (SELECT b.*, count(*) FILTER (msg = 'event:FileAnalysed' AND p <= done_pos) AS file_count,
    count(*) FILTER (msg = 'event:FileAnalysed' AND (silent_pos IS NULL OR p < silent_pos)) AS files_before_silence
    FROM bounds b JOIN placed_msgs USING (job_id) GROUP BY ALL)"""

# Verdicts of a run over damaged archives: what the directory declares is looked at before checksums.
RUN = """run_sizes AS (SELECT s.archive, s.fault, max(octet_length(p.content)) > 24576 AS oversized
    FROM archive_sizes s JOIN packed_rows p USING (archive) GROUP BY ALL),
verdicts AS (SELECT archive, CASE WHEN fault = 2 THEN 'ZipInvalid' WHEN oversized THEN 'ExtractionFailed' WHEN fault = 1 THEN 'ZipInvalid' END AS failed FROM run_sizes),
sound AS (SELECT archive FROM verdicts WHERE failed IS NULL)"""


def _events(lost: str) -> str:
    """Counts of events where the results named by ``lost`` never came."""
    return f""", numbered_results AS (SELECT *, CAST(regexp_extract(project_id, '(\\d+)_\\d+$', 1) AS BIGINT) AS number FROM results),
      found AS (SELECT * FROM numbered_results WHERE NOT ({lost})),
      complete AS (SELECT archive FROM sound WHERE (SELECT count(*) FROM results r WHERE r.project_id = archive) = (SELECT count(*) FROM found f WHERE f.project_id = archive))
      SELECT project_id, 3 AS stage, 'FileDiscovered' AS type, count(*) AS n FROM described GROUP BY ALL
      UNION ALL SELECT project_id, 5, 'FileSkipped', count(*) FROM described WHERE skip_reason IS NOT NULL GROUP BY ALL
      UNION ALL SELECT project_id, 6, 'FileForAnalysis', count(*) FROM results GROUP BY ALL
      UNION ALL SELECT project_id, 8, 'FileAnalysed', count(*) FROM found GROUP BY ALL
      UNION ALL SELECT archive, 0, 'NewUpload', 1 FROM verdicts
      UNION ALL SELECT archive, 1, CASE WHEN failed = 'ZipInvalid' THEN failed ELSE 'ZipValid' END, 1 FROM verdicts
      UNION ALL SELECT archive, 2, failed, 1 FROM verdicts WHERE failed = 'ExtractionFailed'
      UNION ALL SELECT archive, stage, type, 1 FROM sound, (VALUES (4, 'ExtractionDone'), (7, 'TriageComplete'), (10, 'TreeBuilt')) v(stage, type)
      UNION ALL SELECT archive, stage, type, 1 FROM complete, (VALUES (9, 'AnalysisComplete'), (11, 'ProjectDraft'), (12, 'SummaryPolished')) v(stage, type)"""


def _archive_artifacts() -> str:
    """The whole analysis over the packed archives."""
    return _recursive(
        *ARCHIVES,
        "uniq AS (SELECT * FROM archive_files)",
        _described("uniq"),
        *SUMMARY,
        NODES,
        LINES,
        ARTIFACTS,
    )


ODD_PATHS = """odd_paths AS (SELECT 'documents' AS src, doc_id AS id, CASE doc_id % 14
  WHEN 0 THEN '.env' WHEN 1 THEN concat('foo', doc_id, '.') WHEN 2 THEN '..foo' WHEN 3 THEN concat('a', doc_id, '.tar.gz')
  WHEN 4 THEN 'dir/Dockerfile' WHEN 5 THEN 'a..b' WHEN 6 THEN '.a.b' WHEN 7 THEN '...' WHEN 8 THEN concat('x//y/./z_', doc_id, '.TXT')
  WHEN 9 THEN concat('docs/Read.Me.', lang) WHEN 10 THEN concat('win\\path_', doc_id, '.py') WHEN 11 THEN concat('src/', lang, '/App.JS')
  WHEN 12 THEN './lib/tool.ts' ELSE 'a.b/c/' END AS path FROM documents
  UNION ALL SELECT 'pages', page_id, url FROM pages),
clean_paths AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')) AS parts FROM odd_paths),
named_paths AS (SELECT *, parts[-1] AS name FROM clean_paths)"""

ODD_TEXTS = """odd_texts AS (SELECT 'documents' AS src, doc_id AS id, CASE doc_id % 9
  WHEN 0 THEN '# ' || text
  WHEN 1 THEN concat('  ', chr(10), '## ', chr(8195), 'Title of ', source, '  ', chr(10), text)
  WHEN 2 THEN '####### ' || text
  WHEN 3 THEN concat(chr(12288), chr(8201), text, chr(160), chr(28), chr(10))
  WHEN 4 THEN replace(text, '.', ',') WHEN 5 THEN replace(text, ' ', '_')
  ELSE text END AS text FROM documents
  UNION ALL SELECT 'pages', page_id, html FROM pages
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations)"""



def _names(prefix: str, bound: str, top: int) -> str:
    shown = ", ".join(f"CASE WHEN {bound} >= {i} THEN concat('{prefix}{i}_', doc_id) END" for i in range(1, top + 1))
    return f"concat_ws(', ', {shown})"


_F = "(CAST(floor(doc_id / 5) AS BIGINT) % 4)"

RECORD = f"""records AS (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN concat(' ', chr(12288), ' ') ELSE concat(' src\\f_', doc_id, '.py ') END AS rel_path,
  CASE doc_id % 11 WHEN 1 THEN 'binary' WHEN 2 THEN 'text' ELSE 'python' END AS kind,
  concat(' ', text, chr(10)) AS summary,
  CASE doc_id % 11 WHEN 3 THEN -1 ELSE n_chars END AS lines, CASE doc_id % 11 WHEN 4 THEN -5 ELSE n_chars * 2 END AS size_bytes,
  CASE doc_id % 11 WHEN 5 THEN NULL ELSE lang END AS language FROM documents),
cleaned AS (SELECT doc_id, replace({_strip('rel_path', MODEL_BLANK)}, '\\', '/') AS rel_path, kind,
  {_strip('summary', MODEL_BLANK)} AS summary, lines, size_bytes, language FROM records)"""

_KINDS = "('python','javascript','typescript','json','yaml','markdown','text','asset','config','documentation','unknown')"


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    members = _with(NUMBERED, MEMBERS)
    analysed = _with(*ANALYSED)
    summary = _with(*ANALYSED, *SUMMARY)
    tree = _recursive(*BASE, NODES, LINES)
    unique_md5 = "project_id, seq, rel_path, size_bytes, content_md5"

    # Sources and sinks
    q["src1"] = _with(*ARCHIVES) + "SELECT archive AS project_id, zip_bytes AS length FROM archive_sizes WHERE zip_bytes <= 130000"
    q["src2"] = _with(*ARCHIVES) + (
        "SELECT project_id, seq, rel_path AS member_name, rel_path, CAST(octet_length(content) AS BIGINT) AS size_bytes,"
        " md5(content) AS content_md5 FROM archive_files"
    )
    q["src2_content"] = q["src2"]
    q["src3"] = _with(*BASE) + (
        "SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY rel_path) - 1 AS seq, rel_path,"
        " CAST(octet_length(content) AS BIGINT) AS size_bytes, md5(content) AS content_md5 FROM uniq"
    )
    q["src4"] = _with(*BASE) + (
        f"SELECT {unique_md5} FROM (SELECT *, CAST(octet_length(content) AS BIGINT) AS size_bytes, md5(content) AS content_md5 FROM files)"
    )
    q["src5"] = r"""SELECT doc_id, 0 AS item_no, 'src/m_' || doc_id || '.py' AS rel_path, 'python' AS kind, 'Python' AS summary,
        n_chars AS lines, CAST(0 AS BIGINT) AS size_bytes, CAST(NULL AS VARCHAR) AS language FROM documents WHERE doc_id % 5 = 0
      UNION ALL SELECT doc_id, 1, 'a.txt', 'unknown', '', 0, 0, NULL FROM documents WHERE doc_id % 5 = 0
      UNION ALL SELECT doc_id, 0, 'c.json', 'json', lang, 0, 7, NULL FROM documents WHERE doc_id % 5 = 4"""
    q["snk1"] = _recursive(*ANALYSED, *SUMMARY, NODES, LINES, ARTIFACTS) + "SELECT * FROM artifacts"
    q["snk2"] = analysed + "SELECT project_id, rank, rel_path, kind, summary, lines, size_bytes, language FROM results"

    # Validation
    q["val1"] = _with(*ARCHIVES) + """, uploads AS (SELECT archive, CASE fault WHEN 2 THEN 12 + length(archive) ELSE zip_bytes END AS length, fault, first_path FROM archive_sizes
        UNION ALL SELECT DISTINCT 'missing_' || project_id, NULL, NULL, NULL FROM files)
      SELECT archive, length, CASE WHEN length IS NULL THEN 'File does not exist' WHEN length > 131072 THEN 'Archive exceeds 0.125 MB'
        WHEN fault = 2 THEN 'Not a ZIP archive' WHEN fault = 1 THEN 'CRC error in member: ' || first_path END AS reason,
        length IS NOT NULL AND length <= 131072 AND fault NOT IN (1, 2) AS is_valid FROM uploads"""
    q["api1_verdicts"] = _with(*ARCHIVES) + """, uploads AS (SELECT archive, CASE fault WHEN 2 THEN 12 + length(archive) ELSE zip_bytes END AS length, fault, first_path FROM archive_sizes)
      SELECT archive, length, CASE WHEN length > 131072 THEN 'Archive exceeds 0.125 MB'
        WHEN fault = 2 THEN 'Not a ZIP archive' WHEN fault = 1 THEN 'CRC error in member: ' || first_path END AS reason FROM uploads"""
    q["str1_verdicts"] = q["api1_verdicts"]
    q["val2"] = """SELECT doc_id, size, size > 5242880 AS too_large, CASE WHEN size > 5242880 THEN
        concat('Archive exceeds 5 MB (', printf('%.1f', size / 1048576), ' MB)') END AS size_error
      FROM (SELECT doc_id, CAST(octet_length(encode(text)) * 1000 AS BIGINT) AS size FROM documents)"""
    q["val3"] = members + f"SELECT * FROM members WHERE project_id NOT IN (SELECT project_id FROM members WHERE size_bytes > {MEMBER_LIMIT})"
    q["val4"] = members + f"SELECT * FROM members WHERE project_id NOT IN (SELECT project_id FROM members WHERE {ESCAPES})"
    fault = f"""CASE WHEN size_bytes > {MEMBER_LIMIT} THEN concat('Member ', member_name, ' exceeds 0.015625 MB')
        WHEN {ESCAPES} THEN concat('Illegal member path: ', member_name) END"""
    status = f"status AS (SELECT project_id, min_by(fault, seq) FILTER (fault IS NOT NULL) AS reason FROM (SELECT *, {fault} AS fault FROM members) GROUP BY project_id)"
    q["val5"] = _with(NUMBERED, MEMBERS, status) + "SELECT project_id, reason, reason IS NULL AS is_valid FROM status"
    q["val6"] = """SELECT src, id, name FROM (SELECT 'pages' AS src, page_id AS id, CASE page_id % 4 WHEN 0 THEN url || '.zip'
        WHEN 1 THEN url || '.ZIP' ELSE url END AS name FROM pages
        UNION ALL SELECT 'documents', doc_id, CASE doc_id % 3 WHEN 0 THEN source || '.Zip' WHEN 1 THEN '' END FROM documents)
      WHERE name ILIKE '%.zip'"""
    q["val7"] = _with(RECORD) + f"""SELECT *, CASE WHEN rel_path = '' THEN 'rel_path is empty' WHEN kind NOT IN {_KINDS} THEN 'kind is not known'
        WHEN length(summary) > 500 THEN 'summary exceeds 500 characters' WHEN lines < 0 THEN 'lines is negative'
        WHEN size_bytes < 0 THEN 'size_bytes is negative' END AS reject_reason FROM cleaned"""
    q["val8"] = """SELECT doc_id, project_name, length(description) AS description_chars, CASE WHEN project_name = '' THEN 'project_name is empty'
        WHEN length(description) > 1000 THEN 'description exceeds 1000 characters'
        WHEN length(architecture_notes) > 2000 THEN 'architecture_notes exceeds 2000 characters'
        WHEN file_count < 0 THEN 'file_count is negative' WHEN line_count < 0 THEN 'line_count is negative' END AS reject_reason
      FROM (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN '' ELSE source END AS project_name, text AS description,
        text AS architecture_notes, CASE doc_id % 11 WHEN 1 THEN -1 ELSE 3 END AS file_count,
        CASE doc_id % 11 WHEN 2 THEN -1 ELSE n_chars END AS line_count FROM documents)"""
    q["val9"] = _with(*BASE) + "SELECT project_id, seq, rel_path, md5(content) AS content_md5 FROM uniq"
    q["val10"] = members + f"SELECT project_id, seq, member_name, {STORED} AS stored_path FROM members"

    # Scalar functions
    q["fn1"] = _with(ODD_PATHS) + f"""SELECT src, id, path, name, {_stem('name')} AS stem, {_ext('name')} AS ext,
        coalesce(array_to_string(parts[:-2], '/'), '') AS parent, CAST(len(parts) AS INTEGER) AS depth, array_to_string(parts, ' > ') AS parts FROM named_paths"""
    q["fn2"] = f"""SELECT doc_id, {_binary('content')} AS is_binary FROM (SELECT doc_id, encode(CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN NULL
        WHEN 2 THEN repeat(chr(9) || chr(10), 300) || text WHEN 3 THEN repeat('a', 1024) || repeat(chr(2), 900)
        ELSE repeat(chr(1), 295 + doc_id % 25) || text END) AS content FROM documents)"""
    q["fn3"] = _with(ODD_PATHS) + f"SELECT src, id, {SCORE} AS score FROM (SELECT *, {_stem('name')} AS stem, {_ext('name')} AS ext FROM named_paths)"
    q["fn4"] = f"""SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, {_decoded('content')} AS t FROM (
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '\\xFF\\x0D\\x0A'::BLOB || encode(text) || '\\x0D'::BLOB
          WHEN doc_id % 5 = 1 THEN encode(repeat(text, CAST(floor(70000 / greatest(n_chars, 1)) AS BIGINT) + 1))
          WHEN octet_length(encode(text)) = length(text) THEN encode(repeat(text, 3)) ELSE encode(text) END AS content FROM documents))"""
    q["fn5"] = _with(ODD_TEXTS) + f"SELECT src, id, {_summary('text')} AS summary FROM odd_texts"
    q["fn6"] = "SELECT event_id, 'JSON with keys: ' || array_to_string(json_keys(props)[1:5], ', ') AS summary FROM events"
    q["fn6_objects"] = q["fn6"]
    q["fn7"] = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'YAML with keys: doc_id, lang, n, text' WHEN 1 THEN concat('YAML with keys: a, ', source, ', c, ', text, ', e')
        WHEN 2 THEN concat('YAML with keys: ', array_to_string(regexp_extract_all(text, '(?s).')[1:5], ', ')) END AS summary FROM documents"""
    q["fn8"] = f"""SELECT doc_id, CASE WHEN doc_id % 9 = 8 THEN NULL ELSE concat('Python',
        CASE WHEN doc_id % 5 > 0 THEN '; classes=' || {_names('C', 'doc_id % 5', 3)} ELSE '' END,
        CASE WHEN {_F} > 0 THEN '; funcs=' || {_names('f', _F, 3)} ELSE '' END) END AS summary FROM documents"""
    q["fn9"] = _with(NUMBERED, RAW, FILES, _described("files")) + "SELECT project_id, seq, rel_path, kind, summary FROM described"
    q["fn10"] = _with(ODD_PATHS) + "SELECT src, id, replace(path, '\\', '/') AS path FROM odd_paths"
    q["fn11"] = analysed + "SELECT project_id, seq, lines, size_bytes, language FROM described"
    q["fn12"] = _with(ODD_PATHS) + f"SELECT src, id, {KIND} AS declared_kind FROM (SELECT *, {_stem('name')} AS stem, {_ext('name')} AS ext FROM named_paths)"
    q["fn13"] = _with(JOBS) + """SELECT job_id, event_id, CASE WHEN msg = 'close' THEN 'close' WHEN msg LIKE 'event:%' THEN 'event'
        WHEN msg LIKE 'error:%' THEN 'error' ELSE 'other' END AS type,
        CASE WHEN msg LIKE 'event:%' OR msg LIKE 'error:%' THEN substr(msg, 7) END AS body FROM job_msgs"""

    # Triage
    q["tri1"] = analysed + "SELECT project_id, seq, rel_path, is_binary, skip_reason, score FROM described"
    q["tri2"] = analysed + "SELECT project_id, seq, rel_path, score, rank FROM results"
    q["tri3"] = analysed + "SELECT project_id, seq, rel_path, score, rank FROM results WHERE rank <= 20"
    q["tri4"] = analysed + "SELECT project_id, skip_reason AS reason, ext, count(*) AS n FROM described WHERE skip_reason IS NOT NULL GROUP BY ALL"

    # Aggregates
    q["agg1"] = summary + "SELECT * FROM flags"
    q["agg2"] = summary + f"SELECT project_id, {STACK} AS stack FROM flags"
    q["agg3"] = summary + "SELECT * FROM dominant"
    q["agg4"] = summary + "SELECT f.project_id, readme_line FROM flags f LEFT JOIN readmes USING (project_id)"
    q["agg5"] = summary + "SELECT * FROM overview"
    q["agg6"] = analysed + "SELECT project_id, kind, count(*) AS n FROM results GROUP BY ALL"
    q["agg7"] = summary + """, langs AS (SELECT project_id, string_agg(language, ', ' ORDER BY n DESC, language) AS languages FROM (
          SELECT project_id, language, count(*) AS n FROM results WHERE language IS NOT NULL GROUP BY ALL) GROUP BY project_id),
        tops AS (SELECT project_id, string_agg(c, ', ' ORDER BY n DESC, c) AS key_components, count(*) AS component_count FROM (
          SELECT project_id, string_split(rel_path, '/')[1] AS c, count(*) AS n FROM results WHERE rel_path LIKE '%/%' GROUP BY ALL) GROUP BY project_id),
        totals AS (SELECT project_id, count(*) AS file_count, CAST(sum(lines) AS BIGINT) AS line_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM results GROUP BY project_id)
      SELECT t.*, t.project_id AS project_name, coalesce(component_count, 0) AS component_count, coalesce('Top-level components: ' || key_components || '.', '') AS architecture_notes, coalesce(languages, '') AS languages, coalesce(key_components, '') AS key_components, project_summary AS description,
        concat_ws(', ', CASE WHEN has_packaging THEN 'Python package' END, CASE WHEN has_package_json THEN 'Node.js project' END,
          CASE WHEN has_dockerfile THEN 'Containerized service' END, CASE WHEN has_go_mod THEN 'Go module' END,
          CASE WHEN has_pom THEN 'Java Maven project' END) AS frameworks
      FROM totals t JOIN flags USING (project_id) JOIN overview USING (project_id) LEFT JOIN langs USING (project_id) LEFT JOIN tops USING (project_id)"""
    q["agg7_components"] = analysed + """SELECT project_id, string_split(rel_path, '/')[1] AS component, count(*) AS n
        FROM results WHERE rel_path LIKE '%/%' GROUP BY ALL"""
    q["agg8"] = analysed + """SELECT kind, ext, language, count(*) AS file_count, CAST(sum(lines) AS BIGINT) AS line_count,
        CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(summary) AS completed_count FROM results GROUP BY ALL"""

    # Tree
    q["tre1"] = _with(*BASE, NODES) + "SELECT project_id, node, parent, name, depth, is_dir FROM nodes"
    q["tre2"] = _with(*BASE, NODES) + "SELECT project_id, node, parent, name, depth, is_dir, sibling_rank, is_last FROM siblings"
    q["tre2_files"] = _with(*BASE, NODES) + "SELECT project_id, seq, rel_path, ord FROM ordered_files"
    q["tre3_lines"] = tree + "SELECT * FROM tree_rows"
    q["tre3"] = tree + "SELECT project_id, CAST(0 AS BIGINT) AS part, tree_text FROM tree"
    q["tre4"] = _with(*BASE, NODES) + """SELECT project_id, CAST(0 AS BIGINT) AS part, concat(project_id, '/', chr(10),
        string_agg(repeat('  ', depth - 1) || name, chr(10) ORDER BY ord)) AS tree_text FROM ordered_files GROUP BY project_id"""
    q["tre5"] = _with(*BASE, NODES) + f"""SELECT project_id, CAST(0 AS BIGINT) AS part, concat(project_id, '/', chr(10),
        string_agg(repeat('  ', depth - 1) || name, chr(10) ORDER BY start, parts)) AS tree_text FROM (
        SELECT *, min(parts) OVER (PARTITION BY project_id, {_parent('rel_path')}) AS start FROM placed_files) GROUP BY project_id"""

    # Joins
    q["jn1"] = q["snk1"]
    q["jn3"] = _with(NUMBERED, MEMBERS, status) + "SELECT m.* FROM members m JOIN status s USING (project_id) WHERE reason IS NULL"
    q["jn5"] = _with(*ANALYSED, NODES) + """SELECT n.project_id, n.node, n.parent, n.name, n.depth, n.is_dir, r.kind, r.summary, r.lines, r.size_bytes, r.language
      FROM nodes n LEFT JOIN results r ON r.project_id = n.project_id AND r.rel_path = n.node"""

    # Reports and event table
    q["rpt1"] = analysed + """SELECT project_id, rank AS row_no, rel_path AS path, kind, CAST(lines AS VARCHAR) AS lines, substr(summary, 1, 100) AS summary FROM results WHERE rank <= 25
      UNION ALL SELECT project_id, 26, '...', concat('+', count(*) - 25, ' more'), '...', '' FROM results GROUP BY project_id HAVING count(*) > 25"""
    q["rpt1_lines"] = analysed + "SELECT project_id, rank, concat(rel_path, ' (', kind, ') – ', summary) AS line FROM results"
    run = [*ARCHIVES, RUN, "uniq AS (SELECT f.* FROM archive_files f SEMI JOIN sound s ON f.project_id = s.archive)", _described("uniq")]
    q["set1"] = _with(*run) + _events("number % 7 = 3 AND seq % 10 = 7")
    q["api1_events"] = _with(*run) + _events("false")
    q["api1_report"] = _with(*run) + """SELECT project_id, rank AS row_no, rel_path AS path, kind, CAST(lines AS VARCHAR) AS lines, substring(summary, 1, 100) AS summary
        FROM results WHERE rank <= 50
      UNION ALL SELECT project_id, 51, '...', concat('+', count(*) - 50, ' more'), '...', '' FROM results GROUP BY project_id HAVING count(*) > 50"""

    # Jobs
    states = _with(*STATES)
    q["job1"] = _with(JOBS, UNTIL_CLOSE) + "SELECT job_id, event_id, msg FROM until_close"
    q["job2"] = _with(JOBS, UNTIL_CLOSE) + """SELECT job_id, event_id, CAST(CASE WHEN
        count(*) FILTER (msg IN ('event:WORKFLOW_DONE', 'event:ANALYSIS_COMPLETED')) OVER w > 0 THEN 100
        ELSE least(100, 10 * count(*) FILTER (msg LIKE 'event:%') OVER w) END AS INTEGER) AS progress
      FROM until_close WINDOW w AS (PARTITION BY job_id ORDER BY pos)"""
    q["job3"] = states + "SELECT job_id, status, error, latest_stage FROM job_states"
    q["job4"] = states + """SELECT job_id, status, status IN ('completed', 'failed') AS is_complete,
        CAST(epoch_us(completed_at) - epoch_us(created_at) AS DOUBLE) / 1000000 AS duration_seconds FROM job_states"""
    q["job5"] = states + "SELECT job_id, status, concat('upload_', job_id, '.zip') AS filename, (SELECT count(*) FROM job_states) AS total FROM job_states"
    q["job5_counts"] = states + "SELECT status, count(*) AS n FROM job_states GROUP BY status"
    q["job6"] = _with(*ANALYSED, *SUMMARY, *STATES) + """SELECT job_id, status, CASE WHEN status = 'failed' THEN error END AS error, project_summary
      FROM job_states j LEFT JOIN (SELECT CAST(substr(project_id, 4) AS BIGINT) AS job_id, project_summary FROM overview) o USING (job_id)"""

    # Streams
    q["str1"] = _with(*ARCHIVES) + "SELECT archive AS project_id, zip_bytes AS length FROM archive_sizes"
    archive_results = _with(*ARCHIVES, _described("archive_files"))
    q["str2"] = archive_results + "SELECT project_id, seq, rel_path, score, kind, summary, lines, size_bytes, language FROM results"
    q["str3"] = archive_results + "SELECT project_id, kind, count(*) AS n FROM results GROUP BY ALL"
    q["str4"] = _with(JOBS, SILENCES) + "SELECT job_id, file_count, false AS timed_out FROM ends_without_silence WHERE done_pos IS NOT NULL"
    q["str5"] = q["job1"]
    q["str6"] = _with(JOBS, SILENCES) + """SELECT job_id, CASE WHEN timed_out THEN files_before_silence ELSE file_count END AS file_count, timed_out
      FROM (SELECT *, done_pos IS NULL OR silent_pos <= done_pos AS timed_out FROM ends_without_silence)
      WHERE NOT timed_out OR silent_pos IS NOT NULL OR last_ms + 86400000 < now_ms"""
    q["str6_stream"] = q["str6"]
    q["str7"] = _archive_artifacts() + "SELECT * FROM artifacts"

    # Enrichment, user functions, whole pipeline
    q["enr1"] = summary + "SELECT project_id, project_summary, 'ollama' AS provider, false AS polished, CAST(NULL AS VARCHAR) AS error FROM overview"
    q["enr1_upper"] = summary + """SELECT project_id, CASE WHEN project_id LIKE '%5' THEN project_summary ELSE upper(project_summary) END AS project_summary,
        'openai' AS provider, project_id NOT LIKE '%5' AS polished, CASE WHEN project_id LIKE '%5' THEN 'no answer' END AS error FROM overview"""
    q["udf1"] = analysed + """SELECT project_id, seq, CASE WHEN ext = '.sh' AND length(txt) % 2 = 0 THEN 'shell' ELSE kind END AS kind,
        CASE WHEN ext = '.sh' AND length(txt) % 2 = 0 THEN concat('Shell, ', length(txt), ' characters') ELSE summary END AS summary FROM results"""
    q["api1"] = q["snk1"]
    q["api1_archives"] = q["str7"]
    q["api1_flat"] = _with(*ANALYSED, *SUMMARY, NODES, """flat AS (SELECT project_id, concat(project_id, '/', chr(10),
        string_agg(repeat('  ', depth - 1) || name, chr(10) ORDER BY ord)) AS tree_text FROM ordered_files GROUP BY project_id)""") + """
      SELECT project_id, CAST(0 AS BIGINT) AS part, tree_text, project_summary FROM flat JOIN overview USING (project_id)"""
    return q
