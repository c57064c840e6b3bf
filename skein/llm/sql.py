"""DuckDB oracles of the pN queries."""

from . import authored as A

P1_FOUND = """
WITH RECURSIVE lengths AS (
  SELECT f.id AS file_id, coalesce(f.counted, s.kept) AS n
  FROM (SELECT id, max(CASE WHEN line_count > 0 THEN line_count END) AS counted FROM files WHERE id IS NOT NULL GROUP BY id) f
  LEFT JOIN (
    SELECT file_id, kept_lines AS kept FROM (
      SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sent_at DESC NULLS LAST, slice_id DESC NULLS LAST) AS place
      FROM slices WHERE NOT sliced) WHERE place = 1) s
  ON s.file_id = f.id
  WHERE coalesce(f.counted, s.kept) > 400),
cuts AS (
  SELECT l.file_id, l.n, list_sort(list(DISTINCT s.line) FILTER (WHERE s.line BETWEEN 2 AND l.n)) AS lines
  FROM lengths l LEFT JOIN symbols s ON s.file_id = l.file_id GROUP BY ALL),
walk AS (
  SELECT file_id, n, lines, 1 AS piece_no, 1::BIGINT AS a,
    coalesce(list_max(list_filter(lines, lambda x: x > 21 AND x <= 401)), 401)::BIGINT AS s FROM cuts
  UNION ALL
  SELECT file_id, n, lines, piece_no + 1, s - 20,
    coalesce(list_max(list_filter(lines, lambda x: x > s AND x <= s + 380)), s + 380)::BIGINT
  FROM walk WHERE n - a + 1 > 400)
SELECT file_id, piece_no::BIGINT AS piece_no, a AS first_line,
  CASE WHEN n - a + 1 <= 400 THEN n ELSE s - 1 END::BIGINT AS last_line
FROM walk
"""

P2_FOUND = r"""
WITH ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY message_id
    ORDER BY coalesce(input_tokens, output_tokens, cache_read_input_tokens, cache_creation_input_tokens) IS NULL,
             coalesce(input_tokens, 0)::HUGEINT + coalesce(output_tokens, 0) + coalesce(cache_read_input_tokens, 0)
               + coalesce(cache_creation_input_tokens, 0) DESC,
             received_at NULLS LAST, delivery_id) AS place
  FROM log_messages WHERE message_id IS NOT NULL),
turns AS (
  SELECT session_id, message_id, delivery_id, log_path, line_no, event_ts, lower(trim(row_type, E' \t\n\r ')) AS role
  FROM ranked WHERE place = 1 AND session_id IS NOT NULL AND NOT coalesce(is_sidechain, false)),
main AS (SELECT * FROM turns WHERE role IN ('user', 'assistant')),
lines AS (SELECT log_path, line_no, max(event_ts) AS ts FROM log_messages WHERE event_ts IS NOT NULL GROUP BY ALL),
found AS (
  SELECT m.delivery_id, max_by(l.ts, l.line_no) AS ts
  FROM main m JOIN lines l ON l.log_path = m.log_path AND l.line_no < m.line_no
  WHERE m.event_ts IS NULL GROUP BY m.delivery_id),
timed AS (SELECT m.*, coalesce(m.event_ts, f.ts) AS happened FROM main m LEFT JOIN found f USING (delivery_id)),
flags AS (
  SELECT delivery_id,
    bool_or(block_type = 'text' AND regexp_matches(coalesce(block_text, ''), '[^\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]')) AS speaks,
    bool_or(block_type = 'tool_use') AS calls
  FROM log_blocks GROUP BY delivery_id),
numbered AS (
  SELECT t.*, row_number() OVER w AS turn_no,
    role = 'user' AND coalesce(speaks, false) AS prompt,
    role = 'assistant' AND coalesce(speaks, false) AND NOT coalesce(calls, false) AS reply
  FROM timed t LEFT JOIN flags f USING (delivery_id)
  WINDOW w AS (PARTITION BY session_id ORDER BY happened NULLS FIRST, line_no NULLS FIRST, delivery_id)),
acts AS (
  SELECT session_id, prompt, lead(reply) OVER (PARTITION BY session_id ORDER BY turn_no) AS answered
  FROM numbered WHERE prompt OR reply),
tools AS (
  SELECT n.session_id, n.turn_no, b.block_type, CASE WHEN block_type = 'tool_use' THEN block_id ELSE tool_use_id END AS tool
  FROM numbered n JOIN log_blocks b USING (delivery_id) WHERE block_type IN ('tool_use', 'tool_result')),
bad AS (
  SELECT session_id FROM numbered WHERE turn_no = 1 AND NOT prompt
  UNION SELECT session_id FROM acts WHERE prompt AND NOT coalesce(answered, false)
  UNION SELECT session_id FROM tools u WHERE block_type = 'tool_use' AND NOT EXISTS (
    SELECT 1 FROM tools r WHERE r.session_id = u.session_id AND r.tool = u.tool AND r.block_type = 'tool_result' AND r.turn_no > u.turn_no)
  UNION SELECT session_id FROM tools r WHERE block_type = 'tool_result' AND NOT EXISTS (
    SELECT 1 FROM tools u WHERE u.session_id = r.session_id AND r.tool = u.tool AND u.block_type = 'tool_use' AND u.turn_no < r.turn_no))
SELECT session_id, turn_no, message_id FROM numbered WHERE session_id NOT IN (SELECT session_id FROM bad)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _limit(field: str) -> str:
    cases = "".join(f" WHEN '{name}' THEN {getattr(layout, field)}" for name, layout in A.LAYOUTS.items())
    return f"CASE language{cases} ELSE {getattr(A.Layout(), field)} END"


def _listed(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


#: What a comment opened by a generator begins with, spelled out phrase by phrase.
_OPENINGS = [
    "code generated by", "code generated from", "@generated", "do not edit", "automatisch erzeugt", "automatisch generiert", "자동 생성된 파일", "자동생성된 파일", "generated by",
    *[f"{at}auto{sep}generated by" for at in ("", "@") for sep in ("", "-", " ")], *[f"<auto{sep}generated" for sep in ("", "-")],
    *[f"auto{sep}generated {what}" for sep in ("", "-", " ") for what in ("file", "code", "by", "from")],
    *[
        f"{this}{what} {verb} {how}" for this in ("this ", "") for what in ("file", "code", "class") for verb in ("was", "is", "has been")
        for how in ("generated", *(f"auto{more}{sep}generated" for more in ("", "matically") for sep in ("", "-", " ")), "created by a tool", "produced by a tool")
    ],
]
_WORD = "regexp_matches(np[-1], '^[0-9A-Za-z_]+$')"

#: Names and comments are taken apart into lists here, where the operator has patterns; the thresholds are its parameters.
P4_FOUND = f"""
WITH f AS (SELECT DISTINCT id AS file_id, coalesce(path, '') AS path, language, byte_size, line_count FROM files WHERE id IS NOT NULL),
h AS (SELECT file_id, arg_max(head_text, length(head_text)) AS head FROM file_heads GROUP BY file_id),
s AS (SELECT file_id, count(*) AS declared FROM symbols GROUP BY file_id),
r AS (
  SELECT f.*, coalesce(head, '') AS head, coalesce(declared, 0) AS declared, length(coalesce(head, '')) AS size, string_split(path, '/') AS parts, string_split(string_split(path, '/')[-1], '.') AS np,
    CASE WHEN line_count > 0 AND byte_size >= 0 THEN byte_size / line_count END AS line_bytes, trim(coalesce(head, '')) = '' AS headless, string_split(lower(coalesce(head, '')), chr(10)) AS lines
  FROM f LEFT JOIN h USING (file_id) LEFT JOIN s USING (file_id)),
n AS (
  SELECT *, array_to_string(CASE WHEN len(np) > 1 THEN np[:-2] ELSE np END, '.') AS stem, list_has_any(parts[:-3], {_listed(A.VENDOR_DIRS)}) AS vendored,
    list_has_any(parts[:-2], {_listed(A.OUTPUT_DIRS)}) OR contains('/' || path, '/target/codegen/')
      OR (len(np) > 2 AND {_WORD} AND np[-2] IN ('pb', 'g', 'gen', 'generated', 'freezed', 'designer')) OR (len(np) > 1 AND {_WORD} AND ends_with(np[-2], '_generated'))
      OR ends_with(path, '_pb2.py') OR ends_with(path, '_pb2.pyi') OR ends_with(path, '_pb2_grpc.py') OR ends_with(path, '_pb2_grpc.pyi') OR (ends_with(path, 'Grpc.java') AND path[-10] BETWEEN 'a' AND 'z') AS made,
    len(np) > 1 AND {_WORD} AND ((len(np) > 2 AND np[-2] IN ('min', 'bundle', 'chunk')) OR ends_with(np[-2], '-bundle') OR ends_with(np[-2], '-chunk')
      OR (len(np) > 2 AND length(np[-2]) >= 6 AND translate(np[-2], '0123456789abcdef', '') = '' AND np[-1] IN ('js', 'ts', 'css', 'mjs'))) AS bundled,
    list_transform(list_filter(lines, lambda x: regexp_matches(x, '^\\s*(//|#|--|/[*]|[*]|;|<!--)')), lambda x: regexp_replace(x, '^\\s*(//|#|--|/[*]+!?|[*]|;|<!--)\\s*', '')) AS comments,
    string_split(string_split(ltrim(lower(head), E' \\t\\n\\r'), chr(10))[1], '|') AS banner
  FROM r),
p AS (SELECT unnest(list_transform(list_filter(range(1, len(parts) - 1), lambda i: list_contains({_listed(A.VENDOR_DIRS)}, parts[i])), lambda i: CASE WHEN parts[i + 1] IN ('Checkouts', 'lib') AND len(parts) > i + 2 THEN parts[i + 2] ELSE parts[i + 1] END)[1:1]) AS stem FROM n WHERE vendored),
k AS (SELECT stem FROM p WHERE stem <> '' GROUP BY stem HAVING count(*) > 1),
l AS (
  SELECT *, stem IN (SELECT stem FROM k) AS packaged, list_max(list_transform(string_split(head, chr(10)), lambda x: length(x))) AS longest,
    len(list_filter(comments, lambda c: len(list_filter({_listed(_OPENINGS)}, lambda o: starts_with(c, o))) > 0 OR regexp_matches(c, '^produced by [^ ]+ [0-9.]+ *; *regenerate'))) > 0 AS opened,
    len(banner) > 1 AND regexp_matches(trim(banner[1]), '^(//|#|--|/[*]+!?|;)\\s*[0-9a-z_.-]+ v?[0-9]+([.][0-9]+)+$') AND starts_with(trim(banner[2]), '(c)') AND regexp_matches(array_to_string(banner[2:], '|'), 'licen[sc]e') AS released,
    len(list_filter(string_split(head, ''), lambda c: regexp_matches(c, '\\s'))) / greatest(size, 1) AS space,
    len(list_filter(string_split(head, ''), lambda c: regexp_matches(c, '[\\p{{L}}\\p{{N}}]'))) / greatest(size, 1) AS alnum,
    len(list_filter(regexp_extract_all(head, '[0-9A-Za-z_.]+'), lambda w: regexp_matches(w, '^(0x[0-9a-fA-F]+|[0-9]+([.][0-9]+)?)$'))) / greatest(size, 1) AS numbers,
    (length(head) - length(translate(head, ';{{}}', ''))) / greatest(size, 1) AS statements,
    coalesce(list_max(list_transform(regexp_extract_all(head, '([0-9a-fA-F]{{32,}}|[A-Za-z0-9+/]{{60,}})'), lambda x: length(x))), 0) AS run,
    coalesce(list_max(list_transform(regexp_extract_all(head, '\\S+'), lambda x: length(x))), 0) AS unbroken
  FROM n)
SELECT file_id FROM l
WHERE vendored OR made OR bundled OR opened OR released OR regexp_matches(parts[-1], '^[A-Za-z][0-9A-Za-z_.-]*-v?[0-9]+([.][0-9]+)+[.][0-9A-Za-z_]+$')
  OR (headless AND packaged) OR run > {_limit('encoded_run')} OR numbers > {_limit('numbers')}
  OR (alnum > {_limit('alphanumeric')} AND unbroken > {_limit('unbroken')})
  OR (longest > {_limit('longest_line')} AND space < {_limit('dense_whitespace')} AND statements > {_limit('statement_share')})
  OR coalesce(line_bytes > {_limit('mean_line')}, false)
  OR (declared = 0 AND headless AND (coalesce(byte_size >= {A.BARREN_BYTES}, false) OR coalesce(line_count >= {A.BARREN_LINES}, false)))
"""


P5_CHECKS = """
SELECT count(*) AS documents, count(*) FILTER (WHERE coalesce(text, '') = '') AS without_container, 0::BIGINT AS overfull, 0::BIGINT AS split, 0::BIGINT AS over_bound FROM documents
"""

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_ITEM_WORDS, _TEXT_WORDS = (
    f"regexp_extract_all(lower(nfc_normalize(translate(regexp_replace({column}, '\\p{{Cf}}', '', 'g'), {_quoted(_WIDE)}, {_quoted(_PLAIN)}))), '[\\p{{L}}\\p{{N}}]+')"
    for column in ("item_text", "text")
)
_RUNS = "list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))"

#: Of the compatibility form, DuckDB can do composition and full-width letters, which are those that the tables have.
P6_FOUND = f"""
WITH i AS (SELECT DISTINCT item_id, unnest({_RUNS}) AS run FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM eval_items WHERE item_text IS NOT NULL)),
d AS (SELECT doc_id, unnest({_RUNS}) AS run FROM (SELECT doc_id, {_TEXT_WORDS} AS w FROM documents WHERE text IS NOT NULL))
SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)
"""
