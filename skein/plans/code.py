"""Queries on sources: declarations, index changes, debt, slices, bundles, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import debt as B
from ..operators import index as X
from ..operators import refine as Q
from ..registry import Registry, table
from .common import FILES, STOPS, in_list, subwords_sql
from .text import _sensitive, once

registry = Registry()
query = registry.query


def heads(spark, d):
    files = once(table(spark, d, "files")).select(F.col("id").alias("file_id"), "language")
    return once(table(spark, d, "file_heads").where("head_text is not null"), "file_id").join(files, "file_id").select("file_id", "language", F.col("head_text").alias("text"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _rule_sql() -> str:
    cases = []
    for language, rules in X.RULES.items():
        for kind, pattern in rules:
            guard = f" AND NOT regexp_matches(line, {_sql(X.C_CONTROL)})" if pattern == X.C_FUNCTION else ""
            cases.append(f"WHEN language = '{language}' AND regexp_matches(line, {_sql(pattern)}){guard} THEN struct_pack(kind := '{kind}', name := regexp_extract(line, {_sql(pattern)}, 1))")
    return "CASE " + " ".join(cases) + " END"


@query("first_rule_extract", f"""
    SELECT file_id, line_no AS line, r.kind AS kind, r.name AS name FROM (
      SELECT file_id, line_no, {_rule_sql()} AS r FROM (
        SELECT h.file_id, f.language, unnest(string_split(head_text, chr(10))) AS line, unnest(range(1, len(string_split(head_text, chr(10))) + 1))::INTEGER AS line_no
        FROM (SELECT DISTINCT * FROM file_heads WHERE head_text IS NOT NULL) h JOIN {FILES} f ON f.id = h.file_id)) WHERE r IS NOT NULL""")
def first_rule_extract(spark, d):
    return X.declarations(heads(spark, d))


_old = f"(SELECT path || '@' || project AS path, byte_size, modified_at, CASE WHEN id % 5 = 0 THEN 'x' ELSE content_hash END AS content_hash FROM {FILES} WHERE id % 7 <> 0)"
_new = f"(SELECT path || '@' || project AS path, byte_size, modified_at + (id % 3 = 0)::INT AS modified_at, content_hash FROM {FILES} WHERE id % 11 <> 0)"


def _scans(spark, d):
    f = once(table(spark, d, "files")).withColumn("path", F.concat("path", F.lit("@"), "project"))
    old = f.where("id % 7 <> 0").withColumn("content_hash", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("content_hash")))
    new = f.where("id % 11 <> 0").withColumn("modified_at", F.col("modified_at") + (F.col("id") % 3 == 0).cast("int"))
    return new, old


@query("index_merge", f"""
    SELECT status, count(*) AS n FROM (
      SELECT CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted'
        WHEN n.byte_size IS NOT DISTINCT FROM o.byte_size AND n.modified_at IS NOT DISTINCT FROM o.modified_at THEN 'unchanged'
        WHEN n.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'touched' ELSE 'changed' END AS status
      FROM {_new} n FULL JOIN {_old} o ON n.path = o.path) GROUP BY status""")
def index_merge(spark, d):
    return X.change_status(*_scans(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("index_after_scan", f"SELECT count(*) AS files, count(*) FILTER (WHERE n.path IN (SELECT path FROM {_old})) AS kept_ids, count(DISTINCT n.path) AS ids FROM {_new} n")
def index_after_scan(spark, d):
    new, old = _scans(spark, d)
    merged = X.merged_index(new, old)
    top = old.agg(F.max("id")).scalar()
    return merged.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("id") <= top).alias("kept_ids"), F.count_distinct("id").alias("ids"))


@query("deleted_cascade", f"SELECT kind, count(*) AS n FROM symbols WHERE file_id NOT IN (SELECT id FROM {FILES} WHERE id % 7 = 0) GROUP BY kind")
def deleted_cascade(spark, d):
    gone = once(table(spark, d, "files")).where("id % 7 = 0").select("id")
    return X.without_deleted(table(spark, d, "symbols"), gone).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("index_statistics", f"SELECT coalesce(language, 'unknown') AS language, count(*) AS files FROM {FILES} GROUP BY 1")
def index_statistics(spark, d):
    return X.index_statistics(once(table(spark, d, "files")))


@query("top_symbols", "SELECT name, count(*) AS n FROM symbols GROUP BY name ORDER BY n DESC, name LIMIT 2000")
def top_symbols(spark, d):
    return X.top_symbols(table(spark, d, "symbols"))


@query("symbols_of_file_names", f"SELECT path, line, name, kind FROM symbols JOIN (SELECT id, path FROM {FILES} WHERE path LIKE '%session%') f ON f.id = file_id")
def symbols_of_file_names(spark, d):
    """The join of symbols to the files asked for, by a condition instead of a fixed list of paths."""
    chosen = once(table(spark, d, "files")).where("path like '%session%'").select(F.col("id").alias("file_id"), "path")
    return table(spark, d, "symbols").join(chosen, "file_id").select("path", "line", "name", "kind")


_code = f"(SELECT doc_id, regexp_replace(text, {_sql(B.SLASH_CODE)}, '', 'g') AS code FROM documents WHERE text IS NOT NULL)"


@query("code_only_lengths", f"SELECT doc_id, length(code)::BIGINT AS n FROM {_code}")
def code_only_lengths(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.char_length(B.code_only(F.col("text"), F.lit("java"))).cast("long").alias("n"))


_branch = in_list(["if", "for", "while", "case", "catch", "guard", "elif", "except", "rescue", "when"])


@query("branch_counts", f"""
    SELECT doc_id, (len(list_filter(regexp_extract_all(code, '[\\p{{L}}_]+'), lambda w: w IN {_branch})) + len(regexp_extract_all(code, '(&&|\\|\\|| \\? )')))::BIGINT AS n FROM {_code}""")
def branch_counts(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", B.branch_count(B.code_only(F.col("text"), F.lit("java"))).alias("n"))


@query("duplicate_groups", f"""
    WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(code, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM {_code}),
    g AS (SELECT doc_id, len(lines) AS size, replace(array_to_string(lines[2:], chr(10)), ' ', '') AS rest FROM b WHERE len(lines) >= 5),
    h AS (SELECT doc_id, size, sha256(size || ':' || rest) AS digest FROM g WHERE length(rest) >= 40)
    SELECT digest, count(*) AS copies, min(doc_id) AS doc_id, (arg_min(size, doc_id) * (count(*) - 1))::BIGINT AS severity FROM h GROUP BY digest HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    code = docs.select("doc_id", B.code_only(F.col("text"), F.lit("java")).alias("code"))
    lines = F.size(B.body_lines(F.col("code")))
    bodies = code.select("doc_id", B.body_digest(F.col("code")).alias("digest"), lines.alias("lines"))
    return B.duplicate_groups(bodies, digest="digest", order=["doc_id"], lines="lines")


_test = """(regexp_matches(lower(path), '(^|/)(tests|test|spec|__tests__|testing)/') OR regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '(^test_|tests?\\.swift$|_test\\.(py|go|rb)$|_spec\\.rb$|\\.(test|spec)\\.(js|ts|jsx|tsx)$)'))"""


@query("untested_antijoin", f"""
    WITH f AS (SELECT id, project, path, {_test} AS test FROM {FILES}),
    d AS (SELECT DISTINCT id, project, name FROM symbols JOIN f ON f.id = file_id WHERE NOT test AND regexp_matches(path, '^(src|lib|core)/')),
    m AS (SELECT DISTINCT project, name FROM symbols JOIN f ON f.id = file_id WHERE test)
    SELECT DISTINCT id FROM d WHERE id NOT IN (SELECT id FROM d JOIN m USING (project, name))""")
def untested_antijoin(spark, d):
    from ..functions.paths import test_path

    files, symbols = once(table(spark, d, "files")), table(spark, d, "symbols")
    tests = files.where(test_path(F.col("path"))).select(F.col("id").alias("file_id"), "project")
    return B.untested_files(files, symbols, symbols.join(tests, "file_id").select("project", "name"), roots=["src", "lib", "core"])


@query("stale_markers", rf"""
    SELECT id::VARCHAR AS path, line_no AS line, age AS age_days FROM (
      SELECT id, line_no, floor((1781000000 - modified_at) / 86400)::BIGINT AS age, line FROM (
        SELECT id, modified_at, unnest(string_split(head_text, chr(10))) AS line, unnest(range(1, len(string_split(head_text, chr(10))) + 1)) AS line_no FROM (SELECT DISTINCT * FROM file_heads WHERE head_text IS NOT NULL) JOIN {FILES} ON id = file_id)
      WHERE regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_])(TODO|FIXME|HACK|XXX)([^\p{{L}}\p{{N}}_]|$)')) WHERE age >= 90""")
def stale_markers(spark, d):
    """Marker lines of the beginnings of all files; a file's time stands for that of each of its lines."""
    times = once(table(spark, d, "files")).select(F.col("id").alias("file_id"), F.col("modified_at").alias("author_time"))
    lines = heads(spark, d).join(times, "file_id").select(F.col("file_id").cast("string").alias("path"), "author_time", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    marked = lines.where(T.has_marker(F.col("text"))).withColumn("line", (F.col("at") + 1).cast("long"))
    return B.stale_markers(marked.select("path", "line"), marked.select("path", "line", "author_time"), now=F.lit(1781000000.0))


@query("debt_by_severity", f"""
    SELECT kind, id, severity, row_number() OVER (PARTITION BY kind ORDER BY severity DESC NULLS LAST, path, id)::INTEGER AS place
    FROM (SELECT coalesce(language, '?') AS kind, id, path, line_count AS severity FROM {FILES})""")
def debt_by_severity(spark, d):
    """Files as items, their language as the kind and their length as the severity."""
    files = once(table(spark, d, "files")).select(F.coalesce("language", F.lit("?")).alias("kind"), "id", "path", F.col("line_count").alias("severity"))
    return B.by_severity(files, order=["path", "id"]).select("kind", "id", "severity", "place")


@query("index_counts", f"SELECT 'files' AS kind, count(*) AS n FROM {FILES} UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'imports', count(*) FROM imports")
def index_counts(spark, d):
    return X.index_counts(once(table(spark, d, "files")), table(spark, d, "symbols"), table(spark, d, "imports"))


@query("symbols_of_paths", f"""
    SELECT path, line, name, kind FROM symbols JOIN (SELECT id, path FROM {FILES} WHERE path IN (SELECT min(path) FROM {FILES} GROUP BY project)) f ON f.id = file_id""")
def symbols_of_paths(spark, d):
    """Symbols of the first file of each project, asked for by path."""
    files = once(table(spark, d, "files"))
    paths = [r["path"] for r in files.groupBy("project").agg(F.min("path").alias("path")).collect()]  # as a request names them
    return X.symbols_of_paths(files, table(spark, d, "symbols"), paths)


@query("counts_by_kind", f"""
    SELECT k.kind, coalesce(n, 0) AS n FROM (SELECT unnest(['todo', 'complexity', 'duplicate', 'untested']) AS kind) k
    LEFT JOIN (SELECT CASE language WHEN 'python' THEN 'todo' WHEN 'swift' THEN 'untested' WHEN 'go' THEN 'duplicate' END AS kind, count(*) AS n FROM {FILES} GROUP BY 1) c USING (kind)""")
def counts_by_kind(spark, d):
    language = F.col("language")
    kind = F.when(language == "python", "todo").when(language == "swift", "untested").when(language == "go", "duplicate")
    return B.counts_by_kind(once(table(spark, d, "files")).select(kind.alias("kind")))


@query("signature_outline", f"""
    WITH c AS (SELECT id, path FROM {FILES} ORDER BY path, id LIMIT 5), s AS (SELECT DISTINCT file_id, line, name FROM symbols)
    SELECT path, line, name FROM (SELECT path, line, name, row_number() OVER (PARTITION BY path ORDER BY line NULLS FIRST, name) AS place FROM s JOIN c ON c.id = s.file_id) WHERE place <= 12""")
def signature_outline(spark, d):
    return B.outline(once(table(spark, d, "files")).orderBy("path", "id").limit(5), table(spark, d, "symbols"))


def texts(spark, d):
    """Documents as sources; they carry no programming language and are read as Python."""
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("file_id"), F.lit("python").alias("language"), "text")


def _blocks(sources, declared):
    lines = declared.where("kind <> 'import'").groupBy("file_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return B.block_ends(sources.join(lines, "file_id"))


def _sliced(sources):
    declared = X.declarations(sources)
    return C.sliced_files(sources, declared.join(_blocks(sources, declared), ["file_id", "line"], "left"), ["session", "cache"])


@query("block_ends", f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS n FROM documents WHERE text IS NOT NULL),
    i AS (SELECT *, regexp_extract(line, '^[ \\t]*') AS lead, regexp_matches(line, '[^\\s\\x1c-\\x1f\\x0b\\x{{0085}}\\x{{00a0}}\\p{{Z}}]') AS shown, 'python' AS language FROM l),
    k AS (SELECT *, length(lead) + 3 * (length(lead) - length(replace(lead, chr(9), ''))) AS deep, {_rule_sql()} AS r FROM i),
    d AS (SELECT doc_id, n, deep FROM k WHERE r IS NOT NULL AND r.kind <> 'import'),
    s AS (SELECT d.doc_id, d.n, min(x.n) AS stop FROM d LEFT JOIN k x ON x.doc_id = d.doc_id AND x.n > d.n AND x.shown AND x.deep <= d.deep GROUP BY ALL)
    SELECT s.doc_id AS file_id, s.n AS line, greatest(s.n, coalesce(max(x.n), 0)) AS end_line FROM s LEFT JOIN k x ON x.doc_id = s.doc_id AND x.shown AND x.n > s.n AND x.n < coalesce(s.stop, 2147483647) GROUP BY s.doc_id, s.n""")
def block_ends(spark, d):
    """Blocks of the code in documents, read as Python."""
    docs = texts(spark, d)
    return _blocks(docs, X.declarations(docs))


@query("block_ends_heads")
def block_ends_heads(spark, d):
    """Blocks of the beginnings of files, each in its own language."""
    sources = heads(spark, d)
    return _blocks(sources, X.declarations(sources))


@query("sliced_documents")
def sliced_documents(spark, d):
    """Documents, sliced around declarations that match a request or whole; checked in the tests."""
    return _sliced(texts(spark, d))


@query("sliced_heads")
def sliced_heads(spark, d):
    """Beginnings of files, as ``sliced_documents`` but each in its own language."""
    return _sliced(heads(spark, d))


@query("unsent_bodies", f"""
    WITH b AS (SELECT project, path, content_hash AS digest, modified_at AS tick, id FROM {FILES})
    SELECT id FROM b WHERE NOT (id % 2 = 0 AND (1775000000 - tick) BETWEEN 0 AND 20000000)""")
def unsent_bodies(spark, d):
    f = once(table(spark, d, "files"))
    bodies = f.select("id", "project", "path", F.col("content_hash").alias("digest"))
    delivered = f.where("id % 2 = 0").select("project", "path", F.col("content_hash").alias("digest"), F.col("modified_at").alias("at"))
    return C.unsent(bodies, delivered, now=F.lit(1775000000), ttl=20_000_000).select("id")


@query("recorded_deliveries", "SELECT slice_id, count(*) AS n FROM (SELECT slice_id, kept_lines AS selected, total_lines AS full_ FROM slices) WHERE full_ > selected GROUP BY slice_id")
def recorded_deliveries(spark, d):
    rows = table(spark, d, "slices").select("slice_id", F.col("kept_lines").alias("selected"), F.col("total_lines").alias("full"))
    return C.recorded_deliveries(rows).groupBy("slice_id").agg(F.count(F.lit(1)).alias("n"))


@query("context_bundles", """
    WITH RECURSIVE e AS (SELECT project, doc_id, '## ' || doc_id || chr(10) || CASE WHEN doc_id % 4 = 0 AND length(text) > 11 THEN '(unchanged)' ELSE text END AS piece FROM (
        SELECT split_part(source, '/', 1) AS project, doc_id, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)),
    r AS (SELECT *, ceil(length(piece) / 4.0::DOUBLE)::BIGINT AS size, row_number() OVER (PARTITION BY project ORDER BY doc_id) AS place FROM e),
    fold AS (
      SELECT project, place, size, size <= 2000 AS included, CASE WHEN size <= 2000 THEN size ELSE 0 END AS used FROM r WHERE place = 1
      UNION ALL SELECT r.project, r.place, r.size, used + r.size <= 2000, CASE WHEN used + r.size <= 2000 THEN used + r.size ELSE used END
      FROM fold JOIN r ON r.project = fold.project AND r.place = fold.place + 1)
    SELECT project AS request_id, sum(fold.size)::BIGINT AS tokens, md5(string_agg(piece, chr(10) || chr(10) ORDER BY fold.place)) AS digest FROM fold JOIN r USING (project, place) WHERE included GROUP BY project""")
def context_bundles(spark, d):
    docs = table(spark, d, "documents").where("source is not null and text is not null")
    entries = docs.select(
        F.split_part("source", F.lit("/"), F.lit(1)).alias("request_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"),
        F.concat(F.lit("## "), F.col("doc_id").cast("string")).alias("heading"), F.col("text").alias("body"), (F.col("doc_id") % 4 == 0).alias("sent"),
    )
    return C.bundled(entries, 2000).select("request_id", "tokens", F.md5("bundle").alias("digest"))


_vocabulary = f"(SELECT DISTINCT word FROM (SELECT unnest({subwords_sql('name')}) AS word FROM symbols) WHERE length(word) >= 3)"


def vocabulary(spark, d):
    words = table(spark, d, "symbols").select(F.explode(T.subwords(F.col("name"))).alias("word")).distinct()
    return words.where("char_length(word) >= 3")


_typos = "(SELECT DISTINCT substr(word, 1, 2) || substr(word, 4) AS term FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part UNION SELECT word FROM " + _vocabulary + "))"


@query("typo_correct", f"""
    WITH t AS (SELECT term FROM {_typos} WHERE length(term) >= 3 AND term NOT IN (SELECT word FROM {_vocabulary})),
    p AS (SELECT term, word, levenshtein(term, word) AS d FROM t, {_vocabulary} WHERE levenshtein(term, word) BETWEEN 1 AND CASE WHEN length(term) >= 6 THEN 2 ELSE 1 END),
    b AS (SELECT * FROM p QUALIFY d = min(d) OVER (PARTITION BY term))
    SELECT term, min(word) AS fix FROM b GROUP BY term HAVING count(*) = 1""")
def typo_correct(spark, d):
    vocab = vocabulary(spark, d)
    names = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).unionByName(vocab).distinct()
    terms = names.select(F.concat(F.substring("word", 1, 2), F.expr("substring(word, 4)")).alias("term"))
    return Q.corrections(terms, vocab)


_tables = "(VALUES " + ", ".join(f"('{k}', [{', '.join(chr(39) + w + chr(39) for w in words)}])" for k, words in Q.DICTIONARY.items()) + ")"
_tries = "[{'p': 0, 'k': term}, " + ", ".join(f"CASE WHEN ends_with(term, '{p}') AND length(term) > {len(p)} THEN {{'p': {i}, 'k': left(term, length(term) - {len(p)})}} END" for i, p in enumerate(Q.PARTICLES, 1)) + "]"
_requests = "(SELECT item_id, item_text AS text FROM eval_items UNION ALL SELECT -1 - doc_id, text FROM documents WHERE channel = 'issues')"


@query("refined_requests", f"""
    WITH q AS (SELECT item_id, unnest(l) AS term, unnest(range(1, len(l) + 1)) AS place FROM (SELECT item_id, list_filter({subwords_sql('text')}, lambda w: length(w) >= 2 AND w NOT IN {STOPS}) AS l FROM {_requests})),
    u AS (SELECT DISTINCT term FROM q), k AS (SELECT term, unnest({_tries}) AS c FROM u),
    m AS (SELECT term, arg_min(words, c.p) AS words FROM k JOIN {_tables} d(key, words) ON d.key = c.k GROUP BY term),
    t AS (SELECT term FROM u WHERE length(term) >= 3 AND term NOT IN (SELECT term FROM m) AND term NOT IN (SELECT word FROM {_vocabulary})),
    p AS (SELECT term, word, levenshtein(term, word) AS d FROM t, {_vocabulary} WHERE abs(length(term) - length(word)) <= 2 AND levenshtein(term, word) BETWEEN 1 AND CASE WHEN length(term) >= 6 THEN 2 ELSE 1 END),
    b AS (SELECT * FROM p QUALIFY d = min(d) OVER (PARTITION BY term)), f AS (SELECT term, min(word) AS fix FROM b GROUP BY term HAVING count(*) = 1),
    w AS (SELECT item_id, place, CASE WHEN words IS NULL THEN [coalesce(fix, q.term)] WHEN regexp_matches(q.term, '[^\\x00-\\x7F]') THEN words ELSE list_append(words, q.term) END AS ws FROM q LEFT JOIN m ON m.term = q.term LEFT JOIN f ON f.term = q.term),
    e AS (SELECT item_id, place, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS sub FROM w), o AS (SELECT item_id, word, min(place * 1000 + sub) AS place FROM e GROUP BY ALL)
    SELECT item_id AS request_id, string_agg(word, ' ' ORDER BY place) AS terms FROM o GROUP BY item_id""")
def refined_requests(spark, d):
    """Evaluation items and all issue texts as requests: terms expanded by the dictionary, corrected or kept."""
    issues = table(spark, d, "documents").where("channel = 'issues'").select((-1 - F.col("doc_id")).alias("request_id"), "text")
    requests = table(spark, d, "eval_items").select(F.col("item_id").alias("request_id"), F.col("item_text").alias("text")).unionByName(issues)
    return Q.refined_terms(requests, vocabulary(spark, d)).select("request_id", F.array_join("terms", " ").alias("terms"))


@query("redacted_documents", rf"""
    WITH w AS (SELECT doc_id, length(text) AS size, unnest(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f"''<>`,;()\[\]{{}}=]+')) AS word FROM (SELECT doc_id, text || ' see conf/.env.local:3, {{keys\\id_rsa}} and env.md' AS text FROM documents)),
    p AS (SELECT *, lower(regexp_extract(replace(split_part(word, ':', 1), chr(92), '/'), '([^/]*)$', 1)) AS n, lower(replace(split_part(word, ':', 1), chr(92), '/')) AS p FROM w)
    SELECT doc_id, count(*) AS hidden, (any_value(size) - sum(length(word)) + 7 * count(*))::BIGINT AS size FROM p WHERE {_sensitive} GROUP BY doc_id""")
def redacted_documents(spark, d):
    """How many names each text loses to redaction, and how long it is then; two are added to every text."""
    from ..functions import paths as P

    docs = table(spark, d, "documents").withColumn("text", F.concat("text", F.lit(" see conf/.env.local:3, {keys\\id_rsa} and env.md")))
    docs = docs.withColumn("shown", P.redacted(F.col("text")))
    hidden = F.regexp_count("shown", F.lit(P.REDACTED.replace("[", "\\[").replace("]", "\\]"))) - F.regexp_count("text", F.lit(P.REDACTED.replace("[", "\\[").replace("]", "\\]")))
    return docs.select("doc_id", hidden.cast("long").alias("hidden"), F.char_length("shown").cast("long").alias("size")).where("hidden > 0")
