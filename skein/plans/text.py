"""Queries on text, names and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..registry import Registry, table
from .common import EXTENSION, FILES, STEM, STOPS, in_list, subwords_sql

registry = Registry()
query = registry.query


def once(df, key="id"):
    """Files written twice, once."""
    return df.dropDuplicates([key])


@query("subword_counts", f"SELECT word, count(*) AS n FROM (SELECT unnest({subwords_sql('name')}) AS word FROM symbols) GROUP BY word")
def subword_counts(spark, d):
    words = table(spark, d, "symbols").select(F.explode(T.subwords(F.col("name"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("query_terms", f"""
    SELECT item_id, array_to_string(list_filter(
      list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]),
      lambda w: true), ' ') AS terms
    FROM (SELECT item_id, list_filter({subwords_sql('item_text')}, lambda w: length(w) >= 2 AND w NOT IN {STOPS}) AS l FROM eval_items)""")
def query_terms(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.array_join(T.query_terms(F.col("item_text")), " ").alias("terms"))


_known = in_list([*T.LANGUAGES, *T.TEXT_EXTENSIONS])


@query("file_references", f"""
    SELECT reference, count(*) AS n FROM (
      SELECT unnest(regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_./-]+\\.[\\p{{L}}\\p{{N}}_-]+)', 1)) AS reference FROM documents)
    WHERE contains(reference, '/') OR lower(regexp_extract(reference, '\\.([^.]*)$', 1)) IN {_known} GROUP BY reference""")
def file_references(spark, d):
    refs = table(spark, d, "documents").select(F.explode(T.file_references(F.col("text"))).alias("reference"))
    return refs.groupBy("reference").agg(F.count(F.lit(1)).alias("n"))


_language = "CASE " + " ".join(f"WHEN {EXTENSION} = '{e}' THEN '{lang}'" for e, lang in T.LANGUAGES.items()) + " ELSE 'unknown' END"


@query("language_by_extension", f"SELECT language, detected, count(*) AS n FROM (SELECT language, {_language} AS detected FROM {FILES}) GROUP BY ALL")
def language_by_extension(spark, d):
    f = once(table(spark, d, "files")).select("language", T.language_of(F.col("path")).alias("detected"))
    return f.groupBy("language", "detected").agg(F.count(F.lit(1)).alias("n"))


@query("path_stems", f"SELECT stem, count(*) AS n FROM (SELECT {STEM} AS stem FROM {FILES}) GROUP BY stem")
def path_stems(spark, d):
    return once(table(spark, d, "files")).select(T.path_stem(F.col("path")).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query("module_stems", """
    SELECT stem, count(*) AS n FROM (
      SELECT lower(coalesce(list_filter(regexp_split_to_array(module, '[/.:]'), lambda p: p <> '')[-1], module)) AS stem FROM imports)
    GROUP BY stem""")
def module_stems(spark, d):
    return table(spark, d, "imports").select(T.module_stem(F.col("module")).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


_tokens = "CASE WHEN byte_size > 0 THEN ceil(byte_size / CASE WHEN coalesce(language, 'unknown') <> 'unknown' THEN 3.6::DOUBLE ELSE 4.0::DOUBLE END)::BIGINT ELSE 0 END"


@query("token_estimates", f"SELECT id, {_tokens} AS tokens FROM {FILES}")
def token_estimates(spark, d):
    return once(table(spark, d, "files")).select("id", T.estimated_tokens(F.col("byte_size"), F.col("language")).alias("tokens"))


@query("project_token_baseline", f"SELECT project, sum({_tokens})::BIGINT AS tokens, count(*) AS files FROM {FILES} GROUP BY project")
def project_token_baseline(spark, d):
    f = once(table(spark, d, "files"))
    return f.groupBy("project").agg(F.sum(T.estimated_tokens(F.col("byte_size"), F.col("language"))).alias("tokens"), F.count(F.lit(1)).alias("files"))


_abbreviated = """CASE WHEN v < 1000 THEN '~' || v WHEN v < 1000000 THEN '~' || printf('%.1f', v / 1e3) || 'K'
  WHEN v < 1000000000 THEN '~' || printf('%.1f', v / 1e6) || 'M' ELSE '~' || printf('%.1f', v / 1e9) || 'B' END"""
_compact = """CASE WHEN v IS NULL THEN '—' WHEN v >= 1e15 THEN replace(printf('%.1e', v::DOUBLE), 'e+', 'e') WHEN v >= 1e12 THEN printf('%.1f', v / 1e12) || 'T'
  WHEN v >= 1e9 THEN printf('%.1f', v / 1e9) || 'B' WHEN v >= 1e6 THEN printf('%.1f', v / 1e6) || 'M'
  WHEN v >= 1e3 THEN printf('%.1f', v / 1e3) || 'K' ELSE v::VARCHAR END"""


@query("number_labels", f"SELECT id, {_abbreviated} AS short, {_compact} AS dense FROM (SELECT id, byte_size * 1024 AS v FROM {FILES})")
def number_labels(spark, d):
    v = F.col("byte_size") * 1024
    return once(table(spark, d, "files")).select("id", T.abbreviated(v).alias("short"), T.compact(v).alias("dense"))


_dirs = in_list(P.IGNORED_DIRECTORIES)
_sensitive = f"""(regexp_matches(p, '(^|/){P.one_of(P.SENSITIVE_DIRECTORIES)}(/|$)') OR n IN {in_list(P.SENSITIVE_NAMES)} OR starts_with(n, '.env.')
  OR regexp_matches(n, '{P.one_of(P.SENSITIVE_SUFFIXES)}$')
  OR (regexp_matches(n, '{P.CONFIG_EXTENSION}') AND regexp_matches(n, '{P.SECRET_CONFIG}')))"""


@query("path_classes", f"""
    SELECT denied, hidden_name, sensitive, noise, test, count(*) AS n FROM (
      SELECT len(list_filter(string_split(path, '/')[:-2], lambda x: x IN {_dirs} OR (starts_with(x, '.') AND x <> '.' AND x <> '.github'))) > 0 AS denied,
        (sens OR name IN {in_list(P.IGNORED_NAMES)} OR regexp_matches(n, '{P.one_of(P.IGNORED_SUFFIXES)}$')) AS hidden_name,
        sens AS sensitive,
        (name IN {in_list(P.NOISE_NAMES)} OR regexp_matches(name, '{P.one_of(P.NOISE_SUFFIXES)}$') OR regexp_matches(path, '(^|/){P.one_of(P.NOISE_DIRECTORIES)}/')) AS noise,
        (regexp_matches(p, '(^|/){P.one_of(P.TEST_DIRECTORIES)}/') OR regexp_matches(n, '{P.TEST_NAME}')) AS test
      FROM (SELECT *, {_sensitive} AS sens FROM (
        SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, lower(path) AS p, lower(regexp_extract(path, '([^/]*)$', 1)) AS n
        FROM (SELECT path FROM {FILES} UNION ALL SELECT module || '/.env.' || file_id FROM imports UNION ALL SELECT module || '/secrets.json' FROM imports))))
    GROUP BY ALL""")
def path_classes(spark, d):
    paths = once(table(spark, d, "files")).select("path")
    imports = table(spark, d, "imports")
    paths = paths.unionByName(imports.select(F.concat("module", F.lit("/.env."), F.col("file_id").cast("string")).alias("path")))
    paths = paths.unionByName(imports.select(F.concat("module", F.lit("/secrets.json")).alias("path")))
    p = F.col("path")
    classes = paths.select(
        P.ignored_directory(p).alias("denied"), P.ignored_file(p).alias("hidden_name"), P.sensitive_path(p).alias("sensitive"),
        P.noise_path(p).alias("noise"), P.test_path(p).alias("test"),
    )
    return classes.groupBy(*classes.columns).agg(F.count(F.lit(1)).alias("n"))


@query("ignore_rules", f"""
    SELECT path, project, CASE WHEN list_contains(p[:-2], 'tests') OR (p[1] = 'src' AND list_contains(p[2:-2], 'render')) THEN true
      WHEN p[1] = 'src' AND p[2] = 'session' AND len(p) > 2 THEN len(p) > 3 OR NOT ends_with(path, '.py')
      WHEN p[1] = 'lib' AND len(p) = 3 AND contains(p[3], '_view.') THEN NOT starts_with(p[3], 'graph_')
      WHEN ends_with(path, '.min.js') THEN true WHEN p[1] = 'app' AND len(p) > 2 AND ends_with(path, '.go') THEN NOT starts_with(p[2], 'r') ELSE false END AS ignored
    FROM (SELECT path, project, string_split(path, '/') AS p FROM {FILES})""")
def ignore_rules(spark, d):
    """Rules of the root and of two directories: outer before inner ones, nothing back from a pruned directory, escapes."""
    rules = {
        "": ["# built files", "*.min.js", "tests/", "!tests/**/*_test.py", "\\#none", "app/**/*.go", "!app/r*/**", "lib/*/*_view.*   "],
        "src": ["render/", "/session/**", "!session/*.py"],
        "lib": ["!graph_*", "\\!none"],
    }
    return P.ignored_by_rules(once(table(spark, d, "files")).select("path", "project"), rules)


@query("rename_targets", f"""
    SELECT id, regexp_replace(old, '^[^{{]*\\{{[^{{}}]* => ([^{{}}]*)\\}}', project || '/\\1') AS target
    FROM (SELECT id, project, path, project || '/{{old => new}}/' || path AS old FROM {FILES})""")
def rename_targets(spark, d):
    f = once(table(spark, d, "files"))
    return f.select("id", P.rename_target(F.concat("project", F.lit("/{old => new}//"), "path")).alias("target"))


@query("marker_lines", """
    SELECT doc_id, line_no, line FROM (
      SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
    WHERE regexp_matches(line, '(^|[^\\p{L}\\p{N}_])(TODO|FIXME|HACK|XXX)([^\\p{L}\\p{N}_]|$)')""")
def marker_lines(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("TODO|FIXME|HACK|XXX"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.where(T.has_marker(F.col("line"))).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


@query("identifier_counts", "SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([\\p{L}\\p{N}_]+)', 1)) AS w FROM documents) GROUP BY doc_id")
def identifier_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.size(T.identifiers(F.col("text"))).cast("long").alias("n"))
    return docs.where("n > 0")


@query("remote_names", f"SELECT id, lower('code.example.org/' || project) AS remote FROM {FILES}")
def remote_names(spark, d):
    f = once(table(spark, d, "files"))
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("git@code.example.org:"), "project", F.lit(".git"))).otherwise(F.concat(F.lit("HTTPS://Code.Example.org//"), "project", F.lit(".git/")))
    return f.select("id", T.normalized_remote(url).alias("remote"))


_models = in_list(T.UNKNOWN_MODELS)


@query("labels_and_digests", f"""
    SELECT delivery_id, CASE WHEN model IS NULL OR lower(trim(model)) IN {_models} THEN '모델 미상' ELSE trim(model) END AS model,
      coalesce(nullif(substr(regexp_replace(cwd, '\\p{{Cc}}', '', 'g'), 1, 100), ''), 'no project') AS label,
      substr(sha256(log_path), 1, 12) AS digest, replace(regexp_extract(log_path, '^([^/]*)', 1), '-', '/') AS directory
    FROM log_messages""")
def labels_and_digests(spark, d):
    return table(spark, d, "log_messages").select(
        "delivery_id", T.model_name(F.col("model")).alias("model"), T.safe_label(F.col("cwd"), "no project").alias("label"),
        T.short_digest(F.col("log_path")).alias("digest"), T.decoded_directory(F.regexp_extract("log_path", "^([^/]*)", 1)).alias("directory"),
    )


@query("saturating_totals", """
    SELECT coalesce(lower(trim(model)), '') AS model, least(sum(greatest(input_tokens, 0)::HUGEINT * 1000000000000), 9223372036854775807)::BIGINT AS total,
      max(greatest(coalesce(input_tokens, 0), 0) + greatest(coalesce(output_tokens, 0), 0))::BIGINT AS largest
    FROM log_messages GROUP BY 1""")
def saturating_totals(spark, d):
    m = table(spark, d, "log_messages").withColumn("model", F.coalesce(F.lower(F.trim("model")), F.lit("")))
    wide = F.col("input_tokens").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)")
    pair = T.saturating_add(F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0)))
    return m.groupBy("model").agg(T.saturating_sum(wide).alias("total"), F.max(pair).alias("largest"))


@query("redacted_texts", """
    SELECT doc_id, replace(replace(body, 'conf/secrets.json:3', '[민감 파일]'), '.env.local', '[민감 파일]') AS body
    FROM (SELECT doc_id, 'see conf/secrets.json:3, then (.env.local) and ' || source AS body FROM documents WHERE source IS NOT NULL)""")
def redacted_texts(spark, d):
    docs = table(spark, d, "documents").where("source is not null")
    return docs.select("doc_id", P.redacted(F.concat(F.lit("see conf/secrets.json:3, then (.env.local) and "), "source")).alias("body"))


@query("human_ages", f"""
    SELECT id, CASE WHEN x >= 365 THEN (x // 365) || '년' WHEN x >= 30 THEN (x // 30) || '개월' WHEN x >= 1 THEN x || '일' ELSE '오늘' END AS age
    FROM (SELECT id, floor((1781000000 - modified_at) / 86400)::BIGINT AS x FROM {FILES})""")
def human_ages(spark, d):
    return once(table(spark, d, "files")).select("id", T.human_age(F.lit(1781000000) - F.col("modified_at")).alias("age"))


_korean = "CASE WHEN v >= {by} THEN CASE WHEN t % 10 = 0 THEN (t // 10)::VARCHAR ELSE (t // 10) || '.' || (t % 10) END || '{unit}' END"


@query("korean_counts", f"""
    SELECT id, coalesce({_korean.format(by=100000000, unit="억").replace("t ", "h ").replace("(t", "(h")}, {_korean.format(by=10000, unit="만")}, format('{{:,}}', v)) AS label
    FROM (SELECT id, v, round(v / 1e8 * 10)::BIGINT AS h, round(v / 1e4 * 10)::BIGINT AS t FROM (SELECT id, (byte_size * CASE WHEN id % 3 = 0 THEN 1000 WHEN id % 3 = 1 THEN 10 ELSE 1 END)::BIGINT AS v FROM {FILES} WHERE byte_size IS NOT NULL))""")
def korean_counts(spark, d):
    f = once(table(spark, d, "files")).where("byte_size is not null")
    v = (F.col("byte_size") * F.when(F.col("id") % 3 == 0, 1000).when(F.col("id") % 3 == 1, 10).otherwise(1)).cast("long")
    return f.select("id", T.korean_count(v).alias("label"))
