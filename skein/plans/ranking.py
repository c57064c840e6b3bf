"""Queries on ranking, graph expansion and budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as R
from ..registry import Registry, table
from .common import FILES, STEM, subwords_sql
from .text import once

registry = Registry()
query = registry.query
REQUEST, TERMS, BUDGET = "fix the session cache reader", "['session', 'cache', 'reader']", 8000

_words = f"""words AS (
  SELECT project, id, unnest({subwords_sql('path')}) AS word, 'path' AS place FROM f
  UNION ALL SELECT project, id, unnest({subwords_sql(STEM)}), 'stem' FROM f
  UNION ALL SELECT project, id, unnest({subwords_sql('name')}), 'symbol' FROM symbols JOIN f ON f.id = file_id
  UNION ALL SELECT project, id, unnest({subwords_sql('module')}), 'import' FROM imports JOIN f ON f.id = file_id)"""
_idf = "least(2.6, greatest(0.12, (1 + 0.4 * log2((n + 1)::DOUBLE / (df + 1))) * greatest(0.12, 1 - (df::DOUBLE / n) * 1.8)))"
_lexical = f"""f AS (SELECT * FROM {FILES}), {_words},
hits AS (
  SELECT project, id, term, max(CASE WHEN place = 'symbol' AND word = term THEN 5.0 WHEN place = 'symbol' THEN 3.0 WHEN place = 'stem' THEN 3.0 WHEN place = 'path' THEN 2.0 ELSE 1.0 END)::DOUBLE AS best,
    max((word = term AND place <> 'import')::INT) AS counts
  FROM words, (SELECT unnest({TERMS}) AS term) WHERE word = term OR (place = 'symbol' AND length(term) >= 3 AND contains(word, term)) GROUP BY ALL),
sizes AS (SELECT project, count(DISTINCT id) AS n FROM f GROUP BY project),
weights AS (SELECT project, term, {_idf} AS idf FROM (SELECT project, term, sum(counts) AS df FROM hits GROUP BY ALL) JOIN sizes USING (project)),
lexical AS (SELECT project, id, sum(best * idf) * (1 + 0.2 * (count(*) - 1)) AS score, count(*) AS matched FROM hits JOIN weights USING (project, term) GROUP BY ALL)"""
_edges = f"""calls AS (
  SELECT DISTINCT project, id AS src, lower(coalesce(list_filter(regexp_split_to_array(module, '[/.:]'), lambda p: p <> '')[-1], module)) AS stem FROM imports JOIN f ON f.id = file_id),
stems AS (SELECT project, id AS dst, lower({STEM}) AS stem FROM f),
half AS (SELECT project, src, dst FROM calls JOIN stems USING (project, stem) WHERE src <> dst),
edges AS (SELECT project, src, dst FROM half UNION SELECT project, dst, src FROM half)"""
_ranked = f"""WITH RECURSIVE {_lexical}, {_edges},
hop1 AS (SELECT DISTINCT project, id AS seed, dst AS id FROM lexical JOIN edges USING (project) WHERE src = lexical.id),
hop2 AS (SELECT DISTINCT project, seed, dst AS id FROM hop1 JOIN edges USING (project) WHERE src = hop1.id AND dst <> seed
  EXCEPT SELECT * FROM hop1),
spread AS (
  SELECT project, id, score FROM lexical
  UNION ALL SELECT h.project, h.id, score * 0.4 FROM hop1 h JOIN lexical l ON l.project = h.project AND l.id = h.seed
  UNION ALL SELECT h.project, h.id, score * 0.16 FROM hop2 h JOIN lexical l ON l.project = h.project AND l.id = h.seed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, tokens, path) AS place FROM (
    SELECT project, id, path, round(sum(score) * 100) / 100 AS score,
      CASE WHEN byte_size > 0 THEN ceil(byte_size / CASE WHEN coalesce(language, 'unknown') <> 'unknown' THEN 3.6::DOUBLE ELSE 4.0::DOUBLE END)::BIGINT ELSE 0 END AS tokens
    FROM spread JOIN f USING (project, id) GROUP BY project, id, path, language, byte_size)),
fold AS (
  SELECT project, place, tokens <= {BUDGET} AS included, CASE WHEN tokens <= {BUDGET} THEN tokens ELSE 0 END AS used FROM ranked WHERE place = 1
  UNION ALL SELECT r.project, r.place, used + r.tokens <= {BUDGET}, CASE WHEN used + r.tokens <= {BUDGET} THEN used + r.tokens ELSE used END
  FROM fold JOIN ranked r ON r.project = fold.project AND r.place = fold.place + 1)"""


def _inputs(spark, d):
    files = once(table(spark, d, "files"))
    return files, table(spark, d, "symbols"), table(spark, d, "imports")


def _rank(spark, d):
    return R.rank_files(*_inputs(spark, d), REQUEST, BUDGET)


@query("term_rarity", f"""
    SELECT word, df, round({_idf} * 1e6)::BIGINT AS idf_millionths FROM (
      SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({subwords_sql('text')}) AS word FROM documents) GROUP BY word),
      (SELECT count(*) AS n FROM documents)""")
def term_rarity(spark, d):
    docs = table(spark, d, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(T.subwords(F.col("text")))).alias("word"))
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    return df.select("word", "df", F.round(R.idf(F.col("df"), n) * 1e6).cast("long").alias("idf_millionths"))


@query("lexical_scores", f"WITH {_lexical} SELECT id, round(score * 1e4)::BIGINT AS score, matched FROM lexical")
def lexical_scores(spark, d):
    terms, _ = R.plan_terms(spark, REQUEST)
    return R.lexical_scores(*_inputs(spark, d), terms).select("id", F.round(F.col("score") * 1e4).cast("long").alias("score"), "matched")


@query("import_edges", f"WITH f AS (SELECT * FROM {FILES}), {_edges} SELECT src, dst FROM edges")
def import_edges(spark, d):
    files, _, imports = _inputs(spark, d)
    return R.import_edges(files, imports).select("src", "dst")


@query("graph_two_hops", f"""WITH f AS (SELECT * FROM {FILES}), {_edges},
    one AS (SELECT DISTINCT src AS seed, dst AS id FROM edges WHERE src % 100 = 0),
    two AS (SELECT DISTINCT seed, dst AS id FROM one JOIN edges ON src = one.id WHERE dst <> seed EXCEPT SELECT * FROM one)
    SELECT id, round(sum(w) * 1e4)::BIGINT AS score FROM (
      SELECT DISTINCT id, id AS seed, 1.0::DOUBLE AS w FROM f WHERE id % 100 = 0 UNION ALL SELECT id, seed, 0.4 FROM one UNION ALL SELECT id, seed, 0.16 FROM two) GROUP BY id""")
def graph_two_hops(spark, d):
    """Reach of the files whose id is divisible by 100, as queries against all edges."""
    files, _, imports = _inputs(spark, d)
    seeds = files.where("id % 100 = 0").select("project", "id", F.lit(1.0).alias("score"))
    reached = R.expand_scores(seeds, R.import_edges(files, imports))
    return reached.select("id", F.round(F.col("score") * 1e4).cast("long").alias("score"))


@query("graph_request_hops", f"""WITH {_lexical}, {_edges},
    one AS (SELECT DISTINCT project, lexical.id AS seed, dst AS id FROM lexical JOIN edges USING (project) WHERE src = lexical.id),
    two AS (SELECT DISTINCT project, seed, dst AS id FROM one JOIN edges USING (project) WHERE src = one.id AND dst <> seed EXCEPT SELECT * FROM one)
    SELECT id, round(sum(w) * 1e4)::BIGINT AS score FROM (
      SELECT id, 1.0::DOUBLE AS w FROM lexical UNION ALL SELECT id, 0.4 FROM one UNION ALL SELECT id, 0.16 FROM two) GROUP BY id""")
def graph_request_hops(spark, d):
    """Reach of all lexical hits of the request over all edges, every hit weighing 1."""
    files, symbols, imports = _inputs(spark, d)
    terms, _ = R.plan_terms(spark, REQUEST)
    seeds = R.lexical_scores(files, symbols, imports, terms).select("project", "id", F.lit(1.0).alias("score"))
    reached = R.expand_scores(seeds, R.import_edges(files, imports))
    return reached.select("id", F.round(F.col("score") * 1e4).cast("long").alias("score"))


@query("graph_suppliers_2hop", """
    WITH half AS (SELECT DISTINCT l_suppkey AS a, -l_partkey - 1 AS b FROM lineitem),
    edges AS (SELECT a AS src, b AS dst FROM half UNION ALL SELECT b, a FROM half),
    seeds AS (SELECT DISTINCT a AS seed FROM half JOIN supplier ON s_suppkey = a JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_15'),
    one AS (SELECT seed, dst AS id FROM edges JOIN seeds ON src = seed),
    two AS (SELECT DISTINCT seed, dst AS id FROM one JOIN edges ON src = one.id WHERE dst <> seed EXCEPT SELECT * FROM one)
    SELECT id, round(sum(w) * 1e4)::BIGINT AS score FROM (
      SELECT seed AS id, 1.0::DOUBLE AS w FROM seeds UNION ALL SELECT id, 0.4 FROM one UNION ALL SELECT id, 0.16 FROM two) GROUP BY id""")
def graph_suppliers_2hop(spark, d):
    """Reach of all suppliers of a nation over all supplier and part links; keys start at 0, so part p is -p - 1."""
    half = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst")).distinct()
    edges = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("project", F.lit("all"))
    nation = table(spark, d, "nation").where("n_name = 'NATION_15'")
    chosen = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("src"))
    seeds = half.select("src").distinct().join(chosen, "src").select(F.lit("all").alias("project"), F.col("src").alias("id"), F.lit(1.0).alias("score"))
    return R.expand_scores(seeds, edges).select("id", F.round(F.col("score") * 1e4).cast("long").alias("score"))


@query("ranked_context", f"{_ranked} SELECT r.project, r.path, round(score * 100)::BIGINT AS hundredths, tokens, coalesce(included, false) AS included FROM ranked r LEFT JOIN fold USING (project, place)")
def ranked_context(spark, d):
    return _rank(spark, d).select("project", "path", F.round(F.col("score") * 100).cast("long").alias("hundredths"), "tokens", "included")


@query("context_scores", f"""{_ranked}, j AS (SELECT r.*, included FROM ranked r JOIN fold USING (project, place)),
    t AS (SELECT project, coalesce(sum(score) FILTER (WHERE included), 0) AS inside, sum(score) AS total, arg_min(score, place) FILTER (WHERE included) AS top FROM j GROUP BY project)
    SELECT project, CASE WHEN top IS NULL THEN 0 ELSE round(100 * (0.6 * CASE WHEN total > 0 THEN inside / total ELSE 1 END + 0.4 * least(1.0, top / 5.0))) END::BIGINT AS context_score FROM t""")
def context_scores(spark, d):
    return R.context_score(_rank(spark, d))


@query("greedy_budget", """
    WITH RECURSIVE r AS (
      SELECT source AS project, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY written_at DESC NULLS LAST, doc_id) AS place
      FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL),
    fold AS (
      SELECT project, place, doc_id, size <= 4000 AS included, CASE WHEN size <= 4000 THEN size ELSE 0 END AS used FROM r WHERE place = 1
      UNION ALL SELECT r.project, r.place, r.doc_id, used + r.size <= 4000, CASE WHEN used + r.size <= 4000 THEN used + r.size ELSE used END
      FROM fold JOIN r ON r.project = fold.project AND r.place = fold.place + 1)
    SELECT project, doc_id FROM fold WHERE included""")
def greedy_budget(spark, d):
    docs = table(spark, d, "documents").where("source is not null and n_chars is not null").select(
        F.col("source").alias("project"), F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), "written_at"
    )
    order = [F.col("written_at").isNull(), -F.unix_micros(F.col("written_at").cast("timestamp")), F.col("id")]
    return R.fill_budget(docs, 4000, group="project", size="size", order=order).where("included").select("project", F.col("id").alias("doc_id"))


_named_file = f"(SELECT min(path) AS path FROM {FILES} WHERE language = 'go')"
_recent, _changed = "1770000000", "1775000000"


@query("named_context", f"""
    WITH f AS (SELECT * FROM {FILES}), {_edges}, seeds AS (SELECT project, id FROM f WHERE lower(path) = lower((SELECT path FROM {_named_file})) OR ends_with(lower(path), '/' || lower((SELECT path FROM {_named_file})))),
    one AS (SELECT DISTINCT project, seeds.id AS seed, dst AS id FROM seeds JOIN edges USING (project) WHERE src = seeds.id),
    two AS (SELECT DISTINCT project, seed, dst AS id FROM one JOIN edges USING (project) WHERE src = one.id AND dst <> seed EXCEPT SELECT * FROM one)
    SELECT project, id, round(sum(w) * 100)::BIGINT AS hundredths, id IN (SELECT id FROM seeds) AS explicit FROM (
      SELECT project, id, 5.0::DOUBLE AS w FROM seeds UNION ALL SELECT project, id, 2.0 FROM one UNION ALL SELECT project, id, 0.8 FROM two) GROUP BY project, id""")
def named_context(spark, d):
    """A request that names a file and nothing else: the file as an exact symbol, and what it reaches; signals don't count."""
    files, symbols, imports = _inputs(spark, d)
    path = files.where("language = 'go'").agg(F.min("path")).first()[0]
    marks = files.select("project", "path")
    ranked = R.rank_files(files, symbols, imports, f"the {path} please", BUDGET, changed=marks, recent=marks)
    return ranked.select("project", "id", F.round(F.col("score") * 100).cast("long").alias("hundredths"), "explicit")


@query("signalled_context", f"""
    WITH f AS (SELECT * FROM {FILES}), {_edges},
    seeds AS (SELECT project, id, ((modified_at >= {_changed})::INT * 3.0 + (modified_at >= {_recent})::INT * 1.5)::DOUBLE AS w FROM f WHERE modified_at >= {_recent}),
    one AS (SELECT DISTINCT project, seeds.id AS seed, dst AS id FROM seeds JOIN edges USING (project) WHERE src = seeds.id),
    two AS (SELECT DISTINCT project, seed, dst AS id FROM one JOIN edges USING (project) WHERE src = one.id AND dst <> seed EXCEPT SELECT * FROM one),
    all_ AS (SELECT project, id, w FROM seeds UNION ALL SELECT h.project, h.id, 0.4 * w FROM one h JOIN seeds s ON s.id = h.seed UNION ALL SELECT h.project, h.id, 0.16 * w FROM two h JOIN seeds s ON s.id = h.seed)
    SELECT id, round(sum(w) * 100)::BIGINT AS hundredths FROM all_ GROUP BY id""")
def signalled_context(spark, d):
    """A request without a term: only changed and recent files and what they reach."""
    files, symbols, imports = _inputs(spark, d)
    since = lambda when: files.where(F.col("modified_at") >= when).select("project", "path")
    ranked = R.rank_files(files, symbols, imports, "please fix", BUDGET, changed=since(int(_changed)), recent=since(int(_recent)))
    return ranked.select("id", F.round(F.col("score") * 100).cast("long").alias("hundredths"))


@query("prompt_paths", f"""
    {_ranked}, fresh AS (SELECT r.project, r.path, r.place FROM ranked r JOIN fold USING (project, place) WHERE included AND r.path NOT IN (SELECT path FROM f WHERE length(path) % 3 = 0))
    SELECT project, path, place AS shown FROM (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY place)::INTEGER AS place FROM fresh) WHERE place <= 6""")
def prompt_paths(spark, d):
    """The best paths of the request that the last prompt didn't show; it showed those whose length is a multiple of three."""
    from ..operators.context import prompt_paths as paths

    before = once(table(spark, d, "files")).where(F.char_length("path") % 3 == 0).select("project", "path")
    rows = paths(_rank(spark, d), before)
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "tokens", "path"))
    return rows.select("project", "path", place.alias("shown"))


@query("signal_boosts", f"""
    SELECT id, ((project || path IN (SELECT project || path FROM {FILES} WHERE modified_at >= 1770000000))::INT * 30
      + (project || path IN (SELECT project || path FROM {FILES} WHERE modified_at >= 1760000000))::INT * 15)::BIGINT AS tenths FROM {FILES}""")
def signal_boosts(spark, d):
    files = once(table(spark, d, "files"))
    marks = lambda since, tenths: files.where(F.col("modified_at") >= since).select("project", "path", F.lit(tenths).alias("b"))
    boosts = marks(1770000000, 30).unionByName(marks(1760000000, 15)).groupBy("project", "path").agg(F.sum("b").alias("b"))
    return files.join(boosts, ["project", "path"], "left").select("id", F.coalesce("b", F.lit(0)).cast("long").alias("tenths"))


@query("graph_expand_2hop", """
    WITH half AS (SELECT DISTINCT l_suppkey AS a, -l_partkey - 1 AS b FROM lineitem),
    edges AS (SELECT a AS src, b AS dst FROM half UNION ALL SELECT b, a FROM half),
    one AS (SELECT src AS seed, dst AS id FROM edges WHERE src >= 0 AND src % 100 = 0),
    two AS (SELECT DISTINCT seed, dst AS id FROM one JOIN edges ON src = one.id WHERE dst <> seed EXCEPT SELECT * FROM one)
    SELECT id, round(sum(w) * 1e4)::BIGINT AS score FROM (
      SELECT DISTINCT src AS id, src AS seed, 1.0::DOUBLE AS w FROM edges WHERE src >= 0 AND src % 100 = 0
      UNION ALL SELECT id, seed, 0.4 FROM one UNION ALL SELECT id, seed, 0.16 FROM two) GROUP BY id""")
def graph_expand_2hop(spark, d):
    """Reach of the suppliers whose key is divisible by 100, as queries against all supplier and part links."""
    half = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst")).distinct()
    edges = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("project", F.lit("all"))
    seeds = half.where("src % 100 = 0").select(F.lit("all").alias("project"), F.col("src").alias("id"), F.lit(1.0).alias("score")).distinct()
    return R.expand_scores(seeds, edges).select("id", F.round(F.col("score") * 1e4).cast("long").alias("score"))


@query("module_edges", f"""WITH f AS (
      SELECT project, min(id) AS id, dir AS path FROM (SELECT project, id, string_split(path, '/')[-2] AS dir FROM {FILES}) WHERE dir IS NOT NULL GROUP BY project, dir), {_edges}
    SELECT project, src, dst FROM edges""")
def module_edges(spark, d):
    """Edges between directories, the first file of each standing for it."""
    parts = F.split("path", "/")
    files = once(table(spark, d, "files")).where(F.size(parts) > 1).select("project", "id", F.element_at(parts, -2).alias("dir"))
    first = files.groupBy("project", "dir").agg(F.min("id").alias("id")).withColumnRenamed("dir", "path")
    return R.import_edges(first, table(spark, d, "imports")).select("project", "src", "dst")
