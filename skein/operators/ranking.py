"""Lexical ranking of indexed files for a request, graph expansion and filling a token budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import Table

# What a match is worth by where it is found, recency boosts, and what a hop along the import graph keeps.
SYMBOL_EXACT, SYMBOL_PARTIAL, FILE_NAME, PATH, IMPORT = 5.0, 3.0, 3.0, 2.0, 1.0
CHANGED_BOOST, RECENT_BOOST = 3.0, 1.5
HOPS, DECAY = 2, 0.4


def plan_terms(spark: SparkSession, query: str) -> tuple[list[str], list[str]]:
    """(terms, file references) of a request, by the same expressions that read the data."""
    text = F.lit(query)
    row = spark.range(1).select(
        T.query_terms(T.without_references(text)).alias("terms"),
        F.transform(T.file_references(text), lambda r: F.lower(F.regexp_replace(r, r"^\./", ""))).alias("refs"),
    ).first()
    return row["terms"], row["refs"]


def idf(df: Column, n: Column) -> Column:
    """Rarity from 0.12 to 2.6: rare words up, words found in most items down."""
    rarity = 1.0 + F.log2((n + 1) / (df + 1)) * 0.4
    penalty = F.greatest(F.lit(0.12), 1.0 - (df / n) * 1.8)
    return F.least(F.lit(2.6), F.greatest(F.lit(0.12), rarity * penalty))


def indexed_words(files: DataFrame, symbols: DataFrame, imports: DataFrame, terms: Sequence[str] = ()) -> DataFrame:
    """(project, id, word, place): the words of each file by where they stand.

    With ``terms``, texts that hold none of them are left out before they are taken apart; a term with letters beyond ASCII,
    whose lower case can depend on what stands around it, lets every text through.
    """
    own = files.select("project", "id", "path")
    by_file = own.select("project", "id")
    simple = terms and all(t.isascii() for t in terms)

    def holding(rows: DataFrame, text: str) -> DataFrame:
        found = F.lit(False)
        for t in terms:
            found = found | F.lower(text).contains(t)
        return rows.where(found) if simple else rows

    paths, names, modules = holding(own, "path"), holding(symbols.select(F.col("file_id").alias("id"), "name"), "name"), holding(imports.select(F.col("file_id").alias("id"), "module"), "module")
    word = lambda c, place: (F.explode(T.subwords(c)).alias("word"), F.lit(place).alias("place"))
    rows = [
        paths.select("project", "id", *word(F.col("path"), "path")), paths.select("project", "id", *word(T.path_stem(F.col("path")), "stem")),
        names.join(by_file, "id").select("project", "id", *word(F.col("name"), "symbol")), modules.join(by_file, "id").select("project", "id", *word(F.col("module"), "import")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def lexical_scores(files: DataFrame, symbols: DataFrame, imports: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(project, id, score, matched): for each term the best place it is found in, by the term's rarity in the project.

    Words that no term touches leave before any shuffle.  Imports count as places but not in the rarity.
    """
    if not terms:
        return files.select("project", "id").where("false").withColumns({"score": F.lit(0.0), "matched": F.lit(0).cast("long")})
    wanted = F.array(*map(F.lit, terms))
    word, place = F.col("word"), F.col("place")
    hit = F.filter(wanted, lambda t: (word == t) | ((place == "symbol") & (F.char_length(t) >= 3) & word.contains(t)))
    hits = indexed_words(files, symbols, imports, terms).select("project", "id", "word", "place", F.explode(hit).alias("term"))
    exact = word == F.col("term")
    worth = (
        F.when((place == "symbol") & exact, SYMBOL_EXACT).when(place == "symbol", SYMBOL_PARTIAL)
        .when(place == "stem", FILE_NAME).when(place == "path", PATH).otherwise(IMPORT)
    )
    best = hits.groupBy("project", "id", "term").agg(F.max(worth).alias("best"), F.max((exact & (place != "import")).cast("int")).alias("counts"))
    sizes = files.groupBy("project").agg(F.count_distinct("id").alias("n"))
    df = best.groupBy("project", "term").agg(F.sum("counts").alias("df")).join(sizes, "project")
    weights = df.select("project", "term", idf(F.col("df"), F.col("n")).alias("idf"))
    scored = best.join(weights, ["project", "term"]).groupBy("project", "id").agg(
        F.sum(F.col("best") * F.col("idf")).alias("raw"), F.count(F.lit(1)).alias("matched")
    )
    return scored.select("project", "id", (F.col("raw") * (1.0 + 0.2 * (F.col("matched") - 1))).alias("score"), "matched")


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, src, dst): files joined by an import, both ways, each pair once; a file is not its own neighbour."""
    stems = files.select("project", F.col("id").alias("dst"), F.lower(T.path_stem(F.col("path"))).alias("stem"))
    calls = imports.select(F.col("file_id").alias("src"), T.module_stem(F.col("module")).alias("stem")).distinct()
    calls = calls.join(files.select("project", F.col("id").alias("src")), "src")
    edges = calls.join(stems, ["project", "stem"]).where("src <> dst").select("project", "src", "dst")
    return edges.unionByName(edges.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def expand_scores(seeds: DataFrame, edges: DataFrame, *, hops: int = HOPS, decay: float = DECAY) -> DataFrame:
    """(project, id, score): seed scores and what reaches each file from every seed, once at its shortest distance.

    A hop adds the neighbours of the frontier; the least distance by (seed, file) is taken in one aggregation at the
    end, so no hop has to look up what earlier ones reached.
    """
    links = edges.select("project", F.col("src").alias("id"), "dst")
    frontier = seeds.select("project", F.col("id").alias("seed"), "id", "score")
    reached = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        frontier = frontier.join(links, ["project", "id"]).select("project", "seed", F.col("dst").alias("id"), "score").distinct()
        reached = reached.unionByName(frontier.withColumn("hop", F.lit(hop)))
    nearest = reached.groupBy("project", "seed", "id").agg(F.min("hop").alias("hop"), F.max("score").alias("score"))
    return nearest.groupBy("project", "id").agg(F.sum(F.col("score") * F.pow(F.lit(decay), F.col("hop"))).alias("score"))


def fill_budget(candidates: DataFrame, budget: int, *, group: str, size: str, order: Sequence[Column]) -> DataFrame:
    """``candidates`` with ``included``: in order, each item that still fits is taken, one that does not is skipped.

    The items of one size that are taken are the first ones of that size, at most budget / size of them, since what is
    left only shrinks.  The rest is out beforehand, so the sequential part sees at most about budget * ln(budget) items
    of a group, whatever the group's size.  Items of size 0 or less always fit; an unknown size never does.
    """
    sized = candidates.where((F.col(size) > 0) & (F.col(size) <= budget)).select(group, "id", F.col(size).alias("__size"), F.struct(*order_keys(order)).alias("__rank"))
    place = F.row_number().over(Window.partitionBy(group, "__size").orderBy("__rank", "id"))
    # The constant limit is applied before the shuffle, so a size that most items share sends few of them.
    first = sized.withColumn("__place", place).where(F.col("__place") <= max(budget, 0))
    contenders = first.where(F.col("__place") <= F.floor(F.lit(budget) / F.col("__size")))
    listed = contenders.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__rank", "id", F.col("__size").alias("size")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    folded = F.aggregate("items", start, lambda acc, x: F.when(
        acc["used"] + x["size"] <= budget,
        F.struct((acc["used"] + x["size"]).alias("used"), F.array_append(acc["taken"], x["id"]).alias("taken")),
    ).otherwise(acc))
    taken = listed.select(group, F.explode(folded["taken"]).alias("id"), F.lit(True).alias("__taken"))
    joined = candidates.join(taken, [group, "id"], "left")
    return joined.withColumn("included", F.coalesce("__taken", F.col(size) <= 0, F.lit(False))).drop("__taken")


def order_keys(order: Sequence[Column]) -> list[Column]:
    """Columns whose ascending order is ``order``; callers of ``fill_budget`` give ascending keys."""
    return [c.alias(f"k{i}") for i, c in enumerate(order)]


def rank_files(
    files: DataFrame,
    symbols: DataFrame,
    imports: DataFrame,
    query: str,
    budget: int,
    *,
    terms: Sequence[str] | None = None,
    changed: DataFrame | None = None,
    recent: DataFrame | None = None,
) -> DataFrame:
    """(project, id, path, score, tokens, explicit, included): the files that answer ``query``, within ``budget`` tokens.

    ``files`` has (project, id, path, language, byte_size), one row per file; every project is ranked on its own.  A
    file named in the request scores as an exact symbol and comes first.  ``changed`` and ``recent`` (project, path)
    add to the score unless the request names files.  Scores spread over two hops of the import graph, are rounded to
    hundredths, then ordered: named first, score, fewer tokens, path.
    """
    found, refs = plan_terms(files.sparkSession, query)
    terms = list(found if terms is None else terms)
    files = files.where("id is not null and path is not null")
    scores = lexical_scores(files, symbols, imports, terms).select("project", "id", "score")
    path = F.lower("path")
    named = F.lit(False)
    for ref in refs:
        named = named | (path == ref) | (path.endswith("/" + ref) if "/" in ref else F.regexp_extract(path, r"([^/]*)$", 1) == ref)
    explicit = files.where(named).select("project", "id", F.lit(SYMBOL_EXACT).alias("explicit_score"))
    scores = scores.join(explicit, ["project", "id"], "full").select(
        "project", "id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("explicit_score", F.lit(0.0))).alias("score")
    )
    if not refs:
        for signal, boost in ((changed, CHANGED_BOOST), (recent, RECENT_BOOST)):
            if signal is not None:
                lifted = files.join(signal.select("project", "path").distinct(), ["project", "path"]).select("project", "id", F.lit(boost).alias("score"))
                scores = scores.unionByName(lifted)
        scores = scores.groupBy("project", "id").agg(F.sum("score").alias("score"))
    scores, edges = Table(scores).df, Table(import_edges(files, imports)).df  # read by each hop
    spread = expand_scores(scores, edges)
    ranked = spread.join(files.select("project", "id", "path", "language", "byte_size"), ["project", "id"]).select(
        "project", "id", "path", (F.round(F.col("score") * 100) / 100).alias("score"),
        T.estimated_tokens(F.col("byte_size"), F.col("language")).alias("tokens"), named.alias("explicit"),
    )
    order = [(~F.col("explicit")).cast("int"), -F.col("score"), F.col("tokens"), F.col("path")]
    return fill_budget(ranked, budget, group="project", size="tokens", order=order)


def context_score(ranked: DataFrame) -> DataFrame:
    """(project, context_score): 0 to 100 from how much of the score fits and how sure the first hit is."""
    inside = F.when(F.col("included"), F.col("score"))
    first = F.min_by(F.when(F.col("included"), F.col("score")), F.when(F.col("included"), F.struct((~F.col("explicit")).cast("int"), -F.col("score"), "tokens", "path")))
    agg = ranked.groupBy("project").agg(F.sum(inside).alias("inside"), F.sum("score").alias("total"), first.alias("top"))
    coverage = F.when(F.col("total") > 0, F.coalesce("inside", F.lit(0.0)) / F.col("total")).otherwise(1.0)
    value = F.round(100 * (0.6 * coverage + 0.4 * F.least(F.lit(1.0), F.col("top") / SYMBOL_EXACT))).cast("long")
    return agg.select("project", F.when(F.col("top").isNull(), F.lit(0).cast("long")).otherwise(value).alias("context_score"))
