"""A graph of statements as a table of quads (g, s, p, o): graph, subject, predicate, object. Patterns join within one graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import slug


def statements(df: DataFrame, g: Column, s: Column, p: str, o: Column) -> DataFrame:
    """One quad for each row of `df` with a value for the object."""
    return df.select(g.cast("string").alias("g"), s.cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o")).filter("o is not null and o <> ''")


def document_quads(docs: DataFrame, meta: DataFrame, refs: DataFrame) -> DataFrame:
    """The statements about documents: type, language, year, title, authors, keywords, and what they cite.

    Cited is the slug of a reference's title, or a numbered stub for a reference without one; a document's own slug is its
    `same_as`, so that citations lead from document to document.
    """
    d = F.col("doc_id")
    m = F.col("document_id")
    kinds = F.when(F.col("du_document_type").isin("article", "thesis", "report"), F.col("du_document_type")).otherwise("document")
    parts = [
        statements(docs, d, d, "type", kinds),
        statements(docs, d, d, "language", F.col("language")),
        statements(docs, d, d, "year", F.col("year")),
        statements(docs.select("doc_id", F.explode("keywords").alias("k")), d, d, "about", slug(F.col("k"))),
        statements(meta, m, m, "title", F.col("title")),
        statements(meta, m, m, "same_as", slug(F.col("title"))),
        statements(meta.select("document_id", F.explode("authors").alias("a")), m, m, "author", F.col("a")),
        statements(refs.filter(F.length("raw") >= 10), m, m, "cites", F.coalesce(F.nullif(slug(F.col("title")), F.lit("")), F.format_string("ref_%04d", "ref_index"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def having(quads: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    """The subjects and objects of one predicate, with their graph."""
    return quads.filter(F.col("p") == p).select("g", F.col("s").alias(s), F.col("o").alias(o))


def citing(quads: DataFrame) -> DataFrame:
    """(document, cited, title): documents that cite another one, with the cited one's title where it has one."""
    cites = having(quads, "cites", "document", "slug").select("document", "slug")
    same = having(quads, "same_as", "cited", "slug").select("cited", "slug")
    titles = having(quads, "title", "cited", "title").groupBy("cited").agg(F.min("title").alias("title"))
    found = cites.join(same, "slug").filter("document <> cited").select("document", "cited").distinct()
    return found.join(titles, "cited", "left").select("document", "cited", "title")


def reached(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): the nodes reached over `edges` (s, o) from each start in at most `depth` steps, at the fewest steps; no node twice."""
    seen = start.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for n in range(1, depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("s")).select("start", F.col("o").alias("node")).distinct()
        frontier = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(n))
        seen = seen.union(frontier)
    return seen.filter("depth > 0")


def coauthors(quads: DataFrame) -> DataFrame:
    """(author, other, shared): authors that stand together, and in how many documents."""
    a = having(quads, "author", "paper", "author")
    b = having(quads, "author", "paper", "other")
    return a.join(b, ["g", "paper"]).filter("author <> other").groupBy("author", "other").agg(F.countDistinct("paper").alias("shared"))


def about(quads: DataFrame, part: str) -> DataFrame:
    """(document, title): documents about a concept whose name contains `part`."""
    hit = quads.filter((F.col("p") == "about") & F.col("o").contains(part)).select("g", "s")
    titles = having(quads, "title", "s", "title").groupBy("g", "s").agg(F.min("title").alias("title"))
    docs = quads.filter("p = 'type'").select("g", "s").join(hit, ["g", "s"], "left_semi")
    return docs.join(titles, ["g", "s"], "left").select(F.col("s").alias("document"), "title")


def statistics(quads: DataFrame) -> DataFrame:
    """Counts of what the graph holds."""
    c = lambda p: F.count_if(F.col("p") == p)
    return quads.agg(F.count("*").alias("quads"), F.countDistinct("g").alias("graphs"), F.countDistinct(F.when(F.col("p") == "author", F.col("o"))).alias("authors"), c("cites").alias("citations"), c("about").alias("concepts"))


def about_any(quads: DataFrame, predicates: list[str], part: str) -> DataFrame:
    """(document, predicate, concept, title): documents that stand in one of the predicates to a concept whose name contains `part`."""
    hits = quads.filter(F.col("p").isin(*predicates) & F.col("o").contains(part)).select("g", F.col("s").alias("document"), F.col("p").alias("predicate"), F.col("o").alias("concept"))
    titles = having(quads, "title", "document", "title").groupBy("g", "document").agg(F.min("title").alias("title"))
    return hits.join(titles, ["g", "document"], "left").select("document", "predicate", "concept", "title")


def identified(quads: DataFrame, p: str) -> DataFrame:
    """(id, documents): the identifiers of one predicate and the graphs that hold them."""
    return having(quads, p, "node", "id").groupBy("id").agg(F.countDistinct("g").alias("documents"))


def or_listed(hits: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, source): what the graph hits, and what the list has besides."""
    found = hits.select(key).distinct()
    return found.withColumn("source", F.lit("graph")).union(listed.select(key).distinct().join(found, key, "left_anti").withColumn("source", F.lit("keyword")))


def dot_lines(quads: DataFrame) -> DataFrame:
    """(line): the statements in the form that draws graphs."""
    name = lambda c: F.replace(F.col(c), F.lit('"'), F.lit("'"))
    return quads.select(F.format_string('"%s" -> "%s" [label="%s"];', name("s"), name("o"), name("p")).alias("line")).distinct()
