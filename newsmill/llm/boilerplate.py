"""Problem 4: lines repeated across one site's documents.

The lines of a site are nodes, weighted by the documents they are in; two lines that follow each other are an edge,
weighted likewise.  Nodes and edges of high support are kept; connected components of what is left are boilerplate
blocks.  Deleting a document's occurrences of a block's lines leaves its own text.

Lines are compared by hash (letter case, white space and figures don't matter).  One shuffle of (site, line, document)
with map-side combine counts the nodes; edges are counted only between kept nodes, and components are found by
spreading least labels with pointer jumping over that small graph, in checkpointed rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import site_of
from ..session import cut, hot_join, hot_keys, table

#: Documents of its site that a line must be in.
SUPPORT = 5

_BLANK = r"[\s\x00-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+"


def line_key(line: Column) -> Column:
    """What makes two lines the same: no white space at the ends, one blank inside, figures as 0, lower case."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, _BLANK, " "))), r"\d+", "0")


def lines_of(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """(key, line_no, node): the lines of each text that aren't blank, numbered from 1 with blank ones; node is
    the hash of site and line.  Texts without a site (no address) share none with others and give no row."""
    t = pages.select(F.col(key), site_of(F.col(url)).alias("site"), F.split(text, "\n").alias("all"))
    t = t.select(key, "site", F.posexplode("all").alias("at", "line")).withColumn("line", line_key(F.col("line")))
    node = F.when((F.col("line") != "") & F.col("site").isNotNull(), F.xxhash64("site", "line"))
    return t.select(key, (F.col("at") + 1).alias("line_no"), node.alias("node")).where("node is not null")


def blocks(lines: DataFrame, key: str, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(node, support, block) of the kept nodes and (a, b, support) of the kept edges; ``block`` is the least node of
    its component."""
    nodes = cut(lines.groupBy("node", key).agg(F.lit(1).alias("one")).groupBy("node").agg(F.count("*").alias("support")).where(F.col("support") >= support))
    kept = hot_join(lines, nodes.select("node"), ["node"], key, hot_keys(nodes, ["node"], "support"), "inner").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "node"))).alias("run"))
    n = F.size("run")
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("run", i).node.alias("a"), F.get("run", i + 1).node.alias("b"), (F.get("run", i + 1).line_no - F.get("run", i).line_no).alias("gap")))
    edges = kept.where(n >= 2).select(key, F.explode(pairs).alias("e")).select(key, "e.*").where("gap <= 2 and a <> b")
    edges = cut(edges.groupBy("a", "b", key).agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= support))
    return cut(nodes.join(components(edges), "node", "left").withColumn("block", F.coalesce("block", "node"))), edges


def components(edges: DataFrame) -> DataFrame:
    """(node, block) of the nodes of (a, b): block is the least node of the connected component.  Each round takes
    the least label of the neighbours and then the label's own label, so that long chains shrink by halves."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("block")))
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("block").alias("near"))
        new = label.join(near, label.node == near.a).select("node", F.col("block").alias("old"), F.least("block", "near").alias("block"))
        up = new.select(F.col("node").alias("block"), F.col("block").alias("up"))
        new = cut(new.join(up, "block").select("node", "old", F.least("block", "up").alias("block")))
        label = new.select("node", "block")
        if new.where("block <> old").isEmpty():
            return label


def occurrences(lines: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Lines that belong to a block, with it.  ``found`` holds one row a repeated line."""
    found = found.select("node", "support", "block")
    return hot_join(lines, found, ["node"], key, hot_keys(found, ["node"], "support"), "inner")


def without_blocks(pages: DataFrame, key: str, text: str, at: DataFrame) -> DataFrame:
    """(key, text) with the lines of ``at`` (key, line_no) taken out; other texts, nulls among them, as they are.
    Keys must be unique."""
    gone = at.groupBy(key).agg(F.collect_set("line_no").alias("gone"))
    lines = F.split(text, "\n")
    rest = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", (i + 1).cast("int")), x)), lambda x: x.isNotNull())
    return pages.select(key, text).join(gone, key, "left").select(key, F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")).alias(text))


def repeated_lines(pages: DataFrame, key: str, url: str, text: str, support: int = SUPPORT) -> DataFrame:
    """(key, line_no, block, support) of the lines found in at least ``support`` documents of their site.

    Null and empty texts, blank lines and texts without an address give no row; a document that comes twice under one
    key counts once for its lines' support; extra columns are ignored.
    """
    lines = cut(lines_of(pages, key, url, text))
    found, _ = blocks(lines, key, support)
    return occurrences(lines, found, key).select(key, "line_no", "block", "support")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_extractions")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(_pages(spark, sf_dir), "extraction_id", "resolved_url", "body_text").select("extraction_id", "line_no")


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by their number of lines and least and greatest support."""
    found, _ = blocks(cut(lines_of(_pages(spark, sf_dir), "extraction_id", "resolved_url", "body_text")), "extraction_id")
    return found.groupBy("block").agg(F.count("*").alias("n_lines"), F.min("support").alias("least_support"), F.max("support").alias("most_support"))


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return without_blocks(pages, "extraction_id", "body_text", repeated_lines(pages, "extraction_id", "resolved_url", "body_text"))
