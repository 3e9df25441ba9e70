"""Domain-level link graph: weighted edges, adjacency, ego networks and induced subgraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.rows import explode_as
from webloom.session import written

# Fixed values.
MAX_WEIGHT = 5
ROW_COLOR = "#17a2b8"
NEIGHBOUR_COLOR = "#cbf1f7"
VERTEX_SIZE = 100
ARROWS = "to"
INCOMING = "i"
OUTGOING = "o"


def host_of_key(key: Column) -> Column:
    """Host of a link without protocol."""
    return F.regexp_extract(key, r"^([^/?#:]*)", 1)


def domain_edges(links: DataFrame, domain: Callable[[Column], Column] = host_of_key) -> DataFrame:
    """edges(src, dst, weight): number of links between two domains."""
    return (
        links.select(domain(F.col("src")).alias("src"), domain(F.col("dst")).alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """domain, direction, neighbour, weight: every edge seen from both of its ends, in one pass over the edges."""
    out = F.struct(
        F.col("src").alias("domain"), F.lit(OUTGOING).alias("direction"), F.col("dst").alias("neighbour"), "weight"
    )
    back = F.struct(
        F.col("dst").alias("domain"), F.lit(INCOMING).alias("direction"), F.col("src").alias("neighbour"), "weight"
    )
    return edges.select(F.explode(F.array(out, back)).alias("e")).select("e.*")


def multi_lookup(adj: DataFrame, keys: DataFrame) -> DataFrame:
    """Adjacency rows for `keys(domain, pos)`; a domain without a row gives one row of NULLs. Carries list order `pos`.

    An inner join and the missing keys, instead of one outer join: the list can be broadcast to the adjacency, and if
    it is too large for that, the partitions of a domain with very many neighbours can still be split.
    """
    found = adj.join(keys, "domain")
    missing = keys.join(adj.select("domain").distinct(), "domain", "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)


def numbered(adj: DataFrame) -> DataFrame:
    """Give every row of the adjacency the list position of its domain in name order, as an ordering key."""
    return adj.withColumn("pos", F.col("domain"))


# The order in which rows and cells are visited; "first wins" below refers to it.
_VISIT = ("pos", "direction", "neighbour")


def graph_edges(rows: DataFrame) -> DataFrame:
    """edges(from, to, width, arrows) of adjacency rows: clamped weight, no self-loops, first width per pair wins."""
    incoming = F.col("direction") == INCOMING
    return (
        rows.filter(F.col("neighbour").isNotNull() & (F.col("domain") != F.col("neighbour")))
        .select(
            F.when(incoming, F.col("neighbour")).otherwise(F.col("domain")).alias("from"),
            F.when(incoming, F.col("domain")).otherwise(F.col("neighbour")).alias("to"),
            F.least(F.col("weight"), F.lit(MAX_WEIGHT)).cast("int").alias("width"),
            F.struct(*_VISIT).alias("visit"),
        )
        .groupBy("from", "to")
        .agg(F.min_by("width", "visit").alias("width"))
        .withColumn("arrows", F.lit(ARROWS))
    )


def graph_vertices(rows: DataFrame) -> DataFrame:
    """vertices(id, label, color, size): row domains and their neighbours, the first colour per id wins.

    A row's own vertex is visited before its cells, which the empty direction expresses.
    """
    present = rows.filter(F.col("neighbour").isNotNull())
    own = F.struct(
        F.col("domain").alias("id"),
        F.lit(ROW_COLOR).alias("color"),
        F.struct("pos", F.lit("").alias("direction"), F.lit("").alias("neighbour")).alias("visit"),
    )
    other = F.struct(
        F.col("neighbour").alias("id"), F.lit(NEIGHBOUR_COLOR).alias("color"), F.struct(*_VISIT).alias("visit")
    )
    seen = explode_as(present.select(F.array(own, other).alias("v")), "v", "x").select("x.*")
    return (
        seen.groupBy("id")
        .agg(F.min_by("color", "visit").alias("color"))
        .select("id", F.col("id").alias("label"), "color", F.lit(VERTEX_SIZE).alias("size"))
    )


def ego_rows(adj: DataFrame, domain: str) -> DataFrame:
    """Adjacency of one domain; the graph of these rows is its ego network."""
    return numbered(adj.filter(F.col("domain") == domain))


def top_domains(edges: DataFrame, n: int) -> DataFrame:
    """The `n` domains with most references from other domains: domain, in_links, pos (1-based rank). Written."""
    ranked = (
        edges.filter("src <> dst")
        .groupBy(F.lower("dst").alias("domain"))
        .agg(F.sum("weight").alias("in_links"))
        .orderBy(F.desc("in_links"), "domain")
        .limit(n)
    )
    # At most n rows are left, so numbering them in one task is bounded by the parameter.
    order = F.array_sort(
        F.collect_list(F.struct((-F.col("in_links")).alias("neg"), "domain", "in_links"))
    )
    numbered_list = ranked.agg(order.alias("list")).select(F.posexplode("list").alias("at", "d"))
    return written(numbered_list.select("d.domain", "d.in_links", (F.col("at") + 1).alias("pos")), "top")


def restrict(adj: DataFrame, top: DataFrame) -> DataFrame:
    """Adjacency rows whose both ends are in the stored list `top(domain, pos)`."""
    ends = top.select(F.col("domain").alias("neighbour"))
    return adj.join(top.select("domain", "pos"), "domain").join(ends, "neighbour", "left_semi")


def top_graph_vertices(adj: DataFrame, top: DataFrame) -> DataFrame:
    """Vertices of the induced subgraph: listed domains that have a row, or are neighbours of a listed domain."""
    rows = adj.join(top.select("domain", "pos"), "domain")
    return graph_vertices(rows).join(top.select(F.col("domain").alias("id")), "id", "left_semi")


def export_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document per vertex and per edge, under the names the front end reads."""
    v = vertices.select(
        F.lit("vertex").alias("kind"), F.to_json(F.struct("id", "label", "color", "size")).alias("json")
    )
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("from", "to", "width", "arrows")).alias("json"))
    return v.unionByName(e)
