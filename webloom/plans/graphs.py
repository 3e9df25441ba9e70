"""Queries and checks for the domain graph.

The links of `pages` stay within a host, which makes a graph of self-loops. Clamp, direction and first-wins rules are
therefore exercised on the trade graph of the star schema: from the customer's nation to the supplier's nation, both
qualified by part size, weighted by the number of line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import graph
from webloom.plans import sql
from webloom.plans.derived import link_table, stored
from webloom.sources.tables import read_table

TOP = 50
EGO = "nation_6.size7"


def trade_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges as a stored table: every query reads them, none joins them up again."""
    return stored(spark, folder, "trade_edges", lambda: build_trade_edges(spark, folder))


def build_trade_edges(spark: SparkSession, folder: str) -> DataFrame:
    """edges(src, dst, weight). The nation table is fixed-size; the other sides are left to the planner."""
    table = lambda name: read_table(spark, folder, name)
    nation = table("nation").select(
        "n_nationkey", F.lower(F.regexp_replace("n_name", " ", "-")).alias("name")
    )
    customers = (
        table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("name").alias("from_name"))
    )
    suppliers = (
        table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("name").alias("to_name"))
    )
    items = (
        table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        .join(table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    )
    size = F.concat(F.lit(".size"), F.col("p_size").cast("string"))
    return (
        items.select(F.concat("from_name", size).alias("src"), F.concat("to_name", size).alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def trade_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return graph.numbered(graph.adjacency(trade_edges(spark, folder)))


def domain_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacency of the hosts of the link table."""
    return graph.adjacency(graph.domain_edges(link_table(spark, folder)))


def domain_graph_registered(spark: SparkSession, folder: str) -> DataFrame:
    """The same per last-two-labels domain."""
    by_domain = lambda key: urls.domain_of_host(graph.host_of_key(key))
    return graph.adjacency(graph.domain_edges(link_table(spark, folder), by_domain))


def domain_multi_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Rows for the list of all nation names times two sizes, in list order; absent domains give NULLs."""
    names = F.lower(F.regexp_replace("n_name", " ", "-"))
    sizes = F.explode(F.array(F.lit(7), F.lit(999))).alias("size")
    keys = read_table(spark, folder, "nation").select("n_nationkey", names.alias("name"), sizes).select(
        F.concat("name", F.lit(".size"), F.col("size").cast("string")).alias("domain"),
        (F.col("n_nationkey") * 1000 + F.col("size")).alias("pos"),
    )
    adj = graph.adjacency(trade_edges(spark, folder))
    return graph.multi_lookup(adj, keys).select("domain", "pos", "direction", "neighbour", "weight")


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph_edges(trade_adjacency(spark, folder))


def graph_vertices(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph_vertices(trade_adjacency(spark, folder))


def ego_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph_edges(graph.ego_rows(trade_adjacency(spark, folder), EGO))


def ego_vertices(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph_vertices(graph.ego_rows(trade_adjacency(spark, folder), EGO))


def top_domains(spark: SparkSession, folder: str) -> DataFrame:
    return graph.top_domains(trade_edges(spark, folder), TOP)


def _top_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    edges = trade_edges(spark, folder)
    return graph.adjacency(edges), graph.top_domains(edges, TOP)


def top_domain_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph_edges(graph.restrict(*_top_inputs(spark, folder)))


def top_domain_vertices(spark: SparkSession, folder: str) -> DataFrame:
    return graph.top_graph_vertices(*_top_inputs(spark, folder))


def export_graph_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = trade_adjacency(spark, folder)
    return graph.export_json(graph.graph_vertices(rows), graph.graph_edges(rows))


QUERIES = {
    "domain_graph": domain_graph,
    "domain_graph_registered": domain_graph_registered,
    "domain_multi_lookup": domain_multi_lookup,
    "graph_edges": graph_edges,
    "graph_vertices": graph_vertices,
    "ego_graph": ego_edges,
    "ego_graph_vertices": ego_vertices,
    "top_domains": top_domains,
    "top_domain_graph": top_domain_edges,
    "top_domain_graph_vertices": top_domain_vertices,
    "export_graph_json": export_graph_json,
}

_TRADE = r"""
trade AS (
  SELECT lower(replace(cn.n_name, ' ', '-')) || '.size' || p_size AS src,
         lower(replace(sn.n_name, ' ', '-')) || '.size' || p_size AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey
  GROUP BY ALL
)"""
_ADJACENCY = """
adj AS (
  SELECT src AS domain, 'o' AS direction, dst AS neighbour, weight FROM trade
  UNION ALL SELECT dst, 'i', src, weight FROM trade
)"""
_ROWS = "rws AS (SELECT *, domain AS pos FROM adj)"
_EGO_ROWS = f"rws AS (SELECT *, domain AS pos FROM adj WHERE domain = '{EGO}')"
_TOP = f"""
top AS (
  SELECT dst AS domain, in_links, row_number() OVER (ORDER BY in_links DESC, dst) AS pos
  FROM (SELECT dst, sum(weight)::BIGINT AS in_links FROM trade WHERE src <> dst GROUP BY dst)
  QUALIFY pos <= {TOP}
)"""
_TOP_ROWS = "rws AS (SELECT adj.*, top.pos FROM adj JOIN top ON top.domain = adj.domain)"
_EDGES = """
edges AS (
  SELECT "from", "to", width, 'to' AS arrows FROM (
    SELECT CASE direction WHEN 'i' THEN neighbour ELSE domain END AS "from",
           CASE direction WHEN 'i' THEN domain ELSE neighbour END AS "to",
           CASE WHEN weight > 5 THEN 5 ELSE weight END AS width,
           row_number() OVER (PARTITION BY CASE direction WHEN 'i' THEN neighbour ELSE domain END,
                                           CASE direction WHEN 'i' THEN domain ELSE neighbour END
                              ORDER BY pos, direction, neighbour) AS rn
    FROM rws WHERE neighbour <> domain) WHERE rn = 1
)"""
_VERTICES = """
vertices AS (
  SELECT id, id AS label, color, 100 AS size FROM (
    SELECT id, color, row_number() OVER (PARTITION BY id ORDER BY pos, direction, neighbour) AS rn FROM (
      SELECT domain AS id, '#17a2b8' AS color, pos, '' AS direction, '' AS neighbour FROM rws
      UNION ALL SELECT neighbour, '#cbf1f7', pos, direction, neighbour FROM rws)) WHERE rn = 1
)"""
_SELECT_EDGES = 'SELECT "from", "to", width, arrows FROM edges'
_SELECT_VERTICES = "SELECT id, label, color, size FROM vertices"
_HOST = r"regexp_extract({}, '^[^/?#:]*')"


def _link_adjacency(domain: str) -> str:
    edges = f"""
trade AS (
  SELECT {domain.format(_HOST.format('src'))} AS src, {domain.format(_HOST.format('dst'))} AS dst, count(*) AS weight
  FROM links GROUP BY ALL
)"""
    return sql.with_ctes(*sql.TO_LINKS, edges, _ADJACENCY, select="SELECT * FROM adj")


ORACLES = {
    "domain_graph": _link_adjacency("{}"),
    "domain_graph_registered": _link_adjacency(sql.domain_of_host("{}")),
    "domain_multi_lookup": sql.with_ctes(
        _TRADE,
        _ADJACENCY,
        select="""
SELECT k.domain, k.pos, direction, neighbour, weight
FROM (SELECT lower(replace(n_name, ' ', '-')) || '.size' || size AS domain, n_nationkey * 1000 + size AS pos
      FROM nation, (VALUES (7), (999)) s(size)) k LEFT JOIN adj ON adj.domain = k.domain""",
    ),
    "graph_edges": sql.with_ctes(_TRADE, _ADJACENCY, _ROWS, _EDGES, select=_SELECT_EDGES),
    "graph_vertices": sql.with_ctes(_TRADE, _ADJACENCY, _ROWS, _VERTICES, select=_SELECT_VERTICES),
    "ego_graph": sql.with_ctes(_TRADE, _ADJACENCY, _EGO_ROWS, _EDGES, select=_SELECT_EDGES),
    "ego_graph_vertices": sql.with_ctes(_TRADE, _ADJACENCY, _EGO_ROWS, _VERTICES, select=_SELECT_VERTICES),
    "top_domains": sql.with_ctes(_TRADE, _TOP, select="SELECT domain, in_links, pos FROM top"),
    "top_domain_graph": sql.with_ctes(
        _TRADE,
        _ADJACENCY,
        _TOP,
        _TOP_ROWS,
        _EDGES,
        select=f"""{_SELECT_EDGES}
WHERE "from" IN (SELECT domain FROM top) AND "to" IN (SELECT domain FROM top)""",
    ),
    "top_domain_graph_vertices": sql.with_ctes(
        _TRADE,
        _ADJACENCY,
        _TOP,
        _TOP_ROWS,
        _VERTICES,
        select=f"{_SELECT_VERTICES} WHERE id IN (SELECT domain FROM top)",
    ),
    "export_graph_json": sql.with_ctes(
        _TRADE,
        _ADJACENCY,
        _ROWS,
        _EDGES,
        _VERTICES,
        select="""
SELECT 'vertex' AS kind, '{"id":"' || id || '","label":"' || label || '","color":"' || color || '","size":' || size || '}' AS json
FROM vertices
UNION ALL
SELECT 'edge', '{"from":"' || "from" || '","to":"' || "to" || '","width":' || width || ',"arrows":"to"}' FROM edges""",
    ),
}
