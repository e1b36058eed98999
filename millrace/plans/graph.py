"""A graph made from customers, suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph as g
from ..scratch import scratch_folder, written
from ..session import table
from ..sources import keyed
from . import Catalogue

catalogue = Catalogue()

_NODES = """raw AS (
  SELECT lower(c_name) AS text, 'CUSTOMER' AS label FROM customer UNION ALL SELECT lower(s_name), 'SUPPLIER' FROM supplier
  UNION ALL SELECT lower(n_name), 'NATION' FROM nation UNION ALL SELECT lower(r_name), 'REGION' FROM region
), nodes AS (SELECT DISTINCT md5(text || '_' || label) AS id_prop, text, label FROM raw)"""
_EDGES = f"""{_NODES}, links AS (
  SELECT md5(lower(c_name) || '_CUSTOMER') AS s, 'IN_NATION' AS k, md5(lower(n_name) || '_NATION') AS t FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT md5(lower(s_name) || '_SUPPLIER'), 'IN_NATION', md5(lower(n_name) || '_NATION') FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT md5(lower(n_name) || '_NATION'), 'IN_REGION', md5(lower(r_name) || '_REGION') FROM nation JOIN region ON r_regionkey = n_regionkey
), edges AS (SELECT DISTINCT md5(s || '_' || k || '_' || t) AS relation_id, s, k, t FROM links)"""


def _entities(spark, sf_dir):
    rows = [("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"), ("region", "r_name")]
    out = None
    for name, c in rows:
        own = table(spark, sf_dir, name).select(F.concat(F.lit(" "), F.col(c), F.lit("  ")).alias("text"), F.lit(name).alias("label"))
        out = own if out is None else out.unionByName(own)
    return out


def _nodes(spark, sf_dir):
    clean = g.clean_entities(_entities(spark, sf_dir))
    return clean.select(g.node_id(F.col("text"), F.col("label")).alias("id_prop"), "text", "label").distinct()


def _edges(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    lit = F.lit
    links = [
        c.join(n, c.c_nationkey == n.n_nationkey).select(g.node_id(F.col("c_name"), lit("customer")).alias("s"), lit("IN_NATION").alias("k"), g.node_id(F.col("n_name"), lit("nation")).alias("t")),
        s.join(n, s.s_nationkey == n.n_nationkey).select(g.node_id(F.col("s_name"), lit("supplier")).alias("s"), lit("IN_NATION").alias("k"), g.node_id(F.col("n_name"), lit("nation")).alias("t")),
        n.join(r, n.n_regionkey == r.r_regionkey).select(g.node_id(F.col("n_name"), lit("nation")).alias("s"), lit("IN_REGION").alias("k"), g.node_id(F.col("r_name"), lit("region")).alias("t")),
    ]
    rows = links[0].unionByName(links[1]).unionByName(links[2])
    return rows.select(g.relation_id(F.col("s"), F.col("k"), F.col("t")).alias("relation_id"), F.col("s").alias(g.SOURCE), F.col("t").alias(g.TARGET), F.col("k").alias("relation_type")).distinct()


@catalogue.add("kg_ids", f"WITH {_EDGES} SELECT relation_id, s AS source_id, k AS relation_type, t AS target_id FROM edges")
def kg_ids(spark, sf_dir):
    return _edges(spark, sf_dir).select("relation_id", F.col(g.SOURCE).alias("source_id"), "relation_type", F.col(g.TARGET).alias("target_id"))


@catalogue.add("kg_clean_triples", "SELECT lower(c_name) AS head, 'CUSTOMER' AS head_label, 'HAS_SEGMENT' AS kind, lower(c_mktsegment) AS tail, 'SEGMENT' AS tail_label FROM customer WHERE c_custkey % 3 <> 0")
def kg_clean_triples(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), "c_name").alias("head_entity_text"), F.lit("customer").alias("head_entity_label"), F.lit("has_segment").alias("relation_type"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("tail_entity_text"), F.lit("Segment").alias("tail_entity_label"),
    )
    clean = g.clean_relations(rows)
    return clean.toDF("head", "head_label", "kind", "tail", "tail_label")


@catalogue.add("kg_node_upsert", f"""WITH {_NODES}, changed AS (SELECT id_prop, text, CASE WHEN label = 'NATION' THEN 'COUNTRY' ELSE label END AS label FROM nodes WHERE label IN ('NATION', 'REGION'))
SELECT n.id_prop, n.text, coalesce(c.label, n.label) AS label FROM nodes n LEFT JOIN changed c USING (id_prop) UNION ALL SELECT md5('new'), 'new', 'NEW'""")
def kg_node_upsert(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    again = nodes.where("label in ('NATION', 'REGION')")
    first = again.withColumn("label", F.when(F.col("label") == "NATION", "COUNTRY").otherwise(F.col("label"))).withColumn("ord", F.lit(1))
    new = spark.range(1).select(F.md5(F.lit("new")).alias("id_prop"), F.lit("new").alias("text"), F.lit("NEW").alias("label"), F.lit(1).alias("ord"))
    changes = first.unionByName(again.withColumn("label", F.lit("LATE")).withColumn("ord", F.lit(2))).unionByName(new)
    return g.upserted_nodes(nodes, changes, "ord")


@catalogue.add("kg_store_upsert", f"""WITH {_EDGES}, changed AS (SELECT id_prop, text, CASE WHEN label = 'NATION' THEN 'COUNTRY' ELSE label END AS label FROM nodes WHERE label IN ('NATION', 'REGION'))
SELECT n.id_prop AS id, coalesce(c.label, n.label) AS kind FROM nodes n LEFT JOIN changed c USING (id_prop) UNION ALL SELECT md5('new'), 'NEW'
UNION ALL SELECT relation_id, k FROM edges UNION ALL SELECT md5('new edge'), 'NEW'""")
def kg_store_upsert(spark, sf_dir):
    """Nodes and edges in stored tables: put in, changed, put again as after a failure; then read back."""
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    stored_nodes = keyed.KeyedTable.create(spark, scratch_folder(spark, "nodes"), nodes.schema, ["id_prop"], 16)
    stored_edges = keyed.KeyedTable.create(spark, scratch_folder(spark, "edges"), edges.schema, ["relation_id"], 16)
    again = nodes.where("label in ('NATION', 'REGION')")
    late = again.withColumn("label", F.when(F.col("label") == "NATION", "COUNTRY").otherwise(F.col("label"))).withColumn("ord", F.lit(2))
    new = spark.range(1).select(F.md5(F.lit("new")).alias("id_prop"), F.lit("new").alias("text"), F.lit("NEW").alias("label"), F.lit(1).alias("ord"))
    changes = again.withColumn("label", F.lit("EARLY")).withColumn("ord", F.lit(1)).unionByName(late).unionByName(new)
    more = spark.range(2).select(F.md5(F.lit("new edge")).alias("relation_id"), F.lit("a").alias(g.SOURCE), F.lit("b").alias(g.TARGET), F.lit("NEW").alias("relation_type"))
    for _ in range(2):
        stored_nodes.insert(nodes, 1)
        stored_nodes.upsert(changes, 2, "ord")
        stored_edges.insert(edges, 1)
        stored_edges.insert(edges.withColumn("relation_type", F.lit("IGNORED")).unionByName(more), 2)
    return stored_nodes.read().select(F.col("id_prop").alias("id"), F.col("label").alias("kind")).unionByName(stored_edges.read().select(F.col("relation_id").alias("id"), F.col("relation_type").alias("kind")))


@catalogue.add("kg_edge_insert_ignore", f"WITH {_EDGES} SELECT relation_id, k AS relation_type FROM edges UNION ALL SELECT md5('new'), 'NEW'")
def kg_edge_insert_ignore(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    new = spark.range(2).select(F.md5(F.lit("new")).alias("relation_id"), F.lit("a").alias(g.SOURCE), F.lit("b").alias(g.TARGET), F.lit("NEW").alias("relation_type"))
    return g.added_edges(edges, edges.withColumn("relation_type", F.lit("IGNORED")).unionByName(new)).select("relation_id", "relation_type")


@catalogue.add("kg_exact_entity", f"WITH {_NODES} SELECT * FROM nodes WHERE text = 'asia' AND label = 'REGION'")
def kg_exact_entity(spark, sf_dir):
    return g.exact_entity(_nodes(spark, sf_dir), "  ASIA ", "region")


_NATION = "(SELECT lower(n_name) FROM nation WHERE n_nationkey = 8)"


def _nation(spark, sf_dir) -> tuple[str, str]:
    """A nation's text and its region's."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = n.where("n_nationkey = 8").join(r, n.n_regionkey == r.r_regionkey).select(F.lower("n_name"), F.lower("r_name")).first()
    return row[0], row[1]


@catalogue.add("kg_verify_relation", f"WITH {_EDGES} SELECT relation_id, a.text AS source_text, b.text AS target_text FROM edges JOIN nodes a ON a.id_prop = s JOIN nodes b ON b.id_prop = t WHERE k = 'IN_REGION' AND a.text = {_NATION}")
def kg_verify_relation(spark, sf_dir):
    nation, region = _nation(spark, sf_dir)
    found = g.verify_relation(_edges(spark, sf_dir), _nodes(spark, sf_dir), (nation, "NATION"), "IN_REGION", (region, "REGION"))
    return found.select("relation_id", "source_text", "target_text")


@catalogue.add("kg_neighbor_tails", f"WITH {_EDGES} SELECT b.id_prop, b.text FROM edges JOIN nodes a ON a.id_prop = s JOIN nodes b ON b.id_prop = t WHERE k = 'IN_REGION' AND a.text = {_NATION} AND b.text <> 'nowhere' ORDER BY b.text LIMIT 3")
def kg_neighbor_tails(spark, sf_dir):
    return g.neighbors(_edges(spark, sf_dir), _nodes(spark, sf_dir), (_nation(spark, sf_dir)[0], "NATION"), "IN_REGION", True, "nowhere").select("id_prop", "text")


_HEADS = f"SELECT a.id_prop, a.text FROM edges JOIN nodes a ON a.id_prop = s JOIN nodes b ON b.id_prop = t WHERE k = 'IN_REGION' AND b.text = (SELECT lower(r_name) FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 8) AND a.text <> {_NATION} ORDER BY a.text, a.id_prop LIMIT 3"


@catalogue.add("kg_neighbor_heads", f"WITH {_EDGES} {_HEADS}")
def kg_neighbor_heads(spark, sf_dir):
    nation, region = _nation(spark, sf_dir)
    return g.neighbors(_edges(spark, sf_dir), _nodes(spark, sf_dir), (region, "REGION"), "IN_REGION", False, nation).select("id_prop", "text")


def _with_vectors(spark, sf_dir):
    """Nodes of nations and regions with embeddings by their place."""
    e = table(spark, sf_dir, "embeddings").where("vec_id < 30").select("vec_id", "embedding")
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("text"), F.lit("NATION").alias("label"), F.col("n_nationkey").cast("long").alias("vec_id"))
    r = table(spark, sf_dir, "region").select(F.lower("r_name").alias("text"), F.lit("REGION").alias("label"), (F.col("r_regionkey") + 25).cast("long").alias("vec_id"))
    rows = n.unionByName(r).join(e, "vec_id")
    return rows.select(g.node_id(F.col("text"), F.col("label")).alias("id_prop"), "text", "label", "embedding")


_VECTORS = """v AS (SELECT md5(text || '_' || label) AS id_prop, text, label, CAST(embedding AS DOUBLE[]) AS e FROM (
  SELECT lower(n_name) AS text, 'NATION' AS label, n_nationkey AS vec_id FROM nation UNION ALL SELECT lower(r_name), 'REGION', r_regionkey + 25 FROM region) JOIN (SELECT vec_id, embedding FROM embeddings) USING (vec_id))"""
_PROBE = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 100)"


def _probe(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 100").first().embedding


@catalogue.add("kg_vector_topk", f"WITH {_VECTORS} SELECT id_prop, text, round(list_distance(e, {_PROBE}), 6) AS distance FROM v ORDER BY list_distance(e, {_PROBE}), id_prop LIMIT 3")
def kg_vector_topk(spark, sf_dir):
    return g.nearest_nodes(_with_vectors(spark, sf_dir), _probe(spark, sf_dir)).select("id_prop", "text", F.round("distance", 6).alias("distance"))


@catalogue.add("kg_retrieve", f"""WITH {_EDGES}, {_VECTORS}, r AS (SELECT lower(r_name) AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 8),
f AS (
  SELECT id_prop AS id, 'Entity: ' || text || ' | Label: ' || label AS content, 1.0::DOUBLE AS score, 1 AS strategy FROM v WHERE text = 'asia' AND label = 'REGION'
  UNION ALL SELECT relation_id, 'Source: ' || a.text || ' (NATION) | Relation: IN_REGION | Target: ' || b.text || ' (REGION)', 0.9, 2 FROM edges JOIN nodes a ON a.id_prop = s JOIN nodes b ON b.id_prop = t WHERE k = 'IN_REGION' AND a.text = {_NATION}
  UNION ALL SELECT id_prop, 'Entity: ' || text || ' | Label: NATION', 0.8, 3 FROM ({_HEADS})
  UNION ALL SELECT * FROM (SELECT id_prop, 'Entity: ' || text || ' | Label: ' || label, 1 / (1 + list_distance(e, {_PROBE})), 4 FROM v ORDER BY list_distance(e, {_PROBE}), id_prop LIMIT 3)
)
SELECT id, content, round(score, 6) AS score, strategy FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY strategy, score DESC, content) = 1""")
def kg_retrieve(spark, sf_dir):
    nation, region = _nation(spark, sf_dir)
    # both are read by each strategy; written once, their texts are normalised once
    edges, nodes = written(_edges(spark, sf_dir), "kg-edges"), written(_with_vectors(spark, sf_dir), "kg-nodes")
    out = g.retrieve(edges, nodes, ("ASIA", "region"), "IN_REGION", (nation, "NATION"), (region, "REGION"), _probe(spark, sf_dir))
    return out.withColumn("score", F.round("score", 6))


@catalogue.add("kg_dedupe_first", "SELECT c_nationkey, arg_min(c_custkey, c_acctbal * 100000000 + c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def kg_dedupe_first(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return g.first_rows(rows, ["c_nationkey"], [F.col("c_acctbal") * 100_000_000 + F.col("c_custkey")]).select("c_nationkey", "c_custkey")


@catalogue.add("kg_format_records", f"WITH {_EDGES} SELECT relation_id, 'Source: ' || a.text || ' (' || a.label || ') | Relation: ' || k || ' | Target: ' || b.text || ' (' || b.label || ')' AS content FROM edges JOIN nodes a ON a.id_prop = s JOIN nodes b ON b.id_prop = t")
def kg_format_records(spark, sf_dir):
    rows = g._ends(_edges(spark, sf_dir), _nodes(spark, sf_dir))
    return rows.select("relation_id", g.record_text(rows).alias("content"))


def _facts(spark, sf_dir):
    """Facts of every type, from customers and orders."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 5
    kind = F.when(k == 0, "person_project").when(k == 1, "person_idea").when(k == 2, "region_product").when(k == 3, "product_document").otherwise("region_sales_amount")
    relation = F.when(k == 0, "WORKS_ON").when(k == 1, "PROPOSED_IDEA").when(k == 2, "HAS_SALES_PRODUCT").when(k == 3, "OTHER").otherwise("HAS_SALES_AMOUNT")
    amount = F.concat(F.round("c_acctbal", 1).cast("string"), F.when(F.col("c_custkey") % 10 == 4, F.lit("万元")).otherwise(F.lit("")))
    return c.select(
        F.concat(F.lit("s"), F.col("c_nationkey")).alias("subject"), relation.alias("relation"), F.when(k == 4, amount).otherwise(F.col("c_mktsegment")).alias("object"),
        kind.alias("type"), F.when(k == 4, F.lit("2024Q1")).alias("period"), "c_custkey",
    )


_FACTS = """f AS (SELECT 's' || c_nationkey AS subject, c_mktsegment AS object, c_custkey % 5 AS k FROM customer)"""


@catalogue.add("kg_fact_nodes", f"""WITH {_FACTS} SELECT DISTINCT label, 'name' AS prop, subject AS value FROM (SELECT subject, CASE WHEN k < 2 THEN 'Person' WHEN k = 3 THEN 'Product' ELSE 'Region' END AS label FROM f)
UNION SELECT DISTINCT label, CASE WHEN label = 'Document' THEN 'id' ELSE 'name' END, object FROM (SELECT object, CASE k WHEN 0 THEN 'Project' WHEN 1 THEN 'Idea' WHEN 2 THEN 'Product' WHEN 3 THEN 'Document' END AS label FROM f WHERE k < 4)""")
def kg_fact_nodes(spark, sf_dir):
    return g.fact_nodes(_facts(spark, sf_dir))


@catalogue.add("kg_fact_edges", f"""WITH {_FACTS} SELECT DISTINCT CASE k WHEN 2 THEN 'Region' ELSE 'Person' END AS source_label, subject AS source, CASE k WHEN 0 THEN 'WORKS_ON' WHEN 1 THEN 'PROPOSED_IDEA' ELSE 'HAS_SALES_PRODUCT' END AS relation, CASE k WHEN 0 THEN 'Project' WHEN 1 THEN 'Idea' ELSE 'Product' END AS target_label, object AS target FROM f WHERE k < 3""")
def kg_fact_edges(spark, sf_dir):
    return g.fact_edges(_facts(spark, sf_dir))


@catalogue.add("amount_unit_parse", "SELECT c_custkey, round(c_acctbal, 1) AS amount, CASE WHEN c_custkey % 10 = 4 THEN '万元' END AS unit FROM customer WHERE c_custkey % 5 = 4")
def amount_unit_parse(spark, sf_dir):
    rows = _facts(spark, sf_dir).where("type = 'region_sales_amount'")
    return rows.select("c_custkey", tx.amount_and_unit(F.col("object")).alias("a")).select("c_custkey", "a.amount", "a.unit")
