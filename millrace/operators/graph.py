"""A property graph as two tables: nodes (id_prop, text, label[, embedding]) and edges
(relation_id, source_node_id_prop, target_node_id_prop, relation_type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors

SOURCE, TARGET = "source_node_id_prop", "target_node_id_prop"


def node_id(text: Column, label: Column) -> Column:
    """A node's id: a hash of its normalised text and its label in capitals."""
    return F.md5(F.concat_ws("_", tx.normalized_text(text), F.upper(label)))


def relation_id(source: Column, kind: Column, target: Column) -> Column:
    return F.md5(F.concat_ws("_", source, F.upper(kind), target))


def clean_entities(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Entities with normalised text and label in capitals (UNKNOWN if there is none)."""
    named = F.upper(F.coalesce(F.nullif(F.trim(F.col(label)), F.lit("")), F.lit("UNKNOWN")))
    return rows.withColumn(text, tx.normalized_text(F.col(text))).withColumn(label, named)


#: What a relation must have.
RELATION_FIELDS = ["head_entity_text", "head_entity_label", "relation_type", "tail_entity_text", "tail_entity_label"]


def clean_relations(rows: DataFrame) -> DataFrame:
    """Relations that have all fields, texts normalised, labels and types in capitals."""
    full = reduce(lambda a, b: a & b, [F.length(F.trim(F.coalesce(c, F.lit("")))) > 0 for c in RELATION_FIELDS])
    out = rows.where(full)
    for c in RELATION_FIELDS:
        out = out.withColumn(c, tx.normalized_text(F.col(c)) if c.endswith("_text") else F.upper(F.trim(c)))
    return out


def first_rows(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def upserted_nodes(nodes: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """``nodes`` with ``changes`` put in or over them; of changes with one id the first counts."""
    latest = changes.groupBy("id_prop").agg(*(F.min_by(c, order).alias(c) for c in nodes.columns if c != "id_prop"))
    return nodes.join(latest, "id_prop", "left_anti").unionByName(latest)


def added_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """``edges`` and those of ``more`` whose id is new, each once."""
    return edges.unionByName(more.dropDuplicates(["relation_id"]).join(edges, "relation_id", "left_anti"))


def exact_entity(nodes: DataFrame, text: str, label: str) -> DataFrame:
    """The node of a text and label; the text is normalised like the nodes'."""
    wanted = tx.normalized_text(F.lit(text))
    return nodes.where((F.col("text") == wanted) & (F.col("label") == label.upper())).limit(1)


def _ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both nodes' texts and labels."""
    s = nodes.select(F.col("id_prop").alias(SOURCE), F.col("text").alias("source_text"), F.col("label").alias("source_label"))
    t = nodes.select(F.col("id_prop").alias(TARGET), F.col("text").alias("target_text"), F.col("label").alias("target_label"))
    return edges.join(s, SOURCE).join(t, TARGET)


def verify_relation(edges: DataFrame, nodes: DataFrame, head: tuple[str, str], kind: str, tail: tuple[str, str]) -> DataFrame:
    """The edge that joins two nodes, given as (text, label), if there is one."""
    s, t = nodes.where((F.col("text") == head[0]) & (F.col("label") == head[1])), nodes.where((F.col("text") == tail[0]) & (F.col("label") == tail[1]))
    s = s.select(F.col("id_prop").alias(SOURCE), F.col("text").alias("source_text"), F.col("label").alias("source_label"))
    t = t.select(F.col("id_prop").alias(TARGET), F.col("text").alias("target_text"), F.col("label").alias("target_label"))
    return edges.where(F.col("relation_type") == kind).join(s, SOURCE).join(t, TARGET).orderBy("relation_id").limit(1)


def neighbors(edges: DataFrame, nodes: DataFrame, known: tuple[str, str], kind: str, known_is_head: bool, without: str | None = None, k: int = 3) -> DataFrame:
    """Nodes at the other end of a node's edges of a kind, except the one with text ``without``."""
    mine, other = (SOURCE, TARGET) if known_is_head else (TARGET, SOURCE)
    own = nodes.where((F.col("text") == known[0]) & (F.col("label") == known[1])).select(F.col("id_prop").alias(mine))
    out = edges.where(F.col("relation_type") == kind).join(own, mine).select(F.col(other).alias("id_prop"), "relation_type").join(nodes, "id_prop")
    if without is not None:
        out = out.where(F.col("text") != without)
    return out.orderBy("text", "id_prop").limit(k)


def nearest_nodes(nodes: DataFrame, query: list[float], k: int = 3) -> DataFrame:
    """Nodes by the L2 distance of their embeddings to a vector."""
    q = F.lit([float(x) for x in query]).cast("array<double>")
    return nodes.where("embedding is not null").withColumn("distance", vectors.l2(F.col("embedding"), q)).orderBy("distance", "id_prop").limit(k)


def record_text(row: DataFrame) -> Column:
    """A record as one line: a relation, an entity, or JSON cut at 100 characters."""
    has = lambda c: F.col(c) if c in row.columns else F.lit(None).cast("string")
    entity = F.coalesce(F.nullif(has("text"), F.lit("")), F.nullif(has("target_text"), F.lit("")), F.nullif(has("source_text"), F.lit("")))
    label = F.coalesce(F.nullif(has("label"), F.lit("")), F.nullif(has("target_label"), F.lit("")), F.nullif(has("source_label"), F.lit("")))
    relation = F.concat_ws(
        " | ",
        F.concat(F.lit("Source: "), has("source_text"), F.lit(" ("), F.coalesce(has("source_label"), F.lit("Entity")), F.lit(")")),
        F.concat(F.lit("Relation: "), has("relation_type")),
        F.concat(F.lit("Target: "), has("target_text"), F.lit(" ("), F.coalesce(has("target_label"), F.lit("Entity")), F.lit(")")),
    )
    single = F.concat_ws(" | ", F.concat(F.lit("Entity: "), entity), F.concat(F.lit("Label: "), label))
    plain = F.substring(F.to_json(F.struct(*(c for c in row.columns if c != "embedding"))), 1, 100)
    is_relation = has("source_text").isNotNull() & has("target_text").isNotNull() & (F.length(has("relation_type")) > 0)
    return F.when(is_relation, relation).when(entity.isNotNull(), single).otherwise(F.concat(F.lit("Retrieved KG data: "), plain))


def record_score(distance: Column, score: Column) -> Column:
    """1 / (1 + distance), else the given score, else 0.5."""
    return F.coalesce(vectors_inverse(distance), score, F.lit(0.5))


def vectors_inverse(distance: Column) -> Column:
    return F.when(distance.isNotNull(), 1 / (1 + distance))


def retrieve(edges: DataFrame, nodes: DataFrame, entity: tuple[str, str], kind: str, head: tuple[str, str], tail: tuple[str, str], query: list[float], k: int = 3) -> DataFrame:
    """Exact entity, verified relation, neighbours and nearest nodes, each id once, in that order.

    Rows (id, content, score, strategy).
    """

    def shaped(df: DataFrame, place: int, key: str, score: float | None) -> DataFrame:
        distance = F.col("distance") if "distance" in df.columns else F.lit(None).cast("double")
        return df.select(F.col(key).alias("id"), record_text(df).alias("content"), record_score(distance, F.lit(score).cast("double")).alias("score"), F.lit(place).alias("strategy"))

    found = [
        shaped(exact_entity(nodes, *entity), 1, "id_prop", 1.0),
        shaped(verify_relation(edges, nodes, head, kind, tail), 2, "relation_id", 0.9),
        shaped(neighbors(edges, nodes, head, kind, True, tail[0], k), 3, "id_prop", 0.8),
        shaped(neighbors(edges, nodes, tail, kind, False, head[0], k), 3, "id_prop", 0.8),
        shaped(nearest_nodes(nodes, query, k), 4, "id_prop", None),
    ]
    return first_rows(reduce(DataFrame.unionByName, found), ["id"], ["strategy", F.desc("score"), "content"])


#: Labels of a fact's ends by parts of its type (fixed values).
SUBJECT_LABELS = {"person_": "Person", "region_": "Region", "product_": "Product"}
OBJECT_LABELS = {"_project": "Project", "_product": "Product", "_document": "Document", "_idea": "Idea"}
#: Types of facts that are edges, with the relation they must have and the labels of their ends (fixed values).
FACT_EDGES = {
    "person_project": ("WORKS_ON", "Person", "Project"),
    "person_idea": ("PROPOSED_IDEA", "Person", "Idea"),
    "region_product": ("HAS_SALES_PRODUCT", "Region", "Product"),
    "product_document": ("RELATED_TO", "Product", "Document"),
}


def _label(kind: Column, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for part, label in reversed(labels.items()):
        out = F.when(kind.contains(part), F.lit(label)).otherwise(out)
    return out


def fact_nodes(facts: DataFrame) -> DataFrame:
    """Distinct (label, prop, value) nodes of facts (subject, relation, object, type)."""
    kind = F.coalesce(F.col("type"), F.lit(""))
    subject = facts.select(_label(kind, SUBJECT_LABELS).alias("label"), F.col("subject").alias("value"))
    other = facts.where(~kind.endswith("_amount")).select(_label(kind, OBJECT_LABELS).alias("label"), F.col("object").alias("value"))
    rows = subject.unionByName(other).where("label is not null and length(value) > 0").distinct()
    return rows.select("label", F.when(F.col("label") == "Document", "id").otherwise("name").alias("prop"), "value")


def fact_edges(facts: DataFrame) -> DataFrame:
    """Distinct edges of facts of known types that have the type's relation."""
    out = None
    for kind, (relation, s, t) in FACT_EDGES.items():
        own = facts.where((F.col("type") == kind) & (F.col("relation") == relation) & (F.length("subject") > 0) & (F.length("object") > 0))
        own = own.select(F.lit(s).alias("source_label"), F.col("subject").alias("source"), "relation", F.lit(t).alias("target_label"), F.col("object").alias("target"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def fact_amounts(facts: DataFrame) -> DataFrame:
    """Regions' sales amounts by period: (region, period, amount, unit); unreadable amounts are left out."""
    own = facts.where("type = 'region_sales_amount' and length(period) > 0")
    parsed = own.select(F.col("subject").alias("region"), "period", tx.amount_and_unit(F.col("object")).alias("a"))
    return parsed.select("region", "period", "a.amount", "a.unit").where("amount is not null")
