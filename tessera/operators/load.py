"""Property graph from extracted rules: vertices, edges, and edits of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.numeric import safe_float, safe_int
from tessera.functions.text import strip

UNCATEGORIZED = "_uncategorized_"


def relationship_rows(rel: DataFrame) -> DataFrame:
    """Relationships whose definitions stand under various names: name, definition, source_entity, target_entity,
    cardinality; the first name that has a value counts."""
    has = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rel.columns], F.lit(None).cast("string"))
    return rel.select(has("name", "relationship_name").alias("name"), has("definition", "description").alias("definition"), has("source_entity", "source").alias("source_entity"), has("target_entity", "target").alias("target_entity"), has("cardinality").alias("cardinality"))


def category_vertices(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """name, content, kind: an entity wins over a relationship of its name; of equal names one stays."""
    e = entities.select("name", F.coalesce("definition", F.lit("")).alias("content"), F.lit("entity").alias("kind"))
    r = relationships.select("name", F.coalesce("definition", F.lit("")).alias("content"), F.lit("relationship").alias("kind"))
    return e.unionByName(r).groupBy("name").agg(F.min_by("content", F.struct("kind", "content")).alias("content"), F.min("kind").alias("kind"))


def rule_vertices(rules: DataFrame) -> DataFrame:
    """rule_id, name (else the id), rule_type, content, category, confidence_score, mandatory, requires_review."""
    return rules.select(
        "rule_id", F.coalesce("rule_name", F.col("rule_id").cast("string")).alias("name"), F.coalesce("rule_type", F.lit("")).alias("rule_type"), F.coalesce("description", F.lit("")).alias("content"),
        F.coalesce("rule_type", F.lit("")).alias("category"), safe_float("confidence_score").alias("confidence_score"), F.coalesce("mandatory", F.lit(False)).alias("mandatory"), F.coalesce("requires_review", F.lit(False)).alias("requires_review"),
    )


def category_edges(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """src (rule), dst (category), dependency_type: a rule whose category is unknown goes to `_uncategorized_`."""
    c = categories.select(F.col("name").alias("dst"))
    e = rules.select(F.col("rule_id").alias("src"), "entity_or_relationship").join(c, F.col("entity_or_relationship") == F.col("dst"), "left")
    kind = F.when(F.col("dst").isNull(), "categorization_fallback").otherwise("categorization")
    return e.select("src", F.coalesce("dst", F.lit(UNCATEGORIZED)).alias("dst"), kind.alias("dependency_type"))


def relation_edges(relationships: DataFrame, categories: DataFrame) -> DataFrame:
    """src, dst, name, definition, cardinality between known categories; the others are left out."""
    c = categories.select(F.col("name").alias("k"))
    r = relationships.join(c.withColumnRenamed("k", "src"), F.col("source_entity") == F.col("src")).join(c.withColumnRenamed("k", "dst"), F.col("target_entity") == F.col("dst"))
    return r.select("src", "dst", "name", F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce("cardinality", F.lit("")).alias("cardinality"))


def dependency_edges(rules: DataFrame) -> DataFrame:
    """src, dst, dependency_type, strength of the dependencies of rules whose target is loaded too."""
    d = rules.select(F.col("rule_id").alias("src"), F.explode("dependencies").alias("d"))
    ids = rules.select(F.col("rule_id").alias("dst")).distinct()
    return d.select("src", F.col("d.depends_on_rule").alias("dst"), F.coalesce("d.dependency_type", F.lit("unknown")).alias("dependency_type"), safe_int("d.strength").alias("strength")).join(ids, "dst", "left_semi")


def nested_rules(entity_types: DataFrame) -> DataFrame:
    """Rules of the older shape: name, business_rules (array) to one row per rule with the name it stood under."""
    return entity_types.select(F.col("name").alias("entity_or_relationship"), F.explode("business_rules").alias("r")).select("entity_or_relationship", "r.*")


def all_rules(root: DataFrame, nested: DataFrame) -> DataFrame:
    """Root rules and those nested ones whose id is new."""
    return root.unionByName(nested.join(root.select("rule_id"), "rule_id", "left_anti"), allowMissingColumns=True)


def full_vertices(v: DataFrame) -> DataFrame:
    """Defaults of the full projection: name from rule_id, category from rule_type, node_type from label."""
    return v.withColumns({"name": F.coalesce("name", F.col("rule_id").cast("string"), F.lit("")), "category": F.coalesce("category", "rule_type", F.lit("")), "node_type": F.coalesce("node_type", "label")})


def add_vertices(vertices: DataFrame, new: DataFrame) -> DataFrame:
    """vertices and those of new whose name is not taken yet (in any case)."""
    fresh = new.join(vertices.select(F.lower("name").alias("_k")), F.lower("name") == F.col("_k"), "left_anti").dropDuplicates(["name"])
    return vertices.unionByName(fresh.select(*vertices.columns))


# Labels of vertices and types of rules.
LABELS = ["business_rule", "entity_category"]
RULE_TYPES = ["constraint", "eligibility", "process", "prohibition", "documentation", "validation"]


def vertex_errors(new: DataFrame, vertices: DataFrame) -> DataFrame:
    """new (name, label, content, rule_type, confidence_score as text) with errors: what keeps a row from being created, none
    for a good one. A name that a vertex has, or an earlier good row of new (by ord), is taken; names are compared as written,
    without outer blanks."""
    name, content = strip(F.coalesce("name", F.lit(""))), strip(F.coalesce("content", F.lit("")))
    score = F.col("confidence_score").try_cast("double")
    told = [
        F.when(~F.coalesce("label", F.lit("business_rule")).isin(LABELS), F.lit("label must be one of: " + ", ".join(sorted(LABELS)))),
        F.when(name == "", F.lit("name is required")),
        F.when(F.length(content) < 10, F.lit("content is required (min 10 characters)")),
        F.when((F.coalesce("label", F.lit("business_rule")) == "business_rule") & (F.coalesce("rule_type", F.lit("")) != "") & ~F.col("rule_type").isin(RULE_TYPES), F.lit("rule_type must be one of: " + ", ".join(sorted(RULE_TYPES)))),
        F.when(F.col("confidence_score").isNotNull() & (score.isNull() | F.isnan(score)), F.lit("confidence_score must be a number")).when((score < 0) | (score > 100), F.lit("confidence_score must be between 0 and 100")),
    ]
    e = new.withColumns({"_name": name, "errors": F.filter(F.array(*told), lambda x: x.isNotNull())})
    known = vertices.select(F.col("name").alias("_name")).distinct().withColumn("_there", F.lit(True))
    e = e.join(known, "_name", "left")
    good = (F.size("errors") == 0) & F.col("_there").isNull()
    turn = F.row_number().over(W.partitionBy("_name", good).orderBy("ord"))
    taken = F.col("_there").isNotNull() | (good & (turn > 1))
    exists = F.concat(F.lit("A vertex named '"), F.col("_name"), F.lit("' already exists in this graph"))
    # a taken name is only told of where all else is right
    return e.withColumn("errors", F.when((F.size("errors") == 0) & taken, F.array(exists)).otherwise(F.col("errors"))).select(*new.columns, "errors")


def create_vertices(vertices: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(created, edges, errors) of new rows (ord, name, label, content, rule_type, category, entity_or_relationship,
    confidence_score): rows as vertices (vertex_id from a hash of the name, label, name, content, category), the edge to the
    category that a row names, where vertices has it, and the rows that are refused with why."""
    checked = vertex_errors(new, vertices)
    made = checked.where(F.size("errors") == 0).withColumns({"name": strip("name"), "content": strip("content"), "label": F.coalesce("label", F.lit("business_rule"))})
    made = made.withColumn("vertex_id", F.sha2("name", 256))
    created = made.select("vertex_id", "label", "name", "content", F.coalesce("rule_type", "category", F.lit("")).alias("category"))
    cats = vertices.where("label = 'entity_category'").groupBy("name").agg(F.min("vertex_id").alias("dst"))
    named = made.select(F.col("vertex_id").alias("src"), strip(F.coalesce("entity_or_relationship", F.lit(""))).alias("_e"))
    edges = named.join(cats, named["_e"] == cats["name"]).select("src", "dst", F.lit("belongs_to_category").alias("label"), F.lit("categorization").alias("dependency_type"))
    return created, edges, checked.where(F.size("errors") > 0)


def drop_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without those of gone (node) and the edges that touch them."""
    g = gone.select("node")
    return vertices.join(g, F.col("rule_id") == F.col("node"), "left_anti"), edges.join(g, F.col("src") == F.col("node"), "left_anti").join(g, F.col("dst") == F.col("node"), "left_anti")


def reversed_edges(edges: DataFrame, picked: DataFrame) -> DataFrame:
    """edges with those of picked (src, dst) turned round."""
    p = picked.select("src", "dst").distinct().withColumn("_p", F.lit(True))
    e = edges.join(p, ["src", "dst"], "left")
    turn = F.coalesce("_p", F.lit(False))
    return e.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def edge_violations(edges: DataFrame, dependency_types: list[str]) -> DataFrame:
    """Edges that can't be loaded: unknown type, strength not 1 to 5, or a loop; with the reason."""
    why = F.when(~F.col("dependency_type").isin(dependency_types), "dependency_type").when(~F.col("strength").between(1, 5), "strength").when(F.col("src") == F.col("dst"), "loop")
    return edges.withColumn("reason", why).where("reason IS NOT NULL")


def load_graph(rules: DataFrame, entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a whole graph: entities and relationships as categories (an entity wins a clash), rules, the
    category of each rule (`_uncategorized_` where it is unknown), relations between categories, and dependencies.

    vertices: vertex_id, label, name, content. edges: src, dst, label, dependency_type, strength. Ids are text.
    """
    rel = relationship_rows(relationships)
    cats = category_vertices(entities, rel)
    known = cats.select("name")
    text = lambda c: F.col(c).cast("string").alias(c)
    belongs = category_edges(rules, known)
    spare = belongs.where(F.col("dst") == UNCATEGORIZED).select(F.col("dst").alias("vertex_id"), F.lit("entity_category").alias("label"), F.col("dst").alias("name"), F.lit("").alias("content")).distinct()
    vertices = cats.select(F.col("name").alias("vertex_id"), F.lit("entity_category").alias("label"), "name", "content")
    vertices = vertices.unionByName(spare.join(vertices.select("vertex_id"), "vertex_id", "left_anti"))
    vertices = vertices.unionByName(rule_vertices(rules).select(F.col("rule_id").cast("string").alias("vertex_id"), F.lit("business_rule").alias("label"), "name", "content"))
    kind = lambda df, label, dependency, strength: df.select(text("src"), text("dst"), F.lit(label).alias("label"), dependency.alias("dependency_type"), strength.cast("int").alias("strength"))
    none = F.lit(None)
    edges = kind(belongs, "belongs_to_category", F.col("dependency_type"), none)
    edges = edges.unionByName(kind(relation_edges(rel, known), "relates_to", F.col("name"), none))
    if "dependencies" in rules.columns:
        edges = edges.unionByName(kind(dependency_edges(rules), "depends_on", F.col("dependency_type"), F.col("strength")))
    return vertices, edges


def drop_annotations(annotations: DataFrame, gone: DataFrame) -> DataFrame:
    """annotations (vertex_id) without those of deleted vertices (node)."""
    return annotations.join(gone.select(F.col("node").alias("vertex_id")), "vertex_id", "left_anti")
