"""Rule-graph views over the given tables, and the same views as SQL text for the oracle.

rules come from part, dependencies from successive parts of an order, documents of even and odd doc_id make two graphs,
orders make the obligation register, events the run log. All views cover whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TYPES = ["constraint", "eligibility", "process", "prohibition", "documentation", "validation"]
RISKS = ["critical", "high", "medium", "low"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(names: list[str], at) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (at + 1).cast("int"))


def rules(spark: SparkSession, d: str) -> DataFrame:
    """rule_id, rule_name, rule_type, rule_behavior (null), category, entity_type, description, confidence_score,
    risk_level, mandatory, requires_review."""
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("rule_id"),
        F.col("p_name").alias("rule_name"),
        _pick(TYPES, size % 6).alias("rule_type"),
        F.col("p_brand").alias("category"),
        F.lower("p_type").alias("entity_type"),
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("description"),
        (size * 2.0).alias("confidence_score"),
        _pick(RISKS, size % 4).alias("risk_level"),
        (size % 3 == 0).alias("mandatory"),
        (size * 2.0 < 70).alias("requires_review"),
    )


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, dependency_type, strength: each kind of edge once, with its greatest strength."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    kind = F.when(F.col("l_returnflag") == "N", "prerequisite").when(F.col("l_returnflag") == "A", "complementary").otherwise("override")
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), kind.alias("dependency_type"), (F.col("l_linenumber") % 5 + 1).alias("s"))
    return e.where("dst IS NOT NULL").groupBy("src", "dst", "dependency_type").agg(F.max("s").cast("int").alias("strength"))


def graph_rules(spark: SparkSession, d: str, told=lambda rules: rules) -> DataFrame:
    """Rules of two graphs: graph (1 for even, 2 for odd ids), rule_id, behavior, text, quality (null without label). told is
    done to them before the labels are joined, so what it leaves out is not shuffled."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, d, "documents").select((F.col("doc_id") % 2 + 1).cast("int").alias("graph"), F.col("doc_id").alias("rule_id"), F.col("lang").alias("behavior"), "text")
    docs = told(docs)
    return docs.join(labels, docs["rule_id"] == labels["doc_id"], "left").drop("doc_id")


def obligations(spark: SparkSession, d: str) -> DataFrame:
    """rule_id, status, risk_level (null for the lowest), rule_type, jurisdiction."""
    status = F.when(F.col("o_orderstatus") == "O", "mapped").when(F.col("o_orderstatus") == "F", "unmapped").otherwise("partially_mapped")
    p = F.substring("o_orderpriority", 1, 1)
    risk = F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").when(p == "4", "low")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("rule_id"), status.alias("status"), risk.alias("risk_level"), _pick(TYPES, F.col("o_custkey") % 6).alias("rule_type"), F.year("o_orderdate").cast("string").alias("jurisdiction"), (F.col("o_custkey") % 3 == 0).alias("mandatory"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ord, content: lines of documents that are not blank, numbered from 0 with the blank ones counted."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "content"))
    return lines.where(F.trim("content") != "")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """run_id, id, ts, line, value: the events of a user as the log of a run."""
    step = F.when(F.col("event_type") == "purchase", F.concat(F.lit("Step "), F.col("event_id") % 3 + 1, F.lit(" completed"))).when(F.col("event_type") == "error", F.lit("ERROR in agent")).when(F.col("event_type") == "signup", F.lit("WARNING: slow")).otherwise(F.concat(F.lit("Step "), F.col("event_id") % 3 + 1, F.lit(" running")))
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("id"), "ts", step.alias("line"), "value")


SQL = {
    "rules": """rules AS (
  SELECT p_partkey AS rule_id, p_name AS rule_name, ['constraint', 'eligibility', 'process', 'prohibition', 'documentation', 'validation'][p_size % 6 + 1] AS rule_type,
    p_brand AS category, lower(p_type) AS entity_type, p_name || ' ' || lower(p_type) AS description, CAST(p_size AS DOUBLE) * 2.0 AS confidence_score,
    ['critical', 'high', 'medium', 'low'][p_size % 4 + 1] AS risk_level, p_size % 3 = 0 AS mandatory, p_size * 2.0 < 70 AS requires_review FROM part)""",
    "dependencies": """dependencies AS (
  SELECT src, dst, CASE f WHEN 'N' THEN 'prerequisite' WHEN 'A' THEN 'complementary' ELSE 'override' END AS dependency_type, CAST(max(s) AS INTEGER) AS strength FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag) AS dst, l_returnflag AS f, l_linenumber % 5 + 1 AS s FROM lineitem)
  WHERE dst IS NOT NULL GROUP BY 1, 2, 3)""",
    "graph_rules": """graph_rules AS (
  SELECT CAST(d.doc_id % 2 + 1 AS INTEGER) AS graph, d.doc_id AS rule_id, lang AS behavior, text, quality FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)""",
    "obligations": """obligations AS (
  SELECT o_orderkey AS rule_id, CASE o_orderstatus WHEN 'O' THEN 'mapped' WHEN 'F' THEN 'unmapped' ELSE 'partially_mapped' END AS status,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' END AS risk_level,
    ['constraint', 'eligibility', 'process', 'prohibition', 'documentation', 'validation'][o_custkey % 6 + 1] AS rule_type, CAST(year(o_orderdate) AS VARCHAR) AS jurisdiction, o_custkey % 3 = 0 AS mandatory FROM orders)""",
    "chunks": """chunks AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, parts[i] AS content FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
  WHERE trim(parts[i], ' ') <> '')""",
    "log_lines": """log_lines AS (
  SELECT user_id AS run_id, event_id AS id, ts, CASE event_type WHEN 'purchase' THEN 'Step ' || (event_id % 3 + 1) || ' completed' WHEN 'error' THEN 'ERROR in agent' WHEN 'signup' THEN 'WARNING: slow' ELSE 'Step ' || (event_id % 3 + 1) || ' running' END AS line, value FROM events)""",
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """body over the named views."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(SQL[v] for v in views.split()) + ("\n" if body.lstrip().upper().startswith(("SELECT", "FROM")) else ",\n") + body
