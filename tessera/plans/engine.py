"""The public face of a rule graph: its tools as methods that return DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import suggestion_score, suggestion_strength, type_affinity
from tessera.operators import graph, register, search, stats


class RuleGraph:
    """rules (rule_id, rule_name, rule_type, category, entity_type, description, confidence_score, ...), dependencies (src,
    dst, dependency_type, strength), and where they are known chunks, embeddings and annotations."""

    def __init__(self, spark: SparkSession, rules: DataFrame, dependencies: DataFrame, chunks: DataFrame | None = None, embeddings: DataFrame | None = None, annotations: DataFrame | None = None):
        self.spark, self.rules, self.dependencies, self.chunks, self.embeddings, self.annotations = spark, rules, dependencies, chunks, embeddings, annotations

    def semantic_search(self, vector: list[float], k: int = 10) -> DataFrame:
        """Nearest rules by their vectors, with degrees; vec_id is the rule's id."""
        hits = search.knn(self.embeddings, vector, k)
        return hits.join(stats.with_degrees(self.rules, self.dependencies), F.col("vec_id") == F.col("rule_id"), "left").drop("vec_id").orderBy(F.desc("similarity"), "rule_id")

    def text_search(self, term: str, category: str | None = None) -> DataFrame:
        return search.text_search(self.rules, term, category)

    def execute(self, statement: str) -> DataFrame:
        """A read-only SQL statement over views rules, dependencies and, if known, chunks, embeddings, annotations.

        Spark's parser decides: only a query passes, so no statement that writes, in whatever form, and no query that runs a
        command or a Java method, or reads a path.
        """
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parseQuery(statement)
        except Exception as err:  # what the parser can't read as a query
            raise PermissionError(f"not a query: {statement[:40]}") from err
        told = plan.toString()
        if re.search(r"ScriptTransformation|'(reflect|java_method|try_reflect)\b|UnresolvedTableValuedFunction|'?UnresolvedRelation \[[^\],]+, [^\]]*[/\\]", told, re.I):
            raise PermissionError(f"not a query over the graph: {statement[:40]}")
        for name in ("rules", "dependencies", "chunks", "embeddings", "annotations"):
            df = getattr(self, name)
            if df is not None:
                df.createOrReplaceTempView(name)
        return self.spark.sql(statement)

    def graph_data(self) -> tuple[DataFrame, DataFrame]:
        return graph.projection(self.rules)

    def vertex_details(self, rule_id) -> tuple[DataFrame, DataFrame]:
        """The rule with its degrees, and its neighbours both ways."""
        return stats.with_degrees(self.rules.where(F.col("rule_id") == rule_id), self.dependencies), graph.neighbours(self.rules, self.dependencies, rule_id)

    def find_related_rules(self, rule_id) -> DataFrame:
        return graph.neighbourhood(self.rules, self.dependencies, rule_id)

    def graph_statistics(self) -> dict[str, DataFrame]:
        r, e = self.rules, self.dependencies
        return {"types": stats.count_by(r, "rule_type"), "dependency_types": stats.count_by(e, "dependency_type"), "bands": stats.confidence_bands(r), "flags": stats.flag_counts(r), "hubs": stats.hubs(r, e, 5), "isolated": stats.isolated(r, e).agg(F.count("*").alias("n"))}

    def compare_rules(self, ids: list) -> tuple[DataFrame, DataFrame]:
        """The rules with degrees, and what they share: targets, sources, category, entity."""
        return stats.with_degrees(self.rules.where(F.col("rule_id").isin(ids)), self.dependencies), graph.rule_overlap(self.rules, self.dependencies, ids)

    def resolve(self, name: str) -> DataFrame:
        """The rule of that name, else the first whose description holds it."""
        hit = self.rules.withColumn("_tier", F.when(F.col("rule_name") == name, 0).when(F.contains("description", F.lit(name)), 1)).where("_tier IS NOT NULL")
        return hit.orderBy("_tier", "rule_id").limit(1).drop("_tier")

    def find_dependency_path(self, start, goal, most: int = 6) -> DataFrame:
        return graph.path_edges(graph.simple_paths(self.dependencies, start, goal, most), self.dependencies)

    def get_source_reference(self, reference: str, k: int = 2) -> DataFrame:
        """Chunks (chunk_id, title, content) that a reference names, text cut at 3,000 characters."""
        return search.match_reference(self.chunks, reference, k).withColumn("content", F.substring("content", 1, 3000))

    def get_review_status(self) -> DataFrame:
        return register.review_counts(self.annotations)

    def cross_graph_search(self, phrase: str, k: int = 10) -> DataFrame:
        """Text hits per graph; rules need columns graph and content."""
        return search.per_group(search.cross_graph_text(self.rules, phrase), "graph", [F.desc("similarity"), F.col("rule_id")], k)

    def search_knowledge_base(self, query: str, k: int = 10) -> DataFrame:
        return search.knowledge_search(self.chunks, query, k)

    def suggest(self, vector: list[float], rule_type: str, entity: str, category: str, k: int = 5) -> DataFrame:
        """Suggested dependencies of a new rule: the 3 k nearest rules by vector, scored, the k best."""
        hits = search.knn(self.embeddings, vector, 3 * k).withColumnRenamed("vec_id", "rule_id")
        return self.suggest_connections(hits, rule_type, entity, category, k)

    def suggest_connections(self, hits: DataFrame, rule_type: str, entity: str, category: str, k: int = 5) -> DataFrame:
        """hits (rule_id, similarity) as suggested dependencies with blended score and strength."""
        r = hits.join(self.rules, "rule_id").withColumn("_affinity", type_affinity(F.lit(rule_type), "rule_type"))
        score = suggestion_score("similarity", F.col("entity_type") == entity, F.col("category") == category, F.col("rule_type") == rule_type, "_affinity")
        return r.select("rule_id", score.alias("score")).withColumn("strength", suggestion_strength("score")).orderBy(F.desc("score"), "rule_id").limit(k)
