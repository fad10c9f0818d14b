"""Counts, distributions and degrees over rules and dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def known(c: str) -> Column:
    """Lower case; null and empty are `unknown`."""
    return F.coalesce(F.nullif(F.lower(c), F.lit("")), F.lit("unknown"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, degree; a self-loop counts twice in degree. One pass over both endpoints."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum(1 - F.col("e.o")).alias("in_degree"), F.count("*").alias("degree"))


def with_degrees(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """rules with degrees, 0 where there are no edges."""
    d = degrees(edges)
    out = rules.join(d, rules["rule_id"] == d["node"], "left").drop("node")
    return out.fillna(0, ["out_degree", "in_degree", "degree"])


def hubs(rules: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """The rules of highest degree, ties to the smaller id: degrees are counted before names are joined."""
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(limit)
    found = rules.join(F.broadcast(top) if limit <= 100_000 else top, rules["rule_id"] == top["node"]).select("rule_id", "rule_name", "out_degree", "in_degree", "degree")
    return found.orderBy(F.desc("degree"), "rule_id").limit(limit)


def isolated(rules: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("rule_id")).union(edges.select("dst"))
    return rules.join(ends, "rule_id", "left_anti")


def categories(rules: DataFrame, known_categories: DataFrame) -> DataFrame:
    """rule_count of each known category, 0 included."""
    n = rules.groupBy("category").agg(F.count("*").alias("rule_count"))
    return known_categories.join(n, "category", "left").fillna(0, ["rule_count"])


def confidence_bands(rules: DataFrame) -> DataFrame:
    """high: above 90; medium: between 70 and 90.01, both excluded, so up to 90.01 counts in both; low: 70 and less."""
    c = F.col("confidence_score")
    return rules.agg(F.count_if(c > 90).alias("high"), F.count_if((c > 70) & (c < 90.01)).alias("medium"), F.count_if(c <= 70).alias("low"))


def confidence_histogram(rules: DataFrame, width: int = 5) -> DataFrame:
    low = (F.floor(F.col("confidence_score") / width) * width).cast("int")
    return rules.where("confidence_score IS NOT NULL").groupBy(low.alias("low")).agg(F.count("*").alias("n")).select(F.concat_ws("-", F.col("low").cast("string"), (F.col("low") + width).cast("string")).alias("bucket"), "n")


def confidence_summary(rules: DataFrame) -> DataFrame:
    """Null counts as 0 in mean, least and most; mean over positive scores; low: above 0 and under 70."""
    c = F.coalesce("confidence_score", F.lit(0.0))
    return rules.agg(F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(F.when(c > 0, c)).alias("mean_scored"), F.count_if((c > 0) & (c < 70)).alias("low"))


def flag_counts(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count_if("mandatory").alias("mandatory"), F.count_if("requires_review").alias("review"), F.count_if(~F.col("mandatory")).alias("optional"), F.count("*").alias("rules"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """n and rounded percentage of each value; halves go up."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select(key, "n", F.floor(F.col("n") * 100 / F.col("total") + 0.5).cast("long").alias("percent"))


def size_stats(sizes: DataFrame, column: str, small: int = 500, large: int = 2000) -> DataFrame:
    """Least, most, floor mean, upper median and deciles by rank, and counts under and over limits.

    Ranks come from counts per distinct size, so no group of rows is gathered.
    """
    n = sizes.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("c"))
    upto = n.withColumn("upto", F.sum("c").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(W.partitionBy()))
    at = lambda q: F.when(F.col("total") >= 10, F.floor(F.col("total") * q)).cast("long")
    rank = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    return upto.agg(
        F.min("v").alias("least"), F.max("v").alias("most"), F.floor(F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        rank(F.floor(F.col("total") / 2)).alias("median"),
        F.coalesce(rank(at(0.1)), F.min("v")).alias("p10"), F.coalesce(rank(at(0.9)), F.max("v")).alias("p90"),
        F.coalesce(F.sum(F.when(F.col("v") < small, F.col("c"))), F.lit(0)).alias("under"), F.coalesce(F.sum(F.when(F.col("v") > large, F.col("c"))), F.lit(0)).alias("over"),
    )


def connectivity(rules: DataFrame, limit: int = 10) -> DataFrame:
    """Rules of most dependencies and dependents, from their arrays; null arrays count 0."""
    n = F.coalesce(F.size("dependencies"), F.lit(0)) + F.coalesce(F.size("dependent_rules"), F.lit(0))
    return rules.select("rule_id", F.greatest(n, F.lit(0)).alias("connectivity")).orderBy(F.desc("connectivity"), "rule_id").limit(limit)


def term_thresholds(rules: DataFrame, terms: list[str]) -> DataFrame:
    """Terms that several rules give unlike numbers for: term, rules, thresholds (sorted)."""
    from tessera.functions.text import numbers

    t = F.explode(F.filter(F.array(*[F.lit(x) for x in terms]), lambda x: F.contains(F.lower(F.col("description")), x))).alias("term")
    hit = rules.withColumn("numbers", numbers("description")).where(F.size("numbers") > 0).select("rule_id", "numbers", t)
    got = hit.select("term", "rule_id", F.explode("numbers").alias("number")).groupBy("term").agg(F.count_distinct("rule_id").alias("rules"), F.sort_array(F.collect_set("number")).alias("thresholds"))
    return got.where((F.col("rules") > 1) & (F.size("thresholds") > 1))


def entity_coverage(rules: DataFrame) -> DataFrame:
    """entity, n: rules by entity or relationship, else entity type, else `Unknown`; empty counts as missing."""
    named = [F.nullif(F.col(c), F.lit("")) for c in ("entity_or_relationship", "entity_type") if c in rules.columns]
    return rules.groupBy(F.coalesce(*named, F.lit("Unknown")).alias("entity")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values of a column with their counts, ties in order of the value; null and empty are left out."""
    n = df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(column).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), column).limit(k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values of a column, sorted; null and empty are left out."""
    return df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").select(column).distinct().orderBy(column)


def graph_totals(per_graph: DataFrame) -> DataFrame:
    """Sums over all graphs of every number column, and how many graphs there are."""
    numbers = [c for c, kind in per_graph.dtypes if kind in ("int", "bigint", "double", "float") and c != "graph"]
    return per_graph.agg(F.count("*").alias("graphs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers])


def domain_groups(graphs: DataFrame) -> DataFrame:
    """domain, graphs (sorted), n: graphs by their domain, `Other` for none."""
    return graphs.groupBy(F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("Other")).alias("domain")).agg(F.sort_array(F.collect_set("graph")).alias("graphs"), F.count("*").alias("n"))


def verification_counts(rules: DataFrame) -> DataFrame:
    """mandatory, review, verified and unverified; what is not known counts as not so."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return rules.agg(yes("mandatory").alias("mandatory"), yes("requires_review").alias("review"), yes("reference_verified").alias("verified"), (F.count("*") - yes("reference_verified")).alias("unverified"))


def labelled_nodes(vertices: DataFrame, edges: DataFrame, least: int = 5) -> DataFrame:
    """vertices (node, label) that a drawing names: categories, and nodes of `least` edges or more."""
    d = degrees(edges).select("node", "degree")
    return vertices.join(d, "node", "left").fillna(0, ["degree"]).where((F.col("label") == "entity_category") | (F.col("degree") >= least))


def rule_table(rules: DataFrame, text: str | None = None, rule_type: str | None = None, entity: str | None = None, sort: str = "rule_id", descending: bool = False, page: int = 1, size: int = 25) -> DataFrame:
    """A page of the rules whose name, description or id holds text (in any case), of a type and an entity, in order of a
    column (missing first, as the empty text), ties by id. A page beyond the last is the last."""
    out = rules
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "rule_name", "description", F.col("rule_id").cast("string"))), F.lit(text.lower())))
    for c, v in (("rule_type", rule_type), ("entity_type", entity)):
        out = out.where(F.col(c) == v) if v else out
    pages = max(1, -(-out.count() // size))
    key = F.coalesce(F.col(sort), F.lit("")) if dict(rules.dtypes)[sort] == "string" else F.col(sort)
    order = [key.desc() if descending else key.asc(), F.col("rule_id").asc()]
    return out.orderBy(*order).offset((min(max(page, 1), pages) - 1) * size).limit(size)


def orphan_rate(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """rules, orphans (in no dependency) and their share in percent (one decimal); one row, 0 for no rules."""
    ends = edges.select(F.col("src").alias("rule_id")).union(edges.select("dst")).distinct().withColumn("_in", F.lit(True))
    n = rules.select("rule_id").join(ends, "rule_id", "left").agg(F.count("*").alias("rules"), F.count_if(F.col("_in").isNull()).alias("orphans"))
    return n.withColumn("percent", F.round(F.col("orphans") * 100 / F.greatest("rules", F.lit(1)), 1))
