"""Obligation register: seeding, upserts, coverage, control suggestions, exports, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["graph_name", "provider", "rule_id"]
# Controls by rule type, by risk level and by words of the name: (name, type, description).
CONTROLS_BY_TYPE = {
    "compliance": [
        ("Regulatory Compliance Review", "procedure", "Periodic review of regulatory requirements against internal policies"),
        ("Compliance Training Program", "training", "Annual compliance training for all relevant staff"),
    ],
    "eligibility": [
        ("Eligibility Verification Checklist", "procedure", "Systematic verification of eligibility criteria before processing"),
        ("Automated Eligibility Screening", "technical-control", "System-enforced eligibility checks at point of entry"),
    ],
    "validation": [
        ("Data Validation Rules", "technical-control", "Automated validation rules in processing systems"),
        ("QC Sampling Procedure", "procedure", "Quality control sampling of validated records"),
    ],
    "process": [
        ("Standard Operating Procedure", "procedure", "Documented SOP covering the required process steps"),
        ("Process Audit Trail", "technical-control", "System-generated audit trail for process execution"),
    ],
    "prohibition": [
        ("Prohibited Activity Monitoring", "technical-control", "Automated monitoring and alerting for prohibited activities"),
        ("Prohibition Compliance Policy", "policy", "Written policy explicitly prohibiting the activity"),
    ],
    "calculation": [
        ("Calculation Validation Engine", "technical-control", "Automated calculation verification with audit logging"),
        ("Manual Calculation Review", "manual-control", "Secondary review of calculations exceeding threshold"),
    ],
    "documentation": [
        ("Document Retention Policy", "policy", "Document retention and accessibility requirements"),
        ("Document Completeness Checklist", "procedure", "Pre-submission checklist for required documentation"),
    ],
}
CONTROLS_BY_RISK = {
    "critical": [
        ("Executive Review & Sign-off", "manual-control", "Senior management review for critical risk items"),
        ("Independent Audit Verification", "audit", "Annual independent audit of critical compliance controls"),
    ],
    "high": [("Supervisory Review", "manual-control", "Supervisor-level review and approval")],
}
CONTROLS_BY_WORD = [
    (["appraisal", "property", "valuation"], ("Appraisal Independence Policy", "policy", "Ensures appraiser independence per FIRREA requirements")),
    (["wire", "fund", "disburs"], ("Wire Transfer Authorization", "technical-control", "Dual-authorization required for wire transfers")),
    (["aml", "suspicious", "transaction monitoring"], ("Transaction Monitoring System", "technical-control", "Automated suspicious activity detection and SAR filing")),
]


def upsert(register: DataFrame, incoming: DataFrame, kept: tuple[str, ...] = ("status", "notes")) -> DataFrame:
    """register after incoming: new keys are added, known ones take incoming values but keep their own `kept` columns."""
    r, i = register.alias("r"), incoming.alias("i")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"i.{k}")) for k in KEY]
    pick = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s in (("r", "i") if c in kept else ("i", "r")))).alias(c)
    return r.join(i, on, "full").select(*[pick(c) for c in register.columns])


def seed_counts(register: DataFrame, incoming: DataFrame) -> DataFrame:
    """created and existing: incoming keys that the register lacks or has."""
    known = incoming.join(register.select(*KEY, F.lit(1).alias("_k")), KEY, "left")
    return known.agg(F.count_if(F.col("_k").isNull()).alias("created"), F.count_if(F.col("_k").isNotNull()).alias("existing"))


def with_status(register: DataFrame, changes: DataFrame) -> DataFrame:
    """register with the status of changes (keys, status)."""
    c = changes.select(*KEY, F.col("status").alias("_s"))
    return register.join(c, KEY, "left").withColumn("status", F.coalesce("_s", "status")).drop("_s").select(*register.columns)


def heatmap(register: DataFrame) -> DataFrame:
    """facet, value, status, n for rule_type and risk_level, and totals by status; null and empty are one `unknown`.
    One pass by grouping sets."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    r = register.select(known("status"), known("rule_type"), known("risk_level"))
    n = r.groupingSets([["status"], ["status", "rule_type"], ["status", "risk_level"]], "status", "rule_type", "risk_level").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 1, "rule_type").when(F.col("g") == 2, "risk_level").otherwise("all")
    return n.select(facet.alias("facet"), F.coalesce("rule_type", "risk_level", F.lit("all")).alias("value"), "status", "n")


def compliance_score(register: DataFrame) -> DataFrame:
    """total, mapped, partial, score: percent of obligations mapped, half for partly mapped ones, one decimal."""
    c = register.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "mapped").alias("mapped"), F.count_if(F.col("status") == "partially_mapped").alias("partial"))
    return c.withColumn("score", F.round((F.col("mapped") + F.col("partial") * 0.5) / F.greatest("total", F.lit(1)) * 100, 1))


def suggestions(register: DataFrame) -> DataFrame:
    """rule_id, ord, control_name, control_type, description: by type, then risk, then words of the name; the first of a name counts."""
    pair = lambda c: F.struct(F.lit(c[0]).alias("control_name"), F.lit(c[1]).alias("control_type"), F.lit(c[2]).alias("description"))
    none = F.array().cast("array<struct<control_name:string,control_type:string,description:string>>")
    parts = [F.when(F.lower("rule_type") == k, F.array(*map(pair, v))).otherwise(none) for k, v in CONTROLS_BY_TYPE.items()]
    parts += [F.when(F.lower("risk_level") == k, F.array(*map(pair, v))).otherwise(none) for k, v in CONTROLS_BY_RISK.items()]
    parts += [F.when(F.regexp_like(F.lower("rule_name"), F.lit("|".join(w))), F.array(pair(c))).otherwise(none) for w, c in CONTROLS_BY_WORD]
    return register.select("rule_id", F.posexplode(F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts]))).alias("ord", "c")).select("rule_id", "ord", "c.*")


def with_controls(register: DataFrame, controls: DataFrame) -> DataFrame:
    """register with controls, an array of (control_name, control_type); empty where there are none."""
    c = controls.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("control_name", "control_type"))).alias("controls"))
    return register.join(c, "rule_id", "left").withColumn("controls", F.coalesce("controls", F.array().cast("array<struct<control_name:string,control_type:string>>")))


def export(register: DataFrame) -> DataFrame:
    """One row per control, blanks where a rule has none."""
    out = register.select("*", F.explode_outer("controls").alias("_c")).drop("controls")
    return out.select(*[c for c in out.columns if c != "_c"], F.coalesce("_c.control_name", F.lit("")).alias("control_name"), F.coalesce("_c.control_type", F.lit("")).alias("control_type"))


def filtered(register: DataFrame, status=None, risk=None, rule_type=None, jurisdiction=None, mandatory=None, search=None) -> DataFrame:
    out = register
    for name, v in (("status", status), ("risk_level", risk), ("rule_type", rule_type), ("jurisdiction", jurisdiction)):
        out = out.where(F.col(name) == v) if v is not None else out
    if mandatory is not None:
        out = out.where(F.coalesce("mandatory", F.lit(True)) == mandatory)
    return out.where(F.contains(F.lower(F.concat_ws(" ", "rule_id", "rule_name")), F.lit(search.lower()))) if search else out


def merge_annotations(old: DataFrame, new: DataFrame, key: str = "vertex_id") -> DataFrame:
    """old with the values that new supplies; what new leaves null stays."""
    o, n = old.alias("o"), new.alias("n")
    pick = [F.coalesce(*([F.col(f"n.{c}")] if c in new.columns else []), F.col(f"o.{c}")).alias(c) for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*pick)


def review_counts(annotations: DataFrame) -> DataFrame:
    """Tri-state answers: yes, no, or null for none yet; deleted rows don't count."""
    a = annotations.where(~F.coalesce("deleted", F.lit(False)))
    yes = lambda c, v="yes": F.count_if(F.col(c) == v)
    return a.agg(yes("reviewed").alias("reviewed"), yes("approved").alias("approved"), F.count_if(F.col("reviewed").isNull()).alias("needs_review"), F.count_if((F.col("reviewed") == "yes") & F.col("approved").isNull()).alias("needs_approval"))


def drift(live: DataFrame, files: DataFrame) -> DataFrame:
    """graph, live, filed, drifted: rule counts of loaded graphs against those of their files."""
    a, b = live.groupBy("graph").agg(F.count("*").alias("live")), files.groupBy("graph").agg(F.count("*").alias("filed"))
    return a.join(b, "graph", "full").fillna(0).withColumn("drifted", F.col("live") != F.col("filed"))


def named_annotations(annotations: DataFrame, vertices: DataFrame) -> DataFrame:
    """Annotations that aren't deleted, with the name of their vertex, or `vertex:<id>`."""
    a = annotations.where(~F.coalesce("deleted", F.lit(False)))
    v = vertices.select("vertex_id", F.col("name").alias("vertex_name"))
    return a.join(v, "vertex_id", "left").withColumn("vertex_name", F.coalesce("vertex_name", F.concat(F.lit("vertex:"), F.col("vertex_id").cast("string"))))


def orphaned_annotations(annotations: DataFrame, vertices: DataFrame) -> DataFrame:
    """Annotations of vertices that no graph has."""
    return annotations.join(vertices.select("vertex_id"), "vertex_id", "left_anti")


def consistency(graphs: DataFrame, embeddings: DataFrame, annotations: DataFrame, vertices: DataFrame, rules: DataFrame) -> DataFrame:
    """check, subject, ok, detail: rules per graph, index freshness, orphaned annotations, share of verified references."""
    from tessera.operators.search import fresh

    n = graphs.select(F.lit("graph").alias("check"), F.col("graph").alias("subject"), (F.col("rules") > 0).alias("ok"), F.col("rules").cast("string").alias("detail"))
    f = fresh(embeddings, vertices).select(F.lit("embeddings"), "graph", "fresh", F.concat_ws("/", F.col("embeddings").cast("string"), F.col("vertices").cast("string")))
    o = orphaned_annotations(annotations, vertices).agg(F.count("*").alias("n")).select(F.lit("annotations"), F.lit("all"), F.col("n") == 0, F.col("n").cast("string"))
    share = F.count_if("reference_verified") / F.greatest(F.count("*"), F.lit(1))
    r = rules.groupBy("graph").agg(share.alias("s")).select(F.lit("references"), "graph", F.col("s") >= 0.75, F.format_number("s", 2))
    return n.union(f).union(o).union(r)


def reconciled_runs(runs: DataFrame, alive: DataFrame) -> DataFrame:
    """runs with those that are running, but not among the alive ones, failed."""
    a = alive.select("run_id", F.lit(True).alias("_alive")).distinct()
    r = runs.join(a, "run_id", "left")
    return r.withColumn("status", F.when((F.col("status") == "running") & F.col("_alive").isNull(), "failed").otherwise(F.col("status"))).drop("_alive")


def publish(rows: DataFrame, path: str, accept) -> bool:
    """Write rows beside path, look at them again with accept(DataFrame) -> bool, and only then put them in its place; else
    what was there stays. True if published."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged, old = f"{path}.staged", f"{path}.old"
    rows.write.mode("overwrite").parquet(staged)
    if not accept(spark.read.parquet(staged)):
        fs.delete(hadoop(staged), True)
        return False
    fs.delete(hadoop(old), True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    if not fs.rename(hadoop(staged), hadoop(path)):
        fs.rename(hadoop(old), hadoop(path))
        return False
    fs.delete(hadoop(old), True)
    return True


def obligation_stats(register: DataFrame) -> DataFrame:
    """facet, value, n: mandatory obligations (unknown counts as such), those with an effective date, and obligations by
    jurisdiction and by audit frequency (`unknown` for none)."""
    flags = register.agg(F.count_if(F.coalesce("mandatory", F.lit(True))).alias("m"), F.count_if(F.coalesce(F.col("effective_date").cast("string"), F.lit("")) != "").alias("d"))
    flags = flags.select(F.explode(F.array(F.struct(F.lit("mandatory").alias("facet"), F.lit("yes").alias("value"), F.col("m").alias("n")), F.struct(F.lit("effective_date").alias("facet"), F.lit("known").alias("value"), F.col("d").alias("n")))).alias("f")).select("f.*")
    by = lambda c: register.groupBy(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return flags.unionByName(by("jurisdiction")).unionByName(by("audit_frequency"))


def add_controls(controls: DataFrame, new: DataFrame) -> DataFrame:
    """controls (rule_id, control_name, control_type) and those of new whose rule has none of that name yet, one of each."""
    key = ["rule_id", "control_name"]
    return controls.unionByName(new.dropDuplicates(key).join(controls.select(*key), key, "left_anti").select(*controls.columns))


def remove_controls(controls: DataFrame, gone: DataFrame) -> DataFrame:
    return controls.join(gone.select("rule_id", "control_name"), ["rule_id", "control_name"], "left_anti")


def reset(register: DataFrame, controls: DataFrame, graph_name: str) -> tuple[DataFrame, DataFrame]:
    """register without the obligations of a graph, and controls without those of rules that are left in none."""
    kept = register.where(~F.col("graph_name").eqNullSafe(graph_name))
    return kept, controls.join(kept.select("rule_id").distinct(), "rule_id", "left_semi")


def put_runs(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """runs with those of changes: new ids are added, known ones take the values that changes supplies."""
    return merge_annotations(runs, changes, "run_id")


def drop_runs(runs: DataFrame, gone: DataFrame) -> DataFrame:
    return runs.join(gone.select("run_id"), "run_id", "left_anti")


def filtered_items(items: DataFrame, **values) -> DataFrame:
    """Rows whose columns have the given values; None asks for nothing."""
    for name, v in values.items():
        items = items.where(F.col(name) == v) if v is not None else items
    return items
