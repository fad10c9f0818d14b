"""Registered queries of rule records, registers, annotations, references and sections: whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as T
from tessera.operators import graph, impact, match, register, search, segment, validate
from tessera.plans import adaptor as A
from tessera.plans.adaptor import sql
from tessera.plans.catalog import query
from tessera.streaming import logs

# ---- findings about rule records made of orders: some fields are missing, some hold what they may not

RECORDS = """r AS (SELECT o_orderkey + 1 AS rule_id, lower(split_part(o_orderpriority, '-', 2)) AS risk, CASE o_orderstatus WHEN 'O' THEN 'annually' WHEN 'F' THEN 'weekly' END AS audit,
  o_orderkey % 7 <> 0 AS scoped, o_custkey % 5 <> 0 AS loans, o_custkey % 3 <> 0 AS occupancy, o_orderkey % 11 <> 0 AS referred, o_custkey % 7 - 1 AS a, o_orderkey % 9 - 1 AS b, o_orderkey % 8 AS n,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey % 101 AS DOUBLE) END AS confidence FROM orders)"""
FINDINGS = """f AS (SELECT rule_id, 'completeness' AS "check", 'high' AS severity, 'Missing required fields: ' || concat_ws(', ', 'rule_name', 'rule_behavior', 'rule_domain', 'description', 'conditions', 'consequences',
    CASE WHEN NOT referred THEN 'source_reference' END, 'mandatory', 'examples', 'jurisdiction', 'enforcement_action', CASE WHEN NOT scoped THEN 'applicability_scope' END, 'data_points_required', CASE WHEN audit IS NULL THEN 'audit_frequency' END,
    'effective_date (nullable but must be present)', 'expiration_date (nullable but must be present)', 'superseded_by (nullable but must be present)') AS issue FROM r
  UNION ALL SELECT rule_id, 'confidence', 'medium', 'Missing confidence score' FROM r WHERE confidence IS NULL
  UNION ALL SELECT rule_id, 'confidence', 'high', 'Low confidence score' FROM r WHERE confidence < 70
  UNION ALL SELECT rule_id, 'enum_validation', 'medium', 'Invalid risk_level ''' || risk || '''' FROM r WHERE risk NOT IN ('critical', 'high', 'medium', 'low')
  UNION ALL SELECT rule_id, 'enum_validation', 'medium', 'Invalid audit_frequency ''weekly''' FROM r WHERE audit = 'weekly'
  UNION ALL SELECT rule_id, 'scope_validation', 'medium', 'applicability_scope missing or invalid ''loan_types'' array' FROM r WHERE scoped AND NOT loans
  UNION ALL SELECT rule_id, 'scope_validation', 'medium', 'applicability_scope missing or invalid ''occupancy_types'' array' FROM r WHERE scoped AND NOT occupancy
  UNION ALL SELECT rule_id, 'source_reference_positions', 'medium', 'start_word_position must be a non-negative integer' FROM r WHERE referred AND a < 0
  UNION ALL SELECT rule_id, 'source_reference_positions', 'medium', 'end_word_position must be a positive integer' FROM r WHERE referred AND b <= 0
  UNION ALL SELECT rule_id, 'source_reference_positions', 'high', 'start must be less than end' FROM r WHERE referred AND a >= b
  UNION ALL SELECT rule_id, 'source_reference_text', 'medium', 'source_text is missing or too short (< 5 words)' FROM r WHERE referred AND n < 5)"""


def _records(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    some = lambda m: F.when(c % m != 0, F.array(F.lit("any")))
    scope = F.struct(some(5).alias("loan_types"), some(3).alias("occupancy_types"), F.array(F.lit("any")).alias("transaction_types"))
    ref = F.struct((c % 7 - 1).cast("int").alias("start_word_position"), (k % 9 - 1).cast("int").alias("end_word_position"), F.repeat(F.lit("word "), (k % 8).cast("int")).alias("source_text"))
    audit = F.when(F.col("o_orderstatus") == "O", "annually").when(F.col("o_orderstatus") == "F", "weekly")
    return A.table(s, d, "orders").select(
        (k + 1).alias("rule_id"), F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("risk_level"), audit.alias("audit_frequency"),
        F.when(k % 7 != 0, scope).alias("applicability_scope"), F.when(k % 11 != 0, ref).alias("source_reference"), F.when(k % 13 != 0, (c % 101).cast("double")).alias("confidence_score"),
    )


@query(f"WITH {RECORDS}, {FINDINGS} SELECT * FROM f")
def rule_findings(s, d):
    return validate.findings(_records(s, d))


@query(f'WITH {RECORDS}, {FINDINGS} SELECT "check", severity, count(*) AS n, count(DISTINCT rule_id) AS rules, (SELECT avg(coalesce(confidence, 0)) FROM r) AS mean_confidence FROM f GROUP BY 1, 2')
def finding_summary(s, d):
    r = _records(s, d)
    return validate.summary(r, validate.findings(r))


# ---- the obligation register

@query(sql("obligations", """r AS (SELECT jurisdiction AS graph_name, rule_type AS provider, rule_id, status, CASE WHEN rule_id % 4 = 0 THEN 'kept' END AS notes, risk_level FROM obligations WHERE mandatory),
i AS (SELECT jurisdiction AS graph_name, rule_type AS provider, rule_id, 'unmapped' AS status, 'new' AS notes, 'high' AS risk_level FROM obligations WHERE status <> 'mapped')
SELECT coalesce(i.graph_name, r.graph_name) AS graph_name, coalesce(i.provider, r.provider) AS provider, coalesce(i.rule_id, r.rule_id) AS rule_id,
  CASE WHEN coalesce(i.rule_id, r.rule_id) % 5 = 0 THEN 'mapped' ELSE coalesce(r.status, i.status) END AS status, coalesce(r.notes, i.notes) AS notes, coalesce(i.risk_level, r.risk_level) AS risk_level
FROM r FULL JOIN i ON r.graph_name = i.graph_name AND r.provider = i.provider AND r.rule_id = i.rule_id"""))
def register_after(s, d):
    o = A.obligations(s, d).withColumns({"graph_name": F.col("jurisdiction"), "provider": F.col("rule_type")})
    r = o.where("mandatory").select(*register.KEY, "status", F.when(F.col("rule_id") % 4 == 0, "kept").alias("notes"), "risk_level")
    i = o.where("status <> 'mapped'").select(*register.KEY, F.lit("unmapped").alias("status"), F.lit("new").alias("notes"), F.lit("high").alias("risk_level"))
    after = register.upsert(r, i)
    return register.with_status(after, after.where("rule_id % 5 = 0").withColumn("status", F.lit("mapped")))


@query(sql("obligations", """c AS (SELECT DISTINCT l_orderkey AS rule_id, 'control ' || l_linenumber AS control_name, CASE WHEN l_linenumber % 2 = 0 THEN 'policy' ELSE 'audit' END AS control_type FROM lineitem),
a AS (SELECT * FROM c UNION ALL SELECT rule_id, 'control 1', 'added' FROM obligations o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rule_id = o.rule_id AND control_name = 'control 1')),
k AS (SELECT * FROM a WHERE NOT (control_name = 'control 2' AND rule_id % 3 = 0))
SELECT o.rule_id, coalesce(control_name, '') AS control_name, coalesce(control_type, '') AS control_type FROM obligations o LEFT JOIN k ON k.rule_id = o.rule_id WHERE jurisdiction <> '1995'"""))
def exported_controls(s, d):
    o = A.obligations(s, d).withColumn("graph_name", F.col("jurisdiction"))
    n = F.col("l_linenumber")
    c = A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("rule_id"), F.concat(F.lit("control "), n.cast("string")).alias("control_name"), F.when(n % 2 == 0, "policy").otherwise("audit").alias("control_type")).distinct()
    c = register.add_controls(c, o.select("rule_id", F.lit("control 1").alias("control_name"), F.lit("added").alias("control_type")))
    c = register.remove_controls(c, o.where("rule_id % 3 = 0").select("rule_id", F.lit("control 2").alias("control_name")))
    kept, c = register.reset(o, c, "1995")
    return register.export(register.with_controls(kept, c)).select("rule_id", "control_name", "control_type")


# ---- annotations of vertices: what was told before, and what was told anew

ANNOTATIONS = """n AS (SELECT o_orderkey AS vertex_id, CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS approved FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT -1 - c_custkey, 'yes' FROM customer),
m AS (SELECT coalesce(n.vertex_id, o.o_orderkey) AS vertex_id, CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'F' THEN 'no' END AS reviewed, approved, CASE o_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS deleted FROM orders o FULL JOIN n ON n.vertex_id = o.o_orderkey)"""


def _annotations(s: SparkSession, d: str) -> DataFrame:
    o = A.table(s, d, "orders")
    status, c = F.col("o_orderstatus"), F.col("o_custkey")
    old = o.select(F.col("o_orderkey").alias("vertex_id"), F.when(status == "O", "yes").when(status == "F", "no").alias("reviewed"), F.lit(None).cast("string").alias("approved"), F.when(c % 4 == 0, True).when(c % 4 == 1, False).alias("deleted"))
    new = o.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("vertex_id"), F.when(c % 2 == 0, "yes").otherwise("no").alias("approved"))
    return register.merge_annotations(old, new.unionByName(A.table(s, d, "customer").select((-1 - F.col("c_custkey")).alias("vertex_id"), F.lit("yes").alias("approved"))))


@query(f"WITH {ANNOTATIONS} SELECT vertex_id, coalesce(p_name, 'vertex:' || vertex_id) AS vertex_name, reviewed, approved FROM m LEFT JOIN part ON p_partkey = vertex_id WHERE NOT coalesce(deleted, false)")
def annotation_names(s, d):
    v = A.table(s, d, "part").select(F.col("p_partkey").alias("vertex_id"), F.col("p_name").alias("name"))
    return register.named_annotations(_annotations(s, d), v).select("vertex_id", "vertex_name", "reviewed", "approved")


@query(f"WITH {ANNOTATIONS} SELECT count(*) FILTER (WHERE reviewed = 'yes') AS reviewed, count(*) FILTER (WHERE approved = 'yes') AS approved, count(*) FILTER (WHERE reviewed IS NULL) AS needs_review, count(*) FILTER (WHERE reviewed = 'yes' AND approved IS NULL) AS needs_approval FROM m WHERE NOT coalesce(deleted, false)")
def annotation_counts(s, d):
    return register.review_counts(_annotations(s, d))


@query(f"WITH {ANNOTATIONS} SELECT vertex_id, reviewed, approved FROM m WHERE vertex_id NOT IN (SELECT p_partkey FROM part)")
def orphaned_annotations(s, d):
    return register.orphaned_annotations(_annotations(s, d), A.table(s, d, "part").select(F.col("p_partkey").alias("vertex_id"))).select("vertex_id", "reviewed", "approved")


# ---- references by path: addresses of pages without scheme, query and closing slash

PATHS = "p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages), q AS (SELECT page_id, path, string_split(path, '/') AS ps FROM p)"


def _paths(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/+$", "").alias("path"))


@query(f"WITH {PATHS}, r AS (SELECT page_id AS ref_id, CASE WHEN page_id % 2 = 0 THEN ps[-2] || '/' || ps[-1] ELSE ps[-1] END AS path FROM q) SELECT ref_id, r.path, arg_min(p.path, page_id) AS entry FROM r JOIN p ON ends_with(p.path, r.path) OR ends_with(r.path, p.path) GROUP BY 1, 2")
def resolved_paths(s, d):
    p = _paths(s, d)
    two = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    refs = p.select(F.col("page_id").alias("ref_id"), F.when(F.col("page_id") % 2 == 0, two).otherwise(F.substring_index("path", "/", -1)).alias("path"))
    return search.resolve_path(refs, p.select(F.col("page_id").alias("ord"), "path"))


@query(f"""WITH {PATHS}, r AS (SELECT page_id AS ref_id, list_concat(['archive'], ps) AS ps FROM q), e AS (SELECT DISTINCT path AS entry, ps AS es FROM q),
h AS (SELECT ref_id, entry, len(ps) AS n, len(list_filter(ps, lambda x: len(list_filter(es, lambda y: contains(y, x))) > 0)) AS hits FROM r, e)
SELECT ref_id, entry, hits FROM h WHERE hits >= greatest(n // 2, 1)""")
def resolved_segments(s, d):
    p = _paths(s, d)
    return search.resolve_segments(p.select(F.col("page_id").alias("ref_id"), F.concat(F.lit("archive/"), "path").alias("path")), p)


@query(f"""WITH {PATHS}, r AS (SELECT page_id AS ref_id, ps[-1] AS last, CASE page_id % 3 WHEN 0 THEN path WHEN 1 THEN ps[-1] ELSE 'other/' || ps[-2] || '/' || ps[-1] END AS path FROM q),
named AS (SELECT ps[-1] AS last, min(path) AS path FROM (SELECT DISTINCT path, ps FROM q) GROUP BY 1 HAVING count(*) = 1), ended AS (SELECT ps[-2] || '/' || ps[-1] AS tail, min(path) AS path FROM q GROUP BY 1)
SELECT ref_id, r.path, coalesce(x.path, named.path, ended.path) AS chunk FROM r LEFT JOIN (SELECT DISTINCT path FROM p) x ON x.path = r.path LEFT JOIN named ON named.last = r.last LEFT JOIN ended ON contains(r.path, '/') AND ends_with(r.path, '/' || tail)""")
def resolved_chunks(s, d):
    p = _paths(s, d)
    last = F.element_at(F.split("path", "/"), -1)
    told = F.when(F.col("page_id") % 3 == 0, F.col("path")).when(F.col("page_id") % 3 == 1, last).otherwise(F.concat(F.lit("other/"), F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")))
    return search.resolve_chunks(p.select(F.col("page_id").alias("ref_id"), told.alias("path")), p)


@query(r"""WITH i AS (SELECT 'part-' || p_partkey AS chunk_id, 'B' || p_size || '-' || (p_partkey % 3) || ' ' || p_name AS title FROM part), k AS (SELECT 'b7-1 small ring part-17' AS low, ['B7-1'] AS ours, ['b7', '1', 'small', 'ring', 'part', '17'] AS a),
w AS (SELECT chunk_id, lower(title) AS title, low, ours, list_distinct(regexp_extract_all(title, '[A-Z]\d[\-\.\d]+')) AS theirs, a, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[\s()/_,\-]+', ' ', 'g'), ' '), lambda x: x <> '')) AS b FROM i, k),
s AS (SELECT chunk_id, CASE WHEN title = low THEN 100 WHEN contains(title, low) THEN 90 WHEN contains(low, title) THEN 85 WHEN len(list_intersect(ours, theirs)) > 0 THEN 90 WHEN contains(low, chunk_id) THEN 75
  WHEN len(theirs) > 0 THEN NULL WHEN len(list_intersect(a, b)) / greatest(len(a), len(b)) > 0.4 THEN floor(60 * len(list_intersect(a, b)) / greatest(len(a), len(b))) END AS score FROM w)
SELECT chunk_id, CAST(score AS INTEGER) AS score FROM s WHERE score IS NOT NULL ORDER BY score DESC, chunk_id LIMIT 5""")
def reference_matches(s, d):
    p = A.table(s, d, "part")
    title = F.concat(F.lit("B"), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 3).cast("string"), F.lit(" "), "p_name")
    index = p.select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("chunk_id"), title.alias("title"))
    return search.match_reference(index, "B7-1 small ring part-17").select("chunk_id", F.col("score").cast("int").alias("score"))


# ---- forms of names and texts

@query(r"""SELECT p_partkey AS rule_id, regexp_replace(upper(trim(p_name)), '[\s-]+', '_', 'g') AS entity_key, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')/' || p_type), '[\s()/_,\-]+', ' ', 'g')) AS title_key,
  'B' || p_size || '-' || p_partkey AS codes,
  p_name AS chunk_path, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS section_id, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS file_key,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS display_name FROM part""")
def name_forms(s, d):
    even = F.col("p_partkey") % 2 == 0
    ref = T.legacy_reference(F.when(even, F.concat("p_name", F.lit(" | "), "p_brand")).otherwise(F.col("p_name")))
    code = F.concat(F.lit("B"), F.col("p_size").cast("string"), F.lit("-"), F.col("p_partkey").cast("string"))
    return A.table(s, d, "part").select(
        F.col("p_partkey").alias("rule_id"), T.entity_key("p_name").alias("entity_key"), T.title_key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")/"), "p_type")).alias("title_key"),
        F.array_join(T.section_codes(F.concat(code, F.lit(" and "), code)), ";").alias("codes"), ref["chunk_path"].alias("chunk_path"), ref["section_id"].alias("section_id"),
        T.filename_key(F.concat(F.lit("/docs/"), "p_brand", F.lit("/"), "p_name", F.lit(".pdf"))).alias("file_key"), T.display_name(F.translate("p_name", " ", "_")).alias("display_name"),
    )


@query(r"""WITH c AS (SELECT doc_id, text, string_split(regexp_replace(text, '\s*\.{3}\s*', chr(2), 'g'), chr(2)) AS parts, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words, n_chars FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(flatten(list_transform(parts, lambda p: string_split(regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '\.\s+([A-Z])', '.' || chr(1) || '\1', 'g'), chr(1)))), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 8), '|') AS sentences,
  array_to_string(words[3:7], ' ') AS range, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS cut, '{"n": ' || n_chars || '}' AS json FROM c""")
def text_forms(s, d):
    n = F.col("n_chars").cast("string")
    body = F.concat(F.lit('{"n": '), n, F.lit("}"))
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("So: "), body, F.lit(" is all.")))
    return A.table(s, d, "documents").select("doc_id", F.array_join(T.sentence_segments("text"), "|").alias("sentences"), T.word_range("text", F.lit(2), F.lit(7)).alias("range"), T.truncated("text", 200).alias("cut"), T.fenced_json(reply).alias("json"))


# ---- scores, costs and advice

def _grade(name: str, by: int) -> F.Column:
    """An entry of a breakdown, null where the order lacks it; multiples of 20."""
    return F.when(F.col("o_orderkey") % by != 0, F.struct(F.lit(name), ((F.col("o_custkey") + by) % 6 * 20).cast("double")))


def _grade_sql(by: int) -> str:
    return f"CASE WHEN o_orderkey % {by} <> 0 THEN CAST((o_custkey + {by}) % 6 * 20 AS DOUBLE) END"


@query(f"""WITH v AS (SELECT o_orderkey, {_grade_sql(2)} AS a, {_grade_sql(3)} AS b, {_grade_sql(4)} AS c, {_grade_sql(5)} AS d, {_grade_sql(6)} AS e, {_grade_sql(60)} AS x FROM orders)
SELECT o_orderkey AS rule_id, round(coalesce(a, 0) * 0.3::DOUBLE + coalesce(b, 0) * 0.25::DOUBLE + coalesce(c, 0) * 0.2::DOUBLE + coalesce(d, 0) * 0.15::DOUBLE + coalesce(e, 0) * 0.1::DOUBLE, 2) AS extraction,
  CASE WHEN coalesce(a, b, c, d, e) IS NOT NULL THEN round((0.0::DOUBLE + coalesce(a * 0.25::DOUBLE, 0) + coalesce(b * 0.3::DOUBLE, 0) + coalesce(c * 0.2::DOUBLE, 0) + coalesce(d * 0.15::DOUBLE, 0) + coalesce(e * 0.1::DOUBLE, 0))
    / (0.0::DOUBLE + CASE WHEN a IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN d IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN e IS NULL THEN 0 ELSE 0.1::DOUBLE END), 2)
    WHEN x IS NOT NULL THEN x ELSE 50.0 END AS dependency FROM v""")
def breakdown_confidence(s, d):
    keys = zip(N.CONFIDENCE_WEIGHTS, (2, 3, 4, 5, 6))
    other = zip(N.DEPENDENCY_WEIGHTS, (2, 3, 4, 5, 6))
    told = lambda names: F.map_from_entries(F.filter(F.array(*[_grade(k, by) for k, by in names]), lambda x: x.isNotNull()))
    return A.table(s, d, "orders").select(F.col("o_orderkey").alias("rule_id"), N.weighted_confidence(told(keys)).alias("extraction"), N.dependency_confidence(told([*other, ("another", 60)])).alias("dependency"))


@query("""WITH m AS (SELECT o_orderkey, o_custkey, ['gpt-4o', 'gpt-4o-mini-2024', 'GPT-4.1-mini', 'o1', 'o3-mini', 'other'][o_custkey % 6 + 1] AS model FROM orders)
SELECT o_orderkey AS call_id, CASE model WHEN 'gpt-4o' THEN (o_custkey * 2.5::DOUBLE + o_orderkey * 10.0::DOUBLE) / 1000000 WHEN 'gpt-4o-mini-2024' THEN (o_custkey * 0.15::DOUBLE + o_orderkey * 0.6::DOUBLE) / 1000000
  WHEN 'GPT-4.1-mini' THEN (o_custkey * 0.4::DOUBLE + o_orderkey * 1.6::DOUBLE) / 1000000 WHEN 'o1' THEN (o_custkey * 15.0::DOUBLE + o_orderkey * 60.0::DOUBLE) / 1000000 WHEN 'o3-mini' THEN (o_custkey * 1.1::DOUBLE + o_orderkey * 4.4::DOUBLE) / 1000000 ELSE 0.0::DOUBLE END AS cost FROM m""")
def token_costs(s, d):
    names = F.array(*[F.lit(x) for x in ("gpt-4o", "gpt-4o-mini-2024", "GPT-4.1-mini", "o1", "o3-mini", "other")])
    o = A.table(s, d, "orders").withColumn("model", F.element_at(names, (F.col("o_custkey") % 6 + 1).cast("int")))
    return o.select(F.col("o_orderkey").alias("call_id"), N.token_cost("model", "o_custkey", "o_orderkey").alias("cost"))


@query("""SELECT user_id AS run_id, round(sum(value), 6) AS total_cost, CAST(sum(event_id) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 7) AS BIGINT) AS completion_tokens, CAST(0 AS BIGINT) AS cached_tokens, count(*) AS calls
FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1""")
def run_costs(s, d):
    e = A.table(s, d, "events")
    body = F.to_json(F.struct(F.col("value").alias("cost"), F.col("event_id").alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens")))
    line = F.when(F.col("event_type") == "signup", body).when(F.col("event_type") == "error", F.lit(f"{logs.COST} {{no json")).otherwise(F.concat(F.lit(f"{logs.COST} "), body))
    return logs.costs(e.select(F.col("user_id").alias("run_id"), line.alias("line")))


@query(sql("rules", """own AS (SELECT DISTINCT description || CASE WHEN mandatory THEN ' must hold' ELSE '' END AS text FROM rules),
w AS (SELECT text, list_distinct(list_filter(regexp_extract_all(lower(text), '\\b[a-z]{3,}\\b'), lambda x: NOT list_contains(STOPS, x))) AS w FROM own),
r AS (SELECT rule_id, rule_name, list_distinct(list_filter(regexp_extract_all(lower(rule_name || ' ' || description || ' ' || entity_type), '\\b[a-z]{3,}\\b'), lambda x: NOT list_contains(STOPS, x))) AS rw FROM rules),
h AS (SELECT text, rule_id, rule_name, row_number() OVER (PARTITION BY text ORDER BY len(list_intersect(w, rw)) DESC, rule_id) AS i FROM w, r WHERE len(list_intersect(w, rw)) >= 0.15::DOUBLE * len(w)),
g AS (SELECT text, count(*) AS affected, string_agg(rule_name, ', ' ORDER BY i) FILTER (WHERE i <= 3) AS names FROM h WHERE i <= 20 GROUP BY 1),
v AS (SELECT text AS change_id, affected, names, CASE WHEN contains(text, ' must') THEN 'breaking' WHEN affected >= 5 THEN 'material' ELSE 'cosmetic' END AS severity FROM own JOIN g USING (text))
SELECT change_id, affected, severity, CASE severity WHEN 'breaking' THEN 'URGENT: Review and update rules immediately: ' WHEN 'material' THEN 'Review for compliance within next review cycle: ' ELSE 'Minor update — verify accuracy: ' END || names AS recommendation FROM v""".replace("\\\\", "\\").replace("STOPS", str(T.STOP_WORDS))))
def analysed_changes(s, d):
    r = A.rules(s, d)
    text = F.concat("description", F.when(F.col("mandatory"), " must hold").otherwise(""))
    changes = r.select(text.alias("change_id"), F.lit("modified").alias("change_type"), text.alias("text")).distinct()
    return impact.analyse(changes, r).select("change_id", "affected", "severity", "recommendation")


@query("""WITH a AS (SELECT lang, quality, toxic FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)),
n AS (SELECT count(*) AS rules, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity > 49) AS hit FROM part)
SELECT count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS added, count(*) FILTER (WHERE lang = 'de') AS removed, count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('en', 'de')) AS modified, count(*) FILTER (WHERE toxic = 1) AS breaking,
  count(*) FILTER (WHERE coalesce(toxic, 0) <> 1 AND quality = 1) AS material, count(*) FILTER (WHERE coalesce(toxic, 0) <> 1 AND coalesce(quality, 0) <> 1) AS cosmetic, any_value(hit) AS rules_affected, any_value(rules) AS rules, round(any_value(hit) * 100 / any_value(rules), 1) AS impact_percent FROM a, n""")
def change_statistics(s, d):
    lab = A.table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    kind = F.when(F.col("lang") == "en", "added").when(F.col("lang") == "de", "removed").otherwise("modified")
    rank = F.when(F.col("toxic") == 1, "breaking").when(F.col("quality") == 1, "material").otherwise("cosmetic")
    told = A.table(s, d, "documents").join(lab, "doc_id", "left").select(kind.alias("change_type"), rank.alias("severity"))
    hit = A.table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("rule_id"))
    return impact.change_stats(told, hit, A.table(s, d, "part"))


# ---- mappings of items to rules

@query("""WITH l AS (SELECT o_custkey AS item_id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS k FROM orders GROUP BY 1),
m AS (SELECT item_id, 'p-' || (item_id % 50) AS rule_id, CAST(k % 3 AS DOUBLE) - 0.5::DOUBLE AS c, 0 AS i FROM l UNION ALL SELECT item_id, 'p-' || (k % 3000), NULL, 1 FROM l UNION ALL SELECT item_id, 'p-' || (item_id % 50), 0.25::DOUBLE, 2 FROM l),
b AS (SELECT item_id, rule_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(arg_min_null(c, i), 0.6::DOUBLE))) AS c FROM m WHERE rule_id IN (SELECT 'p-' || p_partkey FROM part) GROUP BY 1, 2),
g AS (SELECT item_id, string_agg(rule_id || '=' || c, ',' ORDER BY c DESC, rule_id DESC) AS matched FROM b GROUP BY 1)
SELECT c_custkey AS item_id, coalesce(matched, '') AS matched, CASE WHEN matched IS NOT NULL AND coalesce(status, 'F') = 'F' THEN 'PARTIAL' WHEN coalesce(status, 'F') = 'F' THEN 'NONE' WHEN status = 'O' THEN 'FULL' ELSE 'PARTIAL' END AS coverage
FROM customer LEFT JOIN l ON l.item_id = c_custkey LEFT JOIN g ON g.item_id = c_custkey""")
def normalised_mappings(s, d):
    k, c, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    hit = lambda rule, x: F.struct(F.concat(F.lit("p-"), rule.cast("string")).alias("rule_id"), x.cast("double").alias("confidence"))
    matched = F.array(hit(c % 50, k % 3 - F.lit(0.5)), hit(k % 3000, F.lit(None)), hit(c % 50, F.lit(0.25)))
    told = A.table(s, d, "orders").select(k.alias("ord"), c.alias("item_id"), F.when(status == "O", "FULL").when(status == "F", "NONE").otherwise("PARTIAL").alias("coverage"), matched.alias("matched"))
    rules = A.table(s, d, "part").select(F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("rule_id"))
    got = search.normalised_mappings(told, A.table(s, d, "customer").select(F.col("c_custkey").alias("item_id")), rules)
    return got.select("item_id", F.array_join(F.transform("matched", lambda m: F.concat(m["rule_id"], F.lit("="), m["confidence"].cast("string"))), ",").alias("matched"), "coverage")


@query("SELECT l_orderkey AS item_id, l_partkey AS rule_id, 0.35::DOUBLE AS confidence, 'PARTIAL' AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey) AS i FROM lineitem) WHERE i = 1")
def fallback_mappings(s, d):
    return search.fallback_mapping(A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("rule_id"), F.col("l_discount").alias("lexical_score"))).select("item_id", "rule_id", "confidence", "coverage")


@query("SELECT upper(replace(p_name, ' ', '_')) AS category, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1")
def unused_rules(s, d):
    r = A.rules(s, d).select(F.upper(F.concat_ws("_", F.lit("R"), F.translate("rule_name", " ", "_"), "rule_type", F.col("rule_id").cast("string"))).alias("rule_id"), F.col("rule_id").alias("part"))
    used = r.join(A.table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("part")), "part", "left_semi")
    return search.unused_rules(r, used, [t.upper() for t in A.TYPES])


# ---- sections and pages

@query("""WITH h AS (SELECT user_id AS doc_id, event_id AS n, event_id % 4 + 1 AS level, event_type || ' ' || event_id AS title FROM events),
a AS (SELECT *, max(CASE WHEN level = 1 THEN n END) OVER w AS a1, max(CASE WHEN level = 2 THEN n END) OVER w AS a2, max(CASE WHEN level = 3 THEN n END) OVER w AS a3 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT a.doc_id, a.n, concat_ws(' > ', x.title, y.title, z.title, a.title) AS path FROM a LEFT JOIN h x ON a.level > 1 AND x.doc_id = a.doc_id AND x.n = a1
  LEFT JOIN h y ON a.level > 2 AND y.doc_id = a.doc_id AND y.n = a2 AND a2 > coalesce(a1, -1) LEFT JOIN h z ON a.level > 3 AND z.doc_id = a.doc_id AND z.n = a3 AND a3 > coalesce(a1, -1) AND a3 > coalesce(a2, -1)""")
def heading_paths(s, d):
    h = A.table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("n"), (F.col("event_id") % 4 + 1).alias("level"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("title"))
    return segment.section_paths(h).select("doc_id", "n", F.array_join("path", " > ").alias("path"))


@query(r"""WITH t AS (SELECT doc_id, string_split('lost' || chr(10) || '# About ' || source || chr(10) || text || chr(10) || '### In ' || lang || chr(10) || 'end', chr(10)) AS parts FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL),
l AS (SELECT doc_id, i, parts[i] AS line, regexp_matches(parts[i], '^#{1,6}\s+.+$') AS head FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM t)),
n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS n, max(trim(regexp_extract(line, '^#{1,6}\s+(.+)$', 1))) FILTER (WHERE head) AS title, CAST(max(length(regexp_extract(line, '^(#{1,6})\s+.+$', 1))) FILTER (WHERE head) AS INTEGER) AS level,
  md5(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head), ''), '^\s+|\s+$', '', 'g')) AS content FROM n WHERE n > 0 GROUP BY 1, 2""")
def heading_sections(s, d):
    t = A.table(s, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    t = t.select("doc_id", F.concat(F.lit("lost\n# About "), "source", F.lit("\n"), "text", F.lit("\n### In "), "lang", F.lit("\nend")).alias("text"))
    return segment.heading_chunks(t).select("doc_id", "n", "title", "level", F.md5("content").alias("content"))


@query("""WITH p AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER w AS INTEGER) AS page, count(*) OVER (PARTITION BY o_custkey) AS total, CASE o_orderstatus WHEN 'P' THEN ' ' ELSE o_orderpriority END AS text FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
t AS (SELECT doc_id, page AS ord, CASE WHEN page > 1 OR doc_id % 2 = 1 THEN page ELSE 1 END AS first, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1, total) AS last FROM p WHERE page % 3 = 1)
SELECT t.doc_id, t.ord, string_agg(text, chr(10) ORDER BY p.page) AS content FROM t JOIN p ON p.doc_id = t.doc_id AND p.page BETWEEN first AND last GROUP BY 1, 2 HAVING trim(content, ' ' ) <> ''""")
def toc_pages(s, d):
    o = A.table(s, d, "orders")
    w = W.partitionBy("o_custkey")
    text = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority"))
    p = o.select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w.orderBy("o_orderkey")).alias("page"), F.count("*").over(w).alias("total_pages"), text.alias("text"))
    toc = p.where("page % 3 = 1").select("doc_id", F.col("page").alias("ord"), F.when((F.col("page") > 1) | (F.col("doc_id") % 2 == 1), F.col("page")).alias("page"), "total_pages")
    return segment.pages_of(segment.fill_pages(toc), p.select("doc_id", "page", "text"))


# ---- paths and summaries

@query(sql("dependencies", """p AS (SELECT DISTINCT src AS a, dst AS b FROM dependencies WHERE dependency_type = 'override' AND strength = 5)
SELECT a, b, dependency_type, strength, 'outgoing' AS direction FROM p JOIN dependencies ON src = a AND dst = b UNION ALL SELECT a, b, dependency_type, strength, 'incoming' FROM p JOIN dependencies ON dst = a AND src = b"""))
def path_edge_details(s, d):
    e = A.dependencies(s, d)
    paths = e.where("dependency_type = 'override' AND strength = 5").select(F.array("src", "dst").alias("path")).distinct()
    return graph.path_edges(paths, e).select("a", "b", "dependency_type", "strength", "direction")


@query(sql("graph_rules", """g AS (SELECT behavior, count(*) FILTER (WHERE graph = 1) AS g1, count(*) FILTER (WHERE graph = 2) AS g2, count(*) FILTER (WHERE graph = 1 AND quality = 1) AS matches, count(*) FILTER (WHERE quality = 0) AS contradictions FROM graph_rules GROUP BY 1)
SELECT *, g1 - matches AS g1_unmatched, g2 - matches AS g2_unmatched FROM g WHERE behavior IS NOT NULL"""))
def match_summaries(s, d):
    r = A.graph_rules(s, d).where("behavior IS NOT NULL")
    sizes = r.groupBy("behavior").agg(F.count_if(F.col("graph") == 1).alias("g1"), F.count_if(F.col("graph") == 2).alias("g2"))
    return match.match_summary(sizes, r.where("graph = 1 AND quality = 1"), r.where("quality = 0"))
