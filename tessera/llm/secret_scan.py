"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. Only pairs of blob and rule version that the
ledger does not hold are scanned; findings are then joined back to all paths that ever held the blob.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, set_aside

#: Kind, pattern, group whose length counts (0: the whole match), least length.
RULES = {
    "base-1": (
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    )
}
KINDS = [k for k, *_ in RULES["base-1"]]
#: A run of one class that is too short cannot hold a longer match, so the scan may ask for the length at once.
_SCANNED = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Findings are broadcast up to so many bytes, which are summed first; beyond, paths of a blob go to SALTS tasks.
BROADCAST_BYTES, SALTS = 64 << 20, 16
#: Matches are folded in stretches of so many.
FOLD = 256
LEDGER = "blob string, rules string, n_assign long, n_access long, n_hex long, spans string"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, turn: int) -> Column:
    """Array of (start, turn, end) of the leftmost non-overlapping matches that are long enough.

    Functions give matches without their places, so each match is taken with the gap before it and places are sums of
    lengths.
    """
    pattern = _SCANNED.get(kind, pattern)
    # \G ties each match to the end of the one before; else what follows the last match would be tried at every place
    gapped = F.lit(rf"\G([\s\S]*?)({pattern})")
    hit = F.regexp_like(text, F.lit(pattern))
    gaps = F.regexp_extract_all(text, gapped, F.lit(1))
    full = F.regexp_extract_all(text, gapped, F.lit(2))
    held = F.regexp_extract_all(text, gapped, F.lit(2 + group)) if group else full
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        one = F.array(F.struct(start.alias("s"), F.lit(turn).alias("k"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(F.length(x["2"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    rows = F.zip_with(F.zip_with(gaps, full, lambda a, b: F.struct(a.alias("0"), b.alias("1"))), held, lambda x, v: F.struct(x["0"].alias("0"), x["1"].alias("1"), v.alias("2")))

    def places(matches):
        # folded a stretch at a time, then moved to where the stretch begins: work grows with the matches, not their square
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / FOLD).cast("int")), lambda i: F.aggregate(F.slice(matches, i * FOLD + 1, FOLD), zero, step))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,k:int,e:int>>>").alias("out"))
        moved = lambda at, x: F.struct((x["s"] + at).alias("s"), x["k"].alias("k"), (x["e"] + at).alias("e"))
        return F.flatten(F.aggregate(stretches, none, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(c["out"], lambda x: moved(acc["at"], x)))).alias("out")))["out"])

    found = F.element_at(F.transform(F.array(rows), places), 1)  # binds rows, so that they are made once
    return F.when(hit, found).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


def scan_blobs(blobs: DataFrame, rules: str = "base-1") -> DataFrame:
    """blobs (blob, text) to ledger rows: counts by kind and all spans, kind:start:end in code points."""
    found = [_spans(F.col("text"), kind, pattern, group, least, i) for i, (kind, pattern, group, least) in enumerate(RULES[rules])]
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS])), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string")))
    out = blobs.select("blob", *[c.alias(f"_{k}") for k, c in zip(KINDS, found)])
    return out.select("blob", F.lit(rules).alias("rules"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.array_join(spans, ",").alias("spans"))


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str, rules: str) -> DataFrame:
    """The rows of one rule version, one for each blob: a pair that two writers scanned at once counts once."""
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path).where(F.col("rules") == rules).dropDuplicates(["blob"])


def fill(spark: SparkSession, versions: DataFrame, ledger: str, rules: str = "base-1") -> None:
    """Scan those blobs of versions that the ledger does not hold under these rules, and add them.

    What is added is written aside and then moved into the ledger as a whole, so a scan that breaks off leaves nothing that
    counts and can be run again. A blob's text is moved once, to where all its copies meet, and scanned there.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(ledger).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = versions.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", address(F.col("text")))
    at = at.groupBy("blob").agg(F.first("text").alias("text"))  # before the ledger is asked, so a blob of many paths is one row there
    if fs.exists(jvm.Path(ledger)):
        at = at.join(read_ledger(spark, ledger, rules).select("blob"), "blob", "left_anti")
    name = uuid.uuid4().hex
    scan_blobs(at, rules).write.parquet(f"{ledger}/_aside-{name}")
    if not fs.rename(jvm.Path(f"{ledger}/_aside-{name}"), jvm.Path(f"{ledger}/run-{name}")):
        raise OSError(f"cannot add to {ledger}")


def findings(spark: SparkSession, versions: DataFrame, ledger: str, rules: str = "base-1") -> DataFrame:
    """versions with what the ledger holds of their blobs: _blob, n_assign, n_access, n_hex and spans."""
    held = read_ledger(spark, ledger, rules).where(F.col("spans") != "").drop("rules")
    held = held.select(F.col("blob").alias("_ledger_blob"), *[F.col(f"n_{k}").alias(f"_ledger_{k}") for k in KINDS], F.col("spans").alias("_ledger_spans"))
    used = ("text",)
    kept = versions.drop("n_assign", "n_access", "n_hex", "spans", "_blob")
    own = set_aside(kept, *used).withColumn("_blob", address(F.col("text")))
    size = held.agg(F.sum(F.octet_length("_ledger_spans") + 120)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # then no path and no text is shuffled
        out = own.join(F.broadcast(held), F.col("_blob") == F.col("_ledger_blob"), "left")
    else:  # paths of one blob are dealt to SALTS tasks, each of which gets the blob's findings
        told = [F.col(f"`{f.name}`") for f in own.schema.fields if "map<" not in f.dataType.simpleString()]
        own = own.withColumn("_salt", F.pmod(F.xxhash64(*told), F.lit(SALTS)).cast("int"))
        held = held.withColumn("_ledger_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = own.join(held, (F.col("_blob") == F.col("_ledger_blob")) & (F.col("_salt") == F.col("_ledger_salt")), "left")
    added = [F.coalesce(F.col(f"_ledger_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    names = [F.col(f"`{c}`") if c in used else F.col(f"`_own_{c}`").alias(c) for c in kept.columns]
    return out.select(*names, "_blob", *added, F.coalesce(F.col("_ledger_spans"), F.lit("")).alias("spans"))


def scan(spark: SparkSession, versions: DataFrame, ledger: str | None = None, rules: str = "base-1") -> DataFrame:
    """versions with _blob, n_assign, n_access, n_hex and spans.

    versions: one row per path and historical version, with a column text (null is empty). `ledger` is a folder of scanned
    (blob, rules) pairs; it is read if it exists and gets a row for each pair scanned now. Without one, a new ledger in the
    shared folder is used. Columns of versions with the names of added ones are replaced. Copies, repeated rows and
    unchanged versions are scanned once. An empty table gives an empty one.
    """
    path = ledger or scratch(spark, "ledger")
    fill(spark, versions, path, rules)
    return findings(spark, versions, path, rules)


def scan_in_commits(spark: SparkSession, versions: DataFrame, order: str = "doc_id", commits: int = 2, rules: str = "base-1") -> DataFrame:
    """What scan() gives, with versions arriving in order of a number column, a range of it at a time: each range is held
    against the ledger of those before it, and only blobs that none of them had are scanned."""
    path, id_ = scratch(spark, "ledger"), F.col(order)
    upto = sorted({int(b) for b in versions.select(id_.cast("double").alias("o")).approxQuantile("o", [i / commits for i in range(1, commits)], 0.01)})
    for i in range(len(upto) + 1):
        own = (id_ >= upto[i - 1] if i else F.lit(True)) & (id_ < upto[i] if i < len(upto) else F.lit(True))
        fill(spark, versions.where(own if i else own | id_.isNull()), path, rules)
    return findings(spark, versions, path, rules)


def redact(spark: SparkSession, docs: DataFrame, ledger: str | None = None, rules: str = "base-1", mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of overlapping or touching findings in text replaced by `mark`; n_chars, if there, follows.

    Texts without findings stay as they are, null too. All rows stay.
    """
    found = scan(spark, set_aside(docs, "text"), ledger, rules)
    spans = F.transform(F.split("spans", ","), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e")))
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        fresh = x["s"] > acc["at"]
        first = (acc["at"] == 0) & (x["s"] == 0)
        lead = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))
        out = F.when(fresh, lead).when(first & (acc["out"] == ""), F.lit(mark)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = found.withColumn("text", F.when(F.col("spans") != "", clean).otherwise(text))
    names = [F.col("text") if c == "text" else F.col(f"`_own_{c}`").alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        names[docs.columns.index("n_chars")] = F.when(F.col("spans") != "", F.length("text")).otherwise(F.col("_own_n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*names)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_in_commits(spark, docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


_GAPPED = """list_transform(list_zip(regexp_extract_all(t, {g}, 1), regexp_extract_all(t, {g}, 2), regexp_extract_all(t, {g}, {held})), lambda x: {{'g': length(x[1]), 'm': length(x[2]), 'v': length(x[3])}})"""


def _kind_sql(turn: int, kind: str, pattern: str, group: int, least: int) -> str:
    g = "'(?s)(.*?)(" + _SCANNED.get(kind, pattern).replace("'", "''") + ")'"
    rows = _GAPPED.format(g=g, held=2 + group)
    return f"""SELECT doc_id, {turn} AS k, '{kind}' AS kind, e - m AS s, e, v FROM (
      SELECT doc_id, x.m AS m, x.v AS v, sum(x.g + x.m) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
        SELECT doc_id, i, rows[i] AS x FROM (SELECT doc_id, rows, unnest(range(1, len(rows) + 1)) AS i FROM (SELECT doc_id, {rows} AS rows FROM d)))) WHERE v >= {least}"""


OP3_SQL = (
    "WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), found AS (\n"
    + "\nUNION ALL\n".join(_kind_sql(i, *r) for i, r in enumerate(RULES["base-1"]))
    + """), per AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, k) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, sha256(COALESCE(spans, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)"""
)
