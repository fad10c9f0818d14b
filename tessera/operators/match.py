"""Comparing two rule graphs: clusters, pairs, one-to-one assignment, set operations, duplicates, dependencies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.functions.numeric import strength_confidence
from tessera.functions.text import thresholds, tokens
from tessera.operators.graph import _cut, if_small

#: A judge turns candidate pairs (g1, g2, behavior, texts and qualities) into relationship and confidence columns.
Judge = Callable[[DataFrame], DataFrame]


def normal(text) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


#: Token sets are alike from this Jaccard similarity on (numerator, denominator).
SIMILAR = (3, 4)


def token_key(text="text") -> F.Column:
    return F.xxhash64(F.array_sort(F.array_distinct(tokens(text))))


#: Elements of sets that are told apart by how often they occur; what is broadcast of each is 12 bytes.
FREQUENT = 1_000_000
#: Words of 64 bits in the sketch of a set; in the further one of a set of more than LARGE elements; sets that one step of Python looks at.
SKETCH, MORE, LARGE, STEP = 8, 64, 400, 500


def _leads(x: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """side, g, id, n, at, t, s0 to s7, more of sets (side, g, id, w): size, place and value of each of the first elements in a common
    order (rare first), one of which any two alike sets share; and a sketch, whose bits are parities of the elements that fall
    on them, so two sketches differ in at most as many bits as the sets differ in elements; more: a longer one, or empty."""
    num, den = similar
    often = _cut(x.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where("c > 1"))
    room, least = FREQUENT, 2
    counts = often.groupBy(F.least("c", F.lit(10_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()  # 10,000 rows at most
    for r in counts:
        room -= r["n"]
        if room < 0:
            least = r["c"] + 1
            break
    whole = room >= 0  # then an element that isn't among them is in one set only
    common = often.where(F.col("c") >= least).limit(FREQUENT).toArrow()  # bounded
    value, count = common["t"].to_numpy(), common["c"].to_numpy()
    rank = np.empty(len(value), np.int32)
    rank[np.lexsort((value, count))] = np.arange(len(value), dtype=np.int32)
    order = np.argsort(value)
    shared = x.sparkSession.sparkContext.broadcast((value[order], rank[order]))

    def run(batches):
        value, rank = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                b = batch.slice(lo, STEP)
                w = b.column("w")
                n = w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                t, row, start = w.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                at = np.minimum(np.searchsorted(value, t), max(len(value) - 1, 0))
                key = np.where(value[at] == t, rank[at] + 1, 0) if len(value) else np.zeros(len(t), np.int32)
                words = [np.bitwise_xor.reduceat(np.where((t & 7) == i, np.int64(1) << ((t >> 3) & 63), 0), start) for i in range(SKETCH)]
                big = np.flatnonzero(n > LARGE)
                more = np.zeros((len(big), MORE), np.int64)
                of = np.repeat(np.arange(len(big)), n[big])
                u = t[(n > LARGE)[row]]
                np.bitwise_xor.at(more, (of, (u >> 9) % MORE), np.int64(1) << ((u >> 15) & 63))
                ends = np.concatenate(([0], np.cumsum((n > LARGE) * MORE)))
                longer = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(more.ravel()))
                by = np.lexsort((t, key, row))
                place = np.arange(len(t)) - start[row]
                keep = place < (n - (num * n + den - 1) // den + 1)[row]
                if whole:
                    keep &= key[by] > 0
                row, one = row[keep], [np.asarray(x) for x in (n[row[keep]], place[keep], t[by][keep])]
                told = b.select(["side", "g", "id"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*told.columns, *[pa.array(c) for c in one], *[pa.array(c[row]) for c in words], longer.take(pa.array(row))], names=[*told.schema.names, "n", "at", "t", *[f"s{i}" for i in range(SKETCH)], "more"])

    schema = StructType([*x.select("side", "g", "id").schema, *[StructField(c, LongType()) for c in ("n", "at", "t", *[f"s{i}" for i in range(SKETCH)])], StructField("more", ArrayType(LongType()))])
    return x.select("side", "g", "id", "w").mapInArrow(run, schema)


def similar_sets(one: DataFrame, two: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """g, a, b, both: pairs of sets of one group whose Jaccard similarity is `similar` or more; both: what they share.

    one, two: g, id, w (array of long, no repeats). Sets of that similarity share one of their first elements in any
    common order (rare first), so only these are joined; sizes, places and sketches bound what a pair can share; whole sets
    are only intersected where that is enough. Exact.
    """
    num, den = similar
    x = one.select(F.lit(1).alias("side"), "g", "id", "w").unionByName(two.select(F.lit(2).alias("side"), "g", "id", "w")).where(F.size("w") > 0)
    first = _leads(x, similar)

    def side(n: int, tag: str) -> DataFrame:
        return first.where(F.col("side") == n).select("g", "t", F.col("id").alias(tag), *[F.col(c).alias(f"{tag}_{c}") for c in ("n", "at", "more", *[f"s{i}" for i in range(SKETCH)])])

    all_ = F.col("a_n") + F.col("b_n")
    most = F.least("a_at", "b_at") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(SKETCH)])
    further = F.aggregate(F.zip_with("a_more", "b_more", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    further = F.when((F.size("a_more") == 0) | (F.size("b_more") == 0), True).otherwise((num + den) * further <= (den - num) * all_)
    met = side(1, "a").join(side(2, "b"), ["g", "t"]).where((den * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n")) & ((num + den) * most >= num * all_) & ((num + den) * apart <= (den - num) * all_) & further)
    pairs = _cut(met.select("g", "a", "b").distinct())

    def sets(n: int, tag: str) -> DataFrame:
        own = x.where(F.col("side") == n).select("g", F.col("id").alias(tag), F.col("w").alias(f"{tag}_w"))
        return own.join(if_small(pairs.select("g", tag).distinct()), ["g", tag], "left_semi")

    found = pairs.join(sets(1, "a"), ["g", "a"]).join(sets(2, "b"), ["g", "b"])
    found = found.withColumns({"a_n": F.size("a_w"), "b_n": F.size("b_w"), "both": F.size(F.array_intersect("a_w", "b_w"))})
    return found.where(den * F.col("both") >= num * (F.col("a_n") + F.col("b_n") - F.col("both"))).select("g", "a", "b", "both")


def values(text) -> F.Column:
    """The thresholds of a text as they are compared: without blanks, commas and plural, list references left out."""
    plain = F.transform(thresholds(F.coalesce(text, F.lit(""))), lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[\s,]", ""), r"(?<=[a-z])s$|\.$", ""))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda x: ~x.isin("fatf_ref", "sanctions_ref"))))


def values_conflict(a, b) -> F.Column:
    """Each side has a value of one kind (percent, amount, days, ...) that the other lacks."""
    kinds = lambda x, y: F.transform(F.array_except(x, y), lambda v: F.regexp_replace(v, r"[\d.]+", ""))
    return F.arrays_overlap(kinds(a, b), kinds(b, a))


def rule_facts(g1: DataFrame, g2: DataFrame) -> DataFrame:
    """side (1, 2), behavior, rule_id, k (token_key), t (normalised text, digest), q (quality), v (values), w and u (hashes of
    tokens that are no number, and of numbers): what comparisons look at, taken from each text once. Rules without behaviour
    meet no other and are left out."""
    def side(g: DataFrame, n: int) -> DataFrame:
        return g.where("behavior IS NOT NULL").select(F.lit(n).alias("side"), "behavior", "rule_id", "text", F.col("quality").alias("q"), F.array_distinct(tokens("text")).alias("x"))

    digits, hashed = (lambda x: x.rlike("^[0-9]+$")), (lambda x: F.transform(x, lambda y: F.xxhash64(y)))
    both = side(g1, 1).unionByName(side(g2, 2))
    return _cut(both.select("side", "behavior", "rule_id", F.xxhash64(F.array_sort("x")).alias("k"), F.md5(normal(F.col("text"))).alias("t"), "q", values(F.col("text")).alias("v"), hashed(F.filter("x", lambda x: ~digits(x))).alias("w"), hashed(F.filter("x", digits)).alias("u")))


def similar_keys(g1: DataFrame, g2: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """behavior, k1, k2, jaccard: unlike token sets (token_key) of one behaviour, alike in all tokens or in those that are
    no number. Copies count once; pairs that are alike without their numbers only can contradict but not match."""
    facts = rule_facts(g1, g2) if facts is None else facts

    every = facts.select("side", "behavior", "k", "rule_id")
    first = every.groupBy("side", "behavior", "k").agg(F.min("rule_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = if_small(_cut(every.join(first, ["side", "behavior", "k"]).where("rule_id <> first").select("side", "behavior", "rule_id")))
    alone = facts.join(copies, ["side", "behavior", "rule_id"], "left_anti")  # copies go before their words are shuffled

    def side(n: int) -> DataFrame:
        own = alone.where(F.col("side") == n)
        # where one side has no number, all tokens are no more alike than those without numbers
        forms = F.array(F.struct(F.lit(0).alias("form"), F.col("w").alias("w")), *[F.when(F.size("u") > 0, F.struct(F.lit(1).alias("form"), F.concat("w", "u").alias("w")))])
        return own.select("behavior", F.col("k").alias("id"), F.explode(F.filter(forms, lambda x: x.isNotNull())).alias("x")).select(F.struct("behavior", "x.form").alias("g"), "id", "x.w")

    found = similar_sets(side(1), side(2)).where("a <> b").select(F.col("g.behavior").alias("behavior"), F.col("a").alias("k1"), F.col("b").alias("k2")).distinct()
    found = _cut(found)
    sets = lambda n: alone.where(F.col("side") == n).select("behavior", F.col("k").alias(f"k{n}"), F.concat("w", "u").alias(f"w{n}")).join(if_small(found.select("behavior", f"k{n}").distinct()), ["behavior", f"k{n}"], "left_semi").dropDuplicates(["behavior", f"k{n}"])
    both = F.size(F.array_intersect("w1", "w2"))
    found = found.join(sets(1), ["behavior", "k1"]).join(sets(2), ["behavior", "k2"])
    return found.select("behavior", "k1", "k2", (both / (F.size("w1") + F.size("w2") - both)).alias("jaccard"))


def candidate_pairs(g1: DataFrame, g2: DataFrame, near: bool = True) -> DataFrame:
    """Pairs of one behaviour that can be alike: of equal token sets and, if near, of similar ones. Deals pairs by content
    instead of pairing whole clusters, whose pairs grow with the square of the cluster."""
    def side(g: DataFrame, tag: str) -> DataFrame:
        return g.select("behavior", token_key().alias("k"), F.col("rule_id").alias(tag), F.col("text").alias(f"{tag}_text"), F.col("quality").alias(f"{tag}_quality"))

    one, two = side(g1, "g1"), side(g2, "g2")
    pairs = one.join(two, ["behavior", "k"]).drop("k")
    if not near:
        return pairs
    more = one.withColumnRenamed("k", "k1").join(similar_keys(g1, g2).drop("jaccard"), ["behavior", "k1"]).join(two.withColumnRenamed("k", "k2"), ["behavior", "k2"])
    return pairs.unionByName(more.drop("k1", "k2"))


def default_judge(pairs: DataFrame, by_value: bool = True) -> DataFrame:
    """IDENTICAL (equal normalised text, 1.0) or EQUIVALENT (equal token sets, 0.9; similar ones, 0.9 times their Jaccard
    similarity); CONTRADICTORY where both have a quality and these differ or, by_value, where the thresholds of alike
    texts conflict; UNRELATED (0.5) else."""
    same = normal(F.col("g1_text")) == normal(F.col("g2_text"))
    a, b = F.array_distinct(tokens("g1_text")), F.array_distinct(tokens("g2_text"))
    both = F.size(F.array_intersect(a, b))
    jaccard = F.when(F.array_sort(a) == F.array_sort(b), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))
    alike = F.col("_j") >= SIMILAR[0] / SIMILAR[1]
    clash = F.col("g1_quality") != F.col("g2_quality")
    if by_value:
        clash = F.coalesce(clash, F.lit(False)) | values_conflict(values(F.col("g1_text")), values(F.col("g2_text")))
    kind = F.when(clash, "CONTRADICTORY").when(same, "IDENTICAL").when(alike, "EQUIVALENT").otherwise("UNRELATED")
    out = pairs.withColumn("_j", jaccard).withColumn("relationship", kind)
    return out.withColumn("confidence", F.when(F.col("relationship") == "IDENTICAL", 1.0).when(F.col("relationship") == "EQUIVALENT", 0.9 * F.col("_j")).otherwise(0.5)).drop("_j")


def set_digests(rules: DataFrame) -> DataFrame:
    """rules with k (token set) and t (normalised text), 128 bits each, in place of text; those without text or behaviour go."""
    key = F.md5(F.array_join(F.array_sort(F.array_distinct(tokens("text"))), " "))  # tokens hold no blank
    return rules.where("text IS NOT NULL AND behavior IS NOT NULL").withColumns({"k": key, "t": F.md5(normal(F.col("text")))}).drop("text")


def equal_pairs(g1: DataFrame, g2: DataFrame) -> DataFrame:
    """behavior, g1, g2, relationship: pairs of equal token sets as default_judge(by_value=False) tells them, of rules with
    set_digests(): texts are neither shuffled nor looked at by pair."""
    side = lambda g, n: g.select("behavior", "k", F.col("rule_id").alias(n), F.col("t").alias(f"{n}_t"), F.col("quality").alias(f"{n}_q"))
    kind = F.when(F.col("g1_q") != F.col("g2_q"), "CONTRADICTORY").when(F.col("g1_t") == F.col("g2_t"), "IDENTICAL").otherwise("EQUIVALENT")
    return side(g1, "g1").join(side(g2, "g2"), ["behavior", "k"]).select("behavior", "g1", "g2", kind.alias("relationship"))


def aligned(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts by pair_id, the first to arrive (ord) of each; pairs without one are UNRELATED, 0.5 and 50."""
    first = verdicts.withColumn("_n", F.row_number().over(W.partitionBy("pair_id").orderBy("ord"))).where("_n = 1").drop("_n", "ord")
    out = pairs.join(first, "pair_id", "left")
    return out.withColumns({"relationship": F.coalesce("relationship", F.lit("UNRELATED")), "confidence": F.coalesce("confidence", F.lit(0.5)), "similarity_score": F.coalesce("similarity_score", F.lit(50.0))})


def assign(judged: DataFrame, rounds: int = 60) -> DataFrame:
    """Greedy one-to-one matches: best confidence first, ties to smaller g1, then g2. Where pairs come with texts and qualities
    (as from default_judge), ties first go by the first id of each side's class: rules that no verdict can tell apart.

    In each round the pairs that are the best of both their rules are taken; that gives the greedy result.
    """
    left, ties = judged.where(F.col("relationship").isin("IDENTICAL", "EQUIVALENT")), []
    if {"g1_text", "g2_text", "g1_quality", "g2_quality"} <= set(judged.columns):
        for g in ("g1", "g2"):
            alike = F.struct(token_key(f"{g}_text").alias("k"), F.col(f"{g}_quality").alias("q"), values(F.col(f"{g}_text")).alias("v"))
            first = lambda *by, g=g: F.min(g).over(W.partitionBy("behavior", *by))
            ties.append(F.when(F.col("relationship") == "IDENTICAL", first(alike, normal(F.col(f"{g}_text")))).otherwise(first(alike)).alias(f"_{g}"))
    left = left.select("behavior", "g1", "g2", "relationship", "confidence", *ties)
    done = None
    left = _cut(left)
    by = [F.col(c) for c in left.columns if c.startswith("_g")]
    for _ in range(rounds):
        if left.isEmpty():
            break
        order = [F.desc("confidence"), *by, F.col("g1"), F.col("g2")]
        ranked = left.withColumn("a", F.row_number().over(W.partitionBy("behavior", "g1").orderBy(*order))).withColumn("b", F.row_number().over(W.partitionBy("behavior", "g2").orderBy(*order)))
        take = _cut(ranked.where("a = 1 AND b = 1").select("behavior", "g1", "g2", "relationship", "confidence"))
        left = _cut(left.join(take.select("behavior", "g1"), ["behavior", "g1"], "left_anti").join(take.select("behavior", "g2"), ["behavior", "g2"], "left_anti"))
        done = take if done is None else done.unionByName(take)
    else:
        raise RuntimeError("assignment did not settle")
    return done if done is not None else left.select("behavior", "g1", "g2", "relationship", "confidence")


def _class_id(*cols: str) -> F.Column:
    """128 bits of what makes rules interchangeable."""
    return F.md5(F.to_json(F.struct(*cols)))


def match_members(g1: DataFrame, g2: DataFrame, keys: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """behavior, g1, g2, relationship, confidence: the one-to-one matches of the default judge, without its pairs.

    Rules that no verdict can tell apart are one class, a row with a count: equal normalised text, quality and thresholds
    for IDENTICAL; equal token set, quality and thresholds for EQUIVALENT, where equal token sets come before similar ones.
    Classes are matched in rounds (ranks.matched_classes), and members dealt to them by rank; neither a behaviour nor a class
    is ever held by one task. Confidence decides; ties go to the classes with the smallest first ids, then to the smaller
    ids. Rules without behaviour match nothing. keys, facts: similar_keys() and rule_facts() of the two, where they are known.
    """
    from tessera.operators.ranks import dealt, matched_classes

    facts = rule_facts(g1, g2) if facts is None else facts
    both = facts.drop("w", "u").withColumns({"same": _class_id("behavior", "k", "t", "q", "v"), "alike": _class_id("behavior", "k", "q", "v")})

    def classes(members: DataFrame, by: str, *cols: str) -> tuple[DataFrame, DataFrame]:
        """Of each side: class, how many of members are in it, its first id of all rules, and what verdicts look at."""
        first = both.groupBy("side", by).agg(F.min("rule_id").alias("first"))
        per = _cut(members.groupBy("side", by, "behavior", "k", "q", "v", *cols).agg(F.count("*").alias("n")).join(first, ["side", by]))
        return per.where("side = 1").withColumnRenamed(by, "c"), per.where("side = 2").withColumnRenamed(by, "d")

    def told(per: DataFrame, c: str, n: str, *on: str) -> DataFrame:
        return per.select(c, *on, F.col("q").alias(f"q{n}"), F.col("v").alias(f"v{n}"))

    def agreeing(links: DataFrame) -> DataFrame:
        return links.where(~(F.coalesce(F.col("q1") != F.col("q2"), F.lit(False)) | values_conflict(F.col("v1"), F.col("v2"))))

    def deal(members: DataFrame, by: str, taken: DataFrame, relationship: str) -> DataFrame:
        one = members.where("side = 1").select(F.col(by).alias("c"), F.struct("behavior", "rule_id").alias("g1"))
        two = members.where("side = 2").select(F.col(by).alias("d"), F.struct("behavior", "rule_id").alias("g2"))
        return dealt(taken, one, two).select("g1.behavior", F.col("g1.rule_id").alias("g1"), F.col("g2.rule_id").alias("g2"), F.lit(relationship).alias("relationship"), "confidence")

    def matched(one: DataFrame, two: DataFrame, links: DataFrame) -> DataFrame:
        return matched_classes(one.select("c", "n", "first"), two.select("d", "n", "first"), agreeing(links).select("c", "d", "confidence"))

    one, two = classes(both, "same", "t")
    on = ["behavior", "k", "t"]
    links = told(one, "c", "1", *on).join(told(two, "d", "2", *on), on).withColumn("confidence", F.lit(1.0))
    first = _cut(deal(both, "same", matched(one, two, links), "IDENTICAL"))
    left = both
    for n, tag in ((1, "g1"), (2, "g2")):
        left = left.join(first.select("behavior", F.col(tag).alias("rule_id"), F.lit(n).alias("side")), ["behavior", "rule_id", "side"], "left_anti")
    left = _cut(left)
    one, two = classes(left, "alike")
    mine, theirs = told(one, "c", "1", "behavior", "k"), told(two, "d", "2", "behavior", "k")
    links = mine.join(theirs, ["behavior", "k"]).withColumn("confidence", F.lit(0.9)).drop("k")
    pairs = (similar_keys(g1, g2, facts) if keys is None else keys).where(F.col("jaccard") >= SIMILAR[0] / SIMILAR[1])
    near = mine.withColumnRenamed("k", "k1").join(pairs, ["behavior", "k1"]).join(theirs.withColumnRenamed("k", "k2"), ["behavior", "k2"])
    near = near.withColumn("confidence", F.col("jaccard") * 0.9).drop("k1", "k2", "jaccard")
    return first.unionByName(deal(left, "alike", matched(one, two, links.unionByName(near)), "EQUIVALENT"))


def conflict_classes(g1: DataFrame, g2: DataFrame, matches: DataFrame, keys: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """The contradictions of the default judge by class: behavior, c1, n1, c2, n2, pairs. Unmatched rules of equal or similar
    token sets contradict if their qualities differ or their thresholds conflict; rules of one token set, quality and
    thresholds are one class (c1, c2: a hash of these; n1, n2: rules in it), so a group of copies is a row, not its pairs."""
    facts = rule_facts(g1, g2) if facts is None else facts

    def side(tag: str, n: str) -> DataFrame:
        return _classed(facts, matches, tag).groupBy("behavior", f"k{n}", f"c{n}", f"q{n}", f"v{n}").agg(F.count("*").alias(f"n{n}"))

    one, two = side("g1", "1"), side("g2", "2")
    equal = one.join(two.withColumnRenamed("k2", "k1"), ["behavior", "k1"])
    near = one.join((similar_keys(g1, g2, facts) if keys is None else keys).drop("jaccard"), ["behavior", "k1"]).join(two, ["behavior", "k2"])
    names = ["behavior", "c1", "q1", "v1", "n1", "c2", "q2", "v2", "n2"]
    pairs = equal.select(*names).unionByName(near.select(*names))
    clash = F.coalesce(F.col("q1") != F.col("q2"), F.lit(False)) | values_conflict(F.col("v1"), F.col("v2"))
    return pairs.where(clash).select("behavior", "c1", "n1", "c2", "n2", (F.col("n1") * F.col("n2")).alias("pairs"))


def _classed(facts: DataFrame, matches: DataFrame, tag: str) -> DataFrame:
    """Unmatched rules that can contradict, with key (k), quality (q), thresholds (v) and class (c)."""
    n = tag[-1]
    own = facts.where((F.col("side") == int(n)) & (F.col("q").isNotNull() | (F.size("v") > 0)))
    left = own.join(matches.select("behavior", F.col(tag).alias("rule_id")), ["behavior", "rule_id"], "left_anti")
    own = left.select("behavior", F.col("rule_id").alias(tag), F.col("k").alias(f"k{n}"), F.col("q").alias(f"q{n}"), F.col("v").alias(f"v{n}"))
    return own.withColumn(f"c{n}", F.xxhash64(f"k{n}", f"q{n}", F.array_join(f"v{n}", " ")))


def member_conflicts(g1: DataFrame, g2: DataFrame, matches: DataFrame) -> DataFrame:
    """behavior, g1, g2, confidence: conflict_classes() told rule by rule, for those who need each pair."""
    facts = rule_facts(g1, g2)
    classes = conflict_classes(g1, g2, matches, facts=facts).select("behavior", "c1", "c2")
    one = _classed(facts, matches, "g1").select("behavior", "c1", "g1")
    two = _classed(facts, matches, "g2").select("behavior", "c2", "g2")
    return classes.join(one, ["behavior", "c1"]).join(two, ["behavior", "c2"]).select("behavior", "g1", "g2", F.lit(0.5).alias("confidence"))


def contradictions(judged: DataFrame, matches: DataFrame) -> DataFrame:
    """Contradictory pairs neither of whose rules is matched; a rule may be in many."""
    c = judged.where("relationship = 'CONTRADICTORY'").select("behavior", "g1", "g2", "confidence")
    return c.join(matches.select("behavior", "g1"), ["behavior", "g1"], "left_anti").join(matches.select("behavior", "g2"), ["behavior", "g2"], "left_anti")


def intersection(matches: DataFrame) -> DataFrame:
    """The first graph's rule of each match, with where it came from."""
    return matches.select(F.concat(F.lit("MERGED_"), F.col("g1").cast("string")).alias("rule_id"), "behavior", F.lit("INTERSECTION").alias("operation"), F.struct(F.col("relationship").alias("match_type"), "confidence", F.col("g1").alias("g1_rule"), F.col("g2").alias("g2_rule")).alias("provenance"))


def exclusive(g: DataFrame, matches: DataFrame, side: str, operation: str) -> DataFrame:
    """Rules of one graph without a match. Contradicting rules are not matched, so they are here too."""
    return g.join(matches.select(F.col(side).alias("rule_id"), "behavior"), ["rule_id", "behavior"], "left_anti").select(F.col("rule_id").cast("string").alias("rule_id"), "behavior", F.lit(operation).alias("operation"))


def union_all(g1: DataFrame, g2: DataFrame, matches: DataFrame) -> DataFrame:
    merged = intersection(matches).select("rule_id", "behavior", F.lit("MERGED").alias("operation"))
    return merged.unionByName(exclusive(g1, matches, "g1", "G1_ONLY")).unionByName(exclusive(g2, matches, "g2", "G2_ONLY"))


def set_sizes(g1: DataFrame, g2: DataFrame, matches: DataFrame, conflicts: DataFrame) -> DataFrame:
    """operation, behavior, n of every set operation that has rows; union = intersection + both differences, so each part is
    counted once. conflicts are pairs, or classes with their number of pairs."""
    parts = (matches, exclusive(g1, matches, "g1", ""), exclusive(g2, matches, "g2", ""), conflicts)
    each = None
    for i, p in enumerate(parts):
        one = p.groupBy("behavior").agg((F.sum("pairs") if "pairs" in p.columns else F.count("*")).alias("n")).select("behavior", F.lit(i).alias("part"), "n")
        each = one if each is None else each.unionByName(one)
    n = lambda i: F.coalesce(F.sum(F.when(F.col("part") == i, F.col("n"))), F.lit(0))
    wide = each.groupBy("behavior").agg(*[n(i).alias(f"n{i}") for i in range(4)])
    told = {"INTERSECTION": F.col("n0"), "G1_MINUS_G2": F.col("n1"), "G2_MINUS_G1": F.col("n2"), "UNION": F.col("n0") + F.col("n1") + F.col("n2"), "CONTRADICTIONS": F.col("n3")}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("operation"), v.alias("n")) for k, v in told.items()]))
    return wide.select("behavior", rows.alias("r")).select("r.operation", "behavior", "r.n").where("n > 0")


def unique_rules(rules: DataFrame) -> DataFrame:
    """rules (ord, rule_id, rule_name) with new_id and new_name: later repeats get `_v2`, ` (Variant 2)`, and so on; a
    suffix that another rule already has is passed over. Dependencies are left alone. Empty ids and names stay.

    Names count in lower case without outer spaces. Only ids of which a suffixed form exists need more than a rank: for
    these the free suffixes are laid out and the ranks dealt to them.
    """
    turn = lambda k: F.row_number().over(W.partitionBy(k).orderBy("ord"))
    key = F.lower(F.trim("rule_name"))
    r = rules.withColumn("_t", turn(F.col("rule_id"))).withColumn("_n", turn(key))
    suffix = F.regexp_extract("rule_id", r"^(.*)_v(\d{1,9})$", 2)
    taken = rules.where(suffix != "").select(F.regexp_extract("rule_id", r"^(.*)_v(\d{1,9})$", 1).alias("_base"), suffix.cast("int").alias("s"), suffix.alias("raw")).where("raw = cast(s AS string)").groupBy("_base").agg(F.sort_array(F.collect_set("s")).alias("_taken"))
    r = r.join(taken, r["rule_id"] == taken["_base"], "left").drop("_base")
    # of rank t: the t-th number from 2 on that isn't taken, counted from 1
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_t"), lambda acc, x: F.when(x <= acc, acc + 1).otherwise(acc))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    new_id = F.when(blank("rule_id") | (F.col("_t") == 1), F.col("rule_id")).otherwise(F.concat_ws("_v", "rule_id", free.cast("string")))
    new_name = F.when(blank("rule_name") | (F.col("_n") == 1), F.col("rule_name")).otherwise(F.concat(F.col("rule_name"), F.lit(" (Variant "), F.col("_n").cast("string"), F.lit(")")))
    return r.select(*rules.columns, new_id.alias("new_id"), new_name.alias("new_name"))


def merge_batches(rules: DataFrame) -> DataFrame:
    """Rules of batches (bucket, batch, ord, rule_id, rule_name): one stays if no earlier batch of its bucket has its id
    or name. Repeats inside a batch stay, as each batch is held against those before it."""
    name = F.lower("rule_name")
    first = lambda k: F.min("batch").over(W.partitionBy("bucket", k))
    seen = rules.withColumn("_i", first(F.col("rule_id"))).withColumn("_n", first(name))
    return seen.where("batch = _i AND batch = _n").drop("_i", "_n")


def apply_duplicates(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """Drop the duplicates of groups (primary, duplicate), and note on each primary what it stands for.

    Where groups have a description, the primary takes it (that of the first duplicate which has one); where rules have
    examples, the primary's come first and those of its duplicates after, each once.
    """
    kept = rules.join(groups.select(F.col("duplicate").alias("rule_id")), "rule_id", "left_anti")
    told = [F.sort_array(F.collect_set("duplicate")).alias("merged_from")]
    if "description" in groups.columns:
        told.append(F.min_by(F.nullif(F.col("description"), F.lit("")), F.when(F.coalesce("description", F.lit("")) != "", F.col("duplicate"))).alias("_description"))
    info = groups.groupBy(F.col("primary").alias("rule_id")).agg(*told)
    out = kept.join(info, "rule_id", "left").withColumn("merge_count", F.when(F.col("merged_from").isNull(), 0).otherwise(F.size("merged_from")))
    if "description" in groups.columns:
        out = out.withColumn("description", F.coalesce("_description", "description")).drop("_description")
    if "examples" in rules.columns:
        more = groups.select("primary", "duplicate").join(rules.select(F.col("rule_id").alias("duplicate"), "examples").where(F.col("examples").isNotNull()), "duplicate")
        more = more.groupBy(F.col("primary").alias("rule_id")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("duplicate", "examples"))), lambda x: x["examples"])).alias("_more"))
        none = F.array().cast(rules.schema["examples"].dataType.simpleString())
        out = out.join(more, "rule_id", "left").withColumn("examples", F.when(F.col("_more").isNull(), F.col("examples")).otherwise(F.array_distinct(F.concat(F.coalesce("examples", none), "_more")))).drop("_more")
    return out.select(*rules.columns, "merged_from", "merge_count")


def duplicate_groups(rules: DataFrame, text: str = "text") -> DataFrame:
    """The exact part of the default verdict: rules of equal normalised text; the smallest id is primary."""
    r = rules.select("rule_id", F.xxhash64(normal(F.col(text))).alias("k"), F.md5(normal(F.col(text))).alias("m"))
    p = r.groupBy("k", "m").agg(F.min("rule_id").alias("primary"), F.count("*").alias("c")).where("c > 1")
    return r.join(p, ["k", "m"]).where(F.col("rule_id") != F.col("primary")).select("primary", F.col("rule_id").alias("duplicate"))


#: Passes over links before a search for components gives up: each doubles what is reached, so this is never met.
MOST_PASSES = 100


def _components(links: DataFrame) -> DataFrame:
    """id, p: the least node that links (a, b) lead to, for nodes with links."""
    edges = _cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    least = _cut(edges.select(F.col("a").alias("id")).distinct().withColumn("p", F.col("id")))
    for _ in range(MOST_PASSES):  # each takes the least primary of its neighbours, and then the primary of that
        near = edges.join(least.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("p").alias("q"))
        step = least.join(near, "id").select("id", "p", F.least("p", "q").alias("q"))
        step = _cut(step.join(least.select(F.col("id").alias("q"), F.col("p").alias("_up")), "q").select("id", "p", F.least("q", "_up").alias("q")))
        least = step.select("id", F.col("q").alias("p"))
        if step.where("q <> p").isEmpty():
            return least
    raise RuntimeError("components did not settle")


def _similar_components(x: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """id, p: the least id of the component that links between similar sets make, for sets (id, w) with links.

    Each set first meets one hub of each element that leads it (the least id of about its size), so a group of near copies
    costs a pair a set and element. Then only sets of unlike components that still share such an element meet: elements of
    one component are done. What is left out is within a component, so components are those of all links.
    """
    num, den = similar
    often = x.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    ranked = x.select("id", F.explode("w").alias("t")).join(often, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("e"))
    sets = _cut(ranked.select("id", F.col("e.t").alias("w"), F.size("e").cast("long").alias("n")))
    lead = F.expr(f"slice(w, 1, int(n - ({num} * n + {den - 1}) div {den}) + 1)")
    leads = sets.select("id", "n", F.floor(F.log("n") / F.log(F.lit(den / num))).alias("band"), F.posexplode(lead).alias("at", "t"))

    def alike(pairs: DataFrame) -> DataFrame:
        side = lambda tag: sets.select(F.col("id").alias(tag), F.col("w").alias(f"{tag}_w"), F.col("n").alias(f"{tag}_n"))
        found = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("a_w", "b_w")))
        return _cut(found.where(den * F.col("both") >= num * (F.col("a_n") + F.col("b_n") - F.col("both"))).select("a", "b"))

    hubs = leads.groupBy("t", "band").agg(F.min("id").alias("b"))
    stars = alike(leads.join(hubs, ["t", "band"]).where("id <> b").select(F.col("id").alias("a"), "b"))
    first = _components(stars)
    own = leads.join(first, "id", "left").withColumn("p", F.coalesce("p", "id"))
    several = own.groupBy("t").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo <> hi").select("t")
    own = _cut(own.join(several, "t", "left_semi"))
    side = lambda tag: own.select("t", F.col("id").alias(tag), *[F.col(c).alias(f"{tag}_{c}") for c in ("n", "at", "p")])
    most = F.least("a_at", "b_at") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    met = side("a").join(side("b"), "t").where("a_p < b_p")
    met = met.where((den * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n")) & ((num + den) * most >= num * (F.col("a_n") + F.col("b_n"))))
    across = alike(met)
    return _components(stars.unionByName(across))


def near_duplicate_groups(rules: DataFrame, text: str = "text", n: int = 5) -> DataFrame:
    """The whole default verdict: rules of equal normalised text, then of sets of n-word shingles whose Jaccard similarity
    is SIMILAR or more (a text of fewer words is one shingle). Groups are connected components; the smallest id is primary.
    """
    w = F.filter(F.split(normal(F.col(text)), " "), lambda x: x != "")
    r = _cut(rules.where(F.col(text).isNotNull()).select("rule_id", F.md5(normal(F.col(text))).alias("m"), w.alias("w")))
    one = r.groupBy("m").agg(F.min("rule_id").alias("id"), F.min_by("w", "rule_id").alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
    sets = _cut(one.where(F.size("w") > 0).select(F.lit(0).alias("g"), "id", F.array_distinct(grams).alias("w")))
    least = _similar_components(sets)
    primary = one.select("m", "id").join(least, "id", "left").select("m", F.coalesce("p", "id").alias("primary"))
    return r.select("rule_id", "m").join(primary, "m").where(F.col("rule_id") != F.col("primary")).select("primary", F.col("rule_id").alias("duplicate"))


def surviving(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Dependencies both of whose ends are still there."""
    ids = rules.select("rule_id")
    return edges.join(ids, edges["src"] == ids["rule_id"], "left_semi").join(ids, edges["dst"] == ids["rule_id"], "left_semi")


def apply_dependencies(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """rules with dependencies and dependent_rules; verdicts without both ends are passed over, stale entries dropped."""
    good = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> '' AND dst <> ''") if dict(edges.dtypes)["src"] == "string" else edges.where("src IS NOT NULL AND dst IS NOT NULL")
    out = good.groupBy(F.col("src").alias("rule_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("depends_on_rule"), "dependency_type", "strength", strength_confidence("strength").alias("confidence")))).alias("dependencies"))
    in_ = good.groupBy(F.col("dst").alias("rule_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("dependent_rule"), "dependency_type"))).alias("dependent_rules"))
    return rules.join(out, "rule_id", "left").join(in_, "rule_id", "left")


def cross_batch(edges: DataFrame, batches: DataFrame) -> DataFrame:
    """Dependencies between rules of unlike batches (rule_id, batch)."""
    b = batches.select("rule_id", "batch")
    e = edges.join(b.withColumnsRenamed({"rule_id": "src", "batch": "b1"}), "src").join(b.withColumnsRenamed({"rule_id": "dst", "batch": "b2"}), "dst")
    return e.where("b1 <> b2")


def enriched(rules: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Each rule with the definition of its entity or, by its entity_type, of its relationship; unmatched ones stay."""
    e = entities.select(F.col("name").alias("_e"), F.col("definition").alias("entity_definition"))
    r = relationships.select(F.col("name").alias("_r"), F.col("definition").alias("relationship_definition"))
    own = F.col("entity_or_relationship")
    is_e = F.col("entity_type") == "entity"
    return rules.join(e, is_e & (own == F.col("_e")), "left").join(r, ~is_e & (own == F.col("_r")), "left").drop("_e", "_r")


def canonical_names(rules: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """rules with entity_or_relationship as the catalog writes it; an entity wins over a relationship of its key."""
    from tessera.functions.text import entity_key

    names = entities.select("name", F.lit(0).alias("p")).unionByName(relationships.select("name", F.lit(1).alias("p")))
    best = names.groupBy(entity_key("name").alias("_k")).agg(F.min_by("name", F.struct("p", "name")).alias("_name"))
    out = rules.join(best, entity_key("entity_or_relationship") == F.col("_k"), "left")
    return out.withColumn("entity_or_relationship", F.coalesce("_name", "entity_or_relationship")).drop("_k", "_name")


def orphans(rules: DataFrame, names: DataFrame) -> DataFrame:
    """Rules whose entity or relationship is in no catalog."""
    return rules.join(names.select(F.col("name").alias("entity_or_relationship")), "entity_or_relationship", "left_anti")


def collected_references(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """primary, references: those of each primary and of the rules it stands for, the primary's first.

    rules: rule_id, source_reference (array of struct; a single one is an array of one).
    """
    members = groups.select("primary", F.col("duplicate").alias("rule_id"), F.lit(1).alias("o")).unionByName(groups.select("primary", F.col("primary").alias("rule_id"), F.lit(0).alias("o")).distinct())
    got = members.join(rules.select("rule_id", "source_reference"), "rule_id").groupBy("primary").agg(F.sort_array(F.collect_list(F.struct("o", "rule_id", "source_reference"))).alias("r"))
    return got.select("primary", F.flatten(F.filter(F.col("r.source_reference"), lambda x: x.isNotNull())).alias("references"))


def key_features(rules: DataFrame, cut: int = 500) -> DataFrame:
    """What a judge is told of a rule, as one JSON text."""
    fields = [c for c in ("rule_id", "rule_name", "rule_type", "rule_behavior", "conditions", "consequences") if c in rules.columns]
    return rules.select("rule_id", F.to_json(F.struct(*fields, F.substring("description", 1, cut).alias("description"))).alias("features"))


def rebucketed(rules: DataFrame, names: DataFrame, judge, attempts: int = 3) -> DataFrame:
    """Rules whose entity or relationship is in no catalog go to a judge up to `attempts` times: rows of orphans in, the same
    with `suggestion` out (a catalog name, null for none, `DROP` to drop the rule). What stays unknown is returned as it is."""
    known = names.select(F.col("name").alias("_known")).distinct()
    for _ in range(attempts):
        lost = orphans(rules, names)
        if lost.isEmpty():
            break
        told = judge(lost.select("rule_id", "entity_or_relationship")).select("rule_id", "suggestion")
        good = told.join(known, told["suggestion"] == known["_known"], "left_semi").unionByName(told.where("suggestion = 'DROP'"))
        out = rules.join(good, "rule_id", "left")
        out = out.where(~F.coalesce(F.col("suggestion") == "DROP", F.lit(False)))
        rules = out.withColumn("entity_or_relationship", F.coalesce("suggestion", "entity_or_relationship")).select(*rules.columns)
    return rules


def nested_by_bucket(rules: DataFrame) -> DataFrame:
    """bucket, rules: flat rules under their relationship, else their entity."""
    return rules.withColumn("bucket", F.coalesce(F.nullif(F.col("relationship"), F.lit("")), F.col("entity"))).groupBy("bucket").agg(F.sort_array(F.collect_list("rule_id")).alias("rules"))


def behavior_counts(rules: DataFrame, behaviors: list[str]) -> DataFrame:
    """behavior, graph 1 and graph 2 counts of every known behaviour, zeros kept, `unknown` left out."""
    n = rules.groupBy("behavior").agg(F.count_if(F.col("graph") == 1).alias("g1"), F.count_if(F.col("graph") == 2).alias("g2"))
    all_ = rules.sparkSession.createDataFrame([(b,) for b in behaviors], "behavior string")
    return all_.join(n, "behavior", "left").fillna(0, ["g1", "g2"])


def match_summary(clusters: DataFrame, matches: DataFrame, conflicts: DataFrame) -> DataFrame:
    """behavior, g1, g2, matches, contradictions, g1_unmatched, g2_unmatched of clusters (behavior, g1, g2: sizes)."""
    count = lambda df, name: df.groupBy("behavior").agg(F.count("*").alias(name))
    out = clusters.select("behavior", "g1", "g2").join(count(matches, "matches"), "behavior", "left").join(count(conflicts, "contradictions"), "behavior", "left").fillna(0, ["matches", "contradictions"])
    return out.withColumns({"g1_unmatched": F.col("g1") - F.col("matches"), "g2_unmatched": F.col("g2") - F.col("matches")})


def capped_batches(batched: DataFrame, target: int, per_batch: int) -> DataFrame:
    """Of numbered batches the first target // per_batch + 10: what is asked for, and some to spare."""
    return batched.where(F.col("batch") < target // per_batch + 10)


#: Set operations in the order in which they are listed.
OPERATIONS = ["INTERSECTION", "G1_MINUS_G2", "G2_MINUS_G1", "UNION", "CONTRADICTIONS"]


def comparison_listing(rows: DataFrame) -> DataFrame:
    """One row per comparison of rows (comparison, operation), with how many each operation has and all of them."""
    counts = [F.count_if(F.col("operation") == o).alias(o.lower()) for o in OPERATIONS]
    return rows.groupBy("comparison").agg(*counts, F.count("*").alias("rows"))
