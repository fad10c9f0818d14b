"""Scores, classes and safe casts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import BREAKING, MATERIAL, has_keyword

# Fixed values.
CONFIDENCE_WEIGHTS = {"extraction_clarity": 0.30, "numeric_precision": 0.25, "context_completeness": 0.20, "source_authority": 0.15, "logical_consistency": 0.10}
DEPENDENCY_WEIGHTS = {"semantic_similarity": 0.25, "logical_connection": 0.30, "temporal_ordering": 0.20, "cross_reference": 0.15, "domain_relevance": 0.10}
STRENGTH_CONFIDENCE = {5: 95, 4: 85, 3: 75, 2: 65, 1: 55}
TYPE_AFFINITY = {
    ("constraint", "validation"): 0.9,
    ("constraint", "eligibility"): 0.8,
    ("constraint", "prohibition"): 0.7,
    ("eligibility", "documentation"): 0.6,
    ("eligibility", "process"): 0.7,
    ("process", "documentation"): 0.8,
    ("process", "validation"): 0.7,
    ("prohibition", "validation"): 0.6,
    ("documentation", "validation"): 0.7,
}
PRICES = {
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "o1": (15.00, 60.00),
    "o1-mini": (1.10, 4.40),
    "o3": (2.00, 8.00),
    "o3-mini": (1.10, 4.40),
    "o4-mini": (1.10, 4.40),
}
BEHAVIOR_OF_TYPE = {
    "eligibility": "threshold",
    "constraint": "threshold",
    "compliance": "mandate",
    "validation": "method",
    "documentation": "mandate",
    "process": "sequence",
    "calculation": "formula",
    "prohibition": "prohibition",
    "definition": "classification",
    "exception": "classification",
    "reporting": "mandate",
    "monitoring": "method",
    "screening": "method",
    "investigation": "sequence",
    "onboarding": "sequence",
    "clinical_guideline": "mandate",
    "patient_safety": "prohibition",
    "hipaa_privacy": "mandate",
    "billing_compliance": "method",
    "consent_requirement": "mandate",
    "credentialing": "mandate",
    "quality_measure": "method",
    "regulatory": "mandate",
    "credit_policy": "threshold",
    "collateral": "threshold",
    "covenant": "threshold",
    "underwriting": "method",
    "risk_assessment": "method",
    "pricing": "threshold",
}
BEHAVIORS = ["formula", "classification", "threshold", "prohibition", "timing", "sequence", "method", "mandate"]
REVIEW_BELOW = 70.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def safe_float(value, default: float = 0.0) -> Column:
    return F.coalesce(_col(value).try_cast("double"), F.lit(default))


def safe_int(value, default: int = 0) -> Column:
    return F.coalesce(_col(value).try_cast("double").try_cast("int"), F.lit(default))


def clamp01(value, default: float = 0.5) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), safe_float(value, default)))


def weighted_confidence(breakdown, weights: dict = CONFIDENCE_WEIGHTS) -> Column:
    """Sum of value times weight over a map; a missing key counts as 0. Rounded half up to 2 places."""
    parts = [F.coalesce(F.try_element_at(_col(breakdown), F.lit(k)), F.lit(0.0)) * w for k, w in weights.items()]
    return F.round(sum(parts[1:], parts[0]), 2)


def dependency_confidence(breakdown, weights: dict = DEPENDENCY_WEIGHTS) -> Column:
    """Weighted mean over the keys that are there; else the mean of all values; 50 of none."""
    m = _col(breakdown)
    total, mass = F.lit(0.0), F.lit(0.0)
    for k, w in weights.items():
        v = F.try_element_at(m, F.lit(k))
        total, mass = total + F.coalesce(v * w, F.lit(0.0)), mass + F.when(v.isNotNull(), w).otherwise(0.0)
    values = F.map_values(m)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))
    return F.when(m.isNull() | (F.size(m) == 0), 50.0).when(mass > 0, F.round(F.try_divide(total, mass), 2)).otherwise(F.round(mean, 2))


def strength_confidence(strength, times20: bool = False) -> Column:
    s = _col(strength).cast("int")
    return (s * 20).cast("int") if times20 else F.coalesce(lookup(STRENGTH_CONFIDENCE, s), F.lit(70))


def severity(text, affected) -> Column:
    return F.when(has_keyword(text, BREAKING), "breaking").when(has_keyword(text, MATERIAL) | (_col(affected) >= 5), "material").otherwise("cosmetic")


def recommendation(severity_, names) -> Column:
    """Advice by severity; names: array of affected rule names, the first three are told."""
    n, s = _col(names), _col(severity_)
    told = F.array_join(F.slice(n, 1, 3), ", ")
    return (
        F.when(F.size(n) <= 0, "No rules directly affected. Review for indirect upstream/downstream impact.")
        .when(s == "breaking", F.concat(F.lit("URGENT: Review and update rules immediately: "), told))
        .when(s == "material", F.concat(F.lit("Review for compliance within next review cycle: "), told))
        .otherwise(F.concat(F.lit("Minor update — verify accuracy: "), told))
    )


def type_affinity(a, b) -> Column:
    """Symmetric affinity of two rule types: 0.5 for one type, 0.3 by default."""
    a, b = _col(a), _col(b)
    table = {f"{x}|{y}": v for (x, y), v in TYPE_AFFINITY.items()} | {f"{y}|{x}": v for (x, y), v in TYPE_AFFINITY.items()}
    return F.when(a == b, 0.5).otherwise(F.coalesce(lookup(table, F.concat_ws("|", a, b)), F.lit(0.3)))


def suggestion_score(semantic, same_entity, same_category, same_type, affinity) -> Column:
    one = lambda c, w: F.when(_col(c), w).otherwise(0.0)
    structural = one(same_entity, 0.5) + one(same_category, 0.3) + one(same_type, 0.2)
    return F.least(_col(semantic), F.lit(1.0)) * 0.5 + structural * 0.3 + _col(affinity) * 0.2


def suggestion_strength(score) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(_col(score) * 5, 0).cast("int")))


def token_cost(model, prompt, completion, prices: dict = PRICES) -> Column:
    """Dollars by the price of the model, or of the longest listed name that begins its name; 0 if none does."""
    key = F.lower(F.coalesce(_col(model), F.lit("")))
    cost = lambda r: (_col(prompt) * r[0] + _col(completion) * r[1]) / 1_000_000
    out = F.lit(0.0)
    for name in sorted(prices, key=len):  # the longest ends outermost
        out = F.when(key.startswith(name), cost(prices[name])).otherwise(out)
    return out


def behavior(rule_behavior, rule_type) -> Column:
    """A valid behaviour as it is, else that of the legacy type, else `unknown`."""
    b = F.lower(F.coalesce(_col(rule_behavior), F.lit("")))
    return F.when(b.isin(BEHAVIORS), b).otherwise(F.coalesce(lookup(BEHAVIOR_OF_TYPE, F.lower(F.coalesce(_col(rule_type), F.lit("")))), F.lit("unknown")))
