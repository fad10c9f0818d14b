"""Text functions as column expressions; only the sequence-matcher ratio needs Python."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Fixed values.
STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has",
    "have", "that", "this", "from", "with", "they", "been", "will", "each", "make", "like", "than", "them", "then",
    "into", "some", "when", "which",
]
TOKEN_STOP_WORDS = [
    "the", "and", "for", "that", "with", "this", "from", "are", "was", "were", "have", "has", "had", "into", "onto",
    "under", "over", "must", "shall", "such", "than", "then", "when", "where", "which", "while", "also", "only",
    "loan", "loans", "rule", "rules", "sample", "guideline", "guidelines", "example", "policy", "policies", "jtbd",
    "base", "version", "step", "steps", "review", "identify", "validate", "required", "information",
]
BREAKING = ["must", "shall", "required", "prohibited", "forbid", "mandatory", "not permitted", "violation", "penalty", "cease", "revoke", "terminate"]
MATERIAL = ["should", "recommend", "material", "significant", "threshold", "limit", "maximum", "minimum", "deadline", "timeframe", "calculate", "eligibility", "qualify", "condition", "process", "procedure"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strings(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def strip(text) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def sanitize_folder_name(name) -> Column:
    """Lower case, runs of other characters to one `_`, at most 100 characters, `untitled` if nothing is left."""
    trimmed = lambda c: F.regexp_replace(c, "^_+|_+$", "")
    clean = trimmed(F.substring(trimmed(F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "_")), 1, 100))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("untitled")).otherwise(clean)


def entity_key(name) -> Column:
    return F.regexp_replace(F.upper(F.trim(_col(name))), r"[\s-]+", "_")


def graph_key(name) -> Column:
    """Catalog names: lower case, other characters to `_`, runs collapsed, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(name))), "[^a-z0-9_]", "_"), "_+", "_"), "^_|_$", "")


def title_key(title) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(_col(title))), r"[\s()/_,\-]+", " "))


def words(text) -> Column:
    return F.filter(F.split(_col(text), r"\s+"), lambda x: x != "")


def word_count(text) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def key_phrases(text) -> Column:
    """Words of three letters or more, without stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(STOP_WORDS))


def tokens(text) -> Column:
    found = F.split(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin(TOKEN_STOP_WORDS))


def query_terms(text) -> Column:
    """Terms of a search query; letters of any script count."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.trim(_col(text))), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda x: F.length(x) > 2)


def section_codes(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(r"[A-Z]\d[\-\.\d]+"), F.lit(0)))


def numbers(text) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"\d+\.?\d*"), F.lit(0))


# How thresholds are written. (pattern, group, what stands before and after it)
THRESHOLDS = [
    (r"\d+\.?\d*\s*%", 0, "", ""),
    (r"\$[\d,]+\.?\d*", 0, "", ""),
    (r"(?i)\d+\s*(?:year|month|day|week)s?", 0, "", ""),
    (r"(?i)(?:score|fico|credit)\s*(?:of|>=?|<=?|minimum|maximum)?\s*(\d{3})", 1, "score:", ""),
    (r"(?i)(?:ctr|sar|currency\s+transaction|suspicious\s+activity)[^\d$]{0,50}\$?([\d,]{3,})", 1, "ctr_sar:$", ""),
    (r"(?i)(?:beneficial\s*owner(?:ship)?)[^%]{0,60}?(\d+)\s*%", 1, "bo_pct:", "%"),
]
# Lists that a text refers to.
LIST_REFERENCES = [
    (r"(?i)(?:fatf|grey.?list|high.?risk\s+jurisdiction|non.?cooperative)", "fatf_ref"),
    (r"(?i)(?:ofac|sdn|sanctions?\s+list|specially\s+designated)", "sanctions_ref"),
]


def thresholds(text) -> Column:
    """Percentages, amounts, durations, scores, reporting amounts, ownership shares and list references, in that order."""
    t, none = _col(text), F.array().cast("array<string>")

    def found(pattern: str, group: int, before: str, after: str) -> Column:
        own = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        return F.transform(own, lambda x: F.concat(F.lit(before), x, F.lit(after))) if before or after else own

    told = [found(*x) for x in THRESHOLDS]
    return F.concat(*told, *[F.when(F.regexp_like(t, F.lit(p)), F.array(F.lit(name))).otherwise(none) for p, name in LIST_REFERENCES])


def has_keyword(text, keywords) -> Column:
    return F.regexp_like(F.lower(_col(text)), F.lit(r"\b(?:" + "|".join(keywords) + r")\b"))


def frequency(text, needle) -> Column:
    """Occurrences that don't overlap; none of an empty needle."""
    t, n = _col(text), _col(needle)
    return F.when(F.length(n) > 0, ((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("int")).otherwise(F.lit(0))


def sentence_segments(text) -> Column:
    """Sentences of at least eight characters; `...` parts them too."""
    parts = F.split(_col(text), r"\s*\.{3}\s*")
    return F.filter(F.transform(F.flatten(F.transform(parts, lambda p: F.split(strip(p), r"(?<=\.)\s+(?=[A-Z])"))), strip), lambda s: F.length(s) >= 8)


def word_range(text, start, end) -> Column:
    """Words start (from 0) to end, end left out, joined by spaces."""
    w = words(text)
    return F.array_join(F.slice(w, _col(start) + 1, F.greatest(_col(end) - _col(start), F.lit(0))), " ")


def legacy_reference(text) -> Column:
    """`path | section` as a struct; without a bar all is the path."""
    t = _col(text)
    return F.struct(F.trim(F.split_part(t, F.lit("|"), F.lit(1))).alias("chunk_path"), F.trim(F.split_part(t, F.lit("|"), F.lit(2))).alias("section_id"))


def truncated(text, limit: int, marker: str = "...") -> Column:
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(marker))).otherwise(t)


def fenced_json(text) -> Column:
    """What stands in the first fence of a reply, or else from its first brace to its last."""
    t = _col(text)
    fence = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(fence != "", strip(fence)).otherwise(F.regexp_extract(t, r"(?s)[\[{].*[\]}]", 0))


def filename_key(path) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(_col(path), r"^.*[/\\]", "")), r"\.[a-z0-9]+$", ""), "[^a-z0-9]+", "_")


def display_name(name) -> Column:
    return F.initcap(F.regexp_replace(_col(name), "[-_]", " "))


def strip_html(html) -> Column:
    """Text of a page: scripts, styles and comments go, tags part words."""
    t = F.regexp_replace(_col(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " "))


@pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence-matcher ratio; null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


#: Fixed values of the read-only guard: steps count only when called, the others as words.
MUTATIONS = ("drop", "addv", "adde", "property", "remove")
HOST_TOKENS = ("system", "thread", "runtime", "process", "file", "import", "new ", "evaluate", "java.", "groovy.", "execfile", "exec(")


def safety_violation(query) -> Column:
    """The first blocked token of a traversal text, outside quotes; null if there is none."""
    q = F.regexp_replace(F.lower(F.coalesce(_col(query), F.lit(""))), "'[^']*'|\"[^\"]*\"", "")
    found = [F.when(F.regexp_like(q, F.lit(rf"\b{m}\s*\(")), F.lit(m)) for m in MUTATIONS]
    for t in HOST_TOKENS:
        literal = "\\Q" + t + "\\E"
        found.append(F.when(F.regexp_like(q, F.lit(literal if t[-1] in " (" else rf"\b{literal}\b")), F.lit(t.strip())))
    return F.coalesce(*found)
