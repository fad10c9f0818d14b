"""Language identification by hierarchical discrimination.

A linear classifier names the language family; within a family, one-versus-one linear support vector machines tell
the closely related languages apart by vote. Features are hashed byte n-grams of the whole text. Margins only rank the
languages that were learned; whether a text is in the winner at all is told by its mean log-likelihood per n-gram.

All labelled rows are learned from: their features are written once, and every step of the solver sums its gradients
over the whole table. Only weights and sums are in the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.common import discard, if_small, materialize, restored, set_aside, small_batches

DIMS = 4096
#: Cost of a row's squared hinge loss. The rows of a label weigh no more than its even share of EVEN rows together, so that
#: a label's size doesn't matter; each row counts.
COST, EVEN = 10.0, 3000
#: The solver ends where a gradient is so small a part of what it was at first.
TOLERANCE = 1e-3
#: What is summed over rows is rounded to these parts, so that sums of doubles are exact and no order of rows matters.
PARTS, SHARE_PARTS = float(1 << 18), float(1 << 24)
#: Evidence of held-out rows is counted in so many parts of a bit.
BIT_PARTS = 1024
UNKNOWN = "und"
#: Families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = regex.compile(r"\p{L}")
#: Bits per n-gram. A floor is so far below the median of held-out rows at least; chance in a text of n letters is worth
#: CHANCE standard deviations over sqrt(n).
SLACK, CHANCE = 2.0, 3.0

# letters in lower case and bytes over 127 stand for themselves, all else is a gap
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(text: bytes) -> np.ndarray:
    """Hashed counts of byte pairs and triples. The whole text counts."""
    total = np.zeros(DIMS)
    for at in range(0, len(text), 1 << 20):  # pieces overlap by two bytes, so that no triple is lost
        lead = 2 if at else 0
        b = _FOLD[np.frombuffer(text, np.uint8, min(len(text), at + (1 << 20)) - at + lead, at - lead)].astype(np.uint32)
        if not at:
            b = np.concatenate(([np.uint32(32)], b))
        if at + (1 << 20) >= len(text):
            b = np.append(b, np.uint32(32))
        pair = b[:-1] * np.uint32(257) + b[1:]
        keep = pair != 32 * 257 + 32
        total += np.bincount((pair * np.uint32(2654435761) >> np.uint32(20))[keep] if not at else (pair * np.uint32(2654435761) >> np.uint32(20))[1:][keep[1:]], minlength=DIMS)
        if b.size > 2:
            three = (pair[:-1] * np.uint32(263) + b[2:]) * np.uint32(2246822519)
            total += np.bincount((three >> np.uint32(20))[keep[:-1] & keep[1:]], minlength=DIMS)
    return total


def features(text: bytes) -> np.ndarray:
    """Square roots of hashed counts of byte pairs and triples, to length 1. The whole text counts."""
    total = np.sqrt(gram_counts(text))
    return (total / max(np.linalg.norm(total), 1e-12)).astype(np.float32)


def packed(text: bytes) -> bytes:
    """The n-grams of a text and their counts: 16-bit numbers, then 8-bit counts, or 32-bit ones where one is larger; their
    width is the last byte."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    kind = np.uint8 if counts.max() < 256 else np.uint32
    return at.astype(np.uint16).tobytes() + counts[at].astype(kind).tobytes() + bytes([kind().itemsize])


def unpacked(blobs: list[bytes]) -> np.ndarray:
    """Features of some texts from what packed() gave, rounded to PARTS."""
    x = np.zeros((len(blobs), DIMS))
    for row, blob in zip(x, blobs):
        n = (len(blob) - 1) // (2 + blob[-1])
        counts = np.frombuffer(blob[2 * n : -1], np.uint8 if blob[-1] == 1 else np.uint32).astype(np.float64)
        row[np.frombuffer(blob, np.uint16, n)] = np.rint(np.sqrt(counts / max(counts.sum(), 1.0)) * PARTS) / PARTS
    return x


def n_letters(text: bytes) -> int:
    """Bytes that are letters."""
    return sum(int(np.count_nonzero(_FOLD[np.frombuffer(text, np.uint8, min(len(text), at + (1 << 20)) - at, at)] != 32)) for at in range(0, len(text), 1 << 20))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine (the last is the bias), by dual coordinate descent. y: +1 or -1."""
    norm = np.einsum("ij,ij->i", x, x) + 1.0
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(x))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            own = x[i].astype(np.float64)
            new = min(max(alpha[i] - (y[i] * (w @ own + bias) - 1) / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * own
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


def shares_of(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over rows of features: the share of each n-gram, and the number of n-grams."""
    one = np.square(x, dtype=np.float64)  # features are square roots of shares
    least = np.where(one > 0, one, 1.0).min(axis=1, initial=1.0)
    return (np.rint(one * SHARE_PARTS) / SHARE_PARTS).sum(0), float(np.rint(1 / np.maximum(least, 1e-9)).sum())


def log_shares(share: np.ndarray, grams: float) -> np.ndarray:
    """Log2 of the n-gram shares of one label; the less text was seen, the more goes to unseen n-grams."""
    share = share / max(share.sum(), 1e-12)
    seen = min(0.95, grams / (grams + np.count_nonzero(share)))
    return np.log2(seen * share + (1 - seen) / DIMS).astype(np.float32)


def evidence(model: dict, label: str, x: np.ndarray, letters: int) -> float:
    """Mean log2-likelihood per n-gram of a text of so many letters in a label, with what chance can take from it."""
    i = model["names"].index(label)
    return float(np.square(x, dtype=np.float64) @ model["log"][i] + CHANCE * model["spread"][i] / np.sqrt(max(letters, 1)))


def above_floor(model: dict, label: str, x: np.ndarray, letters: int) -> float:
    """How far a text's evidence is above the floor: of its label, or of the mixture of learned labels that fits it best,
    as a text may hold several of them."""
    over = evidence(model, label, x, letters) - float(model["floor"][model["names"].index(label)])
    if over >= 0 or len(model["names"]) < 2:
        return over
    at = np.flatnonzero(x)
    weight, p = np.square(x[at], dtype=np.float64), np.exp2(model["log"][:, at], dtype=np.float64)
    w = np.full(len(p), 1 / len(p))
    for _ in range(20):
        w = w * ((p / (w @ p)) @ weight)
        w /= w.sum()
    mixed = weight @ np.log2(w @ p) + w @ (CHANCE * model["spread"] / np.sqrt(max(letters, 1)) - model["floor"])
    return max(over, float(mixed))


def set_floors(model: dict, middle: dict[str, float], low: float | None) -> dict:
    """The model with each label's least evidence, from labelled rows that it was not fitted on and names rightly.

    `middle` has the median evidence of such rows by label. A floor is the lower end (`low`, the 0.1 % quantile) of such
    rows over all labels, held against the label's median: SLACK below that median at least, and beyond it never under
    what n-grams drawn at random would give.
    """
    low = -SLACK if low is None else low
    for i, n in enumerate(model["names"]):  # a label without such rows: what its own shares give
        m = middle.get(n, float(np.exp2(model["log"][i], dtype=np.float64) @ model["log"][i]))
        model["floor"][i] = min(m - SLACK, max(m + low, -np.log2(DIMS)))
    return model


def layout(labels) -> dict:
    """Labels in order, their families, and the pairs of labels of one family."""
    names = sorted(set(labels))
    family = [FAMILY.get(n.lower().split("-")[0], n) for n in names]
    kinds = sorted(set(family))
    of = np.array([kinds.index(f) for f in family], int)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if of[i] == of[j]]
    return {"names": names, "of": of, "kinds": kinds, "pairs": pairs}


def signs(model: dict) -> np.ndarray:
    """For each classifier (families, if there are several, then pairs) and label: +1, -1, or 0 where it is not concerned."""
    of, n = model["of"], len(model["names"])
    top = [np.where(of == k, 1.0, -1.0) for k in range(len(model["kinds"]))] if len(model["kinds"]) > 1 else []
    pairs = [np.where(np.arange(n) == i, 1.0, np.where(np.arange(n) == j, -1.0, 0.0)) for i, j in model["pairs"]]
    return np.array([*top, *pairs]).reshape(len(top) + len(pairs), n)


def completed(model: dict, weights, log) -> dict:
    """The model: layout(), weights of families and of pairs; log-likelihoods of n-grams by label, their spread and the
    floors of evidence (none before set_floors)."""
    tops = len(model["kinds"]) if len(model["kinds"]) > 1 else 0
    log = np.array(log, np.float32).reshape(len(model["names"]), DIMS)
    p = np.exp2(log, dtype=np.float64)
    spread = np.sqrt(np.maximum((p * np.square(log)).sum(1) - np.square((p * log).sum(1)), 0.0))
    return model | {"top": np.array(weights[:tops]), "rows": np.array(weights[tops:]), "log": log, "spread": spread, "floor": np.full(len(log), -np.inf)}


def fit(x: np.ndarray, labels: list[str]) -> dict:
    """The model of rows that are held in memory. train() learns from tables."""
    model = layout(labels)
    at = np.array([model["names"].index(v) for v in labels], int)
    weights = [fit_svm(x[y != 0], y[y != 0]) for y in signs(model)[:, at]]
    return completed(model, weights, [log_shares(*shares_of(x[at == i])) for i in range(len(model["names"]))])


def minimise(evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, size: int, tolerance: float = TOLERANCE, memory: int = 10) -> np.ndarray:
    """The minima of n smooth convex functions of `size` numbers each, by L-BFGS, all in the same evaluations.

    evaluate(points, which) gives the values and gradients of the functions `which`. A function is done where its gradient
    is `tolerance` times its first one, or no step lowers it any more.
    """
    best, trial, slope, step = np.zeros((n, size)), np.zeros((n, size)), np.zeros(n), np.ones(n)
    value, gradient, way, first = np.full(n, np.inf), np.zeros((n, size)), np.zeros((n, size)), np.zeros(n)
    past: list[list] = [[] for _ in range(n)]
    live = np.arange(n)
    while live.size:
        values, gradients = evaluate(trial[live], live)
        more = []
        for k, f, g in zip(live.tolist(), values, gradients):
            if f > value[k] + 1e-4 * step[k] * slope[k]:  # too far: back to the minimum of a parabola
                step[k] *= min(max(-slope[k] * step[k] / (2 * (f - value[k] - slope[k] * step[k])), 0.1), 0.5)
                if step[k] < 1e-8:
                    continue
            else:
                if value[k] < np.inf:
                    s, y = trial[k] - best[k], g - gradient[k]
                    past[k] = [*past[k], (s, y)][-memory:] if s @ y > 1e-12 * (y @ y) else past[k]
                else:
                    first[k] = np.linalg.norm(g)
                best[k], value[k], gradient[k] = trial[k], f, g
                if np.linalg.norm(g) <= tolerance * first[k]:
                    continue
                q, shares = g.copy(), []
                for s, y in reversed(past[k]):
                    shares.append(s @ q / (s @ y))
                    q -= shares[-1] * y
                q *= past[k][-1][0] @ past[k][-1][1] / (past[k][-1][1] @ past[k][-1][1]) if past[k] else 1 / np.linalg.norm(g)
                for (s, y), a in zip(past[k], reversed(shares)):
                    q += s * (a - y @ q / (s @ y))
                way[k], slope[k], step[k] = -q, -(g @ q), 1.0
            trial[k] = best[k] + step[k] * way[k]
            more.append(k)
        live = np.array(more, int)
    return best


def losses(x: np.ndarray, weights: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Sums over rows of each classifier's squared hinge loss and its gradient (the last place is the bias): one row a
    classifier. y: +1, -1 or 0 by row and classifier. x and terms are rounded, so sums over any blocks of rows add up alike."""
    short = np.maximum(0.0, 1 - y * (x @ weights[:, :-1].T + weights[:, -1])) * (y != 0)
    loss = np.rint(cost[:, None] * short * short * PARTS) / PARTS
    pull = np.rint(-2 * cost[:, None] * short * y * PARTS) / PARTS
    on = pull.any(axis=1)  # only rows that a classifier is short of pull at it
    return np.hstack([loss.sum(0)[:, None], pull[on].T @ x[on], pull.sum(0)[:, None]])


def predict_many(model: dict, x: np.ndarray) -> list[tuple[str, float]]:
    """Label and score from 0 to 1 of each row of features: all margins in two products, then the votes of each family."""
    names, of = model["names"], model["of"]
    if not names or not len(x):
        return [(UNKNOWN, 0.0)] * len(x)
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    kind, sure = np.zeros(len(x), int), np.ones(len(x))
    if len(model["kinds"]) > 1:
        m = x @ model["top"].T
        kind = m.argmax(1)
        second = np.partition(m, -2, axis=1)[:, -2]
        sure = 1 / (1 + np.exp(-2 * (m.max(1) - second)))
    best, margin = np.zeros(len(x), int), np.full(len(x), np.inf)
    ends = np.array(model["pairs"], int).reshape(-1, 2)
    for k in np.unique(kind):
        rows, inside = np.flatnonzero(kind == k), np.flatnonzero(of == k)
        own = np.flatnonzero(of[ends[:, 0]] == k)
        votes, least = np.zeros((rows.size, inside.size)), np.full((rows.size, inside.size), np.inf)
        m = x[rows] @ model["rows"][own].T if own.size else np.zeros((rows.size, 0))
        for j, (a, b) in enumerate(np.searchsorted(inside, ends[own])):
            won = m[:, j] >= 0
            votes[:, a] += won
            votes[:, b] += ~won
            least[:, a], least[:, b] = np.minimum(least[:, a], m[:, j]), np.minimum(least[:, b], -m[:, j])
        # most votes, then the larger least margin, then the first label
        top = np.where(votes == votes.max(1, keepdims=True), least, -np.inf).argmax(1)
        best[rows], margin[rows] = inside[top], least[np.arange(rows.size), top]
    score = sure / (1 + np.exp(-2 * np.maximum(margin, -20.0)))
    return [(names[i], float(v)) for i, v in zip(best, score)]


def predict(model: dict, x: np.ndarray) -> tuple[str, float]:
    """Label and score from 0 to 1 of one feature vector."""
    return predict_many(model, x[None, :])[0]


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier is fitted on; floors of rejection are set on them. A null doc_id counts as the text `null`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def _bound(share: Column, rows: Column) -> Column:
    """Least signed hash of a row that is left out, so that some four times `share` of `rows` rows stay, or all."""
    part = F.least(F.lit(1.0), (share * 4.0 + 64.0) / F.greatest(rows.cast("double"), F.lit(1.0)))
    return F.when(part >= 1.0, F.lit((1 << 63) - 1)).otherwise((F.lit(-float(1 << 63)) + part * float(1 << 63) * 2.0).cast("long"))


def chosen_rows(docs: DataFrame, limit: int, floor: int) -> DataFrame:
    """A sample for trials; train() does not use it. lang, text, _held: of each label at most its share of `limit` rows that are not held out, and of `floor` held-out
    ones: those of smallest hash, whatever the label's size. At least one row of each label, so that all are learned.

    Repeated rows count once. First a bound on the hash leaves some more than the share of each label (from its estimated
    number of rows, so one aggregation with a bounded sketch), and only these are ranked.
    """
    h = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("train"))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", held_out(F.col("doc_id")).alias("_held"), h.alias("_h"))
    sizes = materialize(known.groupBy("lang", "_held").agg(F.approx_count_distinct("_h").alias("_n")), "sizes")
    labels = max(1, sizes.select("lang").distinct().count())
    share = F.when(F.col("_held"), max(1, floor // labels) if floor else 0).otherwise(max(1, limit // labels))
    bounds = sizes.select(F.col("lang").alias("_l"), F.col("_held").alias("_b"), share.alias("_share"), _bound(share, F.col("_n")).alias("_most")).where("_share > 0")
    near = known.join(if_small(bounds), (known["lang"] == F.col("_l")) & (known["_held"] == F.col("_b")) & (known["_h"] <= F.col("_most"))).dropDuplicates(["lang", "_held", "_h"])
    turn = F.row_number().over(W.partitionBy("lang", "_held").orderBy("_h"))
    return near.withColumn("_turn", turn).where("_turn <= _share").select("lang", "text", "_held")


def _featured(docs: DataFrame, floors: bool) -> DataFrame:
    """lang, held, letters, x (packed counts) of every row with lang and a letter; of held-out ones only with `floors`."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                texts = [t.as_py().encode() for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([n_letters(t) for t in texts], pa.int64()), pa.array([packed(t) for t in texts], pa.binary())], names=["lang", "held", "letters", "x"])

    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", held_out(F.col("doc_id")).alias("held"))
    return materialize((known if floors else known.where("NOT held")).mapInArrow(run, "lang string, held boolean, letters long, x binary"), "features")


def _summed(rows: DataFrame, shape: tuple[int, int], of: Callable[[np.ndarray, list[str]], np.ndarray]) -> np.ndarray:
    """The sum of of(x, labels), an array of this shape, over all blocks of rows. Each task adds up its blocks, Spark the
    tasks' numbers; the driver gets one array, however many tasks there are."""

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                b = batch.slice(a, 128)
                total += of(unpacked(b.column(1).to_pylist()), b.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.float64())], names=["at", "v"])

    found, out = rows.select("lang", "x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow(), np.zeros(shape[0] * shape[1])
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out.reshape(shape)


def _floors(model: dict, held: DataFrame) -> dict:
    """set_floors() from all held-out rows: their evidence, in parts of a bit, is counted by label."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                x, labels = unpacked(b.column(2).to_pylist()), b.column(0).to_pylist()
                right = [i for i, (p, _) in enumerate(predict_many(model, x)) if p == labels[i]]
                told = [round(evidence(model, labels[i], x[i], b.column(1)[i].as_py()) * BIT_PARTS) for i in right]
                yield pa.RecordBatch.from_arrays([pa.array([labels[i] for i in right], pa.string()), pa.array(told, pa.int64())], names=["lang", "v"])

    counts = materialize(held.select("lang", "letters", "x").mapInArrow(run, "lang string, v long").groupBy("lang", "v").agg(F.count("*").alias("n")), "evidence")
    middle = materialize(counts.groupBy("lang").agg(F.percentile("v", 0.5, F.col("n")).alias("m")), "medians")
    low = counts.join(if_small(middle), "lang").agg(F.percentile(F.col("v") - F.col("m"), 0.001, F.col("n"))).first()[0]
    of = {r["lang"]: r["m"] / BIT_PARTS for r in middle.collect()}  # a row a label
    discard(counts, middle)
    return set_floors(model, of, None if low is None else low / BIT_PARTS)


def train(docs: DataFrame, floors: bool = True) -> dict:
    """Learn from all rows that are not held out and have text with a letter and lang, whatever their label's size; set the
    floors of rejection on all held-out ones. Without `floors`, nothing is learned from held-out rows.

    Families and pairs are the support vector machines (squared hinge loss) of all those rows: each pass over the table of
    features gives the sums for one step of all classifiers. Rows count as often as they stand; no order or number of
    partitions matters. Without such rows the model knows no language.
    """
    small_batches(docs.sparkSession)
    table = _featured(docs, floors)
    rows = table.where("NOT held")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a label
    model = layout(sizes)
    names, sign = model["names"], signs(model)
    cost = COST * np.array([min(1.0, max(1, EVEN // len(names)) / sizes[n]) for n in names])
    place = {n: i for i, n in enumerate(names)}

    def shares(x: np.ndarray, labels: list[str]) -> np.ndarray:
        at, out = np.array([place[v] for v in labels]), np.zeros((len(names), DIMS + 1))
        for i in np.unique(at):
            out[i, :-1], out[i, -1] = shares_of(x[at == i])
        return out

    def evaluate(weights: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def lost(x: np.ndarray, labels: list[str]) -> np.ndarray:
            at = np.array([place[v] for v in labels])
            return losses(x, weights, sign[which][:, at].T, cost[at])

        total = _summed(rows, (len(which), DIMS + 2), lost)
        return total[:, 0] + np.square(weights).sum(1) / 2, total[:, 1:] + weights

    seen = _summed(rows, (len(names), DIMS + 1), shares) if names else []
    model = completed(model, minimise(evaluate, len(sign), DIMS + 1), [log_shares(v[:-1], v[-1]) for v in seen])
    if floors and names:
        model = _floors(model, table.where("held"))
    discard(table)
    return model


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with _lang_pred and _score. Without a model, one is learned from docs.

    Null text and text without a letter are `und` with score 0; so is all text if nothing could be learned. An empty
    table gives an empty one. Nothing but the text decides.
    """
    return _identified(docs, model, [])


def _identified(docs: DataFrame, model: dict | None, more: list[str]) -> DataFrame:
    """identify(); with more = [`_over`] also how far the evidence for the label is above its floor, null for `und`."""
    small_batches(docs.sparkSession)
    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("_lang_pred", "_score", *more)
    schema = StructType([*kept.schema.fields, StructField("_lang_pred", StringType()), StructField("_score", DoubleType()), *(StructField(c, DoubleType()) for c in more)])
    at = kept.columns.index("text")

    def told_of(texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        model, found = shared.value, [(UNKNOWN, 0.0, None)] * len(texts)
        own = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if own and model["names"]:
            x = np.stack([features(texts[i].encode()) for i in own])
            for i, row, (label, score) in zip(own, x, predict_many(model, x)):
                found[i] = label, score, above_floor(model, label, row, n_letters(texts[i].encode())) if more else None
        return found

    def run(batches):
        for batch in batches:
            found = []
            for a in range(0, batch.num_rows, 256):
                found += told_of(batch.column(at).slice(a, 256).to_pylist())
            told = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64())[: 2 + len(more)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, "_lang_pred", "_score", *more])

    return kept.mapInArrow(run, schema)


def accept(docs: DataFrame, least: float = 0.25, model: dict | None = None) -> DataFrame:
    """The rows of docs whose language can be told: not `und`, with a score of `least` or more, and with no less evidence
    for the language, or for a mixture of learned ones, than its floor. Scores rank the learned languages and hardly fall
    below 0.25; text in none of them (other languages, code, random letters) goes by its evidence.

    A null lang is filled with the prediction; a given one stays.
    """
    used = ("text", "lang")
    out = _identified(set_aside(docs, *used), train(docs) if model is None else model, ["_over"]).where((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= least) & (F.col("_over") >= 0))
    return restored(out.withColumn("lang", F.coalesce("lang", "_lang_pred")), docs.columns, *used)


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs, floors=False))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
