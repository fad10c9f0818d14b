"""Packing against the best there is, splitters against sorted prefix sums."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, sharding


def fewest_bins(lengths, capacity):
    """Over all subsets: the least (bins, fill of the last one), which is enough to know for the next piece."""
    best = [(1, 0)] + [None] * ((1 << len(lengths)) - 1)
    for s in range(1, 1 << len(lengths)):
        for i, x in enumerate(lengths):
            if s >> i & 1:
                bins, fill = best[s ^ 1 << i]
                new = (bins, fill + x) if fill + x <= capacity else (bins + 1, x)
                if best[s] is None or new < best[s]:
                    best[s] = new
    return best[-1][0]


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_against_the_optimum(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 37, 100])
    lengths = [r.randint(1, capacity if r.random() < 0.3 else capacity // 2) for _ in range(r.randint(1, 10))]
    bins, used = packing.best_fit(np.array(lengths), capacity)
    fill = np.bincount(bins, weights=lengths, minlength=used)
    least = fewest_bins(lengths, capacity)
    assert fill.max() <= capacity and (fill > 0).all() and len(fill) == used
    assert packing.lower_bound(np.array(lengths), capacity) <= least <= used <= 11 / 9 * least + 6 / 9


@pytest.mark.parametrize("seed,shards,tolerance", [(1, 2, 0.001), (2, 8, 0.001), (3, 5, 0.05), (4, 8, 0.0)])
def test_splitters_against_sorted_prefix_sums(spark, seed, shards, tolerance):
    """Each splitter lies within the tolerance of its goal, or no boundary between rows lies nearer."""
    r = random.Random(seed)
    hashes = [r.getrandbits(60) for _ in range(40)]
    rows = sorted({(r.choice(hashes[:3]) if r.random() < 0.4 else r.choice(hashes), r.randint(-50, 500)): r.choice([1, 7, 300, 5000]) for _ in range(300)}.items())
    keys = spark.createDataFrame([(h, d, s) for (h, d), s in rows], "_h long, _d long, _size long").repartition(3)
    splitters, total = sharding.find_splitters(keys, shards, tolerance)
    ends = np.cumsum([0, *[s for _, s in rows]])
    assert total == ends[-1] and splitters == sorted(splitters)
    for k, cut in enumerate(splitters, 1):
        below, goal = sum(s for key, s in rows if key < tuple(cut)), k * total / shards
        assert abs(below - goal) <= max(tolerance * total / shards, np.abs(ends - goal).min())


def test_splitters_of_one_text(spark):
    """Copies of one text are cut by doc_id."""
    keys = spark.range(1000).select(F.lit(5).cast("long").alias("_h"), F.col("id").alias("_d"), F.lit(3).cast("long").alias("_size"))
    assert sharding.find_splitters(keys, 4, 0.001) == ([(5, 250), (5, 500), (5, 750)], 3000)
