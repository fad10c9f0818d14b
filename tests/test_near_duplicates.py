import random

import pytest

from tessera.operators import match


def brute(sets):
    """The least id of each component of all pairs that are alike, for ids with links."""
    ids = sorted(sets)
    p = {i: i for i in ids}
    linked = set()
    for i in ids:
        for j in ids:
            if i < j and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                linked |= {i, j}
                a, b = p[i], p[j]
                p = {k: min(a, b) if v in (a, b) else v for k, v in p.items()}
    return {i: p[i] for i in linked}


@pytest.mark.parametrize("seed", range(3))
def test_components_by_hubs(spark, seed):
    """Groups of near copies, chains across hubs and sizes, sets that share only frequent elements."""
    r = random.Random(seed)
    sets, n = {}, 0
    for group in range(12):
        base = set(r.sample(range(60 if group % 2 else 500), r.randint(1, 30)))
        for _ in range(r.choice([1, 2, 25])):
            sets[n] = set(base)
            for _ in range(r.randint(0, max(1, len(base) // 6))):
                sets[n].discard(r.choice(sorted(base)))
                sets[n].add(r.randrange(500))
            n += 1
            if r.random() < 0.3:  # a chain: the next one starts from this one
                base = sets[n - 1]
    x = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, w array<long>")
    got = {row["id"]: row["p"] for row in match._similar_components(x).collect()}
    assert got == brute(sets) and len(got) > 20


def test_near_duplicates_edges(spark):
    none = spark.createDataFrame([], "rule_id long, text string")
    assert match.near_duplicate_groups(none).count() == 0
    rows = [(1, None), (2, ""), (3, " "), (4, "one two"), (5, "One  two"), (6, "one two three")]
    got = match.near_duplicate_groups(spark.createDataFrame(rows, "rule_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(2, 3), (4, 5)]


@pytest.mark.parametrize("frequent", [match.FREQUENT, 20])
def test_similar_sets_by_sketches(spark, monkeypatch, frequent):
    """All pairs that brute force finds, whatever part of the elements is told apart by frequency; small, large and empty
    sets, of two groups."""
    monkeypatch.setattr(match, "FREQUENT", frequent)
    monkeypatch.setattr(match, "STEP", 7)
    r, sides = random.Random(4), []
    bases = [[r.getrandbits(63) - 2**62 for _ in range(n)] for n in (1, 3, 8, 40, 1500)]
    shared = r.sample(range(1000), 200)
    for _ in range(2):
        rows = [(g, 0, []) for g in "xy"]
        for i in range(1, 60):
            w = set(r.choice(bases)) | set(r.sample(shared, r.randrange(3)))
            w = {v for v in w if r.random() > 0.1} | {r.choice(shared) for _ in range(r.randrange(4))}
            rows.append((r.choice("xy"), i, sorted(w)))
        sides.append(rows)
    want = sorted((g, a, b, len(set(v) & set(w))) for g, a, v in sides[0] for h, b, w in sides[1] if g == h and v and w and 4 * len(set(v) & set(w)) >= 3 * len(set(v) | set(w)))
    got = match.similar_sets(*[spark.createDataFrame(x, "g string, id int, w array<long>") for x in sides])
    assert sorted(map(tuple, got.select("g", "a", "b", "both").collect())) == want and len(want) > 100
