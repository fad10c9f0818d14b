"""Prefix trie, periodic runs and license scan against brute force, and on nulls, blanks, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import license_scan, periodic_runs, prefix_trie
from tessera.llm.license_scan import BASE, NOTICES, Notice, normal

CONV = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- 11

def brute_trie(convs):
    """convs: conv_id -> list of (role, text)."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    out = {}
    for k, cs in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(k))
        out[k] = (min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], sum(not kids[x] for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), sha(ends))
    return sorted(out.values(), key=str)


def brute_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((-1 if turn is None else turn, turn is not None), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(t, key=lambda t: t[0])] for c, t in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        out[c] = base[:h] + own[c][h:]
    return out


def conversations(seed=3):
    r = random.Random(seed)
    start = [(("system", "same start é"), ("user", "hi")), (("system", "same start é"), ("user", "")), (("user", "x\U0001f600"),)]
    rows = []
    for c in [*range(0, 40), *range(100, 130), 277, 278, -5, -101, 5 * 10**12]:
        turns = list(r.choice(start)) + [(r.choice(["user", "assistant", None]), r.choice(["a", "bb", None, "ccc ccc"])) for _ in range(r.randint(0, 4))]
        rows += [(c, i if i else None, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(12, 50 + i, "user", "same") for i in range(300)] + [(13, 50 + i, "user", "same") for i in range(300)]
    rows += [(None, 1, "user", "lost"), (39, 90, "user", "twice"), (39, 90, "user", "twice")]
    r.shuffle(rows)
    return rows


def nodes(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("ends", [4096, 2])
def test_trie(spark, monkeypatch, ends):
    monkeypatch.setattr(prefix_trie, "ENDS", ends)
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).repartition(5)
    for c in ("pos", "depth", "node", "parent", "chars", "n_convs"):
        df = df.withColumn(c, F.lit("own"))
    turns = prefix_trie.placed_turns(df)
    got = prefix_trie.trie(turns.select("conv_id").distinct(), prefix_trie.rebuilt(turns))
    assert nodes(got) == brute_trie(brute_rebuilt(rows))
    plain = collections.defaultdict(list)
    for c, _, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], -1 if x[1] is None else x[1])):
        plain[c].append((role or "", text or ""))
    assert nodes(prefix_trie.prefix_trie(df)) == brute_trie(plain)


def test_trie_parents_of_many_children(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "max", lambda *_: 2, raising=False)  # every parent of two is joined by broadcast
    rows = conversations(8)
    turns = prefix_trie.placed_turns(spark.createDataFrame(rows, CONV))
    got = prefix_trie.trie(turns.select("conv_id").distinct(), prefix_trie.rebuilt(turns))
    assert nodes(got) == brute_trie(brute_rebuilt(rows))


def test_trie_without_turns(spark):
    """Conversation 7 keeps no turn of its own and has no base; the root is its only node."""
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    got = []
    for rows in ([], [(None, 0, "user", "x")], [(c, 0, "user", "x"), (c, 1, "user", "y")]):
        turns = prefix_trie.placed_turns(spark.createDataFrame(rows, CONV))
        got.append(nodes(prefix_trie.trie(turns.select("conv_id").distinct(), prefix_trie.rebuilt(turns))))
    assert got == [[], [], [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]]


def test_trie_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(prefix_trie.OP11_SQL)
    at = {c: i for i, c in enumerate(want.columns)}
    rows = [tuple(r[at[c]] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in want.fetchall()]
    assert nodes(prefix_trie.op11_trie(spark, sf)) == sorted(rows, key=str)


# ---- 12

def brute_runs(words, least=6, repeats=4):
    """Every stretch that can't be extended, for every period, and whether a smaller period does."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def wordy(seed):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        w = [r.choice("abc") for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = [r.choice("abcde") for _ in range(r.randint(1, 6))]
            at, n = r.randint(0, len(w)), r.randint(1, 40)
            w[at:at] = (p * n)[:n]
        out.append(w)
    return [*out, ["a"] * 300, thue_morse(600), thue_morse(64) * 5 + ["c"], ["a"] * 5, ["a"] * 6, [], list("abababab"), list("abababa")]


@pytest.mark.parametrize(("least", "repeats", "pairs"), [(6, 4, 1 << 20), (2, 2, 7), (6, 3, 50)])
def test_find_runs(monkeypatch, least, repeats, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    texts = wordy(repeats)[:: 1 if pairs > 100 else 9]
    ids = np.array([ord(w) - 97 for t in texts for w in t], np.int64)
    ends = np.cumsum([len(t) for t in texts])
    got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(ids, ends, least, repeats)), strict=True))
    want = []
    for t, e in zip(texts, ends.tolist(), strict=True):
        want += [(s + e - len(t), s + e - len(t) + n, q) for s, n, q in brute_runs(t, least, repeats)]
    assert got == sorted(want, key=lambda x: (x[0], x[2]))


def test_find_runs_when_hashes_agree_by_chance(monkeypatch):
    """With hashes of two bits nearly nothing is told apart at first; the search goes on until words agree."""
    fine, tries = periodic_runs.PrefixHashes.equal, []

    def weak(self, at, length, q):
        ok = fine(self, at, length, q)
        tries.append(1)
        return ok | (np.random.default_rng(len(tries)).random(at.size) < (0.3 if len(tries) < 40 else 0))

    monkeypatch.setattr(periodic_runs.PrefixHashes, "equal", weak)
    t = ["a", "b"] * 30 + list("cdefgcdcdcdcd") * 4
    ids = np.array([ord(w) - 97 for w in t], np.int64)
    got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(ids, np.array([len(t)]))), strict=True))
    assert got == [(s, s + n, q) for s, n, q in brute_runs(t)]


def test_long_text():
    t = np.concatenate([np.arange(50_000) * 7919 % 50_021, np.tile(np.arange(1000), 60), np.zeros(60_000, np.int64), np.arange(3)])
    s, e, q = periodic_runs.find_runs(t, np.array([t.size]))
    assert (50_000, 110_001, 1000) in set(zip(s.tolist(), e.tolist(), q.tolist(), strict=True))
    assert (110_000, 170_001, 1) in set(zip(s.tolist(), e.tolist(), q.tolist(), strict=True)) and len(s) == 2


def looped_words(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_op12(doc_id, text):
    w = looped_words(doc_id, text)
    runs = brute_runs(w)
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))), sha(brute_collapsed(w, runs)))


def test_runs_of_documents(spark, rows, odd, empty, tmp_path):
    texts = [r for r in rows if len(r[1] or "") < 5000]
    more = [(1000 + i, " ".join(t), "en", "s", 1) for i, t in enumerate(wordy(1))] + [(i, " ".join(f"w{j % 50}" for j in range(i)), "en", "s", 0) for i in range(200, 330)]
    df = spark.createDataFrame(texts + more, odd.schema[:5]).repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic_runs.op12_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_op12(r[0], r[1]) for r in texts + more), key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 60
    out = periodic_runs.periodic_runs(odd.withColumn("runs", F.lit("x")))
    assert [c for c in out.columns if c not in ("runs", "collapsed")] == [c for c in odd.columns if c != "runs"]
    assert out.count() == odd.count() and {r["_size"] for r in out.collect()} == {"own"}
    blank = [r for r in out.collect() if r["text"] is None]
    assert blank and all(r["runs"] == [] and r["collapsed"] == "" for r in blank)
    assert periodic_runs.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(3, np.int64), np.array([3]), 1, 1)


# ---- 13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    w = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def brute_labels(text):
    """Each notice is matched over the whole text, without seeds."""
    t = " ".join(WORD.findall((text or "").translate(LOWER)))
    return ",".join(sorted({n.label for n in map(lambda x: Notice(*x), NOTICES) if n.match.search(t)}))


def licensed(seed=4):
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz 23éß"
    out = ["Under the MIT License", "under-the\nmit/LICENSE. Apache License, Version 2.0 CC-BY-NC", "xunder the mit license", "under the mit licenses", "apache license version 20", "apache license version 3", "éunder the mit licenseé", "cc by nd", "cc by nc cc by nc", "", "  \t", None, "under the mit license under the mit licence" * 3, "0 1 2"]
    for _ in range(400):
        words = [r.choice(["the", "license", "under", "cc", "by", "nc", "é", "mit", "version", "2", "public"]) for _ in range(r.randint(0, 12))]
        for _ in range(r.randint(0, 2)):
            p = list(r.choice(NOTICES)[0])
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                i, kind = r.randrange(len(p)), r.random()
                if kind < 0.4:
                    p[i] = r.choice(letters)
                elif kind < 0.7:
                    p.insert(i, r.choice(letters))
                else:
                    del p[i]
            words.insert(r.randint(0, len(words)), "".join(p).upper() if r.random() < 0.3 else "".join(p))
        out.append(r.choice([" ", "-", "  ", "\n# "]).join(words))
    return out


def test_licenses(spark, tmp_path):
    texts = licensed()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in license_scan.op13_licenses(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = got[i]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute_base(t), t
        assert g["labels"] == brute_labels(t), t
        assert 0 <= g["score"] <= 1 and (g["score"] > 0) == bool(g["labels"]) and (g["score"] == 1) == any(p["edits"] == 0 for p in g["places"])
        words = WORD.findall((t or "").translate(LOWER))
        for p in g["places"]:
            assert " ".join(words[p["word"] : p["word"] + p["words"]]) == p["text"]
            assert regex.fullmatch(f"(?:{p['phrase']}){{e<={p['edits']}}}", p["text"])
    assert sum(any(p["edits"] for p in g["places"]) for g in got.values()) > 50


def test_license_windows_hold_every_match():
    n = Notice("under the mit license", "mit")
    text = normal("é under thé mit license ß under the mitt licens".encode())[0]
    assert [x[2] for x in n.near(text, [])] == [1, 2] and n.exact(text) == []
    with pytest.raises(ValueError):
        Notice("No, not so", "x")


def test_licenses_odd(odd, empty):
    got = license_scan.license_scan(odd.withColumn("places", F.lit("x")))
    assert got.count() == odd.count() and {r["_size"] for r in got.collect()} == {"own"}
    assert all(r["n_words"] == 0 and r["places"] == [] for r in got.collect() if not (r["text"] or "").strip())
    assert license_scan.license_scan(empty).count() == 0
