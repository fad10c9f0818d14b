"""License notices in texts, exact and with a few edits.

A notice of which k edits are allowed is split into k + 1 pieces; wherever it stands with k edits at most, one piece at
least stands unchanged. Pieces are looked for exactly, and only the surroundings of their places are matched, by the
regex library with a bound on errors, which tells edits and span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import set_aside, small_batches

# The phrases asked for, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Further notices.
MORE = [
    ("permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license", "apache"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
]
NOTICES = BASE + MORE
#: One edit is allowed for so many characters of a notice.
PER_EDIT = 10
#: All that isn't a digit, a letter or beyond ASCII stands between words; capitals are lowered.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
RESULT = "n_words long, places array<struct<label: string, phrase: string, word: bigint, words: bigint, edits: bigint, text: string>>"


def normal(text: bytes | None) -> tuple[bytes, int]:
    """Lower-cased words with one space between, and how many there are."""
    words = (text or b"").translate(_TABLE).split()
    return b" ".join(words), len(words)


class Notice:
    """A phrase of words with one space between, its label, and how many edits it may have.

    A number at its end has to be right, and edits bring in no digits: another version is another license.
    """

    def __init__(self, phrase: str, label: str, per_edit: int = PER_EDIT):
        if normal(phrase.encode())[0] != phrase.encode() or not phrase.isascii():
            raise ValueError(phrase)
        self.phrase, self.label, self.bytes = phrase, label, phrase.encode()
        head, tail = regex.fullmatch(r"(.*?)(\d*)", phrase).groups()
        self.edits = len(head) // per_edit
        fuzzy = f"(?:{regex.escape(head)}){{e<={self.edits}:[^0-9]}}" if self.edits else regex.escape(head)
        self.match = regex.compile(rf"(?b)(?<![^ ])(?:{fuzzy}{tail})(?![^ ])")
        cut = np.linspace(0, len(head), self.edits + 2).astype(int).tolist()
        self.pieces = [(a, head[a:b].encode()) for a, b in zip(cut, cut[1:], strict=False)] if self.edits else []

    def exact(self, text: bytes) -> list[int]:
        """Offsets where the phrase stands as whole words."""
        out, at = [], text.find(self.bytes)
        while at >= 0:
            end = at + len(self.bytes)
            if (not at or text[at - 1] == 32) and (end == len(text) or text[end] == 32):
                out.append(at)
            at = text.find(self.bytes, at + 1)
        return out

    def windows(self, text: bytes):
        """Ranges that hold all matches: around each piece as far as the phrase with its edits can reach, apart where possible."""
        leeway, spans = 4 * self.edits + 1, []
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                spans.append((max(0, at - offset - leeway), min(len(text), at - offset + len(self.bytes) + leeway)))
                at = text.find(piece, at + 1)
        for a, b in sorted(set(spans)):
            while a and text[a] & 0xC0 == 0x80:  # not within a character
                a -= 1
            while b < len(text) and text[b] & 0xC0 == 0x80:
                b += 1
            yield a, b

    def near(self, text: bytes, exact: list[int]) -> list[tuple[int, int, int]]:
        """start, end, edits of matches with edits, apart from each other and from exact ones: of those that overlap, the one
        with fewer edits, then the first."""
        found = [(a, a + len(self.bytes), 0) for a in exact]
        for a, b in self.windows(text):
            part = text[a:b].decode()
            # a digit, which no edit can take, stands for what else is there of a cut word
            before, after = a > 0 and text[a - 1] != 32, b < len(text) and text[b] != 32
            m = self.match.search("0" * before + part + "0" * after)
            if m and (edits := sum(m.fuzzy_counts)):
                start = a + len(part[: m.start() - before].encode())
                found.append((start, start + len(m[0].encode()), edits))
        kept: list[tuple[int, int, int]] = []
        for x in sorted(set(found)):
            if not kept or x[0] >= kept[-1][1]:
                kept.append(x)
            elif (x[2], x[0]) < (kept[-1][2], kept[-1][0]):
                kept[-1] = x
        return [x for x in kept if x[2]]


def notices(listed=NOTICES, per_edit: int = PER_EDIT) -> list[Notice]:
    return [Notice(p, label, per_edit) for p, label in listed]


def places(text: bytes, known: list[Notice]) -> list[tuple[str, str, int, int, int, str]]:
    """label, phrase, first word, number of words, edits and words of each place in a normal text; by first word, then phrase."""
    found = []
    for n in known:
        exact = n.exact(text)
        found += [(n.label, n.phrase, a, a + len(n.bytes), 0) for a in exact]
        found += [(n.label, n.phrase, *x) for x in (n.near(text, exact) if n.edits else [])]
    if not found:
        return []
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    out = []
    for label, phrase, a, b, edits in found:
        word, last = np.searchsorted(gaps, [a, b - 1]).tolist()
        out.append((label, phrase, word, last - word + 1, edits, text[a:b].decode()))
    return sorted(out, key=lambda x: (x[2], x[1]))


def license_scan(docs: DataFrame, listed=NOTICES, per_edit: int = PER_EDIT) -> DataFrame:
    """docs with n_words and places: label, phrase, word (its first, from 0), words, edits and text of each notice found.

    listed: pairs of phrase and label; one edit is allowed for `per_edit` characters of a phrase without the number at its
    end. Exact places are told of all, near ones where they overlap no better one of their phrase. Null and empty texts
    have no words and no places. Whole texts, row by row: repeated rows and null ids don't matter. Columns named n_words
    or places are replaced, all others stay. No shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "places")
    put = set_aside(docs, "text").withColumn("text", F.col("text").cast("string"))
    schema = StructType([*put.schema.fields, *StructType.fromDDL(RESULT).fields])
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64()), ("text", pa.string())]))
    names = [f.name for f in kind.value_type]

    def scan(batches):
        known = notices(listed, per_edit)
        for b in batches:
            texts = [normal(t) for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            found = [[dict(zip(names, x, strict=True)) for x in places(t, known)] for t, _ in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([n for _, n in texts], pa.int64()), pa.array(found, kind)], names=[*b.schema.names, "n_words", "places"])

    out = put.mapInArrow(scan, schema)
    own = [F.col("text") if c == "text" else F.col(f"`_own_{c}`").alias(c) for c in docs.columns]
    return out.select(*own, "n_words", "places")


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    d = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    phrases = F.array(*[F.lit(p) for p, _ in BASE])
    base = F.filter("places", lambda p: (p["edits"] == 0) & F.array_contains(phrases, p["phrase"]))
    d = d.select("doc_id", "n_words", "places", base.alias("base"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(f"{c}.label"))), ",")
    score = F.array_max(F.transform("places", lambda p: 1 - p["edits"] / F.length(p["phrase"])))
    return d.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"), labels("base").alias("base_labels"), labels("places").alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"), "places")
