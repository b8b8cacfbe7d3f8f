"""Rank-order language profiles and bottom-k sketches against versions written out plainly."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from optionlake.llm import fingerprints, langid

SF = "/root/testdata/sf0.001"
ODD = [(900001, None, "en"), (900002, "", "de"), (900003, "123 !?", "en"), (None, "no id here at all", "en"), (900004, "Word", None), (900004, "Word", "de"), (900005, "漢字 🙂 ß É", "fr")]


@pytest.fixture(scope="module")
def documents(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return given.unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string")).repartition(3).persist()


# --- language ------------------------------------------------------------------


def grams(text):
    """Counts of n-grams by code: letters in lower case, one gap (0) for every run of anything else and at both ends."""
    points = [0]
    for c in (text or "").lower():
        point = ord(c) if c.isalpha() else 0
        if point or points[-1]:
            points.append(point)
    if points[-1]:
        points.append(0)
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(points) - n + 1):
            part = points[k : k + n]
            if any(part):
                code = 0
                for p in part:
                    code = code << 21 | p
                out[code] += 1
    return out


def first(counts, most=300):
    return [code for code, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def test_languages_are_those_of_a_plain_rank_order(documents):
    rows = documents.collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    total = defaultdict(Counter)
    for r in rows:
        if not held(r.doc_id) and r.lang is not None:
            total[r.lang].update(grams(r.text))
    place = {lang: {code: k for k, code in enumerate(first(counts))} for lang, counts in total.items()}
    want = []
    for r in rows:
        own = first(grams(r.text))
        apart = sorted((sum(abs(p[c] - k) if c in p else 300 for k, c in enumerate(own)), lang) for lang, p in place.items())
        best = (apart[0][1], round(1 - apart[0][0] / apart[1][0], 12)) if own else ("und", 0.0)
        want.append((r.doc_id, held(r.doc_id), *best))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 12)) for r in langid.identify(documents).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- fingerprints --------------------------------------------------------------


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashes(text):
    """63-bit hashes of the distinct shingles of five words, ascending."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    each = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words]
    out = set()
    for part in [each[k : k + 5] for k in range(len(each) - 4)] if len(each) >= 5 else [each] if each else []:
        seed = 42
        for h in part:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=seed)
        out.add(seed >> 1)
    return sorted(out)


def test_sketches_are_the_least_hashes_and_merge(spark, documents):
    rows = [(k, r.text) for k, r in enumerate(documents.collect())]
    table = spark.createDataFrame(rows, "n int, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    own = {r.n: r.s for r in table.select("n", "s").collect()}
    assert own == {n: hashes(text)[: fingerprints.K] for n, text in rows}
    # A sketch of parts put together, in any order, is the sketch of the whole.
    parts = table.where("n < 60").groupBy((F.col("n") % 4).alias("part")).agg(F.collect_list("s").alias("all"))
    merged = parts.select("part", F.aggregate("all", F.array().cast("array<bigint>"), lambda a, b: fingerprints.merged(a, b)).alias("s"))
    for r in merged.collect():
        union = sorted({h for n, text in rows if n < 60 and n % 4 == r.part for h in hashes(text)})
        assert r.s == union[: fingerprints.K]
    sizes = table.select("n", fingerprints.distinct_count(F.col("s")).alias("d")).collect()
    for r in sizes:
        true = len(hashes(rows[r.n][1]))
        assert r.d == true if true < fingerprints.K else abs(r.d / true - 1) < 0.4


def test_a_phrase_is_looked_for_by_its_first_letter():
    import re

    from optionlake.llm import licenses

    text = "cc by, xcc by CC-BY ccc by\ncc\nby\u00e9 cc by \u00e9cc by cc cc by"
    assert licenses._phrase("cc by").startswith("(?i)c(?<!")
    found = [m.span() for m in re.finditer(licenses._phrase("cc by"), text)]
    assert found == [m.span() for m in re.finditer(rf"(?i)(?<![^{licenses.SEPARATOR}])cc[{licenses.SEPARATOR}]+by(?![^{licenses.SEPARATOR}])", text)] and len(found) == 4
