"""Language identification by rank-order profiles of n-grams.

A language's profile is its most frequent n-grams of one to three letters, in
order. A document takes the language whose profile is least out of place: the
sum, over the document's own most frequent n-grams, of how far each stands from
its place in the profile, or the whole profile length where it is missing.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import per_worker

#: N-grams of a profile; letters of an n-gram; languages a model may have.
PROFILE, LONGEST, LANGUAGES = 300, 3, 1_000


def _letters() -> np.ndarray:
    """Per code point whether it is a letter."""
    size = sys.maxunicode + 1
    return per_worker("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(size)), bool, size))


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending n-gram codes of a whole text and their counts.

    Letters are lower-cased, every run of anything else is one gap, and a gap
    stands at both ends; an n-gram has a letter in it. A code holds the code
    points, 21 bits each.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4").astype(np.int64)
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate(([0], points, [0]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    points = points[keep]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = []
    code, letter = points, points != 0
    for n in range(1, LONGEST + 1):
        if n > 1:
            code = (code[:-1] << 21) | points[n - 1 :]
            letter = letter[:-1] | (points[n - 1 :] != 0)
        found.append(code[letter])
    codes, counts = np.unique(np.concatenate(found), return_counts=True)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; of equal counts the smaller code first."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


def profiles(docs: DataFrame, train: Column, lang: str = "lang", most: int = PROFILE) -> DataFrame:
    """(lang, rank, code) learned from the rows that ``train`` holds for and that have a language. All of them count."""

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                own = total.setdefault(name.as_py(), {})
                codes, counts = ngrams(text.as_py())
                for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    own[c] = own.get(c, 0) + n
            while sum(map(len, total.values())) > 500_000:  # hand on what there is, so that the task stays small
                name, own = total.popitem()
                yield _counted(name, own)
        for name, own in total.items():
            yield _counted(name, own)

    rows = docs.where(train & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")  # Spark keeps the first rows of each part before it shuffles
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", "rank", "code")


def _counted(name: str, own: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(own), pa.string()), pa.array([*own.keys()], pa.int64()), pa.array([*own.values()], pa.int64())], names=["lang", "code", "n"]
    )


class Model:
    """Profiles side by side."""

    def __init__(self, rows: list[tuple[str, int, int]], most: int = PROFILE):
        self.names = sorted({r[0] for r in rows})
        self.most = most
        self.codes = np.array(sorted({r[2] for r in rows}), np.int64)
        # Place of each known code in each profile; the profile length where it has none.
        self.place = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for name, rank, code in rows:
            self.place[self.names.index(name), np.searchsorted(self.codes, code)] = rank - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how sure: 1 less the ratio of the least distance to the next, 0 to 1.

        A text without a letter, or a model without a language, gives ("und", 0).
        """
        codes, counts = ngrams(text)
        if not len(codes) or not self.names:
            return "und", 0.0
        own = ranked(codes, counts, self.most)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        place = self.place[:, at]
        apart = np.where(place >= 0, np.abs(place - np.arange(len(own))), self.most).sum(1)
        order = np.argsort(apart, kind="stable")
        best = int(apart[order[0]])
        if len(order) == 1:
            return self.names[0], 1.0 - best / (self.most * len(own))
        second = int(apart[order[1]])
        return self.names[order[0]], (1.0 - best / second) if second else 0.0


def fit(docs: DataFrame, train: Column, lang: str = "lang", most: int = PROFILE) -> Model:
    """The model of at most LANGUAGES times ``most`` rows; more languages than that are refused."""
    rows = profiles(docs, train, lang, most)
    listed = rows.limit(LANGUAGES * most + 1).collect()
    if len(listed) > LANGUAGES * most:
        raise ValueError(f"more than {LANGUAGES} languages")
    return Model([(r.lang, r.rank, r.code) for r in listed], most)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row never trains: crc32 of the id as text is a multiple of 5. A null id does not train either."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the rest train. Null, empty and letterless texts are ``und``."""
    model = fit(docs, ~held_out())  # bounded, and sent with the function

    def run(batches):
        for batch in batches:
            names, scores = zip(*(model.predict(t.as_py()) for t in batch.column("text")), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
