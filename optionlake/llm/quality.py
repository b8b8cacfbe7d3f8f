"""Quality classifier: a sparse ensemble of rules read off boosted trees.

``statistics`` measures every whole text in Catalyst. Boosted trees are grown on
the labelled rows, every path from a root to a node becomes a rule (a conjunction
of thresholds), a lasso logistic regression weighs the rules, and those with a
weight are compiled into one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Trees, their depth, the lasso's penalty; a rule must tell at least this share of rows from the rest.
TREES, DEPTH, PENALTY, SUPPORT = 12, 3, 0.002, 0.002

STATISTICS = (
    "chars", "words", "word_length", "upper", "digit", "symbol", "stop", "repeat", "line_repeat", "line_length", "symbol_words", "common",
)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the STATISTICS columns (double) of each whole text; a null or empty text has 0 in all of them.

    Shares are of characters (upper, digit, symbol, stop), of words (repeat,
    symbol_words, common) or of lines (line_repeat).
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    narrow = docs.withColumns({
        "_words": F.filter(F.split(t, r"[\s|]+"), lambda w: w != ""), "_lines": F.filter(F.split(t, "\n"), lambda w: w != ""),
    })
    n, chars, lines = F.size("_words").cast("double"), F.length(t).cast("double"), F.size("_lines").cast("double")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    measured = narrow.withColumns({
        "chars": chars, "words": n, "word_length": share(chars - count(r"\s"), n), "upper": share(count(r"\p{Lu}"), chars),
        "digit": share(count(r"[0-9]"), chars), "symbol": share(count(r"[#$%&*+<=>@\\^_`{|}~!?]"), chars), "stop": share(count(r"[.,;:]"), chars),
        "repeat": share(n - F.size(F.array_distinct("_words")), n), "line_repeat": share(lines - F.size(F.array_distinct("_lines")), lines),
        "line_length": share(chars, lines), "symbol_words": share(count(r"[^\p{L}\p{N}\s.,;:]{2,}|\|"), n),
        # words of up to three letters: articles, prepositions and the like
        "common": share(count(r"(?<![\p{L}])\p{Ll}{1,3}(?![\p{L}])"), n),
    })
    return measured.drop("_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, at most, threshold) terms."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in self.terms:
            out = out & ((F.col(name) <= threshold) if at_most else (F.col(name) > threshold))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if m else '>'} {t:g}" for n, m, t in self.terms)


def paths(model, names: list[str]) -> list[Rule]:
    """The rules of all trees: every path from the root to a node, each once; of two thresholds on one side the tighter one."""
    found: dict[Rule, None] = {}

    def walk(node, terms: dict[tuple[str, bool], float]) -> None:
        if terms:
            found[Rule(tuple((n, m, t) for (n, m), t in sorted(terms.items())))] = None
        if node.getClass().getSimpleName() != "InternalNode":
            return
        name, threshold = names[node.split().featureIndex()], float(node.split().threshold())
        below, above = terms.get((name, True), threshold), terms.get((name, False), threshold)
        walk(node.leftChild(), terms | {(name, True): min(below, threshold)})
        walk(node.rightChild(), terms | {(name, False): max(above, threshold)})

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), {})
    return [*found]


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and a constant; ``score`` is their logistic."""

    constant: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.constant)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(rows: DataFrame, label: str = "quality", trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """Learn from measured rows with a 0/1 label; rows without one are left out.

    All labelled rows take part, on the executors. With one class only, or no
    row at all, the ensemble has no rules and scores the share of 1 (a half if
    there is no row).
    """
    from math import log

    data = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), *STATISTICS)
    n, ones = data.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        share = (ones or 0) / n if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Ensemble(log(share / (1 - share)), ())
    named = VectorAssembler(inputCols=[*STATISTICS], outputCol="features").transform(data).select("label", "features", *STATISTICS)
    grown = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=64, stepSize=0.3, cacheNodeIds=False).fit(named)
    rules = paths(grown, [*STATISTICS])
    support = named.agg(*[F.avg(r.column().cast("double")).alias(f"r{k}") for k, r in enumerate(rules)]).first() if rules else []
    rules = [r for r, s in zip(rules, support, strict=True) if SUPPORT <= s <= 1 - SUPPORT]
    if not rules:
        return Ensemble(log(ones / (n - ones)), ())
    bits = named.select("label", *[r.column().cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    bits = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="bits").transform(bits).select("label", "bits")
    lasso = LogisticRegression(
        featuresCol="bits", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60, tol=1e-5
    ).fit(bits)
    weights = [float(w) for w in lasso.coefficients.toArray()]
    return Ensemble(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row never trains: crc32 of the id as text leaves 1 over 3. A null id does not train either."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def learn(measured: DataFrame, labels: DataFrame) -> Ensemble:
    """Fit on measured documents; of several labels of one id the least counts."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where("_id is not null").groupBy("_id").agg(F.min("quality").alias("quality")).where(~held_out("_id"))
    return fit(measured.join(marks, F.col("doc_id") == F.col("_id")))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels (doc_id, quality) train where ``held_out`` is false.

    A null or empty text is scored by its zero statistics like any other; null
    and repeated ids are kept as they are.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = stored(statistics(narrow).drop("text"), "statistics")
    scored = measured.select("doc_id", held_out().alias("held_out"), learn(measured, labels).score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, all columns kept.

    The statistics are worked out a second time beside the text rather than
    joined to it: that reads the input again but shuffles no text.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("_id")).where("_id is not null").distinct().where(~held_out("_id"))
    known = stored(statistics(narrow.join(marks, F.col("doc_id") == F.col("_id"), "left_semi")).drop("text"), "statistics")
    model = learn(known, labels)
    mine = docs.select([F.col(c).alias(f"d_{c}") for c in docs.columns])
    kept = statistics(mine, "d_text").where(model.score() >= 0.5)
    return kept.select([F.col(f"d_{c}").alias(c) for c in docs.columns])
