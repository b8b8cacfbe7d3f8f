"""Secret scan with corpus-wide ownership of every candidate.

Each kind is one pattern, applied leftmost and without overlap to the whole
text. Places come from the lengths of the pieces between matches, so a text is
cut once per kind and never copied. A candidate's hash is then counted over the
corpus by distinct repositories and owners: what one owner alone holds looks
live, what several hold is a copied example. Everything is Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A pattern; the group that is the credential, its least length; whether spans count whoever holds them."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool


# What counts as a secret, in the order in which kinds are listed.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Kind("hex", r"[0-9a-f]+", 0, 24, True),
    Kind("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 24, False),
    Kind("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]{40,}", 0, 60, False),
    Kind("opaque", r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*[a-z])(?=[A-Za-z0-9_-]*[A-Z])(?=[A-Za-z0-9_-]*[0-9])[A-Za-z0-9_-]{32,}", 0, 32, False),
)
#: Owners from which a value counts as copied around.
COPIED = 3


def _quick(kind: Kind) -> str:
    """A pattern that finds no less: whether a text is worth the full one."""
    return r"[0-9a-f]{24}" if kind.name == "hex" else kind.pattern


def _matches(text: Column, kind: Kind) -> Column:
    """(kind number, place in the row, length before since the last match, length, value, whether it counts) of every match."""
    pattern, k = F.lit(kind.pattern), KINDS.index(kind)
    whole, value = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(kind.group))
    before = F.transform(F.split(text, kind.pattern, -1), F.length)
    rows = F.transform(
        F.arrays_zip(F.slice(before, 1, F.size(whole)).alias("before"), whole.alias("whole"), value.alias("value")),
        lambda x, i: F.struct(
            F.lit(k).alias("kind"), i.alias("i"), x["before"].alias("before"), F.length(x["whole"]).alias("length"),
            x["value"].alias("value"), (F.length(x["value"]) >= kind.least).alias("counts"),
        ),
    )
    # Lengths of matches that do not count are still needed for the places after them.
    slim = F.transform(rows, lambda x: x.withField("value", F.when(x["counts"], x["value"])))
    return F.when(text.rlike(_quick(kind)), slim).otherwise(F.array().cast("array<struct<kind:int,i:int,before:int,length:int,value:string,counts:boolean>>"))


def find(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per counting match: doc_id, digest, copies, kind, start, end, secret (hash of the value), repository, owner.

    Places are code points, ends exclusive. A null text has no match. Rows that
    agree in id, text, repository and owner are scanned once; ``copies`` counts them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"), repository.alias("repository"), owner.alias("owner"),
        F.flatten(F.array(*[_matches(text, k) for k in KINDS])).alias("found"),
    ).where(F.size("found") > 0)
    key = ["doc_id", "digest", "repository", "owner"]
    once = rows.groupBy(*key).agg(F.first("found").alias("found"), F.count(F.lit(1)).alias("copies"))
    upto = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = once.select(*key, "copies", F.inline("found")).withColumn("end", F.sum(F.col("before") + F.col("length")).over(upto))
    return placed.where("counts").select(
        *key, "copies", "kind", (F.col("end") - F.col("length")).alias("start"), "end", F.sha2("value", 256).alias("secret")
    )


def owned(found: DataFrame) -> DataFrame:
    """``found`` with repositories and owners, how many distinct ones hold the secret anywhere (a null is none)."""
    held = found.select("secret", "repository", "owner").distinct()
    spread = held.groupBy("secret").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"))
    return found.join(spread, "secret")


def spans(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per (document row that has any): its spans in order of start, then kind, with owners and verdict.

    Base kinds always count. The others are spans only if they look live: one
    owner at most holds the value.
    """
    listed = owned(find(docs, repository, owner)).where(F.col("kind").isin([k for k, x in enumerate(KINDS) if x.base]) | (F.col("owners") <= 1))
    return listed.groupBy("doc_id", "digest", "repository", "owner", "copies").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "repositories", "owners"))).alias("spans")
    )


def _text(spans_: Column) -> Column:
    name = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """A row per document: counts of the base kinds, digest of the base spans, all spans, n_live, n_copied."""
    found = spans(docs, repository, owner)
    base = F.filter("spans", lambda s: s["kind"].isin([k for k, x in enumerate(KINDS) if x.base]))
    count = lambda test: F.size(F.filter("spans", test)).cast("bigint")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    named = {f"n_{x.name}": of_kind(k) for k, x in enumerate(KINDS) if x.base}
    with_any = found.select(
        "doc_id", *[c.alias(n) for n, c in named.items()], F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"),
        count(lambda s: s["owners"] <= 1).alias("n_live"), count(lambda s: s["owners"] >= COPIED).alias("n_copied"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
    key = ["_id", "_digest", "_repository", "_owner"]
    mine = docs.select(
        F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_digest"),
        repository.alias("_repository"), owner.alias("_owner"),
    )
    has = found.select(*[F.col(c.removeprefix("_") if c != "_id" else "doc_id").alias(f"h{c}") for c in key])
    without = mine.join(has, [F.col(c).eqNullSafe(F.col(f"h{c}")) for c in key], "left_anti").select(
        F.col("_id").alias("doc_id"), *[F.lit(0).cast("bigint").alias(n) for n in named], F.sha2(F.lit(""), 256).alias("base_sha256"),
        F.lit("").alias("spans"), F.lit(0).cast("bigint").alias("n_live"), F.lit(0).cast("bigint").alias("n_copied"),
    )
    return with_any.unionAll(without)


def withhold_live(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """The documents whose every credential is a copied example, all columns kept."""
    live = spans(docs, repository, owner).where(F.exists("spans", lambda s: s["owners"] < COPIED)).select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")
    ).distinct()
    digest = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    match = docs["doc_id"].cast("bigint").eqNullSafe(live["_id"]) & (digest == live["_digest"])
    return docs.join(live, match, "left_anti")
