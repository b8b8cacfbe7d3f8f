"""Surrogates for personal data: keyed, of the same kind and shape, distinct where the originals are.

An entity is its normal form (lower case, for numbers only the digits), so the
same address or number gets the same surrogate wherever and however it is
written. Surrogates are drawn from a keyed digest of the normal form, checked
over the whole corpus against each other and against the real entities, and
drawn again where they clash. Everything is Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Kinds of personal data and how each is written, tried in this order at a place.
_HONORIFIC = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sir", "Г-н", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Г-жа", "Госпожа", "Κυρία"),
}
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": r"(?<!\p{L})(?:" + "|".join(h for g in _HONORIFIC.values() for h in g) + r")\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
#: The country code of a telephone number, apart from the digits of the number itself.
CODE = r"^\+([0-9]{1,3}?)[ .-]?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$"
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Letters names are drawn from, by script: consonants, vowels, last letters by gender.
SCRIPTS = {
    "latin": (r"\p{IsLatin}", "bdfglmnprstv", "aeio", {"m": "o", "f": "a"}),
    "cyrillic": (r"\p{IsCyrillic}", "бвглмнрст", "аеио", {"m": "р", "f": "а"}),
    "greek": (r"\p{IsGreek}", "βγδλμνρτ", "αειο", {"m": "ς", "f": "α"}),
}
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Draws before giving up; with half of a format's surrogates taken, each leaves half of the clashes.
ROUNDS = 40


def kind_of(surface: Column) -> Column:
    """The first kind whose pattern is the whole of an entity as written."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(surface.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def normal(kind: Column, surface: Column) -> Column:
    digits = F.regexp_replace(surface, "[^0-9]", "")
    code = F.regexp_extract(surface, CODE, 1)
    phone = F.when(code == "", digits).otherwise(F.concat(F.lit("+"), code, F.lit(" "), F.substring(digits, F.length(code) + 1, F.length(digits))))
    return (
        F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "ip", surface)
        .when(kind == "iban", F.upper(F.regexp_replace(surface, " ", ""))).when(kind == "name", surface).otherwise(F.lower(surface))
    )


def _bare(kind: Column, form: Column) -> Column:
    """What clashes are seen on: the form, of a telephone number without its country code."""
    return F.when(kind == "phone", F.regexp_replace(form, r"^\+[0-9]+ ", "")).otherwise(form)


def _draw(kind: Column, form: Column, key: str, attempt: Column) -> Column:
    """A surrogate of a normal form.

    Hosts end in .example and addresses start at 240, which name nothing real;
    social security numbers start with 9, which are not issued. A country code,
    an honorific, a length and every separator stay.
    """
    seed = F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string"))
    noise = F.concat(F.sha2(F.concat(F.lit("a|"), seed), 512), F.sha2(F.concat(F.lit("b|"), seed), 512))  # 256 hex digits
    byte = lambda i: F.conv(F.substring(noise, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, i: F.substring(F.lit(letters), byte(i) % len(letters) + 1, F.lit(1))
    chars = F.split(form, "")
    same = F.array_join(F.transform(chars, lambda c, i: (
        F.when(c.rlike("[0-9]"), pick(DIGITS, i)).when(c.rlike(r"\p{Lu}"), F.upper(pick(LETTERS, i))).when(c.rlike(r"\p{L}"), pick(LETTERS, i)).otherwise(c)
    )), "")
    host = F.array_join(F.transform(F.sequence(F.lit(100), F.lit(109)), lambda i: pick(LETTERS, i)), "")
    code = F.regexp_extract(form, r"^\+[0-9]+ ", 0)
    local = F.length(F.substring_index(form, "@", 1))
    email = F.concat(F.substring(same, F.lit(1), local), F.lit("@"), host, F.lit(".example"))
    ip = F.concat_ws(".", *[(byte(F.lit(k)) % 16 + 240 if k == 0 else byte(F.lit(k))).cast("string") for k in range(4)])

    def name(script: str, gender: str) -> Column:
        _, consonants, vowels, last = SCRIPTS[script]
        # A name drawn again and again grows by two letters every second time, so that a free one is found however many there are.
        word = lambda w, k: F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(2)) + 2 * F.floor(attempt / 2).cast("int")), lambda i: (
            F.when(i % 2 == 1, pick(consonants, i + k)).otherwise(pick(vowels, i + k)))), ""), F.lit(last[gender]) if k < 40 else pick(vowels, F.lit(k))))
        words = F.split(form, " ")
        return F.concat_ws(" ", F.get(words, F.lit(0)), word(F.get(words, F.lit(1)), 0), F.when(F.size(words) > 2, word(F.get(words, F.lit(2)), 40)))

    named = F.lit(None).cast("string")
    for script, (letters, *_) in SCRIPTS.items():
        for gender, titles in _HONORIFIC.items():
            fits = form.rlike(rf"^(?:{'|'.join(titles)})\.? {letters}")
            named = F.when(fits, name(script, gender)).otherwise(named)
    return (
        F.when(kind == "phone", F.concat(code, F.substring(same, F.length(code) + 1, F.length(same)))).when(kind == "email", email).when(kind == "ip", ip).when(kind == "name", F.coalesce(named, same))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(same, F.lit(2), F.length(same))))
        .when(kind == "iban", F.concat(F.substring(form, F.lit(1), F.lit(2)), F.substring(same, F.lit(3), F.length(same)))).otherwise(same)
    )


def _render(kind: Column, surface: Column, surrogate: Column) -> Column:
    """A surrogate in the writing of one mention: its separators, its country code, its case."""
    digits = F.when(kind == "phone", F.regexp_replace(surrogate, "[^0-9]", "")).otherwise(surrogate)
    pieces = F.split(surface, "")
    # How many letters or digits stand up to each place: the length of the start of the writing without the rest.
    at = lambda i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), "[^A-Z0-9]", ""))
    spaced = F.array_join(F.transform(pieces, lambda c, i: F.when(c.rlike("[A-Z0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), "")
    return F.when(kind.isin("card", "ssn", "phone", "iban"), spaced).when((kind == "email") & (F.upper(surface) == surface), F.upper(surrogate)).otherwise(surrogate)


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, i, surface, kind, form) of every mention; rows of equal id and text once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("found"))
    once = found.where(F.size("found") > 0).groupBy("doc_id", "digest").agg(F.first("found").alias("found"))
    rows = once.select("doc_id", "digest", F.posexplode("found").alias("i", "surface")).withColumn("kind", kind_of(F.col("surface")))
    return rows.withColumn("form", normal(F.col("kind"), F.col("surface")))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) of distinct entities, each surrogate unlike any other and unlike any entity.

    Of entities that drew the same, the least form keeps it and the others draw
    again; the rounds end when none clashes, after one for all but a few. Names
    grow meanwhile; where a kind of fixed format has more entities than it has
    surrogates, ROUNDS end in an error instead.
    """
    bare = lambda c: _bare(F.col("kind"), F.col(c))
    real = stored(entities.select("kind", "form").distinct(), "entities")
    drawn = stored(real.withColumn("attempt", F.lit(0)).withColumn("surrogate", _draw(F.col("kind"), F.col("form"), key, F.col("attempt"))), "surrogates")
    for _ in range(ROUNDS):
        keyed = drawn.withColumn("bare", bare("surrogate"))
        first = keyed.groupBy("kind", "bare").agg(F.min("form").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        twice = keyed.join(first, ["kind", "bare"]).where("form <> first").select("kind", "form")
        taken = keyed.join(real.select("kind", bare("form").alias("bare")), ["kind", "bare"], "left_semi").select("kind", "form")
        clash = stored(twice.unionAll(taken).distinct(), "clashes")
        if clash.isEmpty():
            return drawn.select("kind", "form", "surrogate")
        again = drawn.join(clash, ["kind", "form"]).withColumn("attempt", F.col("attempt") + 1)
        again = again.withColumn("surrogate", _draw(F.col("kind"), F.col("form"), key, F.col("attempt")))
        drawn = stored(drawn.join(clash, ["kind", "form"], "left_anti").unionByName(again.select(drawn.columns)), "surrogates")
    left = clash.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per kind
    raise ValueError("no distinct surrogates left for " + ", ".join(f"{r.n} of kind {r.kind}" for r in left))


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities and n_<kind> of every document.

    A null text stays null and holds nothing; other text between entities is
    untouched. Only texts with an entity are shuffled.
    """
    found = stored(mentions(docs), "mentions")
    drawn = surrogates(found, key)
    placed = found.join(drawn, ["kind", "form"]).select(
        "doc_id", "digest", F.struct("i", "kind", _render(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("to")).alias("one")
    )
    per_text = placed.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list("one")).alias("all"))  # mentions of one text
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    has = F.coalesce(F.col("text"), F.lit("")).rlike(ANY)
    counted = lambda kind: F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    mine = rows.where(has).withColumn("_digest", F.xxhash64("text"))
    named = per_text.withColumnsRenamed({"doc_id": "_id", "digest": "_key"})
    joined = mine.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_key")))
    new = F.array_join(F.flatten(F.zip_with(F.split("text", ANY, -1), F.transform("all", lambda x: x["to"]), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = joined.select("doc_id", new.alias("text"), F.size("all").cast("bigint").alias("n_entities"), *[counted(k) for k in KINDS])
    rest = rows.where(~has).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"), *[F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS])
    return changed.unionAll(rest)
