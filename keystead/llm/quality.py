"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

A rule compares one figure of a document with a cutoff. Sets of a cutoff for each rule are tried on
labelled documents, from lax to strict: for each stratum the strictest set is taken for which an exact
binomial test shows that all rules together reject at most a given share of the good documents. The sets
are tested in a fixed sequence that ends at the first failure, so they need no correction for their
number; the level is shared by the strata. With probability 1 - DELTA no stratum loses more than ALPHA of
its good documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, let, materialise, words_of

#: At most this share of a stratum's good documents is rejected (over all rules), with probability 1 - DELTA.
ALPHA, DELTA = 0.02, 0.05
#: Ids that are broadcast at most (8 bytes each).
MOST_BROADCAST = 1_000_000
#: Documents with fewer words, or with more than this percentage of repeated words, fail the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The rules: a figure of a document, bad where it is above the cutoff, and the cutoffs from strict to lax.
RULES = {
    "symbols": (0.01, 0.03, 0.06, 0.1, 0.2, 0.3),
    "dup_lines": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
    "repeats": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "long_words": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0),
}


#: Up to so many different repeated windows each place is looked up among them; beyond, windows are sorted with their places.
_FEW = 32


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first finding included.

    Windows are hashed to 64 bits; the hashes are sorted, and those equal to a neighbour are repeated.
    The gaps between the places of repeated windows, 3 at most, add up to the words that they cover."""

    def few(h: Column, d: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())

    def many(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k + 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k - 1)["h"].eqNullSafe(x["h"])))
        return F.sort_array(F.transform(let(pairs, twice), lambda x: x["i"]))

    def covered(h: Column) -> Column:
        repeated = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1))))
        places = lambda d: F.when(F.size(d) <= _FEW, few(h, d)).otherwise(many(h))
        gaps = lambda d: F.aggregate(
            places(d),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )
        return let(repeated, lambda d: F.when(F.size(d) == 0, F.lit(0)).otherwise(gaps(d)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, let(windows, covered)).otherwise(F.lit(0)).cast("long")


def figures(text: Column) -> Column:
    """A struct of the base figures of a text; null counts as a text without words."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_PATTERN))
        by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
        by_words = let(
            words_of(t),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
        )
        return F.struct(
            by_words.alias("w"),
            (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            by_lines.alias("l"),
        )

    return let(text, of)


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the figures of its text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines and text_hash, as bigint columns whose names begin with prefix."""
    x = f"{prefix}figures"
    out = docs.withColumn(x, figures(F.col(text))).withColumn(f"{prefix}text_hash", F.xxhash64(F.col(text)))
    names = {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines"}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{x}.{y}").alias(f"{prefix}{k}") for k, y in names.items()], f"{prefix}text_hash")


def base_failed(prefix: str = "") -> Column:
    """Too few words, or too many in repeated windows."""
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < LEAST_WORDS) | (100 * r > MOST_REPEATED * n)


def rule_values(prefix: str = "") -> dict[str, Column]:
    """The figure of each rule, as a double; 0 where it has no denominator."""
    c = lambda x: F.col(f"{prefix}{x}")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbols": ratio(c("n_symbols"), c("word_chars")),
        "dup_lines": ratio(c("n_dup_lines"), c("n_lines")),
        "repeats": ratio(c("n_repeat_words"), c("n_words")),
        "long_words": ratio(c("word_chars"), c("n_words")),
    }


def most_errors(n: Column, alpha: float, level: Column) -> Column:
    """The largest k with P(Binomial(n, alpha) <= k) <= level, or -1: with k or fewer rejected of n good
    documents, a rejection rate above alpha is refuted at that level. Terms are added as logarithms,
    for k up to the mean; above that the probability is about a half and no level allows it."""
    p, q = math.log(alpha), math.log1p(-alpha)
    start = F.struct((n * F.lit(q)).alias("term"), (n * F.lit(q)).alias("total"), F.lit(-1).cast("long").alias("best"))

    def step(a: Column, k: Column) -> Column:
        best = F.when(a["total"] <= F.log(level), k).otherwise(a["best"])
        term = a["term"] + F.log((n - k) / (k + F.lit(1))) + F.lit(p - q)
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"), best.alias("best"))

    ks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor(n * F.lit(alpha)).cast("long")))
    return F.when(n > 0, F.aggregate(ks, start, step, lambda a: a["best"])).otherwise(F.lit(-1).cast("long"))


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of each document that a label calls good, once. Labels without an id or a quality are left out."""
    return labels.where("doc_id is not null and quality = 1").select("doc_id").distinct()


def cutoff_sets() -> list[dict[str, float]]:
    """Sets of a cutoff for each rule, from lax to strict: the rules are tightened by one step in turn.
    The order is constant, which the tests in a fixed sequence rest on."""
    at = {k: len(c) - 1 for k, c in RULES.items()}
    sets = [dict(at)]
    while any(at.values()):
        for k in RULES:
            if at[k]:
                at[k] -= 1
                sets.append(dict(at))
    return [{k: float(RULES[k][j]) for k, j in x.items()} for x in sets]


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "stratum", prefix: str = "", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum that has a good document: the stratum (cut_stratum), its number of good
    texts (cut_good) and for each rule its cutoff (cut_<rule>, null where no set is shown to be safe); names
    begin with prefix.

    measured has doc_id, the stratum and the figures. Its documents that a label calls good and that pass
    the base rules are the holdout. Each different text of a stratum counts once, however many rows,
    labels or ids it has, as the binomial test asks for independent trials; near copies are not told from
    other texts. A set tightens those before it and so rejects what they do: errors never fall along the
    sequence, and the sets with few enough errors are those before the first failure. Where there are 4
    strata, 217 good texts without an error show a set to be safe. Texts are merged and counted before
    rows move, so neither a large stratum nor a large table meets in one task; what is left is a row for
    each stratum."""
    sets, values = cutoff_sets(), rule_values(prefix)
    hit = [F.greatest(*[values[k] > F.lit(c) for k, c in x.items()]).cast("long") for x in sets]
    rows = measured.where(~base_failed(prefix)).select("doc_id", F.col(stratum).alias("stratum"), F.col(f"{prefix}text_hash").alias("text_hash"), *[h.alias(f"e{i}") for i, h in enumerate(hit)])
    texts = rows.join(good_ids(labels), "doc_id", "left_semi").groupBy("stratum", "text_hash").agg(*[F.max(f"e{i}").alias(f"e{i}") for i in range(len(sets))])
    sums = texts.groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *[F.sum(f"e{i}").alias(f"e{i}") for i in range(len(sets))])
    sums = sums.withColumn("strata", F.count(F.lit(1)).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sums = sums.withColumn("most", most_errors(F.col("good"), alpha, F.lit(delta) / F.col("strata")))
    cut = lambda k: F.coalesce(*[F.when(F.col(f"e{i}") <= F.col("most"), F.lit(x[k])) for i, x in reversed(list(enumerate(sets)))])
    return sums.select(F.col("stratum").alias(f"{prefix}cut_stratum"), F.col("good").alias(f"{prefix}cut_good"), *[cut(k).alias(f"{prefix}cut_{k}") for k in RULES])


def verdict(measured: DataFrame, cuts: DataFrame, stratum: str, prefix: str = "") -> DataFrame:
    """measured with base_failed and kept (named with the prefix). A document is kept if it passes the
    base rules and none of its stratum's cutoffs rejects it; a stratum without cutoffs rejects none."""
    bad = F.lit(False)
    for k, v in rule_values(prefix).items():
        bad = bad | F.coalesce(v > F.col(f"{prefix}cut_{k}"), F.lit(False))
    joined = measured.join(cuts, F.col(stratum).eqNullSafe(F.col(f"{prefix}cut_stratum")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in measured.columns], base_failed(prefix).alias(f"{prefix}base_failed"), (~base_failed(prefix) & ~bad).alias(f"{prefix}kept"))


def stratum_of(lang: Column) -> Column:
    """Strata are languages; null is one of its own."""
    return F.coalesce(lang, F.lit("?"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept for
    every document; texts are read once. Null ids are judged like others; empty and null texts fail
    the base rules; repeated rows are judged alike. Other columns are ignored."""
    slim = docs.select("doc_id", "text", stratum_of(F.col("lang")).alias("stratum"))
    measured = materialise(measure(slim).drop("text"), "figures")
    out = verdict(measured, materialise(thresholds(measured, labels), "cutoffs"), "stratum")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns under whatever names, that judge() keeps. Only documents with a good
    label are measured for the cutoffs, then all for their verdict, whose texts aren't written or shuffled."""
    slim = docs.select("doc_id", "text", stratum_of(F.col("lang")).alias("stratum"))
    good = materialise(good_ids(labels), "good")
    # up to MOST_BROADCAST ids are broadcast; with more, documents and ids meet by hash
    good = F.broadcast(good) if good.count() <= MOST_BROADCAST else good
    cuts = thresholds(measure(slim.join(good, "doc_id", "left_semi")).drop("text"), labels)
    prefix = "quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    cuts = materialise(cuts.toDF(*[prefix + c for c in cuts.columns]), "cutoffs")
    stratum = f"{prefix}stratum"
    rows = measure(docs.withColumn(stratum, stratum_of(F.col("lang"))), prefix=prefix)
    return verdict(rows, cuts, stratum, prefix).where(f"`{prefix}kept`").select(*[F.col(f"`{c}`") for c in docs.columns])
