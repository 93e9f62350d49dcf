"""Quality rules with adaptive thresholds from mergeable quantile sketches.

The sketch of a feature is a histogram over logarithmic integer buckets (32
steps for each power of two, so a quantile is off by 1/32 at most).  Sketches
merge by adding counts, which a partial aggregation does on the map side: each
task sends one row for each (language, source, feature, bucket) it has seen,
however many documents a hot source holds.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botlens.session import stage

from .common import BLANKS, bucket, let, packed, total, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50            # base rule: fewer words fail
MIN_GROUP = 200           # documents a (language, source) sketch needs to judge alone
PAIRS = 50_000            # (language, source) pairs whose fences are broadcast, some 100 bytes each
SPREAD = 4                # fences stand this many quartile ranges outside the quartiles

# feature -> (scaled integer expression over the base counts, least distance of a
# fence from its quartile in the feature's unit, whether the lower side is fenced)
FEATURES = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", 30, False),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 350, False),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 350, False),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 150, True),
}


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array.

    Windows are compared by a 64-bit hash of their three words; equal windows
    meet by sorting (hash, position), and the covered words are counted from
    the sorted start positions, so the work is n log n for a text of n words.
    """
    def covered(starts):
        step = F.transform(starts, lambda p, i: F.least(
            F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))).cast("long"))
        return total(step)

    def repeated(rows):
        same = F.filter(rows, lambda x, i: (F.get(rows, i - 1)["h"] == x["h"])
                        | (F.get(rows, i + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), covered)

    def windows(ws):
        at = F.when(F.size(ws) >= 3, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(
            F.array().cast("array<int>"))
        rows = F.transform(at, lambda i: F.struct(
            F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p")))
        return let(F.sort_array(rows), repeated)

    return let(words, windows)


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the base counts of every whole text; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.char_length(F.translate(text, BLANKS, ""))
    symbols = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")

    def measured(ws):
        return F.struct(F.size(ws).cast("long").alias("n_words"),
                        repeated_words(ws).alias("n_repeat_words"))

    def line_counts(ls):
        return F.struct(F.size(ls).cast("long").alias("n_lines"),
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    return docs.select(
        "*", chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        let(words_of(F.col("text")), measured).alias("_w"), let(lines, line_counts).alias("_l"),
    ).select("*", "_w.*", "_l.*").drop("_w", "_l")


def sketches(features: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n) of documents that pass the base rule."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), bucket(F.col(f"f_{k}")).alias("bucket"))
                      for k in FEATURES])
    return (features.filter(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("p"))
            .groupBy("lang", "source", "p.feature", "p.bucket").agg(F.count("*").alias("n")))


def fences(counts: DataFrame, by: list[str]) -> DataFrame:
    """Fences of each group of ``by`` from its merged sketch, one row a group."""
    merged = counts.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "feature")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn(
        "all", F.sum("n").over(group))
    q = lambda share: F.min(F.when(F.col("upto") * 4 >= F.col("all") * share, F.col("bucket")))
    quartiles = ranked.groupBy(*by, "feature").agg(
        q(1).alias("q1"), q(3).alias("q3"), F.max("all").alias("docs"))
    columns = [F.max("docs").alias("docs")]
    for k, (_, least, low) in FEATURES.items():
        reach = F.greatest(F.lit(SPREAD) * (F.col("q3") - F.col("q1")), F.lit(least))
        mine = F.col("feature") == k
        columns.append(F.max(F.when(mine, F.col("q3") + reach)).alias(f"hi_{k}"))
        if low:
            columns.append(F.max(F.when(mine, F.col("q1") - reach)).alias(f"lo_{k}"))
    return quartiles.groupBy(*by).agg(*columns)


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every row, beside ``_row``: the columns of ``keep``.

    A document is kept if it passes the base rule and every feature lies within
    the fences of its (language, source) sketch; a pair with fewer than
    MIN_GROUP judged documents takes the fences of its language, a language with
    fewer those of all documents.  Null language or source is a group of its
    own; null and empty texts have zero words and fail the base rule; rows that
    repeat are judged alike, each.  An empty table gives an empty result.
    """
    counted = base_counts(docs.select(packed(keep).alias("_row"), "lang", "source", "text")).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    features = stage(counted.select(
        "*", failed.alias("base_failed"),
        *[F.expr(e).cast("long").alias(f"f_{k}") for k, (e, _, _) in FEATURES.items()]), "quality")
    counts = stage(sketches(features), "quality-sketches")
    limits = [c for k, (_, _, low) in FEATURES.items() for c in ([f"hi_{k}", f"lo_{k}"] if low else [f"hi_{k}"])]
    folded = lambda df, name, by: df.select(
        *[F.col(c).alias(f"_{name}_{c}") for c in by],
        F.when(F.col("docs") >= MIN_GROUP, F.struct(*limits)).alias(name))
    pair = folded(fences(counts, ["lang", "source"]), "pair", ["lang", "source"])
    lang = folded(fences(counts, ["lang"]), "language", ["lang"])
    every = fences(counts.withColumn("one", F.lit(1)), ["one"]).select(F.struct(*limits).alias("every"))
    # the fences of every known pair, with those it falls back on: one row a pair
    known = (counts.select("lang", "source").distinct()
             .join(pair, F.col("lang").eqNullSafe(F.col("_pair_lang"))
                   & F.col("source").eqNullSafe(F.col("_pair_source")), "left")
             .join(lang, F.col("lang").eqNullSafe(F.col("_language_lang")), "left")
             .join(F.broadcast(every))   # one row
             .select(F.col("lang").alias("_l"), F.col("source").alias("_s"),
                     F.coalesce("pair", "language", "every").alias("fence")))
    inside = F.lit(True)
    for k, (_, _, low) in FEATURES.items():
        inside = inside & (F.col(f"f_{k}") <= F.col(f"fence.hi_{k}"))
        if low:
            inside = inside & (F.col(f"f_{k}") >= F.col(f"fence.lo_{k}"))
    known = stage(known, "quality-fences")
    if known.count() <= PAIRS:          # a bounded side; beyond it the rows are shuffled to their pair
        known = F.broadcast(known)
    joined = features.join(known, F.col("lang").eqNullSafe(F.col("_l"))
                           & F.col("source").eqNullSafe(F.col("_s")), "left")
    return joined.select(
        "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``judged`` with the columns of ``keep`` in the row's place."""
    found = judged(docs, keep)
    return found.select("_row.*", *found.columns[1:])


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they came with."""
    return judged(docs, docs.columns).filter("kept").select("_row.*")
