"""Statistics of whole texts as Spark expressions: no Python touches a row.

A repeated word is found without a shuffle: the 64-bit hashes of a text's
five-word windows are sorted with their positions inside the row, equal
neighbours mark repeated windows, and the union of their spans is measured.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, let

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Very common short words of the four languages; prose has them, word lists don't.
FUNCTION_WORDS = (
    "the and of to in is that it for was on with as are by "
    "der die das und den in von zu mit ist im für des ein "
    "de la le les et des du un une que en est pour "
    "el los las del que y por con se una para"
).split()


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def _window_hashes(found: Column) -> Column:
    """One hash for every window of five consecutive words."""
    def of(hashes):
        last = F.size(hashes) - WINDOW
        return F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(found, lambda w: F.xxhash64(w)), of)


def repeated_words(found: Column) -> Column:
    """Number of words that lie in a five-word window found twice or more."""

    def covered(starts):  # sorted window starts: each adds its distance to the next, five at most
        return F.aggregate(
            F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("bigint"),
            lambda n, d: n + d,
        )

    def scan(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        hit = lambda a, j: (a["h"] == F.get(j[0], j[1] - 1)["h"]) | (a["h"] == F.get(j[0], j[1] + 1)["h"])
        starts = let(
            pairs,
            lambda s: F.array_sort(F.transform(F.filter(s, lambda a, j: F.coalesce(hit(a, (s, j)), F.lit(False))), lambda a: a["i"])),
        )
        return let(starts, covered)

    return let(
        _window_hashes(found),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(scan(h)),
    )


def base_stats(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and what the learned rules need."""
    text = F.coalesce(text, F.lit(""))

    def counts(t):
        n_chars = F.length(t)
        solid = F.length(F.translate(t, SPACE_CHARS, ""))
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
        upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
        return let(
            words(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                solid.cast("long").alias("word_chars"),
                (n_chars - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                letters.cast("long").alias("n_letters"),
                upper.cast("long").alias("n_upper"),
                (n_chars - F.length(F.translate(t, ".,;:!?", ""))).cast("long").alias("n_marks"),
                (n_chars - F.length(F.translate(t, "!?", ""))).cast("long").alias("n_shouts"),
                (n_chars - F.length(F.translate(t, "0123456789", ""))).cast("long").alias("n_digits"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                F.size(F.filter(w, lambda x: x.isin(*FUNCTION_WORDS))).cast("long").alias("n_function"),
                F.size(lines).cast("long").alias("n_lines"),
            ),
        )

    return let(text, counts)


def ratios(s) -> dict[str, Column]:
    """The statistics that models see, by name; ``s`` is a struct of ``base_stats``."""
    n, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    per = lambda name, of: (s[name] / of).cast("double")
    return {
        "log_words": F.log1p(s["n_words"].cast("double")),
        "mean_word": per("word_chars", n),
        "symbol_share": per("n_symbols", chars),
        "dup_lines": per("n_dup_lines", F.greatest(s["n_lines"], F.lit(1))),
        "repeat_share": per("n_repeat_words", n),
        "letter_share": per("n_letters", chars),
        "upper_share": per("n_upper", F.greatest(s["n_letters"], F.lit(1))),
        "mark_share": per("n_marks", n),
        "shout_share": per("n_shouts", n),
        "digit_share": per("n_digits", chars),
        "distinct_share": per("n_distinct", n),
        "function_share": per("n_function", n),
        "words_per_line": per("n_words", F.greatest(s["n_lines"], F.lit(1))),
    }


def labelled_ratios(docs, labels, label: str, limit: int, held_out: bool):
    """``(names, X, y)`` of at most ``limit`` labelled documents per class.

    The bound holds whatever the input's size: the ids are picked by hash, the
    texts are joined to them before any statistic is computed, and ids that
    occur in several rows count once.
    """
    import numpy as np

    from .common import bounded_labels

    picked = bounded_labels(docs.sparkSession, labels, label, limit, held_out)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = texts.join(F.broadcast(picked), "doc_id")  # two times ``limit`` short rows at most
    stats = joined.select("doc_id", "label", base_stats(F.col("text")).alias("s"))
    named = ratios(F.col("s"))
    rows = (
        stats.select("doc_id", "label", F.array(*named.values()).alias("x"))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"), F.max("x").alias("x"))
        .orderBy("doc_id")
        .collect()
    )
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(named))
    return list(named), x, np.array([r["label"] for r in rows], dtype=int)
