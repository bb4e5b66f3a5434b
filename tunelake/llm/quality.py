"""Quality rules whose cutoffs come with a bound on the clean documents they reject.

Fixed base rules reject first. What they leave is judged by ratios (more is worse). For every stratum and ratio,
cutoffs of a fixed grid are tried on the labelled documents, which nothing else is fitted on: a cutoff may be used
only if the exact (Clopper-Pearson) upper bound on the share of good documents above it is within the ratio's
part of ``max_false_rejection``, at a confidence that is divided by the number of all stratum, ratio and cutoff
tests (Bonferroni). So, with probability ``confidence`` at least, no stratum loses more than
``max_false_rejection`` of its good documents through the cutoffs. Among the cutoffs that may be used, the one with
the best balance of bad and good labels above it is taken, the mildest if several are equal, none if none gains.
A stratum with too few labels to prove a bound keeps all that the base rules keep.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm import texts
from tunelake.session import settle

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

RATIOS = {
    "symbols": (("n_symbols", "n_words"), (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "dup_lines": (("n_dup_lines", "n_lines"), (0.8, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "word_length": (("word_chars", "n_words"), (60.0, 40.0, 30.0, 20.0, 15.0)),
}
"""Numerator, denominator and the cutoffs to try, from mild to strict."""

MAX_FALSE_REJECTION = 0.02
CONFIDENCE = 0.95
GOOD_COST = 20.0
"""What the loss of a good document weighs against the catch of a bad one."""

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _features(part: texts.Slice) -> dict[str, np.ndarray]:
    data, offsets = part.data, part.offsets
    space = texts.SPACE[data]
    starts, ends, bounds = part.words(space)
    hashes = texts.prefix_hashes(data)
    words = texts.span_hashes(hashes, starts, ends)
    text_of_word = np.repeat(np.arange(part.size, dtype=np.uint64), np.diff(bounds))

    windows = texts.window_hashes(words, WINDOW)
    inside = text_of_word[: len(windows)] == text_of_word[WINDOW - 1:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    again = at[texts.repeated(windows[at] ^ texts.mix(text_of_word[at] + np.uint64(1)))]
    covered = np.zeros(len(words) + 1, np.int64)
    covered[again] += 1
    np.subtract.at(covered, again + WINDOW, 1)
    covered = np.cumsum(covered)[:-1] > 0

    newline = np.flatnonzero(data == 0x0A)
    line_starts = np.union1d(newline + 1, offsets[:-1][np.diff(offsets) > 0])
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), len(data))
    line_ends = line_ends - ((line_ends > line_starts) & (data[line_ends - 1] == 0x0A)) if len(line_starts) else line_ends
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    text_of_line = np.searchsorted(offsets, line_starts, "right") - 1
    lines = texts.span_hashes(hashes, line_starts, line_ends) ^ texts.mix(text_of_line.astype(np.uint64) + np.uint64(1))
    line_bounds = np.searchsorted(line_starts, offsets)

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    return {
        "n_words": np.diff(bounds),
        "word_chars": texts.per_text(~space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": texts.per_text(symbol[data], offsets),
        "n_lines": np.diff(line_bounds),
        "n_dup_lines": texts.per_text(texts.later_copies(lines), line_bounds),
        "n_repeat_words": texts.per_text(covered, bounds),
    }


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [batch.column(i) for i in range(1, batch.num_columns)]
        for part in texts.slices(batch.column(0)):
            found = [pa.array(values.astype(np.int64)) for values in _features(part).values()]
            kept = [column.slice(part.first, part.size) for column in rest]
            yield pa.RecordBatch.from_arrays(kept + found, names=batch.schema.names[1:] + list(FEATURES))
    texts.release()


def text_features(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Counts of words, code points in words, symbols, lines with a word, later copies of such lines, and words
    in 5-word windows that occur twice or more. Columns ``keep`` are passed on; a NULL text counts as empty."""
    fields = [f"`{name}` {df.schema[name].dataType.simpleString()}" for name in keep]
    schema = ", ".join(fields + [f"{name} long" for name in FEATURES])
    return df.select(F.col(text).alias("_text"), *keep).mapInArrow(_feature_batches, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def ratio(name: str) -> Column:
    above, below = RATIOS[name][0]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed from the largest term down."""
    if k >= n:
        return 1.0
    total = 0.0
    for i in range(k, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                        + i * math.log(p) + (n - i) * math.log1p(-p))
        total += term
        if i < n * p and term < 1e-18:
            break
    return total


def cutoffs(
    labelled: DataFrame, stratum: str, n_strata: int, max_false_rejection: float = MAX_FALSE_REJECTION,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """The chosen cutoff of each stratum and ratio: columns ``_stratum``, ``cut_<ratio>`` (NULL: none may be used).

    ``labelled`` has the features, the stratum and ``good`` (boolean) of labelled documents.
    """
    counts = labelled.where(~base_failed()).groupBy(F.col(stratum).alias("_stratum")).agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"),
        *[F.count_if((ratio(name) > cut) & F.col("good") if good else (ratio(name) > cut) & ~F.col("good"))
          .alias(f"{'good' if good else 'bad'}_{name}_{i}")
          for name, (_, grid) in RATIOS.items() for i, cut in enumerate(grid) for good in (True, False)],
    )
    tests = n_strata * sum(len(grid) for _, grid in RATIOS.values())
    level = (1 - confidence) / max(1, tests)
    share = max_false_rejection / len(RATIOS)

    def choose(groups: Iterator) -> Iterator:
        import pandas as pd

        for rows in groups:
            chosen = []
            for row in rows.to_dict("records"):
                out = {"_stratum": row["_stratum"]}
                for name, (_, grid) in RATIOS.items():
                    best, gain = None, 0.0
                    for i, cut in enumerate(grid):
                        lost, caught = row[f"good_{name}_{i}"], row[f"bad_{name}_{i}"]
                        if row["n_good"] == 0 or binomial_cdf(lost, row["n_good"], share) > level:
                            continue
                        value = caught / max(1, row["n_bad"]) - GOOD_COST * lost / row["n_good"]
                        if value > gain:
                            best, gain = cut, value
                    out[f"cut_{name}"] = best
                chosen.append(out)
            yield pd.DataFrame(chosen, columns=["_stratum", *[f"cut_{name}" for name in RATIOS]])

    kind = labelled.schema[stratum].dataType.simpleString()
    schema = f"_stratum {kind}, " + ", ".join(f"cut_{name} double" for name in RATIOS)
    return counts.mapInPandas(choose, schema)


def judge(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang",
    max_false_rejection: float = MAX_FALSE_REJECTION, confidence: float = CONFIDENCE,
) -> DataFrame:
    """One row per row of ``docs``: key, stratum, features, ``base_failed``, ``kept``. Other columns are left out.

    ``labels`` has the key and ``quality`` (1 good, 0 bad, NULL ignored). A key labelled twice is good if all its
    labels are; rows of ``docs`` with the same key each count. NULL keys are unlabelled, a NULL stratum is a stratum
    of its own, empty and NULL texts have no words and fail the base rules, and empty tables give no rows.
    """
    features = settle(text_features(docs, [key, stratum], text))
    return _judged(features, _chosen(features, labels, key, stratum, max_false_rejection, confidence), stratum)


def _chosen(features: DataFrame, labels: DataFrame, key: str, stratum: str, max_false_rejection: float,
            confidence: float) -> DataFrame:
    good = labels.where("quality IS NOT NULL").groupBy(key).agg((F.min("quality") == 1).alias("good"))
    n_strata = features.select(stratum).distinct().count()
    return cutoffs(features.join(good, key), stratum, n_strata, max_false_rejection, confidence)


def _judged(features: DataFrame, chosen: DataFrame, stratum: str) -> DataFrame:
    judged = features.join(chosen, features[stratum].eqNullSafe(chosen["_stratum"]), "left").drop("_stratum")
    above = [F.coalesce(ratio(name) > F.col(f"cut_{name}"), F.lit(False)) for name in RATIOS]
    rejected = above[0]
    for one in above[1:]:
        rejected = rejected | one
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected)


def select_documents(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang",
    max_false_rejection: float = MAX_FALSE_REJECTION, confidence: float = CONFIDENCE,
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns, without a shuffle of texts."""
    names = docs.columns
    plain = docs.select(*[F.col(name).alias(f"_c{i}") for i, name in enumerate(names)])
    at = {name: f"_c{i}" for i, name in enumerate(names)}
    features = settle(text_features(docs, [key, stratum], text))
    chosen = _chosen(features, labels, key, stratum, max_false_rejection, confidence)
    whole = text_features(plain, plain.columns, at[text])
    return _judged(whole, chosen, at[stratum]).where("kept").select(
        *[F.col(at[name]).alias(name) for name in names])
