"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Every rule rejects documents whose score reaches a cutoff. For each stratum (language) the labelled good documents are
a holdout. All rules' cutoffs form one sequence, fixed beforehand, from the highest of each rule down in turns; each
step adds one cutoff to those before. A step whose rules together reject k of the n passes if the exact binomial tail
P(Bin(n, a) <= k) does not exceed d, where a = `max_false_rejection` holds for all rules together and d = `error` /
number of strata that can pass. Testing ends at the first step that fails (fixed-sequence testing), so that steps
need no correction for their number. Whether a stratum can pass depends on n alone: it does where k = 0 would; one
with too few labels takes no share of the error and keeps its documents, apart from the base rules.

Features are counted in one pass over whole texts. Numbers of one document never depend on other documents.

Defined cases: a NULL text has no words, and fails the base rules, as an empty one does. A NULL language is a stratum
of its own. A document with several label rows is good only if all say so; labels with NULL in `quality` say nothing,
a NULL `toxic` counts as 0. Repeated rows give equal results. Input columns with the name of an output column are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyspan.llm.common import settled, small_broadcast, without

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"

SHARES = (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.14, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0)


@dataclass(frozen=True)
class RiskControl:
    """Limits of the selection, and the cutoffs that are tried for each rule."""

    max_false_rejection: float = 0.01
    error: float = 0.05
    min_words: int = 10
    max_repeat_percent: int = 20
    grids: tuple[tuple[str, tuple[float, ...]], ...] = (
        ("symbol_share", SHARES),
        ("dup_line_share", SHARES),
        ("repeat_share", SHARES),
        ("mean_word_chars", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 40.0)),
        ("short_word_share", (0.3, 0.35, 0.4, 0.5, 0.6, 0.8, 1.0)),
    )


def repeated_words(words: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """Number of words inside windows of `size` words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Windows are numbered exactly: two halves are combined, and renumbered where the product could overflow.
    key, top = ids[:n].copy(), len(number)
    for step in range(1, size):
        if top * len(number) >= 2**62:
            values, key = np.unique(key, return_inverse=True)
            top = len(values)
        key = key * len(number) + ids[step : step + n]
        top *= len(number)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """The values of FEATURES for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    blanks = sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - blanks,
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def _add_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Rows are taken in small slices, so that a batch of very long texts is never held twice.
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [text_features(t.as_py()) for t in part.column(part.schema.get_field_index("text"))]
            columns = [pa.array([row[i] for row in rows], pa.int64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *FEATURES])


def with_features(docs: DataFrame) -> DataFrame:
    """`docs` and the columns FEATURES."""
    kept = without(docs, FEATURES)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + "".join(
        f", {name} bigint" for name in FEATURES
    )
    return kept.mapInArrow(_add_features, schema)


def scores() -> dict[str, Column]:
    """Score of each rule, from the features; 0 where it has no meaning."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
        "short_word_share": share("n_words", "word_chars"),
    }


def base_failed(params: RiskControl = RiskControl()) -> Column:
    return (F.col("n_words") < params.min_words) | (
        100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words")
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly, for k below the mean; 1 otherwise (such a k never passes)."""
    if n <= 0 or k >= n * p:
        return 1.0
    log_term = (
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    total, term, i = 0.0, 1.0, k
    while i >= 0 and term > 1e-17 * max(total, 1e-300):  # terms fall towards 0, faster and faster
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p) if i else 0.0
        i -= 1
    return min(1.0, math.exp(log_term) * total)


def cutoff_sequence(params: RiskControl = RiskControl()) -> list[tuple[str, float]]:
    """(rule, cutoff) in the order of testing: each rule's from the highest down, all rules at equal pace."""
    paced = [
        (at / len(grid), number, name, cutoff)
        for number, (name, grid) in enumerate(params.grids)
        for at, cutoff in enumerate(sorted(grid, reverse=True))
    ]
    return [(name, cutoff) for _, _, name, cutoff in sorted(paced)]


def holdout_counts(features: DataFrame, labels: DataFrame, params: RiskControl = RiskControl()) -> DataFrame:
    """For each stratum and step of `cutoff_sequence`: `n` good labelled documents, `k` of them rejected so far.

    Combined before the shuffle: what moves is at most strata x steps rows a task. Documents that the base rules reject
    are no part of the holdout, as the method doesn't judge them.
    """
    good = (
        labels.where(F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where((F.col("quality") >= 1) & (F.col("toxic") == 0))
        .select("doc_id")
    )
    holdout = features.where(~base_failed(params)).join(good, "doc_id", "left_semi")
    rule_scores, steps = scores(), cutoff_sequence(params)
    # The first step that rejects the document: all later ones do, too.
    first = F.least(
        F.lit(len(steps)),
        *(F.when(rule_scores[name] >= cutoff, at).otherwise(len(steps)) for at, (name, cutoff) in enumerate(steps)),
    )
    counts = holdout.groupBy("stratum", first.alias("first")).agg(F.count("*").alias("docs"))
    # Of one stratum there are at most as many rows as steps, and one.
    per_stratum = counts.groupBy("stratum").agg(
        F.sum("docs").alias("n"), F.collect_list(F.struct("first", "docs")).alias("levels")
    )
    table = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(cutoff).alias("cutoff")) for name, cutoff in steps))
    return per_stratum.select("stratum", "n", "levels", F.posexplode(table).alias("step", "s")).select(
        "stratum",
        "step",
        "s.rule",
        "s.cutoff",
        "n",
        F.aggregate(
            F.filter("levels", lambda x: x["first"] <= F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x["docs"]
        ).alias("k"),
    )


def shared_error(sizes: Iterable[tuple[int, int]], params: RiskControl = RiskControl()) -> float:
    """Error of one stratum, from pairs (n, strata of this n): those that can pass share it; 0 if none can."""
    strata, share = 0, 0.0
    for n, times in sorted(sizes, reverse=True):
        for _ in range(times):
            strata += 1
            if binomial_tail(0, n, params.max_false_rejection) > params.error / strata:
                return share
            share = params.error / strata
    return share


def select_cutoffs(features: DataFrame, labels: DataFrame, params: RiskControl = RiskControl()) -> DataFrame:
    """One row for each stratum where a step passes: the chosen cutoff of each rule, NULL where none passes."""
    counts = settled(holdout_counts(features, labels, params))
    limit = params.max_false_rejection
    sizes = counts.where((F.col("step") == 0) & (F.pow(F.lit(1 - limit), F.col("n")) <= params.error * 1.001))
    allowed = shared_error([(r["n"], r["times"]) for r in sizes.groupBy("n").agg(F.count("*").alias("times")).collect()], params)

    @F.pandas_udf("boolean")
    def passes(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), limit) <= allowed for a, b in zip(k, n, strict=True)])

    # k never falls along the sequence, so the steps that pass are those before the first that fails.
    passed = counts.where(passes("k", "n"))
    chosen = [
        F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name, _ in params.grids
    ]
    return settled(passed.groupBy("stratum").agg(*chosen))


def stratum_of(docs: DataFrame) -> Column:
    """The language, with a mark for NULL; one stratum for all if there is no such column."""
    if "lang" not in docs.columns:
        return F.lit("all")
    return F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))


def _judged(features: DataFrame, cutoffs: DataFrame, params: RiskControl) -> DataFrame:
    rule_scores = scores()
    rejected = F.lit(False)
    for name, _ in params.grids:
        rejected = rejected | F.coalesce(rule_scores[name] >= F.col(f"cut_{name}"), F.lit(False))
    return (
        features.join(small_broadcast(cutoffs), "stratum", "left")
        .withColumn("base_failed", base_failed(params))
        .withColumn("kept", ~F.col("base_failed") & ~rejected)
        .drop("stratum", *(f"cut_{name}" for name, _ in params.grids))
    )


def quality_verdicts(docs: DataFrame, labels: DataFrame, params: RiskControl = RiskControl()) -> DataFrame:
    """doc_id, features, `base_failed` and `kept`, for each row of `docs`."""
    stratum = stratum_of(docs).alias("stratum")
    features = settled(with_features(docs.select("doc_id", "text", stratum)).drop("text"))
    return _judged(features, select_cutoffs(features, labels, params), params)


def kept_documents(docs: DataFrame, labels: DataFrame, params: RiskControl = RiskControl()) -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns. Texts are read twice rather than shuffled."""
    stratum = stratum_of(docs).alias("stratum")
    features = settled(with_features(docs.select("doc_id", "text", stratum)).drop("text"))
    cutoffs = select_cutoffs(features, labels, params)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text", stratum)
    judged = _judged(with_features(whole).drop("text"), cutoffs, params)
    return judged.where("kept").select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
