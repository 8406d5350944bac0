"""Quality filtering by weak supervision.

Each rule looks at figures of a text and votes *keep*, *drop* or abstains. The
rules' accuracies are not known: expectation-maximisation over the counts of
all vote patterns of the corpus estimates, for either class, how often a rule
gives each vote, and the share of good texts. A text is kept if the posterior
probability of the good class reaches one half.

The patterns are at most ``3 ** len(RULES)``, whatever the corpus, so only a
bounded table of counts reaches the driver and only one of posteriors leaves it.

Edge cases: null counts as a text without words; an empty corpus keeps nothing
because there are no rows; texts without words fail the base rule.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_SPACE = re.compile(r"[ \t-\r]")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_WORD = re.compile(r"[^ \t-\r]+")

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_digits long, n_distinct long"


def figures(text: str | None) -> tuple[int, ...]:
    """The figures of :data:`FIGURES` for one whole text."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeats = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = -1
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeats += i + 2 - max(covered, i - 1)
                    covered = i + 2
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    letters = sum(map(str.isalpha, text))
    digits = sum(map(str.isdigit, text))
    return n, sum(map(len, words)), len(text) - len(text.translate(_SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), upper, letters, digits, len(set(words))


def figures_of(text: Column) -> Column:
    """Column ``struct`` of :data:`FIGURES` of a text column, by Arrow batches."""

    @F.pandas_udf(FIGURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([figures(x) for x in texts], columns=[x.split()[0] for x in FIGURES.split(", ")], dtype="int64")

    return run(text)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(keep: Column, drop: Column) -> Column:
    return F.when(drop, 0).when(keep, 1).otherwise(2)


#: Name and votes (0 drop, 1 keep, 2 abstain) of each rule.
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: _vote(F.col("n_words") >= 80, F.col("n_words") < 50),
    "repeated_words": lambda: _vote(_share("n_repeat_words", "n_words") < 0.15, _share("n_repeat_words", "n_words") > 0.4),
    "repeated_lines": lambda: _vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1), _share("n_dup_lines", "n_lines") > 0.3),
    "symbols": lambda: _vote(_share("n_symbols", "n_words") < 0.02, _share("n_symbols", "n_words") > 0.1),
    "word_length": lambda: _vote(_share("word_chars", "n_words").between(3, 9), (_share("word_chars", "n_words") < 2) | (_share("word_chars", "n_words") > 14)),
    "capitals": lambda: _vote(_share("n_upper", "n_letters") < 0.2, _share("n_upper", "n_letters") > 0.5),
    "letters": lambda: _vote(_share("n_letters", "word_chars") > 0.9, _share("n_letters", "word_chars") < 0.7),
    "digits": lambda: _vote(_share("n_digits", "word_chars") < 0.05, _share("n_digits", "word_chars") > 0.25),
    "vocabulary": lambda: _vote((_share("n_distinct", "n_words") > 0.25) | (F.col("n_words") > 2000), (_share("n_distinct", "n_words") < 0.1) & (F.col("n_words") <= 2000)),
}


def votes(of: DataFrame) -> Column:
    """Column with the pattern of all votes, a digit for each rule."""
    return F.concat(*[rule().cast("string") for rule in RULES.values()])


def label_model(patterns: dict[str, int], rounds: int = 100, prior: float = 0.8, anchor: float = 2.0) -> dict[str, float]:
    """Posterior probability of the good class for each vote pattern, by EM.

    The start takes the share of keep votes among the votes given; ``anchor``
    pseudo-counts hold a rule's keep vote more likely in the good class, which
    also fixes which class is which.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    votes_ = np.array([[int(c) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], dtype=float)
    keep, drop = (votes_ == 1).sum(axis=1), (votes_ == 0).sum(axis=1)
    good = np.clip((keep + 1.0) / (keep + 3 * drop + 2.0), 0.02, 0.98)
    start = np.array([[1.0, 3.0, 1.0], [3.0, 1.0, 1.0]]) * anchor  # good, bad by drop, keep, abstain
    for _ in range(rounds):
        like = []
        for c, weight in enumerate((good * n, (1 - good) * n)):
            table = np.array([[weight[votes_[:, r] == v].sum() for v in (0, 1, 2)] for r in range(votes_.shape[1])]) + start[c]
            like.append(np.log(table / table.sum(axis=1, keepdims=True)))
        share = np.clip(((good * n).sum() + 10 * prior) / (n.sum() + 10), 0.01, 0.99)
        at = np.arange(votes_.shape[1])
        score = np.log(share / (1 - share)) + sum(like[0][r, votes_[:, r]] - like[1][r, votes_[:, r]] for r in at)
        new = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return dict(zip(names, good.tolist(), strict=True))


def judge(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``votes``, ``p_good``, ``base_failed`` and ``kept`` to rows with the figures.

    ``rows`` is read twice (once for the corpus counts), so pass a stored table.
    """
    voted = rows.withColumn("votes", votes(rows))
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 ** rules rows
    good = rows.sparkSession.createDataFrame(sorted(label_model(counts).items()), "votes string, p_good double")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = voted.drop("p_good").join(F.broadcast(good), "votes", "left")  # a row for each pattern
    return voted.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
