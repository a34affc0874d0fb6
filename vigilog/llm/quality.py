"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each text. Expectation-maximisation
estimates how often each is right when it votes, and how many texts are good, from nothing but the
votes; it works on the counts of the different vote patterns, whose number depends on the labellers
alone. The posterior of a text's pattern then is its soft label, and a logistic regression over hashed
words learns from soft labels, so that texts on which labellers abstain are judged by their words.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .draws import drawn_texts

#: Frequent short words of the languages served, and words of abuse. Fixed values.
COMMON_WORDS = (
    "the and for that with was this from are not have der die das und ist von mit den ein eine "
    "les des est une que pour dans par sur avec los las del una por para con como más"
).split()
ABUSE_WORDS = (
    "idiot idiots moron morons stupid pathetic worthless clown clowns loser losers trash scum disgusting "
    "hate imbecile dumb garbage filthy shut kill"
).split()
#: Hashed features, documents that train the scorer (about), passes of the two fits, and the cut.
FEATURES = 1 << 14
TRAIN_DOCUMENTS = 12_000
EM_ROUNDS = 200
PASSES = 30
CUT = 0.5


def labellers(text: Column) -> dict[str, Column]:
    """Votes of each labeller: 1 good, 0 bad, null abstains. ``text`` must not be null."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    chars = F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    common = F.regexp_count(text, F.lit(rf"(?i)(?<!\S)(?:{'|'.join(COMMON_WORDS)})(?!\S)")) / F.greatest(words, F.lit(1))
    distinct_lines = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    letters = share(r"\p{L}")
    capitals = share(r"\p{Lu}") / F.greatest(letters, F.lit(0.01))
    sentences = F.regexp_count(text, F.lit(r"\p{L}[.!?](?:\s|$)")) / F.greatest(words, F.lit(1))
    abuse = F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(ABUSE_WORDS)})\b"))
    return {
        "length": vote((words >= 50) & (words <= 5000), words < 15),
        "common": vote(common >= 0.08, common < 0.02),
        "letters": vote(letters >= 0.75, letters < 0.6),
        "marks": vote(share(r"[^\p{L}\p{N}\s.,;:!?'-]") < 0.01, share(r"[^\p{L}\p{N}\s.,;:!?'-]") > 0.04),
        "capitals": vote(capitals < 0.15, capitals > 0.4),
        "sentences": vote((sentences >= 0.02) & (sentences <= 0.4), sentences < 0.005),
        "lines": vote((F.size(lines) >= 2) & (distinct_lines > 0.9), distinct_lines < 0.6),
        "abuse": vote(F.lit(False), abuse >= 2),
    }


def votes(docs: DataFrame) -> DataFrame:
    """``doc_id, text, pattern`` of each row; ``pattern`` has a character per labeller: 1, 0 or ``-``.

    Null text is the empty text."""
    full = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = [F.coalesce(v.cast("string"), F.lit("-")) for v in labellers(F.col("text")).values()]
    return full.withColumn("pattern", F.concat(*marks))


def fit_labellers(counts: list[tuple[str, int]]) -> tuple[dict[str, float], list[float], float]:
    """Posterior of each pattern, accuracy of each labeller, and share of good texts, from pattern counts.

    A labeller gives good, bad or nothing with chances of its own in each class; its accuracy is how
    often its vote is right. The start takes a text for the worse the more bad votes it has, which
    names the classes; chances are smoothed by one text each.
    """
    if not counts:
        return {}, [], 0.5
    patterns = [p for p, _ in counts]
    n = np.array([c for _, c in counts], np.float64)
    outcome = np.array([["10-".index(x) for x in p] for p in patterns])
    given = np.eye(3)[outcome]  # pattern x labeller x outcome
    posterior = np.clip(0.95 - 0.3 * (outcome == 1).sum(axis=1), 0.05, 0.95)
    chance, prior = np.empty((2, *given.shape[1:])), 0.5
    for _ in range(EM_ROUNDS):
        for k, weight in enumerate((posterior * n, (1 - posterior) * n)):
            sums = np.einsum("p,pjo->jo", weight, given) + 1
            chance[k] = sums / sums.sum(axis=1, keepdims=True)
        prior = float((posterior @ n + 1) / (n.sum() + 2))
        good, bad = (np.einsum("pjo,jo->p", given, np.log(c)) for c in chance)
        new = 1 / (1 + np.exp(np.clip(bad + np.log1p(-prior) - good - np.log(prior), -500, 500)))
        done = np.abs(new - posterior).max() < 1e-9
        posterior = new
        if done:
            break
    right = prior * chance[0, :, 0] + (1 - prior) * chance[1, :, 1]
    voted = prior * chance[0, :, :2].sum(axis=1) + (1 - prior) * chance[1, :, :2].sum(axis=1)
    return dict(zip(patterns, posterior.tolist(), strict=True)), (right / voted).tolist(), prior


def _hashed(rows: DataFrame) -> DataFrame:
    """Add ``features``: the hashed words of the text, each once."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    return HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES, binary=True).transform(
        rows.withColumn("words", words)
    )


def train(labelled: DataFrame, most: int = TRAIN_DOCUMENTS) -> LogisticRegressionModel:
    """A scorer from rows of ``text, posterior``, of at most ``most`` distinct texts, the smallest by hash.

    A soft label is two weighted examples, one of each class. ``labelled`` has a row at least."""
    chosen = drawn_texts(labelled.select("text", "posterior"), most)
    both = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")),
        )
    )
    examples = materialise(
        _hashed(chosen).select("features", both.alias("e")).select("features", "e.*").filter("weight > 0.001"), "examples"
    )
    return LogisticRegression(weightCol="weight", maxIter=PASSES, regParam=0.02, standardization=False).fit(examples)


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, pattern, posterior, quality, keep`` of each row of ``doc_id, text``.

    ``pattern`` is the labellers' votes, ``posterior`` the probability that the text is good given
    them, ``quality`` the scorer's, and ``keep`` whether the mean of both reaches ``CUT``. Null and empty
    texts are scored like any other; repeated rows get the same scores; an empty table gives no rows.
    Other columns are not looked at.
    """
    seen = materialise(votes(docs), "votes")  # with the texts: reading them costs less than voting again
    counts = [(r[0], r[1]) for r in seen.groupBy("pattern").count().collect()]  # at most 3 ** labellers
    posteriors, _, _ = fit_labellers(sorted(counts))
    if not posteriors:
        return seen.select(
            "doc_id", "pattern", *[F.lit(0.5).alias(c) for c in ("posterior", "quality")], F.lit(True).alias("keep")
        )
    of_pattern = F.create_map(*[F.lit(x) for pair in posteriors.items() for x in pair])
    labelled = seen.withColumn("posterior", of_pattern[F.col("pattern")])
    model = train(labelled)
    judged = model.transform(_hashed(labelled))
    quality = vector_to_array("probability")[1]
    return judged.select(
        "doc_id", "pattern", "posterior", quality.alias("quality"), ((F.col("posterior") + quality) / 2 >= CUT).alias("keep")
    )
