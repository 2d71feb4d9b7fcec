"""Weak supervision: rules vote good, bad or not at all; their accuracies are learnt without labels.

Votes of all rows are counted by pattern (at most 3 to the number of rules),
expectation-maximisation runs on those counts, and the posterior of a row is
the logistic of a sum over its votes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lapsekit.llm.buffers import tidy
from lapsekit.session import stage

WHITE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_marks bigint, n_upper bigint, n_top bigint"
MIN_WORDS, REPEAT_SHARE = 50, 0.5
#: Posterior from which a row is kept.
KEEP = 0.5
GOOD, BAD, ABSTAIN = 1, -1, 0


def _repeat_words(ids: np.ndarray, width: int = 3) -> tuple[int, int]:
    """Words in windows of three that stand twice or more, and how often the commonest word stands. Exact."""
    n = len(ids)
    top = int(np.bincount(ids).max()) if n else 0
    if n <= width:
        return 0, top
    size = int(ids.max()) + 1
    pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(n, bool)
    for i in range(width):
        covered[starts + i] = True
    return int(covered.sum()), top


def text_features(text: str | None) -> tuple[int, ...]:
    """The measures of ``FEATURES``. Words are split at ASCII white space; null is empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    ids: dict[bytes, int] = {}
    numbered = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    repeated, top = _repeat_words(numbered)
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line in seen:
            lines += bool(line.strip(WHITE))
        seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        lines,
        repeated,
        sum(map(text.count, "!?;:")),
        sum(1 for w in words if len(w) > 1 and w.isupper()),
        top,
    )


def _measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [part.split()[0] for part in FEATURES.split(", ")]
    for batch in texts:
        rows = np.array([text_features(text.as_py()) for text in batch], np.int64).reshape(len(batch), len(names))
        yield pa.StructArray.from_arrays([pa.array(column) for column in rows.T.copy()], names=names)


def features(text: Column) -> Column:
    """Struct of the measures of a text."""
    # Called non-deterministic so that a filter on it doesn't make Spark measure each text twice.
    def measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(_measured)(texts)

    return F.arrow_udf(measured, FEATURES).asNondeterministic()(text)


def _measures(prefix: str) -> dict[str, Column]:
    return {name: F.col(f"{prefix}{name}") for name in (part.split()[0] for part in FEATURES.split(", "))}


def base_failed(m: dict[str, Column]) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > int(100 * REPEAT_SHARE) * m["n_words"])


def rule_votes(m: dict[str, Column]) -> dict[str, Column]:
    """Each rule's vote. Ratios are to the words of the text.

    A rule that knows one fault votes bad or not at all: that its fault is
    missing says nothing of others. Only the rules on how a text looks as a
    whole vote good.
    """
    words = F.greatest(m["n_words"], F.lit(1))
    length = m["word_chars"] / words

    def fault(value: Column, limit: float) -> Column:
        return F.when(value / words >= limit, BAD).otherwise(ABSTAIN)

    plain = (m["n_symbols"] <= 0.02 * words) & (m["n_marks"] <= 0.1 * words) & (m["n_upper"] <= 0.1 * words)
    return {
        "symbols": fault(m["n_symbols"], 0.25),
        "marks": fault(m["n_marks"], 0.4),
        "capitals": fault(m["n_upper"], 0.4),
        "commonest": fault(m["n_top"], 0.35),
        "lines": fault(m["n_dup_lines"] * 50, 1.5),
        "repeats": fault(m["n_repeat_words"], 0.35),
        "word_length": F.when((length < 2.5) | (length > 9), BAD).when(length.between(3.5, 7), GOOD).otherwise(ABSTAIN),
        "plain": F.when(plain, GOOD).otherwise(ABSTAIN),
    }


@dataclass(frozen=True)
class VoteModel:
    """Log prior odds of good, and for every rule the log odds that a good, bad or missing vote adds."""

    prior: float
    weights: dict[str, tuple[float, float, float]]

    def posterior(self, votes: dict[str, Column]) -> Column:
        odds = F.lit(self.prior)
        for name, (good, bad, none) in self.weights.items():
            odds = odds + F.when(votes[name] == GOOD, good).when(votes[name] == BAD, bad).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def fit_votes(counts: list[tuple], names: list[str], rounds: int = 200, tolerance: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over patterns of votes; each entry: one vote per rule, then the count.

    Two classes, independent votes given the class, abstaining included. It
    starts from the majority of the votes, which fixes which class is the good
    one; smoothing of one vote keeps unseen votes possible. No rows: the votes count alike.
    """
    table = np.array([c[:-1] for c in counts], dtype=np.int64).reshape(len(counts), len(names))
    n = np.array([c[-1] for c in counts], dtype=float)
    good = 1 / (1 + np.exp(-1.5 * table.sum(axis=1))) if len(counts) else np.zeros(0)
    kinds = (GOOD, BAD, ABSTAIN)
    is_kind = np.stack([table == kind for kind in kinds], axis=2).astype(float)
    start = np.array([0.7, 0.2, 0.1])
    prior, before = 0.5, None
    given = [np.tile(start, (len(names), 1)), np.tile(start[[1, 0, 2]], (len(names), 1))]
    for _ in range(rounds if len(counts) else 0):
        for side, belief in enumerate((good, 1 - good)):
            weight = np.einsum("p,prk->rk", n * belief, is_kind) + (start if side == 0 else start[[1, 0, 2]])
            given[side] = weight / weight.sum(axis=1, keepdims=True)
        prior = ((n * good).sum() + 1) / (n.sum() + 2)
        logs = [np.einsum("prk,rk->p", is_kind, np.log(g)) for g in given]
        odds = math.log(prior / (1 - prior)) + logs[0] - logs[1]
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if before is not None and np.abs(good - before).max() < tolerance:
            break
        before = good
    weights = np.log(given[0]) - np.log(given[1])
    return VoteModel(
        round(math.log(prior / (1 - prior)), 9), {name: tuple(round(float(x), 9) for x in w) for name, w in zip(names, weights)}
    )


def learn(measured: DataFrame, prefix: str = "") -> VoteModel:
    """The vote model of rows with the columns of ``FEATURES``; rows failing the base rules don't take part."""
    m = _measures(prefix)
    votes = rule_votes(m)
    names = list(votes)
    counts = measured.filter(~base_failed(m)).groupBy(*(votes[name].alias(name) for name in names)).count().orderBy(*names)
    return fit_votes([tuple(row) for row in counts.collect()], names)


def verdict(m: dict[str, Column], model: VoteModel) -> tuple[Column, Column]:
    """Posterior that a row is good, and whether it is kept."""
    posterior = model.posterior(rule_votes(m))
    return posterior, ~base_failed(m) & (posterior >= KEEP)


def quality_scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: measures, base rule, votes' posterior and verdict.

    Null and empty texts have no words and fail. Repeated rows stay repeated
    and count each; an empty table gives no row. Other columns are left out.
    """
    measured = stage(df.select(F.col(key).alias("key"), features(F.col(text)).alias("m")).select("key", "m.*"), "quality")
    m = _measures("")
    posterior, kept = verdict(m, learn(measured))
    return measured.select(
        F.col("key").alias(key), *list(m)[:5], base_failed(m).alias("base_failed"), kept.alias("kept"),
        F.round(posterior, 6).alias("posterior"),
    )


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose verdict is to keep. Texts are measured once to learn and once to filter, not stored."""
    measured = df.withColumn("_quality", features(F.col(text)))
    model = learn(measured, "_quality.")
    return measured.filter(verdict(_measures("_quality."), model)[1]).select(*df.columns)
