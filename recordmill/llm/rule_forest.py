"""Quality rules: fixed limits, and an isolation forest over the statistics behind them.

The forest splits bounded samples at random; rows that few splits isolate are anomalous.
By the method each tree sees ``SAMPLE`` rows, so at most ``TREES * SAMPLE`` rows reach
the driver, those with the smallest hashes of all rows. All rows are scored. The limit of
the score is calibrated on all labelled rows: the lowest one at which no more than
``GOOD_LOST`` of the good rows are lost.

Defined results: null and empty texts have no words and fail the base rules; without
labelled good rows the forest rejects nothing; repeated rows get equal verdicts; an empty
table gives an empty result. Columns named like a result are replaced, others kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import add_in_arrow, smallest_hashes
from recordmill.llm.text_stats import rule_counts

TREES, SAMPLE, SEED = 100, 256, 20240102
GOOD_LOST = 0.005
STEPS = 2000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the rule statistics of every text and ``base_failed``."""
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = np.array([rule_counts(t or "") for t in batch.column(text).to_pylist()], np.int64).reshape(-1, len(COUNTS))
        return {c: pa.array(rows[:, i]) for i, c in enumerate(COUNTS)}

    counted = add_in_arrow(df, ", ".join(f"{c} bigint" for c in COUNTS), run)
    return counted.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def statistics(columns: list[np.ndarray]) -> np.ndarray:
    """What the forest splits: mean word length and the shares of symbols, repeated lines and repeated words."""
    words, chars, symbols, lines, repeats = (c.astype(float) for c in columns)
    n = np.maximum(words, 1)
    return np.stack([np.log1p(words), chars / n, symbols / n, lines / n, repeats / n], axis=1)


class Forest:
    """Random isolation trees in arrays: feature (-1 for a leaf), cut, children, and path length at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.norm = _average_path(min(sample, len(rows)))
        self.trees = []
        for _ in range(trees):
            own = rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)]
            nodes: list[list[float]] = []
            self._grow(own, 0, int(np.ceil(np.log2(max(len(own), 2)))), rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, rows: np.ndarray, depth: int, most: int, rng, nodes: list) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, depth + _average_path(len(rows))])
        low, high = rows.min(axis=0), rows.max(axis=0)
        free = np.flatnonzero(high > low)
        if depth < most and len(rows) > 1 and len(free):
            feature = int(rng.choice(free))
            cut = rng.uniform(low[feature], high[feature])
            left = rows[:, feature] <= cut
            nodes[at][:2] = [feature, cut]
            nodes[at][2] = self._grow(rows[left], depth + 1, most, rng, nodes)
            nodes[at][3] = self._grow(rows[~left], depth + 1, most, rng, nodes)
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; short average paths give high scores."""
        total = np.zeros(len(rows))
        for tree in self.trees:
            at = np.zeros(len(rows), np.int64)
            feature, cut = tree[:, 0].astype(np.int64), tree[:, 1]
            children = tree[:, 2:4].astype(np.int64)
            live = np.arange(len(rows))
            while len(live):
                live = live[feature[at[live]] >= 0]
                node = at[live]
                at[live] = children[node, (rows[live, feature[node]] > cut[node]).astype(np.int64)]
            total += tree[at, 4]
        return 2 ** (-total / len(self.trees) / max(self.norm, 1e-9)) if self.trees else total


def _average_path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit(counted: DataFrame, key: str = "doc_id") -> Forest | None:
    """A forest from the rows with the smallest hashes."""
    sample = smallest_hashes(counted.select(key, *COUNTS), TREES * SAMPLE, key, *COUNTS).toArrow()
    if not sample.num_rows:
        return None
    return Forest(statistics([sample.column(c).to_numpy() for c in COUNTS]))


def anomaly(counted: DataFrame, forest: Forest | None, out: str = "anomaly") -> DataFrame:
    """Adds the forest's score in whole steps of ``1 / STEPS``."""
    if forest is None:
        return counted.withColumn(out, F.lit(0).cast("long"))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        scores = forest.score(statistics([batch.column(c).to_numpy() for c in COUNTS]))
        return {out: pa.array(np.floor(scores * STEPS).astype(np.int64))}

    return add_in_arrow(counted, f"`{out}` bigint", run)


def limit(scored: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", good_lost: float = GOOD_LOST) -> int:
    """The lowest step above which at most the share ``good_lost`` of good labelled rows lies."""
    good = labels.filter(F.col(label) == 1).select(key).distinct()
    counts = dict(map(tuple, scored.filter("not base_failed").join(good, key).groupBy("anomaly").count().collect()))  # at most STEPS rows
    allowed, at = good_lost * sum(counts.values()), STEPS
    for step in sorted(counts, reverse=True):
        allowed -= counts[step]
        if allowed < 0:
            return step
        at = step - 1
    return at if counts else STEPS


def judge(counted: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``anomaly`` and ``kept``; ``counted`` is read three times and should be a stored table without texts."""
    scored = anomaly(counted, fit(counted, key))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= limit(scored, labels, key)))
