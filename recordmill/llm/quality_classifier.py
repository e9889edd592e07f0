"""Quality scores: random Fourier features, ridge regression and isotonic calibration.

Statistics of a text's shape (``text_stats.SHAPE_NAMES``) are standardised and mapped to
cosines of random directions, which approximates a Gaussian kernel. Every task sums the
normal equations of its labelled rows; the sums are added up in a tree, and the driver
solves one system of fixed size. The raw scores of labelled rows that took no part in the
regression are counted in ``STEPS`` steps, and the pool-adjacent-violators solution over
these counts turns raw scores into shares of good documents.

Defined results: null and empty texts are scored like any other (all statistics zero);
rows with no id are scored but never learned from; several labels of one id are averaged;
repeated rows get equal scores; without labelled rows every score is 1, as nothing speaks
against a document; if no labelled row is set aside for calibration, half of the distinct rows
are, and if they are too few even for that, every score is the mean label. Columns named
``features`` or ``score``, whatever the case of their letters, are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import add_in_arrow
from recordmill.llm.text_stats import SHAPE_NAMES, rule_counts, shape

#: Random features, width of the kernel in standard deviations, ridge weight, and seed.
FEATURES, WIDTH, RIDGE, SEED = 192, 4.0, 1e-3, 20240101
#: Raw scores are counted in so many steps between the two bounds.
STEPS, LOW, HIGH = 2000, -0.5, 1.5
#: Sums added by one task of the tree.
FAN_IN = 32


def featurize(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        return {out: pa.array([shape(t, rule_counts(t)) for t in texts], pa.list_(pa.float64()))}

    return add_in_arrow(df, f"`{out}` array<double>", run)


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, 1 / width, (len(mean), features))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights: np.ndarray | None = None
        self.levels: np.ndarray | None = None

    def design(self, rows: np.ndarray) -> np.ndarray:
        """Intercept, standardised statistics and random Fourier features."""
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(z), 1)), z, waves])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.design(rows) @ self.weights

    def step(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((self.raw(rows) - LOW) / (HIGH - LOW) * STEPS), 0, STEPS - 1).astype(np.int64)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.levels is None or not len(rows):
            return np.ones(len(rows))
        return self.levels[self.step(rows)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(SHAPE_NAMES)))


def add_up(sums: DataFrame) -> np.ndarray | None:
    """The sum of the ``sum`` blobs of doubles, in a tree of ``FAN_IN`` and in the order of ``part``.

    The order is fixed, so a task that runs again adds the same numbers to the same result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("sum").to_pylist()):
                value = np.frombuffer(blob)
                total, first = (value.copy(), part) if total is None else (total + value, first)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sum"])

    tasks = sums.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        sums = sums.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, "part bigint, sum binary")
    row = sums.first()
    return None if row is None else np.frombuffer(row["sum"])


def fit(rows: DataFrame, target: str = "target", part: str = "part", features: str = "features", ridge: float = RIDGE) -> Model | None:
    """A model from labelled rows; those with ``part`` 0 fit the regression, those with 1 calibrate.

    ``rows`` is read three times and should be a stored table without texts.
    """
    width = len(SHAPE_NAMES)
    held = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}
    if held and len(held) < 2:
        rows = rows.withColumn(part, (F.xxhash64(features) % 2 != 0).cast("int"))
    fitting = rows.filter(F.col(part) == 0)
    moments = fitting.select(F.count("*"), *(f(F.col(features)[i]) for i in range(width) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return _even(rows, target) if held else None
    mean, scale = (np.array(moments[k::2], float) for k in (1, 2))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            x = model.design(_matrix(batch.column(features)))
            joint = np.hstack([x, np.asarray(batch.column(target))[:, None]])
            total = joint.T @ joint if total is None else total + joint.T @ joint
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sum"])

    size = 2 + width + len(model.phases)
    joint = add_up(fitting.select(features, target).mapInArrow(normal, "part bigint, sum binary")).reshape(size, size)
    gram, cross = joint[:-1, :-1], joint[:-1, -1]
    model.weights = np.linalg.solve(gram + ridge * moments[0] * np.diag(np.append(0, np.ones(size - 2))) + 1e-9 * np.eye(size - 1), cross)

    def steps(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"step": pa.array(model.step(_matrix(batch.column(features))), pa.int64())}

    counted = add_in_arrow(rows.filter(F.col(part) == 1).select(features, target), "step bigint", steps)
    counts = counted.groupBy("step").agg(F.count("*").alias("n"), F.sum(target).alias("good")).collect()  # at most STEPS rows
    if not counts:
        return _even(rows, target)
    model.levels = isotonic({r.step: (r.n, r.good) for r in counts})
    return model


def _even(rows: DataFrame, target: str) -> Model:
    """Gives every text the mean label."""
    width = len(SHAPE_NAMES)
    model = Model(np.zeros(width), np.ones(width))
    model.weights = np.zeros(1 + width + len(model.phases))
    model.levels = np.full(STEPS, rows.agg(F.avg(target)).first()[0])
    return model


def isotonic(counts: dict[int, tuple[int, float]], steps: int = STEPS) -> np.ndarray:
    """Level of every step: the non-decreasing shares of good rows closest to those counted.

    Steps without rows lie between the levels around them.
    """
    blocks: list[list[float]] = []  # rows, good, last step
    for step in sorted(counts):
        n, good = counts[step]
        blocks.append([n, good, step, step])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, good, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + good, blocks[-1][2], last]
    places = [p for b in blocks for p in (b[2], b[3])]
    return np.interp(np.arange(steps), places, [b[1] / b[0] for b in blocks for _ in range(2)])


def score(df: DataFrame, model: Model | None, features: str = "features", out: str = "score") -> DataFrame:
    if model is None:
        return df.withColumn(out, F.lit(1.0))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {out: pa.array(model.score(_matrix(batch.column(features))))}

    return add_in_arrow(df, f"`{out}` double", run)


def score_texts(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """The same from the texts, without keeping the statistics."""
    if model is None:
        return df.withColumn(out, F.lit(1.0))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = [shape(t, rule_counts(t)) for t in (t or "" for t in batch.column(text).to_pylist())]
        return {out: pa.array(model.score(np.array(rows).reshape(-1, len(SHAPE_NAMES))))}

    return add_in_arrow(df, f"`{out}` double", run)


def remainder(key: str = "doc_id") -> Column:
    """crc32 of an id as text, modulo 4: 2 is held out, 3 calibrates, 0 and 1 fit."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4


def labelled(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``features``, ``target`` and ``part`` of the rows that may be learned from."""
    targets = labels.filter(F.col(label).isNotNull() & (remainder(key) != 2)).groupBy(key).agg(F.avg(label).alias("target"))
    return features.select(key, "features").join(targets, key).select("features", "target", F.when(remainder(key) == 3, 1).otherwise(0).alias("part"))
