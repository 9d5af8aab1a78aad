"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

With features x, weights w and factors V the score is
w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i V_if x_i)^2 - sum_i V_if^2 x_i^2 ],
which gives all pairwise interactions in time linear in the features.  Features of a
whole text: log-scaled frequencies of hashed words (unit length), standardised structure
statistics, and its size as metadata.  Labels, language, source and id are never inputs.

It is fitted on a bounded sample of labelled rows (MAX_TRAINING_ROWS, those with the
smallest hash of their id); scoring reads every text.  The fitted model has a fixed size
and is what the tasks receive.

Defined results: null and empty texts are scored from an empty word set.  Null labels
are ignored; a document labelled more than once counts by its largest label, and of
different texts under one labelled id one is learned, the same in every run.  With no
labels, or one label only, every score is the share of that label.  Repeated documents
are scored once each.  Extra columns are carried through by `score`; an input column
named like the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import crc_bucket, slices, string_buffers, word_spans

BUCKETS, FACTORS, EPOCHS, BATCH, MIN_STEPS = 1 << 16, 8, 12, 512, 250
#: Step size, and how much factors and weights shrink a step: interactions have to show again and again.
RATE, SHRINK = 0.02, (1.0, 0.05)
MAX_TRAINING_ROWS = 12_000
THRESHOLD = 0.7

_CLASSES = {"upper": [range(65, 91)], "digit": [range(48, 58)], "bar": [[124]], "mark": [[33, 63]], "symbol": [[35, 36, 37, 38, 64, 42, 60, 62, 123, 125, 91, 93, 61, 95, 92, 126, 94]], "stop": [[46, 44, 59, 58]], "line": [[10]], "wide": [range(128, 256)]}
_TABLE = np.zeros((len(_CLASSES), 256), np.int64)
for _i, _sets in enumerate(_CLASSES.values()):
    for _s in _sets:
        _TABLE[_i, list(_s)] = 1
STATISTICS = [*_CLASSES, "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "repeated_pairs", "distinct_lines", "top_word"]


def features(column: pa.Array):
    """Per text: (buckets, values, statistics)."""
    offsets, data = string_buffers(column)
    for i, j in slices(offsets):
        part, here = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        words, _, lengths, at = word_spans(part, here)
        counted = np.zeros((len(_CLASSES), len(here) + 1), np.int32)
        for k in range(len(_CLASSES)):
            np.cumsum(_TABLE[k][here], out=counted[k, 1:])
        classes = counted[:, part[1:]] - counted[:, part[:-1]]
        for d in range(j - i):
            own, n = words[at[d] : at[d + 1]], int(at[d + 1] - at[d])
            size = int(part[d + 1] - part[d])
            stats = np.zeros(len(STATISTICS))
            if n == 0:
                stats[len(_CLASSES)] = np.log1p(size)
                yield np.zeros(0, np.int64), np.zeros(0), stats
                continue
            distinct, counts = np.unique(own, return_counts=True)
            pairs = own[:-1] * np.uint64(31) + own[1:]
            lines = here[part[d] : part[d + 1]].tobytes().split(b"\n")
            sizes = lengths[at[d] : at[d + 1]]
            stats[: len(_CLASSES)] = classes[:, d] / size
            stats[len(_CLASSES) :] = np.log1p(size), np.log1p(n), sizes.mean(), np.log1p(sizes.max()), len(distinct) / n, 1 - len(np.unique(pairs)) / max(1, n - 1), len(set(lines)) / len(lines), counts.max() / n
            values = np.log1p(counts)
            yield (distinct >> np.uint64(48)).astype(np.int64), values / np.linalg.norm(values), stats


@dataclass
class FactorisationMachine:
    mean: np.ndarray
    spread: np.ndarray
    bias: float
    weights: np.ndarray  # buckets, then statistics
    factors: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4) / 4

    def logits(self, rows: list[tuple]) -> np.ndarray:
        index, value, starts = _flat(rows, self)
        v = self.factors[index] * value[:, None]
        total, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + 0.5 * (total**2 - squares).sum(axis=1)


def _flat(rows, model):
    """Feature indices, values and the first feature of each row; every row has the statistics."""
    index, value, sizes, last = [], [], [], BUCKETS + np.arange(len(STATISTICS))
    for buckets, values, stats in rows:
        index += [buckets, last]
        value += [values, model.dense(stats)]
        sizes.append(len(buckets) + len(last))
    return np.concatenate(index), np.concatenate(value), np.concatenate(([0], np.cumsum(sizes[:-1]))).astype(np.int64)


def fit(rows: list[tuple], labels: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """Adam on the log loss, in a fixed order."""
    stats = np.stack([r[2] for r in rows]) if rows else np.zeros((1, len(STATISTICS)))
    n = BUCKETS + len(STATISTICS)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6), float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, 0.02, (n, FACTORS)))
    if len(set(labels.tolist())) < 2:
        model.factors[:] = 0
        return model
    state = [np.zeros((n, FACTORS + 1)), np.zeros((n, FACTORS + 1))]
    step = 0
    for _ in range(max(EPOCHS, MIN_STEPS // max(1, -(-len(rows) // BATCH)))):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            take = order[a : a + BATCH]
            index, value, starts = _flat([rows[k] for k in take], model)
            sizes = np.diff(np.append(starts, len(index)))
            v = model.factors[index] * value[:, None]
            total, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
            logit = model.bias + np.add.reduceat(model.weights[index] * value, starts) + 0.5 * (total**2 - squares).sum(axis=1)
            error = (1 / (1 + np.exp(-logit)) - labels[take]) / len(take)
            by = np.repeat(error, sizes) * value
            grad = np.empty((n, FACTORS + 1))
            grad[:, FACTORS] = np.bincount(index, by, n)
            own = by[:, None] * (np.repeat(total, sizes, axis=0) - v)
            for f in range(FACTORS):
                grad[:, f] = np.bincount(index, own[:, f], n)
            step += 1
            state[0] += 0.1 * (grad - state[0])
            state[1] += 0.001 * (grad * grad - state[1])
            move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
            model.factors -= move[:, :FACTORS] + RATE * SHRINK[0] * model.factors
            model.weights -= move[:, FACTORS] + RATE * SHRINK[1] * model.weights
            model.bias -= RATE * float(error.sum())
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", max_rows: int = MAX_TRAINING_ROWS) -> FactorisationMachine:
    """Fit on at most `max_rows` labelled documents; `labels` has doc_id and label."""
    chosen = labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").select("doc_id", text, "label")

    def run(batches):
        for batch in batches:
            got = list(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([b.astype(np.uint16).tobytes() for b, _, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v, _ in got], pa.binary()), pa.array([s.tolist() for _, _, s in got], pa.list_(pa.float64()))], names=["doc_id", "label", "buckets", "values", "stats"])

    table = rows.mapInArrow(run, "doc_id bigint, label int, buckets binary, values binary, stats array<double>").toPandas()
    table = table.sort_values(["doc_id", "buckets", "values"]).drop_duplicates("doc_id")
    got = [(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(v, np.float32).astype(float), np.array(s)) for b, v, s in zip(table["buckets"], table["values"], table["stats"])]
    return fit(got, table["label"].to_numpy().astype(float))


def score(df: DataFrame, model: FactorisationMachine, text: str = "text", result: str = "score") -> DataFrame:
    kept = [f for f in df.schema.fields if f.name != result]
    schema = T.StructType([*kept, T.StructField(result, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column, out, rows = batch.column(batch.schema.get_field_index(text)), [], []
            for row in features(column):
                rows.append(row)
                if len(rows) == 256:
                    out.append(shared.value.logits(rows))
                    rows = []
            out += [shared.value.logits(rows)] if rows else []
            logits = np.concatenate(out) if out else np.zeros(0)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(logits, -50, 50))))], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out(column="doc_id"):
    return F.coalesce(crc_bucket(F.col(column), 4) == 2, F.lit(False))
