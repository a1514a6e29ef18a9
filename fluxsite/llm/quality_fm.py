"""Quality classifier: a factorisation machine over sparse features.

A document's features are its hashed words, binned statistics of its structure
and its metadata. The model adds to the linear score low-rank interactions of
all pairs, summed in linear time by the identity

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted on a sample of at most ``max_rows`` labelled rows (those of
smallest hash): each round, every shard of the sample goes on from the current
parameters with AdaGrad, and the driver averages the shards' parameters (their
size is fixed by ``Shape``). Every document is scored over its whole text.

Defined cases: a NULL or empty text is scored from its statistics (all zero);
a NULL ``n_chars`` (or none in the table) is a feature value of its own; NULL
labels teach nothing; without any label of both kinds each score is 0.5;
repeated rows get equal scores; an empty table gives an empty result; other
columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow_text import text_bytes
from .common import column, text_or_empty, work_table

BINS = 16  # slots per binned value


@dataclass(frozen=True)
class Shape:
    """Size of the model and of its fit; nothing here depends on the input."""

    word_buckets: int = 1 << 13
    rank: int = 8
    max_rows: int = 12_000  # labelled rows that the fit sees at most
    shards: int = 8
    rounds: int = 3
    epochs: int = 2  # passes over a shard in each round
    rate: float = 0.1
    l2: float = 1e-5
    seed: int = 7

    @property
    def size(self) -> int:
        return self.word_buckets + BINS * N_VALUES


# -- features --------------------------------------------------------------
# Upper ends of the bins of a share (the first bin is exactly zero).
SHARE_BINS = [0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95]
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = b"0123456789"
STOPS = b".,;:?"
SYMBOLS = bytes(c for c in range(33, 127) if bytes([c]) not in (b".", b",", b";", b":", b"?", b"!", b"|", b"'", b'"', b"-", b"(", b")")
                and not chr(c).isalnum())


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(math.log2(1 + max(0.0, x))))


def structure(raw: bytes, words: list[bytes], counts: Counter) -> list[tuple[str, float]]:
    """Named statistics of a text: sizes (binned by logarithm) and shares."""
    n, size = max(1, len(words)), max(1, len(raw))
    count = lambda chars: size_of - len(raw.translate(None, chars))
    size_of = len(raw)
    lines = raw.split(b"\n")
    letters = max(1, count(LETTERS))
    return [
        ("words", len(words)), ("lines", len(lines)), ("length", 4 * size / n),
        ("distinct", len(counts) / n), ("repeats", sum(map(eq, words, words[1:])) / n),
        ("top", max(counts.values(), default=0) / n), ("same_lines", 1 - len(set(lines)) / len(lines)),
        ("symbols", count(SYMBOLS) / size), ("bars", raw.count(b"|") / n), ("marks", raw.count(b"!") / n),
        ("stops", count(STOPS) / n), ("digits", count(DIGITS) / size), ("upper", count(UPPER) / letters),
        ("wide", sum(map(raw.count, (b"\xc3", b"\xe2"))) / size),
    ]


SIZES = ("words", "lines", "length")
N_VALUES = 14 + 2  # statistics, then metadata: declared length and whether it is right


def features(raw: bytes, declared: int | None, chars: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a document; no index twice."""
    words = raw.split()
    counts = Counter(words)
    hashed: dict[int, int] = {}
    for word, k in Counter(map(bytes.lower, words)).items():
        at = zlib.crc32(word) % buckets
        hashed[at] = hashed.get(at, 0) + k
    value = np.sqrt(np.fromiter(hashed.values(), np.float32, len(hashed)))
    value /= max(1e-6, float(np.sqrt((value**2).sum())))
    slots = [
        _log_bin(x) if name in SIZES else int(np.searchsorted(SHARE_BINS, x, side="left"))
        for name, x in structure(raw, words, counts)
    ]
    slots.append(BINS - 1 if declared is None else _log_bin(declared))
    slots.append(2 if declared is None else int(declared != chars))
    stats = buckets + BINS * np.arange(N_VALUES) + np.array(slots)
    index = np.concatenate([np.fromiter(hashed.keys(), np.int32, len(hashed)), stats.astype(np.int32)])
    return index, np.concatenate([value, np.full(N_VALUES, 0.5, np.float32)])


def _feature_rows(batch: pa.RecordBatch, buckets: int):
    data, offsets = text_bytes(batch.column("text"))
    raw, chars = data.tobytes(), batch.column("chars").to_pylist()
    for k, declared in enumerate(batch.column("declared").to_pylist()):
        yield features(raw[offsets[k] : offsets[k + 1]], declared, chars[k], buckets)


# -- the machine -----------------------------------------------------------
class Machine:
    def __init__(self, shape: Shape):
        rng = np.random.default_rng(shape.seed)
        self.bias = 0.0
        self.linear = np.zeros(shape.size, np.float32)
        self.factors = rng.normal(0, 0.05, (shape.size, shape.rank)).astype(np.float32)

    def raw_score(self, index: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray]:
        """Score before the sigmoid, and the sums over the features that its gradient uses."""
        v = self.factors[index]
        sums = value @ v
        pairs = 0.5 * float((sums**2).sum() - ((value**2) @ (v**2)).sum())
        return self.bias + float(self.linear[index] @ value) + pairs, sums

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return sigmoid(self.raw_score(index, value)[0])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], shape: Shape, seed: int) -> None:
        """AdaGrad on the logistic loss, row by row in a seeded order."""
        square_l, square_f, square_b = np.full_like(self.linear, 1e-2), np.full_like(self.factors, 1e-2), 1e-2
        rng = np.random.default_rng(seed)
        for _ in range(shape.epochs):
            for k in rng.permutation(len(rows)):
                index, value, label = rows[k]
                raw, sums = self.raw_score(index, value)
                slope = sigmoid(raw) - label
                g = slope * value + shape.l2 * self.linear[index]
                square_l[index] += g * g
                self.linear[index] -= shape.rate * g / np.sqrt(square_l[index])
                v = self.factors[index]
                g = slope * (value[:, None] * sums[None, :] - (value**2)[:, None] * v) + shape.l2 * v
                square_f[index] += g * g
                self.factors[index] = v - shape.rate * g / np.sqrt(square_f[index])
                square_b += slope * slope
                self.bias -= shape.rate * slope / math.sqrt(square_b)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else 1 - 1 / (1 + math.exp(min(x, 700)))


def average(machines: list[Machine], weights: list[int]) -> Machine:
    out, total = machines[0], float(sum(weights))
    out.bias = sum(m.bias * w for m, w in zip(machines, weights, strict=True)) / total
    out.linear = (sum(m.linear.astype(np.float64) * w for m, w in zip(machines, weights, strict=True)) / total).astype(np.float32)
    out.factors = (sum(m.factors.astype(np.float64) * w for m, w in zip(machines, weights, strict=True)) / total).astype(np.float32)
    return out


# -- Spark -----------------------------------------------------------------
def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _inputs(docs: DataFrame) -> DataFrame:
    declared = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    text = text_or_empty(F.col("text"))
    return docs.select("doc_id", text.alias("text"), F.length(text).alias("chars"), declared.alias("declared"))


def sample(docs: DataFrame, labels: DataFrame, shape: Shape) -> DataFrame:
    """(shard, index, value, label) of at most ``max_rows`` labelled rows.

    The labels that are chosen number at most ``max_rows``, so they may be
    broadcast: the texts do not move."""
    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    named = named.groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").cast("int").alias("label"))
    order = F.xxhash64(F.col("of"), F.lit(shape.seed))
    named = work_table(named.orderBy(order, "of").limit(shape.max_rows), "labels")
    rows = _inputs(docs).join(F.broadcast(named), F.col("doc_id") == F.col("of"))

    def run(batches):
        for batch in batches:
            found = list(_feature_rows(batch, shape.word_buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array([zlib.crc32(i.tobytes() + x.tobytes()) for i, x in found], pa.int64()), pa.array([i for i, _ in found], pa.list_(pa.int32())),
                 pa.array([x for _, x in found], pa.list_(pa.float32())), batch.column("label")], ["key", "index", "value", "label"])

    found = rows.select("text", "chars", "declared", "label").mapInArrow(run, "key long, index array<int>, value array<float>, label int")
    # repeated doc_ids may give more rows than there are labels: the bound holds on rows
    found = work_table(found, "features").orderBy("key", "label").limit(shape.max_rows)
    return work_table(found.withColumn("shard", F.pmod("key", F.lit(shape.shards))), "sample")


def _fit_shard(start, shape: Shape, k: int):
    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([("key", "ascending"), ("label", "ascending")])
        columns = [part[c].to_pylist() for c in ("index", "value", "label")]
        rows = [(np.array(i, np.int64), np.array(x, np.float32), y) for i, x, y in zip(*columns, strict=True)]
        own = pickle.loads(pickle.dumps(start.value))
        own.fit(rows, shape, shape.seed + 1000 * k + key[0].as_py())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "model": [pickle.dumps(own)]})

    return run


def train(docs: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> Machine:
    spark = docs.sparkSession
    rows, machine = sample(docs, labels, shape), Machine(shape)
    if rows.agg(F.countDistinct("label")).first()[0] < 2:
        machine.factors[:] = 0  # nothing to tell apart: 0.5 for every row
        return machine
    for k in range(shape.rounds):
        start = spark.sparkContext.broadcast(machine)
        done = rows.groupBy("shard").applyInArrow(_fit_shard(start, shape, k), "shard long, n long, model binary").collect()
        done.sort(key=lambda r: r.shard)
        machine = average([pickle.loads(r.model) for r in done], [r.n for r in done])
    return machine


def score(docs: DataFrame, machine: Machine, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, score): likelihood of label 1, for every row."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            scores = [model.value.score(i, x) for i, x in _feature_rows(batch, shape.word_buckets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return _inputs(docs).mapInArrow(run, f"doc_id {key}, score double")


def keep_good(docs: DataFrame, machine: Machine, shape: Shape = Shape(), least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored ``least`` or more, same columns; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns
    rows = docs.select(
        F.struct(*[column(c) for c in names]).alias("row"), text_or_empty(F.col("text")).alias("text"),
        F.length(text_or_empty(F.col("text"))).alias("chars"),
        (F.col("n_chars").cast("long") if "n_chars" in names else F.lit(None).cast("long")).alias("declared"),
    )

    def run(batches):
        for batch in batches:
            keep = [model.value.score(i, x) >= least for i, x in _feature_rows(batch, shape.word_buckets)]
            row = batch.column("row").filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([row], ["row"])

    out = rows.mapInArrow(run, StructType([rows.schema["row"]]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names])
