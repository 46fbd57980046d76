"""Document quality: random-indexing word vectors, pooled per document, and a small network with calibrated probabilities.

Words are cut into pieces (letters, digits, other signs), case kept, and hashed into `BUCKETS` rows. Each row has a sparse
random index vector of -1, 0 and 1; the context vector of a row is the sum of the index vectors of its neighbours within two
pieces, over all texts. Sums are whole numbers, so any order of tasks gives the same vectors. The table of vectors has a
fixed size whatever the input and is all that is broadcast. A text is pooled as mean and spread of its rows' vectors,
scaled to unit length and weighted by rarity. The network (one hidden layer) is trained on at most `max_train` labelled
documents, those with the smallest hashed ids; its temperature is fitted on a fifth of them that it was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.words import PIECES, SAME, mixed, slices, word_hashes

BUCKETS = 1 << 14
WIDTH = 32
NONZERO = 2
WINDOW = 2
HIDDEN = 32

_U = np.uint64


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each row's index vector."""
    draw = mixed(np.arange(BUCKETS * NONZERO, dtype=_U) + _U(77)).reshape(BUCKETS, NONZERO)
    places = (draw % _U(WIDTH // NONZERO)).astype(np.int64) + np.arange(NONZERO) * (WIDTH // NONZERO)
    return places, np.where(draw >> _U(40) & _U(1), 1.0, -1.0)


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = word_hashes(column, PIECES, SAME)
    return (hashes & _U(BUCKETS - 1)).astype(np.int64), first


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = _index_vectors()
    sums, counts = np.zeros(BUCKETS * WIDTH), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text", 1 << 19):
        rows, first = _buckets(batch.column(0))
        counts += np.bincount(rows, minlength=BUCKETS)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for step in range(1, WINDOW + 1):
            same = np.flatnonzero(owner[step:] == owner[:-step])
            left, right = rows[same], rows[same + step]
            for row, near in ((left, right), (right, left)):
                at = row * WIDTH
                for j in range(NONZERO):
                    sums += np.bincount(at + places[near, j], weights=signs[near, j], minlength=BUCKETS * WIDTH)
    used = np.flatnonzero(counts)
    table = sums.reshape(BUCKETS, WIDTH)[used].astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int64()), pa.array(counts[used], pa.int64()), *[pa.array(table[:, i], pa.int64()) for i in range(WIDTH)]],
        names=["bucket", "n", *[f"v{i}" for i in range(WIDTH)]],
    )


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of vectors (BUCKETS by WIDTH), unit length times rarity, from all texts."""
    names = [f"v{i}" for i in range(WIDTH)]
    parts = docs.select(F.col(text).alias("text")).mapInArrow(_contexts, "bucket bigint, n bigint, " + ", ".join(f"{v} bigint" for v in names))
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in names])
    got = sums.toArrow()  # at most BUCKETS rows
    table, counts = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS)
    at = got["bucket"].to_numpy()
    counts[at] = got["n"].to_numpy()
    table[at] = np.stack([got[v].to_numpy() for v in names], axis=1).reshape(-1, WIDTH)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    rarity = np.log1p(counts.sum() / np.maximum(counts, 1.0))
    return (table / np.maximum(length, 1e-9) * rarity[:, None]).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """For each text the mean and the root mean square of its rows' vectors, then log of its length; zeros without pieces."""
    rows, first = _buckets(column)
    count = np.diff(first)
    out = np.zeros((len(count), 2 * WIDTH + 1))
    start, most = 0, 1 << 15
    while start < len(count):
        end = max(start + 1, int(np.searchsorted(first, first[start] + most, "right")) - 1)
        for low in range(first[start], first[end], most):  # a long text in several parts
            part = rows[low : min(low + most, first[end])]
            full = start + np.flatnonzero(count[start:end])
            begin = np.clip(first[full] - low, 0, len(part))
            hit = (begin < len(part)) & (first[full + 1] > low)
            x = vectors[part]
            out[full[hit], :WIDTH] += np.add.reduceat(x, begin[hit], axis=0, dtype=np.float64)
            out[full[hit], WIDTH:-1] += np.add.reduceat(x * x, begin[hit], axis=0, dtype=np.float64)
        start = end
    out /= np.maximum(count, 1)[:, None]
    out[:, WIDTH:-1] = np.sqrt(out[:, WIDTH:-1])
    out[:, -1] = np.log1p(count)
    return out


@dataclass(frozen=True)
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 40) -> Network:
    """A two-layer network by Adam on four fifths of the rows; the temperature minimises the loss on the last fifth.

    With one class only, or no rows, every score is the smoothed share of label 1.
    """
    width = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    centre, scale = x[own].mean(0), x[own].std(0) + 1e-6
    z = (x - centre) / scale
    p = [draw.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        draw.shuffle(own)
        for i in range(0, len(own), 256):
            b = own[i : i + 256]
            h = np.maximum(z[b] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[b]) / len(b)
            back = d[:, None] * p[2] * (h > 0)
            grads = [z[b].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
            t += 1
            for q, g, a, s in zip(p, grads, m, v):
                a += 0.1 * (g - a)
                s += 0.001 * (g * g - s)
                q -= 0.003 * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    raw = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits = raw.logits(x[held])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    losses = [np.logaddexp(0, np.where(y[held] > 0, -logits, logits) / g).mean() for g in grid]
    return Network(centre, scale, p[0], p[1], p[2], float(p[3][0]), float(grid[int(np.argmin(losses))]))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, Network]:
    """(word vectors, network). Learns from labelled rows outside the held-out quarter only, at most `max_train` of them."""
    vectors = word_vectors(docs, text)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    marked = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label)).cast("int").alias("y"))
    sample = marked.orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            x = pooled(batch.column(2), shipped.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(features, f"id {kind}, y int, x array<double>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    x = np.array(got["x"].to_pylist(), float).reshape(-1, 2 * WIDTH + 1)
    return vectors, train(x, got["y"].to_numpy().astype(float))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` of every row of docs, and its score."""
    shipped = docs.sparkSession.sparkContext.broadcast((vectors, network))
    held = docs.select(F.col(text).alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shipped.value
        for batch in slices(batches, "__text", 1 << 19):
            found = network.scores(pooled(batch.column(0), vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.float64())], names=[*keep, name])

    return held.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Only the text decides a score: null and empty texts get the score of a text without pieces, repeated rows get equal
    scores. Null ids are scored and count as not held out; labels without id or value are ignored, of several labels of an id
    the largest holds. Without usable labels every score is the smoothed share of label 1, 0.5 for none at all. An empty
    table gives no rows; other columns are not looked at.
    """
    vectors, network = fit(docs, labels, max_train, doc_id, text)
    scored = score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), vectors, network, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
