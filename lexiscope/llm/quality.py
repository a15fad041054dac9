"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over the UTF-8 bytes of the whole text; their responses are max-pooled over
overlapping chunks (of two half-chunks, moving by one), and the mean and the maximum over the chunks go
through a logistic unit to one probability.  Filters are tables byte -> response per offset, learned by
gradient steps through the pooled maxima.

Training uses a bounded sample: of the ``sample`` labelled rows with the lowest hash of their id among those
whose crc32(id as text) mod ``folds`` is not 0, those whose text has at most ``longest`` bytes.  Scoring reads
whole texts of every row, in pieces of bounded size.  Labels, language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiscope.llm.runtime import by_value, own

by_value(__name__)

WIDTH, FILTERS, HALF_CHUNK = 6, 12, 128
#: Bytes that go through the filters at once.
PIECE = 1 << 18
SAMPLE, LONGEST, FOLDS, STEPS = 2000, 1 << 16, 5, 660
#: Documents that score less are rejected.
THRESHOLD = 0.3


def _flatten(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each zero-padded to whole half-chunks, and the number of half-chunks of each.
    WIDTH - 1 zeros before and after each text keep the filters from seeing two texts at once."""
    halves = np.array([-(-(len(t) + 2 * (WIDTH - 1)) // HALF_CHUNK) for t in texts], np.int64)
    flat = np.zeros(int(halves.sum()) * HALF_CHUNK + WIDTH, np.uint8)
    at = WIDTH - 1
    for t, n in zip(texts, halves.tolist()):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * HALF_CHUNK
    return flat, halves


class ByteConvNet:
    """Parameters and the forward pass; ``fit`` learns them."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.out_bias = np.float32(0)
        self.pairs = None

    def prepare(self) -> None:
        """Tables of responses to byte pairs, so that one lookup serves two offsets."""
        f = self.filters
        self.pairs = [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(1 << 16, FILTERS) for k in range(0, WIDTH, 2)]

    def half_maxima(self, flat: np.ndarray, where: bool = False):
        """Largest response of each filter in each half-chunk; with ``where``, its position too."""
        n = len(flat) - WIDTH
        best = np.empty((n // HALF_CHUNK, FILTERS), np.float32)
        spot = np.empty((n // HALF_CHUNK, FILTERS), np.int64) if where else None
        for at in range(0, n, PIECE):
            m = min(PIECE, n - at)
            b = flat[at : at + m + WIDTH].astype(np.int32)
            pair = b[:-1] << 8 | b[1:]
            total = np.take(self.pairs[0], pair[:m], axis=0)
            for k in range(1, WIDTH // 2):
                total += np.take(self.pairs[k], pair[2 * k : 2 * k + m], axis=0)
            part = total.reshape(-1, HALF_CHUNK, FILTERS)
            h = at // HALF_CHUNK
            if where:
                top = part.argmax(axis=1)
                spot[h : h + len(part)] = top + (np.arange(len(part)) * HALF_CHUNK + at)[:, None]
                best[h : h + len(part)] = np.take_along_axis(part, top[:, None, :], 1)[:, 0]
            else:
                best[h : h + len(part)] = part.max(axis=1)
        return best, spot

    def features(self, halves: np.ndarray, counts: np.ndarray):
        """Per text: mean and maximum over its overlapping chunks of the squashed pooled responses."""
        act = np.tanh(halves + self.bias)
        ends = np.cumsum(counts)
        starts = ends - counts
        nxt = np.arange(len(act)) + 1
        nxt[ends - 1] -= 1  # the last half-chunk of a text has no successor
        chunk = np.maximum(act, act[nxt])
        single = np.zeros(len(act), bool)
        single[ends - 1] = counts > 1  # with several half-chunks the last one starts no chunk
        chunk[single] = 0
        n_chunks = np.maximum(1, counts - 1)
        mean = np.add.reduceat(chunk, starts, axis=0) / n_chunks[:, None]
        top = np.maximum.reduceat(act, starts, axis=0)
        return np.concatenate([mean, top], axis=1), act, nxt, single, starts, n_chunks

    def scores(self, texts: list[bytes]) -> np.ndarray:
        flat, counts = _flatten(texts)
        best, _ = self.half_maxima(flat)
        x = self.features(best, counts)[0]
        return 1 / (1 + np.exp(-np.clip(x @ self.out + self.out_bias, -30, 30).astype(np.float64)))

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = 24, rate: float = 0.02, seed: int = 5) -> ByteConvNet:
        if not len(texts):
            return self
        rng = np.random.default_rng(seed)
        epochs = -(-steps // -(-len(texts) // batch))
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.filters, self.bias, self.out, np.zeros(1, np.float32))]
        share = min(max(float(labels.mean()), 0.02), 0.98)
        self.out_bias = np.float32(np.log(share / (1 - share)))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                self.prepare()
                flat, counts = _flatten([texts[i] for i in rows])
                best, spot = self.half_maxima(flat, where=True)
                x, act, nxt, single, starts, n_chunks = self.features(best, counts)
                p = 1 / (1 + np.exp(-np.clip(x @ self.out + self.out_bias, -30, 30)))
                g = ((p - labels[rows]) / len(rows)).astype(np.float32)
                g_out = x.T @ g + 1e-4 * self.out
                gx = g[:, None] * self.out[None, :]
                doc = np.repeat(np.arange(len(rows)), counts)
                g_chunk = (gx[:, :FILTERS] / n_chunks[:, None])[doc]
                g_chunk[single] = 0
                first = act >= act[nxt]
                g_act = np.where(first, g_chunk, 0)
                np.add.at(g_act, nxt, np.where(first, 0, g_chunk))
                is_top = act == x[:, FILTERS:][doc]
                ties = np.add.reduceat(is_top, starts, axis=0, dtype=np.float32)
                g_act += np.where(is_top, (gx[:, FILTERS:] / ties)[doc], 0)
                g_act *= 1 - act * act
                grad = np.zeros_like(self.filters)
                column = np.broadcast_to(np.arange(FILTERS), spot.shape)
                for k in range(WIDTH):
                    np.add.at(grad[k], (flat[spot + k], column), g_act)
                step += 1
                lr = rate * (1 - 0.7 * epoch / epochs)
                for i, (param, d) in enumerate(((self.filters, grad), (self.bias, g_act.sum(0)), (self.out, g_out), (np.array([self.out_bias]), np.array([g.sum()])))):
                    m, v = state[i]
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    delta = lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    if i == 3:
                        self.out_bias = np.float32(self.out_bias - delta[0])
                    else:
                        param -= delta.astype(np.float32)
        self.prepare()
        return self


def held_out(id_col: str, folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> ByteConvNet:
    """Fit on at most ``sample`` labelled rows of the training folds (see the module's docstring).

    Null labels and null ids are passed over; of several labels of one id the lowest counts, of several texts
    of one id any one.  Without labelled rows the network stays untrained and scores every text 0.5.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    drawn = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter(F.octet_length("text") <= longest)
    # At most ``sample`` ids are broadcast, and at most one row for each of them is collected.
    rows = narrow.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return ByteConvNet().fit([r["text"].encode("utf-8") for r in rows], np.array([r["quality"] for r in rows], np.float32))


def _scored(docs: DataFrame, labels: DataFrame, threshold: float, keep: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """The columns ``keep`` as ``_keep0``, ``_keep1`` and so on, with id, held_out, score and predicted, and the names
    of those four."""
    net = docs.sparkSession.sparkContext.broadcast(vars(train(docs, labels)))

    def run(batches):
        model = ByteConvNet()
        vars(model).update(net.value)
        model.prepare()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            scores, at = np.empty(len(texts)), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE):
                    size += len(texts[to])
                    to += 1
                scores[at:to] = model.scores(texts[at:to])
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], [*batch.schema.names[1:], score])

    # Arrow batches take plain names only, so a caller's columns go by number.
    kept = [c.alias(f"_keep{i}") for i, c in enumerate(keep)]
    data, ident, held, score, predicted = "_bytes", "doc_id", "held_out", "score", "predicted"
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(text.alias(data), F.col("doc_id").cast("long").alias(ident), held_out("doc_id").alias(held), *kept)
    schema = StructType([*narrow.schema.fields[1:], StructField(score, DoubleType())])
    scored = narrow.mapInArrow(run, schema).withColumn(predicted, (F.col(score) >= threshold).cast("int"))
    return scored, [ident, held, score, predicted]


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Null texts score as the empty text, which has a score too; a null id is never held out; repeated rows come
    out repeated; an empty table gives no rows; without labels every score is 0.5.  Other columns are not read.
    """
    scored, names = _scored(docs, labels, threshold, ())
    return scored.select(*names)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts 1, with their columns, whatever those are called."""
    scored, names = _scored(docs, labels, threshold, own(docs))
    return scored.filter(F.col(names[-1]) == 1).select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(docs.columns)))
