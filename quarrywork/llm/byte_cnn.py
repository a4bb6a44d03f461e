"""Language of a text by a byte convolutional network, trained in NumPy.

A text is cut into windows of a fixed number of bytes. Bytes have a small embedding; filters of
several widths slide over a window, each keeps its maximum, and a softmax layer turns the maxima
into log-probabilities. A text's are the mean over all its windows, weighted by their bytes.

Training fits on the driver: of each language about ``DOCS`` labelled documents (chosen by a
hash of the key) give ``WINDOWS`` windows each, spread over the whole text. With so many languages that this would be more
than ``TRAINED`` documents, each gives fewer, but one at least; every label is learned. That bound, not the table, decides the size of what is collected. Prediction is one scan without an exchange; a filter is
applied through tables of its response to each pair of bytes at each offset.

Null texts and texts without a letter are ``und`` with score 0, as is every text if no label was
learned. The key, the label and other columns are never an input. Repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import in_batches, meet, passed, per_process, pieces_of_work, restored

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS, DIMS = 16, 8
#: Labelled documents of each language used for training (about), and windows of each.
DOCS, WINDOWS = 500, 4
#: Labelled documents of all languages together (about), as long as there are fewer languages.
TRAINED = 500_000
UNKNOWN = "und"
_PAD = 256
_REACH = max(WIDTHS)


def windows(text: bytes) -> np.ndarray:
    """All windows of the text, the last one padded."""
    raw = np.frombuffer(text, dtype=np.uint8)
    out = np.full(-(-len(raw) // LENGTH) * LENGTH, _PAD, dtype=np.int16)
    out[: len(raw)] = raw
    return out.reshape(-1, LENGTH)


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray  # 257 x DIMS, the padding's row is 0
    kernel: np.ndarray  # reach x DIMS x all filters; 0 beyond a filter's own width
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Response of every filter to every pair of bytes, at offsets 0, 2, ..."""
        single = [(self.embedding @ k).astype(np.float32) for k in self.kernel]
        single += [np.zeros_like(single[0])] * (_REACH % 2)
        return [(a[:, None] + b[None]).reshape(257 * 257, -1) for a, b in zip(single[::2], single[1::2])]

    def log_probabilities(self, rows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        rows = np.pad(rows.astype(np.int64), ((0, 0), (0, _REACH)), constant_values=_PAD)
        pairs = rows[:, :-1] * 257 + rows[:, 1:]
        response = np.take(tables[0], pairs[:, :LENGTH], axis=0)
        for j, table in enumerate(tables[1:], 1):
            response += np.take(table, pairs[:, 2 * j : 2 * j + LENGTH], axis=0)
        peaks = np.maximum(response.max(axis=1) + self.bias, 0)
        logits = peaks @ self.dense + self.offset
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def shares(self, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        """Probability of each label for every non-empty text: all windows of all texts, 64 at a time."""
        cut = [windows(t) for t in texts]
        every = np.concatenate(cut)
        weight = (every != _PAD).sum(axis=1)[:, None]
        found = np.concatenate([self.log_probabilities(every[lo : lo + 64], tables) for lo in range(0, len(every), 64)])
        first = np.cumsum([0, *[len(c) for c in cut[:-1]]])
        mean = np.add.reduceat(found * weight, first, axis=0) / np.add.reduceat(weight, first, axis=0)
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        return share / share.sum(axis=1, keepdims=True)


def new_network(labels: list[str], rng: np.random.Generator) -> Network:
    n = FILTERS * len(WIDTHS)
    embedding = rng.normal(0, 0.5, (257, DIMS))
    embedding[_PAD] = 0
    kernel = rng.normal(0, (_REACH * DIMS) ** -0.5, (_REACH, DIMS, n)) * reach_mask()
    return Network(labels, embedding, kernel, np.zeros(n), rng.normal(0, n**-0.5, (n, len(labels))), np.zeros(len(labels)))


def reach_mask() -> np.ndarray:
    return np.repeat(np.arange(_REACH)[:, None] < np.array(WIDTHS), FILTERS, axis=1)[:, None, :]


def train(rows: np.ndarray, labels: list[str], epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam on the cross entropy of windows ``rows`` (n x LENGTH)."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    target = np.searchsorted(names, labels)
    net = new_network(names, rng)
    parts = [net.embedding, net.kernel, net.bias, net.dense, net.offset]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    padded = np.pad(rows, ((0, 0), (0, _REACH - 1)), constant_values=_PAD)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            step += 1
            own = order[lo : lo + batch]
            grads = gradients(net, padded[own], target[own])
            for p, g, m, v in zip(parts, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def gradients(net: Network, rows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    response = sum((net.embedding @ net.kernel[j])[rows[:, j : j + LENGTH]] for j in range(_REACH))
    at = response.argmax(axis=1)  # rows x filters
    peak = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + net.bias
    hidden = np.maximum(peak, 0)
    logits = hidden @ net.dense + net.offset
    share = np.exp(logits - logits.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    share[np.arange(len(rows)), target] -= 1
    share /= len(rows)
    back = (share @ net.dense.T) * (peak > 0)
    seen = np.take_along_axis(rows[:, :, None], (at[:, None] + np.arange(_REACH)[None, :, None]), axis=1)  # rows x reach x filters
    vectors = net.embedding[seen]  # rows x reach x filters x dims
    d_kernel = np.einsum("nf,nrfd->rdf", back, vectors) * reach_mask()
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, seen, np.einsum("nf,rdf->nrfd", back, net.kernel))
    d_embedding[_PAD] = 0
    return [d_embedding, d_kernel, back.sum(axis=0), hidden.T @ share, share.sum(axis=0)]


def sample_windows(docs: DataFrame, usable: Column, key: str, text: str, label: str) -> tuple[np.ndarray, list[str]]:
    """Training windows and their labels: about ``DOCS`` documents of each label, ``WINDOWS`` of each."""
    rows = docs.filter(usable & F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit("sample")).alias("h"))
    counts = materialize(rows.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("first")), "label-counts")
    n_labels = counts.count()
    if not n_labels:
        return np.zeros((0, LENGTH), dtype=np.int16), []
    share = F.least(F.lit(1.0), F.lit(max(1, min(DOCS, TRAINED // n_labels))) / F.col("n"))
    # of a label with few rows the first by hash is there in any case; texts are not exchanged while the labels fit a broadcast
    labelled = meet(rows, counts, ["label"], "inner", n_labels, ["h"])
    chosen = labelled.filter(((F.col("h") / F.lit(2.0**64) + 0.5) < share) | (F.col("h") == F.col("first")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for name, body in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                every = windows(body.encode())
                for k in np.unique(np.linspace(0, len(every) - 1, WINDOWS).astype(int)) if len(every) else ():
                    names.append(name)
                    found.append(every[k].astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], names=["label", "window"])

    got = sorted((r["label"], bytes(r["window"])) for r in in_batches(chosen.select("label", "text"), cut, "label string, window binary").collect())
    return np.array([np.frombuffer(w, "<i2") for _, w in got], dtype=np.int16).reshape(-1, LENGTH), [name for name, _ in got]


def learn(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "lang") -> Network | None:
    rows, labels = sample_windows(docs, usable, key, text, label)
    return train(rows, labels) if labels else None


def predict(docs: DataFrame, network: Network | None, columns: dict[str, Column], text: str = "text") -> DataFrame:
    """The given columns, lang_pred and score of the whole text."""
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], F.col(text).alias("__text"))
    names = list(columns)
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = per_process(("letter",), lambda: regex.compile(r"\p{L}"))
        tables = network.tables() if network else []
        for batch in pieces_of_work(batches, "__text"):
            bodies = batch.column("__text").to_pylist()
            found, scores = [UNKNOWN] * len(bodies), [0.0] * len(bodies)
            told = [k for k, body in enumerate(bodies) if network and body is not None and letter.search(body)]
            if told:
                share = network.shares([bodies[k].encode() for k in told], tables)
                for k, best, p in zip(told, share.argmax(axis=1).tolist(), share.max(axis=1).tolist()):
                    found[k], scores[k] = network.labels[best], p
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"]
            )

    return in_batches(rows, run, f"{schema}, lang_pred string, score double")


def keep_known(docs: DataFrame, network: Network | None, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more, with all their columns.

    Without a network (no label was learned) only null texts and texts without a letter are rejected.
    """
    if network is None:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    told = predict(docs, network, passed(docs), text)
    return restored(told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs.columns)
