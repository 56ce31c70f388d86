"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Every passage of the whole text is
encoded (hashed byte pairs and word statistics, then one tanh layer), a gated
attention network weighs the passages, and the weighted sum is scored.  Only
document labels are learned from; weights of passages follow from them.

The model is fitted on the driver with at most ``max_train`` labelled documents,
drawn by a hash of their ids; scoring reads every document.  Labels, language,
source and id are no inputs of a score.

Defined results: a null or empty text is one passage without words and gets a
score like any other; very long texts are scored whole; repeated rows score
alike; without labels of both kinds every score is the share of label 1 (0.5
without labels); an empty table gives an empty result; ``keep_good`` returns
other columns untouched whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.caching import owned
from tessera.llm.textscan import Words, blocks, mix64
from tessera.llm.textstats import _SYMBOL, _sums

PASSAGE_WORDS = 64
PAIRS = 256
EXTRAS = 7
WIDTH = PAIRS + EXTRAS
PREDICT_FROM = 0.7

_PAIR_SLOT = (mix64(np.arange(65536, dtype=np.uint64) + np.uint64(7)) % np.uint64(PAIRS)).astype(np.int64)


def encode_passages(column: pa.Array):
    """Yield (bags, features) per block: passages of each text and a row of each passage."""
    for _, raw, offs in blocks(column):
        w = Words(raw, offs)
        n_docs, n_words = len(w.counts), len(w.starts)
        bags = np.maximum(1, -(-w.counts // PASSAGE_WORDS))
        base = np.concatenate(([0], np.cumsum(bags)))
        x = np.zeros((int(base[-1]), WIDTH), np.float32)
        if n_words:
            doc = np.repeat(np.arange(n_docs), w.counts)
            bag = base[doc] + (np.arange(n_words) - w.first[doc]) // PASSAGE_WORDS
            sizes = np.bincount(bag, minlength=len(x))
            # bytes belong to the passage of the word before them
            lengths = np.diff(np.append(w.starts, len(raw)))
            byte_bag = np.repeat(bag, lengths)
            body = raw[w.starts[0] :]
            pair = _PAIR_SLOT[body[:-1].astype(np.int64) * 256 + body[1:]]
            # white space ahead of a text's first word belongs to no passage
            ahead = np.zeros(len(raw) + 1, np.int8)
            till = np.where(w.counts > 0, w.starts[np.minimum(w.first[:-1], n_words - 1)], offs[1:])
            np.add.at(ahead, offs[:-1], 1)
            np.add.at(ahead, till, -1)
            own = np.cumsum(ahead[:-1], dtype=np.int8)[w.starts[0] :] == 0
            inside = (byte_bag[:-1] == byte_bag[1:]) & own[:-1] & own[1:]
            counts = np.bincount(byte_bag[:-1][inside] * PAIRS + pair[inside], minlength=len(x) * PAIRS).reshape(-1, PAIRS)
            x[:, :PAIRS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
            hashes = w.hashes(fold_case=False)
            per = np.maximum(sizes, 1)
            total = lambda mask: np.bincount(bag, weights=mask, minlength=len(x))
            seen = np.unique(hashes ^ mix64(bag.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
            distinct = np.bincount(bag[seen], minlength=len(x))
            echo = np.zeros(n_words)
            echo[1:] = (hashes[1:] == hashes[:-1]) & (bag[1:] == bag[:-1])
            solid = np.add.reduceat(w.solid & ((raw & 0xC0) != 0x80), w.starts, dtype=np.int64)
            upper = np.add.reduceat((raw >= 65) & (raw <= 90), w.starts, dtype=np.int64)
            lower = np.add.reduceat((raw >= 97) & (raw <= 122), w.starts, dtype=np.int64)
            symbols = np.add.reduceat(_SYMBOL[raw], w.starts, dtype=np.int64)
            x[:, PAIRS:] = np.stack(
                [distinct / per, total(echo) / per, total(solid) / per / 8, total((upper >= 2) & (lower == 0)) / per, total(symbols > 0) / per, sizes / PASSAGE_WORDS, total(w.starts * 0 + (raw[w.starts] < 65)) / per], axis=1
            )
        yield bags, x


class AttentionModel:
    """Encoder, gated attention and scorer; all weights are small arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def constant(cls, share: float) -> "AttentionModel":
        return cls({"share": np.float64(share)})

    @classmethod
    def start(cls, seed: int = 7, hidden: int = 32, gate: int = 16) -> "AttentionModel":
        rng = np.random.default_rng(seed)
        shape = {"W": (WIDTH, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,), "c": (hidden,), "d": ()}
        return cls({k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if s and k != "b" else np.zeros(s)).astype(np.float32) for k, s in shape.items()})

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        first = np.concatenate(([0], np.cumsum(bags)[:-1]))
        doc = np.repeat(np.arange(len(bags)), bags)
        h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        att = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(att[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return p, (first, doc, h, t, g, att, z)

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if "share" in self.weights:
            return np.full(len(bags), float(self.weights["share"]))
        return self.forward(x, bags)[0].astype(np.float64) if len(bags) else np.zeros(0)

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        p, (first, doc, h, t, g, att, z) = self.forward(x, bags)
        dl = ((p - y) / len(y)).astype(np.float32)
        out = {"c": z.T @ dl, "d": dl.sum()}
        dz = dl[:, None] * w["c"]
        dh = att[:, None] * dz[doc]
        da = (h * dz[doc]).sum(axis=1)
        de = att * (da - np.add.reduceat(att * da, first)[doc])
        out["a"] = (t * g).T @ de
        du = de[:, None] * w["a"]
        dt, dg = du * g * (1 - t * t), du * t * g * (1 - g)
        out["V"], out["U"] = h.T @ dt, h.T @ dg
        dh += dt @ w["V"].T + dg @ w["U"].T
        dh *= 1 - h * h
        out["W"], out["b"] = ((x - w["mean"]) / w["scale"]).T @ dh, dh.sum(axis=0)
        return out

    @classmethod
    def fit(cls, bags: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 2e-3, decay: float = 1e-4, seed: int = 7) -> "AttentionModel":
        """Adam on the log loss of document labels; deterministic for a seed."""
        if not len(y) or y.min() == y.max():
            return cls.constant(float(y.mean()) if len(y) else 0.5)
        model = cls.start(seed)
        w = model.weights
        w["mean"], w["scale"] = x.mean(axis=0), x.std(axis=0) + np.float32(0.01)
        first = np.concatenate(([0], np.cumsum(bags)))
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in w.items()}
        m2 = {k: np.zeros_like(v) for k, v in w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
                step += 1
                for k, grad in model.gradients(x[rows], bags[pick], y[pick]).items():
                    grad = grad + (decay * w[k] if k in "WVU" else 0)
                    m1[k] = 0.9 * m1[k] + 0.1 * grad
                    m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                    w[k] = (w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return model


def _remainder(id_column) -> "F.Column":
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(4))


def held_out(id_column: str = "doc_id"):
    """True for ids whose labels are never learned from; a null id is held out too."""
    return F.coalesce(_remainder(id_column) == 2, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = 4000, id_column: str = "doc_id", text_column: str = "text") -> AttentionModel:
    """Fit on at most ``max_train`` labelled documents outside the held-out fold."""
    usable = labels.filter(F.col("quality").isNotNull() & ~held_out(id_column)).groupBy(id_column).agg(F.max("quality").alias("quality"))
    sample = usable.orderBy(F.md5(F.col(id_column).cast("string")), id_column).limit(max_train)
    sample = sample.select(F.col(id_column).alias("train_id"), F.col("quality").cast("double").alias("train_label"))
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("train_id"))

    def run(batches):
        owned("quality")
        for batch in batches:
            bags, rows = [], []
            for b, x in encode_passages(batch.column(1)):
                bags.append(b)
                ends = np.cumsum(b)
                rows += [part.astype(np.float16).tobytes() for part in np.split(x, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["doc_id", "label", "bag"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = picked.select("doc_id", "text", "train_label").mapInArrow(run, f"doc_id {kind}, label double, bag binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["bag"]))
    if not found:
        return AttentionModel.constant(0.5)
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH) for r in found]
    y = np.array([r["label"] for r in found], np.float32)
    return AttentionModel.fit(np.array([len(b) for b in bags]), np.concatenate(bags).astype(np.float32), y)


def _scores(column: pa.Array, model: AttentionModel) -> np.ndarray:
    found = [model.score(x, bags) for bags, x in encode_passages(column)]
    return np.concatenate(found) if found else np.zeros(0)


def score_quality(docs: DataFrame, model: AttentionModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches):
        owned("quality")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), model), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    scored = docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AttentionModel, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with a predicted label of 1, with all their columns."""
    at = docs.columns.index(text_column)

    def run(batches):
        owned("quality")
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), model) >= PREDICT_FROM))

    return docs.mapInArrow(run, docs.schema)
