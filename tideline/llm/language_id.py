"""Operator 3: language identification with a byte convolutional network.

Byte embeddings, filters of several widths, max pooling over a fixed-length
window, softmax; trained in numpy on windows of a bounded sample of labelled
texts (``per_lang`` rows per language).  A text's prediction averages the
class logits of all its windows, so the whole text counts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import hash_share, is_held_out, table, text_batches

WINDOW = 256          # bytes per window
WIDTHS = (2, 3, 4, 5)  # filter widths in bytes
FILTERS = 8           # filters of each width
EMBED = 8
PER_LANG = 1200       # bound of the training sample: rows of each language
CHUNK = 256           # windows per matrix product
UNKNOWN = "und"


@dataclass
class ConvNet:
    """Weights. ``filters`` holds all widths as one matrix over the widest window, short ones zero-padded."""

    langs: list[str]
    embed: np.ndarray      # 257 x EMBED; row 256 is padding
    filters: np.ndarray    # max width * EMBED x filters
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        wide = max(WIDTHS)
        m = np.zeros((wide * EMBED, FILTERS * len(WIDTHS)), dtype=np.float32)
        for i, w in enumerate(WIDTHS):
            m[: w * EMBED, i * FILTERS:(i + 1) * FILTERS] = 1
        return m

    def patches(self, x: np.ndarray) -> np.ndarray:
        """Windows of bytes (n, WINDOW) -> all widest patches (n, WINDOW, max width * EMBED)."""
        wide = max(WIDTHS)
        padded = np.concatenate([x, np.full((len(x), wide - 1), 256, dtype=x.dtype)], axis=1)
        e = self.embed[padded]
        v = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), wide * EMBED, axis=1)
        return v[:, ::EMBED]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        p = np.ascontiguousarray(self.patches(x)).reshape(-1, self.filters.shape[0])
        conv = (p @ self.filters).reshape(len(x), x.shape[1], -1)
        return np.maximum(conv.max(axis=1) + self.bias, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self.pooled(x[i:i + CHUNK]) @ self.dense + self.dense_bias for i in range(0, len(x), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), dtype=np.float32)


def windows_of(data: bytes) -> np.ndarray:
    """All of ``data`` as rows of WINDOW byte codes, the last one padded with 256."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, 256, dtype=np.int16)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def train(texts: list[str], langs: list[str], epochs: int = 10, batch: int = 64, seed: int = 3) -> ConvNet:
    """Adam on cross-entropy over one window of every text; deterministic."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    mask = ConvNet.mask()
    k, f, c = mask.shape[0], mask.shape[1], max(len(names), 1)
    net = ConvNet(names, rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
                  rng.normal(0, 0.3, (k, f)).astype(np.float32) * mask, np.zeros(f, dtype=np.float32),
                  rng.normal(0, 0.3, (f, c)).astype(np.float32), np.zeros(c, dtype=np.float32))
    net.embed[256] = 0
    if len(names) < 2:
        return net
    x = np.concatenate([windows_of(t.encode()[:WINDOW]) for t in texts])
    y = np.array([names.index(v) for v in langs])
    params = [net.embed, net.filters, net.bias, net.dense, net.dense_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            step += 1
            xb, yb = x[order[i:i + batch]], y[order[i:i + batch]]
            n, rows = len(xb), np.arange(len(xb))[:, None]
            patches = np.ascontiguousarray(net.patches(xb))
            conv = (patches.reshape(-1, k) @ net.filters).reshape(n, WINDOW, f)
            at = conv.argmax(axis=1)
            top = np.take_along_axis(conv, at[:, None, :], 1)[:, 0] + net.bias
            hid = np.maximum(top, 0)
            z = hid @ net.dense + net.dense_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p /= n
            d_hid = (p @ net.dense.T) * (top > 0)
            chosen = patches[rows, at]                       # n x f x k: the patch each filter picked
            d_filters = np.einsum("nf,nfk->kf", d_hid, chosen) * mask
            d_patch = d_hid[:, :, None] * net.filters.T[None]  # n x f x k
            d_embed = np.zeros_like(net.embed)
            padded = np.concatenate([xb, np.full((n, max(WIDTHS) - 1), 256, dtype=xb.dtype)], axis=1)
            codes = padded[rows[:, :, None], at[:, :, None] + np.arange(max(WIDTHS))]
            np.add.at(d_embed, codes, d_patch.reshape(n, f, max(WIDTHS), EMBED))
            d_embed[256] = 0
            grads = [d_embed, d_filters, d_hid.sum(axis=0), hid.T @ p, p.sum(axis=0)]
            rate = 0.01 * (0.75 ** epoch)
            for w, g, m1, m2 in zip(params, grads, first, second, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
    return net


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> ConvNet:
    """Train on up to ``per_lang`` rows of each language, outside the hold-out.

    The rows come from a fixed pseudo-random share of each language; of each
    row only one window's worth of text, from a pseudo-random place, reaches
    the driver.  Null texts and null languages teach nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row a language
    if not counts:
        return train([], [])
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.2 * per_lang / r["count"]))])
    picked = rows.where(F.col("text").isNotNull() & hash_share(F.col("doc_id"), F.coalesce(share[F.col("lang")], F.lit(0.0))))
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) % room + 1).cast("int")
    cut = picked.select("doc_id", "lang", F.substring("text", start, F.lit(WINDOW)).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in sorted(cut.where(F.col("text").rlike(r"\p{L}")).collect(), key=lambda r: (r["doc_id"], r["lang"], r["text"])):
        own = texts.setdefault(r["lang"], [])
        if len(own) < per_lang:
            own.append(r["text"])
    pairs = [(t, lang) for lang in sorted(texts) for t in texts[lang]]
    random.Random(1).shuffle(pairs)
    # Every fourth text also appears cut short, so that short texts are known too.
    pairs += [(t[: 12 + 8 * (i % 10)], lang) for i, (t, lang) in enumerate(pairs) if i % 4 == 0]
    return train([t for t, _ in pairs], [lang for _, lang in pairs])


def predict(docs: DataFrame, net: ConvNet) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text of ``docs``.

    ``und`` with score 0 for null texts, texts without a letter, and when
    nothing could be learned.  Ids may be null or repeated.  No shuffle.
    """
    text_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield classify_texts(t.tolist(), net)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       classify.asNondeterministic()(F.col("text").cast("string")).alias("p"))
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def classify_texts(texts: list[str | None], net: ConvNet) -> pd.DataFrame:
    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    todo: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        if not todo:
            return
        sizes = np.array([len(w) for _, w in todo])
        all_windows = np.concatenate([w for _, w in todo])
        weight = (all_windows < 256).sum(axis=1).astype(np.float64)
        z = net.logits(all_windows) * weight[:, None]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(z, starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for (i, _), row in zip(todo, p, strict=True):
            pred[i], score[i] = net.langs[int(row.argmax())], float(min(row.max(), 1.0))
        todo.clear()

    for i, t in enumerate(texts):
        if not net.langs or not t or not any(map(str.isalpha, t)):
            continue
        todo.append((i, windows_of(t.encode("utf-8", "surrogatepass"))))
        held += len(todo[-1][1])
        if held >= 8 * CHUNK:
            flush()
            held = 0
    flush()
    return pd.DataFrame({"lang_pred": pred, "score": score})


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
