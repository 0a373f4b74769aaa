"""Language identification with a byte convolutional network, trained in numpy.

The network reads fixed-length windows of bytes. Filters of several widths slide over a window; a filter of width w
is w tables of 256 weights, one per place (a convolution over one-hot bytes). Each filter's maximum over the window
passes a rectifier and a dense softmax layer. Training minimises cross-entropy with Adam; through the maximum only
the winning place of a filter gets a gradient. The window probabilities of a text, weighted by the letters in the
window, average to the text's score.

A text that is null, empty or has no letter (no character of Unicode's category L) is ``und`` with score 0. Whole
texts are read, window by window. Training uses at most ``SAMPLE`` distinct texts per label (the smallest by a hash of
the text) and ``WINDOWS`` windows of each. Rows without a label teach nothing; without any label the answer is ``und``.
Equal texts get equal answers, equal probabilities the label that sorts first. A row without id is never held out and
never learned from. Empty tables give empty tables; other columns, whatever their names, are neither read nor returned.

For filtering, a network may learn one class more (``noise``): strings of random letters, digits and signs, as dumps
and encoded data have them. A text of a window's length or more that belongs there with a probability of ``REJECT``
has no language and is rejected; of any other the most probable language counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded_batches
from tidemark.llm.bpe import raw_texts

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: Bounds of the training sample: rows per label, windows per row.
SAMPLE, WINDOWS, STRETCH = 300, 6, 4096
STEPS, BATCH = 500, 64
UNKNOWN = "und"
#: Strings that the noise class learns from, and the signs that they are drawn from.
NOISE, REJECT = 240, 0.9
_SIGNS = (b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", bytes(range(33, 127)), b"0123456789abcdef \n", b"01 \nxX")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    """Whether a character of the text is a letter, as ``\\p{L}`` has it."""
    return bool(_ASCII_LETTER.search(raw)) or any(map(str.isalpha, raw.decode("utf-8", "replace")))


@dataclass
class Network:
    labels: list[str | None]  # None: the class of noise
    filters: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # (len(WIDTHS) * FILTERS, labels)
    dense_bias: np.ndarray

    def tables(self) -> None:
        """Merge places two by two: a table over byte pairs answers two places in one look-up."""
        self.pairs: dict[int, list[tuple[int, bool, np.ndarray]]] = {}
        for w, f in self.filters.items():
            parts = []
            for j in range(0, w - 1, 2):
                parts.append((j, True, (f[j][None, :, :] + f[j + 1][:, None, :]).reshape(65536, FILTERS)))
            if w % 2:
                parts.append((w - 1, False, f[w - 1]))
            self.pairs[w] = parts

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW + 3) bytes to (n, labels)."""
        n = len(windows)
        pair = windows[:, :-1].astype(np.uint16) | windows[:, 1:].astype(np.uint16) << np.uint16(8)
        top = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for k, w in enumerate(WIDTHS):
            total = None
            for j, two, table in self.pairs[w]:
                at = (pair if two else windows)[:, j : j + WINDOW]
                got = table[at]
                total = got if total is None else np.add(total, got, out=total)
            top[:, k * FILTERS : (k + 1) * FILTERS] = total.max(axis=1)
        return softmax(np.maximum(top + self.bias, 0) @ self.dense + self.dense_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(raw: bytes) -> np.ndarray:
    """(n, WINDOW + 3): the windows of a text, each with the three bytes that follow it, zeros beyond the end."""
    n = max(1, -(-len(raw) // WINDOW))
    data = np.zeros(n * WINDOW + 3, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, WINDOW + 3)[::WINDOW]


def noise_strings(rng: np.random.Generator) -> list[bytes]:
    """Random strings of several stocks of signs, each about as long as a text's windows."""
    stocks = [np.frombuffer(s, np.uint8) for s in _SIGNS]
    return [stocks[i % len(stocks)][rng.integers(0, len(stocks[i % len(stocks)]), WINDOW * WINDOWS)].tobytes() for i in range(NOISE)]


def train(texts: list[bytes], langs: list[str], seed: int = 7, steps: int = STEPS, noise: bool = False) -> Network:
    """A network for the labels in ``langs``; with a single label or none it always answers that or ``und``.

    With ``noise`` it has one class more for strings that are no language, if there is any label.
    """
    rng = np.random.default_rng(seed)
    labels: list[str | None] = sorted(set(langs)) or [UNKNOWN]
    if noise and langs:
        made = noise_strings(np.random.default_rng(seed + 1))
        texts, langs, labels = [*texts, *made], [*langs, *[None] * len(made)], [*labels, None]
    xs, ys = [], []
    for raw, lang in zip(texts, langs):
        w = windows_of(raw)
        for i in rng.permutation(len(w))[:WINDOWS]:
            xs.append(w[i])
            ys.append(labels.index(lang))
    net = Network(labels, {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    if len(labels) > 1:
        x, y = np.array(xs), np.array(ys)
        weight = (len(y) / len(labels) / np.bincount(y, minlength=len(labels))).astype(np.float32)
        params = [*net.filters.values(), net.bias, net.dense, net.dense_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            i = rng.integers(0, len(y), BATCH)
            grads = gradients(net, x[i], y[i], weight[y[i]])
            rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    n, rows = len(x), np.arange(len(x))
    tops, places = [], []
    for w, f in net.filters.items():
        total = sum(f[j][x[:, j : j + WINDOW]] for j in range(w))
        at = total.argmax(axis=1)
        places.append(at)
        tops.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
    pre = np.concatenate(tops, axis=1) + net.bias
    hidden = np.maximum(pre, 0)
    d = softmax(hidden @ net.dense + net.dense_bias)
    d[rows, y] -= 1
    d *= weight[:, None] / n
    back = (d @ net.dense.T) * (pre > 0)
    out = []
    for k, (w, f) in enumerate(net.filters.items()):
        g, own = np.zeros_like(f), back[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(w):
            np.add.at(g[j], (x[rows[:, None], places[k] + j], np.arange(FILTERS)[None, :]), own)
        out.append(g)
    return [*out, back.sum(0), hidden.T @ d, d.sum(0)]


def training_sample(docs: DataFrame, text: str, lang: str, rows: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """A stretch of at most ``rows`` distinct texts of each label: those with the smallest hashes, so the choice is the same each time.

    Texts are distinct by their hash of 64 bits.
    """
    labelled = docs.select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang")).where(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    hashed = labelled.select("_lang", F.xxhash64("_text").alias("_h"), "_text")
    # copies collapse before any is counted; then only hashes are ranked, so that a label with fewer texts has them all
    distinct = hashed.select("_lang", "_h").distinct()
    order = Window.partitionBy("_lang").orderBy("_h")
    chosen = distinct.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= rows)
    picked = [(r["_lang"], r["_h"], r["_r"]) for r in chosen.collect()]
    sample = docs.sparkSession.createDataFrame(picked, "_lang string, _h long, _r int")
    # of a long text the driver gets one stretch, from a place that the hash picks
    part = F.substring("_text", F.pmod("_h", F.greatest(F.length("_text") - STRETCH, F.lit(1))).cast("int") + 1, F.lit(STRETCH)).alias("_part")
    rest = hashed.join(F.broadcast(sample), ["_lang", "_h"]).select("_lang", "_r", part)
    got = rest.groupBy("_lang", "_r").agg(F.min("_part").alias("_part")).orderBy("_lang", "_r").select("_part", "_lang").collect()
    return [r[0].encode() for r in got], [r[1] for r in got]


def _answers(net: Network, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
    """Label and score of each text, some windows at a time, and whether it was rejected: null, empty, letterless or noise."""
    preds, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    sums = np.zeros((len(texts), len(net.labels)))
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if held:
            w = np.concatenate([x for _, x in held])
            owner = np.concatenate([np.full(len(x), i) for i, x in held])
            body = w[:, :WINDOW]
            letters = (((body | 32) >= 97) & ((body | 32) <= 122) | (body >= 0xC3)).sum(axis=1) + 1e-6
            np.add.at(sums, owner, net.probabilities(w) * letters[:, None])
            held.clear()

    size = 0
    for i in known:
        whole = windows_of(texts[i])
        for at in range(0, len(whole), 512):
            held.append((i, whole[at : at + 512]))
            size += len(held[-1][1])
            if size >= 512:
                flush()
                size = 0
    flush()
    rejected = [True] * len(texts)
    for i in known:
        p = sums[i] / sums[i].sum()
        rejected[i] = net.labels[-1] is None and len(texts[i]) >= WINDOW and bool(p[-1] >= REJECT)
        if not rejected[i]:
            k = int(p[: -1 if net.labels[-1] is None else None].argmax())
            preds[i], scores[i] = net.labels[k], float(min(1.0, p[k]))
    return preds, scores, rejected


def predict(docs: DataFrame, net: Network, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net.tables()
        for b in batches:
            preds, scores, _ = _answers(net, raw_texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def with_language(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text gets a language: not null, empty or letterless, nor noise to the network."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net.tables()
        for b in batches:
            _, _, rejected = _answers(net, raw_texts(b.column(place)))
            yield b.filter(pa.array([not r for r in rejected], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots do not pass
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def fold_of(key: str = "doc_id"):
    """crc32 of the id as text, modulo 3; rows where it is 1 are held out. Null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score): a network learned from the rows not held out, applied to all."""
    # a row without id is in no fold: it is not learned from
    net = train(*training_sample(docs.where(fold_of(key) != 1), text, lang))
    return predict(docs, net, text, key).withColumn("held_out", F.coalesce(fold_of(key) == 1, F.lit(False))).select(key, "held_out", "lang_pred", "score")
