"""Language identification by a byte convolutional network trained in numpy.

Filters of several widths slide over the bytes of fixed-length windows; each filter's
greatest response in a window (max pooling) feeds a softmax layer. Every byte of a text
lies in one window, and a document's probabilities are the windows' mean, weighted by
their length. ASCII and Latin-1 capitals count as small letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widegrain.llm.common import map_arrow, text_buffer, text_slices

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bounds of the training sample: documents of each language, windows of each document.
TRAIN_DOCS = 600
TRAIN_WINDOWS = 3
TRAIN_CHARS = 240
#: Share of held-out documents, told correctly, whose scores count as too low.
REJECT = 0.001
#: Windows convolved at a time; bounds the memory of a worker.
BATCH = 512


@dataclass
class ByteCnn:
    """conv[k] is (256, filters): the response to a byte at place k of a filter."""

    langs: list[str]
    conv: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The same convolution as sums of two lookups by byte pair."""
        first = self.conv[0][:, None, :] + self.conv[1][None, :, :]
        second = self.conv[2][:, None, :] + self.conv[3][None, :, :]
        return first.reshape(65536, -1), second.reshape(65536, -1)

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(n, langs) of windows (n, WINDOW + 3) of folded bytes."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        n = windows.shape[1] - 3
        response = tables[0][pairs[:, :n]]
        response += tables[1][pairs[:, 2 : 2 + n]]
        pooled = np.maximum(response.max(axis=1) + self.bias, 0)
        return softmax(pooled @ self.dense + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fold(buf: np.ndarray) -> np.ndarray:
    """ASCII and two-byte Latin-1 capitals as small letters."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    if len(buf) > 1:
        tail = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[tail] += 32
    return out


def windows_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end of the text, and text number of every window."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[doc] + nth * WINDOW, offsets[doc + 1], doc


def cut_windows(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW + 3)
    inside = at < stops[:, None]
    return np.where(inside, buf[np.where(inside, at, 0)], 0)


def train(texts: list[str], labels: list[str], epochs: int = 8, seed: int = 7, rate: float = 0.02) -> ByteCnn | None:
    """Fit the network by Adam on windows of labelled text; None if there is no text."""
    langs = sorted(set(labels))
    parts = []
    for t, lang in zip(texts, labels):
        raw = fold(np.frombuffer(t.encode("utf-8", "replace"), np.uint8))
        parts += [(raw[lo : lo + WINDOW], langs.index(lang)) for lo in range(0, len(raw), WINDOW)]
    if not parts:
        return None
    x = np.zeros((len(parts), WINDOW + 3), np.uint8)
    for row, (raw, _) in enumerate(parts):
        x[row, : len(raw)] = raw
    y = np.array([lang for _, lang in parts])
    weight = 1 / np.bincount(y, minlength=len(langs)).clip(1)[y]
    weight /= weight.mean()
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    reach = np.repeat(WIDTHS, FILTERS)  # places beyond a filter's width stay zero
    conv = rng.normal(0, 0.3, (4, 256, n_filters)) * (np.arange(4)[:, None] < reach)[:, None, :]
    conv[:, 0, :] = 0
    params = [conv.astype(np.float32), np.zeros(n_filters, np.float32), rng.normal(0, 0.2, (n_filters, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    open_place = (np.arange(4)[:, None] < reach).astype(np.float32)[:, None, :]
    step, size = 0, 128
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), size):
            rows = order[lo : lo + size]
            xb = x[rows]
            pre = sum(params[0][k][xb[:, k : WINDOW + k]] for k in range(4))
            best = pre.argmax(axis=1)
            top = np.take_along_axis(pre, best[:, None, :], 1)[:, 0] + params[1]
            pooled = np.maximum(top, 0)
            grad = softmax(pooled @ params[2] + params[3])
            grad[np.arange(len(rows)), y[rows]] -= 1
            grad *= (weight[rows] / len(rows))[:, None]
            back = (grad @ params[2].T) * (top > 0)
            g_conv = np.zeros_like(params[0])
            for k in range(4):
                np.add.at(g_conv[k], (np.take_along_axis(xb, best + k, 1), np.arange(n_filters)[None, :]), back)
            g_conv *= open_place
            g_conv[:, 0, :] = 0
            step += 1
            for p, (m, v), g in zip(params, moments, (g_conv, back.sum(0), pooled.T @ grad, grad.sum(0))):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteCnn(langs, params[0], params[1], params[2], params[3])


def fold_of(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; documents at 2 are held out of training."""
    return F.crc32(F.col(id_col).cast("string")) % 4


def fit(docs: DataFrame, lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> ByteCnn | None:
    """Train on at most about `train_docs` documents of each label, chosen by id hash.

    The sample is bounded by (labels x train_docs x train_windows) windows of
    TRAIN_CHARS characters from hashed places of the text; held-out ids never enter.
    """
    known = docs.where(F.col("text").isNotNull() & F.col(lang_col).isNotNull() & (fold_of() != 2)).where(F.col(lang_col) != UNDETERMINED)
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(1.0, train_docs / n) * (1 << 30)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share[F.col(lang_col)])
    place = F.pmod(F.xxhash64("doc_id", F.col("nth")), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))) + 1
    rows = (
        chosen.withColumn("nth", F.explode(F.array(*[F.lit(i) for i in range(train_windows)])))
        .select(F.col(lang_col).alias("lang"), F.substring(F.col("text"), place.cast("int"), F.lit(TRAIN_CHARS)).alias("piece"), "doc_id", "nth")
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["nth"], r["lang"], r["piece"]))
    return train([r["piece"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: ByteCnn | None, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (default doc_id) with lang_pred and score for each row.

    A null text, one without a letter, or any text when nothing could be learned gives
    `und` with score 0. Ties between languages go to the first in order of name.
    """
    keep = keep or ["doc_id"]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.when(letters, F.col("text")).alias("__text"))
    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.pair_tables() if model else None
        for part in text_slices(batches, "__text"):
            n = part.num_rows
            buf, off = text_buffer(part.column(part.num_columns - 1))
            langs, score = [UNDETERMINED] * n, np.zeros(n)
            if model and len(buf):
                starts, stops, doc = windows_of(buf, off)
                buf = fold(buf)
                sums = np.zeros((n, len(model.langs)))
                for lo in range(0, len(starts), BATCH):
                    s, e, d = starts[lo : lo + BATCH], stops[lo : lo + BATCH], doc[lo : lo + BATCH]
                    p = model.probabilities(cut_windows(buf, s, e), tables)
                    np.add.at(sums, d, p * np.minimum(e - s, WINDOW)[:, None])
                mean = sums / np.maximum(np.diff(off), 1)[:, None]
                best = mean.argmax(axis=1)
                score = np.clip(mean[np.arange(n), best], 0, 1)
                has = np.diff(off) > 0
                langs = [model.langs[b] if h else UNDETERMINED for b, h in zip(best, has)]
                score = np.where(has, score, 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs), pa.array(score)], [*part.schema.names[:-1], "lang_pred", "score"])

    out = map_arrow(src, run, f"{fields}, lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def least_score(docs: DataFrame, model: ByteCnn | None, reject: float) -> float:
    """The score below which a share `reject` of the held-out documents of known language lies.

    Measured on all held-out documents whose language was told correctly, so it means the
    same for any number of languages; 0 without such documents.
    """
    held = docs.where((fold_of() == 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    told = predict(held, model, ["lang"]).where(F.col("lang") == F.col("lang_pred"))
    return float(told.agg(F.percentile_approx("score", reject, 100_000)).first()[0] or 0.0)


def identified(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """Rows of `docs` whose language is told, with that language where theirs is null.

    A row is rejected if its text is null, has no letter, or if its score is below that
    of all but a share `reject` of the held-out documents (see `least_score`); the mean
    score of a text of mixed or foreign matter is. Other columns come back unchanged.
    """
    names = docs.columns
    model = fit(docs)
    least = least_score(docs, model, reject)
    scored = predict(docs, model, keep=names)
    kept = scored.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    """Contract columns of op2 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(fold_of() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
