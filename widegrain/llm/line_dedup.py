"""Line dedup by pairwise alignment with the earlier documents that share rare runs of lines.

A line's key is the hash of its trimmed text and its occurrence number in the document,
so every key is unique within a document, as patience diff asks of its anchors. A block is
a run of neighbouring lines, of `words` words or more, that an earlier document has too.

Partners are found by hashes. A line alone may be in millions of documents, so what is
hashed is rarer: each shortest run of neighbouring lines that holds enough words, counted
from its first line on and from its last line back. Every block is made up of such runs,
and each run leads a document to the first document that has it: one partner row for each
run, however many documents share it, and none is left out. That is an exact way for
frequent lines as well, which a limit on a line's documents would not be.

Document and partner are aligned by patience (a longest run of anchors that ascends on
both sides), then what is left is aligned again, so that blocks which moved are found too;
an ascending run of greatest length never cuts a block. The blocks go from the later
document. Aligning every pair of documents deletes the same lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from widegrain.llm import kernels
from widegrain.llm.common import map_arrow, save, text_buffer, text_slices

#: Words that a deleted block has at least.
WORDS = 8
U64 = np.uint64


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, line number, 128-bit key (two columns) and words of every line with a word.

    Lines are numbered within their text, lines without a word are not counted.
    """
    starts, ends, first = kernels.word_spans(buf, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, 2), U64), none
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    breaks = np.searchsorted(np.flatnonzero(buf == 10), starts)
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    line_doc = doc[head]
    at = np.arange(len(head))
    number = at - np.searchsorted(line_doc, line_doc)
    view = memoryview(np.ascontiguousarray(buf))
    h = np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(starts[head].tolist(), ends[tail].tolist())]), U64).reshape(-1, 2)
    order = np.lexsort((at, h[:, 1], h[:, 0], line_doc))
    same = np.zeros(len(order), bool)
    same[1:] = (h[order][1:] == h[order][:-1]).all(axis=1) & (line_doc[order][1:] == line_doc[order][:-1])
    group = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - group
    return line_doc, number, kernels.mix(h + nth.astype(U64)[:, None] * U64(kernels.MIX_1)), tail - head + 1


def shortest_runs(doc: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of each shortest run of a text's lines with `least` words, from
    every first line on and from every last line back. Lines are counted over all texts."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = np.arange(len(doc))
    begin, end = np.searchsorted(doc, doc), np.searchsorted(doc, doc, "right")
    stop = np.searchsorted(total, total[:-1] + least)  # the run is first..stop-1
    on = stop <= end
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    back = (total[1:] >= least) & (start >= begin)
    pairs = np.unique(np.concatenate([n[on] * (1 << 32) + stop[on] - n[on], start[back] * (1 << 32) + n[back] + 1 - start[back]]))
    return pairs >> 32, pairs & (1 << 32) - 1


def run_keys(key: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit keys (two columns) of runs of lines, from those of the lines."""
    out = np.repeat(kernels.mix(size.astype(U64))[:, None], 2, axis=1)
    for t in range(int(size.max()) if len(size) else 0):
        live = size > t
        out[live] = kernels.mix(out[live] * U64(kernels.WORD_BASE) + key[first[live] + t])
    return out


def aligned(anchors: list[tuple[int, int]]) -> list[int]:
    """Lines of a longest run that increases in both documents.

    `anchors` are (line, partner's line), lines increasing, both sides unique.
    """
    tops: list[int] = []
    held: list[int] = []
    back = [-1] * len(anchors)
    for i, (_, place) in enumerate(anchors):
        pile = bisect_left(tops, place)
        if pile:
            back[i] = held[pile - 1]
        if pile == len(tops):
            tops.append(place)
            held.append(i)
        else:
            tops[pile], held[pile] = place, i
    out = []
    i = held[-1] if held else -1
    while i >= 0:
        out.append(anchors[i][0])
        i = back[i]
    return out[::-1]


def common_blocks(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first line, lines) of the blocks that two documents share, from their anchors."""
    out: list[tuple[int, int]] = []
    rest = sorted(anchors)
    while rest:
        place = dict(rest)
        run = aligned(rest)
        taken = set(run)
        rest = [a for a in rest if a[0] not in taken]
        start = 0
        for i in range(1, len(run) + 1):
            if i == len(run) or run[i] != run[i - 1] + 1 or place[run[i]] != place[run[i - 1]] + 1:
                out.append((run[start], i - start))
                start = i
    return out


def deleted_lines(runs: list[tuple[int, int, object, int]]) -> list[int]:
    """Lines of one document's common blocks, from its shared runs (line, lines, partner, partner's line)."""
    by_partner: dict = {}
    for line, size, partner, place in runs:
        by_partner.setdefault(partner, set()).update((line + t, place + t) for t in range(size))
    return sorted({line + t for anchors in by_partner.values() for line, size in common_blocks(list(anchors)) for t in range(size)})


def _source(docs: DataFrame) -> DataFrame:
    """The rows with their document: a null id comes last, texts of one id are told apart by hash."""
    return docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("__row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("__doc"),
        F.xxhash64("text").alias("__part"),
        F.col("text").alias("__text"),
    )


def removed_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc, part, removed): the deleted lines of every document that loses some."""
    src = _source(docs).select("__doc", "__part", "__text")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            doc, number, key, size = lines_of(*text_buffer(part.column(2)))
            first, lines = shortest_runs(doc, size, words)
            key = run_keys(key, first, lines).view(np.int64)
            row = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), part.column(0).take(row), part.column(1).take(row), pa.array(number[first], pa.int32()), pa.array(lines, pa.int32())],
                ["ka", "kb", "doc", "part", "line", "lines"],
            )

    runs = map_arrow(src, keys, "ka long, kb long, doc long, part long, line int, lines int")
    firsts = runs.groupBy("ka", "kb").agg(F.count("*").alias("n"), F.min(F.struct("doc", "part", "line")).alias("a")).where("n > 1")
    firsts = firsts.select(F.col("ka").alias("fa"), F.col("kb").alias("fb"), F.col("a.doc").alias("adoc"), F.col("a.part").alias("apart"), F.col("a.line").alias("aline"))
    # Written, so that both sides of the join are plain shuffles and a hot run can be split.
    firsts = save(firsts)
    later = runs.join(firsts, (F.col("ka") == F.col("fa")) & (F.col("kb") == F.col("fb"))).where("doc <> adoc OR part <> apart")
    shared = later.groupBy("doc", "part").agg(F.collect_set(F.struct("line", "lines", "adoc", "apart", "aline")).alias("s"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2)
            line, lines, adoc, apart, aline = [s.flatten().field(i).to_numpy(zero_copy_only=False).tolist() for i in range(5)]
            runs = list(zip(line, lines, zip(adoc, apart), aline))
            off = (s.offsets.to_numpy() - s.offsets[0].as_py()).tolist()
            out = [deleted_lines(runs[a:b]) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc", "part", "removed"])

    return map_arrow(shared, align, "doc long, part long, removed array<int>")


def strip_lines(text: str, removed: set[int]) -> tuple[str, int]:
    """The text without the given word lines, and the number of word lines.

    A line without a word goes if the line before it goes.
    """
    out, number, gone = [], 0, False
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            gone = number in removed
            number += 1
        if not gone:
            out.append(line)
    return "\n".join(out), number


def dedup_blocks(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """`docs` with text cleaned, and the new columns n_lines and n_removed_lines.

    Every row comes back with its other columns unchanged. Earlier is a smaller doc_id; a
    null id comes last, and different texts of one id are ordered by their hash. Equal rows
    are one document and get equal results. A null text stays null, with no lines.
    """
    src = _source(docs)
    gone = removed_lines(docs, words)
    joined = src.join(gone, (F.col("__doc") == F.col("doc")) & (F.col("__part") == F.col("part")), "left")
    fields = [f for f in docs.schema.fields if f.name not in ("text", "n_lines", "n_removed_lines")]
    plain = joined.select(*[F.col("__row")[f.name].alias(f"c{i}") for i, f in enumerate(fields)], F.col("__row")["text"].alias("__text"), F.coalesce("removed", F.array().cast("array<int>")).alias("__removed"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            n = part.num_columns
            texts, counts, sizes = [], [], []
            for t, r in zip(part.column(n - 2).to_pylist(), part.column(n - 1).to_pylist()):
                kept, lines = strip_lines(t, set(r)) if t is not None else (None, 0)
                texts.append(kept)
                counts.append(lines)
                sizes.append(len(r))
            cols = [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[: n - 2], *cols], [*part.schema.names[: n - 2], "text", "n_lines", "n_removed_lines"])

    schema = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(fields)) + "text string, n_lines long, n_removed_lines long"
    out = map_arrow(plain, clean, schema)
    named = {f.name: F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)}
    order = [named.get(c, F.col(c)) for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    return out.select(*order, "n_lines", "n_removed_lines")


def query(spark, sf_dir: str) -> DataFrame:
    """op4 over all documents: the cleaned text and how many of its lines went."""
    return dedup_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
