"""Exact substring dedup through a compacted De Bruijn graph of token k-mers.

The graph's edges are the k-mers (windows of `window` words, an edge joining the two
windows' common words), but no table ever holds one row per edge of unique text:

1. Every window is assigned to its minimizer, the least hash among its short sub-k-mers.
   Equal windows have equal minimizers. Successive windows with one minimizer form a
   nonbranching stretch of the document's path and are compacted, in the task that reads
   the text, into one row: (minimizer, hash of the stretch's words, source coordinates).
2. Equal stretches meet in an aggregate that keeps the first source coordinate. A stretch
   that isn't the first of its kind repeats as a whole.
3. A minimizer with two or more different stretches is a branching node, for example
   where a shared passage begins or ends. Only there the first stretches are opened again
   into single edges, and each edge keeps its first source coordinate.
4. Both lists of first coordinates go back to their documents, where the coordinates are
   read against the whole text: every window that isn't the first of its kind is a
   verified repeat and all its words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widegrain.llm import kernels
from widegrain.llm.common import map_arrow, save, text_buffer, text_slices

U64 = np.uint64
WINDOW = 20
SUB_KMER = 6
MINIMIZER_SEED, CONTENT_SEED = 1, 2


class Path:
    """The windows of many texts, compacted by minimizer."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, window: int, sub: int):
        self.starts, self.ends, self.first = kernels.word_spans(buf, offsets)
        self.words = np.diff(self.first)
        # Minimizers and contents come from two independent hashes of each word: 128 bits in all.
        hashes = kernels.span_hashes(buf, self.starts, self.ends, CONTENT_SEED)
        small = kernels.mix(kernels.rolling(kernels.span_hashes(buf, self.starts, self.ends, MINIMIZER_SEED), sub))
        least = kernels.sliding_argmin(small, window - sub + 1)
        count = np.maximum(self.words - window + 1, 0)
        #: Global word number and text of every window, in order.
        self.doc = np.repeat(np.arange(len(count)), count)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count) + self.first[self.doc]
        place = least[self.at] if len(self.at) else np.zeros(0, np.int64)
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.doc[1:] != self.doc[:-1])
        #: Stretches: first window, number of windows, minimizer, hash of their words.
        self.head = np.flatnonzero(new)
        self.size = np.diff(np.append(self.head, len(place)))
        self.minimizer = small[place[self.head]] if len(place) else np.zeros(0, U64)
        pw, inv = kernels.powers(kernels.WORD_BASE, len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, U64)
        np.cumsum(hashes * pw[: len(hashes)], out=sums[1:])
        a = self.at[self.head] if len(place) else np.zeros(0, np.int64)
        b = a + self.size + window - 1
        self.content = kernels.mix((sums[b] - sums[a]) * inv[a] + self.size.astype(U64) * U64(kernels.MIX_2))
        #: Window number within its text, of each stretch's head.
        self.start = a - self.first[self.doc[self.head]] if len(place) else a
        self.hashes = hashes

    def edges(self, window: int) -> np.ndarray:
        """Hash of each window."""
        return kernels.mix(kernels.rolling(self.hashes, window)[self.at]) if len(self.at) else np.zeros(0, U64)


def _sources(docs: DataFrame) -> DataFrame:
    """(__doc, __part, text, doc_id): a document's place in the order of first occurrences.

    A null id orders after all others. Rows that share an id are one document if their
    texts are equal and are told apart by 31 bits of the text's hash otherwise.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("__doc"),
        F.shiftrightunsigned(F.xxhash64("text"), 33).alias("__part"),
        "text",
        F.col("doc_id").cast("long").alias("doc_id"),
    )


def _least(*cols: str) -> Column:
    return F.min(F.struct(*cols))


def first_stretches(docs: DataFrame, window: int, sub: int) -> DataFrame:
    """(minimizer, doc, part, start): the first occurrence of every distinct stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            path = Path(*text_buffer(part.column(2)), window, sub)
            doc = pa.array(path.doc[path.head])
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.minimizer.view(np.int64)), pa.array(path.content.view(np.int64)), part.column(0).take(doc), part.column(1).take(doc), pa.array(path.start, pa.int32())],
                ["minimizer", "content", "doc", "part", "start"],
            )

    rows = map_arrow(_sources(docs).drop("doc_id"), run, "minimizer long, content long, doc long, part long, start int")
    return rows.groupBy("minimizer", "content").agg(_least("doc", "part", "start").alias("s")).select("minimizer", "s.*")


def repeated_words(docs: DataFrame, window: int = WINDOW, sub: int = SUB_KMER) -> DataFrame:
    """(doc_id, __part, text, firsts, opened, edges): each text with what is first in it.

    firsts: starts of its first stretches; opened: those at branching nodes;
    edges: starts of the first windows inside these.
    """
    firsts = save(first_stretches(docs, window, sub))
    # Written, so that both sides of the join are plain shuffles and a hot minimizer can be split.
    branching = save(firsts.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1").select("minimizer", F.lit(True).alias("branch")))
    marked = firsts.join(branching, "minimizer", "left").select("doc", "part", "start", F.coalesce("branch", F.lit(False)).alias("branch"))
    lists = save(
        marked.groupBy("doc", "part").agg(
            F.collect_list("start").alias("firsts"),
            F.collect_list(F.when(F.col("branch"), F.col("start"))).alias("opened"),
        )
    )
    source = _sources(docs)
    on = lambda right: (F.col("__doc") == right["doc"]) & (F.col("__part") == right["part"])

    def open_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            path = Path(*text_buffer(part.column(2)), window, sub)
            opened = _marked(part.column(3), path)
            pick = np.repeat(opened, path.size)
            doc = path.doc[pick]
            edge = path.edges(window)[pick]
            least = np.repeat(path.minimizer, path.size)[pick]
            start = path.at[pick] - path.first[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(least.view(np.int64)), pa.array(edge.view(np.int64)), part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(start, pa.int32())],
                ["minimizer", "edge", "doc", "part", "start"],
            )

    branchy = lists.where(F.size("opened") > 0)
    opened = source.join(branchy, on(branchy)).select("__doc", "__part", "text", "opened")
    edges = map_arrow(opened, open_edges, "minimizer long, edge long, doc long, part long, start int")
    edges = edges.groupBy("minimizer", "edge").agg(_least("doc", "part", "start").alias("s")).select("s.*")
    edges = save(edges.groupBy("doc", "part").agg(F.collect_list("start").alias("edges")).select(F.col("doc").alias("edoc"), F.col("part").alias("epart"), "edges"))
    out = source.join(lists, on(lists), "left")
    out = out.join(edges, (F.col("__doc") == F.col("edoc")) & (F.col("__part") == F.col("epart")), "left")
    return out.select("doc_id", "__part", "text", "firsts", "opened", "edges")


def _marked(lists: pa.Array, path: Path) -> np.ndarray:
    """Which stretches begin at a start named in their text's list."""
    doc, values = _flat(lists)
    wide = 1 << 32
    return np.isin(path.doc[path.head] * wide + path.start, doc * wide + values)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = lists.fill_null([]) if lists.null_count else lists
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def removed_mask(part: pa.RecordBatch, window: int, sub: int) -> tuple[np.ndarray, Path, np.ndarray]:
    """Bytes of the texts, their path, and which words a later occurrence covers."""
    buf, off = text_buffer(part.column(2))
    path = Path(buf, off, window, sub)
    first = np.repeat(_marked(part.column(3), path), path.size)
    opened = np.repeat(_marked(part.column(4), path), path.size)
    doc, start = _flat(part.column(5))
    wide = 1 << 32
    first_edge = np.isin(path.doc * wide + (path.at - path.first[path.doc]), doc * wide + start) if len(path.at) else np.zeros(0, bool)
    repeat = np.where(opened, ~first_edge, ~first)
    cover = np.zeros(len(path.starts) + 1, np.int64)
    at = path.at[repeat]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return buf, path, np.cumsum(cover[:-1]) > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, sub: int = SUB_KMER, digest: bool = False) -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts earlier.

    Earlier is a smaller doc_id, or an earlier place of the same document; windows are
    judged on the input. Returns doc_id, n_words, n_removed and kept_text (the kept words
    joined by one space), or its kept_sha256 if `digest`. A null text has no words. A null
    id comes last and stays null; equal rows get equal results; other columns are ignored.
    """
    out = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            buf, path, gone = removed_mask(part, window, sub)
            kept = ~gone
            word_doc = np.repeat(np.arange(part.num_rows), path.words)
            n_kept = np.bincount(word_doc[kept], minlength=part.num_rows)
            joined, edge = kernels.join_spans(buf, path.starts[kept], path.ends[kept], n_kept)
            texts = [joined[a : max(b - 1, a)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            final = pa.array([sha256(t).hexdigest() for t in texts]) if digest else pa.array([t.decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(path.words), pa.array(path.words - n_kept), final], ["doc_id", "n_words", "n_removed", out]
            )

    return map_arrow(repeated_words(docs, window, sub), run, f"doc_id long, n_words long, n_removed long, {out} string")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract columns of op5 over all documents."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


#: The same rows from the definition. Equal words make equal windows here, not hashes.
ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20
), keyed AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 19), ' ')) AS k FROM win
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM keyed
), gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM ranked, (SELECT unnest(range(0, 20)) AS o) WHERE r > 1
), word AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w
), kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS t, count(*) AS n
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
