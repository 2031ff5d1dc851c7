"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text is normalised to words that begin with the space mark. Every distinct word of a
slice is segmented once; words of equal length advance together. At each place the hashes
of all substrings that end there are probed in the sorted hashes of the vocabulary, the
best score of each is a vectorised maximum, and its start is the backpointer. Characters
without a piece become their UTF-8 byte pieces, or the unknown id if the model has none.

The path of greatest total score is what the unigram model of SentencePiece means by a
segmentation, with its ties going to the longest last piece. A model file whose training
type is BPE gets the same treatment of its pieces and scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widegrain.llm import kernels
from widegrain.llm.common import map_arrow, ragged_arange, text_buffer, text_slices

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
BASE = 0xC6A4A7935BD1E995
CACHE_WORDS = 1 << 19
#: Words of more characters are segmented one by one.
LONG_WORD = 256


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def hash_points(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each run of code points."""
    pw, inv = kernels.powers(BASE, len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * pw[: len(points)], out=sums[1:])
    return kernels.mix((sums[starts + sizes] - sums[starts]) * inv[starts] + sizes.astype(np.uint64) * np.uint64(kernels.MIX_1))


@dataclass
class Vocabulary:
    """Pieces, scores and types of a model, with the sorted keys that Viterbi probes."""

    pieces: list[str]
    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    unknown: int
    unknown_score: float
    add_prefix: bool
    controls: set[int] = field(default_factory=set)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = np.full(256, -1)
        plain, controls = [], set()
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
            elif sp.is_control(i):
                controls.add(i)
            elif not sp.is_unknown(i) and not sp.is_unused(i):
                plain.append(i)
        sizes = np.array([len(pieces[i]) for i in plain])
        points = np.frombuffer("".join(pieces[i] for i in plain).encode("utf-32-le"), np.uint32)
        keys = hash_points(points, np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(keys)
        ids = np.array(plain)[order]
        scores = np.array([sp.get_score(int(i)) for i in ids], np.float64)
        marked = sp.encode("a") == sp.encode(" a") or sp.id_to_piece(sp.encode("a")[0]).startswith(MARK)
        return cls(pieces, keys[order], ids, scores, int(sizes.max()), byte_ids, sp.unk_id(), float(scores.min()) - UNKNOWN_PENALTY, marked, controls)

    def __post_init__(self) -> None:
        # Where the sorted keys of each leading 17 bits begin, so a probe starts in place.
        self.first = np.searchsorted(self.keys >> np.uint64(47), np.arange((1 << 17) + 1, dtype=np.uint64))
        # The bytes that each id stands for, joined; control pieces stand for none.
        byte_of = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids) if i >= 0}
        blobs = [b"" if i in self.controls else byte_of.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_size = np.array([len(x) for x in blobs])
        self.blob_at = np.cumsum(self.blob_size) - self.blob_size

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, places): which keys are among the sorted keys, and where."""
        lead = (keys >> np.uint64(47)).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        rows = np.flatnonzero(at < end)
        at, end, want = at[rows], end[rows], keys[rows]
        found_rows, found_at = [], []
        while len(rows):
            hit = self.keys[at] == want
            found_rows.append(rows[hit])
            found_at.append(at[hit])
            more = ~hit & (at + 1 < end)
            rows, at, end, want = rows[more], at[more] + 1, end[more], want[more]
        if not found_rows:
            return rows, at
        return np.concatenate(found_rows), np.concatenate(found_at)


def segment_points(vocab: Vocabulary, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words joined, and how many each has; words of equal length advance together."""
    counts = np.zeros(len(starts), np.int64)
    rows_of, ids_of = [], []
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        size = int(sizes[group[0]]) if len(group) else 0
        step = 1 if size > LONG_WORD else max(1, (1 << 18) // max(size, 1))
        for lo in range(0, len(group) if size else 0, step):
            part = group[lo : lo + step]
            if size > LONG_WORD:
                row, ids = _long_word(vocab, points[starts[part[0]] : starts[part[0]] + size])
            else:
                row, ids = _viterbi(vocab, points[starts[part] + np.arange(size)[:, None]], size)
            rows_of.append(part[row])
            ids_of.append(ids)
    if not rows_of:
        return np.zeros(0, np.int32), counts
    rows, ids = np.concatenate(rows_of), np.concatenate(ids_of)
    counts += np.bincount(rows, minlength=len(starts))
    return ids[np.argsort(rows, kind="stable")], counts


def _viterbi(vocab: Vocabulary, points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, id) of n words, points (size, n), in order of words and places."""
    n = points.shape[1]
    pw, _ = kernels.powers(BASE, size + 1)
    scaled = points.astype(np.uint64) + np.uint64(1)
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((size + 1, n), np.int32)
    piece = np.full((size + 1, n), -1, np.int32)
    # Starts ascend and only a greater total replaces another, so a tie keeps the longer last piece.
    for start in range(size):
        total = np.zeros(n, np.uint64)
        lone = best[start] + vocab.unknown_score
        for length in range(1, min(vocab.longest, size - start) + 1):
            end = start + length
            total = total + scaled[end - 1] * pw[length - 1]
            rows, slot = vocab.find(kernels.mix(total + np.uint64(length * kernels.MIX_1 & (1 << 64) - 1)))
            if length == 1:
                absent = np.ones(n, bool)
                absent[rows] = False
                worse = np.flatnonzero(absent & (lone > best[end]))
                best[end, worse], back[end, worse], piece[end, worse] = lone[worse], start, -1
            score = best[start, rows] + vocab.scores[slot]
            better = score > best[end, rows]
            rows, slot, score = rows[better], slot[better], score[better]
            best[end, rows], back[end, rows], piece[end, rows] = score, start, slot
    return _paths(vocab, points, back, piece, size)


def _paths(vocab: Vocabulary, points: np.ndarray, back: np.ndarray, piece: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow the backpointers of all words together."""
    n = points.shape[1]
    rows, end = np.arange(n), np.full(n, size)
    row_parts, start_parts, slot_parts = [], [], []
    while len(rows):
        slot_parts.append(piece[end, rows])
        end = back[end, rows]
        row_parts.append(rows)
        start_parts.append(end)
        rows, end = rows[end > 0], end[end > 0]
    row, start, slot = (np.concatenate(x) for x in (row_parts, start_parts, slot_parts))
    order = np.lexsort((start, row))
    return _ids_of(vocab, points, row[order], start[order], slot[order])


def _long_word(vocab: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_viterbi` of one long word: all places of a length are probed together."""
    size = len(points)
    pw, _ = kernels.powers(BASE, vocab.longest + 1)
    scaled = points.astype(np.uint64) + np.uint64(1)
    total = np.zeros(size, np.uint64)
    starts, lengths, slots = [], [], []
    for length in range(1, min(vocab.longest, size) + 1):
        total = total[: size - length + 1] + scaled[length - 1 :] * pw[length - 1]
        rows, slot = vocab.find(kernels.mix(total + np.uint64(length * kernels.MIX_1 & (1 << 64) - 1)))
        if length == 1:
            absent = np.setdiff1d(np.arange(size), rows)
            rows, slot = np.concatenate([rows, absent]), np.concatenate([slot, np.full(len(absent), -1)])
        starts.append(rows)
        lengths.append(np.full(len(rows), length))
        slots.append(slot)
    start, length, slot = (np.concatenate(x) for x in (starts, lengths, slots))
    order = np.lexsort((length, start))
    start, length, slot = start[order], length[order], slot[order]
    score = np.where(slot >= 0, vocab.scores[slot], vocab.unknown_score)
    best, back, piece = [0.0] + [-np.inf] * size, [0] * (size + 1), [-1] * (size + 1)
    for s, n, k, x in zip(start.tolist(), length.tolist(), slot.tolist(), score.tolist()):
        if best[s] + x > best[s + n]:
            best[s + n], back[s + n], piece[s + n] = best[s] + x, s, k
    path, end = [], size
    while end:
        path.append((back[end], piece[end]))
        end = back[end]
    at, slot = (np.array(x, np.int64) for x in zip(*reversed(path)))
    return _ids_of(vocab, points[:, None], np.zeros(len(at), np.int64), at, slot)


def _ids_of(vocab: Vocabulary, points: np.ndarray, row: np.ndarray, start: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, id) of the path's pieces; a character without a piece becomes its bytes."""
    ids = np.where(slot >= 0, vocab.ids[slot], vocab.unknown)
    lost = np.flatnonzero(slot < 0)
    if not len(lost) or (vocab.byte_ids < 0).any():
        return row, ids.astype(np.int32)
    raw = [chr(c).encode("utf-8", "replace") for c in points[start[lost], row[lost]].tolist()]
    times = np.ones(len(row), np.int64)
    times[lost] = [len(r) for r in raw]
    ids = np.repeat(ids, times)
    at = (np.cumsum(times) - times)[lost]
    spread = np.repeat(at, times[lost]) + ragged_arange(times[lost])
    ids[spread] = vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return np.repeat(row, times), ids.astype(np.int32)


def segment(vocab: Vocabulary, words: list[str]) -> list[np.ndarray]:
    """Ids of every word of a list."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    ids, counts = segment_points(vocab, points, np.cumsum(sizes) - sizes, sizes)
    return np.split(ids, np.cumsum(counts)[:-1])


class Codec:
    """Encoder and decoder of one model; words seen before are remembered, up to a bound."""

    def __init__(self, path: str):
        self.vocab = Vocabulary.load(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.at = self.size = np.zeros(0, np.int64)

    def encode_texts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and offsets) joined, and each text's offset in them."""
        n = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        try:
            points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        except UnicodeError:
            texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            return self.encode_texts(*text_buffer(pa.array(texts, pa.large_string())))
        first = np.searchsorted(np.flatnonzero((buf & 0xC0) != 0x80), offsets)
        points = np.where(points == 0x20, ord(MARK), points).astype(np.uint32)
        if self.vocab.add_prefix:
            held = np.flatnonzero(np.diff(first))
            points = np.insert(points, first[held], ord(MARK))
            first = first + np.concatenate([[0], np.cumsum(np.diff(first) > 0)])
        # A word ends where a mark follows another sign.
        mark = points == ord(MARK)
        new = mark.copy()
        new[1:] &= ~mark[:-1]
        new[first[first < len(points)]] = True
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(points)))
        word_of = np.searchsorted(first, starts, "right") - 1
        # Empty texts share an offset with the next one; the last of equal offsets holds the word.
        ids, counts = self._lookup(points, starts, sizes)
        per_text = np.bincount(word_of, counts, minlength=n).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def _lookup(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, where, inverse = np.unique(hash_points(points, starts, sizes), return_index=True, return_inverse=True)
        fresh = np.ones(len(keys), bool)
        if len(self.keys):
            fresh = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys
        if fresh.any():
            if len(self.keys) + fresh.sum() > CACHE_WORDS:
                self._forget()
                fresh[:] = True
            ids, counts = segment_points(self.vocab, points, starts[where[fresh]], sizes[where[fresh]])
            at = len(self.ids) + np.cumsum(counts) - counts
            merged = np.concatenate([self.keys, keys[fresh]])
            order = np.argsort(merged, kind="stable")
            self.ids, self.keys = np.concatenate([self.ids, ids]), merged[order]
            self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, counts])[order]
        slot = np.searchsorted(self.keys, keys)
        size = self.size[slot][inverse]
        return self.ids[np.repeat(self.at[slot][inverse], size) + ragged_arange(size)], size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, off = self.encode_texts(*text_buffer(pa.array(texts, pa.large_string())))
        return [ids[a:b] for a, b in zip(off[:-1], off[1:])]

    def decode_ids(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each run of ids: byte pieces join up, the first space mark goes."""
        v = self.vocab
        size = v.blob_size[ids]
        raw = v.blob[np.repeat(v.blob_at[ids], size) + ragged_arange(size)].tobytes()
        edge = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        out = [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]
        return [x[1:] if v.add_prefix and x[:1] == b" " else x for x in out]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_ids(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text; a null text gives null, an empty one none.

    Equal rows get equal results; null ids are carried along; other columns are ignored.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for part in text_slices(batches):
            texts = part.column(1).to_pylist()
            ids = codec.encode([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else i.astype(np.int32) for t, i in zip(texts, ids)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; null ids give a null text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op3 over all documents: ids, their digest, and whether decoding gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for part in text_slices(batches):
            buf, offsets = text_buffer(part.column(1))
            ids, off = codec.encode_texts(buf, offsets)
            text = buf.tobytes()
            back = codec.decode_ids(ids, off)
            same = [x == text[a:b] for x, a, b in zip(back, offsets[:-1].tolist(), offsets[1:].tolist())]
            wide = ids.astype("<u4")
            sums = [crc32(wide[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(sums, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return map_arrow(docs, run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
