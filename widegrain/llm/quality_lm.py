"""Quality by an interpolated modified Kneser-Ney trigram model of trusted text.

Symbols are runs of letters, runs of digits and single signs, hashed to 21 bits, so that a
trigram is one 63-bit key; a text is framed by two start symbols and an end symbol. All
trusted documents that are not held out are counted, in slices first; what that gathers
grows with the input. As in most such models a trigram seen once is not kept as one: its
mass goes to the weight of its context (`CUTOFF`).

Spark moves n-grams in packed blocks, one for each slice and shard: sorted keys by their
differences, counts, and places of documents in the slice. Trigrams meet by their first
two symbols for the weights of contexts and by their last two for the rest, and the
model is one packed row for each shard.

A text's log-probability is a sum of parts that each belong to one n-gram:

    log p(w3 | w1 w2) = log p(w3) + log weight(w2) + gain(w2 w3) + log weight(w1 w2) + gain(w1 w2 w3)

where a gain is what knowing that n-gram adds to the step below, and zero for n-grams that
the model lacks. Parts of single symbols are an array bounded by the alphabet, and the
most frequent n-grams are a list of bounded length: both go to the tasks that read the
texts. All other n-grams of the documents that the model can have by their symbols go to
the model's shards, which send back sums for each document. Documents take turns in
`PASSES` parts, which bounds what lies on disk. Only tables of bounded size pass through
the driver, no document is scored twice, and the result does not depend on which n-grams
are held by the tasks.

A document is kept if its perplexity is within a quantile of that of held-out trusted
documents in its language.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from widegrain.llm import kernels
from widegrain.llm.common import map_arrow, save, scratch, text_buffer, text_slices

ORDER, BITS = 3, 21
ALPHABET = 1 << BITS
#: Symbols of the frame; zero stands before shorter keys.
START, END, FIRST = 1, 2, 3
#: Least count of a trigram that is kept as one.
CUTOFF = 2
#: Frequent n-grams that each task holds (16 bytes each); the others are asked for.
HELD_GRAMS = 1 << 20
#: Parts in which documents are scored, one after the other, so that a part's n-grams lie
#: on disk at once.
PASSES = 3
#: Bytes of text whose n-grams are packed together; larger slices pack better.
BLOCK_BYTES = 8 << 20
#: Tasks that add up counts by symbol, each in arrays over the alphabet.
STAT_TASKS = 24
#: Trusted ids up to which they are broadcast; beyond it they are joined by shuffle.
HELD_IDS = 2_000_000
#: Of this many trusted documents, by crc32 of the id, one is held out for the thresholds.
HELD_OUT = 5
QUANTILE = 0.99
BIN = 0.001
#: A mean over n symbols may exceed the threshold by CONFIDENCE / sqrt(n) nats, about one
#: standard error, so that short texts aren't judged by chance.
CONFIDENCE = 3.0
#: Held-out trusted documents that a language needs for a threshold of its own.
MIN_TRUSTED = 30
#: Discounts used where the counts of counts that estimate one are missing.
FALLBACK = (0.5, 1.0, 1.5)

#: Classes of bytes: white space, letters (and all bytes beyond ASCII), digits, signs.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, and how many each text has."""
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    kind = _CLASS[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    h = kernels.span_hashes(buf, starts, ends)
    return (h >> np.uint64(20)) % np.uint64(ALPHABET - FIRST) + np.uint64(FIRST), np.diff(np.searchsorted(starts, offsets))


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every trigram of every text that has a symbol."""
    ids, count = symbols(buf, offsets)
    held = np.flatnonzero(count)
    size = count[held] + ORDER
    ends = np.cumsum(size)
    line = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint64)
    doc = np.repeat(held, size)
    at = np.arange(len(line)) - np.repeat(ends - size, size)
    last = np.repeat(size, size) - 1
    line[(at >= 2) & (at < last)] = ids
    line[ends - 1] = END
    keep = np.flatnonzero(at >= 2)
    b = np.uint64(BITS)
    return doc[keep], line[keep - 2] << b << b | line[keep - 1] << b | line[keep] if len(keep) else line[:0]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: planes of equal bytes, each array compressed."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T)
        data = codec.compress(planes.tobytes(), asbytes=True)
        out += [struct.pack("<2sqq", a.dtype.str[1:].encode(), len(a), len(data)), data]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<2sqq", data, at)
        at += struct.calcsize("<2sqq")
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(codec.decompress(data[at : at + size], n * dtype.itemsize), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype))
        at += size
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences; their running sum gives them back."""
    return np.diff(keys, prepend=np.uint64(0))


def _sums(data: np.ndarray) -> np.ndarray:
    return np.cumsum(data, dtype=np.uint64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the counts of each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = _runs(keys)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _find(keys: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(have):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return at, have[at] == keys


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _dealt(shard: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, its rows of the arrays, in their order) of each shard that has rows."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    shard = shard[order]
    arrays = [a[order] for a in arrays]
    first = _runs(shard)
    for a, z in zip(first, [*first[1:], len(shard)], strict=False):
        yield int(shard[a]), [x[a:z] for x in arrays]


def _shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _counts_of(c: np.ndarray) -> tuple[int, ...]:
    return tuple(int((c == i).sum()) for i in (1, 2, 3, 4))


_BLOCK = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_COUNTED = pa.schema([("payload", pa.binary()), ("n1", pa.int64()), ("n2", pa.int64()), ("n3", pa.int64()), ("n4", pa.int64()), ("begin", pa.float64())])
_COUNTED_DDL = "payload binary, n1 long, n2 long, n3 long, n4 long, begin double"


def count_ngrams(docs: DataFrame, folder: str = "") -> DataFrame:
    """Trigrams of all texts and how often they occur, in one packed row for each shard of contexts."""
    shards = _shards(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=BLOCK_BYTES):
            keys, counts = np.unique(trigrams(*text_buffer(part.column(0)))[1], return_counts=True)
            dealt = _dealt(_shard(keys >> np.uint64(BITS), shards), keys, counts.astype(np.uint32))
            yield _rows([(s, 0, _pack(_steps(k), c)) for s, (k, c) in dealt], _BLOCK)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_unpack(x["payload"]) for x in _pieces(batches)]
        if found:
            keys, counts = _totals(np.concatenate([_sums(k) for k, _ in found]), np.concatenate([c for _, c in found]).astype(np.int64))
            yield _rows([(_pack(_steps(keys), counts), *_counts_of(counts), None)], _COUNTED)

    blocks = map_arrow(docs.select("text"), run, "shard int, kind int, payload binary").repartitionById(shards, F.col("shard"))
    return save(map_arrow(blocks, merge, _COUNTED_DDL), folder=folder)


def _discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, from the counts of counts.

    Always above zero, so that no symbol is impossible.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [i - (i + 1) * y * b / a if a else 0.0 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([d if 0 < d < i else FALLBACK[i - 1] for i, d in enumerate(raw, 1)])


def discounts(counted: DataFrame) -> np.ndarray:
    row = counted.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in (1, 2, 3, 4)]).first()
    return _discounts(*map(float, row))


def _left(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts less their discounts."""
    return c - d[np.minimum(c, 3) - 1]


class Model(NamedTuple):
    """The table of n-grams, and counts by symbol, bounded by the alphabet.

    `table` has a packed row for each shard of bigrams: bigrams (by differences), the
    number of symbols seen before each, places and log weights of those that are contexts
    of weight other than one; then trigrams as bigram, first symbol (by differences), what
    the context leaves to each by its weight, counts.
    """

    table: DataFrame
    shards: int
    symbols: bytes  # packed, since Spark keeps a copy on the disk of each executor
    begin: float  # log weight of the start of a text
    sizes: list[tuple[int, int]]  # (count, n-grams that have it), counts up to 2^16


_LOW, _BOTH, _B = np.uint64(ALPHABET - 1), np.uint64((1 << 2 * BITS) - 1), np.uint64(BITS)


class Symbols(NamedTuple):
    """By symbol: log-probability, log weight as a context, sum of the counts of bigrams that
    begin with it, whether one ends with it; and the discounts of bigrams."""

    base: np.ndarray
    back: np.ndarray
    first: np.ndarray
    seen: np.ndarray
    cut: np.ndarray


@lru_cache(maxsize=2)
def _symbols(data: bytes) -> Symbols:
    w, ends, begins, n1, n2, n3, cut = _unpack(data)
    w = _sums(w).astype(np.int64)
    last, head = ends > 0, begins > 0
    own = _left(ends[last], _discounts(*_counts_of(ends))) / max(1, int(ends.sum()))
    rest = 1 - own.sum() if last.any() else 1.0
    base, back, first, seen = np.full(ALPHABET, np.log(rest / ALPHABET)), np.zeros(ALPHABET), np.zeros(ALPHABET, np.int64), np.zeros(ALPHABET, bool)
    base[w[last]] = np.log(own + rest / ALPHABET)
    back[w[head]] = np.log((cut @ np.stack([n1, n2, n3])[:, head]) / begins[head])
    first[w[head]], seen[w[last]] = begins[head], True
    return Symbols(base, back, first, seen, cut)


@lru_cache(maxsize=2)
def _held(data: bytes) -> tuple[np.ndarray, ...]:
    """Held bigrams, their gains, whether trigrams of them aren't held; held trigrams, their gains."""
    two, gain2, rest, three, gain3 = _unpack(data)
    return _sums(two), gain2, rest > 0, _sums(three), gain3


def _bigram_gains(tails: np.ndarray, c: np.ndarray, at: np.ndarray, weights: np.ndarray, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the last symbol of each bigram, and the bigram's gain."""
    base, back, first, _, cut = symbols
    head, last = (tails >> _B).astype(np.int64), (tails & _LOW).astype(np.int64)
    below = np.exp(back[head] + base[last])
    p = _left(c.astype(np.int64), cut) / first[head] + below
    gain = np.log(p / below)
    gain[at] += weights
    return p, gain


def model(three: DataFrame, cutoff: int = CUTOFF, folder: str = "") -> Model:
    """The model of the counted trigrams, of which those of `cutoff` and more are kept as such."""
    spark = three.sparkSession
    shards, d3 = _shards(spark), discounts(three)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is known where all trigrams of a context are together."""
        for x in _pieces(batches):
            keys, c = _unpack(x["payload"])
            keys = _sums(keys)
            tails, n = np.unique(keys & _BOTH, return_counts=True)
            rows = [(s, 0, _pack(_steps(k), m)) for s, (k, m) in _dealt(_shard(tails, shards), tails, n.astype(np.uint32))]
            context = keys >> _B
            at = _runs(context)
            which = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
            left = np.where(c >= cutoff, _left(c, d3), 0.0)
            total, gone = np.add.reduceat(c, at), np.add.reduceat(left, at)
            weight = 1 - gone / total
            some = gone > 0
            x, w = context[at][some], np.log(weight[some])
            rows += [(s, 1, _pack(_steps(k), m)) for s, (k, m) in _dealt(_shard(x, shards), x, w)]
            kept = c >= cutoff
            share = (left / (total * weight)[which])[kept]
            turned = ((keys & _BOTH) << _B | keys >> _B >> _B)[kept]
            order = np.argsort(turned)
            turned, share, c = turned[order], share[order], c[kept][order]
            rows += [(s, 2, _pack(_steps(k), m, n)) for s, (k, m, n) in _dealt(_shard(turned >> _B, shards), turned, share, c.astype(np.uint32))]
            yield _rows(rows, _BLOCK)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[], [], []]
        for x in _pieces(batches):
            data = _unpack(x["payload"])
            found[x["kind"]].append([_sums(data[0]), *data[1:]])
        if not found[0]:
            # Only the start of a text is a context and never the end of a trigram.
            if found[1]:
                yield _rows([(None, 0, 0, 0, 0, float(found[1][0][1][0]))], _COUNTED)
            return
        two, c = _totals(*[np.concatenate(x) for x in zip(*found[0], strict=True)])
        x, w = [np.concatenate(x) for x in zip(*found[1], strict=True)] if found[1] else (two[:0], np.zeros(0))
        start = x == np.uint64(START << BITS | START)
        at, _ = _find(x[~start], two)
        begin = float(w[start][0]) if start.any() else None
        three, share, n = [np.concatenate(x) for x in zip(*found[2], strict=True)] if found[2] else (two[:0], np.zeros(0), np.zeros(0, np.uint32))
        by, order = np.argsort(at), np.argsort(three)
        packed = _pack(_steps(two), c.astype(np.uint32), at[by].astype(np.uint32), w[~start][by], _steps(three[order]), share[order], n[order])
        yield _rows([(packed, *_counts_of(c), begin)], _COUNTED)

    def by_symbol(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(w, ends, begins, n1, n2, n3) of bigrams; under -c, how many n-grams have c as count."""
        sums, sizes = np.zeros((5, ALPHABET), np.int64), np.zeros((1 << 16) + 1, np.int64)
        for x in _pieces(batches):
            two, c, _, _, _, _, n = _unpack(x["payload"])
            two, c = _sums(two), c.astype(np.int64)
            head, last = (two >> _B).astype(np.int64), (two & _LOW).astype(np.int64)
            sums[0] += np.bincount(last, minlength=ALPHABET)
            sums[1] += np.bincount(head, c, ALPHABET).astype(np.int64)
            for i in (1, 2, 3):
                sums[1 + i] += np.bincount(head[np.minimum(c, 3) == i], minlength=ALPHABET)
            for y in (c, n.astype(np.int64)):
                sizes += np.bincount(np.minimum(y, 1 << 16), minlength=len(sizes))
        w, s = np.flatnonzero(sums[:2].any(0)), np.flatnonzero(sizes)
        none = np.zeros(len(s), np.int64)
        columns = [np.concatenate([w, -s]), np.concatenate([sums[0][w], sizes[s]]), *[np.concatenate([x[w], none]) for x in sums[1:]]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["w", "ends", "begins", "n1", "n2", "n3"])

    table = save(map_arrow(map_arrow(three, heads, "shard int, kind int, payload binary").repartitionById(shards, F.col("shard")), tails, _COUNTED_DDL), folder=folder)
    cut, begin = discounts(table), table.agg(F.max("begin")).first()[0]
    table = table.where("payload IS NOT NULL")
    rows = map_arrow(table.coalesce(STAT_TASKS), by_symbol, "w long, ends long, begins long, n1 long, n2 long, n3 long")
    rows = save(rows.groupBy("w").agg(*[F.sum(x).alias(x) for x in ("ends", "begins", "n1", "n2", "n3")]), folder=folder).toArrow()
    w, *counts = [rows[x].to_numpy() for x in ("w", "ends", "begins", "n1", "n2", "n3")]
    sizes = list(zip((-w[w < 0]).tolist(), counts[0][w < 0].tolist(), strict=True))
    order = np.argsort(w)[(w < 0).sum() :]
    packed = _pack(_steps(w[order].astype(np.uint64)), *[c[order] for c in counts], cut)
    return Model(table, shards, packed, begin or 0.0, sizes)


def _least(sizes: list[tuple[int, int]], held: int) -> int:
    """The least count of which no more than `held` n-grams have as many."""
    total = 0
    for c, n in sorted(sizes, reverse=True):
        total += n
        if total > held:
            return c + 1
    return 0


def _table(payload: bytes, symbols: Symbols) -> tuple[np.ndarray, ...]:
    """Bigrams, counts, gains, log weights as contexts; trigrams by bigram, counts, gains."""
    two, c, at, weights, three, share, n = _unpack(payload)
    two, three = _sums(two), _sums(three)
    p, gain = _bigram_gains(two, c, at, weights, symbols)
    log = np.zeros(len(two))
    log[at] = weights
    return two, c, gain, log, three, n, np.log1p(share / p[_find(three >> _B, two)[0]])


_MOVED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("slice", pa.int64()), ("mark", pa.int64()), ("payload", pa.binary())])
_MOVED_DDL = "shard int, kind int, slice long, mark long, payload binary"
#: Kinds of moved rows: the model's n-grams before a document's, what tasks add up alone, sums.
_GRAMS, _ASKED, _OWN, _SUMS = range(4)


def score(docs: DataFrame, known: Model, held_grams: int = HELD_GRAMS, passes: int = PASSES) -> DataFrame:
    """doc_id, lang, n_symbols and log_perplexity (null without a symbol) for each row.

    Documents are scored in `passes` parts by a hash, one after the other, so that only a
    part's n-grams lie on disk at once; each text is taken apart once.
    """
    spark = docs.sparkSession
    least, shards, begin = _least(known.sizes, held_grams), known.shards, known.begin
    symbols = spark.sparkContext.broadcast(known.symbols)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The held n-grams; rest: whether the table has trigrams of a bigram that aren't held."""
        for x in _pieces(batches):
            two, c, gain, _, three, n, gain3 = _table(x["payload"], _symbols(symbols.value))
            rest = np.zeros(len(two), bool)
            rest[_find(three[n < least] >> _B, two)[0]] = True
            a, b = c >= least, n >= least
            columns = [np.concatenate([two[a], three[b]]).view(np.int64), np.concatenate([gain[a], gain3[b]]), np.concatenate([rest[a], np.zeros(b.sum(), bool)]), np.concatenate([np.ones(a.sum(), bool), np.zeros(b.sum(), bool)])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k", "gain", "rest", "two"])

    top = map_arrow(known.table, frequent, "k long, gain double, rest boolean, two boolean").toArrow().sort_by("k")
    is_two = top["two"].to_numpy()
    keys, gains, more = top["k"].to_numpy().view(np.uint64), top["gain"].to_numpy(), top["rest"].to_numpy()
    frequents = spark.sparkContext.broadcast(_pack(_steps(keys[is_two]), gains[is_two], more[is_two].astype(np.uint8), _steps(keys[~is_two]), gains[~is_two]))

    def place(tails: np.ndarray, turned: np.ndarray, held: np.ndarray) -> np.ndarray:
        """By bigram, but by trigram for bigrams that are held, which are frequent."""
        return _shard(np.where(held, turned, tails), shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams that tasks don't hold, to their shards."""
        have2 = _held(frequents.value)[0]
        for x in _pieces(batches):
            two, c, _, log, three, n, gain3 = _table(x["payload"], _symbols(symbols.value))
            a, b = c < least, n < least
            rows = []
            for s, (k, m, w) in _dealt(_shard(two[a], shards), two[a], c[a], log[a]):
                at = np.flatnonzero(w)
                rows.append((s, _GRAMS, -1, 0, _pack(_steps(k), m, at.astype(np.uint32), w[at])))
            three, gain3 = three[b], gain3[b]
            to = place(three >> _B, three, _find(three >> _B, have2)[1])
            rows += [(s, _GRAMS, -2, 0, _pack(_steps(k), g)) for s, (k, g) in _dealt(to, three, gain3)]
            yield _rows(rows, _MOVED)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task can add up alone, and each slice's n-grams that it can't."""
        base, back, total, ends, _ = _symbols(symbols.value)
        begins = total > 0
        have2, gain2, rest2, have3, gain3 = _held(frequents.value)
        task = TaskContext.get().partitionId()
        for i, part in enumerate(text_slices(batches, limit=BLOCK_BYTES)):
            buf, offsets = text_buffer(part.column(2))
            doc, key = trigrams(buf, offsets)
            n = np.bincount(doc, minlength=part.num_rows)
            w1, w2, w3 = (key >> _B >> _B).astype(np.int64), (key >> _B & _LOW).astype(np.int64), (key & _LOW).astype(np.int64)
            sums = np.bincount(doc, base[w3] + back[w2], part.num_rows) + begin * (n > 0)
            # Symbols that begin no bigram of the model begin no trigram of it.
            turned = (key & _BOTH) << _B | np.where(begins[w1], w1, 0).astype(np.uint64)
            order = np.argsort(turned)
            turned, doc = turned[order], doc[order]
            first = _runs(turned)
            times = np.diff(np.append(first, len(turned)))
            turned = turned[first]
            tails = turned >> _B
            at2, hit2 = _find(tails, have2)
            at3, hit3 = _find(turned, have3)
            gain = np.zeros(len(turned))
            gain[hit2] += gain2[at2[hit2]]
            gain[hit3] += gain3[at3[hit3]]
            sums += np.bincount(doc, np.repeat(gain, times), part.num_rows)
            asked = begins[(tails >> _B).astype(np.int64)] & ends[(tails & _LOW).astype(np.int64)] & ~hit2
            if len(have2):
                asked |= hit2 & rest2[at2] & ~hit3 & (turned & _LOW > 0)
            to = place(tails[asked], turned[asked], hit2[asked])
            all_asked = np.repeat(asked, times)
            by_doc = dict(_dealt(np.repeat(to, times[asked]), doc[all_asked].astype(np.uint16 if part.num_rows <= 1 << 16 else np.uint32)))
            mark = zlib.crc32(buf, zlib.crc32(offsets.tobytes()))
            at = task << 32 | i
            sink = pa.BufferOutputStream()
            held = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(sums)], ["doc_id", "lang", "n_symbols", "own"])
            with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(held)
            rows = [(at % shards, _OWN, at, mark, sink.getvalue().to_pybytes())]
            rows += [(s, _ASKED, at, mark, _pack(_steps(k), m, by_doc[s][0])) for s, (k, m) in _dealt(to, turned[asked], times[asked].astype(np.uint32))]
            yield _rows(rows, _MOVED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of gains that a shard adds to the documents of each slice."""
        have: dict[int, list] = {-1: [], -2: []}
        table = None
        for x in _pieces(batches):
            if x["kind"] == _GRAMS:
                data = _unpack(x["payload"])
                keys = _sums(data[0])
                have[x["slice"]].append((keys, data[1] if x["slice"] == -2 else _bigram_gains(keys, *data[1:], _symbols(symbols.value))[1]))
                continue
            if x["kind"] == _ASKED:
                if table is None:
                    table = []
                    for side in (-1, -2):
                        keys = np.concatenate([k for k, _ in have[side]]) if have[side] else np.zeros(0, np.uint64)
                        gains = np.concatenate([g for _, g in have[side]]) if have[side] else np.zeros(0)
                        order = np.argsort(keys)
                        table += [keys[order], gains[order]]
                turned, times, doc = _unpack(x["payload"])
                turned = _sums(turned)
                gain = np.zeros(len(turned))
                for keys, (names, gains) in ((turned >> _B, table[:2]), (turned, table[2:])):
                    at, hit = _find(keys, names)
                    gain[hit] += gains[at[hit]]
                some = np.repeat(gain != 0, times)
                doc = doc[some].astype(np.int64)
                sums = np.bincount(doc, np.repeat(gain, times)[some])
                rows = np.unique(doc)
                x |= {"kind": _SUMS, "payload": _pack(rows.astype(np.uint32), sums[rows])}
            yield _rows([tuple(x[f.name] for f in _MOVED)], _MOVED)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's rows, which come first, with the sums of all shards."""
        at = rows = sums = mark = None

        def done() -> pa.RecordBatch:
            n = rows.column(2).to_numpy()
            return pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(-sums / np.maximum(n, 1), mask=n == 0)], ["doc_id", "lang", "n_symbols", "log_perplexity"])

        for x in _pieces(batches):
            if x["kind"] == _OWN:
                if rows is not None:
                    yield done()
                at, mark = x["slice"], x["mark"]
                rows = pa.ipc.open_stream(x["payload"]).read_next_batch()
                sums = rows.column(3).to_numpy().copy()
                continue
            if (x["slice"], x["mark"]) != (at, mark):
                raise RuntimeError("the rows of the documents came in another order when a task ran again")
            i, more = _unpack(x["payload"])
            sums[i] += more
        if rows is not None:
            yield done()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    grams = map_arrow(known.table, deal, _MOVED_DDL)
    scored = None
    for i in range(passes):
        some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(passes)) == i).select("doc_id", "lang", "text")
        rows = map_arrow(some, own, _MOVED_DDL).unionAll(grams).repartitionById(shards, F.col("shard")).sortWithinPartitions("kind")
        rows = map_arrow(rows, answer, _MOVED_DDL).repartition(shards, "slice").sortWithinPartitions("slice", "kind")
        out = save(map_arrow(rows, add, f"doc_id {id_type}, lang string, n_symbols long, log_perplexity double"))
        scored = scored.unionAll(out) if scored is not None else out
    symbols.destroy()
    frequents.destroy()
    return scored


def _judged() -> Column:
    """Log-perplexity less what chance may add to a short text's."""
    return F.col("log_perplexity") - CONFIDENCE / F.sqrt(F.greatest("n_symbols", F.lit(1)))


def thresholds(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold): the quantile of judged log-perplexities, of all for lang null.

    Read from counts in bins of BIN, so it is exact to a bin and needs no sort of rows.
    """
    bins = scores.where("log_perplexity IS NOT NULL").select(F.explode(F.array("lang", F.lit(None).cast("string"))).alias("lang"), F.ceil(_judged() / BIN).alias("bin"))
    counted = bins.groupBy("lang", "bin").count()
    run = Window.partitionBy("lang").orderBy("bin")
    cum = counted.withColumn("below", F.sum("count").over(run)).withColumn("total", F.sum("count").over(Window.partitionBy("lang")))
    cut = cum.where(F.col("below") >= F.ceil(F.col("total") * quantile)).groupBy("lang").agg(F.min("bin").alias("bin"), F.max("total").alias("total"))
    return cut.where(F.col("lang").isNull() | (F.col("total") >= MIN_TRUSTED)).select("lang", (F.col("bin") * BIN).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, cutoff: int = CUTOFF, held_grams: int = HELD_GRAMS, held_ids: int = HELD_IDS) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and kept for every document.

    Trusted text is every document with a label of quality 1 and none of quality 0; one
    in HELD_OUT of them by id is not counted and gives the thresholds instead. A language
    with fewer than MIN_TRUSTED held-out documents, or null, takes the threshold of all
    of them; with none at all, the threshold is null and every text with a symbol is kept;
    with no trusted text, perplexity is that of a uniform model. A text that is null or
    has no symbol has null perplexity and isn't kept. Equal rows get equal results; null
    ids are carried along and are never trusted; other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    trusted = save(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("trusted_id"), (F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0).alias("out")))
    few = trusted.limit(held_ids + 1).count() <= held_ids
    known = F.broadcast(trusted) if few else trusted
    learned = src.join(known.where("NOT out"), F.col("doc_id") == F.col("trusted_id"), "left_semi")
    with scratch(docs.sparkSession) as folder:
        # The counts go when the model is made of them.
        with scratch(docs.sparkSession) as counts:
            known_grams = model(count_ngrams(learned, counts), cutoff, folder)
        scores = score(src, known_grams, held_grams=held_grams)
    cuts = thresholds(scores.join(known.where("out"), F.col("doc_id") == F.col("trusted_id"), "left_semi"), quantile)
    by_lang = cuts.where("lang IS NOT NULL").select(F.col("lang").alias("cut_lang"), F.col("threshold").alias("own"))
    general = cuts.where("lang IS NULL").agg(F.max("threshold").alias("general"))
    # One row for each language: bounded by the labels, not by the documents.
    out = scores.join(F.broadcast(by_lang), F.col("lang") == F.col("cut_lang"), "left").join(F.broadcast(general))
    limit = F.coalesce("own", "general")
    kept = F.col("log_perplexity").isNotNull() & F.coalesce(_judged() <= limit, F.lit(True))
    allowed = limit + CONFIDENCE / F.sqrt(F.greatest("n_symbols", F.lit(1)))
    return out.select("doc_id", "lang", "n_symbols", F.exp("log_perplexity").alias("perplexity"), F.exp(allowed).alias("threshold"), kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
