"""SimHash near-dedup by Golay-code fuzzy hashing.

A document's 64-bit fingerprint has a bit set where over half of its shingle hashes do.
The fingerprint is cut into three segments of at most 23 bits. The binary Golay code
[23, 12, 7] is perfect, so each segment, and each segment with one bit turned, decodes to
exactly one codeword; the set of those codeword indices (one to six in most cases) is the
segment's fuzzy key set. Segments that differ in two bits or fewer share a key: the word
half way between them decodes to a codeword that is in both sets. Of four differing bits
over three segments, the two least damaged segments hold two at most (pigeonhole), so
some pair of segments shares a pair of keys. Fingerprints with a common key pair meet in
one bucket and their distance is verified; no link within four bits is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widegrain.llm import kernels
from widegrain.llm.common import map_arrow, save, text_buffer, text_slices
from widegrain.llm.components import Forest, connected_components

U64 = np.uint64
#: Generator polynomial of the binary Golay code [23, 12, 7] (fixed value).
GOLAY_POLY = 0b110001110101
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 4
#: A bucket of more fingerprints is split into chunks that are compared two at a time.
BUCKET_ROWS = 8192
#: Such buckets whose sizes are broadcast (16 bytes each); more are joined by shuffle.
HELD_BUCKETS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every text's shingles in order, the texts that have any, and how many each has."""
    buf = _LOWER[buf]
    starts, ends, first = kernels.word_spans(buf, offsets)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined, _ = kernels.join_spans(buf, starts, ends, np.diff(first))
    lens = ends - starts
    word_at = np.cumsum(lens + 1) - lens - 1
    words = np.diff(first)
    # A text of fewer words than a shingle is one shingle.
    count = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    held = np.flatnonzero(count)
    head = np.repeat(first[held], count[held]) + _within(count[held])
    last = np.minimum(head + shingle, np.repeat(first[held + 1], count[held])) - 1
    h = kernels.xxh64_spans(np.frombuffer(joined, np.uint8), word_at[head], word_at[last] + lens[last] - word_at[head])
    return h, held, count[held]


def fingerprints_of(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints of many texts (UTF-8 bytes and offsets)."""
    h, held, count = shingle_hashes(buf, offsets, shingle)
    counts = np.zeros(len(offsets) - 1, np.int64)
    counts[held] = count
    return set_bits(h, counts)


def set_bits(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of `counts` hashes in order, the bits set in over half of them."""
    out = np.zeros(len(counts), U64)
    held = np.flatnonzero(counts)
    if not len(held):
        return out
    count = counts[held]
    group_at = np.cumsum(count) - count
    votes = np.zeros((len(held), 64), np.int64)
    step = 1 << 16
    for lo in range(0, len(h), step):
        part = h[lo : lo + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a = int(np.searchsorted(group_at, lo, "right")) - 1
        b = int(np.searchsorted(group_at, lo + len(part), "left"))
        cut = np.maximum(group_at[a:b] - lo, 0)
        votes[a:b] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    over = (2 * votes > count[:, None]).astype(np.uint8)
    out[held] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _within(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document; fp is the 64-bit fingerprint as a long.

    Null and wordless texts have fingerprint zero. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            buf, off = text_buffer(part.column(1))
            fp = fingerprints_of(buf, off, shingle)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(src, run, "doc_id long, fp long")


class Golay:
    """Nearest-codeword decoding of 23-bit words through syndrome tables."""

    def __init__(self):
        def remainder(x: np.ndarray) -> np.ndarray:
            for bit in range(22, 10, -1):
                x = np.where((x >> bit) & 1, x ^ (GOLAY_POLY << (bit - 11)), x)
            return x

        self.low = remainder(np.arange(1 << 12)).astype(np.int32)
        self.high = remainder(np.arange(1 << 11) << 12).astype(np.int32)
        errors = np.array([sum(1 << b for b in c) for w in range(4) for c in combinations(range(23), w)])
        self.error = np.zeros(1 << 11, np.int32)
        self.error[remainder(errors)] = errors

    def index(self, words: np.ndarray) -> np.ndarray:
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> 11

    def keys(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, bits + 1) sorted codeword indices of each word and of its one-bit neighbours; a mask of the distinct ones."""
        flips = np.array([0] + [1 << i for i in range(bits)], np.int32)
        k = np.sort(self.index(words.astype(np.int32)[:, None] ^ flips), axis=1)
        fresh = np.ones(k.shape, bool)
        fresh[:, 1:] = k[:, 1:] != k[:, :-1]
        return k, fresh


def bucket_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every bucket that each fingerprint belongs to."""
    per = [golay.keys((fp >> U64(at)) & U64((1 << bits) - 1), bits) for at, bits in SEGMENTS]
    rows, keys = [], []
    for n, (a, b) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (ka, fa), (kb, fb) = per[a], per[b]
        r, i, j = np.nonzero(fa[:, :, None] & fb[:, None, :])
        rows.append(r)
        keys.append((n << 24) | (ka[r, i].astype(np.int64) << 12) | kb[r, j])
    return np.concatenate(rows), np.concatenate(keys)


def bucket_links(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (row pairs) of the links inside each run of equal `group`."""
    forest = Forest(len(fp))
    alive = np.arange(len(fp))
    d = 1
    while True:
        alive = alive[alive + d < len(fp)]
        alive = alive[group[alive] == group[alive + d]]
        if not len(alive):
            return forest.edges()
        near = alive[np.bitwise_count(fp[alive] ^ fp[alive + d]) <= max_bits]
        if len(near):
            forest.add(near, near + d)
        d += 1


def fingerprint_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links between distinct fingerprints `fp` that differ in at most `max_bits` bits.

    The links of one bucket are thinned to a spanning forest, which keeps its connected
    components; all pairs are compared, none are emitted beyond the forest.
    """
    if not 0 < max_bits <= MAX_BITS:
        raise ValueError("the key scheme covers up to four differing bits")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                fp = batch.column(0).slice(lo, 1024).to_numpy(zero_copy_only=False).view(U64)
                rows, keys = bucket_keys(fp, golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows].view(np.int64))], ["k", "fp"])

    keyed = map_arrow(classes.select("fp"), expand, "k long, fp long")
    large = keyed.groupBy("k").count().where(F.col("count") > BUCKET_ROWS)
    large = save(large.select("k", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("m")))
    few = large.limit(HELD_BUCKETS + 1).count() <= HELD_BUCKETS
    dealt = keyed.join(F.broadcast(large) if few else large, "k", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            change = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:3]], axis=0)) + 1
            cut = int(change[-1]) if len(change) else 0
            rest = [c[cut:] for c in cols]
            if cut:
                yield linked([c[:cut] for c in cols])
        if rest is not None and len(rest[0]):
            yield linked(rest)

    def linked(cols: list[np.ndarray]) -> pa.RecordBatch:
        new = np.zeros(len(cols[0]), np.int64)
        new[1:] = np.any([np.diff(c) != 0 for c in cols[:3]], axis=0)
        a, b = bucket_links(np.cumsum(new), cols[3].view(U64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(cols[3][a]), pa.array(cols[3][b])], ["a", "b"])

    return map_arrow(dealt, compare, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 5, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): near-duplicate groups of `docs`.

    component_id is the least doc_id reachable over links of `max_bits` or fewer
    differing bits, the document's own included. Documents of equal fingerprint are one
    class, so copies cost one row, however many there are. Null ids stay null and take
    the group's least id; repeated rows get the same result; an empty table gives none.
    """
    prints = save(fingerprints(docs, shingle, id_col, text_col))
    classes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = connected_components(fingerprint_links(classes, max_bits))
    rooted = classes.join(groups, classes["fp"] == groups["node"], "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = save(rooted.join(least, "root").select(F.col("fp").alias("class_fp"), "component_id"))
    return prints.join(by_class, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


def simhash_keep_first(docs: DataFrame, shingle: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """`docs` with one document of each near-duplicate group, the one of least doc_id.

    Rows without a doc_id can't be ranked and stay. All columns are returned unchanged.
    """
    found = simhash_components(docs, shingle, max_bits)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract columns of op10 over all documents: four-word shingles, four bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_components(docs, shingle=4, max_bits=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
