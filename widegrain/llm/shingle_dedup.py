"""SimHash near-dedup with links held to an exact Jaccard similarity of word-shingle sets.

Candidates come from Golay-code fuzzy hashing of SimHash fingerprints (`simhash_dedup`),
which finds what differs by up to four of 64 bits: most copies, but few of the pairs at a
similarity of 0.8, which differ by about ten. The others are found by prefix filtering.

All shingles have one order: those that a sample of documents holds often come last, the
others by hash. Two sets with Jaccard >= t share one of their first n - ceil(t n) + 1
shingles in any such order, so documents meet in the buckets of these alone and no pair
is missed; the sample only decides how many pairs meet. Pairs of a bucket pass three
bounds that no true pair fails (sizes, places in the order, parity bits of the sets), then
a sharper one (parity bits as long as the sets), and the rest are verified on the sets. The fuzzy hashes' pairs and a few pairs for each
row of a bucket are verified first; pairs that these connect aren't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widegrain.llm import kernels
from widegrain.llm.common import SLICE_BYTES, map_arrow, save, text_buffer, text_slices
from widegrain.llm.components import connected_components
from widegrain.llm.simhash_dedup import BUCKET_ROWS, HELD_BUCKETS, U64, fingerprint_links, set_bits, shingle_hashes

#: Least Jaccard similarity of a link, as a fraction.
NUM, DEN = 4, 5
#: Documents whose shingles are counted for the order, and the least count that is noted.
SAMPLE_DOCS = 10_000
OFTEN = 4
#: Neighbours that each row of a bucket meets before all pairs do.
NEIGHBOURS = 4
#: Nodes up to which they are broadcast to find their texts; beyond it texts are shuffled.
HELD_NODES = 2_000_000
PARITY = ("b0", "b1", "b2", "b3")
NO_ID = (1 << 63) - 1


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, in the common order within a text."""
    h, held, count = shingle_hashes(buf, offsets, shingle)
    doc = np.repeat(held, count)
    rank = np.zeros(len(h), np.int64)
    if len(often) and len(h):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        rank = np.where(often[at] == h, counts[at], 0)
    order = np.lexsort((h, rank, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def node_keys(doc: np.ndarray, h: np.ndarray, n_texts: int) -> np.ndarray:
    """A hash of each text's set; zero for an empty one."""
    out = np.zeros(n_texts, U64)
    held, at = np.unique(doc, return_index=True)
    if len(held):
        out[held] = kernels.mix(np.add.reduceat(kernels.mix(h ^ U64(kernels.WORD_BASE)), at))
    return out.view(np.int64)


def prefix_size(n):
    return n - -(-NUM * n // DEN) + 1


def parities(h: np.ndarray) -> np.ndarray:
    """For each of two to four times as many classes of hashes as the set has, whether it
    holds an odd number of the class, as packed bits."""
    size = max(256, 1 << (2 * len(h)).bit_length())
    bits = np.zeros(size, np.uint8)
    np.bitwise_xor.at(bits, (kernels.mix(h) & U64(size - 1)).astype(np.int64), 1)
    return np.packbits(bits)


def parity_gap(x: np.ndarray, y: np.ndarray) -> int:
    """Classes in which the parities of two sets differ: no more than elements that do."""
    # A class of the smaller sketch is some classes of the larger one together.
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a sample hold, sorted, and their counts."""
    every = max(1, docs.count() // SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, U64)
        for part in text_slices(batches, limit=SLICE_BYTES // 2):
            _, h = shingle_sets(*text_buffer(part.column(0)), shingle, none, none)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")
    counted = map_arrow(some, run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).toArrow()
    h = counted["h"].to_numpy().view(U64)
    order = np.argsort(h)
    return h[order], counted["n"].to_numpy()[order]


def _near(n: tuple, place: tuple, bits: tuple) -> np.ndarray:
    """Pairs that no bound rules out: overlap o >= t/(1+t) (n1+n2) is needed."""
    (n1, n2), (p1, p2) = n, place
    both = n1 + n2
    near = (NUM + DEN) * np.minimum(n1 - p1, n2 - p2) >= NUM * both
    apart = sum(np.bitwise_count(x ^ y).astype(np.int64) for x, y in zip(*bits))
    return near & ((NUM + DEN) * apart <= (DEN - NUM) * both)


def bucket_pairs(group: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, bits: list[np.ndarray], reach: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs in each run of equal `group` that may be links, not yet of one root."""
    alive, d = np.arange(len(node)), 1
    while reach is None or d <= reach:
        alive = alive[alive + d < len(node)]
        alive = alive[group[alive] == group[alive + d]]
        if not len(alive):
            return
        a = alive[root[alive] != root[alive + d]]
        b = a + d
        ok = _near((n[a], n[b]), (place[a], place[b]), ([x[a] for x in bits], [x[b] for x in bits]))
        if ok.any():
            yield a[ok], b[ok]
        d += 1


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, cut only where one of the first `keys` columns changes."""
    rest = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        change = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:keys]], axis=0)) + 1
        cut = int(change[-1]) if len(change) else 0
        rest = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _candidates(shared: DataFrame, reach: int | None) -> DataFrame:
    """Distinct (a, b) of `shared` (k, node, n, place, parity, root) that may be links."""
    large = shared.groupBy("k").count().where(F.col("count") > BUCKET_ROWS)
    large = save(large.select("k", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("m")))
    few = large.limit(HELD_BUCKETS + 1).count() <= HELD_BUCKETS
    dealt = shared.join(F.broadcast(large) if few else large, "k", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "node", "n", "place", "root", *PARITY)
    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, i, j, node, n, place, root, *bits in _runs(batches, 3):
            bits = [b.view(U64) for b in bits]  # bitwise_count takes the magnitude of a signed number
            new = np.zeros(len(k), np.int64)
            new[1:] = np.any([np.diff(c) != 0 for c in (k, i, j)], axis=0)
            for a, b in bucket_pairs(np.cumsum(new), node, root, n.astype(np.int64), place.astype(np.int64), bits, reach):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return map_arrow(dealt, run, "a long, b long").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The pairs whose sets have Jaccard >= NUM / DEN."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    at = classes.join(wanted, "node").select("node", F.col("at.doc").alias("d"), F.col("at.part").alias("p"))
    at = save(at)
    few = at.limit(HELD_NODES + 1).count() <= HELD_NODES
    texts = rows.join(F.broadcast(at) if few else at, (F.col("doc") == F.col("d")) & (F.col("part") == F.col("p"))).select("node", "text").dropDuplicates(["node"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, U64)
        for part in text_slices(batches, limit=SLICE_BYTES // 2):
            doc, h = shingle_sets(*text_buffer(part.column(1)), shingle, none, none)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            sketch = [parities(h[x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(cut)), pa.array(sketch, pa.binary()), pa.array([h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["node", "n", "p", "s"]
            )

    held = save(map_arrow(texts, sets, "node long, n long, p binary, s binary"))

    def sides(of: DataFrame, *cols: str) -> DataFrame:
        left, right = (held.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in cols]) for x in "ab")
        return of.join(left, "a").join(right, "b")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose parities allow the overlap; whole sets are moved for these alone."""
        for batch in batches:
            ok = []
            for na, nb, x, y in zip(*[batch.column(c).to_pylist() for c in range(2, 6)]):
                ok.append((NUM + DEN) * parity_gap(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= (DEN - NUM) * (na + nb))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    close = save(map_arrow(sides(pairs, "n", "p").select("a", "b", "na", "nb", "pa", "pb"), likely, "a long, b long"))
    both = sides(close, "s")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                o = len(np.intersect1d(x, y, assume_unique=True))
                ok.append((NUM + DEN) * o >= NUM * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return save(map_arrow(both.select("a", "b", "sa", "sb"), check, "a long, b long"))


def _fuzzy_pairs(classes: DataFrame) -> DataFrame:
    """(a, b) nodes of near fingerprints: each with the first of its own fingerprint, and
    these along the forest of links that fuzzy hashing finds; a pair may lack similarity."""
    heads = save(classes.groupBy("fp").agg(F.min("node").alias("head")))
    own = classes.select("node", F.col("fp").alias("f")).join(heads, F.col("f") == F.col("fp")).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(heads).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    left, right = (heads.select(F.col("fp").alias(f"h{x}"), F.col("head").alias(x)) for x in "ab")
    found = links.join(left, F.col("fa") == F.col("ha")).join(right, F.col("fb") == F.col("hb"))
    return own.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def shingle_components(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, component_id): groups of documents over links of Jaccard >= NUM / DEN.

    component_id is the least doc_id of the group. Documents of equal sets are one node;
    null and wordless texts have the empty set, which only links to itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    often, counts = common_shingles(rows, shingle)
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("part", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE_BYTES // 2):
            size = batch.num_rows
            doc, h = shingle_sets(*text_buffer(batch.column(1)), shingle, often, counts)
            cut = np.searchsorted(doc, np.arange(size + 1))
            n = np.diff(cut)
            bits = np.zeros(size * 256, np.uint8)
            np.bitwise_xor.at(bits, doc * 256 + (kernels.mix(h) >> U64(56)).astype(np.int64), 1)
            words = np.packbits(bits.reshape(size, 256), axis=1, bitorder="little").view("<i8")
            take = np.where(n > 0, prefix_size(n), 0)
            place = np.arange(len(h)) - cut[doc]
            first = h[place < take[doc]].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(first))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(node_keys(doc, h, size)), pa.array(n, pa.int32()), pa.array(set_bits(h, n).view(np.int64)), *[pa.array(words[:, i].copy()) for i in range(4)], lists],
                ["doc_id", "doc", "part", "node", "n", "fp", *PARITY, "first"],
            )

    prints = save(map_arrow(rows, run, "doc_id long, doc long, part long, node long, n int, fp long, b0 long, b1 long, b2 long, b3 long, first array<long>"))
    classes = save(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc", "part")).alias("at"), F.count("*").alias("rows"), F.first("fp").alias("fp"), F.first("n").alias("n")))
    copied = save(classes.where("rows > 1").select(F.col("node").alias("__n"), "at"))
    own = prints.join(copied, (F.col("node") == F.col("__n")) & ((F.col("doc") != F.col("at.doc")) | (F.col("part") != F.col("at.part"))), "left_anti")
    keyed = own.select("node", F.posexplode("first").alias("place", "k")).select("k", "node", "place").repartition("k").sortWithinPartitions("k", "node")

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose key another node has too; a repeated row goes."""
        for k, node, place in _runs(batches, 1):
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (node[1:] != node[:-1])
            k, node, place = k[new], node[new], place[new]
            same = k[1:] == k[:-1]
            two = np.append(same, False) | np.append(False, same)
            yield pa.RecordBatch.from_arrays([pa.array(x[two]) for x in (k, node, place)], ["k", "node", "place"])

    met = map_arrow(keyed, meeting, "k long, node long, place int")
    shared = save(met.join(prints.select("node", "n", *PARITY).dropDuplicates(["node"]), "node"))
    fuzzy = _fuzzy_pairs(classes.where("n > 0"))
    few = _candidates(shared.withColumn("root", F.col("node")), NEIGHBOURS)
    links = _verified(save(fuzzy.union(few).distinct()), classes, rows, shingle)
    groups = save(connected_components(links))
    rooted = shared.join(groups.withColumnRenamed("component", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    links = links.union(_verified(save(_candidates(rooted, None)), classes, rows, shingle))
    groups = save(connected_components(links))
    rooted = classes.join(groups, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_node = save(rooted.join(least, "root").select("node", "component_id"))
    return prints.join(by_node, "node").select("doc_id", "node", "component_id")


def shingle_keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """`docs` with one document of each near-duplicate group, the one of least doc_id.

    Rows without a doc_id can't be ranked and stay. All columns are returned unchanged.
    """
    found = shingle_components(docs, shingle)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
