"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors u, v have cosine >= c exactly when |u - v|^2 <= 2 (1 - c). A fixed rotation
spreads that distance over the coordinates, which are split into blocks; the squared
budget is shared out in proportion to the blocks' dimensions. If every block exceeded its
share the whole would exceed the budget, so each linked pair is near in some block.
Each block is a range join over all of its coordinates: every vector belongs to the cell
of its nearest pivot, and visits those later cells whose vectors may be within the block's
radius (a vector is no nearer to another cell than to the plane half way between the two
pivots). A cell's task finds the pairs within the block's budget, keeps those for which no
earlier block does (each pair of the union of candidates is then owned by one task), and
verifies them by exact cosine.

How many blocks and pivots prune most depends on the vectors and their number. A bounded
sample estimates pair tests and copies for several plans, and the cheapest is taken; one
block with one cell, which is all pairs, is among them, so that blocks which prune nothing
never cost more than they save. Every plan finds the same links.

A task emits counts of links and a spanning forest of them, never the pairs. Equal vectors
are one class throughout. Cells with many vectors are cut into chunks that meet two at a
time, so no task holds an unbounded group and no candidate is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widegrain.llm.common import map_arrow, save, ship
from widegrain.llm.components import Forest, connected_components

#: Numbers of blocks and of pivots that are tried.
BLOCKS = (1, 2, 4, 8)
PIVOTS = (1, 16, 64, 256, 1024)
#: Vectors in the sample, about; pivots are its first ones.
SAMPLE = 4096
#: Estimated nanoseconds of a pair test, of a coordinate in it, and of a copy of a vector.
TEST_NS, COORDINATE_NS, COPY_NS = 1.5, 0.06, 3000
SEED = 20240501
#: Vectors of a cell that a task compares with as many others; up to SPREAD tasks a side
#: share cells of more than FEW, so that one large cell keeps many tasks busy.
CHUNK, FEW, SPREAD = 16384, 2048, 8
ROWS = 512
#: Cells whose sizes are broadcast (40 bytes each); more of them are joined by shuffle.
HELD_CELLS = 1_000_000
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [round(dim * i / blocks) for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def rotate(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unit vectors in rotated coordinates, computed in pieces of one shape so that a
    vector gets the same coordinates in every task."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    out = np.empty_like(unit)
    for lo in range(0, len(unit), 64):
        piece = np.zeros((64, unit.shape[1]))
        piece[: len(unit[lo : lo + 64])] = unit[lo : lo + 64]
        out[lo : lo + 64] = (piece @ turn)[: len(unit[lo : lo + 64])]
    return out


@dataclass(frozen=True)
class Block:
    """Coordinates from..to, their squared-distance budget, and the pivots of its cells."""

    start: int
    stop: int
    share: float
    pivots: np.ndarray

    def cells(self, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, cells, own): the cell of each rotated vector, then the later cells that it visits."""
        p, radius = self.pivots, math.sqrt(self.share) + 1e-7
        square = np.einsum("ij,ij->i", p, p)
        apart = np.sqrt(np.maximum(square[:, None] + square - 2 * p @ p.T, 1e-24))
        for lo in range(0, len(y), ROWS):
            z = y[lo : lo + ROWS, self.start : self.stop]
            far = np.einsum("ij,ij->i", z, z)[:, None] + square - 2 * z @ p.T
            home = far.argmin(axis=1)
            rows = np.arange(len(z))
            yield rows + lo, home, True
            reach = far - far[rows, home][:, None] <= 2 * radius * apart[home] + 1e-12
            reach &= np.arange(len(p)) > home[:, None]
            visitor, cell = np.nonzero(reach)
            yield visitor + lo, cell, False


def make_plan(sample: np.ndarray, budget: float, blocks: int, pivots: int) -> list[Block]:
    """`sample` holds rotated unit vectors in random order; the first ones are the pivots."""
    dim = sample.shape[1]
    return [Block(a, b, budget * (b - a) / dim + SLACK, np.unique(sample[:pivots, a:b], axis=0)) for a, b in block_bounds(dim, blocks)]


def plan_work(y: np.ndarray, plan: list[Block]) -> tuple[np.ndarray, float]:
    """Pair tests of each block as parts of all pairs, and copies of a vector."""
    tests, copies = [], 0.0
    for block in plan:
        home, away = np.zeros(len(block.pivots)), np.zeros(len(block.pivots))
        for _, cell, own in block.cells(y):
            counts = np.bincount(cell, minlength=len(home))
            home, away = (home + counts, away) if own else (home, away + counts)
        tests.append((home * home / 2 + home * away).sum() / max(len(y) ** 2 / 2, 1))
        copies += (home + away).sum() / max(len(y), 1)
    return np.array(tests), copies


def choose_plan(sample: np.ndarray, total: int, budget: float) -> list[Block]:
    """The plan of least estimated time for `total` vectors, with no more pair tests than all pairs."""
    best, least = make_plan(sample, budget, 1, 1), math.inf
    for blocks in BLOCKS:
        for pivots in PIVOTS:
            if pivots > max(len(sample) // 2, 1) or blocks > sample.shape[1]:
                continue
            plan = make_plan(sample, budget, blocks, pivots)
            tests, copies = plan_work(sample[pivots if pivots > 1 else 0 :], plan)
            if tests.sum() > 1 + 1e-9:
                continue
            cost = total / 2 * sum(t * (TEST_NS + COORDINATE_NS * (b.stop - b.start)) for t, b in zip(tests, plan)) + copies * COPY_NS
            if cost < least:
                best, least = plan, cost
    return best


def sample_plans(classes: DataFrame, cosine: float, blocks: int | None, pivots: int | None) -> dict[int, list[Block]]:
    """The plan for each length of vector, from a sample of about SAMPLE of all classes by hash."""
    budget, total = 2 * (1 - cosine), classes.count()
    every = max(1, total // SAMPLE)
    rows = classes.where(F.pmod(F.xxhash64("cid", F.lit(5)), F.lit(every)) == 0).orderBy(F.xxhash64("cid", F.lit(6)), "cid").select("e").toArrow()["e"].combine_chunks()
    plans: dict[int, list[Block]] = {}
    sizes, flat = np.diff(rows.offsets.to_numpy()), rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        y = rotate(flat[(ends - sizes)[at][:, None] + np.arange(dim)], rotation(dim))
        plans[dim] = choose_plan(y, total, budget) if blocks is None else make_plan(y, budget, min(blocks, dim), pivots or 1)
    return plans


def vectors(embeddings: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, e, valid, ka, kb): the rows, which can link, and a 128-bit key of the vector."""
    e = F.col(col).cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(e, lambda x: x != 0)
    valid = F.coalesce(F.col(col).isNotNull() & ~bad & some & F.col(id_col).isNotNull(), F.lit(False))
    kept = F.when(valid, F.col(col))
    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), kept.alias("e"), valid.alias("valid"), F.xxhash64(kept).alias("ka"), F.xxhash64(F.lit(1), kept).alias("kb"))


def link_parts(classes: DataFrame, cosine: float, blocks: int | None, pivots: int | None, chunk: int) -> DataFrame:
    """(kind, a, b): kind 0, class a has links to classes with b vectors; kind 1, a link a - b."""
    plans = sample_plans(classes, cosine, blocks, pivots)
    kind = classes.schema["e"].dataType.simpleString()

    def plan(dim: int) -> list[Block]:
        # A length that the sample lacks is rare.
        return plans.get(dim) or make_plan(np.zeros((1, dim)), 2 * (1 - cosine), 1, 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            e = batch.column(2)
            sizes = np.diff(e.offsets.to_numpy())
            flat = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[(ends - sizes)[rows][:, None] + np.arange(dim)]
                y = rotate(x, turns.setdefault(dim, rotation(dim)))
                for n, block in enumerate(plan(dim)):
                    for pick, cell, own in block.cells(y):
                        if not len(pick):
                            continue
                        take = pa.array(rows[pick])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(pick), dim), pa.int32()), pa.array(np.full(len(pick), n), pa.int32()), pa.array(cell.astype(np.int64)), pa.array(np.full(len(pick), own)), *[c.take(take) for c in batch.columns]],
                            ["dim", "block", "cell", "own", "cid", "n", "e"],
                        )

    dealt = map_arrow(classes.select("cid", "n", "e"), spread, f"dim int, block int, cell long, own boolean, cid long, n long, e {kind}")
    group = ["dim", "block", "cell"]
    sizes = dealt.groupBy(*group).agg(F.count(F.when(F.col("own"), 1)).alias("home"), F.count(F.when(~F.col("own"), 1)).alias("away"))
    parts = sizes.where("home > 0").select(
        *[F.col(c).alias(f"g_{c}") for c in group],
        _parts("home", chunk).alias("home_parts"),
        _parts("away", chunk).alias("away_parts"),
    )
    parts = save(parts)
    few = parts.limit(HELD_CELLS + 1).count() <= HELD_CELLS
    placed = dealt.join(F.broadcast(parts) if few else parts, [F.col(c) == F.col(f"g_{c}") for c in group])
    # A task is one home chunk with itself, with a later home chunk, or with a chunk of visitors.
    mine = F.pmod(F.xxhash64("cid"), F.when(F.col("own"), F.col("home_parts")).otherwise(F.col("away_parts"))).cast("int")
    homes = F.sequence(F.lit(0), F.col("home_parts") - 1)
    visits = F.sequence(F.lit(0), F.col("away_parts") - 1)
    tasks = F.when(
        F.col("own"),
        F.concat(
            F.transform(homes, lambda o: F.struct(F.least(o, "mine").alias("i"), F.greatest(o, "mine").alias("j"))),
            F.transform(visits, lambda o: F.struct(F.col("mine").alias("i"), (-1 - o).alias("j"))),
        ),
    ).otherwise(F.transform(homes, lambda o: F.struct(o.alias("i"), (-1 - F.col("mine")).alias("j"))))
    placed = placed.withColumn("mine", mine).withColumn("t", F.explode(tasks)).select(*group, "t.i", "t.j", (F.col("own") & (F.col("mine") == F.col("t.i"))).alias("left"), "cid", "n", "e")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dim, block, i, j = int(key[0]), int(key[1]), int(key[3]), int(key[4])
        x = np.stack(frame["e"].to_numpy()).astype(np.float64)
        side = frame["left"].to_numpy()
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        if i == j:
            right = left
        counts, forest = linked_pairs(x, frame["n"].to_numpy(), left, right, i == j, block, plan(dim), cosine)
        ids = frame["cid"].to_numpy()
        a, b = forest.edges()
        has = np.flatnonzero(counts)
        return pd.DataFrame({"kind": np.repeat([0, 1], [len(has), len(a)]).astype(np.int32), "a": np.concatenate([ids[has], ids[a]]), "b": np.concatenate([counts[has], ids[b]])})

    ship(classes.sparkSession)
    # By task, not by cell, or all tasks of a large cell would run one after the other.
    return placed.repartition(*group, "i", "j").groupBy(*group, "i", "j").applyInPandas(compare, "kind int, a long, b long")


def _parts(size: str, chunk: int) -> Column:
    """Chunks of a side of a cell."""
    few = F.least(F.ceil(F.col(size) / min(FEW, chunk)), F.lit(SPREAD))
    return F.greatest(F.ceil(F.col(size) / chunk), few, F.lit(1)).cast("int")


def linked_pairs(x: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, block: int, plan: list[Block], cosine: float) -> tuple[np.ndarray, Forest]:
    """Linked weight of every row and a spanning forest, over pairs owned by `block`."""
    counts, forest = np.zeros(len(x), np.int64), Forest(len(x))
    if not len(left) or not len(right):
        return counts, forest
    y = rotate(x, rotation(x.shape[1]))
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    a, b, share = plan[block].start, plan[block].stop, plan[block].share
    yl, yr = y[left, a:b], y[right, a:b]
    square = np.einsum("ij,ij->i", yr, yr)
    for lo in range(0, len(left), ROWS):
        own = yl[lo : lo + ROWS]
        from_ = lo if same else 0  # rows before are done
        far = np.einsum("ij,ij->i", own, own)[:, None] + square[from_:] - 2 * own @ yr[from_:].T
        p, q = np.nonzero(far <= share + SLACK)
        p, q = p + lo, q + from_
        if same:
            p, q = p[p < q], q[p < q]
        for s in range(0, len(p), 1 << 16):
            l, r = left[p[s : s + (1 << 16)]], right[q[s : s + (1 << 16)]]
            mine = _distance(y, l, r, a, b) <= share
            for earlier in plan[:block]:
                mine &= _distance(y, l, r, earlier.start, earlier.stop) > earlier.share
            l, r = l[mine], r[mine]
            cos = np.einsum("ij,ij->i", x[l], x[r]) / (norm[l] * norm[r])
            l, r = l[cos >= cosine], r[cos >= cosine]
            np.add.at(counts, l, weight[r])
            np.add.at(counts, r, weight[l])
            forest.add(l, r)
    return counts, forest


def _distance(y: np.ndarray, l: np.ndarray, r: np.ndarray, a: int, b: int) -> np.ndarray:
    """Squared distance in one block, added up in one order for every pair."""
    out = np.zeros(len(l))
    for k in range(a, b):
        out += (y[l, k] - y[r, k]) ** 2
    return out


def near_vectors(embeddings: DataFrame, cosine: float = 0.95, blocks: int | None = None, pivots: int | None = None, chunk: int = CHUNK, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `embeddings`.

    n_links counts the other rows with cosine >= `cosine` in double precision,
    component_id is the least vec_id reachable over links. A vector that is null, all
    zero, or holds null or non-finite components, or has no id, links with nothing; so do
    vectors of different length with each other. Equal rows link with each other. Other
    columns are ignored; an empty table gives no rows. `blocks` and `pivots` set a plan that
    is chosen from a sample otherwise; they don't change the result.
    """
    rows = vectors(embeddings, id_col, col)
    classes = save(rows.where("valid").groupBy("ka", "kb").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"), F.first("e").alias("e")))
    parts = save(link_parts(classes, cosine, blocks, pivots, chunk))
    counts = parts.where("kind = 0").groupBy(F.col("a").alias("c0")).agg(F.sum("b").alias("others"))
    groups = connected_components(parts.where("kind = 1").select("a", "b"))
    rooted = classes.select("ka", "kb", "cid", "n").join(groups, F.col("cid") == F.col("node"), "left").join(counts, F.col("cid") == F.col("c0"), "left")
    rooted = rooted.select(F.col("ka").alias("ca"), F.col("kb").alias("cb"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "cid").alias("root"))
    out = rows.join(rooted, F.col("valid") & (F.col("ka") == F.col("ca")) & (F.col("kb") == F.col("cb")), "left")
    component = F.when(F.col("valid"), F.col("root")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract columns of op1 over all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows from all pairs.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), whole AS (
  SELECT vec_id, list_transform(e, lambda x: coalesce(x, CAST(0 AS DOUBLE))) AS e FROM ok
), links AS (
  SELECT a.vec_id AS s, b.vec_id AS t FROM whole a, whole b
  WHERE a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) AND len(a.e) > 0 THEN list_cosine_similarity(a.e, b.e) ELSE -1 END >= 0.95
), reach(s, t) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.s, links.t FROM reach JOIN links ON reach.t = links.s
), least AS (
  SELECT s, min(t) AS component_id FROM reach GROUP BY s
), n AS (
  SELECT s, count(*) AS n FROM links GROUP BY s
)
SELECT least.s AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, least.s = component_id AS kept
FROM least LEFT JOIN n ON least.s = n.s
"""
