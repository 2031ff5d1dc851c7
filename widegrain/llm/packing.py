"""Sequence packing balanced by attention cost.

Each scan partition tokenises its documents and packs them in bounded buffers, so no row
is shuffled. Whole multiples of the sequence length become sequences of their own; the
remainders, longest first, go to the sequence of least estimated cost (a linear term in
tokens plus a quadratic term in each piece, for attention) that still has room. A piece
for which no sequence has room is cut over those with most room. There are as many
sequences as the tokens need, so a buffer leaves less than one sequence of padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widegrain.llm.bpe import BatchBpe
from widegrain.llm.common import map_arrow, text_buffer, text_slices

MAX_TOKENS = 1024
#: Tokens that a task holds before it packs them.
BUFFER_TOKENS = 1 << 21


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Cost:
    """Estimated work of a piece: `linear` per token and `quadratic` per token pair."""

    linear: float = 1.0
    quadratic: float = 1.0 / 512

    def of(self, length):
        return self.linear * length + self.quadratic * length * length


def pack_lengths(lengths: np.ndarray, limit: int = MAX_TOKENS, cost: Cost = Cost()) -> list[np.ndarray]:
    """Pieces as (document, start, length, sequence, offset) arrays for document lengths."""
    whole = lengths // limit
    doc = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = [[doc, nth * limit, np.full(len(doc), limit), np.arange(len(doc)), np.zeros(len(doc), np.int64)]]
    rest = lengths - whole * limit
    held = np.flatnonzero(rest)
    held = held[np.argsort(-rest[held], kind="stable")]
    n_seq = -(-int(rest.sum()) // limit)
    room, spent = [limit] * n_seq, [0.0] * n_seq
    # Sequences by cost; those without room for the piece at hand wait by room until pieces are shorter.
    ready, waiting = [(0.0, s) for s in range(n_seq)], []
    rows = []
    for d in held.tolist():
        left, start = int(rest[d]), int(whole[d] * limit)
        while left:
            while waiting and -waiting[0][0] >= left:
                s = heappop(waiting)[1]
                heappush(ready, (spent[s], s))
            while ready and room[ready[0][1]] < left:
                s = heappop(ready)[1]
                heappush(waiting, (-room[s], s))
            s = heappop(ready)[1] if ready else heappop(waiting)[1]
            size = min(left, room[s])
            rows.append((d, start, size, len(doc) + s, limit - room[s]))
            room[s] -= size
            spent[s] += cost.of(size)
            if room[s]:
                heappush(ready, (spent[s], s))
            start, left = start + size, left - size
    if rows:
        out.append(list(np.array(rows, np.int64).T))
    return [np.concatenate(x).astype(np.int64) for x in zip(*out)]


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = MAX_TOKENS, cost: Cost = Cost(), end_id: int = 0, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, [ids,] ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids followed by `end_id`; a null or empty text is `end_id`
    alone. `ids` holds the piece's ids as little-endian unsigned 32-bit integers.
    Repeated rows are packed once each; null ids are carried along; other columns are
    ignored; an empty table gives no pieces. sequence_id counts within the partition that
    read the rows, whose number is in the upper half; a task run again gives the same ids.
    """
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "start", "length", *(["ids"] if ids else []), "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BatchBpe(path)
        context = TaskContext.get()
        base, used = (context.partitionId() if context else 0) << 32, 0
        keys, parts, sizes, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used, keys, parts, sizes, held
            key = pa.concat_arrays(keys)
            flat, size = np.concatenate(parts), np.concatenate(sizes)
            keys, parts, sizes, held = [], [], [], 0
            doc, start, length, seq, offset = pack_lengths(size, limit, cost)
            at = (np.cumsum(size) - size)[doc] + start
            step = 4096
            for lo in range(0, len(doc), step):
                cut = slice(lo, lo + step)
                views = [flat[a : a + n].tobytes() for a, n in zip(at[cut].tolist(), length[cut].tolist())]
                cols = [key.take(pa.array(doc[cut])), pa.array(start[cut]), pa.array(length[cut])]
                if ids:
                    cols.append(pa.array(views, pa.binary()))
                cols += [pa.array([crc(v) for v in views], pa.int64()), pa.array(size[doc[cut]]), pa.array(base + used + seq[cut]), pa.array(offset[cut])]
                yield pa.RecordBatch.from_arrays(cols, names)
            used += int(seq.max()) + 1

        from zlib import crc32 as crc

        for part in text_slices(batches):
            flat, off = bpe.encode(*text_buffer(part.column(1)))
            flat = np.insert(flat, off[1:], end_id)
            keys.append(part.column(0))
            parts.append(flat.astype("<u4"))
            sizes.append(np.diff(off) + 1)
            held += len(flat)
            if held >= BUFFER_TOKENS:
                yield from flush()
        if keys:
            yield from flush()

    schema = "doc_id long, start long, length long, " + ("ids binary, " if ids else "") + "ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Contract columns of op6 over all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
