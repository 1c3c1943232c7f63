"""Shortest-pack-first packing over the histogram of lengths.

Whole sequences are cut off long documents first; what is left of every document is shorter than a sequence, so a
histogram of a few thousand lengths describes the whole corpus. Lengths are placed from the longest down, each on the
shortest packs, which are kept as counts of equal packs: the plan's size and work depend on the number of distinct
lengths and not on that of documents. The plan says where the documents of a length with ranks from .. to .. go,
and documents find their pieces by rank.

As documents may be cut freely, the number of packs is known beforehand: all tokens fill whole sequences, but for one
of each power of two that the rest consists of. A length that no pack has room for is cut to fill the shortest, and its rest
comes back to the histogram. So every sequence is filled to its end.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, materialize, text_of
from .packing import CAPACITY, word_ids

#: Sequences of documents' whole parts are numbered from here on, those of the plan from 0.
WHOLE = 1 << 62


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Placements of counts[length] documents of each length below the capacity, as rows of length, rank_from,
    number, shift, size, sequence, packs, offset: of the documents of that length, the k-th of `number` from rank_from on has
    `size` tokens from `shift` on put into sequence + k % packs, at offset + k // packs * size."""
    total = sum(n * c for n, c in counts.items())
    packs = [(capacity, total // capacity)] + [(1 << b, 1) for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    # open packs by room left, the shortest (most room) first: (-room, sequence from, number, filled)
    heap, made = [], 0
    for room, number in packs:
        if number:
            heap.append((-room, made, number, 0))
            made += number
    heapq.heapify(heap)
    waiting: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    for n, c in counts.items():
        if n and c:
            waiting[n].append((n, 0, c, 0))
    rows = []
    for size in range(capacity, 0, -1):
        while waiting[size]:
            length, rank, number, shift = waiting[size].pop()
            room, sequence, packs_here, filled = heapq.heappop(heap)
            room = -room
            part = min(size, room)
            # rounds over these packs until the next shorter ones are the shortest, or no room is left for one more
            most = max(1, min((room + heap[0][0]) // part if heap else room // part, room // part))
            if number < packs_here:
                take, rounds = number, 1
                heapq.heappush(heap, (-room, sequence + number, packs_here - number, filled))
                packs_here = number
            else:
                rounds = min(most, number // packs_here)
                take = rounds * packs_here
                if take < number:
                    waiting[size].append((length, rank + take, number - take, shift))
            rows.append((length, rank, take, shift, part, sequence, packs_here, filled))
            if part < size:
                waiting[size - part].append((length, rank, take, shift + part))
            if room > rounds * part:
                heapq.heappush(heap, (rounds * part - room, sequence, packs_here, filled + rounds * part))
    return np.array(rows, np.int64).reshape(-1, 8)


def _read(path: str, capacity: int, end_id: int, batch_bytes: int = 1 << 21) -> Callable:
    """Ids of documents, the length left after whole sequences, its rank and the whole sequences before it in the task."""

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, task = word_ids(path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        narrow = max(len(encode.ends), end_id + 1) <= 1 << 16
        ranks, whole = np.zeros(capacity, np.int64).tolist(), 0
        for batch in batches:
            sizes, at = batch.column(1).to_pylist(), 0
            while at < len(sizes):
                upto, size = at, 0
                while upto < len(sizes) and (upto == at or size + sizes[upto] <= batch_bytes):
                    size += sizes[upto]
                    upto += 1
                columns: tuple[list, ...] = ([], [], [], [], [])
                for ids in encode(batch.column(2).slice(at, upto - at)):
                    ids += end
                    n = len(ids) // 4
                    rest = n % capacity
                    row = n, rest, ranks[rest], whole, np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids
                    ranks[rest] += 1
                    whole += n // capacity
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, upto - at), pa.array([task] * (upto - at), pa.int32()), *arrays],
                    names=["doc_id", "task", "doc_tokens", "rest", "rank", "whole", "ids"],
                )
                at = upto
        pa.default_memory_pool().release_unused()

    return run


def _cut(placements, capacity: int, width: int) -> Callable:
    """Pieces of documents, whose rank is that among all documents with as long a rest."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        rows = placements.value
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        starts = np.searchsorted(rows[:, 0], np.arange(capacity + 1))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for i, (task, tokens, rest, rank, whole, ids) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True)):
                pieces = [(k * capacity, capacity, WHOLE + (task << 36) + whole + k, 0) for k in range(tokens // capacity)]
                if rest:
                    mine = rows[starts[rest] : starts[rest + 1]]
                    for _, first, _, shift, size, sequence, packs, offset in mine[(mine[:, 1] <= rank) & (rank < mine[:, 1] + mine[:, 2])].tolist():
                        turn, place = divmod(rank - first, packs)
                        pieces.append((tokens - rest + shift, size, sequence + place, offset + turn * size))
                full = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                for start, length, sequence, offset in sorted(pieces):
                    for column, value in zip(out, (i, start, length, zlib.crc32(full[4 * start : 4 * (start + length)]), tokens, sequence, offset), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), *[pa.array(c, pa.int64()) for c in out[1:]]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack_by_patterns(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every row of docs.

    Each document's ids end with end_id; a null or empty text is that id alone. Long documents give whole sequences of
    their own first. Sequences are full, but for at most one of each power of two. Documents are read once; their ids are
    written beside length and rank, of which only a histogram with one row a length comes to the driver. Equal lengths, a hot
    one too, are ranked by counts of tasks, so nothing is gathered by length. Repeated rows and null ids are packed as often
    as they come; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("bytes"), text_of(text_col).alias("text"))
    id_field = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    long, short = T.LongType(), T.IntegerType()
    schema = T.StructType([id_field, *[T.StructField(n, t) for n, t in (("task", short), ("doc_tokens", long), ("rest", short), ("rank", long), ("whole", long), ("ids", T.BinaryType()))]])
    read = materialize(rows.mapInArrow(_read(tokenizer_path, capacity, end_id), schema), "ids")
    counts = materialize(read.groupBy("task", "rest").agg(F.count(F.lit(1)).alias("n")), "lengths")
    placed = plan({r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(W.partitionBy("rest").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    earlier = counts.select("task", "rest", F.coalesce(before, F.lit(0)).alias("earlier"))
    ranked = read.join(bounded(materialize(earlier, "earlier")), ["task", "rest"])
    ranked = ranked.select("doc_id", "task", "doc_tokens", "rest", (F.col("rank") + F.col("earlier")).alias("rank"), "whole", "ids")
    width = 2 if max(len(word_ids(tokenizer_path).ends), end_id + 1) <= 1 << 16 else 4
    pieces = T.StructType([id_field, *[T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
    return ranked.mapInArrow(_cut(spark.sparkContext.broadcast(placed), capacity, width), pieces)
