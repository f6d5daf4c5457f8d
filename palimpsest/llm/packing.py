"""Best-fit packing of documents into token sequences.

How documents fill sequences depends only on how many pieces there are of each
length, and a length is at most the capacity.  The histogram of lengths, bounded
by the capacity whatever the input's size, goes to the driver; there sequences
are filled greedily with the longest piece that still fits, and then the
smallest piece of a sequence gives way to two unpacked ones that fit its
expanded gap more tightly.  Equal sequences are planned once with a count.  The
plan is bounded too; pieces find their place by their rank among the pieces of
their length, which a range partitioning gives without gathering any length.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import Encoder, encoded_groups

CAPACITY, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Slot:
    """Pieces of ``length`` with ranks from ``rank`` on take offset ``offset`` of sequences from ``sequence`` on."""

    length: int
    rank: int
    sequence: int
    offset: int


def _fill(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one sequence; ``counts`` is what is left of each length."""
    left, have = counts.copy(), []
    gap = capacity
    while gap > 0:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        have.append(int(fits[-1]))
        left[have[-1]] -= 1
        gap -= have[-1]
    if gap == 0 or not have:
        return have
    small = have[-1]  # lengths fall, so the last is the smallest
    room = gap + small
    lengths = np.flatnonzero(left[:room])  # two pieces, neither longer than the room
    if not len(lengths):
        return have
    rest = room - lengths
    partner = np.searchsorted(lengths, rest, side="right") - 1  # the longest that fits beside it
    ok = partner >= 0
    other = np.where(ok, lengths[np.maximum(partner, 0)], 0)
    alone = ok & (other == lengths) & (left[lengths] < 2)
    lower = np.where(alone, partner - 1, partner)
    ok &= lower >= 0
    total = np.where(ok, lengths + lengths[np.maximum(lower, 0)], 0)
    best = int(total.argmax())
    if total[best] > small:
        have[-1:] = sorted((int(lengths[best]), int(lengths[lower[best]])), reverse=True)
    return have


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Places for all pieces; as many equal sequences as the counts allow are planned at once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used, slots, sequence = np.zeros(capacity + 1, np.int64), [], 0
    while counts.any():
        have = _fill(counts, capacity)
        need = defaultdict(int)
        for x in have:
            need[x] += 1
        times = min(int(counts[x]) // n for x, n in need.items())
        offset = 0
        for x in have:
            slots.append(Slot(x, int(used[x]), sequence, offset))
            used[x] += times
            counts[x] -= times
            offset += x
        sequence += times
    return slots


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and its ids if asked for."""
    path = path or tokenizer_path(TOKENIZER)

    def run(batches):
        import zlib

        import pyarrow as pa

        encoder = Encoder(path)  # not the process's: later stages of a pipeline need the memory
        for doc, ids, counts in encoded_groups(batches, encoder, end):
            n = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            low = (np.cumsum(counts) - counts)[row] + start
            data = memoryview(ids.astype("<u4", copy=False)).cast("B")
            spans = list(zip((4 * low).tolist(), (4 * (low + length)).tolist()))
            columns = [
                doc.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)),
                pa.array(length.astype(np.int64)), pa.array([zlib.crc32(data[a:b]) for a, b in spans], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([bytes(data[a:b]) for a, b in spans], pa.binary())], [*names, "ids"]
            for k in range(0, len(row), 1 << 16):
                yield pa.RecordBatch.from_arrays([c[k : k + (1 << 16)] for c in columns], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def ranked(table: DataFrame, scratch: Scratch) -> DataFrame:
    """``table`` with ``rank``: each row's number among the rows of its length, from 0.

    Rows go to ranges of (length, doc_id, piece), so a common length fills many
    tasks.  A task numbers its own rows; what comes before in earlier ranges is
    known from one count per task and length, and as ranges are ordered by
    length those are at most the number of tasks plus the capacity.
    """

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            edge = np.flatnonzero(np.diff(length, prepend=-1))  # lengths come in order
            size = np.diff(np.append(edge, len(length)))
            base = np.empty(len(edge), np.int64)
            for k, (x, n) in enumerate(zip(length[edge].tolist(), size.tolist())):
                base[k] = seen[x]
                seen[x] += n
            local = np.arange(len(length)) - np.repeat(edge, size) + np.repeat(base, size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(local)],
                names=[*batch.schema.names, "part", "local"],
            )

    schema = ", ".join(f"{n} {t}" for n, t in table.dtypes) + ", part int, local long"
    order = ["length", "doc_id", "piece", "ids_crc32"]
    dealt = table.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.write(dealt.mapInArrow(number, schema), "ranked")


def place(table: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """``table`` (with doc_id, piece, length, ids_crc32) and each row's sequence_id and offset."""
    rows = ranked(table, scratch)
    per_task = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "part").collect()
    before, histogram = {}, defaultdict(int)
    for r in per_task:
        before[r["part"], r["length"]] = histogram[r["length"]]
        histogram[r["length"]] += r["n"]
    by_length = defaultdict(list)
    for s in plan(histogram, capacity):
        by_length[s.length].append((s.rank, s.sequence, s.offset))
    columns = table.columns
    slots = {x: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for x, v in by_length.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy()  # noqa: B023, E731
            length, part, local = column("length"), column("part"), column("local")
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            edge = np.flatnonzero((np.diff(length, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(length)]):
                rank0, sequence0, offset0 = slots[int(length[a])]
                rank = local[a:b] + before[int(part[a]), int(length[a])]
                k = np.searchsorted(rank0, rank, side="right") - 1
                sequence[a:b], offset[a:b] = sequence0[k] + rank - rank0[k], offset0[k]
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"]
            )

    schema = ", ".join(f"{n} {t}" for n, t in table.dtypes) + ", sequence_id long, offset long"
    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for every piece of every row of ``docs``: where it lies in which sequence.

    A document is its ids and then the end id; only documents over ``capacity``
    are cut, and each piece is placed by itself.  Null and empty texts are the
    end id alone.  Rows that repeat are packed as often as they occur; rows
    without an id are packed like others.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    table = scratch.write(pieces(docs, path, capacity, with_ids=with_ids), "pieces")
    return place(table, scratch, capacity)
