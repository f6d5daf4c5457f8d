"""Token ids in binary files: frequency-ranked, byte-aligned, control bytes apart.

An id is written as its rank by frequency, so common ids take one byte.  Each
rank takes one to four bytes; two bits for each, four to a control byte, say how
many, and control bytes stand before all data bytes of a block.  numpy decodes a
block with a table lookup: control byte to four lengths, lengths to offsets,
offsets to bytes.

A data set is a folder of three Parquet tables, written and read by Spark so
that any store will do:

``blocks``  part int, block int, payload binary.  Blocks follow one another by
            (part, block); documents are in ascending doc_id order throughout.
``parts``   part int, base long: ids in all earlier parts.
``ranks``   rank int, id long, n long.

A payload is little-endian: the header ``<4sIIqq`` (magic, format, documents,
ids, ids of this part before the block), the documents' null flags (u1), doc_ids
(i8) and numbers of ids (i8), then control bytes and data bytes.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .packing import tokenizer_path
from .tokens import encoded_groups, shared_encoder

TOKENIZER, END = "byte_bpe_50k.json", 0
MAGIC, FORMAT, HEADER = b"RKVB", 1, struct.Struct("<4sIIqq")
#: Ids in a block, unless a single document has more.
BLOCK = 1 << 18

#: Lengths of the four values of each control byte.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4", copy=False)
    most = int(values.max()) if len(values) else 0
    wide = max(1, -(-most.bit_length() // 8))  # bytes that any value needs
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    own = codes[: len(values)]
    for k in range(1, wide):
        own += values >= 1 << (8 * k)
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    each = values.view(np.uint8).reshape(-1, 4)[:, :wide]
    data = each[np.arange(wide, dtype=np.uint8) <= own[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes."""
    size = _LENGTHS[control].reshape(-1)[:n]
    first = np.cumsum(size, dtype=np.int64) - size
    out = data[first].astype(np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        some = np.flatnonzero(size > k)
        out[some] |= data[first[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_block(doc_ids, known, counts: np.ndarray, ranks: np.ndarray, before: int) -> bytes:
    control, data = encode_values(ranks)
    head = HEADER.pack(MAGIC, FORMAT, len(counts), len(ranks), before)
    body = [np.asarray(known, "u1"), np.asarray(doc_ids, "<i8"), counts.astype("<i8")]
    return b"".join([head, *(x.tobytes() for x in body), control, data])


def decode_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(doc_ids, known, counts, ranks, ids of the part before) of a payload."""
    magic, version, docs, n, before = HEADER.unpack_from(payload)
    if magic != MAGIC or version != FORMAT:
        raise ValueError("not a block of this format")
    at = HEADER.size
    known = np.frombuffer(payload, "u1", docs, at)
    doc_ids = np.frombuffer(payload, "<i8", docs, at + docs)
    counts = np.frombuffer(payload, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    control = np.frombuffer(payload, np.uint8, -(-n // 4), at)
    data = np.frombuffer(payload, np.uint8, -1, at + len(control)) if len(payload) > at + len(control) else np.zeros(0, np.uint8)
    return doc_ids, known, counts, decode_values(control, data, n), before


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, ids, counts): a row for each document with counts false, its ids as little-endian unsigned
    16- or 32-bit integers by the vocabulary's size, and a row for each task with counts true: how often
    the task met each id, as 64-bit integers."""

    def run(batches):
        import pyarrow as pa

        def rows(doc, ids, counts):
            flag = pa.array(np.full(len(ids), counts))
            return pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.binary()), flag], names=["doc_id", "ids", "counts"])

        encoder = shared_encoder(path)
        size = encoder.tokenizer.get_vocab_size()
        kind, total = _kind(size), np.zeros(size, np.int64)
        for doc, ids, counts in encoded_groups(batches, encoder, end):
            total += np.bincount(ids, minlength=size)
            data, width = memoryview(ids.astype(kind)).cast("B"), int(kind[2])
            upto = (np.cumsum(counts) * width).tolist()
            yield rows(doc, [bytes(data[b - n * width : b]) for b, n in zip(upto, counts.tolist())], False)
        yield rows(pa.nulls(1, pa.int64()), [total.astype("<i8").tobytes()], True)

    schema = "doc_id long, ids binary, counts boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _bytes_of(column) -> np.ndarray:
    """The bytes of a binary column's values, one after another."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8, int(at[-1] - at[0]), int(at[0])) if at[-1] > at[0] else np.zeros(0, np.uint8)


def id_ranks(counts: DataFrame) -> list[tuple[int, int, int]]:
    """(rank, id, n) of every id that occurs, most frequent first, from the tasks' counts; bounded by the vocabulary."""

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            for x in batch.column(0):
                n = np.frombuffer(x.as_buffer(), "<i8")
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["id", "n"])

    sums = counts.select("ids").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(((r["n"], r["id"]) for r in sums.collect()), key=lambda x: (-x[0], x[1]))
    return [(k, i, n) for k, (n, i) in enumerate(rows)]


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Write the ids of all texts, each with ``end`` after it, as a data set in ``folder``.

    Null texts are empty ones.  Rows that repeat are written as often as they
    occur, rows without an id come first, an empty table gives an empty set.
    """
    spark, path = docs.sparkSession, path or tokenizer_path(TOKENIZER)
    from tokenizers import Tokenizer

    kind = _kind(Tokenizer.from_file(path).get_vocab_size())
    scratch = Scratch(spark, "tokens")
    parts = scratch.write(tokenized(docs, path, end), "ids", "zstd", by="counts")
    ranks = id_ranks(parts.filter("counts"))
    spark.createDataFrame(ranks, "rank int, id long, n long").coalesce(1).write.parquet(f"{folder}/ranks")
    to_rank = np.zeros(1 + max([0, *(i for _, i, _ in ranks)]), np.uint32)
    for k, i, _ in ranks:
        to_rank[i] = k
    table = parts.filter("not counts").select("doc_id", "ids")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, known, counts, ranks_ = (np.zeros(0, t) for t in (np.int64, np.uint8, np.int64, np.uint32))

        def cut(n):
            """The first ``n`` of the waiting documents as a block."""
            nonlocal block, before, doc_ids, known, counts, ranks_
            size = int(counts[:n].sum())
            payload = encode_block(doc_ids[:n], known[:n], counts[:n], ranks_[:size], before)
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())]
            block, before = block + 1, before + size
            doc_ids, known, counts, ranks_ = doc_ids[n:], known[n:], counts[n:], ranks_[size:]
            return pa.RecordBatch.from_arrays(row, names=["part", "block", "n", "payload"])

        for batch in batches:
            docs_, width = batch.column(0), int(kind[2])
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // width
            doc_ids = np.concatenate([doc_ids, docs_.fill_null(0).to_numpy()])
            known = np.concatenate([known, docs_.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)])
            counts = np.concatenate([counts, sizes])
            ranks_ = np.concatenate([ranks_, to_rank[_bytes_of(batch.column(1)).view(kind)]])
            while counts.sum() >= BLOCK:
                yield cut(max(1, int(np.searchsorted(np.cumsum(counts), BLOCK, side="right"))))
        while len(counts):
            yield cut(max(1, int(np.searchsorted(np.cumsum(counts), BLOCK, side="right"))))

    order = ["doc_id", F.xxhash64("ids")]
    dealt = table.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(run, "part int, block int, n long, payload binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    scratch.drop("ids")
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    base, rows = 0, []
    for r in sorted(sizes.collect(), key=lambda r: r["part"]):  # a row for each partition
        rows.append((r["part"], base))
        base += r["n"]
    spark.createDataFrame(rows, "part int, base long").coalesce(1).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (unless not asked for) the ids of every document in ``folder``."""
    ranks = spark.read.parquet(f"{folder}/ranks").collect()  # bounded by the vocabulary
    to_id = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        to_id[r["rank"]] = r["id"]
    base = {r["part"]: r["base"] for r in spark.read.parquet(f"{folder}/parts").collect()}

    def run(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, known, counts, ranks_, before = decode_block(x.as_buffer().to_pybytes())
                upto = np.cumsum(counts)
                data = memoryview(to_id[ranks_].astype("<u4")).cast("B")
                spans = list(zip((4 * (upto - counts)).tolist(), (4 * upto).tolist()))
                columns = [
                    pa.array(doc_ids, mask=known == 0), pa.array(base[part] + before + upto - counts), pa.array(counts.astype(np.int64)),
                    pa.array([zlib.crc32(data[a:b]) for a, b in spans], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(data[a:b]) for a, b in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return spark.read.parquet(f"{folder}/blocks").select("part", "payload").mapInArrow(run, schema)
