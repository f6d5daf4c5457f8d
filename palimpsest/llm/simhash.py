"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into five blocks.  Two fingerprints at two or fewer
differing bits agree on at least three blocks, so they meet under one of the
ten keys made of three blocks.  Equal fingerprints are one vertex from the
start, which takes exact copies out of every later step.

Fingerprints under one key are compared with each other while they are few.  A
crowded key is never compared pair by pair: its members differ only in the two
free blocks, so each lists itself once for every pair of free bits with those
bits cleared, and under such a key at most four fingerprints can meet.  Both
ways find every link that matters for the components.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit, width
#: Where a null doc_id stands.
FIRST_DOC = -(1 << 63)
#: The near-copy groups of a corpus: shingle words, similarity, bits of the fingerprint.
NEAR_SHINGLE, NEAR, WIDE = 5, 0.8, 512
#: Keys, blocks in a key and bits of a block; members of a key that are compared with each other.
KEYS, KEY_BLOCKS, KEY_WIDTH, NEAR_CROWD = 256, 7, 4, 256
#: Bits that differ at that similarity, acos(2 NEAR / (1 + NEAR)) / pi of all, and one standard error more.
NEAR_BITS = 86
#: Up to so many fingerprints under one key are compared with each other.
CROWD = 64


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _keys() -> list[tuple[int, list[int]]]:
    """The ten keys: a mask of the bits that must agree, and the free bits."""
    out = []
    for held in combinations(BLOCKS, len(BLOCKS) - DISTANCE):
        mask = sum(((1 << width) - 1) << first for first, width in held)
        out.append((_signed(mask), [b for b in range(64) if not mask >> b & 1]))
    return out


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text; zero if it has no word."""
    import numpy as np
    import xxhash

    found = (data or b"").lower().split()  # bytes: A-Z only, and exactly the six white space characters
    if not found:
        return 0
    joined = b" ".join(found)
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    n, totals = max(1, len(found) - shingle + 1), 0
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, 65536):  # bounded memory for texts of any length
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[low : min(n, low + 65536)], ends[min(len(found), shingle) - 1 + low :])]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        totals = totals + bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and a column ``name`` with the fingerprint of its text as a signed long."""
    at = docs.columns.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in texts]
            column = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_fingerprint(rows, "fp", shingle).select("doc_id", "fp")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that join what DISTANCE or fewer bits separate; ``fps`` has distinct fp."""
    spark = fps.sparkSession
    keys = _keys()
    each = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for c, (m, _) in enumerate(keys)])).alias("x"),
    ).select("x.c", "x.k", "fp")
    scratch = Scratch(spark, "links")
    sizes = scratch.write(each.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    met = scratch.write(each.join(sizes, ["c", "k"]), "met")
    few = met.filter(F.col("n") <= crowd).groupBy("c", "k").agg(F.array_sort(F.collect_list("fp")).alias("all"))
    near = few.select("all", F.explode("all").alias("a")).select(
        "a", F.explode(F.filter("all", lambda b: (b > F.col("a")) & (_distance(b, F.col("a")) <= DISTANCE))).alias("b")
    )
    free = F.array(*[F.array(*[F.lit(b) for b in bits]) for _, bits in keys])
    many = met.filter(F.col("n") > crowd).withColumn("free", free[F.col("c")])
    cleared = many.select("fp", "free", F.explode("free").alias("i")).select("fp", "i", F.explode("free").alias("j"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(i))
    cleared = cleared.filter("i < j").select(
        "i", "j", "fp", F.col("fp").bitwiseAND(F.bitwise_not(bit("i").bitwiseOR(bit("j")))).alias("rest")
    )
    four = cleared.groupBy("i", "j", "rest").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    crowded = four.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return near.unionByName(crowded)


def groups(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, root and component_id of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable through links.  Texts that
    are null, empty or white space all have fingerprint zero and are linked like
    any other; rows that repeat a doc_id each keep their row; null ids are in
    components without naming them, so a component of null ids alone has none.
    Very long texts are read whole; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    each = scratch.write(fingerprints(docs, shingle), "each")
    first = scratch.write(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    rooted = components(links(first.select("fp"), crowd), scratch)
    joined = first.join(rooted.select(F.col("node").alias("fp"), "root"), "fp", "left")
    joined = scratch.write(joined.select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = scratch.write(joined.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = scratch.write(joined.join(least, "root").select("fp", "root", "component_id"), "named")
    scratch.drop("first", "rooted", "least")
    return each.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def _wide(data: bytes | None) -> bytes:
    """The WIDE-bit fingerprint of a UTF-8 text over NEAR_SHINGLE words; zero if it has no word."""
    import numpy as np
    import xxhash

    found = (data or b"").lower().split()
    if not found:
        return bytes(WIDE // 8)
    n = max(1, len(found) - NEAR_SHINGLE + 1)
    totals, digest = np.zeros(WIDE, np.int64), xxhash.xxh64_intdigest
    seeds = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for low in range(0, n, 4080):  # bounded memory for texts of any length
        part = [digest(b" ".join(found[k : k + NEAR_SHINGLE]), SEED) for k in range(low, min(n, low + 4080))]
        h = np.array(part, np.uint64)[:, None] + seeds  # independent words from one hash: a mixer's steps
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # sums of 255 ones fit a byte
            totals += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(totals * 2 > n).tobytes()


def block_choice():
    """For each key the bits of the KEY_BLOCKS blocks it is made of: fixed, evenly spread choices."""
    import numpy as np

    rng, blocks = np.random.default_rng(SEED), WIDE // KEY_WIDTH
    chosen = np.array([np.sort(rng.permutation(blocks)[:KEY_BLOCKS]) for _ in range(KEYS)])
    return (chosen[:, :, None] * KEY_WIDTH + np.arange(KEY_WIDTH)).reshape(KEYS, -1)


def with_wide(docs: DataFrame, doc: str, vertex: str, wide: str) -> DataFrame:
    """``docs`` reduced to its id, a hash of its lower-cased words and the wide fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long").alias(doc), "text")

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1).cast(pa.binary())]
            node = [xxhash.xxh3_64_intdigest(b" ".join(t.lower().split())) - (1 << 63) for t in texts]
            known = {v: t for v, t in zip(node, texts)}  # copies in a batch are taken once
            known = {v: _wide(t) for v, t in known.items()}
            out = pa.array([known[v] for v in node], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), out], names=[doc, vertex, wide])

    return rows.mapInArrow(run, f"{doc} long, {vertex} long, {wide} binary")


def block_keys(texts: DataFrame) -> DataFrame:
    """(v, k): the KEYS block keys of every text of ``texts``, which has ``v`` and ``wide``."""
    choice = block_choice()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scale = 1 << np.arange(choice.shape[1], dtype=np.int64)
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                bits = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(part), -1), axis=1)
                own = np.stack([bits[:, c] @ scale + (k << choice.shape[1]) for k, c in enumerate(choice)], axis=1)
                nodes = np.repeat(part.column(0).to_numpy(), KEYS)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(own.ravel())], names=["v", "k"])

    return texts.select("v", "wide").mapInArrow(run, "v long, k long")


def near_links(each: DataFrame, scratch: Scratch, crowd: int = NEAR_CROWD) -> DataFrame:
    """Edges (a, b) between texts whose wide fingerprints differ in NEAR_BITS or fewer bits.

    ``each`` has distinct ``v`` with ``wide``.  Under one key all are
    compared, and those that are connected give edges to the smallest of them:
    a group has edges in proportion to its members, not to their pairs.  A key
    with more than ``crowd`` members is dealt into tiles of that size, and every
    tile also has the key's first member in the order of a hash, through which
    most near copies in different tiles meet; ``crossing_links`` finds the rest
    in the tables ``met`` and ``words`` that are left in ``scratch``.
    """
    rows = block_keys(each)
    sizes = scratch.write(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    words = [F.conv(F.hex(F.substring("wide", 1 + 8 * i, 8)), 16, -10).cast("long") for i in range(WIDE // 64)]
    met = scratch.write(rows.join(sizes, "k"), "met")
    named = scratch.write(met.select("v").distinct().join(each.select("v", F.array(*words).alias("w")), "v"), "words")
    full = met.join(named, "v")
    order = F.xxhash64("v", "k")
    tile = F.pmod(order, F.ceil(F.col("n") / crowd))
    few = full.select("k", F.when(F.col("n") > crowd, tile).otherwise(0).alias("t"), "v", "w")
    many = met.filter(F.col("n") > crowd)
    first = many.groupBy("k", "n").agg(F.min(F.struct(order.alias("o"), "v")).alias("m"))
    hubs = first.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / crowd) - 1)).alias("t"), F.col("m.v").alias("v"))
    hubs = hubs.join(named, "v").select("k", "t", "v", "w")
    tiles = few.unionByName(hubs).groupBy("k", "t").agg(F.array_distinct(F.collect_list(F.struct("v", "w"))).alias("all"))
    return tiles.select("all").mapInArrow(_tile_links, "a long, b long").distinct()


def crossing_links(met: DataFrame, named: DataFrame, roots: DataFrame, scratch: Scratch, crowd: int) -> DataFrame:
    """Edges between roots that links under crowded keys join and tiles did not.

    Under a key with more than ``crowd`` members, those outside the largest
    component so far are compared with all members.  Two members of different
    components cannot both be in the largest, so with the links of the tiles
    this is every link under every key.  Where a key's members are one
    component, as a group of near copies is, nothing is left to compare.  Both
    sides are dealt into parts of ``crowd``; a block is one part of each.
    """
    many = met.filter(F.col("n") > crowd).join(roots.select("v", "root"), "v", "left")
    many = many.select("k", "v", "n", F.coalesce("root", "v").alias("r"))
    sizes = many.groupBy("k", "n", "r").agg(F.count(F.lit(1)).alias("m"))
    split = sizes.groupBy("k").agg(F.max(F.struct("m", "r")).alias("top"), F.first("n").alias("n")).filter(F.col("top.m") < F.col("n"))
    split = split.select("k", F.col("top.r").alias("top"), (F.col("n") - F.col("top.m")).alias("rest"))
    left = scratch.write(many.join(split, "k").join(named, "v"), "left")
    order = F.xxhash64("v", "k")
    tiles, parts = F.ceil(F.col("n") / crowd), F.ceil(F.col("rest") / crowd)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    all_of = left.select("k", F.pmod(order, tiles).alias("t"), numbers(parts).alias("s"), F.lit(False).alias("asks"), "v", "r", "w")
    askers = left.filter("r <> top")
    askers = askers.select("k", numbers(tiles).alias("t"), F.pmod(order, parts).alias("s"), F.lit(True).alias("asks"), "v", "r", "w")
    blocks = all_of.unionByName(askers).groupBy("k", "t", "s").agg(F.collect_list(F.struct("asks", "r", "w")).alias("all"))
    return blocks.select("all").mapInArrow(_block_links, "a long, b long").distinct()


def _block_links(batches):
    """Edges (root, root) that some pair of an asker and a member joins, each once a block."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block in batch.column(0):
            members = block.values
            asks = members.field("asks").to_numpy(zero_copy_only=False)
            r, w = members.field("r").to_numpy(), members.field("w").flatten().to_numpy().view(np.uint64).reshape(len(members), -1)
            others, theirs = w[~asks], r[~asks]
            for x, own in zip(w[asks], r[asks], strict=True):
                close = np.bitwise_count(others ^ x).sum(axis=-1, dtype=np.int64) <= NEAR_BITS
                met = np.unique(theirs[close & (theirs != own)])
                a.append(np.full(len(met), own))
                b.append(met)
        pairs = np.stack([np.concatenate(a), np.concatenate(b)])
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=["a", "b"])


def _tile_links(batches):
    """Edges that join what is close in each tile: as many as its members, not its pairs."""
    import numpy as np
    import pyarrow as pa

    def differ(x, y):
        return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)

    for batch in batches:
        tiles = batch.column(0)
        size = np.diff(tiles.offsets.to_numpy())
        start = tiles.offsets.to_numpy()[:-1] - tiles.offsets.to_numpy()[0]
        members = tiles.flatten()
        v, w = members.field("v").to_numpy(), members.field("w").flatten().to_numpy().view(np.uint64).reshape(len(members), -1)
        a, b = [], []
        at = start[size == 2]
        close = at[differ(w[at], w[at + 1]) <= NEAR_BITS] if len(at) else at
        a.append(v[close])
        b.append(v[close + 1])
        for low, n in zip(start[size > 2], size[size > 2], strict=True):
            x, own = w[low : low + n], v[low : low + n]
            near = np.stack([differ(x, y) for y in x]) <= NEAR_BITS
            left = np.ones(n, bool)
            for k in np.argsort(own):  # the smallest member of each component names it
                if left[k]:
                    reach, edge = np.zeros(n, bool), np.zeros(n, bool)
                    edge[k] = True
                    while edge.any():
                        reach |= edge
                        edge = near[edge].any(axis=0) & ~reach
                    left &= ~reach
                    reach[k] = False
                    a.append(np.full(int(reach.sum()), own[k]))
                    b.append(own[reach])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])


def near_groups(docs: DataFrame, crowd: int = NEAR_CROWD) -> DataFrame:
    """doc_id, v (a hash of the text's lower-cased words) and root of every row of ``docs``:
    near copies by NEAR_SHINGLE words at a similarity of NEAR or more share a root.

    The groups are the components of all pairs that share a key and differ in
    NEAR_BITS or fewer bits, whatever number of texts is under a key.

    Texts with the same words are one vertex from the start; null and empty
    texts have the same, empty, words.  Rows that repeat a doc_id, and rows
    without one, each keep their row.  An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "near")
    each = scratch.write(with_wide(docs, "doc_id", "v", "wide"), "each")
    texts = scratch.write(each.select("v", "wide").dropDuplicates(["v"]), "texts")
    rooted = components(near_links(texts, scratch, crowd), scratch)
    rooted = scratch.write(rooted.select(F.col("node").alias("v"), "root"), "roots")
    scratch.drop("texts", "sizes")
    crossing = Scratch(docs.sparkSession, "crossing")
    joined = components(crossing_links(scratch.read("met"), scratch.read("words"), rooted, crossing, crowd), crossing)
    names = scratch.write(
        rooted.select("v").union(joined.select("node")).distinct().join(rooted, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
        .join(joined.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
        .select("v", F.coalesce("last", "root").alias("root")),
        "names",
    )
    scratch.drop("met", "words", "roots")
    crossing.drop("left")
    rooted = names
    return each.select("doc_id", "v").join(rooted, "v", "left").select("doc_id", "v", F.coalesce("root", "v").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one of smallest doc_id, then of
    smallest word hash; a row without an id only if no row of the group has one.

    Rows equal in doc_id and words are one document and one of them stays: the
    smallest by hash of all columns.
    """
    scratch = Scratch(docs.sparkSession, "first")
    doc, vertex, mark, rank = fresh(docs.columns, "doc", "vertex", "mark", "rank")
    found = near_groups(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")
    kept = found.groupBy("root").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias(doc), F.col("p.v").alias(vertex))
    kept = scratch.write(kept, "kept")
    at = docs.columns.index("text")

    def bodies(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            node = [xxhash.xxh3_64_intdigest(b" ".join(t.as_buffer().to_pybytes().lower().split() if t.is_valid else [])) - (1 << 63) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], names=[*batch.schema.names, mark])

    rows = docs.mapInArrow(bodies, T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())]))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(vertex))
    rows = rows.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_DOC)))
    kept = kept.select(F.coalesce(doc, F.lit(FIRST_DOC)).alias(doc), F.col(vertex).alias(mark))
    # both sides grow with the corpus: one plan at every size; the rows that are left stay where they are
    rows = rows.join(kept.hint("merge"), [doc, mark], "left_semi")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    least = F.min_by(F.struct(*cols), F.struct(F.col("doc_id").isNull(), F.xxhash64(*hashed)))
    return rows.groupBy(doc, mark).agg(least.alias(rank)).select(*[F.col(f"{rank}.`{c}`").alias(c) for c in docs.columns])
