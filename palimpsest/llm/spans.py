"""Substring dedup by sliding sentence spans.

A text is cut into sentences.  A run of at least MIN_SENTENCES consecutive
sentences with at least MIN_WORDS words, or one sentence of at least LONE_WORDS
words, is long enough.  The shortest such run that starts with each sentence
is a span, and so is the shortest that ends with each; each is hashed by its
words.  Spans are joined globally by hash, and sentences covered by any
occurrence but the first (smallest doc_id, then text, then place) go.

A document's hashes are written as one row.  One aggregation then finds the
hashes that two documents have and the first document of each: rows of plain
integers, combined before they move, so a span that very many documents share
costs a row a task.  The occurrences are joined to those hashes only, from two
written tables, so that Spark can split a hash with many rows.  What is gathered
at the end is one document's own spans.  Places inside a text are found again
from the text and never travel.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh

MIN_SENTENCES, MIN_WORDS = 2, 20
#: From so many words on a single sentence is long enough.
LONE_WORDS = 50
#: Where a null doc_id stands: before all others.
FIRST_DOC = -(1 << 63)
#: A sentence with the white space after it; a line's end ends a sentence.
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|\Z)\s*|[.!?]+|\n\s*|\Z)")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence; together they are the whole text.

    Marks inside a word, as in ``3.14``, do not end a sentence.
    """
    out, low = [], 0
    for m in _SENTENCE.finditer(text):
        piece = m.group()
        if not piece:
            continue
        if piece[-1] in ".!?" and m.end() < len(text):  # a mark that no white space follows
            continue
        out.append((low, m.end()))
        low = m.end()
    if low < len(text):
        out.append((low, len(text)))
    return out


def _shortest(words: list[int]) -> list[tuple[int, int]]:
    """(first, last) sentence of the shortest run from each sentence on."""
    runs, high, total = [], 0, 0

    def short(low):
        if high - low == 1 and total >= LONE_WORDS:
            return False
        return total < MIN_WORDS or high - low < MIN_SENTENCES

    for low in range(len(words)):
        while high < len(words) and short(low):
            total += words[high]
            high += 1
        if short(low):
            break
        runs.append((low, high - 1))
        total -= words[low]
    return runs


def span_runs(words: list[int]) -> list[tuple[int, int]]:
    """(first, last) sentence of each span, for the number of words of each sentence.

    Any longer run is the union of the spans inside it.  Of spans that differ
    by sentences without words only the first is listed: their words are one place.
    """
    n = len(words)
    runs = {*_shortest(words), *[(n - 1 - high, n - 1 - low) for low, high in _shortest(words[::-1])]}
    if 0 not in words:
        return sorted(runs)
    filled, out = list(accumulate(w > 0 for w in words)), {}
    for low, high in sorted(runs):
        out.setdefault((filled[low] - (words[low] > 0), filled[high]), (low, high))
    return list(out.values())


def text_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(first sentence, last sentence, hash, second hash) of every span of a text."""
    import xxhash

    found = [text[a:b].split() for a, b in sentences(text)]
    joined = [" ".join(words) for words in found]
    out = []
    for low, high in span_runs([len(w) for w in found]):
        d = xxhash.xxh3_128_intdigest(" ".join([x for x in joined[low : high + 1] if x]).encode())
        out.append((low, high, (d >> 64) - (1 << 63), (d & (1 << 32) - 1) - (1 << 31)))
    return out


def hashes(docs: DataFrame) -> DataFrame:
    """One row a text: ``body`` is a hash of it, ``at``, ``h1`` and ``h2`` are the numbers and the
    hashes of its spans, ``again`` the numbers of spans that the same text had before."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        kinds = [pa.int64(), pa.int64(), *[pa.list_(k) for k in (pa.int32(), pa.int64(), pa.int32(), pa.int32())]]

        def batch_of(rows):
            arrays = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc", "body", "at", "h1", "h2", "again"])

        for batch in batches:
            rows: list[list] = [[] for _ in kinds]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text is None:
                    continue
                seen, again = {}, []
                for k, (_, _, h1, h2) in enumerate(text_spans(text)):
                    if (h1, h2) in seen:
                        again.append(k)
                    else:
                        seen[h1, h2] = k
                body = xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)
                own = [doc, body, [*seen.values()], [h for h, _ in seen], [h for _, h in seen], again]
                for column, value in zip(rows, own, strict=True):
                    column.append(value)
                held += len(seen)
                if held > 100_000:
                    yield batch_of(rows)
                    rows, held = [[] for _ in kinds], 0
            yield batch_of(rows)

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_DOC))
    schema = "doc long, body long, at array<int>, h1 array<long>, h2 array<int>, again array<int>"
    return docs.select(doc.alias("doc"), "text").mapInArrow(run, schema)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, body, runs): the numbers of those spans of each text that occurred before."""
    scratch = Scratch(docs.sparkSession, "spans")
    table = scratch.write(hashes(docs), "hashes")
    # rows equal in doc_id and text are one document
    shared = table.groupBy("doc").agg(F.min("body").alias("b0"), F.max("body").alias("b1")).filter("b0 <> b1").select("doc")
    shared = scratch.write(shared, "shared")
    each = table.select("doc", "body", F.explode(F.arrays_zip("at", "h1", "h2")).alias("s"))
    each = each.select("doc", "body", F.col("s.at").alias("at"), F.col("s.h1").alias("h1"), F.col("s.h2").alias("h2"))
    first = each.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    first = scratch.write(first.filter("first <> last").select("h1", "h2", "first"), "first")
    later = each.join(first, ["h1", "h2"]).filter(F.col("doc") > F.col("first")).select("doc", "body", "at")
    later = later.union(table.select("doc", "body", F.explode("again").alias("at")))
    if not shared.isEmpty():  # different texts under one doc_id: the smaller hash of a text is the earlier
        same = each.join(shared, "doc")
        lead = same.groupBy("doc", "h1", "h2").agg(F.min("body").alias("lead"), F.max("body").alias("tail"))
        lead = scratch.write(lead.filter("lead <> tail").drop("tail"), "lead")
        later = later.union(same.join(lead, ["doc", "h1", "h2"]).filter(F.col("body") > F.col("lead")).select("doc", "body", "at"))
    out = scratch.write(later.groupBy("doc", "body").agg(F.array_sort(F.collect_set("at")).alias("runs")), "runs")
    scratch.drop("hashes", "first", "shared", "lead")
    return out


def dedup(docs: DataFrame, names: tuple[str, str, str] = ("n_sentences", "n_removed", "removed")) -> DataFrame:
    """``docs`` with ``text`` cleaned, the numbers of its sentences and of those
    removed, and the removed (start, end) character spans of the old text.

    Every row stays.  Null texts stay null, texts without a span (empty ones,
    single sentences under LONE_WORDS words, fewer than MIN_WORDS words) stay as they are.
    Very long texts are taken whole.  Rows that repeat a doc_id and text count as
    one document and get the same result; of different texts under one doc_id the
    one with the smaller hash is the earlier; a null doc_id stands at FIRST_DOC.
    An empty table gives an empty one.  ``names`` that ``docs`` already has, in
    any case, get an underscore before them.
    """
    names = tuple(fresh(docs.columns, *names))
    key, body, same, runs = fresh([*docs.columns, *names], "key", "body", "same", "runs")
    text_at = docs.columns.index("text")
    found = repeated(docs).select(F.col("doc").alias(key), F.col("body").alias(same), F.col("runs").alias(runs))

    def bodies(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            values = [xxhash.xxh3_64_intdigest(x.as_buffer()) - (1 << 63) if x.is_valid else None for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=[*batch.schema.names, body])

    schema = T.StructType([*docs.schema.fields, T.StructField(body, T.LongType())])
    keyed = docs.mapInArrow(bodies, schema)
    match = (F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_DOC)) == F.col(key)) & (F.col(body) == F.col(same))
    # both sides grow with the corpus: one plan at every size
    joined = keyed.join(found.hint("merge"), match, "left").drop(body, same, key)
    out_schema = T.StructType(
        [*docs.schema.fields]
        + [T.StructField(names[0], T.IntegerType()), T.StructField(names[1], T.IntegerType())]
        + [T.StructField(names[2], T.ArrayType(T.StructType.fromDDL("start int, end int")))]
    )
    out_names = out_schema.names

    def clean(batches):
        import pyarrow as pa

        for batch in batches:
            texts, counts, gone, removed = [], [], [], []
            for text, own in zip(batch.column(text_at), batch.column(batch.num_columns - 1), strict=True):
                text, own = text.as_py(), own.as_py()
                cut = sentences(text) if text is not None else []
                drop = [False] * len(cut)
                if own:
                    places = span_runs([len(text[a:b].split()) for a, b in cut])
                    for r in own:
                        low, high = places[r]
                        drop[low : high + 1] = [True] * (high + 1 - low)
                spans_: list[dict] = []
                for (a, b), d in zip(cut, drop, strict=True):
                    if d and spans_ and spans_[-1]["end"] == a:
                        spans_[-1]["end"] = b
                    elif d:
                        spans_.append({"start": a, "end": b})
                texts.append("".join([text[a:b] for (a, b), d in zip(cut, drop, strict=True) if not d]) if spans_ else text)
                counts.append(len(cut))
                gone.append(sum(drop))
                removed.append(spans_)
            arrays = list(batch.columns[:-1])
            arrays[text_at] = pa.array(texts, pa.string())
            arrays += [pa.array(counts, pa.int32()), pa.array(gone, pa.int32())]
            arrays.append(pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    return joined.mapInArrow(clean, out_schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The cleaned documents with the columns of ``docs``; a text of which
    nothing but white space is left goes.  ``n_chars``, if it is there, is kept true.
    """
    n, gone, spans_ = fresh(docs.columns, "n_sentences", "n_removed", "removed")
    out = dedup(docs, (n, gone, spans_))
    out = out.filter((F.col(gone) == 0) | F.col("text").rlike(r"\S") | F.col(gone).isNull())
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col(gone) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
