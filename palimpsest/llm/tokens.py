"""Token ids of whole columns of text, by a public tokenizer.

Tokenizing a corpus text by text repeats the same words over and over.  Here a
batch is split at spaces and dictionary-encoded in Arrow; the tokenizers library
encodes each distinct piece once, a bounded cache keeps pieces between batches,
and numpy gathers the ids of every text.  Pieces end only where both tokenizers
in use always separate tokens (before a space that a non-space follows, and
between a run of letters and common punctuation), so the result equals that of
encoding each whole text.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

#: Unicode white space, written out: Python's ``\s`` knows four more characters.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = re.compile(rf"(?<=[^{WS}])\n(?=[^{WS}])|[{WS}]*[^\W\d_]+(?=[{WS}.,;:!?]|\Z)|[{WS}]*[^{WS}]+|[{WS}]+")
#: Pieces kept between batches and their longest length.
CACHE, LONGEST = 1_000_000, 32
#: Text bytes that are encoded at once, if no single text is longer.
GROUP = 16 << 20


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


class Encoder:
    """Ids of texts by the tokenizer in file ``path``, as the library loads it."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit, self.cache = self.tokenizer.model, cache, {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Whether a text holds the string of an added token, as a pattern; None without such tokens.
        self.special = "|".join(re.escape(t.content) for t in added) or None
        self.table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.written = [k.to_bytes(4, sys.byteorder) for k in range(self.tokenizer.get_vocab_size())]
        #: Whether words' case and the spaces before them don't matter.
        self.folds = self.tokenizer.normalizer is not None

    def _letters(self, piece: str) -> bytes | None:
        """The ids of one pre-token of Latin-1 letters, perhaps after a space: only the merges are left."""
        word = piece[1:] if piece[:1] == " " else piece
        if not word.isalpha():
            return None
        if word.isascii():
            shown = word.lower() if self.folds else word
        elif max(word) <= "\xff":
            shown = (word.lower() if self.folds else word).encode().decode("latin-1").translate(self.table)
        else:
            return None
        if word is not piece and not self.folds:
            shown = "\u0120" + shown
        written = self.written
        return b"".join([written[t.id] for t in self.model.tokenize(shown)])

    def _keep(self, piece: str, found: bytes) -> bytes:
        if len(self.cache) < self.limit and len(piece) <= LONGEST:
            self.cache[piece] = found
        return found

    def _ids(self, piece: str) -> bytes:
        found = self.cache.get(piece)
        if found is not None:
            return found
        found = self._letters(piece)
        if found is None:
            found = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return self._keep(piece, found)

    def _chunk(self, chunk: str) -> bytes:
        found = self.cache.get(chunk)
        if found is not None:
            return found
        found = self._letters(chunk)
        if found is not None:
            return self._keep(chunk, found)
        parts = _PIECES.findall(chunk)
        if len(parts) == 1:
            return self._ids(chunk)
        return b"".join([self._ids(p) for p in parts])

    def encode(self, texts):
        """(ids of all texts one after another, number of ids of each) of an Arrow string array without nulls."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # several spaces in a row are one piece with what follows: such texts are cut by the pattern alone;
        # the lower case of U+0130 ends in a mark that joins what follows: such texts are encoded whole,
        # and so are those with the string of an added token
        odd = pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False)
        alone = np.zeros(len(texts), bool)
        if self.special:
            alone |= pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        if self.folds:
            alone |= pc.match_substring(texts, "\u0130").to_numpy(zero_copy_only=False)
        odd = odd | alone
        plain = texts if not odd.any() else pc.if_else(pa.array(odd), "", texts)
        split = pc.split_pattern(plain, " ")
        first = split.offsets.to_numpy()
        first = first - first[0]
        coded = split.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int32), coded.dictionary
        space = "" if self.folds else " "
        # a word with one mark after it is looked up as the word and the mark
        cut = pc.extract_regex(words, r"^(?P<word>\pL+)(?P<mark>[.,;:!?])$")
        bare, mark = cut.field("word").dictionary_encode(), cut.field("mark").to_pylist()  # empty without a match
        bases = [self._ids(space + w) if w else b"" for w in bare.dictionary.to_pylist()]
        which = bare.indices.to_pylist()
        marks = {m: self._ids(m) for m in ".,;:!?"}
        words = words.to_pylist()
        lists = [bases[k] + marks[m] if m else self._chunk(space + w) for w, k, m in zip(words, which, mark)]
        if not self.folds:
            starts, back = np.unique(at[first[:-1]], return_inverse=True)  # no space comes before a text's first word
            at[first[:-1]] = len(lists) + back
            lists += [self._chunk(words[k]) if words[k] else b"" for k in starts]
        sizes = (np.fromiter(map(len, lists), np.int64, len(lists)) >> 2).astype(np.int32)
        flat = np.frombuffer(b"".join(lists), np.uint32)
        place = np.cumsum(sizes, dtype=np.int64) - sizes
        each = sizes[at]
        upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        kind = np.int32 if max(upto[-1], len(flat)) < 1 << 31 else np.int64  # half the memory for all but huge texts
        source = np.repeat((place[at] - upto[:-1]).astype(kind), each)
        source += np.arange(upto[-1], dtype=kind)
        ids = flat[source]
        counts = upto[first[1:]] - upto[first[:-1]]
        if odd.any():
            ends, parts, last = np.cumsum(counts), [], 0
            for k in np.nonzero(odd)[0]:  # the empty stand-ins gave nothing, or one space
                text = texts[int(k)].as_py()
                own = self.tokenizer.encode(text, add_special_tokens=False).ids if alone[k] else np.frombuffer(self._chunk(text), np.uint32)
                parts += [ids[last : ends[k] - counts[k]], np.array(own, np.uint32)]
                last, counts[k] = ends[k], len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, counts


def give_back() -> None:
    """Return freed memory to the system: Spark keeps workers for later tasks that need none of it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def with_end(ids, counts, end: int):
    """The ids with ``end`` after each text, and the new counts."""
    import numpy as np

    counts = counts + 1
    last = np.cumsum(counts) - 1
    out = np.empty(len(ids) + len(counts), np.uint32)
    body = np.ones(len(out), bool)
    body[last] = False
    out[last], out[body] = end, ids
    return out, counts


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """The process's encoder: a worker's later tasks find its pieces."""
    return Encoder(path)


def encoded_groups(batches, encoder: Encoder, end: int):
    """Of (doc_id, text) batches: (doc ids, ids, counts) of groups of rows of bounded size."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        low, ids, counts = 0, None, None
        while low < len(texts):
            base = upto[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(upto, base + GROUP, side="right")))
            ids, counts = with_end(*encoder.encode(texts[low:high]), end)
            yield batch.column(0)[low:high], ids, counts
            low = high
        del texts, ids, counts
        give_back()
