"""Best-fit packing of tokenised documents into sequences of a fixed length.

Every document becomes the ids of a public tokenizer and one end id.  Documents longer than a
sequence are cut into full pieces and a rest.  Pieces go, longest first, through a bounded-space
online best-fit: a fixed number of bins is open, a bitset tells which free spaces they have, a piece
goes to the bin that it fills best, and when too many bins are open the fullest closes.

Defined results: a null or empty text is one piece that holds the end id; repeated rows are packed
once each; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, small_batches, trim

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

#: Words that a worker remembers with their ids, and the longest it remembers.
REMEMBERED, LONGEST = 300_000, 64
#: Words of letters that are encoded as one text, and the digit between them.
TIED, BAR = 100, "7"
#: Marks that part words but are not part of a contraction.
MARKS = b".,;:!?|%$#&*"
#: Bytes of text that are encoded together.
TOGETHER = 3_000_000
#: Sequences that one task packs, about.
FILLED_TOGETHER = 16_384


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def normal(text: str) -> str:
    """The text as the vocabulary's normaliser leaves it: some letters become a letter and a mark that is none."""
    return text if text.isascii() else unicodedata.normalize("NFC", text).lower()


class WordEncoder(dict):
    """UTF-8 words to little-endian 32-bit ids, with a second generation of words that may be forgotten; white space always parts tokens in this vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        whole, (bar,), *parts = ([*e.ids] for e in self.batch([f"ab{BAR}cd", BAR, "ab", "cd"], add_special_tokens=False))
        self.bar = bar if whole == [*parts[0], bar, *parts[1]] else None

    def ids_of(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.batch(words, add_special_tokens=False)]

    def ids_of_letters(self, words: list[str]) -> list[bytes]:
        """The same for words of letters only: many are one text, with a digit between them that is always an id of its own."""
        if self.bar is None:
            return self.ids_of(words)
        found = []
        for e in self.batch([BAR.join(words[k : k + TIED]) for k in range(0, len(words), TIED)], add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.nonzero(ids == self.bar)[0]).tolist()
            raw = ids.tobytes()
            found += [raw[i:j] for i, j in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)])]
        return found

    def learn(self, words: list[bytes]) -> None:
        """Add words; marks after what is a letter when normalised are tokens of their own, so such a word needs its stem alone."""
        letters: dict[bytes, str] = {}
        others: dict[bytes, str] = {}
        cut = []
        for w in words:
            text = w.decode("utf-8", "replace")
            if text.isalpha() and normal(text).isalpha():
                letters[w] = text
                continue
            stem = w.rstrip(MARKS)
            bare = text[: len(text) - (len(w) - len(stem))]
            if len(stem) < len(w) and normal(bare)[-1:].isalpha():
                marks = w[len(stem) :]
                cut.append((w, stem, marks))
                if stem not in self:
                    (letters if bare.isalpha() and normal(bare).isalpha() else others)[stem] = bare
                if marks not in self:
                    others[marks] = marks.decode()
            else:
                others[w] = text
        self.update(zip(letters, self.ids_of_letters(list(letters.values()))))
        self.update(zip(others, self.ids_of(list(others.values()))))
        for w, stem, marks in cut:
            self[w] = self[stem] + self[marks]

    def values(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words; those that are new go to the tokenizer together."""
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        found = list(map(self.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        unknown, older = [], self.older.get
        for i in missing:
            w = words[i]
            if value := older(w):
                self[w] = value
            else:
                unknown.append(w)
        self.learn(unknown)
        for i in missing:
            found[i] = self[words[i]]
        for w in unknown:
            if len(w) > LONGEST:
                self.pop(w, None)
                self.pop(w.rstrip(MARKS), None)
        return found

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts in one row, and where each text's begin and the last one's end."""
        split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
        coded = split.flatten().dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        ids = self.values(coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist())
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        size = sizes[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(starts[which] - ends[:-1], size) + np.arange(ends[-1])]
        return flat, ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: where it starts in its document's ids, its length and checksum."""
    end = end_id.to_bytes(4, "little")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch, _ in blocks(batches, limit=TOGETHER):
            out: tuple[list, ...] = ([], [], [], [], [])
            ids, edges = own.encode_all(batch.column("text"))
            for doc, first, last in zip(batch.column("doc_id").to_pylist(), edges, edges[1:]):
                for k, at in enumerate(range(first, last + 1, size)):
                    part = ids[at : min(last, at + size)]
                    ended = last < at + size  # the end id is in this piece
                    check = zlib.crc32(end, zlib.crc32(part)) if ended else zlib.crc32(part)
                    for column, value in zip(out, (doc, k, at - first, len(part) + ended, check)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        own.older = {}  # the worker may wait long for its next task
        trim()

    return small_batches(docs).select("doc_id", "text").mapInArrow(cut_up, PIECES)


class OpenBins:
    """Bins that still take pieces, by free space; ``bits`` has the free spaces that occur."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.bits, self.made = size, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """The bin for a piece and the piece's place in it."""
        fits = self.bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            where = self._take(free)
        else:
            free, where = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(where)
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return where, self.size - free


def pack(pieces: DataFrame, size: int = 4096, open_bins: int = 2048, parts: int | None = None) -> DataFrame:
    """Give each piece a sequence and a place there.

    Each part of the pieces is packed by itself, longest first; only the last bins of a part stay
    partly empty.  So the number of parts depends on what there is to pack, and on nothing else: a part has
    ``FILLED_TOGETHER`` sequences, some 300,000 pieces of about 50 bytes.
    """
    if parts is None:
        pieces = cut(pieces)
        parts = max(1, (pieces.agg(F.sum("length").alias("n")).first().n or 0) // (size * FILLED_TOGETHER))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = TaskContext.get().partitionId() << 36, OpenBins(size, open_bins)
        for batch in batches:
            places = [bins.put(n) for n in batch.column("length").to_pylist()]
            added = [pa.array([base + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.repartition(parts, "doc_id", "piece").sortWithinPartitions(pieces.length.desc(), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(fill, PACKED)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, size: int = 4096) -> DataFrame:
    return pack(pieces_of(docs, vocabulary or public_vocabulary("word_bpe_49k.json"), size), size)
