"""Packing: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import LOWER, UPPER, written
from tidemark.operators.ranks import number_rows

#: Words whose ids a Python worker remembers at a time.
_REMEMBERED = 1_000_000
#: Rows read into Python objects at a time.
_ROWS = 500
_MARKS = b"!#$%&()*+,-./:;<=>?@[]^_`{|}~"
_PLAIN = bytes.maketrans(b"\n\t\r" + UPPER.encode(), b"   " + LOWER.encode())


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _only_letters(word: bytes) -> bool:
    """Letters that stay letters in lower case: Latin, Greek and Cyrillic without the dotted capital I."""
    if word.isalpha():  # ASCII, as these are bytes
        return True
    text = word.decode()
    return text.isalpha() and max(text) < "\u0530" and "\u0130" not in text


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit numbers, under a tokenizer of lower-case words.

    The tokenizer must never join characters across white space and must keep letters apart from
    ASCII marks. Each word is encoded once while it is remembered; a word of letters with marks at
    its end is put together from both. A text that may hold a special token is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = _tokenizer(path)
        self.known: dict[bytes, bytes] = {}
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def _encode(self, parts: list[bytes]) -> None:
        texts = [part.decode() for part in parts]
        for part, coded in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            self.known[part] = np.asarray(coded.ids, dtype="<u4").tobytes()

    def _encode_letters(self, parts: list[bytes]) -> None:
        """Words of letters as one text, cut behind the ids that end a word."""
        ids = np.asarray(self.tokenizer.encode(b" ".join(parts).decode(), add_special_tokens=False).ids, dtype="<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
        if len(ends) != len(parts):
            return self._encode(parts)
        data, start = ids.tobytes(), 0
        for part, end in zip(parts, ends.tolist()):
            self.known[part] = data[start:end]
            start = end

    def _learn(self, words: set[bytes]) -> None:
        cut, letters, others = [], set(), set()
        for word in words:
            base = word.rstrip(_MARKS)
            if not _only_letters(base):
                others.add(word)
                continue
            letters.add(base)
            if len(base) < len(word):
                others.add(word[len(base) :])
                cut.append((word, base, word[len(base) :]))
        if letters := letters.difference(self.known):
            self._encode_letters(list(letters))
        if others := others.difference(self.known):
            self._encode(list(others))
        for word, base, marks in cut:
            self.known[word] = self.known[base] + self.known[marks]

    def __call__(self, text: str | bytes) -> np.ndarray:
        text = text.encode() if isinstance(text, str) else text
        if b"<|" in text:
            ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            return np.asarray(ids, dtype="<u4")
        words = text.translate(_PLAIN).split(b" ")
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        if new := set(words).difference(self.known):
            self._learn(new)
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<u4")


def token_pieces(
    docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, key: str = "doc_id",
    text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``size`` ids of each document, whose last id is ``end_id``.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32 (of the ids
    as little-endian unsigned 32-bit numbers), doc_tokens and, if asked for, ids. A null text
    counts as empty and has the end id alone. All pieces of a document but the last are full.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(vocabulary)
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            rows, starts, lengths, sums, totals, pieces = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(value or b""), np.array([end_id], dtype="<u4"))
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
                    if with_ids:
                        pieces.append(piece.astype("int32"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array(values, pa.int64()) for values in (starts, lengths, sums, totals)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return source.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of packing patterns for so many pieces of each length.

    Lengths are placed longest first, always into the packs that are shortest so far; only counts
    of patterns change, so the work depends on the lengths that occur and not on the pieces. A
    pattern grows as a chain of (length, pattern before).
    """
    by_room: dict[int, list[list]] = defaultdict(list)  # room left: [count, chain]
    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        left = histogram[length]
        for room in range(max(by_room, default=0), length - 1, -1):
            while left and by_room.get(room):
                count, chain = by_room[room].pop()
                used = min(count, left)
                left -= used
                if count > used:
                    by_room[room].append([count - used, chain])
                by_room[room - length].append([used, (length, chain)])
            if not left:
                break
        per_pack = size // length
        full, rest = divmod(left, per_pack)
        for count, copies in ((full, per_pack), (1 if rest else 0, rest)):
            if count:
                chain = None
                for _ in range(copies):
                    chain = (length, chain)
                by_room[size - copies * length].append([count, chain])
    patterns = []
    for packs in by_room.values():
        for count, chain in packs:
            lengths = []
            while chain:
                lengths.append(chain[0])
                chain = chain[1]
            patterns.append((count, lengths[::-1]))
    return patterns


def _places(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset) in order of rank."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            found[length].append((ranks[length], sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return {length: np.asarray(rows, dtype=np.int64) for length, rows in found.items()}


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` (with doc_id, start and length up to ``size``) with sequence_id and offset.

    The histogram of at most ``size`` lengths comes to the driver, which lays out patterns of
    lengths. Each piece takes the place of its rank among pieces of its length; ranks come from a
    range partitioning over all pieces, so a length that many pieces share is split over tasks.
    Sequence ids run from 0 without gaps, offsets in a sequence too. An empty table stays empty.
    """
    pieces = written(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = _places(shortest_pack_first(histogram, size))
    below, starts = 0, {}
    for length in sorted(histogram):
        starts[length] = below
        below += histogram[length]

    numbered = number_rows(pieces, ["length", "doc_id", "start"], "position", "pieces_total").drop("pieces_total")

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(lengths: pd.Series, positions: pd.Series) -> pd.DataFrame:
        sequence = np.zeros(len(lengths), dtype=np.int64)
        offset = np.zeros(len(lengths), dtype=np.int64)
        values, ranks = lengths.to_numpy(), positions.to_numpy() - 1
        for length in np.unique(values):
            at = np.flatnonzero(values == length)
            rank, table = ranks[at] - starts[length], places[length]
            row = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
            sequence[at] = row[:, 1] + rank - row[:, 0]
            offset[at] = row[:, 2]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = numbered.withColumn("place", place("length", "position"))
    return placed.select(*pieces.columns, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, **options) -> DataFrame:
    """Tokenize, cut and pack: a row per piece with its sequence and its offset there.

    See :func:`token_pieces` and :func:`pack`. Documents may repeat and their keys may be null or
    repeated: every row is a document of its own. Other columns than key and text are not carried.
    """
    return pack(token_pieces(docs, vocabulary, size, **options), size)
