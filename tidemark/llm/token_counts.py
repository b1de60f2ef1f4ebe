"""Token counts by dynamic programming over prefixes, for models that merge pieces by score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_SPACE = "▁"
#: ASCII marks, as they stand in a character class.
_MARKS = r"!-/:-@\[-`{-~"
#: Characters of words whose tables a Python worker remembers at a time, and pairs of pieces.
_REMEMBERED = 4_000_000
_REMEMBERED_PAIRS = 1_000_000
#: Rows read into Python objects at a time.
_ROWS = 500
#: Stands for a character without a piece: nothing merges with it.
_BYTES = -1


class PrefixCounter:
    """Exact token counts at every prefix of a text, in time linear in its length.

    What such a model makes of a prefix is what it makes of a shorter prefix and one more piece:
    among the pieces that end there, exactly one may follow the last piece of the prefix before
    it. Two pieces may follow each other if the model cuts their joined text into just these two.
    So the table holds the last piece and the count for each prefix, and a longer text needs no
    second look at what came before.

    Pieces never hold white space after another character, nor a line break (nor, in some models, a
    mark after a letter), so the table starts again there, and the tables of words met before are
    remembered. Models with another normalisation than the marked spaces, or without bytes for
    unknown characters, are refused.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.vocab_size())
        plain = [i for i in ids if not (
            self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i)
        )]
        names = [self.model.id_to_piece(i) for i in plain]
        letters = set().union(*names)
        self.wall = next((c for c in "\n\x01\x02" if c not in letters), None)
        if self.wall is None or not any(self.model.is_byte(i) for i in ids):
            raise ValueError("the model must have bytes for unknown characters, line breaks among them")
        if any(re.search(f"[^{_SPACE}]{_SPACE}", name) for name in names):
            raise ValueError("a piece of the model holds white space after another character")
        probe = "a  ﬁ é ①\t"
        if self.model.normalize(probe) != _SPACE + probe.replace(" ", _SPACE):
            raise ValueError("the model changes texts before it cuts them")
        self.lead = len(self.model.encode(self.wall, num_threads=1))
        cuts = self.model.encode([self.wall + name for name in names], num_threads=1)
        #: Pieces that the model gives for their own text; others occur in no text.
        self.pieces = {name.replace(_SPACE, " "): i for i, name, cut in zip(plain, names, cuts) if cut[self.lead :] == [i]}
        self.names = {i: name for name, i in self.pieces.items()}
        self.ending = ahocorasick.Automaton()
        for name, i in self.pieces.items():
            self.ending.add_word(name, (len(name), i))
        self.ending.make_automaton()
        self.follows: dict[tuple[int, int], bool] = {}
        self.known: dict[str, np.ndarray] = {}
        self.totals: dict[str, int] = {}
        self.held = 0
        inner = f"[^ {self.wall}]"
        if any(re.search(f"[A-Za-z][{_MARKS}]", name) for name in names):
            self.word = re.compile(f"{self.wall}+| *{inner}*")
        else:  # no piece holds a mark after a letter either, so a word may end there
            plain_run = f"[^ {self.wall}{_MARKS}]*+(?<=[A-Za-z])(?=[{_MARKS}])"
            self.word = re.compile(f"{self.wall}+| *+[{_MARKS}]*+(?:{plain_run}|{inner}*)")

    def _may_follow(self, first: int, second: int) -> bool:
        text = self.wall + self.names[first] + self.names[second]
        may = self.follows[first, second] = self.model.encode(text, num_threads=1)[self.lead :] == [first, second]
        return may

    def _table(self, word: str) -> np.ndarray:
        """Token counts of the prefixes of 1, 2, ... characters of a word."""
        follows = self.follows
        last, counts = [_BYTES] * (len(word) + 1), [0] * (len(word) + 1)
        done = 0

        def skip_to(end: int) -> None:
            nonlocal done
            while done < end:
                counts[done + 1] = counts[done] + len(word[done].encode("utf-8", "replace"))
                done += 1

        for end, (length, piece) in self.ending.iter(word):
            end += 1
            if done == end:
                continue
            skip_to(end - 1)
            start = end - length
            before = last[start]
            if before != _BYTES:
                pair = before, piece
                may = follows.get(pair)
                if not (self._may_follow(*pair) if may is None else may):
                    continue
            last[end] = piece
            counts[end] = counts[start] + 1
            done = end
        skip_to(len(word))
        return np.array(counts[1:], dtype=np.int32)

    def _words(self, text: str) -> list[str]:
        """The words of a text that is not empty, each with its table in ``known``."""
        words = self.word.findall(" " + text.replace(_SPACE, " "))
        words.pop()  # the empty match at the end
        if self.held > _REMEMBERED or len(self.follows) > _REMEMBERED_PAIRS:
            self.known.clear()
            self.totals.clear()
            self.follows.clear()
            self.held = 0
        for word in set(words).difference(self.totals):
            table = self.known[word] = self._table(word)
            self.totals[word] = int(table[-1])
            self.held += len(word)
        return words

    def counts(self, text: str) -> np.ndarray:
        """The token count of each prefix of ``text``, from the empty one to the whole."""
        if not text:
            return np.zeros(1, dtype=np.int64)
        words = self._words(text)
        sums = np.cumsum([0] + [self.totals[word] for word in words[:-1]])
        parts = np.concatenate([self.known[word] for word in words]).astype(np.int64)
        parts += np.repeat(sums, [len(word) for word in words])
        parts[0] = 0  # the space that the model puts before a text is not part of it
        return parts

    def total_and_fit(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the whole text, and characters of its longest prefix of at most ``limit``."""
        if not text:
            return 0, 0
        words = self._words(text)
        totals = list(map(self.totals.__getitem__, words))
        total = sum(totals)
        if total <= limit:
            return total, len(text)
        sums = np.cumsum(totals)
        over = int(np.searchsorted(sums, limit, side="right"))  # the first word that ends beyond
        before = int(sums[over - 1]) if over else 0
        inside = np.flatnonzero(before + self.known[words[over]] <= limit)
        chars = sum(map(len, words[:over])) + (int(inside[-1]) + 1 if len(inside) else 0)
        return total, max(chars - 1, 0)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.col(f"`{text}`").cast("string").cast("binary")
    return docs.select(F.col(f"`{key}`").alias("doc_id"), whole.alias("text"))


def _decoded(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def count_tokens(
    docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit, and what fits: fit_chars.

    ``fit_chars`` counts the characters of the longest prefix of at most ``limit`` tokens. The
    counts are those of the model's own library, whole texts are counted however long, and no
    rows meet, so nothing is shuffled. A null or empty text has no bytes and no tokens. Rows may
    repeat and keys may be null or repeated; other columns are not carried.
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(model)
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            values = batch.column(1).to_pylist()
            found = [table.total_and_fit(_decoded(value), limit) for value in values]
            totals = [total for total, _ in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(value or b"") for value in values], pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array([total > limit for total in totals], pa.bool_()),
                pa.array([fit for _, fit in found], pa.int64()),
            ], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return _texts(docs, key, text).mapInArrow(count, schema)


def prefix_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and ``counts``, the token count at each prefix of 0, 1, ... characters.

    The array answers any later question of truncation or budget: ``counts[i]`` is what the first
    ``i`` characters cost alone. It may fall from one prefix to the next, where a longer piece
    takes the place of several. A null or empty text gives ``[0]``.
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(model)
        for batch in (b.slice(at, 32) for b in batches for at in range(0, b.num_rows, 32)):
            counts = [table.counts(_decoded(value)) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "counts"]
            )

    return _texts(docs, key, text).mapInArrow(count, f"doc_id {kind}, counts array<long>")


def cut_to_budget(docs: DataFrame, model: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and text, cut to its longest prefix of at most ``limit`` tokens.

    A text that fits stays whole; a null text comes back empty.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(model)
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            texts = [_decoded(value) for value in batch.column(1).to_pylist()]
            kept = [value[: table.total_and_fit(value, limit)[1]] for value in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return _texts(docs, key, text).mapInArrow(cut, f"doc_id {kind}, text string")
