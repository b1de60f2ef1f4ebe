"""Token counts at every prefix against the library's own encoding."""

import random

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
from tidemark.llm import token_counts

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(MODEL)


def some_texts(names):
    rng = random.Random(7)
    odd = ["\r", "\t", "  ", "   ", "=", "-", "́", "é", "中", "①", "\U0001f600", "\x00", "İ", "<0x0A>", "</s>", "▁"]
    for _ in range(400):
        yield "".join(rng.choice(names) for _ in range(rng.randint(1, 6)))
        yield "".join(rng.choice("aabbcdetsion \n.,▁'") for _ in range(rng.randint(0, 25)))
        yield "".join(rng.choice(odd) for _ in range(rng.randint(0, 15)))
        yield "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x500)])) for _ in range(rng.randint(0, 20)))
    yield from ("", " ", "\n", "a" * 3000, " " * 40 + "x", "<s> [INST] hi </s>", "1.5, don't (no)... ok!")


def test_every_prefix(library, counter):
    for text in some_texts(list(counter.pieces)):
        counts = counter.counts(text)
        assert counts[-1] == len(library.encode(text)), text
        assert len(counts) == len(text) + 1 and counts[0] == 0
        for at in range(0, min(len(text), 30)):
            assert counts[at] == len(library.encode(text[:at])), (text, at)
        for limit in (0, 1, 3, 7):
            fit = max(at for at in range(len(text) + 1) if counts[at] <= limit)
            assert counter.total_and_fit(text, limit) == (counts[-1], len(text) if counts[-1] <= limit else fit)


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(token_counts, "_REMEMBERED", 50)
    monkeypatch.setattr(token_counts, "_REMEMBERED_PAIRS", 20)
    small = token_counts.PrefixCounter(MODEL)
    for text in some_texts(list(small.pieces)[:3000]):
        assert small.total_and_fit(text, 10)[0] == len(library.encode(text))
        assert not text or small.held <= 50 + len(text) + 1


def test_query_on_whole_texts(spark, folder, library):
    out = {r.doc_id: r for r in entry.queries()["op12_token_counts"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        row, tokens = out[d.doc_id], len(library.encode(d.text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(d.text.encode()), tokens, tokens > 4096)
        assert len(library.encode(d.text[: row.fit_chars])) <= 4096
        if tokens > 4096:
            assert len(library.encode(d.text[: row.fit_chars + 1])) > 4096
        else:
            assert row.fit_chars == len(d.text)
    assert any(r.over_limit for r in out.values())


def test_odd_rows(spark, library):
    long = "word é中, " * 30_000
    rows = [(1, None, 5), (1, "", 5), (None, "a b", 5), (2, long, 5), (2, long, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = sorted(token_counts.count_tokens(frame, MODEL, 100).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    whole = len(library.encode(long))
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out] == [
        (None, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False),
        (2, len(long.encode()), whole, True), (2, len(long.encode()), whole, True)]
    cut = {r.doc_id: r.text for r in token_counts.cut_to_budget(frame, MODEL, 100).collect()}
    assert cut[None] == "a b" and cut[1] == "" and len(library.encode(cut[2])) <= 100 < len(library.encode(long[: len(cut[2]) + 1]))
    counts = {r.doc_id: r.counts for r in token_counts.prefix_counts(frame, MODEL).collect()}
    assert counts[1] == [0] and counts[None] == [len(library.encode("a b"[:i])) for i in range(4)] and counts[2][-1] == whole
    assert token_counts.count_tokens(frame.limit(0), MODEL).count() == 0
