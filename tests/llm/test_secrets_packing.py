"""Secret spans and packed pieces against plain loops."""

import re
import string
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tidemark.llm import packing, secret_scan

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))
BYTES = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def kinds(text):
    return [(k, s) for k, _, _, s in secret_scan.spans_of(text, BYTES)]


def test_base_patterns():
    assert kinds('API_Key : "abcDEF123456/+" x') == [("assign", "abcDEF123456/+")]
    assert kinds("password=short secret=abcdefghijkl") == [("assign", "abcdefghijkl")]
    assert kinds("AKIAABCDEFGHIJKLMN AKIASHORT") == [("access", "AKIAABCDEFGHIJKLMN")]
    assert kinds("id 0123456789abcdef") == [("hex", "0123456789abcdef")]
    assert kinds("token = 0123456789abcdef00") == [("assign", "0123456789abcdef00"), ("hex", "0123456789abcdef00")]
    assert kinds("to\u212aen=abcdefghijkl") == []  # only ASCII letters count as either case
    assert kinds("") == kinds(None) == []


def test_random_strings_and_what_is_excluded():
    random = "q7Zp2LxV9Rk4TnW8sYb3Hd6G"
    assert kinds(f"before {random} after") == [("random", random)]
    assert kinds("D41D8CD98F00B204E9800998ECF8427E") == []  # a digest
    assert kinds("123E4567-E89B-12D3-A456-426614174000") == []  # an identifier
    assert kinds("internationalization_of_everything getUserAccountSettingsFromDatabase") == []
    assert kinds("é" + random) == kinds(random + "密钥") == [("random", random)]  # other letters end a run
    token = "ghp_abcdefabcdef0123456789XyZq9WvBt7LmNo"
    assert kinds(token) == [("random", token), ("hex", "abcdefabcdef0123456789")]
    assert kinds(f"secret={random}") == [("assign", random)]
    text = "x" * 50 + " " + random
    assert secret_scan.spans_of(text, BYTES)[0][1:3] == (51, 51 + len(random))


def test_dotted_tokens_and_random_letters_of_one_case():
    token = ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIiwiaWF0IjoxNTE2MjM5MDIyfQ",
             "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"]
    assert kinds(f"see {'.'.join(token)}.") == [("random", part) for part in token]
    key = ["q7Zp2LxV9Rk4TnW8sYb3Hd", "mW4kQ9zX2vB7nL5cR8tY1pD6sF3gH0jKaUeIoPqZxNw"]
    assert kinds(f"SG.{key[0]}.{key[1]}") == [("random", part) for part in key]
    assert kinds("www.internationalization.example.com/documentation/settings/account.html") == []
    for word in ("qzxkvjwpbnmtrqhgdzfk", "QZXKVJWPBNMTRQHGDZFK", "qzxkvjw-pbnmtrq-hgdzfk"):
        assert kinds(f"a {word} b") == [("random", word)]
    for word in ("internationalization", "UNCHARACTERISTICALLY", "rechtsschutzversicherungsgesellschaften",
                 "state-of-the-art-in-the-world", "a-b-c-d-e-f-g-h-i-j-k", "a+b+c+d+e+f+g+h+i+j=k", "src/main/java/org/qzxw/util"):
        assert kinds(f"a {word} b") == []


def test_scan_against_a_loop(spark, folder):
    out = {r.doc_id: r for r in entry.queries()["op4_secret_scans"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        found = [m for m in re.finditer(r"[0-9a-f]+", d.text) if len(m[0]) >= 16]
        assert out[d.doc_id].n_hex == len(found)
        for m in found:
            assert f"hex:{m.start()}:{m.end()}" in out[d.doc_id].spans
        assert all(int(b) > int(a) for _, a, b in (s.split(":") for s in out[d.doc_id].spans.split(",") if s))


def test_scan_keeps_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "token=abcdefghijkl", "b")]
    out = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    assert sorted(len(r.spans) for r in out.collect()) == [0, 0, 1]
    assert out.limit(0).count() == 0


@pytest.mark.parametrize("text", [
    "Hello  World", "a\u0301 b\u00a0c", "x!\x1c!y", "\u03a3\u03a3 it's 12 3", "<|endoftext|> a <| b", "", " \n\t ",
    "\u0130. D\u0130YARBAK\u0130, x \u0130 a\u0130! I\u0307.", "caf\u0065\u0301 \u1e9b\u0323", "don't\x0bcan't", "The.### ab, cd's. X1. \u00e9t\u00e9| (a) A\u0301.", string.printable, "\u2028a\u3000b",
])
def test_word_ids_are_those_of_the_whole_text(text):
    whole = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert packing.WordIds(VOCABULARY)(text).tolist() == whole


def test_word_ids_of_random_strings():
    rng = np.random.default_rng(3)
    letters = np.array(list("abcDEFzé\u0130\u0307\u0301ßΣς中0189.,!?'\"-_()<|> \n\t\u00a0\u200d"))
    encode, plain = packing.WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(20_000)]
    wide = np.array([chr(c) for c in range(0x80, 0x560)] + list("ab.,!' "))
    texts += ["".join(rng.choice(wide, rng.integers(0, 10))) + end for _ in range(4_000) for end in (".", "!?", "'s", " x", "")]
    for text, whole in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert encode(text).tolist() == whole.ids, text


def test_word_ids_on_documents(spark, folder, monkeypatch):
    monkeypatch.setattr(packing, "_REMEMBERED", 500)
    encode, plain = packing.WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect():
        assert encode(r.text).tolist() == plain.encode(r.text, add_special_tokens=False).ids


def check(pieces, size):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append((p.start, p.length, p.doc_tokens))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return by_sequence, by_doc


def test_packing_of_documents(spark, folder):
    pieces = entry.queries()["op7_packing"](spark, folder).collect()
    by_sequence, by_doc = check(pieces, 2048)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(by_doc) == set(docs)
    for parts in by_doc.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for p in pieces[:40]:
        ids = tokenizer.encode(docs[p.doc_id], add_special_tokens=False).ids + [1]
        part = np.asarray(ids[p.start : p.start + p.length], dtype="<u4")
        assert p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(ids)
    tokens = sum(p.length for p in pieces)
    assert len(by_sequence) <= tokens / 2048 * 1.03 + 1


def test_packing_of_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (2, ""), (3, "w " * 50), (2**60 + 1, "x")] + [(9, "a b")] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack_documents(frame, VOCABULARY, 8, with_ids=True).collect()
    check(pieces, 8)
    assert sum(p.length for p in pieces) == 4 + 4 + 1 + 1 + 51 + 2 + 120
    assert all(len(p.ids) == p.length for p in pieces) and 2**60 + 1 in {p.doc_id for p in pieces}
    assert packing.pack_documents(frame.limit(0), VOCABULARY).count() == 0


def test_patterns_hold_every_piece_once():
    rng = np.random.default_rng(1)
    for size in (1, 7, 64):
        histogram = {int(n): int(c) for n, c in zip(range(1, size + 1), rng.integers(0, 1000, size))}
        patterns = packing.shortest_pack_first(histogram, size)
        placed = defaultdict(int)
        for count, lengths in patterns:
            assert count > 0 and sum(lengths) <= size
            for length in lengths:
                placed[length] += count
        assert placed == {n: c for n, c in histogram.items() if c}
        tokens = sum(n * c for n, c in histogram.items())
        least = max(tokens / size, sum(c for n, c in histogram.items() if 2 * n > size))
        assert sum(c for c, _ in patterns) <= least * 1.06 + 2
