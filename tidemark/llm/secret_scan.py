"""Secrets in texts: patterns, and strings a tokenizer can only cut into tiny tokens."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import free_name

#: Kind, pattern, the group whose length counts, and its least length.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_PATTERNS = [(kind, re.compile(pattern, re.ASCII), group, least) for kind, pattern, group, least in BASE]


@lru_cache(maxsize=4)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _unlike_words(text: str, path: str, ratio: float) -> bool:
    """Whether the runs of letters in a text have few characters a token, in both cases.

    One or two letters that are a token are left out: they say nothing, as in ``a-b-c`` or ``of``.
    """
    encode, letters, tokens = _encoder(path).encode_ordinary, 0, 0
    for part in re.findall(r"[A-Za-z]+", text):
        size = min(len(encode(part)), len(encode(part.lower())))
        if size > 1 or len(part) > 2:
            letters, tokens = letters + len(part), tokens + size
    return letters < ratio * tokens


def _random(text: str, path: str, ratio: float) -> bool:
    """Whether a run has letters, is neither an identifier nor a digest, and few characters make a token."""
    kinds = [any(c.isdigit() for c in text), any(c.isupper() for c in text), any(c.islower() for c in text)]
    if not any(kinds[1:]):
        return False
    if UUID.fullmatch(text) or re.fullmatch(r"[0-9A-Fa-f]+", text) and len(text) in DIGEST_SIZES:
        return False
    if sum(kinds) < 2 or not kinds[0] and re.fullmatch(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/](?:[A-Z]?[a-z]+|[A-Z]+))*", text):
        return _unlike_words(text, path, ratio)
    return len(text) < ratio * len(_encoder(path).encode_ordinary(text))


def spans_of(text: str | None, path: str, ratio: float = 2.2) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) of one text, by start and then by kind as listed."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(_PATTERNS):
        for match in pattern.finditer(text or ""):
            if len(match[group]) >= least:
                found.append((match.start(), order, match.end(), kind, match[group]))
    taken = [(start, end) for start, _, end, _, _ in found]
    for match in RUN.finditer(text or ""):
        start, end = match.span()
        if not any(a <= start and end <= b for a, b in taken) and _random(match[0], path, ratio):
            found.append((start, len(BASE), end, "random", match[0]))
    return [(kind, start, end, secret) for start, _, end, kind, secret in sorted(found)]


def scan_secrets(
    docs: DataFrame, text: str = "text", into: str = "spans", vocabulary: str | None = None, ratio: float = 2.2
) -> DataFrame:
    """``docs`` with a column ``into``: an array of (kind, start, end, secret) of each whole text.

    ``assign``, ``access`` and ``hex`` are the leftmost non-overlapping matches of the patterns,
    less those that are too short. ``random`` marks a further run of 20 or more characters of
    base64 or a name that lies in no such match (it may hold one): with a letter, not a UUID or a digest of a known
    length, and with fewer than ``ratio`` characters a token under the tiktoken vocabulary at
    ``vocabulary`` (a file on every machine; None: ``byte_bpe_50k.tiktoken`` of the installed
    public tokenizers). Of a run without digits that is a compound of words, or of letters of one
    case, only the letters are judged. Dots end a run: each segment of a dotted string is judged by
    itself. Places are code points, ends exclusive; they are in order of start.

    A null or empty text has an empty array. Rows and other columns stay as they are; a column
    ``into`` of the input is replaced.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,secret:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [
            {"kind": k, "start": a, "end": b, "secret": s} for k, a, b, s in spans_of(t, vocabulary, ratio)
        ])

    name = free_name(docs, "found")
    out = docs.withColumn(name, spans(F.col(f"`{text}`").cast("string")))
    return out.drop(into).withColumnRenamed(name, into)
