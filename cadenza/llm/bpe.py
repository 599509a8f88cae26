"""BPE encoding and decoding of whole texts with a byte-level vocabulary.

A text is cut into words by the tokenizer's pattern. A word's bytes are parts in one list, with the ranks of all
adjacent pairs in a second list beside it; the smallest rank is looked for by scanning, its boundary is deleted, and
the two ranks next to it are refreshed. Words of over SCANNED bytes keep their ranks in a heap instead, which gives
the same merges without a scan of the whole list for each. Words recur, so each Python worker keeps the ids of the
words that it has met, up to a fixed number.

The vocabulary file is named by path and read once by each worker. Texts are encoded where they are; nothing is
shuffled.

Defined results: null and empty texts have no ids and decode to an empty text; special tokens written out in a text
are that token's id, as the vocabulary file says; a very long text is held whole by its task; repeated rows each get
their own result; ids come back as they were, null ones beside large ones too; further columns are left out, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of up to so many bytes are scanned for the smallest rank.
SCANNED = 64
#: Words that a worker keeps, and the longest of them in characters.
KEPT_WORDS, KEPT_CHARS = 300_000, 32
#: Ids that a task holds before it hands them on.
HELD_IDS = 250_000
NEVER = 1 << 60
#: The pattern that byte-level vocabularies of this kind are made with, and white space as it means it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> dict[str, int]:
    """The printable letter that vocabulary files write for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def newer_characters() -> str:
    """As ranges for a set: letters and numbers that the regex module knows and the tokenizers library, of an earlier Unicode, doesn't.

    Only characters that this Python doesn't know either are in question; the library's pre-tokenizer is asked for each."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    found = (c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    runs: list[list[int]] = []
    for c in map(ord, (c for c in found if len(cut(("a" if regex.match(r"\p{L}", c) else "1") + c)) > 1)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


class Vocabulary:
    """Ranks, ids and bytes of a byte-level BPE vocabulary in a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        ids: dict[str, int] = told["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        # (left id << 32 | right id) -> rank, and rank -> merged id
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        self.rank = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        plain = PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pattern = regex.compile(plain)
        newer = newer_characters()
        self.newer = regex.compile(f"[{newer}]") if newer else None
        sets = {r"?\p{L}+": f"?[\\p{{L}}--[{newer}]]+", r"?\p{N}+": f"?[\\p{{N}}--[{newer}]]+", r"\p{L}\p{N}]+": f"[\\p{{L}}\\p{{N}}--[{newer}]]]+"}
        for a, b in sets.items():
            plain = plain.replace(a, b)
        self.careful = regex.compile("(?V1)" + plain) if newer else self.pattern
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        return self._scan(word) if len(word) <= SCANNED else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        rank, byte_ids = self.rank.get, self.byte_ids
        parts = [byte_ids[b] for b in word]
        ranks = [rank(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NEVER)
        return parts

    def _heap(self, word: bytes) -> list[int]:
        rank, byte_ids = self.rank.get, self.byte_ids
        parts = [byte_ids[b] for b in word]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        waiting = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a << 32 | b, NEVER)) != NEVER]
        heapq.heapify(waiting)
        while waiting:
            r, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (r := rank(parts[left] << 32 | parts[right], NEVER)) != NEVER:
                    heapq.heappush(waiting, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[tuple[int, ...], str]:
        """A word's ids, and the same as decimal numbers joined by commas."""
        ids = tuple(self.merge(word.encode("utf-8", "surrogatepass")))
        found = ids, ",".join(map(str, ids))
        if len(word) <= KEPT_CHARS and len(self.known) < KEPT_WORDS:
            self.known[word] = found
        return found

    def encode(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """The ids of a text, word by word."""
        found, known, word = [], self.known, self.word
        pieces = self.specials.split(text) if self.specials else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                i = self.special[piece]
                found.append(((i,), str(i)))
            elif piece:
                pattern = self.careful if self.has_newer(piece) else self.pattern
                found += [known.get(w) or word(w) for w in pattern.findall(piece)]
        return found

    def has_newer(self, text: str) -> bool:
        """Whether the careful pattern is needed; Latin-1 texts are told apart without a look at each character."""
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return self.newer is not None and self.newer.search(text) is not None

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One for each file and Python worker."""
    return Vocabulary(path)


def encoded(documents: DataFrame, vocabulary_path: str, *, id_column: str = "doc_id", text_column: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text) and, if asked for, the ids of every row."""
    held = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = f"doc_id {held.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if ids else {})

    def framed(names: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([f[k] for f in found], type=kind) for k, kind in enumerate(kinds.values())]
        return pa.RecordBatch.from_arrays([names, *columns], names=["doc_id", *kinds])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for rows in batches:
            names, found, done, held = rows.column("doc_id"), [], 0, 0  # ids stay in Arrow, as they are
            for text in rows.column("text").to_pylist():
                words = v.encode(text or "")
                flat = [i for w in words for i in w[0]]
                told = hashlib.sha256(",".join([w[1] for w in words]).encode()).hexdigest()
                back = hashlib.sha256(v.decode(flat).encode("utf-8", "surrogatepass")).hexdigest()
                found.append((len(flat), told, back, *([np.array(flat, dtype=np.int32)] if ids else [])))
                held += len(flat)
                if ids and held >= HELD_IDS:
                    yield framed(names.slice(done, len(found)), found)
                    done, found, held = done + len(found), [], 0
            yield framed(names.slice(done), found)

    return held.mapInArrow(encode, schema)


def decoded(tokens: DataFrame, vocabulary_path: str, *, ids_column: str = "ids", to: str = "text") -> DataFrame:
    """The rows with the text of their ids in a further column; null ids give null."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        v = vocabulary(vocabulary_path)
        return pd.Series([None if x is None else v.decode(x.tolist()) for x in ids], index=ids.index, dtype=object)

    return tokens.withColumn(to, decode(F.col(ids_column)))
