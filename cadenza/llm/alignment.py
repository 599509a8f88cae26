"""Alignment of two tokenizers over whole texts, by elementary intervals.

Both tokenizers' tokens cover the bytes of a space and the text. The ends of all tokens, joined and sorted, cut the bytes
into elementary intervals; each interval is one overlap of the A token and the B token that own it, which are found by
bisection. Where both tokens end, a group of tokens is closed.

No token of either tokenizer crosses into white space that follows something else (whether the two files keep to that is
looked up in the vocabulary and tried out first; a character that breaks the rule, such as a carriage return in some
vocabularies, glues what is around it together). So a text is cut into units, white space and what follows it, whose
tokens, groups and links are the same wherever they stand. A worker aligns each different unit once, many at a time in
one pass of the interval method, and keeps the result up to a fixed number of units; documents add units up.

Documents are aligned once: sums, digest and the different links of each (ids and how often, compressed) are written to
the shared folder. From there tasks add up how often two ids are linked, and Spark adds up the tasks' rows. The counts go
to the tasks that need them while there are at most `held_pairs` of them; beyond that documents' links are joined to the
counts by Spark, dealt by a salt. Both give the same rows.

Defined results: null and empty texts, and texts whose tokens don't give back their bytes (those with U+2581, which the
B tokenizer takes for a space), have no tokens, zeros and an empty digest. Words of special tokens in a text are plain
text. Very long texts and units are held whole by one task; long units are aligned but not kept. Repeated rows each get
their own result and count as often as they are there; ids come back as they were; further columns are left out, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.bpe import SPACE, byte_letters
from cadenza.llm.components import checkpoint_dir

#: Links' different id pairs that are sent to tasks at most.
HELD_PAIRS = 4_000_000
#: Units that a worker keeps, and the longest of them in characters.
KEPT, KEPT_CHARS = 600_000, 40
#: Characters of text that are aligned together.
AT_ONCE = 2_000_000
#: Units that are encoded as one text.
RUN = 1000
SALTS = 16
#: Links that a task counts together.
COUNTED = 4_000_000
#: Sums of a unit or document: its A and B tokens, groups and links.
SUMS = ("n_a", "n_b", "n_groups", "n_links")


class Tokens:
    """Ids and bytes by the two tokenizers of strings that begin with white space."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(a_path, encoding="utf-8") as f:
            vocabulary: dict[str, int] = json.load(f)["model"]["vocab"]
        self.a_bytes = {i: bytes(map(letters.__getitem__, token)) for token, i in vocabulary.items()}
        self.lossless = self.a.normalizer is None and {bytes([k]) for k in range(256)} <= set(self.a_bytes.values())  # bytes come back by construction
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.b_space = pieces.index("▁")
        self.units = self._pattern([p.replace("▁", " ") for p in pieces if not p.startswith("<")])
        tried = "  two words,\n\nlines\tand  it's 12 x　y \r\n\r z  ;\r!"
        if self._whole(tried) != [[i for ids in per for i in ids] for per in self.encode(self.units.findall(" " + tried))]:
            self.units, self.plain = regex.compile(r"(?s).+"), False  # then a text is one unit

    def _pattern(self, pieces: list[str]) -> regex.Pattern:
        """Units: white space and what follows it, on to the next white space without a gluing character."""
        glue = {c for p in pieces for c in p if c != " " and regex.match(f"[{SPACE}]", c)}
        if any(regex.search(f"[^{SPACE}] ", p) for p in pieces):
            glue.add(" ")
        self.plain = not glue & {" ", "\n"}
        if not glue:
            return regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        g = "".join(map(regex.escape, sorted(glue)))
        return regex.compile(f"(?V1)[{SPACE}]*[^{SPACE}]+(?:[[{SPACE}]--[{g}]]*[{g}][{SPACE}]*[^{SPACE}]*)*|[{SPACE}]+")

    def _whole(self, text: str) -> list[list[int]]:
        return [self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each unit in its text, one by one. The B tokenizer puts a space before what it is given: the unit's own
        first space is left to it, and where a unit begins with other white space, the space put there is taken off."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return a, [[self.b_space] if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, b, strict=True)]

    def encode_run(self, units: list[str]) -> tuple[list[int], list[int]] | None:
        """The ids of units that don't end in white space, one after the other as one text; None if that text's bytes don't
        come back. The first unit begins with a space."""
        text = "".join(units)
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        raw = text.encode("utf-8", "surrogatepass")
        same = raw == b"".join(map(self.b_bytes.__getitem__, b)) and (self.lossless or raw == b"".join(map(self.a_bytes.__getitem__, a)))
        return (a, b) if same else None

    def cut(self, text: str) -> list[str]:
        """The units of space and text."""
        words, single = text.split(), text.count(" ") + text.count("\n")
        if self.plain and len(words) == single + 1 and sum(map(len, words)) + single == len(text):  # no white space but single ones between words
            return (" " + text.replace(" ", "\x1f ").replace("\n", "\x1f\n")).split("\x1f")
        return self.units.findall(" " + text)


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, owner among A tokens, owner among B tokens, whether both end) of every elementary interval."""
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return cuts, a, b, (ends_a[a] == cuts) & (ends_b[b] == cuts)


def weighed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, in order, and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def press(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Links (A id above 32 bits, B id) and how often each is there, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(keys >> 32, prepend=0), keys & 0xFFFFFFFF, times]).astype("<u4").tobytes())


def unpress(links: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of some documents one after the other, how often each is there, and how many each document has."""
    take = zstandard.ZstdDecompressor().decompress
    own = [np.frombuffer(take(x) if x else b"", dtype="<u4").reshape(3, -1).astype(np.int64) for x in links]
    keys = [x[0].cumsum() << 32 | x[1] for x in own]
    nothing = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(nothing + keys), np.concatenate(nothing + [x[2] for x in own]), np.array([x.shape[1] for x in own], dtype=np.int64)


class Aligner:
    """Units' alignments, kept from text to text."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        sized = lambda found: np.array([len(found.get(i, b"")) for i in range(max(found) + 1)], dtype=np.int64)
        self.a_sizes, self.b_sizes = sized(tokens.a_bytes), sized(tokens.b_bytes)
        # an id's digits with what can follow it: the next id of its side, or the next side or group
        self.digits = [np.array([f"{i}{end}" for i in range(len(of))], dtype=object) for of, end in ((self.a_sizes, ","), (self.a_sizes, "|"), (self.b_sizes, ","), (self.b_sizes, ";"))]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}  # of each unit among all that have been aligned
        self.groups: list[str] = []
        self.sums = np.zeros((1 << 12, len(SUMS)), dtype=np.int64)
        self.starts = np.zeros(1 << 12, dtype=np.int64)  # of each unit's links
        self.links, self.n_links = np.zeros(1 << 14, dtype=np.int64), 0
        self.failed: set[int] = set()

    def learn(self, units: list[str]) -> None:
        """Aligns units that aren't known, many at once: they are encoded as runs of text, and the intervals of a run come
        from its bytes as a whole."""
        first = len(self.groups)
        self.place.update(zip(units, range(first, first + len(units))))
        self.groups += [""] * len(units)
        while len(self.sums) < len(self.groups):
            self.sums, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.starts))
        self.sums[first : len(self.groups)] = 0
        alone = [k for k, u in enumerate(units) if u[-1].isspace() or "▁" in u]
        apart = set(alone)
        rest = [k for k in range(len(units)) if k not in apart]
        for at in range(0, len(rest), RUN):
            own = rest[at : at + RUN]
            run = [units[k] for k in own]
            if (found := self.tokens.encode_run([" x", *run])) is None:
                alone += own
            else:
                self._take(np.array([0, *own]) + first, [" x", *run], *found, 1)
        if alone:
            own = [units[k] for k in alone]
            for k, u, a, b in zip(alone, own, *self.tokens.encode(own), strict=True):
                raw = u.encode("utf-8", "surrogatepass")
                if b"".join(map(self.tokens.a_bytes.__getitem__, a)) == raw == b"".join(map(self.tokens.b_bytes.__getitem__, b)):
                    self._take(np.array([first + k]), [u], a, b, 0)
                else:
                    self.failed.add(first + k)

    def links_of(self, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The different links of units, and how often each is there."""
        at = np.array(places)
        n = self.sums[at, 3]
        before = n.cumsum() - n
        return weighed(self.links[np.arange(n.sum()) + np.repeat(self.starts[at] - before, n)], np.ones(n.sum(), dtype=np.int64))

    def _take(self, places: np.ndarray, units: list[str], a: list[int], b: list[int], skip: int) -> None:
        """Keeps the alignment of units that stand one after the other, but for the first few."""
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        cuts, own_a, own_b, closes = intervals(self.a_sizes[a].cumsum(), self.b_sizes[b].cumsum())
        edges = np.array([len(u.encode("utf-8", "surrogatepass")) for u in units]).cumsum()
        ends = np.searchsorted(cuts, edges) + 1  # of each unit's intervals
        starts = np.concatenate([[0], ends[:-1]])
        if not (closes[ends - 1].all() and (cuts[ends - 1] == edges).all()):
            raise ValueError("a token reaches beyond its unit")
        keys = a[own_a] << 32 | b[own_b]
        while len(self.links) < self.n_links + len(keys):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[self.n_links : self.n_links + len(keys)] = keys
        self.starts[places[skip:]] = self.n_links + starts[skip:]
        self.n_links += len(keys)
        sums = np.zeros((len(units), len(SUMS)), dtype=np.int64)
        sums[:, 0], sums[:, 1] = np.diff(own_a[ends - 1], prepend=-1), np.diff(own_b[ends - 1], prepend=-1)
        sums[:, 2], sums[:, 3] = np.add.reduceat(closes.astype(np.int64), starts), ends - starts
        self.sums[places[skip:]] = sums[skip:]
        # the text of all groups: each group's A ids and then its B ids, every id with what follows it
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[own_a[closes]] = last_b[own_b[closes]] = True
        group_a, group_b = last_a.cumsum() - last_a, last_b.cumsum() - last_b
        told = np.concatenate([np.where(last_a, self.digits[1][a], self.digits[0][a]), np.where(last_b, self.digits[3][b], self.digits[2][b])])
        told = told[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        upto = (own_a[ends - 1] + own_b[ends - 1] + 2).tolist()
        for place, x, y in zip(places[skip:].tolist(), [0, *upto][skip:], upto[skip:], strict=False):
            self.groups[place] = "".join(told[x:y])[:-1]

    def places(self, texts: list[str | None]) -> Iterator[tuple[int, list[int] | None]]:
        """(number of the text, its units' places, or None if it has no tokens), a run of texts after the other; what is
        known may be forgotten between runs."""
        at = 0
        while at < len(texts):
            if len(self.groups) > KEPT:
                self.forget()
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            cut = [self.tokens.cut(t) if t else [] for t in texts[at:end]]
            if new := [u for u in set().union(*cut) if u not in self.place]:
                self.learn(new)
            for k, units in enumerate(cut):
                found = list(map(self.place.__getitem__, units))
                yield at + k, None if not found or (self.failed and not self.failed.isdisjoint(found)) else found
            for u in new:
                if len(u) > KEPT_CHARS:
                    where = self.place.pop(u)
                    self.groups[where] = ""
            at = end


@lru_cache(maxsize=1)
def tokens_of(a_path: str, b_path: str) -> Tokens:
    """One for each pair of files and Python worker."""
    return Tokens(a_path, b_path)


def aligned(documents: DataFrame, a_path: str, b_path: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, row (a number of its own), the sums, groups_sha256 and links (see press) of every document."""
    held = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(tokens_of(a_path, b_path)), TaskContext.get().partitionId() << 33
        for rows in batches:
            sums, digests, links = np.zeros((rows.num_rows, len(SUMS)), dtype=np.int64), [""] * rows.num_rows, [None] * rows.num_rows
            for k, found in aligner.places(rows.column("text").to_pylist()):
                if found:
                    sums[k] = aligner.sums[found].sum(axis=0)
                    digests[k] = hashlib.sha256(";".join(map(aligner.groups.__getitem__, found)).encode()).hexdigest()
                    links[k] = press(*aligner.links_of(found))
            own = [pa.array(np.arange(row, row + rows.num_rows)), *(pa.array(sums[:, k]) for k in range(len(SUMS))), pa.array(digests, pa.string()), pa.array(links, pa.binary())]
            row += rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *own], names=["doc_id", "row", *SUMS, "groups_sha256", "links"])

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(align, ", ".join([f"doc_id {kind}, row long", *(f"{c} long" for c in SUMS), "groups_sha256 string, links binary"]))


def link_columns(keys: np.ndarray) -> list[pa.Array]:
    return [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32))]


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links of all aligned documents hold the ids a and b, and whether no A id has more with b."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for rows in batches:
            links, at = rows.column("links").to_pylist(), 0
            while at < len(links):
                end, size = at, 0
                while end < len(links) and size < COUNTED:
                    size += len(links[end] or b"")
                    end += 1
                more, n, _ = unpress(links[at:end])
                keys, times = weighed(np.concatenate([keys, more]), np.concatenate([times, n]))
                at = end
                if len(keys) > COUNTED:
                    yield pa.RecordBatch.from_arrays([*link_columns(keys), pa.array(times)], names=["a", "b", "n"])
                    keys, times = keys[:0], times[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([*link_columns(keys), pa.array(times)], names=["a", "b", "n"])

    whole = found.select("links").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return whole.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))  # a row for each A id at most


def alignment(documents: DataFrame, a_path: str, b_path: str, *, id_column: str = "doc_id", text_column: str = "text", held_pairs: int = HELD_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    spark = documents.sparkSession
    checkpoint_dir(spark)
    told = aligned(documents, a_path, b_path, id_column=id_column, text_column=text_column).checkpoint()
    pairs = pair_counts(told).checkpoint()
    if pairs.count() > held_pairs:
        return with_joined_counts(told, pairs)
    table = pairs.toPandas()
    keys = table["a"].to_numpy(np.int64) << 32 | table["b"].to_numpy(np.int64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], table["n"].to_numpy(np.int64)[order], table["best"].to_numpy(bool)[order]))  # of a checked size
    passed = ["doc_id", *SUMS, "groups_sha256"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often, is_best = sent.value
        for rows in batches:
            best, counts = np.zeros(rows.num_rows, dtype=np.int64), np.zeros(rows.num_rows, dtype=np.int64)
            for k, links in enumerate(rows.column("links").to_pylist()):
                if links:
                    own, times, _ = unpress([links])
                    at = np.searchsorted(known, own)
                    best[k], counts[k] = (is_best[at] * times).sum(), (often[at] * times).sum()
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in passed), pa.array(best), pa.array(counts)], names=[*passed, "n_best", "count_sum"])

    kinds = {f.name: f.dataType.simpleString() for f in told.schema.fields}
    return told.drop("row").mapInArrow(summed, ", ".join([*(f"{c} {kinds[c]}" for c in passed), "n_best long, count_sum long"]))


def with_joined_counts(told: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents with n_best and count_sum from a join of their links to the counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row, links in zip(rows.column("row").to_pylist(), rows.column("links").to_pylist(), strict=True):
                if links:
                    keys, times, _ = unpress([links])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), *link_columns(keys), pa.array(times)], names=["row", "a", "b", "times"])

    own = told.select("row", "links").mapInArrow(each, "row long, a int, b int, times long").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    dealt = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = own.join(dealt, ["a", "b", "salt"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return told.drop("links").join(sums, "row", "left").select("doc_id", *SUMS, "groups_sha256", none("n_best"), none("count_sum"))


GROUP = "struct<start:bigint,end:bigint,a:array<int>,b:array<int>>"


def token_groups(documents: DataFrame, a_path: str, b_path: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and groups (place in the bytes of space and text, A ids, B ids) of every document; no groups without tokens."""
    held = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokens_of(a_path, b_path))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for rows in batches:
            found = [[] for _ in range(rows.num_rows)]
            for k, places in aligner.places(rows.column("text").to_pylist()):
                end = 0
                for group in ";".join(map(aligner.groups.__getitem__, places)).split(";") if places else ():
                    a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                    start, end = end, end + int(aligner.a_sizes[a].sum())
                    found[k].append({"start": start, "end": end, "a": a, "b": b})
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found, kind)], names=["doc_id", "groups"])

    return held.mapInArrow(told, f"doc_id {held.schema['doc_id'].dataType.simpleString()}, groups array<{GROUP}>")


def group_products(grouped: DataFrame) -> DataFrame:
    """(doc_id, start, end, a, b): every A id of a group beside every B id of it."""
    each = grouped.select("doc_id", F.explode("groups").alias("g")).select("doc_id", "g.start", "g.end", F.explode("g.a").alias("a"), F.col("g.b").alias("bs"))
    return each.select("doc_id", "start", "end", "a", F.explode("bs").alias("b"))
