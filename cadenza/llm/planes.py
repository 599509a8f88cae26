"""Token ids in binary files of shuffled planes.

Documents are dealt by ranges of their ids, sorted, encoded where they then are, and written as one file for each
range, or several if it holds many ids: a file's size, and what a task keeps of it, is bounded whatever the input. A file holds blocks of BLOCK ids; a block's ids are transposed into byte planes (or bit planes), and each
plane is compressed with zstandard on its own. After the blocks come the documents' ids and lengths, and an index
that has each block's place and planes, so that a reader fetches any block by itself and holds one at a time.

A file is written under a name of its own attempt and renamed when it is whole, so lost and repeated tasks leave
one file of each name. Files go to the folder that the caller names, which must be shared; pyarrow's file systems
open it. Only one row for each file reaches the driver.

Layout, integers little-endian: magic; planes of block 0, 1, ...; documents (zstandard: a byte for each id that is
null, ids as int64, lengths as int64); index (zstandard: for each block its number of ids and place as int64, then
the lengths of its planes as int64); int64 x 6: kind (8 or 1 bits a plane), planes, blocks, documents, bytes of the
documents' section, bytes of the index; magic.

Defined results: null and empty texts have the end id alone; documents come by id, null first, and repeated ids by
text, null first; a very long text is held whole by its task; ids come back as they were; further columns are left
out, whatever their names; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.components import checkpoint_dir

MAGIC = b"PLANES01"
BLOCK = 1 << 16
TRAILER = 6 * 8 + len(MAGIC)
#: A file's ids, but for its last document's, and documents at most.
FILE_IDS, FILE_DOCS = 1 << 27, 1 << 20
FILES = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
#: Pieces of text that a worker keeps encoded, and the longest of them in bytes.
KEPT, KEPT_BYTES = 600_000, 40
#: Characters of text that are encoded together, and words that go to the model in one text.
AT_ONCE, RUN = 2_000_000, 1000
#: Latin letters, in UTF-8, and then marks other than the apostrophe, if any: to the tokenizer a word and a word of
#: marks, neither of which depends on the other.
LATIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def to_planes(ids: np.ndarray, bits: int = 8, planes: int = 4) -> list[bytes]:
    """The planes of a block: plane k has the k-th byte (or bit) of every id."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(planes)]
    each = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(each[:, k], bitorder="little").tobytes() for k in range(planes)]


def from_planes(planes: list[bytes], n: int, bits: int = 8) -> np.ndarray:
    if bits == 8:
        rows = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            rows[:, k] = np.frombuffer(p, dtype=np.uint8)
    else:
        each = np.zeros((n, 32), dtype=np.uint8)
        for k, p in enumerate(planes):
            each[:, k] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little")
        rows = np.packbits(each, axis=1, bitorder="little")
    return rows.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes documents' ids to an open file, block by block."""

    def __init__(self, out, bits: int = 8, planes: int | None = None, level: int = 3):
        self.out, self.bits, self.planes = out, bits, planes or (4 if bits == 8 else 32)
        self.press = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held, self.at, self.total = 0, len(MAGIC), 0
        self.names: list[int | None] = []
        self.lengths: list[int] = []
        self.index: list[tuple[int, ...]] = []
        out.write(MAGIC)

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.names.append(name)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BLOCK:
            run = np.concatenate(self.waiting)
            whole = len(run) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(run[k : k + BLOCK])
            self.waiting, self.held = [run[whole:]], len(run) - whole

    def _block(self, ids: np.ndarray) -> None:
        pressed = [self.press.compress(p) for p in to_planes(ids, self.bits, self.planes)]
        self.index.append((len(ids), self.at, *map(len, pressed)))
        for p in pressed:
            self.out.write(p)
        self.at += sum(map(len, pressed))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        nulls = np.array([n is None for n in self.names], dtype=np.uint8)
        names = np.array([n or 0 for n in self.names], dtype="<i8")
        told = self.press.compress(nulls.tobytes() + names.tobytes() + np.array(self.lengths, dtype="<i8").tobytes())
        index = self.press.compress(np.array(self.index, dtype="<i8").tobytes())
        self.out.write(told + index)
        self.out.write(np.array([self.bits, self.planes, len(self.index), len(self.names), len(told), len(index)], dtype="<i8").tobytes() + MAGIC)


class PlaneReader:
    """Reads a file's index at once and its blocks one by one."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._at(size - TRAILER, TRAILER)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a whole file of planes")
        self.bits, self.planes, blocks, n, told, index = np.frombuffer(tail[: -len(MAGIC)], dtype="<i8").tolist()
        unpress = zstandard.ZstdDecompressor().decompress
        self.index = np.frombuffer(unpress(self._at(size - TRAILER - index, index)), dtype="<i8").reshape(blocks, 2 + self.planes)
        raw = unpress(self._at(size - TRAILER - index - told, told))
        names = np.frombuffer(raw, dtype="<i8", count=n, offset=n).tolist()
        self.names = [None if null else name for null, name in zip(raw[:n], names, strict=True)]
        self.lengths = np.frombuffer(raw, dtype="<i8", count=n, offset=9 * n)

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        n, place, *sizes = self.index[k].tolist()
        raw, planes, unpress = self._at(place, sum(sizes)), [], zstandard.ZstdDecompressor().decompress
        for s in sizes:
            planes.append(unpress(raw[:s]))
            raw = raw[s:]
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document's id and its ids, in the pieces that its blocks hold."""
        k, ids = 0, np.zeros(0, dtype="<u4")
        for name, left in zip(self.names, self.lengths.tolist(), strict=True):
            pieces = []
            while left:
                if not len(ids):
                    ids, k = self.block(k), k + 1
                pieces.append(ids[:left])
                left -= len(pieces[-1])
                ids = ids[len(pieces[-1]) :]
            yield name, pieces


class TextEncoder:
    """Ids of whole texts, as little-endian bytes, by the tokenizers library.

    A tokenizer that drops white space never merges across it, so a text's ids are those of its pieces between white
    space; each different piece is encoded by the library once. Words of lower-case Latin letters need no
    normalising and no cutting, so they go to the library's model many at a time, with white space between them, and
    are told apart by the tokens that end a word; whether this tokenizer works so is tried out first."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = Tokenizer.from_str(self.tokenizer.to_str())
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        tried = ["the", "straße", "élan", "ooooooooo", "qzxj"]
        self.cuts_words = all(self.tokenizer.encode(w, add_special_tokens=False).ids == self.plain.encode(w, add_special_tokens=False).ids for w in tried)
        self.cuts_words &= all(self.ends[self.plain.encode(w, add_special_tokens=False).ids].nonzero()[0].tolist() == [len(self.plain.encode(w, add_special_tokens=False).ids) - 1] for w in tried)
        self.known: dict[bytes, bytes] = {}

    def _learn_words(self, words: list[bytes]) -> None:
        runs = [b" ".join(words[k : k + RUN]).decode() for k in range(0, len(words), RUN)]
        for k, e in enumerate(self.plain.encode_batch_fast(runs, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            raw, places = ids.tobytes(), (4 * (self.ends[ids].nonzero()[0] + 1)).tolist()
            own = words[k * RUN : (k + 1) * RUN]
            if len(own) != len(places):
                raise ValueError("the tokenizer left a word without its end")
            self.known.update((w, raw[a:b]) for w, a, b in zip(own, [0, *places], places, strict=False))

    def _learn(self, new: list[bytes]) -> None:
        """Takes up the ids of pieces that aren't known."""
        known, words, others, made = self.known, set(), set(), []
        for p in new:
            if (m := LATIN.fullmatch(p)) is None or not self.cuts_words:
                others.add(p)
                continue
            w, marks = m.groups()
            w = w.lower() if w.isascii() else w.decode().lower().encode()
            if w not in known:
                words.add(w)
            if marks and marks not in known:
                others.add(marks)
            if w != p:
                made.append((p, w, marks))
        self._learn_words(list(words))
        units = list(others)
        for u, e in zip(units, self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False), strict=True):
            known[u] = np.array(e.ids, dtype="<u4").tobytes()
        for p, w, marks in made:
            known[p] = known[w] + known[marks] if marks else known[w]

    def encode(self, texts: list[str]) -> list[bytes]:
        found: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                size += len(texts[end])
                end += 1
            pieces = [t.encode("utf-8", "replace").split() for t in texts[at:end]]  # bytes: at ASCII white space alone
            if len(self.known) > KEPT:
                self.known = {}
            new = [p for p in set().union(*pieces) if p not in self.known]
            self._learn(new)
            found += [b"".join(map(self.known.__getitem__, p)) for p in pieces]
            for p in new:
                if len(p) > KEPT_BYTES:
                    del self.known[p]
            at = end
        return found


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One for each file and Python worker."""
    return TextEncoder(path)


def write_planes(
    documents: DataFrame,
    folder: str,
    tokenizer_path: str,
    *,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    files: int | None = None,
    file_ids: int = FILE_IDS,
    file_docs: int = FILE_DOCS,
    bits: int = 8,
) -> list[dict]:
    """Writes the documents and returns one entry for each file, in order: file, n_docs, n_ids and start (ids in earlier files).

    files: ranges of ids that are written side by side. A range starts another file after file_ids ids or file_docs documents."""
    spark = documents.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    dealt = held.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], dtype="<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, out, draft, k = text_encoder(tokenizer_path), None, None, "", 0
        store, top = fs.FileSystem.from_uri(folder)
        number = TaskContext.get().partitionId()

        def finished() -> pa.RecordBatch:
            writer.close()
            out.close()
            name = f"part-{number:06d}-{k:05d}.planes"
            if store.get_file_info(f"{top}/{name}").type == fs.FileType.NotFound:
                store.move(draft, f"{top}/{name}")
            else:  # an earlier attempt at this task has written the same
                store.delete_file(draft)
            return pa.RecordBatch.from_pylist([{"part": number, "nth": k, "file": name, "n_docs": len(writer.names), "n_ids": writer.total}], schema=FILES)

        for rows in batches:
            names, texts = (rows.column(c).to_pylist() for c in ("doc_id", "text"))
            for doc, ids in zip(names, encoder.encode([t or "" for t in texts]), strict=True):
                if writer is not None and (writer.total >= file_ids or len(writer.names) >= file_docs):
                    yield finished()
                    writer, k = None, k + 1
                if writer is None:
                    store.create_dir(top, recursive=True)
                    draft = f"{top}/.draft-{number:06d}-{k:05d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                    writer = PlaneWriter(out, bits)
                writer.add(doc, np.concatenate((np.frombuffer(ids, dtype="<u4"), end)))
        if writer is not None:
            yield finished()

    told = dealt.mapInArrow(write, "part int, nth int, file string, n_docs long, n_ids long").collect()  # a row for each file
    store, top = fs.FileSystem.from_uri(folder)
    for left in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if left.base_name.startswith(".draft-"):  # of an attempt that was lost
            store.delete_file(left.path)
    wrote = sorted((r.asDict() for r in told), key=lambda r: (r["part"], r["nth"]))
    start = 0
    for r in wrote:
        r["start"], start = start, start + r["n_ids"]
    return wrote


def read_planes(spark: SparkSession, folder: str, files: list[dict], schema: str, each: Callable[[int, str, PlaneReader], pa.RecordBatch]) -> DataFrame:
    """The rows that each(start, file, reader) makes of every file, a task for each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for rows in batches:
            for r in rows.to_pylist():
                with store.open_input_file(f"{top}/{r['file']}") as source:
                    yield each(r["start"], r["file"], PlaneReader(source))

    listed = spark.createDataFrame([(r["start"], r["file"]) for r in files], "start long, file string")
    return listed.repartitionByRange(max(1, len(files)), "start").mapInArrow(read, schema)


def document_checksums(start: int, file: str, reader: PlaneReader) -> pa.RecordBatch:
    found = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
    for doc, pieces in reader.documents():
        crc = 0
        for p in pieces:
            crc = zlib.crc32(p.tobytes(), crc)
        n = sum(map(len, pieces))
        for told, x in zip(found.values(), (doc, start, n, crc), strict=True):
            told.append(x)
        start += n
    return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in found.values()], names=list(found))


def token_files(documents: DataFrame, tokenizer_path: str, *, folder: str | None = None, **options) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files written (to the shared folder unless one is named)."""
    spark = documents.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/planes-{uuid.uuid4().hex}"
    files = write_planes(documents, folder, tokenizer_path, **options)
    return read_planes(spark, folder, files, "doc_id long, start long, n_tokens long, ids_crc32 long", document_checksums)
