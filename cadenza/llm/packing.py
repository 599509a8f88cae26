"""Packing documents into sequences of a fixed number of tokens by linear grouping.

Documents are encoded where they are and cut into pieces; from then on only pieces' lengths matter, and there are no more
different lengths than a sequence has tokens. So the driver plans on a histogram, a table of bounded size whatever the
input, and no task or driver ever holds the pieces:

1. Linear grouping: large lengths, in descending order, are dealt to groups of equal numbers of pieces, and each group
   is rounded up to its largest length.
2. Configurations: the linear program over ways to fill a sequence with the few rounded sizes is solved by column
   generation, with a knapsack over tokens for the next columns; each configuration is used as often as the whole part
   of its share says.
3. Substitution: the slots of configurations take the longest real lengths that leave the other slots their sizes, and the
   room that rounding had kept goes to whatever large length still fits.
4. What is left of large pieces, and then all small ones, go to the fullest sequence that has room, longest first;
   sequences of the same room are handled as runs, so this too is bounded by the number of lengths.

This is done for a few bounds of what is large, and the plan with the fewest sequences is taken.

The plan says for each run of equal lengths, by the rank of a piece among those of its length, which sequences and
places it takes. Ranks come from Spark in two levels: the pieces of a length are dealt by hash to about the root of their
number of shares, ordered within a share, and shares' counts are summed up in order. So a length that a third of all
pieces have is ordered by many tasks.

Defined results: null and empty texts are the end id alone. Longer documents than a sequence are cut; repeated rows
and repeated or null ids each get their own pieces, ids come back as they were, and rows alike in id, piece, place and
checksum are interchangeable. A very long text is held whole by the task that encodes it, and cut there. Further columns
are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.components import checkpoint_dir
from cadenza.llm.planes import text_encoder

SIZE, GROUPS = 2048, 48
#: The linear program ends when no filling is worth more than this share over a sequence, or after so many turns a group.
GAP, TURNS = 1e-4, 40
#: Lengths over such a share of a sequence are large.
LARGE = (1 / 4, 2 / 5, 1 / 8)
#: A plan's key holds the length above so many bits of rank.
RANK_BITS = 50


def equal_groups(lengths: Sequence[tuple[int, int]], groups: int) -> list[tuple[int, int]]:
    """(rounded length, number of pieces), ascending: runs (length, number) in descending order are dealt to groups of equal
    numbers, and a group's pieces are rounded up to its longest. Groups of the same length are one."""
    most, room = -(-sum(n for _, n in lengths) // groups), 0
    found: dict[int, int] = {}
    longest = 0
    for length, n in lengths:
        while n:
            if not room:
                room, longest = most, length
            own = min(room, n)
            found[longest] = found.get(longest, 0) + own
            n, room = n - own, room - own
    return sorted(found.items())


def fillings(sizes: np.ndarray, worth: np.ndarray, size: int, many: int) -> list[np.ndarray]:
    """Ways to fill a sequence, as numbers of each size (ascending), that are worth over 1: the best ones, each with another
    first piece. A knapsack over tokens says what any room is worth, and which piece comes next in it."""
    best, piece = [0.0] * (size + 1), [-1] * (size + 1)
    rooms = np.zeros(size + 1)
    fitting = np.searchsorted(sizes, np.arange(size + 1), side="right").tolist()
    for room in range(int(sizes[0]), size + 1):
        told = rooms[room - sizes[: fitting[room]]] + worth[: fitting[room]]
        k = int(told.argmax())
        best[room], piece[room] = (float(told[k]), k) if told[k] > best[room - 1] + 1e-12 else (best[room - 1], -1)
        rooms[room] = best[room]
    first = worth + rooms[size - sizes]
    found = []
    for k in np.argsort(-first, kind="stable")[:many]:
        if first[k] <= 1 + GAP:
            break
        filling, room = np.zeros(len(sizes)), size - int(sizes[k])
        filling[k] = 1
        while room > 0:
            if (j := piece[room]) < 0:
                room -= 1
            else:
                filling[j] += 1
                room -= int(sizes[j])
        found.append(filling)
    return found


def configurations(sizes: Sequence[int], demand: Sequence[int], size: int) -> list[tuple[list[int], int]]:
    """(sizes in a sequence, number of such sequences), longest first, for sizes that ascend: whole parts of the fractional
    optimum, which is known to a share of GAP. The basis starts with sequences of one size and is changed column by
    column; its inverse is kept, and made anew now and then."""
    at, wanted = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag([float(size // s) for s in sizes])
    turns = 0
    while turns < TURNS * len(sizes):  # every basis is a plan; more turns than that no longer pay
        inverse = np.linalg.inv(basis)
        better = fillings(at, inverse.sum(axis=0), size, len(sizes) // 8 + 1)
        before = turns
        for filling in better:
            if filling @ inverse.sum(axis=0) <= 1 + GAP:
                continue  # not after the columns that have come in before it
            change = inverse @ filling
            share = np.maximum(inverse @ wanted, 0)
            leaving = int(np.where(change > 1e-9, share / np.where(change > 1e-9, change, 1), np.inf).argmin())
            basis[:, leaving] = filling
            row = inverse[leaving] / change[leaving]
            inverse -= np.outer(change, row)
            inverse[leaving] = row
            turns += 1
        if turns == before:
            break
    found = []
    for k, share in enumerate(np.linalg.solve(basis, wanted).tolist()):
        filling = [s for s, x in zip(sizes, basis[:, k], strict=True) for _ in range(round(x))][::-1]
        if (often := int(share + 1e-6)) > 0:
            found.append((filling, often))
    return sorted(found, reverse=True)


class Plan:
    """Where pieces go: rows (length, first rank, pieces to a sequence, first sequence, offset), and the runs of
    sequences by the tokens that they have left."""

    def __init__(self, size: int):
        self.size, self.sequences = size, 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        self.rooms = 0  # a bit for every room that has runs
        self.waiting = 0  # a bit for every large length that waits for a slot

    def leave(self, room: int, first: int, n: int) -> None:
        self.room[room].append((first, n))
        self.rooms |= 1 << room

    def substitute(self, sizes: Sequence[int], often: int, waiting: dict[int, list[int]]) -> None:
        """So many new sequences of one configuration: each slot, longest first, takes the longest waiting length that leaves
        the slots after it their sizes; after the last slot, whatever fits the room that real lengths have left follows.
        Sequences of equal contents stay one run. waiting: first rank and number of the pieces of each large length, which lose what is taken."""
        after = [sum(sizes[k + 1 :]) for k in range(len(sizes) + 1)]
        runs = [(0, 0, often, 0)]  # first sequence, tokens, sequences, slot
        first = self.sequences
        while runs:
            at, filled, n, slot = runs.pop()
            fitting = self.waiting & ((1 << max(0, self.size - filled - after[slot] + 1)) - 1)
            if not fitting:
                if slot < len(sizes) and filled:
                    runs.append((at, filled, n, slot + 1))
                elif filled:  # a run that got nothing isn't begun
                    self.leave(self.size - filled, first + at, n)
                continue
            length = fitting.bit_length() - 1
            rank, have = waiting[length]
            own = min(n, have)
            self.rows.append((length, rank, 1, first + at, filled))
            waiting[length] = [rank + own, have - own]
            if own == have:
                self.waiting &= ~(1 << length)
            if own < n:
                runs.append((at + own, filled, n - own, slot))
            runs.append((at, filled + length, own, min(slot + 1, len(sizes))))
            self.sequences = max(self.sequences, first + at + own)

    def best_fit(self, length: int, rank: int, n: int) -> None:
        """Pieces of one length, each to a sequence with the least room that holds it, or to new ones."""
        while n:
            if wide := self.rooms >> length:
                room = length + (wide & -wide).bit_length() - 1
                first, many = self.room[room].pop()
                if not self.room[room]:
                    self.rooms &= ~(1 << room)
            else:
                room, first, many = self.size, self.sequences, -(-n // (self.size // length))
                self.sequences += many
            each = min(room // length, n)  # a sequence that has taken one has the least room from then on
            filled = min(many, n // each)
            self.rows.append((length, rank, each, first, self.size - room))
            self.leave(room - each * length, first, filled)
            if filled < many:
                self.leave(room, first + filled, many - filled)
            rank, n = rank + filled * each, n - filled * each

    def table(self) -> np.ndarray:
        """The rows in the order of length and rank; the first column has both."""
        rows = np.array(self.rows, dtype=np.int64).reshape(-1, 5)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        return np.column_stack([rows[:, 0] << RANK_BITS | rows[:, 1], rows[:, 1:]])


def plan(histogram: dict[int, int], size: int = SIZE, groups: int = GROUPS, large: Sequence[float] = LARGE) -> Plan:
    """Places for so many pieces of each length, 1 to size: the best of the plans with lengths over each of these shares of
    a sequence as large ones. A plan that leaves less than a sequence's tokens free can't be bettered and ends the search."""
    plans = []
    for share in large:
        plans.append(plan_from(histogram, size, groups, int(size * share)))
        if (plans[-1].sequences - 1) * size < sum(length * n for length, n in histogram.items()):
            break
    return min(plans, key=lambda p: p.sequences)


def plan_from(histogram: dict[int, int], size: int, groups: int, small: int) -> Plan:
    """The plan in which lengths over small are large."""
    told = Plan(size)
    lengths = sorted(histogram.items(), reverse=True)
    large = [x for x in lengths if x[0] > small]
    if large:
        told.waiting = sum(1 << length for length, _ in large)
        waiting = {length: [0, n] for length, n in large}
        for filling, often in configurations(*zip(*equal_groups(large, groups), strict=True), size):
            told.substitute(filling, often, waiting)
        for length, (rank, n) in waiting.items():
            told.best_fit(length, rank, n)
    for length, n in lengths[len(large) :]:
        told.best_fit(length, 0, n)
    return told


def pieces(documents: DataFrame, tokenizer_path: str, *, size: int = SIZE, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and ids, if asked for) of every piece of every document."""
    held = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = f"doc_id {held.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    end, wide = np.array([end_id], dtype="<u4").tobytes(), 4 * size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        for rows in batches:
            owner, piece, start, length, crc, own = [], [], [], [], [], []
            for i, raw in enumerate(encoder.encode([t or "" for t in rows.column("text").to_pylist()])):
                raw += end
                for k, at in enumerate(range(0, len(raw), wide)):
                    part = raw[at : at + wide]
                    owner.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        own.append(np.frombuffer(part, dtype="<i4"))
            columns = [rows.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.list_(pa.int32()))] * ids, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids])

    return held.mapInArrow(cut, schema)


def ranked_by_length(cut: DataFrame, histogram: dict[int, int], size: int) -> DataFrame:
    """The pieces with rank, from 0 among those of their length."""
    shares = F.element_at(F.lit([max(1, int(np.ceil(np.sqrt(histogram.get(k, 1))))) for k in range(1, size + 1)]), F.col("length").cast("int"))
    dealt = cut.withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), shares.cast("long")))
    share = Window.partitionBy("length", "_share")
    counts = dealt.groupBy("length", "_share").count()
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    placed = dealt.withColumn("_nth", F.row_number().over(share.orderBy("doc_id", "piece", "start", "ids_crc32")))
    return placed.join(starts, ["length", "_share"]).select(*cut.columns, (F.col("_before") + F.col("_nth") - 1).alias("rank"))


def packed(documents: DataFrame, tokenizer_path: str, *, size: int = SIZE, groups: int = GROUPS, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece (and its ids, if asked for).

    Pieces are written once, in spark.checkpoint.dir, so that ranks are those of what was counted. The plan that goes to
    tasks has some rows for each length at most, whatever the input."""
    if size < 1 or groups < 1:
        raise ValueError("size and groups must be 1 or more")
    checkpoint_dir(documents.sparkSession)
    cut = pieces(documents, tokenizer_path, size=size, end_id=end_id, id_column=id_column, text_column=text_column, ids=ids).checkpoint()
    histogram = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # a row for each length
    sent = documents.sparkSession.sparkContext.broadcast(plan(histogram, size, groups).table())
    names = cut.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, each, sequences, offsets = (sent.value[:, k] for k in range(5))
        for rows in batches:
            length, rank = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(keys, length << RANK_BITS | rank, side="right") - 1
            nth = rank - firsts[k]
            told = sequences[k] + nth // each[k], offsets[k] + nth % each[k] * length
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *map(pa.array, told)], names=[*names, "sequence_id", "offset"])

    return ranked_by_length(cut, histogram, size).mapInArrow(place, schema)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of every sequence, from pieces packed with their ids."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # no longer than a sequence
    return packed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))
