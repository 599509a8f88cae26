"""Packing by linear grouping: every piece in a gapless place of its own, as few sequences as a search finds."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm import packing
from tests.llm.conftest import MESSY

WORDS = public_tokenizers.path("word_bpe_49k.json")


def places(histogram, size, **options):
    """(sequence, offset, length) of every piece, by the plan's table."""
    table = packing.plan(histogram, size, **options).table()
    keys, firsts, each, sequences, offsets = table.T
    found = []
    for length, n in histogram.items():
        rank = np.arange(n)
        k = np.searchsorted(keys, length << packing.RANK_BITS | rank, side="right") - 1
        nth = rank - firsts[k]
        found += zip((sequences[k] + nth // each[k]).tolist(), (offsets[k] + nth % each[k] * length).tolist(), [length] * n)
    return found


def assert_gapless(found, size):
    own = defaultdict(list)
    for sequence, offset, length in found:
        own[sequence].append((offset, length))
    for parts in own.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(own)


def least(lengths, size):
    """The least number of sequences, by trying everything."""

    @lru_cache(maxsize=None)
    def of(left, rooms):
        if not left:
            return 0
        tried = [of(left[1:], tuple(sorted(rooms + (size - left[0],)))) + 1]
        for k, room in enumerate(rooms):
            if room >= left[0] and (k == 0 or rooms[k - 1] != room):
                tried.append(of(left[1:], tuple(sorted(rooms[:k] + (room - left[0],) + rooms[k + 1 :]))))
        return min(tried)

    return of(tuple(sorted(lengths, reverse=True)), ())


def test_small_cases_take_the_least_or_one_more():
    rng, over = random.Random(4), 0
    for _ in range(150):
        size = rng.choice([10, 16, 30])
        histogram = dict(Counter(rng.randint(1, size) for _ in range(rng.randint(1, 11))))
        got = assert_gapless(places(histogram, size, groups=rng.choice([2, 5, 48])), size)
        best = least([k for k, n in histogram.items() for _ in range(n)], size)
        assert best <= got <= best + 1
        over += got - best
    assert over < 15


@pytest.mark.parametrize("kind", ["documents", "many", "hot", "short", "same", "halves", "full"])
def test_plans_hold_all_pieces(kind):
    rng = random.Random(7)
    one = {"documents": lambda: min(2048, int(rng.expovariate(1 / 500)) + 1), "many": lambda: rng.randint(300, 1100), "hot": lambda: 700 if rng.random() < 0.4 else rng.randint(1, 2048)}
    one |= {"short": lambda: rng.randint(1, 40), "same": lambda: 683, "halves": lambda: rng.choice([1024, 1025, 1023]), "full": lambda: 2048}
    histogram = dict(Counter(one[kind]() for _ in range(20_000)))
    got, tokens = assert_gapless(places(histogram, 2048), 2048), sum(k * n for k, n in histogram.items())
    bound = max(-(-tokens // 2048), sum(n for k, n in histogram.items() if k > 1024))
    assert got <= {"hot": 1.2, "same": 1.51, "halves": 1.4}.get(kind, 1.02) * bound
    # the plan's size doesn't grow with the pieces
    rows = len(packing.plan({k: n * 10**6 for k, n in histogram.items()}).rows)
    assert rows < 10 * 2048


def test_groups_are_of_equal_numbers_and_round_up():
    assert packing.equal_groups([(9, 2), (7, 3), (5, 1)], 3) == [(7, 4), (9, 2)]
    assert packing.equal_groups([(9, 1), (8, 1), (7, 1), (6, 1)], 2) == [(7, 2), (9, 2)]


def test_packed_rows(spark, documents):
    rows = [*MESSY, (None, "no id", "en", "a"), (4, "again", "en", "a"), ((1 << 53) + 1, "big id", "en", "a"), *[(100 + i, "one and the same text", "en", "a") for i in range(200)], *[(1000, "twice", "en", "a")] * 2]
    df = documents(rows, clashes=True).repartition(5)
    library = Tokenizer.from_file(WORDS)
    encoded = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows]
    wanted = sorted((str(i), k // 64, k, len(part := ids[k : k + 64]), zlib.crc32(np.array(part, dtype="<u4").tobytes())) for i, ids in encoded for k in range(0, len(ids), 64))
    packed = packing.packed(df, WORDS, size=64, ids=True).cache()
    found = packed.collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    got = assert_gapless([(r["sequence_id"], r["offset"], r["length"]) for r in found], 64)
    assert got <= -(-sum(w[3] for w in wanted) // 64) + 1
    whole = {r["sequence_id"]: list(r["ids"]) for r in packing.sequences(packed).collect()}
    assert len(whole) == got and sorted(i for s in whole.values() for i in s) == sorted(i for _, ids in encoded for i in ids)
    assert all(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == list(r["ids"]) for r in found)
    assert packing.packed(documents([]), WORDS).count() == 0


def test_ranks_of_a_length_are_dealt_to_many_shares(spark):
    n = 10_000
    cut = spark.range(n).selectExpr("id as doc_id", "0 as piece", "0L as start", "7L as length", "id % 3 as ids_crc32")
    found = packing.ranked_by_length(cut, {7: n}, 2048)
    assert sorted(r["rank"] for r in found.select("rank").collect()) == list(range(n))
    assert found.columns == [*cut.columns, "rank"]
