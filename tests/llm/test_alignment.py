"""Alignment by units and intervals against whole texts, token by token."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cadenza.llm import alignment
from tests.llm.conftest import MESSY
from tests.llm.test_files import odd_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def libraries():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b, alignment.Tokens(A, B)


def spans(sizes):
    at, found = 0, []
    for n in sizes:
        found.append((at, at + n))
        at += n
    return found


def plain(rows):
    """The contract, all pairs of tokens of a document compared."""
    a_lib, b_lib, tokens = libraries()
    told, links = [], Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        if b"".join(tokens.a_bytes[x] for x in a) != raw or b"".join(tokens.b_bytes[x] for x in b) != raw:
            a, b = [], []
        sa, sb = spans(len(tokens.a_bytes[x]) for x in a), spans(len(tokens.b_bytes[x]) for x in b)
        own, first = [], 0
        for (x0, x1), x in zip(sa, a):
            while first < len(sb) and sb[first][1] <= x0:
                first += 1
            k = first
            while k < len(sb) and sb[k][0] < x1:
                own.append((x, b[k]))
                k += 1
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = []
        for lo, hi in zip([0, *ends], ends):
            groups.append(",".join(str(x) for x, s in zip(a, sa) if lo <= s[0] < hi) + "|" + ",".join(str(x) for x, s in zip(b, sb) if lo <= s[0] < hi) if len(a) < 3000 else None)
        links.update(own)
        told.append((i, len(a), len(b), len(groups), own, None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (_, y), n in links.items():
        best[y] = max(n, best.get(y, 0))
    return [(i, n_a, n_b, g, len(own), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), code) for i, n_a, n_b, g, own, code in told]


def odd_rows():
    rng = random.Random(3)
    spaces = [" ", "  ", "\n", "\r\n", "\t", "\r", "　", "\x85", "\xa0", " \r ", "   \n ", "\x1c", " "]
    words = ["it's", "we'll", "foo();", "}", "x", "12", "中文", "\U0001f600", "<|endoftext|>", "</s>", "<0x0A>", "<unk>", "á", "été", ";", "\u0000", "ﬁ"]
    texts = ["".join(rng.choice(words) * rng.randint(0, 2) + rng.choice(spaces) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    return [*odd_texts(400, 11), *texts, "▁x", "a▁b", " ", "  ", "\r", "\n", "x ", "x  ", " x", "\r x", ";\r\n y", "word" * 3000]


def test_units_give_what_whole_texts_give():
    a_lib, b_lib, tokens = libraries()
    assert tokens.units.pattern != r"(?s).+"
    for text in odd_rows():
        units = tokens.units.findall(" " + text)
        assert "".join(units) == " " + text
        if "▁" in text or not text:
            continue
        assert tokens.cut(text) == units, repr(text)
        a, b = tokens.encode(units)
        assert [i for x in a for i in x] == a_lib.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert [i for x in b for i in x] == b_lib.encode(text), repr(text)


def rows_of(df):
    key = lambda r: (r[0] is not None, r[0] or 0, str(r))
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.mark.parametrize("held", [alignment.HELD_PAIRS, 0])
def test_rows_equal_all_pairs(spark, documents, monkeypatch, held):
    monkeypatch.setattr(alignment, "KEPT", 500)
    monkeypatch.setattr(alignment, "AT_ONCE", 3000)
    monkeypatch.setattr(alignment, "COUNTED", 2000)
    rows = [*MESSY, *[(100 + k, t, "en", "a") for k, t in enumerate(odd_rows())], (None, "no id", "en", "a"), (4, "again", "en", "a"), ((1 << 53) + 1, "a big id", "en", "a"), *[(7000, "the same text twice", "en", "a")] * 2]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = rows_of(alignment.alignment(documents(rows, clashes=True).repartition(3), A, B, held_pairs=held).select(columns))
    wanted = sorted(plain([(r[0], r[1]) for r in rows]), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
    assert [r[:7] for r in found] == [r[:7] for r in wanted]
    assert all(w[7] is None or w[7] == f[7] for f, w in zip(found, wanted))


def test_groups_and_their_products(spark, documents):
    rows = [(1, "An unbelievably löng word; 2024!", "en", "a"), (2, None, "en", "a"), (3, "a▁b", "en", "a")]
    grouped = alignment.token_groups(documents(rows), A, B)
    found = {r["doc_id"]: r["groups"] for r in grouped.collect()}
    assert found[2] == found[3] == []
    _, _, tokens = libraries()
    raw = (" " + rows[0][1]).encode()
    for g in found[1]:
        assert b"".join(tokens.a_bytes[i] for i in g["a"]) == raw[g["start"] : g["end"]] == b"".join(tokens.b_bytes[i] for i in g["b"])
    assert found[1][-1]["end"] == len(raw)
    assert alignment.group_products(grouped).count() == sum(len(g["a"]) * len(g["b"]) for g in found[1])


def test_no_documents(spark, documents):
    for held in (alignment.HELD_PAIRS, 0):
        assert alignment.alignment(documents([]), A, B, held_pairs=held).count() == 0
        assert rows_of(alignment.alignment(documents([(1, None, "en", "a"), (2, "", "en", "a")]), A, B, held_pairs=held)) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]
