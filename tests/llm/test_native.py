"""Line dedup, line-frequency rules and mixing against their SQL, over messy, repeated and empty input."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm import line_dedup, mixing, quality_lines
from tests.llm.conftest import MESSY, by_sql, same_rows

CASES = [
    (line_dedup.line_report, line_dedup.LINES_SQL),
    (quality_lines.line_frequency_rules, quality_lines.RULES_SQL),
    (mixing.mix, mixing.MIX_SQL),
]


@pytest.mark.parametrize(("operator", "sql"), CASES, ids=["lines", "rules", "mix"])
def test_messy_documents_match_sql(documents, operator, sql):
    df = documents(MESSY, clashes=True)
    same_rows(operator(df), by_sql(sql, documents=df.select("doc_id", "text", "lang", "source").toPandas()))


@pytest.mark.parametrize(("operator", "sql"), CASES, ids=["lines", "rules", "mix"])
def test_empty_table(documents, operator, sql):
    assert operator(documents([])).count() == 0


@pytest.mark.parametrize(("operator", "sql"), CASES, ids=["lines", "rules", "mix"])
def test_null_ids_and_repeated_rows_each_get_a_row(documents, operator, sql):
    rows = [(None, "a b c", "en", "s"), (None, "d e", "en", None), (1, "same text", "en", "s"), (1, "same text", "en", "s")]
    assert operator(documents(rows)).count() == 4


def test_spread_is_exact_at_the_threshold(documents):
    """Four sites are too few and five enough, whatever the sketch says; one document keeps the line."""
    rows = [(i, f"four sites line\nown {i}", "en", f"s{i % 4}") for i in range(40)] + [(100 + i, f"five sites line\nmine {i}", "en", f"s{i % 5}") for i in range(40)]
    found = {r["doc_id"]: r for r in line_dedup.line_report(documents(rows)).collect()}
    assert all(found[i]["n_removed"] == 0 for i in range(40)) and found[100]["n_removed"] == 0
    assert all(found[100 + i]["n_removed"] == 1 and found[100 + i]["text"] == f"mine {i}" for i in range(1, 40))


def test_sketch_alone_decides_far_from_the_threshold(documents):
    rows = [(i, "everywhere\n" + f"own {i}", "en", f"s{i}") for i in range(400)]
    assert line_dedup.line_report(documents(rows)).filter("n_removed = 1").count() == 399


def test_every_column_stays_when_lines_go(documents):
    df = documents([(i, f"said on all sites\nrest {i}", "en", f"s{i}") for i in range(6)], clashes=True)
    found = line_dedup.without_spread_lines(df)
    assert found.columns == [*df.columns, "_removed"]
    assert sorted(r["text"] for r in found.collect()) == [*(f"rest {i}" for i in range(1, 6)), "said on all sites\nrest 0"]


def test_depleted_documents_are_rejected_and_copies_are_not(documents):
    words = "these words fill up a line of the document rather well"
    rows = [(i, f"{words}\nown {i}", "en", "s") for i in range(60)] + [(100 + i, f"{words} but it is a copy", "en", "s") for i in range(90)]
    found = {r["doc_id"]: r for r in quality_lines.line_frequency_rules(documents(rows)).collect()}
    assert not any(found[i]["kept"] for i in range(60)) and all(found[i]["n_removed_words"] == 11 for i in range(60))
    assert all(found[100 + i]["kept"] for i in range(90))


def test_the_limit_grows_with_the_host(documents):
    """Six of a hundred texts are over a twentieth, and six of two hundred aren't; five are always too few."""
    usual, own = "a line that several documents have", "and here are the many other words of document number"
    rows = [(i, f"{own} {i}\n{usual}" if i < 6 else f"{own} {i}", "en", "small") for i in range(100)]
    rows += [(1000 + i, f"{own} {i}\n{usual}" if i < 6 else f"{own} {i}", "en", "large") for i in range(200)]
    rows += [(2000 + i, f"{own} {i}\n{usual}", "en", None) for i in range(5)]
    found = quality_lines.line_frequency_rules(documents(rows))
    assert sorted(r["doc_id"] for r in found.filter("n_removed_words > 0").collect()) == [0, 1, 2, 3, 4, 5]
    same_rows(found, by_sql(quality_lines.RULES_SQL, documents=documents(rows).toPandas()))


def test_a_line_of_a_third_of_all_rows_is_dealt_to_many_tasks(spark, documents):
    rows = [(i, f"everywhere the same\nown {i}\nmore {i}", "en", f"s{i % 40}") for i in range(4000)]
    lines = line_dedup.document_lines(documents(rows))
    tasks = line_dedup.salted(lines.filter(F.col("line") == lines.groupBy("line").count().orderBy(F.desc("count")).first()["line"]), F.struct("doc_id", "pos"), line_dedup.SALTS)
    sizes = [r["count"] for r in tasks.groupBy("line", "salt").count().collect()]
    assert len(sizes) == line_dedup.SALTS and max(sizes) < 2 * 4000 / line_dedup.SALTS
    assert line_dedup.line_report(documents(rows)).filter("n_removed = 1").count() == 3999


def test_repeat_words_by_hand(documents):
    text = "a b c d e x a b c d e y a b c d e f a b c d e f"
    words = text.split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    assert quality_lines.line_frequency_rules(documents([(1, text, "en", "s")])).first()["n_repeat_words"] == len(covered)


def test_mix_comes_near_its_targets_and_reruns_agree(documents):
    rows = [(i, "w " * (i % 37 + 1), "en", f"s{(i % 9) ** 2 % 7}" if i % 11 else None) for i in range(3000)]
    found = mixing.mix(documents(rows)).toPandas()
    again = mixing.mix(documents(rows[::-1]).repartition(7)).toPandas()
    assert found.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert (found["taken"] <= 2 * found["size"]).all()
    by = found.assign(s=[r[3] or "" for r in rows] if found["doc_id"].is_monotonic_increasing else found["doc_id"].map(lambda i: rows[i][3] or "")).groupby("s").agg({"taken": "sum", "size": "sum", "target": "first"})
    assert ((by["taken"] - by["target"]).abs() <= 2 * 37).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum() and (by["target"] <= 2 * by["size"] + 1e-9).all()


def test_mixed_documents_repeat_with_all_columns(documents):
    df = documents([(i, f"text of document {i}", "en", f"s{i % 3}") for i in range(50)], clashes=True)
    found = mixing.mixed_documents(df)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(df).collect()}
    assert found.columns == df.columns
    assert {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}


def filled(sizes, weights, share=1.5, repeats=2):
    """Targets by plain waterfilling."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, found = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= repeats * sizes[s]}
        if not full:
            return found | {s: w[s] * level for s in open_}
        found |= {s: float(repeats * sizes[s]) for s in full}
        left -= sum(repeats * sizes[s] for s in full)
        open_ -= full
    return found


@pytest.mark.parametrize("n", [1, 2, 3, 2000])
def test_targets_of_many_sources_are_filled_evenly(spark, n):
    rng = random.Random(n)
    sizes = {f"host{rng.random()}é"[: rng.randint(6, 20)]: rng.choice([0, 1, 7, 7, 400, rng.randint(1, 10**9)]) for _ in range(n - 1)} | {None: 5}
    rows = [(s, v) for s, v in sizes.items() if v] + [(s, 0) for s in sizes]
    found = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(5)).collect()}
    wanted = filled(sizes, (3, 1, 2))
    assert {s: r["source_size"] for s, r in found.items()} == sizes
    assert all(abs(found[s]["target"] - wanted[s]) <= 1e-9 * max(1, wanted[s]) for s in sizes)


def test_rows_alike_share_what_is_taken_of_them(documents):
    rows = [(1, "the same words", "en", "s")] * 3 + [(1, "other words", "en", "s"), (None, "no id", "en", None), (None, "no id", "de", None)] + [(10 + i, f"text {i}", "en", f"s{i % 3}") for i in range(30)]
    df = documents(rows)
    times = {}
    for r in mixing.mix(df).collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + r["taken"] // r["size"]
    found = mixing.mixed_documents(df)
    assert {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()} == {i: n for i, n in times.items() if n}
    assert "text" not in str(mixing.fair_queue(df).columns).replace("text_hash", "")
