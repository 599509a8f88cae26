"""Toxicity and language identification: held-out accuracy, counterfactual twins, defined results."""

import zlib

import numpy as np
import pytest

from cadenza.llm import langid, toxicity

SYLLABLES = {"xx": ["ka", "lo", "mi", "tu", "re"], "yy": ["sch", "berg", "und", "ein", "heit"], "zz": ["eau", "ill", "oir", "que", "aux"]}


def texts(n=600):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(rng.integers(3, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["grumbler", "dreckig", "foolio"])))
        rows.append((i, " ".join(words), lang, "s", toxic))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_languages_of_held_out_texts(documents):
    rows = texts()
    odd = [(1000, None, "xx", "s"), (1001, "", "xx", "s"), (1002, "123 !?", "xx", "s"), (1003, "berg und heit " * 20000, None, "s"), (1004, "中文字", None, "s"), (None, "kalo mire", "xx", "s")]
    df = documents([r[:4] for r in rows] + odd, clashes=True)
    found = {r["doc_id"]: r for r in langid.languages(df).collect()}
    assert all(found[i]["held_out"] == held(i) for i in range(len(rows)))
    out = [r for r in rows if held(r[0])]
    assert np.mean([found[r[0]]["lang_pred"] == r[2] for r in out]) > 0.98
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert found[1003]["lang_pred"] == "yy" and all(0 <= r["score"] <= 1 for r in found.values()) and None in found


def test_bundles_are_sums_of_bound_letters():
    def plain(text):
        run = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        total = np.zeros(langid.DIMENSIONS)
        for k in range(len(run) - 2):
            a, b, c = (langid.letter_vector(ord(x)) for x in run[k : k + 3])
            total += np.roll(a, 2) * np.roll(b, 1) * c
        return total

    some = ["Hello, World", "é", "", "a1b", "x" * 70000]
    assert np.allclose(langid.text_vectors(some[:2] + some[3:]), [plain(t) for t in some[:2] + some[3:]])
    assert not langid.text_vectors(["", None, "12"]).any()


def test_nothing_learned(documents):
    df = documents([(i, "some text", None, "s") for i in range(5)])
    assert {(r["lang_pred"], r["score"]) for r in langid.languages(df).collect()} == {("und", 0.0)}
    assert langid.languages(documents([])).count() == 0


def test_toxicity_of_held_out_texts(spark, documents):
    rows = texts()
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows if r[0] % 5] + [(9999, 0, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    df = documents([r[:4] for r in rows] + [(1000, None, "xx", "s"), (1001, "", "xx", "s"), (1002, "grumbler " + "kalo " * 50000, "xx", "s")], clashes=True)
    found = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    out = [r for r in rows if held(r[0])]
    assert all(found[r[0]]["held_out"] for r in out)
    assert np.mean([found[r[0]]["predicted"] == r[4] for r in out]) > 0.98
    assert found[1000]["predicted"] == found[1001]["predicted"] == 0 and found[1002]["predicted"] == 1
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in found.values())
    stay = {r["doc_id"] for r in toxicity.without_toxic(df, labels).collect()}
    assert stay == {i for i, r in found.items() if not r["predicted"]}


def test_held_out_labels_teach_nothing(spark, documents):
    rows = texts(300)
    df = documents([r[:4] for r in rows])
    told = [(r[0], 1, r[4]) for r in rows]
    wrong = [(i, q, 1 - t if held(i) else t) for i, q, t in told]
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (told, wrong)]
    assert scores[0] == scores[1]


def test_labels_of_one_kind_or_none(spark, documents):
    df = documents([(i, "some text", "en", "s") for i in range(5)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r["score"], 6) for r in toxicity.toxicity(df, none).collect()} == {0.0}
    assert toxicity.toxicity(documents([]), none).count() == 0


def biased():
    """A group is named in most toxic sentences, and in a few neutral ones; its twin group hardly ever."""
    rng = np.random.default_rng(4)
    filler = [f"word{k}" for k in range(40)]
    rows = []
    for k in range(400):
        words = list(rng.choice(filler, 8))
        toxic = k % 2
        if toxic:
            words += [str(rng.choice(["vile", "rotten"])), "muslims"]
        elif k % 20 == 0:
            words.append("muslims")
        elif k % 10 == 2:
            words.append("christians")
        rows.append((" ".join(words), toxic))
    return [t for t, _ in rows], np.array([y for _, y in rows])


def test_twins_swap_terms_of_one_list():
    assert toxicity.twins({"a", "women"}, toxicity.IDENTITY_TERMS) == [{"a", "men"}]
    assert toxicity.twins({"a"}, toxicity.IDENTITY_TERMS) == []


def test_neutral_mentions_score_lower_with_the_penalty():
    sentences, labels = biased()
    plain = toxicity.fit(sentences, labels, counterfactual=0.0)
    fair = toxicity.fit(sentences, labels, counterfactual=20.0)
    neutral, twin, toxic = ["word1 word2 muslims word3", "word1 word2 christians word3", "word1 vile word3"]
    gap = lambda m: abs(np.diff(m.margins([neutral, twin]))[0])
    assert gap(fair) < 0.25 * gap(plain)
    assert plain.scores([neutral])[0] > fair.scores([neutral])[0] and fair.scores([neutral])[0] < 0.3
    assert fair.scores([toxic])[0] > 0.5


def test_gradient_is_that_of_the_loss():
    """With twins and without, against differences of the loss."""
    rng = np.random.default_rng(6)
    for m in (7, 0):
        rows, columns, twin_rows, twin_columns = rng.integers(0, 20, 60), rng.integers(0, 9, 60), rng.integers(0, max(m, 1), 3 * m), rng.integers(0, 9, 3 * m)
        task = toxicity.Task(rows, columns, rng.random(20), rng.integers(0, 2, 20).astype(float), rng.integers(0, 20, m), twin_rows, twin_columns, 9, 0.7, 0.3)
        at = rng.normal(size=10)
        loss = lambda x: task.loss(x[:-1], x[-1])[0]  # noqa: B023, E731
        steps = np.eye(10) * 1e-6
        assert np.allclose(task.loss(at[:-1], at[-1])[1], [(loss(at + e) - loss(at - e)) / 2e-6 for e in steps], atol=1e-7)


def test_repeated_ids_are_learned_alike_on_every_run(spark, documents):
    rows = [(r[0], r[1], *r[2:4]) for r in texts(200)]
    rows += [(i, f"again {t}", la, s) for i, t, la, s in rows]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    a, b = (toxicity.learn(documents(x).repartition(n), labels) for x, n in ((rows, 3), (rows[::-1], 7)))
    assert a == b


@pytest.mark.parametrize("text", ["", None])
def test_texts_without_words_get_the_offset(text):
    model = toxicity.Model(-1.0, {"bad": 3.0})
    assert model.margins([text]).tolist() == [-1.0] and model.margins(["bad bad"]).tolist() == [2.0]
