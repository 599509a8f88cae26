"""SimHash, E8 lattice hashing and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import lattice, simhash
from cadenza.llm.components import checkpoint_dir, connected_components
from tests.llm.conftest import MESSY, by_sql, same_rows

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def near_texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = list(MESSY)
    for g in range(12):
        base = rng.choice(vocabulary, 300)
        for c in range(12):
            words = base.copy()
            for p in rng.integers(0, 300, c // 2):
                words[p] = rng.choice(vocabulary)
            rows.append((100 + g * 20 + c, " ".join(words), "en", "a"))
    return rows


def test_fingerprints_and_components(documents):
    rows = near_texts()
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents(rows, clashes=True)).collect()}
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    wanted = plain_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in found.items()} == wanted
    assert len(set(wanted.values())) < len(wanted)


@pytest.mark.parametrize("partitions", [(2,), (3,), (4,)])
def test_no_link_is_missed_with_any_number_of_partitions(spark, partitions):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    values = {int(b) for b in base}
    for b in base[:30]:
        for k in (1, 2, 3, 3, 4):
            values.add(int(b) ^ int(sum(1 << int(p) for p in rng.choice(60, k, replace=False))))
    prints = sorted(values)
    found = {(r["a"], r["b"]) for r in simhash.fingerprint_links(spark.createDataFrame([(v,) for v in prints], "fp long"), 3, partitions).collect()}
    assert found == {(a, b) for a in prints for b in prints if a < b and (a ^ b & ((1 << 64) - 1)).bit_count() >= 0 and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}


def test_thousands_of_probes_are_one_literal(spark, monkeypatch):
    """A radius of three over 32 bits has 5,489 probes; the session must live on after their plan."""
    values = [5, 5 ^ (0b111 << 3), 5 ^ (0b1111 << 40), -1]
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    monkeypatch.setattr(simhash, "plan_search", lambda *_: [(list(range(32)), 3)])
    links = simhash.fingerprint_links(prints)
    assert links._jdf.queryExecution().optimizedPlan().toString().count("named_struct") <= 2
    assert [tuple(r) for r in links.collect()] == [(5, 5 ^ (0b111 << 3))]
    assert spark.range(100).repartition(3).count() == 100


def test_allocation_is_the_cheapest():
    costs = [[5.0, 9.0, 30.0], [1.0, 20.0, 40.0], [7.0, 8.0, 9.0]]
    every = [(sum(c[t] for c, t in zip(costs, ts) if t >= 0), ts) for ts in np.ndindex(4, 4, 4) if sum(ts) - 3 == 1 for ts in [tuple(t - 1 for t in ts)]]
    assert simhash.allocate(costs, 1)[0] == min(every)[0]


def test_one_of_each_group_stays_whole(documents):
    rows = [(5, "same words here again", "en", "a"), (3, "same words here again", "en", "b"), (3, "same words here again", "en", "b"), (9, "something else that differs", "en", "a"), (8, None, "en", "a"), (7, "", "en", "a")]
    df = documents(rows, clashes=True)
    found = simhash.one_of_each(df)
    assert sorted(r["doc_id"] for r in found.collect()) == [3, 7, 9] and found.columns == df.columns


def test_one_of_each_keeps_different_texts_that_share_an_id(documents):
    """Null and repeated ids are no reason to lose a text, nor to keep one that is represented elsewhere."""
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(None, "first text without an id", "en", "a"), (None, "second text without an id", "en", "a"), (None, "second text without an id", "en", "b")]
    rows += [(4, "one text of number four", "en", "a"), (4, "another text of this number", "en", "a"), (4, long, "en", "a"), (2, long + " end", "en", "a"), (9, "another text of this number", "en", "c")]
    found = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.one_of_each(documents(rows, clashes=True)).collect())
    assert found == [(0, "first text without an id"), (0, "second text without an id"), (2, long + " end"), (4, "another text of this number"), (4, "one text of number four")]


def test_one_of_each_finds_what_exact_similarity_links(documents):
    """Copies with a few words changed, whose fingerprints are often over three bits apart, against all pairs' Jaccard of five-word shingles."""
    rows = near_texts()
    rows += [(1000 + k, " ".join(["a", "few", "words", "of", f"x{k % 3}", "alone"]), "en", "a") for k in range(6)]
    plain = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))] if w for i in range(max(1, len(w) - 4))}
    sets = {r[0]: plain(r[1]) for r in rows}
    wanted = plain_components(sorted(sets), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    found = simhash.one_of_each(documents(rows, clashes=True))
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(set(wanted.values()))
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    by_bits = plain_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert len(set(wanted.values())) < len(set(by_bits.values()))
    assert simhash.one_of_each(documents([])).count() == 0


def test_empty_tables(spark, documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert sum(len(list(bits)) > 20 and t > 0 for bits, t in simhash.plan_search(spark.createDataFrame([], "fp long"))) == 0
    assert simhash.near_duplicates(documents([(1, "one text", "en", "a")])).count() == 1  # the session lives on
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            pass

    Session.sparkContext.master = master
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 200), (7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}


def test_a_round_of_components_has_few_tasks(spark):
    """With many partitions and few links each task leaves more on disk than links: pairs and a star are done in one round, of at most eight stages."""
    links = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 9)], "a long, b long").repartition(1)
    context, many, held = spark.sparkContext, 40, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("rounds", "rounds")
        found = connected_components(links)
        told = context.statusTracker()
        stages = {s for job in told.getJobIdsForGroup("rounds") for s in told.getJobInfo(job).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(told.getStageInfo, stages) if i)
        assert {r["node"]: r["component"] for r in found.collect()} == {k: k - k % 2 for k in range(40)} | {100 + k: 100 for k in range(9)}
        assert 0 < tasks <= 10 * many
        assert connected_components(links.filter("a < 0")).columns == found.columns
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_decoded_points_are_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 3, (300, 8))
    own = lattice.nearest_e8(x)
    short = lattice.shortest_vectors()
    assert short.shape == (240, 8) and np.allclose((short**2).sum(axis=1), 2)
    near = ((x[:, None] - (own[:, None] + short[None])) ** 2).sum(axis=2).min(axis=1)
    assert (((x - own) ** 2).sum(axis=1) <= near + 1e-9).all()


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(11)
    rows, i = [], 0
    for _ in range(60):
        base = rng.normal(size=48)
        for k in range(int(rng.integers(1, 6))):
            rows.append((i, (base + rng.normal(size=48) * rng.choice([0.0, 0.1, 0.2, 0.3])).tolist()))
            i += 1
    rows += [(i, [0.0] * 48), (i + 1, None), (i + 2, [float("nan")] + [1.0] * 47), (i + 3, [None] + [1.0] * 47), (i + 4, [float("inf")] + [1.0] * 47), (i + 5, []), (i + 6, rows[0][1]), (i + 7, [1e-30 * v for v in rows[0][1]])]
    rows = [(a, b, "x", 1.0, 2) for a, b in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, copies double, key long")
    clean = df.select("vec_id", "embedding").toPandas()
    same_rows(lattice.near_vectors(df), by_sql(lattice.VECTORS_SQL.replace("len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0", "list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda e: not isfinite(e))) = 0"), embeddings=clean))


def test_recall_at_the_threshold():
    """Pairs of exactly the threshold's cosine meet in some table."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    met = np.zeros(len(a), dtype=bool)
    for t in range(lattice.TABLES):
        x, y = lattice.cells(a, t, lattice.PROBES), lattice.cells(b, t, lattice.PROBES)
        met |= (x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1)
    assert met.mean() >= 0.99


def test_near_copies_are_looked_for_in_groups_of_fingerprints(documents, monkeypatch):
    """The pipeline's step searches fingerprints by pigeonholes: without any MinHash bucket it finds what is within 3 bits, and confirms it."""
    docs = documents(near_texts())
    monkeypatch.setattr(simhash, "sketch_column", lambda text, whole=simhash.sketch_column: whole(text).withField("keys", F.array().cast("array<long>")))
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs, "doc_id", "text").collect()}
    texts = {r[0]: r[1] for r in near_texts()}
    prints, sets = {i: plain_fingerprint(t) for i, t in texts.items()}, {i: set(simhash.shingle_set(t).tolist()) for i, t in texts.items()}
    close = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and texts[a] != texts[b] and len(sets[a] & sets[b]) >= 0.8 * max(len(sets[a] | sets[b]), 1)]
    assert close and all(found[a] == found[b] for a, b in close)
