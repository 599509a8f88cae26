"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's
3-word shingles, repeats included. Fingerprints link at `limit` or fewer differing bits.

Candidate search is exact. The 64 bits are grouped into partitions of correlated bits, and every partition gets a
threshold of its own, -1 (not searched) included, with a sum of limit - partitions + 1: two fingerprints within the
limit are within the threshold of at least one partition. Grouping and thresholds come from counts over all
fingerprints: bit co-occurrences, and the pairs that share a partition's bits. Dynamic programming picks the
thresholds with the smallest estimate of rows probed and pairs met; the number of partitions is chosen likewise. An
empty table is planned as one fingerprint, so it gets few probes too.

Equal fingerprints are one row from the start, so copies are never expanded into pairs, and the bit count is part of
the join's condition, so a pair that is met but doesn't link makes no row.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a text of one or two
words has one shingle; repeated rows share a component; a null id is never a component's name unless all its ids are
null; an empty table gives an empty result.

`one_of_each` goes on from there: groups of fingerprints that the search links are where near copies are looked for, and
a link is what the texts confirm, sharing `similarity` of their different 5-word shingles (Jaccard). Texts that are so
similar can differ in up to 14 bits of their fingerprints, more than pigeonhole search can cover, so beside those groups there
are buckets of texts that share all minima of one of 24 bands of 6 MinHash values (a pair at exactly 0.8 that is in no group is
missed with odds of 0.0007, more similar ones with less). Members of a group or bucket are
first compared with four of its texts, the one that shares the fullest buckets among them, since it lies in the middle
of its copies. After that only texts of different components are compared, by their shingles in the join's own
condition, so that what doesn't link makes no row: a large group of near copies isn't expanded into its pairs, and the
components are those that all pairs of all buckets would give.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import checkpoint_dir, connected_components

SHINGLE, SEED, BITS = 3, 42, 64
#: Near copies: words in a shingle, similarity, MinHash values in a band, bands, and the most that 128 bits of two texts' values may differ.
WIDE, SIMILARITY, ROWS, BANDS, UNLIKE = 5, 0.8, 6, 24, 32
FACTORS, SHIFTS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, ROWS * BANDS), dtype=np.uint32) | np.array([[1], [0]], dtype=np.uint32)
PLACES = np.random.default_rng(SEED + 1).integers(0, 1 << 64, WIDE + 1, dtype=np.uint64) | np.uint64(1)


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 of each shingle of a text, repeats included; none without a word."""
    words = lower_words(text)
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    spans, digest = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype="<u8", count=n)


def shingle_set(text: str | None) -> np.ndarray:
    """A hash of each different WIDE-word shingle, in order; none without a word. Words are hashed once each, and a
    shingle's hash is a mixed sum of its words' hashes, each times its place's factor."""
    words = lower_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    own = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n, width = max(1, len(words) - WIDE + 1), min(WIDE, len(words))
    told = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        told += own[k : k + n] * PLACES[k]
    told = (told ^ told >> np.uint64(32)) * PLACES[WIDE]
    return np.unique(told ^ told >> np.uint64(29))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    hashes = shingle_hashes(text, width)
    n, set_bits = len(hashes), np.zeros(BITS, dtype=np.int64)
    if not n:
        return 0
    for k in range(0, n, 1 << 15):
        set_bits += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column) -> Column:
    """Fingerprints as signed 64-bit integers."""

    def marked(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64), index=texts.index)

    return F.pandas_udf(marked, "long")(text)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set, over all rows."""

    def gram(batches):
        total = np.zeros((BITS, BITS), dtype=np.int64)
        n = 0
        for rows in batches:
            values = rows["fp"].to_numpy(np.int64).view(np.uint64)
            for k in range(0, len(values), 1 << 14):
                b = np.unpackbits(values[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (b.T @ b).astype(np.int64)
            n += len(values)
        if n:
            i, j = np.indices((BITS, BITS))
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": total.ravel()})
            yield pd.DataFrame({"i": [-1], "j": [-1], "n": [n]})

    both, n = np.zeros((BITS, BITS), dtype=np.int64), 0
    for r in prints.mapInPandas(gram, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 4097 rows at most
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of near-equal size: each starts with the bit most correlated with the free ones, and takes the free bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        first = max(free, key=lambda b: (corr[b, free].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    """The bits' mask as a signed 64-bit integer."""
    return int(np.array(sum(1 << b for b in bits), dtype=np.uint64).view(np.int64))


def estimated_pairs(same: float, n: int, both: np.ndarray, bits: list[int], limit: int) -> list[float]:
    """Estimated ordered pairs within 0, 1, ... limit differing bits on a partition: the counted pairs without
    difference, times the odds of so many differences if the bits differ independently."""
    p = np.diag(both)[bits] / max(n, 1)
    odds = 2 * p * (1 - p) / (p**2 + (1 - p) ** 2)
    by_difference = np.zeros(limit + 1)
    by_difference[0] = 1
    for o in odds:
        by_difference[1:] += by_difference[:-1] * o
    return list(same * np.cumsum(by_difference))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, summing to total, with the smallest sum of costs[i][threshold]; -1 costs nothing."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                at, c = spent + t, cost + (row[t] if t >= 0 else 0)
                if at not in following or c < following[at][0]:
                    following[at] = (c, [*chosen, t])
        best = following
    return best[total]


def plan_search(prints: DataFrame, limit: int = 3, partitions: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is searched."""
    n, both = bit_counts(prints)
    groups = {m: correlated_groups(n, both, m) for m in partitions}
    masks = [mask_of(g) for m in partitions for g in groups[m]]
    fp = F.col("fp")
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(mask)).alias("key")) for k, mask in enumerate(masks)]))
    counts = prints.select(keys.alias("x")).groupBy("x.k", "x.key").count().groupBy("k").agg(F.sum(F.col("count").cast("double") ** 2 - F.col("count")).alias("same"))
    same = {r["k"]: r["same"] for r in counts.collect()}  # one row for each partition
    plans, k = [], 0
    for m in partitions:
        costs = []
        for bits in groups[m]:
            met = estimated_pairs(same.get(k, 0.0), n, both, bits, limit)
            costs.append([met[t] + max(n, 1) * sum(comb(len(bits), d) for d in range(t + 1)) for t in range(limit + 1)])
            k += 1
        cost, thresholds = allocate(costs, limit - m + 1)
        plans.append((cost, m, [(bits, t) for bits, t in zip(groups[m], thresholds, strict=True) if t >= 0]))
    return min(plans)[2]


def fingerprint_links(prints: DataFrame, limit: int = 3, partitions: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(a, b): all pairs of different fingerprints (column fp, without repeats) within limit bits, a < b; a pair may come more than once.

    A partition's probes are one array of masks, so the plan is as small for thousands of them as for one."""

    def flipped(k: int, key: Column, masks: list[int]) -> Column:
        return F.transform(F.lit(np.array(masks, dtype=np.int64)), lambda mask: F.struct(F.lit(k).alias("k"), key.bitwiseXOR(mask).alias("key")))

    kept, probed = [], []
    for k, (bits, threshold) in enumerate(plan_search(prints, limit, partitions)):
        key = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        kept.append(F.struct(F.lit(k).alias("k"), key.alias("key")))
        probed.append(flipped(k, key, [mask_of(list(flip)) for d in range(threshold + 1) for flip in combinations(bits, d)]))
    stored = prints.select(F.col("fp").alias("b"), F.explode(F.array(*kept)).alias("s")).select("b", F.col("s.k").alias("s_k"), F.col("s.key").alias("s_key"))
    probes = prints.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probed))).alias("p")).select("a", F.col("p.k").alias("p_k"), F.col("p.key").alias("p_key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit)
    return probes.join(stored, (F.col("p_k") == F.col("s_k")) & (F.col("p_key") == F.col("s_key")) & near).select("a", "b")


def near_duplicates(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of every row."""
    checkpoint_dir(documents.sparkSession)
    marked = documents.select(F.col(id_column).alias("doc_id"), fingerprint_column(F.col(text_column)).alias("fp")).checkpoint()
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    parts = connected_components(fingerprint_links(groups.select("fp"), limit))
    rooted = groups.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy(F.col("root").alias("name")).agg(F.min("least").alias("component_id"))
    rooted = rooted.join(named, F.col("root") == F.col("name")).select(F.col("fp").alias("of"), "component_id")
    return marked.join(rooted, F.col("fp") == F.col("of")).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """The first n MinHash values of a set of hashes: the least of their upper halves under each of n mixings; all ones for an empty set."""
    least, halves = np.full(n, (1 << 32) - 1, dtype=np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    room = np.empty((256, n), dtype=np.uint32)
    for k in range(0, len(halves), 256):
        some = halves[k : k + 256, None]
        mixed = np.multiply(some, FACTORS[:n], out=room[: len(some)])
        mixed += SHIFTS[:n]
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def sketch(text: str | None) -> tuple[int, int, int, np.ndarray]:
    """A text's shingle set as a hash, 128 bits of its MinHash values as two integers, and its bands' keys; all signed."""
    own = shingle_set(text)
    node = xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)
    if not len(own):
        return node, 0, 0, np.empty(0, dtype=np.int64)
    least = minima(own, ROWS * BANDS)
    left, right = np.packbits((least[: 2 * BITS] & np.uint32(1)).astype(np.uint8)).view(np.int64).tolist()
    keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, ROWS))], dtype=np.int64)
    return node, left, right, keys


def sketch_column(text: Column) -> Column:
    """node, left, right and keys of each text."""

    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(x) for x in texts], columns=["node", "left", "right", "keys"], index=texts.index)

    return F.pandas_udf(told, "node long, left long, right long, keys array<long>")(text)


def shingle_column(text: Column) -> Column:
    """The different shingle hashes of each text."""

    def told(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x).view(np.int64) for x in texts], index=texts.index, dtype=object)

    return F.pandas_udf(told, "array<long>")(text)


def jaccard(a: Column, b: Column) -> Column:
    """The part of two sets of shingles that is in both."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def alike(a: str, b: str) -> Column:
    """Whether two sketches (structs of these names) differ in so few bits that the texts can be near copies."""
    return F.bit_count(F.col(f"{a}.left").bitwiseXOR(F.col(f"{b}.left"))) + F.bit_count(F.col(f"{a}.right").bitwiseXOR(F.col(f"{b}.right"))) <= UNLIKE


def print_groups(marked: DataFrame, limit: int = 3) -> DataFrame:
    """(key, x) of each sketch: the component of its text's fingerprint by links of at most limit bits, found by the pigeonhole search."""
    prints = marked.select("fp").distinct().checkpoint()
    parts = connected_components(fingerprint_links(prints, limit)).withColumnRenamed("node", "of")
    held = marked.select("fp", F.struct("node", "left", "right").alias("x")).distinct()
    return held.join(parts, F.col("fp") == F.col("of"), "left").select(F.xxhash64(F.lit("fingerprint"), F.coalesce("component", "fp")).alias("key"), "x").distinct()


def similar_components(documents: DataFrame, id_column: str, text_column: str, similarity: float = SIMILARITY, limit: int = 3) -> DataFrame:
    """doc_id, text_hash, component_id (smallest doc_id reachable by links of similar texts) and stays of every row.

    stays: the row's id and text are the smallest of its component, null ids last; rows that repeat both share it."""
    checkpoint_dir(documents.sparkSession)
    held = documents.select(F.col(id_column).alias("doc_id"), F.xxhash64(id_column).alias("id_hash"), F.xxhash64(text_column).alias("hash"), F.col(text_column).alias("text"))
    marked = held.select("doc_id", "hash", fingerprint_column(F.col("text")).alias("fp"), sketch_column(F.col("text")).alias("s")).select("doc_id", "hash", "fp", "s.*").checkpoint()
    nodes = marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("least"))
    spread = marked.dropDuplicates(["node"]).select(F.explode("keys").alias("key"), F.struct("node", "left", "right").alias("x")).unionByName(print_groups(marked, limit))
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("key", "of")
    members = spread.join(sizes, F.col("key") == F.col("of")).select("key", "x", "n").checkpoint()
    central = members.groupBy("x.node").agg(F.sum("n").alias("score")).withColumnRenamed("node", "of")
    scored = members.join(central, F.col("x.node") == F.col("of")).select("key", "x", "score")
    firsts = F.array(F.max_by("x", F.struct("score", "x.node")), F.min("x"), F.max("x"), F.min_by("x", F.xxhash64("x.node")))
    buckets = scored.groupBy("key").agg(firsts.alias("firsts")).withColumnRenamed("key", "of")
    crowded = members.join(buckets, F.col("key") == F.col("of")).select("key", "x", "firsts").checkpoint()
    asked = crowded.select("x.node").distinct().join(nodes, "node").select("node", F.xxhash64("least.doc_id").alias("id_hash"), F.col("least.hash").alias("hash"))  # one row of each: copies don't meet in a task
    texts = held.join(asked.select("id_hash", "hash"), ["id_hash", "hash"], "left_semi").groupBy("id_hash", "hash").agg(F.first("text").alias("text")).join(asked, ["id_hash", "hash"])
    sets = texts.select("node", shingle_column(F.col("text")).alias("set")).checkpoint()  # of texts that share a bucket with others

    def confirmed(pairs: DataFrame) -> DataFrame:
        """(a, b) of the rows (x, y) whose texts are near copies."""
        ends = [f(F.col("x.node"), F.col("y.node")).alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
        met = pairs.filter(F.col("x.node") != F.col("y.node")).select(*ends).distinct()
        a, b = (sets.select(F.col("node").alias(c), F.col("set").alias(f"{c}_set")) for c in "ab")
        return met.join(a, "a").join(b, "b").filter(jaccard(F.col("a_set"), F.col("b_set")) >= similarity).select("a", "b")

    near = connected_components(confirmed(crowded.select("x", F.explode("firsts").alias("y")).filter(alike("x", "y"))))
    joined = crowded.select("key", "x").join(near, F.col("x.node") == F.col("node"), "left").select("key", "x", F.coalesce("component", "x.node").alias("part")).checkpoint()
    mixed = joined.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.mode("part", True).alias("most")).filter("low < high").select(F.col("key").alias("of"), "most")
    rest = joined.join(mixed, F.col("key") == F.col("of")).select("of", "x", "part", "most")
    rest = rest.join(sets.withColumnRenamed("node", "n"), F.col("x.node") == F.col("n")).select("of", "x", "part", "most", "set")
    few = rest.filter("part <> most").select(F.col("of").alias("key"), "x", F.col("part").alias("x_part"), F.col("set").alias("x_set"))  # of two different parts one at least isn't the most frequent
    linked = (F.col("x_part") != F.col("part")) & alike("x", "y") & (jaccard(F.col("x_set"), F.col("set")) >= similarity)
    met = few.join(rest.select("of", F.col("x").alias("y"), "part", "set"), (F.col("key") == F.col("of")) & linked)
    late = met.select(F.col("x_part").alias("a"), F.col("part").alias("b"))
    last = connected_components(late).select(F.col("node").alias("part"), F.col("component").alias("root"))
    rooted = nodes.select("node", "least").join(near.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    rooted = rooted.join(last, "part", "left").select("node", "least", F.coalesce("root", "part").alias("root"))
    named = rooted.groupBy(F.col("root").alias("name")).agg(F.min("least").alias("first"))
    rooted = rooted.join(named, F.col("root") == F.col("name")).select("node", "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    return marked.select("doc_id", "hash", "node").join(rooted, "node").select("doc_id", F.col("hash").alias("text_hash"), F.col("first.doc_id").alias("component_id"), stays.alias("stays"))


def one_of_each(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, limit: int = 3) -> DataFrame:
    """The documents with all their columns, one of each component of near copies: that with the smallest id, and of several texts with this id one.

    Rows that share an id and have texts of different components are different documents, and so are rows without an
    id; rows that repeat both id and text are one. Texts are shuffled once, by the hashes of id and text."""
    found = similar_components(documents, id_column, text_column, similarity, limit)
    stay = found.filter("stays").select(F.xxhash64("doc_id").alias("s_id"), F.col("text_hash").alias("s_text")).distinct()
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.xxhash64(id_column).alias("_id"), F.xxhash64(text_column).alias("_text"))
    return keyed.join(stay, (F.col("_id") == F.col("s_id")) & (F.col("_text") == F.col("s_text")), "left_semi").dropDuplicates(["_id", "_text"]).select("_row.*")
