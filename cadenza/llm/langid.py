"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with its code point. An n-gram's vector
binds its letters' vectors, each rotated by its place, by multiplication. A text's vector bundles (sums) those of
its n-grams. A language's prototype bundles the texts that are labelled with it, each scaled to the same length;
a text gets the language of the prototype with the largest cosine.

Learning reads every labelled text outside the held-out fold. Each task bundles its own texts; the bundles, one row
for each language and component, are summed by Spark, and only the sums reach the driver (languages x DIMENSIONS).

Defined results: null texts and texts without a letter get `und` and score 0, as do all texts if nothing was
learned; texts of any length are read whole, a block of letters at a time; ties go to the first language by code
point; repeated rows each get their own result; further columns are left out, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.holdout import held_out

DIMENSIONS, GRAM, UNKNOWN = 1024, 3, "und"
#: Texts whose n-grams are counted in one matrix, and n-grams that are bound at a time.
TEXTS, BOUND = 128, 4096
POINTS = 0x110000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter; one table for each worker."""
    table = np.zeros(POINTS, dtype=bool)
    table[[c for c in range(POINTS) if chr(c).isalpha()]] = True
    return table


@lru_cache(maxsize=1 << 16)
def letter_vector(point: int) -> np.ndarray:
    """The letter's vector; the point of a space stands for anything between words."""
    return np.random.default_rng([point, DIMENSIONS]).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1


def bound_vectors(grams: np.ndarray) -> np.ndarray:
    """The vectors of n-grams, given as rows of code points."""
    points, place = np.unique(grams, return_inverse=True)
    place = place.reshape(grams.shape)
    vectors = np.stack([letter_vector(int(p)) for p in points])
    found = np.ones((len(grams), DIMENSIONS), dtype=np.float32)
    for k in range(grams.shape[1]):
        found *= np.roll(vectors, grams.shape[1] - 1 - k, axis=1)[place[:, k]]
    return found


def spaced_points(text: str) -> np.ndarray:
    """Lower-case code points with one space for each run of other characters, and one at either end; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    points = np.where(letters()[points], points, 32)
    points = np.concatenate(([32], points, [32]))
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    return points if len(points) > 2 else points[:0]


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """One bundle for each text; zero for those without a letter."""
    bundles = np.zeros((len(texts), DIMENSIONS), dtype=np.float64)
    for start in range(0, len(texts), TEXTS):
        runs = [spaced_points(t or "") for t in texts[start : start + TEXTS]]
        held = [i for i, r in enumerate(runs) if len(r)]
        if not held:
            continue
        alphabet, codes = np.unique(np.concatenate([runs[i] for i in held]), return_inverse=True)
        base = len(alphabet)
        owner = np.repeat(np.array(held), [len(runs[i]) for i in held])
        gram = codes[: -GRAM + 1].astype(np.int64)
        for k in range(1, GRAM):
            gram = gram * base + codes[k : len(codes) - GRAM + 1 + k]
        inside = owner[: -GRAM + 1] == owner[GRAM - 1 :]
        grams, which = np.unique(gram[inside], return_inverse=True)
        places = np.stack([grams // base ** (GRAM - 1 - k) % base for k in range(GRAM)], axis=1)
        owner = owner[: -GRAM + 1][inside]
        for lo in range(0, len(grams), BOUND):
            hi = min(lo + BOUND, len(grams))
            part = (which >= lo) & (which < hi) if len(grams) > BOUND else slice(None)
            counts = np.bincount(owner[part] * (hi - lo) + which[part] - lo, minlength=len(runs) * (hi - lo)).reshape(len(runs), hi - lo)
            bundles[start : start + len(runs)] += counts.astype(np.float32) @ bound_vectors(alphabet[places[lo:hi]])
    return bundles


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length == 0, 1, length)


def prototypes(documents: DataFrame, text_column: str = "text", label_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages by code point, and a unit vector for each."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for rows in batches:
            vectors = unit(text_vectors(rows["text"].tolist()))
            for label, places in rows.groupby("label").indices.items():
                sums[label] = sums.get(label, 0) + vectors[places].sum(axis=0)
        for label, v in sums.items():
            yield pd.DataFrame({"label": label, "k": np.arange(DIMENSIONS, dtype=np.int32), "v": np.round(v * (1 << 20)).astype(np.int64)})

    held = documents.select(F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("label")).filter("text is not null and label is not null")
    sums = held.mapInPandas(bundle, "label string, k int, v long").groupBy("label", "k").agg(F.sum("v").alias("v")).toPandas()
    table = sums.pivot(index="label", columns="k", values="v").sort_index() if len(sums) else pd.DataFrame(index=[])
    table = table[table.abs().sum(axis=1) > 0] if len(table) else table
    return list(table.index), unit(table.to_numpy(np.float64)) if len(table) else np.zeros((0, DIMENSIONS))


def with_language(documents: DataFrame, names: list[str], profile: np.ndarray, *, text_column: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with all their columns, the language found and the cosine (at least 0) with its prototype. Columns of these two names are replaced."""
    profile = profile.astype(np.float64)

    def judge(texts: pd.Series) -> pd.DataFrame:
        vectors = unit(text_vectors(texts.tolist()))
        known = np.abs(vectors).sum(axis=1) > 0
        if not names or not len(texts):
            return pd.DataFrame({"name": [UNKNOWN] * len(texts), "score": 0.0}, index=texts.index)
        cosines = vectors @ profile.T
        best = cosines.argmax(axis=1)
        return pd.DataFrame(
            {"name": np.where(known, np.array(names, dtype=object)[best], UNKNOWN), "score": np.where(known, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)}, index=texts.index
        )

    judged = F.pandas_udf(judge, "name string, score double")
    held = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), judged(F.col(text_column)).alias("_judged"))
    rest = [F.col(f"_row.`{c}`") for c in documents.columns if c not in (to, score)]
    return held.select(*rest, F.col("_judged.name").alias(to), F.col("_judged.score").alias(score))


def languages(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; prototypes come from the labelled rows that aren't held out."""
    out = held_out(F.col(id_column))
    names, profile = prototypes(documents.filter(~out), text_column, label_column)
    held = documents.select(F.col(id_column).alias("doc_id"), out.alias("held_out"), F.col(text_column).alias("text"))
    return with_language(held, names, profile).select("doc_id", "held_out", "lang_pred", "score")
