"""Quality rules with cross-document line frequency.

Base figures come from each text alone. The method's own verdict counts, for every host and normalised line, the
distinct documents (by text: exact copies of a text count once) that have the line; lines in more than
`least_documents` of a host, and in more than `share` of its documents with a line, are removed, and documents that keep
less than `min_kept` of their words are rejected. The share makes the limit grow with the host: on a host of a million
documents a usual line is in fifty of them, and says nothing.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; lines without
a word are never counted; very long texts are one row's arrays in the JVM; repeated rows each get their own result;
further columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import text as T
from cadenza.llm.components import checkpoint_dir
from cadenza.llm.line_dedup import SALTS, for_each_salt, salted

GRAM = 5
#: A line goes if it is in more documents of a host than this, and in more than this part of them.
LEAST_DOCUMENTS, SHARE = 5, 0.05


def repeat_words(hashes: Column) -> Column:
    """Number of words, given by their hashes in order, that lie in GRAM-word windows found twice or more."""

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        fresh = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(GRAM), F.get(p, k + 1) - x)), F.lit(0), lambda a, x: a + x)
        return T.let(T.let(placed, starts), fresh)

    def of(h: Column) -> Column:
        grams = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (GRAM - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, GRAM)]))
        return T.let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    return T.let(hashes, of).cast("long")


def base_figures(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    spoken = T.let(F.filter(F.split(text, "\n"), T.has_word), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    kept = documents.select(
        F.col(id_column).alias("doc_id"),
        F.col(host_column).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        (F.length(text) - without("\x20\t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        spoken.cast("long").alias("n_dup_lines"),
        T.let(F.transform(T.words(text), lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeat_words(h).alias("n_repeat_words"))).alias("w"),
    )
    return kept.select("doc_id", "host", "text_hash", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def host_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """host, hashes of id and text and, for each line with a word, its place, hash and number of words."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    told = F.transform(F.filter(F.split(text, "\n"), T.has_word), lambda x: F.struct(T.line_hash(x).alias("line"), F.size(T.words(x)).alias("n")))
    held = documents.select(F.col(host_column).alias("host"), F.xxhash64(id_column).alias("id_hash"), F.xxhash64(text).alias("text_hash"), F.posexplode(told).alias("pos", "l"))
    return held.select("host", "id_hash", "text_hash", "pos", "l.line", "l.n")


def line_frequency_rules(documents: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, share: float = SHARE, min_kept: float = 0.5, salts: int = SALTS, **columns: str) -> DataFrame:
    """doc_id, the base figures, n_removed_words, base_failed and kept for every row of documents.

    What a text loses depends on its host and its words alone, so it is summed once for each host and text. Lines are
    hashed once and kept as a table of hashes in the shared folder; a line may hold a third of its rows, so the join by
    line is dealt by a salt too."""
    checkpoint_dir(documents.sparkSession)
    lines = host_lines(documents, **columns).checkpoint()
    hosts = lines.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("h_host")).agg(F.count(F.lit(1)).alias("n_texts"))
    counted = lines.groupBy("host", "line").agg(F.count_distinct("text_hash").alias("n_docs")).filter(F.col("n_docs") > least_documents)
    frequent = counted.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).filter(F.col("n_docs") > F.lit(float(share)) * F.col("n_texts"))
    frequent = for_each_salt(frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line")), salts)
    held = salted(lines, F.struct("id_hash", "pos"), salts)
    lost = held.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")) & (F.col("salt") == F.col("s_salt")))
    lost = lost.groupBy("host", "text_hash", "pos").agg(F.max("n").alias("n")).groupBy("host", "text_hash").agg(F.sum("n").alias("n_removed_words"))
    lost = lost.select(F.col("host").alias("l_host"), F.col("text_hash").alias("l_text"), "n_removed_words")
    base = base_figures(documents, **columns)
    told = base.join(lost, F.col("host").eqNullSafe(F.col("l_host")) & (F.col("text_hash") == F.col("l_text")), "left")
    told = told.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    told = told.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= F.lit(min_kept) * F.col("n_words")))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


RULES_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
g as (select doc_id, i, list_slice(words, i, i + 4) as gram from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from d where len(words) >= 5) x),
again as (select doc_id, gram from g group by doc_id, gram having count(*) > 1),
covered as (select doc_id, count(distinct p) as n from (select g.doc_id, unnest(range(g.i, g.i + 5)) as p from g join again using (doc_id, gram)) x group by doc_id),
l as (select doc_id, source, text, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) as norm,
             len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as n
      from (select doc_id, source, text, unnest(lines) as line from d) x),
hosts as (select source, count(distinct text) as n_texts from l group by source),
counted as (select source, norm, count(distinct text) as n_docs from l group by source, norm),
frequent as (select c.source, norm from counted c join hosts h on c.source is not distinct from h.source where n_docs > 5 and n_docs > 0.05::double * n_texts),
lost as (select l.doc_id, sum(l.n) as n from l join frequent f on l.norm = f.norm and l.source is not distinct from f.source group by l.doc_id),
m as (
  select d.doc_id, cast(len(words) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(covered.n, 0) as bigint) as n_repeat_words,
         cast(coalesce(lost.n, 0) as bigint) as n_removed_words
  from d left join covered using (doc_id) left join lost using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words - n_removed_words >= 0.5 * n_words as kept
from m
"""
