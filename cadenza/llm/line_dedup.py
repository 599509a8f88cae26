"""Line dedup by distinct-site spread.

Every normalised line's hash has a HyperLogLog sketch of its sites, merged by aggregation. Lines whose estimate is
near the threshold are counted again exactly, so the sketch's error never decides. A line on `min_sites` sites or
more is cross-site boilerplate: its first document (smallest id) keeps it, all others lose it, so no text that is
said anywhere is lost as a whole.

A line may hold a third of all rows, so joins by line are dealt by line and a salt: the rows of a line go to `salts`
tasks, and the short list of spread lines to each of them.

Defined results: a null text stays null and has no lines; lines without a word are never boilerplate; a null site is
a site of its own; rows with the same id share the same decision; a null id is never first unless all ids are
null; very long texts are one row's lines in the JVM; further columns may have any names; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import text as T
from cadenza.llm.components import checkpoint_dir

SALTS = 16


def document_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source") -> DataFrame:
    """doc_id, text_hash, site, and the place and hash of each line with a word."""
    told = F.transform(T.lines(F.col(text_column)), lambda x: F.when(T.has_word(x), T.line_hash(x)))
    held = documents.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.coalesce(F.concat(F.lit("="), F.col(site_column)), F.lit("")).alias("site"), F.posexplode(told).alias("pos", "line")
    )
    return held.filter(F.col("line").isNotNull())


def salted(rows: DataFrame, of: Column, salts: int) -> DataFrame:
    """The rows with a salt by the hash of a column that differs between rows of one line."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(of), F.lit(salts)))


def for_each_salt(rows: DataFrame, salts: int) -> DataFrame:
    """Each row once for every salt."""
    return rows.withColumn("s_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))


def spread_lines(lines: DataFrame, *, min_sites: int = 5, lg_k: int = 12, margin: float = 0.3, salts: int = SALTS) -> DataFrame:
    """(line, first): the lines on min_sites sites or more, and the smallest doc_id that has each.

    margin: estimates within this part of the threshold are checked; the sketch's standard error is 1.04 / sqrt(2 ** lg_k)."""
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("doc_id").alias("first"))
    guessed = sketched.select("line", "first", F.hll_sketch_estimate("sketch").alias("guess")).filter(F.col("guess") >= min_sites * (1 - margin))
    near = guessed.filter(F.col("guess") <= min_sites * (1 + margin)).select(F.col("line").alias("s_line"), "first")
    asked = salted(lines, F.struct("doc_id", "pos"), salts).join(for_each_salt(near, salts), (F.col("line") == F.col("s_line")) & (F.col("salt") == F.col("s_salt")))
    sites = asked.groupBy("line", "site").agg(F.first("first").alias("first")).groupBy("line").agg(F.count(F.lit(1)).alias("sites"), F.first("first").alias("first"))
    far = guessed.filter(F.col("guess") > min_sites * (1 + margin)).select("line", "first")
    return far.unionByName(sites.filter(F.col("sites") >= min_sites).select("line", "first"))


def without_spread_lines(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source", salts: int = SALTS, **options) -> DataFrame:
    """The documents with all their columns, texts without other documents' boilerplate lines, and the list of places removed as `_removed`.

    Lines are hashed once and kept as a table of hashes in the shared folder; only that is shuffled to find them. Texts
    are cut along the sorted places, in time linear in the text."""
    checkpoint_dir(documents.sparkSession)
    lines = document_lines(documents, id_column, text_column, site_column).checkpoint()
    spread = for_each_salt(spread_lines(lines, salts=salts, **options).withColumnRenamed("line", "s_line"), salts)
    held = salted(lines, F.struct("doc_id", "pos"), salts)
    gone = held.join(spread, (F.col("line") == F.col("s_line")) & (F.col("salt") == F.col("s_salt"))).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_text")).agg(F.sort_array(F.collect_set("pos")).alias("_removed"))
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    told = keyed.join(gone, F.col("_id").eqNullSafe(F.col("g_id")) & (F.xxhash64("_text") == F.col("g_text")), "left")

    def cut(parts):
        removed = F.col("_removed")
        edges = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(parts)))
        spans = F.filter(F.transform(edges, lambda e, i: F.struct((e + 2).alias("from"), (F.get(edges, i + 1) - e - 1).alias("n"))), lambda s: s["n"] > 0)
        return F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(parts, s["from"], s["n"]))), "\n")

    text = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(T.let(F.split("_text", "\n"), cut))
    columns = [(text if c == text_column else F.col(f"_row.`{c}`")).alias(c) for c in documents.columns]
    return told.select(*columns, F.coalesce("_removed", F.array().cast("array<int>")).alias("_removed"))


def line_report(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source", **options) -> DataFrame:
    """doc_id, n_removed (lines) and the text that is left of every document."""
    held = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(site_column).alias("source"))
    told = without_spread_lines(held, **options)
    return told.select("doc_id", F.size("_removed").cast("long").alias("n_removed"), "text")


LINES_SQL = r"""
with l as (
  select doc_id, pos, line, coalesce('=' || source, '') as site,
         case when regexp_matches(line, '[^\x20\x09-\x0D]') then lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) end as norm
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null) x),
spread as (select norm, min(doc_id) as first from l where norm is not null group by norm having count(distinct site) >= 5),
m as (select l.*, s.norm is not null and l.doc_id <> s.first as gone from l left join spread s on l.norm = s.norm),
t as (select doc_id, count(*) filter (where gone) as n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text from m group by doc_id)
select d.doc_id, cast(coalesce(t.n_removed, 0) as bigint) as n_removed, t.text from documents d left join t using (doc_id)
"""
