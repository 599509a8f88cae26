"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are put in a shuffled order. A document's virtual finish time is its source's cumulative
words, up to and including it, divided by the source's target. All documents of all sources are then taken in the
order of their finish times until the total budget is spent, so that each source ends near its target. A source
whose target is above its size goes through its documents again, up to `repeats` times.

Running sums never meet in one task: a source is cut into buckets by the leading digits of the shuffle key, and the
global order into ranges of finish time, and the one range in which the budget ends into ranges again; only sums per
bucket or range, of a fixed number, are ordered as a whole, and the rows of the one small range that the budget cuts.
Sources, which can be as many as hosts, aren't ordered in one task either: their ranks come from ranges of names, and
the level of the targets from bands of size.

Texts are read once for their sizes and take no part in the queue; `mixed_documents` joins them to what is taken.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated rows are
documents of their own; documents of size 0 are taken 0 words; texts of any length count whole; further columns may have
any names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import text as T
from cadenza.llm.components import checkpoint_dir

#: Ranges of finish time per unit, and of each of these; finish times of 2 and more share the last range.
RANGES = 4096
#: Bands of a source's cap by its weight, for each doubling.
BANDS = 512


def weighted_sources(per: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """The sources (one row each) with their weight w: weights go to them by code point, null last, and repeat.

    Sources are dealt to ranges of their names; a source's rank is its rank within its range and the ranges' counts before it."""
    order = F.col("source").asc_nulls_last()
    dealt = per.repartitionByRange(order).withColumn("part", F.spark_partition_id()).checkpoint()  # the ranges are drawn once
    counts = dealt.groupBy("part").count()  # a row for each partition
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("part").alias("c_part"), F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    ranked = dealt.withColumn("nth", nth).join(F.broadcast(counts), F.col("part") == F.col("c_part"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("before") + F.col("nth")) % len(weights) + 1).cast("int"))
    return ranked.withColumn("w", weight.cast("long")).drop("part", "c_part", "before", "nth")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, target, budget) from rows (source, size).

    The targets share `share` times all sizes by weight. No target is above `repeats` times its source's size; what is
    cut off goes to the others by weight. Sources reach their cap in the order of cap / weight, so the level of the
    others is found at the first cap / weight above what is left there for each weight. Sums over bands of cap / weight
    (some ten thousand of them at most) tell the band, and the different values within it the place."""
    checkpoint_dir(sizes.sparkSession)
    per = weighted_sources(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    per = per.withColumn("cap", F.col("source_size") * repeats)
    per = per.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    per = per.withColumn("band", F.when(F.col("ratio") > 0, F.floor(F.log2("ratio") * BANDS)).otherwise(F.lit(-(2**40)))).checkpoint()
    totals = per.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))  # one row
    upto = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    bands = per.groupBy("band").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.max("ratio").alias("most"))
    bands = bands.withColumns({"cap_upto": F.sum("cap").over(upto), "w_upto": F.sum("w").over(upto)}).join(F.broadcast(totals), F.lit(True))
    budget = F.col("all_size") * F.lit(share)
    over = F.col("cap_upto") + F.col("most") * (F.col("all_w") - F.col("w_upto")) > budget
    least = F.min_by(F.struct("band", (F.col("cap_upto") - F.col("cap")).alias("cap_before"), (F.col("w_upto") - F.col("w")).alias("w_before")), "band")
    found = bands.filter(over).agg(least.alias("b")).select(F.col("b.band").alias("b_band"), "b.cap_before", "b.w_before")  # one row
    same = per.join(F.broadcast(found), F.col("band") == F.col("b_band")).groupBy("ratio", "cap_before", "w_before").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")).join(F.broadcast(totals), F.lit(True))
    earlier = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)  # different values of one band
    left = budget - (F.col("cap_before") + F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
    left_w = F.col("all_w") - (F.col("w_before") + F.coalesce(F.sum("w").over(earlier), F.lit(0)))
    level = same.withColumn("level", left / left_w).filter("ratio > level").agg(F.min_by("level", "ratio").alias("level"))  # one row
    per = per.join(F.broadcast(totals), F.lit(True)).join(F.broadcast(level), F.lit(True))
    cap = F.col("cap").cast("double")
    target = F.coalesce(F.least(cap, F.col("w") * F.col("level")), cap)
    return per.select("source", "source_size", target.alias("target"), budget.alias("budget")).checkpoint()


def fair_queue(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
    digits: int = 3,
) -> DataFrame:
    """One row for each document and pass: doc_id, text_hash, source, size, source_size, target, row (an id of the input row), pass, finish and taken.

    digits: hex digits of the shuffle key that cut a source into buckets (16 ** digits of them).
    """
    checkpoint_dir(documents.sparkSession)
    held = documents.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(text_column).alias("text_hash"),
        F.col(source_column).alias("source"),
        T.n_words(F.col(text_column)).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary")).alias("key"),
    )
    held = held.withColumn("bucket", F.substring("key", 1, digits)).checkpoint()  # some ten bytes for each document
    buckets = held.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(buckets.select("source", "size"), weights, share, repeats).withColumnRenamed("source", "t_source")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets, F.col("b_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        held.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.count(F.lit(1)).over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .drop("b_source", "b_bucket")
        .checkpoint()
    )
    passed = F.col("pass") * F.col("source_size") + F.col("start") + F.col("upto")
    copies = (
        queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("finish", F.when(F.col("target") > 0, passed / F.col("target")).otherwise(F.lit(0.0)))
        .withColumn("place", F.least(F.col("finish"), F.lit(2.0)) * RANGES)
        .withColumns({"range": F.floor("place").cast("int"), "part": F.floor((F.col("place") - F.floor("place")) * RANGES).cast("int")})
        .select("doc_id", "text_hash", "source", "size", "source_size", "target", "budget", F.struct("source", "bucket", "nth").alias("row"), "key", "pass", "finish", "range", "part")
    )

    def cut(rows: DataFrame, by: str, start: str) -> tuple[DataFrame, DataFrame]:
        """The rows of the ranges that the budget takes or leaves whole, with taken, and those of the range in which it ends, with its start as c_start."""
        words = rows.groupBy(by, start, "budget").agg(F.sum("size").alias("words"))  # 2 * RANGES + 1 rows at most
        upto = F.col(start) + F.sum("words").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        ranges = words.select(F.col(by).alias("r_range"), (upto - F.col("words")).alias("c_start"), upto.alias("c_end")).checkpoint()
        placed = rows.join(F.broadcast(ranges), F.col(by) == F.col("r_range"))
        splits = (F.col("c_start") < F.col("budget")) & (F.col("c_end") > F.col("budget"))
        whole = placed.filter(~splits).withColumn("taken", F.col("c_end") <= F.col("budget"))
        return whole, placed.filter(splits).drop("r_range", "c_end")

    whole, rest = cut(copies.withColumn("start", F.lit(0).cast("long")), "range", "start")
    near, last = cut(rest.withColumn("start", F.col("c_start")).drop("c_start"), "part", "start")
    final = Window.partitionBy("range", "part").orderBy("finish", "key", "doc_id", "size", "text_hash", "pass").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("taken", F.col("c_start") + F.sum("size").over(final) <= F.col("budget"))
    columns = ["doc_id", "text_hash", "source", "size", "source_size", "target", "row", "pass", "finish", "taken"]
    return whole.select(*columns).unionByName(near.select(*columns)).unionByName(last.select(*columns))


def mix(documents: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    queue = fair_queue(documents, **options)
    taken = F.sum(F.when(F.col("taken"), F.col("size")).otherwise(F.lit(0))).alias("taken")
    return queue.groupBy("row", "doc_id", "size", "source_size", "target").agg(taken).drop("row")


def mixed_documents(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", repeats: int = 2, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    What is taken is joined to the texts by hashes of id, text and source, the one time that texts are moved. Rows that
    have all three alike share what is taken of them: none comes more than once oftener than another."""
    queue = fair_queue(documents, id_column=id_column, text_column=text_column, source_column=source_column, repeats=repeats, **options)
    site = lambda c: F.xxhash64(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")))
    alike = queue.groupBy(F.xxhash64("doc_id").alias("t_id"), F.col("text_hash").alias("t_text"), site(F.col("source")).alias("t_site"))
    taken = alike.agg((F.count(F.lit(1)) / repeats).cast("long").alias("rows"), F.count_if("taken").alias("times")).filter("times > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    keyed = documents.select(row.alias("_row"), F.xxhash64(id_column).alias("_id"), F.xxhash64(text_column).alias("_text"), site(F.col(source_column)).alias("_site"), F.xxhash64(row).alias("_order"))
    met = keyed.join(taken, (F.col("_id") == F.col("t_id")) & (F.col("_text") == F.col("t_text")) & (F.col("_site") == F.col("t_site")))
    nth = F.row_number().over(Window.partitionBy("_id", "_text", "_site").orderBy("_order"))
    each = F.floor(F.col("times") / F.col("rows")) + F.when(nth <= F.col("times") % F.col("rows"), 1).otherwise(0)
    return met.withColumn("_each", each).filter("_each > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_each")))).select("_row.*")


MIX_SQL = r"""
with d as (
  select doc_id, source, md5('mix:' || coalesce(cast(doc_id as varchar), '')) as key,
         cast(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) as bigint) as size
  from documents),
per as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [3, 1, 2][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as w, 2 * source_size as cap from per),
r as (select *, cast(cap as double) / w as ratio, cast((select sum(source_size) from w) as double) * 1.5 as budget, cast((select sum(w) from w) as bigint) as all_w from w),
l as (
  select *, (budget - coalesce(sum(cap) over p, 0)) / (all_w - coalesce(sum(w) over p, 0)) as level
  from r window p as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, budget, least(cast(cap as double), coalesce(w * (select arg_min(level, ratio) from l where ratio > level), cap)) as target from l),
q as (select d.*, t.source_size, t.target, t.budget, cast(sum(d.size) over (partition by d.source order by key, doc_id rows unbounded preceding) as bigint) as upto
      from d join t on d.source is not distinct from t.source),
c as (select *, case when target > 0 then (pass * source_size + upto) / target else 0.0 end as finish from q, (values (0), (1)) p(pass)),
o as (select *, sum(size) over (order by finish, key, doc_id, size, pass rows unbounded preceding) as total from c)
select doc_id, size, source_size, target, cast(sum(case when total <= budget then size else 0 end) as bigint) as taken
from o group by doc_id, size, source_size, target
"""
