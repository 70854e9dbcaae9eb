"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is put in a shuffled order (by an MD5 of its id and text). Its virtual finish time is the source's
running token count, repeats included, divided by the source's target. All sources' documents merge in the order of
these times, by a range sort, and the merged queue is cut at the total budget, which is the sum of the targets: no source
is served beyond its target, so at virtual time 1 each lacks less than its next document. The largest document that still
fits closes this gap, so that each source comes near its target and the sum never exceeds the budget.

A source's running count is a prefix sum in two levels (within a bucket of the shuffled order, and over the buckets'
sums), so one source may hold any share of the rows; places in the merged queue are summed up likewise over its ranges.

Defined cases. Null text: size 0, never taken. Null source: a source of its own, after all others. Repeated rows: each is
a document. Null ids: shuffled by their texts. Ties in the order: by id, then size. An empty table or no words: nothing is
taken. Very long texts: one document, taken whole or not at all. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import n_words, saved, table

#: Documents of a bucket of a source's order, about.
BUCKET = 1000
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
META = ("_src", "_key", "_id", "_size")


def _described(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """docs with the columns that place a document in its source's queue."""
    text = F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.lit(""))
    out = {
        "_src": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")),  # a null source sorts last
        "_key": F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary")),
        "_id": F.col(id_col),
        "_size": n_words(text_col),
    }
    return docs.select("*", *(c.alias(n) for n, c in out.items()))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: _src, source_size. Adds target: shares of the total by weight, none above max_epochs times its source."""
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("_src")) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", "_src").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * max_epochs
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    return (
        sizes.withColumn("_w", w.cast("long"))
        .withColumn("_ratio", cap.cast("double") / F.col("_w"))
        .withColumn("_level", level)
        .withColumn("target", F.least(cap.cast("double"), F.max("_level").over(every) * F.col("_w")))
        .select("_src", "source_size", "target")
    )


def _queued(described: DataFrame, offsets: DataFrame, digits: int) -> DataFrame:
    """Adds _end, a document's place in its source's queue (tokens up to its end), and what offsets has of the source."""
    inside = Window.partitionBy("_src", "_bucket").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    described = described.withColumn("_bucket", F.substring("_key", 1, digits))
    return described.withColumn("_end", F.sum("_size").over(inside)).join(offsets, ["_src", "_bucket"]).withColumn("_end", F.col("_end") + F.col("_before"))


def _finish(epoch) -> F.Column:
    return (F.col("_end") + epoch * F.col("source_size")).cast("double") / F.col("target")


class Plan:
    """Offsets of every source's buckets, and the document that fits each source's gap."""

    def __init__(self, meta: DataFrame, weights: tuple[int, ...], max_epochs: int):
        self.max_epochs, self.digits = max_epochs, 1
        while BUCKET << 4 * self.digits < meta.count():
            self.digits += 1
        per = saved(meta.groupBy("_src", F.substring("_key", 1, self.digits).alias("_bucket")).agg(F.sum("_size").alias("_n")), "mix-buckets")
        sources = targets(per.groupBy("_src").agg(F.sum("_n").alias("source_size")), weights, max_epochs)
        before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = saved(per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").join(sources, "_src"), "mix-offsets")
        self.budget = per.agg(F.sum("_n")).first()[0] or 0
        queued = saved(_queued(meta, offsets, self.digits).where("_size > 0 and target > 0").select("_src", "_size", "_end", "source_size", "target"), "mix-queue")
        copies = self.copies()
        gaps = queued.groupBy("_src").agg((F.first("target") - F.coalesce(F.max(F.when(copies > 0, F.col("_end") + (copies - 1) * F.col("source_size"))), F.lit(0))).alias("_gap"))
        spare = queued.where(copies < max_epochs).groupBy("_src", "_size").agg(F.min("_end").alias("_end"))
        best = spare.join(gaps, "_src").where("_size <= _gap").groupBy("_src").agg(F.max(F.struct(F.col("_size"), (-F.col("_end")).alias("_back"))).getField("_back").alias("_extra"))
        self.offsets = saved(offsets.join(best.withColumn("_extra", -F.col("_extra")), "_src", "left"), "mix-plan")

    def copies(self) -> F.Column:
        """How many times a source's queue, cut at its target (virtual time 1), holds a document."""
        taken = [F.when(F.col("_end") + e * F.col("source_size") <= F.col("target"), 1).otherwise(0) for e in range(self.max_epochs)]
        return F.when((F.col("_size") > 0) & (F.col("target") > 0), sum(taken[1:], taken[0])).otherwise(0)

    def apply(self, described: DataFrame) -> DataFrame:
        """described with _copies, source_size and target."""
        extra = F.when((F.col("_size") > 0) & (F.col("_end") == F.col("_extra")), 1).otherwise(0)
        return _queued(described, self.offsets, self.digits).withColumn("_copies", self.copies() + extra)

    def merged(self, applied: DataFrame) -> DataFrame:
        """The merged queue of what apply() gives, cut at the budget: _src, _end, _size, _epoch, _upto (tokens up to a copy's end)."""
        order = ["_at", "_src", "_end", "_epoch"]
        each = applied.where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        each = each.select("_src", "_end", "_size", "_epoch", _finish(F.col("_epoch")).alias("_at"))
        ranged = saved(each.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-merged")
        sums = ranged.groupBy("_range").agg(F.sum("_size").alias("_n"))  # one row for each task of the sort
        sums = sums.withColumn("_done", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
        inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return ranged.withColumn("_upto", F.sum("_size").over(inside)).join(sums, "_range").withColumn("_upto", F.col("_upto") + F.col("_done")).where(F.col("_upto") <= self.budget)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, ordered: bool = True) -> DataFrame:
    """The mixed documents, a row for each copy that the mix takes, with the columns of docs. ordered: in the order of
    virtual finish times, from partition to partition; otherwise in any order."""
    names, plain = docs.columns, docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    described = _described(plain, at[id_col], at[source_col], at[text_col])
    plan = Plan(saved(described.select(*META), "mix-meta"), weights, max_epochs)
    taken = plan.apply(described).where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    if ordered:
        taken = taken.withColumn("_at", _finish(F.col("_epoch"))).repartitionByRange("_at", "_src", "_end").sortWithinPartitions("_at", "_src", "_end")
    return taken.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row for each document: id, size, source_size, target (of its source), taken (words that the mix takes of it), place
    (words of the mix before its first copy; null if it isn't taken)."""
    meta = saved(_described(docs.select(id_col, source_col, text_col), id_col, source_col, text_col).select(*META), "mix-meta")
    plan = Plan(meta, weights, max_epochs)
    done = saved(plan.apply(meta), "mix-applied")
    copies = plan.merged(done).groupBy("_src", "_end").agg(F.sum("_size").alias("taken"), F.min(F.col("_upto") - F.col("_size")).alias("place"))
    done = done.withColumn("_end", F.when(F.col("_copies") > 0, F.col("_end")).otherwise(-1 - F.abs(F.hash("_key").cast("long")))).join(copies, ["_src", "_end"], "left")
    return done.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("place").cast("long").alias("place"))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (
  select doc_id, coalesce('s' || source, 't') as src, md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(md5(text), '')) as k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size
  from documents),
s as (select src, cast(sum(size) as bigint) as source_size from d group by src),
w as (select *, 1 + (row_number() over (order by src) - 1) % 3 as w from s),
-- Filling by weight: the level at which the sources that aren't full share what the full ones leave.
l as (
  select *, cast(sum(source_size) over () - coalesce(sum(3 * source_size) over b, 0) as double) / cast(sum(w) over () - coalesce(sum(w) over b, 0) as double) as lvl
  from w window b as (order by cast(3 * source_size as double) / w, src rows between unbounded preceding and 1 preceding)),
t as (select src, source_size, least(cast(3 * source_size as double), max(lvl) over () * w) as target from l),
q as (
  select d.*, source_size, target, cast(sum(size) over (partition by d.src order by k, doc_id, size rows unbounded preceding) as bigint) as fin
  from d join t on d.src = t.src),
-- Every source goes round its queue up to three times; what ends by its target is served.
e as (select q.*, e, fin + e * source_size as fin_e from q, (values (0), (1), (2)) as x(e) where size > 0 and target > 0),
gap as (select src, any_value(target) - coalesce(max(fin_e) filter (fin_e <= target), 0) as gap from e group by src),
nxt as (
  select src, fin, min(e) as e from e where fin_e > target group by src, fin),
one as (
  select e.src, e.fin, e.e from e join nxt using (src, fin, e) join gap using (src) where size <= gap
  qualify row_number() over (partition by e.src order by size desc, e.fin) = 1),
served as (
  select src, fin, e, size, cast(fin_e as double) / target as vft from e where fin_e <= target
  union all
  select src, fin, e, size, cast(fin_e as double) / target from e join one using (src, fin, e)),
upto as (select *, sum(size) over (order by vft, src, fin, e rows unbounded preceding) as upto from served),
taken as (
  select src, fin, cast(sum(size) as bigint) as taken, cast(min(upto - size) as bigint) as place
  from upto where upto <= (select sum(size) from d) group by src, fin)
select q.doc_id, cast(q.size as bigint) as size, q.source_size, q.target, coalesce(case when q.size > 0 then taken end, 0) as taken, case when q.size > 0 then place end as place
from q left join taken on q.src = taken.src and q.fin = taken.fin
"""
