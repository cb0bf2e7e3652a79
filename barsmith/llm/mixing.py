"""Mixing sources to target weights by Pareto order sampling.

Each source has a weight. All sources together are to give ``share`` times all words; a source's target
is its weighted part, but at most ``limit`` times its own size, and what it cannot take is shared again
by weight among the others. A document first gets the whole copies that its source's rate allows for
certain; the rest of the target is a fixed-size sample without replacement. Documents are ranked by

    Q = (u / (1 - u)) / (p / (1 - p))

with ``u`` a uniform number made from the document's id and text (and seat, see below) and ``p`` its inclusion probability, the
fraction of the rate (times a document weight, if there is one); the smallest Q are taken until the
source's target is met to within one document.

The cut through the ranking is found without sorting a source in one task: words are summed in bins of
Q/(1+Q), the bin where the running sum meets the target is found from the small table of bins, and only
that bin's rows are cut finer in the same way before the last few are ranked.

Only DataFrame functions. Nulls: a null text has size 0 and is taken 0 times; a null source is a source
of its own, which comes last; a null id is hashed as the empty string. Rows that repeat (one id, text and
source) are told apart by seats, counted from 0 within the parts that the table is read in and then over
parts, so no task holds all of them: each has a u of its own, and which of them is taken makes no
difference. So rows of one id, or without one, are spread over the ranks like all others, and no bin is larger for them.
Very long texts are read whole. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import WORD, table, written

#: Bins of one level of the search. Two levels leave about a 2**-24th of a source for the last ranking.
BINS = 4096
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of an MD5."""
    digits = F.substring(F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def row_key(id_col: str, text: str, source: str) -> Column:
    """A hash of id, text and source, the same for rows that repeat."""
    parts = [p for c in (id_col, text, source) for p in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*parts)


def seated(rows: DataFrame) -> DataFrame:
    """Adds ``seat`` to rows with a ``rk``: 0, 1, ... among rows of one key, without bringing them together.

    Rows of a key are numbered in each part of the table as it is read, and the parts' counts are summed up.
    """
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    each = rows.groupBy("rk", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("rk").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    repeated = rows.groupBy("rk").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("rk")
    repeated = written(repeated, "mix-repeated")  # read again, its size is known to the joins
    offsets = each.join(repeated, "rk", "left_semi").select("rk", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part", "rk").orderBy("_at")) - 1
    many = rows.join(repeated, "rk", "left_semi").withColumn("_local", local).join(offsets, ["rk", "_part"])
    many = many.withColumn("seat", (F.col("_local") + F.col("_before")).cast("bigint")).drop("_local", "_before")
    one = rows.join(repeated, "rk", "left_anti").withColumn("seat", F.lit(0).cast("bigint"))
    return one.unionByName(many).drop("_part", "_at")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, size) rows -> one row a source: source, source_size, target.

    Water-filling in closed form: in order of limit/weight, sources are full up to some point, and the
    rest share what is left by weight. There is one row a source, so the windows are small as long as sources are
    collections; a ``source`` of very many values (one a host) should be grouped first.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).cast("int"))
    each = each.withColumn("w", weight).withColumn("cap", limit * F.col("source_size"))
    need = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = need.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    w_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    each = each.withColumn("level", left / w_left).withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return each.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def pareto(u: Column, p: Column) -> Column:
    """Q/(1+Q) of the Pareto rank, which orders as Q does and lies between 0 and 1."""
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def _bins(q: Column) -> tuple[Column, Column]:
    """The coarse bin of a rank in 0..1, and the fine bin within it."""
    inside = lambda x: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(x).cast("int")))
    coarse = inside(q * BINS)
    return coarse, inside((q * BINS - coarse) * BINS)


def _cut(rows: DataFrame, bin_col: str, want: str) -> DataFrame:
    """key -> the bin in which the running sum of words first reaches ``want``, and the sum before that bin."""
    sums = rows.groupBy("key", bin_col).agg(F.sum("size").alias("words"), F.first(want).alias("want"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy(bin_col)))
    return sums.where("upto >= want").groupBy("key").agg(F.min(bin_col).alias(f"{bin_col}_cut"), F.min(F.col("upto")).alias("upto"), F.min_by("words", bin_col).alias("words")).select("key", f"{bin_col}_cut", (F.col("upto") - F.col("words")).alias(f"{bin_col}_before"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, limit: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, h, rk, seat, source, size, source_size, target, copies, taken): taken is copies * size, h the XXH64 of the text.

    One row for each row of ``docs``, copies 0 where the mix leaves it out; ``rk`` and ``seat`` tell rows apart.
    """
    digest = F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("h"), digest.alias("digest"), row_key(id_col, text, source).alias("rk"))
    sized = written(seated(written(sized, "mix-sizes")), "mix-seats")
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    goal = targets(sized, weights, share, limit).withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("bigint")).withColumn("p", F.col("rate") - F.col("whole"))
    goal = written(goal.select(key.alias("key"), "source_size", "target", "whole", "p", (F.col("target") - F.col("whole") * F.col("source_size")).alias("want")), "mix-targets")
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "digest", F.when(F.col("seat") == 0, "").otherwise(F.concat(F.lit("#"), F.col("seat").cast("string"))))
    q = pareto(uniform(name, seed), F.col("p"))
    rows = sized.withColumn("key", key).join(goal, "key").withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), q))
    coarse, fine = _bins(F.col("q"))
    rows = rows.withColumn("b1", coarse).withColumn("b2", fine)
    drawn = rows.where("q is not null")
    cut1 = written(_cut(drawn, "b1", "want"), "mix-cut")
    edge = drawn.join(cut1, "key").where("b1 = b1_cut").withColumn("want", F.col("want") - F.col("b1_before"))
    edge = written(edge.select("key", "doc_id", "h", "seat", "size", "q", "b2", "want"), "mix-edge")
    cut2 = _cut(edge, "b2", "want")
    order = Window.partitionBy("key").orderBy("q", "doc_id", "h", "seat").rowsBetween(Window.unboundedPreceding, 0)
    last = edge.join(cut2, "key").where("b2 = b2_cut").withColumn("upto", F.col("b2_before") + F.sum("size").over(order))
    # the document at the cut is in if that brings the sum nearer to what is wanted
    last = last.where(F.abs(F.col("upto") - F.col("want")) <= F.abs(F.col("upto") - F.col("size") - F.col("want")))
    last = last.groupBy("key").agg(F.max(F.struct("q", "doc_id", "h", "seat")).alias("at"))
    bound = written(cut1.select("key", "b1_cut").join(cut2.select("key", "b2_cut"), "key", "left").join(last, "key", "left"), "mix-bound")
    rows = rows.join(bound, "key", "left")
    here = F.struct("q", "doc_id", "h", "seat") <= F.col("at")
    within = (F.col("b2") < F.col("b2_cut")) | ((F.col("b2") == F.col("b2_cut")) & here)
    taken = (F.col("b1") < F.col("b1_cut")) | ((F.col("b1") == F.col("b1_cut")) & within)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("q").isNotNull() & F.coalesce(taken, F.lit(False)), 1).otherwise(0)).otherwise(0).cast("bigint")
    return rows.select("doc_id", "h", "rk", "seat", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def taken_rows(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """(row): every column of ``docs`` in a struct, each row as often as the mix takes it.

    ``docs`` is read several times and must come in the same parts each time: a table, or a plan that deals rows out by their
    columns. Of rows that repeat id, text and source, any may be the ones that are taken.
    """
    plan = mix(docs, id_col=id_col, text=text, source=source, **options).where("copies > 0").select("rk", "seat", "copies")
    rows = seated(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key(id_col, text, source).alias("rk")))
    return rows.join(plan, ["rk", "seat"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row")


def op8_mixing(spark, sf_dir):
    """All ``documents`` mixed with weights 3, 1, 2, ... to one and a half times their words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The same by one sort of each source.
ORACLE = r"""
with d as (
  select doc_id, source, row_number() over (partition by doc_id, source, text) - 1 as seat, cast(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as bigint) as size,
         md5(text) as h from documents),
d1 as (select *, (cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(h, md5('')) || case when seat > 0 then '#' || seat else '' end), 1, 13) as bigint) + 0.5::double) / 4503599627370496::double as u from d),
s0 as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as k from d group by source),
s1 as (select source, source_size, case (k - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, 2.0::double * source_size as cap from s0),
s2 as (select *, cap / w as need, sum(source_size) over () as total, sum(w) over () as w_all,
         coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_before,
         coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as w_before from s1),
s3 as (select *, (1.5::double * total - cap_before) / (w_all - w_before) as level from s2),
s4 as (select *, cap <= w * level as is_full, (select min_by(level, need) from s3 where cap > w * level) as open_level from s3),
s as (select source, source_size, case when is_full then cap else w * open_level end as target from s4),
r as (select d1.*, s.source_size, s.target, coalesce(s.target / nullif(cast(s.source_size as double), 0), 0) as rate from d1 join s on d1.source is not distinct from s.source),
p as (select *, floor(rate) as whole, rate - floor(rate) as p from r),
q as (select *, case when p > 0 and size > 0 then (u / (1 - u)) / (p / (1 - p)) end as q0 from p),
c as (select *, case when q0 is not null then q0 / (1 + q0) end as q from q),
o as (select *, case when q is not null then sum(size) over (partition by source, q is null order by q, doc_id, h, seat rows unbounded preceding) end as upto from c),
t as (select *, target - whole * source_size as want from o),
e as (select doc_id, size, source_size, target, cast(whole as bigint) + case when q is not null and (upto < want or (upto - size < want and abs(upto - want) <= abs(upto - size - want))) then 1 else 0 end as n from t)
select doc_id, size, source_size, target, case when size > 0 then n * size else 0 end as taken, case when size > 0 then n else 0 end as copies from e
"""
