"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target of words: all sources together share `share` times the words
there are, by weight, and none gets more than `cap` times its own words; what a cap cuts
off is shared again by weight among the rest. The level at which that settles has a
closed form over the sources sorted by cap / weight, so it needs no iteration.

Within a source longer documents, which hold more connected text, are drawn with better
odds. Documents of b + 1 binary digits of words form a class of pull 2**(b/4), and the class
is to be taken m = min(cap, c * pull) times on average, c being such that the source's words
times m add up to its target: the same sharing, once more. Then

1. each document is allocated floor(m) whole copies for certain;
2. what is left of m is its inclusion probability p, which differs between classes. The
   source's remaining words are the size of an order sample: each document has a fixed random
   number U from its id and text, documents rank by Pareto's ratio
   (U / (1-U)) / (p / (1-p)), random odds over inclusion odds, and the lowest are taken until
   their words reach that size. A sample is of fixed size in words, as the targets are.

No source is ever sorted. Words are added up by (source, bucket of ratio / (1 + ratio)), a
partial aggregation; running sums over runs of buckets, and then over the buckets of one run (at
most the root of `buckets` rows a source), tell the bucket in which the sample ends. Only that bucket's documents are ordered. As the words to take are the
sum of p times words, the sample ends near a ratio of 1, where a bucket holds about
4 p (1 - p) / `buckets` of a class: never more than an even share. Every document is then
judged by itself against its source's last ratio, so texts do not move.

Defined cases: a null text has no words; a document without words counts as one of the
first class, takes no words and may have copies; a null source is one source, last in order;
a null doc_id takes part as the word "null"; rows equal in id and text have one ratio and are
taken or left together, by which comes nearer; a source without words has no copies; an empty
table gives an empty result; very long texts are counted by a scan that keeps no list of
words; other columns pass through mix() whatever their names.
The window over the source table itself holds one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)
SHARE, CAP, BUCKETS = 1.5, 2, 4096
#: Bits of the random key: exact in a double.
BITS = 48


def count_words(text: Column) -> Column:
    """Words of a text, without an array of them: each becomes one character W, then the Ws are counted."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "W")
    return (F.length(marked) - F.length(F.replace(marked, F.lit("W"), F.lit("")))).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    """The top 48 bits of md5 of id and text: uniform, and the same in any engine."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, BITS // 4), 16, 10).cast("long")


def _weight(rank0: Column, weights) -> Column:
    out = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        out = F.when(rank0 % len(weights) == i, w).otherwise(out)
    return out.cast("long")


def _shared(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Each group's `total` shared among its rows by w, none above its `limit`: adds got.

    order sorts by limit / w. The level, were all rows before this one at their limit and none
    from it on, rises up to the true one and falls after it; so the true level is the largest
    that leaves its own row below the limit.
    """
    everything = Window.partitionBy(*by)
    ordered = everything.orderBy(*order)
    before, on = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    level = F.try_divide(F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)), F.sum("w").over(on))
    x = df.withColumn("level", level)
    x = x.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))).over(everything))
    most = F.col("level").isNull() | (F.col("level") * F.col("w") > F.col("limit"))
    return x.withColumn("got", F.when(most, F.col("limit").cast("double")).otherwise(F.col("level") * F.col("w")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes: one row per source (src, src_null, source_size). Adds target."""
    named = sizes.withColumn("w", _weight(F.row_number().over(Window.orderBy("src_null", "src")) - 1, weights)).withColumn("limit", (F.col("source_size") * cap).cast("long"))
    named = named.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    return _shared(named, [], [F.col("limit") / F.col("w"), "src_null", "src"]).select("src", "src_null", "source_size", F.col("got").alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    """src, src_null, size, key and class of each row, which is kept whole as `row`."""
    size = count_words(F.col("text"))
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("src"), F.col("source").isNull().alias("src_null"), size.alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("key"))
    return x.withColumn("cls", F.length(F.bin(F.greatest("size", F.lit(1)))) - 1)


def _ratio() -> Column:
    """Pareto's ratio; null for documents that are not drawn."""
    u = (F.col("key") + 0.5) / F.lit(float(2**BITS))
    return F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))


def _bucket(buckets: int) -> Column:
    return F.least(F.floor(F.col("pareto") / (1 + F.col("pareto")) * buckets), F.lit(buckets - 1)).cast("int")


def _isqrt(n: int) -> int:
    return max(1, int(n**0.5))


def _reached(parts: DataFrame, by: list[str], name: str) -> DataFrame:
    """parts: by, name (in order), words, before (of all parts), rest. Per source the last part that
    begins before the rest is full: name, before (of that part), rest."""
    earlier = Window.partitionBy(*by).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    x = parts.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0))).where("before <= rest")
    return x.groupBy(*by).agg(F.max(name).alias(name), F.max("before").alias("before"), F.first("rest").alias("rest"))


def _deal(b: DataFrame, weights, share: float, cap: int, buckets: int) -> DataFrame:
    """b: id, src, src_null, size, key, cls. One row per source and class: whole, p, and where
    the sample ends: bucket `edge`, and in it the tuple `last`."""
    by = ["src", "src_null"]
    sums = materialize(b.groupBy(*by, "cls").agg(F.sum("size").alias("words")), "mix-classes")
    source = targets(sums.groupBy(*by).agg(F.sum("words").alias("source_size")), weights, share, cap)
    pull = F.sqrt(F.sqrt(F.pow(F.lit(2.0), F.col("cls").cast("double"))))
    classes = sums.join(source, by).withColumn("w", pull * F.col("words")).withColumn("limit", F.col("words") * cap).withColumn("total", F.col("target"))
    # by limit / w, which falls with the class
    classes = _shared(classes, by, [F.desc("cls")])
    often = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= F.col("source_size") * cap, float(cap))
    often = often.otherwise(F.when(F.col("level").isNull() | (F.col("level") * pull > cap), float(cap)).otherwise(F.col("level") * pull))
    classes = classes.withColumn("often", often).withColumn("whole", F.floor("often")).withColumn("p", F.col("often") - F.col("whole"))
    classes = materialize(classes.select(*by, "cls", "words", "source_size", "target", "whole", "p"), "mix-odds")
    rest = classes.groupBy(*by).agg(F.sum(F.col("p") * F.col("words")).alias("rest"))
    drawn = b.join(classes.select(*by, "cls", "p"), [*by, "cls"]).withColumn("pareto", _ratio()).where("pareto is not null").withColumn("bucket", _bucket(buckets))
    filled = materialize(drawn.groupBy(*by, "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    # where a source's words reach the rest: among runs of buckets, then within one run
    run = F.floor(F.col("bucket") / F.lit(_isqrt(buckets)))
    found = rest.withColumn("before", F.lit(0).cast("long"))
    edge = _reached(filled.withColumn("run", run).groupBy(*by, "run").agg(F.sum("words").alias("words")).join(found, by), by, "run")
    edge = _reached(filled.withColumn("run", run).join(edge, [*by, "run"]), by, "bucket").withColumnRenamed("bucket", "edge")
    edge = materialize(edge, "mix-edges")
    at = drawn.join(edge, by).where("bucket = edge").groupBy(*by, "pareto", "size", "id").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inside = Window.partitionBy(*by).orderBy("pareto", "size", F.asc_nulls_first("id")).rowsBetween(Window.unboundedPreceding, -1)
    # the document across the edge is taken if that leaves the smaller error
    taken = at.withColumn("prefix", F.col("before") + F.coalesce(F.sum("words").over(inside), F.lit(0))).where(F.col("prefix") + F.col("words") / 2 <= F.col("rest"))
    last = taken.groupBy(*by).agg(F.max(F.struct("pareto", "size", "id")).alias("last"))
    return materialize(classes.drop("words").join(edge.select(*by, "edge"), by, "left").join(last, by, "left"), "mix-deal")


def _judged(x: DataFrame, deal: DataFrame, buckets: int) -> DataFrame:
    """Adds to each row whole, p, pareto, source_size, target and copies."""
    x = x.join(deal, ["src", "src_null", "cls"]).withColumn("pareto", _ratio()).withColumn("bucket", _bucket(buckets))
    drawn = (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.struct("pareto", "size", "id") <= F.col("last")))
    return x.withColumn("copies", F.col("whole") + F.coalesce(drawn, F.lit(False)).cast("long"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, whole, p, pareto."""
    b = materialize(_sized(docs).drop("row"), "mix-sizes")
    out = _judged(b, _deal(b, weights, share, cap, buckets), buckets)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "whole", "p", "pareto")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, buckets: int = BUCKETS) -> DataFrame:
    """The mixed rows themselves: every column of docs, each row as often as it is taken."""
    x = _sized(docs)
    each = _judged(x, _deal(materialize(x.drop("row"), "mix-sizes"), weights, share, cap, buckets), buckets).where("copies > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
with b as (
  select doc_id, coalesce(source, '') as src, source is null as src_null,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::bigint as key
  from documents),
d as (select *, (key + 0.5::double) / 281474976710656::double as u, length(bin(greatest(size, 1))) - 1 as cls from b),
s as (select src, src_null, sum(size)::bigint as source_size from b group by all),
w as (
  select *, source_size * 2 as capped,
         case (row_number() over (order by src_null, src) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w
  from s),
l as (
  select *, ((sum(source_size) over ())::double * 1.5 - coalesce(sum(capped) over o, 0)::double)
            / ((sum(w) over ()) - coalesce(sum(w) over o, 0))::double as level
  from w window o as (order by capped / w, src_null, src rows between unbounded preceding and 1 preceding)),
m as (select *, max(case when level * w <= capped then level end) over () as lv from l),
t as (
  select src, src_null, source_size,
         case when lv is null or lv * w > capped then capped::double else lv * w end as target
  from m),
c as (
  select d.src, d.src_null, cls, sqrt(sqrt((1::bigint << cls)::double)) as pull, sum(size)::double as words,
         any_value(source_size) as source_size, any_value(target) as target
  from d join t on d.src = t.src and d.src_null = t.src_null group by 1, 2, 3, 4),
cl as (
  select *, (target - coalesce(sum(words * 2) over (partition by src, src_null order by cls desc rows between unbounded preceding and 1 preceding), 0))
            / nullif(sum(pull * words) over (partition by src, src_null order by cls desc rows between current row and unbounded following), 0) as level
  from c),
cm as (select *, max(case when level * (pull * words) <= words * 2 then level end) over (partition by src, src_null) as lv from cl),
co as (
  select *, case when source_size = 0 then 0.0 when target >= source_size * 2 then 2.0
                 when lv is null or lv * pull > 2 then 2.0 else lv * pull end as often from cm),
cr as (
  select *, floor(often) as whole, often - floor(often) as p,
         sum((often - floor(often)) * words) over (partition by src, src_null) as rest from co),
r as (
  select d.doc_id, d.src, d.src_null, d.size, source_size, target, whole::bigint as whole, rest,
         case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as pareto
  from d join cr on d.src = cr.src and d.src_null = cr.src_null and d.cls = cr.cls),
x as (
  select *, sum(size) over (partition by src, src_null, pareto, doc_id) as words,
         coalesce(sum(size) over (partition by src, src_null order by pareto, size, doc_id nulls first
                                  range between unbounded preceding and current row exclude group), 0) as prefix
  from r where pareto is not null)
select doc_id, size, source_size, target, (size * (whole + case when prefix + words / 2 <= rest then 1 else 0 end))::bigint as taken from x
union all
select doc_id, size, source_size, target, size * whole from r where pareto is null
"""
