"""Operator 10: mixing sources to target weights by systematic sampling. DataFrame functions only.

Every document of a source is expected `rate` times. Documents of a source are put in one order; the prefix sum
of expected copies is rank * rate, taken as a product so that it is the same in every run; one random offset
(from the seed and the source) is added, and a document comes out once for each integer that its step crosses.
The order is (size, md5 of seed and id, id), at every number of rows. As sizes never fall along it, what a sweep
takes is off its expectation by the largest size at most. Documents of more than one part in LARGE_PART of their
source's target are swept first and by themselves, at the rate target / source size; the rate of all others is
what is then left of the target over what is left of the source. So a source's taken words are within one part
in LARGE_PART of its target, unless its large documents alone take more, or the others have to come more often
than `max_epochs` times.

Scale: ranks come from counts of slices, which are ranges of that order (see common.ranked); no task sorts a
whole source. Offsets are summed by size class, then over the classes of a source; only one row per source is
ever sorted in one task. Large documents are so few for each source that their sweep is a side table.

Defined cases: null text counts 0 words; null sources are one source, last in order; repeated rows are
documents of their own; an empty table gives no rows; a source without words takes nothing; other columns,
whatever their names, are carried by `mixed` and ignored by `plan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, SLICE_ROWS, Scratch, ranked, table

SHARE = 1.5
WEIGHTS = (3, 1, 2)
MAX_EPOCHS = 2
SEED = "mix-1"
#: Documents above this part of their source's target are swept apart.
LARGE_PART = 200
#: Rows that one slice of the order holds when rows carry their texts.
WHOLE_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source):
    """Nulls have a key of their own, so joins and windows see them."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (mix_key, source, source_size), a row per source: adds target, by water-filling.

    Sources fill in the order of cap / weight: a source is at its cap if the level that the rest would get
    without capping it is above that. Caps come in as exact integers, so one division decides the level.
    """
    one = Window.partitionBy()
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(one))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ahead, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(ahead), F.lit(0))) / F.sum("weight").over(rest))
    # the first source that isn't above its cap sets the level of all after it
    s = s.withColumn("is_free", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("level", F.first(F.when(F.col("is_free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("mix_key", "source_size", target.alias("target"))


def _planned(docs: DataFrame, slim: DataFrame, scratch: Scratch, seed: str, share: float, weights, max_epochs: int, slice_rows: int) -> DataFrame:
    sizes = slim.groupBy("mix_key").agg(F.max("mix_source").alias("source"), F.sum("mix_size").alias("source_size"))
    aims = scratch.cut(targets(sizes, share, weights, max_epochs))
    few = aims.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # size classes: steps of an eighth of a doubling, so that each stretch of the order has like sizes
    classes = F.floor(F.log2(F.col("mix_size") + 1) * 8).cast("int")
    mark = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("mix_id").cast("string"), F.lit(""))))
    order = [F.col("mix_size"), F.col("mix_mark"), F.col("mix_id")]
    spread = F.conv(F.substring("mix_mark", 1, 8), 16, 10).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("mix_key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    at = F.col("mix_at").cast("double")
    copies = lambda rate: F.least(F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset), F.lit(max_epochs)).cast("long")

    def aimed(rows: DataFrame, with_: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(with_) if few else with_, "mix_key").withColumns({"mix_class": classes, "mix_mark": mark})
        return rows.withColumn("mix_large", F.col("mix_size") * LARGE_PART > F.col("target"))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    large = scratch.cut(aimed(slim, aims).where("mix_large"))
    large = ranked(large, ["mix_key"], order, name="mix_at", lead=["mix_size"], spread=spread)
    taken = large.groupBy("mix_key").agg(F.sum(F.col("mix_size") * copies(rate)).alias("taken"), F.sum("mix_size").alias("sized"))
    rates = aims.join(taken, "mix_key", "left").fillna(0, ["taken", "sized"])
    left = F.col("source_size") - F.col("sized")
    small = F.when(left > 0, F.least(F.greatest((F.col("target") - F.col("taken")) / left, F.lit(0.0)), F.lit(float(max_epochs)))).otherwise(F.lit(0.0))
    rates = scratch.cut(rates.select("mix_key", "source_size", "target", rate.alias("large_rate"), small.alias("small_rate")))

    docs, slim = aimed(docs, rates), aimed(slim, rates)
    cells = ["mix_key", "mix_large", "mix_class"]
    out = ranked(docs, cells, order, counts_from=slim, name="mix_in", slice_rows=slice_rows, lead=["mix_size"], spread=spread)
    firsts = slim.groupBy(*cells).agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_key", "mix_large").orderBy("mix_class").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(*cells, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_first"))
    firsts = F.broadcast(firsts) if firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else firsts
    out = out.join(firsts, cells).withColumn("mix_at", F.col("mix_first") + F.col("mix_in"))
    return out.withColumn("mix_copies", copies(F.when(F.col("mix_large"), F.col("large_rate")).otherwise(F.col("small_rate"))))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source"), _key(F.col(source_col)).alias("mix_key"), words(F.col(text_col)).alias("mix_size"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, share: float = SHARE, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row per document: id, size, source_size, target (its source's) and copies."""
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.cut(_slim(docs, id_col, text_col, source_col))
    out = _planned(slim, slim, scratch, seed, share, weights, max_epochs, SLICE_ROWS)
    return out.select(F.col("mix_id").alias(id_col), F.col("mix_size").alias("size"), "source_size", "target", F.col("mix_copies").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, share: float = SHARE, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: the rows of `docs`, all columns, each as often as it is taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.cut(_slim(docs, id_col, text_col, source_col))
    rows = docs.select(F.struct("*").alias("mix_row"), F.col(id_col).alias("mix_id"), _key(F.col(source_col)).alias("mix_key"), words(F.col(text_col)).alias("mix_size"))
    out = _planned(rows, slim, scratch, seed, share, weights, max_epochs, WHOLE_ROWS).where("mix_copies > 0")
    return out.select("mix_row", F.explode(F.expr("sequence(1L, mix_copies)")).alias("copy")).select("mix_row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
with docs as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from docs group by source),
s1 as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, 2 * source_size as cap,
  1.5::double * (sum(source_size) over ())::double as total from s0),
s2 as (select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
  / (sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following))::double as level from s1),
s3 as (select *, first_value(case when level * weight <= cap then level end ignore nulls) over (order by cap / weight, source nulls last rows between unbounded preceding and current row) as free from s2),
s4 as (select source, source_size, case when free is null then cap::double else least(free * weight, cap::double) end as target from s3),
d as (select d.doc_id, d.size, d.source, t.source_size, t.target, d.size * 200 > t.target as large, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
  (('0x' || substr(md5('mix-1' || case when d.source is null then 'n' else 's' || d.source end), 1, 8))::bigint)::double / 4294967296.0::double as u
  from docs d join s4 t on d.source is not distinct from t.source),
p as (select *, (row_number() over (partition by source, large order by size, md5('mix-1' || coalesce(doc_id::varchar, '')), doc_id) - 1)::double as pos from d),
l as (select source, sum(size * least(2, floor((pos + 1) * rate + u) - floor(pos * rate + u)))::bigint as taken, sum(size)::bigint as sized from p where large group by source),
r as (select p.*, case when large then rate when p.source_size > coalesce(l.sized, 0) then least(greatest((p.target - coalesce(l.taken, 0)) / (p.source_size - coalesce(l.sized, 0)), 0.0), 2.0) else 0.0 end as own
  from p left join l on p.source is not distinct from l.source)
select doc_id, size, source_size, target, (size * least(2, floor((pos + 1) * own + u) - floor(pos * own + u)))::bigint as taken from r
"""
