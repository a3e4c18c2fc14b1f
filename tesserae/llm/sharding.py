"""Operator 9: sharding by balanced label propagation. DataFrame functions only.

Linked documents (by default those of equal text) form units, a star around the unit's key instead of its pairs.
A unit larger than a shard is dealt into parts, all but the last as large as a shard; every other unit stays
whole where room allows. First labels: units above 1/GRAIN of a shard, largest first, go to the shard with most
room; all other rows lie in one order that keeps a unit's rows together, and fill what is left of each shard. So
few units begin on two shards. In each round such a unit votes for the shard that could hold most of it, and its
members elsewhere want to move there. Moves between two shards are matched one for one, first against moves the
other way, then against documents without links; quotas say how many of each flow are let through, so the row
counts never change and stay at most one apart (law `rows`). Rounds end when nobody wants to move, or when two
rounds running cut no fewer members off; the round that cut fewest counts. `cut_report` says what is left.

Scale: there are at most GRAIN units above 1/GRAIN of a shard for each shard, so their table is broadcast and
their places are one row's fold; no other unit has more rows than that share. Null keys and linkless rows take
part in no join; quotas are a table of shards squared; places within a flow come from slice counts
(common.ranked), so no task sorts a flow; each round's state is written to the shared folder, which cuts lineage.

Defined cases: a null text has size 8, crc 0 and no links; empty texts are equal texts; repeated rows are
documents of their own; null ids are allowed; very long texts are read once, for size, crc and digest; an empty
table gives no rows; fewer rows than shards leave shards empty; further columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ranked, table

SHARDS = 24
#: Rounds at most; one or two are usual.
ROUNDS = 12
#: Units of more than one part in GRAIN of a shard are placed one by one.
GRAIN = 64


def _quotas(flows: DataFrame, free: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From flows (shard, want, n) and linkless rows (shard, free): how many moves pass, and the linkless rows moved in return."""
    back = flows.select(F.col("want").alias("shard"), F.col("shard").alias("want"), F.col("n").alias("back"))
    pair = flows.join(back, ["shard", "want"], "left").fillna(0, ["back"])
    pair = pair.withColumn("direct", F.least("n", "back")).withColumn("need", F.col("n") - F.col("direct"))
    pair = pair.join(free.select(F.col("shard").alias("want"), "free"), "want", "left").fillna(0, ["free"])
    need = F.sum("need").over(Window.partitionBy("want"))
    fill = F.when(need <= F.col("free"), F.col("need")).otherwise(F.floor(F.col("need") * F.col("free") / F.greatest(need, F.lit(1))))
    pair = pair.withColumn("fill", fill.cast("long"))
    moves = pair.select("shard", "want", (F.col("direct") + F.col("fill")).alias("quota"))
    upto = F.sum("fill").over(Window.partitionBy("want").orderBy("shard"))
    returns = pair.select(F.col("want").alias("shard"), F.col("shard").alias("to"), upto.alias("upto"), F.col("fill"))
    return moves, returns.where("fill > 0").withColumn("start", F.col("upto") - F.col("fill"))


def _placed(pieces: DataFrame, caps: list[int]) -> tuple[DataFrame, list[int]]:
    """From pieces (link, part, n), at most a few thousand: (link, part, shard) of those that fit, and the room left.

    Largest first, each into the shard with most room."""
    rooms = "array(" + ", ".join(f"{c}L" for c in caps) + ")"
    at = "array_position(acc.rooms, array_max(acc.rooms)) - 1"
    fold = f"""aggregate(list, named_struct('rooms', {rooms}, 'placed', cast(array() as array<struct<link:string,part:bigint,shard:int>>)),
      (acc, x) -> if(array_max(acc.rooms) < x.n, acc, named_struct('rooms', transform(acc.rooms, (r, j) -> if(j = {at}, r - x.n, r)),
        'placed', concat(acc.placed, array(named_struct('link', x.link, 'part', x.part, 'shard', cast({at} as int)))))))"""
    one = pieces.agg(F.sort_array(F.collect_list(F.struct("n", "link", "part")), asc=False).alias("list")).select(F.expr(fold).alias("done"))
    done = one.first()[0]
    spark = pieces.sparkSession
    return spark.createDataFrame([tuple(x) for x in done.placed], "link string, part long, shard int"), list(done.rooms)


def shard_linked(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", link=None, rounds: int = ROUNDS) -> DataFrame:
    """A row per document: id, size, text_crc32, shard, slot. link: a column; rows of equal value (not null) are linked."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.col(text_col)
    link = F.sha2(text.cast("binary"), 256) if link is None else link.cast("string")
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("crc"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), link.alias("link"))
    slim = scratch.cut(slim)
    total = slim.count()
    caps = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    whole, most = max(1, caps[-1]), max(1, caps[0])
    columns, tie = ["id", "crc", "size", "unit"], [F.xxhash64("id", "crc", "size"), F.col("id"), F.col("crc"), F.col("size")]

    counts = scratch.cut(slim.where("link is not null").groupBy("link").agg(F.count("*").alias("n")).where("n > 1"))
    big = counts.where(F.col("n") * GRAIN > most)
    linked = slim.where("link is not null").join(F.broadcast(big), "link", "left")
    small = linked.where("n is null").drop("n").join(counts.where(F.col("n") * GRAIN <= most), "link", "left")
    ordinary = small.select("id", "crc", "size", F.when(F.col("n").isNotNull(), F.col("link")).alias("unit"))
    ordinary = ordinary.unionByName(slim.where("link is null").select("id", "crc", "size", F.lit(None).cast("string").alias("unit")))
    rooms, settled = caps, None
    if not big.isEmpty():
        parts = F.when(F.col("n") > most, F.ceil(F.col("n") / whole)).otherwise(F.lit(1)).cast("long")
        pieces = big.select("link", F.col("n").alias("every"), parts.alias("parts")).select("*", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
        rest = F.col("every") - F.col("part") * whole
        pieces = pieces.select("link", "part", F.when(F.col("parts") == 1, F.col("every")).otherwise(F.least(F.lit(whole), rest)).cast("long").alias("n"))
        placed, rooms = _placed(pieces, caps)
        rows = scratch.cut(linked.where("n is not null"))
        dealt = ranked(rows.where(F.col("n") > most), ["link"], tie).withColumn("part", F.floor(F.col("rank") / whole)).drop("rank")
        rows = rows.where(F.col("n") <= most).withColumn("part", F.lit(0).cast("long")).unionByName(dealt)
        rows = scratch.cut(rows.join(F.broadcast(placed), ["link", "part"], "left"))
        settled = rows.where("shard is not null").select("id", "crc", "size", "shard")
        # what fits nowhere whole is dealt into parts small enough to move
        crumb = F.pmod(F.xxhash64("id", "crc"), F.ceil(F.col("n") * GRAIN / most))
        ordinary = ordinary.unionByName(rows.where("shard is null").select("id", "crc", "size", F.concat_ws(":", "link", "part", crumb).alias("unit")))
    ends = [sum(rooms[: s + 1]) for s in range(n_shards)]
    ordinary = scratch.cut(ordinary.withColumn("near", F.pmod(F.when(F.col("unit").isNull(), F.xxhash64("id", "crc")).otherwise(F.xxhash64("unit")), F.lit(1 << 32))))
    state = ranked(ordinary, [], [F.col("near"), F.col("unit"), *tie], spread=F.col("near"))
    state = scratch.cut(state.withColumn("shard", F.expr("size(filter(array(" + ", ".join(f"{e}L" for e in ends) + "), e -> e <= rank))")).select(*columns, "shard"))

    best, stale = None, 0
    for _ in range(rounds):
        votes = scratch.cut(state.where("unit is not null").groupBy("unit", "shard").agg(F.count("*").alias("n")))
        units = votes.groupBy("unit").agg(F.sum("n").alias("every"), F.max("n").alias("top"))
        # a full shard is no goal: what counts is how many of the unit could be there, then how many are
        room = state.where("unit is null").groupBy("shard").agg(F.count("*").alias("free"))
        torn = votes.join(units.where("top < every"), "unit").join(F.broadcast(room), "shard", "left")
        torn = torn.withColumn("could", F.col("n") + F.least(F.coalesce("free", F.lit(0)), F.col("every") - F.col("n")))
        wins = torn.groupBy("unit").agg(F.max_by("shard", F.struct("could", "n", F.xxhash64("unit", "shard"))).alias("want"), F.max(F.col("every") - F.col("top")).alias("off"))
        wins = scratch.cut(wins)
        off = wins.agg(F.coalesce(F.sum("off"), F.lit(0))).first()[0]
        if best is None or off < best[0]:
            best, stale = (off, state), 0
        else:
            stale += 1
        if not off or stale == 2:
            break
        asked = scratch.cut(state.where("unit is not null").join(wins.select("unit", "want"), "unit", "left").withColumn("want", F.when(F.col("want") != F.col("shard"), F.col("want"))))
        flows = scratch.cut(asked.where("want is not null").groupBy("shard", "want").agg(F.count("*").alias("n")))
        moves, returns = _quotas(flows, room)
        moved = ranked(asked.where("want is not null"), ["shard", "want"], [F.xxhash64("unit"), F.col("unit"), *tie]).join(F.broadcast(moves), ["shard", "want"])
        moved = moved.withColumn("shard", F.when(F.col("rank") < F.col("quota"), F.col("want")).otherwise(F.col("shard")))
        linkless = ranked(state.where("unit is null"), ["shard"], tie)
        linkless = linkless.alias("r").join(F.broadcast(returns).alias("q"), F.expr("r.shard = q.shard and r.rank >= q.start and r.rank < q.upto"), "left")
        linkless = linkless.select("r.id", "r.crc", "r.size", "r.unit", F.coalesce("q.to", "r.shard").alias("shard"))
        stay = asked.where("want is null")
        new = scratch.cut(stay.select(*columns, "shard").unionByName(moved.select(*columns, "shard")).unionByName(linkless.select(*columns, "shard")))
        scratch.drop(asked, flows, votes, wins, *([state] if state is not best[1] else []))
        state = new

    state = best[1].select("id", "crc", "size", "shard") if best else state.select("id", "crc", "size", "shard")
    state = scratch.finish(state if settled is None else state.unionByName(settled))
    out = ranked(state, ["shard"], tie, name="slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def cut_report(docs: DataFrame, shards: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: groups of equal texts, those on more than one shard, and the rows off their group's fullest shard.

    Ids must be unique and not null. It shuffles digests and ids, not texts."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("link"))
    rows = rows.join(shards.select(F.col(id_col).alias("id"), "shard"), "id").groupBy("link", "shard").agg(F.count("*").alias("n"))
    units = rows.groupBy("link").agg(F.sum("n").alias("every"), F.max("n").alias("top"), F.count("*").alias("shards")).where("every > 1")
    return units.agg(F.count("*").alias("groups"), F.count_if(F.col("shards") > 1).alias("cut_groups"), F.coalesce(F.sum(F.col("every") - F.col("top")), F.lit(0)).alias("cut_rows"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_linked(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
