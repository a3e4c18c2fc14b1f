"""Operator 7: near-duplicates by MinHash.

A document's set is its distinct shingles of k words. MINIMA universal hash functions give a signature; bands
of it name candidates; signatures confirm them; full sets decide; components join what is linked.

1. Equal sets collapse to one representative (the least doc_id), whatever the size of a group of copies.
2. Each band bucket becomes a star around its least member; members whose signatures are far from that one's
   form a star of their own in a next round, until none is left. So a bucket costs its size, never its pairs.
3. Components of these stars are families: every link lies within one.
4. Sets are compared in full, as sparse products within a task, and only a spanning star of what is linked comes
   out. A family of one block is compared all against all. The members of a larger one are first compared with
   HUBS of its members: near copies of one text are then one cluster, at a cost that follows the family's size.
   What is outside the largest cluster is compared with the whole family, block by block, each pair of blocks a
   task, so memory is bounded and no pair that could still join two clusters is left out.
5. Components of those links are the result.

Bands are chosen so that a pair at the threshold shares fewer than two with a probability under MISS (one is enough
in the first round, later rounds ask for two).

Defined cases: null texts and texts without words have an empty set and are linked with nothing; fewer than k
words are one shingle of their own kind; repeated rows are alike and in one component; one doc_id with several
texts counts as several documents, in one component if any is linked; rows with a null doc_id are linked with nothing and kept; very long texts
are hashed whole; an empty table gives no rows; other columns, whatever their names, pass through `deduplicated`.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_UPPER, Scratch, table
from .components import components

MINIMA = 216
MISS = 1e-6
#: Signatures that agree in less than this share are no family. It is far below any threshold: documents that are
#: linked through others come to one hub in few rounds, and what only shares passages stays apart.
FAR = 0.25
#: Members' texts are picked out of the scan by so many hash values at most (a broadcast of a few MB) before they
#: are shuffled; with more members than that it filters less, and the join still decides.
PICKS = 1 << 18
#: A family's block holds so many members, and so many shingles, on average at most.
BLOCK_MEMBERS = 1000
BLOCK_SHINGLES = 2_000_000
#: Members of a family of several blocks that all others are compared with first.
HUBS = 8
SEED = 5

_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_UPPER.lower().encode())
FACTOR, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """text -> its set, as sorted distinct 64-bit hashes. Words are parted at 0x20 and 0x09 to 0x0D; A-Z are lowered."""

    def __init__(self, k: int):
        self.k, self.up, self.down = k, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def words(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
        b = np.frombuffer(b" " + raw + b" ", np.uint8)
        n = len(b)
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, f, np.uint64)])) for f in (FACTOR, INVERSE))
        gap = (b == 32) | ((b >= 9) & (b <= 13))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(b.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text) if text else np.zeros(0, np.uint64)
        if not len(w):
            return w
        k = min(self.k, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = mix(h * FACTOR + w[i : len(w) - k + 1 + i])
        return np.unique(h)


def banding(threshold: float, minima: int = MINIMA, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows a band): the longest bands of which a pair at the threshold rarely enough shares fewer than two."""
    for rows in range(12, 0, -1):
        bands, same = minima // rows, threshold**rows
        if (1 - same) ** bands + bands * same * (1 - same) ** (bands - 1) <= miss:
            return bands, rows
    return minima, 1


class Signer:
    def __init__(self, bands: int, rows: int, minima: int = MINIMA, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, minima, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, minima, np.uint32)
        self.c = rng.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.bands, self.rows = bands, rows

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):
            np.minimum(out, (x[at : at + 512] * self.a + self.b).min(axis=0), out=out)
        return out

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(a hash per band, a byte per minimum)."""
        m = self.minima(shingles).astype(np.uint64)
        used = mix(m[: self.bands * self.rows].reshape(self.bands, self.rows) + np.uint64(1))
        keys = mix((used * self.c).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))
        return keys.view(np.int64), (mix(m) & np.uint64(255)).astype(np.uint8).tobytes()


def signatures(rows: DataFrame, k: int, bands: int, per_band: int) -> DataFrame:
    """rows: id, mark, text -> id, mark, n_shingles, print (of the whole set; null if empty), bands, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signer = Shingles(k), Signer(bands, per_band)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                if len(s):
                    keys, signature = signer(s)
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys, signature))
                else:
                    out.append((0, None, None, None))
            columns = zip(*out, strict=True) if out else [[]] * 4
            arrays = [batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, kinds[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "mark", "n_shingles", "print", "bands", "signature"])

    return rows.mapInArrow(run, "id long, mark long, n_shingles long, print binary, bands array<long>, signature binary")


def _near(pairs: DataFrame, far: float) -> DataFrame:
    """(hub, id, s, t) -> (hub, id, near): whether the signatures s and t agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1)) for c in ("s", "t"))
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("id"), pa.array((s == t).mean(axis=1) >= far)], names=["hub", "id", "near"])

    return pairs.mapInArrow(run, "hub long, id long, near boolean")


def family_links(sets: DataFrame, scratch: Scratch, far: float = FAR) -> DataFrame:
    """From (id, bands, signature) of distinct sets: links (a, b) whose components are the families."""
    rows = sets.select(F.explode("bands").alias("bucket"), "id")
    prints = sets.select("id", "signature")
    found, refined = None, False
    while True:
        # written, so that a bucket with very many members is a skewed side of a plain join
        hubs = scratch.cut(rows.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"))
        stars = scratch.cut(rows.join(hubs, "bucket").where("id <> hub"))
        pairs = stars.select("hub", "id").distinct()
        pairs = pairs.join(prints.select(F.col("id").alias("hub"), F.col("signature").alias("s")), "hub").join(prints.withColumnRenamed("signature", "t"), "id")
        judged = scratch.cut(_near(pairs.select("hub", "id", "s", "t"), far))
        links = judged.where("near").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        found = links if found is None else found.unionByName(links)
        if judged.where("not near").isEmpty():
            return found
        rows = stars.join(judged.where("not near").select("hub", "id"), ["hub", "id"]).select("bucket", "id")
        if not refined:
            # what is left shares a passage more than a text: from here on, members must share a second band
            # (linked ones share two, see `banding`), so a passage of very many documents doesn't cost a round for each
            rows = rows.join(sets.select("id", F.explode("bands").alias("other")), "id").where("bucket <> other")
            rows, refined = scratch.cut(rows.select(F.xxhash64("bucket", "other").alias("bucket"), "id")), True


def linked_stars(ids: list[int], sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links (id, least id) of the sets that intersect in at least `percent` of their union.

    side: pairs of one side only are compared if all sides are equal, else only pairs of different sides."""
    n = len(ids)
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), lengths)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    step = max(64, 4_000_000 // n)
    both = np.zeros((n, n), np.float32)
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, (a, a + step))
        dense = np.zeros((n, min(step, width - a)), np.float32)
        dense[owner[lo:hi], column[lo:hi] - a] = 1
        both += dense @ dense.T
    both = both.astype(np.int64)
    link = 100 * both >= percent * (lengths[:, None] + lengths[None, :] - both)
    if (side != side[0]).any():
        link &= side[:, None] != side[None, :]
        np.fill_diagonal(link, True)
    ids_, label = np.array(ids), np.array(ids)
    while True:
        new = np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    return [(int(i), int(r)) for i, r in zip(ids_, label, strict=True) if i != r]


def hub_links(rows: DataFrame, hubs: DataFrame, k: int, percent: int) -> DataFrame:
    """rows: family, part, id, text; hubs: family, id, text, parts -> links (a, b) of members with hubs, on full sets."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shingles = Shingles(k)
        centres = [(h.id, shingles(h.text)) for h in group[group["is_hub"]].drop_duplicates(["id", "text"]).itertuples()]
        out = []
        for m in group[~group["is_hub"]].itertuples():
            s = shingles(m.text)
            for hub, c in centres:
                both = int((c[np.minimum(np.searchsorted(c, s), len(c) - 1)] == s).sum())
                if hub != m.id and 100 * both >= percent * (len(s) + len(c) - both):
                    out.append((hub, m.id))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    copies = hubs.select("family", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "id", "text", F.lit(True).alias("is_hub"))
    both = rows.select("family", "part", "id", "text", F.lit(False).alias("is_hub")).unionByName(copies)
    return both.groupBy("family", "part").applyInPandas(run, "a long, b long")


def confirmed_links(members: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """members: id, mark, n_shingles, family; texts: id, mark, text -> links (a, b), confirmed on full sets.

    Families of one block are compared all against all. In larger ones clusters around hubs come first; a pair
    within the largest cluster can join nothing any more, so pairs with a member outside of it are what is left.
    """
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS)).cast("int")
    weight = scratch.cut(members.groupBy("family").agg(blocks.alias("parts")))
    pick = F.pmod("mark", F.lit(PICKS)).alias("pick")
    picked = texts.withColumn("pick", pick).join(F.broadcast(members.select(pick).distinct()), "pick", "left_semi").drop("pick")
    dealt = lambda parts: F.pmod(F.xxhash64("id"), parts).cast("int")

    found, place = None, members.join(weight.where("parts = 1"), "family").select("id", "mark", "family", F.lit(0).alias("part"), F.lit(1).alias("outer"), F.lit(1).alias("parts"))
    large = weight.where("parts > 1")
    if not large.isEmpty():
        own = scratch.cut(members.join(large, "family"))
        hubs = own.groupBy("family", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(HUBS)).alias("h")).agg(F.min(F.struct(F.xxhash64("id"), "id", "mark")).alias("hub"), F.first("parts").alias("parts"))
        hubs = scratch.cut(hubs.select("family", "hub.id", "hub.mark", "parts"))
        rows = picked.join(own.select("id", "mark", "family", dealt(F.col("parts")).alias("part")), ["id", "mark"])
        found = scratch.cut(hub_links(rows, picked.join(hubs, ["id", "mark"]), k, percent))
        clusters = components(found, scratch)
        own = scratch.cut(own.join(clusters, own["id"] == clusters["node"], "left").select("id", "mark", "n_shingles", "family", F.coalesce("root", "id").alias("cluster")))
        main = own.groupBy("family", "cluster").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"))
        own = own.join(F.broadcast(main) if main.limit(10_001).count() <= 10_000 else main, "family").withColumn("inside", F.col("cluster") == F.col("main"))
        blocks_of = lambda inside: F.greatest(F.ceil(F.coalesce(F.sum(F.when(inside, F.col("n_shingles"))), F.lit(0)) / BLOCK_SHINGLES), F.ceil(F.count_if(inside) / BLOCK_MEMBERS)).cast("int")
        deal = own.groupBy("family").agg(blocks_of(~F.col("inside")).alias("outer"), blocks_of(F.col("inside")).alias("inner")).where("outer > 0")
        own = own.join(deal, "family")
        part = F.when(F.col("inside"), F.col("outer") + dealt(F.col("inner"))).otherwise(dealt(F.col("outer")))
        place = place.unionByName(own.select("id", "mark", "family", part.alias("part"), "outer", (F.col("outer") + F.col("inner")).alias("parts")))

    # the blocks 0 to outer - 1 meet all blocks, the others only those
    rows = picked.join(place, ["id", "mark"])
    other = F.explode(F.expr("sequence(0, if(part < outer, parts, outer) - 1)")).alias("other")
    rows = rows.select("family", "id", "mark", "text", "part", other)
    rows = rows.select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "mark", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["id", "mark"])
        shingles = Shingles(k)
        links = linked_stars(group["id"].tolist(), [shingles(t) for t in group["text"]], group["part"].to_numpy(), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    links = rows.groupBy("family", "i", "j").applyInPandas(run, "a long, b long")
    return scratch.cut(links if found is None else links.unionByName(found))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, n_shingles, component_id, kept) for every row; mark is xxhash64 of the text."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.cut(signatures(rows, k, *banding(percent / 100)))
    classes = scratch.cut(signed.where("id is not null and print is not null").groupBy("print").agg(F.min("id").alias("rep")))
    sets = signed.join(classes, (signed["print"] == classes["print"]) & (signed["id"] == classes["rep"]), "left_semi")
    sets = scratch.cut(sets.dropDuplicates(["id", "print"]))
    families = components(family_links(sets, scratch), scratch).withColumnRenamed("root", "family")
    families = families.unionByName(families.select(F.col("family").alias("node"), "family").distinct()).withColumnRenamed("node", "id")
    members = scratch.cut(sets.join(families, "id").select("id", "mark", "n_shingles", "family"))
    links = confirmed_links(members, rows, k, percent, scratch)
    roots = components(links, scratch).withColumnRenamed("node", "rep")
    every = signed.select("id", "mark", "n_shingles", "print").join(classes, "print", "left").join(roots, "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id"))
    return scratch.finish(every.select("id", "mark", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, one document of each component; of repeated rows one stays."""
    found = near_duplicates(docs, k, percent, id_col, text_col).select("id", "mark", "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"))
    # rows that go, or that repeat, share one of PICKS hash values with few others: only those are shuffled
    pick = F.pmod("mark", F.lit(PICKS)).alias("pick")
    repeated = found.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    picks = F.broadcast(found.where("not kept").select(pick).unionByName(repeated.select(pick)).distinct())
    rows = rows.withColumn("pick", pick)
    clear = rows.join(picks, "pick", "left_anti").select("row.*")
    asked = rows.join(picks, "pick", "left_semi").drop("pick")
    kept = found.where("kept").select(F.col("id").alias("kept_id"), F.col("mark").alias("kept_mark"))
    asked = asked.join(kept, asked["id"].eqNullSafe(kept["kept_id"]) & (asked["mark"] == kept["kept_mark"]), "left_semi")
    return clear.unionByName(asked.dropDuplicates(["id", "mark"]).select("row.*"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: Exact: all pairs that share a shingle, then the least doc_id reachable.
OP7_SQL = r"""
with recursive w as (select doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') as ws from documents),
s as (select doc_id, case when len(ws) = 1 and ws[1] = '' then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
   else list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) end as sh from w),
x as (select doc_id, unnest(sh) as h from s),
rare as (select h from x group by h having count(*) > 1),
p as (select a.doc_id as u, b.doc_id as v, count(*) as n from x a join x b on a.h = b.h and a.doc_id <> b.doc_id where a.h in (select h from rare) group by 1, 2),
e as (select u, v from p join s a on a.doc_id = u join s b on b.doc_id = v where 100 * n >= 85 * (len(a.sh) + len(b.sh) - n)),
r(doc_id, root) as (select doc_id, doc_id from s union select r.doc_id, e.v from r join e on r.root = e.u)
select s.doc_id, len(any_value(s.sh))::bigint as n_shingles, min(r.root) as component_id, s.doc_id = min(r.root) as kept from s join r on s.doc_id = r.doc_id group by s.doc_id
"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
