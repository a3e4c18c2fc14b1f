"""Operator 6: license scans by diagonal voting. DataFrame functions only.

Texts become words; the hash of every rolling k-gram of words is joined with the k-grams of all templates (LONG_K
words for templates of LONG_WORDS or more, SHORT_K for others; both are parameters, as the templates are). A hit
votes for its diagonal (place in the text minus place in the template), and votes are counted by diagonal. A base
phrase stands where its diagonal has all of its votes. For the method's own templates, diagonals of MIN_VOTES or
more that follow each other within a DRIFT of the template's words are merged, as words put in or left out shift
them; a stray hit votes for a diagonal of its own and breaks nothing. A merged span is kept if the template words
that its hits cover reach MIN_COVER and it isn't longer in the text than two templates; where it fails, each of its
diagonals is verified by itself.

Scale: one pass over the texts; a k-gram leaves the scan only if some template has it, with its words compared as
such, so what is shuffled is hits and one slim row a document. The templates' k-grams are broadcast only up to
BROADCAST_GRAMS of them. Votes are pre-aggregated before they are shuffled; a document's hits are never gathered
in one place but in sorts by (document, template).

Defined cases: null and empty texts have no words; repeated rows come out as often as they came in; null ids stay;
very long texts are read whole; without any label the label strings are empty and the first and last word null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_UPPER, Scratch, lower_ascii, table
from .license_texts import WORDINGS

#: What parts the words of a lower-cased text: all ASCII but digits and a-z. Splitting there takes a twentieth
#: of the time that Spark's regexp_extract_all takes to find the words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many template k-grams the join is a broadcast (some 10 MB); beyond it both sides are shuffled.
BROADCAST_GRAMS = 100_000
SHORT_K, LONG_K, LONG_WORDS = 2, 5, 12
MIN_COVER = 0.7
#: Diagonals with fewer votes are strays, unless the template has fewer k-grams than four times that.
MIN_VOTES = 2
#: Diagonals that follow each other are one span if they are apart by this part of the template's words, or by 2.
DRIFT = 8

# The base phrases and their labels.
BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(ASCII_UPPER, ASCII_UPPER.lower()))) if w]


def gram_rows(base: list[tuple[str, str]], own: list[tuple[str, str]], short_k: int = SHORT_K, long_k: int = LONG_K) -> list[tuple]:
    """A row per k-gram of each template: template, base, label, words, k, place, gram."""
    rows = []
    for i, (is_base, (label, phrase)) in enumerate([(True, x) for x in base] + [(False, x) for x in own]):
        w = words_of(phrase)
        k = long_k if not is_base and len(w) >= max(LONG_WORDS, long_k) else short_k
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {phrase!r}")
        rows += [(i, is_base, label, len(w), k, p, " ".join(w[p : p + k])) for p in range(len(w) - k + 1)]
    return rows


GRAMS = "template int, base boolean, label string, words int, k int, place int, gram string"


def template_grams(spark: SparkSession, base: list[tuple[str, str]], own: list[tuple[str, str]], short_k: int = SHORT_K, long_k: int = LONG_K) -> DataFrame:
    return spark.createDataFrame(gram_rows(base, own, short_k, long_k), GRAMS)


def scan(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text", ks: tuple[int, ...] = (SHORT_K, LONG_K)) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: a slim row each with id, mark (of the text), n_words, copies.
    spans: id, mark, template, base, label, first_word, last_word, cover; a base span is one place. ks: all k in `grams`."""
    scratch = Scratch(docs.sparkSession, "licenses")
    # each document also emits one row at its end (k 0), which gives its number of words
    end = docs.sparkSession.createDataFrame([(-1, False, None, 0, 0, 0, "")], GRAMS)
    hashed = F.lit(0).cast("long")
    for k in ks:
        hashed = F.when(F.col("k") == k, F.xxhash64(F.lit(k), *[F.get(F.split("gram", " "), F.lit(j)) for j in range(k)])).otherwise(hashed)
    grams = grams.unionByName(end).withColumn("h", hashed)
    if grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    words = F.array_remove(F.split(lower_ascii(F.coalesce("text", F.lit(""))), GAP), "")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("mark"), F.concat(words, F.array(F.lit(None).cast("string"))).alias("ws"))
    rows = rows.select("id", "mark", "ws", F.posexplode_outer("ws").alias("pos", "w"))  # outer: else a filter is inferred that splits the text again
    at = lambda j: F.get("ws", F.col("pos") + j) if j else F.col("w")
    own = [F.when(F.col("w").isNull(), F.lit(0) if k == ks[0] else F.lit(None)).when(at(k - 1).isNotNull(), F.xxhash64(F.lit(k), *[at(j) for j in range(k)])) for k in ks]
    rows = rows.select("id", "mark", "ws", "pos", F.explode(F.array(*own)).alias("h"))
    hits = rows.join(grams, "h").where((F.col("template") < 0) | (F.array_join(F.slice("ws", F.col("pos") + 1, F.greatest(F.col("k"), F.lit(1))), " ") == F.col("gram")))
    hits = scratch.cut(hits.select("id", "mark", "pos", "template", "base", "label", "words", "k", "place"))

    every = hits.where("template < 0").groupBy("id", "mark", F.col("pos").cast("long").alias("n_words")).agg(F.count("*").alias("copies"))
    votes = hits.where("template >= 0").distinct().withColumn("diagonal", F.col("pos") - F.col("place"))  # rows that repeat vote once
    key = ["id", "mark", "template", "base", "label"]
    lines = votes.groupBy(*key, "words", "k", "diagonal").agg(F.count("*").alias("n"))
    exact = lines.where(F.col("base") & (F.col("n") == F.col("words") - F.col("k") + 1))
    exact = exact.select(*key, F.col("diagonal").cast("long").alias("first_word"), (F.col("diagonal") + F.col("words") - 1).cast("long").alias("last_word"), F.lit(1.0).alias("cover"))

    lines = lines.where(~F.col("base") & ((F.col("n") >= MIN_VOTES) | (F.col("words") - F.col("k") + 1 < 4 * MIN_VOTES)))
    line = Window.partitionBy("id", "mark", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > F.greatest(F.lit(2), F.floor(F.col("words") / DRIFT))
    lines = lines.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    mine = [F.col(c).eqNullSafe(F.col("line_" + c)) for c in ("id", "mark", "template", "diagonal")]
    lines = lines.select(*[F.col(c).alias("line_" + c) for c in ("id", "mark", "template", "diagonal")], "span")
    own = scratch.cut(votes.where("not base").join(lines, mine[0] & mine[1] & mine[2] & mine[3]).select(*key, "words", "k", "pos", "place", "diagonal", "span"))

    def verified(by: str, rows: DataFrame) -> DataFrame:
        covered = rows.select(*key, "words", by, "pos", "k", F.explode(F.expr("sequence(place, place + k - 1)")).alias("word"))
        out = covered.groupBy(*key, "words", by).agg(F.count_distinct("word").alias("n"), F.min("pos").alias("a"), F.max(F.col("pos") + F.col("k")).alias("b"))
        return out.withColumn("ok", (F.col("n") >= MIN_COVER * F.col("words")) & (F.col("b") - F.col("a") <= 2 * F.col("words")))

    spans = scratch.cut(verified("span", own))
    failed = spans.where("not ok").select(*[F.col(c).alias("line_" + c) for c in ("id", "mark", "template")], F.col("span").alias("failed"))
    alone = own.join(failed, mine[0] & mine[1] & mine[2] & (F.col("span") == F.col("failed")), "left_semi")
    found = spans.where("ok").drop("span").unionByName(verified("diagonal", alone).where("ok").drop("diagonal"))
    found = found.select(*key, F.col("a").cast("long").alias("first_word"), (F.col("b") - 1).cast("long").alias("last_word"), (F.col("n") / F.col("words")).alias("cover"))
    return every, exact.unionByName(found)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = scan(table(spark, sf_dir, "documents"), template_grams(spark, BASE, WORDINGS))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")  # noqa: E731  at most one entry per label
    on_base = lambda c: F.when(F.col("base"), F.col(c))
    found = spans.groupBy("id", "mark").agg(F.count(on_base("label")).alias("n_base"), F.min(on_base("first_word")).alias("first_word"), F.max(on_base("first_word")).alias("last_word"), joined(on_base("label")).alias("base_labels"), joined("label").alias("labels"), F.max("cover").alias("score"))
    found = found.withColumnRenamed("id", "found_id").withColumnRenamed("mark", "found_mark")
    out = docs.join(found, docs["id"].eqNullSafe(found["found_id"]) & (docs["mark"] == found["found_mark"]), "left")
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


#: Places by unnesting words; the method's spans follow the same rules in window functions.
OP6_SQL = (
    r"""
with grams(template, base, label, words, k, place, gram) as (values """
    + ", ".join(f"({i}, {str(b).lower()}, '{label}', {n}, {k}, {p}, '{g}')" for i, b, label, n, k, p, g in gram_rows(BASE, WORDINGS))
    + rf"""),
docs as (select row_number() over () as n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
u as (select n, unnest(ws) as w, unnest(range(len(ws))) as pos from docs),
s as (select n, pos, w || ' ' || lead(w) over v as two, w || ' ' || lead(w) over v || ' ' || lead(w, 2) over v || ' ' || lead(w, 3) over v || ' ' || lead(w, 4) over v as five from u window v as (partition by n order by pos)),
votes as (select s.n, s.pos, g.*, s.pos - g.place as diagonal from s join grams g on g.k = {SHORT_K} and s.two = g.gram union all select s.n, s.pos, g.*, s.pos - g.place from s join grams g on g.k = {LONG_K} and s.five = g.gram),
line as (select n, template, base, label, words, k, diagonal, count(*) as votes from votes group by all),
exact as (select n, label, diagonal as first_word, 1.0::double as cover from line where base and votes = words - k + 1),
o1 as (select *, diagonal - lag(diagonal) over v > greatest(2, words // {DRIFT}) as apart from line where not base and (votes >= {MIN_VOTES} or words - k + 1 < {4 * MIN_VOTES}) window v as (partition by n, template order by diagonal)),
o2 as (select *, sum(case when apart then 1 else 0 end) over (partition by n, template order by diagonal rows unbounded preceding) as span from o1),
own as (select v.n, v.template, v.label, v.words, v.k, v.pos, v.diagonal, o.span, unnest(range(v.place, v.place + v.k)) as word from votes v join o2 o on v.n = o.n and v.template = o.template and v.diagonal = o.diagonal),
m as (select n, template, label, span, count(distinct word) / words as cover, count(distinct word) >= {MIN_COVER} * words and max(pos + k) - min(pos) <= 2 * words as ok from own group by n, template, label, words, span),
a1 as (select o.n, o.label, count(distinct word) / words as cover from own o join m using (n, template, span) where not m.ok group by o.n, o.template, o.label, o.words, o.diagonal having count(distinct word) >= {MIN_COVER} * words and max(pos + k) - min(pos) <= 2 * words),
e as (select n, count(*) as n_base, min(first_word) as first_word, max(first_word) as last_word, string_agg(distinct label, ',' order by label) as base_labels from exact group by n),
a as (select n, string_agg(distinct label, ',' order by label) as labels, max(cover) as score from (select n, label, cover from exact union all select n, label, cover from m where ok union all select * from a1) group by n)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(e.n_base, 0)::bigint as n_base, e.first_word::bigint as first_word, e.last_word::bigint as last_word,
  coalesce(e.base_labels, '') as base_labels, coalesce(a.labels, '') as labels, coalesce(a.score, 0.0)::double as score
from docs d left join e using (n) left join a using (n)
"""
)
