"""Registered queries against their SQL, and the pipeline against each stage's rule."""

import os
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tesserae.llm import decontam, mixing, near_dup, quality, registry
from tests.llm.test_operators import DOCS, clashing, edits, plain_buckets, prose, reachable

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(registry.SQL[name])
    assert sorted(want.columns) == names
    show = lambda rows: sorted(str(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r)) for r in rows)
    assert show(df.select(*names).collect()) == show(tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}


def test_recall_of_op5(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in registry.QUERIES["op5_nearest"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        hits += len(got[ids[q]] & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(got)


def test_pipeline_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen.append((name, before.collect(), after.collect()))
        before = after
        if name != "sharding":
            assert after.columns == columns
    (_, a, b), (_, c, d), (_, e, f), (_, g, h), (_, i, j) = seen
    assert {r.doc_id for r in b} <= {r.doc_id for r in a} and len(b) > 0.6 * len(a)
    roots, _ = reachable([(r.doc_id, r.text, "") for r in c], 5, 80)
    assert {r.doc_id for r in d} == {k for k, v in roots.items() if k == v}
    items = [x for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(x := decontam.normal(r.text)) >= decontam.MIN_CHARS]
    assert {r.doc_id for r in f} <= {r.doc_id for r in e}
    assert not any(x in decontam.normal(r.text) for r in f for x in items)
    assert {r.doc_id for r in h} <= {r.doc_id for r in g}
    shards = {}
    for r in j:
        shards[r.shard] = shards.get(r.shard, 0) + 1
    assert len(j) == len(i) == len(h) and max(shards.values()) - min(shards.values()) <= 1
    assert corpus_pipeline.run(spark, SF).count() == len(j)
    assert near_dup.banding(0.8)[1] * near_dup.banding(0.8)[0] <= near_dup.MINIMA


def small_corpus(spark, at):
    """A folder of tables: good and bad prose, near copies, benchmark passages with edits, four sources, odd rows."""
    r = random.Random(31)
    rows, labels, items = [], [], [(i, prose(14, 700 + i)) for i in range(4)]
    for i in range(120):
        text = prose(r.randint(15, 50), 4000 + i)
        good = i % 4 != 3
        if not good:
            text = " ".join(w + "!!" for w in text.upper().split())
        if good and i % 10 == 0:
            text += " " + items[i % 4][1].replace("a", "", 1) + " end"
        rows.append((i, text, "en", ("x", "y", "z", None)[i % 5 % 4], len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[4 * i][1] + (" tail" if i % 2 else ""), "en", "y", 0) for i in range(12)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "x", 0), (None, prose(30, 9), "en", "x", 0), rows[5], (2002, prose(8000, 10), "en", "z", 0)]
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return items


def test_pipeline_against_brute_force(spark, tmp_path):
    items = small_corpus(spark, tmp_path)
    sf = str(tmp_path)
    names = lambda rows: Counter(str(x.doc_id) for x in rows)
    before, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    model = quality.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(f"{sf}/out/{name}")
        after = spark.read.parquet(f"{sf}/out/{name}")
        seen[name] = before.collect(), after.collect()
        before = after
    a, b = seen["quality"]
    u, bias = model.table()
    margin = lambda t: (sum(float(u[i]) for i in ids) / len(ids) if (ids := plain_buckets(t or "")) else 0.0) + bias
    assert names(b) == names(x for x in a if margin(x.text) >= 0) and 80 < len(b) < 120
    a, b = seen["near_duplicates"]
    named = [x for x in a if x.doc_id is not None]
    roots, _ = reachable([(x.doc_id, x.text, "") for x in named], 5, 80)
    assert names(b) == Counter([str(k) for k, v in roots.items() if k == v] + ["None"] * (len(a) - len(named))) and len(b) < len(a) - 5
    a, b = seen["decontamination"]
    wanted = [(m := decontam.normal(t), len(m) // decontam.ERROR_PART) for _, t in items]
    dirty = lambda t: any(edits(m, decontam.normal(t)) <= k for m, k in wanted)
    short = [x for x in a if len(x.text or "") < 5000]
    assert names(x for x in b if len(x.text or "") < 5000) == names(x for x in short if not (x.text and dirty(x.text))) and len(b) < len(a)
    a, b = seen["mixing"]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/out/decontamination/*.parquet'")
    words = con.sql(f"select doc_id, size, taken from ({mixing.OP10_SQL})").fetchall()
    assert names(b) == Counter({str(i): taken // size for i, size, taken in words if taken})
    a, b = seen["sharding"]
    shards = Counter(x.shard for x in b)
    assert names(a) == names(b) and max(shards.values()) - min(shards[k] for k in range(24)) <= 1
    assert names(corpus_pipeline.run(spark, sf).collect()) == names(b)


def test_stages_of_odd_tables(spark, tmp_path):
    """No rows at all, and clashing columns: each stage gives what its rule says and keeps the columns."""
    small_corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        odd = clashing(docs.where("doc_id is null or doc_id >= 1000"))
        out = stage(spark, odd, str(tmp_path))
        rows = out.collect()
        assert k == 4 or (out.columns == odd.columns and empty.columns == docs.columns), name
        assert len(rows) == odd.count() if k == 4 else len(rows) >= 0
