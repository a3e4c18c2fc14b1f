"""Edge cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import ann, chat, components, decontam, licenses, mixing, near_dup, pii, quality, sharding, url_rules
from tesserae.llm.common import Scratch, ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(4)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def odd(spark):
    """Null id, null and empty text, blanks, a repeated row, a null source and a very long text."""
    long = prose(30_000, 1)
    return docs(spark, [(1, "", "a"), (2, None, None), (3, " \n", "a"), (4, prose(40, 2), "a"), (4, prose(40, 2), "a"), (None, prose(40, 3), "b"), (5, long, "b"), (6, "x", "b")])


def clashing(df):
    """Columns named like those the operators use inside."""
    for c in ("id", "mark", "row", "rank", "shard", "unit", "copies", "mix_key", "size", "label", "score", "part", "kept"):
        df = df.withColumn(c, F.lit("?"))
    return df


def test_ranked(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    out = ranked(df, ["k"], [F.col("id")], slice_rows=50).groupBy("k").agg(F.collect_list("rank").alias("r"), F.count("*").alias("n")).collect()
    assert all(sorted(r.r) == list(range(r.n)) for r in out)
    assert sorted(r.rank for r in ranked(df, [], [F.col("id")], slice_rows=70).collect()) == list(range(1000))


# 1 PII


def test_pseudonyms(spark):
    t = "card 4111 1111 1111 1111, mail Jo.Doe7@Mail.example.com, +1 (212) 555-0187, 10.20.30.40, 078-05-1120, 1984-02-29, GB82 2345 0000 0000 00"
    rows = [*((r.doc_id, r.text, r.source) for r in odd(spark).collect()), (8, t, "a"), (9, "again 4111-1111-1111-1111 and 4111111111111112, 2021-13-45, 999.1.1.1", "a")]
    df = clashing(docs(spark, rows))
    got = pii.pseudonyms(df, "key")
    out = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and out[2].text is None and out[1].text == "" and out[5].text == dict((r[0], r[1]) for r in rows)[5]
    new = re.findall(r"card ([\d ]{19})", out[8].text)[0]
    assert new != "4111 1111 1111 1111" and pii.luhn_digit(new.replace(" ", "")[:-1]) == new[-1]
    assert new.replace(" ", "-") in out[9].text  # the same value is linked in another shape
    assert "4111111111111112" in out[9].text and "2021-13-45" in out[9].text and "999.1.1.1" in out[9].text
    for private in ("Jo.Doe7", "555-0187", "10.20.30.40", "078-05-1120", "1984-02-29"):
        assert private not in out[8].text
    assert out[8].kinds == "card:1,date:1,email:1,ipv4:1,phone:1,ssn:1" and out[4].n_found == 0
    back = {r.doc_id: r.text for r in pii.pseudonyms(got, "key", inverse=True).collect()}
    assert back[8] == t and back[9] == rows[-1][1]
    assert pii.pseudonyms(df.limit(0), "key").count() == 0
    with pytest.raises(ValueError, match="key"):
        pii.pseudonyms(df, "")


#: Each line is one value in every shape it may be written in.
SHAPES = [
    ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"],
    ["378282246310005", "3782 822463 10005"],
    ["+442071838750", "+44 20 7183 8750", "+44-20-7183-8750", "+44 (20) 7183 8750", "+44 (0)20 7183 8750", "+44.20.7183.8750"],
    ["+12125550187", "+1 (212) 555-0187", "(212) 555-0187", "212-555-0187", "212.555.0187", "+1.212.555.0187", "+1 212 555 0187"],
    ["+4930123456789", "+49 30 123456789"[:16], "+49 30 12345 6789"],
    ["+35312345678", "+353 1 234 5678"],
    ["GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19"],
    ["FR1420041010050500013M02606", "FR14 2004 1010 0505 0001 3M02 606"],
    ["1990-12-31", "1990/12/31", "12/31/1990", "31/12/1990", "31.12.1990"],
    ["1990-02-01", "1990/2/1", "1990/02/01", "1/2/1990", "01/02/1990", "1.2.1990", "01.02.1990"],
    ["2004-02-29", "29/2/2004", "2/29/2004", "02/29/2004", "29.02.2004"],
    ["2011-11-11", "11/11/2011", "2011/11/11"],
    ["Jo.Doe7@Mail.example.com", "jo.doe7@mail.example.com", "JO.DOE7@MAIL.EXAMPLE.com"],
    ["078-05-1120"],
    ["'" + "aB3-" * 33 + "'"],
    ["0123456789abcdef" * 8 + "0"],
]


@pytest.mark.parametrize("shapes", SHAPES, ids=lambda x: x[0][:12])
def test_every_value_in_every_shape(shapes):
    f = pii.Feistel("k")
    plain = lambda v: re.sub(r"[^0-9a-z]", "", v.replace("(0)", "").lower())

    def value(v):
        if (m := re.fullmatch(r"(\d{4})[-/](\d+)[-/](\d+)", v)) or (m := re.fullmatch(r"(\d\d?)[/.](\d\d?)[/.](\d{4})", v)):
            y, a, b = (int(x) for x in m.groups())
            y, month, day = (y, a, b) if y > 31 else (b, a, y) if a <= 12 else (b, y, a)
            return y, month, day
        return plain(v)[-10:] if shapes[0].startswith("+1") else plain(v)

    new = set()
    for v in shapes:
        for text in (v, f"see {v} there", f"({v})" if v[0] != "(" else v, f"{v}\n{shapes[0]}"):
            if text.count("'") == 2 and text[0] == "(":
                continue
            out, found = pii.pseudonymise(text, f)
            assert sum(found.values()) == 1 + text.count("\n") and len(out) == len(text) and out != text
            assert re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", out))) == re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", text))) or len(v) > 100
            assert pii.pseudonymise(out, f, inverse=True) == (text, found)
            at = text.index(v)
            new.add(value(out[at : at + len(v)]))
    assert len(new) == 1 and new != {value(shapes[0])}
    assert pii.pseudonymise(shapes[0], pii.Feistel("other"))[0] != pii.pseudonymise(shapes[0], f)[0]


def test_phones_keep_valid_codes():
    f = pii.Feistel("k")
    out, found = pii.pseudonymise("at 10.20.30.40, 10.20.30.40", f)  # octets may differ in width
    assert found == {"ipv4": 2} and (m := re.fullmatch(r"at ((?:\d+\.){3}\d+), \1", out)) and m[1] != "10.20.30.40" and pii.pseudonymise(out, f, inverse=True)[0] == "at 10.20.30.40, 10.20.30.40"
    r = random.Random(8)
    for _ in range(300):
        n = f"+1 {r.randint(2, 9)}{r.randint(10, 99)} {r.randint(2, 9)}{r.randint(10, 99)} {r.randint(1000, 9999)}"
        assert re.fullmatch(r"\+1 [2-9]\d\d [2-9]\d\d \d{4}", pii.pseudonymise(n, f)[0])
        n = f"+{r.choice([44, 49, 33, 353, 971])} {r.randint(1, 9)}{r.randint(10, 99)} {r.randint(100, 999)} {r.randint(1000, 9999)}"
        out = pii.pseudonymise(n, f)[0]
        assert out.split(" ")[0] == n.split(" ")[0] and out.split(" ")[1][0] != "0"


def test_ibans_with_letters_and_month_first_dates():
    f = pii.Feistel("k")
    valid = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    kinds = lambda v: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v))
    real = ["GB29 NWBK 6016 1331 9268 19", "NL91ABNA0417164300", "FR1420041010050500013M02606", "IE29 AIBK 9311 5212 3456 78", "IT60X0542811101000000123456", "MT84MALT011000012345MTLCAST001S", "NO93 8601 1117 947", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"]
    for v in real:
        for text in (v, f"to {v} EUR 1234 PAID", f"{v} {real[1]}", f"({v}), ok"):
            out, found = pii.pseudonymise(text, f)
            a = text.index(v)
            new = out[a : a + len(v)]
            assert found["iban"] == 1 + (text == f"{v} {real[1]}") and new != v and kinds(out) == kinds(text) and new[:2] == v[:2] and valid(new.replace(" ", ""))
            assert out[:a] == text[:a] and pii.pseudonymise(out, f, inverse=True) == (text, found)
    assert pii.pseudonymise("GB29 NWBK 6016 1331 9268 19", f)[0].replace(" ", "") == pii.pseudonymise("GB29NWBK60161331926819", f)[0]
    assert pii.pseudonymise("GB28 NWBK 6016 1331 9268 19", f)[1]["iban"] == 0  # a wrong check digit
    for month, day in itertools.product(range(1, 13), range(13, 29)):
        text = f"born {month:02}/{day}/1990."
        out, found = pii.pseudonymise(text, f)
        m = re.fullmatch(r"born (\d\d)/(\d\d)/(\d{4})\.", out)
        assert found == {"date": 1} and int(m[1]) <= 12 < int(m[2]) and pii.pseudonymise(out, f, inverse=True)[0] == text
    assert pii.pseudonymise("12/05/1990", f)[1] == {"date": 1} and not pii.pseudonymise("13/25/1990 02/30/1990 31/04/1990", f)[1]


def test_feistel_permutes():
    f = pii.Feistel("k")
    for size in (1, 2, 10, 97, 1000):
        image = [f.permute("t", size, v) for v in range(size)]
        assert sorted(image) == list(range(size)) and [f.permute("t", size, v, inverse=True) for v in image] == list(range(size))
    assert [f.permute("t", 1000, v) for v in range(50)] != [pii.Feistel("l").permute("t", 1000, v) for v in range(50)]


# 2 quality


def test_quality(spark):
    good = [(i, prose(60, i), "a") for i in range(200)]
    bad = [(1000 + i, " ".join(w + "!!" for w in prose(60, 5000 + i).upper().split()), "a") for i in range(60)]
    df = docs(spark, [*good, *bad])
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _, _ in [*good, *bad]], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    held = quality.scored(df, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert len(held) > 50 and np.mean([(r.score >= 0.5) == r.quality for r in held]) >= 0.97
    out = quality.scored(clashing(odd(spark)), model).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1  # the bias alone
    kept = quality.accepted(clashing(df), model)
    assert kept.columns == clashing(df).columns and all(r.doc_id < 1000 for r in kept.collect())
    none = quality.fit(df, labels.limit(0))
    assert {r.score for r in quality.scored(df, none).collect()} == {0.5}
    assert quality.scored(df.limit(0), model).count() == 0
    u, bias = model.table()
    for r in out:
        text = next(x.text for x in odd(spark).collect() if x.doc_id == r.doc_id)
        ids = plain_buckets(text or "") if len(text or "") < 1000 else []
        if ids or not text or not text.strip():
            assert abs(r.score - 1 / (1 + math.exp(-(sum(float(u[i]) for i in ids) / max(1, len(ids)) + bias)))) < 1e-6
    assert quality.training_rows(df.unionByName(df), labels, sample=50).count() == 50
    assert quality.training_rows(df, labels, sample=50, total_bytes=2000).agg(F.sum(F.octet_length("text"))).first()[0] <= 2000


def plain_buckets(text):
    """The features one by one, in whole numbers."""
    full, factor = (1 << 64) - 1, int(quality.FACTOR)
    data = bytes(32 if c <= 32 else c for c in text.encode())

    def bucket(h, salt):
        h = (h + salt) * int(quality.MIXER) & full
        return ((h ^ h >> 32) * int(quality.MIXER) & full) >> 29 & quality.BUCKETS - 1

    hashed = lambda b: sum((c + 1) * pow(factor, i, 1 << 64) for i, c in enumerate(b)) & full
    words = [hashed(w) for w in data.split(b" ") if w]
    if not words:
        return []
    out = [bucket(w, 1) for w in words] + [bucket(0 if a == b else (a * factor + b) & full, 2) for a, b in itertools.pairwise(words)]
    padded = b" " + data + b" "
    for k in quality.NGRAMS:
        out += [bucket(hashed(padded[i : i + k]), 2 + k) for i in range(len(padded) - k + 1)] if len(padded) > k else []
    return out


# 3 url rules


def test_url_rules_against_brute_force(spark):
    r = random.Random(2)
    hosts = ["net", "example.net", "a.example.net", "Example.NET", "example.com", "b.org", "org", "xnet", "", "a..net"]
    paths = ["", "/", "/en/", "/en/x", "/en", "/de/y?q", "/fr/#z", "/de/\U0010ffff"]
    urls = [None, "no scheme", "://", "http://net/", "http://" + "a." * 50_000 + "example.net/en/", "http://example.com/de/" + "x" * 200_000] + [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame([(i % 250, u, "?") for i, u in enumerate(urls)] + [(1, urls[1], "?")], "page_id long, url string, host string")
    rules = url_rules.RULES + [("allow", "a.example.net/"), ("block", "net/en/"), ("allow", "net/en/"), ("allow", "org/")]

    def brute(u):
        m = re.match(r"(?s)[^:]*?://([^/?#]*)([^?#]*)", u[u.index("://") - 0 :] if u and "://" in u else "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fit = [(len(x), v == "block", x, v) for v, x in rules for h, p in [x.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    got = url_rules.match_urls(pages.withColumnRenamed("host", "at"), url_rules.rule_table(spark, rules)).collect()
    want = [(i % 250, *brute(u)) for i, u in enumerate(urls)] + [(1, *brute(urls[1]))]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)
    assert url_rules.match_urls(pages.limit(0), url_rules.rule_table(spark, rules)).count() == 0
    assert {r.verdict for r in url_rules.match_urls(pages, url_rules.rule_table(spark, rules).limit(0)).collect()} == {"allow"}


# 4 decontamination


def edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    r = random.Random(3)
    items = [(i, prose(r.randint(6, 20), 900 + i)) for i in range(12)] + [(50, None), (51, ""), (52, "short")]

    def changed(t, n):
        t = list(t)
        for _ in range(n):
            at = r.randrange(len(t))
            t[at : at + r.choice((0, 1, 1))] = r.choice(("x", "y", "", "zz"))  # changed, put in or left out
        return "".join(t)

    rows = [(k, prose(20, k) + " " + changed(items[k % 12][1].upper(), k // 3) + ", " + prose(10, k + 1), "a") for k in range(40)]
    rows += [(100 + k, prose(60, 300 + k), "a") for k in range(20)]
    df = clashing(docs(spark, rows + [(d.doc_id, d.text, d.source) for d in odd(spark).collect()]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(m.doc_id, m.item_id): m.distance for m in decontam.matches(df, bench).collect()}
    want = {}
    for (k, t, _), (i, x) in itertools.product(rows, items[:12]):
        n, m = decontam.normal(t), decontam.normal(x)
        d = edits(m, n)
        if d <= len(m) // decontam.ERROR_PART:
            want[(k, i)] = d
    assert got == want and len(want) > 12
    clean = decontam.decontaminated(df, bench)
    assert clean.columns == df.columns and sorted(str(x.doc_id) for x in clean.collect()) == sorted(str(x) for x in [k for k, _, _ in rows if k not in {a for a, _ in want}] + [d.doc_id for d in odd(spark).collect()])
    assert decontam.matches(df, bench.limit(0)).count() == 0 and decontam.decontaminated(df.limit(0), bench).count() == 0
    assert len(list(decontam.blocks(bench, 300))) > 2


def test_decontamination_by_short_items(spark):
    items = [(1, "What is Pi?"), (2, "日本の首都は東京です"), (3, "42 km"), (4, "?!"), (5, ""), (6, None), (7, "x" * 24)]
    rows = [(1, "So: WHAT is pi, then?"), (2, "what is pivot"), (3, "それは日本の首都は東京ですと言う"), (4, "142 km, 42 kms"), (5, "142 km or 42\nkm"), (6, "what is po"), (7, "x" * 25), (8, "日本の首都は京都です"), (9, "what is pivot; what is pi"), (10, "?!")]
    df = docs(spark, [(i, t, "a") for i, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(m) for m in decontam.matches(df, bench).collect()) == [(1, 1, 0, 0, 13), (3, 2, 0, 0, 13), (5, 3, 0, 0, 15), (9, 1, 0, 0, 24)]
    assert sorted(r.doc_id for r in decontam.decontaminated(df, bench).collect()) == [2, 4, 6, 7, 8, 10]


# 5 nearest neighbours


def test_nearest(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(1500, 16))
    x[7] = x[0]  # a tie
    rows = [(i, [float(v) for v in r], "?") for i, r in enumerate(x)]
    rows += [(5000, None, "?"), (5050, [0.0] * 16, "?"), (5100, [float("nan")] * 16, "?"), (5150, [None] * 16, "?"), (5200, [1.0], "?"), (None, [1.0] * 16, "?"), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = 0
    for q in range(0, 1500, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[q, r.vec_id]) < 1e-9 for r in mine)
        best = sorted(range(1500), key=lambda i: (-s[q, i], i))[:5]
        hits += len({r.vec_id for r in mine} & set(best))
    assert len(got) == 150 and hits >= 0.95 * 150
    assert next(r for r in got if r.query_id == 0 and r.rank == 1).vec_id == 7
    junk = spark.createDataFrame([(9000 + i, [] if i % 2 else [float("nan")] * 3, "?") for i in range(40)], df.schema)
    assert ann.nearest(df.where("vec_id < 12").unionByName(junk), F.col("vec_id") % 10 == 0).count() == 10
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_in_small_blocks(spark, monkeypatch):
    """Queries in several blocks, codes and lookups in several chunks: the result is that of one of each."""
    g = np.random.default_rng(3)
    x = g.normal(size=(900, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    monkeypatch.setattr(ann, "QUERY_BYTES", 64 * 10)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 3)
    monkeypatch.setattr(ann, "CODE_CHUNK", 50)
    monkeypatch.setattr(ann, "SUM_ROWS", 16)
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert len(want) == 45 * 5 and [r[:3] for r in got] == [r[:3] for r in want]


def test_lookups_are_the_distances_of_sums():
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 12))
    books = ann.learn(x, levels=6, words=8)
    codes, norms = ann.encode(x, books)
    sums = np.array([sum(books[level][w] for level, w in enumerate(c)) for c in codes], float)
    assert np.allclose(norms, (sums**2).sum(1), atol=1e-4)
    assert ((x - sums) ** 2).sum() <= ((x - np.array([sum(books[level][w] for level, w in enumerate(c)) for c in ann.encode(x, books, beam=1)[0]])) ** 2).sum()
    got = ann.scores(codes, norms.astype(np.float32), x[:20].astype(np.float32), books)
    assert np.allclose(got, 2 * x[:20] @ sums.T - (sums**2).sum(1), atol=1e-3)


# 6 licenses


def license_spans(text, rows):
    """The rules of the scan, step by step."""
    words, out = licenses.words_of(text), []
    for i in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == i]
        base, label, m, k = mine[0][1], mine[0][2], mine[0][3], mine[0][4]
        votes = [(p, r[5]) for p in range(len(words) - k + 1) for r in mine if " ".join(words[p : p + k]) == r[6]]
        lines = {}
        for p, q in votes:
            lines.setdefault(p - q, []).append((p, q))
        if base:
            out += [(label, True, d) for d, v in lines.items() if len(v) == m - k + 1]
            continue
        least = licenses.MIN_VOTES if m - k + 1 >= 4 * licenses.MIN_VOTES else 1
        kept, spans = sorted(d for d, v in lines.items() if len(v) >= least), []
        for d in kept:
            if spans and d - spans[-1][-1] <= max(2, m // licenses.DRIFT):
                spans[-1].append(d)
            else:
                spans.append([d])

        def fits(ds):
            v = [x for d in ds for x in lines[d]]
            return len({q + j for _, q in v for j in range(k)}) >= licenses.MIN_COVER * m and max(p for p, _ in v) + k - min(p for p, _ in v) <= 2 * m

        for ds in spans:
            for group in [ds] if fits(ds) else [[d] for d in ds if fits([d])]:
                out.append((label, False, min(p for d in group for p, _ in lines[d])))
    return sorted(out)


BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"


def test_licenses(spark):
    text = "Released under the MIT License. GNU General Public License; gnu general public license mit-license cc by cc by nc"
    r = random.Random(21)
    wordings = [w for _, w in licenses.WORDINGS]
    mangled = []
    for n in range(60):
        w = licenses.words_of(r.choice(wordings))
        for _ in range(r.randint(0, len(w) // 8)):
            at = r.randrange(len(w))
            w[at : at + r.choice((0, 1))] = r.choice(([], [r.choice(w)], ["stray", "words"]))
        mangled.append(prose(r.randint(0, 30), n) + " " + " ".join(w) + (" " + r.choice(wordings)) * (n % 3))
    rows = [(1, text, "a"), (1, text, "a"), (2, BSD.replace("forms with", "forms are permitted with"), "a"), (3, "the mit and license", "a"), (4, None, "a"), (5, "", "a"), (None, "CC-BY", "a"), (6, prose(30_000, 1) + " apache license", "a"), (7, "ÉMIT license Kit", "a"), (8, BSD, "a"), (9, BSD.replace("use in", "use by you in").replace("permitted", "permitted to all"), "a")]
    rows += [(100 + i, t, "a") for i, t in enumerate(mangled)]
    grams = licenses.gram_rows(licenses.BASE, licenses.WORDINGS)
    every, spans = (x.collect() for x in licenses.scan(clashing(docs(spark, rows)).drop("row"), licenses.template_grams(spark, licenses.BASE, licenses.WORDINGS)))
    assert sum(x.copies for x in every) == len(rows)
    base = sorted((x.id, x.label, x.first_word) for x in spans if x.base and x.id == 1)
    assert base == [(1, "cc-by", 15), (1, "cc-by", 17), (1, "gpl", 5), (1, "gpl", 9), (1, "mit", 3), (1, "mit", 13)]
    for i, t, _ in rows:
        assert sorted((x.label, x.base, x.first_word) for x in spans if x.id == i) == license_spans(t or "", grams), i
        assert {x.n_words for x in every if x.id == i} == {len(licenses.words_of(t or ""))}
    assert all("bsd" in {x.label for x in spans if x.id == i} for i in (2, 8, 9)) and sum(not x.base and x.id is not None and x.id >= 100 for x in spans) > 40
    own = licenses.scan(docs(spark, rows), licenses.template_grams(spark, [], [("prose", prose(40, 1))], long_k=7), ks=(2, 7))[1].collect()
    assert [(x.id, x.label, x.first_word) for x in own] == [(6, "prose", 0)]
    assert licenses.scan(docs(spark, rows).limit(0), licenses.template_grams(spark, licenses.BASE, []))[0].count() == 0


# 7 near-duplicates


def shingle_sets(rows, k):
    out = {}
    for i, t, _ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def reachable(rows, k, percent):
    sets = shingle_sets(rows, k)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 20)  # so that families are dealt into blocks
    r = random.Random(9)
    rows = []
    for family in range(6):
        base = prose(120, 70 + family).split()
        for _ in range(40):
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(VOCABULARY)
            rows.append((len(rows) + 1, " ".join(t), "a"))
    shared = prose(60, 999)
    rows += [(1000 + i, prose(150, 2000 + i) + " " + shared, "a") for i in range(60)]
    rows += [(2000, "One two", "a"), (2001, "one  TWO", "a"), (2002, "one", "a"), (2003, "", "a"), (2004, None, "a"), (2005, "\t", "a"), (2006, rows[0][1], "a"), (2007, prose(30_000, 8), "a"), (2008, prose(30_000, 8) + " more", "a")]
    df = clashing(docs(spark, [*rows, rows[0], (None, rows[0][1], "a")]))
    got = near_dup.near_duplicates(df, k, percent).collect()
    want, sizes = reachable(rows, k, percent)
    assert len(got) == len(rows) + 2
    assert {g.id: (g.component_id, g.n_shingles) for g in got if g.id is not None} == {i: (want[i], sizes[i]) for i in want}
    assert all(g.kept == (g.id is None or g.id == g.component_id) for g in got)
    kept = near_dup.deduplicated(df, k, percent)
    assert kept.columns == df.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted([str(i) for i in want if want[i] == i] + ["None"])
    assert near_dup.near_duplicates(df.limit(0), k, percent).count() == 0


def test_a_large_family_costs_its_size(spark, monkeypatch):
    """Near copies of one text in many blocks: all but the outliers are linked by the hubs, and only outliers meet the blocks."""
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 100)
    r = random.Random(12)
    base = prose(200, 77).split()
    rows = []
    for i in range(2000):
        t = list(base)
        for _ in range(1 if i % 40 else 25):
            t[r.randrange(len(t))] = f"w{i}"
        rows.append((i + 1, " ".join(t), "a"))
    rows += [(5001, prose(50, 6), "a"), (5001, rows[5][1] + " end", "a")]  # one id, two texts
    scratch = Scratch(spark, "t")
    members = docs(spark, rows).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), F.lit(200).alias("n_shingles"), F.lit(1).alias("family"))
    texts = docs(spark, rows).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text")
    links = near_dup.confirmed_links(members, texts, 3, 85, scratch)
    got = {x.node: x.root for x in components.components(links, scratch).collect()}
    sets = shingle_sets(rows[:2000], 3)
    linked = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    near = [i for i in sets if (i - 1) % 40]
    assert {i for i in sets if got.get(i, i) == min(near)} >= set(near) and got[5001] == min(near)
    for i in set(sets) - set(near):
        assert (got.get(i, i) == min(near)) == any(linked(sets[i], sets[j]) for j in near)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)] + [(7, 7), (5, 6), (6, 5)]
    edges += [(3000, 3001 + i) for i in range(300)] + [(4999, 4000 + i) for i in range(300)]  # hubs: the least node, and the largest
    rows = [(a, b, "?") for a, b in [*edges, *edges[:50], (None, 5), (6, None)]]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(rows, "a long, b long, m string"), Scratch(spark, "t")).collect()}
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# 8 chat


def test_chat_round_trip(spark):
    nasty = "\\### assistant: </turn>\n#<:\\"
    rows = [(1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, "assistant", ""), (4, 0, None, "x"), (4, 0, "user", "tie"), (None, 0, "user", "n"), (5, 0, "user", "r"), (5, 0, "user", "r")]
    rows += [(6, i, "user" if i % 2 == 0 else "assistant", f"#{i}") for i in range(3000)] + [(7, 0, "user", "#<:\\x " * 200_000), (7, 1, "assistant", prose(30_000, 2)), (8, None, "user", "no turn"), (8, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, "?") for r in rows], "conv_id long, turn long, role string, text string, state string")
    segments = chat.format_chats(df)
    t = chat.Template()
    got = {r.conv_id: r for r in chat.digest_chats(segments).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((-1 if n is None else n, role or "", x or "") for c, n, role, x in rows if c == conv))
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        learned = "".join(b for _, a, b in mine if a == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(t.opening[0] + t.escaped(a) + t.opening[1] + t.escaped(b) + t.closing) for _, a, b in mine)
    assert {c: got[c].valid for c in range(1, 9)} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: True, 8: True}
    assert t.unescaped(t.escaped(nasty)) == nasty and "###" not in t.escaped(nasty).replace("\\#", "")
    assert chat.digest_chats(chat.format_chats(df.limit(0))).count() == 0


# 9 shards


def test_shards(spark):
    rows = [(i, f"unique {i}", "a") for i in range(1500)] + [(10_000 + i, f"copy {i % 90}", "a") for i in range(360)] + [(20_000 + i, "one huge group", "a") for i in range(700)]
    rows += [(25_000 + i, f"most of a shard {i % 3}", "a") for i in range(240)]
    rows += [(30_000, None, "a"), (30_001, None, "a"), (30_002, "", "a"), (None, "x", "a"), (None, "x", "a"), (30_003, prose(30_000, 5), "a")]
    df = docs(spark, rows)
    out = sharding.shard_linked(clashing(df)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert len(sizes) == 24 and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    text = {i: t for i, t, _ in rows if i is not None}
    assert all((r.size, r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 8, zlib.crc32((text[r.doc_id] or "").encode())) for r in out if r.doc_id is not None)
    where = {}
    for r in out:
        if r.doc_id is not None and text[r.doc_id]:
            where.setdefault(text[r.doc_id], set()).add(r.shard)
    whole = len(rows) // 24
    assert all(len(s) == 1 for t, s in where.items() if t != "one huge group") and len(where["one huge group"]) == -(-700 // whole)
    ids = df.where("doc_id is not null")
    report = sharding.cut_report(ids, sharding.shard_linked(ids)).first()
    assert (report.groups, report.cut_groups) == (94, 1) and report.cut_rows == 700 - len(ids.collect()) // 24
    assert all((r.size, r.text_crc32) == (8, 0) for r in out if r.doc_id in (30_000, 30_001, 30_002))
    assert sharding.shard_linked(df.limit(0)).count() == 0
    assert sorted(map(str, sharding.shard_linked(df).collect())) == sorted(map(str, sharding.shard_linked(df).collect()))


def test_shards_without_room(spark):
    """A group that fits one shard stays whole; with groups alone, at most one is cut at each boundary and none is lost."""
    seven = [(i, f"unique {i}", "a") for i in range(233)] + [(500 + i, "seven", "a") for i in range(7)]
    out = {r.doc_id: r.shard for r in sharding.shard_linked(docs(spark, seven)).collect()}
    assert len(out) == 240 and len({out[500 + i] for i in range(7)}) == 1
    groups = [(i, f"group {i // 6}", "a") for i in range(480)]
    out = {r.doc_id: r.shard for r in sharding.shard_linked(docs(spark, groups), n_shards=5).collect()}
    cut = sum(len({out[6 * g + k] for k in range(6)}) > 1 for g in range(80))
    assert sorted(Counter(out.values()).values()) == [96] * 5 and cut <= 4
    few = {r.doc_id: r.shard for r in sharding.shard_linked(docs(spark, [(1, "x", "a"), (2, "x", "a"), (3, None, "a")])).collect()}
    assert len(set(few.values())) == 3


# 10 mixing


def test_mixing(spark):
    r = random.Random(6)
    rows = [(i, prose(r.randint(1, 60), i), s) for i, s in enumerate(["a"] * 2000 + ["b"] * 300 + ["c"] * 40 + [None] * 100)]
    rows += [(9000, None, "a"), (9001, "", "b"), (9002, "x", "d"), (9002, "x", "d"), (9003, prose(30_000, 3), "a"), (9004, prose(1500, 4), "c")]
    df = clashing(docs(spark, rows))
    nameless = docs(spark, [*rows, (None, "one two", "a"), (None, "one two", "a"), (None, None, None)])
    assert mixing.mixed(nameless).count() == sum(x.copies for x in mixing.plan(nameless).collect())
    p = mixing.plan(df).collect()
    assert len(p) == len(rows) and all(0 <= r.copies <= 2 for r in p)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + words(t)
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(total.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    source = {i: s for i, _, s in rows}
    taken = {}
    for x in p:
        s = source[x.doc_id]
        assert x.source_size == total[s] and abs(x.target - target[s]) < 1e-6
        taken[s] = taken.get(s, 0) + x.size * x.copies
    assert all(abs(taken[s] - target[s]) <= 1 + target[s] / mixing.LARGE_PART for s in order if s != "d")
    whole = mixing.mixed(df)
    assert whole.columns == df.columns and whole.count() == sum(x.copies for x in p)
    assert sorted(map(str, p)) == sorted(map(str, mixing.plan(df).collect()))
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_mixing_takes_the_same_documents_at_every_size(spark, tmp_path, monkeypatch):
    """Against the registered SQL: a group of equal texts above SLICE_ROWS, classes of several sizes, a null source."""
    text = F.expr("case when id < 21000 then 'same' else repeat('w ', cast(2 + id * id % 90 as int)) end")
    df = spark.range(27_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.expr("case when id < 25000 then 'a' when id < 26000 then 'b' end").alias("source"))
    df.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = {i: taken // size for i, size, taken in con.sql(f"select doc_id, size, taken from ({mixing.OP10_SQL})").fetchall()}
    df = spark.read.parquet(f"{tmp_path}/documents")

    def check():
        assert {r.doc_id: r.copies for r in mixing.plan(df).collect()} == want
        assert Counter(r.doc_id for r in mixing.mixed(df).select("doc_id").collect()) == Counter(want)

    check()
    monkeypatch.setattr(mixing, "SLICE_ROWS", 50)
    monkeypatch.setattr(mixing, "WHOLE_ROWS", 7)
    check()


def test_kernels_need_no_package_on_executors(tmp_path):
    """What is pickled for the workers loads and runs in a process that can't import the package."""
    import os
    import subprocess
    import sys

    import pyarrow as pa
    from pyspark import cloudpickle

    def kernel():
        text = "card 4111 1111 1111 1111, born 1990-12-31 or 5/6/1990, mail Ann.Lee@example.org, call +44 20 7183 8750, GB82 WEST 1234 5698 7654 32"
        f = pii.Feistel("k")
        new, counts = pii.pseudonymise(text, f)
        turns = pa.RecordBatch.from_pydict({"conv_id": [1], "role": ["user"], "text": ["#"]})
        x = np.random.default_rng(0).normal(size=(64, 4))
        books = ann.learn(x, levels=2, words=4, iterations=2)
        codes, norms = ann.encode(x, books)
        return [
            pii.pseudonymise(new, f, inverse=True)[0] == text and sum(counts.values()),
            len(decontam.Matcher([(1, decontam.normal(text))])(text)),
            near_dup.linked_stars([1, 2], [near_dup.Shingles(3)(text)] * 2, np.zeros(2), 80),
            len(near_dup.Signer(*near_dup.banding(0.8))(near_dup.Shingles(5)(text))[1]),
            quality._score(quality.train([text, "b"], [1, 0], 1 << 8).table()[0], 0.0, quality.Hasher(1 << 8), text) >= 0,
            [b.num_rows for b in chat._digest(chat._emit(iter([turns]), chat.Template()), chat.Template())],
            ann.scores(codes, norms, x[:3].astype(np.float32), books).shape,
        ]

    (tmp_path / "kernel").write_bytes(cloudpickle.dumps(kernel))
    program = "import importlib.util, pickle; assert importlib.util.find_spec('tesserae') is None; print(pickle.load(open('kernel', 'rb'))())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == str(kernel()) and kernel()[0] == 6
