"""Operator 4: benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with every run of ASCII signs and spaces as one space. An item of m
characters may be altered by k = m // ERROR_PART edits. It is split into k + 1 pieces; k edits can't touch all
of them, so any copy within the budget has one piece unaltered. One Aho-Corasick pass over the text finds all
pieces; each hit names a window, and Myers' bit-parallel search finds the least edit distance in it, unless the
window lacks more of the item's short grams than the budget's edits could spoil. Items under MIN_CHARS
characters have no edits and must stand between word bounds; in scripts without spaces any place is one.

Scale: one narrow pass over the documents, no shuffle; per document only hits are held. Items reach the
executors in blocks of at most BLOCK_CHARS characters, however large the benchmark; more blocks are more passes.

Defined cases: null and empty texts match nothing; null items and items of ASCII signs and spaces alone are not
searched; items alike but for case and signs are each reported; repeated documents are each reported; an empty table on either side gives no matches; other columns, whatever their names, pass
through `decontaminated` and are ignored by `matches`.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: One edit is allowed for so many characters.
ERROR_PART = 12
#: An edit spoils at most so many of an item's grams of that length; windows that lack more aren't measured.
GRAM = 5
#: Shorter items are searched without edits, at word bounds.
MIN_CHARS = 25
#: Thai, Lao, Tibetan, Burmese, Khmer, kana and ideographs: words aren't set apart.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
BLOCK_CHARS = 2_000_000
_SIGNS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str) -> str:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SIGNS).split()).decode()


def is_bound(text: str, at: int) -> bool:
    """Whether no word goes on across the place."""
    pair = text[at - 1 : at + 1] if at else ""
    return len(pair) < 2 or not (pair[0].isalnum() and pair[1].isalnum()) or bool(UNSPACED.search(pair))


def myers(pattern_bits: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring, end of the first substring with it); most + 1 if above."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, most + 1, -1
    get = pattern_bits.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, len(t) // ERROR_PART if len(t) >= MIN_CHARS else 0) for i, t in items]
        self.bits: dict[int, dict[str, int]] = {}
        self.grams: dict[int, Counter] = {}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[t[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for p, places in pieces.items():
            self.automaton.add_word(p, (len(p), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def _bits(self, n: int) -> dict[str, int]:
        if n not in self.bits:
            out: dict[str, int] = {}
            for i, c in enumerate(self.items[n][1]):
                out[c] = out.get(c, 0) | (1 << i)
            self.bits[n] = out
        return self.bits[n]

    def _lacks(self, n: int, window: str) -> int:
        """How many of the item's grams the window doesn't have."""
        if n not in self.grams:
            item = self.items[n][1]
            self.grams[n] = Counter(item[i : i + GRAM] for i in range(len(item) - GRAM + 1))
        own = self.grams[n]
        there = own.keys() & {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
        return sum(own.values()) - sum(own[g] for g in there)

    def __call__(self, text: str, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, budget, end in the normal text) of the best match of each item."""
        if self.empty or not text:
            return []
        t = normal(text)
        hits: dict[int, set[int]] = defaultdict(set)
        for end, (length, places) in self.automaton.iter(t):
            for n, offset in places:
                hits[n].add(end + 1 - length - offset)
        found = []
        for n, starts in hits.items():
            item_id, item, k = self.items[n]
            best, end = k + 1, -1
            ordered = sorted(starts)
            if not k:
                ends = (s + len(item) for s in ordered if is_bound(t, s) and is_bound(t, s + len(item)))
                if (end := next(ends, -1)) < 0:
                    continue
                found.append((item_id, 0, 0, end))
                if first_only:
                    break
                continue
            a = b = ordered[0]
            for s in [*ordered[1:], None]:
                # windows of near starts are one
                if s is not None and s - b <= 2 * k:
                    b = s
                    continue
                left = max(0, a - k)
                window = t[left : b + len(item) + k]
                at = window.find(item)
                if at >= 0:
                    best, end = 0, left + at + len(item)
                elif self._lacks(n, window) <= (best - 1) * GRAM:
                    got = myers(self._bits(n), len(item), window, best - 1)
                    if got[0] < best:
                        best, end = got[0], left + got[1]
                if not best:
                    break
                a = b = s
            if best <= k:
                found.append((item_id, best, k, end))
                if first_only:
                    break
        return found


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items as normal texts, in blocks that the driver and each executor can hold."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for i in range(n):
        mine = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted({(r[0], x) for r in mine.toLocalIterator() if (x := normal(r[1]))}, key=lambda r: (r[0] is None, r))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, distance, budget, end_at) for each document and item within its budget; clean documents have no row."""
    schema = f"{id_col} long, item_id long, distance int, budget int, end_at int"
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                got = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher(t or "")]
                columns = zip(*got, strict=True) if got else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[id_col, "item_id", "distance", "budget", "end_at"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that hold an item."""
    schema = docs.schema
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=schema.fieldNames().index(text_col)) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not matcher(t or "", first_only=True) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
