r"""Operator 8: chat formatting by a finite-state machine over roles and a declarative template.

A conversation's turns become text segments with a loss flag each: the turn's opening marker, its text, its
closing marker. The machine says whether the roles' order is valid; invalid conversations are formatted all
the same and say so. In texts and roles, the escape character and every character that begins a control
string get the escape character before them, so no control string can arise inside a text or across its
end, and taking the escapes out gives the text back.

Scale: rows are dealt by conversation and sorted within the partition; the formatter streams over them and
holds one batch and the machine's state, never a whole conversation, so a huge one needs no more memory.
The digest is a stream of its own over the emitted segments. It reads only those.

Defined cases: a null text or role is empty; a null turn comes first; rows of one turn number follow by role,
then text; empty and very long texts and conversations of very many turns are formatted whole; a null conv_id
is a conversation; repeated rows are turns of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """opening is split at {role}; loss_roles: whose texts are learned; turns: (state, role) -> state; final states."""

    opening: tuple[str, str] = ("### ", ": ")
    closing: str = " </turn>\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    turns: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"),
        ("start", "user", "asked"),
        ("told", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = ("answered",)
    #: First characters of control strings; the space of the closing marker is literal, its "<" is the mark.
    marks: str = field(default="#<:")

    def escaped(self, text: str) -> str:
        return re.sub("([" + re.escape(self.escape + self.marks) + "])", lambda m: self.escape + m[1], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)


SEGMENTS = "conv_id long, turn_at long, part string, segment string, loss boolean, state string, valid boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _emit(batches: Iterator[pa.RecordBatch], t: Template) -> Iterator[pa.RecordBatch]:
    steps = {(a, r): b for a, r, b in t.turns}
    conv, state, at = object(), t.start, 0
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "turn_at", "part", "segment", "loss", "state", "valid")}
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv_id != conv:
                conv, state, at = conv_id, t.start, 0
            state = steps.get((state, role), "invalid")
            loss = role in t.loss_roles
            for part, segment, flag in (("open", t.opening[0] + t.escaped(role) + t.opening[1], False), ("text", t.escaped(text), loss), ("close", t.closing, False)):
                for k, v in zip(out, (conv_id, at, part, segment, flag, state, state in t.final), strict=True):
                    out[k].append(v)
            at += 1
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("turn_at", pa.int64()), ("part", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("state", pa.string()), ("valid", pa.bool_())]))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments in order within each partition; a conversation never spans partitions.

    valid is that of the conversation up to and with this turn; its last turn's is the conversation's.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(lambda batches: _emit(batches, template), SEGMENTS)


def _digest(batches: Iterator[pa.RecordBatch], t: Template) -> Iterator[pa.RecordBatch]:
    """Reads formatted text back: the marker gives the role, the escapes go, the loss flags choose what is learned."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
    done: list[tuple] = []
    conv, open_ = None, False
    n = loss_n = chars = 0
    all_, loss, valid = hashlib.sha256(), hashlib.sha256(), True
    for batch in batches:
        for conv_id, part, segment, flag, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "segment", "loss", "valid")), strict=True):
            if not open_ or conv_id != conv:
                if open_:
                    done.append((conv, n, all_.hexdigest(), loss_n, loss.hexdigest(), chars, valid))
                conv, open_, n, loss_n, chars, all_, loss, valid = conv_id, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), True
            chars += len(segment)
            valid = ok
            if part == "open":
                n += 1
                role = t.unescaped(segment[len(t.opening[0]) : len(segment) - len(t.opening[1])])
                all_.update((role + "\n").encode())
            elif part == "text":
                text = t.unescaped(segment)
                all_.update((text + "\n").encode())
                if flag:
                    loss_n += len(text)
                    loss.update(text.encode())
        if done:
            yield _digests(done, names)
            done = []
    if open_:
        yield _digests([(conv, n, all_.hexdigest(), loss_n, loss.hexdigest(), chars, valid)], names)


def _digests(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def digest_chats(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per conversation, read back from the segments of format_chats (its partitions as they are)."""
    return segments.mapInArrow(lambda batches: _digest(batches, template), DIGEST)


PLANTED = r"\### Assistant: </turn> ok"


def op8_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], turns.schema)
    return digest_chats(format_chats(turns.unionByName(extra)))


OP8_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s as (select *, lag(role) over w as before, row_number() over w as n, lead(role) over w is null as is_last from c window w as (partition by conv_id order by turn nulls first, role, text)),
v as (select conv_id, bool_and(case when n = 1 then role in ('system', 'user') when role = 'user' then before in ('assistant', 'system') and (before = 'assistant' or n = 2)
   when role = 'assistant' then before = 'user' else false end) and max(case when is_last then role end) = 'assistant' as valid from s group by conv_id)
select c.conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 2 + length(regexp_replace(text, '([\\#<:])', '\\\1', 'g')) + 9)::bigint as formatted_chars,
  any_value(v.valid) as valid
from c join v on c.conv_id is not distinct from v.conv_id group by c.conv_id
"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
