"""Chat formatting: conversations rendered by a compiled template, with the spans a model is to be trained on."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches
from .template import Template

# The strings that mark turns, and the character that keeps them out of texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>")
GUARD = "\\"
#: Each turn: its role, its text, an end. A guard goes after the first character of a control string in a text, and before a guard.
TEMPLATE = (
    "{% for turn in turns %}<|turn|>{{ turn.role | escape }}<|text|>"
    '{% if turn.role == "assistant" %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}'
    "<|end|>{% endfor %}"
)
_NEEDS = re.compile("|".join(map(re.escape, [GUARD, *sorted(CONTROL, key=len, reverse=True)])))
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str | None) -> str:
    return _NEEDS.sub(lambda m: GUARD * 2 if m[0] == GUARD else m[0][0] + GUARD + m[0][1:], text or "")


def unescape(text: str) -> str:
    """What escape() was given: `\\\\\\\\` is a guard that was there, a guard after < or [ is one that was put."""
    out, i = [], 0
    while True:
        j = text.find(GUARD, i)
        if j < 0:
            return "".join([*out, text[i:]])
        if text.startswith(GUARD * 2, j):
            out.append(text[i : j + 1])
            i = j + 2
        else:
            out.append(text[i:j])
            i = j + 1


@lru_cache(8)
def compiled(source: str) -> Template:
    return Template(source, {"escape": escape})


def read_back(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns of a formatted conversation, and all text under the loss mask, unescaped."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)], "".join(unescape(text[s:e]) for s, e in spans)


def _rendered(batches: Iterator[pa.RecordBatch], source: str, digest: bool) -> Iterator[pa.RecordBatch]:
    """Turns come sorted by conversation and turn."""
    template = compiled(source)
    turns: list[dict] = []
    mine: tuple = ()

    def row():
        text, spans = template.render(turns=turns)
        if not digest:
            return (mine[0], len(turns), text, [{"s": s, "e": e} for s, e in spans])
        back, loss = read_back(text, spans)
        told = "".join(f"{r}\n{t}\n" for r, t in back)
        return (mine[0], len(back), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] if digest else [pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]

    def batch(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([kind, *types])], names=[str(i) for i in range(len(types) + 1)])

    kind = pa.int64()
    out: list[tuple] = []
    for b in batches:
        kind = b.schema.field(0).type
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 2))):
            if turns and mine != (conv,):
                out.append(row())
                turns = []
            mine = (conv,)
            turns.append({"role": role or "", "text": text or ""})
        if out:
            yield batch(out, kind)
            out = []
    if turns:
        yield batch([row()], kind)


def _run(df: DataFrame, source: str, conv: str, turn: str, role: str, text: str, digest: bool, schema: str) -> DataFrame:
    short_batches(df.sparkSession)
    rows = df.select(F.col(conv).alias("conv"), F.col(role).alias("role"), F.col(text).alias("text"), F.col(turn).alias("turn"))
    kind = dict(df.dtypes)[conv]
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(partial(_rendered, source=source, digest=digest), f"conv {kind}, {schema}")


def format_conversations(df: DataFrame, source: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (array of s, e in code points of `formatted`): one row per conversation.

    Turns are ordered by turn, then role and text, nulls first; null texts and roles are empty; repeated turns stay; rows with a
    null id form one conversation; other columns are ignored. A task holds one conversation at a time, however many turns the
    others have. An empty table gives an empty one.
    """
    return _run(df, source, conv, turn, role, text, False, "n_turns long, formatted string, loss_spans array<struct<s:bigint,e:bigint>>").withColumnRenamed("conv", conv)


def conversation_digests(df: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    return _run(df, source, "conv_id", "turn", "role", "text", True, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", "conv_id")
