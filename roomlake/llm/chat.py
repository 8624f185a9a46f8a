"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of
one role are merged by an array aggregation, and the blocks are concatenated.
Inside a block the merged turns stay apart by a marker, so that the formatted
string gives every turn back.

Texts are escaped reversibly: a backslash goes behind the first character of
every control string, and of every control string escaped before.

A conversation is one output string; its turns are therefore gathered in one
row, which is as large as the output itself.

Defined cases
-------------
null text         an empty text
null role         an empty role
null turn         comes before the numbered turns
equal turns       by role, then text; repeated rows are kept
null conv_id      a conversation of its own
empty table       no conversation
other columns     of the input are ignored
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers of blocks and the strings that texts must not bring in."""

    open: str = "<|turn|>"
    more: str = "<|more|>"
    close: str = "<|end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    #: Control strings of common chat templates, besides the markers.
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.open, self.more, self.close.rstrip("\n"), *self.reserved)))

    def __post_init__(self):
        for inner in self.controls:
            if len(inner) < 2 or "\\" in inner or any(inner in outer[1:] for outer in self.controls):
                raise ValueError(f"{inner!r} can't be escaped reversibly")

    @property
    def _parts(self) -> tuple[str, str]:
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return f"([{heads}])", "(" + "|".join(re.escape(c[1:]) for c in self.controls) + ")"

    def escape(self, text: Column) -> Column:
        head, rest = self._parts
        return F.regexp_replace(text, head + r"(\\*)" + rest, r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        head, rest = self._parts
        return F.regexp_replace(text, head + r"\\(\\*)" + rest, r"$1$2$3")


def _literal(text: str) -> str:
    return re.escape(text)


def format_conversations(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, formatted, loss_spans: where in ``formatted`` (code points, from 0) each trained turn's text stands."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    gathered = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))

    one = lambda t: F.array(F.struct(t["role"].alias("role"), F.array(template.escape(t["text"])).alias("parts")))

    def merge(blocks, t):
        last = F.element_at(blocks, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["parts"], F.array(template.escape(t["text"]))).alias("parts"))
        return F.when((F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == t["role"]), F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))).otherwise(F.concat(blocks, one(t)))

    empty = F.expr("cast(array() as array<struct<role:string,parts:array<string>>>)")
    blocks = F.aggregate("turns", empty, merge)

    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(block):
        trained = block["role"].isin(*template.trained)
        texts = F.transform(block["parts"], lambda part, k: F.array(piece(F.when(k > 0, template.more).otherwise(""), F.lit(False)), piece(part, trained)))
        start = piece(F.concat(F.lit(template.open), F.url_encode(block["role"]), F.lit("\n")), F.lit(False))
        return F.concat(F.array(start), F.flatten(texts), F.array(piece(F.lit(template.close), F.lit(False))))

    def spans(acc, p):
        end = acc["at"] + F.length(p["text"])
        here = F.array(F.struct(acc["at"].alias("start"), F.length(p["text"]).alias("length")))
        return F.struct(end.alias("at"), F.when(p["loss"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    origin = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>))")
    return (
        gathered.select("conv_id", F.flatten(F.transform(blocks, pieces)).alias("pieces"))
        .select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), F.aggregate("pieces", origin, spans)["spans"].alias("loss_spans"))
    )


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """array<struct<role, text>> of the turns that ``formatted`` holds."""

    def block(segment):
        role = F.substring_index(segment, "\n", 1)
        body = F.substring(segment, F.length(role) + 2, F.length(segment) - F.length(role) - 1 - len(template.close))
        return F.transform(F.split(body, _literal(template.more)), lambda part: F.struct(F.url_decode(role).alias("role"), template.unescape(part).alias("text")))

    segments = F.split(formatted, _literal(template.open))
    return F.flatten(F.transform(F.slice(segments, 2, F.size(segments)), block))


def read_trained(formatted: Column, loss_spans: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: template.unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
