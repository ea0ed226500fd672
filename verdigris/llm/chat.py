"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are
rendered and consecutive outputs compared: if an output begins with the one before it, what was added is the new
turn's span. Within a span the text is found without knowing the template, by rendering the turn with two
different probe texts: what the two spans share at their start and end is the turn's frame. If some output does not
begin with the one before it, the template rewrites history; the spans are then found in the final output alone, by
probing each turn there, and the conversation is flagged.

ChatTemplate is the template of the registered query. It marks turns with control strings and escapes those that
occur inside roles and texts, reversibly, so its output can be parsed back into the turns.

Conversations are brought together by their identifier and sorted by turn (then role and text) on the way; a task
holds one conversation at a time. Cases: null text and role count as empty; null turns come first; rows repeated in
full stay repeated; a null identifier is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import map_batches, partitions

Turns = list[tuple[str, str]]
START, END = "<|im_start|>", "<|im_end|>"
SCHEMA = "conv_id long, formatted string, spans array<struct<role:string,start:int,end:int>>, rewrites_history boolean"
PROBES = "0", "1"


class ChatTemplate:
    """<|im_start|>role\\ntext<|im_end|>\\n for each turn."""

    turn = re.compile(re.escape(START) + r"((?:[^\n\\]|\\.)*)\n(.*?)" + re.escape(END) + r"\n", re.S)

    def escape(self, text: str) -> str:
        return text.replace("\\", "\\\\").replace("<|", "<\\|")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)

    def __call__(self, turns: Turns) -> str:
        return "".join([f"{START}{self.escape(role).replace(chr(10), chr(92) + 'n')}\n{self.escape(text)}{END}\n" for role, text in turns])

    def parse(self, formatted: str) -> Turns:
        return [(self.unescape(role), self.unescape(text)) for role, text in self.turn.findall(formatted)]


def common_prefix(a: str, b: str) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def frame(one: str, other: str) -> tuple[int, int]:
    """Lengths of what two renderings that differ in one probe text share at their start and end."""
    start = common_prefix(one, other)
    return start, common_prefix(one[start:][::-1], other[start:][::-1])


def locate(template: Callable[[Turns], str], turns: Turns) -> tuple[str, list[tuple[int, int]], bool]:
    """The rendering of turns, the span of each text in it, and whether the template rewrites history."""
    spans, before, rewrites = [], template([]), False
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            rewrites = True
            break
        probes = [template([*turns[:k], (role, probe)]) for probe in PROBES]
        start, end = frame(*(p[len(before) :] for p in probes))
        spans.append((len(before) + start, len(now) - end))
        before = now
    if rewrites:
        final, spans = template(turns), []
        for k, (role, _) in enumerate(turns):
            start, end = frame(*(template([*turns[:k], (role, probe), *turns[k + 1 :]]) for probe in PROBES))
            spans.append((start, len(final) - end))
        return final, spans, True
    return before, spans, False


KINDS = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("rewrites_history", pa.bool_())])


def format_conversations(conversations: DataFrame, template: Callable[[Turns], str] | None = None) -> DataFrame:
    """conv_id, formatted text, the span of every turn's text with its role, whether the template rewrites history."""
    render = template or ChatTemplate()
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    together = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        def done(conv, turns):
            formatted, spans, rewrites = locate(render, turns)
            return {"conv_id": conv, "formatted": formatted, "spans": [{"role": r, "start": s, "end": e} for (r, _), (s, e) in zip(turns, spans, strict=True)], "rewrites_history": rewrites}

        own, turns, out = None, [], []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if turns and conv != own:
                    out.append(done(own, turns))
                    turns = []
                own = conv
                turns.append((role, text))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=KINDS)
                out = []
        if turns:
            yield pa.RecordBatch.from_pylist([done(own, turns)], schema=KINDS)

    return map_batches(together.select("conv_id", "role", "text"), run, SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask (assistant spans), from the formatted output alone."""
    template = ChatTemplate()

    def run(batches):
        for batch in batches:
            out = []
            for conv, text, spans, rewrites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = template.parse(text)
                loss = "".join([template.unescape(text[x["start"] : x["end"]]) for x in spans if x["role"] == "assistant"])
                digest = hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in turns]).encode()).hexdigest()
                out.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), rewrites))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return map_batches(formatted, run, DIGEST)
