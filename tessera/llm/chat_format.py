"""Chat formatting by event-sourced reconstruction.

A log holds events of a conversation in sequence: a message starts a turn, deltas add to it, an edit
replaces its text, a regeneration starts it anew and a deletion takes it out. Logs are partitioned by
conversation, sorted by sequence and folded in one streaming pass; final turns are rendered with
marks, and what would read as a mark within a text is escaped so that reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"

KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    """No mark can stand in the result: each `<`, backslashes, `|` gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


_ROLE = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
_ROLE_BACK = {v: k for k, v in _ROLE.items()}


def render(turns: list[tuple[str, str]]) -> str:
    """Turns of (role, text), each as start mark, role, line feed, text, end mark, line feed; a role is one line without marks."""
    return "".join(f"{START}{''.join(_ROLE.get(c, c) for c in role)}\n{escape(text)}{END}\n" for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, read from the rendered form; start and end bound the escaped text."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        stop = formatted.index(END, line)
        role = re.sub(r"\\.", lambda m: _ROLE_BACK[m[0]], formatted[at + len(START) : line])
        turns.append((role, unescape(formatted[line + 1 : stop]), line + 1, stop))
        at = stop + len(END) + 1
    return turns


class Fold:
    """The final turns of one conversation from its events in order."""

    def __init__(self):
        self.turns: dict[object, list] = {}  # by message: role and parts

    def add(self, message: object, kind: str, role: str, text: str) -> None:
        turn = self.turns.get(message)
        if kind == "delete":
            self.turns.pop(message, None)
        elif turn is None:  # whatever names an unknown message starts it
            self.turns[message] = [role, [text]]
        elif kind == "delta":
            turn[1].append(text)
        elif kind == "regenerate":
            turn[:] = [role or turn[0], [text]]
        elif kind == "edit":
            turn[1] = [text]
        else:  # a message said again in full
            turn[:] = [role, [text]]

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.turns.values()]


def format_chats(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """Rendered conversations of events(conv_id, seq, message, kind, role, text).

    Returns conv_id, formatted, loss_spans (start and end, in code points, of each trained text as it
    stands in formatted) and n_turns, a row a conversation. Events sort by seq, null first, then by
    kind, role, text and message; a repeated event is a fact of the log and folds twice. Null texts and
    roles are empty, a null kind is a message, an unknown one too; a null conv_id is a conversation of
    its own. Conversations without turns at the end give an empty text. One conversation is one row of
    the result and is folded by one task, which holds its turns and no other's.
    """
    spark = events.sparkSession
    small_batches(spark)
    order = ["conv_id", "seq", "kind", "role", "text", "message"]
    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = events.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), F.col("message").cast("string"), F.coalesce(F.col("kind"), F.lit("message")).alias("kind"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = kept.repartition(size, "conv_id").sortWithinPartitions(*order)
    kind = "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>, n_turns long"
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_turns", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        weight, conv, fold = 0, None, None

        def finish() -> int:
            turns = fold.final()
            formatted, spans, at = render(turns), [], 0
            for role, _, start, end in parse(formatted):
                if role == trained:
                    spans.append({"start": start, "end": end})
            done.append({"conv_id": conv, "formatted": formatted, "loss_spans": spans, "n_turns": len(turns)})
            return len(formatted)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for c, _, message, what, role, text in zip(*columns, strict=True):
                if fold is None or c != conv:
                    if fold is not None:
                        weight += finish()
                    conv, fold = c, Fold()
                fold.add(message, what, role, text)
            if weight > 4 << 20:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, weight = [], 0
        if fold is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return dealt.mapInArrow(work, kind)


def digests(formatted: DataFrame) -> DataFrame:
    """What format_chats holds, read back from its text: digests of turns and of the trained texts.

    A row for each of formatted; a conversation without turns, and one without trained texts, has the digest of nothing. Null ids
    and repeated rows are kept, other columns are ignored, an empty table gives an empty table.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                whole = hashlib.sha256()
                for role, said, _, _ in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((conv, len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    small_batches(formatted.sparkSession)
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
