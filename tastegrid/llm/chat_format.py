"""Prefix-target examples from conversations: one example per assistant turn, with all turns before it as context.

Template: ``<turn>`` role, line end, text, line end, ``</turn>``, line end. A control string inside a text, after any
number of backslashes, gets one backslash more, and reading takes one away, so every text comes back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<turn>", "</turn>"
TRAINED_ROLE = "assistant"

_CONTROL = re.compile(r"(\\*)(</?turn>)")
_ESCAPED = re.compile(r"\\(\\*</?turn>)")
_TURN = re.compile(r"<turn>([^\n]*)\n(.*?)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text) if "turn>" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "turn>" in text else text


def escape_role(role: str) -> str:
    """A role on one line: backslashes and line ends coded, then escaped as a text."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}\n{escape(text)}\n{CLOSE}\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example; an error if anything lies between the turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        while m and _unescaped(m[2]):  # a close mark that belongs to the text is escaped, so this never happens in a valid example
            raise ValueError("unescaped control string in a text")
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _unescaped(text: str) -> bool:
    return any(not m[1] for m in _CONTROL.finditer(text))


def _examples(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From turns sorted by conversation and turn: conversation, example, text, start and end of the trained part."""
    conv, parts, length, k, open_turns = None, [], 0, 0, False
    first = True
    for c, role, text in rows:
        if first or c != conv:
            if open_turns:
                yield conv, k, "".join(parts), length, length
            conv, parts, length, k, open_turns, first = c, [], 0, 0, False, False
        role, text = role or "", text or ""
        turn = format_turn(role, text)
        parts.append(turn)
        if role == TRAINED_ROLE:
            start = length + len(OPEN) + len(escape_role(role)) + 1
            prefix = "".join(parts)
            parts = [prefix]  # one string grows, so the next example copies it once
            yield conv, k, prefix, start, start + len(escape(text))
            k, open_turns = k + 1, False
        else:
            open_turns = True
        length += len(turn)
    if open_turns:
        yield conv, k, "".join(parts), length, length


EXAMPLE = "conv_id {id}, example long, text string, loss_start long, loss_end long"
#: Characters of examples that a task holds before it passes them on.
BATCH_CHARS = 4_000_000


def expand(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example, text, loss_start, loss_end`` (code points, end exclusive).

    ``conversations`` has ``conv_id, turn, role, text``; further columns are ignored. Null texts and roles count as empty;
    a null conversation id is a conversation of its own; null turns come first; turns with equal numbers are ordered by
    role and text, repeated rows stay. Turns after the last reply form one more example with an empty trained part, so
    that no turn is lost. A task streams its sorted turns and holds one conversation's text and a bounded batch of
    examples.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        held, chars = [], 0
        for e in _examples(rows):
            held.append(e)
            chars += len(e[2])
            if chars > BATCH_CHARS:
                yield _batch(held, ids)
                held, chars = [], 0
        if held:
            yield _batch(held, ids)

    ids = pa.int64() if kind == "bigint" else None
    return dealt.mapInArrow(run, EXAMPLE.format(id=kind))


def _batch(rows: list[tuple], ids: pa.DataType | None) -> pa.RecordBatch:
    conv, example, text, start, end = zip(*rows)
    arrays = [pa.array(conv, ids), pa.array(example, pa.int64()), pa.array(text, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "example", "text", "loss_start", "loss_end"])


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, read from its examples in order (as :func:`expand` leaves them, no shuffle):
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples``."""
    kind = examples.schema["conv_id"].dataType.simpleString()
    ids = pa.int64() if kind == "bigint" else None
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def summary(conv, last: str, loss: int, digest, chars: int, n: int) -> tuple:
        turns = read_turns(last)
        whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")).hexdigest()
        return conv, len(turns), whole, loss, digest.hexdigest(), chars, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for b in batches:
            for conv, k, text, start, end in zip(*(b.column(i).to_pylist() for i in range(5))):
                if k == 0:
                    if now:
                        out.append(summary(*now))
                    now = [conv, "", 0, hashlib.sha256(), 0, 0]
                reply = unescape(text[start:end])
                now[3].update(reply.encode("utf-8"))
                now[1], now[2], now[4], now[5] = text, now[2] + len(reply), now[4] + len(text), now[5] + 1
            if out:
                yield rows_of(out)
                out = []
        if now:
            yield rows_of([summary(*now)])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return examples.mapInArrow(run, schema)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations plus conversation -7, whose texts hold what looks like control strings."""
    text = "\\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe.select("conv_id", "turn", "role", "text"))


__all__ = ["expand", "read_back", "with_probe", "escape", "unescape", "format_turn", "read_turns", "F"]
