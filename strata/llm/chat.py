"""Chat formatting with a grammar round trip.

A turn is rendered between marks of its role, read back by a deterministic parser and compared
with its source; where they differ, what conflicts in the text is escaped and the turn is tried
again. A turn's rendering starts and ends with its own marks, so that a conversation is the
plain sequence of its turns and is read back turn by turn, without holding it whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
OTHER = ("[ROLE ", "[/ROLE]")
#: what the parser takes for a mark, or for an escaped character
TOKEN = re.compile(r"\\[\\\[<]|\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE[ \]]")
SPECIAL = re.compile(r"[\\\[<]")
OPEN = {a.strip(): (role, a, b) for role, (a, b) in MARKS.items()}
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def _put(role: str, text: str) -> str:
    if role in MARKS:
        a, b = MARKS[role]
        return a + text + b
    return f"{OTHER[0]}{re.sub(r'[\\\]\[<]', lambda m: f'\\u{ord(m[0]):04x}', role)}]{text}{OTHER[1]}"


def render(role: str, text: str) -> str:
    """The turn's rendering, escaped only if it would not read back as it is."""
    plain = _put(role, text)
    if parse(plain) == [(role, text)]:
        return plain
    done = _put(role, escape(text))
    if parse(done) != [(role, text)]:
        raise ValueError(f"turn can't be rendered: {role!r} {text[:80]!r}")
    return done


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of a rendering, or None if it doesn't follow the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        m = TOKEN.match(formatted, at)
        if not m:
            return None
        if m[0] == OTHER[0]:
            end = formatted.find("]", at)
            if end < 0:
                return None
            role = re.sub(r"\\u([0-9a-f]{4})", lambda x: chr(int(x[1], 16)), formatted[m.end() : end])
            start, close = end + 1, OTHER[1]
        elif m[0] in OPEN and formatted.startswith(OPEN[m[0]][1], at):
            role, a, close = OPEN[m[0]]
            start = at + len(a)
        else:
            return None
        out, pos = [], start
        for m in TOKEN.finditer(formatted, start):
            if m[0][0] == "\\":
                out += [formatted[pos : m.start()], m[0][1]]
                pos = m.end()
                continue
            break
        else:
            return None
        pad = len(close) - len(close.lstrip())  # the white space that belongs to the closing mark
        if m[0] != close.lstrip() or m.start() - pad < pos or formatted[m.start() - pad : m.start()] != close[:pad]:
            return None
        out.append(formatted[pos : m.start() - pad])
        turns.append((role, "".join(out)))
        at = m.end()
    return turns


def loss_span(role: str, rendering: str) -> tuple[int, int] | None:
    """Where a turn's rendering holds what a model is trained to say (code points, end exclusive): an assistant's text, without its marks."""
    a, b = MARKS["assistant"]
    return (len(a), len(rendering) - len(b)) if role == "assistant" else None


def unescape(text: str) -> str:
    """What :func:`escape` escaped, as :func:`parse` reads it."""
    return re.sub(r"\\([\\\[<])", r"\1", text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> ``(conv_id, turn, segment, escaped, loss)``, a row a row.

    A conversation's rendering is its segments in the order of turns; ``loss`` is the mask, the spans of the segment that count
    in training; ``escaped`` says that the text in it is escaped. Null role and null text count as empty. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            made, loss, escaped = [], [], []
            for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                made.append(render(r or "", t or ""))
                escaped.append(made[-1] != _put(r or "", t or ""))
                span = loss_span(r or "", made[-1])
                loss.append([{"start": span[0], "end": span[1]}] if span else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string()), pa.array(escaped, pa.bool_()), pa.array(loss, spans)], ["conv_id", "turn", "segment", "escaped", "loss"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn long, segment string, escaped boolean, loss array<struct<start:long,end:long>>")


def digest_conversations(segments: DataFrame) -> DataFrame:
    """Read formatted conversations back: one row of ``SCHEMA`` a conversation.

    Turns are what the parser recovers from the renderings, the loss columns what lies under the mask. Turns go by turn
    number, null first; equal numbers by their rendering. Rows without a conversation id form one conversation. A
    conversation is streamed, never held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, segment, escaped, loss in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    said = segment[span["start"] : span["end"]]
                    said = unescape(said) if escaped else said
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(segment)
            if len(done) > 1000:
                yield _rows(done)
                done.clear()
        close()
        if done:
            yield _rows(done)

    ordered = segments.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "segment")
    return ordered.mapInArrow(run, SCHEMA)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


def round_trip(conversations: DataFrame) -> DataFrame:
    """Format the conversations and read them back: one row of ``SCHEMA`` a conversation.

    Null role and text count as empty, a null conversation id is a conversation of its own, repeated rows are repeated
    turns, texts may be of any length, other columns are ignored. Empty table: no rows.
    """
    return digest_conversations(format_turns(conversations))
