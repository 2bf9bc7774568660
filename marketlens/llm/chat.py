"""Chat formatting from event logs: fold streamed events into messages, then render.

Events of a conversation: ``message`` opens a message with a role and a first text, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` empties it so that later deltas
start anew. Logs are partitioned by conversation and sorted by message and sequence; a task
folds them as they stream by, holding one message at a time, however long a conversation is.

Rendering marks turns as ``<|im_start|>role\\n text <|im_end|>\\n`` and escapes inside roles
and texts: a backslash is doubled, ``<|`` becomes ``<\\|`` and, in roles, a newline ``\\n``.
Both are undone when reading back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the template.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLES = ("assistant",)

MESSAGE_SCHEMA = "conv_id long, position long, message string, role string, text string"
RENDERED_SCHEMA = (
    "conv_id long, position long, message string, role string, rendered string, "
    "start long, length long, loss_start long, loss_end long"
)
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_BATCH = 1024


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (cut := text.find("\\", at)) >= 0:
        out += [text[at:cut], "\n" if text[cut + 1] == "n" else text[cut + 1]]
        at = cut + 2
    return "".join([*out, text[at:]])


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn and the place of its escaped text in it."""
    head = TURN_START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return f"{head}{body}{TURN_END}\n", len(head), len(head) + len(body)


def parse_turn(rendered: str) -> tuple[str, str, int, int]:
    """Role and text of a rendered turn, unescaped, and the place of the escaped text."""
    line = rendered.index("\n")
    end = rendered.index(TURN_END, line)
    return unescape(rendered[len(TURN_START) : line]), unescape(rendered[line + 1 : end]), line + 1, end


def _records(rows: Iterator[dict], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row.values() if isinstance(v, str))
        if len(held) >= _BATCH or chars >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for low in range(0, batch.num_rows, _BATCH):
            yield from batch.slice(low, _BATCH).to_pylist()


_MESSAGES = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("message", pa.string()), ("role", pa.string()), ("text", pa.string())]
)
_RENDERED = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("message", pa.string()), ("role", pa.string()), ("rendered", pa.string())]
    + [(c, pa.int64()) for c in ("start", "length", "loss_start", "loss_end")]
)
_DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def messages() -> Iterator[dict]:
        key, role, parts = None, "", []

        def close() -> dict:
            return {"conv_id": key[0], "position": key[1], "message": key[2], "role": role, "text": "".join(parts)}

        for e in _rows(batches):
            this = (e["conv_id"], e["position"], e["message"])
            if this != key:
                if key is not None:
                    yield close()
                key, role, parts = this, "", []
            role = e["role"] if e["role"] is not None else role
            text = e["text"] or ""
            if e["kind"] in ("edit", "regenerate"):
                parts = [text]
            else:  # message and delta
                parts.append(text)
        if key is not None:
            yield close()

    return _records(messages(), _MESSAGES)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of ``events(conv_id, position, message, seq, kind, role, text)``.

    A message is one (conv_id, position, message); its events apply in the order of ``seq``,
    ties by kind and text. Null texts are empty, a null role keeps the one before, null
    conversations form one conversation, null positions come first. Kinds other than edit
    and regenerate append.
    """
    columns = ["conv_id", "position", "message", "seq", "kind", "role", "text"]
    log = events.select(
        F.col("conv_id").cast("long"), F.col("position").cast("long"), F.col("message").cast("string"),
        F.col("seq").cast("long"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.col("role").cast("string"), F.col("text").cast("string"),
    ).select(*columns)
    ordered = log.repartition(F.col("conv_id")).sortWithinPartitions(
        "conv_id", "position", "message", "seq", F.col("kind").desc(), "text"
    )
    return ordered.mapInArrow(_fold, MESSAGE_SCHEMA)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def turns() -> Iterator[dict]:
        conv, at, begun = None, 0, False
        for m in _rows(batches):
            if not begun or m["conv_id"] != conv:
                conv, at, begun = m["conv_id"], 0, True
            rendered, low, high = render_turn(m["role"], m["text"])
            learnt = m["role"] in LEARNT_ROLES
            yield {
                "conv_id": conv, "position": m["position"], "message": m["message"], "role": m["role"], "rendered": rendered,
                "start": at, "length": len(rendered), "loss_start": at + low if learnt else None, "loss_end": at + high if learnt else None,
            }
            at += len(rendered)

    return _records(turns(), _RENDERED)


def render(messages: DataFrame) -> DataFrame:
    """One row per turn: its rendered text, its place in the conversation's text, and the
    place of what is learnt (null for roles that are not). The turns of a conversation in
    the order of ``start``, joined by nothing, are its training text."""
    ordered = messages.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "position", "message")
    return ordered.mapInArrow(_render, RENDERED_SCHEMA)


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold and render in one pass over the sorted log."""
    return fold_events(events).mapInArrow(_render, RENDERED_SCHEMA)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests() -> Iterator[dict]:
        state = None
        for t in _rows(batches):
            if state is None or t["conv_id"] != state["conv_id"]:
                if state is not None:
                    yield close(state)
                state = {"conv_id": t["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            role, text, low, high = parse_turn(t["rendered"])
            state["n"] += 1
            state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if t["loss_start"] is not None:
                masked = unescape(t["rendered"][t["loss_start"] - t["start"] : t["loss_end"] - t["start"]])
                state["loss"].update(masked.encode("utf-8", "surrogatepass"))
                state["loss_chars"] += len(masked)
            state["chars"] += len(t["rendered"])
        if state is not None:
            yield close(state)

    def close(s: dict) -> dict:
        return {
            "conv_id": s["conv_id"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["loss_chars"],
            "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["chars"],
        }

    return _records(digests(), _DIGESTS)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from rendered turns alone; hashes run as turns stream by."""
    ordered = rendered.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "start")
    return ordered.mapInArrow(_read_back, DIGEST_SCHEMA)
