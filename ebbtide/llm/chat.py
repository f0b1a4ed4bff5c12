"""Chat formatting: messages rebuilt from event logs, rendered with a loss mask, and read back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of the template. None can occur inside an escaped text, which holds no "<" and no "[".
OPEN, CLOSE, INST, END_INST, SYS, END_SYS = "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"
_ESCAPE = str.maketrans({"\\": "\\\\", "<": "\\l", "[": "\\b"})
_BACK = {"\\": "\\", "l": "<", "b": "["}
#: Code points of a part of the output; a conversation of any length is stored as parts of about this size.
PART = 1 << 20


def escape(text: str) -> str:
    """Reversible: backslash, "<" and "[" become two characters, so no mark can appear."""
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out += (text[at:k], _BACK[text[k + 1]])
        at = k + 2
    return "".join([*out, text[at:]])


def messages(events: DataFrame) -> DataFrame:
    """Fold an event log to final messages: conv_id, turn, place, role, text.

    ``events`` has conv_id, message, turn, seq, kind, role, text; ``message`` names a message inside its
    conversation. Kinds, by seq: ``message`` sets the text (and role and turn), ``delta`` appends to it, ``edit`` puts another text
    in its place, ``regenerate`` empties it for the deltas to come, ``delete`` takes the message away until it is set or edited again.
    The fold needs only the last event that sets the text and the deltas after it, so events are grouped by message:
    a conversation with very many messages is spread over many tasks.

    Null text counts as empty, null seq comes first, ties go by kind, then text; unknown kinds are ignored. The role and turn are the
    last given. ``place`` is the first seq of the message, for messages of one turn.
    """
    rank = F.struct(F.col("seq"), F.array_position(F.array(*map(F.lit, ("message", "regenerate", "edit", "delta", "delete"))), F.col("kind")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    known = events.filter(F.col("kind").isin("message", "delta", "edit", "regenerate", "delete"))
    log = known.select("conv_id", "message", "turn", "role", F.struct(rank.alias("at"), "kind", F.coalesce("text", F.lit("")).alias("text")).alias("e"), F.col("seq"))
    given = log.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list("e")).alias("log"),  # events of one message
        F.max(F.when(F.col("turn").isNotNull(), F.struct("e.at", "turn")))["turn"].alias("turn"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("e.at", "role")))["role"].alias("role"),
        F.min("seq").alias("place"),
    )
    start = F.struct(F.lit(True).alias("gone"), F.array().cast("array<string>").alias("parts"))

    def step(a, e):
        return (
            F.when(e["kind"].isin("message", "edit"), F.struct(F.lit(False).alias("gone"), F.array(e["text"]).alias("parts")))
            .when(e["kind"] == "regenerate", F.struct(F.lit(False).alias("gone"), F.array().cast("array<string>").alias("parts")))
            .when(e["kind"] == "delta", F.struct(F.lit(False).alias("gone"), F.concat(F.when(a["gone"], F.array().cast("array<string>")).otherwise(a["parts"]), F.array(e["text"])).alias("parts")))
            .otherwise(start)
        )

    folded = given.withColumn("f", F.aggregate("log", start, step))
    return folded.filter("not f.gone").select("conv_id", "turn", "place", "role", F.array_join("f.parts", "").alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """Formatted conversations in parts: conv_id, part, text, mask.

    A turn is ``<s>[INST]role[/INST]text</s>``, role and text escaped, so any role in any order can be
    rendered and read back. ``mask`` lists (from, to) in code points of the part: the escaped texts of
    assistant turns. Turns are dealt by ranges of (conversation, turn, place, role, text), so a conversation with very many turns is
    rendered by many tasks, each of which sorts and streams its own: a part ends at a turn border, and parts are numbered by
    task and place in it, in the order of the conversation, not without gaps. Null roles are empty; null turns come first.
    """

    kind = dict(turns.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c, r, t) for b in batches for c, r, t in zip(*[b.column(k).to_pylist() for k in ("conv_id", "role", "text")], strict=True))
        out, held = {"conv_id": [], "part": [], "text": [], "mask": []}, 0
        _parts = _packer(kind)
        task = TaskContext.get().partitionId() << 32  # ranges are numbered in order
        for conv, turns_ in groupby(rows, key=lambda x: x[0]):
            text, mask, size, part = [], [], 0, task
            for _, role, said in turns_:
                head, body = f"{OPEN}{INST}{escape(role or '')}{END_INST}", escape(said or "")
                if role == "assistant":
                    mask.append({"from": size + len(head), "to": size + len(head) + len(body)})
                text += (head, body, CLOSE)
                size += len(head) + len(body) + len(CLOSE)
                if size >= PART:
                    yield _parts({"conv_id": [conv], "part": [part], "text": ["".join(text)], "mask": [mask]})
                    text, mask, size, part = [], [], 0, part + 1
            if text:
                for k, v in zip(out, (conv, part, "".join(text), mask), strict=True):
                    out[k].append(v)
                held += size
            if held >= 4 * PART:
                yield _parts(out)
                out, held = {k: [] for k in out}, 0
        if out["conv_id"]:
            yield _parts(out)

    # the beginning of the text is enough to cut ranges by, and it keeps what is sampled for them small
    keys = ["conv_id", "turn", "place", "role"]
    ranged = turns.withColumn("_head", F.substring("text", 1, 64)).repartitionByRange(*keys, "_head")
    return ranged.sortWithinPartitions(*keys, "text").select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, part long, text string, mask array<struct<from:bigint,to:bigint>>")


def _packer(kind: str):
    mask = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    return lambda out: pa.RecordBatch.from_arrays([_ids(out["conv_id"], kind), pa.array(out["part"], pa.int64()), pa.array(out["text"], pa.string()), pa.array(out["mask"], mask)], list(out))


def _ids(values: list, kind: str) -> pa.Array:
    return pa.array(values, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind))


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted part."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN + INST, at):
            raise ValueError(f"no turn begins at {at}")
        head = text.index(END_INST, at)
        end = text.index(CLOSE, head)
        yield unescape(text[at + len(OPEN + INST) : head]), unescape(text[head + len(END_INST) : end])
        at = end + len(CLOSE)


def digests(parts: DataFrame) -> DataFrame:
    """Read formatted parts back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Parts are sorted by number within their conversation and folded as they stream by, in bounded memory.
    """

    kind = dict(parts.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c, t, m) for b in batches for c, t, m in zip(*[b.column(k).to_pylist() for k in ("conv_id", "text", "mask")], strict=True))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        out = []

        def pack(found: list[tuple]) -> pa.RecordBatch:
            ids, *rest = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([_ids(list(ids), kind), *map(pa.array, rest)], names)

        for conv, mine in groupby(rows, key=lambda x: x[0]):
            turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, mask in mine:
                size += len(text)
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                    n += 1
                for m in mask:
                    said = unescape(text[m["from"] : m["to"]])
                    loss.update(said.encode("utf-8", "replace"))
                    chars += len(said)
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if len(out) >= 5000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "text", "mask")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
