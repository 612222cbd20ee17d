r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all turns before it as context, the turn
itself as the only trainable text. A turn is rendered as ``### <role>: <text></turn>\n``.
Inside texts the control strings are escaped reversibly (``\`` as ``\\``, ``###`` as ``\h``,
``</turn>`` as ``\e``), so neither control string occurs in escaped text and an example is
parsed by splitting. A conversation whose last turn is not an assistant's (or that has none)
also gives one example without target, so that no turn is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import trimmed

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e", ":": "\\c", "\n": "\\n"}
_BACK = {v: k for k, v in _ESCAPES.items()}
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_CODE = re.compile(r"\\[\\hecn]")
EXAMPLES = "conv_id long, example long, formatted string, loss_start long, loss_end long"
TARGET = "assistant"


def escape(text: str) -> str:
    return _TEXT.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _BACK[m[0]], text)


def render(role: str, text: str) -> tuple[str, str]:
    """Head (up to the text) and body (text and close) of a turn."""
    return OPEN + _ROLE.sub(lambda m: _ESCAPES[m[0]], role) + MIDDLE, escape(text) + CLOSE


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of an example."""
    for block in formatted.split(CLOSE)[:-1]:
        role, text = block[len(OPEN) :].split(MIDDLE, 1)
        yield unescape(role), unescape(text)


def expand(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[int, str, int, int]]:
    """Examples of one conversation: number, text and the span under the loss mask."""
    context, number, open_end = "", 0, True
    for role, text in turns:
        head, body = render(role, text)
        start = len(context) + len(head)
        context += head + body
        open_end = role != TARGET
        if not open_end:
            yield number, context, start, len(context) - len(CLOSE)
            number += 1
    if open_end:
        yield number, context, len(context), len(context)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    import itertools

    return itertools.groupby(rows, key=lambda r: r[0])


def format_conversations(conversations: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """One row per example: conv_id, example, formatted, loss_start, loss_end (code points).

    Turns are ordered by turn, then role and text, so repeated turn numbers and repeated rows
    have a fixed order and all stay. Null text and role count as empty, null turns come first,
    rows with a null conv_id form one conversation. Extra columns are ignored. A task streams
    its sorted rows: it holds the context of one conversation (which an example must hold
    anyway) and about ``limit`` characters of output, never all examples of a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for conv_id, rows in _grouped(_rows(batches)):
            for example in expand((role, text) for _, role, text in rows):
                held.append((conv_id, *example))
                chars += len(example[1])
                if chars >= limit:
                    yield _batch(held)
                    held, chars = [], 0
        if held:
            yield _batch(held)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(trimmed(run), EXAMPLES)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ("conv_id", "example", "formatted", "loss_start", "loss_end")
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def write_examples(examples: DataFrame, folder: str) -> str:
    """Examples as Parquet files; returns the folder."""
    examples.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return folder


def read_examples(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EXAMPLES).parquet(folder)


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples in any order: what was formatted and what is trainable.

    Only the last example of a conversation (which holds all turns) and the texts under the loss
    masks are shuffled, so what moves is in proportion to the conversations, not to the square
    of their turns.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    reply = F.substr(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    replies = F.array_sort(F.collect_list(F.struct("example", reply.alias("reply"))))  # the texts of one conversation
    grouped = examples.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("last"), replies.alias("replies"), F.sum(F.length("formatted")).cast("long").alias("chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv_id, last, replies, total in _rows(batches):
            loss, chars, turns, n = hashlib.sha256(), 0, hashlib.sha256(), 0
            for r in replies:
                text = unescape(r["reply"])
                loss.update(text.encode())
                chars += len(text)
            for role, text in parse(last):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            out.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), total, len(replies)))
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return grouped.select("conv_id", "last", F.col("replies"), "chars").mapInArrow(trimmed(run), schema)
