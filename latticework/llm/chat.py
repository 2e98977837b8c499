"""Chat formatting: prefix-target expansion of conversations into one example per assistant turn.

Method. Every assistant turn gives an example: all turns before it as context, then the turn itself, whose
text alone is under the loss mask (``loss_start`` to ``loss_end``, code points of the formatted text). Turns
after the last assistant turn, or of a conversation without one, come in one more example with an empty mask,
so that the output holds every turn. Rows are sorted inside partitions and streamed: a task holds the prefix of
one conversation and a few finished examples.

Template. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts a backslash is doubled, and
a backslash goes between the first and second character of any control string, so no control string of this
or the bracket style occurs in them; ``unescape`` drops each escaping backslash. A line break in a role gets
a backslash before it.

Edge cases. A null role or text counts as empty. Turns of a conversation are ordered by turn (nulls first),
role, text; repeated rows are turns of their own. A null conversation id is a conversation of its own.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings of common chat templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"
_CONTROL = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>((?:\\.|[^\\\n])*)\n(.*?)<\|im_end\|>\n", re.S)
_FLUSH_CHARS = 4_000_000


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def examples(turns: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str, int, int]]:
    """``(n_turns, text, loss_start, loss_end)`` of each example of one conversation."""
    prefix, n, told = "", 0, 0
    for role, text in turns:
        turn, start, end = format_turn(role, text)
        before, prefix, n = len(prefix), prefix + turn, n + 1
        if role == TARGET_ROLE:
            told = n
            yield n, prefix, before + start, before + end
    if told < n:
        yield n, prefix, 0, 0


def expand(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: ``conv_id, example, n_turns, text, loss_start, loss_end``, in order inside partitions."""
    rows = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([rows.schema["conv_id"]] + T._parse_datatype_string("example long, n_turns long, text string, loss_start long, loss_end long").fields)
    key_type = ordered.select("conv_id").limit(0).toArrow().schema.field(0).type

    def run(batches):
        def turns():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())

        out, held = [], 0
        for key, group in _grouped(turns()):
            for number, (n, text, start, end) in enumerate(examples(group)):
                out.append((key, number, n, text, start, end))
                held += len(text)
                if held > _FLUSH_CHARS:
                    yield _batch(out, schema, key_type)
                    out, held = [], 0
        if out:
            yield _batch(out, schema, key_type)

    return ordered.mapInArrow(run, schema)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(key, rows without the key)`` for each run of equal keys; each group is read before the next begins."""
    rows = iter(rows)
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def group():
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                yield ahead[1:]
                ahead = next(rows, None)

        yield key, group()


def _batch(rows: list[tuple], schema: T.StructType, key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [key_type] + [pa.string() if f.dataType == T.StringType() else pa.int64() for f in schema.fields[1:]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its examples say when read back; ``formatted`` as ``expand`` returns it."""
    schema = T.StructType([formatted.schema["conv_id"]] + T._parse_datatype_string(DIGESTS).fields)
    key_type = formatted.select("conv_id").limit(0).toArrow().schema.field(0).type

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in (3, 4, 5)))

        out = []
        for key, group in _grouped(rows()):
            loss, n_loss, n_formatted, n_examples, longest = hashlib.sha256(), 0, 0, 0, ""
            for text, start, end in group:
                said = unescape(text[start:end])
                loss.update(said.encode())
                n_loss, n_formatted, n_examples, longest = n_loss + len(said), n_formatted + len(text), n_examples + 1, text
            turns = parse(longest)  # the last example holds every turn
            whole = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            out.append((key, len(turns), whole, n_loss, loss.hexdigest(), n_formatted, n_examples))
            if len(out) >= 10_000:
                yield _batch(out, schema, key_type)
                out = []
        if out:
            yield _batch(out, schema, key_type)

    return formatted.mapInArrow(run, schema)
