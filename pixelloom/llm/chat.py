"""Chat formatting: a finite-state machine over roles, and a declarative template.

The rows of a conversation, in turn order, become segments with loss flags; the segments
in order are the formatted text. Rows are shuffled by conversation and sorted within their
partition; both formatter and reader then stream, so that a conversation of any length
needs the memory of one batch. (One conversation stays in one task: its digest is
sequential.)

Escaping: inside roles and texts, each ``<``, any run of backslashes, ``|`` gets one more
backslash before the bar. No ``<|`` is left, so marks are unambiguous, and taking one
backslash away restores the text. In roles, line ends become ``<\\n`` forms as well.

Defined results: null texts and roles are empty. Turns sort with null first, then by role
and text, so repeated turns all stay in a fixed order. Rows with a null conversation id
form one conversation. A conversation of which the machine rejects the order is formatted
all the same and marked ``valid`` false. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import in_arrow


@dataclass(frozen=True)
class ChatTemplate:
    """``begin`` and ``end`` surround a turn; roles in ``loss_roles`` are learned.

    ``moves`` is the machine: state -> role -> state; it starts in ``start`` and must end in
    ``accept``.
    """

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple = ("assistant",)
    start: str = "begin"
    accept: tuple = ("asked", "answered")
    moves: dict = field(
        default_factory=lambda: {
            "begin": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def _format(template: ChatTemplate):
    def run(batches):
        known, conv, state, number = False, None, None, 0
        for b in batches:
            convs, segments, loss, numbers, valid = [], [], [], [], []

            def put(text, flag, ok, at):
                convs.append(at)
                segments.append(text)
                loss.append(flag)
                numbers.append(number)
                valid.append(ok)

            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                role, text = role or "", text or ""
                if not known or c != conv:
                    known, conv, state, number = True, c, template.start, 0
                state = template.moves.get(state, {}).get(role)
                ok = state in template.accept if state else None
                put(template.begin + escape_role(role) + template.after_role, False, ok, c)
                number += 1
                put(escape(text), role in template.loss_roles, ok, c)
                number += 1
                put(template.end + template.after_turn, False, ok, c)
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(segments, pa.string()), pa.array(loss, pa.bool_()), pa.array(valid, pa.bool_())], ["conv_id", "segment", "text", "loss", "accepted"])

    return run


def format_chat(rows: DataFrame, template: ChatTemplate = ChatTemplate(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments (conv_id, segment, text, loss, accepted), in order within each partition.

    ``accepted``: whether the turns so far are a whole conversation; null once an order is wrong.
    """
    own = rows.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("n"), F.col(role).alias("r"), F.col(text).alias("t"))
    ordered = own.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")
    return in_arrow(ordered, _format(template), "conv_id long, segment long, text string, loss boolean, accepted boolean")


class _Reader:
    """Reads a conversation back from its formatted text, piece by piece."""

    def __init__(self, template: ChatTemplate):
        self.template, self.buffer, self.turns, self.chars, self.valid = template, [], 0, 0, True
        self.all, self.learned, self.learned_chars = hashlib.sha256(), hashlib.sha256(), 0

    def feed(self, piece: str, loss: bool, accepted) -> None:
        self.chars += len(piece)
        self.valid = accepted if self.valid is not None else None  # null: an order was wrong before
        if loss:
            own = unescape(piece)
            self.learned.update(own.encode("utf-8", "surrogatepass"))
            self.learned_chars += len(own)
        self.buffer.append(piece)
        end = self.template.end + self.template.after_turn
        if piece.endswith(end):
            formatted = "".join(self.buffer)
            inner = formatted[len(self.template.begin) : -len(end)]
            if formatted.startswith(self.template.begin) and self.template.end not in inner:
                role, _, text = inner.partition(self.template.after_role)
                self.all.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                self.turns, self.buffer = self.turns + 1, []

    def row(self, conv):
        return (conv, self.turns, self.all.hexdigest(), self.learned_chars, self.learned.hexdigest(), self.chars, bool(self.valid))


def _read_back(template: ChatTemplate):
    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        conv, reader = None, None
        for b in batches:
            done = []
            for c, number, text, loss, accepted in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if number == 0:
                    if reader:
                        done.append(reader.row(conv))
                    conv, reader = c, _Reader(template)
                reader.feed(text, loss, accepted)
            if done:
                yield pack(done)
        if reader:
            yield pack([reader.row(conv)])

    return run


def read_back(segments: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of each conversation, parsed from the segments of ``format_chat`` (in their order).

    ``turns_sha256`` is that of role, line end, text, line end of each turn.
    """
    return in_arrow(segments, _read_back(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
