"""Chat formatting: a finite-state machine over roles, and a declarative template with per-segment loss flags.

``format_chat`` returns one row per segment (conv_id, turn_no, role, segment, text, loss, state, fault); the texts of a
conversation's segments, joined in order, are its formatted conversation.  ``read_back`` is the inverse: it parses that
string alone into turns again.

Defined cases: a null role or text is the empty string; rows with a null ``conv_id`` form one conversation; rows are taken
by turn (null last), then role, then text, and repeated rows are turns of their own; a turn that the machine does not
allow is formatted like any other and marked in ``fault``; an empty table gives no rows; further columns are ignored.

A conversation is never gathered: rows stream through in order.  In memory are the machine's state, one Arrow batch (which Spark bounds by
bytes, or to one row), 256 of its turns as Python objects, and the turn being read, whatever the length of a conversation.  (Its digest is sequential, hence one task's work.)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import pieces

START = "start"


@dataclass(frozen=True)
class ChatTemplate:
    """What is written round a turn, which strings a text must not show, which roles carry loss, and the legal order.

    ``transitions`` maps state -> role -> next state; the state after a turn is named by it.  ``accepting`` are the states
    in which a conversation may end.  ``closing`` must begin with a character that it does not repeat, so that no text can
    run into it.
    """

    opening: tuple[str, str] = ("<turn ", ">\n")
    closing: str = "</turn>\n"
    reserved: tuple[str, ...] = ("<turn", "</turn", "### ", "<|", "[INST]", "[/INST]")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            START: {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    accepting: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self) -> None:
        if any("\\" in c or len(c) < 2 for c in self.reserved):
            raise ValueError("reserved strings have two characters or more and no backslash")
        if self.closing[0] in self.closing[1:] or not any(self.closing.startswith(c) for c in self.reserved):
            raise ValueError("closing must start with a reserved string whose first character is not repeated")

    def escape(self, text: str) -> str:
        r"""A backslash is doubled, and one follows the first character of every reserved string."""
        starts = "|".join(map(re.escape, self.reserved))
        return re.sub(rf"\\|(?=(?:{starts}))[\s\S]", lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        """The inverse of ``escape``."""
        return re.sub(r"\\([\s\S])", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        """(segment, text, loss) of one turn."""
        header = self.opening[0] + quote(role, safe="") + self.opening[1]
        return [("open", header, False), ("text", self.escape(text), role in self.loss_roles), ("close", self.closing, False)]

    def step(self, state: str, role: str) -> tuple[str, str | None]:
        """Next state and fault; after a fault the machine goes on from the state named like the role."""
        after = self.transitions.get(state, {}).get(role)
        if after is not None:
            return after, None
        return (role if role in self.transitions else state), f"{role or 'empty role'} after {state}"


class TurnReader:
    """Parses the formatted text of one conversation, given in pieces, into (role, text, loss) turns."""

    def __init__(self, template: ChatTemplate) -> None:
        self.template, self.rest = template, ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, str]]:
        """Yield (role, text, escaped text) of each turn that is now complete."""
        t = self.template
        # only what the new piece adds can hold the end mark
        at = max(0, len(self.rest) - len(t.closing))
        self.rest += piece
        while (end := self.rest.find(t.closing, at)) >= 0:
            head_end = self.rest.index(t.opening[1])
            if not self.rest.startswith(t.opening[0]):
                raise ValueError("a turn does not begin with the opening mark")
            escaped = self.rest[head_end + len(t.opening[1]) : end]
            yield unquote(self.rest[len(t.opening[0]) : head_end]), t.unescape(escaped), escaped
            self.rest, at = self.rest[end + len(t.closing) :], 0


SEGMENTS = "conv_id long, turn_no long, role string, segment string, text string, loss boolean, state string, fault string"


def format_chat(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per segment; rows of a conversation stay together and in order within a partition."""
    template = template or ChatTemplate()
    rows = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, turn_no = object(), START, 0
        for batch in pieces(batches):
            out: dict[str, list] = {k: [] for k in ("conv_id", "turn_no", "role", "segment", "text", "loss", "state", "fault")}
            ids, roles, texts = (batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))
            for conv, role, text in zip(ids, roles, texts, strict=True):
                if conv != current:
                    current, state, turn_no = conv, START, 0
                state, fault = template.step(state, role)
                for kind, piece, loss in template.segments(role, text):
                    for k, v in zip(out, (conv, turn_no, role, kind, piece, loss, state, fault), strict=True):
                        out[k].append(v)
                turn_no += 1
            yield pa.RecordBatch.from_pydict(out, schema=_SEGMENT_ARROW)

    return rows.mapInArrow(run, SEGMENTS)


_SEGMENT_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("state", pa.string()), ("fault", pa.string())]
)

DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_fault string"
_DIGEST_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("first_fault", pa.string())]
)


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation of ``format_chat``'s output, read from the formatted text and the loss flags."""
    template = template or ChatTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = nothing = object()
        reader, turns, loss = TurnReader(template), hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = 0
        state: str = START
        first_fault: str | None = None

        def row() -> pa.RecordBatch:
            if reader.rest:
                raise ValueError(f"conversation {current} ends within a turn")
            ok = first_fault is None and state in template.accepting
            values = (current, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, ok, first_fault or (None if ok else f"ends after {state}"))
            return dict(zip(_DIGEST_ARROW.names, values, strict=True))

        for batch in pieces(batches):
            done = []
            for r in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss", "state", "fault")), strict=True):
                conv, text, masked, r_state, fault = r
                if current is nothing or conv != current:
                    if current is not nothing:
                        done.append(row())
                    current, reader, turns, loss = conv, TurnReader(template), hashlib.sha256(), hashlib.sha256()
                    n_turns = loss_chars = chars = 0
                    first_fault = None
                state = r_state
                first_fault = first_fault or fault
                chars += len(text)
                if masked:
                    plain = template.unescape(text)
                    loss.update(plain.encode())
                    loss_chars += len(plain)
                for role, plain, _ in reader.feed(text):
                    turns.update(f"{role}\n{plain}\n".encode())
                    n_turns += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_DIGEST_ARROW)
        if current is not nothing:
            yield pa.RecordBatch.from_pylist([row()], schema=_DIGEST_ARROW)

    return segments.mapInArrow(run, DIGEST)
