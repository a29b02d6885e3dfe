"""Chat formatting of turns with typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one string with an ordered
placeholder for each attachment, and records the attachment's reference and its expanded token count.
Turns are formatted row by row; a window gives each its place in its conversation. The template is

    ### role: content</turn>\\n

and control strings inside roles and texts are escaped by a backslash, so that reading back is exact.
"""

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, CLOSE, SLOT = "### ", "</turn>", "<|"
_CONTROL = re.compile(r"\\|### |</turn>|<\|")
_ROLE = re.compile(r"\\|:|### |</turn>|<\|")
_ESCAPED = re.compile(r"\\(\\|:|### |</turn>|<\|)")
_TOKEN = re.compile(r"\\(?:\\|:|### |</turn>|<\|)|### |</turn>|<\||: ")

#: Tokens that an attachment expands to: pixels of a patch's side, audio tokens a second, tokens of a page.
PATCH, AUDIO_RATE, PAGE = 28, 12.5, 512


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class Flattener:
    """Visits typed parts in order. A part is a dict: type, text, ref, width, height, seconds, pages.

    An unknown type and missing numbers are legal: the former is kept as a `file` placeholder of one token,
    the latter count as the smallest expansion."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_file)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width") or 1, part.get("height") or 1
        self._slot("image", part, math.ceil(w / PATCH) * math.ceil(h / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._slot("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self._slot("document", part, max(1, part.get("pages") or 1) * PAGE)

    def visit_file(self, part: dict) -> None:
        self._slot("file", part, 1)

    def _slot(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments)
        self.out.append(f"{SLOT}{kind}:{n}|>")
        self.attachments.append({"position": n, "kind": kind, "ref": part.get("ref"), "n_tokens": tokens})


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The formatted turn, the span of its content in it, and its attachments."""
    head = f"{OPEN}{escape(role or '', _ROLE)}: "
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    body = "".join(flat.out)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body), flat.attachments


def next_turn(text: str) -> tuple[str, str, str, int] | None:
    """role, text and raw content of the turn that the formatted text begins with, found from control strings alone, and its length; None: it does not end there."""
    if not OPEN.startswith(text[: len(OPEN)]):
        raise ValueError("a turn begins with its mark")
    role_end = next((m for m in _TOKEN.finditer(text, len(OPEN)) if m[0] == ": "), None)
    close = role_end and next((m for m in _TOKEN.finditer(text, role_end.end()) if m[0] == CLOSE), None)
    if not close or close.end() == len(text):
        return None
    if text[close.end()] != "\n":
        raise ValueError("a turn ends with its mark")
    raw = text[role_end.end() : close.start()]
    return unescape(text[len(OPEN) : role_end.start()]), unescape(raw), raw, close.end() + 1


def read_turn(segment: str) -> tuple[str, str, str]:
    """role, text and raw content of one formatted turn."""
    found = next_turn(segment)
    if not found or found[3] != len(segment):
        raise ValueError("not one turn")
    return found[:3]


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    while text:
        found = next_turn(text)
        if not found:
            raise ValueError("the last turn has no end")
        out.append(found[:2])
        text = text[found[3] :]
    return out


_ATTACHMENTS = "array<struct<position int, kind string, ref string, n_tokens long>>"
_TURN = f"segment string, body_start int, body_end int, attachments {_ATTACHMENTS}, expanded_tokens long"


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a turn: conv_id, turn, role, segment, its attachments, expanded_tokens, and the code-point spans
    char_start/char_end (the segment) and loss_start/loss_end (what is learnt; null outside loss_roles) in the
    conversation's formatted text, which is the segments in order.

    turns: conv_id, turn, role, text, or parts (array of structs as `Flattener` takes them) instead of the
    text; other columns are left out. Null roles and texts are empty; null turns come first, a null conv_id is a
    conversation of its own; rows that tie in turn are ordered by role and text, equal rows all stay."""
    has_parts = "parts" in turns.columns
    content = F.col("parts") if has_parts else F.col("text")
    # Spark sorts a conversation's turns on disk if need be: no conversation is gathered in Python's memory.
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"))

    @F.pandas_udf(_TURN)
    def turn(roles: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for role, value in zip(roles, contents, strict=True):
            parts = [dict(p) for p in value if p is not None] if has_parts and value is not None else [{"type": "text", "text": None if has_parts else value}]
            segment, start, end, found = format_turn(role, parts)
            out.append((segment, start, end, found, sum(a["n_tokens"] for a in found)))
        return pd.DataFrame(out, columns=["segment", "body_start", "body_end", "attachments", "expanded_tokens"])

    formatted = rows.withColumn("_f", turn("role", "content")).select("conv_id", "turn", "role", "_f.*")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "segment").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = formatted.withColumn("char_end", F.sum(F.char_length("segment").cast("long")).over(order))
    start, learns = F.col("char_end") - F.char_length("segment"), F.col("role").isin(*loss_roles)
    return placed.select("conv_id", "turn", "role", "segment", "attachments", "expanded_tokens", start.alias("char_start"), "char_end", F.when(learns, start + F.col("body_start")).alias("loss_start"), F.when(learns, start + F.col("body_end")).alias("loss_end"))


_DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """What is read back of one conversation: its formatted text comes piece by piece, and turns are told apart by the text alone."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.at, self.loss = conv_id, 0, 0, 0
        self.rest, self.masks = "", []
        self.turns, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, loss_start, loss_end) -> None:
        self.rest += piece
        if not pd.isna(loss_start):
            self.masks.append((int(loss_start), int(loss_end)))
        while self.rest and (found := next_turn(self.rest)):
            role, text, _, length = found
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            while self.masks and self.masks[0][1] <= self.at + length:
                start, end = self.masks.pop(0)
                learnt = unescape(self.rest[start - self.at : end - self.at])
                self.loss += len(learnt)
                self.learnt.update(learnt.encode())
            self.rest, self.at = self.rest[length:], self.at + length

    def row(self) -> tuple:
        if self.rest or self.masks:
            raise ValueError("the last turn has no end, or a loss span lies in none")
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.learnt.hexdigest(), self.at


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, now = [c.split()[0] for c in _DIGEST.split(", ")], None
    for batch in batches:
        done = []
        for conv_id, segment, a, b in zip(batch.conv_id, batch.segment, batch.loss_start, batch.loss_end, strict=True):
            if now is None or now.conv_id != conv_id:
                done += [now.row()] if now else []
                now = _Digest(conv_id)
            now.add(segment, a, b)
        if done:
            yield _frame(done, columns)
    if now:
        yield _frame([now.row()], columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read from the formatted text: n_turns, a digest of roles and texts, the number of
    code points and a digest of what the loss mask covers, and the formatted length.

    A conversation's text streams through one task in order, and a parser finds its turns; one turn, hashes and counts are held."""
    columns = ["conv_id", "segment", "char_start", "loss_start", "loss_end"]
    dealt = formatted.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "char_start")
    # Ids pass through Python as text: there, numbers with nulls among them would lose digits.
    return dealt.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(_digests, _DIGEST).withColumn("conv_id", F.col("conv_id").cast("long"))
