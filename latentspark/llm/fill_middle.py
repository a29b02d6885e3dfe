"""Fill-in-middle transformation by a table-driven byte automaton.

The automaton reads UTF-8 bytes. Its state holds how many continuation bytes are due, whether the last unit is a run of letters, and how much of a
sentinel has been read; each transition counts the units and sentinels that begin or end with it. A state depends on the last few bytes only
(`Automaton.window` of them, found when the tables are compiled), so all bytes of a buffer take their transitions side by side:
one step of the tables for each byte of the window. A second pass over the counted transitions finds where the cuts lie.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands between texts and brings the automaton to its start; UTF-8 has no such byte.
RESET = 0xFF
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of texts that are scanned together, and of a piece whose states are held at a time.
LUMP, PIECE = 1 << 23, 1 << 20
CUT = "n long, form string, prefix_chars long, middle_chars long, output string"


class Automaton:
    """Transition tables over (state, byte class): next state, units begun, sentinel ended."""

    def __init__(self, sentinels: tuple[bytes, ...] = tuple(s.encode() for s in SENTINELS)):
        heads = {s[:i] for s in sentinels for i in range(len(s) + 1)}
        read = lambda seen: next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in heads)
        start = (0, False, b"")
        states, rows = {start: 0}, []
        todo = [start]
        while todo:
            due, word, seen = todo.pop(0)
            row = []
            for byte in range(256):
                letter = 65 <= byte <= 90 or 97 <= byte <= 122
                more = 0x80 <= byte < 0xC0 and due > 0
                text = seen + bytes([byte])
                left = due - 1 if more else 1 if 0xC0 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF8 else 0
                to = start if byte == RESET else (left, letter, read(text))
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                begins = byte != RESET and not more and not (letter and word)
                row.append((states[to], begins, byte != RESET and text.endswith(sentinels)))
            rows.append(row)
        table = np.array(rows, np.uint8)  # state, byte, (next, unit, sentinel)
        columns, kind = np.unique(table.transpose(1, 0, 2).reshape(256, -1), axis=0, return_inverse=True)
        table = columns.reshape(len(columns), len(states), 3).transpose(1, 0, 2)
        self.kind = kind.reshape(-1).astype(np.uint8)
        self.width = len(columns)
        self.next, self.unit, self.sentinel = (np.ascontiguousarray(table[:, :, i]).reshape(-1) for i in range(3))
        self.window = self._window(len(states))

    def _window(self, states: int) -> int:
        """After so many bytes the state is the same wherever the automaton began."""
        pairs, n = {(a, b) for a in range(states) for b in range(a)}, 0
        step = self.next.reshape(states, self.width).tolist()
        while pairs:
            pairs = {(max(x, y), min(x, y)) for a, b in pairs for x, y in zip(step[a], step[b], strict=True) if x != y}
            n += 1
            if n > states * states:
                raise ValueError("the state depends on all that was read")
        return n

    def scan(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes begin a unit and which end a sentinel, for a buffer that begins at the start state."""
        unit, sentinel = np.empty(len(data), bool), np.empty(len(data), bool)
        led = np.concatenate([np.full(self.window, RESET, np.uint8), data])
        for at in range(0, len(data), PIECE):
            end = min(at + PIECE, len(data))
            kinds = self.kind[led[at : end + self.window]]
            state = np.zeros(end - at, np.uint16)
            for k in range(self.window):
                state = self.next[state * np.uint16(self.width) + kinds[k : k + end - at]].astype(np.uint16)
            taken = state * np.uint16(self.width) + kinds[self.window :]
            unit[at:end], sentinel[at:end] = self.unit[taken], self.sentinel[taken]
        return unit, sentinel


def lumps(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some LUMP bytes; a longer text is alone."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > LUMP:
            yield first, i
            first, held = i, 0
        held += size + 1
    if first < len(sizes):
        yield first, len(sizes)


def _forms(texts: list[bytes], draws: np.ndarray, automaton: Automaton, marks: tuple[bytes, ...], plain_from: int, spm_below: int) -> list[tuple]:
    data = np.frombuffer(bytes([RESET]).join(texts), np.uint8)
    unit, sentinel = automaton.scan(data)
    lead = (data & 0xC0) != 0x80
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    out = []
    for text, end, (h1, h2, h3, h4) in zip(texts, ends.tolist(), draws.tolist(), strict=True):
        begin = end - len(text)
        n = int(np.count_nonzero(unit[begin:end]))
        if n == 0 or h3 % 100 >= plain_from or sentinel[begin:end].any():
            out.append((n, "plain", None, None, text))
            continue
        # The second pass: the bytes at which the units after prefix and middle begin.
        places = np.append(np.flatnonzero(unit[begin:end]), len(text))
        a, b = sorted((int(places[h1 % (n + 1)]), int(places[h2 % (n + 1)])))
        chars = int(np.count_nonzero(lead[begin : begin + a])), int(np.count_nonzero(lead[begin + a : begin + b]))
        p, s, m = marks
        if h4 % 100 < spm_below:
            out.append((n, "spm", *chars, b"".join((s, text[b:], p, text[:a], m, text[a:b]))))
        else:
            out.append((n, "psm", *chars, b"".join((p, text[:a], s, text[b:], m, text[a:b]))))
    return out


def fill_in_middle(docs: DataFrame, key: str = "1", sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Per document: doc_id, n (its units: runs of letters A-Z in either case, and every other code point), form (plain, psm or spm), prefix_chars
    and middle_chars (code points; null where plain), output (the text with its parts behind the sentinels for prefix, suffix and middle).

    Draws are the 8-digit groups of sha256(key:doc_id), a null doc_id like an empty one. Needs doc_id and text; further
    columns are left out. Null and empty texts are plain and empty; a text that holds a sentinel is plain, and so is one of no units. Very long texts are scanned piece by
    piece. Bytes that are not UTF-8 count as units of their own (0xFF, which parts texts, as none). Repeated rows stay. No shuffle."""
    marks = tuple(s.encode() for s in sentinels)
    automaton = Automaton(marks)
    digest = F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", "text", *[draw(i).alias(f"h{i + 1}") for i in range(4)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            draws = np.column_stack([batch.column(f"h{i + 1}").to_numpy(zero_copy_only=False) for i in range(4)])
            for first, last in lumps([len(t) for t in texts]):
                n, form, prefix, middle, output = zip(*_forms(texts[first:last], draws[first:last], automaton, marks, plain_from, spm_below), strict=True)
                columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string(), safe=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {CUT}")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, from output and form alone. No part of a text that is not plain holds a sentinel, so sentinels part it."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels))
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
