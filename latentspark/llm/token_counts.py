"""Token counts by a compiled finite-state transducer.

The tokenizer (BPE with word ends) is compiled to one deterministic transducer over the bytes of words, the last
byte of a word being a symbol of its own. A numbered state knows the longest end of the bytes read so far that may
still grow into a token, and for each place in it where such a token may begin the token before that place
and how many tokens lie between; prefixes that agree in this go on alike, so they are one state. A transition
carries how many tokens its symbol adds to (or, where symbols merge, takes from) the count. Merges are run
for pairs of tokens only: a segmentation is right when the merges leave each neighbouring pair as it is.
Transitions are entered into the table when a text first needs them.

A text is cut into chunks, and all chunks of many texts run through the table side by side. What follows the first
word border of a chunk has the same exit whatever the entry; what lies before it, or a chunk without a border,
maps an entry state to an exit state and a count. A scan passes exits on as the next chunks' entries and evaluates the
maps there, all at a time, until no entry changes; states soon forget where a word began, so this takes
few rounds even for words of a million letters.
"""

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Symbols of one chunk; code points that are worked on at a time, cut at white space.
CHUNK, AT_ONCE = 128, 1 << 20
#: States and remembered pairs of a task; beyond it both start anew before the next texts, with the same counts.
MEMO = 160_000
#: Lanes up to which a Python loop beats array operations.
FEW = 4
#: The mark of a word's end inside tokens, beyond all bytes.
END = chr(256)
#: Classes of code points.
SPACE, LETTER, NUMBER, OTHER, NEW = 0, 1, 2, 3, 255


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Transducer:
    """Counts tokens of byte strings; a symbol is a byte, plus 256 where it ends a word. State 0 is a word's beginning."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        plain = {s: chr(b) for b, s in enumerate(byte_symbols())}
        as_bytes = lambda t: "".join(map(plain.__getitem__, t.removesuffix(suffix))) + (END if t.endswith(suffix) else "")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        self.merges = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {as_bytes(t) for t in vocab}
        self.prefixes = {t[:n] for t in self.tokens for n in range(len(t))} - {""}
        #: Of a token that a merge makes: its two parts and the merge's rank.
        self.made = {a + b: (a, b, rank) for (a, b), rank in reversed(self.merges.items())}
        self.reset()

    def reset(self) -> None:
        self.apart: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.whole: dict[str, bool] = {}
        self.states = [("", (("", 0),))]
        self.number = {self.states[0]: 0}
        #: Columns of the table by symbol, given as symbols come up.
        self.column = np.full(512, -1, np.int64)
        self.met: list[int] = []
        #: By state and column: 256 * next state + tokens added + 128; -1: not entered yet.
        self.table = np.full((1024, 128), -1, np.int32)

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one edge (0: left, 1: right) of a token while the merges make it, and the rank at which each is merged."""
        out = self.edges.get((token, side))
        if out is None:
            out, until, now = [], 1 << 60, token
            while True:
                out.append((now, until))
                if now not in self.made:
                    break
                until, now = self.made[now][2], self.made[now][side]
            self.edges[token, side] = out
        return out

    def meet(self, left: str, right: str, before: int) -> bool:
        """Whether a merge over the border of two tokens comes first, that is before those of either side and before rank `before`.
        Of equal ranks the one further left comes first."""
        for x, x_until in self.edge(left, 1):
            for y, y_until in self.edge(right, 0):
                rank = self.merges.get((x, y), 1 << 60)
                if rank < min(x_until, before) and rank <= y_until:
                    return True
        return False

    def makes(self, token: str) -> bool:
        """Whether the merges make this token of its bytes."""
        out = self.whole.get(token)
        if out is None:
            out = True
            if token in self.made:
                a, b, rank = self.made[token]
                out = self.makes(a) and self.makes(b) and not self.meet(a, b, rank)
            elif len(token.removesuffix(END)) > 1:
                out = False
            self.whole[token] = out
        return out

    def stay(self, left: str, right: str) -> bool:
        """Whether the merges leave these two tokens as they are when they stand together; left: empty at a word's beginning."""
        out = self.apart.get((left, right))
        if out is None:
            out = self.apart[left, right] = self.makes(right) and not (left and self.meet(left, right, 1 << 60))
        return out

    def _enter(self, state: int, column: int) -> int:
        """Finds and enters a transition."""
        (held, known), symbol = self.states[state], self.met[column]
        grown = held + chr(symbol & 255)
        ended = grown + END if symbol > 255 else grown
        start = next(j for j, k in enumerate(known) if k is not None and ended[j:] in self.tokens and self.stay(k[0], ended[j:]))
        added = known[start][1] + 1
        following = 0
        if symbol < 256:
            begin = next(j for j in range(len(grown) + 1) if j == len(grown) or grown[j:] in self.prefixes)
            places = [*known, (grown[start:], added)]
            later = tuple((places[j][0], places[j][1] - added) if j == len(grown) or grown[j:] in self.prefixes else None for j in range(begin, len(places)))
            key = (grown[begin:], later)
            following = self.number.setdefault(key, len(self.states))
            if following == len(self.states):
                self.states.append(key)
                if following == len(self.table):
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        if not -128 <= added < 128:
            raise ValueError("a symbol adds or takes too many tokens")
        self.table[state, column] = move = following * 256 + added + 128
        return move

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        out = self.column[symbols]
        if len(out) and out.min() < 0:
            for x in np.unique(symbols[out < 0]).tolist():
                self.column[x] = len(self.met)
                self.met.append(x)
            if len(self.met) > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full((len(self.table), 512 - self.table.shape[1]), -1, np.int32)], 1)
            out = self.column[symbols]
        return out

    def walk(self, symbols: np.ndarray, state: int) -> tuple[int, int]:
        """The exit state and the tokens of one run of symbols."""
        total = 0
        for x in symbols.tolist():
            move = self.table.item(state, x)
            if move < 0:
                move = self._enter(state, x)
            state = move >> 8
            total += (move & 255) - 128
        return state, total

    def run(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and tokens of many runs of symbols side by side."""
        if len(start) <= FEW:
            ends = [self.walk(symbols[s : s + n], int(e)) for s, n, e in zip(start, length, entry, strict=True)]
            return np.array([e for e, _ in ends], np.int64), np.array([n for _, n in ends], np.int64)
        order = np.argsort(-length, kind="stable")
        at, state, total = start[order], entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        longest = int(length.max(initial=0))
        lanes = np.searchsorted(-length[order], -np.arange(longest), "left")
        width = self.table.shape[1]
        for j, n in enumerate(lanes.tolist()):
            cell = state[:n] * width + symbols[at[:n] + j]
            move = self.table.reshape(-1)[cell]
            if move.min() < 0:
                for c in np.unique(cell[move < 0]).tolist():
                    self._enter(*divmod(c, width))
                move = self.table.reshape(-1)[cell]
            total[:n] += (move & 255) - 128
            state[:n] = move >> 8
        exits, counts = np.empty_like(state), np.empty_like(total)
        exits[order], counts[order] = state, total
        return exits, counts

    def count(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of the texts that follow each other in `symbols`, up to `ends`; each ends a word."""
        if len(self.states) > MEMO or len(self.apart) > MEMO:
            self.reset()
        sizes = np.diff(ends, prepend=0)
        chunks = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(ends)), chunks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = (ends - sizes)[text] + nth * CHUNK
        stop = np.minimum(start + CHUNK, ends[text])
        border = np.append(np.flatnonzero(symbols > 255), len(symbols))
        middle = np.minimum(border[np.searchsorted(border, start)] + 1, stop)  # after the first border, if there is one
        constant = symbols[middle - 1] > 255
        symbols = self.columns(symbols)
        exits, tokens = self.run(symbols, middle, stop - middle, np.zeros(len(start), np.int64))
        entry, heads, out = np.full(len(start), -1), np.zeros(len(start), np.int64), np.where(constant, exits, 0)
        while True:
            due = np.where(nth == 0, 0, np.roll(out, 1))
            new = np.flatnonzero(due != entry)
            if not len(new):
                break
            entry[new] = due[new]
            left, heads[new] = self.run(symbols, start[new], (middle - start)[new], due[new])
            out[new] = np.where(constant[new], out[new], left)
        return np.bincount(text, heads + tokens, minlength=len(ends)).astype(np.int64)


class Counter:
    """Tokens of texts under one tokenizer file. The library itself says what class each code point has and how texts
    with combining or rare ones are normalised, so its Unicode tables are used and not others."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.transducer = Transducer(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        #: By code point; `simple`: lower-cased by itself, whatever stands beside it.
        self.classes = np.full(0x110000, NEW, np.uint8)
        self.simple = np.full(0x110000, NEW, np.uint8)

    def _class(self, c: str) -> int:
        if len(self.pieces(f"a{c}a")) == 1:
            return LETTER
        if len(self.pieces(f"!{c}!")) == 1:
            return OTHER
        return NUMBER if any(offset == (1, 2) for _, offset in self.pieces(f"a{c}a")) else SPACE

    def _simple(self, c: str) -> bool:
        composes = unicodedata.category(c) in ("Mn", "Mc", "Me", "Cn", "Cs") or "ᄀ" <= c <= "ᇿ"
        return not composes and unicodedata.normalize("NFC", c) == c and self.normalise(c) in (c.lower(), " ")

    @staticmethod
    def _looked_up(table: np.ndarray, points: np.ndarray, find) -> np.ndarray:
        out = table[points]
        if len(points) and out.max() == NEW:
            for p in np.unique(points[out == NEW]).tolist():
                table[p] = find(chr(p))
            out = table[points]
        return out

    def normal(self, part: str) -> str:
        if not part.isascii():
            points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            if not self._looked_up(self.simple, points, self._simple).all():
                return self.normalise(part)
            part = part.replace("Σ", "σ")  # no final form of sigma here
        return part.lower()

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words of a normalised text, and for each code point how many symbols end with it."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self._looked_up(self.classes, points, self._class)
        after = np.append(kind[1:], SPACE)
        last = (kind == NUMBER) | ((kind != SPACE) & (kind != after))
        # An apostrophe alone, with one of these endings after it, is one word with it.
        alone = np.flatnonzero((points == 39) & (after == LETTER) & (np.append(SPACE, kind[:-1]) != OTHER))
        following = np.append(points, [0, 0])
        one, two = following[alone + 1], following[alone + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(alone), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        last[alone[short | long]] = False
        last[alone[short] + 1] = True
        last[alone[long] + 2] = True
        keep = kind != SPACE
        if text.isascii():
            return (points + 256 * last)[keep].astype(np.uint16), np.cumsum(keep)
        raw = np.frombuffer(text.encode(), np.uint8)
        first = (raw & 0xC0) != 0x80
        of = np.cumsum(first) - 1
        closes = np.append(first[1:], True)
        ends = np.cumsum(keep[of])[closes]
        return (raw + np.uint16(256) * (closes & last[of]))[keep[of]], ends

    def _parts(self, text: str) -> Iterator[str]:
        """Normalised pieces between special strings, cut at white space."""
        for part in self.special.split(text) if "<|" in text else (text,):
            part = self.normal(part)
            at = 0
            while len(part) - at > AT_ONCE:
                cuts = [c for c in (part.find(" ", at + AT_ONCE), part.find("\n", at + AT_ONCE)) if c >= 0]
                if not cuts:
                    break
                yield part[at : min(cuts)]
                at = min(cuts)
            yield part[at:]

    def counts(self, texts) -> list[int]:
        """Tokens of every text."""
        out, held, owner, size = [], [], [], 0

        def settle() -> None:
            lengths = np.array([len(p) + 1 for p in held], np.int64)
            symbols, seen = self.symbols("\n".join(held) + "\n")
            found = self.transducer.count(symbols, seen[np.cumsum(lengths) - 1])
            for text, n in zip(owner, found.tolist(), strict=True):
                out[text] += n
            held.clear()
            owner.clear()

        for i, text in enumerate(texts):
            out.append(len(self.special.findall(text)) if "<|" in text else 0)
            for part in self._parts(text):
                held.append(part)
                owner.append(i)
                size += len(part)
                if size >= AT_ONCE:
                    settle()
                    size = 0
        if held:
            settle()
        return out

    def count(self, text: str) -> int:
        return self.counts([text])[0]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(path: str):
    """A column function: text to its number of tokens. path: the tokenizer's file, on every executor."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series(c.counts([t or "" for t in texts]), dtype="int64")

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    One pass without a shuffle; whole texts. Null and empty texts have 0 bytes and tokens. Special strings
    in a text count as one token each, as the library does by default. Columns of docs that are called as the new ones
    are replaced; others stay. Repeated rows give repeated results, no rows give none."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": token_count(path)(whole)}).withColumn("over_limit", F.col("n_tokens") > limit)
