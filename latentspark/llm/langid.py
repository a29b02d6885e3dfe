"""Language identification with error-correcting output codes.

Each language has a codeword; for each of its bits a binary classifier over character n-grams of words tells on
which side a text is. Loss-weighted decoding sums, for each codeword, the losses of all margins, weighted
by how reliable their classifier was in training, and takes the codeword with the least; a second one close to
it makes the text ambiguous.
"""

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the classifiers are fitted on (about; bounds of what reaches the driver): of each language, and in all,
#: so that with many languages each has fewer.
PER_LANGUAGE, IN_ALL = 500, 12_000
#: Hashed cells of n-grams of one to three characters.
CELLS = 4096
#: Rows up to which the fit solves rows x rows equations, beyond it cells x cells.
ROWS_FORM = CELLS
#: Words that a task remembers, texts that it reads at a time, and new words whose n-grams it weighs at a time.
MEMO, AT_ONCE, WORDS_AT_ONCE = 200_000, 128, 8192
UNKNOWN = "und"

_NOT_LETTERS = regex.compile(r"[^\p{L}\n]")
_K = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def n_grams(lines: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams of all runs of letters, each with a space on either side, and the line that each stands in."""
    text = f" {_NOT_LETTERS.sub(' ', lines.lower())} "
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    line = np.cumsum(points == 10)
    letter = (points != 10) & (points != 32)
    points = np.where(letter, points, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    a, b, c = points[at - 1] * _K[0], points[at] * _K[1], points[at + 1] * _K[2]
    # A letter by itself, with the one before it, with the one after it where its run ends there, and with both.
    ends = at[~letter[at + 1]]
    hashes = np.concatenate([b * _K[2], (a ^ b) * _K[1] + np.uint32(1), (points[ends] * _K[0] ^ points[ends + 1] * _K[1]) * _K[1] + np.uint32(1), (a ^ b ^ c) * _K[0] + np.uint32(2)])
    cells = (hashes ^ (hashes >> np.uint32(15))) * _K[1] >> np.uint32(20)
    return cells.astype(np.int64), np.concatenate([line[at], line[at], line[ends], line[at]])


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of +1 and -1: all different splits of up to six languages, else the most distant of random codes."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 6:
        return np.array([[1.0, *bits] for bits in itertools.product((1.0, -1.0), repeat=k - 1)][1:]).T
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    tries = [rng.choice((-1.0, 1.0), (k, length)) for _ in range(50)]
    nearest = lambda c: ((length - c @ c.T) / 2 + length * np.eye(k)).min()
    best = max(tries, key=nearest)
    return best[:, np.abs(best.sum(0)) < k]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # cell x bit
    bias: np.ndarray  # bit
    reliability: np.ndarray  # bit
    sharpness: float

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted exponential losses of every codeword, text by text."""
        return (self.reliability[None, None, :] * np.exp(-np.clip(margins, -3, 3)[:, None, :] * self.codes[None])).sum(2)

    def chances(self, margins: np.ndarray) -> np.ndarray:
        z = -self.sharpness * self.losses(margins)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _featurise():
    @F.pandas_udf("struct<cells: binary, counts: binary>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [np.unique(n_grams((t or "").replace("\n", " "))[0], return_counts=True) for t in texts]
            yield pd.DataFrame([(c.astype(np.uint16).tobytes(), n.astype(np.uint32).tobytes()) for c, n in found], columns=["cells", "counts"])

    return features


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fits on about `per_language` rows of each language of labelled (doc_id, text, lang; null langs take no part), fewer of each where
    they would be more than IN_ALL together.

    The rows are chosen by a hash of id and text; their n-gram shares, at most CELLS numbers a row, are what
    reaches the driver. Texts without a letter teach nothing."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((CELLS, 1)), np.zeros(1), np.ones(1), 1.0)
    per_language = min(per_language, max(1, IN_ALL // len(languages)))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.filter(place < share).limit(2 * per_language * len(languages)).select("lang", _featurise()("text").alias("f")).select("lang", "f.*").filter(F.length("cells") > 0).collect()
    languages = sorted({r["lang"] for r in sample}) or languages
    x = np.zeros((len(sample), CELLS), np.float32)
    for i, r in enumerate(sample):
        counts = np.frombuffer(r["counts"], np.uint32)
        x[i, np.frombuffer(r["cells"], np.uint16)] = counts / max(1, counts.sum())
    label = np.array([languages.index(r["lang"]) for r in sample], np.int64)
    codes = codewords(len(languages))
    if not len(sample):
        return LanguageModel(languages, codes, np.zeros((CELLS, codes.shape[1])), np.zeros(codes.shape[1]), np.ones(codes.shape[1]), 1.0)
    targets = codes[label]
    # Ridge regression of every bit, languages weighing the same.
    weight = 1 / np.bincount(label, minlength=len(languages))[label]
    weight *= len(weight) / weight.sum()
    mean = (weight[:, None] * x).sum(0) / weight.sum()
    root = np.sqrt(weight)[:, None]
    bias = (weight[:, None] * targets).sum(0) / weight.sum()
    xc = x - mean.astype(np.float32)
    xc *= root
    aim = root * (targets - bias)
    # The smaller of the two forms of the normal equations: cells x cells, or rows x rows.
    few = len(xc) <= ROWS_FORM
    gram = (xc @ xc.T if few else xc.T @ xc).astype(np.float64)
    gram[np.diag_indices(len(gram))] += 1e-2 * np.trace(gram) / len(xc) + 1e-12
    weights = xc.T.astype(np.float64) @ np.linalg.solve(gram, aim) if few else np.linalg.solve(gram, xc.T.astype(np.float64) @ aim)
    margins = x @ weights - mean @ weights + bias
    # A classifier that is no better than chance has no say.
    right = (weight[:, None] * (margins * targets > 0)).sum(0) / weight.sum()
    model = LanguageModel(languages, codes, weights, bias - mean @ weights, np.clip(2 * right - 1, 1e-3, 1) / codes.shape[1], 1.0)
    sharp = max((1.0, 2.0, 4.0, 8.0, 16.0), key=lambda s: np.log(LanguageModel(**{**vars(model), "sharpness": s}).chances(margins)[np.arange(len(label)), label] + 1e-6).mean())
    return LanguageModel(**{**vars(model), "sharpness": sharp})


class WordMargins(dict):
    """White-space separated words to rows of a table: the summed weights of a word's n-grams and how many these are."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[str] = []
        self.table = np.zeros((0, self.model.weights.shape[1] + 1))

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row

    def _settle(self) -> None:
        """Rows of the words that are new, some words at a time."""
        found = [self.table]
        for at in range(0, len(self.new), WORDS_AT_ONCE):
            part = self.new[at : at + WORDS_AT_ONCE]
            cells, word = n_grams("\n".join(part))
            order = np.argsort(word, kind="stable")
            cells, word = cells[order], word[order]
            out = np.zeros((len(part), self.table.shape[1]))
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)
            if len(first):
                out[word[first], :-1] = np.add.reduceat(self.model.weights[cells], first)
                out[word[first], -1] = np.diff(np.append(first, len(word)))
            found.append(out)
        self.table, self.new = np.concatenate(found), []

    def margins(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The margins of every bit, text by text; None without a letter."""
        if len(self) > MEMO:
            self.clear()
        rows = [list(map(self.__getitem__, (t or "").split())) for t in texts]
        self._settle()
        totals = [self.table[r].sum(0) for r in rows]
        return [t[:-1] / t[-1] + self.model.bias if t[-1] else None for t in totals]


def predict(docs: DataFrame, model: LanguageModel, ambiguous_below: float = 0.2) -> DataFrame:
    """docs with lang_pred, score (the chosen codeword's chance, 0 to 1), runner_up and ambiguous (the two chances lie less
    than `ambiguous_below` apart).

    Reads whole texts, however long, and nothing but the texts. Null texts and texts without a letter (Unicode's classes L; digits,
    fractions and numerals are none) are `und` with score 0; so are all where nothing could be learnt. Columns called as the new ones are replaced, others stay. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double, runner_up: string, ambiguous: boolean>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        words = WordMargins(m)
        for texts in batches:
            found = []
            for at in range(0, len(texts), AT_ONCE):
                part = texts.iloc[at : at + AT_ONCE].to_list()
                found += words.margins(part) if m.languages else [None] * len(part)
            have = [i for i, f in enumerate(found) if f is not None]
            chances = m.chances(np.array([found[i] for i in have])) if have else np.zeros((0, 1))
            order = np.argsort(-chances, axis=1, kind="stable")
            out = [(UNKNOWN, 0.0, None, True)] * len(found)
            for i, c, o in zip(have, chances, order, strict=True):
                second = o[1] if len(o) > 1 else None
                gap = c[o[0]] - (c[second] if second is not None else 0)
                out[i] = (m.languages[o[0]], float(c[o[0]]), None if second is None else m.languages[second], bool(gap < ambiguous_below))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "runner_up", "ambiguous"])

    new = docs.withColumn("_j", judge("text"))
    return new.withColumns({c: F.col(f"_j.{c}") for c in ("lang_pred", "score", "runner_up", "ambiguous")}).drop("_j")


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 4 is not 2 and predicts all: doc_id, held_out, lang_pred, score, runner_up,
    ambiguous. Needs doc_id, text and lang; further columns are left out; repeated rows repeat; no rows give none."""
    split = docs.select("doc_id", "text", "lang", (remainder("doc_id", 4) == 2).alias("held_out"))
    model = fit(split.filter("NOT held_out"))
    return predict(split.select("doc_id", "held_out", "text"), model).drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs, all columns, without those whose language cannot be told: `und` or ambiguous texts."""
    model = fit(docs.filter(remainder("doc_id", 4) != 2))
    known = (F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")
    old = [F.col(c) for c in docs.columns]
    packed = docs.select(F.struct(*old).alias("_row"), F.col("text"))
    return predict(packed, model).filter(known).select("_row.*")
