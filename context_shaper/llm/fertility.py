"""Quality rules from tokeniser fertility.

Method: public vocabularies cut every word of a text into tokens.  Text in a language a vocabulary was
made for, and like the rest of its corpus, has a typical number of characters per token, share of tokens
that are single bytes of characters the vocabulary lacks, and entropy of its tokens.  The bands that are
typical come from the corpus itself: per language, script and length the median, and the quartiles'
distance as the unit.  A document outside a band of ``width`` units is rejected.

A vocabulary sees every different word of a task once; what it made of it is kept for the words to come.
Texts are read once and never shuffled: a row of numbers per document is staged, and bands come from those.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from context_shaper.llm.tokens import by_bytes, grams, mix, space_separated, span_hashes, text_bytes, token_bounds
from context_shaper.session import stage

# Fixed value: how texts are cut before a byte-level vocabulary is applied.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SYMBOLS = b"#*$%&|<>"
# Scripts by the first byte of a character's UTF-8 form, from the given byte on.
SCRIPTS = [
    (0xC3, "Latin"), (0xCA, "other"), (0xCE, "Greek"), (0xD0, "Cyrillic"), (0xD4, "other"), (0xD6, "Hebrew"),
    (0xD8, "Arabic"), (0xDC, "other"), (0xE0, "Indic"), (0xE1, "other"), (0xE3, "Kana"), (0xE4, "Han"),
    (0xEA, "Hangul"), (0xEE, "other"),
]
PART = 256  # longer words are cut into parts before a vocabulary sees them
KNOWN = 400_000  # different words whose tokens a worker remembers
MEASURES = ("chars", "fallback", "entropy")


@dataclass(frozen=True)
class Fertility:
    """``folder``, on every machine, holds the ``vocabularies``: a ``.model`` file of sentence pieces or a
    ``.tiktoken`` file of byte ranks.  Bands need ``min_group`` different rows, else the next wider group's
    band holds: of language and script, then of script, then none.  A band's unit is at least the floor:
    of the median for characters per token and entropy, an absolute share for byte fallback."""

    folder: str = "/opt/tokenizers"
    vocabularies: tuple[str, ...] = ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
    min_words: int = 50
    max_repeat_percent: int = 50
    width: float = 4.5
    min_group: int = 100
    floors: tuple[float, float, float] = (0.01, 0.02, 0.01)

    @property
    def measures(self) -> list[str]:
        return [f"{name}_{number}" for number in range(len(self.vocabularies)) for name in MEASURES]


Encoder = Callable[[list[str]], list[list[int]]]
_loaded: dict[str, tuple[Encoder, np.ndarray]] = {}


def _load(path: str) -> tuple[Encoder, np.ndarray]:
    """An encoder of words, and for each token whether it is less than a whole character."""
    if path in _loaded:
        return _loaded[path]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        partial = [pieces.is_byte(i) or pieces.is_unknown(i) for i in range(pieces.get_piece_size())]
        encode: Encoder = lambda words: pieces.encode(words, num_threads=1)
    else:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("words", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        partial = [False] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            partial[rank] = token.decode("utf-8", "ignore").encode() != token
        encode = lambda words: [encoding.encode_ordinary(" " + word) for word in words]
    _loaded[path] = encode, np.array(partial)
    return _loaded[path]


class _Tokens:
    """The tokens of words under one vocabulary, remembered by the words' hashes."""

    def __init__(self, path: str) -> None:
        self._encode, self.partial = _load(path)
        self._forget()

    def _forget(self) -> None:
        self._place: dict[int, int] = {}
        self._ends, self._ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def of(self, hashes: np.ndarray, word: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of every word, and all tokens in turn; ``word(i)`` is the i-th different word."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self._place) + len(keys) > KNOWN:
            self._forget()
        new = [i for i, key in enumerate(keys) if key not in self._place]
        if new:
            parts = self._cut([word(int(first[i])) for i in new])
            sizes = np.fromiter((len(part) for part in parts), np.int64, len(parts))
            ids = np.fromiter((i for part in parts for i in part), np.int32, int(sizes.sum()))
            for number, i in enumerate(new, len(self._place)):
                self._place[keys[i]] = number
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])
            self._ids = np.concatenate([self._ids, ids])
        place = np.fromiter((self._place[key] for key in keys), np.int64, len(keys))[inverse]
        sizes = self._ends[place + 1] - self._ends[place]
        shift = self._ends[place] - (np.cumsum(sizes) - sizes)
        return sizes, self._ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]

    def _cut(self, words: list[str]) -> list[list[int]]:
        parts = [[word[at : at + PART] for at in range(0, len(word), PART)] for word in words]
        tokens = iter(self._encode([part for some in parts for part in some]))
        return [[i for _ in some for i in next(tokens)] for some in parts]


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row the sum of its flags."""
    if not len(flags):
        return np.zeros(len(offsets) - 1, np.int64)
    sums = np.add.reduceat(flags, np.minimum(offsets[:-1], len(flags) - 1), dtype=np.int64)
    return np.where(np.diff(offsets) > 0, sums, 0)


def _table(flagged: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(flagged)] = True
    return table


def _script_table() -> np.ndarray:
    names = [name for _, name in SCRIPTS]
    table = np.full(256, -1)
    for (low, name), (high, _) in zip(SCRIPTS, [*SCRIPTS[1:], (256, "")]):
        table[low:high] = names.index(name)
    table[65:91] = table[97:123] = names.index("Latin")
    return table


_SYMBOL, _SCRIPT = _table(SYMBOLS), _script_table()
_SPACE, _LINE = space_separated(), np.where(np.arange(256) == 10, 0, 1).astype(np.uint8)


def _repeat_words(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row the words inside three-word windows that the row has twice or more."""
    inside = row[2:] == row[: max(len(row) - 2, 0)]
    keys = mix(grams(hashes, 3) + row[: len(inside)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keys[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(row), bool)
    if len(twice):
        found = np.searchsorted(twice, keys)
        starts = np.flatnonzero(inside & (twice[np.minimum(found, len(twice) - 1)] == keys))
        for place in range(3):
            covered[starts + place] = True
    return np.bincount(row[covered], minlength=rows)


def _dup_lines(data: np.ndarray, offsets: np.ndarray, rows: int) -> np.ndarray:
    """Per row its lines with a word that equal an earlier one."""
    starts, ends = token_bounds(data, offsets, _LINE)
    at = np.flatnonzero(_SPACE[data])
    worded = np.searchsorted(at, starts) < np.searchsorted(at, ends)
    starts, ends = starts[worded], ends[worded]
    row = np.searchsorted(offsets, starts, "right") - 1
    keys = mix(span_hashes(data, starts, ends, cased=True) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)


def _scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The script most letters of each row are of; ``none`` without letters."""
    kinds = _SCRIPT[data]
    names = list(dict.fromkeys(name for _, name in SCRIPTS))
    number = [name for _, name in SCRIPTS]
    counts = np.stack([
        row_sums(np.isin(kinds, [i for i, x in enumerate(number) if x == name]), offsets) for name in names
    ])
    return [names[i] if most else "none" for i, most in zip(counts.argmax(axis=0), counts.max(axis=0))]


def _entropies(tokens: np.ndarray, row: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Per row the entropy of its tokens in bits."""
    total = np.bincount(row, minlength=rows).astype(float)
    keys = np.sort(row * size + tokens)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(keys)]])).astype(float)
    held = np.bincount(keys[starts] // size, weights=counts * np.log2(counts), minlength=rows)
    return np.log2(np.maximum(total, 1)) - held / np.maximum(total, 1)


def _measure(options: Fertility):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = [_Tokens(os.path.join(options.folder, name)) for name in options.vocabularies]
        for whole in batches:
            for batch in by_bytes(whole, 0):
                yield _measured(batch, vocabularies, options)

    return run


def _measured(batch: pa.RecordBatch, vocabularies: list[_Tokens], options: Fertility) -> pa.RecordBatch:
    rows = batch.num_rows
    data, offsets = text_bytes(batch.column(0))
    starts, ends = token_bounds(data, offsets, _SPACE) if len(data) else (np.zeros(0, np.int64),) * 2
    hashes = span_hashes(data, starts, ends, cased=True)
    words = np.diff(np.searchsorted(starts, offsets))
    row = np.repeat(np.arange(rows), words)
    in_word = (_SPACE[data] != 0) & ((data & 0xC0) != 0x80)
    chars = row_sums(in_word, offsets)
    found = {
        "n_words": words, "word_chars": chars, "n_symbols": row_sums(_SYMBOL[data], offsets),
        "n_dup_lines": _dup_lines(data, offsets, rows) if len(data) else np.zeros(rows, np.int64),
        "n_repeat_words": _repeat_words(hashes, row, rows),
    }
    columns = [pa.array(values.astype(np.int64)) for values in found.values()]
    names = [*found, "script"]
    columns.append(pa.array(_scripts(data, offsets), pa.string()))
    for number, vocabulary in enumerate(vocabularies):
        sizes, tokens = vocabulary.of(hashes, lambda i: data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))
        token_row = np.repeat(row, sizes)
        count = np.maximum(np.bincount(token_row, minlength=rows), 1)
        fallback = np.bincount(token_row, weights=vocabulary.partial[tokens], minlength=rows)
        entropy = _entropies(tokens.astype(np.int64), token_row, rows, len(vocabulary.partial))
        for name, values in zip(MEASURES, (chars / count, fallback / count, entropy)):
            names.append(f"{name}_{number}")
            columns.append(pa.array(values.astype(float)))
    return pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["row", *names])


def measure_fertility(documents: DataFrame, options: Fertility = Fertility()) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, script, measures) per row."""
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    row = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(lang, F.lit("")).alias("lang"))
    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    measures = ", ".join(f"{name} double" for name in options.measures)
    return documents.select(F.col("text").cast("string").alias("text"), row.alias("row")).mapInArrow(
        _measure(options), f"row struct<doc_id:bigint,lang:string>, {counts}, script string, {measures}"
    ).select("row.*", "*").drop("row")


def base_rule(options: Fertility = Fertility()) -> Column:
    """True for texts that are too short or mostly repeat themselves."""
    return (F.col("n_words") < options.min_words) | (
        100 * F.col("n_repeat_words") > options.max_repeat_percent * F.col("n_words")
    )


def _length_class() -> Column:
    return F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")


def fertility_bands(measured: DataFrame, options: Fertility = Fertility()) -> DataFrame:
    """(script, lang, length, depth, low_*, high_*): a band per measure and group; ``depth`` 0 is the narrowest.

    Rows with the same figures count once, so copies of one text do not set a band.
    """
    keys, names = ["script", "lang", "length"], options.measures
    rows = measured.filter(~base_rule(options)).withColumn("length", _length_class()).select(*keys, *names).distinct()
    quartiles = [F.percentile_approx(name, [0.25, 0.5, 0.75], 10_000).alias(name) for name in names]
    grouped = rows.rollup(*keys).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *quartiles)
    wide = grouped.filter((F.col("n") >= options.min_group) & F.col("script").isNotNull())
    depth = F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).when(F.col("g") == 3, 2)
    bounds = []
    for number, name in enumerate(names):
        low, middle, high = (F.get(name, F.lit(i)) for i in range(3))
        kind = MEASURES[number % len(MEASURES)]
        floor = F.lit(options.floors[1]) if kind == "fallback" else options.floors[MEASURES.index(kind)] * F.abs(middle)
        # The quartiles of a normal distribution are 1.349 standard deviations apart.
        unit = F.greatest((high - low) / 1.349, floor)
        bounds += [(middle - options.width * unit).alias(f"low_{name}"), (middle + options.width * unit).alias(f"high_{name}")]
    return wide.select(*keys, depth.alias("depth"), *bounds).filter("depth IS NOT NULL")


def judge_fertility(documents: DataFrame, options: Fertility = Fertility()) -> DataFrame:
    """``measure_fertility`` with base_failed and kept for every row of documents(doc_id, text, lang, ...).

    Words are runs of anything but the six ASCII spaces.  Null, empty and blank texts have no words and
    fail the base rule, as do all texts of fewer than ``min_words``.  Without a column ``lang``, or where it is
    null, the empty language stands for it.  Bands cover all rows that pass the base rule; a value on a band's
    edge is inside.  Long texts are taken whole, words of over 256 characters are tokenised in parts.  Equal
    windows and lines are found by 64-bit hashes.  Other columns are ignored, equal rows give equal rows,
    and an empty table an empty result.
    """
    measured = stage(measure_fertility(documents, options), "fertility").withColumn("length", _length_class())
    bands = stage(fertility_bands(measured.drop("length"), options), "bands")
    names, judged = options.measures, measured
    for depth, keys in enumerate((["script", "lang", "length"], ["script", "lang"], ["script"])):
        bounds = F.struct(*[F.col(f"{side}_{name}") for name in names for side in ("low", "high")]).alias(f"band_{depth}")
        judged = judged.join(bands.filter(F.col("depth") == depth).select(*keys, bounds), keys, "left")
    judged = judged.withColumn("band", F.coalesce("band_0", "band_1", "band_2"))
    inside = F.lit(True)
    for name in names:
        inside = inside & F.col(name).between(F.col(f"band.low_{name}"), F.col(f"band.high_{name}"))
    return judged.withColumn("base_failed", base_rule(options)).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    ).drop("band", "band_0", "band_1", "band_2", "length")
