"""Language identification by cross-parsing with suffix automata.

Each language has a suffix automaton of a bounded sample of labelled text.  A
text is cut greedily into the longest pieces that occur in that sample; the more
alike, the fewer phrases.  Phrases times the bits needed to point into the
sample, per character, estimate the cross entropy, and the smallest wins.

Letters are lower-cased; a run of anything else is one space.  Texts are parsed
in stretches of ``STRETCH`` symbols, all of them, so that a batch moves through
the automaton table side by side.

The fit is bounded by documented parameters: ``documents_per_language`` rows,
chosen by a hash of the id, ``chars_per_document`` from each and ``sample_chars``
in all, for the ``max_languages`` most frequent labels.  Prediction reads every
row and whole texts.

Null texts and texts without letters are ``und`` with score 0, and so is every
text where no labels were learned.  Of equal entropies the smaller label wins,
with score 0.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftscope.llm.scratch import give_back_memory, ship_package

STRETCH = 256
_FAR_LETTER = 0x3400  # stands for letters beyond the basic plane, which no automaton has
_CHARS = 1 << 21
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # of each code point below 65536: 0 unseen letter, 1 space, 2.. letters of the samples
    letters: int
    tables: list[np.ndarray]  # [state * letters + symbol] -> (next state * letters) << 1 | a phrase ended
    bits: list[float]  # of a pointer into the sample


@lru_cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(65536)])


def _symbols(text: str, model_symbol: np.ndarray) -> tuple[np.ndarray, bool]:
    """The symbols of a text with runs of spaces joined, and whether it has letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    high = code > 65535
    if high.any():
        letter = np.array([chr(c).isalpha() for c in code[high].tolist()])
        code = code.copy()
        code[high] = np.where(letter, _FAR_LETTER, 0x20)
    symbol = model_symbol[code]
    keep = symbol != 1
    found = bool(keep.any())
    keep[1:] |= keep[:-1].copy()  # the first space of a run stays
    return symbol[keep], found


def automaton(sequence: list[int], letters: int) -> np.ndarray:
    """Transition table (states x letters, -1 where there is none) of the sequence's substrings."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in sequence:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and s not in step[at]:
            step[at][s] = new
            at = link[at]
        if at >= 0:
            to = step[at][s]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and step[at].get(s) == to:
                    step[at][s] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    table = np.full((len(step), letters), -1, np.int32)
    for state, row in enumerate(step):
        for s, to in row.items():
            table[state, s] = to
    return table


def fit(texts: dict[str, list[str]], sample_chars: int = 16384) -> Model:
    """The model of labelled texts."""
    languages = sorted(texts)
    letter = _is_letter()
    seen = sorted({c for rows in texts.values() for t in rows for c in t.lower() if ord(c) < 65536 and letter[ord(c)]} - {chr(_FAR_LETTER)})
    symbol = np.where(letter, 0, 1).astype(np.int32)
    for i, c in enumerate(seen):
        symbol[ord(c)] = i + 2
    letters = len(seen) + 2
    tables, bits = [], []
    for language in languages:
        sequence: list[int] = []
        for text in texts[language]:
            sequence += [*_symbols(text, symbol)[0].tolist(), 0]  # 0 is in no text, so no phrase spans two of them
            if len(sequence) >= sample_chars:
                break
        step = automaton(sequence[:sample_chars], letters)
        step[:, 0] = -1
        start = np.maximum(step[0], 0)
        tables.append(np.where(step >= 0, (step * letters) << 1, (start[None, :] * letters) << 1 | 1).astype(
            np.int32).ravel())
        bits.append(float(np.log2(max(2, min(len(sequence), sample_chars)))))
    return Model(languages, symbol, letters, tables, bits)


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bits per symbol for each text and language, and which texts have letters."""
    phrases = np.zeros((len(texts), len(model.languages)))
    symbols, letters = np.zeros(len(texts)), np.zeros(len(texts), bool)
    parts, owners, size = [], [], 0

    def parse() -> None:
        if not parts:
            return
        flat = np.concatenate(parts)
        length = np.array([len(p) for p in parts])
        count = -(-length // STRETCH)
        owner = np.repeat(np.array(owners), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(length) - length, count) + number * STRETCH
        lane = np.minimum(np.repeat(length, count) - number * STRETCH, STRETCH)
        order = np.argsort(-lane, kind="stable")
        owner, start, lane = owner[order], start[order], lane[order]
        active = np.searchsorted(-lane, -np.arange(STRETCH), side="left").tolist()
        state = [np.zeros(len(lane), np.int32) for _ in model.languages]
        ended = [np.ones(len(lane), np.int32) for _ in model.languages]
        for j in range(STRETCH):
            k = active[j]
            if not k:
                break
            now = flat[start[:k] + j]
            for i, table in enumerate(model.tables):
                value = table[state[i][:k] + now]
                ended[i][:k] += value & 1
                state[i][:k] = value >> 1
        for i, n in enumerate(ended):
            phrases[:, i] += np.bincount(owner, n, len(texts))

    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), _CHARS):
            part, found = _symbols(text[at:at + _CHARS], model.symbol)
            letters[row] |= found
            symbols[row] += len(part)
            parts.append(part)
            owners.append(row)
            size += len(part)
            if size >= _CHARS:
                parse()
                parts, owners, size = [], [], 0
    parse()
    return phrases * np.array(model.bits)[None, :] / np.maximum(symbols, 1)[:, None], letters


def predict(model: Model, texts: list[str | None]) -> pd.DataFrame:
    if not model.languages or not texts:
        return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
    entropy, letters = entropies(model, texts)
    best = entropy.argmin(axis=1)
    ordered = np.sort(entropy, axis=1)
    second = ordered[:, 1] if len(model.languages) > 1 else np.full(len(texts), np.inf)
    score = np.where(letters, 1 - ordered[:, 0] / np.where(letters, second, 1), 0.0)
    names = np.array([*model.languages, UNKNOWN], object)
    return pd.DataFrame({"lang": names[np.where(letters, best, len(model.languages))], "score": score})


def learn(docs: DataFrame, usable: Column | None = None, id_column: str = "doc_id", text_column: str = "text",
          lang_column: str = "lang", documents_per_language: int = 48, chars_per_document: int = 1024,
          sample_chars: int = 16384, max_languages: int | None = None, full_samples: int = 64) -> Model:
    """Fit on a bounded sample of the labelled rows for which ``usable`` holds.

    Every label is learned.  Beyond ``full_samples`` labels each has a smaller
    sample, so that all samples together stay as large.  A sample's pieces of
    ``chars_per_document`` lie at places of the whole texts that a hash chooses.
    ``max_languages`` keeps the most frequent labels only, if that is wanted.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"),
                       F.col(text_column).alias("text"), (F.lit(True) if usable is None else usable).alias("usable"))
    rows = rows.where("usable AND lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("id"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    common = common if max_languages is None else common.limit(max_languages)
    labels = common.count()
    if labels > full_samples:
        documents_per_language = max(1, documents_per_language * full_samples // labels)
        sample_chars = max(chars_per_document, sample_chars * full_samples // labels)
    by_hash = Window.partitionBy("lang").orderBy("h", "id")
    chosen = rows.select("lang", "h", "id").withColumn("n", F.row_number().over(by_hash)).where(
        F.col("n") <= documents_per_language)
    # at most full_samples * documents_per_language rows, or one per label
    chosen = F.broadcast(chosen.join(F.broadcast(common.select("lang")), "lang").select("lang", "h", "id", "n"))
    room = F.greatest(F.char_length("text") - chars_per_document, F.lit(0)) + 1
    piece = F.substr("text", F.pmod(F.xxhash64(F.lit(1), "id"), room).cast("int") + 1, F.lit(chars_per_document))
    sample = rows.join(chosen, ["lang", "h", "id"]).groupBy("lang", "n").agg(F.min(piece).alias("text"))  # of equal ids one
    texts: dict[str, list[str]] = {}
    for row in sample.orderBy("lang", "n").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    return fit(texts, sample_chars)


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> Column:
    """A struct column ``lang, score`` for the rows of ``docs``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of the fit

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(shared.value, batch.tolist())
        give_back_memory()

    return of(F.col(text_column))


def is_held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept from the fit; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows whose language can be told; labels of the same rows are what the fit learns from.

    Where there is no label to learn from, only texts that are null or have no letter go.
    """
    model = learn(docs, **options)
    text = options.get("text_column", "text")
    if not model.languages:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    return docs.withColumn("__language", identify(docs, model, text)).where(
        F.col("__language.lang") != UNKNOWN).drop("__language")
