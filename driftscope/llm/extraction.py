"""Main text of HTML pages by a recurrent block labeller.

A page is a sequence of text blocks.  Each is a vector of its tag path, its
hashed words and a few measures; a bidirectional LSTM in numpy reads the whole
sequence, so that every block is labelled in the light of all others.  Blocks
labelled main are joined in the order of the page.

The labeller is trained here, on ``TRAINING_PAGES`` made-up pages with known
main text (``html_samples``), once in a session, from fixed seeds.  Labels for
given pages are not needed.

A null or empty page, or one without main text, gives an empty text.  Pages of
any length are read whole; long ones only take more steps.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftscope.llm.html_blocks import Block, blocks
from driftscope.llm.html_samples import BEGIN, END, PageMaker

PATH, LEAF, WORDS, MEASURES = 192, 48, 64, 9
WIDTH = PATH + LEAF + WORDS + MEASURES
HIDDEN = 20
TRAINING_PAGES = 1200
EPOCHS = 8
_BATCH_CELLS = 40_000
_STRIP = re.compile(r"^\W+|\W+$")


# ---- vectors --------------------------------------------------------------------------------------------------------

@lru_cache(maxsize=100_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Which elements and names occur on the path, and those of the two innermost elements once more."""
    out = np.zeros(PATH + LEAF, np.float32)
    for depth, entry in enumerate(reversed(path)):
        for token in entry.split():
            out[zlib.crc32(token.encode()) % PATH] = 1
            if depth < 2:
                out[PATH + zlib.crc32(f"{depth} {token}".encode()) % LEAF] = 1
    return out


@lru_cache(maxsize=200_000)
def _word_bucket(word: str) -> int:
    bare = _STRIP.sub("", word.lower())
    return zlib.crc32((bare or word).encode("utf-8", "surrogatepass")) % WORDS


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), WIDTH), np.float32)
    for i, block in enumerate(page):
        text = block.text
        words = text.split(" ")
        size, count = len(text), len(words)
        out[i, :PATH + LEAF] = _path_vector(block.path)
        seen = np.bincount(list(map(_word_bucket, words)), minlength=WORDS)
        out[i, PATH + LEAF:PATH + LEAF + WORDS] = np.sqrt(seen / count)
        out[i, -MEASURES:] = (np.log1p(size) / 7, np.log1p(count) / 5, block.link_chars / size,
                              min(1, 8 * (text.count(".") + text.count(",")) / size),
                              1 if "©" in text or "|" in text else 0, i / len(page), 1 / len(page),
                              text[0].isupper(), text[-1] in ".!?")
    return out


# ---- the network ----------------------------------------------------------------------------------------------------

@dataclass
class Model:
    into: list[np.ndarray]  # per direction: (WIDTH, 4 * HIDDEN)
    back: list[np.ndarray]  # (HIDDEN, 4 * HIDDEN)
    bias: list[np.ndarray]
    out: np.ndarray  # (2 * HIDDEN,)
    shift: np.ndarray  # (1,)

    def parameters(self) -> list[np.ndarray]:
        return [*self.into, *self.back, *self.bias, self.out, self.shift]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _turned(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each sequence backwards, its padding still at the end."""
    step = np.arange(x.shape[1])[None, :]
    at = np.where(step < length[:, None], length[:, None] - 1 - step, step)
    return np.take_along_axis(x, at[:, :, None], axis=1)


def _lstm(gates_in: np.ndarray, back: np.ndarray, keep: list | None = None) -> np.ndarray:
    n, steps, _ = gates_in.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((n, steps, HIDDEN), np.float32)
    for t in range(steps):
        gates = gates_in[:, t] + h @ back
        ifo, g = _sigmoid(gates[:, :3 * HIDDEN]), np.tanh(gates[:, 3 * HIDDEN:])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN:2 * HIDDEN], ifo[:, 2 * HIDDEN:]
        before, last = c, h
        c = f * c + i * g
        bent = np.tanh(c)
        h = o * bent
        out[:, t] = h
        if keep is not None:
            keep.append((i, f, o, g, before, bent, last))
    return out


def scores(model: Model, x: np.ndarray, length: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The score of each block of padded sequences; above zero is main text."""
    sides = []
    for d in range(2):
        own = _turned(x, length) if d else x
        cells: list | None = None if keep is None else []
        h = _lstm(own @ model.into[d] + model.bias[d], model.back[d], cells)
        sides.append(_turned(h, length) if d else h)
        if keep is not None:
            keep.append((own, cells))
    both = np.concatenate(sides, axis=2)
    if keep is not None:
        keep.append(both)
    return both @ model.out + model.shift


def _gradients(model: Model, x: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    keep: list = []
    score = scores(model, x, length, keep)
    real = np.arange(x.shape[1])[None, :] < length[:, None]
    chance = _sigmoid(score)
    loss = -np.where(label > 0, np.log(chance + 1e-9), np.log(1 - chance + 1e-9))[real].mean()
    d_score = (np.where(real, chance - label, 0) / real.sum()).astype(np.float32)
    both = keep[2]
    d_out, d_shift = np.einsum("nt,nth->h", d_score, both), d_score.sum(keepdims=True).ravel()
    d_both = d_score[:, :, None] * model.out
    into, back, bias = [], [], []
    for d in range(2):
        own, cells = keep[d]
        d_h_all = d_both[:, :, d * HIDDEN:(d + 1) * HIDDEN]
        if d:
            d_h_all = _turned(d_h_all, length)
        d_gates = np.zeros((*own.shape[:2], 4 * HIDDEN), np.float32)
        d_h, d_c = np.zeros((len(own), HIDDEN), np.float32), np.zeros((len(own), HIDDEN), np.float32)
        d_back = np.zeros_like(model.back[d])
        for t in range(own.shape[1] - 1, -1, -1):
            i, f, o, g, before, bent, last = cells[t]
            d_h = d_h + d_h_all[:, t]
            d_c = d_c + d_h * o * (1 - bent * bent)
            step = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * bent * o * (1 - o),
                                   d_c * i * (1 - g * g)], axis=1)
            d_gates[:, t] = step
            d_back += last.T @ step
            d_h, d_c = step @ model.back[d].T, d_c * f
        flat = d_gates.reshape(-1, 4 * HIDDEN)
        into.append(own.reshape(-1, WIDTH).T @ flat)
        back.append(d_back)
        bias.append(flat.sum(axis=0))
    return float(loss), [*into, *back, *bias, d_out, d_shift]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in pages])
    out = np.zeros((len(pages), int(length.max()), WIDTH), np.float32)
    for i, p in enumerate(pages):
        out[i, :len(p)] = p
    return out, length


def labelled_pages(count: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of made-up pages."""
    out = []
    for k in range(count):
        inside, kept, label = False, [], []
        for block in blocks(PageMaker(seed * 1_000_003 + k).page()):
            if block.text in (BEGIN, END):
                inside = block.text == BEGIN
            else:
                kept.append(block)
                label.append(inside)
        if kept:
            out.append((vectors(kept), np.array(label, np.float32)))
    return out


@lru_cache(maxsize=1)
def train(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """The labeller, by Adam on made-up pages; the same for the same parameters."""
    random = np.random.default_rng(seed)

    def spread(rows: int, columns: int) -> np.ndarray:
        return (random.standard_normal((rows, columns)) / np.sqrt(rows)).astype(np.float32)

    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN:2 * HIDDEN] = 1
    model = Model([spread(WIDTH, 4 * HIDDEN) for _ in range(2)], [spread(HIDDEN, 4 * HIDDEN) for _ in range(2)],
                  [bias, bias.copy()], spread(2 * HIDDEN, 1).ravel(), np.zeros(1, np.float32))
    data = labelled_pages(pages, seed)
    data.sort(key=lambda p: len(p[0]))
    batches = [data[i:i + 24] for i in range(0, len(data), 24)]
    mean = [np.zeros_like(p) for p in model.parameters()]
    square = [np.zeros_like(p) for p in model.parameters()]
    step, total = 0, epochs * len(batches)
    for _ in range(epochs):
        for k in random.permutation(len(batches)):
            x, length = _padded([p[0] for p in batches[k]])
            label = np.zeros(x.shape[:2], np.float32)
            for i, (_, y) in enumerate(batches[k]):
                label[i, :len(y)] = y
            _, gradient = _gradients(model, x, length, label)
            step += 1
            rate = 0.01 * (1 - step / total) + 0.0005
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradient))
            for p, g, m, s in zip(model.parameters(), gradient, mean, square):
                g = g * min(1, 1 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return model


def label(model: Model, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Which blocks of each page are main text; pages of like length are read side by side."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(pages[order[stop]]) <= _BATCH_CELLS:
            stop += 1
        some = order[at:stop]
        found = scores(model, *_padded([pages[i] for i in some])) > 0
        for i, row in zip(some, found):
            out[i] = row[:len(pages[i])]
        at = stop
    return out


def extract(model: Model, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    parsed = [blocks(p) if p else [] for p in pages]
    chosen = label(model, [vectors(p) for p in parsed])
    return ["\n".join(b.text for b, main in zip(page, mains) if main) for page, mains in zip(parsed, chosen)]


def main_text(pages: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``name``, which replaces one of that name."""
    shared = pages.sparkSession.sparkContext.broadcast(train())  # a few hundred kB

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts: list[str] = []
            for at in range(0, len(batch), 512):
                texts += extract(shared.value, batch.iloc[at:at + 512].tolist())
            yield pd.Series(texts, dtype=object)

    return pages.withColumn(name, of(F.col(html_column)))
