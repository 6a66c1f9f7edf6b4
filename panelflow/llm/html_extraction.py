"""Main text of pages by a recurrent block labeller.

A bidirectional LSTM, in numpy, reads the blocks of a page in order.  A block
is its hashed tag-path names, hashed words and four figures; every block is
classified with the whole page as context, and the texts of article blocks are
joined.

The labeller learns from up to ``TRAIN_PAGES`` different pages of any size,
chosen by a hash; of a page with many blocks, ``WINDOWS`` stretches of
``STRETCH`` blocks: both ends, where most of the rest stands, and places between.  Blocks are labelled by the names
on their path: article containers without any of ``OTHERS`` on the path are main
text; where no page of the sample has such containers, all blocks without
``OTHERS``.  Each stretch is also seen in other dress, with the containers'
names exchanged, inserted notices and comments, so that names which are rare in
the sample are learned.  Pages are read where they are; training runs in one
task and returns the weights.

Defined results: null or empty html, and a page without main blocks, give an
empty text.  Repeated rows are extracted each; further columns are ignored; an
empty table stays empty.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.html_blocks import blocks

TRAIN_PAGES = 240
WINDOWS, STRETCH = 3, 180
PATH, WORDS, FIGURES, HIDDEN = 256, 32, 4, 16
STEPS = 260
MAIN = ("article", "main", "content", "post", "entry", "story")
OTHERS = (
    "nav", "navigation", "menu", "header", "footer", "aside", "sidebar", "form", "ad", "ads", "advert", "advertisement", "sponsor", "promo",
    "notice", "cookie", "cookies", "consent", "banner", "popup", "newsletter", "subscribe", "comment", "comments", "reply", "replies", "share",
    "social", "related", "breadcrumb", "breadcrumbs", "copyright", "login", "search", "widget", "pagination", "disclaimer", "alert", "modal")
DRESS = (("article",), ("main",), ("main", "article"), ("div", "content"), ("div", "main", "content"), ("div", "post"), ("div", "entry", "content"),
         ("section", "article"), ("div", "article", "body"), ("div", "story"), ("main", "div", "content"))


def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % size


def features(page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """One row per block."""
    x = np.zeros((len(page), PATH + WORDS + FIGURES), np.float32)
    for row, (path, text, linked) in zip(x, page):
        for name in path:
            row[_bucket(name, PATH)] = 1.0
        words = text.lower().split()
        for w in words:
            row[PATH + _bucket(w, WORDS)] += 0.2 / len(words) ** 0.5
        row[PATH + WORDS :] = (np.log1p(len(words)) / 5, linked, min(1.0, sum(text.count(c) for c in ".,;:!?") / 20), text[-1:] in ".!?")
    return x


def _direction(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool = False):
    """Hidden states (T, B, H) of one LSTM; where ``mask`` is 0 the state is carried on."""
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    own = x @ w[:-HIDDEN] + b
    out, steps = np.zeros((t, n, HIDDEN), np.float32), []
    for k in range(t):
        z = own[k] + h @ w[-HIDDEN:]
        s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[k][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            steps.append((h, c, i, f, o, g, tc, m))
        c = m * c_new + (1 - m) * c
        h = m * (o * tc) + (1 - m) * h
        out[k] = h
    return out, steps


def _direction_back(x: np.ndarray, w: np.ndarray, steps: list, d_out: np.ndarray):
    t, n, _ = x.shape
    dz_all = np.zeros((t, n, 4 * HIDDEN), np.float32)
    d_low = np.zeros((HIDDEN, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        h, c, i, f, o, g, tc, m = steps[k]
        dh = dh + d_out[k]
        live = dh * m
        d_c = dc * m + live * o * (1 - tc * tc)
        dz = np.concatenate((d_c * g * i * (1 - i), d_c * c * f * (1 - f), live * tc * o * (1 - o), d_c * i * (1 - g * g)), axis=1)
        dz_all[k] = dz
        d_low += h.T @ dz
        dc = d_c * f + dc * (1 - m)
        dh = dz @ w[-HIDDEN:].T + dh * (1 - m)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return np.concatenate((x.reshape(-1, x.shape[2]).T @ flat, d_low)), flat.sum(axis=0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x = np.zeros((t, len(pages), PATH + WORDS + FIGURES), np.float32)
    mask = np.zeros((t, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


class Labeller:
    """Weights of both directions and of the output."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.weights = weights

    @staticmethod
    def fresh(seed: int = 5) -> "Labeller":
        rng = np.random.default_rng(seed)
        size = PATH + WORDS + FIGURES + HIDDEN
        w = [rng.normal(0, 0.15, (size, 4 * HIDDEN)), np.zeros(4 * HIDDEN), rng.normal(0, 0.15, (size, 4 * HIDDEN)), np.zeros(4 * HIDDEN),
             rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)]
        w[1][HIDDEN : 2 * HIDDEN] = w[3][HIDDEN : 2 * HIDDEN] = 1.0
        return Labeller([a.astype(np.float32) for a in w])

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        w = self.weights
        ahead, s1 = _direction(x, mask, w[0], w[1], keep)
        back, s2 = _direction(x[::-1], mask[::-1], w[2], w[3], keep)
        hidden = np.concatenate((ahead, back[::-1]), axis=2)
        return hidden @ w[4] + w[5], hidden, s1, s2

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss of the blocks and the gradients."""
        w = self.weights
        logit, hidden, s1, s2 = self.logits(x, mask, True)
        p = 1 / (1 + np.exp(-logit))
        n = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        d = (p - y) * mask / n
        d_hidden = d[:, :, None] * w[4]
        g0, g1 = _direction_back(x, w[0], s1, d_hidden[:, :, :HIDDEN])
        g2, g3 = _direction_back(x[::-1], w[2], s2, d_hidden[::-1, :, HIDDEN:])
        return loss, [g0, g1, g2, g3, np.einsum("tb,tbh->h", d, hidden), np.array([d.sum()])]

    def main_blocks(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            some = [order.pop()]  # longest first; about 8,000 padded blocks at once
            while order and (len(some) + 1) * len(pages[some[0]]) <= 8000:
                some.append(order.pop())
            logit = self.logits(*_padded([pages[i] for i in some]))[0]
            for k, i in enumerate(some):
                out[i] = logit[: len(pages[i]), k] > 0
        return out

    def to_bytes(self) -> bytes:
        return np.concatenate([w.ravel() for w in self.weights]).astype("<f4").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> "Labeller":
        flat, out, at = np.frombuffer(data, "<f4"), [], 0
        for w in Labeller.fresh().weights:
            out.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        return Labeller(out)


def weak_label(path: tuple[str, ...]) -> bool:
    """Main text by the names on the path alone; only for training."""
    names = set(path)
    return bool(names & set(MAIN)) and not names & set(OTHERS)


def _dressed(page: list, labels: list[bool], rng: random.Random) -> tuple[list, list[bool]]:
    """The page with other container names and inserted blocks of other kinds."""
    main = rng.choice(DRESS)
    names = {}
    out, y = [], []
    for (path, text, linked), label in zip(page, labels):
        if label:
            leaf = path[-1] if path[-1] in ("p", "li", "td", "pre", "blockquote") or path[-1][0] == "h" else "p"
            out.append((("html", "body", *main, leaf), text, linked))
        else:
            key = path[2] if len(path) > 2 else ""
            other = names.setdefault((key, len(path)), (rng.choice(("div", "section", "ul", "aside")), rng.choice(OTHERS)))
            inside = main if rng.random() < 0.1 else ()
            out.append((("html", "body", *inside, *other, rng.choice(("p", "li", "div", "span"))), text, linked))
        y.append(label)
        if rng.random() < 0.06:
            inside = main if label and rng.random() < 0.7 else ()
            words = text.split()[: rng.randint(1, 40)]
            tag = rng.choice(("div", "section", "aside", "form", "footer", "header"))
            for _ in range(rng.randint(1, 4)):
                out.append((("html", "body", *inside, tag, rng.choice(OTHERS), rng.choice(("p", "div", "li"))), " ".join(words) or "x", rng.choice((0.0, 0.0, 1.0))))
                y.append(False)
    return out, y


def stretches(html: str) -> list[list]:
    """The blocks of a page; of a long one its two ends and stretches between, from places that its text decides."""
    page = blocks(html)
    if len(page) <= WINDOWS * STRETCH:
        return [page] if page else []
    rng, last = random.Random(zlib.crc32(html.encode("utf-8", "replace"))), len(page) - STRETCH
    starts = [0, last, *(rng.randrange(last + 1) for _ in range(WINDOWS - 2))]
    return [page[a : a + STRETCH] for a in starts]


def fit(read: list[list], steps: int = STEPS, seed: int = 11) -> Labeller:
    """A labeller trained on weakly labelled stretches of blocks by Adam."""
    rng = random.Random(seed)
    model = Labeller.fresh()
    if not read:  # no page has any block
        model.weights[5][:] = -20.0
        return model
    labels = [[weak_label(path) for path, _, _ in b] for b in read]
    if not any(map(any, labels)):
        labels = [[not set(path) & set(OTHERS) for path, _, _ in b] for b in read]
    mean, square = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    for k in range(1, steps + 1):
        xs, ys = [], []
        for i in rng.choices(range(len(read)), k=24):
            page, y = (read[i], labels[i]) if rng.random() < 0.4 else _dressed(read[i], labels[i], rng)
            last = max(0, len(page) - 60)
            a = rng.choice((0, last, rng.randint(0, last)))  # the ends, where kinds change, as often as the rest
            xs.append(features(page[a : a + 60]))
            ys.append(np.array(y[a : a + 60], np.float32))
        x, mask = _padded(xs)
        y = np.zeros(mask.shape, np.float32)
        for i, own in enumerate(ys):
            y[: len(own), i] = own
        _, grads = model.step(x, mask, y)
        rate = 0.02 * (1 - 0.9 * k / steps)
        for w, g, m, s in zip(model.weights, grads, mean, square):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-6)
    return model


def train(pages: DataFrame, html_col: str = "html") -> Labeller:
    """Fits in one task on the bounded sample."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [json.dumps(s) for h in batch.column(0).to_pylist() for s in stretches(h)]
            yield pa.RecordBatch.from_pydict({"stretch": pa.array(told, pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = sorted(s for batch in batches for s in batch.column(0).to_pylist())
        read = [[(tuple(path), text, linked) for path, text, linked in json.loads(s)] for s in told]
        yield pa.RecordBatch.from_pydict({"weights": pa.array([fit(read).to_bytes()], pa.binary())})

    usable = pages.select(F.col(html_col).cast("string").alias("html")).where("length(html) > 0").withColumn("h", F.xxhash64("html"))
    # different pages first: a page that holds a third of the rows is one of the sample
    chosen = usable.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(TRAIN_PAGES)
    sample = usable.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min("html").alias("html")).select("html")
    rows = sample.mapInArrow(cut, "stretch string").coalesce(1).mapInArrow(run, "weights binary").collect()
    return Labeller.from_bytes(bytes(rows[0]["weights"])) if rows else fit([])


def extract(pages: DataFrame, model: Labeller, carry: list[str], html_col: str = "html") -> DataFrame:
    """Columns ``carry`` of ``pages`` with the main text and its length in code points."""
    shared = pages.sparkSession.sparkContext.broadcast(model.to_bytes())
    rows = pages.select(*[F.col(f"`{c}`") for c in carry], F.col(html_col).cast("string").alias("html__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.from_bytes(shared.value)
        for batch in batches:
            last = batch.num_columns - 1
            pages, texts = batch.column(last).to_pylist(), []
            for a in range(0, len(pages), 200):
                read = [blocks(h) for h in pages[a : a + 200]]
                main = labeller.main_blocks([features(b) for b in read])
                texts += ["\n\n".join(text for (_, text, _), m in zip(b, keep) if m) for b, keep in zip(read, main)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carry, "text", "n_chars"])

    return rows.mapInArrow(run, rows.drop("html__").schema.add("text", "string").add("n_chars", "long"))
