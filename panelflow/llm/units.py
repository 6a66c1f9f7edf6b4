"""Texts as distinct units for a tokenizer.

A space followed by a character that is no white space always begins a new
token of the tokenizers used here (their patterns attach at most that space to
the word and never look back over it); so does an ASCII character other than a
letter after an ASCII letter, and a character after a single line end.  A text
may be cut there and its pieces encoded apart.  Tokenizers that fold case and
drop white space also take A-Z as a-z and pieces without the space.  Only the
first kind of cut keeps special strings, so texts with ``<|`` are cut at spaces
and not folded.  Words recur, so a worker encodes each distinct piece once while
it remembers it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np

#: Bytes of text in one call of the library's batch, and in one Arrow batch's inner batches.
BATCH_BYTES = 4 << 20
#: Plain words in one line of the library's batch.
LINE = 400
_SPACE = re.compile(r"(?= \S)")
_CUT = re.compile(r"(?= \S)|(?<=[A-Za-z])(?=[\x00-\x40\x5b-\x60\x7b-\x7f])|(?<=\S\n)(?=\S)")
_INNER = re.compile(r"(?<=[A-Za-z])(?=[\x00-\x1f\x21-\x40\x5b-\x60\x7b-\x7f])")
_WIDE = re.compile(r" (?=\s|$)")


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The tokenizer of file ``name``, loaded once per worker; the file must be installed there."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already fills the cores
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about equal bytes; a longer text is a range alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def cut(text: str, folds: bool = False) -> list[str]:
    """Units of a text, in order."""
    if not text:
        return []
    if "<|" in text:
        return _SPACE.split(text)
    out: list[str] = []
    if folds:  # cuts become spaces, which fall away
        text = text.encode().lower().decode().replace("\n", " ")  # A-Z only
        return list(filter(None, _INNER.sub(" ", text).split(" ")))
    if _WIDE.search(text):
        return _CUT.split(text)
    words = text.split(" ")
    out += _CUT.split(words[0])
    for word in words[1:]:
        if word.isalpha():
            out.append(" " + word)
        else:
            out += _CUT.split(" " + word)
    return out


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of ``sizes`` values; zero for empty runs."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def parts(text: str, limit: int = BATCH_BYTES) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters, cut at safe places only."""
    start = 0
    while len(text) - start > limit:
        at = _SPACE.search(text, start + limit)
        if at is None:
            break
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """``values``, moved to twice the room if they hold fewer than ``size``."""
    if size <= len(values):
        return values
    out = np.zeros(max(size, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


class _Slots(dict):
    """Numbers units in the order in which they are first met."""

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


@lru_cache(maxsize=4)
def encoder(name: str) -> "Encoder":
    """The encoder of a worker process, which lives longer than one task."""
    return Encoder(name)


class Encoder:
    """Token ids of texts with a bounded memory of the units met before."""

    def __init__(self, name: str, most: int = 300_000) -> None:
        self.library = tokenizer(name)
        self.most = most
        # this normalizer folds case and white space, and its pattern drops the latter
        self.folds = "Lowercase" in str(self.library.normalizer)
        self._forget()

    def _forget(self) -> None:
        self.slots = _Slots()
        self.known, self.used = 0, 0
        # arrays with room to grow: per slot its number of ids and their place, and the ids of all
        self.sizes = np.zeros(1 << 12, np.int64)
        self.starts = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)

    def _learn(self) -> None:
        """Encodes the units that have a slot but no ids yet."""
        if self.known == len(self.slots):
            return
        new = list(islice(self.slots, self.known, None))
        for a, b in by_bytes(new, 1 << 18):
            sizes, ids = self._encode(new[a:b])
            end, last = self.known + len(sizes), self.used + len(ids)
            self.sizes, self.starts, self.flat = _room(self.sizes, end), _room(self.starts, end), _room(self.flat, last)
            self.sizes[self.known : end] = sizes
            self.starts[self.known : end] = self.used + np.cumsum(sizes) - sizes
            self.flat[self.used : last] = ids
            self.known, self.used = end, last

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids per unit, and all ids.  Plain words are encoded in lines: the library then tells the word of each id."""
        glue = " " if self.folds else ""
        plain = [i for i, u in enumerate(new) if (u.isalpha() if self.folds else u[:1] == " " and u[1:].isalpha())]
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        sizes = np.zeros(len(new), np.int64)
        found: list[tuple[int, np.ndarray]] = []
        rest = set(range(len(new))).difference(plain)
        for line, e in zip(lines, self.library.encode_batch([glue.join(new[i] for i in line) for line in lines], add_special_tokens=False)):
            counts = np.bincount(np.array(e.word_ids, np.int64)) if e.ids else np.zeros(0, np.int64)
            if len(counts) == len(line) and counts.all():
                sizes[line] = counts
                found.append((line[0], np.array(e.ids, np.uint32)))
            else:
                rest.update(line)
        order = sorted(rest)
        got = [e.ids for e in self.library.encode_batch_fast([new[i] for i in order], add_special_tokens=False)]
        sizes[order] = [len(x) for x in got]
        out = np.zeros(sizes.sum(), np.uint32)
        at = np.cumsum(sizes) - sizes
        for line in lines:
            if found and found[0][0] == line[0]:
                ids = found.pop(0)[1]
                own = sizes[line]
                ends = np.cumsum(own)
                out[np.repeat(at[line] - ends + own, own) + np.arange(len(ids))] = ids
        own = sizes[order]
        ends = np.cumsum(own)
        flat = np.fromiter(chain.from_iterable(got), np.uint32)
        out[np.repeat(at[order] - ends + own, own) + np.arange(len(flat))] = flat
        return sizes, out

    def _slots_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slot of every unit of the texts, and units per text."""
        if len(self.slots) > self.most:
            self._forget()
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = cut(t, self.folds)
            counts[i] = len(own)
            pieces += own
        at = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        return at, counts

    def _batches(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Texts, or parts of long ones, in batches of about ``BATCH_BYTES``; with the place of each part's text."""
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for p in parts(t):
                pieces.append(p)
                owner.append(i)
        for a, b in by_bytes(pieces):
            yield owner[a:b], pieces[a:b]

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for owner, pieces in self._batches(texts):
            at, counts = self._slots_of(pieces)
            np.add.at(out, owner, sums(self.sizes[at], counts))
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for owner, pieces in self._batches(texts):
            at, counts = self._slots_of(pieces)
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            flat = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(len(sizes) and ends[-1])]
            edges = np.concatenate(([0], np.cumsum(sums(sizes, counts))))
            for i, a, b in zip(owner, edges[:-1], edges[1:]):
                out[i].append(flat[a:b])
        return [o[0] if len(o) == 1 else np.concatenate([np.zeros(0, np.uint32), *o]) for o in out]
