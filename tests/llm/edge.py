"""Small tables with every awkward case, and brute-force versions."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, token long, n long, gid long, node long, comp long, model string, text__ string, window long, hub long"


def prose(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(4)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    texts = [None, "", " \t\n ", "one two", "one  TWO", "one two three four five", "x" * 50_000, prose(rng, 30_000), base, base.upper(), base + " tail",
             base.replace(" ", "\n"), passage + " " + prose(rng, 90), passage + " " + prose(rng, 90), prose(rng, 80, "éüñß日本"), "123 456 !!!", "\x00\u2028 é"]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, "en" if i % 3 else None, "s" if i % 2 else None))
    for k in range(12):  # near copies of one text, in a chain
        w = base.split()
        for p in range(k):
            w[p * 3] = "chain"
        out.append((100 + k, " ".join(w), "en", "s"))
    out += [(8, base, "en", "s"), (8, prose(rng, 70), "en", "s"), (None, base, "en", "s"), (None, None, None, None), (5, "one two", "en", "s"), (5, "one two", "en", "s")]
    for k in range(40):
        out.append((200 + k, prose(rng, 60, "abcdef" if k % 2 else "ghijkl"), "aa" if k % 2 else "bb", f"s{k % 3}"))
    return [(*r, 0, "r", 1, 2, 3, 4, 5, "m", "t", 6, 7) for r in out]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingle_set(text: str | None) -> frozenset:
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def components(docs: list[tuple], percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingle_set(r[1]) for r in docs]
    comp = list(range(len(docs)))

    def find(i: int) -> int:
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                comp[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(docs):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(docs)]


def key(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row)
