"""Extractive summary models (M3, M6): sentences of the text itself, chosen by what the text says.

A text is cut at line ends and at ``.``, ``!`` and ``?``; all sentences of any text count, wherever they are.
"""

from __future__ import annotations

import re

import numpy as np

_SENTENCE = re.compile(r"[.!?\n]+")
_TOKEN = re.compile(r"[^\W_]+")
_BLANK = " \t\r\n"


def sentences(text: str | None) -> list[str]:
    return [p for p in (x.strip(_BLANK) for x in _SENTENCE.split(text or "")) if p]


def joined(parts: list[str], chosen: list[int]) -> str:
    return ". ".join(parts[i] for i in sorted(chosen)) + "." if chosen else ""


def centrality(words: list[list[str]], rounds: int, damping: float) -> tuple[np.ndarray, bool]:
    """PageRank of the sentences over their cosine similarities by word counts, after ``rounds`` steps from equal ranks, in
    multiples of the mean; and whether any two sentences share a word.

    The similarities are the products of the sentences' unit vectors, so a step multiplies by the sentence-word table and its
    transpose: time and memory go with the words, not with the pairs of sentences.
    """
    n = len(words)
    seen: dict[str, int] = {}
    row, col = [], []
    for i, ws in enumerate(words):
        row += [i] * len(ws)
        col += [seen.setdefault(w, len(seen)) for w in ws]
    cell, tf = np.unique(np.array(row, np.int64) * max(len(seen), 1) + np.array(col, np.int64), return_counts=True)
    r, c = np.divmod(cell, max(len(seen), 1))
    length = np.sqrt(np.bincount(r, tf.astype(float) ** 2, n))
    x = tf / length[r]
    own = np.bincount(r, x * x, n)

    def similar(v: np.ndarray) -> np.ndarray:
        """The similarities to the other sentences times ``v``."""
        by_word = np.bincount(c, x * v[r], max(len(seen), 1))
        return np.bincount(r, x * by_word[c], n) - own * v

    total = similar(np.ones(n))
    linked = total > 1e-9
    v = np.full(n, 1 / n)
    for _ in range(rounds):
        v = (1 - damping) / n + damping * similar(np.divide(v, total, out=np.zeros(n), where=linked))
    return v * n, bool(linked.any())


class CentralSentences:
    """The ``n`` most central sentences in text order (ties: more different words, then the earlier one).

    With ``answer_unlinked=False`` a text whose sentences have no word in common gets no answer, which leaves it to a
    fallback model.
    """

    def __init__(self, n: int = 2, rounds: int = 10, damping: float = 0.85, answer_unlinked: bool = True, name: str = "central-sentences"):
        self.n, self.rounds, self.damping, self.answer_unlinked, self.name = n, rounds, damping, answer_unlinked, name

    def generate(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            parts = sentences(t)
            words = [_TOKEN.findall(p.lower()) for p in parts]
            if not parts:
                out.append("")
                continue
            rank, linked = centrality(words, self.rounds, self.damping)
            if not linked and not self.answer_unlinked:
                out.append("")
                continue
            rank = np.round(rank, 9)
            out.append(joined(parts, sorted(range(len(parts)), key=lambda i: (-rank[i], -len(set(words[i])), i))[:self.n]))
        return out


class KeySentences:
    """The ``n`` sentences with the most different words, in text order (ties: the earlier one)."""

    def __init__(self, n: int = 2, name: str = "key-sentences"):
        self.n, self.name = n, name

    def generate(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            parts = sentences(t)
            out.append(joined(parts, sorted(range(len(parts)), key=lambda i: (-len(set(_TOKEN.findall(parts[i].lower()))), i))[:self.n]))
        return out
