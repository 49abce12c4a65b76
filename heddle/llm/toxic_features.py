"""Dense features of a text for toxicity, from token codes kept in a memo, and the lexicon's terms."""

from __future__ import annotations

import math
import re

import numpy as np

from heddle.llm.chunk_ids import Memo, groups

#: Insults that count from the start, whatever the labels say (fixed values).
SEEDS = frozenset(
    "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown fool jerk creep "
    "imbecile retard bastard bitch asshole shit crap fuck fucking whore slut pig vermin garbage "
    "freak coward liar ugly".split()
)
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch toi vous votre vos usted ustedes tú vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasii")
PREFIXES = (3, 4, 5, 6)
NAMES = (
    "log_tokens", "hit_density", "log_hits", "seed_density", "learned_density", "hidden_density", "second_density", "near_second",
    "capital_rate", "shouted_rate", "punctuation_rate", "exclamation_rate", "symbol_rate", "mixed_rate", "stretched_rate", "crowding",
)
HIT, SEED, HIDDEN, YOU, SHOUT, MIXED, STRETCHED = 1, 2, 4, 8, 16, 32, 64
_WORD = re.compile(r"[^\W_]+")
_STRETCH = re.compile(r"(.)\1{2,}")
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~")] = True
NEAR, CROWD = 5, 50


def terms(word: str) -> list[str]:
    """A word and its prefixes, marked by a star, as lexicon terms."""
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


def plain(word: str) -> str:
    """A token without what is put in to hide it: look-alikes, stretched letters, separators."""
    folded = "".join(_WORD.findall(word.translate(LEET)))
    return _STRETCH.sub(r"\1", folded)


class Features:
    """Texts -> one row of NAMES each."""

    def __init__(self, lexicon: frozenset[str]):
        self.lexicon = lexicon
        self.memo = Memo(lambda tokens: [self._code(t) for t in tokens])

    def _known(self, word: str) -> int:
        if word in SEEDS:
            return HIT | SEED
        return HIT if any(t in self.lexicon for t in terms(word)) else 0

    def _code(self, token: str) -> int:
        low = token.lower()
        words = _WORD.findall(low)
        code = 0
        for w in words:
            code |= self._known(w)
            if w in SECOND:
                code |= YOU
        if not code & HIT and len(low) > 2:
            bare = plain(low)
            if bare not in words and len(bare) > 2 and not bare.isdigit() and self._known(bare):
                code |= HIT | HIDDEN
        if len(token) > 2 and token.isupper():
            code |= SHOUT
        if any(any(c.isdigit() for c in w) and any(c.isalpha() for c in w) for w in words):
            code |= MIXED
        if _STRETCH.search(low) and words:
            code |= STRETCHED
        return code

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(NAMES)))
        at = 0
        for run in groups(texts):
            split = [t.split() for t in run]
            self.memo.learn(split)
            get = self.memo.__getitem__
            for text, tokens in zip(run, split, strict=True):
                out[at] = self._row(text, np.frombuffer(bytes(map(get, tokens)), "uint8"))
                at += 1
        return out

    @staticmethod
    def _row(text: str, codes: np.ndarray) -> list[float]:
        n = max(1, len(codes))
        by = np.bincount(codes, minlength=128)
        count = lambda bit: int(by[[c for c in range(128) if c & bit]].sum())
        hits, seeds, hidden, you = (count(b) for b in (HIT, SEED, HIDDEN, YOU))
        near = crowd = 0.0
        if hits:
            at, yous = np.flatnonzero(codes & HIT), np.flatnonzero(codes & YOU)
            if len(yous):
                right = np.searchsorted(yous, at)
                gap = np.minimum(np.abs(at - yous[np.minimum(right, len(yous) - 1)]), np.abs(at - yous[np.maximum(right - 1, 0)]))
                near = float((gap <= NEAR).mean())
            crowd = float((np.searchsorted(at, at + CROWD) - np.arange(len(at))).max())
        data = np.bincount(np.frombuffer(text.encode("utf-8"), "uint8"), minlength=256)
        size, letters = max(1, int(data.sum())), max(1, int(data[_LETTER].sum()))
        return [
            math.log1p(len(codes)), hits / n, math.log1p(hits), seeds / n, (hits - seeds) / n, hidden / n, you / n, near,
            data[_UPPER].sum() / letters, count(SHOUT) / n, data[_PUNCT].sum() / size, data[33] / size, data[_SYMBOL].sum() / size,
            count(MIXED) / n, count(STRETCHED) / n, crowd,
        ]


def document_terms(text: str) -> set[str]:
    """All terms of a text, for counting documents."""
    return {t for w in set(_WORD.findall(text.lower())) if len(w) > 2 for t in terms(w)}
