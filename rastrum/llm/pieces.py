"""Texts as sequences of independent pieces for byte-level BPE.

The pattern of a byte-level BPE always starts a new word at a single space that has a non-space
on both sides. A text cut at those spaces gives pieces whose token ids do not depend on each other,
so the ids of a text are the ids of its pieces in order. Pieces repeat a lot; a worker numbers
the pieces it has met and encodes each of them once.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import numpy as np

CUT = re.compile(r"(?<=\S) (?=\S)")
PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,!?;:]*)")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 characters
    stand for themselves, the other bytes take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_LETTER_OF = {b: c for c, b in byte_letters().items()}


class Words:
    """Byte-letter words of a piece: the common shape, Latin letters and then marks, is cut here,
    anything else by the tokenizer's own pre-tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    def independent(config: dict) -> bool:
        """Is this a tokenizer whose texts may be cut at single spaces?"""
        pre = config.get("pre_tokenizer") or {}
        return (config["model"]["type"] == "BPE" and config.get("normalizer") is None and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in config["added_tokens"]))

    def __call__(self, piece: str) -> list[str]:
        found = PLAIN.fullmatch(piece)
        if found is None:
            return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]
        word, marks = found.groups()
        word = word.encode().decode("latin-1").translate(_LETTER_OF)
        return [word, marks] if marks else [word]


class _Numbers(dict):
    """piece -> number; a new piece gets the next number, one with outer white space gets -1."""

    def __init__(self, owner: "Pieces", lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> int:
        if not self.owner.irregular and (not piece or piece[0].isspace() or piece[-1].isspace()):
            return -1  # not remembered: the whole text is cut again with the exact rule
        new = self.owner.fresh
        self[piece] = n = self.owner.size + len(new)
        new.append(self.lead + piece)
        return n


class Pieces:
    """Numbers for pieces and, for every number, what ``learn`` says about the piece.

    ``learn`` takes the new pieces and returns nothing; it is called once per piece. When more
    than ``most`` pieces are known at the start of a batch, all are forgotten and ``forget`` is
    called, which bounds the memory and changes no result.
    """

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], most: int = 700_000):
        self.learn, self.forget, self.most = learn, forget, most
        self.irregular = False
        self._clear()

    def _clear(self) -> None:
        self.size, self.fresh = 0, []
        self.first, self.inner = _Numbers(self, ""), _Numbers(self, " ")

    def _numbers(self, text: str) -> np.ndarray:
        parts = CUT.split(text) if self.irregular else text.split(" ")
        head = self.first[parts[0]]
        out = np.fromiter(itertools.chain((head,), map(self.inner.__getitem__, itertools.islice(parts, 1, None))), np.int32, len(parts))
        if not self.irregular and len(out) and out.min() < 0:
            self.irregular = True
            try:
                return self._numbers(text)
            finally:
                self.irregular = False
        return out

    def number(self, batch: list[str]) -> list[np.ndarray]:
        """Piece numbers of each text; an empty text has none."""
        if self.size > self.most:
            self._clear()
            self.forget()
        out = [self._numbers(t) if t else np.empty(0, np.int32) for t in batch]
        if self.fresh:
            new, self.fresh = self.fresh, []
            self.learn(new)
            self.size += len(new)
        return out


class Ragged:
    """Arrays of different lengths, kept end to end in one growing buffer."""

    def __init__(self, dtype):
        self.flat, self.used = np.empty(1 << 16, dtype), 0
        self.starts, self.lengths, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.count + len(lengths) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, np.empty_like(self.starts)]), np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.flat[self.used:self.used + len(flat)] = flat
        span = slice(self.count, self.count + len(lengths))
        self.lengths[span] = lengths
        self.starts[span] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.count += len(lengths)

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The arrays of ``numbers``, end to end."""
        n = self.lengths[numbers]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[numbers] - (ends - n), n) + np.arange(total)]
