"""Exact token counts of every prefix by dynamic programming, without encoding texts.

A byte-level BPE encodes a word as the one sequence of tokens whose neighbours all survive
each other: no merge crosses the border of two neighbouring tokens before the merges that built
them. So the last token of every prefix of a word follows from shorter prefixes:

    last[i] = the token t that ends at i with last[i - len(t)] and t surviving each other
    count[i] = count[i - len(t)] + 1

The table is filled for many words at once with numpy; a worker fills it once per distinct word.
The counts at every prefix answer how many tokens a cut text has and where a budget runs out.

Defined cases: a null or empty text has 0 tokens and one (empty) prefix; rows are answered one by
one, so repeated rows give repeated answers; columns other than id and text are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record, texts
from .pieces import CUT, Pieces, Ragged, Words, byte_letters
from .token_files import _chunks

LONG = 256
NEVER = np.int64(1 << 40)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """Vocabulary as numbered merges: 0..255 are the bytes, 256 + i is the result of merge i."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        spelled = [bytes([b]) for b in range(256)]
        number = {s: i for i, s in enumerate(spelled)}
        left, right, keys = [-1] * 256, [-1] * 256, []
        for a, b in merges:
            left.append(number[a])
            right.append(number[b])
            if a + b in number:
                raise ValueError("two merges give the same token")
            number[a + b] = len(spelled)
            spelled.append(a + b)
            keys.append((number[a] << 32) | number[b])
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.spelled = spelled
        order = np.argsort(np.array(keys, np.int64), kind="stable") if keys else np.empty(0, np.int64)
        self.pair_keys, self.pair_token = np.array(keys, np.int64)[order], order + 256
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(spelled):
            by_length.setdefault(len(s), []).append(i)
        self.by_length = {}
        for n, members in sorted(by_length.items()):
            rows = np.frombuffer(b"".join(spelled[i] for i in members), np.uint8).reshape(len(members), n)
            h = self._hash(rows)
            o = np.argsort(h)
            self.by_length[n] = (h[o], np.array(members, np.int64)[o], rows[o])

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for c in range(rows.shape[1]):
            h = (h ^ rows[:, c].astype(np.uint64)) * _MULT
            h ^= h >> np.uint64(29)
        return h

    def tokens(self, rows: np.ndarray) -> np.ndarray:
        """Token number of each byte row, -1 where the row is not a token."""
        entry = self.by_length.get(rows.shape[1])
        out = np.full(len(rows), -1, np.int64)
        if entry is None or not len(rows):
            return out
        hashes, members, spelled = entry
        at = np.minimum(np.searchsorted(hashes, h := self._hash(rows)), len(hashes) - 1)
        hit = np.flatnonzero(hashes[at] == h)
        hit = hit[(spelled[at[hit]] == rows[hit]).all(axis=1)]
        out[hit] = members[at[hit]]
        return out

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token that a pair merges into; NEVER where no merge exists."""
        keys = (a << 32) | b
        if not len(self.pair_keys):
            return np.full(len(a), NEVER, np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_token[at], NEVER)

    def survive(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do neighbours a, b stay apart? Merges are undone from the latest to the earliest (of two
        equal ones the right is the later, since a word is merged from the left); at each state the pair
        at the border must not merge before the next merge beside it."""
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), NEVER, np.int64)
        while len(live):
            x, y = a[live], b[live]
            bad = self.merged(x, y) < limit[live]
            ok[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            undo_left = x > y  # a token's number is the rank of its last merge
            more = np.where(undo_left, x, y) >= 256
            live, x, y, undo_left = live[more], x[more], y[more], undo_left[more]
            limit[live] = np.where(undo_left, x, y + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return ok

    def prefix_counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts at prefixes 1..n of each word end to end, and the word lengths."""
        lengths = np.array([len(w) for w in words], np.int32)
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        flat = np.zeros(int(lengths.sum()), np.uint32)
        order = np.argsort(lengths, kind="stable")
        i = 0
        while i < len(order):  # words of like length together; a very long one alone
            n = int(lengths[order[i]])
            top = n + max(1, n // 4)
            j = i
            while j < len(order) and lengths[order[j]] <= top and (j - i) * top < 2_000_000:
                j += 1
            j = max(j, i + 1)
            group = order[i:j]
            if n > LONG:
                for k in group:
                    flat[starts[k]:starts[k] + lengths[k]] = self._fill_long(words[k])
                i = j
                continue
            counts = self._fill([words[k] for k in group], lengths[group])
            for col in range(counts.shape[1]):
                has = lengths[group] > col
                flat[starts[group[has]] + col] = counts[has, col]
            i = j
        return flat, lengths

    def _fill_long(self, word: bytes) -> list[int]:
        """The same table for one long word: tokens are found for all ends at once, then ends go in order."""
        row = np.frombuffer(word, np.uint8)
        found: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
        for n in sorted(self.by_length, reverse=True):
            if n <= len(word):
                for a in range(0, len(word) - n + 1, 200_000):
                    token = self.tokens(np.lib.stride_tricks.sliding_window_view(row[a:a + 200_000 + n - 1], n))
                    for e in np.flatnonzero(token >= 0).tolist():
                        found[a + e + n].append((n, int(token[e])))
        last, count, known = [-1] * (len(word) + 1), [0] * (len(word) + 1), {}
        for end in range(1, len(word) + 1):
            for n, token in found[end]:
                pair = (last[end - n], token)
                if n < end and pair not in known:
                    known[pair] = bool(self.survive(np.array(pair[:1]), np.array(pair[1:]))[0])
                if n == end or known[pair]:
                    last[end], count[end] = token, count[end - n] + 1
                    break
        return count[1:]

    def _fill(self, words: list[bytes], lengths: np.ndarray) -> np.ndarray:
        most = int(lengths.max(initial=0))
        grid = np.zeros((len(words), most), np.uint8)
        for r, w in enumerate(words):
            grid[r, :len(w)] = np.frombuffer(w, np.uint8)
        last = np.full((len(words), most + 1), -1, np.int64)
        count = np.zeros((len(words), most + 1), np.uint32)
        for end in range(1, most + 1):
            todo = np.flatnonzero(lengths >= end)
            for n in sorted((n for n in self.by_length if n <= end), reverse=True):
                if not len(todo):
                    break
                token = self.tokens(grid[todo, end - n:end])
                hit = np.flatnonzero(token >= 0)
                if n < end and len(hit):
                    before = last[todo[hit], end - n]
                    hit = hit[self.survive(before, token[hit])]
                rows = todo[hit]
                last[rows, end] = token[hit]
                count[rows, end] = count[rows, end - n] + 1
                todo = np.delete(todo, hit)
            if len(todo):
                raise ValueError("a prefix without a last token: the merges are not those of a byte-level BPE")
        return count[:, 1:]


class PrefixCounter:
    """Counts for texts of the tokenizer at ``path`` (its pre-tokenizer, added tokens and merges)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.plain = Words(self.tokenizer)
        self.added = self.plain.added
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if not Words.independent(config):
            raise ValueError("prefix counts need a byte-level BPE without normalizer")
        merges = config["model"]["merges"]
        self.letters = byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.table = MergeTable([(self._bytes(a), self._bytes(b)) for a, b in pairs])
        self.words: dict[str, int] = {}
        self.word_prefixes = Ragged(np.uint32)
        self.piece_tokens = Ragged(np.int32)
        self.piece_bytes = Ragged(np.int32)
        self.pieces = Pieces(self._learn, self._forget)

    def _bytes(self, spelled: str) -> bytes:
        return bytes(map(self.letters.__getitem__, spelled))

    def _forget(self) -> None:
        self.words, self.word_prefixes = {}, Ragged(np.uint32)
        self.piece_tokens, self.piece_bytes = Ragged(np.int32), Ragged(np.int32)

    def _parts(self, text: str) -> list[str | None]:
        """Byte-letter words of a text in order; None stands for an added token."""
        for a in self.added:
            if a in text:
                head, tail = text.split(a, 1)
                return [*self._parts(head), None, *self._parts(tail)]
        return self.plain(text) if text else []

    def _known(self, parts: list[list[str | None]]) -> None:
        fresh = dict.fromkeys(w for p in parts for w in p if w is not None and w not in self.words)
        if fresh:
            flat, lengths = self.table.prefix_counts([self._bytes(w) for w in fresh])
            for w in fresh:
                self.words[w] = len(self.words)
            self.word_prefixes.add(flat, lengths)

    def _prefixes(self, word: str) -> np.ndarray:
        return self.word_prefixes.gather(np.array([self.words[word]]))

    def _learn(self, new: list[str]) -> None:
        parts = [self._parts(p) for p in new]
        self._known(parts)
        size = len(self.words)
        ends = self.word_prefixes.starts[:size] + self.word_prefixes.lengths[:size] - 1
        whole = self.word_prefixes.flat[ends].tolist() if size else []
        number = self.words
        counts = np.array([sum(1 if w is None else whole[number[w]] for w in p) for p in parts], np.int32)
        one = np.ones(len(new), np.int32)
        self.piece_tokens.add(counts, one)
        self.piece_bytes.add(np.array([len(p.encode()) for p in new], np.int32), one)

    def piece_prefixes(self, piece: str) -> np.ndarray:
        """Exact token counts of piece[:k] for k = 0..len(piece), as if each prefix were a text.

        Inside a word the table has the answer. Three kinds of prefix end differently when cut: one in
        white space (the run is then one word), one inside an apostrophe ending such as 're (which falls
        apart), and one inside an added token (its characters are then ordinary); these last words
        are looked up anew.
        """
        if any(a in piece for a in self.added):
            return np.array([self.count(piece[:k]) for k in range(len(piece) + 1)], np.int64)
        out = np.zeros(len(piece) + 1, np.int64)
        spans = self.split(piece)
        self._known([[w for w, _ in spans]])
        base = 0
        for word, (a, b) in spans:
            prefixes = self._prefixes(word)
            at = np.cumsum([len(c.encode()) for c in piece[a:b]]) - 1
            out[a + 1:b + 1] = base + prefixes[at]
            if piece[a] == "'" and b - a == 3:
                out[a + 2] = base + self.count(piece[a:a + 2])
            base += int(prefixes[-1])
        run = 0
        for k in range(1, len(piece) + 1):
            if piece[k - 1].isspace():
                out[k] = out[run] + self.count(piece[run:k])
            else:
                run = k
        return out

    def count(self, text: str) -> int:
        parts = self._parts(text)
        self._known([parts])
        return sum(1 if w is None else int(self._prefixes(w)[-1]) for w in parts)

    def text_pieces(self, text: str) -> list[str]:
        head, *rest = CUT.split(text)
        return [head, *[" " + r for r in rest]]

    def text_prefixes(self, text: str) -> np.ndarray:
        """Exact token counts of text[:k] for k = 0..len(text)."""
        out, base = [np.zeros(1, np.int64)], 0
        for piece in self.text_pieces(text) if text else []:
            counts = self.piece_prefixes(piece)
            out.append(base + counts[1:])
            base += int(counts[-1])
        return np.concatenate(out)

    def measure(self, batch: list[str], limit: int) -> tuple[list[int], list[int], list[int]]:
        """Bytes, tokens, and characters of a prefix that fits ``limit`` tokens, of each text."""
        n_bytes, n_tokens, fits = [], [], []
        for text, numbers in zip(batch, self.pieces.number(batch), strict=True):
            tokens = np.cumsum(self.piece_tokens.flat[numbers], dtype=np.int64)
            total = int(tokens[-1]) if len(tokens) else 0
            n_bytes.append(int(self.piece_bytes.flat[numbers].sum(dtype=np.int64)))
            n_tokens.append(total)
            if total <= limit:
                fits.append(len(text))
                continue
            over = int(np.searchsorted(tokens, limit, side="right"))  # first piece that ends beyond the limit
            pieces = self.text_pieces(text)
            before = int(tokens[over - 1]) if over else 0
            inside = self.piece_prefixes(pieces[over]) + before
            fits.append(sum(map(len, pieces[:over])) + int(np.flatnonzero(inside <= limit)[-1]))
        return n_bytes, n_tokens, fits


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars: characters of the longest prefix that
    ends in the first piece over the limit (or before it) and has at most ``limit`` tokens.

    No exchange: each partition is counted where it is read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer_path)
        for batch in batches:
            contents = texts(batch.column("text"))
            for run in _chunks(contents):
                n_bytes, n_tokens, fits = tool.measure(contents[run], limit)
                yield record(schema, doc_id=batch.column("doc_id")[run.start:run.stop], n_bytes=n_bytes, n_tokens=n_tokens, over_limit=[n > limit for n in n_tokens], fit_chars=fits)

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the token count at every character prefix (0..n) as a little-endian int32 array."""
    schema = pa.schema([("doc_id", pa.int64()), ("counts", pa.binary())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer_path)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), texts(batch.column("text")), strict=True):
                yield record(schema, doc_id=[doc_id.as_py()], counts=[tool.text_prefixes(text).astype("<i4").tobytes()])

    return docs.select("doc_id", "text").mapInArrow(fill, "doc_id long, counts binary")


def budget_cut(counts: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens, from a stored table."""
    return int(np.flatnonzero(np.frombuffer(counts, "<i4") <= budget)[-1])
