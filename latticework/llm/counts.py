"""Edit-aware token counts: a segment tree over the pre-tokens of each text, updated where edits touch it.

Method. A text is cut into pre-tokens by the public tokenizer's pattern; no token crosses a pre-token. The tree's leaves
are the pre-tokens with their characters and token counts, its inner nodes hold sums. An edit finds its leaves by walking down
the character sums, re-encodes the touched leaves with two leaves before and as many after as it takes until a new cut
meets an old one, and puts the new pre-tokens into the first leaf; the others become empty. Only the sums on the paths
to the root change. The count of the text is the root.

The pattern looks ahead one character at most, and never back, so a cut that meets an old cut behind the edit leaves the rest as it was.

Edge cases. Null and empty texts have no leaves and count 0; edits of them insert. Null edits change nothing. Positions are
clipped to the text, a null replacement is empty, and edits apply in order, each to the text the last one left. Very long texts take memory in
proportion. Repeated rows and extra columns stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.frames import append_columns
from latticework.llm.order import PATTERN, Encoder, loaded

KEPT_COUNTS = 500_000
#: Leaves before an edit that are encoded again: whitespace before a word may depend on it.
BEFORE = 2
_CUT = regex.compile(PATTERN)


class Counter:
    """Token counts of pre-tokens, kept for later texts of the task."""

    def __init__(self, encoder: Encoder):
        self.encode = encoder.public.encode_ordinary
        self.kept: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> list[int]:
        kept = self.kept
        try:
            return [kept[p] for p in pieces]
        except KeyError:
            if len(kept) > KEPT_COUNTS:
                kept.clear()
            for p in set(pieces).difference(kept):
                kept[p] = len(self.encode(p))
            return [kept[p] for p in pieces]


class Tree:
    """The leaves of a text and the sums above them; ``chars`` and ``tokens`` are heap-ordered, the root at 1."""

    def __init__(self, text: str, count: Counter):
        self.count = count
        self.leaves: list[list[str]] = [[p] for p in _CUT.findall(text)] if text else []
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars = self._sums(np.array([len(p[0]) for p in self.leaves], np.int64))
        self.tokens = self._sums(np.array(count([p[0] for p in self.leaves]), np.int64))
        self.encoded = 0

    def _sums(self, leaves: np.ndarray) -> np.ndarray:
        tree = np.zeros(2 * self.width, np.int64)
        tree[self.width : self.width + len(leaves)] = leaves
        level = self.width
        while level > 1:
            tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2
        return tree

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.leaves))

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf starts; the last leaf for the end of the text."""
        node, start = 1, 0
        while node < self.width:
            left = int(self.chars[2 * node])
            if position < start + left or self.chars[2 * node + 1] == 0:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return node - self.width, start

    def _set(self, leaf: int, pieces: list[str], tokens: int) -> None:
        self.leaves[leaf] = pieces
        node = leaf + self.width
        change = (sum(map(len, pieces)) - self.chars[node], tokens - self.tokens[node])
        while node:
            self.chars[node] += change[0]
            self.tokens[node] += change[1]
            node //= 2

    def _before(self, leaf: int) -> int:
        leaf -= 1
        while leaf > 0 and not self.leaves[leaf]:
            leaf -= 1
        return max(leaf, 0)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters ``start`` to ``stop`` by ``new``."""
        total = int(self.chars[1])
        start = min(max(start, 0), total)
        stop = min(max(stop, start), total)
        if start == stop and not new:
            return
        if not self.leaves:
            encoded = self.encoded
            self.__init__(new, self.count)
            self.encoded = encoded + len(self.leaves)
            return
        first, _ = self._find(start)
        for _ in range(BEFORE):
            first = self._before(first)
        begin = self._start(first)
        last, last_start = self._find(max(stop - 1, start))
        old = [p for leaf in self.leaves[first : last + 1] for p in leaf]
        region = "".join(old)
        cut = region[: start - begin] + new + region[stop - begin :]
        pieces, done = [], 0
        while True:
            ahead, ends = last + 1, len(cut)
            tail = self._tail(ahead)
            text = cut + tail
            pieces, done = [], 0
            for match in _CUT.finditer(text):
                pieces.append(match.group())
                done = match.end()
                if done >= ends:
                    break
            if done == ends or not tail:
                break
            grown = self._extend(last)
            cut += "".join(p for leaf in self.leaves[last + 1 : grown + 1] for p in leaf)
            last = grown
        self.encoded += len(pieces)
        self._set(first, pieces, sum(self.count(pieces)))
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, [], 0)

    def _start(self, leaf: int) -> int:
        """Characters before a leaf."""
        node, total = leaf + self.width, 0
        while node > 1:
            if node % 2:
                total += int(self.chars[node - 1])
            node //= 2
        return total

    def _extend(self, leaf: int) -> int:
        leaf += 1
        while leaf + 1 < len(self.leaves) and not self.leaves[leaf]:
            leaf += 1
        return leaf

    def _tail(self, leaf: int) -> str:
        """Context behind a region: the next two pre-tokens."""
        out, at = [], leaf
        while at < len(self.leaves) and len(out) < 2:
            out += self.leaves[at]
            at += 1
        return "".join(out)

    def state(self) -> tuple[bytes, bytes, bytes]:
        """Lengths of the pre-tokens, and both trees, for keeping."""
        sizes = np.array([len(p) for leaf in self.leaves for p in leaf], "<i4")
        per_leaf = np.array([len(leaf) for leaf in self.leaves], "<i4")
        return sizes.tobytes() + per_leaf.tobytes(), self.chars.astype("<i8").tobytes(), self.tokens.astype("<i8").tobytes()

    @classmethod
    def kept(cls, text: str, leaves: bytes, chars: bytes, tokens: bytes, count: Counter) -> Tree:
        """A tree from its kept state and current text, without encoding anything."""
        tree = cls("", count)
        tree.chars, tree.tokens = np.frombuffer(chars, "<i8").astype(np.int64), np.frombuffer(tokens, "<i8").astype(np.int64)
        tree.width = len(tree.chars) // 2
        numbers = np.frombuffer(leaves, "<i4")
        n = _leaf_count(numbers)
        sizes, per_leaf = numbers[: len(numbers) - n], numbers[len(numbers) - n :]
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        pieces = [text[a:b] for a, b in zip(ends, ends[1:])]
        edges = np.concatenate([[0], np.cumsum(per_leaf)]).tolist()
        tree.leaves = [pieces[a:b] for a, b in zip(edges, edges[1:])]
        return tree


def _leaf_count(numbers: np.ndarray) -> int:
    """How many of the last numbers count the pre-tokens of leaves: their sum is the number of those before them."""
    total = len(numbers)
    sums = np.concatenate([[0], np.cumsum(numbers[::-1])])
    for n in range(total + 1):
        if sums[n] == total - n:
            return n
    raise ValueError("not a kept tree")


_COUNTERS: dict[bytes, Counter] = {}


def _counter(vocabulary: bytes) -> Counter:
    if vocabulary not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[vocabulary] = Counter(loaded(vocabulary))
    return _COUNTERS[vocabulary]


EDITS = "array<struct<start:int,stop:int,text:string>>"
COUNTED = "n_tokens_before long, n_tokens long, n_pieces long, n_encoded long, n_chars long"


def count_edited(docs: DataFrame, vocabulary: bytes, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``docs`` with token counts before and after its edits, and how many pre-tokens the edits encoded again."""
    text_at, edits_at = docs.columns.index(text_col), docs.columns.index(edits_col)

    def make(batch: pa.RecordBatch) -> list:
        count, rows = _counter(vocabulary), []
        edits = batch.column(edits_at)
        for i, text in enumerate(batch.column(text_at)):
            tree = Tree(text.as_py() or "", count)
            before = tree.n_tokens
            for edit in edits[i].as_py() or ():
                if edit is not None:
                    tree.edit(edit["start"] or 0, edit["stop"] or 0, edit["text"] or "")
            rows.append((before, tree.n_tokens, tree.n_pieces, tree.encoded, int(tree.chars[1])))
        return [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5

    return append_columns(docs, COUNTED, make)


STATE = "leaves binary, char_tree binary, token_tree binary, n_tokens long"


def build(docs: DataFrame, vocabulary: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the kept tree of every text."""
    place = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch) -> list:
        trees = [Tree(text or "", _counter(vocabulary)) for text in batch.column(place).to_pylist()]
        states = [t.state() for t in trees]
        return [pa.array([s[i] for s in states], pa.binary()) for i in range(3)] + [pa.array([t.n_tokens for t in trees], pa.int64())]

    return append_columns(docs, STATE, make)


def update(docs: DataFrame, vocabulary: bytes, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Kept trees and texts after their edits; only what the edits touch is encoded."""
    at = {c: docs.columns.index(c) for c in (text_col, edits_col, "leaves", "char_tree", "token_tree")}

    def make(batch: pa.RecordBatch) -> list:
        count, texts, trees = _counter(vocabulary), [], []
        for text, edits, *state in zip(*(batch.column(i).to_pylist() for i in at.values())):
            tree = Tree.kept(text or "", *state, count)
            for edit in edits or ():
                if edit is not None:
                    tree.edit(edit["start"] or 0, edit["stop"] or 0, edit["text"] or "")
            trees.append(tree)
            texts.append(tree.text())
        states = [t.state() for t in trees]
        return [pa.array(texts, pa.string())] + [pa.array([s[i] for s in states], pa.binary()) for i in range(3)] + [pa.array([t.n_tokens for t in trees], pa.int64())]

    return append_columns(docs, f"{text_col} string, {STATE}", make)


def sample_edits(text_col: str = "text") -> Column:
    """Three edits made from a text itself: an insertion in the middle, a deletion, a replacement near the end."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.length(text)

    def edit(start: Column, stop: Column, new: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), new.alias("text"))

    middle, quarter, end = F.floor(size / 2), F.floor(size / 4), F.greatest(size - 9, F.lit(0))
    return F.array(edit(middle, middle, F.substring(text, 1, 24)), edit(quarter, quarter + 12, F.lit("")), edit(end, end + 5, F.upper(F.substring(text, 5, 7))))
