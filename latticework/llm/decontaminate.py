"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Method. The test items are taken in blocks of bounded size (``BLOCK_WORDS``), every block against all
documents. A first scan counts in how many documents each item's n-grams occur. A seed is rare for its item
if its document count is at most ``RARE_FACTOR`` times the median of the item; the others may be stock phrases,
but also all that an edited passage in many documents has left, so every seed is looked for. The second scan
aligns the words around seed hits with the item (match 2, mismatch -1, gap -1) inside the task that read the
text. Where no hit is rare, the pair is aligned only if the text there holds enough of the item's words to reach
the least score at all, which loses nothing. The score is that of the best local alignment over that of the item
with itself. No shuffle moves texts, and no pair without a seed is ever made.

Edge cases. Words are runs of bytes other than ASCII white space, A-Z lower-cased. Null or empty texts and
items match nothing. An item of fewer words than a seed is one seed of its own length. Rows with equal ids
are judged one by one, and each pair of ids comes out once with its best score. Very long texts are aligned only
around their seeds, all of them, and as far from them as gaps can lead. A pair without three words in a row in common is not
found; the tests measure how many pairs above the least score that leaves out. An empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm import words
from latticework.llm.frames import standard

#: Words of a seed.
SEED_WORDS = 3
RARE_FACTOR = 4
RARE_FLOOR = 8
#: Least share of the item's own score.
MIN_SCORE = 0.6
#: Words of the items that one scan carries to every task (8 bytes each, and as much again for their seeds).
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, 1
_CELLS = 200_000
#: Seed hits times items with the seed that are laid out at once, and words checked at once; neither changes results.
_ENTRIES = 2_000_000
_CHECKED_WORDS = 1 << 17


class Items:
    """A block of test items: word hashes, and the sorted seed hashes with the items and places they come from."""

    def __init__(self, ids: pa.Array, texts: pa.Array, seed_words: int = SEED_WORDS):
        self.ids = ids
        self.words: list[np.ndarray] = []
        found = []
        for run in words.runs(texts):
            for i in range(len(run)):
                mine = run.hashes[run.bounds[i] : run.bounds[i + 1]]
                self.words.append(mine)
                n = min(seed_words, len(mine))
                for j in range(len(mine) - n + 1 if n else 0):
                    found.append((n, words.sequence_hash(mine[j : j + n]), run.first + i, j))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.concatenate([np.zeros(0, words.U64), *self.words])
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.sizes = sorted({n for n, _, _, _ in found})
        table = np.array([(h, i, j) for _, h, i, j in found], dtype=[("hash", words.U64), ("item", np.int64), ("place", np.int64)])
        self.table = np.sort(table, order=["hash", "item", "place"])
        self.rare = np.ones(len(self.table), bool)
        self.seeds, self.starts = np.unique(self.table["hash"], return_index=True)
        self.ends = np.append(self.starts[1:], len(self.table))
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.seeds >> words.U64(44)).astype(np.int64)] = True

    def mark_rare(self, counts: dict[int, int]) -> None:
        """Mark the seeds that are not far more frequent than their item's median seed."""
        df = np.array([counts.get(int(h) - 2**63, 0) for h in self.table["hash"]], np.int64)
        order = np.argsort(self.table["item"], kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(self.table["item"][order])) + 1) if len(order) else []:
            self.rare[rows] = df[rows] <= max(RARE_FLOOR, RARE_FACTOR * np.median(df[rows]))

    def hits(self, run: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Words of a run where a seed starts, and which seed."""
        at, which = [], []
        for n in self.sizes:
            if len(run.hashes) < n:
                continue
            ends = np.repeat(run.bounds[1:], run.counts)
            sums = words.window_hashes(run.hashes, n)
            some = np.flatnonzero(self.near[(sums >> words.U64(44)).astype(np.int64)])
            some = some[some + n <= ends[some]]
            slot = np.searchsorted(self.seeds, sums[some])
            good = slot < len(self.seeds)
            good[good] = self.seeds[slot[good]] == sums[some[good]]
            at.append(some[good])
            which.append(slot[good])
        return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of many (item, window) pairs at once; one step moves along the windows by a word."""
    wide, deep = max(map(len, items)), max(map(len, windows))
    a = np.zeros((len(items), wide), words.U64)
    is_word = np.zeros((len(items), wide), bool)
    b = np.zeros((len(items), deep), words.U64)
    depth = np.array([len(w) for w in windows])
    for i, (item, window) in enumerate(zip(items, windows)):
        a[i, : len(item)], is_word[i, : len(item)], b[i, : len(window)] = item, True, window
    slope = GAP * np.arange(wide + 1)
    row = np.zeros((len(items), wide + 1), np.int64)
    best = np.zeros(len(items), np.int64)
    for t in range(deep):
        step = np.where((a == b[:, t, None]) & is_word, MATCH, MISMATCH)
        fresh = np.zeros_like(row)
        fresh[:, 1:] = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] - GAP), 0)
        row = np.maximum.accumulate(fresh + slope, axis=1) - slope
        best = np.maximum(best, np.where(t < depth, row.max(1), 0))
    return best


def _parts(items: Items, run: words.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(word, row of the seed table)`` of every seed hit, all those of a text and an item in one part of bounded size."""
    at, which = items.hits(run)
    text = np.searchsorted(run.bounds, at, "right") - 1
    order = np.argsort(text, kind="stable")
    at, which, text = at[order], which[order], text[order]
    upto = np.cumsum(items.ends[which] - items.starts[which])
    texts = np.flatnonzero(np.diff(text, prepend=-1))  # first hit of each text
    lasts = np.append(texts[1:], len(text))
    i = 0
    while i < len(texts):
        before = upto[texts[i] - 1] if texts[i] else 0
        j = max(i + 1, int(np.searchsorted(upto[lasts - 1], before + _ENTRIES, "right")))
        hit = slice(texts[i], lasts[j - 1])
        yield from _entries(items, at[hit], which[hit], 0, len(items.ids))
        i = j


def _entries(items: Items, at: np.ndarray, which: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the seed table with items from ``low`` to below ``high``, per hit; halved by items where they are too many."""
    if (low, high) == (0, len(items.ids)):
        rows, starts, ends = None, items.starts[which], items.ends[which]
    else:
        rows = np.flatnonzero((items.table["item"] >= low) & (items.table["item"] < high))
        starts, ends = np.searchsorted(rows, items.starts[which]), np.searchsorted(rows, items.ends[which])
    many = ends - starts
    if many.sum() > _ENTRIES and high - low > 1:
        middle = (low + high) // 2
        yield from _entries(items, at, which, low, middle)
        yield from _entries(items, at, which, middle, high)
    elif many.any():
        entry = _ranges(starts, many)
        yield np.repeat(at, many), entry if rows is None else rows[entry]


def _windows(items: Items, run: words.Words, word: np.ndarray, entry: np.ndarray, min_score: float) -> tuple[np.ndarray, ...]:
    """Per stretch of seed hits of one item in one text: the text's row in the run, the item, first and last word, whether a hit is rare.

    An alignment that reaches the least score can afford so many gaps at most, so it strays no further from the diagonal of a hit.
    """
    item, rare = items.table["item"][entry], items.rare[entry]
    begin = word - items.table["place"][entry]  # where the item would start
    text = np.searchsorted(run.bounds, word, "right") - 1
    order = np.lexsort((begin, item, text))
    text, item, begin, rare = text[order], item[order], begin[order], rare[order]
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(begin) > items.lengths[item[1:]])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(text)) - 1
    text, item = text[firsts], item[firsts]
    slack = np.ceil((1 - min_score) * MATCH * items.lengths[item] / GAP).astype(np.int64) + 1
    left = np.maximum(begin[firsts] - slack, run.bounds[text])
    right = np.minimum(begin[lasts] + items.lengths[item] + slack, run.bounds[text + 1])
    return text, item, left, right, np.logical_or.reduceat(rare, firsts)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _most(items: Items, run: words.Words, item: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A bound that no alignment of an item and a window can pass: every word of the item that is in the window matches.

    Words are looked up in a table of 20 hash bits, so some may be taken as present that are not; the bound only grows.
    """
    out = np.zeros(len(item), np.int64)
    wide, upto = right - left, np.cumsum(right - left)
    i = 0
    while i < len(item):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _CHECKED_WORDS, "right")))
        salt = words.mixed(np.arange(j - i, dtype=words.U64))
        place = lambda hashes, sizes: ((hashes ^ np.repeat(salt, sizes)) * words.U64(0x9E37_79B9_7F4A_7C15) >> words.U64(44)).astype(np.int64)  # noqa: E731, B023
        there = np.zeros(1 << 20, bool)
        there[place(run.hashes[_ranges(left[i:j], wide[i:j])], wide[i:j])] = True
        sizes = items.lengths[item[i:j]]
        mine = there[place(items.flat[_ranges(items.firsts[item[i:j]], sizes)], sizes)]
        out[i:j] = MATCH * np.bincount(np.repeat(np.arange(j - i), sizes), mine, j - i).astype(np.int64)
        i = j
    return out


def _scored(items: Items, run: words.Words, min_score: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for word, entry in _parts(items, run):
        text, item, left, right, rare = _windows(items, run, word, entry, min_score)
        doubtful = np.flatnonzero(~rare)
        most = _most(items, run, item[doubtful], left[doubtful], right[doubtful])
        rare[doubtful] = most / (MATCH * np.maximum(items.lengths[item[doubtful]], 1)) >= min_score
        text, item, left, right = text[rare], item[rare], left[rare], right[rare]
        scores = np.zeros(len(text))
        order = np.argsort(right - left, kind="stable")
        at = 0
        while at < len(order):
            wide = max(items.lengths[item[order[at]]], 1)
            group = order[at : at + max(1, _CELLS // (4 * wide))]
            scores[group] = align([items.words[i] for i in item[group]], [run.hashes[a:b] for a, b in zip(left[group], right[group])])
            at += len(group)
        scores = scores / (MATCH * np.maximum(items.lengths[item], 1))
        good = scores >= min_score
        if good.any():
            yield text[good] + run.first, item[good], scores[good]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(doc_id, item_id, score)`` of every pair whose alignment reaches ``min_score``."""
    texts = standard(docs, doc_col, text_col)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("score", T.DoubleType())])
    found = [_one_block(texts, items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), schema, min_score) for b in range(blocks)]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _one_block(texts: DataFrame, items: DataFrame, schema: T.StructType, min_score: float) -> DataFrame:
    table = items.toArrow()  # at most about `block_words` words
    block = Items(table["item_id"].combine_chunks(), table["text"].combine_chunks())

    def count(batches):
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for run in words.runs(batch.column(0)):
                at, which = block.hits(run)
                owner = np.searchsorted(run.bounds, at, "right") - 1
                found.append(np.unique(owner * (len(block.seeds) + 1) + which) % (len(block.seeds) + 1))
            seeds, n = np.unique(np.concatenate(found), return_counts=True)
            hashes = (block.seeds[seeds] ^ words.U64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n.astype(np.int64))], names=["seed", "n"])

    counted = texts.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    block.mark_rare(dict(zip(counted["seed"].to_pylist(), counted["n"].to_pylist())))

    def score(batches):
        for batch in batches:
            for run in words.runs(batch.column(1)):
                for text, item, value in _scored(block, run, min_score):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text)), block.ids.take(pa.array(item)), pa.array(value)], names=["doc_id", "item_id", "score"]
                    )

    return texts.mapInArrow(score, schema)


def clean(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id has a leak; rows with a null id stay."""
    leaked = find_leaks(docs, benchmark, doc_col, text_col).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, F.col(doc_col) == F.col("_leaked"), "left_anti")
