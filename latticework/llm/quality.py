"""Quality rules: a linear-chain conditional random field marks each line content or boilerplate.

Method. Every line of a text becomes a short vector of shares (symbols, capitals, repeated words, ...). A
two-state chain scores the lines together; Viterbi decoding finds the best labelling of the whole text, and
the share of characters on content lines decides whether the text stays. Plain rules (few words, repeated
windows) come first. The chain is fitted on a bounded sample of labelled texts (``SAMPLE`` texts, all lines of
each, without padding); statistics and decoding always use whole texts.

Edge cases. Null and empty texts have no words and fail the rules. Lines without a word are not labelled and
count for nothing. A text without lines to label has content share 0. Repeated rows are judged alike. Without
labelled texts of both kinds every line is content, so the rules alone decide. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import words
from latticework.llm.frames import append_columns, standard

#: Labelled texts that the chain is fitted on, those with the smallest hashes of their ids.
SAMPLE = 1_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Least share of characters on content lines.
MIN_CONTENT = 0.5
WINDOW = 3
#: Bytes of text whose statistics are laid out at once; a longer text is laid out by itself.
RUN_BYTES = 1 << 18

#: The fit ends when no slope is steeper than this share of the steepest at the start.
TOLERANCE = 1e-4
#: Steps that the fit remembers.
MEMORY = 10

SYMBOLS = b"#*$%&|<>"
N_FEATURES = 11
CONTENT = 1


@dataclass(frozen=True)
class Chain:
    """Weights of the field: per feature and state, per pair of following states, and for the first state."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray


ALL_CONTENT = Chain(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.array([0.0, 1.0]))


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = {
    "symbols": _flags(SYMBOLS),
    "bang": _flags(b"!"),
    "upper": _flags(bytes(range(65, 91))),
    "lower": _flags(bytes(range(97, 123))) + _flags(bytes(range(128, 256))),
    "digits": _flags(b"0123456789"),
    "points": 1 - _flags(bytes(range(128, 192))),
}


@dataclass
class Lines:
    """Lines with a word: their texts (row of the run), features, code points and whether they repeat an earlier one."""

    owners: np.ndarray
    features: np.ndarray
    chars: np.ndarray
    repeats: np.ndarray


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _seen_before(owners: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where the same hash came earlier in the same text."""
    keys = words.mixed(hashes + owners.astype(words.U64) * words.U64(0xD6E8_FEB8_6659_FD93))
    _, first = np.unique(keys, return_index=True)
    out = np.ones(len(keys), bool)
    out[first] = False
    return out


def lines_of(run: words.Words) -> Lines:
    """The lines (cut at ``\\n``) with at least one word, of all texts of a run."""
    breaks = np.flatnonzero(run.data == 10)
    begins = np.unique(np.concatenate([run.offsets[:-1], breaks + 1]))
    begins = begins[begins < run.offsets[-1]]
    ends = np.minimum(np.append(begins[1:], len(run.data)), run.offsets[np.searchsorted(run.offsets, begins, "right")])
    ends = ends - ((ends > begins) & (run.data[ends - 1] == 10))
    counts = np.searchsorted(run.starts, ends) - np.searchsorted(run.starts, begins)
    begins, ends, counts = begins[counts > 0], ends[counts > 0], counts[counts > 0]
    owners = np.searchsorted(run.offsets, begins, "right") - 1
    repeats = _seen_before(owners, run.spans(begins, ends))
    totals = {name: _sums(table[run.data]) for name, table in _CLASSES.items()}
    found = {name: (t[ends] - t[begins]).astype(float) for name, t in totals.items()}
    chars = np.maximum(found["points"], 1)
    line_of_word = np.repeat(np.arange(len(begins)), counts)
    again = _seen_before(line_of_word, run.hashes)  # every word is on one of these lines
    said = np.bincount(line_of_word, again, len(begins)) / np.maximum(counts, 1)
    letters = np.maximum(found["upper"] + found["lower"], 1)
    closed = np.isin(run.data[np.maximum(ends - 1, 0)], list(b".!?:;\"'")).astype(float)
    features = np.column_stack([
        np.ones(len(begins)),
        np.minimum(found["symbols"] / counts, 1),
        np.minimum(found["symbols"] / chars * 10, 1),
        np.minimum(found["bang"] / counts, 1),
        found["upper"] / letters,
        found["digits"] / chars,
        np.where(counts >= 8, said, 0),
        (said > 0.8) & (counts >= 8),
        np.minimum(np.log1p(counts) / 6, 1),
        repeats,
        closed,
    ]).astype(float)
    return Lines(owners, features, found["points"].astype(np.int64), repeats)


def decode(chain: Chain, features: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Viterbi labels of the lines of many texts at once; a step moves all texts on by one line."""
    labels = np.zeros(len(owners), np.int64)
    if not len(owners):
        return labels
    scores = features @ chain.emit
    firsts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
    sizes = np.diff(np.append(firsts, len(owners)))
    order = np.argsort(-sizes, kind="stable")
    firsts, sizes = firsts[order], sizes[order]
    back = np.zeros((len(owners), 2), np.int64)
    best = scores[firsts] + chain.start
    ends = np.zeros_like(best)
    active = len(firsts)
    for step in range(1, int(sizes[0]) + 1):
        still = int(np.searchsorted(-sizes, -step, "left"))  # texts with more than `step` lines come first
        ends[still:active] = best[still:active]
        active = still
        if not active:
            break
        at = firsts[:active] + step
        paths = best[:active, :, None] + chain.move
        back[at] = paths.argmax(1)
        best = paths.max(1) + scores[at]
    state = ends.argmax(1)
    for step in range(int(sizes[0]) - 1, -1, -1):
        active = int(np.searchsorted(-sizes, -step, "left"))
        at = firsts[:active] + step
        labels[at] = state[:active]
        state[:active] = back[at, state[:active]]
    return labels


def _climb(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, steps: int, reach: float) -> np.ndarray:
    """The maximum of a concave function: limited-memory quasi-Newton steps, halved until the value grows enough."""
    value, slope = value_and_slope(at)
    first = slope
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() <= TOLERANCE * max(np.abs(first).max(), 1e-12):
            break
        way, shares = slope.copy(), []
        for move, bend in reversed(pairs):
            shares.append(move @ way / (move @ bend))
            way -= shares[-1] * bend
        if pairs:
            move, bend = pairs[-1]
            way *= move @ bend / (bend @ bend)
        else:
            way *= reach / np.abs(way).max()
        for (move, bend), share in zip(pairs, reversed(shares)):
            way += (share - bend @ way / (move @ bend)) * move
        length = 1.0
        while True:
            new = at + length * way
            new_value, new_slope = value_and_slope(new)
            if new_value >= value + 1e-4 * length * (slope @ way):
                break
            length /= 2
            if length < 1e-10:
                return at
        move, bend = new - at, slope - new_slope
        if move @ bend > 1e-12 * (move @ move):
            pairs = [*pairs[-MEMORY + 1 :], (move, bend)]
        at, value, slope = new, new_value, new_slope
    return at


def fit(texts: list[np.ndarray], labels: list[int], steps: int = 300, rate: float = 0.2, ridge: float = 1e-3) -> Chain:
    """Maximise the conditional likelihood of the line labels; every line carries its text's label.

    ``texts`` are feature matrices, one row per line. Both labels weigh the same in total. The likelihood less the ridge term
    is strictly concave; at most ``steps`` steps climb it, the first by ``rate`` at most in each weight.
    """
    pairs = sorted(((x, y) for x, y in zip(texts, labels) if len(x)), key=lambda p: -len(p[0]))
    if len({y for _, y in pairs}) < 2:
        return ALL_CONTENT
    texts, y = [x for x, _ in pairs], np.array([y for _, y in pairs])
    sizes = np.array([len(x) for x in texts])
    # The first lines of all texts, then the second lines of those that have one, ...; the longest texts come first.
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    at = np.append(0, np.cumsum(active))
    owner = np.arange(at[-1]) - np.repeat(at[:-1], active)
    line = np.repeat(np.arange(sizes[0]), active)
    x = np.concatenate(texts)[(np.cumsum(sizes) - sizes)[owner] + line]
    before = at[line[active[0] :] - 1] + owner[active[0] :]  # the line before each but the first ones
    last = at[sizes - 1] + np.arange(len(sizes))
    weight = 1.0 / (2 * np.bincount(y, minlength=2)[y] * sizes)
    truth = np.eye(2)[y]
    wanted = np.einsum("ni,nj,n->ij", truth, truth, (sizes - 1) * weight)
    rest = slice(active[0], None)
    cuts = [2 * N_FEATURES, 2 * N_FEATURES + 4]

    def likelihood(params: np.ndarray) -> tuple[float, np.ndarray]:
        emit, move, start = (part.reshape(-1, 2) for part in np.split(params, cuts))
        start = start[0]
        scores = x @ emit
        ahead, behind = scores.copy(), np.zeros_like(scores)
        ahead[: at[1]] += start
        for t in range(1, len(active)):
            old = ahead[at[t - 1] : at[t - 1] + active[t]]
            ahead[at[t] : at[t + 1]] += np.logaddexp(old[:, :1] + move[0], old[:, 1:] + move[1])
        for t in range(len(active) - 2, -1, -1):
            new = scores[at[t + 1] : at[t + 2]] + behind[at[t + 1] : at[t + 2]]
            behind[at[t] : at[t] + active[t + 1]] = np.logaddexp(new[:, :1] + move[:, 0], new[:, 1:] + move[:, 1])
        totals = np.logaddexp(ahead[last, 0], ahead[last, 1])
        total = totals[owner]
        told = (scores * truth[owner]).sum(1) @ weight[owner] + (move * wanted).sum() + (truth @ start) @ weight
        state = np.exp(ahead + behind - total[:, None])
        moved = np.exp(ahead[before][:, :, None] + move + ((scores + behind)[rest] - total[rest, None])[:, None, :])
        missed = (truth[owner] - state) * weight[owner, None]
        slope = [x.T @ missed, wanted - np.einsum("nij,n->ij", moved, weight[owner[rest]]), missed[: active[0]].sum(0)]
        return told - totals @ weight - ridge / 2 * params @ params, np.concatenate([s.ravel() for s in slope]) - ridge * params

    emit, move, start = np.split(_climb(likelihood, np.zeros(cuts[1] + 2), steps, rate), cuts)
    return Chain(emit.reshape(-1, 2), move.reshape(2, 2), start)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most ``sample`` labelled texts, those with the smallest id hashes."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    halves = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2) for y in (0, 1)]
    chosen = F.broadcast(halves[0].unionByName(halves[1]))  # at most `sample` rows

    def rows(batches):
        for batch in batches:
            ids, sizes, blocks = [], [], []
            for run in words.runs(batch.column(1), folded=False, run_bytes=RUN_BYTES):
                lines = lines_of(run)
                for i in range(len(run)):
                    mine = lines.features[lines.owners == i]
                    ids.append(batch.column(0)[run.first + i].as_py())
                    sizes.append(len(mine))
                    blocks.append(mine.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary())], names=["y", "n", "block"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id")
    found = texts.select(F.col("_y").cast("long").alias("y"), "_text").mapInArrow(rows, "y long, n long, block binary").toArrow()
    return fit([np.frombuffer(b, "<f8").reshape(-1, N_FEATURES) for b in found["block"].to_pylist()], found["y"].to_pylist())


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, n_content_lines long, content_share double"
)


def _judged(run: words.Words, chain: Chain) -> list[np.ndarray]:
    size, counts = len(run), run.counts
    in_words = np.zeros(len(run.data) + 1, np.int64)
    np.add.at(in_words, run.starts, 1)
    np.subtract.at(in_words, run.ends, 1)
    points = _sums(np.cumsum(in_words)[:-1] * _CLASSES["points"][run.data])
    symbols = _sums(_CLASSES["symbols"][run.data])
    word_chars, n_symbols = np.diff(points[run.offsets]), np.diff(symbols[run.offsets])

    hashes, whole = words.grams(run, WINDOW)
    at = np.flatnonzero(whole)
    keys = words.mixed(hashes[at] + run.owners[at].astype(words.U64) * words.U64(0xD6E8_FEB8_6659_FD93))
    _, group, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    twice = np.zeros(len(hashes) + WINDOW, bool)
    for j in range(WINDOW):
        twice[at[sizes[group] > 1] + j] = True
    n_repeat = np.diff(_sums(twice[: len(hashes)])[run.bounds])

    lines = lines_of(run)
    content = decode(chain, lines.features, lines.owners) == CONTENT
    n_dup = np.bincount(lines.owners, lines.repeats, size).astype(np.int64)
    n_lines = np.bincount(lines.owners, minlength=size)
    n_content = np.bincount(lines.owners, content, size).astype(np.int64)
    share = np.bincount(lines.owners, lines.chars * content, size) / np.maximum(np.bincount(lines.owners, lines.chars, size), 1)
    failed = (counts < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * counts)
    return [counts, word_chars, n_symbols, n_dup, n_repeat, failed, ~failed & (share >= MIN_CONTENT), n_lines, n_content, share]


def judge(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, the verdict of the rules and ``kept``, from whole texts."""
    place = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch) -> list:
        parts = [_judged(run, chain) for run in words.runs(batch.column(place), folded=False, run_bytes=RUN_BYTES)]
        empty = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)] * 2 + [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return [np.concatenate(p) for p in zip(*parts)] if parts else empty

    return append_columns(docs, COLUMNS, make)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics and the verdict of every row, without its text."""
    chain = train(docs, labels, id_col, text_col)
    return judge(standard(docs, id_col, text_col), chain).drop("text")
