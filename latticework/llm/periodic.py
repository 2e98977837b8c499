"""Periodic run detection: every maximal repetition of words in a text, by Kruskal's algorithm on descending LCP.

Method. The suffixes of a text (as word sequences) are sorted by prefix doubling, and neighbours get the length of their
longest common prefix (LCP). Pairs of neighbours are taken by decreasing LCP; a pair unites the classes of its two suffixes
in a union-find forest, whose roots hold the ordered positions of a class, the smaller set going into the larger one. Positions that
become neighbours in a class at LCP ``l`` and distance ``d`` within ``l`` are a seed: the text has period ``d`` from the first of them
up to ``l`` words past the second. A seed that can't be extended to the left is a maximal run, and every run
of exponent 2 or more comes from exactly one such seed, with its smallest period: at LCP ``l`` no position between the
start of a run and the next period can be in the class, as it would make a shorter period.

A run of ``min_words`` words repeated ``min_exponent`` times shares ``min_words * (min_exponent - 1) / min_exponent`` words with itself one
period on, so only texts in which that many words in a row stand twice are sorted, and only the suffixes of
such places enter the forest; this loses nothing. Texts are handled in runs of about a megabyte by numpy, a longer text by
itself; the words of different texts never share a class.

Edge cases. Null and empty texts have no words and no runs, and collapse to an empty text. Very long texts are sorted as a whole. Rows with equal or
null ids are kept row by row. Empty tables give no rows. Other columns are ignored. Words are equal if their 64-bit hashes are.
"""

from __future__ import annotations

from bisect import bisect, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import words
from latticework.llm.frames import standard

U64 = words.U64
MIN_WORDS = 24
MIN_EXPONENT = 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repeated(run: words.Words, size: int) -> np.ndarray:
    """Word numbers at which ``size`` words stand that stand at another place of the same text too."""
    hashes, whole = words.grams(run, size)
    at = np.flatnonzero(whole)
    keys = words.mixed(hashes[at] + run.owners[at].astype(U64) * U64(0xD6E8_FEB8_6659_FD93))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.append(same, False) | np.append(False, same)
    return np.sort(at[order[twice]])


def sorted_suffixes(hashes: np.ndarray, owners: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word numbers in the order of their suffixes, text by text; ``ends`` is where each word's text ends."""
    n = len(hashes)
    order = np.lexsort((hashes, owners))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (owners[order][1:] != owners[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width, open_ = 1, np.arange(n)
    while True:
        open_ = open_[np.bincount(rank[open_], minlength=n)[rank[open_]] > 1]
        if not len(open_):
            break
        further = open_ + width
        following = np.where(further < ends[open_], rank[np.minimum(further, n - 1)] + 1, 0)
        keys = rank[open_] * (n + 1) + following
        by = np.argsort(keys, kind="stable")
        open_, keys, place = open_[by], keys[by], np.arange(len(by))
        bucket = rank[open_]
        start = np.maximum.accumulate(np.where(np.append(True, bucket[1:] != bucket[:-1]), place, 0))
        first = np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1]), place, 0))
        rank[open_] = bucket + first - start
        width *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def common_prefixes(ids: list[int], ends: list[int], order: np.ndarray, chosen: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(lcp, first, second)`` of neighbouring suffixes that share ``least`` words or more; both are then among ``chosen``.

    Positions are walked in text order, so that each comparison goes on where the last one stopped.
    """
    before = np.empty(len(ids), np.int64)
    before[order] = np.append(-1, order[:-1])
    out, shared, last = [], 0, -2
    for at, other in zip(chosen.tolist(), before[chosen].tolist()):
        shared = max(shared - 1, 0) if at == last + 1 else 0
        last = at
        if other < 0:
            shared = 0
            continue
        stop = min(ends[at] - at, ends[other] - other)
        if ends[at] != ends[other]:  # another text
            shared = 0
            continue
        while shared < stop and ids[at + shared] == ids[other + shared]:
            shared += 1
        if shared >= least:
            out.append((shared, other, at))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def kruskal(lcp: np.ndarray, first: np.ndarray, second: np.ndarray):
    """``(lcp, position, next position)`` of the positions that become neighbours in a class, by decreasing LCP."""
    parent: dict[int, int] = {}
    held: dict[int, list[int]] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for k in np.argsort(-lcp, kind="stable").tolist():
        shared, large, small = int(lcp[k]), find(int(first[k])), find(int(second[k]))
        into, moved = held.setdefault(large, [large]), held.setdefault(small, [small])
        if len(into) < len(moved):
            large, small, into, moved = small, large, moved, into
        parent[small] = large
        del held[small]
        for i, x in enumerate(moved):
            at = bisect(into, x)
            if at and (not i or into[at - 1] > moved[i - 1]):
                yield shared, into[at - 1], x
            if at < len(into) and (i + 1 == len(moved) or into[at] < moved[i + 1]):
                yield shared, x, into[at]
        if len(moved) < 16:
            for x in moved:
                insort(into, x)
        else:
            into += moved
            into.sort()


def runs_of(run: words.Words, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> dict[int, list[tuple[int, int, int]]]:
    """``{text: [(start, length, period)]}`` of the texts of a run that have any, sorted."""
    least = max(1, min(63, min_words * (min_exponent - 1) // min_exponent))
    places = repeated(run, least)
    if not len(places):
        return {}
    owners, counts = run.owners, run.counts
    concerned = np.zeros(len(run), bool)
    concerned[owners[places]] = True
    kept = np.flatnonzero(concerned[owners])  # all words of the texts with such places
    renumbered = np.cumsum(concerned[owners]) - 1
    owners, hashes = owners[kept], run.hashes[kept]
    ends = np.repeat(np.cumsum(counts[concerned]), counts[concerned])
    begins = ends - np.repeat(counts[concerned], counts[concerned])
    order = sorted_suffixes(hashes, owners, ends)
    ids = np.unique(hashes, return_inverse=True)[1].tolist()
    pairs = common_prefixes(ids, ends.tolist(), order, renumbered[places], least)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for shared, at, after in kruskal(*pairs):
        period = after - at
        if period > shared or shared + period < max(min_words, min_exponent * period):
            continue
        begin = int(begins[at])
        if at == begin or ids[at - 1] != ids[after - 1]:
            out.setdefault(int(owners[at]), []).append((at - begin, shared + period, period))
    return {text: sorted(found) for text, found in out.items()}


def collapse(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run has after its first period."""
    parts = text.split()  # bytes: at ASCII white space only
    if found:
        kept = np.ones(len(parts), bool)
        for start, length, period in found:
            kept[start + period : start + length] = False
        parts = [parts[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(parts)


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """``doc_id, runs, text``: all runs of at least ``min_words`` words and ``min_exponent`` (2 or more) periods, and the text without their repetitions."""
    if min_exponent < 2 or min_words < 2:
        raise ValueError("min_exponent and min_words are 2 at least")
    rows = standard(docs, id_col, text_col)
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: long, length: long, period: long>>, text string"

    def run(batches):
        for batch in batches:
            for part in words.runs(batch.column(1), folded=False):
                found = runs_of(part, min_words, min_exponent)
                lists = [found.get(i, []) for i in range(len(part))]
                flat = np.array([r for x in lists for r in x], np.int64).reshape(-1, 3)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
                structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
                view = memoryview(part.data)
                texts = [collapse(view[a:b].tobytes(), found.get(i, [])) for i, (a, b) in enumerate(zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist()))]
                columns = [batch.column(0).slice(part.first, len(part)), pa.ListArray.from_arrays(offsets, structs), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "text"])

    return rows.mapInArrow(run, ddl)


def report(found: DataFrame) -> DataFrame:
    """One row per document of ``find_runs``: how many runs, the one with the greatest exponent, and digests of all runs and of the text."""
    ahead = lambda a, b: F.when(
        a.length * b.period > b.length * a.period, True
    ).when(a.length * b.period < b.length * a.period, False).otherwise((a.start < b.start) | ((a.start == b.start) & (a.period < b.period)))
    best = F.aggregate(F.col("runs"), F.get("runs", F.lit(0)), lambda kept, x: F.when(ahead(x, kept), x).otherwise(kept))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


def make_periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with a planted run in every text whose id's CRC-32 is divisible by ten.

    From word ``a`` on, the first ``p`` words are repeated up to the text's length; ``a`` and ``p`` follow from the CRC-32.
    """
    rows = standard(docs, id_col, text_col)
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    said = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    chosen = rows.select("doc_id", "text", seed.alias("seed")).withColumn("words", F.when(F.col("seed") % 10 == 0, said))
    g, n = F.floor(F.col("seed") / 10).cast("long"), F.size("words").cast("long")
    placed = chosen.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)).cast("long"))
    a, p, rest = F.col("a").cast("int"), F.col("p").cast("int"), (F.col("n") - F.col("a")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(rest / p).cast("int"))), 1, rest)
    built = F.array_join(F.concat(F.slice("words", 1, a), again), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, built).otherwise(F.col("text")).alias("text"))
