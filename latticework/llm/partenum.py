"""N-gram Jaccard join by PartEnum signatures: near-duplicate texts and their connected components.

Method. A text is its set of distinct word 5-grams (64-bit hashes). Sets fall in bands of size; a set also enters
the next band if a partner of allowed size is there. Two sets of Jaccard similarity ``percent`` or more differ in at most
``k`` features. A band parts the feature domain, first by how frequent a feature is (powers of two, rare ones first), then into
ranges of the hash; ``SECOND`` neighbouring parts are a group. Of the first ``k // 2 + 1`` groups of a set, one has at most
one part that differs, so the subsets of a group that leave out one part are enumerated as signatures, and every similar
pair has one in common. Groups are counted only if two of their parts are not empty; a set with too few such groups also
enters with each feature as a part of its own. Sets of up to ``TINY`` features enumerate their own subsets with at most two
features left out.

Features that no other text has differ from any partner, so they lower ``k`` and leave the set; a text with more than ``k``
of them has no partner and gives no signature, and two texts that have too many together are not paired. A first pass counts features exactly, apart from rare
collisions that only make a feature look more frequent: each task sends its sorted features by hash range, and gets their
frequencies back in side files. So only texts that may have a partner send signatures.

Texts with equal sets are one class, and only classes are counted, signed and compared, each by one task: first each with the class that it
shares most signatures with among those with the fewest features of their own; then, in buckets that still hold classes not connected by links, the classes of different
components. So a group of copies never gives all its pairs, and no link between components is missed. Everything is checked on the full
sets, which meet in blocks of bounded size, however large a group is.

Edge cases. Null and empty texts have no shingles and link to nothing, not even each other. Texts shorter than a
shingle are one shingle. Rows with equal or null ids are kept row by row. An empty table gives no rows. Other columns are ignored.
Hashes decide equality: a false match has a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm import sidecar, words
from latticework.llm.frames import release
from latticework.llm.graph import components
from latticework.session import BROADCAST_ROWS, materialize

U64 = words.U64
SHINGLE_WORDS = 5
PERCENT = 75
TINY = 8
BAND_RATIO = 4
#: Parts per feature of the largest set of a band, and parts of a group, of which one may differ.
PARTS, SECOND = 0.625, 3
#: Features of one segment of a task's texts (segments are counted one by one), and of one span of the hash range.
SEGMENT, SPAN = 2_000_000, 2_000_000
#: Bytes of text laid out at once.
RUN_BYTES = 1 << 18
#: Pairs of one class that one task checks.
BLOCK = 256
#: Classes on either side of a block of a cluster.
CHUNK = 512


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """Smallest size of each band above the tiny one."""
    out = [TINY + 1]
    while out[-1] < 2**40:
        out.append(out[-1] * BAND_RATIO)
    return np.array(out, np.int64)


def max_difference(size: int, percent: int) -> int:
    """Most features in which a set of ``size`` differs from any set similar enough."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


def _salted(sums: np.ndarray, salt: int) -> np.ndarray:
    return words.mixed(sums ^ U64((salt + 1) * 0x9E37_79B9_7F4A_7C15 % 2**64))


def _schemes(size: int, percent: int) -> list[int]:
    """Bands above the tiny one that a set of ``size`` enters."""
    lows = bands()
    own = int(np.searchsorted(lows, size, "right")) - 1
    return [b for b in (own, own + 1) if b >= 0 and (b == own or size * 100 // percent >= lows[b])]


def _tiny(features: np.ndarray) -> np.ndarray:
    values = words.mixed(features)
    left = [[i for i in range(len(values)) if i not in out] for n in range(min(3, len(values))) for out in combinations(range(len(values)), n)]
    return _salted(np.array([values[kept].sum(dtype=U64) for kept in left], U64), 0)


def slack(size: int, alone: int, percent: int) -> int:
    """Two sets whose slacks sum to less than 0 are not similar: their ``alone`` features, which no other text has, differ."""
    return size * (100 - percent) - alone * (100 + percent)


def signatures(features: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set; ``frequency`` is 0 for features of no other text, else a power of two's exponent, 1 or more."""
    out = [_tiny(features)] if len(features) <= TINY else []
    shared = frequency > 0
    k = max_difference(len(features), percent) - int((~shared).sum())
    bands_of = _schemes(len(features), percent)
    if k < 0 or not shared.any() or not bands_of:
        return out[0] if out else np.zeros(0, U64)
    order = np.argsort(frequency[shared], kind="stable")
    ordered, level = features[shared][order], frequency[shared][order].astype(U64)
    values = words.mixed(ordered)
    for band in bands_of:
        groups = int(bands()[band] * BAND_RATIO * PARTS / SECOND) + 1
        place = level * U64(groups * SECOND) + (((ordered >> U64(32)) * U64(groups * SECOND)) >> U64(32))
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        part, sums = place[starts], np.add.reduceat(values, starts)
        group, row = np.unique(part // U64(SECOND), return_inverse=True)
        table, filled = np.zeros((len(group), SECOND), U64), np.zeros((len(group), SECOND), bool)
        slot = (part % U64(SECOND)).astype(np.int64)
        table[row, slot], filled[row, slot] = sums, True
        good = np.cumsum(filled.sum(1) > 1)
        wanted = k // 2 + 1
        if good[-1] >= wanted:
            last = int(np.searchsorted(good, wanted)) + 1
        else:
            last = len(group)
            out.append(_salted(values[: k + 1], 1))
        total = table[:last].sum(1, dtype=U64)
        for j in range(SECOND):
            some = np.delete(filled[:last], j, 1).any(1)
            out.append(_salted(words.mixed(total - table[:last, j])[some] + words.mixed(group[:last][some]), 2 + SECOND * band + j))
    return np.concatenate(out)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    slot = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[slot] == values


def class_of(features: np.ndarray) -> int:
    """One number of a whole set."""
    total = words.mixed(features).sum(dtype=U64, keepdims=True)
    return int(words.mixed(total + U64(len(features))).view(np.int64)[0])


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key of their own; wholly equal rows share one."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return named.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def _beside(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Join on ``key``; the side is broadcast only when its rows and the entries of their arrays were counted and are few."""
    entries = sum((F.size(f.name) for f in side.schema if isinstance(f.dataType, T.ArrayType)), F.lit(1))
    small = (side.agg(F.sum(entries.cast("long"))).first()[0] or 0) <= BROADCAST_ROWS
    return rows.join(F.broadcast(side) if small else side, "key", how)


def _survey(rows: DataFrame, shingle_words: int) -> DataFrame:
    """Size, class and scan partition of every row's set; the class is null without shingles."""

    def run(batches):
        pid = sidecar.partition_id()
        for batch in batches:
            for part in words.runs(batch.column(2), run_bytes=RUN_BYTES):
                sets = words.shingle_sets(part, shingle_words)
                own = [batch.column(i).slice(part.first, len(sets)) for i in (0, 1)]
                classes = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
                yield _batch(["doc_id", "key", "n", "cls", "pid"], *own, np.array([len(s) for s in sets], np.int64), classes, np.full(len(sets), pid, np.int64))

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, n long, cls long, pid long")


def _segments(batches, path: str, shingle_words: int):
    """``(classes, sets)`` of the classes that are this task's own by the side files in ``path``, each once, in segments of about ``SEGMENT`` features.

    A class that many tasks meet is the own one of a single task, so copies count no feature twice and send nothing.
    """
    own = np.sort(sidecar.read(path, sidecar.partition_id(), ["cls"])["cls"].to_numpy())
    left = np.ones(len(own), bool)
    classes, sets, held = [], [], 0
    for batch in batches:
        for part in words.runs(batch.column(0), run_bytes=RUN_BYTES):
            for features in words.shingle_sets(part, shingle_words):
                if not len(features):
                    continue
                cls = class_of(features)
                at = int(np.searchsorted(own, cls))
                if at == len(own) or own[at] != cls or not left[at]:
                    continue
                left[at] = False
                classes.append(cls)
                sets.append(features)
                held += len(features)
                if held >= SEGMENT:
                    yield classes, sets
                    classes, sets, held = [], [], 0
    if left.any():
        raise RuntimeError("The scan gave other rows than before; give a table that does not change")
    if sets:
        yield classes, sets
    release()


def _cut(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct leading bits of all features of a segment, and how many of its classes have each."""
    return np.unique(np.concatenate(sets) >> U64(64 - bits), return_counts=True)


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane, and counts up to 255; compressed."""
    steps = np.diff(values, prepend=U64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    raw = np.array([len(values), width], "<i8").tobytes() + planes.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(block[8:], int(np.frombuffer(block[:8], "<i8")[0]), "zstd", asbytes=True)
    size, width = np.frombuffer(raw[:16], "<i8")
    planes = np.frombuffer(raw, np.uint8, width * size, 16).reshape(width, size)
    steps = np.zeros((size, 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view("<u8")[:, 0], dtype=U64), np.frombuffer(raw, np.uint8, size, 16 + width * size)


def _frequencies(texts: DataFrame, owned: str, path: str, shingle_words: int, bits: int, ranges: int) -> None:
    """Write, per scan partition and segment, the frequency exponents of its sorted features: the number of classes that have them."""

    def send(batches):
        pid = sidecar.partition_id()
        for segment, (_, sets) in enumerate(_segments(batches, owned, shingle_words)):
            values, counts = _cut(sets, bits)
            edges = np.searchsorted(values, (np.arange(ranges + 1).astype(object) * 2**bits // ranges).astype(U64))
            for r in range(ranges):
                if edges[r] < edges[r + 1]:
                    packed = _pack(values[edges[r] : edges[r + 1]], counts[edges[r] : edges[r + 1]])
                    yield _batch(["span", "pid", "segment", "block"], *[pa.array([x], pa.int64()) for x in (r, pid, segment)], pa.array([packed], pa.binary()))

    def answer(batches):
        for span, blocks in _spans(batches):
            lists = [_unpack(b) for _, _, b in blocks]
            values, counts = np.concatenate([v for v, _ in lists]), np.concatenate([c for _, c in lists]).astype(np.int64)
            order = np.argsort(values, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(values[order]) != 0))
            totals = np.add.reduceat(counts[order], starts)
            group = np.empty(len(values), np.int64)
            group[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
            exponents = np.floor(np.log2(totals)).astype(np.uint8)[group]
            at = 0
            for (pid, segment, _), (v, _) in zip(blocks, lists):
                packed = pa.compress(exponents[at : at + len(v)].tobytes(), "zstd", asbytes=True)
                yield _batch(["pid", "segment", "span", "size", "block"], *[pa.array([x], pa.int64()) for x in (pid, segment, span, len(v))], pa.array([packed], pa.binary()))
                at += len(v)

    sent = texts.mapInArrow(send, "span long, pid long, segment long, block binary").repartition(ranges, "span").sortWithinPartitions("span", "pid", "segment")
    sidecar.write(sent.mapInArrow(answer, "pid long, segment long, span long, size long, block binary"), path)


def _spans(batches):
    """``(span, [(pid, segment, block)])`` of rows sorted by span."""
    now, held = None, []
    for batch in batches:
        for span, pid, segment, block in zip(*(c.to_pylist() for c in batch.columns)):
            if span != now and held:
                yield now, held
                held = []
            now = span
            held.append((pid, segment, block))
    if held:
        yield now, held


def _signed_rows(texts: DataFrame, owned: str, path: str, shingle_words: int, bits: int, percent: int) -> DataFrame:
    """``sig, cls, n, slack`` of every class that may have a partner."""

    def sign(batches):
        side = sidecar.read(path, sidecar.partition_id(), ["segment", "span", "size", "block"]).sort_by([("segment", "ascending"), ("span", "ascending")])
        known: dict[int, list[bytes]] = {}
        for segment, size, block in zip(side["segment"].to_pylist(), side["size"].to_pylist(), side["block"].to_pylist()):
            known.setdefault(segment, []).append(pa.decompress(block, size, "zstd", asbytes=True))
        for segment, (classes, sets) in enumerate(_segments(batches, owned, shingle_words)):
            values, counts = _cut(sets, bits)
            exponents = np.frombuffer(b"".join(known.pop(segment, [])), np.uint8)
            if len(exponents) != len(values):
                raise RuntimeError("The scan gave other rows than before; give a table that does not change")
            sigs, slacks = [], []
            for features in sets:
                frequency = exponents[np.searchsorted(values, features >> U64(64 - bits))]
                sigs.append(signatures(features, frequency, percent))
                slacks.append(slack(len(features), int((frequency == 0).sum()), percent))
            counts = [len(x) for x in sigs]
            columns = [np.repeat(np.array(x, np.int64), counts) for x in (classes, [len(f) for f in sets], slacks)]
            yield _batch(["sig", "cls", "n", "slack"], np.concatenate(sigs).view(np.int64), *columns)

    return texts.mapInArrow(sign, "sig long, cls long, n long, slack long")


def _buckets(batches):
    """Rows sorted by ``sig``, falling ``slack``, ``cls``: those that may have a partner in their bucket, with the bucket's first class as ``hub``.

    Of a bucket, only the first row is remembered from batch to batch, and whether it has come out.
    """
    sig0, cls0, n0, slack0, told = None, 0, 0, 0, True

    for batch in batches:
        sig, cls, n, slacks = (batch.column(i).to_numpy() for i in range(4))
        if not len(sig):
            continue
        if sig0 is not None and sig[0] == sig0:  # go on with the bucket of the last batch, its first row ahead
            sig, cls, n, slacks = (np.append(x, y) for x, y in ((sig0, sig), (cls0, cls), (n0, n), (slack0, slacks)))
            ahead = True
        else:
            ahead, told = False, True
        first = np.append(True, sig[1:] != sig[:-1])
        again = np.append(False, (cls[1:] == cls[:-1]) & ~first[1:])  # one class from several tasks
        start = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))
        again |= ~first & (cls == cls[start])
        kept = ~first & ~again & (slacks + slacks[start] >= 0)
        kept[np.unique(start[kept])] = True
        if ahead:
            kept[0] &= not told
            told = told or bool(kept[0])
        last = int(start[-1])
        if last > 0 or not ahead:
            told = bool(kept[last])
        sig0, cls0, n0, slack0 = sig[last], cls[last], n[last], slacks[last]
        if kept.any():
            yield _batch(["sig", "cls", "n", "slack", "hub"], sig[kept], cls[kept], n[kept], slacks[kept], cls[start][kept])


def check_pairs(rows: DataFrame, reps: DataFrame, pairs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sets are similar enough; ``reps (cls, key)`` names a row of each class.

    The pairs of one ``a`` are dealt into blocks of about ``BLOCK``, and each class sends its set once to every block it is in.
    """
    pairs = materialize(pairs)
    cuts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("cuts"))
    dealt = materialize(pairs.join(cuts, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("cuts"))).alias("block")))
    ways = dealt.select(F.col("a").alias("cls"), "block").union(dealt.select("b", "block")).groupBy("cls").agg(F.collect_set("block").alias("blocks"))
    side = materialize(ways.join(reps, "cls").select("key", "cls", "blocks"))

    def sets(batches):
        names = ["block", "a", "b", "features"]
        for batch in batches:
            for part in words.runs(batch.column(0), run_bytes=RUN_BYTES):
                found = []
                for i, features in enumerate(words.shingle_sets(part, shingle_words)):
                    cls = batch.column(1)[part.first + i].as_py()
                    if len(features) and class_of(features) == cls:
                        packed = features.astype("<u8").tobytes()
                        found += [(block, cls, None, packed) for block in batch.column(2)[part.first + i].as_py()]
                if found:
                    yield _batch(names, *[pa.array(c, t) for c, t in zip(zip(*found), [pa.int64()] * 3 + [pa.binary()])])

    held = _beside(rows, side, "inner").select("text", "cls", "blocks").mapInArrow(sets, "block long, a long, b long, features binary")
    met = held.unionByName(dealt.withColumn("features", F.lit(None).cast("binary")).select("block", "a", "b", "features"))
    met = met.repartition("block").sortWithinPartitions("block", F.col("features").isNull())

    def compare(batches):
        now, known, good = None, {}, []
        for batch in batches:
            for block, a, b, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    now, known = block, {}
                if packed is not None:
                    known[a] = np.frombuffer(packed, "<u8")
                    continue
                x, y = sorted((known[a], known[b]), key=len)
                if 100 * len(x) >= percent * len(y):
                    shared = int(_member(x, y).sum())
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        good.append((a, b))
            if good:
                yield _batch(["a", "b"], *[pa.array(c, pa.int64()) for c in zip(*good)])
                good = []

    return materialize(met.mapInArrow(compare, "a long, b long"))


def check_clusters(rows: DataFrame, reps: DataFrame, met: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components that meet in a bucket; ``met`` has ``low, label, cls`` of all rows of such buckets.

    ``low`` is the smallest label of the bucket, so a pair of labels stands for all pairs of their classes. Buckets that share labels are a cluster. Each class outside its cluster's largest component is compared with all classes of the
    cluster: chunks of ``CHUNK`` of the former meet chunks of all in blocks, where shared features are counted through sorted
    lists of features. No pairs are written out; of the links of a class to one component, one comes out.
    """
    met = materialize(met.select("low", "label", "cls").distinct())
    meetings = met.filter("low <> label").select(F.col("low").alias("a"), F.col("label").alias("b")).distinct()
    clusters = components(meetings).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    placed = materialize(met.select("cls", "label").distinct().join(clusters, "label"))
    sizes = placed.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    chunks = lambda n: F.ceil(n / CHUNK).cast("long")
    whole = sizes.groupBy("cluster").agg(
        F.max_by("label", F.struct("n", "label")).alias("largest"), chunks(F.sum("n")).alias("right"), chunks(F.sum("n") - F.max("n")).alias("left")
    ).filter("left > 0")
    dealt = placed.join(whole, "cluster")
    own = F.xxhash64("cls")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    lefts = F.transform(every(F.col("right")), lambda j: F.struct(F.xxhash64("cluster", F.pmod(own, F.col("left")), j).alias("block"), F.lit(True).alias("left")))
    rights = F.transform(every(F.col("left")), lambda i: F.struct(F.xxhash64("cluster", i, F.pmod(own, F.col("right"))).alias("block"), F.lit(False).alias("left")))
    ways = F.when(F.col("label") != F.col("largest"), F.concat(lefts, rights)).otherwise(rights)
    side = materialize(dealt.join(reps, "cls").select("key", "cls", "label", ways.alias("ways")))

    def sets(batches):
        names = ["block", "left", "cls", "label", "features"]
        for batch in batches:
            for part in words.runs(batch.column(0), run_bytes=RUN_BYTES):
                found = []
                for i, features in enumerate(words.shingle_sets(part, shingle_words)):
                    _, cls, label, ways = (batch.column(c)[part.first + i].as_py() for c in range(4))
                    if len(features) and class_of(features) == cls:
                        packed = features.astype("<u8").tobytes()
                        found += [(w["block"], w["left"], cls, label, packed) for w in ways]
                if found:
                    yield _batch(names, *[pa.array(c, t) for c, t in zip(zip(*found), [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()])])

    held = _beside(rows, side, "inner").select("text", "cls", "label", "ways").mapInArrow(sets, "block long, left boolean, cls long, label long, features binary")
    ordered = held.repartition("block").sortWithinPartitions("block", "left")

    def compare(batches):
        now, right, lists, links = None, [], None, []

        def indexed():
            values = np.concatenate([f for _, _, f in right])
            owner = np.repeat(np.arange(len(right)), [len(f) for _, _, f in right])
            order = np.argsort(values, kind="stable")
            classes, labels = (np.array([r[i] for r in right], np.int64) for i in (0, 1))
            return values[order], owner[order], classes, labels, np.array([len(f) for _, _, f in right])

        for batch in batches:
            for block, left, cls, label, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    now, right, lists = block, [], None
                features = np.frombuffer(packed, "<u8")
                if not left:
                    right.append((cls, label, features))
                    continue
                if not right:  # no class fell into this chunk
                    continue
                values, owner, classes, labels, counts = lists = lists or indexed()
                start, stop = np.searchsorted(values, features, "left"), np.searchsorted(values, features, "right")
                many = stop - start
                hits = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                shared = np.bincount(owner[hits], minlength=len(classes))
                near = np.flatnonzero((labels != label) & (100 * shared >= percent * (counts + len(features) - shared)))
                _, one = np.unique(labels[near], return_index=True)
                links += [(cls, int(c)) for c in classes[near[one]]]
            if links:
                yield _batch(["a", "b"], *[pa.array(c, pa.int64()) for c in zip(*links)])
                links = []

    return materialize(ordered.mapInArrow(compare, "a long, b long"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(rows, labels)``: ``doc_id, key, n, cls, pid`` per row, and ``cls, label`` of every class with a link; a label is a component.

    ``docs`` is scanned several times and must be a scan or another plan whose partitions stay the same.
    """
    rows = _keyed(docs, id_col, text_col)
    texts = rows.select("text")
    members = materialize(_survey(rows, shingle_words))
    first = F.min(F.struct("key", "pid")).alias("first")
    reps = materialize(members.filter("cls is not null").groupBy("cls").agg(first, F.max("n").alias("n")).select("cls", "first.*", "n"))
    total = reps.agg(F.sum("n")).first()[0] or 0
    bits = min(63, int(total).bit_length() + 9)
    folder = sidecar.shared_folder(docs.sparkSession)
    owned, path = f"{folder}/owned", f"{folder}/frequencies"
    sidecar.write(reps.select("pid", "cls"), owned)
    _frequencies(texts, owned, path, shingle_words, bits, -(-int(total) // SPAN) or 1)
    reps = reps.select("cls", "key")

    signed = _signed_rows(texts, owned, path, shingle_words, bits, percent)
    signed = signed.repartition("sig").sortWithinPartitions("sig", F.desc("slack"), "cls")
    signed = materialize(signed.mapInArrow(_buckets, "sig long, cls long, n long, slack long, hub long"))
    near = signed.filter("cls <> hub").groupBy("cls", "hub").agg(F.count(F.lit(1)).alias("n"))
    first = near.groupBy("cls").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")).select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    links = check_pairs(rows, reps, first, shingle_words, percent)

    labels = components(links).withColumnRenamed("node", "cls")
    labelled = signed.join(labels, "cls", "left").select("sig", "hub", F.coalesce("label", "cls").alias("label"), "cls")
    split = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sig", "low")
    more = check_clusters(rows, reps, labelled.join(split, "sig").select("low", "label", "cls"), shingle_words, percent)
    return members, labels if more.isEmpty() else _joined(labels, more)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: the links become edges between components, and theirs are joined."""
    every = labels.unionByName(links.select(F.col("a").alias("cls")).union(links.select("b")).distinct().join(labels, "cls", "left_anti").withColumn("label", F.col("cls")))
    every = materialize(every)
    start, end = (every.select(F.col("cls").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
    edges = links.join(start, "a").join(end, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    roots = components(edges).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return materialize(every.join(roots, "label", "left").select("cls", F.coalesce("root", "label").alias("label")))


def _components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``cls, root, least``: classes of several rows or with links; ``least`` is the smallest id of the class."""
    smallest = members.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many"))
    rooted = smallest.join(labels, "cls", "left").filter("label is not null or many > 1")
    return materialize(rooted.select("cls", F.coalesce("label", "cls").alias("root"), "least"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; the component is the smallest id reachable by links."""
    members, labels = classes(docs, id_col, text_col, shingle_words, percent)
    shared = _components(members, labels)
    roots = shared.groupBy("root").agg(F.min("least").alias("component_id"))
    named = shared.join(roots, "root").select(F.col("cls").alias("key"), "component_id")
    out = _beside(members.select("doc_id", "n", F.col("cls").alias("key")), materialize(named), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that with the smallest id and then key; rows without shingles all stay.

    Of wholly equal rows one stays. A component of null ids alone keeps the row with the smallest key.
    """
    members, labels = classes(docs, id_col, text_col, shingle_words, percent)
    shared = _components(members, labels).select("cls", "root")
    grouped = members.join(shared, "cls").select("root", "doc_id", "key")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    kept = grouped.groupBy("root").agg(first.alias("kept")).select(F.col("kept.key").alias("key"), F.lit(True).alias("_kept"))
    losers = grouped.select("key").distinct().join(kept, "key", "left").filter("_kept is null").select("key", F.lit(True).alias("_lost"))
    lost = _beside(docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(id_col, text_col).alias("key")), materialize(losers), "left")
    out = lost.filter("_lost is null").select("_row", "key")
    repeated = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").join(kept, "key", "left_semi").select("key", F.lit(True).alias("_many"))
    repeated = materialize(repeated)
    if not repeated.isEmpty():
        marked = _beside(out, repeated, "left")
        out = marked.filter("_many is null").select("_row").union(marked.filter("_many is not null").dropDuplicates(["key"]).select("_row"))
    return out.select("_row.*")
