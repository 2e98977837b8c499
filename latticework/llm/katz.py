"""LM scoring with a Katz back-off bigram model: Good-Turing discounts and exactly normalised back-off weights.

Model. Tokens are words (A-Z lower-cased), then one end per text; the history of the first token is the start.
``P(w | h) = d(r) r / c(h)`` where the pair was counted ``r > 0`` times, else ``alpha(h) P(w)``, and recursively ``P(w) = d(c) c / N``
for a token counted ``c > 0`` times, else the mass left over, taken as one unknown token. ``d`` is the Good-Turing
discount for counts up to ``K`` (half a count where the counts of counts give none in (0, 1)). ``alpha(h)`` makes the
probabilities of all counted tokens and the unknown one sum to 1. Where no pair of a history is discounted, its total counts
one more, so that the back-off has mass. An unseen history backs off with weight 1.

Execution. Token counts are gathered in one shuffle and written as a table partitioned by scan partition, so every task of the next scan
finds the counts of its own words. That scan scores the baseline, and sends its (history, token, text) triples in compact
blocks to tasks by history; histories above ``share`` triples are spread over several tasks by token. There the pairs are
counted and scored, but for what depends on sums over all tasks: discounts (numbers of pairs per count, summed on the driver) and
back-off weights, which are kept in a table partitioned by history and joined to the few triples of unseen pairs. No vocabulary or count table is broadcast.

Edge cases. Null and empty texts have the end as their only token. A null id is a training row. Without training rows
every token is unknown: the baseline divides by ``N + 0.1 (V + 1) = 0.1``, and the model gives probability 1. Rows with
equal ids are scored one by one. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm import sidecar, words
from latticework.session import BROADCAST_ROWS, materialize

U64 = words.U64
#: Counts up to this are discounted.
K = 5
BASE_ADD = 0.1
#: Hashes of the end token and of the start history.
END, START = U64(0x1E5D_0E4D_0F7E_7E01), U64(0x57A2_7A11_0C0D_E503)
#: Tokens of a task that are held before blocks are sent, and twice the distinct words before counts are.
FLUSH = 2_000_000
#: Training triples that a task should hold at most, whatever number of partitions the session asks for.
TRIPLES = 750_000


def held_out(id_col: str) -> Column:
    """True for a tenth of the texts, by the CRC-32 of the id's digits."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def discounts(types: list[int]) -> np.ndarray:
    """``d(1..K)`` from the numbers of types counted 1 to ``K + 1`` times."""
    n = [0.0] + [float(t) for t in types]
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, K + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (ratio - tail) / (1 - tail) if tail != 1.0 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(out)


class Unigram:
    """The lowest order: ``P(w)`` from a token's count; count 0 is the unknown token."""

    def __init__(self, total: int, types: int, counts: list[int]):
        self.total, self.types = total, types
        self.discount = discounts(counts)
        kept = total - sum((1 - d) * r * n for r, d, n in zip(range(1, K + 1), self.discount, counts))
        self.rest = max(total - kept, 1.0) / max(total, 1)  # mass of the unknown token
        if total == 0:
            self.rest = 1.0
        self.scale = (1 - self.rest) / kept if kept else 0.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        d = np.concatenate([[0.0], self.discount, [1.0]])[np.minimum(counts, K + 1)]
        return np.where(counts > 0, d * counts * self.scale, self.rest)


def _tokens(texts: pa.Array):
    """``(first, bounds, hashes)`` of runs of texts, an end after each text's words."""
    for run in words.runs(texts):
        bounds = run.bounds + np.arange(len(run) + 1)
        hashes = np.full(bounds[-1], END, U64)
        hashes[np.arange(len(run.hashes)) + run.owners] = run.hashes
        yield run.first, bounds, hashes


def _count(batches):
    """``pid, w, n, docs``: training counts of every word of a task, 0 for words of held-out texts only."""
    pid = sidecar.partition_id()
    held, size = [], 0

    def out():
        hashes = np.concatenate([h for h, _ in held])
        order = np.argsort(hashes)
        hashes = hashes[order]
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        return hashes[starts], np.add.reduceat(np.concatenate([n for _, n in held])[order], starts)

    def batch_of(found, counts):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), pid, np.int64)), pa.array(found.view(np.int64)), pa.array(counts)], names=["pid", "w", "n"])

    for batch in batches:
        train = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for first, bounds, hashes in _tokens(batch.column(2)):
            rows = train[first : first + len(bounds) - 1]
            found, place = np.unique(hashes, return_inverse=True)
            counts = np.bincount(place, np.repeat(rows, np.diff(bounds)), len(found))
            held.append((np.append(found, START), np.append(counts, rows.sum()).astype(np.int64)))
            size += len(found)
        if size > FLUSH // 2:
            held = [out()]
            if len(held[0][0]) > FLUSH * 3 // 8:
                yield batch_of(*held[0])
                held = []
            size = sum(len(h) for h, _ in held)
    if held:
        yield batch_of(*out())


def _pack(*arrays: np.ndarray) -> bytes:
    parts = []
    for a in arrays:
        if a.dtype == np.int64:  # as few bytes as the largest needs
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.int64)
        parts.append(np.array([len(a), a.dtype.num], "<i8").tobytes() + a.tobytes())
    raw = b"".join(parts)
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.int64, U64, np.float64)}


def _unpack(block: bytes) -> list[np.ndarray]:
    raw = pa.decompress(block[8:], int(np.frombuffer(block[:8], "<i8")[0]), "zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        size, kind = np.frombuffer(raw, "<i8", 2, at)
        a = np.frombuffer(raw, _KINDS[int(kind)], size, at + 16)
        at += 16 + a.nbytes
        out.append(a.astype(np.int64) if a.dtype.kind == "u" and a.dtype.itemsize < 8 else a)
    return out


def _row(names: list[str], *values) -> pa.RecordBatch:
    kinds = [pa.binary() if isinstance(v, bytes) else pa.int64() for v in values]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def _send(path: str, unigram: Unigram, tasks: int, share: int):
    """Blocks ``task, kind, pid, block``: kind 0 tells about texts, kind 1 holds their triples."""
    log_base = np.log10(unigram.total + BASE_ADD * (unigram.types + 1))
    names = ["task", "kind", "pid", "block"]

    def run(batches):
        pid = sidecar.partition_id()
        side = sidecar.read(path, pid, ["w", "c"])
        known, counts = side["w"].to_numpy().view(U64), side["c"].to_numpy()
        order = np.argsort(known)
        known, counts = known[order], counts[order]
        start = int(np.searchsorted(known, START)) if len(known) else 0
        slices = np.maximum(1, -(-counts // share))
        seen, held, size = 0, [], 0

        def blocks():
            nonlocal held, size
            h, w, doc, spread = (np.concatenate([chunk[i] for chunk in held]) for i in range(4))
            held, size = [], 0
            order = np.argsort(spread * np.int64(len(known) + 1) + h, kind="stable").astype(np.int32)
            edges = np.append(0, np.cumsum(np.bincount(spread, minlength=tasks)))
            del spread
            for task in range(tasks):
                mine = order[edges[task] : edges[task + 1]]
                if len(mine):
                    starts = np.flatnonzero(np.append(True, np.diff(h[mine]) != 0))
                    hs = h[mine][starts]
                    ws, place = np.unique(w[mine], return_inverse=True)
                    packed = _pack(known[hs], counts[hs], np.diff(np.append(starts, len(mine))), known[ws], counts[ws], place, doc[mine].astype(np.int64))
                    yield _row(names, task, 1, pid, packed)

        for batch in batches:
            train = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for first, bounds, hashes in _tokens(batch.column(2)):
                rows = np.arange(first, first + len(bounds) - 1)
                w = np.searchsorted(known, hashes)
                if len(known) == 0 or (w >= len(known)).any() or (known[w] != hashes).any():
                    raise RuntimeError("The scan gave other rows than before; give a table that does not change")
                h = np.empty_like(w)
                h[1:] = w[:-1]
                h[bounds[:-1]] = start
                own = np.repeat(np.arange(len(rows)), np.diff(bounds))
                c = counts[w]
                base = np.bincount(own, np.log10(c + BASE_ADD) - log_base, len(rows))
                fresh = counts[h] == 0  # an unseen history: the token's own probability
                done = np.bincount(own[fresh], np.log10(unigram.probability(c[fresh])), len(rows)).astype(float)  # without rows bincount gives integers
                n_known = np.bincount(own, c > 0, len(rows)).astype(np.int64)
                told = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(rows)), pa.array(~train[rows]), pa.array(np.diff(bounds)), pa.array(n_known), pa.array(base), pa.array(done)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "done"],
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, told.schema) as stream:
                    stream.write_batch(told)
                yield _row(names, (pid * 7 + seen) % tasks, 0, pid, np.array([seen], "<i8").tobytes() + sink.getvalue().to_pybytes())
                h, w, own = h[~fresh], w[~fresh], own[~fresh]
                spread = words.mixed(known[h] + (words.mixed(known[w]) % slices[h].astype(U64)) * U64(0x9E37_79B9_7F4A_7C15)) % U64(tasks)
                held.append([x.astype(np.int32) for x in (h, w, 2 * (seen + own) + train[rows][own], spread)])  # all that is held: 16 bytes a triple
                seen += len(rows)
                size += len(h)
                if size > FLUSH:
                    yield from blocks()
        if size:
            yield from blocks()

    return run


_SCORED = ["kind", "pid", "block"]


def _score(unigram: Unigram, share: int):
    """Blocks ``kind, pid, block``: 0 as received; 1 sums per text; 2 histories; 3 unseen or undecided triples; 4 pairs per count."""

    def one(blocks: list[tuple[int, bytes]]):
        parts = [_unpack(b) for _, b in blocks]
        source = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[6]) for p in parts])
        hashes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c_h = np.zeros(len(hashes), np.int64)
        c_h[place] = np.concatenate([p[1] for p in parts])
        h = np.repeat(place, np.concatenate([p[2] for p in parts]))
        w = np.concatenate([p[3][p[5]] for p in parts])
        c_w = np.concatenate([p[4][p[5]] for p in parts])
        text = np.concatenate([p[6] for p in parts])
        del parts
        doc, train = (text >> 1).astype(np.int32), (text & 1).astype(np.int32)
        order = np.argsort(words.mixed(w + hashes[h] * U64(0xA076_1D64_78BD_642F)), kind="stable")
        h, w, c_w, doc, train, source = h[order], w[order], c_w[order], doc[order], train[order], source[order]
        del order, text
        starts = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (h[1:] != h[:-1])))
        r_pair = np.add.reduceat(train, starts)
        pair = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(w))))
        r = r_pair[pair]
        real = r_pair > 0
        pair_h, pair_r = h[starts][real], r_pair[real].astype(np.int64)
        low = [np.bincount(pair_h[pair_r == i], minlength=len(hashes)) for i in range(1, K + 1)]
        high = np.bincount(pair_h[pair_r > K], pair_r[pair_r > K], len(hashes)).astype(np.int64)
        mass = np.bincount(pair_h, unigram.probability(c_w[starts][real]), len(hashes))
        discounted, spread = sum(low) > 0, c_h > share
        total = c_h + (~discounted & ~spread)
        seen = r > 0
        score = np.where(seen, np.log10(np.maximum(r, 1) / total[h]), np.log10(unigram.probability(c_w)))
        for s, (pid, _) in enumerate(blocks):
            mine = source == s
            docs, at = np.unique(doc[mine], return_inverse=True)
            counts = [np.bincount(at[r[mine] == i], minlength=len(docs)) for i in range(1, K + 1)]
            yield _row(_SCORED, 1, pid, _pack(docs.astype(np.int64), np.bincount(at, score[mine], len(docs)), *counts))
            later = mine & (~seen | (spread & ~discounted)[h])
            if later.any():
                keys, first, at = np.unique(h[later] * (int(doc.max()) + 1) + doc[later], return_index=True, return_inverse=True)
                missing, open_ = np.bincount(at, ~seen[later]), np.bincount(at, seen[later])
                yield _row(_SCORED, 3, pid, _pack(hashes[h[later][first]], doc[later][first].astype(np.int64), missing.astype(np.int64), open_.astype(np.int64)))
        needed = spread.copy()
        needed[h[~seen]] = True
        yield _row(_SCORED, 2, -1, _pack(hashes[needed], c_h[needed], *[x[needed] for x in low], high[needed], mass[needed]))
        yield _row(_SCORED, 4, -1, _pack(np.array([(pair_r == i).sum() for i in range(1, K + 2)], np.int64)))

    def run(batches):
        now, held = None, []
        for batch in batches:
            for task, kind, pid, block in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    yield _row(_SCORED, 0, pid, block)
                    continue
                if task != now and held:
                    yield from one(held)
                    held = []
                now = task
                held.append((pid, block))
        if held:
            yield from one(held)

    return run


def _histories(batches):
    names = ["h", "c", *[f"t{i}" for i in range(1, K + 1)], "high", "mass"]
    for batch in batches:
        for block in batch.column(0).to_pylist():
            h, *rest = _unpack(block)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, rest)], names=names)


def _later(batches):
    for batch in batches:
        for pid, block in zip(*(c.to_pylist() for c in batch.columns)):
            h, doc, missing, open_ = _unpack(block)
            columns = [h.view(np.int64), np.full(len(h), pid, np.int64), doc, missing, open_]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["h", "pid", "doc", "missing", "open"])


def _finish(discount: np.ndarray, train_tokens: int):
    """Rows of the texts from their blocks of kinds 0 and 1, sorted by ``pid``."""
    logs = np.log10(discount)

    def one(pid: int, told: list[bytes], sums: list[bytes]):
        starts, tables = [], []
        for block in told:
            starts.append(int(np.frombuffer(block[:8], "<i8")[0]))
            tables.append(pa.ipc.open_stream(block[8:]).read_all())
        order = np.argsort(starts)
        table = pa.concat_tables([tables[i] for i in order]).combine_chunks()
        score = table["done"].to_numpy().copy()
        for block in sums:
            docs, part, *counts = _unpack(block)
            score[docs] += part + sum(n * x for n, x in zip(counts, logs))
        n = len(score)
        columns = [np.full(n, pid, np.int64), np.arange(n)], [table[c].combine_chunks() for c in ("doc_id", "held_out", "n_tokens", "n_known")]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, columns[0]), *columns[1], pa.array(np.full(n, train_tokens, np.int64)), table["base"].combine_chunks(), pa.array(score)],
            names=["pid", "doc", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "partial"],
        )

    def run(batches):
        now, told, sums = None, [], []
        for batch in batches:
            for pid, kind, block in zip(*(c.to_pylist() for c in batch.columns)):
                if pid != now and told:
                    yield from one(now, told, sums)
                    told, sums = [], []
                now = pid
                (told if kind == 0 else sums).append(block)
        if told:
            yield from one(now, told, sums)

    return run


def _tasks(partitions: int, total: int) -> int:
    """Tasks for the triples: they follow the data, as a task holds all triples of its histories."""
    return max(2 * partitions, -(-total // TRIPLES))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    ``docs`` is scanned twice and must be a scan or another plan whose partitions stay the same.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held"), F.col(text_col).alias("text"))
    folder = sidecar.shared_folder(spark)
    counted = texts.mapInArrow(_count, "pid long, w long, n long").groupBy("pid", "w").agg(F.sum("n").alias("n"))
    totals = counted.repartition("w").sortWithinPartitions("w").mapInArrow(_totals, "pid long, w long, c long, first boolean")
    sidecar.write(totals, f"{folder}/tokens")

    marks = [int(np.array([x]).view(np.int64)[0]) for x in (START,)]
    table = spark.read.parquet(f"{folder}/tokens") if not docs.isEmpty() else None
    if table is None:
        return spark.createDataFrame([], _result_schema(docs, id_col))
    tokens = table.filter(F.col("first") & ~F.col("w").isin(marks))
    sums = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), *[F.count_if(F.col("c") == i) for i in range(1, K + 2)]).first()
    unigram = Unigram(sums[0], sums[1], list(sums[2:]))

    tasks = _tasks(int(spark.conf.get("spark.sql.shuffle.partitions")), unigram.total)
    share = max(20_000, unigram.total // (4 * tasks))
    sent = texts.mapInArrow(_send(f"{folder}/tokens", unigram, tasks, share), "task long, kind long, pid long, block binary")
    scored = sent.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(_score(unigram, share), "kind long, pid long, block binary")
    scored.write.partitionBy("kind").parquet(f"{folder}/scored")
    blocks = spark.read.schema("pid long, block binary, kind long").parquet(f"{folder}/scored")

    types = np.zeros(K + 1, np.int64)
    for row in blocks.filter("kind = 4").select("block").toLocalIterator():  # a few bytes per task
        types += _unpack(bytes(row["block"]))[0]
    discount = discounts(types.tolist())
    kept = sum((F.col(f"t{i}") * float(i * discount[i - 1]) for i in range(1, K + 1)), F.col("high").cast("double"))
    columns = ", ".join(f"t{i} long" for i in range(1, K + 1))
    histories = blocks.filter("kind = 2").select("block").mapInArrow(_histories, f"h long, c long, {columns}, high long, mass double")
    histories = histories.groupBy("h").agg(F.max("c").alias("c"), *[F.sum(x).alias(x) for x in (*[f"t{i}" for i in range(1, K + 1)], "high", "mass")])
    plain = sum((F.col(f"t{i}") for i in range(1, K + 1)), F.lit(0)) == 0
    total = F.col("c") + F.when(plain, 1).otherwise(0)
    weighed = histories.select("h", F.log10((1 - kept / total) / F.greatest(1 - F.col("mass"), F.lit(1e-12))).alias("alpha"), F.log10(F.col("c") / total).alias("shift"))
    weighed.withColumn("bucket", F.pmod("h", F.lit(16))).write.partitionBy("bucket").parquet(f"{folder}/histories")
    weights = spark.read.schema("h long, alpha double, shift double").parquet(f"{folder}/histories")

    unseen = blocks.filter("kind = 3").select("pid", "block").mapInArrow(_later, "h long, pid long, doc long, missing long, open long")
    back = F.sum(F.col("missing") * F.col("alpha") + F.col("open") * F.col("shift"))
    added = unseen.join(weights, "h").groupBy("pid", "doc").agg(back.alias("added"))
    added = materialize(added)
    side = F.broadcast(added) if added.count() <= BROADCAST_ROWS else added
    told = blocks.filter("kind in (0, 1)").select("pid", "kind", "block").repartition("pid").sortWithinPartitions("pid")
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = told.mapInArrow(
        _finish(discount, unigram.total),
        f"pid long, doc long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, partial double",
    )
    out = rows.join(side, ["pid", "doc"], "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("partial") + F.coalesce("added", F.lit(0.0))).alias("score"))


def _result_schema(docs: DataFrame, id_col: str) -> str:
    return f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _totals(batches):
    """``pid, w, c, first`` from rows sorted by ``w``: the count over all partitions, and one row per word marked as the first."""
    held = [np.zeros(0, np.int64)] * 3

    def out(pid, w, n):
        starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))[: len(w)]
        first = np.zeros(len(w), bool)
        first[starts] = True
        sums = np.add.reduceat(n, starts) if len(starts) else n
        return pa.RecordBatch.from_arrays(
            [pa.array(pid), pa.array(w), pa.array(np.repeat(sums, np.diff(np.append(starts, len(w))))), pa.array(first)], names=["pid", "w", "c", "first"]
        )

    for batch in batches:
        pid, w, n = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
        if len(w):
            cut = int(np.flatnonzero(np.append(True, w[1:] != w[:-1]))[-1])
            yield out(pid[:cut], w[:cut], n[:cut])
            held = [pid[cut:], w[cut:], n[cut:]]
    yield out(*held)
