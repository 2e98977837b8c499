"""Line dedup: lines that stand in many documents are dropped from all of them, by probing a sharded minimal perfect hash.

Method. A line's key is the line without ASCII white space at its ends and with A-Z as a-z; it is known by a 128-bit digest.
The range of digests is cut into shards of about ``SHARD_LINES`` lines, so their number grows with the data. Each
shard gets a minimal perfect hash: a level is an array of bits, twice as long as the keys that are left; a key alone in its
slot sets the bit and has its rank among set bits as index, the others go on to the next level. Under that index the
shard keeps two compact arrays, a 32-bit fingerprint (so that a strange line is told apart) and the count of documents, in the
narrowest type that holds the largest. The index is a table, one row a shard.

Documents never meet in a join of lines. Their texts are stored once with a segment number (runs of ``SEGMENT_ROWS`` rows). A segment sends
each distinct digest once to its shard, with the number of its documents that have the line; the shards are built from these
counts. Then the segments' digests probe the arrays, and the digests that are common come back to the segment as a
side file, which the task that reads the segment's texts again looks up line by line. A line that every document has is one entry a
segment, so no shard grows hot. Answers go by the stored segment number, so it does not matter how a scan is split.

Edge cases. A null or empty text is one empty line, and an empty line has no key, so it stays. A text that loses all lines is
empty. Rows are documents of their own, also with equal or null ids, so ten copies of one row make its lines common. Empty tables give no
rows. Other columns are ignored. Two lines are held equal if their 128-bit digests are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from latticework.llm import sidecar, words
from latticework.llm.frames import Batches, standard

U64 = words.U64
MIN_DOCS = 10
MIN_CHARS = 1
#: Lines of one shard of the index, on average.
SHARD_LINES = 1 << 18
SEGMENT_ROWS = 1 << 14
#: Distinct digests that a task holds before it sends them, and bytes of text in one batch of results.
FLUSH_KEYS = 1 << 19
FLUSH_BYTES = 8 << 20
#: Slots of a level per key, and levels before the keys left are listed as they are.
SPREAD, LEVELS = 2, 40
WHITE = b" \t\n\x0b\x0c\r"


def digest(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 16-byte digest of a line's key; none if the key is too short."""
    key = line.strip(WHITE).lower()  # bytes: only A-Z change
    if not key or (min_chars > 1 and len(key.decode()) < min_chars):
        return None
    return blake2b(key, digest_size=16).digest()


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(U64)
    return both[:, 0], both[:, 1]


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (((high >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


def _slots(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    spread = words.mixed(high + (low | U64(1)) * U64(2 * level + 1))
    return (((spread >> U64(32)) * U64(size)) >> U64(32)).astype(np.int64)


@dataclass
class Shard:
    """A minimal perfect hash over the digests of a shard, with their fingerprints and counts.

    ``sizes`` are the slots of each level, ``bits`` all levels behind each other in 64-bit words, ``rest`` the digests that no level could place.
    """

    sizes: list[int]
    bits: np.ndarray
    rest: bytes
    fingerprints: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])
        self.listed = {self.rest[i : i + 16]: n for n, i in enumerate(range(0, len(self.rest), 16))}

    @classmethod
    def build(cls, digests: bytes, counts: np.ndarray) -> Shard:
        """From distinct digests and their counts."""
        high, low = _halves(digests)
        left, sizes, parts = np.arange(len(high)), [], []
        while len(left) and len(sizes) < LEVELS:
            size = -(-len(left) * SPREAD // 64) * 64
            slots = _slots(high[left], low[left], len(sizes), size)
            alone = np.bincount(slots, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[slots]]
        rest = b"".join(digests[16 * i : 16 * i + 16] for i in left.tolist())
        out = cls(sizes, np.concatenate(parts) if parts else np.zeros(0, U64), rest, np.zeros(0, np.uint32), np.zeros(0, np.uint8))
        index = out.index(digests)
        width = np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8
        out.fingerprints, out.counts = np.empty(len(index), np.uint32), np.empty(len(index), width)
        out.fingerprints[index], out.counts[index] = low.astype(np.uint32), counts
        return out

    def index(self, digests: bytes) -> np.ndarray:
        """The place of each digest, -1 for those that are surely strange; other strange ones get any place."""
        high, low = _halves(digests)
        out, left, base = np.full(len(high), -1), np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            slots = base + _slots(high[left], low[left], level, size)
            word, bit = self.bits[slots >> 6], (slots & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            out[left[hit]] = (self.ranks[slots >> 6] + below)[hit]
            left, base = left[~hit], base + size
        for i in left.tolist() if self.listed else ():
            out[i] = self.listed.get(digests[16 * i : 16 * i + 16], -1 - self.ranks[-1]) + self.ranks[-1]
        return out

    def count(self, digests: bytes) -> np.ndarray:
        """Documents per digest; 0 for a strange one (missed once in 2**32)."""
        index = self.index(digests)
        if not len(self.counts):
            return np.zeros(len(index), np.int64)
        _, low = _halves(digests)
        known = (index >= 0) & (self.fingerprints[index] == low.astype(np.uint32))
        return np.where(known, self.counts[index].astype(np.int64), 0)

    def row(self) -> tuple:
        return (self.sizes, self.bits.astype("<u8").tobytes(), self.rest, self.fingerprints.astype("<u4").tobytes(),
                self.counts.dtype.itemsize, self.counts.astype(f"<u{self.counts.dtype.itemsize}").tobytes())

    @classmethod
    def from_row(cls, sizes, bits, rest, fingerprints, width, counts) -> Shard:
        return cls(list(sizes), np.frombuffer(bits, "<u8"), rest, np.frombuffer(fingerprints, "<u4"), np.frombuffer(counts, f"<u{width}"))


REQUEST = "shard long, segment long, digests binary, docs binary"
INDEX = "shard long, sizes array<long>, bits binary, rest binary, fingerprints binary, width int, counts binary"


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(part.split(" ") for part in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    data, offsets = words._buffers(batch.column(column))
    view = memoryview(data)
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield view[start:stop].tobytes()


def requests(texts: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """Per segment and shard: the sorted distinct digests of ``texts (segment, text)``, and in how many of its documents each is."""

    def sent(segment: int, counts: Counter) -> Iterator[pa.RecordBatch]:
        digests = b"".join(sorted(counts))
        docs = np.array([counts[digests[i : i + 16]] for i in range(0, len(digests), 16)], "<i4")
        edges = np.searchsorted(shard_of(_halves(digests)[0], shards), np.arange(shards + 1)).tolist()
        rows = [(s, segment, digests[16 * a : 16 * b], docs[a:b].tobytes()) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
        if rows:
            yield _batch(REQUEST, rows)

    def run(batches: Batches) -> Batches:
        now, counts = None, Counter()
        for batch in batches:
            for segment, raw in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                if segment != now or len(counts) >= FLUSH_KEYS:
                    yield from sent(now, counts)
                    now, counts = segment, Counter()
                counts.update({d for line in raw.split(b"\n") if (d := digest(line, min_chars))})
        yield from sent(now, counts)

    return texts.mapInArrow(run, REQUEST)


def build_index(asked: DataFrame) -> DataFrame:
    """One row per shard with its minimal perfect hash and arrays, from the ``requests`` of all segments."""

    def merged(blocks: list[tuple[bytes, bytes]]) -> tuple[bytes, np.ndarray]:
        digests = b"".join(d for d, _ in blocks)
        docs = np.concatenate([np.frombuffer(c, "<i4") for _, c in blocks]).astype(np.int64)
        high, low = _halves(digests)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        starts = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        return np.column_stack([high[starts], low[starts]]).astype(">u8").tobytes(), np.add.reduceat(docs[order], starts)

    def run(batches: Batches) -> Batches:
        now, blocks = None, []
        for batch in batches:
            for shard, digests, docs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if shard != now and blocks:
                    yield _batch(INDEX, [(now, *Shard.build(*merged(blocks)).row())])
                    blocks = []
                now = shard
                blocks.append((digests, docs))
        if blocks:
            yield _batch(INDEX, [(now, *Shard.build(*merged(blocks)).row())])

    return asked.repartition("shard").sortWithinPartitions("shard", "segment").mapInArrow(run, INDEX)


def probe(asked: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """Per request, the digests found in ``min_docs`` documents or more, as ``pid`` (its segment) and ``digests``.

    A shard's arrays are sorted ahead of its requests, so a task holds one shard and one request at a time.
    """
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    shards = index.select(*index.columns, F.lit(-1).cast("long").alias("segment"), empty("digests", "binary"))
    rest = [empty(f.name, f.dataType) for f in index.schema.fields[1:]]
    met = shards.unionByName(asked.select("shard", *rest, "segment", "digests")).repartition("shard").sortWithinPartitions("shard", "segment")

    def run(batches: Batches) -> Batches:
        shard = None
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                _, *arrays, segment, digests = (batch.column(c)[i].as_py() for c in range(batch.num_columns))
                if digests is None:
                    shard = Shard.from_row(*arrays)
                    continue
                common = np.flatnonzero(shard.count(digests) >= min_docs).tolist()
                if common:
                    found.append((segment, b"".join(digests[16 * k : 16 * k + 16] for k in common)))
            if found:
                yield _batch("pid long, digests binary", found)

    return met.mapInArrow(run, "pid long, digests binary")


def _drop(texts: DataFrame, path: str, min_chars: int) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of ``texts (doc_id, segment, text)``, by the answers under ``path``."""
    ddl = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_dropped long"

    def run(batches: Batches) -> Batches:
        now, common = None, set()
        for batch in batches:
            kept, total, lost, held, first = [], [], [], 0, 0
            for i, (segment, raw) in enumerate(zip(batch.column(1).to_pylist(), _texts(batch, 2))):
                if segment != now:
                    blocks = sidecar.read(path, segment, ["digests"])["digests"].to_pylist()
                    now, common = segment, {d[k : k + 16] for d in blocks for k in range(0, len(d), 16)}
                lines = raw.split(b"\n")
                stay = [line for line in lines if digest(line, min_chars) not in common] if common else lines
                kept.append(b"\n".join(stay))
                total.append(len(lines))
                lost.append(len(lines) - len(stay))
                held += len(raw)
                if held >= FLUSH_BYTES or i + 1 == batch.num_rows:
                    columns = [batch.column(0).slice(first, len(kept)), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_lines", "n_dropped"])
                    kept, total, lost, held, first = [], [], [], 0, i + 1

    return texts.mapInArrow(run, ddl)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: every text without the lines whose key, of ``min_chars`` code points or more, is in ``min_docs`` documents."""
    spark, folder = docs.sparkSession, sidecar.shared_folder(docs.sparkSession)
    seen = Observation()
    breaks = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    numbered = standard(docs, id_col, text_col).withColumn("segment", F.floor(F.monotonically_increasing_id() / SEGMENT_ROWS).cast("long"))
    numbered.observe(seen, F.sum(breaks).alias("lines")).select("doc_id", "segment", "text").write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    shards = -(-(seen.get["lines"] or 1) // SHARD_LINES)
    requests(texts.select("segment", "text"), shards, min_chars).write.parquet(f"{folder}/requests")
    asked = spark.read.parquet(f"{folder}/requests")
    build_index(asked).write.parquet(f"{folder}/index")
    sidecar.write(probe(asked, spark.read.parquet(f"{folder}/index"), min_docs), f"{folder}/common")
    return _drop(texts, f"{folder}/common", min_chars)
