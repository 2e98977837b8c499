"""Training-order materialisation: token sequences in a keyed random order, in binary shards of fixed stride.

Method. The texts of a scan partition are encoded and joined, an end id after each, and cut into sequences of
``length`` ids; the last of a partition is filled with end ids. A first pass counts the sequences of each
partition, so every sequence gets a dense number. A Feistel network keyed by ``seed`` permutes the numbers below the next
power of four; numbers outside the range walk on along their cycle until they fall inside, so each sequence gets a slot of
its own. Slots are dealt to one task per shard, sorted, and written: record ``i`` of shard ``s`` is slot ``s * records + i``
and starts at byte ``i * length * width``. So training reads sequentially, and resumes from any slot by one seek.
A file is written under a temporary name and then moved, so a repeated task does no harm.

Encoding. Texts are cut where white space begins and before a space that a word follows: no pre-token crosses these places, whatever
stands around them. The distinct pieces of a run of texts are found by their hashes; new ones are encoded by one call of the public
tokenizer and kept for later runs of the task (up to ``KEPT_PIECES``). The ids are those of the public tokenizer.

Edge cases. Null and empty texts are one end id. Rows with equal or null ids are kept. An empty table gives no shards and no rows.
Other columns are ignored. Very long texts spread over many sequences.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import sidecar, words
from latticework.llm.frames import standard

#: Vocabulary file of the registered query, a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 2_048
#: Sequences of a shard.
RECORDS = 2_048
ROUNDS = 6
KEPT_PIECES = 1_000_000


class Encoder:
    """A byte-pair vocabulary; ``end`` is the first free id."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self.end = max(ranks.values()) + 1
        self.kind = np.dtype("<u2" if self.end < 2**16 else "<u4")
        self.public = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.stop = np.array([self.end], self.kind).tobytes()
        self.sizes = np.zeros(self.end + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(piece) for piece in ranks]
        self.forget()

    def forget(self) -> None:
        """Drop the kept pieces: hashes in order, each one's place in the store and number of ids; place 0 holds the end id."""
        self.known, self.places, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.array([self.end], self.kind)

    def raw(self, text: str) -> bytes:
        return array(self.kind.char, self.public.encode_ordinary(text)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The little-endian ids of a text and its end id."""
        return self.raw(text) + self.stop if text else self.stop

    def _pieces(self, run: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of a run start, and how many bytes of a new piece's joined form stand before it (-1: not to be joined)."""
        data = run.data
        before, after = np.append(np.uint8(32), data[:-1]), np.append(data[1:], np.uint8(32))
        plain = _WHITE[data]
        opens = plain | ((data == 0xC2) & np.isin(after, (0x85, 0xA0))) | (np.isin(data, (0xE1, 0xE2, 0xE3)) & np.isin(after, (0x80, 0x81, 0x9A)))
        closes = plain | ((before == 0xC2) & np.isin(data, (0x85, 0xA0)))
        closes[2:] |= np.isin(data[:-2], (0xE1, 0xE2, 0xE3)) & np.isin(data[1:-1], (0x80, 0x81, 0x9A))
        follows = np.append(~opens[1:], False)  # a word, in the same text
        follows[run.offsets[run.offsets > 0] - 1] = False
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = plain[1:] & (~closes[:-1] | ((data[1:] == 32) & follows[1 : len(data)]))
        cut[run.offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts, len(data))[1:]
        lead = np.where(closes[ends - 1] if len(starts) else False, -1, np.where(plain[starts], 0, np.where(opens[starts], -1, 1)))
        return starts, lead

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray, hashes: np.ndarray) -> None:
        """Encode new pieces: those that end with a word in one text, apart where they don't begin with white space, the others alone."""
        order = np.argsort(lead < 0, kind="stable")
        starts, ends, lead, hashes = starts[order], ends[order], lead[order], hashes[order]
        joined = int((lead >= 0).sum())
        sizes = ends[:joined] - starts[:joined]
        stops = np.cumsum(sizes + lead[:joined])
        text = np.full(stops[-1] if joined else 0, 10, np.uint8)  # a line break before a word stays a token of its own
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[np.repeat(stops - sizes, sizes) + inside] = data[np.repeat(starts[:joined], sizes) + inside]
        ids = np.array(self.public.encode_ordinary(text.tobytes().decode()), self.kind)
        edges = np.append(0, np.cumsum(self.sizes[ids]))
        first, last = np.searchsorted(edges, stops - sizes), np.searchsorted(edges, stops)
        if (edges[first] != stops - sizes).any() or (edges[last] != stops).any():
            raise RuntimeError("A token crosses the border of a piece; the pattern is not the one that pieces are cut for")
        alone = [np.frombuffer(self.raw(data[i:j].tobytes().decode()), self.kind) for i, j in zip(starts[joined:].tolist(), ends[joined:].tolist())]
        counts = np.concatenate([last - first, np.array([len(x) for x in alone], np.int64)])
        more = counts[joined:]
        places = len(self.store) + np.concatenate([first, len(ids) + np.cumsum(more) - more])
        self.store = np.concatenate([self.store, ids, *alone])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.places, self.counts = known[order], np.concatenate([self.places, places])[order], np.concatenate([self.counts, counts])[order]

    def runs(self, texts: pa.Array, ids: bool = True):
        """``(first, bounds, ids)`` of runs of texts, an end after each text's ids; without ``ids`` only where they would lie."""
        for run in words.runs(texts, folded=False):
            starts, lead = self._pieces(run)
            ends = np.append(starts, len(run.data))[1:]
            found, first, place = np.unique(run.spans(starts, ends), return_index=True, return_inverse=True)
            at = np.searchsorted(self.known, found)
            new = (at == len(self.known)) | (np.append(self.known, np.uint64(0))[at] != found)
            if new.any():
                if len(self.known) + new.sum() > KEPT_PIECES or len(self.store) > 16 * KEPT_PIECES:
                    self.forget()
                    new[:] = True
                self._learn(run.data, starts[first[new]], ends[first[new]], lead[first[new]], found[new])
                at = np.searchsorted(self.known, found)
            owners = np.searchsorted(run.offsets, starts, "right") - 1
            bounds = np.searchsorted(starts, run.offsets) + np.arange(len(run) + 1)
            counts, places = np.ones(bounds[-1], np.int64), np.zeros(bounds[-1], np.int64)
            spot = np.arange(len(starts)) + owners
            counts[spot], places[spot] = self.counts[at][place], self.places[at][place]
            total = np.append(0, np.cumsum(counts))
            flat = self.store[np.repeat(places - total[:-1], counts) + np.arange(total[-1])] if ids else None
            yield run.first, total[bounds], flat


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOADED: dict[bytes, Encoder] = {}


def loaded(vocabulary: bytes) -> Encoder:
    """The encoder of a vocabulary, once per Python worker."""
    if vocabulary not in _LOADED:
        _LOADED.clear()
        _LOADED[vocabulary] = Encoder(vocabulary)
    return _LOADED[vocabulary]


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _round(values: np.ndarray, key: int) -> np.ndarray:
    x = (values + np.uint64(key)) * np.uint64(0xD6E8_FEB8_6659_FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xCA9B_0C7E_BA1D_A115)
    return x ^ (x >> np.uint64(29))


def permute(numbers: np.ndarray, size: int, seed: int, backwards: bool = False) -> np.ndarray:
    """A keyed permutation of ``0 .. size - 1``, or its inverse."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int.from_bytes(hashlib.blake2b(f"{seed}/{i}".encode(), digest_size=8).digest(), "little") for i in range(ROUNDS)]
    out = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for key in reversed(keys) if backwards else keys:
            if backwards:
                left, right = right ^ (_round(left, key) & mask), left
            else:
                left, right = right, left ^ (_round(right, key) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Shards:
    """Where the shards are and how they are cut; ``manifest`` has a row per sequence."""

    folder: str
    sequences: int
    length: int
    records: int
    width: int
    seed: int
    manifest: DataFrame


def _sequences(batches, encoder: Encoder, length: int):
    """``(ids, first_doc, n_docs)`` of the sequences of a partition: the row where the first text starts, and how many start."""
    held, starts, docs = np.zeros(0, encoder.kind), np.zeros(0, np.int64), []
    for batch in batches:
        rows = batch.column(0).to_pylist()
        for first, bounds, ids in encoder.runs(batch.column(1)):
            starts = np.append(starts, len(held) + bounds[:-1])
            held = np.append(held, ids)
            docs += rows[first : first + len(bounds) - 1]
            whole = len(held) // length
            edges = np.searchsorted(starts, np.arange(whole + 1) * length).tolist()
            for i in range(whole):
                yield held[i * length : (i + 1) * length].tobytes(), docs[edges[i] : edges[i + 1]]
            held, starts, docs = held[whole * length :], starts[edges[-1] :] - whole * length, docs[edges[-1] :]
    if len(held):
        yield held.tobytes() + encoder.stop * (length - len(held)), docs


def write(docs: DataFrame, folder: str, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, records: int = RECORDS, seed: int = 0) -> Shards:
    """Write the shards of ``docs`` below ``folder`` (shared storage) in training order.

    ``docs`` is scanned twice and must be a scan or another plan whose partitions stay the same.
    """
    texts = standard(docs, id_col, text_col)
    width = 2 if len(vocabulary.splitlines()) < 2**16 else 4

    def count(batches):
        encoder, total = loaded(vocabulary), 0
        for batch in batches:
            total += sum(int(bounds[-1]) for _, bounds, _ in encoder.runs(batch.column(0), ids=False))
        yield pa.RecordBatch.from_arrays([pa.array([sidecar.partition_id()]), pa.array([-(-total // length)])], names=["pid", "n"])

    counted = texts.select("text").mapInArrow(count, "pid long, n long").toArrow()  # one row per partition
    numbers = dict(zip(counted["pid"].to_pylist(), counted["n"].to_pylist()))
    sequences = sum(numbers.values())
    offsets, before = {}, 0
    for pid in sorted(numbers):
        offsets[pid], before = before, before + numbers[pid]
    kind = texts.schema["doc_id"].dataType.simpleString()
    id_type = texts.select("doc_id").limit(0).toArrow().schema.field(0).type

    def place(batches):
        pid, n, held = sidecar.partition_id(), 0, []

        def out():
            numbers = np.arange(n - len(held), n) + offsets[pid]
            slots = permute(numbers, sequences, seed)
            return pa.RecordBatch.from_arrays(
                [pa.array(slots // records), pa.array(slots), pa.array(numbers), pa.array([d for _, d in held], pa.list_(id_type)), pa.array([i for i, _ in held], pa.binary())],
                names=["shard", "slot", "number", "doc_ids", "ids"],
            )

        for sequence in _sequences(batches, loaded(vocabulary), length):
            held.append(sequence)
            n += 1
            if len(held) == 1_024:
                yield out()
                held = []
        if held:
            yield out()
        if n != numbers[pid]:
            raise RuntimeError("The scan gave other rows than before; give a table that does not change")

    def save(batches):
        files, inner = fs.FileSystem.from_uri(folder)
        files.create_dir(inner, recursive=True)
        context = TaskContext.get()
        mark = f"{context.stageId()}-{context.taskAttemptId()}"
        now, stream = None, None

        def close():
            if stream is not None:
                stream.close()
                files.move(_temporary(inner, now, mark), f"{inner}/{shard_name(now)}")

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(4)):
                if shard != now:
                    close()
                    now, stream = shard, files.open_output_stream(_temporary(inner, shard, mark))
                stream.write(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)], names=["shard", "slot", "number", "doc_ids"])
        close()

    shards = max(1, -(-sequences // records))
    placed = texts.mapInArrow(place, f"shard long, slot long, number long, doc_ids array<{kind}>, ids binary")
    ordered = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    manifest = ordered.mapInArrow(save, f"shard long, slot long, number long, doc_ids array<{kind}>")
    manifest.write.parquet(f"{folder}/manifest")
    return Shards(folder, sequences, length, records, width, seed, docs.sparkSession.read.parquet(f"{folder}/manifest"))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _temporary(folder: str, shard: int, mark: str) -> str:
    return f"{folder}/.{shard_name(shard)}-{mark}"


def read(folder: str, length: int, records: int, width: int, start: int = 0):
    """The sequences from slot ``start`` on, as they are trained on: ``(slot, ids)``, shard by shard."""
    files, inner = fs.FileSystem.from_uri(folder)
    stride, shard, skip = length * width, start // records, start % records
    while files.get_file_info(f"{inner}/{shard_name(shard)}").type == fs.FileType.File:
        with files.open_input_file(f"{inner}/{shard_name(shard)}") as file:
            file.seek(skip * stride)
            for i in range(skip, file.size() // stride):
                yield shard * records + i, np.frombuffer(file.read(stride), "<u2" if width == 2 else "<u4")
        shard, skip = shard + 1, 0


def report(shards: Shards) -> DataFrame:
    """Per slot, what its shard holds when read back: shard, position, the sequence's own number, the texts that start in it and a digest."""
    folder, length, records, width = shards.folder, shards.length, shards.records, shards.width
    stride = length * width

    def run(batches):
        files, inner = fs.FileSystem.from_uri(folder)
        now, file = None, None
        for batch in batches:
            digests, positions = [], []
            for shard, slot in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now:
                    if file is not None:
                        file.close()
                    now, file = shard, files.open_input_file(f"{inner}/{shard_name(shard)}")
                position = slot - shard * records
                if file.tell() != position * stride:
                    file.seek(position * stride)
                positions.append(position)
                digests.append(hashlib.sha256(file.read(stride)).hexdigest())
            columns = [batch.column(1), batch.column(0), pa.array(positions, pa.int64()), batch.column(2), batch.column(3), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "position", "number", "doc_ids", "ids_sha256"])

    kind = shards.manifest.schema["doc_ids"].dataType.simpleString()
    rows = shards.manifest.select("shard", "slot", "number", "doc_ids")
    return rows.mapInArrow(run, f"slot long, shard long, position long, number long, doc_ids {kind}, ids_sha256 string")
