"""SentencePiece encoding and decoding: Viterbi over a trie of distinct marked words, depth first.

Method. A text gets a leading space if the model wants one, spaces become the mark, and it is cut into units: a
run of marks with the word after it, the punctuation behind a word, line breaks. No piece of the model crosses such a cut. Each
task sorts the distinct new units of its texts, so the sorted order is a depth-first walk of their trie: from one unit to the
next, the forward states of the common prefix stay, and only the rest is computed. For a unigram model the state
after each character is the best score and its last piece. For a BPE model, whose pieces are ranks and not probabilities, it is
the last piece of the prefix's own encoding: the one piece that is compatible with the state it follows. Both give
the ids of the public library for the model's type. Characters without a piece become byte pieces, or else the unknown id.

Distinct units are numbered, and texts are held as arrays of these numbers. Encoded units are kept for the worker's later texts; beyond
``KEPT_UNITS`` units or ``KEPT_CHARS`` characters the less used half is forgotten. The model file is read once, on the driver, and its bytes (about 0.5 MB) go to the tasks.

Edge cases. Null and empty texts give no ids and decode to an empty text. Decoding gives back the text exactly, as
the model's normaliser changes nothing; models with another normaliser or user-defined pieces are refused. Very long
units take linear time. Ids out of range are an error. Repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.frames import append_columns, standard

#: Vocabulary file of the registered query, a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
KEPT_UNITS = 300_000
#: Characters of the kept units; writing without spaces gives units as long as sentences.
KEPT_CHARS = 8_000_000
KEPT_PAIRS = 400_000
MARK = "▁"
_PENALTY = 10.0  # an unknown character scores this much below the worst piece


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all spans, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """The pieces of a model, ready for encoding and decoding."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        parsed = proto.ModelProto()
        parsed.ParseFromString(model)
        spec, kinds = parsed.normalizer_spec, parsed.SentencePiece
        kind = parsed.trainer_spec.model_type
        if kind not in (parsed.trainer_spec.BPE, parsed.trainer_spec.UNIGRAM):
            raise ValueError("Only unigram and BPE models can be used")
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("Only models that leave their input as it is can be used")
        if any(p.type == kinds.USER_DEFINED for p in parsed.pieces):
            raise ValueError("Models with user-defined pieces can't be used")
        self.bpe = kind == parsed.trainer_spec.BPE
        self.lead = MARK if spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(parsed.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in parsed.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(parsed.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(parsed.pieces) if p.type == kinds.UNKNOWN)
        self.control = {i for i, p in enumerate(parsed.pieces) if p.type == kinds.CONTROL}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - _PENALTY
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("Only models whose pieces don't cross words can be used")
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        alone = re.escape("".join(c for c in "\n\t\r" if c not in inside))
        after_words = {c for p in self.ids for x, c in zip(p, p[1:]) if re.match(r"\w", x)}
        closing = re.escape("".join(c for c in ".,!?:;|#%&$*" if c not in after_words))
        # a word without what follows it, where no piece holds both; else all up to the next mark
        self.units = re.compile(rf"{MARK}*+\w++(?![^\w{MARK}{alone}{closing}])|{MARK}*+[^{MARK}{alone}]++|{MARK}++" + (f"|[{alone}]" if alone else ""))
        self.after: dict[str, dict] = {}  # per piece, those that were looked at after it; "" stands for the start
        self.n_pairs = 0
        self.usable = {p for p in self.ids if len(p) > 1 and self._merged(p) == [p]} if self.bpe else set()
        self.numbers: defaultdict[str, int] = defaultdict()
        self._keep([], np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.spelled = [None] * len(parsed.pieces)
        for piece, i in self.ids.items():
            self.spelled[i] = piece.encode()
        for value, i in self.bytes.items():
            self.spelled[i] = bytes([value])
        for i in self.control:
            self.spelled[i] = b""
        self.spelled[self.unknown] = " ⁇ ".encode()

    def _merged(self, text: str) -> list[str]:
        """The BPE pieces of a short text, by merging the best pair until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, left: str, piece: str, known: dict):
        """What may follow ``piece`` if it may stand after ``left``, else False; the answer is put into ``known``, those of ``left``."""
        fits = len(piece) == 1 or piece in self.usable
        if fits and left:
            fits = self._merged(left + piece) == [left, piece]  # the two stay two when encoded together
        known[piece] = self.after.setdefault(piece, {}) if fits else False
        self.n_pairs += 1
        return known[piece]

    def walk(self, units: list[str]):
        """Yield ``(unit, pieces)`` for sorted distinct units; forward states of common prefixes are reused."""
        if self.n_pairs > KEPT_PAIRS:
            self.after, self.n_pairs = {}, 0
        extend = self._bpe_states if self.bpe else self._unigram_states
        # after i characters: the last piece, and the score, or for BPE what is known of the pieces that may follow
        states: list = [("", self.after.setdefault("", {}) if self.bpe else 0.0)]
        before = ""
        for unit in units:
            common, most = 0, min(len(before), len(unit))
            while common < most and before[common] == unit[common]:
                common += 1
            del states[common + 1 :]
            extend(unit, common, states)
            pieces, end = [], len(unit)
            while end:
                piece = states[end][0]
                pieces.append(piece)
                end -= len(piece)
            pieces.reverse()
            yield unit, pieces
            before = unit

    def _unigram_states(self, unit: str, done: int, states: list) -> None:
        for end in range(done + 1, len(unit) + 1):
            best = None
            for start in range(max(0, end - self.longest), end):
                piece = unit[start:end]
                score = self.scores.get(piece)
                if score is None:
                    if start < end - 1:
                        continue
                    score = self.worst
                total = states[start][1] + score
                if best is None or total > best[1]:
                    best = (piece, total)
            states.append(best)

    def _bpe_states(self, unit: str, done: int, states: list) -> None:
        for end in range(done + 1, len(unit) + 1):
            # every prefix has one encoding, so exactly one piece that ends here fits
            for start in range(end - 1, -1, -1):
                left, known = states[start]
                piece = unit[start:end]
                after = known.get(piece)
                if after is None:
                    after = self._follows(left, piece, known)
                if after is not False:
                    states.append((piece, after))
                    break
            else:
                raise AssertionError("every prefix has an encoding")

    def _ids_of(self, pieces: list[str]) -> list[int]:
        found = list(map(self.ids.get, pieces))
        if None not in found:
            return found
        out = []
        for piece, i in zip(pieces, found):
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _keep(self, units: list[str], sizes: np.ndarray, flat: np.ndarray, used: np.ndarray) -> None:
        """Know these units only: their numbers of ids, all ids in order, and how often each was used."""
        self.numbers.default_factory = None  # else the old table holds itself
        self.numbers = defaultdict(None, zip(units, range(len(units))))
        self.numbers.default_factory = self.numbers.__len__  # a new unit gets the next number
        self.sizes, self.flat, self.used = sizes, flat, used
        self.starts = np.cumsum(sizes) - sizes
        self.chars = sum(map(len, units))

    def _forget(self) -> None:
        """Forget the less used half of the units."""
        names = list(self.numbers)
        order = np.argsort(-self.used, kind="stable")[: KEPT_UNITS // 2]
        chars = np.cumsum(np.fromiter((len(names[i]) for i in order.tolist()), np.int64, len(order)))
        most = np.sort(order[: np.searchsorted(chars, KEPT_CHARS // 2, "right")])
        sizes = self.sizes[most]
        self._keep([names[i] for i in most.tolist()], sizes, self.flat[_spans(self.starts[most], sizes)], self.used[most] // 2)

    def _learn(self, known: int) -> None:
        """Encode the units numbered from ``known`` on."""
        new = sorted(islice(self.numbers, known, None))
        self.chars += sum(map(len, new))
        sizes, flat = [], []
        for _, pieces in self.walk(new):
            ids = self._ids_of(pieces)
            sizes.append(len(ids))
            flat += ids
        places = np.fromiter(map(self.numbers.__getitem__, new), np.int64, len(new))
        own = np.array(sizes, np.int64)
        total = known + len(new)
        for name in ("sizes", "starts", "used"):
            setattr(self, name, np.concatenate([getattr(self, name), np.zeros(len(new), np.int64)]))
        self.sizes[places], self.starts[places] = own, len(self.flat) + np.cumsum(own) - own
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        assert len(self.sizes) == total == len(self.numbers)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and the ids of all texts in order."""
        if len(self.numbers) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self._forget()
        known, number, cut = len(self.numbers), self.numbers.__getitem__, []
        for text in texts:
            units = self.units.findall(self.lead + text.replace(" ", MARK)) if text else []
            cut.append(np.fromiter(map(number, units), np.int32, len(units)))
        self._learn(known)
        units = np.concatenate(cut) if cut else np.zeros(0, np.int32)
        self.used += np.bincount(units, minlength=len(self.used))
        sizes = self.sizes[units]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[np.cumsum([0, *map(len, cut)])]
        return np.diff(bounds), self.flat[_spans(self.starts[units], sizes)]

    def decode(self, ids: list[int] | None) -> str:
        """The text of some ids; control ids say nothing, and bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.spelled.__getitem__, ids or ())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.lead and text.startswith(" ") else text


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The tables of a model, once per Python worker."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _slices(column: pa.Array, chars: int = 4_000_000):
    """Runs of texts of about ``chars`` characters."""
    held, size = [], 0
    for value in column:
        text = value.as_py()
        held.append(text)
        size += len(text or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", chars: int = 1_000_000, keep_text: bool = True) -> DataFrame:
    """``docs`` with the ids of every text as ``array<int>``; texts of about ``chars`` characters are cut into units at once. Without ``keep_text`` the text does not come back."""
    place = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch) -> list:
        pieces = loaded(model)
        parts = [pieces.encode(texts) for texts in _slices(batch.column(place), chars)]
        sizes = np.concatenate([[0], *(p[0] for p in parts)])
        flat = np.concatenate([np.zeros(0, np.int32), *(p[1] for p in parts)])
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat, pa.int32()))]

    return append_columns(docs, f"{ids_col} array<int>", make, () if keep_text else (text_col,))


def decode(docs: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids of every row."""
    place = docs.columns.index(ids_col)
    return append_columns(docs, f"{text_col} string", lambda batch: [pa.array([loaded(model).decode(ids) for ids in batch.column(place).to_pylist()], pa.string())])


def report(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the number of ids, digests of the ids (little-endian 32-bit) and of the decoded text, and whether it is the text."""
    # encoded and decoded in one step, so that a task has one Python worker and the ids never leave it
    def make(batch: pa.RecordBatch) -> list:
        pieces = loaded(model)
        counts, digests, said_digests, same = [], [], [], []
        for texts in _slices(batch.column(1)):
            sizes, flat = pieces.encode(texts)
            end = 0
            for text, size in zip(texts, sizes.tolist()):
                mine = flat[end : end + size]
                end += size
                said = pieces.decode(mine.tolist())
                counts.append(size)
                digests.append(hashlib.sha256(mine.astype("<i4").tobytes()).hexdigest())
                said_digests.append(hashlib.sha256(said.encode()).hexdigest())
                same.append(said == (text or ""))
        return [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(said_digests, pa.string()), pa.array(same, pa.bool_())]

    return append_columns(standard(docs, id_col, text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean", make).drop("text")
