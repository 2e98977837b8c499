import numpy as np
import pyarrow as pa

from latticework.llm import words

TEXTS = [None, "", " \t\n", "A b\tc", "a  B\nC", "é É x", "one", "a b c d e f a b c d e f", "x\x1cy \x85 z", "w " * 3000]


def test_words_are_runs_between_ascii_white_space():
    known = {}
    for run_bytes in (1, 10, 1 << 20):
        rows = 0
        for run in words.runs(pa.array(TEXTS), run_bytes=run_bytes):
            for i in range(len(run)):
                want = (TEXTS[run.first + i] or "").encode().lower().split()
                got = run.hashes[run.bounds[i] : run.bounds[i + 1]].tolist()
                assert len(got) == len(want)
                for word, number in zip(want, got):
                    assert known.setdefault(word, number) == number
                rows += 1
        assert rows == len(TEXTS)
    assert len(set(known.values())) == len(known)


def test_case_matters_only_when_asked():
    folded, plain = (next(words.runs(pa.array(["Ab ab"]), folded=f)).hashes for f in (True, False))
    assert folded[0] == folded[1] and plain[0] != plain[1]


def test_sets_of_short_and_long_texts():
    run = next(words.runs(pa.array(TEXTS)))
    sizes = [len(s) for s in words.shingle_sets(run, 5)]
    want = []
    for t in TEXTS:
        w = (t or "").encode().lower().split()
        want.append(len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
    assert sizes == want
    short = words.sequence_hash(run.hashes[:2])
    assert short == words.sequence_hash(run.hashes[:2]) != words.sequence_hash(run.hashes[:3])
    assert words.window_hashes(run.hashes, 2)[0] == np.uint64(short)


def test_no_texts():
    assert list(words.runs(pa.array([], pa.string()))) == []
