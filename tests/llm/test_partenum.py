import random

import helpers
import numpy as np
import pyarrow as pa
import pytest

from latticework.llm import partenum, words
from latticework.llm.graph import components

SCHEMA = "doc_id long, text string"


def corpus(seed=1):
    """Groups of edited copies of many sizes, some behind a common passage, with null ids and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(70):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 10, 12, 15, 20, 40, 80, 200]))]
        if rng.random() < 0.4:
            base = common[: rng.choice([10, 30, 60])] + base
        for _ in range(rng.choice([1, 2, 3, 6, 25])):
            x = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, len(x) // 20))):
                k, op = rng.randrange(len(x)), rng.random()
                if op < 0.4:
                    x[k] = rng.choice(vocabulary)
                elif op < 0.7:
                    x.insert(k, rng.choice(vocabulary))
                elif len(x) > 1:
                    del x[k]
            rows.append((len(rows) if rng.random() > 0.02 else None, " ".join(x)))
    return rows + [(None, None), (5_000, ""), (7_000, "  "), rows[0], rows[0]]


def brute(rows):
    numbered = helpers.jaccard_components([(i, t) for i, (_, t) in enumerate(rows)])
    component = {i: c for i, _, c in numbered}
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[component[i]] = min(least.get(component[i], doc_id), doc_id)
    return sorted(((rows[i][0], n, least.get(c)) for i, n, c in numbered), key=str)


def test_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(partenum, "SEGMENT", 3_000)
    monkeypatch.setattr(partenum, "CHUNK", 3)
    rows = corpus()
    got = partenum.join(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_copies_in_many_tasks_are_counted_and_signed_once(spark, tmp_path, monkeypatch):
    """Texts without near duplicates send no signature, however many tasks hold copies of them."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    for part in range(4):
        rows = [(part * 100 + i, t) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "copies"))
    signed, plain = [], partenum._signed_rows
    monkeypatch.setattr(partenum, "_signed_rows", lambda *a: signed.append(plain(*a)) or signed[0])
    out = partenum.join(spark.read.parquet(str(tmp_path / "copies"))).collect()
    assert len(out) == 160 and {(r.doc_id % 100, r.component_id) for r in out} == {(i, i) for i in range(40)}
    assert signed[0].count() == 0


def test_long_lists_are_not_broadcast(spark):
    """A side of few rows whose arrays are long stays distributed."""
    rows = spark.range(4).withColumnRenamed("id", "key")
    few = rows.selectExpr("key", "sequence(1, 10) AS ways")
    many = rows.selectExpr("key", "sequence(1, 100000) AS ways")
    plans = [partenum._beside(rows, side, "inner")._jdf.queryExecution().logical().toString() for side in (few, many)]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]


def test_one_row_of_each_component_stays(spark):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "x y"), (4, None), (None, None), (2, "x y"), (9, "q r s t u v")]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{SCHEMA}, key int")
    kept = partenum.representatives(frame)
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, rows[1][1]), (2, "x y"), (4, None), (None, None), (9, rows[6][1])], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert partenum.join(empty).count() == 0 and partenum.representatives(empty).count() == 0


@pytest.mark.parametrize("size", [1, 4, 8, 9, 30, 100, 400])
def test_similar_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    for trial in range(40):
        x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        y, percent = x, partenum.PERCENT
        drop, add = rng.integers(0, len(x) // 3 + 1), rng.integers(0, len(x) // 3 + 1)
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < percent * (len(x) + len(y) - shared) or not len(y):
            continue
        for hidden in (False, True):  # with and without knowing which features are nowhere else
            both = np.intersect1d(x, y)
            sides = [partenum.signatures(s, np.where(np.isin(s, both) | (not hidden), 1, 0).astype(np.uint8), percent) for s in (x, y)]
            assert len(np.intersect1d(*sides)) or (len(x) == len(y) == shared), (trial, hidden)


def test_buckets_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    sig, cls = np.sort(rng.integers(0, 30, 400)), rng.integers(0, 60, 400)
    slack = np.array([(c * 37 % 50) - 20 for c in cls])
    order = np.lexsort((cls, -slack, sig))
    columns = [c[order] for c in (sig, cls, np.full(400, 10), slack)]
    outs = []
    for step in (1, 7, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in columns], names=["sig", "cls", "n", "slack"]) for i in range(0, 400, step)]
        outs.append({tuple(r.values()) for b in partenum._buckets(iter(batches)) for r in b.to_pylist()})
    assert outs[0] == outs[1] == outs[2] and outs[0]
    best = {s: max(slack[sig == s]) for s in set(sig.tolist())}
    assert all(r[3] + best[r[0]] >= 0 for r in outs[0])


def test_packed_lists_come_back():
    values = np.unique(np.random.default_rng(2).integers(0, 2**40, 1000, dtype=np.uint64))
    back, counts = partenum._unpack(partenum._pack(values, np.full(len(values), 300)))
    assert (back == values).all() and (counts == 255).all()


def test_component_labels(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(labels[i] == 0 for i in range(41)) and labels[100] == labels[95] == labels[90] == 90
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_sets_agree():
    run = next(words.runs(pa.array(["a b c d e", "A B C D E"])))
    first, second = words.shingle_sets(run, 5)
    assert partenum.class_of(first) == partenum.class_of(second)
