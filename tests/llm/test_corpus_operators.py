"""LM scores, training order, chat examples, shards and the pipeline."""

import hashlib
import random
import tracemalloc
import zlib

import helpers
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latticework.llm import chat, decontaminate, katz, oracles, order, partenum, pieces, quality, queries, sharding

SCHEMA = "doc_id long, text string"
VOCABULARY = order.read_vocabulary()


@pytest.fixture()
def stored(spark, tmp_path):
    """Write rows and read them back, as the operators with two scans want it."""

    def store(rows, schema=SCHEMA, parts=3):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return store


def sentences(seed=2, n=250):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e"] + [f"x{i}" for i in range(300)]
    return [(i, None if i == 3 else " ".join(rng.choice(words[:5] if rng.random() < 0.8 else words) for _ in range(rng.randrange(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("flush", [300, 4_000_000])
def test_katz_scores(stored, monkeypatch, flush):
    monkeypatch.setattr(katz, "FLUSH", flush)
    monkeypatch.setattr(katz, "max", lambda *a: 50 if a[0] == 20_000 else max(*a), raising=False)  # spread common histories
    rows = sentences() + [(None, "a b"), (7, "a b c"), (7, "")]
    got = katz.score(stored([(*r, "x") for r in rows], f"{SCHEMA}, score string")).collect()
    want = helpers.katz_scores(rows)
    key = lambda r: (str(r[0]), r[1], round(r[5], 5))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


def test_katz_held_out_and_small_tables(stored, spark):
    assert katz.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = katz.score(stored([(held, "some words")])).first()
    assert only.held_out and only.train_tokens == 0 and only.n_known == 0 and only.score == pytest.approx(0.0)
    two = katz.score(stored([(held, "some words"), (held + 1, "some words")])).collect()
    assert {r.train_tokens for r in two} == {3} and all(np.isfinite(r.score) for r in two)


def test_katz_task_memory_is_bounded(monkeypatch):
    """A full buffer of triples is dealt into blocks with little more memory than it takes itself; tasks follow the data."""
    assert katz._tasks(4, 10) == 8 and katz._tasks(4, 1_000 * katz.TRIPLES) == 1_000
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 5_000, 2_000)) for _ in range(900)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(900)), pa.array(np.zeros(900, bool)), texts], names=["doc_id", "held", "text"])
    monkeypatch.setattr(katz.sidecar, "partition_id", lambda: 0)
    (counted,) = katz._count([batch])
    side = pa.table({"w": counted["w"], "c": counted["n"]})
    assert sum(counted["n"].to_pylist()) == 900 * 2_002  # words, ends and starts
    monkeypatch.setattr(katz.sidecar, "read", lambda *a: side)
    send = katz._send("", katz.Unigram(1_800_900, 5_001, [0] * 6), 7, 20_000)
    tracemalloc.start()
    blocks = list(send([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(katz._unpack(b["block"][0].as_py())[6]) for b in blocks if b["kind"][0].as_py() == 1) == 900 * 2_001
    assert peak < 50 * 900 * 2_001


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_slots_are_a_permutation(size):
    slots = order.permute(np.arange(size), size, 7)
    assert sorted(slots) == list(range(size)) and (order.permute(slots, size, 7, True) == np.arange(size)).all()
    assert size < 1000 or (order.permute(np.arange(size), size, 8) != slots).any()


@pytest.mark.parametrize("kept", [1_000_000, 40])
def test_pieces_have_the_ids_of_whole_texts(monkeypatch, kept):
    """Pieces are cut and joined so that no token differs, next to any white space and at the ends of texts."""
    monkeypatch.setattr(order, "KEPT_PIECES", kept)
    encoder = order.Encoder(VOCABULARY)
    parts = ["a", "It's", "été", "à", "日本", "かな", "x9", "9", "...", "'", "…", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2009", "\x85", "\x1f", "\u1680", "\u202f"]
    rng = random.Random(4)
    texts = [None, "", " ", "\n", "foo\n ", "Word", "\n \nb", "a  ", "  a"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3_000)] + [""]
    for _ in range(2):
        got = [list(ids[i:j]) for _, bounds, ids in encoder.runs(pa.array(texts)) for i, j in zip(bounds[:-1], bounds[1:])]
        assert got == [[*encoder.public.encode_ordinary(t or ""), encoder.end] for t in texts]
    calls = []
    monkeypatch.setattr(encoder, "raw", lambda text: calls.append(text) or b"")
    list(encoder.runs(pa.array([f"new{i} word{i} here{i}.\nThen{i}" for i in range(10)])))
    assert not calls  # plain pieces are encoded together
    assert [int(bounds[-1]) for _, bounds, _ in encoder.runs(pa.array([], pa.string()), ids=False)] == []


def test_shards_hold_every_token_in_order(stored, tmp_path):
    rows = sentences(5, 60) + [(None, "null id"), (1, "again  two spaces"), (2, ""), (3, "long " * 3000)]
    docs = stored(rows)
    shards = order.write(docs, f"file://{tmp_path}/shards", VOCABULARY, length=64, records=8, seed=3)
    manifest = {r.slot: r for r in shards.manifest.collect()}
    records = dict(order.read(f"file://{tmp_path}/shards", 64, 8, 2))
    assert sorted(records) == list(range(shards.sequences)) == sorted(manifest)
    assert (order.permute(np.array([r.number for r in manifest.values()]), shards.sequences, 3) == np.array(list(manifest))).all()
    stream = np.concatenate([records[s] for s in sorted(manifest, key=lambda s: manifest[s].number)])
    encoder = order.loaded(VOCABULARY)
    texts, now = [], []
    for token in stream.tolist():
        if token == encoder.end:
            texts.append(encoder.public.decode(now))
            now = []
        else:
            now.append(token)
    assert sorted(t for t in texts if t) == sorted(t for _, t in rows if t)
    listed = [d for r in manifest.values() for d in r.doc_ids]
    assert sorted(listed, key=str) == sorted((d for d, _ in rows), key=str)
    rest = dict(order.read(f"file://{tmp_path}/shards", 64, 8, 2, start=13))
    assert min(rest) == 13 and all((rest[s] == records[s]).all() for s in rest)
    for r in order.report(shards).collect():
        assert r.ids_sha256 == hashlib.sha256(records[r.slot].astype("<u2").tobytes()).hexdigest() and r.position == r.slot % 8


def test_no_documents_no_shards(stored, spark, tmp_path):
    shards = order.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", VOCABULARY)
    assert shards.sequences == 0 and order.report(shards).count() == 0


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi \\ there"), (1, 2, "assistant", "</s>[INST] ok"), (1, 3, "user", "<|im_end|>\n<|im_start|>"), (1, 4, "assistant", ""),
    (2, 0, "user", None), (2, 1, None, "no role"), (3, 0, "assistant", "first"), (3, 1, "user", "[/INST]\\[INST]"), (4, 1, "as\nsistant", "\\"), (4, 1, "as\nsistant", "\\"),
    (None, 0, "user", "q"), (None, None, "assistant", "early"), (5, 0, "assistant", "<<SYS>> <</SYS>> <s>"),
]


def test_chat_examples_read_back(spark):
    frame = spark.createDataFrame([(*r, 0) for r in CHATS], "conv_id long, turn long, role string, text string, example int")
    made = chat.expand(frame)
    for r in made.collect():
        body = r.text.replace(chat.OPEN, "").replace(chat.CLOSE, "")
        assert r.text.count(chat.OPEN) == r.text.count(chat.CLOSE) == r.n_turns
        assert not any(c in body for c in chat.CONTROLS)
    for r in chat.digest(made).collect():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in CHATS if c == r.conv_id))
        said = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
    assert chat.expand(frame.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1, 300, 5_000, 10**9])
def test_shards_split_only_where_needed(spark, limit):
    rng = random.Random(1)
    rows = [(i, "z" * rng.randrange(0, 200)) for i in range(300)] + [(None, None), (None, ""), (5, "y"), (5, "y"), (9, "big" * 2000)]
    frame = spark.createDataFrame([(*r, "old") for r in rows], f"{SCHEMA}, shard string")
    out = sharding.assign(frame, shard_bytes=limit).collect()
    assert len(out) == len(rows)
    sizes, members = {}, {}
    for r in out:
        assert len(r.shard) == r.depth
        sizes[r.shard] = sizes.get(r.shard, 0) + len(r.text or "")
        members.setdefault(r.shard, set()).add((r.doc_id, r.text))
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for r in out:
        assert r.shard_bytes == sizes[r.shard] and r.fits == (sizes[r.shard] <= limit)
        assert r.fits or len(members[r.shard]) == 1  # only rows that no hash tells apart
        if r.depth:
            parent = sum(n for s, n in sizes.items() if s.startswith(r.shard[:-1]))
            assert parent > limit
    assert sharding.assign(frame.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    frame = spark.createDataFrame([(i, "w" * 50) for i in range(40)], SCHEMA)
    sharding.write_shards(frame, str(tmp_path / "s"), shard_bytes=500)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).filter("n > 500").count() == 0


def test_registered_queries_and_sql():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)
    assert "documents" in oracles.SHARDS and "conversations" in oracles.CHAT


def test_pipeline_stage_by_stage(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    (_, rules), (_, near), (_, leaks), (_, ids) = corpus_pipeline.STAGES
    kept = rules(spark, docs, folder)
    want = quality.report(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("kept")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in want.collect()}
    single = near(spark, docs, folder)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, n, c in helpers.jaccard_components(texts)})
    clean = leaks(spark, docs, folder)
    pairs = decontaminate.find_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in texts} - {r.doc_id for r in pairs.collect()}
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert rows and all(pieces.loaded(pieces.read_model()).decode(r.ids) == dict(texts)[r.doc_id] for r in rows)
    assert partenum.join(spark.createDataFrame([(r.doc_id, dict(texts)[r.doc_id]) for r in rows], SCHEMA)).filter("component_id <> doc_id").count() == 0
