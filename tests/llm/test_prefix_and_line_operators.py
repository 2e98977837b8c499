"""Conversation tries, line dedup and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import linededup, periodic, queries, trie

SCHEMA = "doc_id long, text string"
WHITE = b" \t\n\x0b\x0c\r"
sha = lambda data: hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- line dedup


def deduped(rows, min_docs=10, min_chars=1):
    key = lambda line: line.strip(WHITE).lower()
    lines = [(d, (t or "").encode().split(b"\n")) for d, t in rows]
    found = Counter(k for _, ls in lines for k in {key(x) for x in ls} if len(k.decode()) >= min_chars)
    out = []
    for d, ls in lines:
        kept = [x for x in ls if found[key(x)] < min_docs]
        out.append((d, b"\n".join(kept).decode(), len(ls), len(ls) - len(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(5)
    common = ["Share this page", "  share THIS page\r", "\tÄ rule", "ä rule", "x", "", " \x0b ", "—", "only nine"]
    rows = [(i, "\n".join(rng.choice(common[:8]) if rng.random() < 0.6 else f"line {rng.randrange(60)}" for _ in range(rng.randrange(0, 12)))) for i in range(150)]
    rows += [(1000 + i, "only nine\nonly nine\nonly nine") for i in range(9)]
    rows += [(None, None), (None, "x"), (7, ""), (7, "copy\ncopy"), (8, "\n\n\n"), (9, "end\n")]
    return rows + [(5, "same row\nShare this page")] * 12


@pytest.mark.parametrize("shard_lines,segment_rows", [(1 << 18, 1 << 14), (40, 8)])
def test_line_dedup(spark, monkeypatch, shard_lines, segment_rows):
    monkeypatch.setattr(linededup, "SHARD_LINES", shard_lines)
    monkeypatch.setattr(linededup, "SEGMENT_ROWS", segment_rows)
    rows = line_rows()
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], f"{SCHEMA}, segment int, shard string").repartition(3)
    got = linededup.drop_common_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect()), key=repr) == deduped(rows)


def test_line_dedup_limits_and_types(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    got = linededup.drop_common_lines(docs, "name", "body", min_docs=3, min_chars=4)
    want = deduped([(None if d is None else str(d), t) for d, t in rows], 3, 4)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert linededup.drop_common_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "\n".join(f"row {i % 7}" for i in range(200_000))
    (row,) = linededup.drop_common_lines(spark.createDataFrame([(1, long)], SCHEMA)).collect()
    assert (row.text, row.n_lines, row.n_dropped) == (long, 200_000, 0)


@pytest.mark.parametrize("levels", [0, 1, 40])
@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(monkeypatch, n, levels):
    monkeypatch.setattr(linededup, "LEVELS", levels)
    rng = np.random.default_rng(n)
    digests = rng.bytes(16 * n)
    counts = rng.integers(1, 70_000 if n > 2 else 200, n)
    shard = linededup.Shard.from_row(*linededup.Shard.build(digests, counts).row())
    assert sorted(shard.index(digests).tolist()) == list(range(n))
    assert shard.count(digests).tolist() == counts.tolist()
    assert not shard.count(np.random.default_rng(n + 1).bytes(16 * 5000)).any()
    assert shard.counts.dtype.itemsize == (4 if n > 2 else 1)


# --- periodic runs


def brute_runs(parts, least=24, exponent=3):
    n, out = len(parts), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and parts[j] == parts[j + q]:
                j += 1
            length = j - i + q
            run = parts[i : i + length]
            if length >= max(least, exponent * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def run_rows():
    rng, rows = random.Random(11), []
    for d in range(160):
        n, letters = rng.randrange(0, 160), rng.choice([1, 2, 3, 40])
        parts = [f"{rng.choice('aAé')}{rng.randrange(letters)}" for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 20:
                a, p = rng.randrange(n), rng.randrange(1, 20)
                for i in range(a, min(n, a + rng.randrange(120))):
                    parts[i] = parts[a + (i - a) % p]
        rows.append((d, "".join(x + rng.choice([" ", "\n", "\t ", "\x0b"]) for x in parts)))
    return rows + [(None, None), (None, "b " * 30), (3, ""), (3, "c d " * 12), (3, "c d " * 12), (4, "\xa0 " * 24), (5, "x y " * 12 + "x")]


def collapsed(parts, found):
    lost = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(x for i, x in enumerate(parts) if i not in lost)


def test_periodic_runs(spark):
    rows = run_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, runs string").repartition(3)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.text) for r in periodic.find_runs(docs).collect()), key=repr)
    want = []
    for d, text in rows:
        parts = (text or "").encode().split()
        found = brute_runs(parts)
        want.append((d, found, collapsed(parts, found).decode()))
    assert got == sorted(want, key=repr) and sum(len(w[1]) for w in want) > 40


@pytest.mark.parametrize("least,exponent", [(2, 2), (6, 2), (10, 4), (25, 3)])
def test_periodic_run_limits(spark, least, exponent):
    rows = run_rows()[:60]
    found = periodic.find_runs(spark.createDataFrame(rows, SCHEMA), min_words=least, min_exponent=exponent)
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in found.collect()}
    assert got == {d: brute_runs(t.encode().split(), least, exponent) for d, t in rows}


def test_periodic_report(spark):
    rows = run_rows()
    got = periodic.report(periodic.find_runs(periodic.make_periodic(spark.createDataFrame(rows, SCHEMA)))).collect()
    want = []
    for d, text in rows:
        parts = (text or "").encode().split()
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and parts:
            g, n = h // 10, len(parts)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            parts = [x if i < a else parts[a + (i - a) % p] for i, x in enumerate(parts)]
        found = brute_runs(parts)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
        milli = 1000 * best[1] // best[2] if found else None
        want.append((d, len(found), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(collapsed(parts, found))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > sum(len(brute_runs((t or "").encode().split())) for _, t in rows)
    assert periodic.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_with_runs(spark):
    texts = ["a " * 30_000, "a b " * 15_000, " ".join(str(i % 997) for i in range(30_000)), " ".join(str(i * i % 1009) for i in range(30_000))]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.find_runs(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == {0: [(0, 30_000, 1)], 1: [(0, 30_000, 2)], 2: [(0, 30_000, 997)], 3: [(0, 30_000, 1009)]}


# --- conversation trie


def brute_trie(rows):
    """``[(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends)]`` of the replanted conversations."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        cost = (len(convs) - 1) * len(path[-1][1].encode().split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += cost
    ends = lambda p: sha(",".join(str(c) for c in members[p] if built[c] == p))
    return sorted(
        ((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items()), key=repr
    )


def conversation_rows(n=140, seed=3):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 13])):
            said = "hello there" if t < 5 and rng.random() < 0.8 else rng.choice(["", "yes  no", None, f"more {rng.randrange(4)} words\there"])
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "user", "assistant", None]) if t % 2 else "user", said))
    rows += [(n + 1 + i, t, "user", f"copy {t}") for i in range(90) for t in range(6)]
    return rows + [(500, 1, "user", "tie"), (500, 1, "user", "tie"), (500, 1, "assistant", "x"), (None, 0, "user", "nobody"), (None, 0, "user", "nobody")]


@pytest.mark.parametrize("block,chunk,piece", [(4, 1 << 12, 1 << 12), (1, 2, 3), (3, 1, 7)])
def test_conversation_trie(spark, monkeypatch, block, chunk, piece):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, block int").repartition(3)
    got = trie.build(*trie.replant(trie.digests(table)), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_trie_of_a_long_conversation_and_empty_tables(spark):
    rows = [(20, t, "user", f"turn {t}") for t in range(900)] + [(40, t, "user", f"turn {t}") for t in range(700)] + [(21, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie.build(*trie.replant(trie.digests(table)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)
    assert trie.build(*trie.replant(trie.digests(table.limit(0)))).count() == 0


def test_new_queries_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = queries.op11_conversation_trie(spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie([tuple(r) for r in table.collect()])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(d, n, k, sha(t)) for d, t, n, k in deduped(docs)]
    assert sorted(map(tuple, queries.op12_line_dedup(spark, folder).collect())) == sorted(want)
    assert queries.op13_periodic_runs(spark, folder).count() == len(docs)
