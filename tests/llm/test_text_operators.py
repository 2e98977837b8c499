"""Quality rules, decontamination, licences, pieces and counts against plain Python."""

import hashlib
import random
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from latticework.llm import counts, decontaminate, frames, licences, order, pieces, quality, words

SCHEMA = "doc_id long, text string"
PROSE = "The rain that fell on the old town was soft and it ran along the stones to the river below the hill."
AWKWARD = [None, "", " \n ", "x", "ab " * 4000, "a  b\t c\n\n d", "É日🙂 ▁ <s>", "one\ntwo\none\n", "\x00\x1f end"]


def prose(rng, n):
    return " ".join(rng.choice(PROSE.split()) + rng.choice(["", "", "ly", "ed", ","]) for _ in range(n)) + "."


def rows(seed=0):
    rng = random.Random(seed)
    made = [(i, "\n".join(prose(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    made += [(100 + i, "\n".join("BUY!! NOW!! " * 12 + "### $$$" for _ in range(5))) for i in range(15)]
    return made + [(200 + i, t) for i, t in enumerate(AWKWARD)] + [(None, PROSE), made[0], made[0]]


def base_features(text):
    text = text or ""
    lines, found = text.split("\n"), [w for w in words_of(text)]
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    many = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in lines:
        if words_of(line):
            dup += line in seen
            seen.add(line)
    n = len(found)
    failed = n < 50 or 100 * len(marked) > 50 * n
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), failed


def words_of(text):
    return [w.decode() for w in text.encode().split()]


def test_quality_statistics_and_verdict(spark):
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows())], f"{SCHEMA}, kept int")  # a clashing column
    labels = spark.createDataFrame([(i, int(i < 60)) for i in [*range(60), *range(100, 115)]] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality.report(frame, labels).collect()
    assert len(out) == len(rows())
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=str)
    assert got == sorted(((d, *base_features(t)) for d, t in rows()), key=str)
    for r in out:
        assert r.kept == (not r.base_failed and r.content_share >= quality.MIN_CONTENT)
        if r.doc_id is not None and r.doc_id < 100:
            assert r.kept == (not r.base_failed)
        if r.doc_id is not None and 100 <= r.doc_id < 200:
            assert not r.kept and r.n_content_lines == 0


def test_quality_fit_uses_late_lines(spark):
    rng = random.Random(11)
    clean = lambda n: [prose(rng, 12) for _ in range(n)]
    texts = [clean(rng.randrange(90, 110)) for _ in range(20)] + [clean(70) + ["BUY!! NOW!! ### $$$"] * rng.randrange(20, 50) for _ in range(20)] + [clean(1)]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], SCHEMA)
    chain = quality.train(docs, spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int"))
    features = lambda text: next(quality.lines_of(run).features for run in words.runs(pa.array([text]), folded=False))
    label = lambda lines: quality.decode(chain, features("\n".join(lines)), np.zeros(len(lines), np.int64)).tolist()
    assert label(clean(100)) == [1] * 100 and label(["BUY!! NOW!! ### $$$"] * 30) == [0] * 30


def test_quality_fit_climbs_the_enumerated_likelihood():
    rng = np.random.default_rng(5)
    texts, labels = [rng.normal(size=(n, quality.N_FEATURES)) for n in (4, 1, 3, 5, 0, 2)], [0, 1, 1, 0, 1, 1]
    weight = [1 / (2 * (2 if y == 0 else 3) * max(len(x), 1)) for x, y in zip(texts, labels)]

    def likelihood(emit, move, start):
        value = -0.05 * sum((p**2).sum() for p in (emit, move, start))
        for x, y, w in zip(texts, labels, weight):
            paths = [[(k >> t) & 1 for t in range(len(x))] for k in range(2 ** len(x))] if len(x) else []
            score = lambda p: start[p[0]] + sum(x[t] @ emit[:, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            value += w * (score([y] * len(x)) - np.log(sum(np.exp(score(p)) for p in paths))) if len(x) else 0
        return value

    chain = quality.fit(texts, labels, steps=2500, rate=0.01, ridge=0.1)
    best = likelihood(chain.emit, chain.move, chain.start)
    for _ in range(30):
        shift = [1e-2 * rng.normal(size=p.shape) for p in (chain.emit, chain.move, chain.start)]
        assert likelihood(*(p + d for p, d in zip((chain.emit, chain.move, chain.start), shift))) < best


def test_quality_without_labels_or_rows(spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    chain = quality.train(spark.createDataFrame(rows(), SCHEMA), nothing)
    assert chain is quality.ALL_CONTENT
    assert quality.judge(spark.createDataFrame([], SCHEMA), chain).count() == 0


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(1)
    chain = quality.Chain(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [3, 1, 5, 2]
    features = rng.normal(size=(sum(sizes), quality.N_FEATURES))
    labels = quality.decode(chain, features, np.repeat(np.arange(4), sizes))
    at = 0
    for n in sizes:
        scores = features[at : at + n] @ chain.emit
        paths = [[(k >> t) & 1 for t in range(n)] for k in range(2**n)]
        value = lambda p: chain.start[p[0]] + sum(scores[t, s] for t, s in enumerate(p)) + sum(chain.move[a, b] for a, b in zip(p, p[1:]))
        assert labels[at : at + n].tolist() == max(paths, key=value)
        at += n


def smith_waterman(a, b):
    best, before = 0, [0] * (len(a) + 1)
    for y in b:
        now = [0] * (len(a) + 1)
        for j, x in enumerate(a, 1):
            now[j] = max(0, before[j - 1] + (2 if x == y else -1), before[j] - 1, now[j - 1] - 1)
        best, before = max(best, *now), now
    return best


def test_alignment_scores():
    rng = random.Random(4)
    pairs = [([rng.randrange(6) for _ in range(rng.randrange(1, 9))], [rng.randrange(6) for _ in range(rng.randrange(1, 20))]) for _ in range(200)]
    got = decontaminate.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert got.tolist() == [smith_waterman(a, b) for a, b in pairs]


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_leaks_copied_and_edited(spark, block_words):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(8)] + [(8, "rare pair"), (9, None), (10, ""), (None, " ".join(vocabulary[:20]))]
    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    edited = items[2][1].split()
    edited[5], edited[14] = "other", "words"
    del edited[20]
    docs = [(1, f"{noise(50)} {items[0][1].upper()} {noise(50)}"), (2, f"{noise(20)}\n{' '.join(edited)}\t{noise(9)}"), (3, noise(80)), (4, None), (5, ""),
            (6, "a rare pair here"), (7, " ".join(items[1][1].split()[:9]) + " " + noise(60)), (None, items[3][1]), (1, items[0][1])]
    docs += [(100 + i, items[4][1]) for i in range(20)]  # one passage in many texts
    out = decontaminate.find_leaks(spark.createDataFrame([(*d, 1.0) for d in docs], f"{SCHEMA}, score double"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    want = {(1, 0), (2, 2), (6, 8), (None, 3)} | {(100 + i, 4) for i in range(20)}
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want
    kept = decontaminate.clean(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "7", "None"]
    assert decontaminate.find_leaks(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("copies, every, entries", [(5, 5, 2_000_000), (9, 5, 2_000_000), (9, 4, 40), (2_000, 5, 2_000_000)])
def test_leaks_of_an_edited_passage_in_many_texts(spark, monkeypatch, copies, every, entries):
    monkeypatch.setattr(decontaminate, "_ENTRIES", entries, raising=False)
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [["which", "of", "the", "following", *noise(n)] for n in (16, 36, 56)]
    docs = []
    for item in items:
        edited = [f"other{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
        docs += [noise(3) + edited + noise(3) for _ in range(copies)]
    docs += [noise(10) + ["which", "of", "the", "following"] + noise(10) for _ in range(copies)]
    score = lambda item, doc: smith_waterman(item, doc) / (2 * len(item))
    known = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            if d % copies < 5 and set(zip(item, item[1:], item[2:])) & set(zip(doc, doc[1:], doc[2:])):
                known[d, i] = score(item, doc)
    made = [spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], f"{name} long, text string") for texts, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(*made).collect()}
    assert set(got) == {(i * copies + c, i) for i in range(3) for c in range(copies)}
    assert {k: v for k, v in got.items() if k in known} == pytest.approx({k: v for k, v in known.items() if v >= decontaminate.MIN_SCORE})


def test_alignments_with_many_gaps(spark):
    """A copy with a long insertion and then a word after every second strays far from the diagonal of its first seeds."""
    item = [f"w{i}" for i in range(60)]
    docs = []
    for intact in (12, 18, 24):
        for inserted in (5, 12, 20, 24):
            rest = [x for i in range(intact, 60, 2) for x in (*item[i : i + 2], f"new{i}")]
            docs.append([f"before{i}" for i in range(70)] + item[:intact] + [f"in{i}" for i in range(inserted)] + rest + [f"after{i}" for i in range(70)])
    score = lambda doc: smith_waterman(item, doc) / 120
    want = {d: score(doc) for d, doc in enumerate(docs) if score(doc) >= decontaminate.MIN_SCORE}
    frames = [spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], f"{name} long, text string") for texts, name in ((docs, "doc_id"), ([item], "item_id"))]
    assert {r.doc_id: r.score for r in decontaminate.find_leaks(*frames).collect()} == pytest.approx(want) and len(want) > 6


def test_recall_of_the_seeds(spark):
    """Of all pairs that plain alignment accepts, at least nine in ten share three words in a row, with edits anywhere."""
    rng = random.Random(17)
    items = [[f"w{rng.randrange(4000)}" for _ in range(40)] for _ in range(40)]
    docs, best = [], {}
    for d in range(240):
        item, out, rate = items[d % 40], [], rng.choice([0.05, 0.1, 0.2, 0.3])
        for x in item:
            kind = rng.random() / rate
            out += [] if kind < 0.33 else [f"n{rng.randrange(10**6)}"] if kind < 0.66 else [x, f"n{rng.randrange(10**6)}"] if kind < 1 else [x]
        docs.append([f"n{rng.randrange(10**6)}" for _ in range(30)] + out)
        best[d] = smith_waterman(item, docs[-1]) / 80
    want = {(d, d % 40) for d, score in best.items() if score >= decontaminate.MIN_SCORE}
    frames = [spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], f"{name} long, text string") for texts, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(*frames).collect()}
    assert got <= want and len(want) > 100 and len(got) >= 0.9 * len(want)


def test_lines_are_fitted_as_they_are_judged(spark, monkeypatch):
    """The features that the chain is fitted on are those that the verdict reads, also for words that differ in case only."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.extend(texts) or quality.ALL_CONTENT)
    text = "The the THE tHe thE THe tHE The\nOne two Three FOUR five six seven eight nine\nthe one The One"
    quality.train(spark.createDataFrame([(1, text)], SCHEMA), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    (run,) = quality.words.runs(pa.array([text]), folded=False)
    assert seen[0].tolist() == quality.lines_of(run).features.tolist()


def test_licences_in_any_dress(spark):
    mit = dict(reversed(licences.KNOWN))["MIT"]
    texts = [mit, "Copyright (c) 2020 Somebody\n\n" + licences.KNOWN[5][1].upper().replace("\n", "  \n"), "© 1999 X\nreleased under the  MIT Licence!", "Released under the MIT License. And more.", None, "", "!!", licences.KNOWN[0][1]]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], f"{SCHEMA}, license_id string")
    got = {r.doc_id: r.license_id for r in licences.scan(frame, licences.known_licences(spark)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "CC-BY-NC-4.0"}
    assert licences.scan(frame, spark.createDataFrame([], "license_id string, text string")).filter("license_id is not null").count() == 0


def line_features(line, again):
    found, raw = line.split(), line
    n, chars = len(found), max(len(raw.decode()), 1)
    upper, lower = sum(65 <= b < 91 for b in raw), sum(97 <= b < 123 or b > 127 for b in raw)
    symbols, said = sum(b in b"#*$%&|<>" for b in raw), (1 - len(set(found)) / n if n >= 8 else 0)
    return np.array([1, min(symbols / n, 1), min(symbols / chars * 10, 1), min(raw.count(b"!") / n, 1), upper / max(upper + lower, 1), sum(48 <= b < 58 for b in raw) / chars,
                     said, said > 0.8, min(np.log1p(n) / 6, 1), again, raw[-1:] in (b".", b"!", b"?", b":", b";", b'"', b"'")], float)


def best_labelling(chain, scores):
    """Enumerated for few lines, else the best path to each state, line by line."""
    value = lambda p: chain.start[p[0]] + sum(scores[t][s] for t, s in enumerate(p)) + sum(chain.move[a, b] for a, b in zip(p, p[1:]))
    if len(scores) <= 10:
        return max(([(k >> t) & 1 for t in range(len(scores))] for k in range(2 ** len(scores))), key=value)
    paths = [[0], [1]]
    for n in range(2, len(scores) + 1):
        paths = [max((p + [s] for p in paths), key=value) for s in (0, 1)]
        assert len(paths[0]) == n
    return max(paths, key=value)


def test_pipeline_stages_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    chain = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = set()
    for d, text in texts.items():
        lines = [line for line in (text or "").encode().split(b"\n") if line.split()]
        scores = [line_features(line, line in lines[:i]) @ chain.emit for i, line in enumerate(lines)]
        chars = [len(line.decode()) for line in lines]
        if lines and not base_features(text)[-1] and sum(c * s for c, s in zip(chars, best_labelling(chain, scores))) >= quality.MIN_CONTENT * sum(chars):
            kept.add(d)
    assert {r.doc_id for r in stages["quality_rules"](spark, docs, folder).collect()} == kept

    split = lambda text: [w.lower() for w in (text or "").encode().split()]
    items = [split(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    edited = [b"other" if i % 5 == 4 else w for i, w in enumerate(max(items, key=len))]  # in many documents, so that no seed of it is rare
    planted = {10**9 + i: b" ".join(edited).decode() for i in range(12)}
    wider = docs.unionByName(spark.createDataFrame(list(planted.items()), SCHEMA), allowMissingColumns=True)
    leaked = set()
    for d, text in (texts | planted).items():
        doc = split(text)
        there = set(doc)
        for item in items:  # an item can only reach the score with so many of its words in the text
            least = decontaminate.MIN_SCORE * len(item)
            if item and sum(w in there for w in item) >= least and smith_waterman(item, doc) >= 2 * least:
                leaked.add(d)
                break
    assert set(planted) < leaked and {r.doc_id for r in stages["benchmark_decontamination"](spark, wider, folder).collect()} == set(texts) - leaked


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES."""
NOTICES = ["", "Copyright (c) 2020 Some Body\n\n", "(C) 1999-2003 by X\r\nCopyright by Y\n© Z\nAll rights reserved.\n\n", "Copyright Jane Doe\nCopyright Google Inc. All Rights Reserved.\n\n", "  © 1999 X\n", "Copyright [yyyy] [name]\n"]


def test_licences_wrapped_at_any_width(spark):
    known = licences.KNOWN + [("BSD-2-Clause", BSD)]
    wrapped = lambda text, width: "\n".join(textwrap.fill(line, width, break_long_words=False) for line in text.split("\n"))
    made = [(name, NOTICES[(i + width) % len(NOTICES)] + wrapped(text, width)) for i, (name, text) in enumerate(known) for width in range(16, 110)]
    made += [(name, "\n\n".join(text.split()).replace("\n\n", "\n")) for name, text in known]  # a word a line
    made += [(None, t) for t in ["(c) the licensee pays.\nReleased under the MIT License.", "All rights reserved. No use.\nReleased under the MIT License.", "Copyrighted work.\nReleased under the MIT License."]]
    made += [("MIT", "Copyright of many\n" * 50_000 + "\nReleased under the MIT License.")]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(made)], SCHEMA)
    more = spark.createDataFrame([(0, "BSD-2-Clause", BSD)], "n int, license_id string, text string")
    got = {r.doc_id: r.license_id for r in licences.scan(frame, licences.known_licences(spark, more)).collect()}
    assert [(got[i], t) for i, (_, t) in enumerate(made)] == made


MODEL = pieces.read_model()

@pytest.mark.parametrize("bound", ["KEPT_UNITS", "KEPT_CHARS"])
def test_pieces_forget_units_without_changing_ids(monkeypatch, bound):
    rng = random.Random(3)
    said = [" ".join("".join(rng.choices("abcdeé樂", k=rng.randrange(1, 9))) for _ in range(40)) for _ in range(30)]
    small, public = pieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    monkeypatch.setattr(pieces, bound, 100)
    forgotten = 0
    for text in said:
        old = small.numbers
        assert small.encode([text])[1].tolist() == public.encode(text)
        assert small.chars == sum(map(len, small.numbers)) and len(small.numbers) == len(small.sizes)
        if old is not small.numbers:
            assert old.default_factory is None  # the old table does not hold itself
            forgotten += 1
    assert forgotten > 3


def test_pieces_are_those_of_the_public_library(spark):
    rng = random.Random(0)
    public = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    letters = "  ab\n\teéèßü▁日本語‍🙂the ing<s></s><0x41>.,!|#"
    texts = [t for _, t in rows()] + ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(1500)] + ["   ", "\n\n  x", " a", "a ", "the" * 900]
    frame = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], f"{SCHEMA}, ids array<int>")
    out = pieces.decode(pieces.encode(frame, MODEL), MODEL).collect()
    assert len(out) == len(texts)
    for r in out:
        assert list(r.ids) == (public.encode(r.text) if r.text else [])
        assert r.decoded == (r.text or "").replace("▁", " ")
    report = pieces.report(frame.filter("text is null or text not like '%▁%'"), MODEL)
    assert report.filter("not round_trip").count() == 0
    first = report.filter("doc_id = 0").first()
    assert first.ids_sha256 == hashlib.sha256(np.array(public.encode(texts[0]), "<i4").tobytes()).hexdigest()
    assert pieces.encode(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_encoded_batches_are_small_and_leave_the_text_behind(spark, monkeypatch):
    """A large Arrow batch is worked on in short runs of rows, and the pipeline's last stage hands no text back from Python."""
    batch = pa.record_batch({"doc_id": list(range(5_000)), "text": ["the rain and the river " * 90] * 5_000})
    parts = list(frames.slices(batch))
    assert len(parts) > 1 and max(p.nbytes for p in parts) <= 1.1 * frames.SLICE_BYTES and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    seen, plain = [], pieces.append_columns
    monkeypatch.setattr(pieces, "append_columns", lambda *a: seen.append(plain(*a)) or seen[0])
    docs = spark.createDataFrame([(1, "the rain", "en", "web"), (2, None, "en", "web")], f"{SCHEMA}, lang string, source string")
    out = {r.doc_id: list(r.ids) for r in corpus_pipeline.token_ids(spark, docs, "").collect()}
    assert out == {1: sentencepiece.SentencePieceProcessor(model_proto=MODEL).encode("the rain"), 2: []} and "text" not in seen[0].columns


def test_unigram_scores_are_the_best():
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(MODEL)
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    for i, p in enumerate(model.pieces):
        if p.type == p.NORMAL:
            p.score = -5 - (i * 7919 % 1000) / 100
    raw = model.SerializeToString()
    own, public = pieces.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    worst = min(own.scores.values()) - 10
    texts = [t for _, t in rows() if t and len(t) < 2000]
    sizes, flat = own.encode(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        value = lambda ids: sum(own.scores.get(public.id_to_piece(i), worst) for i in ids)
        assert value(ids.tolist()) == pytest.approx(value(public.encode(text)), abs=1e-3)


VOCABULARY = order.read_vocabulary()


def test_counts_after_edits(spark):
    rng = random.Random(3)
    letters = "  ab\n\t.,'s1é 日🙂Z"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(300)] + [t for _, t in rows()[:20]] + [None, "", "q"]
    data, want = [], {}
    encode = order.loaded(VOCABULARY).public.encode_ordinary
    for i, text in enumerate(texts):
        now, edits = text or "", []
        for _ in range(rng.randrange(0, 6)):
            a = rng.randrange(0, len(now) + 1)
            b = min(len(now), a + rng.randrange(0, 6))
            new = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 5)))
            edits.append((a, b, new))
            now = now[:a] + new + now[b:]
        data.append((i, text, edits or None, 5))
        want[i] = (len(encode(text or "")), len(encode(now)), now)
    frame = spark.createDataFrame(data, f"{SCHEMA}, edits {counts.EDITS}, n_tokens int")
    for r in counts.count_edited(frame, VOCABULARY).collect():
        assert (r.n_tokens_before, r.n_tokens, r.n_chars) == (*want[r.doc_id][:2], len(want[r.doc_id][2]))
    kept = counts.update(counts.build(frame, VOCABULARY), VOCABULARY)
    again = counts.update(kept.withColumn("edits", F.lit(None).cast(counts.EDITS)), VOCABULARY)
    for r in again.collect():
        assert (r.n_tokens, r.text) == want[r.doc_id][1:]
    assert counts.count_edited(frame.limit(0), VOCABULARY).count() == 0


def test_edits_encode_little():
    tree = counts.Tree(" ".join(f"word{i}" for i in range(5000)), counts.Counter(order.loaded(VOCABULARY)))
    tree.edit(20_000, 20_004, "new")
    assert tree.encoded < 12
    tree.edit(-5, 10**9, "")
    assert tree.n_tokens == 0 and tree.text() == ""
    tree.edit(0, 0, "again and")
    assert tree.text() == "again and" and tree.n_tokens == 2
