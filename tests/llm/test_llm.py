"""Operators for training text against brute-force versions and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import attention_lm, line_dedup, lm_scoring, mixing, packing, quality_rules, simhash, warc, wrappers
from quillgraph.llm.document_stats import text_counts
from quillgraph.llm.lm_scoring import score_texts
from quillgraph.llm.neighbours import embedding_groups
from quillgraph.llm.quality_classifier import classify_quality
from quillgraph.llm.storage import read_table, stored

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 997}" for k in range(30_000))
ROWS = [
    (1, "One two three four five six.\nA b c.\nD e f.\nTail of one.", "en"),
    (1, "One two three four five six.\nA b c.\nD e f.\nTail of one.", "en"),
    (2, None, None),
    (3, "", "en"),
    (None, "No id here\nA b c.\nD e f.\nTail of one.", "en"),
    (4, "x\nOne two three four five six.\nA b c.\nD e f.\ny", "de"),
    (5, LONG, "en"),
    (6, "ÄÖ ß é <|endoftext|> \t\x0b 漢字 \r\n end", "de"),
]
SCHEMA = "doc_id long, text string, lang string, p string, rate string, covered string, fp string, n_lines string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, 1), (5, 1, 1), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")


def reference_ids(text):
    return [*packing.tokenizer("byte_bpe_50k").exact(text or "").tolist(), 1]


def test_packing_covers_every_id_once(awkward):
    pieces = packing.pack_documents(awkward).collect()
    assert sum(p["length"] for p in pieces) == sum(len(reference_ids(t)) for _, t, _ in ROWS)
    fill = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert fill.get(p["sequence_id"], 0) == p["offset"]
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(fill.values()) <= 2048
    long = sorted((p for p in pieces if p["doc_id"] == 5), key=lambda p: p["start"])
    joined = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in long]).tolist()
    assert joined == reference_ids(LONG) and all(p["doc_tokens"] == len(joined) for p in long)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_fast_ids_equal_plain_ids(text):
    encode = packing.tokenizer("byte_bpe_50k")
    assert encode.ids(text).tolist() == encode.exact(text).tolist()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(4, 40))
def test_sum_of_squares_places_all(sizes, limit):
    packer, full = packing.SumOfSquares(64, limit), []
    for k, size in enumerate(sizes):
        full += packer.place((k, 0, np.zeros(size), size))
        assert int(packer.level.sum()) <= limit + 1
    full += packer.settle(last=True)
    got = Counter()
    for window in full:
        assert window.fill == sum(len(p[2]) for p in window.pieces) <= 64
        for doc, _, ids, _ in window.pieces:
            got[doc] += len(ids)
    assert got == Counter({k: s for k, s in enumerate(sizes)})
    assert sum(w.fill < 64 for w in full) <= 1


def test_sum_of_squares_prefers_the_rarer_level():
    packer = packing.SumOfSquares(10, 100)
    for size in (4, 4, 4):
        packer.place((0, 0, np.zeros(size), size))
    packer.place((1, 0, np.zeros(3), 3))
    assert packer.level[7] == packer.level[8] == 1 and packer.level.sum() == 2


def test_counts_match_brute_force():
    for text in [*(t for _, t, _ in ROWS), "a b c d e a b c d e f", "x\nx\n \nx y\n", "1 2 3 4 5 " * 40 + "z"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        at = {}
        for k in range(len(words) - 4):
            at.setdefault(tuple(words[k : k + 5]), []).append(k)
        covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = text_counts(text)
        assert got[:3] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")))
        assert got[3] == len(lines) - len(set(lines)) and got[4] == len(covered)


def test_quality_rules_and_classifier_on_awkward_rows(awkward, empty, labels):
    rules = quality_rules.apply_quality_rules(awkward, labels)
    rows = rules.collect()
    assert len(rows) == len(ROWS)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (2, 3))
    scores = classify_quality(awkward, labels).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    for r in scores:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)
    assert quality_rules.apply_quality_rules(empty, labels).count() == 0
    assert classify_quality(empty, labels.limit(0)).count() == 0


def test_trees_keep_their_directions():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 2))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.standard_normal(2000) < 0.5).astype(float)
    trees = quality_rules.fit_trees(x, y, [-1, 0], rounds=20)
    line = np.linspace(0, 1, 101)
    for other in (0.1, 0.5, 0.9):
        steps = np.diff(trees.margin(np.column_stack([line, np.full(101, other)])))
        assert (steps <= 1e-12).all()
    assert ((trees.probability(x) >= 0.5) == y).mean() > 0.8


def test_classifier_on_held_out_labels(spark):
    scores = classify_quality(read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels"))
    known = scores.where("held_out").join(read_table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    assert len(known) > 40
    assert sum(r["predicted"] == r["quality"] for r in known) / len(known) > 0.95


def brute_lines(rows):
    place = lambda d: (1 << 63) - 1 if d is None else d
    first, gone = {}, {}
    found = sorted({(place(d), k, tuple(t.split("\n")[k : k + 3])) for d, t in rows if t is not None for k in range(t.count("\n") - 1)})
    for d, k, window in found:
        if "".join(window).strip(" \t\n\x0b\f\r") and first.setdefault(window, (d, k)) != (d, k):
            gone.setdefault(d, set()).update(range(k, k + 3))
    return [
        (d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(place(d), ())))
        for d, t in rows
    ]


def test_line_dedup_matches_brute_force(awkward, empty):
    got = line_dedup.dedup_lines(awkward)
    assert set(got.columns) == {*awkward.columns, "n_removed"}
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(brute_lines([(d, t) for d, t, _ in ROWS]), key=key)
    assert line_dedup.dedup_lines(empty).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_match_brute_force(spark, awkward, empty):
    rows = [(d, t) for d, t, _ in ROWS] + [(r["doc_id"] + 100, r["text"]) for r in read_table(spark, SMALL, "documents").collect()]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    want = sorted(((str(d), f"{prints[k]:016x}", least.get(root(k))) for k, (d, _) in enumerate(rows)), key=str)
    assert sorted(((str(r[0]), r[1], r[2]) for r in got), key=str) == want
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_hamming_links_are_exact(spark, segments):
    rng = np.random.default_rng(segments)
    base = rng.integers(-(1 << 62), 1 << 62, 12)
    values = {int(b) ^ simhash._signed(sum(1 << int(p) for p in rng.choice(64, k, replace=False))) for b in base for k in range(7)}
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    assert {tuple(r) for r in simhash.hamming_links(frame, 4, segments).collect()} == want


def test_mixing_meets_targets(spark, awkward, empty, labels):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    known = read_table(spark, "/root/testdata/sf0.01", "labels")
    from quillgraph.llm.queries import label_domains

    TARGETS = {"clean": 0.78, "poor": 0.11, "toxic": 0.11}  # within reach of these posteriors
    rows = mixing.mix_domains(docs, label_domains(known), TARGETS).toPandas()
    weight = rows["n_tokens"] * rows["rate"]
    p = np.array(rows["p"].tolist())
    assert np.allclose(p.sum(axis=1), 1) and (rows["rate"] >= 0).all()
    for k, d in enumerate(sorted(TARGETS)):
        assert abs((weight * p[:, k]).sum() / rows["n_tokens"].sum() - TARGETS[d]) < 1e-3
    assert ((rows["copies"] - rows["rate"]).abs() < 1).all()
    odd = mixing.mix_domains(awkward, label_domains(labels), TARGETS).collect()
    assert len(odd) == len(ROWS)
    fitted = mixing.fit_mixture(awkward, label_domains(labels), {"clean": 0.9, "toxic": 0.1}, repeat=False)
    assert fitted.repeated(awkward).columns == awkward.columns
    assert mixing.mix_domains(empty, label_domains(labels.limit(0)), TARGETS).count() == 0


PAGES = [
    (1, "http://a.org/1", "<p>" + "x" * 1200),
    (2, "http://a.org/2", "<p>" + "x" * 1200),
    (2, "http://a.org/2", "<p>" + "x" * 1200),
    (3, None, None),
    (4, "http://a.org/ü b\r\n", "<p>small"),
    (5, "http://b.org", "<p>small"),
    (None, "http://c.org", "<p>" + "x" * 1200),
    (6, "http://b.org", "<p>\r\n\r\nWARC/1.1 ü" + "y" * 5000),
]


def test_archives_round_trip(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    index = warc.write_archives(frame, frame_bytes=2000)
    got = warc.read_archives(index).collect()
    assert len(got) == len(PAGES)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        refers = 2 if len(data) >= 1000 and html[3] == "x" and page != 2 else None
        want.append((str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    mine = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert warc.read_one(index, warc.record_id(6)) == [PAGES[-1][2].encode()]
    assert {bytes(r["payload"]) for r in got if r["page_id"] == 6} == {PAGES[-1][2].encode()}
    assert warc.read_archives(warc.write_archives(frame.limit(0))).count() == 0


def test_mixing_without_repeats_writes_no_document_twice(spark):
    rows = [(k, 100, [0.97, 0.03] if k % 25 else [0.3, 0.7]) for k in range(500)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>").coalesce(1)
    steps, totals, targets = mixing.fit_rates(members, [0.95, 0.05], repeat=False, rounds=3)
    fitted = mixing.Mixture(None, steps, totals, targets, members, repeat=False)
    got = fitted.rated(members).collect()
    assert max(r["rate"] for r in got) <= 1 and max(r["copies"] for r in got) == 1
    free = mixing.Mixture(None, steps, totals, targets, members, repeat=True)
    assert max(r["rate"] for r in free.rated(members).collect()) > 1


def test_embedding_groups_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    near = np.vstack([b + 0.03 * rng.standard_normal((k % 5 * 8, 16)) for k, b in enumerate(base)])
    vectors = np.vstack([base, near, base[:3]]).astype(np.float32)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [None] * 16), (n + 3, [float("nan")] * 16), (n + 4, [1.0]), (n + 5, [])]
    got = {r["vec_id"]: r for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    reach = link.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    for k in range(n):
        assert got[k]["n_links"] == link[k].sum() - 1 and got[k]["component_id"] == int(np.flatnonzero(reach[k])[0])
    for k in range(n, n + 6):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_groups_join_tight_parts_of_a_group(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    parts = [axes[0], 0.97 * axes[0] + 0.243 * axes[1], axes[2]]
    vectors = np.vstack([unit(c + 0.1 * unit(rng.standard_normal((40, 64)))) for c in parts] + [unit(rng.standard_normal((80, 64)))])
    vectors = vectors.astype(np.float32)
    unit_rows = unit(vectors.astype(float))
    near = (unit_rows @ unit_rows.T >= 0.95) & ~np.eye(len(vectors), dtype=bool)
    assert near[:40, 40:80].mean() > 0.5 and not near[:80, 80:].any()
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_groups(frame).collect()}
    assert [got[k]["n_links"] for k in range(200)] == near.sum(axis=1).tolist()
    assert [got[k]["component_id"] for k in range(120)] == [0] * 80 + [80] * 40


def test_attention_gradient_and_windows():
    rng = np.random.default_rng(0)
    model = attention_lm.Attention(70, 4)
    sizes = np.array([20, 0, 33, 7])
    classes = rng.integers(0, 70, 60)
    keys, targets, mask = model.blocks(classes, sizes)
    assert targets[mask].tolist() == classes.tolist() and mask.sum() == 60
    assert keys[0, 8] == 70 and (keys[0, :8] == 71).all()
    model.params = model.params.astype(float)
    model.p = model._views(model.params)
    _, grad = model.gradient(keys, targets, mask)
    for k in rng.choice(len(grad), 40, replace=False):
        values = []
        for step in (1e-5, -2e-5):
            model.params[k] += step
            values.append(-model.log_probability(keys, targets)[mask].mean())
        model.params[k] += 1e-5
        assert abs((values[0] - values[1]) / 2e-5 - grad[k]) < 1e-4
    whole = np.exp([model.log_probability(keys[:1], np.full((1, 8), c))[0] for c in range(70)])
    assert np.allclose(whole.sum(axis=0), 1)


def test_words_split_alike_alone_and_together():
    tokens = packing.tokenizer("byte_bpe_50k")
    words = "plain don't 's café \xa0a b\xa0 \u3000 a<|endoftext|>b x1,y2 \x85 日本語".split(" ")
    words = [w.encode() for w in words] + [b"\xff\xfe", b"z" * 3000] + [b"w%d" % k for k in range(5000)]
    heads, inner, sizes = attention_lm.split_words(tokens, words)
    want = [tokens.ids(" " + w.decode("utf-8", "replace")).tolist() for w in words]
    assert heads.tolist() == [ids[0] for ids in want] and sizes.tolist() == [len(ids) for ids in want]
    assert inner.tolist() == [i for ids in want for i in [*ids[1:], attention_lm.END]]
    assert [len(part) for part in attention_lm.split_words(tokens, [])] == [0, 0, 0]


def test_word_memory_keeps_probabilities_whole():
    tokens = packing.tokenizer("byte_bpe_50k")
    words = [b"unbelievable", b"unbearable", b"unbroken"]
    heads = attention_lm.split_words(tokens, words)[0]
    firsts = np.zeros(attention_lm.VOCABULARY)
    np.add.at(firsts, heads, [7, 5, 4])
    memory = lm_scoring.WordMemory(dict(zip(words[:2], (7, 5), strict=True)), firsts, "byte_bpe_50k")
    inside = np.log([0.2, 0.3, 0.4])
    got = np.exp(memory.sharpened(words, heads, inside))
    for head in set(heads.tolist()):
        same = heads == head
        mass, left = got[same].sum(), 1 - np.exp(inside[same]).sum()
        listed = [c for c, h in zip((7, 5), heads[:2], strict=True) if h == head]
        rest = len(listed) + firsts[head] - sum(listed)
        assert abs(mass + rest * left / (firsts[head] + len(listed)) - 1) < 1e-9


def test_every_training_word_shapes_the_model(spark):
    for doc, n in ((None, 3), (23, 5), (-1, 200), (24, 32), (7, 0)):
        text = " ".join(f"w{k}" for k in range(n))
        spans = [s for turn in range(2) for s in lm_scoring.spans_of(doc, text, turn, 2)]
        assert sorted(w for s in spans for w in s) == sorted([*lm_scoring.words_of(text), b""])
    rows = spark.createDataFrame([(23, False, "a few words")], "doc_id long, held_out boolean, text string")
    classes = tuple(attention_lm.make_classes(np.zeros(attention_lm.VOCABULARY)) for _ in range(2))
    start = lm_scoring.Scorer(classes, 16, None, "byte_bpe_50k").params
    half = len(start) // 2
    counts = spark.createDataFrame([(w, n) for w, n in ((b"a", 1), (b"few", 1), (b"words", 1), (b"", 1), (b"unseen", 0))], "word binary, c long")
    learnt = lm_scoring.train(rows, counts, classes, "byte_bpe_50k", 2, 0.02, 16)
    assert (learnt[:half] != start[:half]).any() and (learnt[half:] != start[half:]).any()


def test_words_and_spans_of_many_texts_are_those_of_each():
    texts = ["  Ab\tc\x0b\x0cD ÄÖ ", "", None, " ", "x\xa0y Z\u2003z é\x1cQ\x85w", " ".join(f"W{k % 50}" for k in range(200)), "a " * 32]
    docs = [5, -3, None, 8, 23, 24, 1]
    kinds, codes, sizes = lm_scoring.coded_words(pa.array(texts))
    kinds = kinds.to_pylist()
    assert len(kinds) == len(set(kinds))
    flat = [kinds[c] for c in codes]
    assert flat == [w for t in texts for w in [*lm_scoring.words_of(t), b""]]
    assert sizes.tolist() == [len(lm_scoring.words_of(t)) + 1 for t in texts]
    want = [s for d, t in zip(docs, texts, strict=True) for turn in range(3) for s in lm_scoring.spans_of(d, t, turn, 3)]
    assert lm_scoring.span_sizes(sizes).tolist() == [len(s) for s in want]
    assert flat == [w for s in want for w in s]
    assert not len(lm_scoring.span_sizes(np.zeros(0, np.int64)))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for size in (1, 20, 1 << 20):
        parts = list(lm_scoring.portions(batch, 0, size))
        assert pa.Table.from_batches(parts).column(0).to_pylist() == texts
    assert not list(lm_scoring.portions(batch.slice(0, 0), 0, 5))


def test_steps_write_to_the_same_memory_again():
    import tracemalloc

    model = attention_lm.Attention(1024, 16)
    classes = np.random.default_rng(1).integers(0, 1024, 32 * 256)
    blocks = model.blocks(classes, np.full(256, 32))
    first = model.gradient(*blocks)[1]
    tracemalloc.start()
    again = model.gradient(*blocks)[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (first == again).all()
    assert peak < 3.5e6


def test_only_real_positions_are_scored_and_summed(monkeypatch):
    rng = np.random.default_rng(2)
    model = attention_lm.Attention(1024, 16)
    sizes = np.array([5, 0, 9, 1, 16])
    keys, targets, mask = model.blocks(rng.integers(0, 1024, sizes.sum()), sizes)
    whole = model.log_probability(keys, targets)
    ordered, seen = model._ordered, []
    monkeypatch.setattr(model, "_ordered", lambda h, order: seen.append(len(order)) or ordered(h, order))
    assert np.allclose(model.scored(keys, targets, mask), whole[mask], atol=1e-5)
    model.gradient(keys, targets, mask)
    assert seen == [mask.sum()] * 2
    at, values = rng.integers(0, 1026, 5000), rng.standard_normal((5000, 6))
    at[:2000] %= 40
    want = np.zeros((1026, 6))
    np.add.at(want, at, values)
    want[1025] = 0
    assert np.allclose(model._by_class(at, values), want)


def test_first_ids_of_listed_words_are_not_encoded_again(spark, monkeypatch):
    classes = tuple(attention_lm.make_classes(np.zeros(attention_lm.VOCABULARY)) for _ in range(2))
    scorer = lm_scoring.Scorer(classes, 16, None, "byte_bpe_50k")
    words = [b"unbelievable", b"few", b"\xff\xfe"]
    memory = lm_scoring.WordMemory({}, np.ones(attention_lm.VOCABULARY), "byte_bpe_50k", np.ones(attention_lm.VOCABULARY))
    counts = spark.createDataFrame([(w, 1) for w in [*words, b""]], "word binary, c long")
    rows = lm_scoring.value_words(counts, memory, classes, scorer.params, "byte_bpe_50k", 16).collect()
    heads = {bytes(r["word"]): r["head"] for r in rows}
    assert [heads[w] for w in words] == scorer.heads(words).tolist()
    docs = spark.createDataFrame([(1, False, "few other unbelievable words"), (2, True, None)], "doc_id long, held_out boolean, text string")

    def scores(listed):
        known = {w: (1, 0.0, h) for w, h in listed}
        return [r["score"] for r in lm_scoring.score_rows(docs, known, classes, scorer.params, "byte_bpe_50k", 16).orderBy("doc_id").collect()]

    assert np.allclose(scores(heads.items()), scores([]))
    other = int(next(h for h in range(50) if classes[0].of[h] != classes[0].of[heads[b"few"]]))
    assert scores([(b"few", other)])[0] != scores([])[0]


def test_scores_match_brute_force_base(spark, awkward, empty):
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    rows = [(r[0], r[1]) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))
        want.append((str(d), held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(base, 6)))
    got = score_texts(docs, frequent=500).collect()
    mine = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(mine) == sorted(want)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert score_texts(empty).count() == 0


def test_scores_match_a_text_by_text_computation(spark, awkward):
    """The model's parameters are taken as they are; counts, insides, joins and batches are redone plainly."""
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text")).coalesce(1)
    seen = {}

    def kept(*args, **more):
        seen["params"], seen["classes"] = plain(*args, **more), args[2]
        return seen["params"]

    plain, lm_scoring.train = lm_scoring.train, kept
    try:
        got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in score_texts(docs, frequent=50).collect()}
    finally:
        lm_scoring.train = plain
    rows = [(r[0], lm_scoring.words_of(r[1])) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, words in rows if not held(d) for w in words)
    scorer = lm_scoring.Scorer(seen["classes"], 16, seen["params"], "byte_bpe_50k")
    vocabulary = sorted({w for _, words in rows for w in words})
    heads, inside = scorer.insides(vocabulary)
    firsts, kinds = np.zeros(attention_lm.VOCABULARY), np.zeros(attention_lm.VOCABULARY)
    for w, head in zip(vocabulary, heads, strict=True):
        firsts[head] += counts[w]
        kinds[head] += counts[w] > 0
    value = {
        w: math.log((counts[w] + kinds[h] * math.exp(p)) / (firsts[h] + kinds[h])) if kinds[h] else p
        for w, h, p in zip(vocabulary, heads.tolist(), inside.tolist(), strict=True)
    }
    for d, words in rows:
        want = scorer.texts([*words, b""], [len(words) + 1])[0] + sum(value[w] for w in words)
        assert abs(got[d, len(words) + 1] - want / math.log(10)) < 1e-3 * (1 + abs(want) / 1000), (d, len(words))


def test_scores_do_not_depend_on_the_length_of_the_word_list(spark, awkward):
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    short, long = (
        sorted((str(r["doc_id"]), round(r["score"], 3)) for r in score_texts(docs.coalesce(1), frequent=n).collect())
        for n in (5, 1 << 17)
    )
    assert [r[0] for r in short] == [r[0] for r in long]
    assert np.allclose([r[1] for r in short], [r[1] for r in long], rtol=1e-5)


def test_main_text_of_pages(spark):
    chrome = "<nav><ul><li>m<li>n</ul></nav><div class='ad'>buy</div><div id=cookie-notice>ok?</div>"
    foot = "<section class=comments><p>me too</section><aside>side</aside><form>f</form><footer>&copy; x</footer>"
    rows = [
        (1, "http://h.org/1", f"<html><body>{chrome}<article><h1>T &amp; t</h1><p>One <b>two</b><br>three<p>four</article>{foot}"),
        (2, "http://h.org/2", f"<html><body>{chrome}<article><h1>U</h1><p>a  b</p><ul><li>i<li>j</ul></article>{foot}</body></html>"),
        (3, None, None),
        (4, "http://[bad", "plain &lt;text&gt; < 3<script>var t='</p>'</script>"),
        (5, "http://h.org/5", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (6, "http://h.org/6", "".join(f"<p>{k}" for k in range(3000))),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows + rows[:1]], "page_id long, url string, html string, key string, flags string")
    got = {r["page_id"]: r for r in wrappers.extract_main_text(frame).collect()}
    assert got[1]["text"] == "T & t\nOne two three\nfour" and got[2]["text"] == "U\na b\ni\nj"
    assert (got[3]["text"], got[3]["n_chars"]) == ("", 0)
    assert got[4]["text"] == "plain <text> < 3" and got[5]["text"] == "deep"
    assert got[6]["text"] == "\n".join(map(str, range(3000)))
    assert wrappers.extract_main_text(frame).count() == 7
    assert wrappers.extract_main_text(frame.limit(0)).count() == 0


def test_names_and_raw_tags_do_not_swallow_text():
    def text(markup):
        items, slots, blocks = wrappers.PageReader().read(markup).result()
        good = wrappers.verdicts(items)
        return [t for s, t in zip(slots, blocks, strict=True) if good[s]]

    assert text("<div class='layout has-sidebar'><article><p>Body text</article></div>") == ["Body text"]
    assert text("<article class='post comments-open'><p>kept</article>") == ["kept"]
    assert text("<article><section class='related-work'><p>a</section><p class='search-results'>b</article>") == ["a", "b"]
    for tag in ("<svg viewBox='0'/>", "<object data=x />", "<iframe src='y'/>", "<script src='z'/>", "<title>", "<svg>", "<select>"):
        assert text(f"<p>a{tag}<p>b") == ["a", "b"], tag
    assert text("<p>a<svg><text>no</text></svg><script>x='<p>'</script>b<title>t</title><style>p{}</style><p>c") == ["a", "b", "c"]
    assert text("<div class='ad-slot'>buy</div><div id='site-footer'>f</div><div class='x sidebar'>s</div><p>t") == ["t"]


def test_wrapper_has_optional_and_repeated_groups():
    shapes = [wrappers.PageReader().read(h).result()[0] for h in ("<div><p>a<p>b</div>", "<div><h2>t</h2><p>a</div>")]
    wrapper = wrappers.merge(wrappers.merge([], shapes[0]), shapes[1])
    assert (("+", ("<p", "#", "</p")), False) in wrapper and ("<h2", True) in wrapper


def test_pipeline_stages_keep_columns(spark, awkward):
    pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import functions as F

    docs = read_table(spark, SMALL, "documents").withColumn("p", F.col("source"))
    start = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), "stage")
        assert docs.columns == start, name
    assert pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0
