"""Substring dedup, near duplicates, quality rules and the lattice model against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sparkselect.llm import lattice_lm, near_duplicates, quality_rules, substring_dedup
from sparkselect.llm.graph import components

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text):
    return (text or "").encode().split()


def removed(rows, window=35):
    seen = Counter(tuple(w[i:i + window]) for _, w in rows for i in range(len(w) - window + 1))
    out = []
    for key, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_edges(odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, substring_dedup.op1_frame(odd_docs).collect()), key=str)
    assert got == removed([(r[0], words_of(r[1])) for r in odd_rows])
    assert substring_dedup.op1_frame(no_docs).collect() == []


def test_substring_dedup_hot_passage_and_repetition(make_docs, spark):
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    texts = [" ".join([rnd.choice(vocab) for _ in range(rnd.randint(0, 40))] + passage + [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]) for _ in range(120)]
    texts += ["z " * 90, " ".join(passage[:36]), " ".join(passage[:35]), " ".join(passage[:34])]
    docs = make_docs(texts)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert substring_dedup.hot_buckets(docs.select("text"), 35, parts), "the passage is meant to be hot"
    got = sorted(map(tuple, substring_dedup.op1_frame(docs).collect()), key=str)
    assert got == removed([(i + 1, words_of(t)) for i, t in enumerate(texts)])


def test_substring_dedup_of_many_equal_rows(spark, make_docs, monkeypatch):
    """A few thousand equal rows are a list of a few ranges, and buckets follow the data."""
    monkeypatch.setattr(substring_dedup, "BUCKET_ROWS", 6000)
    text = " ".join(f"e{i}" for i in range(200))
    docs = make_docs(["x y z"]).union(make_docs([text]).crossJoin(spark.range(4000)).drop("id"))
    ranges = substring_dedup.repeated_ranges(docs).distinct()
    assert ranges.count() < 50
    got = substring_dedup.op1_frame(docs).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(3, 0, 1), (200, 200, 4000)]


def test_windows_with_equal_hashes_are_compared_by_words():
    codes = np.arange(200, dtype=np.uint32)
    at = np.array([0, 50, 100])
    same = np.zeros(3, np.uint64)
    assert not substring_dedup._repeated(codes, at, np.ones(3), same, 35).any()
    codes[50:85] = codes[:35]
    assert substring_dedup._repeated(codes, at, np.ones(3), same, 35).tolist() == [True, True, False]


def near_truth(rows):
    sets = []
    for key, text in rows:
        w = words_of(text)
        w = [x.translate(LOW) for x in w]
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    names = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[find(i)] = min(key, names.get(find(i), key))
    return sorted(((k, len(sets[i]), names.get(find(i)), k == names.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def test_near_duplicates_edges(odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, near_duplicates.op8_frame(odd_docs).collect()), key=str)
    assert got == near_truth([(r[0], r[1]) for r in odd_rows])
    assert near_duplicates.op8_frame(no_docs).collect() == []
    stay = near_duplicates.without_copies(odd_docs).collect()
    full = [r for r in stay if words_of(r.text)]
    assert len(full) == len({r[2] if r[2] is not None else str(r) for r in near_truth([(r[0], r[1]) for r in odd_rows]) if r[1]})
    assert sum(not words_of(r.text) for r in stay) == sum(not words_of(r[1]) for r in odd_rows)


def test_bands_and_estimate_follow_the_percentage():
    assert near_duplicates.band_shape(85) == (5, 25) and near_duplicates.least_equal(85) == 92
    assert near_duplicates.band_shape(80) == (4, 32) and 84 <= near_duplicates.least_equal(80) <= 86
    with pytest.raises(ValueError):
        near_duplicates.band_shape(5)


def test_pipeline_stage_drops_copies_from_80_percent(spark, make_docs):
    texts = []
    for i in range(60):
        w = [f"d{i}_{j}" for j in range(114)]  # 110 shingles
        texts += [" ".join(w), " ".join(f"x{j}" if j in (20, 60) else x for j, x in enumerate(w))]  # 100 of 120 are common
    sets = lambda t: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)}
    a, b = sets(texts[0]), sets(texts[1])
    assert 0.81 < len(a & b) / len(a | b) < 0.85
    docs = make_docs(texts)
    stay = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in stay) == list(range(1, 121, 2))
    assert len(near_duplicates.without_copies(docs).collect()) == 120


def test_near_duplicates_group_of_many_blocks(make_docs):
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(700):  # more than two blocks of copies that link through each other
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{i}_{j}" for j in range(80)) for i in range(40)]
    rnd.shuffle(texts)
    got = sorted(map(tuple, near_duplicates.op8_frame(make_docs(texts)).collect()), key=str)
    assert got == near_truth([(i + 1, t) for i, t in enumerate(texts)])


def test_signature_estimate_is_close():
    rnd = np.random.default_rng(2)
    import pyarrow as pa
    a = [f"t{i}" for i in rnd.integers(0, 10**6, 900)]
    b = a[:700] + [f"s{i}" for i in range(200)]
    hashes, starts = near_duplicates.shingle_sets(pa.array([" ".join(a), " ".join(b)]))
    low = near_duplicates._minima(hashes, starts)
    bits = (near_duplicates.mix(low) & np.uint64(3)).reshape(2, 4, 32)
    sig = np.zeros((2, 4), np.uint64)
    for k in range(32):
        sig |= bits[:, :, k] << np.uint64(2 * k)
    x, y = set(hashes[:starts[1]].tolist()), set(hashes[starts[1]:].tolist())
    assert abs(near_duplicates.estimated_similarity(near_duplicates.equal_values(sig[0], sig[1:])[0]) - len(x & y) / len(x | y)) < 0.2


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50)]])
def test_components(spark, edges):
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.comp, set()).add(r.node)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    want = {}
    for x in list(parent):
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def quality_truth(text):
    t = text or ""
    w = [x.decode() for x in words_of(t)]
    n = len(w)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(n - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(odd_docs, odd_rows, no_docs, make_docs):
    got = quality_rules.op5_frame(odd_docs).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((r[0], *quality_truth(r[1])) for r in odd_rows), key=str)
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality_rules.op5_frame(no_docs).collect() == []
    texts = ["ab cd " * 300 + "ef", "a b c a b c a b c d", "x\nx\ny\n\n \nx", "# $ % word *", "a b a b a", "p q r s p q r t"] * 2
    got = quality_rules.op5_frame(make_docs(texts)).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted((i + 1, *quality_truth(t)) for i, t in enumerate(texts))


def test_quality_ledger_ablations(odd_docs):
    ledger = quality_rules.ledger(odd_docs).cache()
    rows = ledger.select("failed_bits").collect()
    for version, policy in quality_rules.POLICIES.items():
        kept = quality_rules.apply_policy(ledger, version).where("kept").count()
        assert kept == sum(r[0] & policy == 0 for r in rows)
        for r in quality_rules.ablations(ledger, version).collect():
            bit = quality_rules.mask_of(r.rule)
            assert (r.n_failed, r.n_only) == (sum(x[0] & bit != 0 for x in rows), sum(x[0] & policy == bit for x in rows))
            assert r.n_kept_without == sum(x[0] & policy & ~bit == 0 for x in rows)


def small_lattice():
    pieces = ["</s>", "▁", "▁a", "a", "b", "ab", "ba", "aba", "<0xC3>", "<0xA9>"]
    p = np.array([0.1, 0.1, 0.15, 0.15, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])
    byte = np.array([x.startswith("<0x") for x in pieces])
    return pieces, p, byte, lattice_lm.Lattice(pieces, np.where(np.arange(10) == 0, 0, p), byte)


def segmentations(word, ids):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in ids:
            for rest in segmentations(word[k:], ids):
                yield [word[:k], *rest]


def test_lattice_sums_all_segmentations():
    pieces, p, byte, lattice = small_lattice()
    ids = {x: i for i, x in enumerate(pieces) if not byte[i] and i}
    words = ["▁abab", "▁", "▁aab", "▁bbbabaab"]
    for w, got in zip(words, lattice.forward(words), strict=True):
        paths = [[ids[x] for x in s] for s in segmentations(w, ids)]
        weight = [math.prod(p[i] for i in s) for s in paths]
        assert got == pytest.approx(math.log(sum(weight)))
        sums = np.zeros(len(pieces))
        lattice.expected([w], np.array([2.0]), sums)
        want = np.zeros(len(pieces))
        for s, x in zip(paths, weight, strict=True):
            for i in s:
                want[i] += 2 * x / sum(weight)
        assert sums == pytest.approx(want)
    assert lattice.forward(["▁é"])[0] == pytest.approx(math.log(p[1] * p[8] * p[9]))


def test_lattice_scores(odd_docs, odd_rows, no_docs):
    got = lattice_lm.op7_frame(odd_docs).collect()
    assert lattice_lm.op7_frame(no_docs).collect() == []
    docs = [(r[0], [w.translate(LOW) for w in words_of(r[1])] + [None]) for r in odd_rows]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs]
    c = Counter(x for (_, w), h in zip(docs, held) if not h for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted(((k, h, len(w), sum(c[x] > 0 for x in w), n) for (k, w), h in zip(docs, held)), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    base = sorted((str(k), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for k, w in docs)
    mine = sorted((str(r.doc_id), r.base_score) for r in got)
    assert [k for k, _ in mine] == [k for k, _ in base] and [x for _, x in mine] == pytest.approx([x for _, x in base])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lattice_chunks_are_rows_of_documents_and_words(spark, make_docs, monkeypatch):
    """F1: a row holds one document or one word, whatever a chunk's size; the chunks' size changes no score."""
    texts = ["a b a", None, "c " * 50, "b c d", "e", "", "a d f g"] * 6
    seen, written = {}, lattice_lm.written
    monkeypatch.setattr(lattice_lm, "written", lambda df, what, *a: seen.setdefault(what, written(df, what, *a)))
    got = {}
    for size in (1 << 20, 40):
        seen.clear()
        monkeypatch.setattr(lattice_lm, "CHUNK_BYTES", size)
        got[size] = sorted(map(tuple, lattice_lm.op7_frame(make_docs(texts).coalesce(1)).collect()))
        rows = seen["lm-chunks"].collect()
        docs = [r for r in rows if r["word"] is None]
        assert len(docs) == len(texts) and len({(r["chunk"], r["word"]) for r in rows if r["word"] is not None}) == len(rows) - len(docs)
        assert (len({r["chunk"] for r in docs}) == 1) if size > 40 else (len({r["chunk"] for r in docs}) > 5)
    assert len(got[40]) == len(texts) and [r[:5] for r in got[40]] == [r[:5] for r in got[1 << 20]]
    assert [r[5:] for r in got[40]] == [pytest.approx(r[5:]) for r in got[1 << 20]]
