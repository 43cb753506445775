"""Token encoder, packing, plane files and mixing."""

import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkselect.llm import packing, plane_files, source_mixing
from sparkselect.llm.common import shared_folder
from sparkselect.llm.tokens import Encoder, vocabulary

ODD = ["", "  a  b\n\n c <|endoftext|> d  e \t\tf  don't, o'clock!. x.y a1b2 'tis  \n ", "\n\nI'm the 12345 x'll\r\n  café é ß ΣΑΣ. İstanbul, Ünï!",
       "nbsp here 　 wide", "word's, a,b,. Ⅷ ª Ⓐ ǅ ﬁ, 한국 日本. !. ,,", "   ", "\n\n\n", "A" * 300, "zero​width ﻿",
       "<|endoftext|>", "x<|endoftext|>y <|startoftext|> z", "a <|EndOfText|> <|endoftext|", " <|endoftext|> \n<|endoftext|>  é "]


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "lower"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_units_equal_whole_texts(name, lower):
    rnd = random.Random(1)
    texts = [None, *ODD, *["".join(rnd.choice("ab é.,!\n1'中") for _ in range(60)) for _ in range(300)]]
    texts += ["".join(rnd.choice(["Ab", "cd.", "é", "x1", " ", " ", "\n", "!"]) for _ in range(30)).strip() for _ in range(300)]
    ids, at = Encoder(vocabulary(name), lower).encode(pa.array(texts, pa.string()))
    whole = library(name)
    for i, text in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == whole(text), repr(text)
    assert Encoder(vocabulary(name), lower).encode(pa.array([], pa.string()))[1].tolist() == [0]


def one_by_one(lengths, caps):
    """Best fit of single pieces, longest first, by the residual norm."""
    whole, w = caps.total(), np.array(caps.weights) / caps.total().astype(float) ** 2
    bins = []
    for n in sorted(lengths, reverse=True):
        need = caps.demand(n)
        fit = [b for b in range(len(bins)) if (bins[b] >= need).all()]
        if fit:
            b = min(fit, key=lambda b: (((bins[b] - need) ** 2 * w).sum(), b))
            bins[b] = bins[b] - need
        else:
            bins.append(whole - need)
    return len(bins)


@pytest.mark.parametrize("caps", [packing.Capacities(), packing.Capacities(100, 4, 2500), packing.Capacities(64, 64, 64 * 64)])
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(caps, rule):
    rnd = random.Random(caps.tokens)
    top = min(caps.tokens, math.isqrt(caps.attention))
    lengths = [min(top, int(rnd.expovariate(3 / top)) + 1) for _ in range(800)]
    rows, bins = packing.plan(list(Counter(lengths).items()), caps, rule)
    got, filled = Counter(), defaultdict(list)
    for length, lo, hi, first, each, offset in rows.tolist():
        got[length] += hi - lo
        for r in range(hi - lo):
            filled[first + r // each].append((offset + r % each * length, length))
    assert got == Counter(lengths) and set(filled) == set(range(bins))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert (sum(caps.demand(n) for _, n in own) <= caps.total()).all()
    if rule == "norm":
        assert bins == one_by_one(lengths, caps)


def test_plan_size_does_not_follow_the_counts():
    rnd = random.Random(4)
    base = [(n, rnd.randint(1, 9)) for n in range(1, 400)]
    few, _ = packing.plan(base)
    many, _ = packing.plan([(n, c * 10**7) for n, c in base])
    assert len(many) < 4 * len(few) + 1000


def test_packing_frame(odd_docs, odd_rows, no_docs):
    got = packing.op3_frame(odd_docs).collect()
    assert packing.op3_frame(no_docs).collect() == []
    whole, want = library(packing.VOCABULARY), []
    for r in odd_rows:
        ids = np.array([*whole(r[1]), 1], "<u4")
        want += [(r[0], i, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) == -(-sum(w[3] for w in want) // 4096)


def test_plan_joined_as_a_table(odd_docs, monkeypatch):
    items = packing.pieces(odd_docs)
    a = sorted(map(str, packing.pack(items).collect()))
    monkeypatch.setattr(packing, "PLAN_ROWS", 0)
    assert sorted(map(str, packing.pack(items).collect())) == a


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_plane_round_trip(kind):
    rnd = np.random.default_rng(3)
    for n in (0, 1, 7, 1000):
        for top in (1, 2, 50257, 2**32):
            ids = rnd.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            assert (plane_files.from_planes(plane_files.to_planes(ids, kind), n, kind) == ids).all()
    docs = [(None, 3), (1, 0), (2, plane_files.BLOCK * 2 + 5), (5, 1), (5, 70_000)]
    docs = [(k, rnd.integers(0, 50257, n).astype(np.uint32)) for k, n in docs]
    out = io.BytesIO()
    out.close = lambda: None
    w = plane_files.FileWriter(out, kind)
    for k, ids in docs:
        w.add(k, ids)
    w.close()

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    back = list(plane_files.FileReader(File(out.getvalue())).documents())
    assert [(k, ids.tolist()) for k, _, ids in back] == [(k, ids.tolist()) for k, ids in docs]
    assert [s for _, s, _ in back] == np.cumsum([0, *[len(x) for _, x in docs]])[:-1].tolist()
    whole = np.concatenate([x for _, x in docs])
    reader = plane_files.FileReader(File(out.getvalue()))
    assert (reader.block(1) == whole[plane_files.BLOCK:2 * plane_files.BLOCK]).all()
    bad = bytearray(out.getvalue())
    bad[40] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        plane_files.FileReader(File(bytes(bad))).block(0)
    with pytest.raises(ValueError, match="cut short"):
        plane_files.FileReader(File(out.getvalue()[:-3]))


def test_plane_files(odd_docs, odd_rows, no_docs, spark):
    got = plane_files.op4_frame(odd_docs).orderBy("start").collect()
    assert plane_files.op4_frame(no_docs).collect() == []
    whole = library(plane_files.VOCABULARY)
    want = Counter()
    for r in odd_rows:
        ids = np.array([*whole(r[1]), 2], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    folder = shared_folder(spark, "test-files")
    plane_files.write_token_files(odd_docs, folder, kind="bit")
    back = plane_files.read_token_files(spark, folder).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in back) == Counter((r[0], (*whole(r[1]), 2)) for r in odd_rows)


def targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {k: i % 3 + 1 for i, k in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = {k: left * w[k] / sum(w[x] for x in free) for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k]]
        if not over:
            return out | share
        for k in over:
            out[k] = 3 * sizes[k]
            left -= out[k]
            free.discard(k)
    return out


def test_mixing(odd_docs, odd_rows, no_docs, make_docs):
    assert source_mixing.op9_frame(no_docs).collect() == []
    rnd = random.Random(8)
    texts = ["w " * rnd.randint(0, 300) for _ in range(300)]
    for rows, docs in ((odd_rows, odd_docs), (None, make_docs(texts, source=lambda i: "hot" if i % 3 else ["a", None, "\U0001d518", "￮"][i % 4]))):
        rows = rows or docs.collect()
        got = source_mixing.mix(source_mixing.sized(docs)).collect()
        assert sorted(map(str, got)) == sorted(map(str, source_mixing.mix(source_mixing.sized(docs)).collect()))
        assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(((r[0], r[3], len((r[1] or "").split())) if r[1] is None or r[1].isascii() else (r[0], r[3], len(r[1].encode().split())) for r in rows), key=str)
        sizes, taken, longest = Counter(), Counter(), Counter()
        for r in got:
            sizes[r.source] += r.size
            taken[r.source] += r.size * r.copies
            longest[r.source] = max(longest[r.source], r.size)
            assert 0 <= r.copies <= 3
        want = targets(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        for k in sizes:
            assert abs(taken[k] - want[k]) <= max(1, longest[k])
        frame = source_mixing.op9_frame(docs).collect()
        assert sum(r.taken for r in frame) == sum(taken.values())
        rows_out = source_mixing.mixed(docs)
        assert rows_out.columns == docs.columns and rows_out.count() == sum(r.copies for r in got)


def test_fit_counts_reaches_reachable_sums():
    rnd = random.Random(2)
    for _ in range(60):
        counts = [(n, rnd.randint(1, 5)) for n in rnd.sample(range(1, 60), 8)]
        whole = sum(a * b for a, b in counts)
        budget = rnd.randrange(whole)
        take = source_mixing.fit_counts(counts, budget)
        assert all(0 <= take.get(a, 0) <= b for a, b in counts)
        assert budget - 60 <= sum(a * take.get(a, 0) for a, _ in counts) <= budget
    assert sum(a * b for a, b in source_mixing.fit_counts([(1, 50), (7, 10**6), (5000, 3)], 6_999_999).items()) == 6_999_999


def best_sum(counts, budget):
    """Largest sum up to budget, one document at a time."""
    reach = 1
    for length, n in counts:
        for _ in range(n):
            reach |= reach << length
    return (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1


def test_fit_counts_is_the_best_of_all_choices():
    rnd = random.Random(41)
    for round_ in range(300):
        lengths = rnd.sample(range(70, 2000), rnd.randint(2, 12)) if round_ % 3 else [x * 30 for x in rnd.sample(range(2, 60), 4)]
        counts = [(n, rnd.randint(1, 6)) for n in lengths]
        whole = sum(a * b for a, b in counts)
        budget = rnd.randrange(whole)
        take = source_mixing.fit_counts(counts, budget)
        assert all(0 <= take.get(a, 0) <= b for a, b in counts)
        assert sum(a * take.get(a, 0) for a, _ in counts) == best_sum(counts, budget)
    # many documents, and lengths that only reach some sums
    assert sum(a * b for a, b in source_mixing.fit_counts([(1999, 900), (2000, 900)], 1_700_123).items()) == best_sum([(1999, 900), (2000, 900)], 1_700_123)
    assert sum(a * b for a, b in source_mixing.fit_counts([(n, 10**6) for n in range(3, 4000)], 10**12 + 7).items()) == 10**12 + 7


def test_equal_rows_share_their_copies(make_docs, spark):
    docs = make_docs(["w " * 50] * 3 + ["x " * (10 + i) for i in range(30)], source=lambda i: "a" if i < 12 else "b")
    same = docs.where("doc_id = 1")
    docs = docs.where("doc_id > 3").union(same).union(same).union(same)
    got = source_mixing.mix(source_mixing.sized(docs)).where("doc_id = 1").agg({"copies": "sum"}).first()[0]
    assert source_mixing.mixed(docs).where("doc_id = 1").count() == got > 0
