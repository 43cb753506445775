"""Benchmark passages: every term of every document against a plain search for each window."""

import hashlib
import random
import re

from sparkselect.llm import benchmark_overlap

ITEM = "item_id long, text string, doc_id long, `window` string, item string, doc long"
KEEP = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def terms_of(text):
    return KEEP.findall((text or "").translate(LOW))


def plain(docs, items, window=10):
    pattern = {}
    for item, text in items:
        own = terms_of(text)
        for i in range(max(1, len(own) - window + 1)) if own else ():
            pattern.setdefault(tuple(own[i:i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        own = terms_of(text)
        hit, found = set(), set()
        for n in {len(p) for p in pattern}:
            for i in range(len(own) - n + 1):
                names = pattern.get(tuple(own[i:i + n]))
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 7, "w", "i", 7) for i, t in rows], ITEM)


def test_overlaps_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    texts = [r[1] for r in odd_rows if r[1]]
    rows = [(1, texts[8][:300].upper()), (2, "one"), (10, "a B,c"), (3, None), (4, "?!"), (None, "Café x"), (1, texts[9][40:260]), (1, texts[9][40:260]),
            (5, " ".join(texts[6].split()[3000:3400])), (6, " ".join(texts[6].split()[3100:3150])), (7, "ß 12")]
    items = items_of(spark, rows)
    got = sorted(map(tuple, benchmark_overlap.op11_frame(odd_docs, items).collect()), key=str)
    assert got == plain([(r[0], r[1]) for r in odd_rows], rows)
    assert sum(r[5] for r in got) > 5
    blocks = benchmark_overlap.overlaps(odd_docs, items, block_rows=40).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, benchmark_overlap.overlaps(odd_docs, items).collect()))
    assert benchmark_overlap.op11_frame(no_docs, items).collect() == []
    none = items_of(spark, [])
    assert {r.n_hit for r in benchmark_overlap.op11_frame(odd_docs, none).collect()} == {0}


def test_overlapping_patterns_and_borders(spark, make_docs):
    rnd = random.Random(11)
    vocab = ["x", "Y", "z", "é"]
    line = lambda n: rnd.choice([" ", "\n", ", "]).join(rnd.choice(vocab) for _ in range(n))
    texts = [line(rnd.randint(0, 80)) for _ in range(150)]
    rows = [(i, line(rnd.randint(5, 25))) for i in range(30)]
    got = sorted(map(tuple, benchmark_overlap.op11_frame(make_docs(texts), items_of(spark, rows)).collect()), key=str)
    assert got == plain([(i + 1, t) for i, t in enumerate(texts)], rows)
    # a pattern that starts in one document and ends in the next is none
    halves = make_docs(["a b c d e f", "g h i j k l"])
    assert {r.n_hit for r in benchmark_overlap.overlaps(halves, items_of(spark, [(1, "a b c d e f g h i j k l")])).collect()} == {0}


def test_spans_are_places_in_the_original(spark, make_docs):
    text = "Ünï — ignore. The quick; BROWN fox (jumps) over a LAZY dog, said Ädam & left. The end"
    found = benchmark_overlap.overlaps(make_docs([text]), items_of(spark, [(1, "the QUICK brown fox jumps over a lazy dog said Ädam"), (2, "the end")])).first()
    assert found.items == ["1", "2"]
    assert [text[s.start:s.end] for s in found.spans] == ["The quick; BROWN fox (jumps) over a LAZY dog, said Ädam", "The end"]
    kept = benchmark_overlap.decontaminated(make_docs([text, "clean text", None, text]), items_of(spark, [(2, "the end")]))
    assert sorted(str(r.text) for r in kept.collect()) == ["None", "clean text"]
    two = spark.createDataFrame([(1, "which one is it", "it is the second of them")], "item_id long, text string, answer string")
    assert benchmark_overlap.overlaps(make_docs(["x it is the second of them"]), two, columns=("text", "answer")).first().n_hit == 6
