"""Ranked search against the score of every pair, over one shard and many."""

import math
import random
import re
from collections import Counter

from sparkselect.llm import ranked_search
from tests.llm.test_overlap import items_of, terms_of


def plain(docs, items, k=10):
    texts = {}
    for item, text in dict.fromkeys(items):
        texts.setdefault(item, Counter()).update(terms_of(text))
    own = [(doc, Counter(terms_of(text))) for doc, text in docs if terms_of(text)]
    total, words = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, terms in texts.items():
        scored = []
        for doc, c in own:
            m = 25 + (75 * sum(c.values()) * total) // words
            score = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in terms.items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    texts = [r[1] for r in odd_rows if r[1]]
    rows = [(1, texts[8][:300].upper()), (2, "one ONE b"), (2, "b a"), (3, None), (4, "?!"), (None, "Café x w1 w2"), (5, "w7 w7 w8"), (5, "w7 w7 w8"), (6, "nowhere"), (7, texts[6])]
    items = items_of(spark, rows)
    got = sorted(map(tuple, ranked_search.op12_frame(odd_docs, items).collect()), key=str)
    assert got == plain([(r[0], r[1]) for r in odd_rows], rows)
    assert ranked_search.op12_frame(no_docs, items).collect() == []
    assert ranked_search.op12_frame(odd_docs, items_of(spark, [])).collect() == []


def test_many_shards_blocks_and_ties(spark, make_docs):
    rnd = random.Random(12)
    vocab = [f"v{int(rnd.paretovariate(0.7))}" for _ in range(3000)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60))) for _ in range(900)]
    texts += [texts[3]] * 40 + ["v1 " * 400, "v2"] * 3
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 12)))) for i in range(25)] + [(99, texts[3])]
    docs, items = make_docs(texts), items_of(spark, rows)
    expected = plain([(i + 1, t) for i, t in enumerate(texts)], rows)
    index = ranked_search.build_index(docs.repartition(7))
    assert index.count() == 7
    assert sorted(map(tuple, ranked_search.search(index, items, query_rows=30).collect()), key=str) == expected
    assert sorted(map(tuple, ranked_search.op12_frame(docs.coalesce(1), items).collect()), key=str) == expected


def test_blocks_are_rejected_before_they_are_unpacked(spark):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(13)
    texts = [" ".join(["common"] + [f"f{rnd.randint(0, 50)}" for _ in range(rnd.randint(3, 300))]) for _ in range(4000)]
    for i in range(20):
        texts[i * 17] = "rare rare common"
    row = ranked_search._shard(pa.array(texts), pa.array(range(4000)))
    row |= {k: row[k].astype(t).tobytes() for k, t in ranked_search._ARRAYS.items()}
    shard = ranked_search.Shard(row, pa.array(["rare", "common"], pa.large_string()), row["n_docs"], row["n_terms"])
    doc, score = shard.best(shard.list_of, np.array([5000, 3]), 10, 1)
    assert len(doc) >= 10 and set(doc.tolist()) <= {i * 17 for i in range(20)}
    assert shard.unpacked <= 1 + 20 and shard.list_blocks[shard.list_of[1]] == 32
    assert re.fullmatch(r"f\d+", texts[1].split()[-1])
