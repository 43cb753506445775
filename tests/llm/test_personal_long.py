"""Personal data in very long runs, and the model's precision and recall on cases it has not seen."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from sparkselect.llm import personal_data
from tests.llm.test_search_pages import luhn_ok


def test_linear_forms_equal_the_patterns():
    rnd = random.Random(31)
    for _ in range(20000):
        text = "".join(rnd.choice("a1._%-@@ .0b\n") for _ in range(rnd.randint(0, 40)))
        assert list(personal_data.addresses(text)) == [m.span() for m in personal_data._EMAIL.finditer(text)], repr(text)
        text = "".join(rnd.choice("12.0.3.a") for _ in range(rnd.randint(0, 40)))
        assert [m.span() for m in personal_data._IP_RUN.finditer(text)] == [m.span() for m in personal_data._IP.finditer(text)], repr(text)


def test_taken_equals_a_scan():
    rnd = random.Random(32)
    for _ in range(500):
        spans = [(s, s + rnd.randint(1, 6)) for s in (rnd.randint(0, 40) for _ in range(rnd.randint(0, 6)))]
        taken = personal_data.Taken(spans)
        for _ in range(20):
            a = rnd.randint(0, 40)
            b = a + rnd.randint(1, 10)
            assert taken.meets(a, b) == any(a < e and s < b for s, e in spans)
            left = [i for i in range(a, b) if not any(s <= i < e for s, e in spans)]
            assert [i for s, e in taken.free(a, b) for i in range(s, e)] == left


@pytest.mark.parametrize("text", [
    "a" * 1_000_000 + " x@y.z", "1" * 1_000_000 + " 1.2.3.4", "+1 (555) 123-4567, " * 50_000, "1." * 500_000, "@" * 1_000_000, "a.b@c.de " * 100_000, "0f9a" * 250_000,
    "token=abc123def456ghi789 " * 20_000, "1.2.3." + "0" * 5_000 + " and 1.2.3." + "9" * 5_000])
def test_long_runs_take_seconds(text, model):
    start = time.time()
    base = personal_data.base_spans(text)
    added = personal_data.added_spans([text], [base], model)[0]
    ends = sorted((s, e) for s, _, e in added)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert time.time() - start < 60


def made_texts(seed, n):
    rnd = random.Random(seed)
    words = "the of and lorem ipsum dolor amet magna".split()
    plain = lambda: " ".join(rnd.choice(words) for _ in range(20))

    def card():
        d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return next(d + x for x in "0123456789" if luhn_ok(d + x))

    made = [lambda: f"u{rnd.randrange(999)}@mail{rnd.randrange(9)}.example.com", lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)), card,
            lambda: f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(10**4):04d}", lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)), lambda: f"password={rnd.randrange(16**18):018x}"]
    return [f"{plain()} {made[i % 6]()} {plain()}" for i in range(n)]


@pytest.fixture(scope="module")
def model(make_docs):
    return personal_data.fit(make_docs(made_texts(33, 600)))


def test_crash_of_long_leading_zeros_is_gone(make_docs):
    texts = made_texts(34, 60) + ["1.2.3." + "0" * 5_000 + " x"]
    out = personal_data.op6_frame(make_docs(texts)).orderBy("doc_id").collect()
    assert out[-1].n_ip == 1 and out[-1].spans.startswith("ip:0:5006")


def test_held_out_precision_and_recall_of_each_kind(model):
    batch = pa.RecordBatch.from_pydict({"text": made_texts(35, 300)})
    (cases,) = personal_data._labelled(iter([batch]))
    x, y = np.array(cases.column(0).to_pylist()), cases.column(1).to_numpy()
    p = model.probability(x)
    for i, kind in enumerate(personal_data.ADDED):
        own = x[:, 0] == i
        chosen = own & (p >= model.least[kind])
        assert own.sum() > 50 and (own & (y == 1)).sum() > 20, kind
        assert y[chosen].mean() >= 0.95, kind
        assert y[chosen].sum() >= 0.9 * y[own].sum(), kind
