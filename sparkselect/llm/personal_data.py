"""Personal data: candidate spans judged by boosted trees.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Besides,
generators with high recall propose overlapping spans of more forms (obfuscated addresses,
numbers in national formats, ids with checksums, network addresses, keys and passwords).
Each candidate gets format and context features; gradient-boosted trees, fitted on a bounded
sample of rows with labels from strict format rules and on rewritten copies of them, give a
score; copies of a text or case count once in the sample; isotonic calibration on held-out rows and a threshold per kind select the spans that
are added. Added spans never overlap a base span; among themselves the likelier wins.

Defined results: a null text counts as empty; positions are code points of the whole text,
end exclusive; with candidates of one class only in the sample, nothing is added; repeated
rows are treated each; an empty table gives an empty result; other columns are ignored by
``find_spans`` and carried on by ``redact``.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, written

#: Distinct texts of the training sample (expected number, chosen by hash) and distinct cases at most.
SAMPLE_DOCS, SAMPLE_ROWS = 20_000, 20_000
TREES, DEPTH = 30, 5
#: A candidate is added if its calibrated probability reaches what gives this precision.
PRECISION = 0.95

BASE = ("email", "ip", "card", "phone")
ADDED = ("email", "phone", "card", "ssn", "iban", "ipv6", "secret")
ORDER = {k: i for i, k in enumerate([*BASE, "ssn", "iban", "ipv6", "secret"])}

#: The base patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
# The same matches in time linear in the text: an address is looked for from its @, an ip from the start of a run.
_NOT_LOCAL = re.compile(r"(?s:.*)[^A-Za-z0-9._%+-]")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The spans of the non-overlapping leftmost matches of the address pattern."""
    pos, at = 0, text.find("@")
    while at >= 0:
        before = _NOT_LOCAL.match(text, pos, at)
        start = before.end() if before else pos
        host = _HOST.match(text, at) if start < at else None
        if host:
            yield start, host.end()
        pos = host.end() if host else at + 1
        at = text.find("@", pos)


def _part(digits: str) -> int:
    """Value of one part of an ip, at most 256; leading zeros of any number count nothing."""
    short = digits.lstrip("0")
    return int(short or 0) if len(short) <= 3 else 256


class Taken:
    """Disjoint spans in order; each question costs a search, not a scan."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_right(self.ends, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)

    def free(self, start: int, end: int) -> list[tuple[int, int]]:
        """What these spans leave of start to end."""
        parts, at, i = [], start, bisect.bisect_right(self.ends, start)
        while i < len(self.starts) and self.starts[i] < end:
            if self.starts[i] > at:
                parts.append((at, self.starts[i]))
            at, i = self.ends[i], i + 1
        return [*parts, (at, end)] if at < end else parts


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, in the order of the digest."""
    out = []
    if "@" in text:
        out += [(start, "email", end) for start, end in addresses(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), "ip", m.end()) for m in _IP_RUN.finditer(text) if all(_part(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]]))


# Generators of candidates. Each is anchored on characters that few texts hold.
_SPELLED_AT = re.compile(r"[\w.+-]{1,64}\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?[\w-]+(?:\s?(?:\.|[\[({<]\s?dot\s?[\])}>])\s?[\w-]+)+", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z.])[+(]?[0-9][0-9 ().-]{5,28}[0-9](?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_SIGN = re.compile(r"[=:]\s?[\"']?")
_UNBROKEN = re.compile(r"[^\s\"'<>]+")
_TOKEN = re.compile(r"[A-Za-z0-9_/+=-]+")
_JOINED = re.compile(r"[A-Za-z0-9_/+=.~%-]")
_MARKS = ".,;:!?)]}"
_RUN = re.compile("[0-9]+")
#: Fixed value: words before a value or a number that hint at what it is.
_HINTS = (
    ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access", "key"),
    ("phone", "tel", "call", "mobile", "fax", "cell"),
    ("card", "visa", "credit", "account"),
    ("ssn", "social", "iban", "bank", "passport"),
    ("mail", "contact", "write", "address"),
)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every proposed span; they may overlap."""
    out = set()
    values: list[tuple[int, int]] = []  # the whole unbroken runs after a hint, in order
    for m in _SIGN.finditer(text) if "=" in text or ":" in text else ():
        if m.start() >= (values[-1][1] if values else 0) and any(h in text[max(0, m.start() - 16):m.start()].lower() for h in _HINTS[0]):
            v = _UNBROKEN.match(text, m.end())
            if v and v.end() - v.start() >= 6:
                values.append(v.span())
    out.update((s, e, "secret") for s, e in values)
    if "@" in text:
        out.update((start, end, "email") for start, end in addresses(text))
    low_at = re.search(r"[\[({<]\s?(?:at|@)\s?[\])}>]", text, re.I) if any(c in text for c in "[({<") else None
    if low_at:
        out.update((m.start(), m.end(), "email") for m in _SPELLED_AT.finditer(text))
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(_digits(m.group()))
            if 7 <= n <= 15:
                out.add((m.start(), m.end(), "phone"))
            if 13 <= n <= 19:
                out.add((m.start(), m.end(), "card"))
        out.update((m.start(), m.end(), "ssn") for m in _SSN.finditer(text))
        out.update((m.start(), m.end(), "iban") for m in _IBAN.finditer(text))
        end = run_end = at = 0
        for m in _RUN.finditer(text):  # the token around a digit, and all that is joined to it
            if m.start() < end:
                continue
            s = m.start()
            while s > end and _TOKEN.match(text[s - 1]):
                s -= 1
            t = _TOKEN.match(text, s)
            end = t.end()
            if end - s < 16:
                continue
            spans = [(s, end)]
            if s >= run_end:
                start = s
                while start > run_end and _JOINED.match(text[start - 1]):
                    start -= 1
                run_end = _UNBROKEN.match(text, s).end()
                spans.append((start, max(end, start + len(text[start:run_end].rstrip(_MARKS)))))
            for a, b in spans:  # a hint joined to its value is not part of it
                while at < len(values) and values[at][1] <= a:
                    at += 1
                if not (at < len(values) and a < values[at][0] < b <= values[at][1]):
                    out.add((a, b, "secret"))
    if text.count(":") >= 2:
        out.update((m.start(), m.end(), "ipv6") for m in _IPV6.finditer(text) if m.end() - m.start() >= 6)
    return sorted(out)


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    n = len(s)
    digits = _digits(s)
    upper, lower = sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    share = [s.count(c) / n for c in set(s)]
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", s) if g]
    left = text[max(0, start - 24):start].lower()
    tail = re.split(r"[^0-9A-Za-z]+", s)[-1]
    v6 = False
    if kind == "ipv6":
        try:
            v6 = ipaddress.ip_address(s).version == 6
        except ValueError:
            v6 = False
    return [
        float(ADDED.index(kind)), float(n), float(len(digits)), float(upper), float(lower), float(n - len(digits) - upper - lower),
        float(len(share)), -sum(p * math.log2(p) for p in share), len(digits) / n,
        float(s[0] == "+"), float("(" in s), float("@" in s), float(s.count(".")), float(s.count("-")), float(s.count(" ")),
        float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(bool(digits) and luhn(digits)), float(kind == "iban" and _mod97(s)), float(v6),
        sum(c in "0123456789abcdefABCDEF" for c in s) / n, float(len(tail)), float(tail.isalpha()),
        float(start > 0 and text[start - 1].isalnum()), float(end < len(text) and text[end].isalnum()), float(s[:3] in ("000", "666") or s[:1] == "9"),
        float(bool(re.match("(AKIA|ASIA|ghp_|sk-|xox)", s))), *[float(any(h in left for h in hint)) for hint in _HINTS],
    ]


def strict_label(text: str, start: int, end: int, kind: str) -> int | None:
    """1 or 0 where a format rule is sure, else None (such rows train nothing)."""
    s = text[start:end]
    d = _digits(s)
    if kind == "email":
        tail = re.split(r"[^0-9A-Za-z]+", s)[-1]
        return int(tail.isalpha() and 2 <= len(tail) <= 24)
    if kind == "card":
        return int(luhn(d) and len(set(d)) > 2 and re.fullmatch(r"[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", s) is not None)
    if kind == "phone":
        if _SSN.fullmatch(s):
            return 0
        if re.fullmatch(r"\+[0-9][0-9 ().-]+", s) and 10 <= len(d) <= 15 or re.fullmatch(r"\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s):
            return 1
        return 0 if re.fullmatch(r"[0-9]+|[0-9.]+|[0-9]{4}-[0-9]{2}-[0-9]{2}.*", s) else None
    if kind == "ssn":
        return int("-" in s and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    if kind == "iban":
        return int(_mod97(s))
    if kind == "ipv6":
        try:
            return int(ipaddress.ip_address(s).version == 6 and s.count(":") >= 3)
        except ValueError:
            return 0
    if re.fullmatch(r"(AKIA|ASIA)[A-Z0-9]{16}", s):
        return 1
    hinted = any(h in text[max(0, start - 16):start].lower() for h in _HINTS[0])
    if hinted and len(d) >= 2 and any(c.isalpha() for c in s) and "/" not in s:
        return 1
    joints = s.count("-") + s.count("/")  # in long random text they are rare, between words they are not
    return 0 if not hinted and (joints >= 3 and 20 * joints >= len(s) or d == s) else None


def _iban(digits: str) -> str:
    body = "BANK" + digits[:14].ljust(14, "7")
    rest = int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
    return f"GB{98 - rest:02d}{body}"


def _random_text(s: str, n: int) -> str:
    """n characters of URL-safe base64, fixed by ``s``; the same bytes in plain base64 hold + and /."""
    blocks = (hashlib.sha512(f"{i}:{s}".encode("utf-8", "surrogatepass")).digest() for i in range(n // 80 + 1))
    return base64.urlsafe_b64encode(b"".join(blocks)).decode()[:n]


def _long_forms(s: str, half: list[str]) -> list[tuple[str, str, str, int]]:
    """Long secrets (keys, signed tokens, signed addresses) and long texts that are none."""
    size = 130 + int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=2).digest()) % 1900
    url = _random_text(s, size)
    plain, jwt = url.replace("-", "+").replace("_", "/"), f"eyJ{url[:33]}.eyJ{url[33:-43]}.{url[-43:]}"
    hexed = hashlib.shake_256(s.encode("utf-8", "surrogatepass")).hexdigest(size // 2)
    out = [(h, v, "secret", 1) for h in ("token: ", "password=", "") for v in (url, plain, jwt, hexed)]
    out += [(h, f"https://files.example.com/{half[0]}/report.pdf?expires=17{len(half)}0000000&signature={plain}", "secret", 1) for h in ("token: ", "secret=")]
    many = [half[i % len(half)] for i in range(size // 8)]
    out += [("", "/".join([*many, "2020", "index"]), "secret", 0), ("see ", "-".join([*many, "2019"]), "secret", 0), ("", ".".join([*many, "v2"]), "secret", 0), ("", "_".join([*many, "10"]), "secret", 0),
            ("", "".join(many) + "2", "secret", 0), ("", str(size) * (size // 4), "secret", 0), ("", "-" * size + "1", "secret", 0), ("", "=" * (size // 2) + f"{size}" + "=" * (size // 2), "secret", 0)]
    return out


def _rewritten(s: str, kind: str, words: list[str]) -> list[tuple[str, str, str, int]]:
    """(before, value, kind, label): a found value in other right and wrong forms, so that the
    trees meet forms that a sample may lack."""
    d, out = _digits(s), []
    bad_end = lambda x: x[:-1] + str((int(x[-1]) + 3) % 10)
    if kind == "card" and len(d) >= 15:
        wrong = bad_end(d)
        out += [("card ", " ".join(re.findall(".{1,4}", d)), kind, 1), ("", "-".join(re.findall(".{1,4}", d)), kind, 1), ("", wrong, kind, 0), ("number ", wrong, kind, 0),
                ("", f"{d[:3]}-{d[3]}-{d[4:6]}-{d[6:12]}-{d[12]}", kind, 0), *[(h, _iban(d), "iban", 1) for h in ("account ", "", "iban ")], *[(h, bad_end(_iban(d)), "iban", 0) for h in ("account ", "", "iban ")]]
        ssn = f"{d[:3]}-{d[3:5]}-{d[5:9]}"
        low = f"{int(d[:3]) % 665 + 1:03d}-{int(d[3:5]) % 99 + 1:02d}-{int(d[5:9]) % 9999 + 1:04d}"
        for h in ("ssn ", ""):
            out += [(h, low, "ssn", 1), (h, low, "phone", 0), (h, "9" + low[1:], "ssn", 0), (h, "000" + low[3:], "ssn", 0)]
        out += [("", ssn, "ssn", 0)] if ssn[0] == "9" else []
        out += [("", d, "phone", 0), ("", d[:9], "phone", 0), ("", f"19{d[:2]}-0{d[3]}-1{d[4]}", "phone", 0), ("", f"{d[:2]}.{d[2:6]}.{d[6:9]}", "phone", 0)]
    elif kind == "phone" and len(d) >= 10:
        t = "2" + d[-9:] if d[-10] in "01" else d[-10:]
        out += [(h, v, kind, 1) for h in ("", "call ", "phone: ") for v in (f"({t[:3]}) {t[3:6]}-{t[6:]}", f"{t[:3]}-{t[3:6]}-{t[6:]}", f"{t[:3]}.{t[3:6]}.{t[6:]}")]
        out += [("", f"20{t[:2]}-0{t[3]}-1{t[4]}", kind, 0), ("", t, kind, 0), ("", f"{t[:4]} {t[4:8]}", kind, 0)]
    elif kind == "email" and "@" in s:
        name, host = s.split("@", 1)
        bare, site = re.sub("[^a-z]", "", name.lower()) or "info", re.sub("[0-9]", "", host)
        out += [("", f"{n} [at] {h.replace('.', ' [dot] ')}", kind, 1) for n, h in ((name, host), (bare, site), (bare[:3], site[-11:].lstrip(".")))]
        out += [("", f"{n}(at){h}", kind, 1) for n, h in ((name, host), (bare, site))] + [("", f"{name}@{host.rsplit('.', 1)[0]}.7", kind, 0), ("", f"{bare}@{site.rsplit('.', 1)[0]}.7", kind, 0)]
    elif kind == "secret":
        half = words[:3] or ["plain", "word"]
        longer = "".join(c.upper() if i % 3 else c for i, c in enumerate((s + s[::-1])[:28]))
        out += [("token = ", s[:16], kind, 1), ("password: ", s[-12:], kind, 1)] if len(_digits(s[:16])) > 1 and len(_digits(s[-12:])) > 1 else []
        out += [("api_key: ", "sk-" + longer, kind, 1), ("api_key: ", "sk-" + longer.lower()[:20], kind, 1), ("", "ghp_" + longer, kind, 1), ("secret=", longer, kind, 1), ("", longer + s[:8], kind, 1)]
        out += [("the ", "-".join([*half, "2019", *half[:2]]), kind, 0), ("", "/".join([*half, "2020", "index"]), kind, 0), ("", "_".join([*half, *half, "10"]), kind, 0),
                ("", d[:20].ljust(18, "0"), kind, 0), *_long_forms(s, half), ("see ", (re.sub("[^a-z]", "", "".join(half).lower()) or "plain") * 3 + "2", kind, 0)]
    elif kind == "ip":
        h = [f"{_part(x):x}" for x in s.split(".")]
        out += [("", f"fe80::{h[0]}ff:{h[1]}:{h[2]}:{h[3]}", "ipv6", 1), ("host ", f"2001:db8:{':'.join(h)}::1", "ipv6", 1), ("at ", f"{int(h[0], 16) % 24:02d}:{int(h[1], 16) % 60:02d}:{int(h[2], 16) % 60:02d}", "ipv6", 0),
                ("", f"{h[0]}:{h[1]}:{h[2]}x", "ipv6", 0)]
    return out


def _cases(text: str) -> Iterator[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, label) of the sure candidates of a text and of their other forms."""
    found = [(s, e, k) for s, k, e in base_spans(text) if k == "ip"]
    for start, end, kind in [*candidates(text), *found]:
        label = strict_label(text, start, end, kind) if kind != "ip" else None
        if label is not None:
            yield text, start, end, kind, label
        if label == 1 or kind == "ip":
            before = text[max(0, start - 60):start].split(" ")[1:-1]
            end_mark = text[end:end + 1]
            for hint, value, k, y in _rewritten(text[start:end], kind, [w for w in before if w.isalpha()]):
                lead = " ".join(before[-2:]) + " " + hint
                yield lead + value + end_mark, len(lead), len(lead) + len(value), k, y


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, labels, keys = [], [], []
        for text in batch.column(0).to_pylist():
            for where, s, e, kind, y in _cases(text or ""):
                rows.append(features(where, s, e, kind))
                labels.append(float(y))
                left = max(0, s - 24)  # all that features and label depend on
                keys.append(int.from_bytes(hashlib.blake2b(f"{kind}:{y}:{s - left}:{e - s}:{where[left:e + 1]}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64()), pa.array(keys, pa.int64())], names=["x", "label", "key"])


@dataclass
class Trees:
    """Boosted trees as arrays, with calibration steps and a threshold per kind."""

    trees: list[tuple] = field(default_factory=list)  # (feature, threshold, left, right, value, weight)
    steps: tuple = ((), ())  # margins, calibrated probabilities
    least: dict = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value, weight in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += weight * value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(x), self.steps[0], self.steps[1])


def _arrays(tree, weight: float) -> tuple:
    feature, threshold, left, right, value = [], [], [], [], []

    def add(node) -> int:
        i = len(feature)
        for column, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, float(node.prediction()))):
            column.append(v)
        if node.subtreeDepth() > 0:
            split = node.split()
            feature[i], threshold[i] = split.featureIndex(), float(split.threshold())
            left[i] = add(node.leftChild())
            right[i] = add(node.rightChild())
        return i

    add(tree._call_java("rootNode"))
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), weight


def isotonic(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: increasing steps (margin, mean label)."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, y in zip(margin[order], label[order], strict=True):
        blocks.append([y, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, n2, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, m2]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Boosted trees for the candidates of ``docs``, from a bounded sample of them."""
    n = docs.select(F.xxhash64("text").alias("h")).distinct().count()
    share = min(1.0, sample_docs / max(1, n))
    picked = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1)).distinct()
    cases = picked.mapInArrow(frugal(_labelled), "x array<double>, label double, key long")
    rows = cases.dropDuplicates(["key"]).orderBy("key").limit(sample_rows)
    rows = written(rows.withColumn("held", F.pmod("key", F.lit(5)) == 0), "pii-sample")
    classes = {(r["held"], r["label"]) for r in rows.select("held", "label").distinct().collect()}
    if not classes >= {(False, 0.0), (False, 1.0)}:
        return Trees()
    train = rows.where(~F.col("held")).select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(train.coalesce(1))
    trees = Trees([_arrays(t, w) for t, w in zip(model.trees, model.treeWeights, strict=True)])
    held = rows.where("held").orderBy("key").collect() if (True, 1.0) in classes else rows.orderBy("key").collect()
    x, y = np.array([r["x"] for r in held]), np.array([r["label"] for r in held])
    trees.steps = isotonic(trees.margin(x), y)
    p = trees.probability(x)
    for i, kind in enumerate(ADDED):
        own = x[:, 0] == i
        trees.least[kind] = 0.5
        for cut in sorted({0.5, *p[own & (p >= 0.5)].tolist()}):
            chosen = own & (p >= cut)
            if chosen.any() and y[chosen].mean() >= PRECISION:
                trees.least[kind] = cut
                break
    return trees


def _outside_of(start: int, end: int, base: Taken | list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """What the base spans leave of start to end; nothing if they hold half of it."""
    parts = (base if isinstance(base, Taken) else Taken((s, e) for s, _, e in base)).free(start, end)
    return parts if 2 * sum(e - s for s, e in parts) > end - start else []


def added_spans(texts: list[str], base: list[list[tuple]], trees: Trees) -> list[list[tuple[int, str, int]]]:
    """The candidates of each text that the trees select, without overlaps. Of secrets within
    each other the widest goes first, so that no rest of one stays."""
    out: list[list] = [[] for _ in texts]
    if not trees.trees:
        return out
    owner, spans, rows = [], [], []
    held, chosen = [Taken((s, e) for s, _, e in b) for b in base], [Taken() for _ in texts]
    for i, text in enumerate(texts):
        for start, end, kind in candidates(text):
            if kind != "secret" and held[i].meets(start, end):
                continue
            if kind == "secret" and not _outside_of(start, end, held[i]):
                continue
            owner.append(i)
            spans.append((start, kind, end))
            rows.append(features(text, start, end, kind))
    if not rows:
        return out
    p = trees.probability(np.array(rows))
    likely, wider = p.copy(), np.zeros(len(p), np.int64)
    secrets = [j for j in range(len(p)) if spans[j][1] == "secret" and p[j] >= trees.least["secret"]]  # by text and start
    for n, j in enumerate(secrets):
        start, _, end = spans[j]
        k = n - 1
        while k >= 0 and owner[secrets[k]] == owner[j] and spans[secrets[k]][0] == start:
            k -= 1
        for i in (secrets[m] for m in range(k + 1, len(secrets))):
            if owner[i] != owner[j] or spans[i][0] >= end:
                break
            if i != j and spans[i][2] <= end and any(c.isalnum() for c in texts[owner[j]][start:spans[i][0]] + texts[owner[j]][spans[i][2]:end]):
                likely[j], wider[j] = max(likely[j], p[i]), end - start
    for j in sorted(range(len(rows)), key=lambda j: (-likely[j], -wider[j], spans[j][0], -spans[j][2], ORDER[spans[j][1]])):
        start, kind, end = spans[j]
        i = owner[j]
        if p[j] >= trees.least[kind] and not chosen[i].meets(start, end):
            for s, e in _outside_of(start, end, held[i]) if kind == "secret" else [(start, end)]:
                out[i].append((s, kind, e))
                chosen[i].add(s, e)
    return out


def _key(span: tuple[int, str, int]) -> tuple:
    return span[0], ORDER[span[1]], span[2]


def _join(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _find(trees: Trees):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, trees)
            n = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([_join(sorted(b + m, key=_key)) for b, m in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, digest, spans], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    return find


def find_spans(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(frugal(_find(trees)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _redact(trees: Trees, column: int):
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            plain = [t or "" for t in texts]
            base = [base_spans(t) for t in plain]
            more = added_spans(plain, base, trees)
            new = []
            for text, b, m in zip(texts, base, more, strict=True):
                parts, at = [], 0
                for start, kind, end in sorted(b + m, key=_key):
                    if start >= at:  # base kinds may overlap: the first one's mark stands for both
                        parts += [text[at:start], f"[{kind.upper()}]"]
                    at = max(at, end)
                new.append("".join([*parts, text[at:]]) if at else text)
            columns = list(batch.columns)
            columns[column] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return redact


def redact(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets."""
    return docs.mapInArrow(frugal(_redact(trees, docs.columns.index(text))), docs.schema)


def op6_frame(docs: DataFrame) -> DataFrame:
    return find_spans(docs, fit(docs))
