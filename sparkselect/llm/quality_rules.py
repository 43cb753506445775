"""Quality rules as a rule bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document: the ledger keeps each measurement and
one long whose bit i says that rule i failed. A policy is a version name and the
mask of the rules that it enforces; applying another policy, or asking what a rule
contributes, reads only the ledger and uses bitwise operations.

Defined results: a null text has no words, lines or symbols and fails ``too_few_words``;
an empty table gives an empty ledger; repeated rows are judged one by one; other
columns of the input are carried on unless a ledger column has their name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows are hashed; only if two hashes are equal are they sorted together with
    their positions (hash bits above, position bits below, in one long), and windows
    with equal hash bits are then compared as words, so that the count is exact.
    """

    def covered(w: Column) -> Column:
        n = F.size(w) - 2
        bits = F.greatest(F.lit(1), F.ceil(F.log2(n + F.lit(1.0)))).cast("int")
        starts = F.sequence(F.lit(0), n - 1)
        text = lambda p: F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))
        hashed = lambda p: F.xxhash64(F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))

        def sort_keys(b: Column) -> Column:
            return F.sort_array(F.transform(starts, lambda p: F.call_function("shiftleft", hashed(p), b).bitwiseOR(p.cast("long"))))

        def positions(b: Column) -> Column:
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
            high = lambda x: F.call_function("shiftright", x, b)

            def near(s: Column) -> Column:
                same = lambda x, i: F.coalesce(high(F.get(s, i - 1)) == high(x), F.lit(False)) | F.coalesce(high(F.get(s, i + 1)) == high(x), F.lit(False))
                return F.transform(F.filter(s, same), lambda x: x.bitwiseAND(mask).cast("int"))

            return let(sort_keys(b), near)

        def exact(pos: Column) -> Column:
            tagged = F.array_sort(F.transform(pos, lambda p: F.struct(text(p).alias("t"), p.alias("p"))))

            def twice(s: Column) -> Column:
                same = lambda x, i: F.coalesce(F.get(s, i - 1)["t"] == x["t"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["t"] == x["t"], F.lit(False))
                return F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))

            return let(tagged, twice)

        def length(found: Column) -> Column:
            gaps = F.transform(found, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(found, i + 1) - p, F.lit(3))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        any_twice = F.size(F.array_distinct(F.transform(starts, hashed))) < n
        found = let(bits, lambda b: let(positions(b), lambda pos: let(exact(pos), length)))
        return F.when(any_twice, found).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(covered(words))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one ``_measured`` struct of the measurements of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, SEPARATORS, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        )

    return df.withColumn("_measured", let(_words(t), of))


@dataclass(frozen=True)
class Rule:
    """``failed`` maps a function name -> measurement column to a boolean."""

    name: str
    failed: object


def _share(m, part: str, whole: str, percent: int) -> Column:
    """100 * part > percent * whole, in integers (false where whole is 0 and part is 0)."""
    return F.lit(100) * m(part) > F.lit(percent) * m(whole)


#: Bit i of the ledger belongs to rule i. Append only: stored ledgers keep their meaning.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: _share(m, "n_repeat_words", "n_words", 50)),
    Rule("symbols", lambda m: _share(m, "n_symbols", "word_chars", 5)),
    Rule("duplicate_lines", lambda m: _share(m, "n_dup_lines", "n_lines", 50)),
    Rule("short_words", lambda m: F.lit(10) * m("word_chars") < F.lit(22) * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > F.lit(15) * m("n_words")),
    Rule("few_alphabetic_words", lambda m: F.lit(100) * m("n_alpha_words") < F.lit(60) * m("n_words")),
)


def mask_of(*names: str) -> int:
    bits = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << bits[n] for n in names)


#: Versioned policies: the rules that reject a document. Versions are added, never changed.
POLICIES: dict[str, int] = {
    "base": mask_of("too_few_words", "repeated_windows"),
    "v1": mask_of(*[r.name for r in RULES]),
}


def _measured(name: str) -> Column:
    return F.col(f"_measured.{name}")


def _failed_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.failed(_measured), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def passing(df: DataFrame, version: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``df``, unchanged, that no rule of the policy rejects."""
    fine = _failed_bits().bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0
    return measure(df, text).where(fine).select(*[F.col(c) for c in df.columns])


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus the measurements and ``failed_bits`` (one evaluation of each rule)."""
    own = {*MEASURES, "failed_bits", "_measured"}
    measured = measure(df, text)
    kept = [F.col(c) for c in df.columns if c not in own]
    return measured.select(*kept, *[_measured(x).alias(x) for x in MEASURES], _failed_bits().alias("failed_bits"))


def apply_policy(ledger_df: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger plus ``kept``: no rule of the policy failed."""
    return ledger_df.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def ablations(ledger_df: DataFrame, version: str = "v1") -> DataFrame:
    """One row per rule of the policy: how many documents it rejects, how many only it
    rejects, and how many the policy would keep without it. One aggregation of bits."""
    policy = POLICIES[version]
    rules = [(i, r) for i, r in enumerate(RULES) if policy >> i & 1]
    hit = F.col("failed_bits").bitwiseAND(F.lit(policy).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum((hit == 0).cast("long")).alias("kept")]
    for i, _ in rules:
        bit = F.lit(1 << i).cast("long")
        sums += [F.sum((hit.bitwiseAND(bit) != 0).cast("long")).alias(f"f{i}"), F.sum((hit == bit).cast("long")).alias(f"o{i}")]
    one = ledger_df.agg(*sums)
    rows = [F.struct(F.lit(r.name).alias("rule"), F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("n_failed"),
                     F.coalesce(F.col(f"o{i}"), F.lit(0)).alias("n_only"),
                     (F.coalesce(F.col("kept"), F.lit(0)) + F.coalesce(F.col(f"o{i}"), F.lit(0))).alias("n_kept_without")) for i, r in rules]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def op5_frame(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the ledger's bits."""
    base = F.lit(POLICIES["base"]).cast("long")
    judged = apply_policy(ledger(docs.select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (F.col("failed_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "failed_bits")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t3
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t3) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), m AS (
  SELECT w.r, doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_alpha_words
  FROM w LEFT JOIN rep ON rep.r = w.r
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * word_chars < 22 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_alpha_words < 60 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""
