"""Quality rules as a bitmask ledger, in DataFrame functions only.

Each rule is evaluated once for a text; the ledger keeps the measurements and one bit per failed rule. Policies are
versioned sets of rules applied to the ledger with bitwise operations, and ablations aggregate its bits, so texts are
never read again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named bit and the condition under which a text fails."""

    bit: int
    name: str
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject under it."""

    version: str
    rules: tuple[str, ...]


def _over(part: str, percent: int, whole: str) -> Column:
    return 100 * F.col(part) > percent * F.col(whole)


#: Integer comparisons only, so any engine gives the same verdicts. Bits are permanent; new rules take new ones.
RULES = (
    Rule(0, "too_few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeated_trigrams", lambda: _over("n_repeat_words", 50, "n_words")),
    Rule(2, "many_symbols", lambda: _over("n_symbols", 15, "n_words")),
    Rule(3, "long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule(4, "short_words", lambda: 2 * F.col("word_chars") < 3 * F.col("n_words")),
    Rule(5, "repeated_lines", lambda: _over("n_dup_lines", 50, "n_lines")),
    Rule(6, "shouting", lambda: _over("n_upper", 50, "word_chars")),
    Rule(7, "no_words", lambda: F.col("n_words") == 0),
)
BASE = Policy("base-1", ("too_few_words", "repeated_trigrams"))
STRICT = Policy("strict-1", ("too_few_words", "repeated_trigrams", "many_symbols", "long_words", "short_words", "repeated_lines", "shouting"))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in set(policy.rules))


def measured(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_lines, word_chars, n_symbols, n_upper, n_dup_lines, n_repeat_words) of every row.

    Null and empty texts measure zero everywhere. Repeated keys stay separate rows; other columns of ``df`` are ignored.
    Three-word windows are compared by the 64-bit hashes of their words. A document's windows are sorted with their
    positions; equal neighbours mark both, and the words covered by marked windows are counted from the gaps.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = df.select(
        F.col(key).alias("key"),
        F.filter(F.split(body, SPACE + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )
    hashed = words.select(
        "key", "n_symbols", "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            """CASE WHEN size(words) < 4 THEN array()
               ELSE sort_array(transform(sequence(0, size(words) - 3),
                                         i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i))) END"""
        ).alias("grams"),
    )
    marked = hashed.select(
        "*",
        F.expr("size(grams)").alias("n_grams"),
        F.expr(
            "sort_array(transform(filter(grams, (x, k) -> x.h = get(grams, k - 1).h OR x.h = get(grams, k + 1).h), x -> x.i))"
        ).alias("at"),
    )
    repeated = F.expr(
        """CASE WHEN size(at) = 0 THEN 0L
           ELSE aggregate(at, struct(0L AS n, -3 AS last),
                          (s, p) -> struct(s.n + least(3, p - s.last) AS n, p AS last), s -> s.n) END"""
    )
    return marked.select(
        F.col("key").alias(key), "n_words", "n_lines", "word_chars", "n_symbols", "n_upper", "n_dup_lines", repeated.alias("n_repeat_words")
    )


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and ``fail_bits``: bit r.bit is set if rule r failed."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits + F.when(rule.fails(), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return measured(df, key, text).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy, name: str = "kept", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A boolean column: no rule of the policy failed. Reads only ``fail_bits``."""
    return rows.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablation(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of the policy: texts that fail it, and texts that only it rejects (kept without the rule).

    Bit patterns are counted first (at most 2^rules of them), so the shuffle does not grow with the documents.
    """
    whole = mask(policy, rules)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    named = [(r.bit, r.name) for r in rules if r.name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("rule")) for b, n in named])).alias("r")
    bit = F.expr("shiftleft(1L, r.bit)")
    return (
        patterns.select("bits", "n", each)
        .groupBy(F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("n_only"),
            F.sum("n").alias("n_texts"),
        )
        .withColumn("policy", F.lit(policy.version))
    )


def quality_rules(documents: DataFrame) -> DataFrame:
    """The registered query: the ledger of every document under the base and the strict policy."""
    rows = apply_policy(apply_policy(ledger(documents), BASE, "base_kept"), STRICT, "kept")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "n_lines", "n_upper", "fail_bits",
    )


#: The same in DuckDB: windows are compared as strings of words there.
SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n >= 2),
c AS (
  SELECT doc_id, CAST(sum(least(3, i - p)) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -9) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda s: length(s))), 0) AS BIGINT) AS word_chars,
         CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(x) - length(regexp_replace(x, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper
  FROM t LEFT JOIN c ON t.doc_id = c.doc_id),
b AS (
  SELECT *, CAST((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
       + 4 * (100 * n_symbols > 15 * n_words)::BIGINT + 8 * (word_chars > 20 * n_words)::BIGINT
       + 16 * (2 * word_chars < 3 * n_words)::BIGINT + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
       + 64 * (100 * n_upper > 50 * word_chars)::BIGINT + 128 * (n_words = 0)::BIGINT AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 127) = 0 AS kept, n_lines, n_upper, fail_bits
FROM b
"""
