"""Quality rules as a bitmask ledger.

measure() reads each text once and stores its measurements; ledger() evaluates every rule once and
stores the failures as bits; policies are versioned masks over those bits, so a new policy or an
ablation is bitwise arithmetic on the ledger and reads no text.

Null and empty texts have no word: all measurements 0, the few-words bit set. Rows are never merged
or dropped; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _hash_piece, _pieces, _SPACE, mix
from quarry.session import ship

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

#: Rules by bit: name and failure condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("repeated_lines", "n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
]
#: Policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"],
}
POLICY = "v1"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _measure(data: bytes) -> tuple[int, ...]:
    buf = np.frombuffer(data, np.uint8)
    chars = int(np.count_nonzero(((buf & 0xC0) != 0x80) & ~_SPACE[buf]))
    symbols = int(np.count_nonzero(_SYMBOL[buf]))
    parts = [_hash_piece(p)[0] for p in _pieces(data)]
    h = np.concatenate(parts)
    repeated = 0
    if len(h) > WINDOW:
        a = np.zeros(len(h) - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            a = mix(a * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - WINDOW + 1 + j])
        order = np.argsort(a, kind="stable")
        s = a[order]
        same = s[1:] == s[:-1]
        if same.any():
            hit = np.zeros(len(a), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            step = np.zeros(len(h) + 1, np.int64)
            np.add.at(step, np.flatnonzero(hit), 1)
            np.add.at(step, np.flatnonzero(hit) + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(step)[:-1] > 0))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(h), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """(row, measurements): row is a struct of df's columns, so that none can clash with a measurement."""
    names = [x.split()[0] for x in MEASURED.split(", ")]

    @F.pandas_udf(MEASURED)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_measure((t or "").encode()) for t in s], columns=names, dtype="int64")

    ship(df.sparkSession)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), run(F.col(text)).alias("m")).select("row", "m.*")


def mask(policy: str) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[x] for x in POLICIES[policy])


def ledger(measured: DataFrame) -> DataFrame:
    """measured with failed_bits: bit i is set where rule i fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, cond) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed_bits", total.cast("long"))


def verdict(policy: str = POLICY, bits: str = "failed_bits") -> Column:
    """True where no rule of the policy fails."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects. The ledger is first
    counted by its distinct bit sets (2 to the number of rules at most)."""
    sets = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]])
    one = sets.select("b", "n", F.explode(rules).alias("r"))
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_docs"),
    )


def judged(df: DataFrame, policy: str = POLICY) -> DataFrame:
    """(row, measurements, failed_bits, base_failed, kept) of every row of df."""
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return ledger(measure(df)).withColumn("base_failed", base).withColumn("kept", ~base & verdict(policy))
