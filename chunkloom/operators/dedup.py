"""Index decisions as relational operators.

Everything that only needs totals is an aggregation by fingerprint with map-side combining: equal chunks of any number meet as one row
per task, so a hot fingerprint is no skew. Where each chunk needs its decision, the first occurrence by fingerprint (a small aggregate) is
joined back, which adaptive execution can split, rather than a window over all chunks of a fingerprint, which it can't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.config import ENTRY
from chunkloom.functions.fingerprint import truncated


def ratio(logical: Column, written: Column) -> Column:
    """logical / written, 0 where nothing was written."""
    return F.round(F.when(written > 0, logical / written).otherwise(F.lit(0.0)), 6)


def occurrences(chunks: DataFrame, *by: str) -> DataFrame:
    """A row per fingerprint (within ``by``): n, len, first (the least ord)."""
    return chunks.groupBy(*by, "fp").agg(F.count("*").alias("n"), F.max("len").alias("len"), F.min("ord").alias("first"))


def decisions(chunks: DataFrame) -> DataFrame:
    """``chunks`` with chunk_id (ord of the first occurrence) and kind (new or dup): the exact index."""
    first = chunks.groupBy("fp").agg(F.min("ord").alias("chunk_id"))
    return chunks.join(first, "fp").withColumn("kind", F.when(F.col("ord") == F.col("chunk_id"), "new").otherwise("dup"))


def new_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Incremental form: the chunks of a batch that ``store`` (fp) doesn't have, one for each fingerprint."""
    return chunks.join(store.select("fp").distinct(), "fp", "left_anti").groupBy("fp").agg(F.min("ord").alias("chunk_id"), F.max("len").alias("len"))


def totals(occ: DataFrame, *by: str) -> DataFrame:
    """Counters of a store from ``occurrences``."""
    return occ.groupBy(*by).agg(F.sum("n").alias("chunks"), F.count("*").alias("uniques"), F.sum(F.col("n") - 1).alias("dups"), F.sum(F.col("n") * F.col("len")).alias("logical"), F.sum("len").alias("written"), (F.count("*") * ENTRY).alias("index_ram")).withColumn("ratio", ratio(F.col("logical"), F.col("written")))


def near_exact(chunks: DataFrame, bits: int, verify: bool) -> DataFrame:
    """One row of counters under an index of keys cut to ``bits``: see ``near_exact_grid``."""
    return near_exact_grid(chunks, [(bits, verify)])


def near_exact_grid(chunks: DataFrame, settings: list[tuple[int, bool]]) -> DataFrame:
    """A row of counters for each (bits, verified) of an index of keys cut to ``bits`` (0: whole).

    Verified, a key's hit counts only if the whole fingerprint is stored, so decisions are the exact index's and only the index
    shrinks. Unverified, every later chunk with the key counts as its first: a false hit where fingerprints differ.
    All settings share one aggregation by fingerprint and one by key, both combined map-side; there is no join.
    """
    every = sorted({b for b, _ in settings})
    keyed = occurrences(chunks).select("*", F.explode(F.array(*map(F.lit, every))).alias("bits"))
    cut = F.when(F.col("bits") == 0, F.col("fp"))  # the whole fingerprint
    for b in every:
        cut = cut if not b else cut.when(F.col("bits") == b, truncated(F.col("fp"), b).cast("string"))
    first = F.min(F.struct("first", "len", "n"))
    keys = keyed.groupBy("bits", cut.alias("key")).agg(F.count("*").alias("fps"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("len")).alias("logical"), F.sum("len").alias("len"), first.alias("lead"))
    sums = keys.groupBy("bits").agg(F.count("*").alias("keys"), *(F.sum(c).alias(c) for c in ("fps", "n", "logical", "len")), F.sum("lead.len").alias("lead_len"), F.sum("lead.n").alias("lead_n"))
    flags = F.explode(F.array(F.lit(True), F.lit(False))).alias("verified")
    v = F.col("verified")
    written = F.when(v, F.col("len")).otherwise(F.col("lead_len"))
    out = sums.select("*", flags).select("bits", "verified", F.col("n").alias("chunks"), F.when(v, F.col("fps")).otherwise(F.col("keys")).alias("uniques"), F.when(v, F.lit(0).cast("long")).otherwise(F.col("n") - F.col("lead_n")).alias("false_hits"), "logical", written.alias("written"), (F.col("keys") * ENTRY).alias("index_ram"), ratio(F.col("logical"), written).alias("ratio"))
    wanted = F.lit(False)
    for b, f in settings:
        wanted = wanted | ((F.col("bits") == b) & (v == f))
    return out.filter(wanted)


def coverage(copy: DataFrame, original: DataFrame, *by: str) -> DataFrame:
    """The share of the copy's bytes in chunks (fp, len) that the original has, within ``by``."""
    have = original.select(*by, "fp", "len").distinct().withColumn("_hit", F.lit(1))
    hit = F.sum(F.when(F.col("_hit") == 1, F.col("len")).otherwise(0))
    return copy.join(have, [*by, "fp", "len"], "left").groupBy(*by).agg(F.sum("len").alias("bytes"), hit.alias("covered")).withColumn("coverage", ratio(F.col("covered"), F.col("bytes")))
