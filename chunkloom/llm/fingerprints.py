"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its words (runs of ASCII letters or digits and other non-ASCII characters, lower-cased), weighted by their counts.
For sample k each term of weight S draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash and k; with
t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1), the term with the least a is the sample, and (term, t) its value. Two texts
agree in a sample with the probability of their generalised Jaccard similarity, the sum of the smaller weights by that of the larger.

Plan. Rows are dealt out once, by ranges of (doc_id, hash of the text), and everything after that (the next document's text, word counts,
samples, fingerprints) runs inside those partitions: ``(range, place)`` keys refine the partitioning, so Spark adds no exchange. The bounds of
the ranges are quantiles of a sample chosen by hash, so ranges hold about ``RANGE`` rows however ids are spread, negative, 64-bit or null ones too;
a row finds its range by binary search. The first row of each range is also given to the range before it, so "next" needs no global order.
``samples`` are drawn ``WIDE`` at a time in generated code.

The next document is the one with the next smaller doc_id (null being the least, equal ids in falling order of their texts' hashes), after
the last the first; a single document is its own next. Null and empty texts are empty; a text without words has one term that no other
text shares a fingerprint by, so such texts are alike. Repeated rows are rows of their own (and share a range). Further columns are ignored.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, WIDE = 64, 8
#: Rows of a range, ranges at most, and sampled rows for each bound; the bounds are two longs each.
RANGE, RANGES, DRAWN = 256, 50_000, 20
_LEAST = -(2**63)
_UNIT = 2.0**-21
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ordered(docs: DataFrame) -> DataFrame:
    """text, and _id and _h, by which rows are in order: null ids come as the least, and before it."""
    text, known = F.coalesce("text", F.lit("")), F.col("doc_id").isNotNull()
    h = F.shiftrightunsigned(F.xxhash64(text), 1)
    return docs.select(text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("_id"), F.when(known, h).otherwise(h.bitwiseOR(F.lit(_LEAST))).alias("_h"))


def bounds(rows: DataFrame) -> list[tuple[int, int]]:
    """The least (_id, _h) of each range but the first: at most RANGES, out of DRAWN times as many rows."""
    n = rows.count()
    ranges = min(RANGES, -(-n // RANGE))
    if ranges < 2:
        return []
    every = max(1, n // (DRAWN * ranges))
    drawn = rows.filter(F.pmod(F.xxhash64("_id", "_h"), F.lit(every)) == 0).select("_id", "_h").distinct().toArrow()
    keys = sorted(zip(drawn["_id"].to_pylist(), drawn["_h"].to_pylist(), strict=True))
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def range_of(edges: list[tuple[int, int]]) -> Column:
    """The number of bounds up to a row's (_id, _h), by binary search in constant arrays."""
    if not edges:
        return F.lit(0)
    ids, hashes = (F.split(F.lit(",".join(str(e[k]) for e in edges)), ",").cast("array<bigint>") for k in (0, 1))

    def step(at: Column, width: Column) -> Column:
        i, h = F.get(ids, at + width - 1), F.get(hashes, at + width - 1)
        below = (i < F.col("_id")) | ((i == F.col("_id")) & (h <= F.col("_h")))
        return F.when((at + width <= len(edges)) & below, at + width).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(len(edges).bit_length())))), F.lit(0), step)


def neighbours(docs: DataFrame) -> DataFrame:
    """part, place, extra, _id, _h, text, next: each text beside the next document's; rows with ``extra`` stand in for a next range's first."""
    base = ordered(docs)
    part = range_of(bounds(base))
    heads = base.select("_id", "_h", part.alias("part")).groupBy("part").agg(F.max(F.struct("_id", "_h")).alias("x")).select("part", "x.*")  # no more than RANGES rows
    order = Window.orderBy(F.desc("part"))
    above = heads.select("_id", "_h", F.coalesce(F.lag("part").over(order), F.min("part").over(Window.partitionBy())).alias("above"))
    spread = base.withColumn("part", part).join(F.broadcast(above), ["_id", "_h"], "left")
    both = spread.select("_id", "_h", "text", F.explode(F.when(F.col("above").isNull(), F.array(F.struct("part", F.lit(0).alias("extra")))).otherwise(F.array(F.struct("part", F.lit(0).alias("extra")), F.struct(F.col("above").alias("part"), F.lit(1).alias("extra"))))).alias("_to"))
    w = Window.partitionBy("part").orderBy("extra", F.desc("_id"), F.desc("_h"))
    return both.select("_id", "_h", "text", "_to.*").select("*", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next"))


def edited(n: Column) -> Column:
    """The text, its last third replaced by the start of the next."""
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring("text", F.lit(1), n - k), F.substring(F.coalesce("next", F.lit("")), F.lit(1), k))


def term_weights(rows: DataFrame) -> DataFrame:
    """part, place, term (hash), ln_own and ln_edit: logarithms of the term's weights in the text and the edited text, null where it isn't."""
    n = F.char_length("text")
    two = F.explode(F.array(F.struct(F.col("text").alias("t"), F.lit(1).alias("own"), F.lit(0).alias("edit")), F.struct(edited(n).alias("t"), F.lit(0).alias("own"), F.lit(1).alias("edit"))))
    each = rows.select("part", "place", two.alias("x")).select("part", "place", "x.own", "x.edit", F.explode(F.split(F.concat(F.lower("x.t"), F.lit(" ")), SEPARATORS)).alias("word"))
    counts = each.select("part", "place", "own", "edit", F.xxhash64("word").alias("term"), (F.col("word") == "").alias("none")).groupBy("part", "place", "term", "none").agg(F.sum("own").alias("own"), F.sum("edit").alias("edit"))
    # the empty word behind the last separator stands for "no words": too light to be drawn before any other
    weigh = lambda c: F.when(F.col(c) > 0, F.when(F.col("none"), F.lit(-30.0)).otherwise(F.log(F.col(c).cast("double"))))
    return counts.select("part", "place", "term", weigh("own").alias("ln_own"), weigh("edit").alias("ln_edit"))


def fingerprints(rows: DataFrame) -> DataFrame:
    """part, place, own and edit: arrays of SAMPLES longs."""
    terms = term_weights(rows).select("*", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // WIDE - 1))).alias("g"))
    drawn = ["part", "place", "g", "ln_own", "ln_edit"]
    bits = F.lit(0x1FFFFF).cast("long")  # 21 bits a draw: u1, u2 and b from x, u3 and u4 from y
    x = [F.xxhash64("term", F.col("g") * WIDE + j) for j in range(WIDE)]
    terms = terms.select(*drawn, *(c.alias(f"x{j}") for j, c in enumerate(x)), *(F.xxhash64("g", "term", F.lit(j)).alias(f"y{j}") for j in range(WIDE)))
    unit = lambda c: (c + F.lit(0.5)) * F.lit(_UNIT)
    gamma = lambda c: -F.log(unit(F.shiftrightunsigned(c, 21).bitwiseAND(bits)) * unit(c.bitwiseAND(bits)))
    terms = terms.select(*drawn, *(f"x{j}" for j in range(WIDE)), *(gamma(F.col(f"x{j}")).alias(f"r{j}") for j in range(WIDE)), *(F.log(gamma(F.col(f"y{j}"))).alias(f"c{j}") for j in range(WIDE)), *((F.shiftrightunsigned(F.col(f"x{j}"), 43) * F.lit(_UNIT)).alias(f"b{j}") for j in range(WIDE)))

    def packed(ln: str, j: int) -> Column:
        t = F.floor(F.col(ln) / F.col(f"r{j}") + F.col(f"b{j}"))
        a = F.col(f"c{j}") - F.col(f"r{j}") * (t - F.col(f"b{j}") + 1)
        high = F.shiftleft(((F.greatest(a, F.lit(-63.0)) + 64) * float(2**26)).cast("long"), 30)
        return F.min(high.bitwiseOR(F.col(f"x{j}").bitwiseXOR(t).bitwiseAND(F.lit(2**30 - 1))))

    least = terms.groupBy("part", "place", "g").agg(*(packed("ln_own", j).alias(f"o{j}") for j in range(WIDE)), *(packed("ln_edit", j).alias(f"e{j}") for j in range(WIDE)))
    low = lambda k: F.array(*(F.col(f"{k}{j}").bitwiseAND(F.lit(2**30 - 1)) for j in range(WIDE))).alias(k)
    lists = least.select("part", "place", F.struct("g", low("o"), low("e")).alias("x")).groupBy("part", "place").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return lists.select("part", "place", F.flatten("x.o").alias("own"), F.flatten("x.e").alias("edit"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two fingerprints agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(SAMPLES))


def shown(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = neighbours(docs.select("doc_id", "text"))
    prints = fingerprints(rows).withColumn("after", F.lead("own").over(Window.partitionBy("part").orderBy("place")))
    n = F.char_length("text")
    about = rows.filter("extra = 0").select("part", "place", F.when(F.col("_h") >= 0, F.col("_id")).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(edited(n).cast("binary"), 256).alias("edited_sha256"))
    both = about.join(prints, ["part", "place"])
    return both.select("doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))


def brute_force(text: str) -> str:
    """The fingerprint of a text, sample by sample, with the hash function of the query; for tests."""
    import math
    import re
    import struct
    from collections import Counter

    import xxhash

    words = Counter(re.split(SEPARATORS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c.lower() for c in text) + " "))
    signed = lambda x: x - 2**64 if x >= 2**63 else x

    def hashed(*values: int | bytes) -> int:
        seed = 42
        for v in values:
            data = v if isinstance(v, bytes) else struct.pack("<q", v) if abs(v) >= 2**31 or v in terms else struct.pack("<i", v)
            seed = xxhash.xxh64_intdigest(data, seed)
        return seed

    terms: set[int] = set()
    found = {}
    for word, n in words.items():
        term = signed(hashed(word.encode()))
        terms.add(term)
        found[term] = -30.0 if word == "" else math.log(n)
    bits, unit, out = 0x1FFFFF, lambda c: (c + 0.5) * _UNIT, []
    for g in range(SAMPLES // WIDE):
        for j in range(WIDE):
            best = None
            for term, ln in found.items():
                x, y = hashed(term, g * WIDE + j), hashed(g, term, j)
                gamma = lambda c: -math.log(unit((c >> 21) & bits) * unit(c & bits))
                r, c, b = gamma(x), math.log(gamma(y)), (x >> 43) * _UNIT
                t = math.floor(ln / r + b)
                a = c - r * (t - b + 1)
                high = int((max(a, -63.0) + 64) * 2.0**26) << 30
                packed = high | ((x ^ (t % 2**64)) & (2**30 - 1))
                packed = signed(packed % 2**64)
                best = packed if best is None else min(best, packed)
            out.append(best & (2**30 - 1))
    return "".join(f"{v:08x}" for v in out)
