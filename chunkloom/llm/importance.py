"""Target-distribution importance resampling: documents are drawn by how much their n-grams look like those of a target corpus.

Features are all runs of 1 to ``NGRAM`` words of a text, joined by a space, repeats included; a word is a run of ASCII letters or digits and
non-ASCII characters, A-Z lower-cased. A feature's bucket is its unsigned crc32 modulo ``BUCKETS``. With s of all S features of the
documents and t of all T of the target in a bucket, its gain is ``floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS))))``. A document's weight
is the floored mean of its features' gains (0 without features), its score the weight and a Gumbel variate of its id, ``floor(-1000 ln(-ln((h + 0.5) / 2^32)))``
with h the first 32 bits of sha256 of ``<seed>:<doc_id>``: the highest scores are a sample without replacement by weight. Of the N documents of at least
``MIN_WORDS`` words the ``floor(PERCENT N / 100)`` with the highest scores are drawn.

Plan, DataFrame functions only. Texts are exploded twice: to count buckets (at most ``BUCKETS`` rows leave a task) and, beside the broadcast
table of gains (``BUCKETS`` rows of 12 bytes), to sum gains by document (a row per document leaves a task). Sums are stored, sorted by ranges of
(score, doc_id, hash of the text) and stored with their range; a row's rank is its place in its range and what the ranges before it hold (one row per range).

Repeated rows (equal in doc_id and text) are one row with their number until the end, so they rank one after the other and no range grows by them.
Ties in score go to the smaller doc_id, then null, then by the text's hash. A null doc_id counts as no digits. Null and empty texts, and texts
without words, have no features. With an empty target gains follow the documents alone. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm.shared import store

NGRAM, BUCKETS, MIN_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Rows of a range that is ranked in one task; copies of a row that are made at a time.
RANGE, COPIES = 200_000, 1 << 16
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case; ``lower`` does no more than that to ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def features(rows: DataFrame, keys: list[str], ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """``keys``, bucket, and words and first (1 or 0: a single word, a row's first feature) for each feature; one row with a null bucket for a text without."""
    words = rows.select(*keys, F.array_remove(F.split(F.coalesce("text", F.lit("")), SEPARATORS), "").alias("_w"))
    runs = F.arrays_zip(*(F.expr(f"slice(_w, {k + 1}, greatest(size(_w) - {k}, 0))").alias(f"w{k}") for k in range(ngram)))
    each = words.select(*keys, F.posexplode_outer(runs).alias("_at", "_x"))
    each = each.select(*keys, F.coalesce("_at", F.lit(0)).alias("_at"), *(lowered(F.col("_x").getField(f"w{k}")).alias(f"_w{k}") for k in range(ngram)))
    # concat is null where a run would go beyond the text's end
    grams = [F.concat(*[c for j in range(k + 1) for c in ([F.lit(" ")] if j else []) + [F.col(f"_w{j}")]]) for k in range(ngram)]
    spread = each.select(*keys, "_at", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), g.alias("g")) for k, g in enumerate(grams)))).alias("_g"))
    spread = spread.select(*keys, F.pmod(F.crc32(F.col("_g.g").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"), F.col("_g.k").alias("_k"), "_at")
    first = (F.col("_at") == 0) & (F.col("_k") == 0)
    kept = spread.filter(F.col("bucket").isNotNull() | first)
    return kept.select(*keys, "bucket", F.when((F.col("_k") == 0) & F.col("bucket").isNotNull(), 1).otherwise(0).alias("words"), F.when(first, 1).otherwise(0).alias("first"))


def gains(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, a row for each bucket."""
    counts = lambda rows, name: features(rows.select("text"), [], ngram, buckets).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    table = store(every.join(counts(docs, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").fillna(0), "buckets")
    s, t = (float(x or 0) for x in table.agg(F.sum("s"), F.sum("t")).first())
    ratio = ((F.col("t") + 1.0) * F.lit(s + buckets)) / ((F.col("s") + 1.0) * F.lit(t + buckets))
    return table.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / float(2**32))) * -1000.0)


def weighted(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, copies, n_words, n_features, weight, score for each distinct (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    each = features(rows, ["doc_id", "text_hash"], ngram, buckets).join(F.broadcast(gains(docs, target, ngram, buckets)), "bucket", "left")
    sums = each.groupBy("doc_id", "text_hash").agg(
        F.sum("first").alias("copies"), F.sum("words").alias("words"), F.count("bucket").alias("features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain")
    )
    weight = F.when(F.col("features") > 0, F.floor(F.col("gain") / F.col("features"))).otherwise(F.lit(0)).cast("long")
    per_row = lambda c: F.floor(F.col(c) / F.col("copies")).alias(f"n_{c}")
    found = sums.select("doc_id", "text_hash", "copies", per_row("words"), per_row("features"), weight.alias("weight"))
    return found.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def ranked(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with before: how many copies come before a row's by falling score, doc_id (null last) and text_hash."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("text_hash")]
    parts = store(rows.repartitionByRange(max(1, -(-size // RANGE)), *order).withColumn("part", F.spark_partition_id()), "ranges")
    held = parts.groupBy("part").agg(F.sum("copies").alias("held"))
    offsets = held.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("offset"))  # a row for each range
    inside = F.sum("copies").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    return parts.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("before", F.col("offset") + F.col("inside")).drop("part", "inside", "offset")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) for each row of ``docs``."""
    found = store(weighted(docs, target, ngram, buckets, seed), "weights")
    distinct, n = found.filter(F.col("n_words") >= min_words).agg(F.count("*"), F.sum("copies")).first()
    drawn = percent * (n or 0) // 100
    enough = F.col("n_words") >= min_words
    all_ = ranked(found.filter(enough), distinct).unionByName(found.filter(~enough).withColumn("before", F.lit(drawn).cast("long")))
    lots = all_.withColumn("_lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    rows = lots.withColumn("_copy", F.explode(F.expr(f"sequence(_lot * {COPIES}, least(copies, (_lot + 1) * {COPIES}) - 1)")))
    rank = F.col("before") + F.col("_copy") + 1
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", F.when(enough & (rank <= drawn), rank).alias("rank"))


def resample_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank, all long."""
    return resample(docs, target).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("n_features", "weight", "score", "rank")))


SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
w AS (SELECT src, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM (SELECT 'd' AS src, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark)),
f AS (SELECT src, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
g AS (SELECT f, list_reduce(list_prepend(4294967295, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)) AS c
      FROM (SELECT DISTINCT f FROM f), crc),
b AS (SELECT src, doc_id, xor(c, 4294967295) % 10000 AS bucket FROM f JOIN g USING (f)),
c AS (SELECT bucket, count(*) FILTER (src = 'd')::DOUBLE AS s, count(*) FILTER (src = 'b')::DOUBLE AS t FROM b GROUP BY bucket),
a AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM c),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM b JOIN a USING (bucket) WHERE src = 'd' GROUP BY doc_id),
x AS (SELECT w.doc_id, len(w.w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM w LEFT JOIN m USING (doc_id) WHERE src = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 25 * count(*) OVER () // 100 AS k FROM x WHERE words >= 20)
SELECT x.doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN r <= k THEN r END::BIGINT AS rank
FROM x LEFT JOIN r USING (doc_id)
"""
