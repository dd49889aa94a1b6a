"""Queries over resemblance: bases found by super-features, and deltas by anchors and by words against both kinds of bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.codec import encode, encode_words
from chunkloom.operators import delta, resemblance
from chunkloom.plans.dedup import gear_sql
from chunkloom.plans.delta import CFG, ROTATED_TURNS, ROTATED_VBLOCKS, blocks, chunks
from chunkloom.plans.registry import query
from chunkloom.sources.storage import stored

TRANSFORMS = ", ".join(f"({i}, {m}, {a})" for i, (m, a) in enumerate(map(resemblance.transform, range(resemblance.FEATURES))))


def distinct(c: DataFrame) -> DataFrame:
    """fp, len, bytes and pos (of the first occurrence by version, file and place), a row for each different chunk that isn't empty."""
    return c.filter("len > 0").groupBy("fp").agg(F.max("len").alias("len"), F.first("bytes").alias("bytes"), F.min(F.struct("version", "file_id", "seq")).alias("pos"))


@query(f"""WITH {ROTATED_VBLOCKS}, k AS (SELECT fp AS file_id, min((version, file_id, seq)) AS pos FROM c GROUP BY fp),
body AS (SELECT DISTINCT c.fp AS file_id, v.body[c.seq * 256 + 1 : c.seq * 256 + c.len] AS body FROM c JOIN versions v USING (file_id, version)), {gear_sql(resemblance.WINDOW_BITS, "body")},
f AS (SELECT file_id AS fp, i, min((h * m + a) & 4294967295) AS v FROM (SELECT DISTINCT file_id, h FROM hashed), (VALUES {TRANSFORMS}) t(i, m, a) GROUP BY ALL),
s AS (SELECT fp, i // {resemblance.EACH} AS g, string_agg(v, ',' ORDER BY i) AS sf FROM f GROUP BY ALL), p AS (SELECT s.*, pos FROM s JOIN k ON k.file_id = s.fp),
heads AS (SELECT g, sf, arg_min(fp, pos) AS t_fp FROM p GROUP BY ALL)
SELECT p.fp, t_fp, count(*) AS matches FROM p JOIN heads USING (g, sf) WHERE p.fp <> t_fp GROUP BY ALL""")
def resembling_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier chunks that share super-features with each different chunk of all versions, whatever file they are of, and how many they share."""
    d = stored(distinct(blocks(spark, sf_dir, ROTATED_TURNS, keep=True)), "distinct")
    return resemblance.candidates(resemblance.super_features(d), d)


CODERS = {"anchors": encode, "words": encode_words}


@query()
def resemblance_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different chunk stored against a base of the version before (around the same place) or one that resembles it, of any file, its delta made
    by anchors or by words: deltas, bytes raw and stored, and how many records don't give their chunk again."""
    c = stored(chunks(spark, sf_dir), "chunks")
    d = stored(delta.different(c), "different")
    by_version = delta.first_pairs(c.drop("bytes"), d, CFG).select("fp", "t_fp", "rank", F.lit(None).cast("int").alias("like"))
    places = d.select("fp", F.struct("version", "file_id", "seq").alias("pos"))
    alike = resemblance.candidates(resemblance.super_features(d), places).join(d.filter(F.col("len") >= CFG.delta_min).select("fp"), "fp", "left_semi")
    # what both kinds of bases have in common is encoded once, by both coders where its bytes are
    pairs = by_version.unionByName(alike.select("fp", "t_fp", F.lit(None).cast("int").alias("rank"), F.lit(0).alias("like")))
    made = delta.measured(pairs.groupBy("fp", "t_fp").agg(F.min("rank").alias("rank"), F.min("like").alias("like")), d, CODERS)
    kinds = F.array(F.struct(F.lit("version").alias("base"), F.col("rank").alias("place")), F.struct(F.lit("resemblance").alias("base"), F.col("like").alias("place")))
    each = made.select("fp", "t_fp", "coder", "rec_len", "same", F.explode(kinds).alias("k")).select("*", "k.*").filter("place IS NOT NULL")
    best = each.groupBy("base", "coder", "fp").agg(F.min_by(F.struct("rec_len", "same"), F.struct("rec_len", "place", "t_fp")).alias("r")).select("base", "coder", "fp", "r.*")
    found = best.join(d.select("fp", "len"), "fp").filter(F.col("rec_len") < (F.col("len") + 1) * CFG.delta_min_ratio)
    sums = found.groupBy("base", "coder").agg(F.count("*").alias("deltas"), F.sum(F.col("len") + 1 - F.col("rec_len")).alias("less"), F.count_if(~F.col("same")).alias("wrong"))
    raw = d.agg(F.count("*").alias("chunks"), F.sum(F.col("len") + 1).alias("raw"))  # one row
    four = spark.createDataFrame([(b, n) for b in ("version", "resemblance") for n in CODERS], "base string, coder string")
    out = four.join(sums, ["base", "coder"], "left").fillna(0, ["deltas", "less", "wrong"]).crossJoin(F.broadcast(raw))
    return out.select("base", "coder", "chunks", "deltas", "raw", (F.col("raw") - F.col("less")).alias("stored"), F.round(F.col("less") / F.col("raw"), 6).alias("saved"), "wrong")
