"""The earlier recipe a file has most chunks in common with, out of all of them, without pairing all files that share a chunk.

1. Files with the same chunks are one node, named by the least file_id. Within a node the first file is the best recipe of all others but for
   an earlier node that has all their chunks. Chunks of one node only can't be shared and are left out.
2. A good recipe first: of the nodes that are the first with one of a node's chunks, the one that is so most often. How much it really has in common is a lower
   bound L, exact and at least 1.
3. Rarest first: chunks are ordered by the number of nodes that have them. Who has more than L in common with a node of n chunks shares one of the first n - L of them
   (and it is among the other's first n' - L too); who has no more than L chunks can't. The commonest chunks of a node are thus never looked up, however many nodes have them.
   An equally good but earlier recipe may need the chunk behind these; it is looked up only if its first node is earlier than the recipe known.
4. Candidates are compared exactly, by a join on (node, chunk).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.sources.storage import stored


def nodes_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, node, size; node, fp, df, first, size and rank, from the rarest, of what nodes share). ``chunks`` has file_id and fp."""
    distinct = chunks.select("file_id", "fp").distinct()
    h = [F.xxhash64("fp"), F.xxhash64(F.lit(1), "fp")]
    prints = distinct.groupBy("file_id").agg(F.count("*").alias("size"), *(F.bit_xor(x).alias(f"h{i}") for i, x in enumerate(h)))
    alike = prints.groupBy("size", "h0", "h1").agg(F.min("file_id").alias("node"))
    files = stored(prints.join(alike, ["size", "h0", "h1"]).select("file_id", "node", "size"), "nodes")
    own = distinct.join(files.filter("file_id = node").select("file_id"), "file_id", "left_semi").withColumnRenamed("file_id", "node")
    shared = own.groupBy("fp").agg(F.count("*").alias("df"), F.min("node").alias("first")).filter("df > 1")
    w = Window.partitionBy("node")
    sets = own.join(shared, "fp").select("node", "fp", "df", "first", F.count("*").over(w).alias("size"), F.row_number().over(w.orderBy("df", "fp")).alias("rank"))
    return files, stored(sets, "shared-chunks")


def in_common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (node, other) with overlap."""
    mine = pairs.join(sets.select("node", "fp"), "node")
    both = mine.join(sets.select(F.col("node").alias("other"), "fp"), ["other", "fp"])
    return both.groupBy("node", "other").agg(F.count("*").alias("overlap"))


def best_node(sets: DataFrame) -> DataFrame:
    """node, other, overlap: the earlier node with most in common, the first of equally good ones."""
    firsts = sets.filter("first < node").groupBy("node", "first").agg(F.count("*").alias("n"))
    lead = firsts.groupBy("node").agg(F.min_by("first", F.struct((-F.col("n")).alias("n"), "first")).alias("other"))
    known = stored(in_common(lead, sets).withColumnsRenamed({"other": "known", "overlap": "least"}), "known-recipes")
    asked = sets.join(known, "node")
    strict = F.col("rank") <= F.col("size") - F.col("least")
    tie = (F.col("rank") == F.col("size") - F.col("least") + 1) & (F.col("first") < F.col("known"))
    asked = asked.filter(strict | tie).select("fp", "node", "known", "least", strict.alias("strict"))
    there = sets.select("fp", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("rank").alias("other_rank"))
    more = F.when((F.col("other") < F.col("known")) | ~F.col("strict"), F.col("least")).otherwise(F.col("least") + 1)
    fits = (F.col("other") < F.col("node")) & (F.col("other") != F.col("known")) & (F.col("strict") | (F.col("other") < F.col("known")))
    room = (F.col("other_size") >= more) & (F.col("other_rank") <= F.col("other_size") - more + 1)
    pairs = asked.join(there, "fp").filter(fits & room).select("node", "other").distinct()
    found = in_common(pairs, sets).unionByName(known.select("node", F.col("known").alias("other"), F.col("least").alias("overlap")))
    best = F.struct((-F.col("overlap")).alias("less"), "other")
    return found.groupBy("node").agg(F.min(best).alias("b")).select("node", F.col("b.other").alias("other"), (-F.col("b.less")).alias("overlap"))


def best_recipes(chunks: DataFrame) -> DataFrame:
    """file_id, recipe_of and overlap of every file that shares a chunk with an earlier one."""
    files, sets = nodes_of(chunks)
    found = files.join(best_node(sets), "node", "left")
    copy = F.col("file_id") != F.col("node")
    earlier = ~copy | (F.col("overlap") == F.col("size"))
    out = found.select("file_id", F.when(F.col("overlap").isNotNull() & earlier, F.col("other")).when(copy, F.col("node")).alias("recipe_of"), F.when(copy, F.col("size")).otherwise(F.col("overlap")).alias("overlap"))
    return out.filter("recipe_of IS NOT NULL")
