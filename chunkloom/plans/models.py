"""Cost models, dimensions, generated data and report formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.config import ENTRY, DedupConfig
from chunkloom.functions import report
from chunkloom.functions.gear import cdc_spans
from chunkloom.operators import chunking, dedup
from chunkloom.plans.dedup import BLOCKS, blocks
from chunkloom.plans.lifecycle import KEEP, SESSIONS, refs
from chunkloom.plans.registry import query
from chunkloom.sources import generate
from chunkloom.sources.tables import FILES_SQL, files


@query(f"SELECT tb, kb, (tb * 1024 * 1024 * 1024 // kb)::BIGINT AS entries, (tb * 1024 * 1024 * 1024 // kb * {ENTRY})::BIGINT AS index_bytes FROM (SELECT unnest([1, 10, 100, 1000])::BIGINT AS tb), (SELECT unnest([4, 8, 64])::BIGINT AS kb)")
def index_size_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index bytes for so many terabytes in chunks of so many kilobytes."""
    grid = spark.range(1).select(F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 10, 100, 1000)))).alias("tb")).select("tb", F.explode(F.array(*(F.lit(x).cast("long") for x in (4, 8, 64)))).alias("kb"))
    n = F.floor(F.col("tb") * 1024 * 1024 * 1024 / F.col("kb"))
    return grid.select("tb", "kb", n.alias("entries"), (n * ENTRY).alias("index_bytes"))


@query(f"""{BLOCKS}, n AS (SELECT count(DISTINCT file_id) AS f, count(*) AS c FROM chunks) SELECT 'whole index' AS model, (c * {ENTRY})::BIGINT AS ram, c AS random_reads FROM n
UNION ALL SELECT 'entry per file', (f * {ENTRY})::BIGINT, f FROM n UNION ALL SELECT 'entry per segment', (ceil(c / 16) * {ENTRY})::BIGINT, ceil(c / 16)::BIGINT FROM n""")
def index_cost_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory and random reads: an entry for each chunk, each file, each segment of sixteen."""
    n = blocks(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("c")).agg(F.count("*").alias("f"), F.sum("c").alias("c"))
    k = F.ceil(F.col("c") / 16)
    row = lambda name, x: F.struct(F.lit(name).alias("model"), (x * ENTRY).cast("long").alias("ram"), x.cast("long").alias("random_reads"))
    return n.select(F.explode(F.array(row("whole index", F.col("c")), row("entry per file", F.col("f")), row("entry per segment", k))).alias("r")).select("r.*")


@query(f"""{SESSIONS}, v AS (SELECT DISTINCT day, file_id, doc_id FROM backups), l AS (SELECT v.day, v.file_id, octet_length(f.body) AS n, v.doc_id IS DISTINCT FROM lag(v.doc_id) OVER (PARTITION BY v.file_id ORDER BY v.day) AS changed FROM v JOIN files f ON f.file_id = v.doc_id),
u AS (SELECT fp, max(len) AS len FROM refs GROUP BY fp) SELECT 'full' AS strategy, sum(n)::BIGINT AS bytes FROM l UNION ALL SELECT 'incremental', sum(n) FILTER (changed)::BIGINT FROM l UNION ALL SELECT 'dedup', sum(len)::BIGINT FROM u""")
def retention_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month's bytes as full copies, as changed files, as distinct chunks."""
    r = refs(spark, sf_dir)
    per = r.groupBy("file_id", "day", "doc_id").agg(F.sum("len").alias("n"))
    w = Window.partitionBy("file_id").orderBy("day")
    changed = ~F.lag("doc_id").over(w).eqNullSafe(F.col("doc_id"))
    l = per.select("n", changed.alias("changed")).agg(F.sum("n").alias("full"), F.sum(F.when(F.col("changed"), F.col("n"))).alias("inc"))
    d = r.groupBy("fp").agg(F.max("len").alias("len")).agg(F.sum("len").alias("bytes"))
    return l.select(F.lit("full").alias("strategy"), F.col("full").alias("bytes")).unionByName(l.select(F.lit("incremental").alias("strategy"), F.col("inc").alias("bytes"))).unionByName(d.select(F.lit("dedup").alias("strategy"), "bytes"))


@query("SELECT n AS night, n * 2.0::DOUBLE AS logical_tb, round(2.0::DOUBLE + (n - 1) * 2.0::DOUBLE * 0.16::DOUBLE, 6) AS physical_tb FROM (SELECT unnest(range(1, 13))::INT AS n)")
def growth_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve nights of 2 TB, a sixth of it new each night (a formula, not a measurement)."""
    n = F.col("night")
    return spark.range(1, 13).select(F.col("id").cast("int").alias("night")).select("night", (n * 2.0).alias("logical_tb"), F.round(2.0 + (n - 1) * 2.0 * 0.16, 6).alias("physical_tb"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t.name}', {t.share}::DOUBLE, '{t.extension}', '{t.base}', {t.churn}::DOUBLE)" for t in generate.TYPES) + ") AS t(type, share, ext, base, churn)")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles of generated files."""
    return generate.type_dimension(spark)


@query()
def generated_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedup of a generated set of files with versions and copies, by kind. Seeded, so the same each time; tests check its shape."""
    d = generate.dataset(spark, 40, 48)
    c = chunking.cdc_chunks(d.select("file_id", "kind", "version", "body"), DedupConfig(bits=10))
    occ = c.withColumn("ord", F.col("ord") * 4 + F.col("version"))
    return dedup.totals(dedup.occurrences(occ, "kind"), "kind")


@query()
def shift_coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a shifted copy of a megabyte by insert length, mean size and masks, the mean over five seeds: an experiment in parallel tasks."""
    grid = spark.range(5).select((F.col("id") + 1).alias("seed")).select("seed", F.explode(F.array(*(F.lit(x) for x in (0, 137, 1024, 4096)))).alias("insert")).select("*", F.explode(F.array(*(F.lit(x) for x in (10, 12, 13)))).alias("bits")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("normalized"))

    def run(frames):
        for f in frames:
            out = []
            for seed, ins, bits, nc in zip(f["seed"], f["insert"], f["bits"], f["normalized"], strict=True):
                a, b = generate.shifted_pair(int(seed), 1024, int(ins))
                cfg = DedupConfig(bits=int(bits), normalized=bool(nc))
                have = {a[o : o + n] for o, n in cdc_spans(a, cfg)}
                parts = [b[o : o + n] for o, n in cdc_spans(b, cfg)]
                out.append(sum(len(p) for p in parts if p in have) / len(b))
            yield f.assign(coverage=out)

    cov = grid.repartition("seed", "insert", "bits").mapInPandas(run, "seed long, insert int, bits int, normalized boolean, coverage double")
    return cov.groupBy("insert", "bits", "normalized").agg(F.round(F.avg("coverage"), 6).alias("coverage"), F.count("*").alias("runs"))


@query(f"""WITH {FILES_SQL} SELECT file_id, CASE WHEN octet_length(body) >= 1048576 THEN printf('%.1f', octet_length(body) / 1048576.0) || ' MB' WHEN octet_length(body) >= 1024 THEN printf('%.0f', octet_length(body) / 1024.0) || ' KB' ELSE octet_length(body) || ' B' END AS size,
 hex(body[greatest(octet_length(body) - 15, 1) : octet_length(body)]) AS tail, file_id || '@' || (file_id % 30) AS key, printf('file-%03d.%s', file_id + 1, lang) AS name FROM files WHERE octet_length(body) > 0""")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How files are shown: size, last bytes, recipe key, name."""
    n = F.octet_length("body")
    f = files(spark, sf_dir).filter(n > 0)
    # without an id or a language there is no name: format_string would write the word null
    name = F.when(F.col("file_id").isNotNull() & F.col("lang").isNotNull(), F.format_string("file-%03d.%s", F.col("file_id") + 1, F.col("lang")))
    return f.select("file_id", report.byte_size(n).alias("size"), report.hex_window(F.col("body"), n - 1, 16).alias("tail"), report.mark_key(F.col("file_id"), (F.col("file_id") % 30)).alias("key"), name.alias("name"))


@query(f"""WITH {FILES_SQL} SELECT file_id, k::INT AS k, (('0x' || hex(body[k * octet_length(body) // 64 + 1 : k * octet_length(body) // 64 + 1]))::INT & 63) / 63.0::DOUBLE AS shade
FROM files, range(64) t(k) WHERE octet_length(body) > 0""")
def file_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty-four evenly spaced bytes of every file that isn't empty (a picture of it), as shades."""
    f = files(spark, sf_dir).filter(F.octet_length("body") > 0)
    k = f.select("file_id", "body", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    byte = F.conv(F.hex(F.substring("body", (F.floor(F.col("k") * F.octet_length("body") / 64) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return k.select("file_id", "k", (byte.bitwiseAND(F.lit(63)) / 63.0).alias("shade"))


@query(f"""{BLOCKS}, g AS (SELECT lang, count(*) AS n FROM chunks GROUP BY lang), m AS (SELECT *, pow(10, floor(log10(n))) AS p FROM g)
SELECT lang, n, (CASE WHEN n / p <= 1 THEN 1 WHEN n / p <= 2 THEN 2 WHEN n / p <= 5 THEN 5 ELSE 10 END * p)::DOUBLE AS axis, regexp_replace(n::VARCHAR, '(\\d)(?=(\\d{{3}})+$)', '\\1,', 'g') AS shown FROM m""".replace("regexp_replace(n::VARCHAR, '(\\d)(?=(\\d{3})+$)', '\\1,', 'g')", "format('{:,}', n)"))
def axis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a chart's axis ends, and grouped digits."""
    g = blocks(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    return g.select("lang", "n", report.nice_maximum(F.col("n").cast("double")).alias("axis"), report.grouped(F.col("n")).alias("shown"))


@query(f"""{BLOCKS}, g AS (SELECT fp, count(*) AS n, max(len) AS len FROM chunks GROUP BY fp)
SELECT sum(n * len)::BIGINT AS logical, sum(len)::BIGINT AS disk, sum(n)::BIGINT AS refs, count(*) AS uniques, (sum(n * len) - sum(len))::BIGINT AS saved, (count(*) * {ENTRY})::BIGINT AS index_ram, round(sum(n * len)::DOUBLE / sum(len), 6) AS ratio FROM g""")
def live_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance panel of a store: one row."""
    g = dedup.occurrences(blocks(spark, sf_dir))
    all_, one = F.sum(F.col("n") * F.col("len")), F.sum("len")
    return g.agg(all_.alias("logical"), one.alias("disk"), F.sum("n").alias("refs"), F.count("*").alias("uniques"), (all_ - one).alias("saved"), (F.count("*") * ENTRY).alias("index_ram"), F.round(all_ / one, 6).alias("ratio"))


@query("WITH r AS (SELECT l_returnflag AS flag, md5(concat_ws('|', l_partkey, l_suppkey)) AS fp, count(*) AS n FROM lineitem GROUP BY ALL) SELECT flag, sum(n)::BIGINT AS line_rows, count(*) AS distinct_rows, round(sum(n)::DOUBLE / count(*), 6) AS ratio FROM r GROUP BY flag")
def row_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same idea on relational rows: distinct (part, supplier) pairs of line items."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    r = li.groupBy(F.col("l_returnflag").alias("flag"), F.md5(F.concat_ws("|", "l_partkey", "l_suppkey")).alias("fp")).agg(F.count("*").alias("n"))
    return r.groupBy("flag").agg(F.sum("n").alias("line_rows"), F.count("*").alias("distinct_rows"), F.round(F.sum("n") / F.count("*"), 6).alias("ratio"))


assert KEEP
