"""The byte kernels as SQL functions: ``register(spark)``, then

    SELECT file_id, c.* FROM files, LATERAL chunk_bytes(body, 10) c
    SELECT delta_apply(target, delta_encode(target, body), octet_length(body)) = body FROM pairs
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from chunkloom.config import DedupConfig
from chunkloom.functions import codec
from chunkloom.functions.fingerprint import two_lane
from chunkloom.functions.gear import cdc_spans


@pandas_udf("array<struct<off:long,len:long>>")
def cdc_cuts(body: pd.Series, bits: pd.Series) -> pd.Series:
    return pd.Series([[{"off": o, "len": n} for o, n in cdc_spans(bytes(b or b""), DedupConfig(bits=int(k)))] for b, k in zip(body, bits, strict=True)])


@pandas_udf("binary")
def delta_encode(target: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else codec.encode(bytes(t or b""), bytes(s)) for t, s in zip(target, source, strict=True)])


@pandas_udf("binary")
def delta_apply(target: pd.Series, record: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else codec.apply(None if t is None else bytes(t), bytes(r), int(n)) for t, r, n in zip(target, record, length, strict=True)])


@pandas_udf("long")
def first_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([codec.first_difference(bytes(x or b""), bytes(y or b"")) for x, y in zip(a, b, strict=True)])


@pandas_udf("string")
def fingerprint64(body: pd.Series) -> pd.Series:
    return pd.Series([two_lane(bytes(b or b"")) for b in body])


@udtf(returnType="seq int, off long, len long, fp string")
class ChunkBytes:
    def eval(self, body: bytes, bits: int):
        import hashlib

        body = bytes(body or b"")
        for k, (o, n) in enumerate(cdc_spans(body, DedupConfig(bits=bits))):
            yield k, o, n, hashlib.md5(body[o : o + n], usedforsecurity=False).hexdigest()


@udtf(returnType="k int, op string, off long, len long")
class ParseRecord:
    def eval(self, record: bytes):
        for k, (op, off, n, _) in enumerate(codec.parse(bytes(record or b""))):
            yield k, op, off, n


def register(spark: SparkSession) -> None:
    for name, f in (("cdc_cuts", cdc_cuts), ("delta_encode", delta_encode), ("delta_apply", delta_apply), ("first_diff", first_diff), ("fingerprint64", fingerprint64)):
        spark.udf.register(name, f)
    spark.udtf.register("chunk_bytes", ChunkBytes)
    spark.udtf.register("parse_record", ParseRecord)
