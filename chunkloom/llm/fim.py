"""Fill-in-the-middle: documents cut in three and put together again in another order, for training.

A text is cut at two places given in units (code points, words or lines). Texts may be very long, so no list of units is made: while units
are counted, a sparse index keeps the byte and code-point offset of every ``EVERY``-th unit, in blocks of ``BLOCK`` bytes. A cut is found by
binary search among these checkpoints and a rescan of the units between the checkpoint before it and the cut.

What becomes of a document depends on its id alone: h1 to h4 are the first four 8-digit groups of the hex sha256 of ``<seed>:<doc_id>``.
Cuts are ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units from the start. ``h3`` decides between plain and cut, ``h4`` between the two orders:

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle

A text that is empty or holds one of the three marks stays plain, so that every output can be undone (``restore``).

One map over Arrow batches; no shuffle. A task holds one batch, one block's arrays and a text's checkpoints.

Null texts are empty. A null doc_id counts as no digits. Repeated rows and ids give equal results. Further columns pass through
``fill_in_middle`` where they don't clash with its own, which replace them. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units from one checkpoint to the next; bytes looked at together; bytes of output after which a batch is handed on.
EVERY, BLOCK, OUT = 1024, 1 << 20, 1 << 24
#: Percentage of the other texts that are cut, and of these in the order suffix, prefix, middle.
CUT, SPM, SEED = 90, 20, 1
MARKS = ("<P>", "<S>", "<M>")


def _code_points(x: np.ndarray, before: int) -> np.ndarray:
    return (x & 0xC0) != 0x80


def _words(x: np.ndarray, before: int) -> np.ndarray:
    """A unit begins with the first byte that isn't white space after one that is."""
    blank = (x == 32) | ((x >= 9) & (x <= 13))
    last = np.empty(len(x), bool)
    last[0] = before < 0 or before == 32 or 9 <= before <= 13
    last[1:] = blank[:-1]
    return ~blank & last


def _lines(x: np.ndarray, before: int) -> np.ndarray:
    out = np.empty(len(x), bool)
    out[0] = before < 0 or before == 10
    np.equal(x[:-1], 10, out=out[1:])
    return out


#: For bytes of UTF-8 and the byte before them (-1: none), at which a unit begins.
UNITS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"char": _code_points, "word": _words, "line": _lines}


class Checkpoints:
    """Where units begin: n of them, and the byte and code-point offsets of every ``every``-th."""

    def __init__(self, data: np.ndarray, unit: str = "char", every: int = EVERY, block: int = BLOCK):
        self.data, self.starts, self.every = data, UNITS[unit], every
        numbers, places, points = [], [], []
        n = chars = 0
        for at in range(0, len(data), block):
            x = data[at : at + block]
            begins = np.flatnonzero(self.starts(x, int(data[at - 1]) if at else -1))
            picked = begins[-n % every :: every]
            point = _code_points(x, -1)
            numbers.append(np.arange(n + -n % every, n + len(begins), every))
            places.append(picked + at)
            points.append(chars + _ranks(point, picked))
            n, chars = n + len(begins), chars + int(np.count_nonzero(point))
        empty = [np.empty(0, np.int64)]
        self.n, self.chars = n, chars
        self.numbers, self.bytes, self.points = (np.concatenate(v or empty) for v in (numbers, places, points))

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offsets at which unit ``unit`` begins, from 0; the text's end for the number of units."""
        if unit >= self.n:
            return len(self.data), self.chars
        k = int(np.searchsorted(self.numbers, unit, side="right")) - 1
        at, chars, left = int(self.bytes[k]), int(self.points[k]), unit - int(self.numbers[k])
        step = max(64, 4 * self.every)
        while True:
            x = self.data[at : at + step]
            begins = np.flatnonzero(self.starts(x, int(self.data[at - 1]) if at else -1))
            point = _code_points(x, -1)
            if left < len(begins):
                found = int(begins[left])
                return at + found, chars + int(np.count_nonzero(point[:found]))
            at, chars, left = at + len(x), chars + int(np.count_nonzero(point)), left - len(begins)


def _ranks(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set before each place of ``at``, which ascend."""
    if not len(at):
        return np.empty(0, np.int64)
    edges = np.concatenate([[0], at])
    return np.cumsum([np.count_nonzero(flags[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transformed(doc_id: int | None, data: memoryview, unit: str, every: int, cut: int, spm: int, seed: int, marks: tuple[bytes, bytes, bytes]) -> tuple:
    """n, form, code points of prefix and middle (None if plain) and the parts of the output."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    index = Checkpoints(np.frombuffer(data, np.uint8), unit, every)
    text = bytes(data)
    if not text or h3 % 100 >= cut or any(m in text for m in marks):
        return index.n, "plain", None, None, [text]
    a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (first, c1), (second, c2) = index.cut(a), index.cut(b)
    p, s, m = marks
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm:
        return index.n, "spm", c1, c2 - c1, [s, suffix, p, prefix, m, middle]
    return index.n, "psm", c1, c2 - c1, [p, prefix, s, suffix, m, middle]


RESULTS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}


def fill_in_middle(docs: DataFrame, unit: str = "char", every: int = EVERY, cut: int = CUT, spm: int = SPM, seed: int = SEED, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of ``docs`` without text, with n (units), form, prefix_chars, middle_chars and output."""
    if unit not in UNITS or len(set(marks)) != 3 or not all(marks):
        raise ValueError(f"unit must be one of {sorted(UNITS)}, and marks three different strings")
    if any(m[k:] and other.startswith(m[k:]) for m in marks for other in marks for k in range(1, len(m))):
        raise ValueError("no mark may begin with the end of one")
    others = [c for c in docs.columns if c not in RESULTS and c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("others"))
    coded = tuple(m.encode() for m in marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = held = 0
            out: list[tuple] = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                *about, parts = transformed(doc_id, memoryview(batch.column(1)[i].as_buffer()), unit, every, cut, spm, seed, coded)
                out.append((*about, b"".join(parts)))
                held += len(out[-1][-1])
                if held >= OUT or i + 1 == batch.num_rows:
                    columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), RESULTS.values(), strict=True)]
                    kept = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), *columns], names=["doc_id", "others", *RESULTS])
                    start, held, out = i + 1, 0, []

    schema = f"doc_id long, others {rows.schema['others'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary"
    done = rows.mapInArrow(work, schema)
    return done.select("doc_id", *(F.col("others").getField(c).alias(c) for c in others), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output, from where its marks stand."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.char_length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.char_length(one) + len(second) + 1, F.char_length(rest))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.char_length(two) + len(m) + 1, F.char_length(rest))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def fim_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = fill_in_middle(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS c1, ('0x' || x[9:16])::BIGINT % (n + 1) AS c2,
             ('0x' || x[17:24])::BIGINT % 100 AS h3, ('0x' || x[25:32])::BIGINT % 100 AS h4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                  WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
