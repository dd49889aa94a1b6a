"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Each stretch of text that no piece can cross is encoded by a score-ordered agenda of adjacent symbol pairs: the pair whose
merged piece scores highest goes first, the leftmost among equals. Symbols outside the vocabulary fall back to bytes. The
ids of each whole text, batch after batch, are compared with the sentencepiece library's; a difference raises.

Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated results. Whole texts are
encoded, however long. One pass, no shuffle; the cache of stretches is bounded by ``CACHE``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import cache
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm.shared import rowwise

MARK = "▁"
#: What words are cut from: also characters like ² that aren't alphabetic.
LETTER = r"[^\W\d_]"
#: Stretches remembered per Python worker, at most twice as many.
CACHE = 300_000
#: Code points up to which an agenda is a list and not a heap.
SHORT = 48


class Remembered(dict):
    """What ``work`` gives for a key, for at most ``CACHE`` keys and as many of the generation before: what is in use moves on, the rest goes."""

    def __init__(self, work: Callable[[str], str]):
        self.work, self.old = work, {}

    def __missing__(self, key: str) -> str:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        x = self[key] = self.old.get(key) or self.work(key)
        return x


class Encoder:
    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.said, score = {}, {}  # piece to decimal id, piece to score
        for i in range(n):
            if lib.is_byte(i):
                self.byte0 = min(i, getattr(self, "byte0", i))
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.said[p := lib.id_to_piece(i)] = str(i)
                score[p] = lib.get_score(i)
        place = {v: k for k, v in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: place[v] for p, v in score.items()}
        self.none = len(place)  # no piece: after all ranks
        self.decimal = list(map(str, range(n)))
        if any(MARK in p[1:] and p.strip(MARK) for p in self.said) or any("\n" in p for p in self.said):
            raise ValueError("pieces of this vocabulary cross word starts or line ends")
        before = {c: set() for c in map(chr, range(33, 127)) if not c.isalnum()}  # the letters that some piece has before a mark
        for p in self.said:
            for a, b in zip(p, p[1:]):
                if b in before and re.match(LETTER, a):
                    before[b].add(a)
        # no piece has such a letter and then such a mark, so none crosses the cut between them
        cuts = [f"(?<![{''.join(sorted(letters))}]){re.escape(c)}" for c, letters in before.items() if letters]
        if apart := "".join(re.escape(c) for c, letters in before.items() if not letters):
            cuts.append(f"[{apart}]")
        # texts are cut with spaces for marks: most then take a byte a character, which is quicker to cut and to look up
        word = f" *+{LETTER}++(?={'|'.join(['[ \\n]', *cuts])})"
        self.split = re.compile(f"{word}| *[^ \\n]+| +|\\n")
        self.check, self.cache = check, Remembered(self.stretch_ids)

    def symbols(self, stretch: str) -> list[str]:
        """Merge adjacent symbols in the order of the agenda: a heap of pairs by rank of score and place, over linked symbols.

        A pair's key is ``rank * n + place``. A key whose pair has been merged since names no pair of that rank any more.
        """
        if len(stretch) <= SHORT:
            return self.few_symbols(stretch)
        rank, s, n = self.rank.get, list(stretch), len(stretch)
        heap = [v * n + i for i, v in enumerate(map(rank, map(add, stretch, stretch[1:]))) if v is not None]
        if not heap:
            return s
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if j < 0 or not s[i] or rank(joined := s[i] + s[j]) != r:
                continue
            s[i], s[j] = joined, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (v := rank(joined + s[k])) is not None:
                    heappush(heap, v * n + i)
            k = before[i]
            if k >= 0 and (v := rank(s[k] + joined)) is not None:
                heappush(heap, v * n + k)
        return [x for x in s if x]

    def few_symbols(self, stretch: str) -> list[str]:
        """The same for short stretches, whose agenda is a list: its least rank is merged where it stands first."""
        rank, none, s = self.rank.get, self.none, list(stretch)
        agenda = [rank(x, none) for x in map(add, stretch, stretch[1:])]
        while agenda and (r := min(agenda)) < none:
            i = agenda.index(r)
            joined = s[i] + s[i + 1]
            s[i : i + 2] = [joined]
            del agenda[i]
            if i:
                agenda[i - 1] = rank(s[i - 1] + joined, none)
            if i < len(agenda):
                agenda[i] = rank(joined + s[i + 1], none)
        return s

    def stretch_ids(self, stretch: str) -> str:
        """Decimal ids joined by commas; spaces stand for marks."""
        said = self.said.get
        return ",".join([said(x) or self.by_bytes(x) for x in self.symbols(stretch.replace(" ", MARK))])

    def by_bytes(self, symbol: str) -> str:
        return ",".join(str(self.byte0 + b) for b in symbol.encode("utf-8", "surrogatepass"))

    def joined(self, text: str) -> str:
        """Decimal ids of a text joined by commas."""
        return ",".join(map(self.cache.__getitem__, self.split.findall(" " + text.replace(MARK, " ")))) if text else ""

    def checked(self, text: str | None) -> tuple[list[int], str]:
        """The ids of a whole text, compared with the library's, and the same in decimal, joined by commas."""
        said = self.joined(text or "")
        if not self.check:
            return list(map(int, said.split(","))) if said else [], said
        ids = self.library.encode(text or "")
        if ",".join(map(self.decimal.__getitem__, ids)) != said:
            raise ValueError(f"encoding of {(text or '')[:80]!r} differs from the library's")
        return ids, said

    def encode(self, text: str | None) -> list[int]:
        return self.checked(text)[0]

    def decode(self, ids: list[int]) -> str:
        """What the ids stand for: pieces with their marks as spaces, byte runs as UTF-8, without the leading mark."""
        lib, out, run = self.library, [], bytearray()
        for i in ids:
            if lib.is_byte(i):
                run.append(i - self.byte0)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append("" if lib.is_control(i) else " ⁇ " if lib.is_unknown(i) else lib.id_to_piece(i))
        out.append(run.decode("utf-8", "replace"))
        said = "".join(out).replace(MARK, " ")
        return said[1:] if ids and not lib.is_byte(ids[0]) and said[:1] == " " else said


@cache
def encoder(path: str, check: bool) -> Encoder:
    return Encoder(path, check)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def piece_digest(docs: DataFrame, model: str, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 for each row of ``docs`` (doc_id, text)."""

    def work(columns: list[list]) -> list[list]:
        enc, n, a, b = encoder(model, check), [], [], []
        for text in columns[1]:
            ids, said = enc.checked(text)
            n.append(len(ids))
            a.append(hashlib.sha256(said.encode()).hexdigest())
            b.append(hashlib.sha256(enc.library.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return [columns[0], n, a, b]

    return rowwise(docs, ["doc_id", "text"], SCHEMA, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def piece_ids(docs: DataFrame, model: str, check: bool = True) -> DataFrame:
    """doc_id and ids, an array of int, for each row of ``docs``."""

    def work(columns: list[list]) -> list[list]:
        enc = encoder(model, check)
        return [columns[0], [enc.encode(t) for t in columns[1]]]

    return rowwise(docs, ["doc_id", "text"], pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), work, "doc_id long, ids array<int>")


def piece_texts(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id and text for each row of ``tokens`` (doc_id, ids): the way back."""

    def work(columns: list[list]) -> list[list]:
        enc = encoder(model, False)
        return [columns[0], [enc.decode(i or []) for i in columns[1]]]

    return rowwise(tokens, ["doc_id", "ids"], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), work, "doc_id long, text string")
