"""Splitting oversized texts at natural boundaries (problem 3).

Method: every place of a text has a boundary strength.  A sparse table answers range-maximum queries over the strengths,
so the strongest cut in the window of permissible lengths is found in constant time; ties go to the right; the next
piece starts ``overlap_tokens`` before the cut.  Size is the UTF-8 length of a text divided by four, rounded up.

Strengths, from strong to weak: a change of section, a change of block type, a block's end, the end of a list item
or line, the end of a sentence, of a clause, of a word, between any two characters (not before a mark that belongs to the
letter before it, except where nothing else fits).

Behaviour in corner cases: null and empty texts have no piece; a text within the limit is one piece and is only given
when asked for; repeated rows give their pieces once; an overlap that isn't smaller than the limit is an error; null
limits are ignored; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "limit_name string, chunk_id string, piece_no int, start_char int, end_char int, token_estimate int, text string"
MOST_LIMITS = 1000

SECTION, TYPE, BLOCK, ITEM, SENTENCE, CLAUSE, WORD, ANY, MARK = 8, 7, 6, 5, 4, 3, 2, 1, 0
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”»’)\]]*(?:\[\d+\])*\s+(?=[^\W_a-z]|[\"“„«(\[¿¡•-])|[。！？।॥؟]+[”」』）)»]*\s*)")
_CLAUSE = re.compile(r"[,;:،；：，、–—]\s*")
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.category(c) in ("Mn", "Mc") or c == "\u200d") + "]")


def token_estimate(size: int) -> int:
    return -(-size // 4)


def strengths(text: str, blocks: list[tuple[str, str]] | None = None) -> np.ndarray:
    """Strength of a cut before each character; entry 0 and the end are 0 and not used.

    blocks: type and section of the paragraphs in order, where they are known.
    """
    n = len(text)
    out = np.full(n + 1, ANY, dtype=np.int8)

    def put(pattern: re.Pattern | str, level: int) -> None:
        for m in re.finditer(pattern, text):
            if out[m.end()] < level:
                out[m.end()] = level

    put(r"\s+", WORD)
    put(_CLAUSE, CLAUSE)
    put(_SENTENCE, SENTENCE)
    put(r"\n[^\S\n]*", ITEM)
    for k, m in enumerate(re.finditer(r"\n[^\S\n]*\n\s*", text)):
        level = BLOCK
        if blocks and k + 1 < len(blocks):
            level = SECTION if blocks[k][1] != blocks[k + 1][1] else TYPE if blocks[k][0] != blocks[k + 1][0] else ITEM if blocks[k][0] == "list_item" else BLOCK
        out[m.end()] = level
    for m in _MARKS.finditer(text):
        out[m.start()] = min(out[m.start()], MARK)
    out[0] = out[n] = 0
    return out


_GAP = re.compile(r"\n[^\S\n]*\n\s*")
HEAD = 40


def paragraphs(text: str, parts: list[tuple[str, str, str]]) -> list[tuple[str, str]] | None:
    """Type and section of each paragraph of a text, by the blocks (type, section, beginning) that it was put together from.

    A block that has empty lines inside covers several paragraphs; one whose beginning isn't found covers none.
    """
    found: list[tuple[int, str, str]] = []
    at = 0
    for kind, section, head in parts:
        i = text.find(head, at) if head else -1
        if i >= 0:
            found.append((i, kind, section))
            at = i + 1
    if not found:
        return None
    out, k = [], 0
    for start in [0, *(m.end() for m in _GAP.finditer(text))]:
        while k + 1 < len(found) and found[k + 1][0] <= start:
            k += 1
        out.append(found[k][1:])
    return out


class SparseTable:
    """Range-maximum queries over strengths; of equal ones the rightmost is found."""

    def __init__(self, strength: np.ndarray, longest: int) -> None:
        n = len(strength)
        self.n = n
        level = strength.astype(np.int64) * n + np.arange(n)
        self.levels = [level]
        half = 1
        while 2 * half <= min(longest, n):
            level = np.maximum(level[: len(level) - half], level[half:])
            self.levels.append(level)
            half *= 2

    def strongest(self, a: int, b: int) -> int:
        """The place of the maximum in [a, b]."""
        k = (b - a + 1).bit_length() - 1
        row = self.levels[k]
        return int(max(row[a], row[b - (1 << k) + 1])) % self.n


class Text:
    """What all limits need to know of a text, found out once."""

    def __init__(self, text: str, blocks: list[tuple[str, str]] | None = None) -> None:
        self.text, self.blocks = text, blocks
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        #: how many bytes stand before each character
        self.at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])

    @cached_property
    def strengths(self) -> np.ndarray:
        return strengths(self.text, self.blocks)


def cuts(text: str, max_tokens: int, overlap_tokens: int, blocks: list[tuple[str, str]] | None = None, least: float = 0.5, known: Text | None = None) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, end, bytes).  least: share of the limit that a piece fills at least, except the last."""
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("the overlap must be smaller than the limit")
    if not text:
        return []
    known = known or Text(text, blocks)
    at = known.at
    room, back, n = 4 * max_tokens, 4 * overlap_tokens, len(text)
    if at[n] <= room:
        return [(0, n, int(at[n]))]
    table = SparseTable(known.strengths, room + 1)
    out, start, cut = [], 0, 0
    while True:
        last = int(np.searchsorted(at, at[start] + room, side="right")) - 1
        if last >= n:
            out.append((start, n, int(at[n] - at[start])))
            return out
        first = int(np.searchsorted(at, at[start] + max(1, int(room * least))))
        # a piece goes on beyond the last cut; a character wider than the room stays whole
        first = max(min(first, last), cut + 1, start + 1)
        cut = table.strongest(first, max(first, last))
        out.append((start, cut, int(at[cut] - at[start])))
        start = max(int(np.searchsorted(at, at[cut] - back)), start + 1)
        start = min(start, cut)


def _splitter(limits: list[tuple[str, int, int]], whole: bool):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cid, text, parts in zip(b["chunk_id"], b["text"], b["parts"]):
                if not text:
                    continue
                blocks = None if parts is None else paragraphs(text, [(p["block_type"], p["section"], p["head"]) for p in parts])
                known = Text(text, blocks)
                size = int(known.at[-1])
                for name, most, overlap in limits:
                    if size > 4 * most or whole:
                        for k, (s, e, n) in enumerate(cuts(text, most, overlap, known=known)):
                            rows.append((name, cid, k, s, e, token_estimate(n), text[s:e]))
            yield pd.DataFrame(rows, columns=["limit_name", "chunk_id", "piece_no", "start_char", "end_char", "token_estimate", "text"]).astype({"piece_no": "int32", "start_char": "int32", "end_char": "int32", "token_estimate": "int32"})

    return split


def split_pieces(chunks: DataFrame, limits: DataFrame, links: DataFrame | None = None, blocks: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Pieces of ``chunks(chunk_id, text)`` for every row of ``limits(limit_name, max_tokens, overlap_tokens)``.

    links, blocks: source blocks of the chunks, whose types and sections make some boundaries stronger.
    whole: also give the texts that are within the limit, as one piece.  The limits are read to the driver and
    checked to be few.
    """
    rows = limits.where("max_tokens is not null").select("limit_name", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("o")).distinct().limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    todo = sorted((r["limit_name"], int(r["max_tokens"]), int(r["o"])) for r in rows)
    if any(not 0 <= o < m for _, m, o in todo):
        raise ValueError("the overlap must be smaller than the limit")
    texts = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text").where(F.col("text").isNotNull())
    if not whole and todo:
        texts = texts.where(F.octet_length("text") > 4 * min(m for _, m, _ in todo))
    if links is not None and blocks is not None:
        part = F.struct(F.col("source_position").alias("position"), "block_type", "section", "head")
        head = F.substring(F.regexp_replace("text", r"^\s+", ""), 1, HEAD)
        info = blocks.where("length(text) > 0").select("block_id", "block_type", F.concat_ws(" > ", "section_path").alias("section"), head.alias("head"))
        oversized = texts.select("chunk_id").distinct()
        used = links.where("link_type = 'source'").select(F.col("chunk_id").cast("string").alias("chunk_id"), "block_id", "source_position").join(oversized, "chunk_id", "left_semi")
        parts = used.join(info, "block_id").groupBy("chunk_id").agg(F.array_sort(F.collect_set(part)).alias("parts"))
        texts = texts.join(parts, "chunk_id", "left")
    else:
        texts = texts.withColumn("parts", F.lit(None).cast("array<struct<position:int,block_type:string,section:string,head:string>>"))
    # by a number of its own, so that few bytes aren't put into one task
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(tasks, "chunk_id").distinct().mapInPandas(_splitter(todo, whole), PIECES)


def oversized(pieces: DataFrame) -> DataFrame:
    """limit_name, chunk_id of the texts that had to be cut."""
    return pieces.where("piece_no > 0").select("limit_name", "chunk_id").distinct()
