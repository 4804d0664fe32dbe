"""Filling fixed-capacity containers with items (problem 6).

Method: best-fit decreasing.  A segment tree over the remaining capacities finds the tightest open container in
logarithmic time per item.  The items are dealt by hash into groups of a bounded number of tokens, each packed by
one task; what the groups' last, poorly filled containers hold is packed again in common, so that grouping costs little space.

Sizes are tokens of a public tokenizer (a ``.tiktoken`` file of ranks, by its path).  Only an item larger than the capacity
is divided: into pieces of exactly the capacity and a rest.

Behaviour in corner cases: null and empty texts have no tokens and get no container; repeated rows are packed once; ties
in size go to the smaller id; containers of a null or non-positive capacity are ignored; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tasks import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public tokenizer splits a text before its merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_CONTAINERS = 1000

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a file of ranks, once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _counter(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(encode(t)) for t in b["text"]]}).astype({"tokens": "int64"})

    return count


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens of the texts that aren't null or empty."""
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("length(text) > 0")).mapInPandas(_counter(tokenizer), "doc_id long, tokens long")


class Remaining:
    """Segment tree over remaining capacities: which open container has the least room that is enough."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)
        self.open: dict[int, list[int]] = {}

    def _add(self, room: int, d: int) -> None:
        i = room + self.width
        while i:
            self.tree[i] += d
            i >>= 1

    def put(self, room: int, container: int) -> None:
        if room:
            self.open.setdefault(room, []).append(container)
            self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and gives (room, container) of the tightest container with room for ``size``."""
        tree, i = self.tree, size + self.width
        if not tree[i]:
            # up until a right neighbour has an open container, then down to its leftmost one
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i *= 2
                if not tree[i]:
                    i += 1
        room = i - self.width
        container = self.open[room].pop()
        self._add(room, -1)
        return room, container


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each size; the sizes must be in decreasing order and at most the capacity."""
    tree = Remaining(capacity)
    out, n = [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            room, container, n = capacity, n, n + 1
        else:
            room, container = found
        out.append(container)
        tree.put(room - size, container)
    return out


PACKED = "container_name string, capacity long, grp long, container_no long, doc_id long, piece_no long, start_token long, tokens long"


def _pack(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True])
    g["container_no"] = best_fit_decreasing(g["tokens"].tolist(), int(g["capacity"].iloc[0]))
    return g[["container_name", "capacity", "grp", "container_no", "doc_id", "piece_no", "start_token", "tokens"]].astype({"container_no": "int64"})


def pack(counts: DataFrame, containers: DataFrame, group_tokens: int = 16_000_000, group_rows: int = 500_000, poor: float = 0.98) -> DataFrame:
    """container_name, container_id, doc_id, piece_no, start_token, tokens: every token of ``counts(doc_id, tokens)`` in a
    container of each kind of ``containers(container_name, capacity_tokens)``.

    group_tokens, group_rows: tokens and items that one task packs, about; poor: containers filled less than this are packed again in groups of
    that size.
    """
    rows = containers.where("capacity_tokens > 0").select("container_name", "capacity_tokens").distinct().limit(MOST_CONTAINERS + 1).collect()
    if len(rows) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} kinds of container")
    kinds = F.array(*(F.struct(F.lit(r["container_name"]).alias("container_name"), F.lit(int(r["capacity_tokens"])).cast("long").alias("capacity")) for r in rows)) if rows else F.array().cast("array<struct<container_name:string,capacity:bigint>>")
    counts = counts.where("tokens > 0").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    total, number = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // group_tokens), -(-number // group_rows))
    items = counts.withColumn("k", F.explode(kinds)).select("k.*", "doc_id", "tokens")
    starts = F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.col("capacity"))
    items = items.select("container_name", "capacity", "doc_id", F.col("tokens").alias("size"), F.posexplode(starts).alias("piece_no", "start_token"))
    items = items.withColumn("tokens", F.least("capacity", F.col("size") - F.col("start_token"))).withColumn("piece_no", F.col("piece_no").cast("long"))
    # two texts of one id differ in size
    full = items.where("tokens = capacity").withColumn("container_id", F.concat_ws("-", F.lit("whole"), "doc_id", "size", "piece_no"))
    rest = items.where("tokens < capacity").withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    result = ["container_name", "container_id", "doc_id", "piece_no", "start_token", "tokens"]
    first = rest.groupBy("container_name", "grp").applyInPandas(_pack, PACKED)
    if groups == 1:
        packed = first.withColumn("container_id", F.concat_ws("-", F.lit("0"), "container_no"))
        return full.select(*result).unionByName(packed.select(*result))
    first = first.persist(StorageLevel.MEMORY_AND_DISK)
    fill = first.groupBy("container_name", "grp", "container_no").agg((F.sum("tokens") < poor * F.first("capacity")).alias("poor"))
    marked = first.join(fill, ["container_name", "grp", "container_no"])
    good = marked.where("not poor").withColumn("container_id", F.concat_ws("-", F.lit("0"), "grp", "container_no"))
    left = marked.where("poor").drop("poor", "container_no")
    by = left.groupBy("container_name").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    most, number = by.agg(F.coalesce(F.max("tokens"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    again = left.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(max(1, -(-most // group_tokens), -(-number // group_rows))))).groupBy("container_name", "grp").applyInPandas(_pack, PACKED)
    again = again.withColumn("container_id", F.concat_ws("-", F.lit("1"), "grp", "container_no"))
    return full.select(*result).unionByName(good.select(*result)).unionByName(again.select(*result))


def summary(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container_name, containers, tokens, fill: how full the containers are."""
    by = packed.groupBy("container_name").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return by.join(containers.select("container_name", "capacity_tokens").distinct(), "container_name").select(
        "container_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill")
    )
