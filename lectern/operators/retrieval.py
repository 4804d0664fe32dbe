"""Vector and keyword retrieval, rank fusion and coverage."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import WORDS

MODES = ("vector", "keyword", "hybrid")
COVERED, WEAK = 0.75, 0.60
CANDIDATES, MOST = 20, 50
FUSION = 60
#: What a user is told by the level of coverage.
MESSAGES = {"covered": "The paper covers this topic.", "weak": "The paper may only touch on this topic.", "absent": "The paper does not seem to cover this topic."}


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null for a vector of length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def valid_vector(v: Column, dim: int) -> Column:
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _nearest(sent, k: int):
    """Keeps the ``k`` nearest rows of each query, batch by batch, with one matrix product each."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        kept = [np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int64)]
        for b in batches:
            if not len(b):
                continue
            v = np.stack(b["embedding"].to_numpy()).astype(np.float64)
            norm = np.sqrt((v * v).sum(axis=1))
            for a in range(0, len(v), 4096):
                n = norm[a : a + 4096]
                s = q @ np.divide(v[a : a + 4096], n[:, None], where=n[:, None] > 0, out=np.zeros_like(v[a : a + 4096])).T
                s[:, n == 0] = np.nan
                s = np.concatenate([kept[0], s], axis=1)
                i = np.concatenate([kept[1], np.broadcast_to(b["vec_id"].to_numpy(np.int64)[a : a + 4096], (len(ids), len(n)))], axis=1)
                # by similarity to nine digits, then by id; vectors of length zero come last and are dropped
                order = np.lexsort((i, -np.round(s, 9)), axis=1)[:, :k]
                kept = [np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)]
        s, i = kept
        r, c = np.nonzero(~np.isnan(s))
        yield pd.DataFrame({"query_id": np.asarray(ids, dtype=np.int64)[r], "vec_id": i[r, c], "similarity": s[r, c]})

    return find


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k nearest vectors of each query, exactly.

    vectors(vec_id, embedding), queries(query_id, embedding), ids are numbers.  A stated query set goes against all rows: ``block``
    queries at once are broadcast, every task keeps k rows of each, and a window merges the tasks.  Vectors that are null, of
    another width than the queries or of length zero have no similarity; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    out = None
    rows = queries.where(F.col("embedding").isNotNull()).orderBy("query_id").toLocalIterator()
    while some := list(itertools.islice(rows, block)):
        q = np.array([r["embedding"] for r in some], dtype=np.float64)
        norm = np.sqrt((q * q).sum(axis=1, keepdims=True))
        use = norm[:, 0] > 0
        sent = spark.sparkContext.broadcast(([r["query_id"] for r, u in zip(some, use) if u], q[use] / norm[use]))
        usable = vectors.where((F.size("embedding") == q.shape[1]) & F.forall("embedding", lambda x: x.isNotNull())).select("vec_id", "embedding")
        found = usable.mapInPandas(_nearest(sent, k), "query_id long, vec_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scoped(chunks: DataFrame, embeddings: DataFrame, documents: DataFrame, queries: DataFrame, model: str, dim: int, limit: int = 5) -> DataFrame:
    """query_id, chunk_id, similarity, rank: a user's own passages nearest to a question.

    chunks(chunk_id, document_id), embeddings(chunk_id, model_name, embedding), documents(document_id, user_id), queries(query_id,
    user_id, document_id or null for all of the user's, embedding).  Another user's document gives nothing.  Ties go by chunk_id.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    vectors = embeddings.where((F.col("model_name") == model) & valid_vector(F.col("embedding"), dim)).select("chunk_id", "embedding")
    own = chunks.select("chunk_id", "document_id").join(vectors, "chunk_id").join(documents.select("document_id", "user_id").distinct(), "document_id")
    q = queries.where(valid_vector(F.col("embedding"), dim)).select("query_id", "user_id", F.col("document_id").alias("within"), F.col("embedding").alias("q"))
    # questions to one document meet that document only
    narrow = own.join(q.where("within is not null").withColumnRenamed("within", "document_id"), ["user_id", "document_id"])
    wide = own.join(q.where("within is null").drop("within"), "user_id")
    hits = narrow.unionByName(wide).select("query_id", "chunk_id", cosine(F.col("q"), F.col("embedding")).alias("similarity")).where("similarity is not null")
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


class Cells:
    """An approximate index: vectors by the nearest of some centres, of which a search looks at the nearest few.

    The centres are fitted on at most ``sample`` vectors, chosen by a hash of their id; every vector is indexed.
    """

    def __init__(self, vectors: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 5) -> None:
        picked = vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        v = np.array([r["embedding"] for r in picked], dtype=np.float64)
        v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
        r = np.random.default_rng(seed)
        self.centres = v[r.permutation(len(v))[:cells]]
        for _ in range(rounds):
            own = (v @ self.centres.T).argmax(axis=1)
            for c in range(len(self.centres)):
                if (own == c).any():
                    m = v[own == c].mean(axis=0)
                    self.centres[c] = m / max(1e-12, float(np.sqrt(m @ m)))

    def assign(self, vectors: DataFrame, most: int = 1) -> DataFrame:
        """vectors with ``cell``: each row under its ``most`` nearest centres."""
        centres = self.centres

        def f(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()).astype(np.float64) @ centres.T
            return pd.Series(list(np.argsort(-x, axis=1, kind="stable")[:, :most].astype(np.int32)))

        return vectors.withColumn("cell", F.explode(F.pandas_udf(f, "array<int>")(F.col("embedding"))))

    def search(self, indexed: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, vec_id, similarity, rank among the rows of the ``probes`` nearest cells."""
        q = self.assign(queries.select("query_id", "embedding"), probes).withColumnRenamed("embedding", "q")
        hits = indexed.join(q, "cell").select("query_id", "vec_id", cosine(F.col("q"), F.col("embedding")).alias("similarity")).where("similarity is not null")
        w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "vec_id")
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """recall: the share of the exact neighbours that a search found."""
    e = exact.select("query_id", "vec_id")
    hit = e.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy().agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def coverage(evidence: DataFrame) -> DataFrame:
    """query_id, best, level from evidence(query_id, similarity)."""
    level = F.when(F.col("best") >= COVERED, "covered").when(F.col("best") >= WEAK, "weak").otherwise("absent")
    return evidence.groupBy("query_id").agg(F.max("similarity").alias("best")).withColumn("level", level)


def keyword_hits(passages: DataFrame, terms: list[str]) -> DataFrame:
    """chunk_id, hits: positions of any of the terms in passages(chunk_id, text); passages without one are left out."""
    terms = [t.lower() for t in dict.fromkeys(terms)][:64]
    if not terms:
        return passages.select("chunk_id", F.lit(0).cast("long").alias("hits")).where(F.lit(False))
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)), lambda w: w.isin(*terms))
    return passages.select("chunk_id", F.size(found).cast("long").alias("hits")).where("hits > 0")


def fuse(rankings: DataFrame, k: int = 60) -> DataFrame:
    """item, score, methods, rank by reciprocal rank fusion of rankings(list_no, pos, item, method); ties in first-seen order."""
    if k < 1:
        raise ValueError("k must be at least 1")
    first = rankings.groupBy("list_no", "item", "method").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("list_no").orderBy("pos", "item")))
    fused = ranked.groupBy("item").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"),
        F.min(F.struct("list_no", "rank")).alias("seen"),
        F.transform(F.array_sort(F.collect_set(F.struct("list_no", "method"))), lambda s: s["method"]).alias("methods"),
    )
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seen", "item"))).select("item", "score", "methods", "rank")


def search(vectors: DataFrame, passages: DataFrame, query: DataFrame, terms: list[str], mode: str = "vector", k: int = 20, keyword_may_fail: bool = True) -> DataFrame:
    """item, score, methods, rank for one question, by its vector, its words, or both.

    vectors(vec_id, embedding) and passages(chunk_id, text) share their ids; query(query_id, embedding) has one row.  A hybrid search whose
    words can't be searched goes by the vector alone, unless ``keyword_may_fail`` is off; a blank question finds nothing by words.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    spark = vectors.sparkSession
    none = "query_id long, item string, {} double, rank int"
    by_vector = spark.createDataFrame([], none.format("similarity")) if mode == "keyword" else top_k(vectors, query, CANDIDATES).select("query_id", F.col("vec_id").cast("string").alias("item"), "similarity", "rank")
    by_word = spark.createDataFrame([], none.format("rank_score"))
    if mode != "vector":
        try:
            top = keyword_hits(passages, terms).orderBy(F.desc("hits"), "chunk_id").limit(CANDIDATES)
            by_word = top.crossJoin(F.broadcast(query.select(F.col("query_id").cast("long").alias("query_id")).limit(1))).select("query_id", F.col("chunk_id").cast("string").alias("item"), (F.col("hits") * 0.1).alias("rank_score"), F.row_number().over(Window.orderBy(F.desc("hits"), "chunk_id")).alias("rank"))
        except Exception:
            if mode == "keyword" or not keyword_may_fail:
                raise
            mode = "vector"
    return ranked(by_vector, by_word, mode, k).select("item", "score", "methods", "rank")


def ranked(vector_hits: DataFrame, keyword_hits: DataFrame, mode: str = "vector", k: int = 20) -> DataFrame:
    """query_id, item, score, methods, rank, vector_similarity, keyword_score of questions searched by vector, by words, or both.

    vector_hits(query_id, item, similarity, rank), keyword_hits(query_id, item, rank_score, rank).  Of each list the first
    ``CANDIDATES`` count; k is cut to 1 to ``MOST``.  A hybrid score is the reciprocal rank fusion, ties in first-seen order.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    k = max(1, min(MOST, k))
    v = vector_hits.where(F.col("rank") <= CANDIDATES).select("query_id", "item", F.col("similarity").alias("vector_similarity"), F.col("rank").alias("v"))
    w = keyword_hits.where(F.col("rank") <= CANDIDATES).select("query_id", "item", F.col("rank_score").alias("keyword_score"), F.col("rank").alias("w"))
    if mode == "vector":
        both = v.withColumn("keyword_score", F.lit(None).cast("double")).withColumn("w", F.lit(None).cast("int"))
    elif mode == "keyword":
        both = w.withColumn("vector_similarity", F.lit(None).cast("double")).withColumn("v", F.lit(None).cast("int"))
    else:
        both = v.join(w, ["query_id", "item"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (FUSION + F.col(c)), F.lit(0.0))
    score = {"vector": F.col("vector_similarity"), "keyword": F.col("keyword_score"), "hybrid": F.round(part("v") + part("w"), 12)}[mode]
    methods = F.array_compact(F.array(F.when(F.col("v").isNotNull(), "vector"), F.when(F.col("w").isNotNull(), "keyword")))
    both = both.withColumn("score", score).withColumn("methods", methods)
    seen = [F.col("v").asc_nulls_last(), F.col("w").asc_nulls_last()]
    order = [F.desc("score"), *seen] if mode == "hybrid" else seen
    n = Window.partitionBy("query_id").orderBy(*order, "item")
    return both.withColumn("rank", F.row_number().over(n)).where(F.col("rank") <= k).select("query_id", "item", "score", "methods", "rank", "vector_similarity", "keyword_score")


def best_score(evidence: DataFrame, mode: str) -> DataFrame:
    """query_id, best: what tells how well a question is covered: the first hit's score by words, else the best similarity."""
    best = F.min_by("keyword_score", "rank") if mode == "keyword" else F.max("vector_similarity")
    return evidence.groupBy("query_id").agg(best.alias("best"))
