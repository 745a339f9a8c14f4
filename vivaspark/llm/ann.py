"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of BOOKS full-dimensional
codebooks. Codebooks are learned one after the other on what the earlier ones
leave over (k-means on residuals of a bounded sample), then encoding searches
the sum with a beam, keeping the BEAM best partial sums at each book, so early
choices can be revised. With each code goes the squared norm of its sum.

A query's inner products with all codewords form a lookup table; a code's score
is the sum of BOOKS entries over its stored norm, so a block of codes is scored
by lookups. Equal vectors of a block are one code, however many rows they are.
The best RERANK codes of each block and query, and all that tie with the last
of them, are scored exactly, with the original vectors in double precision;
their rows follow, smallest ids first, and the best K of all blocks stay. A
block holds its vectors beside their codes: fetching those of a shortlist by id
would move a vector for each query and candidate, this one for each query block.

Vectors are dealt by hash into index blocks of about BLOCK rows, a row of the
index each, and queries into blocks of about QUERY_BLOCK; the stated set of
queries meets the index block by block. Index and queries are written to the
shared folder before they meet, so a row is encoded once. So recall does not fall as the index
grows, results do not depend on the layout, and neither side passes through the
driver or is broadcast. Lists by nearest centroid were measured as well: on
unit vectors without clusters 0.95 recall needs seven tenths of them, so they
save less than they cost.

Every row is indexed; only the codebooks come from a sample, of at most SAMPLE
vectors taken by a hash of their id. Defined results: vectors that are null,
empty, zero, of another length than the commonest, or hold null or non-finite
components take no part; rows that repeat a vec_id count as candidates once
each, the query's own id never; ties go to the smaller vec_id; with no more
than K candidates all are returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vivaspark.llm.common import cut, table

BOOKS, WORDS, BEAM = 12, 256, 4
SAMPLE = 8192
RERANK = 1024
QUERY_BLOCK = 4096
BLOCK = 16_384


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class AdditiveQuantiser:
    """Codebooks of shape (books, words, dim), in single precision."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.gram = np.einsum("bwd,cvd->bcwv", books, books)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 7) -> AdditiveQuantiser:
        rng, rest, out = np.random.default_rng(seed), x.astype(np.float32), []
        for _ in range(books):
            centres = _kmeans(rest, words, rounds, rng)
            if len(centres) < words:
                centres = np.concatenate([centres, np.zeros((words - len(centres), x.shape[1]), np.float32)])
            rest = rest - centres[np.argmax(rest @ centres.T - 0.5 * (centres**2).sum(1), axis=1)]
            out.append(centres.astype(np.float32))
        return cls(np.stack(out))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) by beam search, and the squared norms of their sums."""
        n, (books, words, _) = len(x), self.books.shape
        x = x.astype(np.float32)
        codes, norm, dot = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1), np.float32), np.zeros((n, 1), np.float32)
        for b in range(books):
            inner = x @ self.books[b].T  # (n, words)
            cross = sum((self.gram[c, b][codes[:, :, c]] for c in range(b)), np.zeros((n, codes.shape[1], words), np.float32))
            norms = norm[:, :, None] + 2 * cross + np.diagonal(self.gram[b, b])[None, None, :]
            dots = dot[:, :, None] + inner[:, None, :]
            error = (norms - 2 * dots).reshape(n, -1)
            keep = np.argpartition(error, min(beam, error.shape[1]) - 1, axis=1)[:, :beam]
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, keep // words], (keep % words)[:, :, None].astype(np.uint8)], axis=2)
            norm, dot = norms.reshape(n, -1)[rows, keep], dots.reshape(n, -1)[rows, keep]
        best = np.argmin(norm - 2 * dot, axis=1)
        return codes[np.arange(n), best], norm[np.arange(n), best]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products (queries, books, words)."""
        return np.einsum("qd,bwd->qbw", queries.astype(np.float32), self.books)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of usable vectors of one length as doubles."""
    return column.flatten().to_numpy().reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that may take part, by built-in functions."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter(v.isNotNull() & F.col("vec_id").isNotNull() & sound)


def train(vectors: DataFrame, dim: int, sample: int = SAMPLE) -> AdditiveQuantiser:
    """Codebooks from at most `sample` unit vectors, chosen by a hash of vec_id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    x = _matrix(rows.column("embedding").combine_chunks(), dim)
    return AdditiveQuantiser.fit(x / np.linalg.norm(x, axis=1, keepdims=True))


INDEX = T.StructType([T.StructField(n, T.BinaryType()) for n in ("ids", "vectors", "codes", "norms")])


def _in_blocks(vectors: DataFrame, blocks: int) -> DataFrame:
    """block, vec_id and embedding, the rows of a block together in order of their ids."""
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).alias("block"), "vec_id", "embedding")
    return dealt.repartition(blocks, "block").sortWithinPartitions("block", "vec_id")


def _runs(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """vec_id and vectors of each block, from rows sorted by block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None
    for b in batches:
        block, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim)
        for own in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            if len(own):
                if held and block[own[0]] != last:
                    yield tuple(np.concatenate(c) for c in zip(*held))
                    held = []
                last = block[own[0]]
                held.append((ids[own], x[own]))
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def index(vectors: DataFrame, quantiser: AdditiveQuantiser, blocks: int) -> DataFrame:
    """A row a block: ids, vectors, codes and their squared norms, as bytes."""
    shared, dim = vectors.sparkSession.sparkContext.broadcast(quantiser.books), quantiser.books.shape[2]

    def run(batches):
        aq = AdditiveQuantiser(shared.value)
        for ids, x in _runs(batches, dim):
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes, norms = (np.concatenate(c) for c in zip(*(aq.encode(unit[at : at + 1024]) for at in range(0, len(x), 1024))))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (ids, x, codes, norms.astype(np.float32))], names=INDEX.names)

    return _in_blocks(vectors, blocks).mapInArrow(run, INDEX)


def query_blocks(queries: DataFrame, dim: int, blocks: int) -> DataFrame:
    """A row a block of queries: their ids and vectors, as bytes."""

    def run(batches):
        for ids, x in _runs(batches, dim):
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["q_ids", "q_vectors"])

    return _in_blocks(queries, blocks).mapInArrow(run, "q_ids binary, q_vectors binary")


def nearest_of_block(aq: AdditiveQuantiser, vec: np.ndarray, x: np.ndarray, code: np.ndarray, norm: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec_id, score) of the k best rows of an index block for each query."""
    # Equal vectors are searched as one; its members follow by id. No id but the query's own is left out,
    # so `spare` more than wanted is enough, the most rows of one id.
    spare = int(np.unique(vec, return_counts=True)[1].max())
    _, which = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((vec, which))
    group = which[order]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.minimum(np.diff(np.append(start, len(group))), k + spare)
    vec, one = vec[order], order[start]
    x, code, norm = x[one], code[one], norm[one]
    length, unit = np.linalg.norm(x, axis=1), queries / np.linalg.norm(queries, axis=1, keepdims=True)
    out: list[tuple] = []
    for at in range(0, len(ids), 128):
        lut = aq.tables(unit[at : at + 128])
        approx = sum(lut[:, b, :][:, code[:, b]] for b in range(code.shape[1])) / np.sqrt(np.maximum(norm, 1e-12))
        m = min(rerank + spare, len(x))
        least = np.partition(approx, len(x) - m, axis=1)[:, len(x) - m]
        for i in range(len(approx)):
            # All that tie with the last are scored exactly too.
            rows = np.flatnonzero(approx[i] >= least[i])
            q = queries[at + i]
            exact = (x[rows] * q).sum(1) / (length[rows] * np.sqrt((q * q).sum()))
            if len(rows) > k + spare:
                best = exact >= np.partition(exact, -(k + spare))[-(k + spare)]
                rows, exact = rows[best], exact[best]
            n = count[rows]
            member = vec[np.repeat(start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            score = np.repeat(exact, n)[member != ids[at + i]]
            member = member[member != ids[at + i]]
            best = np.lexsort((member, -score))[:k]
            out.append((np.full(len(best), ids[at + i]), member[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _partitions(spark: SparkSession, blocks: int, most: int) -> int:
    """As many partitions as there are blocks or cores, and no more than need be for `most` blocks each."""
    return min(blocks, max(spark.sparkContext.defaultParallelism, blocks // most))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest found for each query row."""
    spark, names = vectors.sparkSession, "query_id long, vec_id long, score double"
    vectors, queries = usable(vectors), usable(queries)
    sizes = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        found = spark.createDataFrame([], names)
    else:
        dim = sizes.d
        vectors, queries = vectors.filter(F.size("embedding") == dim), queries.filter(F.size("embedding") == dim)
        # Of rows that share a query id, one asks: that of the smallest vector.
        queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        quantiser = train(vectors, dim)
        shared = spark.sparkContext.broadcast(quantiser.books)
        blocks, q_blocks = max(1, -(-sizes["count"] // BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
        # Both sides are written once, so each row is encoded once, however many query blocks it meets. A task is a
        # pair of partitions: several blocks each where there are many, whatever the shuffles had.
        built = cut(index(vectors, quantiser, blocks).coalesce(_partitions(spark, blocks, 64)))
        wanted = cut(query_blocks(queries, dim, q_blocks).coalesce(_partitions(spark, q_blocks, 16)))
        pairs = built.hint("shuffle_replicate_nl").crossJoin(wanted)

        def run(batches):
            aq = AdditiveQuantiser(shared.value)
            for b in batches:
                for at in range(b.num_rows):
                    ids, x, codes, norms, q_ids, q = (c[at].as_buffer() for c in b.columns)
                    x, q = np.frombuffer(x, np.float64).reshape(-1, dim), np.frombuffer(q, np.float64).reshape(-1, dim)
                    code = np.frombuffer(codes, np.uint8).reshape(len(x), -1)
                    got = nearest_of_block(aq, np.frombuffer(ids, np.int64), x, code, np.frombuffer(norms, np.float32), np.frombuffer(q_ids, np.int64), q, k, rerank)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

        found = pairs.mapInArrow(run, names)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))
