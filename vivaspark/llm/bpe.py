"""BPE encoding by a distinct-word table, and decoding by an id-to-piece join.

A text's ids are those of its white-space separated words in order, so words
are encoded, not texts:

1. Tasks split their texts and count the words; the counts are summed by word.
   The commonest words that fit a fixed bound (number and bytes) form the hot
   table: each is encoded once, and the table is broadcast.
2. Every text becomes a compressed array of word numbers, by frequency, in which
   words outside the hot table are holes.
3. Those words travel as (word, row key, position), partitioned by word, so
   each distinct one is encoded once, and their ids join back to the arrays by
   row key and position.
4. Ids join the table of pieces, a row for each id of the vocabulary, and the
   pieces of a text are joined in order.

What is broadcast never grows with the corpus. A task hands on the counts of
words that it met twice or more among RUN distinct ones: all other words are
met once in so many, which no key of a shuffle feels, and are most of the rows.
Counts choose which words are hot, which changes cost and never results.
Words are looked up and put back as Arrow and numpy columns, not one by one;
texts are worked in blocks of bytes, so a task's memory is that of a block or
of its longest text.

Defined results: null and blank texts have no ids and decode to the empty
text; repeated rows give repeated results; an empty table gives an empty
table; kept columns pass through untouched, whatever their name, but for the
columns that the result adds, which replace them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vivaspark.llm import wordtok
from vivaspark.llm.common import give_back, small_batches, table

#: Bytes of text that are split into words at a time, and of packed arrays that are put together at a time.
BLOCK, PACKED = 4 << 20, 1 << 20
#: Distinct words that a task counts together.
RUN = 1 << 19


def _blocks(batches: Iterator[pa.RecordBatch], column: int = -1, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the values of a text or binary column have about `most` bytes."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.columns[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, end - at)
            at = end
            pa.default_memory_pool().release_unused()


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and where each text's words end; empty ones come with blanks at an end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    return lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _encoded(words: pa.Array, tok) -> pa.Array:
    return pa.array([e.ids for e in tok.encode_batch_fast(words.to_pylist(), add_special_tokens=False)], pa.list_(pa.int32()))


def _ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[0] : starts[0] + sizes[0]], then the next, in one array."""
    ends = np.cumsum(sizes)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _placed(places: pa.Array, ids: pa.Array, kind: str) -> pa.Array:
    """Each place, in two numbers, and the ids that belong there, as bytes."""
    n = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends, base = np.cumsum(n), 1 << 16
    out, at = np.empty(int(ends[-1]), kind), places.to_numpy()
    own = np.ones(len(out), bool)
    own[ends - n] = own[ends - n + 1] = False
    out[ends - n], out[ends - n + 1], out[own] = at % base, at // base, pc.list_flatten(ids).to_numpy()
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.dtype(kind).itemsize * ends]).astype(np.int32)), pa.py_buffer(out)])


def _digests(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> word and n of the words met twice or more among RUN distinct ones; the empty word stands for all words."""
    held: list[pa.Table] = []
    size = total = 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

    def often(t: pa.Table) -> list[pa.RecordBatch]:
        return t.filter(pc.and_(pc.greater_equal(t.column("n"), 2), pc.not_equal(t.column("word"), ""))).to_batches()

    for b in _blocks(batches):
        words, _ = _words(b.column(0))
        seen = pc.value_counts(words)
        total += len(words) - (pc.sum(pc.equal(words, "")).as_py() or 0)
        held.append(pa.table({"word": seen.field(0), "n": seen.field(1)}))
        size += len(seen)
        if size > 2 * RUN:
            held = [merged()]
            size = held[0].num_rows
            if size > RUN:
                yield from often(held[0])
                held, size = [], 0
    if held:
        yield from often(merged())
    yield pa.RecordBatch.from_pydict({"word": [""], "n": [total]})


def hot_table(docs: DataFrame, tokenizer: str, most_words: int, most_bytes: int) -> tuple[pa.Table, int]:
    """word and ids of the commonest words, commonest first, at most most_words of them and most_bytes of text;
    and about how many times the texts have other words.

    One query: the counts by word are shuffled once and read twice, for the
    sizes of their levels (a few hundred whatever the corpus) and for the words
    of the levels that fit.
    """
    level = F.when(F.col("word") != "", F.floor(F.log2("n") * 8).cast("int"))
    counts = docs.select("text").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).withColumn("level", level)
    steps = counts.groupBy("level").agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes"), F.sum("n").alias("times"))
    down = Window.orderBy(F.desc_nulls_last("level"))
    fits = F.col("level").isNotNull() & (F.sum("words").over(down) <= most_words) & (F.sum("bytes").over(down) <= most_bytes)
    steps = steps.select("level", "times", fits.alias("fits"))

    def encode_words(batches):
        tok = wordtok.load(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _encoded(b.column(0), tok)], names=["word", "n", "ids"])

    hot = counts.join(F.broadcast(steps.filter("fits").select("level")), "level").select("word", "n").mapInArrow(encode_words, "word string, n long, ids array<int>")
    rare = F.sum(F.when(F.col("level").isNull(), F.col("times")).when(F.col("fits"), -F.col("times")).otherwise(0))
    rest = steps.agg(F.lit(None).cast("string").alias("word"), F.coalesce(rare, F.lit(0)).cast("long").alias("n"), F.lit(None).cast("array<int>").alias("ids"))
    found = hot.union(rest).toArrow().combine_chunks()
    missing = pc.is_null(found.column("word"))
    rare = pc.sum(found.filter(missing).column("n")).as_py()
    known = found.filter(pc.invert(missing))
    if known.num_rows:
        known = known.take(np.lexsort((pc.rank(known.column("word")).to_numpy(), -known.column("n").to_numpy())))
    return known.select(["word", "ids"]).combine_chunks(), int(rare or 0)


def _stream(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", column.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(pa.RecordBatch.from_arrays([column], names=["x"]))
    return sink.getvalue().to_pybytes()


def _array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class _Lookup:
    """The hot words in a task. Number 0 is the empty word, without ids; `hole` marks other words."""

    def __init__(self, blob: bytes):
        words = _array(pa.ipc.open_stream(blob).read_all().column(0))
        self.hole = len(words) + 1
        # Of words that share a digest the commonest is known; the others are holes.
        self.digest, first = np.unique(_digests(words), return_index=True)
        self.words, self.number = words.take(pa.array(first)), (first + 1).astype(np.int32)

    def numbers(self, words: pa.Array) -> np.ndarray:
        runs = pc.dictionary_encode(words)
        own = runs.dictionary
        if not len(self.digest):
            found = np.full(len(own), self.hole, np.int32)
        else:
            at = np.minimum(np.searchsorted(self.digest, _digests(own)), len(self.digest) - 1)
            same = pc.equal(own, self.words.take(pa.array(at))).to_numpy(zero_copy_only=False)
            found = np.where(same, self.number[at], self.hole)
        empty = pc.equal(own, "").to_numpy(zero_copy_only=False)
        return np.where(empty, 0, found)[runs.indices.to_numpy()]


@lru_cache(maxsize=1)
def _lookup(call: str, shared) -> _Lookup:
    """One for a Python process and call of the encoder."""
    return _Lookup(shared.value)


class _Ids:
    """The hot words' ids in a task: values[starts[n] : starts[n] + sizes[n]] are those of number n."""

    def __init__(self, blob: bytes):
        lists = _array(pa.ipc.open_stream(blob).read_all().column(0))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.sizes = np.concatenate([[0], sizes, [0]]).astype(np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)
        self.values = lists.flatten().to_numpy()


def _packed(numbers: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Seven bits a byte, lowest first, all but a number's last byte with the high bit set; then compressed."""
    size = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14)
    out = np.stack([numbers & 127, numbers >> 7 & 127, numbers >> 14], 1).astype(np.uint8)
    place = np.arange(3)[None, :]
    out |= ((place + 1 < size[:, None]) * 128).astype(np.uint8)
    return pack.compress(out[place < size[:, None]].tobytes())


def _unpacked(blob: bytes, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    data = np.frombuffer(unpack.decompress(blob), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], data[:-1] < 128]))
    shift = 7 * (np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, start)


#: What becomes of the id lists of a block of rows: the columns to return in their place.
Finish = Callable[[pa.Array], list[pa.Array]]


def _encoded_rows(docs: DataFrame, keep: list[str] | None, tokenizer: str, most_words: int, most_bytes: int, added: T.StructType, finish: Callable[[], Finish]) -> DataFrame:
    """The kept columns (all, if none are named), and those that finish() makes of each row's ids."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    hot, rare = hot_table(docs, tokenizer, most_words, most_bytes)
    kind = "<u2" if wordtok.load(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    # About 32 MB of rare words a task, and a task a core at least. More would part a text's rare words for nothing.
    parts = max(spark.sparkContext.defaultParallelism, rare * 40 // (32 << 20))
    hole = hot.num_rows + 1
    words, ids = (spark.sparkContext.broadcast(_stream(_array(hot.column(c)))) for c in ("word", "ids"))
    call = uuid4().hex
    del hot
    give_back()

    # Small ids compress well; where there is none, the text's own hash has to tell rows apart.
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    own = F.xxhash64("text", F.col("`doc_id`").cast("string"))
    keys = [(F.coalesce(F.col("`doc_id`").cast("long"), own) if whole else own).alias("_key"), F.hash("text").alias("_key2")]
    texts = docs.select(*keys, F.col("text").alias("_text"))
    rows = docs.select(*keys, *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))

    def fill(batches):
        hot, pack = _lookup(call, words), zstandard.ZstdCompressor(level=1)
        for b in _blocks(batches):
            parts, ends = _words(b.columns[-1])
            numbers = np.split(hot.numbers(parts), ends[:-1])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([_packed(x, pack) for x in numbers], pa.binary())], names=[*b.schema.names[:-1], "_packed"])

    def missing(batches):
        hot = _lookup(call, words)
        for b in _blocks(batches):
            parts, ends = _words(b.columns[-1])
            at = np.flatnonzero(hot.numbers(parts) == hole)
            if len(at):
                row = np.searchsorted(ends, at, side="right")
                first = np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays([parts.take(pa.array(at)), *(c.take(pa.array(row)) for c in b.columns[:2]), pa.array((np.arange(len(at)) - first).astype(np.int32))], names=["word", "_key", "_key2", "place"])

    def once(batches):
        tok, last = wordtok.load(tokenizer), (None, None)
        for b in batches:
            runs = pc.dictionary_encode(b.column(0))  # equal words lie together: the rows are sorted
            words, known = runs.dictionary, []
            if words[0].as_py() == last[0]:
                known = [pa.array([last[1]], pa.list_(pa.int32()))]
            ids = pa.concat_arrays([*known, _encoded(words.slice(len(known)), tok)])
            last = (words[-1].as_py(), ids[-1].as_py())
            yield pa.RecordBatch.from_arrays([*b.columns[1:3], _placed(b.column(3), ids.take(runs.indices), kind)], names=["_key", "_key2", "placed"])

    def stitch(batches):
        hot, unpack, end = _Ids(ids.value), zstandard.ZstdDecompressor(), finish()
        for b in _blocks(batches, -2, PACKED):
            numbers = [_unpacked(x.as_py(), unpack) for x in b.columns[-2]]
            ends = np.cumsum([len(x) for x in numbers])
            numbers = np.concatenate(numbers)
            starts, sizes, values = hot.starts[numbers], hot.sizes[numbers], hot.values
            holes = np.flatnonzero(numbers == hole)
            if len(holes):
                each, flat = pc.list_parent_indices(b.columns[-1]).to_numpy(), pc.list_flatten(b.columns[-1])
                n = pc.binary_length(flat).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
                found, at = np.frombuffer(b"".join(flat.to_pylist()), kind).astype(np.int32), np.cumsum(n) - n
                order = np.lexsort((found[at] + (found[at + 1].astype(np.int64) << 16), each))
                if len(order) != len(holes):
                    raise ValueError(f"{len(holes)} words are missing, {len(order)} were found")
                starts[holes], sizes[holes] = at[order] + 2 + len(values), n[order] - 2
                values = np.concatenate([values, found])
            offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(sizes)])[ends]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_ragged(values, starts, sizes).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *end(lists)], names=[*b.schema.names[:-2], *(f"_a{i}" for i in range(len(added)))])

    # Rows that share both keys share text and doc_id, so the set of their words' places is that of one.
    found = texts.mapInArrow(missing, "word string, _key long, _key2 int, place int").repartition(parts, "word").sortWithinPartitions("word")
    found = found.mapInArrow(once, "_key long, _key2 int, placed binary").groupBy("_key", "_key2").agg(F.collect_set("placed").alias("_found"))
    kept = rows.drop("_text").schema
    arrays = rows.mapInArrow(fill, T.StructType([*kept.fields, T.StructField("_packed", T.BinaryType())]))
    joined = arrays.join(found, ["_key", "_key2"], "left").drop("_key", "_key2")
    out = joined.mapInArrow(stitch, T.StructType([*kept.fields[2:], *(T.StructField(f"_a{i}", f.dataType) for i, f in enumerate(added))]))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"_a{i}").alias(c) for i, c in enumerate(added.names)])


#: Bounds of the hot table.
MOST_WORDS, MOST_BYTES = 800_000, 16 << 20


def encode(docs: DataFrame, keep: list[str] | None = None, tokenizer: str = wordtok.DEFAULT_TOKENIZER, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The kept columns (all, if none are named) and `ids array<int>` of each row's text.

    Name only what is needed: kept columns cross the shuffle that brings rare
    words back.
    """
    return _encoded_rows(docs, keep, tokenizer, most_words, most_bytes, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]), lambda: lambda lists: [lists])


def _joiner(tables: list[list[str]]) -> Finish:
    """Id lists -> for each table, the pieces of their ids joined by one space. Ids without a piece give nothing."""
    pieces = [pa.array(t, pa.string()) for t in tables]

    def run(lists: pa.Array) -> list[pa.Array]:
        flat = pc.list_flatten(lists)
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces[0])))
        if not pc.all(known).as_py():
            lists = pa.array([[i for i in x or [] if i is not None and 0 <= i < len(pieces[0])] for x in lists.to_pylist()], lists.type)
            flat = pc.list_flatten(lists)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return [pc.binary_join(pa.ListArray.from_arrays(offsets, p.take(flat)), " ") for p in pieces]

    return run


def round_trip(docs: DataFrame, keep: list[str] | None = None, tokenizer: str = wordtok.DEFAULT_TOKENIZER, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """encode() and decode() in one pass: the kept columns, n_tokens, ids_text (decimal ids joined by one space) and decoded."""
    pieces = pieces_of(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast([list(map(str, range(len(pieces)))), pieces])
    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_text", T.StringType()), T.StructField("decoded", T.StringType())])

    def finish() -> Finish:
        join = _joiner(shared.value)
        return lambda lists: [pc.list_value_length(lists).cast(pa.int64()), *join(lists)]

    return _encoded_rows(docs, keep, tokenizer, most_words, most_bytes, added, finish)


def pieces_of(tokenizer: str = wordtok.DEFAULT_TOKENIZER) -> list[str]:
    """Piece of each id. The file must have no decoder of its own: the library then joins pieces by a space."""
    if wordtok.spec(tokenizer)["decoder"] is not None:
        raise ValueError(f"{tokenizer} has a decoder; pieces alone don't give its texts")
    tok = wordtok.load(tokenizer)
    return [tok.id_to_token(i) for i in range(tok.get_vocab_size())]


def decode(rows: DataFrame, ids: str = "ids", to: str = "decoded", tokenizer: str = wordtok.DEFAULT_TOKENIZER) -> DataFrame:
    """rows with a text column `to`, the library's decode(ids, skip_special_tokens=False), in place of `ids`.

    The table of pieces has a row for each id of the vocabulary, so it is sent
    to every task. Null ids give the empty text; ids outside the vocabulary give
    nothing.
    """
    shared = rows.sparkSession.sparkContext.broadcast([pieces_of(tokenizer)])
    keep = [c for c in rows.columns if c not in (to, ids)]
    picked = rows.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], F.col(f"`{ids}`").alias("_ids"))

    def run(batches):
        join = _joiner(shared.value)
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(b.columns[-1]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(sizes // PACKED)) + 1):
                own = b.slice(int(part[0]), len(part))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *join(own.columns[-1])], names=[*own.schema.names[:-1], "_to"])

    out = picked.mapInArrow(run, T.StructType([*picked.schema.fields[:-1], T.StructField("_to", T.StringType())]))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], F.col("_to").alias(to))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text they decode to."""
    texts = round_trip(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return texts.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
