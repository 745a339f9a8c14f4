"""SimHash near-duplicates: 64-bit fingerprints linked through BK-trees.

Fingerprints at most RADIUS bits apart agree on at least two of four 16-bit
blocks, so each distinct fingerprint joins six shards, one for each pair of
blocks, keyed by those 32 bits. A shard's members form a BK-tree, sent with its
queries to one task; searches follow only edges within the radius. A shard of
over SHARD members is divided again by pairs of the four 8-bit blocks of its
other 32 bits: members of a part share 48 bits, which bounds a tree at 65,536
nodes whatever the data hold. Tasks emit a spanning forest of the links they
find (at most one row a member), never the pairs of a group. Sending every tree
to every task would make the broadcast grow with the corpus, so trees meet
their queries by key instead.

Exact copies share a fingerprint and are one node, so a group of copies of any
size costs one row here. Rows find their component by fingerprint: fingerprints
of a thousandth of all rows or more are broadcast, the others shuffled.

With a similarity asked for, texts whose sets of shingles have that share in
common (Jaccard) are linked too, far beyond RADIUS. Minima of the shingles' hashes in
bands name candidates: texts that agree in a band of BAND_ROWS minima hang at the
band's first text, and what hangs together is one crowd, sent with its texts to
one task (above PART texts, in pairs of parts); a filter of fixed size keeps most
other texts out of that shuffle. There a BK-tree gives the pairs
within WIDE bits, and an exact comparison of their sets decides. Bands miss a
pair at 0.8 with probability 3e-5, and WIDE bits about one in a million.

Defined results: a text without words (null, empty or blank) has fingerprint
zero and links like any other; a text of any length is read in blocks; repeated
rows repeat their result; a null doc_id keeps its row, and its component is the
smallest non-null doc_id reachable (null, if there is none); an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vivaspark.llm.bktree import Forest, roots
from vivaspark.llm.common import HOT, arrow_rows, cut, join_by_key, small_batches, table
from vivaspark.llm.components import components

RADIUS = 2
#: Radius of the trees for links by similarity; a pair at 0.8 is about 10 bits apart.
WIDE = 24
BANDS, BAND_ROWS = 20, 4
#: Texts of a crowd that are compared in one piece; a larger one is compared by pairs of parts.
PART = 4096
SHARD = 65_536
#: Bits of the filter of the texts that crowds need, as a power of two.
SIEVE = 23
#: Rows a task gathers before it builds and searches the trees of the whole shards among them.
CHUNK = 200_000
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _word_blocks(data: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a text, in lists of those of about size bytes."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            # Up to the next blank, wherever it is.
            found = _BLANK.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def _shingles(text: str | None, words_each: int, seed: int, block: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, repeats included; blocks of about `block` bytes at a time."""
    digest, n = xxhash.xxh64_intdigest, 0
    last: list[bytes] = []
    for own in _word_blocks((text or "").encode().lower(), block):
        words = last + own
        if len(words) >= words_each:
            line = b" ".join(words)
            ends = list(accumulate((len(w) + 1 for w in words), initial=0))
            h = [digest(line[a : b - 1], seed) for a, b in zip(ends, ends[words_each:])]
            yield np.array(h, np.uint64)
            n += len(h)
            words = words[len(words) - words_each + 1 :]
        last = words
    if not n and last:
        yield np.array([digest(b" ".join(last), seed)], np.uint64)


def _majority(hashes: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
        np.add(ones, bits.sum(0, dtype=np.int64), out=ones)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_each: int = 3, seed: int = 42, block: int = 1 << 18) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; blocks of about `block` bytes at a time."""
    return _majority(_shingles(text, words_each, seed, block))


_RNG = np.random.default_rng(11)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def bands(hashes: Iterable[np.ndarray]) -> list[int]:
    """A signed hash for each band of minima of the hashes under random maps; none without hashes."""
    least = None
    for h in hashes:
        for at in range(0, len(h), 1024):
            own = (h[None, at : at + 1024] * _TIMES + _PLUS).min(1)
            least = own if least is None else np.minimum(least, own)
    if least is None:
        return []
    found = [xxhash.xxh64_intdigest(m.tobytes(), k) for k, m in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(found, np.uint64).view(np.int64).tolist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words_each: int = 3, seed: int = 42, with_bands: bool = False) -> DataFrame:
    """doc_id, key (a hash of the text), fp, the fingerprint as a signed long, and, if asked for, bands."""

    def make():
        def rows(ids: list, keys: list, texts: list) -> Iterator[tuple]:
            for i, k, t in zip(ids, keys, texts):
                if with_bands:
                    h = list(_shingles(t, words_each, seed, 1 << 18))
                    yield i, k, _signed(_majority(h)), bands(h)
                else:
                    yield i, k, _signed(fingerprint(t, words_each, seed))

        return rows

    fields = [T.StructField(c, T.LongType()) for c in ("doc_id", "key", "fp")] + [T.StructField("bands", T.ArrayType(T.LongType()))] * with_bands
    return arrow_rows(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text"), T.StructType(fields), make)


def _shards(fp: Column, k: Column, width: int, places: list[int]) -> Column:
    """One (k, bits, fp) struct for each pair of blocks of so many bits at these places; k tells pairs apart."""
    b = [F.shiftrightunsigned(fp, p).bitwiseAND(F.lit((1 << width) - 1)) for p in places]
    return F.array(*[F.struct((k * 6 + n).alias("k"), (F.shiftleft(b[i], width) + b[j]).alias("bits"), fp.alias("fp")) for n, (i, j) in enumerate(combinations(range(len(places)), 2))])


def _parts(fp: Column, k: Column) -> Column:
    """The parts of a crowded shard, by pairs of the 8-bit blocks outside its own two 16-bit ones."""
    out = None
    for n, own in enumerate(combinations(range(4), 2)):
        free = [p for b in range(4) if b not in own for p in (16 * b, 16 * b + 8)]
        part = _shards(fp, F.lit(6) + k, 8, free)
        out = F.when(k == n, part) if out is None else out.when(k == n, part)
    return out


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, bits, fp) sorted by shard -> links (a, b) that keep each shard's connections."""

    def emit(salt: np.ndarray, bits: np.ndarray, fp: np.ndarray):
        new = np.concatenate([[True], (salt[1:] != salt[:-1]) | (bits[1:] != bits[:-1])])
        shard = np.cumsum(new)
        many = np.bincount(shard)[shard] > 1
        if many.any():
            value, shard = fp[many].view(np.uint64), shard[many]
            root = roots(len(value), Forest(shard, value).links(RADIUS))
            own = np.flatnonzero(root != np.arange(len(value)))
            yield pa.RecordBatch.from_arrays([pa.array(value[own].view(np.int64)), pa.array(value[root[own]].view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for b in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
        size += b.num_rows
        if size >= CHUNK:
            salt, bits, fp = (np.concatenate(x) for x in zip(*held))
            last = np.flatnonzero((salt != salt[-1]) | (bits != bits[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield from emit(salt[:whole], bits[:whole], fp[:whole])
            held, size = [(salt[whole:], bits[whole:], fp[whole:])], len(salt) - whole
    if size:
        yield from emit(*(np.concatenate(x) for x in zip(*held)))


def shards(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> k, bits and fp: each one's shards, those of over SHARD members in parts.

    Parts keep their shard's bits above their own, so no two shards mix.
    """
    keys, total = ["k", "bits"], 6 * fps.count()
    wide = fps.select(F.explode(_shards(F.col("fp"), F.lit(0), 16, [0, 16, 32, 48])).alias("x")).select("x.*")
    hot = cut(wide.groupBy(*keys).count().filter(F.col("count") > SHARD))
    if hot.isEmpty():
        return wide
    crowd = join_by_key(wide, hot, keys, "count", total).select(F.col("bits").alias("own"), F.explode(_parts(F.col("fp"), F.col("k"))).alias("x"))
    parts = crowd.select("x.k", (F.shiftleft("own", 16) + F.col("x.bits")).alias("bits"), "x.fp")
    largest = F.broadcast(hot.filter(F.col("count") * HOT >= total).select(*keys))
    return wide.join(largest, keys, "left_anti").join(hot, keys, "left_anti").select("k", "bits", "fp").union(parts)


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) with the connections of all pairs within the radius."""
    return shards(fps).repartition("k", "bits").sortWithinPartitions("k", "bits", "fp").mapInArrow(_spanning, "a long, b long")


def _alike(texts: list[str | None], words_each: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of fingerprints, enough to connect all texts whose sets of shingles are that similar."""
    by: dict[int, list[np.ndarray]] = {}
    for t in texts:
        h = list(_shingles(t, words_each, 42, 1 << 18))
        if h:
            by.setdefault(_majority(h), []).append(np.unique(np.concatenate(h)))
    value = np.array(list(by), np.uint64)
    sets, root = list(by.values()), np.arange(len(value))

    def close(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < similarity * max(len(x), len(y)):
            return False
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common >= similarity * (len(x) + len(y) - common)

    for i, j in Forest(np.zeros(len(value), np.int64), value).links(WIDE) if len(value) > 1 else ():
        for at in range(0, len(i), 10_000):
            a, b = i[at : at + 10_000], j[at : at + 10_000]
            apart = root[a] != root[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                if root[x] != root[y] and any(close(p, q) for p in sets[x] for q in sets[y]):
                    root[root == root[x]] = root[y]
                    yield _signed(int(value[x])), _signed(int(value[y]))


def sieve(rows: DataFrame, keys: list[str], wanted: DataFrame, wanted_keys: list[str]) -> DataFrame:
    """rows less most of those whose keys are not wanted, before a shuffle: all wanted ones stay.

    The keys' hashes set bits of a filter of 2^SIEVE bits, in words of 64 that are
    broadcast: at most 2^17 rows whatever the tables. More wanted keys than it
    can tell apart only let more rows pass.
    """
    word = lambda names: F.shiftrightunsigned(F.xxhash64(*names), 64 - SIEVE + 6)
    bit = lambda names: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(*names).bitwiseAND(63).cast("int"))
    bits = wanted.groupBy(word(wanted_keys).alias("_word")).agg(F.bit_or(bit(wanted_keys)).alias("_ones"))
    found = rows.join(F.broadcast(bits), word(keys) == F.col("_word")).filter(F.col("_ones").bitwiseAND(bit(keys)) != 0)
    return found.drop("_word", "_ones")


def similar(docs: DataFrame, prints: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """Links (a, b) of fingerprints that connect all texts of docs at that similarity; prints are fingerprints() with bands."""
    wide, rows = prints.select("key", F.explode("bands").alias("band")), prints.count()
    met = cut(wide.groupBy("band").agg(F.min("key").alias("b"), F.max("key").alias("_last"), F.count("*").alias("n")).filter("b < _last").drop("_last"))
    tied = components(join_by_key(wide, met, ["band"], "n", BANDS * rows).select(F.col("key").alias("a"), "b"))
    crowd = cut(tied.union(tied.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("key"), F.col("b").alias("crowd")))
    parts = crowd.groupBy("crowd").agg(F.count("*").alias("m"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = join_by_key(crowd, parts, ["crowd"], "m", crowd.count())
    # One row a text.
    members = cut(members.join(prints.groupBy("key").agg(F.min("doc_id").alias("_first"), F.count("*").alias("n")), "key"))
    own = docs.select(F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("_id"), "text")
    texts = join_by_key(sieve(own, ["key", "_id"], members, ["key", "_first"]), members, ["key"], "n", rows)
    part, other = F.pmod(F.xxhash64(F.col("key"), F.lit(1)), F.col("parts")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pairs = texts.filter(F.col("_id").eqNullSafe(F.col("_first"))).select("crowd", "parts", part.cast("int").alias("part"), other, "key", "text")
    pairs = pairs.filter("parts = 1 OR part <> other").select("crowd", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "key", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = ((row[:3], row[3:]) for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for _, group in groupby(rows_, lambda r: r[0]):
            found = list(_alike(list(dict(r[1] for r in group).values()), words_each, similarity))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    small_batches(docs.sparkSession)
    return pairs.repartition("crowd", "i", "j").sortWithinPartitions("crowd", "i", "j").mapInArrow(compare, "a long, b long")


def _grouped(docs: DataFrame, words_each: int, similarity: float | None = None) -> DataFrame:
    """doc_id, key, fp, root and component_id of every row; root names its component."""
    prints = cut(fingerprints(docs, words_each, with_bands=similarity is not None))
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = links(fps.select("fp"))
    tied = components(found if similarity is None else found.union(similar(docs, prints, words_each, similarity)))
    prints = prints.select("doc_id", "key", "fp")
    # Only linked fingerprints take part in the joins on components; the rest keep their own smallest id.
    members = fps.join(tied.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    members = cut(members.select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = join_by_key(members, least, ["root"], "m", members.count())
    return join_by_key(prints, named.select("fp", "root", "component_id", "n"), ["fp"], "n", prints.count())


def near_duplicates(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    return _grouped(docs, words_each).select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_each: int = 3, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, null ids last, then of the smallest hash of its text.

    With a similarity, texts with that share of shingles in common are in one component too.
    Rows that share a doc_id but not a text are told apart.
    """
    id_ = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("_id")
    first = _grouped(docs, words_each, similarity).groupBy("root").agg(F.min(F.struct(id_, F.col("key").alias("_key"))).alias("x")).select("x.*")
    # The caller's columns go by numbers meanwhile, so none can meet one of ours.
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_id"), F.xxhash64("text").alias("_key"))
    return rows.join(first, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
