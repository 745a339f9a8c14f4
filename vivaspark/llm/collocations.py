"""Collocations: phrases of two to four words whose parts seldom come apart, from suffix arrays of word ids.

1. A shard (some million words of one task) numbers its words, texts one after
   another with a separator behind each piece, and sorts its suffixes by prefix
   doubling: ranks of one word, then of two, then of four. Neighbours' common
   prefixes (LCP, up to four words) part the array into intervals, and an
   interval is a phrase with its count.
2. Most phrases of a corpus are rare. A first pass counts words and pairs by
   64-bit hashes, and those that reach the least count set bits of a filter of
   fixed size. Hashes that fall together only add counts, so no frequent phrase
   is lost; what else passes is counted exactly and dropped later.
3. A second pass counts words, pairs, triples and fours of which all words and
   pairs pass the filter, by language and text, summed by key over all shards.
4. Cuts, containment and ranks are joins and aggregations of the frequent
   phrases. Ranks come from a histogram of scores, so that no task sees more of
   a language than one class of scores.

What is broadcast is the filter, of fixed size; on a corpus with more frequent
pairs than it can tell apart, more phrases are counted, and results stay exact.
A task holds one shard and its distinct words; the longest piece is never parted.

Defined results: null texts are empty; null languages are `und`, together with
those that say so; repeated rows count as often as they are there; equal scores
rank by count and then by the phrase's bytes; other columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vivaspark.llm.bpe import _blocks
from vivaspark.llm.common import cut, give_back, small_batches, table

#: Characters that end a piece, all ASCII; words lie between spaces and tabs.
BREAKS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 4
_BREAK = re.compile("[" + re.escape(BREAKS.decode()) + "]")
#: Words of a shard, characters of a long text's slices, and a shard's rows in a batch of results.
SHARD, SLICE, BATCH = 3 << 19, 1 << 21, 1 << 17
#: Bits of the filter of frequent words and pairs, as a power of two.
FILTER = 26
#: 0xFF is in no UTF-8 text, so it can stand for a piece's end.
_END = b"\xff"
_BYTES = bytes.maketrans(BREAKS + b"\t", _END * len(BREAKS) + b" ")


class Shard:
    """Word ids of texts, -1 behind each piece; an id is a word of a language."""

    def __init__(self) -> None:
        new = count()
        self.ids: dict[str, defaultdict[bytes, int]] = defaultdict(lambda: defaultdict(lambda: next(new), {_END: -1}))
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str | None, text: str | None) -> None:
        words = (text or "").encode().lower().translate(_BYTES).replace(_END, b" \xff ").split()
        words.append(_END)
        own = self.ids["und" if lang is None else lang]
        self.parts.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def words(self) -> tuple[list[str], list[bytes]]:
        """Language and word of each id."""
        n = sum(map(len, self.ids.values())) - len(self.ids)
        langs, words = [""] * n, [b""] * n
        for lang, own in self.ids.items():
            for w, i in own.items():
                if i >= 0:
                    langs[i], words[i] = lang, w
        return langs, words


def slices(text: str | None, most: int = SLICE) -> Iterator[str | None]:
    """A text in slices of about `most` characters that end where pieces do."""
    at = 0
    while text and len(text) - at > most:
        end = _BREAK.search(text, at + most)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD) -> Iterator[Shard]:
    """lang, text -> shards. A long text may lie in several; a long piece makes one of its own."""
    shard = Shard()
    for b in _blocks(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for part in slices(text):
                shard.add(lang, part)
                if shard.size >= most:
                    yield shard
                    shard = Shard()
    if shard.size:
        yield shard


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and each key's rank among the distinct ones, from 1."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else 0
    return order, rank


def intervals(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """ids, negative at separators -> for each length, one place of each distinct sequence of that length and its count.

    Suffixes end at the next separator.
    """
    ids = np.concatenate([ids, np.full(longest, -1, ids.dtype)])
    n = len(ids) - longest
    left = np.zeros(len(ids), np.int8)  # words to the next separator, up to `longest`
    for k in range(longest):
        left[: len(ids) - k] += (left[: len(ids) - k] == k) & (ids[k:] >= 0)
    rank, depth = np.maximum(ids.astype(np.int64) + 1, 0), 1
    starts = np.flatnonzero(left[:n])
    order = np.argsort(rank[starts], kind="stable")
    while depth < longest:
        ahead = np.where(left[starts] >= depth, rank[np.minimum(starts + depth, len(ids) - 1)], 0)
        ahead[left[starts] == depth] = 0  # what follows is a separator
        ahead += rank[starts] * (int(rank.max(initial=0)) + 1)
        order, dense = _dense(ahead)
        del ahead
        rank = np.zeros(len(ids), np.int64)
        rank[starts] = dense
        depth *= 2
    suffixes = starts[order]
    common = np.zeros(len(suffixes), np.int8)  # with the suffix before, in words
    for k in range(longest):
        a, b = ids[suffixes[1:] + k], ids[suffixes[:-1] + k]
        common[1:] += (common[1:] == k) & (a == b) & (a >= 0)
    for length in range(1, longest + 1):
        heads = np.flatnonzero(common < length)
        sizes = np.diff(heads, append=len(suffixes))
        whole = left[suffixes[heads]] >= length
        yield length, suffixes[heads[whole]], sizes[whole]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(langs: list[str], words: list[bytes]) -> np.ndarray:
    seeds = {lang: xxhash.xxh32_intdigest(lang.encode()) for lang in set(langs)}
    return np.array([xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in zip(langs, words)], np.uint64)


def _pair_hashes(words: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(words[first] * np.uint64(0x9E3779B97F4A7C15) + words[second])


def _hash_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> hash and n of the words and pairs of each shard."""
    for shard in shards(batches):
        ids, hashes = np.concatenate(shard.parts), _word_hashes(*shard.words())
        del shard
        for length, at, n in intervals(ids, 2):
            for i in range(0, len(at), BATCH):
                own = at[i : i + BATCH]
                h = hashes[ids[own]] if length == 1 else _pair_hashes(hashes, ids[own], ids[own + 1])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n[i : i + BATCH].astype(np.int64))], names=["hash", "n"])


def _bit_columns(h: Column) -> list[Column]:
    """The two bits of a hash: its lowest bits, and the next above them."""
    return [h.bitwiseAND((1 << FILTER) - 1), F.shiftrightunsigned(h, FILTER).bitwiseAND((1 << FILTER) - 1)]


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for shift in (0, FILTER):
        at = (hashes >> np.uint64(shift)) & np.uint64((1 << FILTER) - 1)
        ok &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return ok


def frequent_filter(docs: DataFrame, least: int) -> np.ndarray:
    """Bits of the words and pairs that occur `least` times or more, by language: 2^FILTER of them, whatever the corpus."""
    # Shards have distinct hashes, so summing before the shuffle would only fill memory.
    counts = docs.select("lang", "text").mapInArrow(_hash_counts, "hash long, n long").repartition("hash").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    bits = counts.select(F.explode(F.array(*_bit_columns(F.col("hash")))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = bits.select(F.shiftrightunsigned("bit", 6).cast("int").alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("ones"))
    found = words.toArrow()
    out = np.zeros(1 << FILTER - 6, np.uint64)
    if found.num_rows:
        out[found.column("word").to_numpy()] = found.column("ones").to_numpy().view(np.uint64)
    return out


@lru_cache(maxsize=1)
def _bits(call: str, shared) -> np.ndarray:
    """One for a Python process and call."""
    return np.frombuffer(shared.value, np.uint64)


def phrase_counts(docs: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """lang, phrase (its words joined by a space), words, n: all phrases of up to `longest` words that occur `least` times or more.

    The empty phrase, of no words, has the number of words of the language,
    however few.
    """
    small_batches(docs.sparkSession)
    shared, call = docs.sparkSession.sparkContext.broadcast(frequent_filter(docs, least).tobytes()), uuid4().hex
    give_back()

    def count_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(call, shared)
        for shard in shards(batches):
            ids, (langs, words) = np.concatenate(shard.parts), shard.words()
            hashes = _word_hashes(langs, words)
            del shard
            total: defaultdict[str, int] = defaultdict(int)
            for i, n in enumerate(np.bincount(ids[ids >= 0], minlength=len(words)).tolist()):
                total[langs[i]] += n
            kept = np.append(np.where((ids >= 0) & np.append(_passes(bits, hashes), False)[ids], ids, -1), -1).astype(np.int32)
            pair = np.flatnonzero((kept[:-1] >= 0) & (kept[1:] >= 0))
            apart = np.ones(len(kept), bool)  # between a word and the next
            apart[pair[_passes(bits, _pair_hashes(hashes, kept[pair], kept[pair + 1]))]] = False
            # A separator goes wherever a pair is rare, so longer phrases hold none.
            shift = np.cumsum(np.concatenate([[0], (apart & (kept >= 0))[:-1]]))
            spread = np.full(len(kept) + int(shift[-1]) + 1, -1, np.int32)
            spread[np.arange(len(kept)) + shift] = kept
            rows = [(lang, "", 0, n) for lang, n in total.items()]
            for length, at, sizes in intervals(spread, longest):
                for a, n in zip(at.tolist(), sizes.tolist()):
                    own = spread[a : a + length].tolist()
                    rows.append((langs[own[0]], b" ".join([words[i] for i in own]).decode(), length, n))
            for i in range(0, len(rows), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + BATCH]), (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "words", "n"])

    counted = docs.select("lang", "text").mapInArrow(count_phrases, "lang string, phrase string, words int, n long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0))


def scored(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more, by its lowest-scoring cut."""
    part = lambda name, n: counts.filter("words > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = counts.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    low = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return low.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def swallowed(counts: DataFrame, percent: int = 80) -> DataFrame:
    """lang, phrase of those that lie in a longer phrase with so much of their count, or more."""
    longer = counts.filter("words > 2").select("lang", "n", F.split("phrase", " ").alias("w"), "words")
    inner = longer.select("lang", "n", "w", F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(w, s, m), ' '))))")).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    own = counts.filter("words > 1").select("lang", "phrase", F.col("n").alias("a"))
    exact = [F.col(c).cast("decimal(19,0)") * F.lit(x).cast("decimal(3,0)") for c, x in (("most", 100), ("a", percent))]
    return own.join(most, ["lang", "phrase"]).filter(exact[0] >= exact[1]).select("lang", "phrase")


def ranked(df: DataFrame, key: str, best: list[Column], score: str, most: int) -> DataFrame:
    """The first `most` rows of each key, with their rank from 1.

    Scores, at least 0, fall into about 16 classes a power of two. Rows of
    higher classes are only counted, and each class is ranked by itself.
    """
    rows = df.withColumn("_class", F.floor(F.log2(F.col(score) + 1) * 16).cast("int"))
    above = Window.partitionBy(key).orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(key, "_class").agg(F.count("*").alias("_n"))
    offset = sizes.select(key, "_class", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above")).filter(F.col("_above") < most)
    place = F.row_number().over(Window.partitionBy(key, "_class").orderBy(*best))
    own = rows.join(offset, [key, "_class"]).withColumn("_place", place).filter(F.col("_place") <= most)
    return own.withColumn("rank", F.col("_above") + F.col("_place")).filter(F.col("rank") <= most).drop("_class", "_above", "_place")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases."""
    counts = cut(phrase_counts(docs, least))
    kept = scored(counts).join(swallowed(counts), ["lang", "phrase"], "left_anti")
    best = ranked(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "score", most)
    totals = counts.filter("words = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of two to four words, thirty occurrences or more."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), parted AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM parted, range(1, 5) s(m), LATERAL (SELECT unnest(range(1, greatest(len(w) - m + 2, 1))) AS i)
), counts AS (
    SELECT lang, phrase, m, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM parted GROUP BY lang
), cuts AS (
    SELECT c.lang, c.phrase, c.n AS a, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS tail
    FROM counts c, range(1, 4) s(k) WHERE k < c.m
), scores AS (
    SELECT cuts.lang, cuts.phrase, a, k, f.n AS l, g.n AS r, (2000000::HUGEINT * a // (f.n::HUGEINT + g.n::HUGEINT))::BIGINT AS score
    FROM cuts JOIN counts f ON f.lang = cuts.lang AND f.phrase = head JOIN counts g ON g.lang = cuts.lang AND g.phrase = tail
), low AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
    SELECT c.lang, c.n, array_to_string(string_split(c.phrase, ' ')[i:i + k - 1], ' ') AS phrase
    FROM counts c, range(2, 4) s(k), range(1, 4) t(i) WHERE k < c.m AND i + k - 1 <= c.m
), kept AS (
    SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inner_phrases p WHERE p.lang = low.lang AND p.phrase = low.phrase AND 100::HUGEINT * p.n >= 80::HUGEINT * low.a)
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, totals.n, score
FROM kept JOIN totals ON totals.lang = kept.lang
QUALIFY rank <= 2000
"""
