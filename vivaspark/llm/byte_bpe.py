"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, and decoding by the byte table.

The file holds a rank for each byte string. Two neighbouring pieces merge where
their bytes together have a rank, lowest rank first, leftmost first. The library
knows merges of pairs of pieces instead, so every way to part a ranked string
in two ranked ones becomes a merge, in the order of the whole's rank; and it
works on characters, so each byte is written as one (printable ones as they
are, the others from U+0100 on).

Encoding works on chunks: white space and the word after it. No match of the
pattern crosses from a non-space to a space, so a text's ids are those of its
chunks in order. A task numbers the chunks of a block of texts, has the library
encode each distinct one that its cache lacks, many at a time, and gathers the
ids by position with numpy. Offsets count code points; a character whose bytes lie in several
tokens belongs to each of them.

Nothing is shuffled. A task's memory is that of a block of text, of its cache
(bounded) and of the longest run without white space or punctuation; a long
text is worked in slices.

Defined results: null and empty texts have no ids and decode to no bytes;
repeated rows give repeated results; an empty table gives an empty table; kept
columns pass through, whatever their name, but for those that the result adds,
which replace them. Ids outside the vocabulary and null ids decode to nothing.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vivaspark.llm.bpe import _blocks, _ragged
from vivaspark.llm.common import small_batches, table
from vivaspark.llm.wordtok import tokenizer_path

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: White space as the pattern sees it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c))
#: Where a long text may be cut: before white space after something else, and from punctuation to a letter or digit.
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[.,;:!?)\\]\\u3001\\u3002\\uff0c\\uff1a\\uff1b\\uff01\\uff1f])(?=[A-Za-z0-9\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5])")
#: Code points of a text, and bytes of a block of texts, that are worked at a time; chunks in a task's cache, and code points of those that enter it.
SLICE, BLOCK, CACHE, CACHED = 1 << 19, 2 << 20, 300_000, 64
#: Chunks that the library gets as one text.
TOGETHER = 4096
#: A token's id, and with offsets its first and last code point.
_ID, _OFF = 1, 3


def byte_characters() -> list[str]:
    """The character of each byte: itself where it prints, the next from U+0100 on where not."""
    out, more = [], 0x100
    for b in range(256):
        prints = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD
        out.append(chr(b if prints else more))
        more += not prints
    return out


def ranks_of(name_or_path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    """Byte strings with their ranks, which are their ids."""
    with open(tokenizer_path(name_or_path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def library(ranks: dict[bytes, int]):
    """The library's tokenizer for a table of ranks."""
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    as_text = byte_characters()
    name = {t: "".join(as_text[b] for b in t) for t in ranks}
    merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges))
    split = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")
    tok.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


def slices(text: str, most: int = SLICE) -> Iterator[str]:
    """The text in slices of about `most` code points that encode by themselves."""
    at = 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class _Coder:
    """The library's tokenizer of a process, and the tokens of chunks met before, as bytes of int32 rows."""

    def __init__(self, ranks_file: str):
        ranks = ranks_of(ranks_file)
        self.tok = library(ranks)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int32)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.known: dict[int, dict[str, bytes]] = {_ID: {}, _OFF: {}}

    def _together(self, parts: list[list[str]], width: int) -> Iterator[bytes]:
        """Tokens of each chunk, those of a part encoded as one text; where a chunk's bytes end, so do its tokens."""
        texts = ["".join(part) for part in parts]
        batch = (self.tok.encode_batch_fast if width == _ID else self.tok.encode_batch)(texts, add_special_tokens=False)
        for part, e in zip(parts, batch):
            ids = np.array(e.ids, np.int32)
            stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(c.encode()) for c in part])) + 1
            rows = ids[:, None]
            if width == _OFF:
                lengths = np.array([len(c) for c in part])
                own = np.repeat(np.cumsum(lengths) - lengths, np.diff(stops, prepend=0))
                rows = np.concatenate([rows, np.array(e.offsets, np.int32).reshape(-1, 2) - own[:, None]], 1)
            blob, at = np.ascontiguousarray(rows, np.int32).tobytes(), 0
            for end in (stops * (4 * width)).tolist():
                yield blob[at:end]
                at = end

    def tokens(self, chunks: list[str], width: int) -> list[bytes]:
        known = self.known[width]
        if len(known) > CACHE:
            known.clear()
        out = list(map(known.get, chunks))
        parts, places, joined = [], [], []
        for i, row in enumerate(out):
            if row is None:
                c = chunks[i]
                if c[0] in _SPACES and c[-1] not in _SPACES and len(c) <= CACHED:
                    joined.append(i)
                else:  # such a chunk would run into its neighbours
                    parts.append([c])
                    places.append(i)
        for at in range(0, len(joined), TOGETHER):
            parts.append([chunks[i] for i in joined[at : at + TOGETHER]])
        for i, row in zip([*places, *joined], self._together(parts, width)):
            out[i] = row
            if len(chunks[i]) <= CACHED:
                known[chunks[i]] = row
        return out

    def encode(self, texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of tokens of all texts, and where each text's end."""
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        parts, ends, n = [], [], 0
        for text in texts:
            for piece in slices(text or ""):
                own = _CHUNK.findall(piece)
                parts.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
                n += len(own)
            ends.append(n)
        at = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        chunks = list(numbers)
        rows = self.tokens(chunks, width)
        sizes = np.array([len(r) for r in rows], np.int64) // (4 * width)
        flat = np.frombuffer(b"".join(rows), np.int32).reshape(-1, width)
        stops = np.concatenate([[0], np.cumsum(sizes[at])])[np.concatenate([[0], ends]).astype(np.int64)]
        out = flat[_ragged(np.arange(len(flat)), (np.cumsum(sizes) - sizes)[at], sizes[at])]
        if width == _OFF:
            lengths = np.array([len(c) for c in chunks], np.int64)[at]
            first = np.concatenate([[0], np.cumsum(lengths)])
            starts = first[:-1] - np.repeat(first[np.concatenate([[0], ends[:-1]]).astype(np.int64)], np.diff(np.concatenate([[0], ends])))
            out = out.copy()
            out[:, 1:] += np.repeat(starts, sizes[at]).astype(np.int32)[:, None]
        return out, stops


@lru_cache(maxsize=1)
def _coder(ranks_file: str) -> _Coder:
    """One a Python process, which serves many tasks."""
    return _Coder(ranks_file)


def _lists(values: pa.Array, stops: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), values)


def _mapped(docs: DataFrame, keep: list[str] | None, column: str, added: T.StructType, make, most: int = BLOCK) -> DataFrame:
    """The kept columns (all, if none are named), and those that make()'s function gives for a batch of one column."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").alias("_in"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(f"_a{i}", f.dataType) for i, f in enumerate(added))])

    texts = not isinstance(rows.schema["_in"].dataType, T.ArrayType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, to = make(), to_arrow_schema(schema)
        for b in _blocks(batches, -1, most) if texts else batches:
            made = f(b.columns[-1])
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip([*b.columns[:-1], *made], to)], schema=to)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"_a{i}").alias(c) for i, c in enumerate(added.names)])


def encode(docs: DataFrame, keep: list[str] | None = None, ranks_file: str = DEFAULT_RANKS, offsets: bool = False) -> DataFrame:
    """The kept columns and `ids array<int>` of each row's text; with offsets also `starts` and `ends`, in code points."""
    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    added = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in names])

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            rows, stops = _coder(ranks_file).encode(texts.to_pylist(), _OFF if offsets else _ID)
            return [_lists(pa.array(np.ascontiguousarray(rows[:, i])), stops) for i in range(len(names))]

        return run

    return _mapped(docs, keep, "text", added, make)


def _pieces(ranks_file: str) -> pa.Array:
    by_id = {r: t for t, r in ranks_of(ranks_file).items()}
    return pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.binary())


def _joined(lists: pa.Array, pieces: pa.Array, between: bytes = b"") -> pa.Array:
    """Pieces of each list's ids, in one; ids without a piece give nothing."""
    flat, stops = pc.list_flatten(lists), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    own = flat.fill_null(-1).to_numpy(zero_copy_only=False)
    known = (own >= 0) & (own < len(pieces))
    if not known.all():
        stops, own = np.concatenate([[0], np.cumsum(known)])[stops.astype(np.int64)], own[known]
    return pc.binary_join(_lists(pieces.take(pa.array(own)), stops), between)


def decode(rows: DataFrame, ids: str = "ids", to: str = "decoded", ranks_file: str = DEFAULT_RANKS, as_text: bool = False) -> DataFrame:
    """rows with the bytes of `ids` in a column `to`, in place of `ids`.

    As text, bytes that are no whole character, as where a list of ids begins or
    ends within one, become U+FFFD.
    """
    added = T.StructType([T.StructField(to, T.StringType() if as_text else T.BinaryType())])

    def make():
        pieces = _pieces(ranks_file)

        def run(lists: pa.Array) -> list[pa.Array]:
            found = _joined(lists, pieces)
            return [pa.array([b.decode("utf-8", "replace") for b in found.to_pylist()], pa.string()) if as_text else found]

        return run

    return _mapped(rows, [c for c in rows.columns if c != ids], ids, added, make)


def round_trip(docs: DataFrame, keep: list[str] | None = None, ranks_file: str = DEFAULT_RANKS) -> DataFrame:
    """encode() and decode() in one pass: the kept columns, n_tokens, ids_text (decimal ids joined by one space) and decoded (bytes)."""
    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_text", T.StringType()), T.StructField("decoded", T.BinaryType())])

    def make():
        pieces = _pieces(ranks_file)
        decimals = pa.array([str(i).encode() for i in range(len(pieces))], pa.binary())

        def run(texts: pa.Array) -> list[pa.Array]:
            rows, stops = _coder(ranks_file).encode(texts.to_pylist(), _ID)
            lists = _lists(pa.array(rows[:, 0]), stops)
            return [pa.array(np.diff(stops)), _joined(lists, decimals, b" "), _joined(lists, pieces)]

        return run

    return _mapped(docs, keep, "text", added, make)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes they decode to."""
    texts = round_trip(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return texts.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
