"""Token counts at every prefix of a text, by dynamic programming.

`PrefixCounter.prefix_counts(text)` is an array whose entry k is the number of
tokens of text[:k] (code points), as the tokenizer library would count them.
With it, token totals, "longest prefix within a budget" and "tokens of a
truncated text" are lookups; nothing is encoded again.

Recurrence, for a run of characters that the pre-tokenizer keeps together:
let last[i] be the final token of the merge result of the first i characters
without word end. A token t ending at i extends the result at j = i - |t|
exactly if t is alone (j = 0) or merging last[j] with t gives those two tokens
back. So inner[i] = inner[j] + 1, and the count of the prefix, with t's
word-end form in place of t, is closed[i] = inner[j] + 1. Counts of a text are
the counts of its whole words before k plus closed[] inside the word at k. So
the total and the longest prefix within a budget need each word's last count and
all counts of one word; a text's whole table is made where it is asked for.

Words that normalising recomposes are cut where it can't reach over. A prefix
that ends inside such a piece may have other characters than the whole piece;
its count goes on from the state before the piece, over the piece's few
characters. Letter case and character classes are the library's own, asked once
a character. So any text costs time in proportion to its length.

Defined results: null counts as the empty text (0 tokens); texts of only
white space have 0; repeated rows get equal rows; an empty table gives an
empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vivaspark.llm import wordtok
from vivaspark.llm.common import arrow_rows, table

#: How the tokenizer file cuts a word without white space into runs.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


class PrefixCounter:
    """Prefix counts for one tokenizer; remembers at most twice max_words words, and totals of at most twice max_totals."""

    def __init__(self, tokenizer: str = wordtok.DEFAULT_TOKENIZER, max_words: int = 300_000, max_totals: int = 500_000):
        model = wordtok.spec(tokenizer)["model"]
        self.tok, self.end = wordtok.load(tokenizer), model["end_of_word_suffix"]
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in wordtok.spec(tokenizer)["added_tokens"]) or r"(?!)")
        self.lower, self.stand_in = _Lower(self.tok), _StandIn(self.tok)
        self.base = 0
        # By the text of a token: its length, its id inside a run and its id at a run's end (-1: none).
        forms: dict[str, list[int]] = {}
        for t, i in model["vocab"].items():
            stem, at_end = (t[: -len(self.end)], 1) if t.endswith(self.end) and t != self.end else (t, 0)
            forms.setdefault(stem, [-1, -1])[at_end] = i
        self.matcher = ahocorasick.Automaton()
        for stem, (inside, final) in forms.items():
            self.matcher.add_word(stem, (len(stem), inside, final))
        self.matcher.make_automaton()
        self.longest = max(map(len, forms))
        # Rank of the merge that makes a token (-1: a symbol), its two halves, and the rank of a pair's merge.
        vocab = model["vocab"]
        self.made, self.halves, self.joins = [-1] * (max(vocab.values()) + 1), {}, {}
        for rank, m in enumerate(model["merges"]):
            left, right = m.split(" ", 1) if isinstance(m, str) else m
            i, pair = vocab[left + right], (vocab[left], vocab[right])
            if self.made[i] < 0:
                self.made[i], self.halves[i] = rank, pair
            self.joins[pair[0] << 32 | pair[1]] = rank
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes | np.ndarray] = {"": b""}
        self.older: dict[str, bytes | np.ndarray] = {}
        self.runs: dict[str, list[int]] = {}
        self.totals: dict[str, int] = {"": 0}
        self.older_totals: dict[str, int] = {}
        self.run_totals: dict[str, int] = {}
        self.max_words, self.max_totals = max_words, max_totals
        self.bytes_of = _byte_chars()

    def _ok(self, key: int) -> bool:
        """Whether two tokens, a << 32 | b, stay as they are side by side.

        Undo the merges of both in reverse order of rank and look, at each
        moment, whether a merge across the border would have come first.
        """
        made, halves, joins = self.made, self.halves, self.joins
        a, b, known, limit = key >> 32, key & 0xFFFFFFFF, None, 1 << 60
        while known is None:
            if joins.get(a << 32 | b, limit) < limit:
                known = False
            elif made[a] < 0 and made[b] < 0:
                known = True
            elif made[a] > made[b]:
                limit, a = made[a], halves[a][1]
            else:
                # A merge right of the border comes after one across it of equal rank: left goes first.
                limit, b = made[b] + 1, halves[b][0]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[key] = known
        return known

    def _walk(self, window: str, skip: int, last: list[int], inner: list[int], closed: list[int]) -> None:
        """The recurrence over the places of window after the first skip ones, whose last and inner are known."""
        ok, pair, base = self._ok, self.pairs.get, self.base
        for end, (size, inside, final) in self.matcher.iter(window):
            i = end + 1
            if i <= skip:
                continue
            j = i - size
            if not j and not base:
                if inside >= 0:
                    last[i], inner[i] = inside, 1
                if final >= 0:
                    closed[i] = 1
                continue
            if last[j] < 0:
                continue
            before = last[j] << 32
            if inside >= 0 and last[i] < 0:
                stays = pair(before | inside)
                if stays or stays is None and ok(before | inside):
                    last[i], inner[i] = inside, inner[j] + 1
            if final >= 0 and not closed[i]:
                stays = pair(before | final)
                if stays or stays is None and ok(before | final):
                    closed[i] = inner[j] + 1

    def _run(self, run: str) -> tuple[list[int], list[int], list[int]]:
        """last, inner and closed of a run, from place 0 on; run is in the model's byte alphabet."""
        n = len(run)
        last, inner, closed = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        self.base = 0
        self._walk(run, 0, last, inner, closed)
        if not all(closed[1:]):
            raise ValueError(f"no segmentation of {run[:99]!r}")
        return last, inner, closed

    def run_counts(self, run: str) -> list[int]:
        """closed[i] for i = 1 .. len(run)."""
        found = self.runs.get(run)
        if found is None:
            found = self._run(run)[2][1:]
            if len(run) < 64:
                self.runs[run] = found
        return found

    def _extended(self, run: str, last: list[int], inner: list[int], n: int, tail: str) -> int:
        """closed of run[:n] + tail, from what is known of run."""
        self.base = start = max(0, n - self.longest)
        before, more = last[start : n + 1] + [-1] * len(tail), inner[start : n + 1] + [0] * len(tail)
        closed = [0] * len(before)
        self._walk(run[start:n] + tail, n - start, before, more, closed)
        return closed[-1]

    def _in_bytes(self, text: str) -> str:
        return "".join([self.bytes_of[b] for b in text.encode()])

    def _low_counts(self, low: str, plain: bool) -> tuple[list[int], list[int]]:
        """Counts at each character of a normalised word, and where its runs start. White space of other kinds counts nothing."""
        ends, starts, base, at = [], [], 0, 0
        for run in _CUT.findall(low) if plain else self._cut(low):
            if run is None:
                ends.append(base)
                at += 1
                continue
            starts.append(at)
            at += len(run)
            contracted = run in _CONTRACTIONS
            counts: list[int] = []
            for piece in ("'", run[1:]) if contracted else (run,):
                if plain or piece.isascii() and piece.isprintable():
                    closed = self.run_counts(piece)
                else:
                    closed = self.run_counts(self._in_bytes(piece))
                    closed = [closed[k - 1] for k in itertools.accumulate(1 if c < "\x80" else len(c.encode()) for c in piece)]
                counts += [counts[-1] + c for c in closed] if counts else closed
            if contracted:
                counts[-1] = self.run_counts(run)[-1]
            ends += [base + c for c in counts] if base else counts
            base = ends[-1]
        return ends, starts

    def _cut(self, low: str) -> Iterator[str | None]:
        """Runs of a word by the library's character classes; None for a character of white space."""
        at = 0
        for m in _CUT.finditer(low.translate(self.stand_in)):
            yield from itertools.repeat(None, m.start() - at)
            at = m.end()
            yield low[m.start() : at]
        yield from itertools.repeat(None, len(low) - at)

    def word_counts(self, word: str) -> list[int]:
        """Counts of word[:1] .. word[:len(word)]."""
        plain = word.isascii() and word.isprintable()
        if plain and word.isalpha():
            return self.run_counts(word.lower())
        if self.special.search(word):
            return self._around_specials(word)
        if plain:
            return self._low_counts(word.lower(), True)[0]
        if not unicodedata.is_normalized("NFC", word):
            return self._recomposed(word)
        lowered = [self.lower[c] for c in word]
        ends, _ = self._low_counts("".join(lowered), False)
        return ends if len(ends) == len(word) else [ends[k - 1] for k in itertools.accumulate(map(len, lowered))]

    def _around_specials(self, word: str) -> list[int]:
        """A special string is one token and parts what is before and after it."""
        out: list[int] = []
        at = base = 0
        for m in self.special.finditer(word):
            # Until its last character is there, the string is text like any other.
            out += [base + c for c in self.word_counts(word[at : m.end() - 1])]
            base += (self.word_counts(word[at : m.start()])[-1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        return out + ([base + c for c in self.word_counts(word[at:])] if at < len(word) else [])

    def _recomposed(self, word: str) -> list[int]:
        """Counts of a word that is not in composed form."""
        cuts = [k for k, c in enumerate(word) if not k or c.isascii() or not (unicodedata.combining(c) or c in _seconds())] + [len(word)]
        pieces = [word[a:b] for a, b in zip(cuts, cuts[1:])]
        normal = self.tok.normalizer.normalize_str
        whole = [self.lower[p] if len(p) == 1 else normal(p) for p in pieces]
        low = "".join(whole)
        ends, starts = self._low_counts(low, False)
        out: list[int] = []
        at, run, held = 0, -1, None
        for piece, end in zip(pieces, whole):
            while run + 1 < len(starts) and starts[run + 1] < at:
                run, held = run + 1, None
            for k in range(1, len(piece)):
                part = normal(piece[:k])
                if end.startswith(part):
                    out.append(ends[at + len(part) - 1])
                    continue
                begin = starts[run] if run >= 0 else 0
                before = ends[begin - 1] if begin else 0
                same = self._cut(low[at - 1 : at] + part)
                head = next(same) if at > begin else None
                if at - begin < 64:
                    out.append(before + self._low_counts(low[begin:at] + part, False)[0][-1])
                elif head is None or len(head) < 2:
                    out.append(ends[at - 1] + self._low_counts(part, False)[0][-1])
                else:
                    if held is None:
                        stop = starts[run + 1] if run + 1 < len(starts) else len(low)
                        data = self._in_bytes(low[begin:stop])
                        held = (data, *self._run(data)[:2], list(itertools.accumulate((len(c.encode()) for c in low[begin:stop]), initial=0)))
                    on, rest = head[1:], part[len(head) - 1 :]
                    n = self._extended(held[0], held[1], held[2], held[3][at - begin], self._in_bytes(on))
                    out.append(before + n + (self._low_counts(rest, False)[0][-1] if rest else 0))
            at += len(end)
            out.append(ends[at - 1])
        return out

    def _known(self, word: str):
        """A byte a prefix where that is enough, so that a text's table is one join of its words'."""
        got = self.words.get(word)
        if got is None:
            got = self.older.pop(word, None)
            if got is None:
                counts = self.word_counts(word)
                got = bytes(counts) if max(counts) < 256 else np.array(counts, np.int32)
            if len(self.words) >= self.max_words:  # what was of use since the last time stays
                self.words, self.older, self.runs = {"": b""}, self.words, {}
            self.words[word] = got
        return got

    def run_total(self, run: str) -> int:
        """closed at the end of a run: the same recurrence, which asks for no word end before it."""
        n = self.run_totals.get(run)
        if n is None:
            size = len(run)
            closed = [1] * size + [0]
            self.base = 0
            self._walk(run, 0, [-1] * (size + 1), [0] * (size + 1), closed)
            n = closed[size]
            if not n:
                raise ValueError(f"no segmentation of {run[:99]!r}")
            if size < 64:
                self.run_totals[run] = n
        return n

    def word_total(self, word: str) -> int:
        """The last of word_counts(word)."""
        plain = word.isascii() and word.isprintable()
        if plain and word.isalpha():
            return self.run_total(word.lower())
        if self.special.search(word) or not (plain or unicodedata.is_normalized("NFC", word)):
            return self.word_counts(word)[-1]
        if plain:
            return sum(map(self.run_total, _CUT.findall(word.lower())))
        low = "".join([self.lower[c] for c in word])
        return sum(self.run_total(self._in_bytes(run)) for run in self._cut(low) if run is not None)

    def _total(self, word: str) -> int:
        n = self.older_totals.pop(word, None)
        if n is None:
            n = self.word_total(word)
        if len(self.totals) >= self.max_totals:
            self.totals, self.older_totals, self.run_totals = {"": 0}, self.totals, {}
        self.totals[word] = n
        return n

    def within(self, text: str | None, budget: int) -> tuple[int, int]:
        """Tokens of a text, and longest_within() of its prefix counts; only the word at which the budget ends is looked into."""
        if not text:
            return 0, 0
        words = wordtok.blank(text).split(" ")
        totals = list(map(self.totals.get, words))
        if None in totals:
            known = self.totals
            for k, word in enumerate(words):
                if totals[k] is None:
                    # An earlier place in this text may have learned it.
                    n = known.get(word)
                    totals[k] = self._total(word) if n is None else n
                    known = self.totals
        total = sum(totals)
        if total <= budget:
            return total, len(text)
        # Counts before words never fall, so past the last word before which the budget holds every count is over.
        before = list(itertools.accumulate(totals, initial=0))
        k = bisect_right(before, budget) - 1
        inside = np.array([0, *(self.word_counts(words[k]) if words[k] else ())])
        return total, sum(map(len, words[:k])) + k + longest_within(inside, budget - before[k])

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """int32 array of length len(text) + 1: tokens of each prefix."""
        if not text:
            return np.zeros(1, np.int32)
        words = wordtok.blank(text).split(" ")
        known = list(map(self.words.get, words))
        if None in known:
            known = [self._known(w) if k is None else k for w, k in zip(words, known)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if all(type(k) is bytes for k in known):
            inside = np.frombuffer(b"\0".join(known), np.uint8).astype(np.int32)
        else:
            inside = np.concatenate([x for k in known for x in (np.frombuffer(k, np.uint8) if type(k) is bytes else k, np.zeros(1, np.int32))])[:-1].astype(np.int32)
        # Place of each word's first character and of the blank after it, in the text.
        after = np.cumsum(sizes + 1) - 1
        totals = np.where(sizes > 0, inside[np.maximum(after - 1, 0)], 0)
        before = np.concatenate([[0], np.cumsum(totals)])
        out = np.zeros(len(text) + 1, np.int32)
        out[1:] = inside + np.repeat(before[:-1], sizes + 1)[:-1]
        out[after[:-1] + 1] = before[1:-1]
        return out


class _Lower(dict):
    """The library's normalised form of a character."""

    def __init__(self, tok):
        self.tok = tok

    def __missing__(self, c: str) -> str:
        self[c] = c.lower() if c.isascii() else self.tok.normalizer.normalize_str(c)
        return self[c]


class _StandIn(dict):
    """For str.translate: a character of the class that the library sees in another, as the pattern's library may differ."""

    def __init__(self, tok):
        self.tok = tok

    def __missing__(self, code: int) -> int:
        c, pieces = chr(code), self.tok.pre_tokenizer.pre_tokenize_str
        if c.isascii() and c.isprintable():
            kind = code
        elif not pieces(c):
            kind = 0xA0
        elif len(pieces("a" + c)) == 1:
            kind = 0xE9
        else:
            kind = 0xA1 if len(pieces("!" + c)) == 1 else 0xB2
        self[code] = kind
        return kind


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters without a combining class that composing may join to the one before."""
    out = {chr(k) for k in itertools.chain(range(0x1161, 0x1176), range(0x11A8, 0x11C3))}
    for k in range(0xC0, 0x20000):
        d = unicodedata.decomposition(chr(k))
        if d and d[0] != "<" and " " in d:
            second = chr(int(d.split()[1], 16))
            if not unicodedata.combining(second):
                out.add(second)
    return frozenset(out)


def _byte_chars() -> list[str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the rest moves above 255."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(moved)) for b in range(256)]


@lru_cache(maxsize=1)
def _counter(tokenizer: str) -> PrefixCounter:
    return PrefixCounter(tokenizer)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix with at most budget tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType())])


def count_tokens(docs: DataFrame, budget: int, tokenizer: str = wordtok.DEFAULT_TOKENIZER, with_prefixes: bool = False) -> DataFrame:
    """Per row: bytes, tokens, whether over the budget, and the longest prefix within it.

    with_prefixes adds prefix_tokens array<int>, the whole table of the text.
    One narrow pass without a shuffle; a task holds a slice of rows and a
    bounded memory of words.
    """
    schema = T.StructType([*SCHEMA.fields, T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))]) if with_prefixes else SCHEMA

    def make():
        counter = _counter(tokenizer)  # its memory serves the next tasks of the process too

        def rows(ids: list, texts: list, sizes: list) -> Iterator[tuple]:
            for i, text, size in zip(ids, texts, sizes):
                n, fit = counter.within(text, budget)
                row = (i, size, n, n > budget, fit)
                yield (*row, counter.prefix_counts(text)) if with_prefixes else row

        return rows

    picked = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return arrow_rows(picked, schema, make)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), budget=2048)
