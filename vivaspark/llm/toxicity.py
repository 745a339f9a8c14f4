"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers work on a clause, each on what the one before writes:

* insult: letters of a word to its class and weight, by the learned lexicon and
  the closed lists (insult, threat, target, negation, report, quote, other);
* negation: insults and threats shortly after a negation become denied ones;
* reported speech: those after a reporting verb, or inside quotation marks,
  become quoted ones;
* target: an insult close behind a target, or a target close behind an insult,
  marks an attack;
* threat: a target close behind a threat marks a menace.

The last four are composed into one deterministic machine from classes to
roles, whose weights add to that of the insults. Clauses end at punctuation and
line ends; within a sentence, at commas and colons, the machine goes on. A
document's score is a logistic function of the weights of its matched clauses.

Targets, threats, negations and reporting verbs are closed lists, matched
without accents. Insults are learned: words, and beginnings of words of 3 to 10
letters, that mark toxic documents, with their log odds. Fitting reads at most
PER_CLASS labelled rows of each label, whole, chosen by a hash of the id;
scoring reads every text whole. Labels, language, source and id are never
inputs of a score. Two limits keep one word from deciding alone: a word says no
more than twice, and the largest clause counts up to 8, the mean up to 4.

Defined results: null, empty and blank texts get the score of a text without
any match; repeated rows get equal scores; without labelled rows of both kinds
the insult list is empty and only threats count; an empty table gives an empty
table; further columns are ignored, and all are kept by the filter.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vivaspark.llm.common import arrow_rows, crc_fold, give_back, small_batches, table

PER_CLASS = 3000
THRESHOLD = 0.7
#: Weight of a clause that few clean documents hold.
STRONG = 3.5

#: Classes that words have, then roles that the transducers write.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, DENIED, QUOTED, ATTACK, MENACE = range(11)
CLASSES, LABELS = range(7), range(11)
_CLOSED = {
    THREAT: "kill hurt destroy beat punish crush hunt burn tuer frapper detruire toten schlagen vernichten matar golpear destruir",
    TARGET: "you your yours yourself u he she him her they them tu toi vous il elle ils du dich dir ihr euch er sie ellos ella usted ustedes ti",
    NEGATION: "not no never isn aren wasn nicht kein keine nie pas jamais non nunca jamas",
    REPORT: "said says say told tells wrote writes claimed quoted called sagte schrieb dit ecrit dijo escribio",
}
CLOSED = {w: c for c, words in _CLOSED.items() for w in words.split()}
#: Words, what ends a clause, and quotation marks.
_TOKEN = re.compile(r"\w+|[.!?;:,|\n\"«»“”„]")
#: What ends a clause within a sentence: the machine goes on, so what was said before a colon still holds.
_SOFT = frozenset(",:")
_QUOTES = frozenset('"«»“”„')
_LEET = str.maketrans("013457", "oieast")


class Transducer:
    """Deterministic weighted machine: (state, read label) -> (state, written label, weight). State 0 is the start."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def run(self, labels: list[int]) -> tuple[list[int], float]:
        state, out, total = self.start, [], 0.0
        for label in labels:
            state, written, weight = self.arcs[state, label]
            out.append(written)
            total += weight
        return out, total

    def compose(self, other: Transducer) -> Transducer:
        """The machine that reads what this one reads and writes what the other makes of it; weights add. Reachable states only."""
        start = (self.start, other.start)
        arcs, waiting, seen = {}, [start], {start}
        while waiting:
            a, b = state = waiting.pop()
            for label in LABELS:
                if (a, label) not in self.arcs:
                    continue
                na, middle, wa = self.arcs[a, label]
                nb, written, wb = other.arcs[b, middle]
                arcs[state, label] = ((na, nb), written, wa + wb)
                if (na, nb) not in seen:
                    seen.add((na, nb))
                    waiting.append((na, nb))
        return Transducer(arcs, start)

    def dense(self) -> tuple[list[list[int]], list[list[float]]]:
        """Tables next[state][class] and weight[state][class]; the start is state 0."""
        names = {self.start: 0}
        for state, _ in self.arcs:
            names.setdefault(state, len(names))
        nxt, weight = [[0] * len(CLASSES) for _ in names], [[0.0] * len(CLASSES) for _ in names]
        for (state, label), (to, _, w) in self.arcs.items():
            if label in CLASSES:
                nxt[names[state]][label], weight[names[state]][label] = names[to], w
        return nxt, weight


def near(first: set[int], then: set[int], reach: int, role: dict[int, int], weight: float) -> Transducer:
    """A label of `then` at most reach labels after one of `first` is written as its role, with the weight."""
    arcs = {}
    for left, label in product(range(reach + 1), LABELS):
        met = left > 0 and label in then
        arcs[left, label] = (reach if label in first else max(0, left - 1), role.get(label, label) if met else label, weight if met else 0.0)
    return Transducer(arcs)


def within(role: dict[int, int], weight: float) -> Transducer:
    """Labels after a report, or between quotation marks, are written as their roles, with the weight each."""
    arcs = {}
    for (said, quoted), label in product(product((0, 1), (0, 1)), LABELS):
        inside = (said or quoted) and label in role
        arcs[(said, quoted), label] = ((int(said or label == REPORT), quoted ^ (label == QUOTE)), role[label] if inside else label, weight if inside else 0.0)
    return Transducer(arcs, (0, 0))


#: The grammar's parts in their order, and what each adds to a clause's weight.
def negation() -> Transducer:
    return near({NEGATION}, {INSULT, THREAT}, 3, {INSULT: DENIED, THREAT: DENIED}, -1.0)


def reported_speech() -> Transducer:
    return within({INSULT: QUOTED, THREAT: QUOTED}, -0.6)


def target() -> Transducer:
    """Whoever comes first: insults behind a target are attacks, and so is a target behind an insult."""
    before = near({TARGET}, {INSULT}, 4, {INSULT: ATTACK}, 0.4)
    return before.compose(near({INSULT}, {TARGET}, 4, {TARGET: ATTACK}, 0.4))


def threat() -> Transducer:
    return near({THREAT}, {TARGET}, 4, {TARGET: MENACE}, MENACE_WEIGHT)


#: A threat at a target weighs as much as a strong insult.
MENACE_WEIGHT = 3.5


def grammar() -> Transducer:
    return reduce(Transducer.compose, (negation(), reported_speech(), target(), threat()))


def bare(word: str) -> str:
    """A word without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _patterns(word: str) -> list[str]:
    """What may stand for a word in the lexicon: itself, and beginnings that it goes beyond."""
    return [word, *(word[:k] + "*" for k in range(3, min(len(word), 11)))]


class Model:
    """Lexicon and document weights; plain values, so it travels with the tasks."""

    def __init__(self, lexicon: dict[str, float], centre: list[float], scale: list[float], beta: list[float]):
        self.lexicon, self.centre, self.scale, self.beta = lexicon, centre, scale, beta

    def reader(self):
        return Reader(self)


class Reader:
    """A model at work in one task: the lexicon, the composed machine and a bounded memory of words."""

    def __init__(self, model: Model):
        self.model, self.words = model, {}
        self.next, self.weight = grammar().dense()

    def classify(self, word: str) -> tuple[int, float] | None:
        """(class, weight) of a word, None for a word that is no part of any pattern."""
        if word in _QUOTES:
            return QUOTE, 0.0
        if not word[0].isalnum():
            return OTHER, -1.0 if word in _SOFT else -2.0  # ends the clause, or the sentence
        lexicon = self.model.lexicon
        plain = word.translate(_LEET) if not word.isalpha() else word
        best = max((lexicon[p] for p in _patterns(plain) if p in lexicon), default=0.0)
        if best > 0:
            return INSULT, best
        plain = bare(word)
        return (CLOSED[plain], 0.0) if plain in CLOSED else None

    def clauses(self, text: str | None) -> tuple[list[float], int]:
        """Weights of the clauses that match anything, and the number of words."""
        words, known, out = tokens_of(text), self.words, []
        if len(known) > 300_000:
            known.clear()
        kinds = []
        for w in words:
            k = known.get(w, 0)
            if k == 0:
                k = known[w] = self.classify(w)
            kinds.append(k)
        state, total, hit, n = 0, 0.0, False, 0
        met: Counter = Counter()  # a word repeated on and on says no more than twice
        for w, k in zip(words, kinds):
            if k is None:
                n += 1
                if state:
                    total += self.weight[state][OTHER]
                    state = self.next[state][OTHER]
                continue
            label, value = k
            if value < 0:
                if hit:
                    out.append(max(0.0, total))
                state, total, hit = self.next[state][OTHER] if value == -1 else 0, 0.0, False
                continue
            n += label != QUOTE
            if value:
                met[w] += 1
                value = value if met[w] <= 2 else 0.0
            total += value + self.weight[state][label]
            hit = hit or label in (INSULT, THREAT) or self.weight[state][label] > 0
            state = self.next[state][label]
        if hit:
            out.append(max(0.0, total))
        return [x for x in out if x > 0], n

    def features(self, text: str | None) -> list[float]:
        weights, n = self.clauses(text)
        total = sum(weights)
        strong = sum(w >= STRONG for w in weights)
        return [math.log1p(total), min(max(weights, default=0.0), 8.0), min(total / math.sqrt(n + 4), 4.0), math.log1p(strong), math.log1p(n) * (total > 0)]

    def score(self, text: str | None) -> float:
        m = self.model
        z = m.beta[0] + sum(b * (x - c) / s for b, x, c, s in zip(m.beta[1:], self.features(text), m.centre, m.scale))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _lexicon(docs: list[set[str]], toxic: np.ndarray) -> dict[str, float]:
    """Words and beginnings with log odds of at least 1.5, seen in at least 3 toxic documents and 0.4 % of them."""
    n = (max(1, int((~toxic).sum())), max(1, int(toxic.sum())))
    least = max(3, 0.004 * n[1])
    # Only words of enough toxic documents, and beginnings of which enough have any, are counted in the others.
    met: Counter = Counter()
    for words, t in zip(docs, toxic):
        if t:
            met.update({p for w in words for p in _patterns(w)})
    often = {p: k for p, k in met.items() if k >= least and bare(p) not in CLOSED}
    del met
    clean: Counter = Counter()
    for words, t in zip(docs, toxic):
        if not t:
            clean.update({p for w in words for p in _patterns(w) if p in often})
    out = {}
    for p, k in often.items():
        odds = math.log((k + 0.5) / (n[1] + 1)) - math.log((clean[p] + 0.5) / (n[0] + 1))
        if odds >= 1.5:
            out[p] = round(min(odds, 6.0), 4)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _groups(texts: list[str | None]) -> list[int]:
    """A group for each text; texts that share one of four minimal hashes of word triples go together."""
    first: dict[tuple[int, int], int] = {}
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, t in enumerate(texts):
        words = tokens_of(t)
        h = np.array([zlib.crc32(" ".join(x).encode()) for x in zip(words, words[1:], words[2:])] or [zlib.crc32(" ".join(words).encode())], np.uint64)
        for k, factor in enumerate((2654435761, 2246822519, 3266489917, 668265263)):
            j = first.setdefault((k, int((h * np.uint64(factor) % np.uint64(4294967291)).min())), i)
            root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """Lexicon from all rows; document weights from rows whose lexicon came from the other half."""
    # Copies and near copies would count as so many witnesses; one of each group and label speaks.
    seen: dict[tuple, str] = {}
    groups = _groups(texts)
    for g, t, x in zip(groups, texts, toxic):
        seen.setdefault((g, int(bool(x))), t or "")
    texts, y = list(seen.values()), np.array([x for _, x in seen], bool)
    # Documents share one string a word.
    docs = [{sys.intern(w) for w in tokens_of(t) if len(w) >= 3 and w.isalpha()} for t in texts]
    if y.all() or not y.any():
        return Model({}, [0.0] * 5, [1.0] * 5, [-4.0, 1.0, 1.0, 1.0, 1.0, 0.0])
    half, x = np.array([zlib.crc32(t.encode()) >> 7 & 1 for t in texts]), np.zeros((len(y), 5))
    for k in (0, 1):
        own = np.flatnonzero(half == k)
        reader = Model(_lexicon([docs[i] for i in np.flatnonzero(half != k)], y[half != k]), [], [], []).reader()
        x[own] = [reader.features(texts[i]) for i in own]
    centre, scale = x.mean(0), x.std(0) + 1e-9
    beta = _logistic((x - centre) / scale, y.astype(float))
    return Model(_lexicon(docs, y), centre.tolist(), scale.tolist(), beta.tolist())


def train(docs: DataFrame, labels: DataFrame, fold: int | None = 1, folds: int = 3, per_class: int = PER_CLASS) -> Model:
    """Fit on at most per_class rows of each label, none of the held-out fold."""
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if fold is not None:
        ids = ids.filter(crc_fold("doc_id", folds) != fold)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [ids.filter((F.col("toxic") == 1) if t else (F.col("toxic") != 1)).orderBy(*order).limit(per_class) for t in (1, 0)]
    picked = chosen[0].union(chosen[1])
    # At most 2 * per_class ids and labels are broadcast; of rows that share an id the smallest text counts.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    model = fit([r["text"] for r in rows], [int(r["toxic"] == 1) for r in rows])
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, by a narrow pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        reader = shared.value.reader()

        def rows(ids: list, texts: list) -> Iterator[tuple]:
            return ((i, reader.score(t)) for i, t in zip(ids, texts))

        return rows

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    return arrow_rows(docs.select(F.col("doc_id").cast("long"), "text"), schema, make)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score THRESHOLD or more; all columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        reader = shared.value.reader()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield part.filter(pa.array([reader.score(t) < THRESHOLD for t in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
