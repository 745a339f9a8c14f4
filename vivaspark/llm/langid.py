"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into segments of SEGMENT bytes. Two gated recurrent
layers read a segment in both directions, and their states at a byte give that
byte's language probabilities. A document's are the mean over all its bytes.
Segments of many documents run side by side as matrix rows, one array operation
a step, so the cost is the number of bytes.

`fit` trains in numpy, by backpropagation through time and Adam, on SEGMENTS
segments a language from at most DOCS labelled texts a language, chosen by a
hash of the id. Segments are drawn by tasks from all over each whole text, so
what reaches the driver is SEGMENTS times SEGMENT bytes a language, however
long the texts are. Scoring labels every byte of every text. Language, source
and id are never inputs of a prediction.

Defined results: null texts and texts without a letter are `und` with score 0;
without any labelled text all are; equal texts get equal results, repeated rows
equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vivaspark.llm.common import arrow_rows, crc_fold, crc_mod, table

SEGMENT = 64
HIDDEN = 8
DOCS = 250
SEGMENTS = 1500
#: Symbol after the last byte of a text's last segment.
PAD = 256
#: Segments that run side by side; their states stay in a core's cache.
ROWS = 4096


class Network:
    """Weights: for each direction, input gates of each symbol and recurrent weights; then the labels' layer.

    Gate columns are reset, update, candidate. A sigmoid is half a tanh plus a
    half, with the half inside the tanh kept in the weights.
    """

    NAMES = ("in_f", "rec_f", "in_b", "rec_b", "out", "bias")

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]):
        self.langs, self.w = langs, weights

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        shape = {"in_f": (257, 3 * hidden), "rec_f": (hidden, 3 * hidden), "in_b": (257, 3 * hidden), "rec_b": (hidden, 3 * hidden), "out": (2 * hidden, len(langs)), "bias": (len(langs),)}
        scale = {"in_f": 0.4, "in_b": 0.4, "rec_f": 0.4, "rec_b": 0.4, "out": 0.4, "bias": 0.0}
        return cls(langs, {k: rng.normal(0, 1, s).astype(np.float32) * np.float32(scale[k]) for k, s in shape.items()})

    @staticmethod
    def _step(a: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gates (tanh of reset and update), candidate, and the next state; a is overwritten."""
        n = h.shape[1]
        gates = a[:, : 2 * n]
        gates += g[:, : 2 * n]
        np.tanh(gates, out=gates)
        cand = g[:, 2 * n :] * gates[:, :n]
        cand += g[:, 2 * n :]
        cand *= np.float32(0.5)
        cand += a[:, 2 * n :]
        np.tanh(cand, out=cand)
        new = h - cand
        new *= gates[:, n:]
        new += h
        new += cand
        new *= np.float32(0.5)
        return gates, cand, new

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(positions, rows, languages) of segments x, (positions, rows)."""
        steps, rows = x.shape
        n = self.w["rec_f"].shape[0]
        logits = np.empty((steps, rows, len(self.langs)), np.float32)
        a = np.empty((rows, 3 * n), np.float32)
        for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            table, rec, out = self.w["in_" + way], self.w["rec_" + way], np.ascontiguousarray(self.w["out"][:n] if way == "f" else self.w["out"][n:])
            h, g = np.zeros((rows, n), np.float32), np.empty((rows, 3 * n), np.float32)
            for t in order:
                np.take(table, x[t], axis=0, out=a, mode="clip")
                _, _, h = self._step(a, np.matmul(h, rec, out=g), h)
                if way == "f":
                    np.matmul(h, out, out=logits[t])
                else:
                    logits[t] += h @ out
        logits += self.w["bias"]
        np.exp(np.clip(logits, -30, 30, out=logits), out=logits)
        logits /= logits.sum(2, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the bytes of segments x (positions, rows) with labels y, and its gradients."""
        steps, rows = x.shape
        n, w, kept, states = self.w["rec_f"].shape[0], self.w, {}, {}
        for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h, kept[way], states[way] = np.zeros((rows, n), np.float32), [None] * steps, [None] * steps
            for t in order:
                g = h @ w["rec_" + way]
                gates, cand, new = self._step(w["in_" + way][x[t]], g, h)
                kept[way][t] = (gates, cand, h, g[:, 2 * n :])
                states[way][t] = h = new
        both = np.concatenate([np.stack(states["f"]), np.stack(states["b"])], axis=2)
        logits = both @ w["out"] + w["bias"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        mask = (x != PAD).astype(np.float32)[:, :, None] / max(1, int((x != PAD).sum()))
        loss = -float((np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (steps, rows, 1)), 2) + 1e-9) * mask).sum())
        d = p
        d[:, np.arange(rows), y] -= 1
        d *= mask
        grad = {"out": np.einsum("trh,trk->hk", both, d), "bias": d.sum((0, 1))}
        dboth = d @ w["out"].T
        for way, order, part in (("f", range(steps - 1, -1, -1), slice(0, n)), ("b", range(steps), slice(n, 2 * n))):
            rec, dh, drec, da = w["rec_" + way], np.zeros((rows, n), np.float32), np.zeros_like(w["rec_" + way]), np.empty((steps, rows, 3 * n), np.float32)
            for t in order:
                gates, cand, h, gc = kept[way][t]
                reset, update = gates[:, :n], gates[:, n:]
                dnew = dh + dboth[t][:, part]
                dcand = dnew * 0.5 * (1 - update) * (1 - cand**2)
                dupdate = dnew * 0.5 * (h - cand) * (1 - update**2)
                dreset = dcand * 0.5 * gc * (1 - reset**2)
                da[t] = np.concatenate([dreset, dupdate, dcand], axis=1)
                dg = np.concatenate([dreset, dupdate, dcand * 0.5 * (1 + reset)], axis=1)
                drec += h.T @ dg
                dh = dnew * 0.5 * (1 + update) + dg @ rec.T
            table = np.zeros_like(w["in_" + way])
            np.add.at(table, x.reshape(-1), da.reshape(-1, 3 * n))
            grad["in_" + way], grad["rec_" + way] = table, drec
        return loss, grad

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, languages); texts are not empty."""
        sizes = np.array([len(t) for t in texts])
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + place * SEGMENT
        left = np.minimum(np.repeat(sizes, pieces) - place * SEGMENT, SEGMENT)
        sums = np.zeros((len(owner), len(self.langs)))
        steps = np.arange(SEGMENT)[:, None]
        for at in range(0, len(owner), ROWS):
            s, n = starts[at : at + ROWS], left[at : at + ROWS]
            inside = steps < n
            x = np.where(inside, data[np.minimum(s + steps, len(data) - 1)].astype(np.int64), PAD)
            p = self.probabilities(x)
            p *= inside[:, :, None]
            sums[at : at + ROWS] = p.sum(0)
        out = np.zeros((len(texts), len(self.langs)))
        np.add.at(out, owner, sums)
        return out / sizes[:, None]


def draw(text: str, n: int, seed: int) -> list[bytes]:
    """n segments from all over a text; none of an empty one."""
    data, rng = text.encode(), np.random.default_rng(seed)
    starts = rng.integers(0, max(1, len(data) - SEGMENT // 2), n) if data else []
    return [data[at : at + SEGMENT] for at in starts]


def fit(pieces: list[bytes], langs: list[str], hidden: int = HIDDEN, epochs: int = 14, batch: int = 256, seed: int = 5) -> Network | None:
    """A network for the languages of these segments; None without any."""
    rng, names = np.random.default_rng(seed), sorted(set(langs))
    if not names:
        return None
    x = np.full((len(pieces), SEGMENT), PAD, np.int64)
    for row, piece in zip(x, pieces):
        row[: len(piece)] = np.frombuffer(piece, np.uint8)
    place = {name: k for k, name in enumerate(names)}
    net, y = Network.fresh(names, hidden, rng), np.array([place[lang] for lang in langs])
    first, second, step = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.02 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            _, grad = net.gradients(np.ascontiguousarray(x[rows].T), y[rows])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            step += 1
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def segments(docs: DataFrame, fold: int | None = 2, folds: int = 4, per_lang: int = DOCS, per_fit: int = SEGMENTS) -> DataFrame:
    """doc_id, lang and piece: at least per_fit segments of each language, from at most per_lang of its texts, none of the held-out fold.

    Every language is ranked by itself, so how many others or how many rows there
    are changes nothing. Of rows that share an id and a language the smallest text
    counts. The choice shuffles ids and languages only; the texts of the chosen
    ids follow by a join with them, per_lang rows a language.
    """
    known = docs.filter(F.col("lang").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull())
    if fold is not None:
        known = known.filter(crc_fold("doc_id", folds) != fold)
    ids = known.select("doc_id", "lang").distinct()
    # First per_lang of each language's salted parts, then of those: a language of most rows is no one task's.
    order = [F.xxhash64("doc_id", "lang"), F.col("doc_id")]
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order))
    first = ids.withColumn("k", part).filter(F.col("k") <= per_lang)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = first.withColumn("k", rank).filter(F.col("k") <= per_lang)
    chosen = chosen.withColumn("n", F.ceil(F.lit(float(per_fit)) / F.count("*").over(Window.partitionBy("lang"))).cast("int"))
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id", "lang", "n")), ["doc_id", "lang"]).groupBy("doc_id", "lang", "n").agg(F.min("text").alias("text"))

    def run(ids: list, langs: list, ns: list, texts: list) -> Iterator[tuple]:
        for i, lang, n, text in zip(ids, langs, ns, texts):
            for piece in draw(text, n, crc_mod(i, 1 << 32)):
                yield i, lang, piece

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("piece", T.BinaryType())])
    return arrow_rows(texts.select(F.col("doc_id").cast("long"), "lang", "n", "text"), schema, lambda: run, slice_rows=64)


def train(docs: DataFrame, fold: int | None = 2, folds: int = 4, per_lang: int = DOCS) -> Network | None:
    """Fit on segments of at most per_lang texts of each language, none of the held-out fold."""
    rows = segments(docs, fold, folds, per_lang).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["piece"]))
    return fit([r["piece"] for r in rows], [r["lang"] for r in rows])


PREDICTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row, in a narrow pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        net = shared.value

        def rows(ids: list, texts: list) -> Iterator[tuple]:
            if net is None:
                yield from ((i, "und", 0.0) for i in ids)
                return
            lettered = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            p = net.pooled([texts[k].encode() for k in lettered]) if lettered else np.zeros((0, 1))
            best, of = p.argmax(1), dict(zip(lettered, range(len(lettered))))
            for k, i in enumerate(ids):
                j = of.get(k)
                yield (i, "und", 0.0) if j is None else (i, net.langs[best[j]], min(1.0, float(p[j, best[j]])))

        return rows

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), "text"), PREDICTED, make, slice_rows=256)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
