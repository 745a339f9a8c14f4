"""Feature plans of fused turns: named features, ordered scaling rules, masks, confidences, imputation.

A plan is compiled from names when the query is made: each name meets the
first rule that fits and becomes one column expression, so a turn is one narrow
projection. Which fields a struct has is known from its type; a field that is
not there reads as null, and stands back for its fallback.

Only imputation depends on earlier turns: an imputed value enters the history
that later gaps are filled from. Turns are dealt by candidate and sorted, and
a task walks through them in Arrow batches with the last few vectors in hand,
so no candidate's turns are ever gathered. Rows are best dealt before their
vectors are made, which are many times wider.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Names of classes and features, in the order of the fused vector.
COMPETENCIES = ("beginner", "mid", "expert")
EMOTIONS = ("blank", "nervous", "confused", "engaged", "confident")
ACTION_UNITS = ("AU1", "AU2", "AU4", "AU6", "AU12", "AU15", "AU17", "AU23", "AU25")
TEXT = (
    *("stt_confidence", "stt_response_latency_ms", "transcript_word_count", "transcript_duration_ms"),
    *("semantic_similarity", "question_relevance", "answer_completeness", "semantic_confidence"),
    *(f"competency_{c}_prob" for c in COMPETENCIES),
)
VISION = (
    *("vision_confidence", "emotion_confidence", "eye_contact_score", "blink_rate", "blink_rate_deviation"),
    *(f"vision_emotion_{e}_prob" for e in EMOTIONS),
    *("gaze_yaw", "gaze_pitch", "head_roll", "head_pitch", "head_yaw"),
    *(f"au_{a}_activation" for a in ACTION_UNITS),
    *(f"au_{a}_deviation" for a in ACTION_UNITS),
)
PROSODY = (
    *("pitch_mean", "pitch_variance", "pitch_range", "speech_rate", "pause_count", "pause_total_duration_ms", "disfluency_count"),
    *("prosody_response_latency_ms", "energy_mean", "jitter", "shimmer", "speech_to_silence_ratio"),
    *("pitch_deviation", "rate_deviation", "energy_deviation"),
    *(f"mfcc_{i}" for i in range(1, 14)),
)
MODALITIES = {"text": TEXT, "vision": VISION, "prosody": PROSODY}


def positive(x: Column) -> Column:
    """What is above 0 of a finite number; null stays null, which greatest() would make 0."""
    return (x + F.abs(x)) / 2


def unit(x: Column) -> Column:
    """a finite number cut to [0, 1], null stays null."""
    return F.when(x > 1, 1.0).otherwise(positive(x))


def compressed(x: Column, scale: float) -> Column:
    """x / (x + scale) of what is above 0."""
    return positive(x) / (positive(x) + scale)


def signed(x: Column, scale: float) -> Column:
    """tanh(x / scale)."""
    return F.tanh(x / scale)


@dataclass(frozen=True)
class Rule:
    """A scaling of the names that hold, start or end with one of some words."""

    scale: Callable[[Column], Column]
    holds: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()

    def fits(self, name: str) -> bool:
        return any(w in name for w in self.holds) or name.startswith(self.starts or "\0") or name.endswith(self.ends or "\0")


def _above(scale: float, *holds: str, **more: tuple[str, ...]) -> Rule:
    return Rule(lambda x: compressed(x, scale), holds, **more)


def _around(scale: float, *holds: str, **more: tuple[str, ...]) -> Rule:
    return Rule(lambda x: signed(x, scale), holds, **more)


#: Fixed values, F32: rules in their order, the first that fits counts. So a blink
#: rate's deviation is a blink rate, and a pause's duration a duration.
RULES = (
    Rule(unit, ("confidence", "activation"), ends=("_prob", "_score")),
    _above(5000.0, "latency", "duration", ends=("_ms",)),
    _above(100.0, "word_count"),
    _above(10.0, "pause_count", "disfluency_count"),
    _above(60.0, "blink_rate"),
    _above(300.0, "pitch_mean"),
    _above(150.0, "pitch_variance", "pitch_range"),
    _above(8.0, "speech_rate"),
    _above(1.0, "energy_mean"),
    _above(1.0, "jitter", "shimmer"),
    _above(10.0, "speech_to_silence_ratio"),
    _around(2.0, "deviation"),
    _around(45.0, "gaze_yaw", "gaze_pitch"),
    _around(45.0, "head_roll", "head_pitch", "head_yaw"),
    _around(50.0, starts=("mfcc_",)),
    Rule(lambda x: x),
)


def rule_of(name: str) -> int:
    """Number of the first rule that fits a name; the last one takes what is left."""
    low = name.lower()
    return next((i for i, r in enumerate(RULES[:-1]) if r.fits(low)), len(RULES) - 1)


def number(x: Column) -> Column:
    """x as a finite number, null where it is none; NaN is above infinity."""
    d = x.cast("double")
    return F.when(F.abs(d) < float("inf"), d)


def scaled(name: str, x: Column) -> Column:
    """F32: a feature's value by the first rule that fits its name; null where it is no finite number."""
    return RULES[rule_of(name)].scale(number(x))


def raw_vector(names: tuple[str, ...], raw: dict[str, Column]) -> Column:
    """The named values as finite numbers, null where one is missing."""
    return F.array(*[number(raw[n]) if n in raw else F.lit(None).cast("double") for n in names])


def scaled_vector(names: tuple[str, ...], raw: Column) -> Column:
    """The plan of a list of names over a raw_vector, which is a column of its own, so that each value is made once."""
    return F.array(*[RULES[rule_of(n)].scale(F.get(raw, F.lit(i))) for i, n in enumerate(names)])


class Fields:
    """Fields of a struct column by name; null for those that its type does not have."""

    def __init__(self, df: DataFrame, column: str):
        kind = df.schema[column].dataType if column in df.columns else None
        self.column, self.names = column, set(kind.names) if isinstance(kind, T.StructType) else set()

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def __call__(self, *names: str) -> Column:
        """The first of the names that the type has, whether or not it is null in a row."""
        found = next((n for n in names if n in self.names), None)
        return F.col(self.column).getField(found) if found else F.lit(None)

    @property
    def there(self) -> Column:
        return F.col(self.column).isNotNull() if self.names else F.lit(False)


def _inner(field: Column, df: DataFrame, column: str, name: str, key: str) -> Column:
    """A key of a struct or map field."""
    kind = df.schema[column].dataType[name].dataType if column in df.columns and name in df.schema[column].dataType.names else None
    if isinstance(kind, T.MapType):
        return F.try_element_at(field, F.lit(key))
    return field.getField(key) if isinstance(kind, T.StructType) and key in kind.names else F.lit(None)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x made once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def distribution(weights: Column, labels: tuple[str, ...]) -> Column:
    """shares of the labels in a map, keys in any case; null if they are all about 0. Of keys that agree the last counts."""
    keys = F.reverse(F.transform(F.map_keys(weights), lambda k: F.lower(F.trim(k))))
    values = F.reverse(F.transform(F.map_values(weights), lambda v: unit(number(v))))

    def shares(e: Column) -> Column:
        at = lambda label: (F.array_position(e.getField("keys"), label) - 1).cast("int")
        parts = F.array(*[F.coalesce(F.get(e.getField("values"), at(x)), F.lit(0.0)) for x in labels])
        total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
        return _once(parts, lambda p: _once(total(p), lambda t: F.when(t > 1e-8, F.transform(p, lambda v: v / t))))

    return _once(F.struct(keys.alias("keys"), values.alias("values")), shares)


def label_distribution(label: Column, confidence: Column, labels: tuple[str, ...], default: float = 0.70) -> Column:
    """the label's confidence, the others sharing the rest; null for an unknown label."""
    own = F.lower(F.trim(label.cast("string")))
    conf = F.coalesce(unit(number(confidence)), F.lit(default))
    return F.when(own.isin(*labels), F.array(*[F.when(own == x, conf).otherwise((1 - conf) / max(len(labels) - 1, 1)) for x in labels]))


def _shares(df: DataFrame, column: str, maps: tuple[str, ...], label: Column, confidence: Column, labels: tuple[str, ...]) -> Column:
    fields = Fields(df, column)
    found = [distribution(fields(m), labels) for m in maps if m in fields]
    return F.coalesce(*found, label_distribution(label, confidence, labels))


@dataclass(frozen=True)
class Plan:
    """raw values, presence and confidence of a modality. `shares` is one array with the values of `shared`, to be made once."""

    raw: dict[str, Column]
    there: Column
    sure: Column
    shared: tuple[str, ...] = ()
    shares: Column | None = None


def text_plan(df: DataFrame, stt: str = "stt", semantic: str = "semantic") -> Plan:
    """the text modality. A missing confidence is not replaced by the recogniser's."""
    s, m = Fields(df, stt), Fields(df, semantic)
    transcript, words = s("transcript").cast("string"), s("word_timestamps")
    sure = m("semantic_confidence", "confidence")
    span = F.lit(None)
    if "word_timestamps" in s:
        span = positive(number(F.get(words, F.size(words) - 1).end) - number(F.get(words, F.lit(0)).start)) * 1000
    raw = {
        "stt_confidence": s("confidence"),
        "stt_response_latency_ms": s("response_latency_ms"),
        "transcript_word_count": F.coalesce(F.regexp_count(transcript, F.lit(r"(?U)\w+")), F.lit(0)),
        "transcript_duration_ms": span,
        **{n: m(n) for n in ("semantic_similarity", "question_relevance", "answer_completeness")},
        "semantic_confidence": sure,
    }
    maps = ("competency_distribution", "competency_probs", "competency_probabilities")
    shares = _shares(df, semantic, maps, m("predicted_competency"), sure, COMPETENCIES)
    return Plan(raw, (F.coalesce(F.length(transcript), F.lit(0)) > 0) | m.there, sure, tuple(f"competency_{c}_prob" for c in COMPETENCIES), shares)


def vision_plan(df: DataFrame, vision: str = "vision") -> Plan:
    """the vision modality."""
    v = Fields(df, vision)
    sure = v("vision_confidence", "confidence", "emotion_confidence")
    part = lambda name, key: _inner(v(name), df, vision, name, key)
    raw = {
        "vision_confidence": sure,
        "emotion_confidence": v("emotion_confidence"),
        "eye_contact_score": v("eye_contact_score", "eye_contact_ratio"),
        "blink_rate": v("blink_rate"),
        "blink_rate_deviation": v("blink_rate_deviation"),
        **{f"gaze_{k}": part("gaze_vector", k) for k in ("yaw", "pitch")},
        **{f"head_{k}": part("head_pose", k) for k in ("roll", "pitch", "yaw")},
        **{f"au_{a}_{kind}": part(f"au_{kind}s", a) for kind in ("activation", "deviation") for a in ACTION_UNITS},
    }
    shares = _shares(df, vision, ("emotion_distribution",), v("emotion_label", "dominant_emotion"), v("emotion_confidence"), EMOTIONS)
    return Plan(raw, v.there, sure, tuple(f"vision_emotion_{e}_prob" for e in EMOTIONS), shares)


def prosody_plan(df: DataFrame, prosody: str = "prosody") -> Plan:
    """the prosody modality; without a confidence, the share of six main values that are there."""
    p = Fields(df, prosody)
    raw = {n: p(n) for n in PROSODY}
    raw["prosody_response_latency_ms"] = p("response_latency_ms")
    raw |= {f"mfcc_{i}": F.get(p("mfcc_vector"), F.lit(i - 1)) if "mfcc_vector" in p else F.lit(None) for i in range(1, 14)}
    main = ("pitch_mean", "speech_rate", "energy_mean", "jitter", "shimmer", "speech_to_silence_ratio")
    seen = sum((number(p(n)).isNotNull().cast("double") for n in main), F.lit(0.0)) / len(main)
    return Plan(raw, p.there, F.coalesce(p("prosody_confidence").cast("double"), seen))


def turn_features(df: DataFrame, keep: list[str], stt: str = "stt", semantic: str = "semantic", vision: str = "vision", prosody: str = "prosody") -> DataFrame:
    """keep, and a modality's struct of scaled values (null: missing), mask and confidence, in narrow projections, one after the other where a value is used often."""
    plans = {"text": text_plan(df, stt, semantic), "vision": vision_plan(df, vision), "prosody": prosody_plan(df, prosody)}
    first = df.select("*", *[p.shares.alias(f"s_{m}") for m, p in plans.items() if p.shared])
    values = {m: p.raw | {x: F.get(f"s_{m}", F.lit(i)) for i, x in enumerate(p.shared)} for m, p in plans.items()}
    raw = first.select(*keep, *[F.when(p.there, raw_vector(MODALITIES[m], values[m])).alias(f"r_{m}") for m, p in plans.items()], *[number(p.sure).alias(f"c_{m}") for m, p in plans.items()])
    scaled_ = raw.select(*keep, *[F.when(F.col(f"r_{m}").isNotNull(), scaled_vector(names, F.col(f"r_{m}"))).alias(f"v_{m}") for m, names in MODALITIES.items()], *[unit(F.col(f"c_{m}")).alias(f"c_{m}") for m in MODALITIES])
    out = []
    for m, names in MODALITIES.items():
        v = F.col(f"v_{m}")
        observed = F.size(F.filter(v, lambda x: x.isNotNull())) / len(names)
        sure = F.when(v.isNotNull(), F.coalesce(F.col(f"c_{m}"), observed)).otherwise(0.0)
        out.append(F.struct(v.alias("values"), v.isNotNull().cast("double").alias("mask"), sure.alias("confidence")).alias(m))
    return scaled_.select(*keep, *out)


#: What a turn gets: the fused vector and the names of its imputed features.
_FILLED = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("imputed", T.ArrayType(T.StringType()))])


def dealt(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows by candidate, in order; narrow projections keep them so.

    Their work, not their size, is large, so the session's number of partitions is
    taken as it is: adaptive execution would join small ones.
    """
    by = [F.col(f"`{c}`") for c in (key, *order)]
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by[0]).sortWithinPartitions(*by)


def filled(turns: DataFrame, key: str, order: list[str], n: int = 5) -> DataFrame:
    """walked() over turns in any order."""
    return walked(dealt(turns, key, order), key, n)


def walked(turns: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Turns, dealt(), with `vector`, all modalities' values in order, and `imputed`, the names of those that were missing.

    A missing value is the mean of the candidate's last n vectors of that
    modality, 0 without any. A turn without the modality leaves its history as it
    is; a turn with it enters, with its imputed values. Turns with null keys are
    one candidate's.
    """
    rest = [c for c in turns.columns if c not in MODALITIES]
    schema = T.StructType([*turns.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)]).schema.fields, *_FILLED.fields])
    wide, names = {m: len(f) for m, f in MODALITIES.items()}, [x for f in MODALITIES.values() for x in f]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, past, to, own = object(), {}, to_arrow_schema(schema), pa.array(names)
        for b in batches:
            who, *parts = (b.column(i) for i in range(b.num_columns - len(wide) - 1, b.num_columns))
            there = {m: np.array(p.is_valid(), bool) for m, p in zip(wide, parts)}
            vectors = {m: np.full((b.num_rows, w), np.nan) for m, w in wide.items()}
            for m, p in zip(wide, parts):
                vectors[m][there[m]] = p.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide[m])
            holes = {m: np.isnan(x) for m, x in vectors.items()}
            gaps = [(m, vectors[m], holes[m], holes[m].any(axis=1).tolist(), there[m].tolist()) for m in wide]
            for i, k in enumerate(who.to_pylist()):
                if k != now:
                    now, past = k, {m: deque(maxlen=n) for m in wide}
                for m, x, hole, some, has in gaps:
                    if some[i]:
                        x[i, hole[i]] = np.mean(past[m], axis=0)[hole[i]] if past[m] else 0.0
                    if has[i]:
                        past[m].append(x[i])
            past = {m: deque((x.copy() for x in p), n) for m, p in past.items()}  # rows of a batch hold all of it
            hole = np.concatenate(list(holes.values()), axis=1)
            starts = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            full = np.concatenate(list(vectors.values()), axis=1)
            vector = pa.ListArray.from_arrays(starts(np.full(b.num_rows, full.shape[1])), pa.array(full.ravel()), type=to.field("vector").type)
            imputed = pa.ListArray.from_arrays(starts(hole.sum(axis=1)), own.take(pa.array(np.nonzero(hole)[1])), type=to.field("imputed").type)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], vector, imputed], schema=to)

    sent = turns.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)], F.col(f"`{key}`").alias("_key"), *[F.col(f"{m}.values").alias(f"_{m}") for m in MODALITIES])
    done = sent.mapInArrow(walk, schema)
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(rest)], "vector", "imputed")
