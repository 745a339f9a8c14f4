"""Faces, emotions, sound levels, request digests and retry texts as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The interview's emotions, and how each of a classifier's is shared among them, in this order.
EMOTIONS = ("engaged", "confused", "nervous", "confident", "blank")
SHARES = {
    "happy": (0.85, 0.0, 0.0, 0.10, 0.05),
    "neutral": (0.05, 0.0, 0.05, 0.30, 0.60),
    "fear": (0.0, 0.10, 0.80, 0.0, 0.10),
    "surprise": (0.10, 0.65, 0.15, 0.0, 0.10),
    "sad": (0.0, 0.05, 0.60, 0.0, 0.35),
    "disgust": (0.0, 0.10, 0.50, 0.0, 0.40),
    "angry": (0.0, 0.05, 0.40, 0.10, 0.45),
}
#: Labels of classifiers and data sets as the interview's; what is not here is blank.
NAMES = {"happy": "engaged", "surprise": "confused", "surprised": "confused", "angry": "nervous", "disgust": "nervous", "fear": "nervous", "fearful": "nervous", "sad": "nervous", "engaged": "engaged", "confused": "confused", "nervous": "nervous", "confident": "confident"}
#: What the second and third try at a question are asked for.
ANGLES = ("Use a different technical mechanism or concept.", "Use a different failure mode or diagnostic scenario.")
#: Places of the points of a face among its landmarks.
POINTS = {"inner_l": 107, "inner_r": 336, "outer_l": 70, "outer_r": 300, "brow_1": 9, "brow_2": 10, "lid_l": 159, "lid_r": 386, "cheek_l": 50, "cheek_r": 280, "lip_l": 61, "lip_r": 291, "upper_1": 13, "upper_2": 14, "lower_1": 17, "lower_2": 18, "chin": 152, "nose": 1, "eye_l": 33, "eye_r": 263}
LEFT_EYE, RIGHT_EYE = (33, 160, 158, 133, 153, 144), (362, 385, 387, 263, 373, 380)
_LARGEST = 3.4028234663852886e38

Point = tuple[Column, Column]


def emotion(label: Column) -> Column:
    """a label as one of the interview's, blank for unknown ones and null."""
    known = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(label))), F.lit("blank"))


def score_class(score: Column) -> Column:
    """high from 4, medium from 2.5, else low."""
    return F.when(score >= 4, "high").when(score >= 2.5, "medium").when(score.isNotNull(), "low")


def shared_emotions(raw: Column) -> Column:
    """a classifier's map of emotions shared among the interview's: label, confidence and distribution (4 digits).

    Unknown emotions count as blank; ties go to the first of EMOTIONS; null where
    the map's values are about 0 together.
    """
    total = F.aggregate(F.map_values(raw), F.lit(0.0), lambda a, v: a + v)
    blank = [float(e == "blank") for e in EMOTIONS]
    table = F.create_map(*[x for k, w in SHARES.items() for x in (F.lit(k), F.array(*map(F.lit, w)))])
    weights = lambda e: F.coalesce(F.try_element_at(table, F.lower(e.key)), F.array(*map(F.lit, blank)))
    zero = F.array(*[F.lit(0.0)] * len(EMOTIONS))
    sums = F.aggregate(F.map_entries(raw), zero, lambda a, e: F.zip_with(a, weights(e), lambda x, w: x + e.value / total * w))
    top = F.array_max(sums)
    label = F.element_at(F.array(*map(F.lit, EMOTIONS)), F.array_position(sums, top).cast("int"))
    return F.when(total >= 1e-6, F.struct(label.alias("label"), top.alias("confidence"), F.transform(sums, lambda x: F.round(x, 4)).alias("distribution")))


def eye_contact(yaw: Column, pitch: Column) -> Column:
    """1 looking straight, less by 0.6 and 0.4 up to 30 degrees aside and 25 up or down."""
    away = 0.6 * F.least(F.abs(yaw) / 30, F.lit(1.0)) + 0.4 * F.least(F.abs(pitch) / 25, F.lit(1.0))
    return F.least(F.greatest(1 - away, F.lit(0.0)), F.lit(1.0))


def landmarks(points: Column) -> Callable[[int], Point]:
    """Places of an array of structs with x and y."""
    return lambda i: (F.get(points, F.lit(i)).x, F.get(points, F.lit(i)).y)


def _far(a: Point, b: Point) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def _middle(a: Point, b: Point) -> Point:
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def _share(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def action_units(at: Callable[[int], Point]) -> dict[str, Column]:
    """nine activations from distances on a face, in parts of the distance of the eyes."""
    p = {name: at(i) for name, i in POINTS.items()}
    apart = _far(p["eye_l"], p["eye_r"])
    unit = F.when(apart < 1e-6, 1.0).otherwise(apart)
    d = lambda a, b: _far(p[a] if isinstance(a, str) else a, p[b] if isinstance(b, str) else b) / unit
    both = lambda a, b: (d(f"{a}_l", f"{b}_l") + d(f"{a}_r", f"{b}_r")) / 2
    upper, lower = _middle(p["upper_1"], p["upper_2"]), _middle(p["lower_1"], p["lower_2"])
    lift = (p["nose"][1] - (p["lip_l"][1] + p["lip_r"][1]) / 2) / unit
    gap = d(upper, lower)
    return {
        "AU1": _share(both("inner", "lid"), 0.08, 0.18),
        "AU2": _share(both("outer", "lid"), 0.10, 0.22),
        "AU4": 1 - _share(d(_middle(p["brow_1"], p["brow_2"]), _middle(p["lid_l"], p["lid_r"])), 0.06, 0.14),
        "AU6": _share(0.20 - both("cheek", "lid"), 0.0, 0.08),
        "AU12": _share(d("lip_l", "lip_r") * 0.5 + lift, 0.15, 0.45),
        "AU15": _share(0.35 - lift, 0.0, 0.15),
        "AU17": _share(d("chin", lower), 0.04, 0.12),
        "AU23": _share(0.08 - gap, 0.0, 0.06),
        "AU25": _share(gap, 0.02, 0.10),
    }


def eye_aspect(at: Callable[[int], Point], otherwise: float = 0.3) -> Column:
    """mean aspect ratio of the eyes that have a width, 0.3 without one."""
    found = []
    for eye in (LEFT_EYE, RIGHT_EYE):
        p = [at(i) for i in eye]
        wide = _far(p[0], p[3])
        found.append(F.when(wide > 1e-6, F.try_divide(_far(p[1], p[5]) + _far(p[2], p[4]), 2 * wide)))
    n = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in found])
    return F.coalesce(F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in found]), n), F.lit(otherwise))


def levelled(samples: Column) -> Column:
    """samples with NaN as 0 and infinities as the largest number, scaled to a peak of 1 where it is above; null for none."""
    numbers = F.transform(samples, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.greatest(x.cast("double"), F.lit(-_LARGEST)), F.lit(_LARGEST))))
    peak = F.array_max(F.transform(numbers, F.abs))
    return F.when(F.size(samples) > 0, F.when(peak > 1, F.transform(numbers, lambda x: x / peak)).otherwise(numbers))


def latency(ms: Column) -> Column:
    """0 for what is missing, no number or negative."""
    x = ms.try_cast("double")
    return F.when(x > 0, x).otherwise(0.0)


def request_fingerprint(*values: Column) -> Column:
    """SHA-256 of a request's parts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), 256)


def retry_text(reasons: Column, rejected: Column, attempt: Column) -> Column:
    """what the second or third try at a question is told; null for others."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce(rejected, F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    angle = F.get(F.array(*map(F.lit, ANGLES)), attempt - 2)
    told = F.concat(F.lit("Previous rejection: "), F.array_join(reasons, "; "), F.lit(". Rejected output: "), quoted, F.lit(". Do not repeat or lightly rephrase that output. Retry "), attempt.cast("string"), F.lit(" of 3. "), angle)
    return F.when(attempt.isin(2, 3), told)


def duration(seconds: Column) -> Column:
    """a time to go, no more precise than it is: hours and minutes, minutes and seconds, or seconds."""
    s = F.greatest(F.rint(seconds).cast("long"), F.lit(0))
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(hours > 0, F.format_string("%dh %02dm", hours, minutes)).when(minutes > 0, F.format_string("%dm %02ds", minutes, s % 60)).otherwise(F.format_string("%ds", s))
