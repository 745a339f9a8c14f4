"""Recordings in a column: base64, limits, and what RIFF and WebM headers say, as column expressions.

Only bytes of the headers are read and no sound is decoded, so a table of
recordings is one narrow scan. A RIFF file's chunks are walked, at most CHUNKS of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes and seconds that a recording may have, and what a longer text is refused for before it is decoded.
MOST_BYTES, MOST_SECONDS = 20 * 1024 * 1024, 300
MOST_ENCODED = MOST_BYTES * 4 // 3 + 4096
#: Chunks of a RIFF file, and bytes of a WebM file, that are looked at.
CHUNKS, HEAD = 16, 4096


def encoded(text: Column) -> Column:
    """What follows a data URL's `base64,`, or the whole text."""
    at = F.instr(text, "base64,")
    return F.when(at > 0, F.substring(text, at + 7, F.length(text))).otherwise(text)


def decoded(base64: Column) -> Column:
    """The bytes of strict base64, null where it is none."""
    strict = (F.length(base64) % 4 == 0) & base64.rlike("^[A-Za-z0-9+/]*={0,2}$")
    return F.when(strict, F.try_to_binary(base64, F.lit("base64")))


def little_endian(data: Column, at: Column | int, n: int) -> Column:
    """An unsigned number of n bytes from place `at`, counted from 1."""
    h = F.hex(F.substring(data, at, n))
    return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))]), 16, 10).cast("long")


def _tag(data: Column, at: Column | int, tag: bytes) -> Column:
    return F.hex(F.substring(data, at, len(tag))) == tag.hex().upper()


def riff(data: Column) -> Column:
    """rate, channels, bits and seconds of a RIFF WAVE file, null for others or without both chunks.

    A data chunk that claims more than there is has what there is.
    """
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(13).cast("long").alias("at"), none.alias("rate"), none.alias("channels"), none.alias("bits"), none.alias("speed"), none.alias("bytes"))

    def step(s: Column, _: Column) -> Column:
        size = little_endian(data, s.at + 4, 4)
        is_format, is_data = _tag(data, s.at, b"fmt "), _tag(data, s.at, b"data")
        there = F.octet_length(data) - (s.at + 7)
        read = lambda old, at, n: F.when(is_format, little_endian(data, s.at + 8 + at, n)).otherwise(old)
        fields = [read(s.channels, 2, 2).alias("channels"), read(s.bits, 14, 2).alias("bits"), read(s.speed, 8, 4).alias("speed")]
        found = F.when(is_data, F.least(size, there)).otherwise(s.bytes)
        # Once the data are found, or nothing is left, the walk stands still.
        move = F.when(s.bytes.isNull() & ~is_data & size.isNotNull(), s.at + 8 + size + size % 2).otherwise(s.at)
        return F.struct(move.alias("at"), read(s.rate, 4, 4).alias("rate"), *fields, F.coalesce(s.bytes, found).alias("bytes"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(CHUNKS)), start, step)
    ok = _tag(data, 1, b"RIFF") & _tag(data, 9, b"WAVE")
    return F.when(ok, F.struct(walked.rate.alias("rate"), walked.channels.alias("channels"), walked.bits.alias("bits"), F.try_divide(walked.bytes.cast("double"), walked.speed).alias("seconds")))


def big_endian_float(digits: Column) -> Column:
    """A positive IEEE 754 number from its 8 or 16 hexadecimal digits; null for others."""
    whole = lambda d: F.conv(d, 16, 10).cast("double")
    bits = F.conv(digits, 16, 10).cast("long")
    one = (1 + (bits % (1 << 23)) / (1 << 23)) * F.pow(F.lit(2.0), F.floor(bits / (1 << 23)) - 127)
    two = (1 + whole(F.substring(digits, 4, 13)) / 2.0**52) * F.pow(F.lit(2.0), whole(F.substring(digits, 1, 3)) - 1023)
    return F.when(F.length(digits) == 8, one).when(F.length(digits) == 16, two)


def webm(data: Column) -> Column:
    """rate and seconds of a WebM file from its first HEAD bytes, null for others; seconds are null where it states none, as live recordings do."""
    head = F.hex(F.substring(data, 1, HEAD))
    # An element's id, its length, its value; `(?:..)*?` keeps to whole bytes.
    found = lambda pattern, i: F.regexp_extract(head, pattern, i)
    length = found("^(?:..)*?4489(?:84(.{8})|88(.{16}))", 1), found("^(?:..)*?4489(?:84(.{8})|88(.{16}))", 2)
    rate = found("^(?:..)*?E1..(?:..){0,24}?B5(?:84(.{8})|88(.{16}))", 1), found("^(?:..)*?E1..(?:..){0,24}?B5(?:84(.{8})|88(.{16}))", 2)
    scale = F.coalesce(F.conv(F.nullif(found("^(?:..)*?2AD7B183(.{6})", 1), F.lit("")), 16, 10).cast("double"), F.lit(1e6))
    pick = lambda pair: big_endian_float(F.coalesce(F.nullif(pair[0], F.lit("")), F.nullif(pair[1], F.lit(""))))
    return F.when(_tag(data, 1, b"\x1a\x45\xdf\xa3"), F.struct(pick(rate).cast("long").alias("rate"), (pick(length) * scale / 1e9).alias("seconds")))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later expressions read, but do not compute again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def recordings(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Keep, and outcome, bytes, kind, rate and seconds of recordings in base64, with or without a data URL's beginning.

    Outcomes, the first that holds: missing, too_large, undecodable, empty,
    too_long, accepted. A length that the header does not state is not too long.
    """
    rows = _once(df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("_text")), "_body", encoded(F.col("_text")))
    body, data, wave, web = F.col("_body"), F.col("_data"), F.col("_wave"), F.col("_web")
    rows = _once(rows, "_data", F.when(F.length(body) <= MOST_ENCODED, decoded(body)))
    rows = _once(_once(rows, "_wave", riff(data)), "_web", webm(data))
    seconds, n = F.coalesce(wave.seconds, web.seconds), F.octet_length(data)
    outcome = F.when(F.col("_text").isNull(), "missing").when(F.length(body) > MOST_ENCODED, "too_large").when(data.isNull(), "undecodable").when(n == 0, "empty").when(n > MOST_BYTES, "too_large").when(seconds > MOST_SECONDS, "too_long").otherwise("accepted")
    kind = F.when(wave.isNotNull(), "wav").when(web.isNotNull(), "webm")
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], outcome.alias("outcome"), n.alias("bytes"), kind.alias("kind"), F.coalesce(wave.rate, web.rate).alias("rate"), seconds.alias("seconds"))
