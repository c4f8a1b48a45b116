"""Names, keys, durations, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without zone; free of the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def normal_stem(stem: Column) -> Column:
    """Lower case without one trailing edit mark."""
    return F.regexp_replace(F.lower(stem), r"_(edit|edited|retouched|v\d+|crop|copy)$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shot_key(path: Column) -> Column:
    """Files of one exposure share folder and name up to its first dot."""
    return F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.lower(F.substring_index(file_name(path), ".", 1)))


def folded_text(text: Column) -> Column:
    """Lower case, white space runs as one blank, trimmed: the text's stem."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def token_set(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))


def slug(*parts: Column) -> Column:
    """Keyword of parts: lower case, other characters as one hyphen, joined by bars."""
    clean = [F.regexp_replace(F.regexp_replace(F.lower(p), r"[^a-z0-9]+", "-"), r"^-|-$", "") for p in parts]
    return F.concat_ws("|", *clean)


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def hamming_hex(left: Column, right: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal strings, in two halves of 32 bits."""
    half = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("long")
    return F.bit_count(half(left, 1).bitwiseXOR(half(right, 1))) + F.bit_count(half(left, 9).bitwiseXOR(half(right, 9)))


def parse_duration(text: Column) -> Column:
    """Seconds of ``90s``, ``15m``, ``1h30m``, ``2d``, ``HH:MM[:SS]``, with an optional sign; null if it's none of these."""
    body = F.regexp_replace(F.lower(F.trim(text)), r"^[+-]", "")
    sign = F.when(F.trim(text).startswith("-"), -1).otherwise(1)
    unit = lambda u: F.coalesce(F.expr("null").cast("double"), F.nullif(F.regexp_extract(body, rf"(\d+(?:\.\d+)?){u}", 1), F.lit("")).cast("double"), F.lit(0.0))
    units = unit("d") * 86400 + unit("h") * 3600 + unit("m") * 60 + unit("s")
    at = lambda i: F.coalesce(F.try_element_at(F.split(body, ":"), F.lit(i)).try_cast("double"), F.lit(0.0))
    clock = at(1) * 3600 + at(2) * 60 + at(3)
    named = body.rlike(r"^(\d+(\.\d+)?d)?(\d+(\.\d+)?h)?(\d+(\.\d+)?m)?(\d+(\.\d+)?s)?$") & (body != "")
    return sign * F.when(named, units).when(body.rlike(r"^\d{1,3}:\d{2}(:\d{2})?$"), clock)


def format_duration(seconds: Column) -> Column:
    """``45s``, ``3m10s``, ``1h02m``; ``?`` for null."""
    s = F.floor(seconds).cast("long")
    return (
        F.when(seconds.isNull(), "?")
        .when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def redacted(text: Column) -> Column:
    """Text without local paths: of Windows (a drive letter) and of Unix (two levels or more)."""
    mark = "<redacted-path>"
    return F.regexp_replace(F.regexp_replace(text, r"[A-Za-z]:\\[^\s\"']+", mark), r"(?<![\w/.<])/(?:[^\s/\"'<>]+/)+[^\s\"'<>]*", mark)


def version_numbers(version: Column) -> Column:
    """The release numbers of a version, four of them, missing ones 0."""
    found = F.transform(F.regexp_extract_all(F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1), F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.coalesce(F.try_element_at(found, i), F.lit(0)))


def version_satisfies(version: Column, specifier: str) -> Column:
    """Whether a version meets all parts of a specifier such as ``>=1.2,<2``, ``~=1.4.2`` or ``==1.3.*``; an empty one is always met."""
    have, ok = version_numbers(version), F.lit(True)
    for part in filter(None, map(str.strip, specifier.split(";")[0].split(","))):
        op = next((o for o in ("~=", "==", "!=", ">=", "<=", ">", "<") if part.startswith(o)), None)
        if op is None:
            return F.lit(False)
        wanted = part[len(op) :].strip()
        numbers = [int(n) for n in wanted.removesuffix(".*").split(".")]
        full = F.array(*[F.lit(n) for n in (numbers + [0] * 4)[:4]])
        if wanted.endswith(".*") or op == "~=":
            lead = numbers if wanted.endswith(".*") else numbers[:-1]
            same = F.slice(have, 1, len(lead)) == F.array(*map(F.lit, lead))
            ok = ok & {"~=": same & (have >= full), "!=": ~same}.get(op, same)
        else:
            ok = ok & {"==": have == full, "!=": have != full, ">=": have >= full, "<=": have <= full, ">": have > full, "<": have < full}[op]
    return ok


def set_name(number: Column, start: Column) -> Column:
    """Zero-padded number and time of the first capture of a set."""
    return F.concat_ws("_", F.lpad(number.cast("string"), 3, "0"), F.date_format(start, "yyyyMMdd_HHmm"))
