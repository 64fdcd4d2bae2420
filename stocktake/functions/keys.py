"""Expressions over object keys and other text of an inventory."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(key: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(key, "/", -1)


def prefix(key: Column) -> Column:
    """What precedes the last slash; ``/`` for keys without one."""
    return F.when(F.instr(key, "/") == 0, F.lit("/")).otherwise(F.left(key, F.length(key) - F.length(name(key)) - 1))


def encode(pre: Column, leaf: Column) -> Column:
    """A key from prefix and name. Not an inverse for keys like ``//x``, whose prefix is ``/`` too."""
    return F.when(pre == "/", leaf).otherwise(F.concat(pre, F.lit("/"), leaf))


def ancestors(key: Column) -> Column:
    """All directories above a key, nearest first, each with its slash, then the empty root."""
    parts = F.split(key, "/")
    depth = F.size(parts) - 1
    ups = F.transform(F.when(depth > 0, F.sequence(depth, F.lit(1))).otherwise(F.array().cast("array<int>")), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    return F.concat(ups, F.array(F.lit("")))


def segment_index(key: Column, bounds: list[str]) -> Column:
    """The range a key falls into: ranges include their upper bound and exclude the lower one."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < key))


def tsv_escape(text: Column) -> Column:
    """Backslash, tab and line ends as two characters each."""
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def tsv_unescape(text: Column) -> Column:
    """What ``tsv_escape`` was given; NUL, which no key holds, stands in for a backslash meanwhile."""
    text = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\\", "\0")):
        text = F.replace(text, F.lit(shown), F.lit(raw))
    return text


def csv_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def sanitize_path(text: Column) -> Column:
    """A path component: anything but ASCII letters, digits, ``-``, ``_`` and ``.`` becomes ``_``; so does an empty one."""
    safe = F.regexp_replace(text, r"[^A-Za-z0-9\-_.]", "_")
    return F.when(safe == "", "_").otherwise(safe)


def human_bytes(n: Column) -> Column:
    """``512 B``, ``1.50 KiB`` and so on to TiB, by powers of 1024 with two decimals."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.2f", n.cast("double") / float(1024**i)), F.lit(f" {unit}"))).otherwise(out)
    return out


def error_class(code: Column) -> Column:
    """Name, number and whether a try again may help, for an error code of the listing API."""
    number = F.lit(255)
    for codes, errno in reversed(ERROR_NUMBERS):
        number = F.when(code.isin(*codes), errno).otherwise(number)
    label = F.lit("Unknown")
    for errno, text in ERROR_NAMES:
        label = F.when(number == errno, text).otherwise(label)
    return F.struct(number.alias("errno"), label.alias("name"), (number < 16).alias("retryable"))


# The error numbers of the listing API's codes, and their names.
ERROR_NUMBERS = [
    (("NoSuchBucket",), 16),
    (("AccessDenied",), 17),
    (("PermanentRedirect",), 18),
    (("SignatureDoesNotMatch",), 19),
    (("AuthorizationHeaderMalformed",), 20),
    (("SlowDown",), 21),
    (("TooManyRequests", "ThrottlingException"), 22),
    (("InternalError", "InternalFailure"), 23),
    (("ServiceUnavailable", "RequestTimeout"), 24),
]
ERROR_NAMES = [
    (1, "StreamTimeout"),
    (2, "ClientGeneric"),
    (3, "ClientConnectionTimeout"),
    (4, "MissingRegion"),
    (16, "NoSuchBucket"),
    (17, "AccessDenied"),
    (18, "PermanentRedirect"),
    (19, "SignatureDoesNotMatch"),
    (20, "AuthorizationHeaderMalformed"),
    (21, "SlowDown"),
    (22, "TooManyRequests"),
    (23, "InternalError"),
    (24, "ServiceUnavailable"),
]
