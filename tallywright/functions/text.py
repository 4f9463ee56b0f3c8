"""Normalising messy text, money, dates and quantities, as native column expressions.

Patterns carry ``(?U)`` where the rules are about Unicode digits or white space.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of the closed accented set and what they fold to, each base letter with its accented forms (fixed values).
ACCENTED = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåāą", "c": "çćč", "d": "đðď", "e": "èéẻẽẹêềếểễệëēęě", "i": "ìíỉĩịïîī", "n": "ñńň",
    "o": "òóỏõọôồốổỗộơờớởỡợöō", "r": "ř", "s": "śšş", "t": "ťţ", "u": "ùúủũụưừứửữựüûūů", "y": "ỳýỷỹỵÿ", "z": "źżž", "l": "ĺľ", "g": "ğ",
}
_FROM = "".join(ACCENTED.values())
_TO = "".join(base * len(forms) for base, forms in ACCENTED.items())


def apart(value: Column) -> Column:
    """``value``, worked out by itself: not within the generated method of its stage, which the JVM compiles up to a length only."""
    return F.transform(F.array(F.lit(0)), lambda _: value)[0]


def text(value: Column) -> Column:
    """Null as the empty string: extracted values are never null."""
    return F.coalesce(value, F.lit(""))


#: White space of any Unicode kind, information separators included (fixed values).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(value: Column) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.btrim(value, F.lit(WHITE))


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _unmarked(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_each(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else [None if x is None else unicodedata.normalize("NFC", x) for x in v])


def compose(value: Column) -> Column:
    """Unicode NFC, exactly, in Arrow batches: there is no built-in for it."""
    return _nfc(value)


def normalize_unicode(value: Column) -> Column:
    """NFC, then stripped; empty for null."""
    return strip(compose(text(value)))


def normalize_each(values: Column) -> Column:
    """:func:`normalize_unicode` of each text of an array; no Arrow function works within one."""
    return F.transform(_nfc_each(F.transform(values, text)), strip)


def strip_then_compose(value: Column) -> Column:
    """Stripped, then NFC: the order that dictionary building takes."""
    return compose(strip(text(value)))


def normalize_money(value: Column) -> Column:
    """Digits, with a minus if the first character is a minus or an opening bracket; both separators are thousands'."""
    bare = F.regexp_replace(strip(text(value)), r"(?U)[đĐ₫\s]", "")
    kept = F.regexp_replace(bare, r"(?U)[^\d]", "")
    return F.when(kept == "", "").otherwise(F.concat(F.when(F.substring(bare, 1, 1).isin("-", "("), "-").otherwise(""), kept))


def normalize_date(value: Column) -> Column:
    """DD/MM/YYYY out of four forms; anything else stripped only. No calendar check."""
    v = strip(text(value))
    dashed = F.regexp_replace(v, r"(?U)^(\d{2})-(\d{2})-(\d{4})$", "$1/$2/$3")
    dotted = F.regexp_replace(dashed, r"(?U)^(\d{2})\.(\d{2})\.(\d{4})$", "$1/$2/$3")
    return F.regexp_replace(dotted, r"(?U)^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1")


def normalize_time(value: Column) -> Column:
    """Stripped."""
    return strip(text(value))


#: Whole numbers that a double holds exactly, with zeros after the point or none: what most quantities are.
_WHOLE = r"^[1-9][0-9]{0,14}(?:[.,]0*)?\z"
_NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"


def _whole(number: Column) -> Column:
    """All digits of a whole double, exact below 2**95: as its part above 32 bits and the one below."""
    unit = F.lit(float(1 << 32))
    above = F.floor(number / unit).cast("bigint")
    exact = above.cast("decimal(28,0)") * F.lit(1 << 32).cast("decimal(10,0)") + (number - above * unit).cast("bigint")
    return F.when(F.abs(number) < float(1 << 62), number.cast("bigint").cast("string")).when(F.abs(number) < float(1 << 94), exact.cast("string")).otherwise(number.cast("string"))


def _plain(number: Column) -> Column:
    """A double as its shortest decimal digits: a whole number without a fraction, an exponent only below 0.0001 (``1e-05``)."""
    told = F.abs(number).cast("string")
    digits = F.regexp_replace(F.regexp_replace(told, r"E.*$", ""), r"\.0$", "")
    bare = F.replace(digits, F.lit("."), F.lit(""))
    power = F.coalesce(F.regexp_extract(told, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    moved = F.concat(F.substring(bare, F.lit(1), power + 1), F.lit("."), F.substring(bare, power + 2, F.char_length(bare)))
    part = (
        F.when(power == 0, told).when(power > 0, moved).when(power >= -4, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), bare))
        .otherwise(F.concat(digits, F.lit("e-"), F.lpad((-power).cast("string"), F.greatest(F.lit(2), F.char_length((-power).cast("string"))), F.lit("0"))))
    )
    return F.when(number == F.rint(number), _whole(number)).otherwise(F.concat(F.when(number < 0, "-").otherwise(""), part))


def normalize_quantity(value: Column) -> Column:
    """A number in its shortest form, a comma taken as the point; of other text the ASCII digits and points.

    The comma of text that is no number goes: ``4,378kg`` is ``4378``. NaN and
    infinity, which are no quantities, are null.
    """
    v = F.replace(strip(text(value)), F.lit(","), F.lit("."))
    special = F.lower(v).rlike(r"^[+-]?(?:nan|inf|infinity)$")
    kept = F.regexp_replace(strip(text(value)), r"(?U)[^\d.]", "")
    return F.when(v == "", "").when(special, F.lit(None)).when(v.rlike(_NUMBER), _plain(v.try_cast("double"))).otherwise(kept)


def normalize_type(value: Column) -> Column:
    """Stripped and in lower case."""
    return F.lower(strip(text(value)))


def money_for_compare(value: Column) -> Column:
    """Digits without leading zeros, ``0`` if none are left; the sign is ignored. Empty stays empty."""
    v = text(value)
    # A zero is put before the digits, so that one is left where there are no others. Plain numbers are told by one look.
    kept = F.regexp_replace(F.concat(F.lit("0"), F.regexp_replace(v, r"(?U)[^\d]", "")), "^0+(?=.)", "")
    return F.when(v == "", "").when(v.rlike(r"^[1-9][0-9]*\z"), v).otherwise(kept)


def quantity_for_compare(value: Column) -> Column:
    """The number without trailing zeros, the comma taken as the point; text that is no number as it is left."""
    kept = F.replace(F.regexp_replace(F.lower(text(value)), r"(?U)[^\d.,]", ""), F.lit(","), F.lit("."))
    number = kept.try_cast("double")
    return F.when(text(value) == "", "").when(text(value).rlike(_WHOLE), F.regexp_extract(text(value), "^[0-9]+", 0)).when(kept.rlike(_NUMBER), _plain(number)).otherwise(kept)


def fold_accents(value: Column) -> Column:
    """Lower case without the marks of the closed accented set, white space collapsed."""
    lowered = F.translate(F.lower(text(value)), _FROM, _TO)
    return strip(F.regexp_replace(lowered, r"(?U)\s+", " "))


def remove_marks(value: Column) -> Column:
    """As :func:`fold_accents` for all of Unicode, in Arrow batches."""
    lowered = F.translate(F.lower(_unmarked(text(value))), "đð", "dd")
    return strip(F.regexp_replace(lowered, r"(?U)\s+", " "))


def block_prefix(lowered: Column) -> Column:
    """First three code points."""
    return F.substring(lowered, 1, 3)


def block_length(lowered: Column) -> Column:
    """Length in fours."""
    return F.floor(F.char_length(lowered) / 4).cast("int")


def hostname(url: Column) -> Column:
    """The URL's host in lower case, without user and port; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^\[|\]$", ""))


def basename(url: Column, image_suffix: bool = False) -> Column:
    """The last segment after a slash; with ``image_suffix``, ``.jpg`` is added where no image suffix is."""
    last = F.element_at(F.split(url, "/"), -1)
    return F.when(last.rlike(r"(?i)\.(?:jpe?g|png|webp|gif|bmp)$"), last).otherwise(F.concat(last, F.lit(".jpg"))) if image_suffix else last


def host_allowed(url: Column, domains: Column) -> Column:
    """Whether the host is one of ``domains`` or below one."""
    host = hostname(url)
    return F.coalesce(F.exists(domains, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))), F.lit(False))


def cache_key(phash: Column, version: Column) -> Column:
    """Key of a cached extraction."""
    return F.format_string("ocr:phash:%s:psv:%s", phash, version)


def requeue_key(job_id: Column) -> Column:
    """Key of a job's requeue count."""
    return F.format_string("ocr:requeue:%s", job_id)


def mismatch_field(path: Column) -> Column:
    """Index and field of ``product[i].field``; null index for a base field."""
    at = F.regexp_extract(path, r"^product\[(\d+)\]\.(.+)$", 1)
    return F.struct(F.when(at != "", at.cast("int")).alias("index"), F.when(at != "", F.regexp_extract(path, r"^product\[(\d+)\]\.(.+)$", 2)).otherwise(path).alias("field"))


def split_label(path: Column) -> Column:
    """dev or test by the file's stem, else full."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    return F.when(F.contains(stem, F.lit("dev")), "dev").when(F.contains(stem, F.lit("test")), "test").otherwise("full")


def seconds_until_hour(now: Column, hour: int = 2, least: int = 60) -> Column:
    """Seconds until the next full ``hour`` of the day, ``least`` at least."""
    today = F.date_trunc("day", now) + F.expr(f"INTERVAL {hour} HOURS")
    upcoming = F.when(now < today, today).otherwise(today + F.expr("INTERVAL 1 DAY"))
    return F.greatest(F.lit(least).cast("double"), upcoming.cast("double") - now.cast("double"))
