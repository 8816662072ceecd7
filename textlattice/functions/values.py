"""Column expressions over short values: identifiers, addresses, dates, sizes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Patterns of identifiers.
ISBN_IN_TEXT = r"(?i)(?:97[89][-\s]?)?[\d][-\s\d]{8,}[\dXx]"
WORK_ID = r"W[1-9][0-9]*"
OPEN_LIBRARY_ID = r"OL[0-9]+"
SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"


def _normal(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else " ".join(sorted(re.findall(r"\w+", unicodedata.normalize("NFKC", v).casefold()))))


def normal_title(x: Column) -> Column:
    """Word runs of the compatibility form without case, sorted and joined. Spark has neither that form nor case folding."""
    return F.pandas_udf(_normal, StringType())(x)


def isbn_in(x: Column) -> Column:
    """The first run of a text that reads like an ISBN, without dashes and blanks; its check digit isn't looked at."""
    return F.nullif(F.regexp_replace(F.regexp_extract(x, ISBN_IN_TEXT, 0), r"[-\s]", ""), F.lit(""))


def is_work_id(x: Column) -> Column:
    return x.rlike(rf"\A(?:{WORK_ID})\z")


def open_library_id(x: Column, kind: str) -> Column:
    """The last step of a path where it is an id of the kind: M for editions, W for works, A for authors."""
    key = F.element_at(F.split(x, "/", -1), -1)
    return F.when(key.rlike(rf"\A{OPEN_LIBRARY_ID}{kind}\z"), key)


def iso_day(x: Column) -> Column:
    """The date where it is written as year, month and day and exists."""
    return F.when(x.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(x, "yyyy-MM-dd"))


def language_subtag(x: Column) -> Column:
    """The first part of a language tag in small letters."""
    return F.lower(F.split_part(F.trim(x), F.lit("-"), F.lit(1)))


def any_language(languages: Column, wanted: Column) -> Column:
    """Whether a row has one of the languages of a comma-separated list."""
    return F.arrays_overlap(languages, F.split(wanted, ","))


def search_input(x: Column) -> Column:
    """struct(kind, value): what a search box holds is an ISBN, a positive catalog number (after any #), or a title."""
    t = F.regexp_replace(x, r"^\s+|\s+$", "")
    compact, number = F.regexp_replace(t, r"[\s-]", ""), F.regexp_replace(t, "^#+", "")
    isbn, positive = compact.rlike(r"\A(?:\d{13}|\d{9}[\dXx])\z"), number.rlike(r"\A\d+\z") & (number.try_cast("long") > 0)
    value = F.when(isbn, F.upper(compact)).when(positive, number.try_cast("long").cast("string")).otherwise(t)
    return F.struct(F.when(isbn, "isbn").when(positive, "gutenberg").otherwise("title").alias("kind"), value.alias("value"))


def normal_url(u: Column) -> Column:
    """An address without a scheme gets https."""
    return F.when(u.rlike(SCHEME), u).otherwise(F.concat(F.lit("https://"), u))


def url_name(u: Column) -> Column:
    """The last step of an address's path."""
    return F.regexp_extract(u, r"([^/?#]+)/?(?:[?#].*)?$", 1)


def shown_bytes(b: Column) -> Column:
    """A size with its unit, one place after the point from KB on."""
    show = lambda div, unit: F.concat(F.bround((b / div).cast("decimal(38,18)"), 1).cast("decimal(38,1)").cast("string"), F.lit(unit))
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1 << 20, show(1024.0, " KB")).when(b < 1 << 30, show(1048576.0, " MB")).otherwise(show(1073741824.0, " GB"))


def public_url(u: Column) -> Column:
    """Whether an address may be fetched: http or https, no credentials, and no host that is local, private, link-local or multicast by its name or number."""
    part = lambda name: F.try_parse_url(u, F.lit(name))
    host = part("HOST")
    octet = lambda k: F.split_part(host, F.lit("."), F.lit(k)).try_cast("int")
    four = host.rlike(r"\A\d+\.\d+\.\d+\.\d+\z")
    private = octet(1).isin(0, 10, 127) | (octet(1) >= 224) | ((octet(1) == 169) & (octet(2) == 254)) | ((octet(1) == 192) & (octet(2) == 168)) | ((octet(1) == 172) & octet(2).between(16, 31))
    six = host.rlike(r"(?i)\A\[(?:::1?\]|::ffff:|f[cd]|fe[89ab]|ff)")
    return F.coalesce(part("PROTOCOL").isin("http", "https") & part("USERINFO").isNull() & (host != "localhost") & ~(four & private) & ~six, F.lit(False))
