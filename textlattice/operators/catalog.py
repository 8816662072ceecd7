"""Catalog search: filters, rolling dates, federation over providers and paging.

A catalog is a table (source, id, title, authors, language, publication_date, kind,
categories, isbn). What a caller asks for is checked before any plan is built.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlattice.functions.values import normal_title

PAGE_SIZE, MAX_PAGE = 32, 312
PROVIDERS = ["gutendex", "openalex"]
#: The provider whose paging ends at MAX_PAGE.
CAPPED = "openalex"
#: What a book lacks and an edition has, and what an edition adds.
FILLED, EDITION_FACTS = ["publisher", "date", "number_of_pages"], ["edition_id", "cover_id", "subjects"]
#: Works of one title up to which a match is trusted.
CANDIDATES = 10
DOMAINS = [f"domain:{k}" for k in range(1, 5)]
# What the kind "academic" stands for, and the rolling windows in days.
ACADEMIC = ["article", "preprint", "review", "dissertation", "report", "conference-paper"]
WINDOWS = {"today": 0, "7days": 6, "30days": 29, "year": 364}
KINDS = {"book": ["book"], "academic": ACADEMIC, "other": ["other"]}
# Text formats by preference.
FORMATS = ["text/plain; charset=utf-8", "text/plain; charset=us-ascii", "text/plain", "text/html; charset=utf-8", "text/html"]


class SearchError(ValueError):
    """The combination of filters isn't supported."""


def date_window(keys: Iterable[str], today: date) -> tuple[date, date] | None:
    """All windows end today, so the widest contains the others."""
    keys = list(keys)
    if unknown := set(keys) - set(WINDOWS):
        raise SearchError(f"unknown dates: {sorted(unknown)}")
    return (today - timedelta(days=max(WINDOWS[k] for k in keys)), today) if keys else None


def kinds_of(keys: Iterable[str]) -> list[str]:
    if unknown := set(keys) - set(KINDS):
        raise SearchError(f"unknown kinds: {sorted(unknown)}")
    return [t for k in KINDS if k in set(keys) for t in KINDS[k]]


def capable(sources: Iterable[str], page: int = 1, isbn: str | None = None, number: int | None = None, dates: Iterable[str] = (), categories: Iterable[str] = (), kinds: Iterable[str] = ()) -> None:
    """Raises where a provider can't answer what is asked; every provider is checked before any is asked."""
    sources, categories, kinds = set(sources), list(categories), set(kinds)
    domains = [c for c in categories if c in DOMAINS]
    subjects = [c for c in categories if c not in DOMAINS]
    if bad := [c for c in subjects if not c.startswith("subject:") or c[8:] != c[8:].strip() or not c[8:]]:
        raise SearchError(f"unknown categories: {sorted(bad)}")
    if "gutendex" in sources:
        if list(dates):
            raise SearchError("gutendex has no publication dates")
        if domains or len(subjects) > 1:
            raise SearchError("gutendex takes one subject and no domains")
        if kinds - {"book"}:
            raise SearchError("gutendex only has books")
    if "openalex" in sources:
        if isbn or number is not None:
            raise SearchError("openalex knows neither ISBN nor catalog numbers")
        if subjects:
            raise SearchError("openalex takes domains and no subjects")
        if page > MAX_PAGE:
            raise SearchError(f"openalex has pages 1 to {MAX_PAGE}")


def matches(query: str | None = None, isbn: str | None = None, dates: Iterable[str] = (), categories: Iterable[str] = (), kinds: Iterable[str] = (), languages: Iterable[str] = (), today: date | None = None, number: int | None = None) -> Column:
    """Any value within a dimension, all dimensions together. A catalog number goes before an ISBN, and that before a query."""
    c = F.lit(True)
    if number is not None:
        c &= F.col("id") == number
    elif isbn:
        c &= F.col("isbn") == isbn
    elif query:
        c &= F.contains(F.lower("title"), F.lit(query.lower()))
    if span := date_window(dates, today or date.today()):
        c &= F.col("publication_date").between(*(F.lit(x) for x in span))
    if categories := list(categories):
        c &= F.arrays_overlap("categories", F.array(*map(F.lit, categories)))
    if types := kinds_of(kinds):
        c &= F.col("kind").isin(types)
    if languages := list(languages):
        c &= F.col("language").isin(languages)
    return c


def page_of(rows: DataFrame, page: int, partition: list[str], order: list) -> DataFrame:
    """The page of each partition with its true count; beyond the last page nothing."""
    if page < 1:
        raise SearchError("pages begin with 1")
    totals = rows.groupBy(*partition).agg(F.count("*").alias("total"))
    # a partition's first rows are kept while ranking, so no task holds a whole provider
    w = Window.partitionBy(*partition).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= page * PAGE_SIZE).where(F.col("rank") > (page - 1) * PAGE_SIZE)
    return ranked.join(F.broadcast(totals), partition)  # a row per provider


def search_catalog(catalog: DataFrame, page: int = 1, sources: Iterable[str] = PROVIDERS, **filters) -> DataFrame:
    """The same page of every provider, one after the other, nothing merged, with next_page and previous_page of the whole.

    One provider ends at page MAX_PAGE; while it is among the sources there is no page after that (see paging_warning).
    """
    sources = list(sources)
    if unknown := set(sources) - set(PROVIDERS):
        raise SearchError(f"unknown sources: {sorted(unknown)}")
    if CAPPED in sources and page > MAX_PAGE:
        raise SearchError(f"{CAPPED} has pages 1 to {MAX_PAGE}")
    rows = catalog.where(F.col("source").isin(sources) & matches(**filters))
    more = rows.groupBy("source").agg(F.count("*").alias("n")).agg((F.max("n") > page * PAGE_SIZE).alias("more"))
    out = page_of(rows, page, ["source"], [F.col("id")]).join(F.broadcast(more))  # one row
    nxt = F.when(F.col("more") & F.lit(not (CAPPED in sources and page == MAX_PAGE)), page + 1)
    out = out.withColumns({"next_page": nxt, "previous_page": F.lit(page - 1 if page > 1 else None).cast("int")}).drop("more")
    return out.withColumn("provider_ord", F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("source")))


def paging_warning(totals: dict[str, int], page: int) -> str | None:
    """Why there is no next page although matches remain. totals: matches of each provider that was asked."""
    if CAPPED in totals and page == MAX_PAGE and any(n > page * PAGE_SIZE for n in totals.values()):
        return f"{CAPPED} ends at page {MAX_PAGE} ({MAX_PAGE * PAGE_SIZE:,} results); narrow the search, or ask other sources alone"
    return None


def search_books(catalog: DataFrame, text: str, page: int = 1, sources: Iterable[str] = PROVIDERS, **filters) -> DataFrame:
    """A search by what a search box holds: an ISBN, a catalog number after any #, or words of a title."""
    compact, number = text.replace("-", "").replace(" ", "").upper(), text.strip().lstrip("#")
    if re.fullmatch(r"\d{13}|\d{9}[\dX]", compact):
        own = {"isbn": compact}
    elif number.isdecimal() and int(number) > 0:
        own = {"number": int(number)}
    else:
        own = {"query": text.strip()}
    return search_catalog(catalog, page, sources, **own, **filters)


def disambiguate(rows: DataFrame, key: list[str]) -> DataFrame:
    """not found (no row), book (one) or choice (the first ten of several) for each key."""
    # counted apart, so that the window keeps only ten rows of a key while it ranks
    n = rows.groupBy(*key).agg(F.count("*").alias("n"))
    d = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where("rank <= 10")
    return d.join(n, key).withColumn("outcome", F.when(F.col("n") == 1, "book").otherwise("choice"))


def pick_format(formats: Column) -> Column:
    """The address of the first preferred format, else of the first other text that isn't zipped."""
    other = F.filter(F.map_entries(formats), lambda e: F.contains(e["key"], F.lit("text")) & ~F.contains(e["key"], F.lit("zip")))
    return F.coalesce(*(formats[f] for f in FORMATS), F.when(F.size(other) > 0, F.element_at(other, 1)["value"]))


def valid_isbn(x: Column) -> Column:
    """The compact ISBN where its check digit holds, else null."""
    v = F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s-]", ""))
    digit = lambda i: F.substring(v, i, 1)
    s13 = sum((digit(i).try_cast("int") * (1 if i % 2 else 3) for i in range(1, 14)), F.lit(0))
    s10 = sum((F.when(digit(i) == "X", 10).otherwise(digit(i).try_cast("int")) * (11 - i) for i in range(1, 11)), F.lit(0))
    return F.when(v.rlike(r"^\d{13}$") & (s13 % 10 == 0), v).when(v.rlike(r"^\d{9}[\dX]$") & (s10 % 11 == 0), v)


def enrich(books: DataFrame, editions: DataFrame, works: DataFrame) -> DataFrame:
    """Left join: by valid ISBN to editions, else by exact normal title and an author in common to the only such work.

    A title with over CANDIDATES works isn't looked at, as a provider that returns that many shows only a part.

    books: id, title, authors, isbn, and any of FILLED; editions: isbn, any of FILLED and of EDITION_FACTS, which come
    along; works: work_id, title, authors. A work never fills what an edition would, and nothing that a book has is
    overwritten.
    """
    fill = [c for c in FILLED if c in books.columns and c in editions.columns]
    facts = [c for c in EDITION_FACTS if c in editions.columns]
    b = books.withColumns({"key": valid_isbn(F.col("isbn")), "t": normal_title(F.col("title"))})
    ed = editions.select(F.col("isbn").alias("key"), F.lit(True).alias("ed_found"), *(F.col(c).alias(f"ed_{c}") for c in fill), *facts).dropDuplicates(["key"])
    b = b.join(ed, "key", "left")
    pairs = b.where(F.col("key").isNull()).select("id", "t", F.explode("authors").alias("author")).withColumn("author", normal_title(F.col("author"))).distinct()
    titled = works.select("work_id", "authors", normal_title(F.col("title")).alias("t"))
    few = titled.groupBy("t").agg(F.count_distinct("work_id").alias("n")).where(F.col("n") <= CANDIDATES).select("t")
    w = titled.join(few, "t").select("work_id", "t", F.explode("authors").alias("author")).withColumn("author", normal_title(F.col("author"))).distinct()
    one = pairs.join(w, ["t", "author"]).groupBy("id").agg(F.min("work_id").alias("work_id"), F.max("work_id").alias("other")).where("work_id = other").drop("other")
    b = b.join(one, "id", "left")
    method = F.when(F.col("ed_found"), "isbn").when(F.col("work_id").isNotNull(), "title_author")

    def filled(c: str) -> Column:
        own = F.col(c)
        if c == "number_of_pages":  # a count of pages is a positive one
            return F.coalesce(F.when(own > 0, own), F.when(F.col(f"ed_{c}") > 0, F.col(f"ed_{c}"))).alias(c)
        return F.coalesce(F.nullif(own, F.lit("")), F.col(f"ed_{c}")).alias(c)

    return b.select("id", method.alias("match_method"), "work_id", *(filled(c) for c in fill), *facts)
