"""The library of saved scans: joins, merges, integrity checks, and the filters of its listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Names of sources, and kinds by schema.
SOURCES = {"gutenberg": "gutendex", "gutendex": "gutendex", "document": "upload", "upload": "upload", "openalex": "openalex", "kindle": "kindle"}
KINDS = ["book", "academic", "canon", "collection", "other"]
KIND_BY_SCHEMA = {"canonical_scripture": "canon", "essay_or_story_collection": "collection", "standard_book": "book", "sectioned_book": "book", "flat": "book"}


def ordered_names(links: DataFrame, key: str, position: str, name: str) -> DataFrame:
    """Each key's names in the order of their positions."""
    return links.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, name))), lambda x: x[name]).alias("authors"))


def library_list(books: DataFrame, metadata: DataFrame, publishers: DataFrame, schemas: DataFrame, authors: DataFrame, author_key: str = "metadata_id") -> DataFrame:
    """Books with their metadata; publisher, scan and authors where there are any."""
    d = books.join(metadata, "metadata_id").join(publishers, "publisher_id", "left").join(schemas, "schema_id", "left").join(authors, author_key, "left")
    return d.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def newest(rows: DataFrame, limit: int, source: str | None = None) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit goes from 1 to 500")
    rows = rows if source is None else rows.where(F.col("source") == source)
    return rows.orderBy(F.col("created_at").desc(), F.col("id")).limit(limit)


def scoped(rows: DataFrame, owner: str | int, owner_col: str = "user_id") -> DataFrame:
    """The rows of one owner, who must be named: every read of a library goes through here."""
    if owner is None or owner == "":
        raise ValueError("an owner is required")
    return rows.where(F.col(owner_col) == owner)


def get_result(requests: DataFrame, books: DataFrame, metadata: DataFrame) -> DataFrame:
    """requests: request, id. Whether each book is there, with its source and title."""
    d = requests.join(books, "id", "left").join(metadata, "metadata_id", "left")
    return d.select("request", F.col("source").isNotNull().alias("found"), "source", "title")


def integrity(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, violations: the rows that break each rule, counted."""
    parts = [d.agg(F.count("*").alias("violations")).select(F.lit(k).alias("rule"), "violations") for k, d in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# What a saved record may hold.
RECORD_SOURCES, RECORD_FORMATS, SCAN_SCOPES = ["gutenberg", "upload"], ["epub"], ["paragraph", "sentence", "clause", "word"]


def violations(source: Column, book: Column, fmt: Column, blob: Column, scan: Column, created_at: Column, updated_at: Column) -> Column:
    """What is wrong with a saved record, in order; empty for a valid one. book, blob, scan: structs; types are the table's own."""
    missing = lambda c, name: F.when(c.isNull(), f"{name} is required")
    rules = [
        missing(source, "source"), F.when(~source.isin(RECORD_SOURCES), "unknown source"),
        missing(book, "book"), F.when(book.isNotNull() & book["title"].isNull(), "book.title is required"),
        F.when(F.exists(book["authors"], lambda a: a["name"].isNull()), "book.authors.name is required"),
        missing(fmt, "format"), F.when(~fmt.isin(RECORD_FORMATS), "unknown format"),
        F.when(blob.isNotNull() & (blob["url"].isNull() | blob["pathname"].isNull() | blob["size_bytes"].isNull()), "blob is incomplete"),
        missing(scan, "scan"), F.when(scan.isNotNull() & scan["scanned"].isNull(), "scan.scanned is required"), F.when(~scan["scope"].isin(SCAN_SCOPES), "unknown scan.scope"),
        missing(created_at, "created_at"), missing(updated_at, "updated_at"),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


BOOK_FIELDS = ["title", "authors", "language", "subjects", "isbn", "publisher", "license", "date"]


def public_view(rows: DataFrame) -> DataFrame:
    """Flat rows as they are shown: id as text, the book's fields nested, a scan for every row, internal columns left out."""
    book = F.struct(*BOOK_FIELDS, F.col("numberOfPage").alias("number_of_pages"), "open_library")
    scan = F.coalesce(F.col("scan"), F.from_json(F.lit('{"scanned": false}'), rows.schema["scan"].dataType))
    return rows.select(F.col("id").cast("string").alias("id"), "source", "gutenberg_id", "format", "blob", book.alias("book"), scan.alias("scan"), F.col("createdAt").alias("created_at"), F.col("updatedAt").alias("updated_at"))


def get_or_create(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """A dimension after its new keys came in: ids of known keys stay, new ones follow from the key."""
    new = incoming.select(key).where(F.col(key).isNotNull()).distinct().join(existing, key, "left_anti")
    return existing.select("id", key, F.lit(False).alias("created")).unionByName(new.select(F.sha2(key, 256).alias("id"), key, F.lit(True).alias("created")))


def merge_scans(existing: DataFrame, scans: DataFrame) -> DataFrame:
    """SCD-1: id and created_at of a known record stay, the newest scan sets the rest. existing: key, created_at; scans: key, ts, value."""
    last = scans.groupBy("key").agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.min("ts").alias("first_at"), F.max("ts").alias("updated_at"), F.count("*").alias("scans"))
    d = existing.join(last, "key", "full")
    return d.select("key", F.coalesce("created_at", "first_at").alias("created_at"), "updated_at", "value", F.coalesce("scans", F.lit(0)).alias("scans"), F.when(F.col("updated_at").isNull(), "pending").otherwise("scanned").alias("status"))


def source_key(x: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in SOURCES.items() for v in kv])
    return known[F.lower(F.trim(F.coalesce(x, F.lit(""))))]


def record_kind(explicit: Column, source: Column, schema: Column) -> Column:
    known = F.lower(F.trim(explicit))
    key = source_key(source)
    by_schema = F.create_map(*[F.lit(v) for kv in KIND_BY_SCHEMA.items() for v in kv])
    blank = F.coalesce(F.trim(explicit), F.lit("")) == ""
    return (
        F.when(known.isin(KINDS), known)
        .when(blank & (key == "openalex"), "academic")
        .when(schema.isNotNull(), F.coalesce(by_schema[schema], F.lit("other")))
        .otherwise(F.when(key.isin("gutendex", "upload"), "book").otherwise("other"))
    )


def activity(now: Column, *times: Column) -> Column:
    """The newest time; null where there is none or it lies in the future."""
    last = F.greatest(*times) if len(times) > 1 else times[0]
    return F.when(last <= now, last)


def matches_date(at: Column, now: Column, keys: list[str]) -> Column:
    """Today by day, else so many times 24 hours back; any of the keys."""
    c = F.lit(False) if keys else F.lit(True)
    for k in keys:
        if k == "today":
            c |= F.to_date(at) == F.to_date(now)
        elif k in (days := {"7days": 7, "30days": 30, "year": 365}):
            c |= at >= now - F.make_dt_interval(F.lit(days[k]))
    return F.coalesce(c & (at.isNotNull() if keys else F.lit(True)), F.lit(False))


def squeeze(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def matches_query(query: str, title: Column, isbn: Column, names: Column, subjects: Column, number: Column) -> Column:
    q = " ".join(query.split()).lower()
    if not q:
        return F.lit(True)
    has = lambda x: F.coalesce(F.contains(squeeze(x), F.lit(q)), F.lit(False))
    compact, digits = q.replace("-", "").replace(" ", ""), q.removeprefix("#").strip()
    c = has(title) | F.coalesce(F.exists(names, has), F.lit(False)) | F.coalesce(F.exists(subjects, has), F.lit(False))
    if compact:
        c |= F.coalesce(F.contains(F.lower(F.regexp_replace(isbn, r"[\s-]", "")), F.lit(compact)), F.lit(False))
    if digits:
        c |= F.coalesce(F.contains(number.cast("string"), F.lit(digits)), F.lit(False))
    return c


def facets(rows: DataFrame, array_col: str) -> DataFrame:
    """The distinct values of an array column with the records that have them."""
    return rows.select(F.explode(F.array_distinct(array_col)).alias("value")).groupBy("value").agg(F.count("*").alias("records"))
