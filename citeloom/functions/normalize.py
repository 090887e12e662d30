"""Projection and normalisation scalars: column expressions only, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squish(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def lenient_int(c: Column) -> Column:
    """An integer from text such as "1999" or "1999.0"; null where it is none."""
    return c.try_cast("double").try_cast("int")


def normalize_doi(c: Column) -> Column:
    bare = F.regexp_replace(squish(c), r"^https?://(dx\.)?doi\.org/", "")
    return F.nullif(F.lower(F.regexp_replace(bare, r"^doi:\s*", "")), F.lit(""))


def safe_doi_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize_doi(c), r"[^A-Za-z0-9]+", "_"), "^_|_$", "")


def doi_from_safe_id(c: Column) -> Column:
    """The lossy inverse: the first separator is the slash, the others are dots."""
    rest = F.regexp_replace(c, "^10_", "10.")
    slashed = F.regexp_replace(rest, "^([^_]*)_", "$1/")
    return F.when(c.rlike("^10_"), F.replace(slashed, F.lit("_"), F.lit(".")))


def normalize_title(c: Column) -> Column:
    words = F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    return F.nullif(F.trim(words), F.lit(""))


def normalize_author_key(c: Column) -> Column:
    return F.nullif(squish(F.regexp_replace(F.lower(c), r"[^a-z,; ]+", " ")), F.lit(""))


def first_author_name(c: Column) -> Column:
    return F.nullif(squish(F.element_at(F.split(c, r";|\|", 2), 1)), F.lit(""))


def first_author_surname(c: Column) -> Column:
    name = first_author_name(c)
    surname = F.when(F.contains(name, F.lit(",")), F.element_at(F.split(name, ",", 2), 1)).otherwise(F.element_at(F.split(name, " "), -1))
    return F.nullif(F.regexp_replace(F.lower(surname), "[^a-z]+", ""), F.lit(""))


def venue_key(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), F.lit(""))


def reference_key(c: Column) -> Column:
    """A cited reference as letters and digits, without a ``doi:`` prefix."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.lower(squish(c)), r"^doi:\s*", ""), r"[^a-z0-9]+", " ")), F.lit(""))


def openalex_id(c: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(F.lower(c), r"(w\d+)", 1), F.lit("")))


def context_key(c: Column) -> Column:
    """The key under which two routes' sentences are the same: lower case, one space, 240 characters."""
    return F.substring(squish(F.lower(c)), 1, 240)


def coalesce_columns(df: DataFrame, candidates: list[str], kind: str = "string") -> Column:
    """The first non-null of those candidates that the table has."""
    present = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast(kind)


def ensure_columns(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """``df`` with typed nulls for the columns of ``spec`` that it lacks."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in spec.items() if n not in df.columns})


# Column names of bibliographic exports, first present and non-null wins.
FIELDS = {
    "source_record_id": ["ut_unique_wos_id", "accession_number", "eid", "id", "record_id"],
    "doi": ["doi", "book_doi", "di"],
    "title": ["article_title", "title", "ti", "source_title"],
    "authors": ["authors", "au", "author_full_names"],
    "year": ["publication_year", "py", "year"],
    "venue": ["source_title", "journal", "journal_name", "publication_name", "so"],
    "document_type": ["document_type", "dt", "type"],
    "abstract": ["abstract", "ab"],
    "keywords": ["author_keywords", "keywords", "de", "id"],
    "addresses": ["addresses", "c1", "affiliations"],
    "cited_references": ["cited_references", "cr", "references"],
}


def harmonize(df: DataFrame, source_file: Column | None = None, source_row: Column | None = None) -> DataFrame:
    """Bibliographic rows of any naming as the harmonised works table, with their work key."""
    name = source_file if source_file is not None else F.lit(None).cast("string")
    row = source_row if source_row is not None else F.monotonically_increasing_id() + 1
    raw = {k: coalesce_columns(df, v).cast("string") for k, v in FIELDS.items()}
    out = df.select(row.alias("source_row"), name.alias("source_file"), *[c.alias(k) for k, c in raw.items()])
    out = out.withColumn("doi", normalize_doi(F.col("doi"))).withColumn("year", lenient_int(F.col("year")))
    database = F.when(F.contains(F.lower("source_file"), F.lit("savedrecs")), "web_of_science_or_clarivate").otherwise("unknown")
    out = out.withColumns(
        {
            "database": database,
            "title_norm": normalize_title(F.col("title")),
            "authors_norm": normalize_author_key(F.col("authors")),
            "doi_safe": safe_doi_id(F.col("doi")),
        }
    )
    return out.withColumn("work_key", work_key())


def work_key(doi: str = "doi", title: str = "title_norm", year: str = "year", row: str = "source_row") -> Column:
    return (
        F.when(F.col(doi).isNotNull(), F.concat(F.lit("doi:"), doi))
        .when(F.col(title).isNotNull() & F.col(year).isNotNull(), F.concat_ws(" ", F.lit("title_year:"), title, year))
        .when(F.col(title).isNotNull(), F.concat(F.lit("title: "), title))
        .otherwise(F.concat(F.lit("row:"), row))
    )


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decade_of(year: Column) -> Column:
    return F.when(year.between(1900, 2100), F.concat(decade(year).cast("string"), F.lit("s"))).otherwise("unknown")


def band_of(decade_label: Column) -> Column:
    """before 2000, 2000s, from 2010, unknown"""
    start = F.substring(decade_label, 1, 4)
    return (
        F.when(decade_label == "unknown", "unknown")
        .when(decade_label.isNull(), "unknown")
        .when(start < "2000", "pre2000")
        .when(start == "2000", "2000s")
        .otherwise("2010onward")
    )


def cited_by_bin(n: Column) -> Column:
    return (
        F.when(n.isNull(), "unknown")
        .when(n <= 0, "0")
        .when(n < 5, "1-4")
        .when(n < 25, "5-24")
        .when(n < 100, "25-99")
        .when(n < 500, "100-499")
        .otherwise("500+")
    )


def confidence_bin(p: Column) -> Column:
    return (
        F.when(p.isNull(), "missing")
        .when(p < 0.5, "<0.50")
        .when(p < 0.65, "0.50-0.64")
        .when(p < 0.8, "0.65-0.79")
        .when(p < 0.9, "0.80-0.89")
        .otherwise("0.90-1.00")
    )


def collapse_type(c: Column) -> Column:
    """Document types in four levels."""
    low = F.lower(c)
    return (
        F.when(low.isin("article", "journal-article", "review", "letter", "editorial"), "article")
        .when(low.isin("book", "book-chapter", "monograph", "reference-entry"), "book_or_chapter")
        .when(low.isin("dissertation", "report", "preprint", "paratext"), "grey")
        .otherwise("other")
    )


def recode(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    out = default if default is not None else c
    for old, new in reversed(mapping.items()):
        out = F.when(c == old, new).otherwise(out)
    return out


# Byte sequences of misread typography and what they stand for, in order.
MOJIBAKE = (
    ("‚Ä¶", "..."),
    ("‚Äì|‚Äî", "-"),
    ("‚Äï|‚Äò|‚Äô", "'"),
    ("‚Äú|‚Äù|‚Äñ", '"'),
    ("Ô¨Å", "fi"),
    ("Ô¨Æ", "fl"),
    ("Ô¨Ç", "ffi"),
    ("Ô¨È", "ffl"),
)


def repair_text(c: Column) -> Column:
    """Misread typography, line breaks and end-of-line hyphens of extracted text put right."""
    steps = [*MOJIBAKE, (r"[\r\t]+", " "), (r"\s*\n\s*", " "), (r"-\s+(?=[a-z])", ""), (r"\s{2,}", " ")]
    return F.trim(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c))


def short_hash(*parts: Column, length: int = 12, separator: str = "||") -> Column:
    """The first hexadecimal digits of a SHA-1 over the joined parts."""
    return F.substring(F.sha1(F.concat_ws(separator, *parts)), 1, length)


def split_flags(c: Column, separator: str = r"\|") -> Column:
    """Distinct non-empty flags in their order, without ``none``."""
    parts = F.transform(F.split(c, separator), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != "none")))


def title_match(title: Column, needle: str) -> Column:
    """Whether all words of more than two letters of ``needle`` are in the title."""
    words = [w for w in needle.lower().split() if len(w) > 2]
    return reduce(lambda a, b: a & b, (F.contains(F.lower(title), F.lit(w)) for w in words), F.lit(True))


def has_author(names: Column, required: str) -> Column:
    """Whether a name is among an array of author names, in any case; not among no names."""
    return F.contains(F.lower(F.array_join(F.coalesce(names, F.array().cast("array<string>")), " ")), F.lit(required.lower()))


def display_count(n: Column) -> Column:
    return F.format_number(n, 0)


def display_share(p: Column) -> Column:
    return F.format_string("%.1f%%", p * 100)


def display_interval(low: Column, high: Column) -> Column:
    return F.format_string("[%.2f, %.2f]", low, high)
