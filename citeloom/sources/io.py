"""Sources and sinks: delimited exports, JSON lines, payloads, binary documents, manifests, configuration."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_name(name: str) -> str:
    """A column name in lower case with single underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", name.strip().lower())).strip("_")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A bibliographic export (.csv or .tsv) with clean names, all columns strings; other types raise."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "tsv"):
        raise ValueError(f"unsupported bibliographic file type: {path}")
    df = spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, quote='"', escape='"', encoding="UTF-8", nullValue=None)
    return df.toDF(*[clean_name(c.lstrip("﻿")) for c in df.columns])


def union_exports(frames: list[DataFrame]) -> DataFrame:
    """All rows of several files, columns matched by name, missing ones null, with their source."""
    tagged = [f.withColumn("source_path", F.input_file_name()) for f in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return out.withColumn("source_file", F.regexp_extract("source_path", r"([^/]+)$", 1))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of known schema; an empty file gives no rows."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', encoding="UTF-8")


def read_after_preamble(spark: SparkSession, path: str, first: str, schema: str) -> DataFrame:
    """A CSV whose header is the first line that starts with ``first``; what stands before is skipped.

    The header's place is looked up in the file's numbered lines; sheets of this kind are small.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    start = lines.where(F.startswith("line", F.lit(first))).agg(F.min("n").alias("start"))
    body = lines.join(F.broadcast(start), F.col("n") > F.col("start")).where(F.trim("line") != "")  # one row
    return body.select(F.from_csv("line", schema).alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """With a header; ``append`` adds files of the same columns, ``error`` refuses to overwrite a named run."""
    df.write.csv(path, header=True, mode=mode, escape='"')


def write_union_csv(tables: list[DataFrame], path: str, mode: str = "error") -> None:
    """Tables of different columns under one header: all names in the order in which they first appear."""
    names = list(dict.fromkeys(c for t in tables for c in t.columns))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    write_csv(rows.select(*names), path, mode)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with typed nulls for missing fields."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def latency_seconds(start: Column, end: Column) -> Column:
    """Seconds between two ISO-8601 texts or timestamps; null where one doesn't parse."""
    stamp = lambda c: F.unix_micros(F.try_to_timestamp(c.cast("string")))
    return (stamp(end) - stamp(start)) / 1e6


def flatten_config(tree: dict, prefix: str = "") -> dict[str, str]:
    """A nested configuration as dotted keys."""
    out: dict[str, str] = {}
    for k, v in tree.items():
        key = f"{prefix}{k}"
        out |= flatten_config(v, f"{key}.") if isinstance(v, dict) else {key: "" if v is None else str(v)}
    return out


def read_config(path: str) -> dict[str, str]:
    """Indented ``key: value`` lines as dotted keys; the items of a list ("- item") are numbered from 1."""
    out, stack, items = {}, [], {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            body = line.split(" #")[0].rstrip()
            if not body.strip() or body.lstrip().startswith("#"):
                continue
            depth = len(body) - len(body.lstrip())
            listed = body.lstrip().startswith("- ")
            while stack and (stack[-1][0] > depth or (stack[-1][0] == depth and not listed)):
                stack.pop()
            if listed:
                at = ".".join(k for _, k in stack)
                items[at] = items.get(at, 0) + 1
                out[f"{at}.{items[at]}"] = body.strip()[2:].strip().strip("\"'")
                continue
            key, _, value = body.strip().partition(":")
            if value.strip():
                out[".".join([*(k for _, k in stack), key])] = value.strip().strip("\"'")
            else:
                stack.append((depth, key))
    return out


def cached_lookup(wanted: DataFrame, cache: DataFrame, key: str, enabled: bool = False) -> DataFrame:
    """Each wanted key with its cached payload and how it was got; nothing is fetched here."""
    hit = wanted.join(cache.select(key, "payload", F.lit("cache_hit").alias("_s")), key, "left")
    rest = "pending_fetch" if enabled else "skipped_api_disabled"
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    return hit.withColumn("status", F.coalesce("_s", F.when(blank, "skipped_no_query"), F.lit(rest))).drop("_s")


def with_responses(looked_up: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Pending keys with the responses that a fetch stored (key, code, body, error): fetched, http_N, json_error or request_error."""
    got = responses.select(key, F.lit(True).alias("_got"), F.col("code").alias("_code"), F.col("body").alias("_body"), F.col("error").alias("_error"))
    both = looked_up.join(got, key, "left")
    parsed = F.try_parse_json("_body").isNotNull()
    status = (
        F.when((F.col("status") != "pending_fetch") | F.col("_got").isNull(), F.col("status"))
        .when(F.col("_error").isNotNull(), F.concat(F.lit("request_error:"), "_error"))
        .when(~F.col("_code").between(200, 299), F.concat(F.lit("http_"), F.col("_code").cast("string")))
        .otherwise(F.when(parsed, "fetched").otherwise("json_error"))
    )
    both = both.withColumn("status", status)
    return both.withColumn("payload", F.when(F.col("status") == "fetched", F.col("_body")).otherwise(F.col("payload"))).select(*looked_up.columns)


def done_already(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do: resuming never repeats work."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def pages_of(payloads: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of cached result pages: each item of a JSON array with its index."""
    items = F.from_json(column, f"array<{schema}>")
    return payloads.select("*", F.posexplode_outer(items).alias("item_index", "item")).drop(column)


def pick_json(c: Column, path: str) -> Column:
    """A nested value, null-safe."""
    return F.get_json_object(c, path)


def read_blobs(spark: SparkSession, path: str, most: int = 8 * 1024 * 1024) -> DataFrame:
    """Files with the digest of their whole bytes, their format, and ``content``: what a capped fetch keeps of them."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    digest = F.sha2("content", 256)
    kept = F.substring("content", 1, most)
    return df.select("path", "modificationTime", "length", digest.alias("sha256"), F.substring(digest, 1, 16).alias("blob_id"), blob_format(F.col("content")).alias("format"), kept.alias("content"))


def blob_format(content: Column, content_type: Column | None = None) -> Column:
    """pdf, html or other, from the content type or the first bytes."""
    kind = F.lower(content_type) if content_type is not None else F.lit("")
    magic = F.hex(F.substring(content, 1, 4))
    start = F.lower(F.try_to_binary(F.hex(F.substring(content, 1, 200)), F.lit("hex")).cast("string"))
    return (
        F.when(F.contains(kind, F.lit("pdf")) | (magic == "25504446"), "pdf")
        .when(F.contains(kind, F.lit("html")) | start.rlike(r"^\s*(<!doctype html|<html)"), "html")
        .otherwise("other")
    )


def blob_text(blobs: DataFrame) -> DataFrame:
    """Plain text of HTML and text blobs natively; PDF needs a reader of its own and stays null."""
    from citeloom.functions.text import html_to_text

    raw = F.col("content").cast("string")
    return blobs.withColumn("text", F.when(F.col("format") == "html", html_to_text(raw)).when(F.col("format") == "other", raw))


def inventory(blobs: DataFrame) -> DataFrame:
    """Files with their role, size band and a recommendation."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    role = (
        F.when(name.rlike(r"\.(r|py|sh)$"), "script")
        .when(name.rlike(r"\.(csv|tsv|parquet|json|jsonl)$"), "data")
        .when(name.rlike(r"\.(pdf|html?)$"), "source_document")
        .when(name.rlike(r"\.(md|txt)$"), "documentation")
        .otherwise("other")
    )
    out = blobs.select("path", name.alias("name"), "length", role.alias("role"))
    return out.withColumn("recommendation", F.when((F.col("role") == "data") & (F.col("length") > 50_000_000), "store_outside").otherwise("keep"))


def manifest(blobs: DataFrame) -> DataFrame:
    """Path, size and SHA-256 of each file: what a frozen snapshot is checked against."""
    return blobs.select("path", "length", "sha256").orderBy("path")


def verify_manifest(found: DataFrame, frozen: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a frozen manifest."""
    f = frozen.select("path", F.col("sha256").alias("frozen"))
    both = found.select("path", F.col("sha256").alias("found")).join(f, "path", "full_outer")
    status = F.when(F.col("frozen").isNull(), "new").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("frozen"), "changed")
    return both.withColumn("status", status).where("status is not null").select("path", "status")


def place_columns(df: DataFrame, new: dict[str, Column], after: str) -> DataFrame:
    """Schema migration: new columns behind a given one."""
    at = df.columns.index(after) + 1
    names = [c for c in df.columns if c not in new]
    at = names.index(after) + 1
    return df.withColumns(new).select(*names[:at], *new, *names[at:])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of some tables."""
    return reduce(lambda a, b: a.unionByName(b), (t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()))
