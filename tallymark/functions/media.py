"""Attachments of documents: media types, contents, message parts, what a model takes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import media_hint, media_sniff

OCTETS = "application/octet-stream"


def attachments(docs: DataFrame, key: str, column: str = "attachments") -> DataFrame:
    """``key, ordinal, url, media``: one row for each attachment that is not null, its type
    from the data URI or the extension, null if neither tells."""
    rows = docs.select(key, F.posexplode(column).alias("ordinal", "url")).where("url IS NOT NULL")
    return rows.withColumn("media", media_hint(F.col("url")))


def load(files: DataFrame, folder: str | None = None, fetch: Callable[[str], bytes] | None = None) -> DataFrame:
    """Add ``data`` (binary) and fill ``media``: a data URI is decoded, a path is looked up among
    the files of ``folder``, other addresses go to ``fetch`` (in Arrow batches, on the
    executors). What cannot be had is null. A type not told is read off the first bytes;
    octet-stream if they tell none."""
    inline = F.col("url").startswith("data:")
    body = F.substring_index(F.col("url"), ",", -1)
    told = F.when(F.substring_index(F.col("url"), ",", 1).endswith(";base64"), F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(F.url_decode(body), "UTF-8"))
    out = files.withColumn("data", F.when(inline, told))
    if folder:
        stored = out.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        name = F.substring_index(F.regexp_replace("path", "^file:/+", "/"), folder.rstrip("/").removeprefix("file:") + "/", -1)
        stored = stored.select(name.alias("_name"), F.col("content").alias("_content"))
        out = out.join(stored, F.col("url") == F.col("_name"), "left").withColumn("data", F.coalesce("data", "_content")).drop("_name", "_content")
    if fetch:

        @F.pandas_udf("binary")
        def get(urls: pd.Series) -> pd.Series:
            def one(url):
                try:
                    return None if url is None else fetch(url)
                except Exception:  # noqa: BLE001
                    return None

            return urls.map(one)

        remote = F.col("url").rlike("^[a-z]+://")
        out = out.withColumn("_got", get(F.when(remote & F.col("data").isNull(), F.col("url")))).withColumn("data", F.coalesce("data", "_got")).drop("_got")
    return out.withColumn("media", F.coalesce("media", media_sniff(F.col("data"))))


def refused(files: DataFrame, models: DataFrame, takes: DataFrame) -> DataFrame:
    """``model`` and the columns of ``files`` for each attachment that a model (``model``) does
    not take: of unknown type, or none of its types in ``takes`` (``model, media``)."""
    pairs = files.join(F.broadcast(models.select("model").distinct().agg(F.collect_list("model").alias("_m")))).withColumn("model", F.explode("_m")).drop("_m")
    return pairs.join(takes.select("model", "media").distinct(), ["model", "media"], "left_anti")


PART = "STRUCT<kind: STRING, text: STRING, url: STRING, media: STRING>"


def message(prompt: Column, urls: Column) -> Column:
    """Parts of a message: the prompt, then each attachment that is an image or a PDF; others
    are left out. Without attachments the prompt alone."""
    media = lambda u: media_hint(u)
    part = lambda kind, text, url, m: F.struct(kind.alias("kind"), text.alias("text"), url.alias("url"), m.alias("media"))
    none = F.lit(None).cast("string")
    first = F.array(part(F.lit("text"), prompt, none, none))
    shown = F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.coalesce(media(u).startswith("image/") | (media(u) == "application/pdf"), F.lit(False)))
    return F.concat(first, F.transform(shown, lambda u: part(F.when(media(u) == "application/pdf", "file").otherwise("image"), none, u, media(u))))


def for_report(files: DataFrame) -> DataFrame:
    """``url, media, kind, data`` (base64) and the other columns: what a page can show."""
    kind = F.when(F.col("media").startswith("image/"), "image").when(F.col("media") == "application/pdf", "pdf").otherwise("file")
    return files.withColumns({"kind": kind, "media": F.coalesce("media", F.lit(OCTETS)), "data": F.base64("data")})
