"""Readers: message files, mbox files, alias lists; lines of mailbox protocols."""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrmail.sources.archive import read_archive
from corrmail.sources.schema import ALIAS


def read_message_files(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """(path, content) of files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the messages in mbox files; the path ends in the place of the message in its file."""
    return read_archive(spark, path).select(F.concat_ws("#", "file", F.col("uid").cast("string")).alias("path"), "content")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias list in CSV with a header; a byte order mark is ignored."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    names = [x.split()[0] for x in ALIAS.split(", ")]
    return rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names])


def list_line(c: Column) -> Column:
    """struct(flags, delimiter, name) of a folder list line: flags in parentheses, then two strings, each quoted or an atom."""
    quoted = r'"((?:[^"\\]|\\.)*)"'
    line = rf"\(([^)]*)\)\s+(?:{quoted}|(\S+))\s+(?:{quoted}|(\S.*?))\s*$"
    either = lambda k: F.regexp_replace(F.concat(F.regexp_extract(c, line, k), F.regexp_extract(c, line, k + 1)), r'\\(["\\])', "$1")
    flags = F.filter(F.split(F.regexp_extract(c, line, 1), r"\s+"), lambda x: x != "")
    return F.struct(flags.alias("flags"), either(2).alias("delimiter"), either(4).alias("name"))


def folder_status(c: Column) -> Column:
    """struct(messages, uidvalidity, uidnext) of a status line; 0 where a number is missing."""
    number = lambda k: F.coalesce(F.regexp_extract(c, rf"(?i)\b{k}\s+(\d+)", 1).try_cast("long"), F.lit(0))
    return F.struct(number("MESSAGES").alias("messages"), number("UIDVALIDITY").alias("uidvalidity"), number("UIDNEXT").alias("uidnext"))


def decode_folder_name(name: str) -> str:
    """Modified UTF-7 to text; a name that is not well formed stays."""

    def piece(m: re.Match) -> str:
        if not m[1]:
            return "&"
        raw = m[1].replace(",", "/")
        return base64.b64decode(raw + "=" * (-len(raw) % 4)).decode("utf-16-be")

    try:
        return re.sub(r"&([^-]*)-", piece, name)
    except (ValueError, UnicodeDecodeError):
        return name


def encode_folder_name(name: str) -> str:
    """Text to modified UTF-7."""

    def piece(m: re.Match) -> str:
        if m[0] == "&":
            return "&-"
        return "&" + base64.b64encode(m[0].encode("utf-16-be")).decode().rstrip("=").replace("/", ",") + "-"

    return re.sub(r"&|[^\x20-\x7e]+", piece, name)


def with_folder_names(folders: DataFrame, raw: str = "raw_name", out: str = "name", decode: bool = True) -> DataFrame:
    """Add the decoded (or encoded) folder name, in Arrow batches."""
    how = decode_folder_name if decode else encode_folder_name

    @F.pandas_udf("string")
    def convert(x: pd.Series) -> pd.Series:
        return x.map(how, na_action="ignore")

    return folders.withColumn(out, convert(raw))
