"""Where results go: text files for one note or for many."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.functions import text as X

BOM = "﻿"


def export_txt(text: str, path: str) -> None:
    """One transcript to a local .txt file: UTF-8 with a byte-order mark, replaced as a whole or not at all."""
    if not path.lower().endswith(".txt"):
        raise ValueError("not a .txt path")
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8-sig") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_new(text: str, path: str) -> None:
    """Like ``export_txt``, but a path that exists is a FileExistsError."""
    with open(path, "x", encoding="utf-8-sig") as out:
        out.write(text)


def export_many(notes: DataFrame, path: str) -> None:
    """Transcripts of many notes as text files in a folder for each id, written by the executors."""
    notes.select("id", F.concat(F.lit(BOM), F.col("transcript")).alias("value")).write.partitionBy("id").mode("errorifexists").text(path)


def notices(packages: DataFrame) -> DataFrame:
    """Markdown table rows of (name, version, license, places)."""
    return packages.select(F.format_string("| %s | %s | %s | %s |", "name", "version", "license", "places").alias("value"))


def notice_blocks(texts: DataFrame) -> DataFrame:
    """(first_owner, value): each license text once, whatever white space is around it, below the names of its owners, from (owner, text). Owners are packages
    with a text each, so a block's names are gathered."""
    own = texts.select("owner", X.strip(F.col("text")).alias("text")).groupBy(F.sha2("text", 256).alias("sha256")).agg(F.array_sort(F.collect_set("owner")).alias("owners"), F.first("text").alias("text"))
    return own.select(F.get("owners", F.lit(0)).alias("first_owner"), F.concat(F.lit("### "), F.array_join("owners", ", "), F.lit("\n\n```\n"), F.col("text"), F.lit("\n```")).alias("value"))


def profile(df: DataFrame, path: str) -> None:
    """Writes down how a table would be computed: its formatted plan, as a local text file."""
    write_new(df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"), path)
