"""File-name patterns and the virtual columns that they give.

A pattern is a file name with ``?`` and ``*`` as wildcards, ``${KEY}`` for a part
that becomes text column KEY and ``@{KEY}`` for digits that become a number.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PART = re.compile(r"\$\{(\w+)\}|@\{(\w+)\}|([?*])")


def compile_pattern(pattern: str) -> tuple[str, list[tuple[str, bool]]]:
    """(regular expression, [(key, whether it is a number)])."""
    out, keys, at = [], [], 0
    for m in _PART.finditer(pattern):
        out.append(re.escape(pattern[at : m.start()]))
        if m[1]:
            out.append("(.*)")
            keys.append((m[1], False))
        elif m[2]:
            out.append("([0-9]+)")
            keys.append((m[2], True))
        else:
            out.append("." if m[3] == "?" else ".*")
        at = m.end()
    return "^" + "".join(out) + re.escape(pattern[at:]) + "$", keys


def check_pattern(name: str, pattern: str) -> dict[str, str] | None:
    """The keys of a file name, or None if it doesn't match."""
    regex, keys = compile_pattern(pattern)
    m = re.match(regex, name)
    return {k: m[i + 1] for i, (k, _) in enumerate(keys)} if m else None


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Paths of a folder's files that match, through Hadoop's file system (any store that Spark reads)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    regex, _ = compile_pattern(pattern)
    return sorted(str(s.getPath()) for s in fs.listStatus(path) if s.isFile() and re.match(regex, s.getPath().getName()))


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_with_keys(spark: SparkSession, folder: str, pattern: str, where: dict[str, set] | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Files of a folder that match, with a column per key.

    ``where`` keeps only files whose key has one of the given values: they are
    chosen from the listing, so other files are never opened.
    """
    regex, keys = compile_pattern(pattern)
    number = {k for k, is_number in keys if is_number}
    files = []
    for path in list_files(spark, folder, pattern):
        found = check_pattern(path.rsplit("/", 1)[-1], pattern) or {}
        if all((int(found[k]) if k in number else found[k]) in values for k, values in (where or {}).items()):
            files.append(path)
    if not files:
        raise FileNotFoundError(f"no file of {folder} matches {pattern}")
    df = spark.read.format(fmt).options(**options).load(files)
    extra = [F.regexp_extract(file_name(), regex, i + 1).cast("long" if is_number else "string").alias(k) for i, (k, is_number) in enumerate(keys)]
    return df.select("*", *extra)
