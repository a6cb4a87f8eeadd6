"""Delimited text in and out, with a schema written as NAME:TYPE;NAME:TYPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "int1": "tinyint", "int2": "smallint", "int4": "int", "int8": "bigint", "float2": "float", "float4": "float", "float8": "double", "numeric": "decimal(38,10)", "text": "string", "bool": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz", "bytea": "binary",
}


def parse_schema(spec: str) -> T.StructType:
    """NAME:TYPE[:EXTRA];...  EXTRA is precision,scale of a numeric."""
    fields = []
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        name, kind, *extra = part.split(":")
        ddl = f"decimal({extra[0]})" if kind == "numeric" and extra else _TYPES.get(kind, kind)
        fields.append(f"`{name}` {ddl}")
    return T.StructType.fromDDL(", ".join(fields))


def read(spark: SparkSession, path: str, spec: str, sep: str = "\t", header: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Typed columns; a bad value is an error.  ``offset`` and ``limit`` count rows in file order."""
    df = spark.read.csv(path, schema=parse_schema(spec), sep=sep, header=header, mode="FAILFAST")
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def write(df: DataFrame, path: str, sep: str = ",", header: bool = True, offset: int = 0, limit: int | None = None) -> None:
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def create_table(schema: T.StructType, name: str) -> str:
    """CREATE TABLE text for a schema, with quoted names and PostgreSQL's type names."""
    back = {"tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision", "string": "text", "boolean": "boolean", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytea"}
    quote = lambda n: '"' + n.replace('"', '""') + '"'

    def kind(t: T.DataType) -> str:
        if isinstance(t, T.ArrayType):
            return f"{kind(t.elementType)}[]"
        if isinstance(t, T.DecimalType):
            return f"numeric({t.precision},{t.scale})"
        return back.get(t.simpleString(), "jsonb")

    return f"CREATE TABLE {quote(name)} (" + ", ".join(f"{quote(f.name)} {kind(f.dataType)}{'' if f.nullable else ' NOT NULL'}" for f in schema) + ")"


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """VCF lines as rows: fixed fields, INFO as a map, samples as an array of text.

    A value may hold "="; of an INFO key that comes twice the first one counts;
    a key without a value is there with null.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("##"))
    cells = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#"))
    names = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
    out = rows.select(*[F.get(cells, i).alias(n) for i, n in enumerate(names)], F.slice(cells, 10, F.greatest(F.size(cells) - 9, F.lit(0))).alias("samples"))
    at = lambda p: F.instr(p, "=")
    pairs = F.transform(F.split("info", ";"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(at(p) > 0, F.substr(p, at(p) + 1, F.length(p))).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return out.withColumn("pos", F.col("pos").cast("long")).withColumn("qual", F.when(F.col("qual") != ".", F.col("qual")).cast("double")).withColumn("attributes", F.map_from_entries(first))


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of the ## lines of VCF files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.col("value").startswith("##"))
    return lines.select("file", F.substring_index(F.substr("value", F.lit(3)), "=", 1).alias("key"), F.substr("value", F.instr("value", "=") + 1).alias("value"))


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, name) of the samples that VCF files name: ``place`` counts from 0, as in ``samples``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.col("value").startswith("#CHROM"))
    names = F.split("value", "\t")
    return lines.select("file", F.posexplode(F.slice(names, 10, F.greatest(F.size(names) - 9, F.lit(0)))).alias("place", "name"))
