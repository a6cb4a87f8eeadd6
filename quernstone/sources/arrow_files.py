"""Arrow IPC files as a Spark data source, with statistics in the footer.

Reading: one partition per record batch, or of neighbours where there are many.
Footer statistics of the batches
(``min_values``, ``max_values`` and ``null_counts`` of a field) skip batches for
pushed filters and for a ``where`` tree of AND, OR and NOT.  Custom metadata of
files and fields, its items by batch, and parts of file names become virtual
columns, and filters on these skip whole files.  Writing: files of bounded size,
with statistics.  Both run inside executors through the Python data source API.
Paths are those of the local file system, or URIs that pyarrow's file systems open.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema

#: Bytes of a file after which the writer begins another one: bounds what it holds.
FILE_BYTES = 128 << 20
#: Footers that are read at once.
FOOTERS = 16
#: Partitions beyond which neighbouring batches of a file share one, and the bytes of file up to which they do.
PARTITIONS = 512
PARTITION_BYTES = 64 << 20


# ---- files ------------------------------------------------------------------------
def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str, suffix: str = "", pattern: str = "") -> list[str]:
    """Files of a folder (or the one named), by suffix and file-name pattern; several paths are comma-separated."""
    from quernstone.sources.patterns import check_pattern

    out = []
    for one in filter(None, path.split(",")):
        system, inner = store(one)
        if system.get_file_info(inner).type != pafs.FileType.Directory:
            out.append(one)
            continue
        ends = (suffix,) if suffix else (".arrow", ".feather")
        names = sorted(f.base_name for f in system.get_file_info(pafs.FileSelector(inner)) if f.is_file and f.base_name.endswith(ends))
        out += [f"{one.rstrip('/')}/{n}" for n in names if not pattern or check_pattern(n, pattern) is not None]
    return out


def opened(path: str):
    """An open source; local files are mapped, so only the batches that are read are touched."""
    system, inner = store(path)
    return pa.memory_map(inner) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(inner)


def unique_names(names: list[str]) -> list[str]:
    """Column names of which later ones that repeat one get a number: a, a_1, a_2."""
    out: list[str] = []
    taken = set(names)
    for k, name in enumerate(names):
        if name in names[:k]:
            n = next(i for i in range(1, len(names) + 1) if f"{name}_{i}" not in taken)
            name = f"{name}_{n}"
            taken.add(name)
        out.append(name)
    return out


# ---- bounds as JSON -------------------------------------------------------------------
def pack(value):
    """A bound as JSON: numbers, booleans and text as they are, other types named."""
    if isinstance(value, datetime.datetime):
        return {"timestamp": value.isoformat()}
    if isinstance(value, datetime.date):
        return {"date": value.isoformat()}
    if isinstance(value, decimal.Decimal):
        return {"decimal": str(value)}
    return value


def unpack(value):
    if isinstance(value, dict):
        ((kind, text),) = value.items()
        return {"timestamp": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "decimal": decimal.Decimal}[kind](text)
    return value


def can_pack(kind: pa.DataType) -> bool:
    t = pa.types
    return t.is_integer(kind) or t.is_floating(kind) or t.is_string(kind) or t.is_large_string(kind) or t.is_boolean(kind) or t.is_date(kind) or t.is_timestamp(kind) or t.is_decimal(kind)


def bounds(column: pa.Array) -> tuple[object, object, int]:
    """Least, greatest value (None if unknown) and number of nulls; NaN is above all numbers, so it hides the greatest."""
    found = pc.min_max(column).as_py()
    low, high = pack(found["min"]), pack(found["max"])
    if pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
        low = high = None
    return low, high, column.null_count


@dataclass
class Stats:
    """What is known of a column in one batch."""

    low: object
    high: object
    nulls: int | None
    rows: int


def statistics(schema: pa.Schema) -> dict[str, tuple[list, list, list | None]]:
    """Field -> (least values, greatest values, null counts) by batch, from the field metadata."""
    out = {}
    for field in schema:
        meta = field.metadata or {}
        if b"min_values" in meta and b"max_values" in meta:
            read = lambda k, meta=meta: [unpack(v) for v in json.loads(meta[k])]
            out[field.name] = (read(b"min_values"), read(b"max_values"), json.loads(meta[b"null_counts"]) if b"null_counts" in meta else None)
    return out


# ---- what a batch may hold ---------------------------------------------------------------
#: A filter is a tree: (op, column, value), ("is_null" | "not_null", column), ("and" | "or", ...), ("not", tree).
_OPS = {EqualTo: "=", EqualNullSafe: "<=>", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
_INVERSE = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">", "is_null": "not_null", "not_null": "is_null"}


def tree_of(f) -> tuple | None:
    """The tree of a pushed filter, or None if statistics say nothing about it."""
    if isinstance(f, Not):
        inner = tree_of(f.child)
        return ("not", inner) if inner else None
    if len(getattr(f, "attribute", ())) != 1:
        return None
    name = f.attribute[0]
    if type(f) in _OPS:
        return (_OPS[type(f)], name, f.value)
    if isinstance(f, In):
        return ("or", *(("=", name, v) for v in f.value))
    if isinstance(f, StringStartsWith):
        return ("starts", name, f.value)
    return ("is_null", name) if isinstance(f, IsNull) else ("not_null", name) if isinstance(f, IsNotNull) else None


def may_match(tree: tuple, stats: dict[str, Stats]) -> bool:
    """Whether a batch can hold a row for which the filter is true."""
    op = tree[0]
    if op in ("and", "or"):
        return (all if op == "and" else any)(may_match(t, stats) for t in tree[1:])
    if op == "not":
        inner = tree[1]
        if inner[0] == "not":
            return may_match(inner[1], stats)
        if inner[0] in ("and", "or"):  # by De Morgan's laws, which hold for three values too
            return may_match(("or" if inner[0] == "and" else "and", *(("not", t) for t in inner[1:])), stats)
        return may_match((_INVERSE[inner[0]], *inner[1:]), stats) if inner[0] in _INVERSE else True
    s = stats.get(tree[1])
    if s is None:
        return True
    if op == "is_null":
        return s.nulls is None or s.nulls > 0
    if s.nulls is not None and s.nulls == s.rows:
        return op == "<=>" and tree[2] is None  # nothing but nulls
    if op == "not_null":
        return True
    value = tree[2]
    if value is None:
        return op == "<=>" and (s.nulls is None or s.nulls > 0)
    if s.low is None or s.high is None or (isinstance(value, float) and math.isnan(value)):
        return True
    low, high = s.low, s.high
    if isinstance(low, datetime.datetime) and isinstance(value, datetime.datetime) and (low.tzinfo is None) != (value.tzinfo is None):
        return True
    try:
        return {
            "=": lambda: low <= value <= high, "<=>": lambda: low <= value <= high, "<>": lambda: not (low == high == value), "<": lambda: low < value, "<=": lambda: low <= value, ">": lambda: high > value, ">=": lambda: high >= value,
            "starts": lambda: low[: len(value)] <= value <= high[: len(value)],
        }[op]()
    except TypeError:  # a literal of another type
        return True


def column_of(tree: tuple):
    """The Spark condition of a tree."""
    from pyspark.sql import functions as F

    op = tree[0]
    if op in ("and", "or"):
        return reduce(lambda a, b: a & b if op == "and" else a | b, map(column_of, tree[1:]))
    if op == "not":
        return ~column_of(tree[1])
    x = F.col(f"`{tree[1]}`")
    one = {"is_null": lambda: x.isNull(), "not_null": lambda: x.isNotNull(), "=": lambda: x == tree[2], "<=>": lambda: x.eqNullSafe(tree[2]), "<>": lambda: x != tree[2], "<": lambda: x < tree[2], "<=": lambda: x <= tree[2], ">": lambda: x > tree[2], ">=": lambda: x >= tree[2], "starts": lambda: x.startswith(tree[2])}
    return one[op]()


def load(spark, path: str, where: tuple | None = None, **options):
    """Rows of Arrow files for which a tree holds; batches that can't hold any are skipped, also for OR and NOT."""
    reader = spark.read.format("arrow_files").options(**options).option("path", path)
    if where is None:
        return reader.load()
    return reader.option("where", json.dumps(where, default=pack)).load().filter(column_of(where))


def _tree_from_json(node):
    return tuple(_tree_from_json(x) if isinstance(x, list) else unpack(x) for x in node)


# ---- reading ---------------------------------------------------------------------------------
@dataclass
class Batch(InputPartition):
    path: str
    number: int
    values: tuple = ()
    #: further batches of the file in this partition: (number, values)
    more: tuple = ()


def packed(files: list[tuple[int, list[Batch]]]) -> list[Batch]:
    """Partitions of the batches of files, given with the mean size of a file's batches.

    Small batches would cost more as tasks than to read, so beyond ``PARTITIONS``
    of them a partition takes its share of the batches, up to ``PARTITION_BYTES``.
    """
    share = -(-sum(len(found) for _, found in files) // PARTITIONS)
    out = []
    for size, found in files:
        n = max(1, min(share, PARTITION_BYTES // max(size, 1)))
        for first, *rest in (found[i : i + n] for i in range(0, len(found), n)):
            out.append(Batch(first.path, first.number, first.values, tuple((b.number, b.values) for b in rest)))
    return out


class ArrowReader(DataSourceReader):
    """``virtual``: (column, kind, key) of the columns that aren't in the files."""

    def __init__(self, path: str, schema, virtual: list[tuple[str, str, str]] | None = None, suffix: str = "", pattern: str = "", where: tuple | None = None):
        self.path, self.schema, self.virtual = path, schema, virtual or []
        self.suffix, self.pattern, self.filters = suffix, pattern, [where] if where else []

    def pushFilters(self, filters):
        for f in filters:
            tree = tree_of(f)
            if tree:
                self.filters.append(tree)
            yield f  # Spark checks every row again

    def virtual_values(self, path: str, schema: pa.Schema, number: int) -> tuple:
        """Values of the virtual columns in a batch."""
        from quernstone.sources.patterns import check_pattern

        text = lambda meta, key: v.decode() if (v := (meta or {}).get(key.encode())) is not None else None
        out = []
        for _, kind, key in self.virtual:
            if kind == "file":
                out.append(text(schema.metadata, key))
            elif kind == "field":
                field, _, own = key.partition(".")
                out.append(text(schema.field(field).metadata, own) if field in schema.names else None)
            elif kind == "split":
                items = (text(schema.metadata, key) or "").split(",")
                out.append(items[number] if number < len(items) and items != [""] else None)
            elif kind == "pathname":
                out.append(path)
            elif kind == "filename":
                out.append(path.rsplit("/", 1)[-1])
            else:
                found = check_pattern(path.rsplit("/", 1)[-1], self.pattern) or {}
                out.append(int(found[key]) if kind == "number" and key in found else found.get(key))
        return tuple(out)

    def batches_of(self, path: str) -> tuple[int, list[Batch]]:
        """Mean size of a file's batches, and those that can hold rows."""
        with opened(path) as source:
            reader = pa.ipc.open_file(source)
            known, out = statistics(reader.schema), []
            for i in range(reader.num_record_batches):
                values = self.virtual_values(path, reader.schema, i)
                stats = {n: Stats(v, v, int(v is None), 1) for (n, _, _), v in zip(self.virtual, values, strict=True)}
                if self.filters:
                    for name, (low, high, nulls) in known.items():
                        count = None if nulls is None else nulls[i]
                        rows = -1 if low[i] is not None or count is None else reader.get_batch(i).num_rows
                        stats[name] = Stats(low[i], high[i], count, rows)
                if all(may_match(f, stats) for f in self.filters):
                    out.append(Batch(path, i, values))
            return source.size() // max(reader.num_record_batches, 1), out

    def partitions(self):
        paths = files_of(self.path, self.suffix, self.pattern)
        with ThreadPoolExecutor(FOOTERS) as pool:
            return packed(list(pool.map(self.batches_of, paths))) or [Batch("", 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as source:
            reader = pa.ipc.open_file(source)
            for number, values in ((partition.number, partition.values), *partition.more):
                batch = reader.get_batch(number)
                for (name, kind, _), value in zip(self.virtual, values, strict=True):
                    batch = batch.append_column(name, pa.array([value] * batch.num_rows, pa.int64() if kind == "number" else pa.string()))
                yield batch.rename_columns(unique_names(batch.schema.names)).replace_schema_metadata(None)


# ---- writing ----------------------------------------------------------------------------------
@dataclass
class Written(WriterCommitMessage):
    paths: tuple


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str, stats: list[str], metadata: dict[str, str], batch_rows: int, file_bytes: int = FILE_BYTES, codec: str = "", flatten: str = ""):
        self.path, self.stats, self.metadata, self.batch_rows = path, stats, metadata, batch_rows
        self.file_bytes, self.codec, self.flatten = file_bytes, codec, flatten

    def flat(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Fields of structs as columns, named PARENT__CHILD, or by their own names (``bare``)."""
        while self.flatten and any(pa.types.is_struct(f.type) for f in batch.schema):
            columns, names = [], []
            for field, column in zip(batch.schema, batch.columns, strict=True):
                if pa.types.is_struct(field.type):
                    columns += column.flatten()
                    names += [child.name if self.flatten == "bare" else f"{field.name}__{child.name}" for child in field.type]
                else:
                    columns.append(column)
                    names.append(field.name)
            batch = pa.RecordBatch.from_arrays(columns, names=names)
        return batch

    def write(self, iterator):
        paths, held, rows, size = [], [], 0, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            batch = self.flat(batch)
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if size >= self.file_bytes:
                paths.append(self._file(held))
                held, rows, size = [], 0, 0
        if held:
            paths.append(self._file(held))
        return Written(tuple(paths))

    def _file(self, held: list[pa.RecordBatch]) -> str:
        """Writes one file of what is held: the statistics stand in the schema, so they come first."""
        table = pa.Table.from_batches(held).combine_chunks()
        parts = table.to_batches(max_chunksize=self.batch_rows)
        fields = []
        for field in table.schema:
            meta = {k.partition(".")[2]: v for k, v in self.metadata.items() if k.startswith(f"{field.name}.")}
            if field.name in self.stats and can_pack(field.type):
                low, high, nulls = zip(*(bounds(p.column(field.name)) for p in parts), strict=True)
                meta |= {"min_values": json.dumps(low), "max_values": json.dumps(high), "null_counts": json.dumps(nulls)}
            fields.append(field.with_metadata(meta) if meta else field)
        own = {k: v for k, v in self.metadata.items() if k.partition(".")[0] not in table.schema.names or "." not in k}
        schema = pa.schema(fields, metadata=own or None)
        system, inner = store(self.path)
        system.create_dir(inner, recursive=True)
        name = f"{inner.rstrip('/')}/part-{uuid.uuid4().hex}.arrow"
        options = pa.ipc.IpcWriteOptions(compression=self.codec or None)
        with system.open_output_stream(name + ".tmp") as sink, pa.ipc.new_file(sink, schema, options=options) as out:
            for p in parts:
                out.write_batch(pa.RecordBatch.from_arrays(p.columns, schema=schema))
        return name

    def _each(self, messages) -> Iterator[tuple[pafs.FileSystem, str]]:
        system, _ = store(self.path)
        for m in messages:
            for p in m.paths if m else ():
                yield system, p

    def commit(self, messages):
        for system, p in self._each(messages):
            system.move(p + ".tmp", p)

    def abort(self, messages):
        for system, p in self._each(messages):
            if system.get_file_info(p + ".tmp").is_file:
                system.delete_file(p + ".tmp")


class ArrowFiles(DataSource):
    """format("arrow_files").

    Read: path (several by comma), suffix, pattern (its keys become columns),
    metadata (keys of files, or FIELD.KEY, as columns), split (keys whose items go to
    the batches), pathname and filename (names of columns), where (see ``load``).
    Write: path, stats (fields), meta.KEY and meta.FIELD.KEY, batchRows, fileBytes,
    codec (lz4 or zstd), flatten (true or bare).
    """

    @classmethod
    def name(cls):
        return "arrow_files"

    def _list(self, key: str) -> list[str]:
        return [k for k in self.options.get(key, "").split(",") if k]

    def _virtual(self) -> list[tuple[str, str, str]]:
        from quernstone.sources.patterns import compile_pattern

        pattern = self.options.get("pattern", "")
        out = [(k, "field" if "." in k else "file", k) for k in self._list("metadata")] + [(k, "split", k) for k in self._list("split")]
        out += [(self.options[k], k, k) for k in ("pathname", "filename") if self.options.get(k)]
        return out + [(k, "number" if is_number else "text", k) for k, is_number in (compile_pattern(pattern)[1] if pattern else [])]

    def _files(self) -> list[str]:
        return files_of(self.options["path"], self.options.get("suffix", ""), self.options.get("pattern", ""))

    def schema(self):
        files = self._files()
        if not files:
            raise FileNotFoundError(f"no Arrow file in {self.options['path']}")
        with opened(files[0]) as source:
            schema = pa.ipc.open_file(source).schema
        for name, kind, _ in self._virtual():
            schema = schema.append(pa.field(name, pa.int64() if kind == "number" else pa.string()))
        names = unique_names(schema.names)
        return from_arrow_schema(pa.schema([pa.field(n, f.type, f.nullable) for n, f in zip(names, schema, strict=True)]))

    def reader(self, schema):
        where = self.options.get("where")
        return ArrowReader(self.options["path"], schema, self._virtual(), self.options.get("suffix", ""), self.options.get("pattern", ""), _tree_from_json(json.loads(where)) if where else None)

    def writer(self, schema, overwrite):
        meta = {k[5:]: v for k, v in self.options.items() if k.startswith("meta.")}
        return ArrowWriter(self.options["path"], self._list("stats"), meta, int(self.options.get("batchrows", "65536")), int(self.options.get("filebytes", str(FILE_BYTES))), self.options.get("codec", ""), {"true": "names", "bare": "bare"}.get(self.options.get("flatten", ""), ""))


def register(spark) -> None:
    from quernstone.sources import patterns

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # planning workers don't have shipped files yet: the classes travel by value
    for module in (sys.modules[__name__], patterns):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(ArrowFiles)


def import_table(spark, view: str, path: str, **options) -> None:
    """Declares a temporary view over Arrow files: its columns come from the files, repeated names get a number."""
    register(spark)
    spark.read.format("arrow_files").options(**options).load(path).createOrReplaceTempView(view)


def metadata_info(path: str) -> list[tuple[str, str | None, str, str]]:
    """(file, field or None, key, value) of all custom metadata in the footers."""

    def of(f: str) -> list[tuple]:
        with opened(f) as source:
            schema = pa.ipc.open_file(source).schema
        own = [(f, None, k.decode(), v.decode()) for k, v in (schema.metadata or {}).items()]
        return own + [(f, field.name, k.decode(), v.decode()) for field in schema for k, v in (field.metadata or {}).items()]

    with ThreadPoolExecutor(FOOTERS) as pool:
        return [row for rows in pool.map(of, files_of(path)) for row in rows]


def metadata_stats(path: str) -> list[tuple[str, str, int, object, object, int | None]]:
    """(file, field, batch, least, greatest, nulls) of all statistics in the footers."""
    out = []
    for f in files_of(path):
        with opened(f) as source:
            known = statistics(pa.ipc.open_file(source).schema)
        for field, (low, high, nulls) in known.items():
            out += [(f, field, i, a, b, nulls[i] if nulls else None) for i, (a, b) in enumerate(zip(low, high, strict=True))]
    return out
