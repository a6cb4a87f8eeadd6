"""Sources, sinks and continuously updated tables, each as a round trip."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import functions as F

from quernstone.plans.base import Plans
from quernstone.session import table
from quernstone.sources import arrow_files, delimited, generators, patterns
from quernstone.sources.parquet_cache import ParquetCache
from quernstone.streaming import tables as stream_tables

P = Plans()
c = F.col


def scratch(spark) -> str:
    """A fresh folder that executors see too: in the shared checkpoint folder; a local session without one gets a temporary folder."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or os.path.join(tempfile.gettempdir(), "quernstone-io")
    return f"{base.removeprefix('file://')}/{uuid.uuid4().hex}"


@P.plan("SELECT CAST(year(l_shipdate) AS BIGINT) AS y, l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE year(l_shipdate) IN (1997, 1999) GROUP BY ALL")
def virtual_column(spark, sf_dir):
    """Keys of the file name as columns; other files aren't opened."""
    folder = scratch(spark)
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", F.year("l_shipdate").alias("y"))
    li.filter(c("y").between(1996, 1999)).repartition("y").write.partitionBy("y").parquet(f"{folder}/raw")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/all"))
    for y in (1996, 1997, 1998, 1999):
        for k, part in enumerate(patterns.list_files(spark, f"{folder}/raw/y={y}", "part-*.parquet")):
            fs.rename(path(part), path(f"{folder}/all/line_{y}_{k}.parquet"))
    df = patterns.read_with_keys(spark, f"{folder}/all", "line_@{y}_${rest}.parquet", {"y": {1997, 1999}})
    return df.groupBy("y", c("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@P.plan("SELECT o_orderstatus, count(*) AS n, 'driver' AS origin, CAST(NULL AS VARCHAR) AS absent FROM orders WHERE o_orderkey BETWEEN 500 AND 1500 GROUP BY o_orderstatus")
def arrow_roundtrip(spark, sf_dir):
    """Arrow files with statistics and custom metadata: batches are skipped, metadata comes back as columns."""
    arrow_files.register(spark)
    folder = scratch(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    o.write.format("arrow_files").option("path", folder).option("stats", "o_orderkey").option("batchRows", "1000").option("meta.origin", "driver").mode("append").save()
    back = spark.read.format("arrow_files").option("path", folder).option("metadata", "origin,absent").load()
    return back.filter(c("o_orderkey").between(500, 1500)).groupBy("o_orderstatus", "origin", "absent").agg(F.count("*").alias("n"))


def _arrow_orders(spark, sf_dir, **options) -> str:
    """Orders as Arrow files in key order, 500 rows a batch."""
    arrow_files.register(spark)
    folder = scratch(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", c("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"), (c("o_custkey") % 2 == 0).alias("even"))
    o.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.format("arrow_files").option("path", folder).option("stats", "o_orderkey,o_orderdate,o_totalprice,even").option("batchRows", "500").options(**options).mode("append").save()
    return folder


@P.plan("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE (o_orderkey < 300 OR o_orderkey > 1200) AND NOT (o_orderkey BETWEEN 100 AND 200) AND (o_orderkey < 2000 OR o_orderdate IS NULL) GROUP BY o_orderstatus")
def arrow_or_skipping(spark, sf_dir):
    """Batches are skipped by AND, OR and NOT over their statistics."""
    where = ("and", ("or", ("<", "o_orderkey", 300), (">", "o_orderkey", 1200)), ("not", ("and", (">=", "o_orderkey", 100), ("<=", "o_orderkey", 200))), ("or", ("<", "o_orderkey", 2000), ("is_null", "o_orderdate")))
    rows = arrow_files.load(spark, _arrow_orders(spark, sf_dir), where)
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@P.plan("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND CAST(o_totalprice AS DECIMAL(12, 2)) > 250000.5 AND o_custkey % 2 = 0")
def arrow_typed_skipping(spark, sf_dir):
    """Statistics of timestamps, decimals and booleans."""
    rows = spark.read.format("arrow_files").load(_arrow_orders(spark, sf_dir))
    low = F.lit("1996-01-01").cast("timestamp_ntz")
    return rows.filter((c("o_orderdate") >= low) & (c("o_totalprice") > F.lit("250000.5").cast("decimal(12,2)")) & c("even")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@P.plan("SELECT k.unit AS unit, k.kind AS kind, k.year AS year, count(*) AS n FROM orders, (SELECT 'key' AS unit, 'b' AS kind, 1997 AS year) k GROUP BY ALL")
def arrow_virtual(spark, sf_dir):
    """Columns from field metadata (FIELD.KEY) and from the file name; other files are left out by the filter."""
    folders = [(_arrow_orders(spark, sf_dir, **{"meta.o_orderkey.unit": "key"}), name) for name in ("a_1996", "b_1997")]
    whole = scratch(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(whole).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(whole))
    for folder, name in folders:
        for k, part in enumerate(patterns.list_files(spark, folder, "part-*.arrow")):
            fs.rename(path(part), path(f"{whole}/{name}_{k}.arrow"))
    rows = spark.read.format("arrow_files").option("metadata", "o_orderkey.unit").option("pattern", "${kind}_@{year}_*.arrow").option("filename", "file").load(whole)
    return rows.filter((c("kind") == "b") & (c("year") == 1997) & c("file").startswith("b_")).groupBy(c("`o_orderkey.unit`").alias("unit"), "kind", c("year").cast("int").alias("year")).agg(F.count("*").alias("n"))


@P.plan("SELECT n.field AS field, min(o_orderkey) AS lo, max(o_orderkey) AS hi, 0 AS nulls FROM orders, (SELECT 'o_orderkey' AS field) n GROUP BY n.field")
def arrow_statistics(spark, sf_dir):
    """Statistics of the footers as a table."""
    rows = [(field, low, high, nulls) for _, field, _, low, high, nulls in arrow_files.metadata_stats(_arrow_orders(spark, sf_dir)) if field == "o_orderkey"]
    found = spark.createDataFrame(rows, "field string, lo bigint, hi bigint, nulls int")
    return found.groupBy("field").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("nulls").cast("int").alias("nulls"))


@P.plan("SELECT n_regionkey AS k, n_name AS k_1, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def arrow_import(spark, sf_dir):
    """A table declared over Arrow files whose column names repeat."""
    folder, view = scratch(spark), f"imported_{uuid.uuid4().hex[:8]}"
    n = table(spark, sf_dir, "nation").select(F.struct(c("n_regionkey").alias("k")).alias("a"), F.struct(c("n_name").alias("k")).alias("b"), "n_nationkey")
    arrow_files.register(spark)
    n.write.format("arrow_files").option("path", folder).option("flatten", "bare").mode("append").save()
    arrow_files.import_table(spark, view, folder)
    return spark.table(view).join(table(spark, sf_dir, "customer"), c("n_nationkey") == c("c_nationkey")).groupBy("k", "k_1").agg(F.count("*").alias("n"))


@P.plan("SELECT CAST(batch AS VARCHAR) AS part, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS batch FROM nation) x GROUP BY batch")
def arrow_split(spark, sf_dir):
    """The i-th item of a metadata list belongs to the i-th batch."""
    arrow_files.register(spark)
    folder = scratch(spark)
    n = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    n.write.format("arrow_files").option("path", folder).option("batchRows", "10").option("meta.part", "0,1,2").mode("append").save()
    return spark.read.format("arrow_files").option("split", "part").load(folder).groupBy("part").agg(F.count("*").alias("n"))


@P.plan("SELECT s_nationkey AS k, count(*) AS n, round(sum(s_acctbal), 2) AS bal, CAST(count(DISTINCT s_suppkey // 100) AS BIGINT) AS files FROM supplier WHERE s_suppkey >= 0 GROUP BY s_nationkey")
def arrow_flatten(spark, sf_dir):
    """Structs written as flat columns, compressed buffers."""
    arrow_files.register(spark)
    folder = scratch(spark)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.struct("s_nationkey", F.struct("s_acctbal").alias("money")).alias("s"))
    s.write.format("arrow_files").option("path", folder).option("flatten", "true").option("codec", "zstd").mode("append").save()
    back = spark.createDataFrame([], "s_suppkey bigint").select("s_suppkey").unionByName(spark.read.format("arrow_files").load(folder), allowMissingColumns=True)
    return back.groupBy(c("s__s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("s__money__s_acctbal"), 2).alias("bal"), F.count_distinct(F.floor(c("s_suppkey") / 100)).alias("files"))


@P.plan("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_roundtrip(spark, sf_dir):
    folder = scratch(spark)
    delimited.write(table(spark, sf_dir, "supplier"), folder, sep="\t", header=True)
    return delimited.read(spark, folder, "s_suppkey:int8;s_name:text;s_nationkey:int4;s_acctbal:float8", header=True)


@P.plan("SELECT user_id % 22 + 1 AS chrom, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS pos, CAST(sum(user_id) AS BIGINT) AS depth FROM events GROUP BY user_id % 22 + 1")
def vcf_roundtrip(spark, sf_dir):
    folder = scratch(spark)
    ev = table(spark, sf_dir, "events")
    line = F.concat_ws("\t", (c("user_id") % 22 + 1).cast("string"), c("event_id").cast("string"), F.lit("."), F.lit("A"), F.lit("T"), F.lit("."), F.lit("PASS"), F.concat(F.lit("DP="), c("user_id").cast("string"), F.lit(";DB")), F.lit("GT"), F.lit("0|1"))
    ev.select(line.alias("value")).write.text(folder)
    v = delimited.read_vcf(spark, folder)
    return v.groupBy(c("chrom").cast("long").alias("chrom")).agg(F.count("*").alias("n"), F.sum("pos").alias("pos"), F.sum(c("attributes")["DP"].cast("long")).alias("depth"))


@P.plan("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY l_returnflag, l_linestatus")
def partition_pruned_agg(spark, sf_dir):
    """A table partitioned by year: one partition is read."""
    folder = scratch(spark)
    table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate")).write.partitionBy("y").parquet(folder)
    return spark.read.parquet(folder).filter("y = 1998").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


@P.plan("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus")
def ctas_roundtrip(spark, sf_dir):
    """CREATE TABLE AS SELECT, read again."""
    folder = scratch(spark)
    spark.sql("SELECT o_orderstatus, o_totalprice FROM {orders}", orders=table(spark, sf_dir, "orders")).write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@P.plan("SELECT kind, count(*) AS n FROM (SELECT 'a' AS kind FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b' FROM orders WHERE o_orderkey % 2 = 1) x GROUP BY kind")
def mixed_partitions(spark, sf_dir):
    """One table of children in different formats (Parquet, ORC), by name."""
    folder = scratch(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    o.filter("o_orderkey % 2 = 0").write.parquet(f"{folder}/p")
    o.filter("o_orderkey % 2 = 1").write.orc(f"{folder}/o")
    both = spark.read.parquet(f"{folder}/p").withColumn("kind", F.lit("a")).unionByName(spark.read.orc(f"{folder}/o").withColumn("kind", F.lit("b")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


def _unit_sql(seed: int) -> str:
    return f"(CAST('0x' || substr(md5(id || ':{seed}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _int_sql(seed: int, low: int, high: int) -> str:
    return f"CAST(floor({_unit_sql(seed)} * {high - low + 1}) + {low} AS BIGINT)"


@P.plan(
    f"""SELECT id, CASE WHEN {_unit_sql(7920)} * 100 >= 2 THEN {_int_sql(1, 5, 9)} END AS i, {_unit_sql(2)} * 2 - 1 AS f, DATE '2020-01-01' + CAST(floor({_unit_sql(3)} * 365) AS INT) AS d, 't' || CAST(floor({_unit_sql(4)} * 10) AS BIGINT) AS t,
'192.168.' || CAST(floor({_unit_sql(6)} * 256) AS INT) || '.' || CAST(floor({_unit_sql(7)} * 256) AS INT) AS a, regexp_replace(substr(md5(id || ':6'), 1, 12), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS m, CAST(floor({_unit_sql(8)} * 86400000000) AS BIGINT) AS us,
substr(md5(id || ':10:0') || md5(id || ':10:1'), 1, CAST(floor({_unit_sql(10)} * 40) AS INT) + 1) AS x, least({_int_sql(12, 0, 99)}, {_int_sql(13, 0, 99)}) < greatest({_int_sql(12, 0, 99)}, {_int_sql(13, 0, 99)}) AS filled, abs({_int_sql(12, 0, 99)} - {_int_sql(13, 0, 99)}) AS width FROM (SELECT CAST(range AS VARCHAR) AS key, range AS id FROM range(1000)) k""".replace("md5(id", "md5(key")
)
def random_columns(spark, sf_dir):
    """Deterministic generators with null percentages."""
    k = c("id")
    r = generators.random_range(k, 12, 0, 99)
    return spark.range(1000).select(
        "id", generators.random_int(k, 1, 5, 9, 2).alias("i"), generators.random_float(k, 2, -1, 1).alias("f"), generators.random_date(k, 3, "2020-01-01", 365).alias("d"), generators.random_text(k, 4, "t", 10).alias("t"), generators.random_inet(k, 5).alias("a"), generators.random_macaddr(k, 6).alias("m"),
        generators.random_time(k, 8).alias("us"), generators.random_text_len(k, 10, 40).alias("x"), (~r["empty"]).alias("filled"), F.coalesce(r["upper"] - r["lower"], F.lit(0)).alias("width"),
    )


_LAST = "(SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)"


@P.plan(f"SELECT user_id, event_type, value FROM {_LAST} x WHERE r = 1 AND event_type <> 'error'")
def stream_upsert(spark, sf_dir):
    """A keyed replica of a change stream: the last change of each user, errors delete."""
    folder = scratch(spark)
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    ev.repartitionByRange(3, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("op", F.when(c("event_type") == "error", "delete").otherwise("put"))
    t = stream_tables.KeyedTable(f"{folder}/table", ["user_id"], "event_id")
    t.start(stream, f"{folder}/ck").awaitTermination()
    return t.read(spark).select("user_id", "event_type", "value")


@P.plan("SELECT CAST(ts AS DATE) AS day, event_type, 'log' AS tag, count(*) AS n FROM events GROUP BY ALL")
def stream_ingest(spark, sf_dir):
    """A stream appended to files by day."""
    folder = scratch(spark)
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    ev.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{folder}/in")
    stream_tables.ingest(stream, f"{folder}/out", f"{folder}/ck", "ts", "log").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("day", "event_type", "tag").agg(F.count("*").alias("n"))


@P.plan("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Event-time windows with a watermark; complete mode gives every window."""
    folder = scratch(spark)
    ev = table(spark, sf_dir, "events").select(c("ts").cast("timestamp").alias("ts"), "event_type")
    ev.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{folder}/in")
    counts = stream_tables.windowed_counts(stream, "ts", "6 hours", by=("event_type",))
    stream_tables.complete_to(counts, f"{folder}/out", f"{folder}/ck").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(c("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_GAPS = "(SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))"


@P.plan(f"SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM {_GAPS} g) x GROUP BY user_id, s")
def stream_sessions(spark, sf_dir):
    """Sessions of each user that end after half a day without an event."""
    folder = scratch(spark)
    ev = table(spark, sf_dir, "events").select(c("ts").cast("timestamp").alias("ts"), "user_id")
    ev.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{folder}/in")
    stream_tables.complete_to(stream_tables.session_counts(stream, "ts", "12 hours", by=("user_id",)), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", c("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@P.plan("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_late(spark, sf_dir):
    """Rows behind the watermark are left out of windows that it has closed."""
    folder = scratch(spark)
    ev = table(spark, sf_dir, "events").select(c("ts").cast("timestamp").alias("ts"))
    end = ev.agg(F.max("ts").alias("ts"))
    late = ev.agg(F.min("ts").alias("ts")).select(F.explode(F.array_repeat("ts", 50)).alias("ts"))
    # the events, rows of the first day that come after the last one, and a row that closes all windows
    for part in (ev.coalesce(1), end.select((c("ts") + F.expr("INTERVAL '3' DAY")).alias("ts")), late, end.select((c("ts") + F.expr("INTERVAL '9' DAY")).alias("ts"))):
        part.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = stream_tables.windowed_counts(stream, "ts", "1 day").writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    last = end.select(F.date_trunc("day", "ts").alias("day"))
    return spark.read.parquet(f"{folder}/out").select(c("window.start").alias("day"), "n").join(F.broadcast(last.withColumnRenamed("day", "end")), c("day") <= c("end")).select(c("day").cast("timestamp_ntz").alias("start"), "n")


@P.plan("SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events GROUP BY user_id")
def stream_state(spark, sf_dir):
    """A user's own state per key, carried from micro-batch to micro-batch."""
    folder = scratch(spark)
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    ev.repartitionByRange(3, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def add(key, frames, state):
        n, total = state.get if state.exists else (0, 0)
        for frame in frames:
            n, total = n + len(frame), total + int(frame["event_id"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "s": [total]})

    out = stream.groupBy("user_id").applyInPandasWithState(add, "user_id bigint, n bigint, s bigint", "n bigint, s bigint", "update", "NoTimeout")
    t = stream_tables.KeyedTable(f"{folder}/table", ["user_id"], "n")
    t.start(out.withColumn("op", F.lit("put")), f"{folder}/ck", "update").awaitTermination()
    return t.read(spark).select("user_id", "n", "s")


@P.plan("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s, 2 AS entries FROM orders GROUP BY o_orderstatus")
def parquet_cache(spark, sf_dir):
    """Columns of Parquet files kept on the executors' disks: two queries, one read."""
    table(spark, sf_dir, "orders")
    cache = ParquetCache(spark)
    cache.read(f"{sf_dir}/nation.parquet")
    for _ in range(2):
        rows = cache.read(f"{sf_dir}/orders.parquet", ["o_orderstatus", "o_totalprice"])
        out = rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    return out.withColumn("entries", F.lit(len(cache.info())))


@P.plan("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events WHERE event_id >= 100 GROUP BY event_type")
def stream_ingest_arrow(spark, sf_dir):
    """A stream appended to Arrow files with statistics."""
    arrow_files.register(spark)
    folder = scratch(spark)
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    ev.repartitionByRange(2, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream_tables.ingest_arrow(stream, f"{folder}/out", f"{folder}/ck", "event_id").awaitTermination()
    folders = [f"{folder}/out/{e:010d}" for e in range(2)]
    return arrow_files.load(spark, ",".join(folders), (">=", "event_id", 100)).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


QUERIES, ORACLES = P.queries, P.oracles
