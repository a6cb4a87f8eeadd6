"""Table-level features: renamed columns, imported schemas, statistics, bucketed joins, user functions, typed nested data."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators import joins as J
from quernstone.plans.base import Plans
from quernstone.plans.io import scratch
from quernstone.session import table
from quernstone.sources import arrow_files

P = Plans()
c = F.col


@P.plan("SELECT n_nationkey AS id, n_name AS label, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def column_mapping(spark, sf_dir):
    """Columns of a file under other names."""
    n = table(spark, sf_dir, "nation").withColumnsRenamed({"n_nationkey": "id", "n_name": "label"})
    return n.join(table(spark, sf_dir, "customer"), c("id") == c("c_nationkey")).groupBy("id", "label").agg(F.count("*").alias("n"))


@P.plan("SELECT r_regionkey, r_name FROM region")
def import_schema(spark, sf_dir):
    """A table declared over files: the schema comes from them."""
    name = f"imported_{uuid.uuid4().hex[:8]}"
    folder = scratch(spark)
    table(spark, sf_dir, "region").write.parquet(folder)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} USING parquet OPTIONS (path '{folder}')")
    return spark.table(name)


@P.plan("SELECT 'origin' AS k, 'driver' AS v, CAST(NULL AS VARCHAR) AS field, count(DISTINCT n_regionkey) AS files FROM nation WHERE n_regionkey = 1 GROUP BY ALL")
def metadata_info(spark, sf_dir):
    """Custom metadata of files as a table."""
    arrow_files.register(spark)
    folder = scratch(spark)
    table(spark, sf_dir, "nation").coalesce(1).write.format("arrow_files").option("path", folder).option("meta.origin", "driver").mode("append").save()
    rows = [(f, field, k, v) for f, field, k, v in arrow_files.metadata_info(folder) if k == "origin"]
    return spark.createDataFrame(rows, "file string, field string, k string, v string").groupBy("k", "v", "field").agg(F.count_distinct("file").alias("files"))


@P.plan("SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def column_statistics(spark, sf_dir):
    """What ANALYZE keeps: counts and bounds, in one pass."""
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@P.plan("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) < '0d'")
def table_sample(spark, sf_dir):
    """ANALYZE's sampling: a deterministic share (13 of 256) of the rows by a digest of the key (a sampling operator)."""
    return table(spark, sf_dir, "orders").filter(F.substring(F.md5(c("o_orderkey").cast("string")), 1, 2) < "0d").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@P.plan("SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def join_bucketed(spark, sf_dir):
    """Partition-wise join: both tables are bucketed by the key, so the join doesn't shuffle."""
    a, b = (f"bucketed_{k}_{uuid.uuid4().hex[:8]}" for k in "ol")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.bucketBy(8, "o_orderkey").sortBy("o_orderkey").saveAsTable(a)
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").write.bucketBy(8, "l_orderkey").sortBy("l_orderkey").saveAsTable(b)
    joined = spark.table(a).hint("merge").join(spark.table(b), c("o_orderkey") == c("l_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@P.plan("SELECT n_regionkey, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal IS NOT NULL GROUP BY n_regionkey")
def join_keep_right(spark, sf_dir):
    """A build side of a checked size feeds several probes."""
    n = J.checked_broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    return table(spark, sf_dir, "supplier").filter(c("s_acctbal").isNotNull()).join(n, c("s_nationkey") == c("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("bal"))


@P.plan("SELECT p_type, count(*) AS n, round(sum(p_retailprice * 1.1), 2) AS taxed FROM part GROUP BY p_type")
def udf_scalar(spark, sf_dir):
    """A user's vectorised scalar function (Arrow batches)."""

    @F.pandas_udf(T.DoubleType())
    def taxed(x: pd.Series) -> pd.Series:
        return x * 1.1

    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.sum(taxed("p_retailprice")), 2).alias("taxed"))


@P.plan("SELECT l_returnflag, round(sqrt(avg(l_tax * l_tax)), 8) AS rms FROM lineitem GROUP BY l_returnflag")
def udf_aggregate(spark, sf_dir):
    """A user's aggregate as partial and final parts, so it combines before the shuffle."""
    partial = F.struct(F.sum(c("l_tax") * c("l_tax")).alias("s"), F.count("l_tax").alias("n"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(partial.alias("p")).select("l_returnflag", F.round(F.sqrt(c("p.s") / c("p.n")), 8).alias("rms"))


@P.plan("SELECT n_name, unnest(range(n_regionkey + 1)) AS i FROM nation")
def udf_table(spark, sf_dir):
    """A set-returning function, laterally joined."""
    return table(spark, sf_dir, "nation").select("n_name", F.explode(F.sequence(F.lit(0).cast("long"), c("n_regionkey").cast("long"))).alias("i"))


@P.plan("SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal >= 1000 AND c_acctbal < 5000) AS inside, count(*) FILTER (WHERE c_acctbal + 100 > 1000 AND c_acctbal < 5000) AS overlap FROM customer GROUP BY c_mktsegment")
def range_ops(spark, sf_dir):
    """Half-open ranges: contains and overlaps."""
    lo, hi = F.lit(1000.0), F.lit(5000.0)
    x = c("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.when((x >= lo) & (x < hi), 1)).alias("inside"), F.count(F.when((x < hi) & (lo < x + 100), 1)).alias("overlap"))


@P.plan("SELECT o_orderstatus AS status, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus")
def composite_fields(spark, sf_dir):
    """Sub-fields of composites and arrays of them."""
    o = table(spark, sf_dir, "orders").select(F.struct("o_orderstatus", F.array("o_totalprice").alias("prices")).alias("o"))
    return o.groupBy(c("o.o_orderstatus").alias("status")).agg(F.min(c("o.prices")[0]).alias("lo"), F.max(c("o.prices")[0]).alias("hi"))


@P.plan("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY source")
def documents_profile(spark, sf_dir):
    """Profile of the document table by source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct(F.md5("text")).alias("texts"))


@P.plan("SELECT conv_id, count(*) AS turns, min(role) AS first_role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conversations_profile(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("role").alias("first_role"), F.sum(F.length("text").cast("long")).alias("chars"))


P.same("lateral_join", "SELECT r_name, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) x")
P.same("nested_subquery_in_from", "SELECT k, count(*) AS n FROM (SELECT o_custkey % 10 AS k, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) t WHERE m > 100000 GROUP BY k")
P.same("not_null_three_ways", "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND NOT (nullif(o_orderpriority, '5-LOW') IS NULL)")
P.same("union_by_group", "SELECT kind, sum(n) AS n FROM (SELECT 'c' AS kind, count(*) AS n FROM customer UNION ALL SELECT 's', count(*) FROM supplier UNION ALL SELECT 'c', count(*) FROM nation) t GROUP BY kind", "SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'c' AS kind, count(*) AS n FROM customer UNION ALL SELECT 's', count(*) FROM supplier UNION ALL SELECT 'c', count(*) FROM nation) t GROUP BY kind")
P.same("date_trunc_group", "SELECT date_trunc('quarter', o_orderdate) AS q, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1")
P.same("simple_case_null", "SELECT CASE nullif(o_orderstatus, 'P') WHEN 'F' THEN 'f' WHEN 'O' THEN 'o' END AS k, count(*) AS n FROM orders GROUP BY 1")
P.same("in_subquery_multi", "SELECT count(*) AS n FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50)")

QUERIES, ORACLES = P.queries, P.oracles
