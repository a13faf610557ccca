"""Sources and sinks: written to the shared folder, read back, compared with the table they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsreach.operators import rollup as R
from newsreach.plans.registry import query
from newsreach.plans.stand_ins import Roles
from newsreach.sources import files as S
from newsreach.sources.ledger import ledger, read_chunks, run_chunks
from newsreach.sources.workspace import fresh_path


@query("S4_csv_union_by_name", """
    SELECT doc_id, lang, CASE WHEN lang <> 'en' THEN source END AS source, n_chars, md5(text) AS text_md5 FROM documents""")
def s4(r: Roles) -> DataFrame:
    """Texts with quotes and line breaks, written as two sets of parts with different headers."""
    folder = fresh_path(r.spark, "csv")
    docs = r.table("documents")
    for name, part, columns in (
        ("a", docs.where("lang = 'en'"), ["doc_id", "lang", "n_chars", "text"]),
        ("b", docs.where("lang <> 'en'"), ["text", "source", "doc_id", "n_chars", "lang"]),
    ):
        S.write_csv_gz(part.select(*columns), f"{folder}/{name}")
    table = S.read_csv_glob(r.spark, f"{folder}/*/*.csv.gz", {"doc_id": "bigint", "n_chars": "bigint"})
    return table.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("S7_parquet_sink", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s7(r: Roles) -> DataFrame:
    orders = r.table("orders", "o_orderkey", "o_custkey", "o_totalprice")
    path = fresh_path(r.spark, "orders")
    S.write_if_absent(S.write_table(orders, path, ["o_custkey", "o_orderkey"]), path)
    return r.spark.read.parquet(path)


@query("S8_csv_gz_sink", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS written FROM customer")
def s8(r: Roles) -> DataFrame:
    path = fresh_path(r.spark, "customer")
    rows = S.write_csv_gz(r.table("customer", "c_custkey", "c_name"), path)
    back = S.read_csv_glob(r.spark, f"{path}/*.csv.gz", {"c_custkey": "bigint"})
    return back.withColumn("written", F.lit(rows).cast("bigint"))


@query("S9_publish", """
    SELECT 'media' AS name, count(*) AS rows FROM media UNION ALL
    SELECT 'media_frequency', count(*) FROM frequency UNION ALL SELECT 'media_total', 1""", "media frequency")
def s9(r: Roles) -> DataFrame:
    folder = fresh_path(r.spark, "serving")
    tables = {"media": r.media(), "media_frequency": r.frequency(), "media_total": r.total()}
    S.publish(tables, folder)
    counted = None
    for name in tables:
        part = S.published(r.spark, folder, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        counted = part if counted is None else counted.unionByName(part)
    return counted


@query("S10_run_missing", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled FROM orders")
def s10(r: Roles) -> DataFrame:
    """A first run that did a part of the keys, and a second one that takes up the rest."""
    path = fresh_path(r.spark, "resumed")
    orders = r.table("orders", "o_orderkey", "o_orderstatus", "o_totalprice")

    def work(part: DataFrame) -> DataFrame:
        return part.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("doubled"))

    S.run_missing(orders.where("o_orderstatus = 'F'"), path, ["o_orderkey"], work)
    return S.run_missing(orders, path, ["o_orderkey"], work)


@query("S10_chunk_ledger", """
    SELECT o_orderkey % 8 AS chunk, CASE WHEN o_orderkey % 8 = 3 THEN 0 ELSE count(*) END AS first_run, count(*) AS second_run,
           CASE WHEN o_orderkey % 8 = 3 THEN 2 ELSE 1 END::INTEGER AS attempts FROM orders GROUP BY 1""")
def s10_ledger(r: Roles) -> DataFrame:
    """Eight chunks, of which one fails in the first run; the second run takes up that one alone."""
    path = fresh_path(r.spark, "chunks")
    orders = r.table("orders", "o_orderkey").withColumn("chunk", F.col("o_orderkey") % 8)

    def failing(part: DataFrame) -> DataFrame:
        return part.withColumn("checked", F.when(F.col("chunk") == 3, F.raise_error(F.lit("no"))).otherwise("yes"))

    run_chunks(orders, "chunk", path, failing)
    first = read_chunks(r.spark, path).groupBy("chunk").agg(F.count(F.lit(1)).alias("first_run"))
    run_chunks(orders, "chunk", path, lambda part: part.withColumn("checked", F.lit("yes")))
    second = read_chunks(r.spark, path).groupBy("chunk").agg(F.count(F.lit(1)).alias("second_run"))
    tries = ledger(r.spark, path).groupBy(F.col("chunk").cast("bigint").alias("chunk")).agg(F.max("attempt").alias("attempts"))
    return second.join(first, "chunk", "left").join(tries, "chunk").select(
        "chunk", F.coalesce("first_run", F.lit(0)).alias("first_run"), "second_run", "attempts")


@query("S11_metrics_json", "SELECT outlet, case_count FROM frequency", "frequency")
def s11(r: Roles) -> DataFrame:
    return S.write_metrics(r.frequency(), fresh_path(r.spark, "metrics"))


@query("A11_assert_unique", "SELECT o_orderkey, o_custkey FROM orders")
def a11(r: Roles) -> DataFrame:
    return R.assert_unique(r.table("orders", "o_orderkey", "o_custkey"), ["o_orderkey"])


@query("A12_assert_same_count", "SELECT o_orderkey FROM orders")
def a12(r: Roles) -> DataFrame:
    orders = r.table("orders", "o_orderkey")
    return R.assert_same_count(orders, S.write_table(orders, fresh_path(r.spark, "copy")), ["o_orderkey"])
