"""Queries that check tables: the chronology and tense of spans, and rules over configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, spans
from ..operators.storage import shared_dir
from .registry import query, table

_TODAY = "1998-08-02"
_SPANS = f"""l AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey),
s AS (SELECT o_custkey AS owner, o_orderkey AS id, CAST(o_orderdate AS DATE) AS start, CASE WHEN o_orderstatus <> 'O' THEN CAST(last AS DATE) END AS stop, o_orderkey % 1000 AS place
  FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
e AS (SELECT *, coalesce(stop, greatest(DATE '{_TODAY}', start)) AS ends FROM s),
w AS (SELECT *, max(ends) OVER (PARTITION BY owner ORDER BY start, ends, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest, min(start) OVER (PARTITION BY owner ORDER BY place, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS oldest FROM e)"""


@query(
    f"""WITH {_SPANS} SELECT id AS o_orderkey, array_to_string(list_filter([CASE WHEN stop < start THEN 'reversed' END, CASE WHEN start > DATE '{_TODAY}' THEN 'future' END, CASE WHEN start > oldest THEN 'order' END, CASE WHEN start < latest THEN 'overlap' END], lambda x: x IS NOT NULL), ',') AS errors,
  CAST(CASE WHEN latest IS NULL THEN 0 ELSE greatest(0, date_diff('day', start, least(latest, ends))) END AS BIGINT) AS covered_days, CAST(greatest(0, coalesce(date_diff('day', latest, start), 0)) AS BIGINT) AS gap_days FROM w"""
)
def span_chronology(spark: SparkSession, d: str) -> DataFrame:
    """An order is a span of its customer, from its date to its last shipment; one that is open goes on."""
    shipped = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, d, "orders").join(shipped, "o_orderkey", "left")
    stop = F.when(F.col("o_orderstatus") != "O", F.to_date("last"))
    told = rows.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("start"), stop.alias("stop"), (F.col("o_orderkey") % 1000).alias("place"))
    out = spans.chronology(told, F.lit(_TODAY).cast("date"))
    return out.select(F.col("id").alias("o_orderkey"), F.array_join("errors", ",").alias("errors"), F.col("covered_days").cast("bigint").alias("covered_days"), F.col("gap_days").cast("bigint").alias("gap_days"))


_TOLD = "CASE o_orderkey % 4 WHEN 0 THEN 'Gère le lot ' || o_custkey WHEN 1 THEN 'A géré le lot ' || o_custkey WHEN 2 THEN 'Gère et a géré ' || o_custkey ELSE 'Client ' || o_custkey END"


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 IN (0, 2) THEN 'present' WHEN o_orderstatus <> 'F' AND o_orderkey % 4 = 1 THEN 'past' END AS wrong FROM orders")
def span_tense(spark: SparkSession, d: str) -> DataFrame:
    """What is over must be told in the past, what goes on in the present."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.expr(_TOLD).alias("said"))
    return rows.select("o_orderkey", spans.wrong_tense(F.col("said"), F.col("o_orderstatus") == "F", ["gère"], ["a géré"]).alias("wrong"))


_PARENT = "CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey * 7 + 1) % 1024 END"


@query(
    f"""WITH RECURSIVE link AS (SELECT p_partkey AS id, {_PARENT} AS p FROM part), step AS (SELECT id, id AS at_ FROM link UNION SELECT s.id, l.p FROM step s JOIN link l ON l.id = s.at_ JOIN link k ON k.id = l.p),
ended AS (SELECT DISTINCT s.id FROM step s JOIN link l ON l.id = s.at_ LEFT JOIN link k ON k.id = l.p WHERE k.id IS NULL)
SELECT 'part.name' AS rule, p_name || '/' || p_brand AS subject, count(*) || ' rows' AS detail FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL GROUP BY p_name, p_brand HAVING count(*) > 1
UNION ALL SELECT 'part.size', CAST(p_partkey AS VARCHAR), 'p_size: ' || p_size FROM part WHERE p_size NOT BETWEEN 1 AND 40
UNION ALL SELECT 'customer.nation', CAST(c_custkey AS VARCHAR), 'c_nationkey: ' || c_nationkey FROM customer WHERE c_nationkey % 7 = 0
UNION ALL SELECT 'customer.segment', CAST(c_custkey AS VARCHAR), 'c_mktsegment: ' || c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE', 'MACHINERY')
UNION ALL SELECT 'document.lang', CAST(doc_id AS VARCHAR), 'lang is missing' FROM documents WHERE coalesce(trim(lang), '') = ''
UNION ALL SELECT 'part.parent', CAST(id AS VARCHAR), 'leads into a cycle' FROM link WHERE id NOT IN (SELECT id FROM ended)"""
)
def config_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every violation of the rules of a configuration: duplicates, ranges, choices, unknown references, missing values, cycles."""
    part, customer = table(spark, d, "part"), table(spark, d, "customer")
    return rules.violations(
        rules.unique(part, "part.name", ["p_name", "p_brand"]),
        rules.holds(part, "part.size", "p_partkey", "p_size", F.col("p_size").between(1, 40)),
        rules.refers(customer, "customer.nation", "c_custkey", "c_nationkey", table(spark, d, "nation").where("n_nationkey % 7 <> 0"), "n_nationkey"),
        rules.one_of(customer, "customer.segment", "c_custkey", "c_mktsegment", ["BUILDING", "FURNITURE", "MACHINERY"]),
        rules.required(table(spark, d, "documents"), "document.lang", "doc_id", "lang"),
        rules.acyclic(part.select("p_partkey", F.expr(_PARENT).alias("parent")), "part.parent", "p_partkey", "parent"),
    )


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_nationkey % 6 <> 0 UNION ALL SELECT NULL, 'readable: is no JSON of this form' FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey % 6 = 0)")
def config_documents(spark: SparkSession, d: str) -> DataFrame:
    """Configuration from a folder of JSON documents, a list per nation; those that are cut off are told, not read."""
    where = f"{shared_dir(spark)}/config-{uuid.uuid4().hex}"
    each = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))).alias("j"))
    cut = F.when(F.col("s_nationkey") % 6 == 0, F.substr("j", F.lit(1), F.length("j") - 2)).otherwise(F.col("j"))
    each.select("s_nationkey", cut.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(where)
    entries, broken = rules.read_config(spark, f"{where}/*", "k bigint, name string")
    return entries.select("k", "name").unionByName(broken.select(F.lit(None).cast("bigint").alias("k"), F.concat_ws(": ", "rule", "detail").alias("name")))
