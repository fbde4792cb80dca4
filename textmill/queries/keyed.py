"""Keyed-table queries: customers as students, parts as courses, line items as enrolments."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.operators import keyed as k
from textmill.queries.register import registry
from textmill.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, 'new ' || c_name, 0.0 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0""")
def insert_if_absent(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    have = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return k.insert_if_absent(have, new, "c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer""")
def partial_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changes = c.select("c_custkey", F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'renamed' WHEN c_custkey % 4 = 1 THEN '  ' END").alias("c_name"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 0.0D END").alias("c_acctbal"))
    return k.update_partial(c, changes, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def delete_by_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return k.delete_by_key(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT DISTINCT o_custkey + 7 AS c_custkey FROM orders WHERE o_custkey + 7 NOT IN (SELECT c_custkey FROM customer)")
def unmatched_keys(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 7).alias("c_custkey"))
    return k.unmatched_keys(table(spark, sf_dir, "customer"), asked, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def key_lookup(spark, sf_dir):
    return k.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 42)


_ROSTER = "SELECT o_orderkey, c_name, p_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey"
_COUNTS = "SELECT p_partkey AS id_curso, p_name, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2"


@query(_ROSTER)
def roster(spark, sf_dir):
    enrolments = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("id_curso"))
    enrolments = enrolments.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id_alumno")), "o_orderkey")
    students = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id_alumno"), "c_name")
    courses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id_curso"), "p_name")
    return k.roster(enrolments, students, courses).select("o_orderkey", "c_name", "p_name")


@query(_ROSTER)
def roster_all(spark, sf_dir):
    return roster(spark, sf_dir)


@query(_COUNTS)
def count_per_course(spark, sf_dir):
    courses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id_curso"), "p_name")
    return k.count_per_course(courses, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id_curso")))


@query(_COUNTS)
def count_per_course_all(spark, sf_dir):
    return count_per_course(spark, sf_dir)


@query("SELECT l_orderkey, l_partkey AS id_curso, l_quantity FROM lineitem WHERE l_partkey = 7")
def enrolments_of_course(spark, sf_dir):
    enrolments = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id_curso"), "l_quantity")
    return k.enrolments_of_course(enrolments, 7)


@query("""SELECT coalesce(c_custkey, o_custkey + 100) AS c_custkey, CASE WHEN n % 2 = 0 THEN 'orders ' || n ELSE c_name END AS c_name, coalesce(CAST(n AS DOUBLE), c_acctbal) AS c_acctbal, c_mktsegment
    FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey + 100""")
def upsert(spark, sf_dir):
    """Orders of each customer, shifted so that some keys are new; odd counts give a blank name, which leaves the old one."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 100).alias("c_custkey")).agg(F.count("*").alias("n"))
    name = F.when(F.col("n") % 2 == 0, F.concat(F.lit("orders "), F.col("n").cast("string"))).otherwise("  ")
    return k.upsert(c, n.select("c_custkey", name.alias("c_name"), F.col("n").cast("double").alias("c_acctbal")), "c_custkey")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def dedup_pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates(["l_partkey", "l_suppkey"])


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM f WHERE n = 1""")
def distinct_by_key(spark, sf_dir):
    return k.distinct_by_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH r AS (SELECT c_custkey AS id_alumno, unnest(['C' || c_nationkey, 'C' || (c_nationkey + 1), 'C' || c_custkey % 5]) AS id_curso, generate_subscripts([1, 2, 3], 1) AS place FROM customer)
    SELECT CAST(100 + row_number() OVER (ORDER BY id_alumno, place) AS INT) AS id_inscripcion, id_alumno, id_curso, '2024-03-01' AS fecha_inscripcion FROM r""")
def enroll_many(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    list_of = F.concat(F.lit("C"), F.col("c_nationkey").cast("string"), F.lit(", C"), (F.col("c_nationkey") + 1).cast("string"), F.lit(" ,C"), (F.col("c_custkey") % 5).cast("string"))
    return k.enroll_many(c.select(F.col("c_custkey").alias("id_alumno"), list_of.alias("cursos")), 101, "2024-03-01").withColumn("fecha_inscripcion", F.col("fecha_inscripcion").cast("string"))


_NEXT = "SELECT 'S' || CASE WHEN max(s_suppkey) + 1 < 10 THEN '0' ELSE '' END || CAST(max(s_suppkey) + 1 AS VARCHAR) AS next_id FROM supplier"


@query(_NEXT)
def next_id(spark, sf_dir):
    return k.next_id(table(spark, sf_dir, "supplier"), "s_suppkey", "S")


@query(_NEXT)
def next_id_all(spark, sf_dir):
    return next_id(spark, sf_dir)


@query("SELECT CASE WHEN count(*) + 1 < 10 THEN '0' ELSE '' END || CAST(count(*) + 1 AS VARCHAR) AS next_id FROM supplier")
def next_id_by_count(spark, sf_dir):
    return k.next_id(table(spark, sf_dir, "supplier"), "s_suppkey", by_count=True)


@query("SELECT n_name, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0")
def membership(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    bridge = s.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    bridge = k.delete_by_key(bridge, s.where("s_acctbal <= 0"), "s_suppkey")
    return bridge.join(s.select("s_suppkey", "s_name"), "s_suppkey").join(table(spark, sf_dir, "nation"), "n_nationkey").select("n_name", "s_name")


@query("""SELECT 'customer' AS kind, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
    UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey <> 1""")
def cascade_delete(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    left, children = k.cascade_delete(nations, table(spark, sf_dir, "customer"), nations.where("n_regionkey = 1"), "n_nationkey", "c_nationkey")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(children, "customer").union(count(left, "nation"))


@query("SELECT p_brand, p_type, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2, 3")
def composite_dedup(spark, sf_dir):
    return k.distinct_by_key(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], ["p_partkey"]).select("p_brand", "p_type", "p_size", "p_partkey")


@query("SELECT r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def parts_of_whole(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    r = table(spark, sf_dir, "region")
    return r.join(n, r["r_regionkey"] == n["n_regionkey"], "left").select("r_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def owner_pairs(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_name", "n_name")
