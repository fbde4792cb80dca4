"""Column jobs on text, dates and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import columns as c
from textmill.functions.text import fix_mojibake, slug
from textmill.operators.stats import login_attempts as attempts
from textmill.queries.register import registry
from textmill.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()


@query("""SELECT p_brand, round(avg(length(p_name)), 4) AS mean_length, round(avg(len(string_split(p_name, ' '))), 4) AS mean_words, sum(length(p_name) - length(replace(p_name, 'a', ''))) AS letters_a,
    count(*) FILTER (length(p_name) > 5) AS over_5, count(*) FILTER (length(p_name) > 10) AS over_10 FROM part GROUP BY 1""")
def text_profile(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.round(F.avg(F.length("p_name")), 4).alias("mean_length"),
        F.round(F.avg(c.n_words("p_name")), 4).alias("mean_words"),
        F.sum(c.occurrences("p_name", "a")).alias("letters_a"),
        F.count_if(F.length("p_name") > 5).alias("over_5"),
        F.count_if(F.length("p_name") > 10).alias("over_10"),
    )


@query("""SELECT p_partkey, reverse(p_name) AS backwards, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS swapped,
    CASE WHEN length(p_name) > 10 THEN upper(p_name) ELSE lower(p_name) END AS sized, replace(p_name, substr(p_name, 1, 1), '*') AS starred FROM part""")
def text_variants(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.reverse(n).alias("backwards"),
        c.swap_case(n).alias("swapped"),
        F.when(F.length(n) > 10, F.upper(n)).otherwise(F.lower(n)).alias("sized"),
        F.replace(n, F.substring(n, 1, 1), F.lit("*")).alias("starred"),
    )


@query("""SELECT lang, count(*) FILTER (contains(text, 'the')) AS has_the, count(*) FILTER (starts_with(text, 'The')) AS starts_the, count(*) FILTER (lower(source) = reverse(lower(source))) AS palindromes, count(*) AS n FROM documents GROUP BY 1""")
def text_matches(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count_if(F.col("text").contains("the")).alias("has_the"),
        F.count_if(F.col("text").startswith("The")).alias("starts_the"),
        F.count_if(c.is_palindrome("source")).alias("palindromes"),
        F.count("*").alias("n"),
    )


@query("""SELECT c_mktsegment, count(*) FILTER (length(c_name) >= 8 AND regexp_matches(c_name, '[A-Z]') AND regexp_matches(c_name, '[0-9]')) AS passwords, count(*) FILTER (NOT regexp_matches(substr(c_name, 10), '^[0-9]+$')) AS names FROM customer GROUP BY 1""")
def value_audit(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count_if(c.valid_password("c_name")).alias("passwords"), F.count_if(c.valid_name(F.expr("substr(c_name, 10)"))).alias("names"))


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, count(*) AS tries, bool_or(event_type = 'click') AS entered FROM r WHERE n <= 3 GROUP BY 1""")
def login_attempts(spark, sf_dir):
    return attempts(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click")


@query("""SELECT o_orderpriority, count(*) AS n, count(try_strptime(lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '/' || (2000 + o_orderkey % 25), '%d/%m/%Y')) AS valid FROM orders GROUP BY 1""")
def date_audit(spark, sf_dir):
    k = F.col("o_orderkey")
    s = F.concat_ws("/", (k % 31 + 1).cast("string"), (k % 12 + 1).cast("string"), (k % 25 + 2000).cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count(c.day_of(s)).alias("valid"))


@query(f"""SELECT o_orderkey, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap, day(last_day(o_orderdate)) AS days,
    [{', '.join(repr(m) for m in c.MONTHS)}][month(o_orderdate)] AS month, dayofyear(o_orderdate) AS day_number FROM orders""")
def calendar_columns(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", c.is_leap(F.year(d)).alias("leap"), F.day(F.last_day(d)).alias("days"), c.month_name(d).alias("month"), F.dayofyear(d).alias("day_number"))


@query("""SELECT event_id, (event_id * 37) // 3600 AS h, (event_id * 37) % 3600 // 60 AS m, event_id * 37 % 60 AS s, event_id * 37 AS back, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events""")
def duration_columns(spark, sf_dir):
    t = c.hms(F.col("event_id") * 37)
    out = table(spark, sf_dir, "events").select("event_id", "ts", t.alias("t"))
    return out.select("event_id", "t.h", "t.m", "t.s", c.seconds("t.h", "t.m", "t.s").alias("back"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("""SELECT CASE WHEN s_acctbal > 0 THEN 'positivo' WHEN s_acctbal < 0 THEN 'negativo' ELSE 'cero' END AS sign, CASE WHEN s_suppkey % 30 < 12 THEN 'infantil' WHEN s_suppkey % 30 <= 18 THEN 'joven' ELSE 'adulto' END AS age, s_suppkey % 2 = 0 AS even, count(*) AS n FROM supplier GROUP BY ALL""")
def band_counts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.groupBy(c.sign_band("s_acctbal").alias("sign"), c.age_band(F.col("s_suppkey") % 30).alias("age"), (F.col("s_suppkey") % 2 == 0).alias("even")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, value + k AS plus, value - k AS minus, value * k AS times, CASE WHEN k <> 0 THEN value / k END AS over, CASE WHEN k = 0 OR event_id = 0 THEN false ELSE event_id % nullif(k, 0) = 0 OR k % nullif(event_id, 0) = 0 END AS divides FROM (SELECT *, event_id % 7 AS k FROM events)""")
def safe_arithmetic(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 7)
    v, k = F.col("value"), F.col("k")
    return e.select("event_id", (v + k).alias("plus"), (v - k).alias("minus"), (v * k).alias("times"), F.try_divide(v, k).alias("over"), c.divides("event_id", "k").alias("divides"))


@query("""SELECT l_returnflag, count(*) FILTER (l_quantity BETWEEN 0 AND 10) AS grades, count(*) FILTER (NOT l_quantity BETWEEN 0 AND 10) AS rejected, count(*) FILTER (l_discount >= 0 AND l_tax >= 0.01) AS prices FROM lineitem GROUP BY 1""")
def range_rejects(spark, sf_dir):
    grade = F.col("l_quantity").between(0, 10)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(grade).alias("grades"), F.count_if(~grade).alias("rejected"), F.count_if((F.col("l_discount") >= 0) & (F.col("l_tax") >= 0.01)).alias("prices"))


@query("""SELECT age, count(*) AS n FROM (SELECT CASE WHEN try_cast(x AS INT) IS NULL OR try_cast(x AS INT) < 0 THEN 18 ELSE try_cast(x AS INT) END AS age FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'x' || event_id WHEN event_id % 5 = 1 THEN '-3' ELSE CAST(event_id % 90 AS VARCHAR) END AS x FROM events)) GROUP BY 1""")
def cast_or_default(spark, sf_dir):
    i = F.col("event_id")
    x = F.when(i % 5 == 0, F.concat(F.lit("x"), i.cast("string"))).when(i % 5 == 1, "-3").otherwise((i % 90).cast("string"))
    return table(spark, sf_dir, "events").groupBy(c.age_or_default(x).alias("age")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, text FROM documents")
def mojibake_repair(spark, sf_dir):
    """Text whose accented letters were misread comes back as it was."""
    from textmill.functions.text import MOJIBAKE

    broken = F.col("text")
    for wrong, right in sorted(MOJIBAKE, key=lambda p: -len(p[0])):  # marks that stand in the other forms first
        broken = F.replace(broken, F.lit(right), F.lit(wrong))
    return table(spark, sf_dir, "documents").select("doc_id", fix_mojibake(broken).alias("text"))


@query("""SELECT doc_id, CASE WHEN s = '' THEN 'documento' ELSE s END AS name FROM (SELECT doc_id, regexp_replace(substr(replace(replace(regexp_replace(regexp_replace(strip_accents(replace(source, 'src', 'Ñandú é-')), '[^\\x00-\\x7F]', '', 'g'), '[\\x09-\\x0D\\x20-]+', '_', 'g'), '.', ''), ',', ''), 1, 150), '^_+|_+$', '', 'g') AS s FROM documents)""")
def file_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", slug(F.replace("source", F.lit("src"), F.lit("Ñandú é-"))).alias("name"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM part""")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", c.title_case("p_name").alias("title"))


@query("""SELECT CASE WHEN s_acctbal > 10 THEN 'mayor' WHEN s_acctbal < 0 THEN 'menor' ELSE '0-10' END AS band, count(*) AS n FROM supplier GROUP BY 1""")
def range_bands(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(c.range_band("s_acctbal").alias("band")).agg(F.count("*").alias("n"))
