"""Aggregation, ranking and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.operators import stats as s
from textmill.operators.order import numbered
from textmill.operators.order import reverse_order as by_reverse
from textmill.queries.register import registry
from textmill.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
_SALES = "sales AS (SELECT l_partkey % 20 AS item, l_suppkey % 5 AS branch, round(l_quantity * l_extendedprice, 2) AS amount FROM lineitem)"


def _sales(spark, sf_dir):
    """Articles and branches: parts and suppliers folded to 20 and 5."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("item"), (F.col("l_suppkey") % 5).alias("branch"), F.round(F.col("l_quantity") * F.col("l_extendedprice"), 2).alias("amount"))


@query(f"WITH {_SALES} SELECT item, branch, round(sum(amount), 0) AS total FROM sales GROUP BY CUBE (item, branch)")
def sales_cube(spark, sf_dir):
    return s.cube_total(_sales(spark, sf_dir), ["item", "branch"], F.col("amount")).withColumn("total", F.round("total", 0))


@query(f"WITH {_SALES} SELECT branch, round(sum(amount), 0) AS total, round(sum(amount) FILTER (item = 3), 0) AS article_3 FROM sales GROUP BY 1")
def sales_by_branch(spark, sf_dir):
    return _sales(spark, sf_dir).groupBy("branch").agg(F.round(F.sum("amount"), 0).alias("total"), F.round(F.sum(F.when(F.col("item") == 3, F.col("amount"))), 0).alias("article_3"))


@query(f"WITH {_SALES} SELECT branch, round(sum(amount), 0) AS total FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def top_branch(spark, sf_dir):
    return s.top_one(_sales(spark, sf_dir).groupBy("branch").agg(F.round(F.sum("amount"), 0).alias("total")), "total", "branch")


@query("""SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, max(c_acctbal) AS maximum, min(c_acctbal) AS minimum, count(*) FILTER (c_acctbal > 5000) AS above FROM customer GROUP BY 1""")
def column_profile(spark, sf_dir):
    out = s.column_profile(table(spark, sf_dir, "customer"), "c_acctbal", 5000, ["c_mktsegment"])
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query("SELECT c_custkey, round(avg(o_totalprice), 4) AS mean, CASE WHEN avg(o_totalprice) IS NULL THEN 'sin notas' END AS note FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def group_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return s.group_mean(table(spark, sf_dir, "customer"), rows, "c_custkey", "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def max_ties(spark, sf_dir):
    return s.extremes(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size")


@query("SELECT p_brand, p_partkey, p_size FROM part WHERE (p_brand, p_size) IN (SELECT (p_brand, min(p_size)) FROM part GROUP BY p_brand)")
def min_ties(spark, sf_dir):
    return s.extremes(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_size", ["p_brand"], largest=False)


@query("""WITH p AS (SELECT c_nationkey, lag(c_acctbal) OVER w AS low, c_acctbal AS high FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)),
    r AS (SELECT *, round(high - low, 6) AS gap, row_number() OVER (PARTITION BY c_nationkey ORDER BY high - low, low, high) AS n FROM p WHERE low IS NOT NULL) SELECT c_nationkey, low, high, gap FROM r WHERE n = 1""")
def closest_pair(spark, sf_dir):
    return s.closest_pair(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal").withColumn("gap", F.round("gap", 6))


@query("SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS letter FROM documents) WHERE letter <> '' GROUP BY 1")
def char_count(spark, sf_dir):
    return s.char_count(table(spark, sf_dir, "documents"), "text")


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \n]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_count(spark, sf_dir):
    return s.word_count(table(spark, sf_dir, "documents"))


@query("SELECT value, count(*) AS n FROM (SELECT unnest([l_returnflag, l_linestatus]) AS value FROM lineitem) GROUP BY 1")
def pair_counts(spark, sf_dir):
    return s.pair_value_count(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT l_partkey, count(*) AS n, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS positions FROM lineitem WHERE l_quantity = 7 GROUP BY 1")
def value_positions(spark, sf_dir):
    out = s.value_positions(table(spark, sf_dir, "lineitem"), F.col("l_quantity") == 7, "l_partkey", "l_linenumber")
    return out.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    w AS (SELECT doc_id, line_no, generate_subscripts(x, 1) - 1 AS word_no, unnest(x) AS word FROM (SELECT doc_id, line_no, string_split(line, ' ') AS x FROM l)),
    f AS (SELECT doc_id, line_no, word_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, word_no) AS n FROM w WHERE word = 'the')
    SELECT doc_id, coalesce(f.line_no, -1) AS line_no, coalesce(f.word_no, -1) AS word_no FROM documents LEFT JOIN f USING (doc_id) WHERE coalesce(n, 1) = 1""")
def first_position(spark, sf_dir):
    return s.first_position(table(spark, sf_dir, "documents"), "doc_id", "text", "the")


@query("SELECT l_returnflag, sum(l_quantity) FILTER (l_linenumber = 1) AS line_1, sum(l_quantity) FILTER (l_linenumber = 2) AS line_2, sum(l_quantity) FILTER (l_linenumber = 3) AS line_3 FROM lineitem GROUP BY 1")
def transpose(spark, sf_dir):
    out = s.transpose(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity", [1, 2, 3])
    return out.select("l_returnflag", *(F.col(str(i)).alias(f"line_{i}") for i in (1, 2, 3)))


@query("SELECT l_returnflag, l_linenumber, sum(l_quantity) AS total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber))")
def margins(spark, sf_dir):
    return s.sums_over(table(spark, sf_dir, "lineitem"), [["l_returnflag"], ["l_linenumber"]], "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_partkey % 3 = 0 THEN coalesce(p_retailprice, 0.0) ELSE 0.0 END AS p_retailprice FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def price_lookup(spark, sf_dir):
    prices = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return s.price_lookup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), prices, "l_partkey", "p_retailprice", 0.0)


@query("""WITH m AS (SELECT CASE WHEN l_quantity > l_discount * 500 THEN '1' WHEN l_quantity < l_discount * 500 THEN '2' ELSE 'X' END AS result FROM lineitem) SELECT result, count(*) AS n FROM m GROUP BY 1""")
def match_result(spark, sf_dir):
    goals = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_discount") * 500).alias("away"))
    return s.value_counts(goals.select(s.match_result("l_quantity", "away").alias("result")), "result")


@query("SELECT s_nationkey, string_agg(s_name, ' ' ORDER BY s_suppkey) AS joined FROM supplier GROUP BY 1")
def concat_group(spark, sf_dir):
    return s.concat_group(table(spark, sf_dir, "supplier"), "s_nationkey", "s_name", "s_suppkey")


@query("SELECT c_custkey AS k, c_acctbal + s_acctbal AS v FROM customer JOIN supplier ON s_suppkey = c_custkey")
def series_add(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return s.series_add(a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), "k", "v")


@query("SELECT user_id, date_trunc('week', ts) AS week, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def weekly_total(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("week", "ts").alias("week")).agg(F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, bool_or(event_type = 'error') AS any_hit, array_to_string(list(DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) ORDER BY CAST(CAST(ts AS DATE) AS VARCHAR)) FILTER (value > 99), ',') AS days FROM events GROUP BY 1")
def matching_days(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    days = F.array_sort(F.collect_set(F.when(F.col("value") > 99, F.to_date("ts").cast("string"))))
    return e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("any_hit"), F.nullif(F.array_join(days, ","), F.lit("")).alias("days"))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, (max(value) + min(value)) / 2 AS middle FROM events GROUP BY 1""")
def pairwise_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(((F.max("value") + F.min("value")) / 2).alias("middle"))


@query("SELECT DISTINCT p_type FROM part WHERE length(p_type) > 5")
def long_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type").where(F.length("p_type") > 5).distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_search(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END AS status FROM orders WHERE o_orderpriority <> '1-URGENT'")
def replace_remove(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "closed").otherwise(F.col("o_orderstatus")).alias("status"))


_MOVES = "moves AS (SELECT event_id, ts, user_id, CAST(floor(value * 100) AS BIGINT) * CASE WHEN event_id % 3 = 0 THEN -2 ELSE 1 END AS amount FROM events)"


def _moves(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", (F.floor(F.col("value") * 100).cast("long") * F.when(F.col("event_id") % 3 == 0, -2).otherwise(1)).alias("amount"))


@query(f"WITH {_MOVES} SELECT event_id, user_id, amount, CAST(100 + sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM moves WHERE amount <> 0")
def ledger(spark, sf_dir):
    out = s.ledger_balance(_moves(spark, sf_dir), "user_id", ["ts", "event_id"], "amount", 100.0)
    return out.select("event_id", "user_id", "amount", "balance")


@query(f"""WITH RECURSIVE {_MOVES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM moves),
    walk AS (SELECT user_id, i, event_id, amount, amount > 0 AS accepted, CASE WHEN amount > 0 THEN amount ELSE 0.0 END AS balance FROM n WHERE i = 1
        UNION ALL SELECT n.user_id, n.i, n.event_id, n.amount, n.amount > 0 OR (n.amount < 0 AND -n.amount <= w.balance), w.balance + CASE WHEN n.amount > 0 OR (n.amount < 0 AND -n.amount <= w.balance) THEN n.amount ELSE 0 END
        FROM walk w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
    SELECT user_id, event_id, amount, accepted, CAST(balance AS DOUBLE) AS balance FROM walk""")
def ledger_guarded(spark, sf_dir):
    out = s.ledger_guarded(_moves(spark, sf_dir), "user_id", ["ts", "event_id"], "amount")
    return out.select("user_id", "event_id", "amount", "accepted", "balance")


@query(f"""WITH {_MOVES}, r AS (SELECT *, sum(amount) OVER w AS s FROM moves WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, user_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS total FROM r""")
def floored_total(spark, sf_dir):
    out = s.floored_total(_moves(spark, sf_dir), "user_id", ["ts", "event_id"], "amount")
    return out.select("event_id", "user_id", "total")


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS before, round(sum(c_acctbal * CASE c_mktsegment WHEN 'BUILDING' THEN 1.1 WHEN 'MACHINERY' THEN 1.05 ELSE 1 END), 2) AS after FROM customer GROUP BY 1""")
def role_uplift(spark, sf_dir):
    rates = spark.sql("SELECT * FROM VALUES ('BUILDING', 1.1D), ('MACHINERY', 1.05D) AS r(c_mktsegment, rate)")
    out = s.role_uplift(table(spark, sf_dir, "customer"), rates, "c_mktsegment", "c_acctbal")
    return out.select("c_mktsegment", "n", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"))


@query("""SELECT count(*) FILTER (a BETWEEN 18 AND 24) AS young, count(*) FILTER (a >= 18) AS adults, count(*) AS n FROM (SELECT p_size + 10 AS a FROM part)""")
def adults(spark, sf_dir):
    age = table(spark, sf_dir, "part").select((F.col("p_size") + 10).alias("a"))
    return age.agg(F.count_if(F.col("a").between(18, 24)).alias("young"), F.count_if(F.col("a") >= 18).alias("adults"), F.count("*").alias("n"))


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS number FROM part")
def sort_rows(spark, sf_dir):
    """Parts in ascending order of their price, each with its place."""
    return numbered(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), ["p_retailprice", "p_partkey"]).drop("p_retailprice")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_id DESC) AS place FROM events")
def reverse_order(spark, sf_dir):
    """The events from the last to the first."""
    return by_reverse(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


@query("""SELECT event_id, user_id, amount, age, amount >= 0 OR coalesce(age >= 18 AND age < 25, false) AS eligible FROM
    (SELECT event_id, user_id, CAST(floor(value * 100) AS BIGINT) * CASE WHEN event_id % 3 = 0 THEN -2 ELSE 1 END AS amount FROM events) LEFT JOIN (SELECT c_custkey AS user_id, c_custkey % 40 AS age FROM customer) USING (user_id)""")
def eligible_withdrawal(spark, sf_dir):
    """Customers hold the accounts; their key gives an age below 40."""
    holders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 40).alias("age"))
    return s.eligible_withdrawal(_moves(spark, sf_dir).drop("ts"), holders, "user_id", "amount", "age")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= l_discount * 500 THEN (l_quantity + l_discount * 500) / 2 END AS middle, l_quantity >= l_discount * 500 AS valid FROM lineitem")
def pairwise_mean_valid(spark, sf_dir):
    """Quantity as the day's maximum, the scaled discount as its minimum."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", s.pairwise_mean(F.col("l_discount") * 500, F.col("l_quantity")).alias("p")).select("l_orderkey", "l_linenumber", "p.middle", "p.valid")


@query(f"""WITH {_MOVES}, r AS (SELECT *, sum(amount) OVER w AS s FROM moves WHERE abs(amount) <= 200 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, user_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS total FROM r""")
def floored_total_in_range(spark, sf_dir):
    """Moves above 200 are rejected first."""
    out = s.floored_total(_moves(spark, sf_dir), "user_id", ["ts", "event_id"], "amount", most=200)
    return out.select("event_id", "user_id", "total")
