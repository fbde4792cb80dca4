"""Queries on the event log: parsing, sessions, scoreboard, replay and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.operators import events as e
from textmill.queries.register import registry
from textmill.sources.tables import scratch_dir, table
from textmill.streaming import monitor as m

QUERIES, ORACLE_SQL, query = registry()

_LOG_SQL = """log AS (SELECT event_id, ts, CASE event_id % 3
    WHEN 0 THEN 'Partida iniciada: Dificultad: ' || ['EASY', 'HARD'][1 + event_id % 2] || ', Modo barcos: NORMAL, Rivales: ' || (1 + event_id % 3)
    WHEN 1 THEN 'Jugador: Disparo a Rival 1 en (' || event_id % 10 || ', ' || user_id % 10 || ') - ' || ['Agua', 'Tocado', 'Hundido'][1 + user_id % 3]
    ELSE 'Fin de partida: Ganador: ' || ['Jugador', 'IA'][1 + user_id % 2] || ', Puntuación Jugador: ' || user_id % 40 || ', Puntuación IA: ' || event_id % 40 END AS message FROM events)"""


def _log(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    start = F.concat(F.lit("Partida iniciada: Dificultad: "), pick(["EASY", "HARD"], i % 2), F.lit(", Modo barcos: NORMAL, Rivales: "), (1 + i % 3).cast("string"))
    shot = F.format_string("Jugador: Disparo a Rival 1 en (%d, %d) - %s", i % 10, u % 10, pick(["Agua", "Tocado", "Hundido"], u % 3))
    end = F.format_string("Fin de partida: Ganador: %s, Puntuación Jugador: %d, Puntuación IA: %d", pick(["Jugador", "IA"], u % 2), u % 40, i % 40)
    return table(spark, sf_dir, "events").select("event_id", "ts", F.when(i % 3 == 0, start).when(i % 3 == 1, shot).otherwise(end).alias("message"))


@query("""SELECT event_id, ['start', 'shot', 'end'][1 + event_id % 3] AS kind, CASE event_id % 3 WHEN 0 THEN ['EASY', 'HARD'][1 + event_id % 2] END AS difficulty,
    CASE event_id % 3 WHEN 1 THEN CAST(event_id % 10 AS INT) END AS row, CASE event_id % 3 WHEN 1 THEN ['Agua', 'Tocado', 'Hundido'][1 + user_id % 3] END AS result,
    CASE event_id % 3 WHEN 2 THEN ['Jugador', 'IA'][1 + user_id % 2] END AS winner, CASE event_id % 3 WHEN 2 THEN CAST(user_id % 40 AS INT) END AS player_score FROM events""")
def parsed_log(spark, sf_dir):
    return e.parse_log(_log(spark, sf_dir)).select("event_id", "kind", "difficulty", "row", "result", "winner", "player_score")


@query(f"""WITH {_LOG_SQL}, s AS (SELECT *, sum(CASE WHEN starts_with(message, 'Partida') THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS game FROM log)
    SELECT game, count(*) FILTER (contains(message, 'Disparo')) AS shots, count(*) FILTER (starts_with(message, 'Fin')) AS ends FROM s GROUP BY 1""")
def sessions(spark, sf_dir):
    """One log, so one source; windows run by source."""
    log = e.parse_log(_log(spark, sf_dir)).withColumn("source", F.lit("log"))
    s = e.sessionize(log, "source", ["ts", "event_id"], F.col("kind") == "start")
    return s.groupBy("game").agg(F.count_if(F.col("kind") == "shot").alias("shots"), F.count_if(F.col("kind") == "end").alias("ends"))


_SCORES = "SELECT event_type AS mode, user_id % 3 + 1 AS rivals, count(*) FILTER (value >= 50) AS player_wins, count(*) FILTER (value < 50) AS ai_wins, sum(CAST(value AS BIGINT)) AS player_score, sum(user_id) AS ai_score FROM events GROUP BY 1, 2"


def _scores(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), (F.col("user_id") % 3 + 1).alias("rivals"), "value", F.rint("value").cast("long").alias("points"), "user_id")
    return e.scoreboard(ev, ["mode", "rivals"], F.col("value") >= 50, "points", "user_id")


@query(_SCORES)
def scoreboard(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(f"""WITH s AS ({_SCORES}) SELECT m.mode, r.rivals, coalesce(player_wins, 0) AS player_wins, coalesce(ai_wins, 0) AS ai_wins, coalesce(player_score, 0) AS player_score, coalesce(ai_score, 0) AS ai_score
    FROM (SELECT DISTINCT event_type AS mode FROM events) m CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS rivals) r LEFT JOIN s ON s.mode = m.mode AND s.rivals = r.rivals""")
def scoreboard_full(spark, sf_dir):
    modes = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"))
    rivals = spark.range(1, 5).select(F.col("id").alias("rivals"))
    return e.fill_defaults(_scores(spark, sf_dir), {"mode": modes, "rivals": rivals})


_CELLS = """cells AS (SELECT DISTINCT l_orderkey % 50 AS board, l_linenumber AS row, l_partkey % 10 AS col, l_suppkey % 4 AS ship FROM lineitem WHERE l_suppkey % 4 = (l_linenumber + l_partkey) % 4),
    shots AS (SELECT l_orderkey % 50 AS board, l_linenumber AS row, l_partkey % 10 AS col, l_shipdate AS ts, l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY board, row, col ORDER BY ts, o, p, s) AS n FROM shots),
    len AS (SELECT board, ship, count(*) AS length FROM cells GROUP BY 1, 2),
    hit AS (SELECT r.board, c.ship, l.length, count(*) OVER (PARTITION BY r.board, c.ship ORDER BY ts, o, p, s, r.row, r.col ROWS UNBOUNDED PRECEDING) AS hits FROM ranked r JOIN cells c USING (board, row, col) JOIN len l ON l.board = c.board AND l.ship = c.ship WHERE n = 1)"""


def _battle(spark, sf_dir):
    """Every line item is a shot; cells where supplier and place agree belong to a ship, the others are water."""
    li = table(spark, sf_dir, "lineitem")
    at = [(F.col("l_orderkey") % 50).alias("board"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 10).alias("col")]
    ship = F.col("l_suppkey") % 4
    cells = li.where(ship == (F.col("l_linenumber") + F.col("l_partkey")) % 4).select(*at, ship.alias("ship")).distinct()
    shots = li.select(*at, F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return shots, cells


@query(f"WITH {_CELLS} SELECT board, ship, length AS points FROM hit WHERE hits = length")
def replay_sunk(spark, sf_dir):
    shots, cells = _battle(spark, sf_dir)
    return e.replay_hits(shots, cells, ["ts", "o", "p", "s", "row", "col"]).where("is_sunk").select("board", "ship", "points")


@query(f"WITH {_CELLS} SELECT board, count(*) AS shots, count(*) FILTER (n > 1) AS again FROM ranked GROUP BY 1")
def repeat_events(spark, sf_dir):
    shots, _ = _battle(spark, sf_dir)
    return e.repeated(shots, ["board", "row", "col"], ["ts", "o", "p", "s"]).groupBy("board").agg(F.count("*").alias("shots"), F.count_if("again").alias("again"))


@query(f"WITH {_CELLS}, top AS (SELECT board, ship, max(hits) = max(length) AS is_sunk FROM hit GROUP BY 1, 2) SELECT board, bool_and(is_sunk) AS all_sunk, string_agg(CASE WHEN is_sunk THEN 'HUNDIDO' ELSE 'VIVO' END, ',' ORDER BY ship) AS ships FROM top GROUP BY 1")
def all_sunk(spark, sf_dir):
    shots, cells = _battle(spark, sf_dir)
    hits = e.replay_hits(shots, cells, ["ts", "o", "p", "s", "row", "col"])
    ships = hits.groupBy("board", "ship").agg(F.bool_or("is_sunk").alias("is_sunk"))
    status = F.array_sort(F.collect_list(F.struct("ship", e.ship_status("is_sunk").alias("s"))))
    names = ships.groupBy("board").agg(F.array_join(F.transform(status, lambda x: x["s"]), ",").alias("ships"))
    return e.all_sunk(ships).join(names, "board")


@query("SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 3 ELSE 0 END) AS player_score, sum(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) AS ai_score FROM events GROUP BY 1")
def game_scores(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    shots = ev.select(F.col("user_id").alias("game"), F.when(kind == "purchase", "Jugador").otherwise("IA 1").alias("actor"), F.when(kind == "error", "Jugador").otherwise("Rival 1").alias("target"), F.when(kind == "purchase", 3).when(kind == "error", 2).otherwise(0).alias("points"))
    return e.game_scores(shots).withColumnRenamed("game", "user_id")


@query("""WITH w AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s, user_id, event_id FROM events WHERE event_type <> 'click'),
    x AS (SELECT unnest(range(s // 3600 * 3600 - 10800, s // 3600 * 3600 + 3600, 3600)) AS a, s, user_id, event_id FROM w)
    SELECT make_timestamp(a * 1000000) AS start, user_id AS sender, count(*) AS n FROM x WHERE s >= a AND s < a + 14400 GROUP BY 1, 2""")
def monitor_window(spark, sf_dir):
    """The inbox monitor over four hours, sliding by one."""
    mail = table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("sender"), F.col("event_id").cast("string").alias("subject"), (F.col("event_type") == "click").alias("deleted"))
    return m.inbox_monitor(mail, "4 hours", "1 hour").select(F.col("window.start").alias("start"), "sender", "n")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, ts, event_id, event_type FROM r WHERE n = 1")
def latest_per_user(spark, sf_dir):
    return m.latest_from(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["ts", "event_id", "event_type"])


@query("""WITH c AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS s, count(*) AS n FROM events GROUP BY 1), k AS (SELECT unnest(range((SELECT min(s) FROM c), (SELECT max(s) FROM c) + 60, 60)) AS s)
    SELECT make_timestamp(k.s * 1000000) AS start, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'SIN_NOVEDADES' ELSE 'NOVEDADES' END AS state FROM k LEFT JOIN c USING (s)""")
def quiet_intervals(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.date_trunc("second", "ts").alias("ts"))
    return m.quiet_intervals(ev, "ts", "1 minute", 60)


@query("SELECT event_type, user_id % 3 AS rivals, count(*) AS n FROM events GROUP BY 1, 2")
def log_tail(spark, sf_dir):
    """The running count over CSV logs as they come, read to their end. Each micro-batch writes the counts that it
    changed; half of the events come again in the second file's batch, so counts are updated."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("rivals"))
    path, out = scratch_dir(spark, "logs"), scratch_dir(spark, "counts")
    for k in (0, 1):  # two files arrive
        ev.where(F.coalesce(F.pmod("event_id", F.lit(2)), F.lit(0)) == k).drop("event_id").coalesce(1).write.mode("append").option("header", True).csv(path)
    counts = m.log_tail(spark, path, "event_type string, rivals long", ["event_type", "rivals"])
    keys = ["event_type", "rivals"]
    m.tail_counts(counts, keys, out, scratch_dir(spark, "tail"), {"availableNow": True}).awaitTermination()
    return m.read_counts(spark, out, counts.schema, keys)


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'Agua' WHEN value >= 50 THEN 'Hundido' ELSE 'Tocado' END AS result FROM events""")
def shot_results(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", e.shot_result(F.col("event_type") != "error", F.when(F.col("value") >= 50, 3).otherwise(0)).alias("result"))


@query("""WITH s AS (SELECT ['EASY', 'NORMAL', 'HARD', 'VERY HARD'][CAST(1 + user_id % 4 AS INT)] AS difficulty, count(*) FILTER (value >= 50) AS player_wins, count(*) FILTER (value < 50) AS ai_wins, sum(user_id) AS player_score, sum(event_id) AS ai_score
        FROM events WHERE event_type = 'click' AND user_id % 3 = 1 GROUP BY 1)
    SELECT upper(substr(difficulty, 1, 1)) || lower(substr(difficulty, 2)) AS label, player_wins, ai_wins, player_score, ai_score FROM s""")
def scoreboard_view(spark, sf_dir):
    """One mode and number of rivals of the scoreboard; the view's filter is the operator's own."""
    u = F.col("user_id")
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("mode"), (u % 3).cast("string").alias("rivals"), F.element_at(F.array(*map(F.lit, e.DIFFICULTIES)), (1 + u % 4).cast("int")).alias("difficulty"), "value", "user_id", "event_id"
    )
    scores = e.scoreboard(ev, ["mode", "rivals", "difficulty"], F.col("value") >= 50, "user_id", "event_id")
    return e.scoreboard_view(scores, "click", "1")
