"""Action log and scoreboard: parsing, sessions, scores and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import col
from textmill.operators.order import running_sum

#: The dimensions of the scoreboard, in their order.
MODES = ("NORMAL", "RUSO")
RIVALS = ("1", "2", "3")
DIFFICULTIES = ("EASY", "NORMAL", "HARD", "VERY HARD")
COUNTS = ("player_wins", "ai_wins", "player_score", "ai_score")
START = r"^Partida iniciada: Dificultad: ([A-Z ]+), Modo barcos: ([A-Z]+), Rivales: (\d+)"
SHOT = r"^(.+?): Disparo a (.+?) en \((\d+), (\d+)\) - (Agua|Tocado|Hundido)"
END = r"^Fin de partida: Ganador: (.+?), Puntuación Jugador: (\d+), Puntuación IA: (\d+)"


def parse_log(log: DataFrame, message: str = "message") -> DataFrame:
    """Adds kind (start, shot, end; else null) and the fields of each shape; others are null."""
    m = F.col(message)
    kind = F.when(m.rlike(START), "start").when(m.rlike(SHOT), "shot").when(m.rlike(END), "end")
    part = lambda k, pattern, i: F.when(F.col("kind") == k, F.regexp_extract(m, pattern, i))
    number = lambda c: c.cast("int")
    return log.withColumn("kind", kind).withColumns(
        {
            "difficulty": part("start", START, 1),
            "mode": part("start", START, 2),
            "rivals": part("start", START, 3),
            "actor": part("shot", SHOT, 1),
            "target": part("shot", SHOT, 2),
            "row": number(part("shot", SHOT, 3)),
            "col": number(part("shot", SHOT, 4)),
            "result": part("shot", SHOT, 5),
            "winner": part("end", END, 1),
            "player_score": number(part("end", END, 2)),
            "ai_score": number(part("end", END, 3)),
        }
    )


def shot_result(hit: str | Column, points: str | Column) -> Column:
    return F.when(~col(hit), "Agua").when(col(points) > 0, "Hundido").otherwise("Tocado")


def sessionize(events: DataFrame, source: str, order: list[str], starts: Column) -> DataFrame:
    """Adds game: the number of start records so far, within a source. Events before the first start are game 0.
    One log may be of any length: it is summed in ranges."""
    return running_sum(events, order, F.coalesce(starts, F.lit(False)).cast("long"), "game", (source,))


def scoreboard(games: DataFrame, keys: list[str], player_won: Column, player: str, ai: str) -> DataFrame:
    return games.groupBy(*keys).agg(
        F.count_if(player_won).alias("player_wins"),
        F.count_if(~player_won).alias("ai_wins"),
        F.sum(player).alias("player_score"),
        F.sum(ai).alias("ai_score"),
    )


def fill_defaults(scores: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Every combination of the dimension values (a few each), zeros where there is no score."""
    grid = None
    for name, values in dims.items():
        one = values.select(name).distinct()
        grid = one if grid is None else grid.crossJoin(one)
    out = grid.join(scores, list(dims), "left")
    return out.select(*dims, *(F.coalesce(c, F.lit(0)).alias(c) for c in scores.columns if c not in dims))


def scoreboard_view(scores: DataFrame, mode: str, rivals: str, order: tuple[str, ...] = DIFFICULTIES) -> DataFrame:
    """The rows of one mode and number of rivals in the fixed order, labels with a capital."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("difficulty"))
    label = F.concat(F.upper(F.substring("difficulty", 1, 1)), F.lower(F.substring("difficulty", 2, 100)))
    return scores.where((F.col("mode") == mode) & (F.col("rivals") == rivals)).orderBy(place).select(label.alias("label"), *COUNTS)


def game_scores(shots: DataFrame) -> DataFrame:
    """(game, player_score, ai_score) of shots(game, actor, target, points): the machines score only on the player."""
    player = F.col("actor") == "Jugador"
    return shots.groupBy("game").agg(
        F.sum(F.when(player, F.col("points")).otherwise(0)).alias("player_score"),
        F.sum(F.when(~player & (F.col("target") == "Jugador"), F.col("points")).otherwise(0)).alias("ai_score"),
    )


def repeated(shots: DataFrame, cell: list[str], order: list) -> DataFrame:
    """Adds again: whether the cell was shot at before."""
    return shots.withColumn("again", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) > 1)


def replay_hits(shots: DataFrame, cells: DataFrame, order: list[str]) -> DataFrame:
    """Shots on ship cells: (…, ship, hits, length, is_sunk, points).

    shots(board, row, col, ...) meet cells(board, row, col, ship) by cell; the second shot at a cell
    is no hit. A ship is sunk by the hit that equals its length, and then gives its length in points.
    """
    length = cells.groupBy("board", "ship").agg(F.count("*").alias("length"))
    first = repeated(shots, ["board", "row", "col"], order).where("NOT again").drop("again")
    hits = first.join(cells.join(length, ["board", "ship"]), ["board", "row", "col"])
    so_far = Window.partitionBy("board", "ship").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hits.withColumn("hits", F.count("*").over(so_far)).withColumn("is_sunk", F.col("hits") == F.col("length"))
    return out.withColumn("points", F.when(F.col("is_sunk"), F.col("length")).otherwise(0))


def all_sunk(ships: DataFrame) -> DataFrame:
    return ships.groupBy("board").agg(F.bool_and("is_sunk").alias("all_sunk"))


def ship_status(sunk: str | Column) -> Column:
    return F.when(col(sunk), "HUNDIDO").otherwise("VIVO")
