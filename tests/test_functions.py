"""Small literal cases of the engine's functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from textmill.functions import columns as c
from textmill.functions import text as t
from textmill.operators import chunk, clean, events, html, keyed, retrieve, stats
from textmill.sources import tables as io
from textmill.streaming import monitor


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    ("line", "noise"),
    [("ab", True), ("", True), ("--- ===", True), ("* * *", True), ("PÁGINA 12", True), ("123", True), ("- 7 -", True), ("[ 3 ]", True),
     ("https://example.org/a", True), ("3/11/2024", True), ("Volver", True), ("[Imagen: x]", True), ("Aviso legal y más", True),
     ("Página 12 de 40", False), ("ver https://example.org", False), ("Volver al inicio", False)],
)
def test_noise(spark, line, noise):
    assert one(spark, t.is_noise(F.lit(line))) is noise


def test_repeated_headers_and_duplicates(spark):
    text = "boja header x\nalpha text one\nboja header x\nalpha text one \nalpha text one\nboja header x\nlast line here"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in clean.clean_parts(docs).collect()}
    assert got[1].clean == "alpha text one\nlast line here"
    assert (got[1].n_lines, got[1].n_noise, got[1].n_repeats) == (7, 3, 2)
    assert got[2].clean == "" and got[3].n_noise == 1
    kept = clean.clean_parts(docs, least=4).collect()[0]
    assert "boja" in kept.clean


def test_header_round_trip(spark):
    rule = "=" * 80
    text = f"{rule}\nCATEGORÍA: LEY\nTIPO: HTML\nTÍTULO: \nURL ORIGINAL: https://example.org/x\nTIPO: PDF\n{rule}\n\nbody\nmore"
    got = one(spark, clean.parse_header(F.lit(text)))
    assert got.metadata == {"CATEGORÍA": "LEY", "URL ORIGINAL": "https://example.org/x", "TIPO": "PDF"}
    assert got.body == "\nbody\nmore"
    assert one(spark, clean.parse_header(F.lit("plain"))).body == "plain"


def test_text_functions(spark):
    assert one(spark, t.strip(F.lit(" \t a b \n"))) == "a b"
    assert one(spark, t.squeeze(F.lit(" a   b \n\n\n\n c "))) == "a b\n\nc"
    assert one(spark, t.slug(F.lit("Guía: ñandú, año-2.pdf"))) == "Guia_nandu_ano_2pdf"
    assert one(spark, t.slug(F.lit("日本"))) == "documento"
    assert one(spark, t.fix_mojibake(F.lit("EspaÃ±a â€“ niÃ±o"))) == "España – niño"
    assert one(spark, t.nfc(F.lit("é"))) == "é"


def test_fixed_chunks(spark):
    docs = spark.createDataFrame([(1, ""), (2, "x" * 4000), (3, "x" * 10000), (4, None)], "doc_id long, text string")
    got = {}
    for r in chunk.fixed_chunks(docs).collect():
        got.setdefault(r.doc_id, []).append(len(r.chunk))
    assert got == {2: [4000, 400], 3: [4000, 4000, 2800]}


def test_semantic_chunks():
    text = "first sentence here. second sentence follows. third one is longer than others. tail"
    parts = chunk.semantic_split(text, 40, 8)
    assert all(len(p) <= 140 for p in parts) and parts[0].startswith("first") and parts[-1].endswith("tail")
    assert chunk.semantic_split("short", 40, 8) == ["short"]
    # every piece gets its separator back, so a text without one ends with the sentence separator's stop
    assert "".join(chunk.semantic_split("x" * 500, 40, 0)) == "x" * 500 + "."
    # paragraphs fit one by one; the next chunk starts behind the first blank of its predecessor's last 12 characters
    assert chunk.semantic_split("aaaa bbbb cccc dddd\n\neeee ffff gggg\n\nhhhh", 24, 8) == ["aaaa bbbb cccc dddd", "cccc dddd\n\neeee ffff gggg", "ffff gggg\n\nhhhh"]
    # a blank that would leave less than half an overlap is passed over for a whole overlap
    assert chunk.semantic_split("abcdefghijklmn op\nqrstuvwxyz\nlast\n" + "z" * 100, 18, 8) == ["abcdefghijklmn op", "klmn op\nqrstuvwxyz", "tuvwxyz\nlast", "yz\nlast\n" + "z" * 100]
    # paragraph marks first, lines inside what is still too long
    assert chunk.semantic_split("p1\n\n" + "line one\nline two\n" * 12, 60, 0)[0] == "p1"


def test_recursive_chunks():
    assert all(len(p) <= 50 for p in chunk.recursive_split("word " * 200, 50, 10))
    assert chunk.recursive_split("aa bb cc dd ee", 8, 3) == ["aa bb cc", "cc dd", "dd ee"]
    assert chunk.recursive_split("one\n\ntwo three four\n\nfive", 12, 0) == ["one", "two three", "four", "five"]
    assert chunk.recursive_split("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunk.recursive_split("", 4, 1) == [] and chunk.recursive_split(" \n ", 4, 1) == []
    text = "".join(f"w{i}{' ' if i % 7 else chr(10)}" for i in range(400))
    parts = chunk.recursive_split(text, 60, 15)
    assert all(p in text for p in parts) and all(w in " ".join(parts).split() for w in text.split())


def test_running_sums_over_ranges(spark):
    from textmill.operators.order import numbered, reverse_order, running_sum

    rows = [(i, f"g{i % 3}" if i % 10 else None, i % 5) for i in range(1_000)]
    df = spark.createDataFrame(rows, "k long, g string, v long").repartition(7)
    want, total = {}, 0
    for k, _, v in rows:
        total += v
        want[k] = total
    assert {r.k: r.s for r in running_sum(df, ["k"], F.col("v"), "s").collect()} == want
    got = {r.k: r.number for r in numbered(df, ["k"], "number", ("g",)).collect()}
    seen = {}
    for k, g, _ in rows:
        seen[g] = seen.get(g, 0) + 1
        assert got[k] == seen[g]
    assert {r.k: r.place for r in reverse_order(df, "k").collect()} == {k: 1_000 - k for k, *_ in rows}
    assert numbered(df.limit(0), ["k"]).count() == 0


def test_upsert_and_default_answer(spark):
    from textmill.operators import retrieve as rt

    have = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, n string, v double")
    new = spark.createDataFrame([(2, " ", 5.0), (3, "c", None)], "k long, n string, v double")
    assert sorted(map(tuple, keyed.upsert(have, new, "k").collect())) == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", None)]
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, [-1.0, 0.0]), (9, None)], "query_id long, query array<double>")
    got = {r.query_id: (r.chunk_id, r.score, r.answer) for r in rt.best_match(index, q).collect()}
    assert got == {7: (1, 1.0, None), 8: (3, 0.0, None), 9: (None, None, rt.DEFAULT_ANSWER)}
    none = rt.best_match(index.limit(0), q).collect()
    assert [r.answer for r in none] == [rt.DEFAULT_ANSWER] * 3
    assert [(r.chunk_id, r.rank) for r in sorted(rt.top_k(index, q.where("query_id = 7"), 2).collect(), key=lambda r: r.rank)] == [(1, 1), (2, 2)]


def test_chunk_metadata(spark):
    made = one(spark, clean.rebuild_document(F.create_map(F.lit("TIPO"), F.lit("PDF"), F.lit("X"), F.lit("y")), F.lit("the body"), F.lit("f.txt")))
    assert one(spark, chunk.chunk_body(F.lit(made), strip_footer=True)) == "the body"
    head = one(spark, chunk.header_metadata(F.lit(made)))
    assert (head.type, head.title) == ("PDF", None)


PAGE = """<html><head><title> A &amp; B </title><meta name="Author" content="x"><meta name="author" content="y"></head><body>
<nav><a href="/n">nav</a></nav><article><h1>Title here</h1><p>Text <b>bold</b> one</p><a href="ley.pdf"></a><a href='/guia'>Guia</a></article><footer>foot</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "http://e.org/a/b", PAGE), (2, None, None)], "page_id long, url string, html string")
    assert one(spark, html.page_title(F.lit(PAGE))) == "A & B"
    assert one(spark, html.page_meta(F.lit(PAGE))) == {"author": "y"}
    assert [(r.tag, r.text) for r in html.page_blocks(pages).collect()] == [("article", "Title here Text bold one Guia"), ("h1", "Title here"), ("p", "Text bold one")]
    links = html.page_links(pages)
    assert [r.href for r in links.collect()] == ["/n", "ley.pdf", "/guia"]
    assert [r.href for r in html.page_links(pages, "content").collect()] == ["ley.pdf", "/guia"]
    absolute = links.withColumn("target", html.absolute_url("url", "href"))
    assert [r.target for r in absolute.collect()] == ["http://e.org/n", "http://e.org/a/ley.pdf", "http://e.org/guia"]
    split = html.split_links(absolute).collect()
    assert [(r.kind, r.text) for r in split] == [("PDF", "Documento PDF"), ("HTML", "Guia")]
    seen = spark.createDataFrame([("http://e.org/guia",)], "url string")
    assert [r.kind for r in html.split_links(absolute, seen).collect()] == ["PDF"]


def test_crawl_depths(spark):
    seeds = spark.createDataFrame([("a", 1)], "url string, depth int")
    hops = spark.createDataFrame([("a", "b", "HTML"), ("a", "p", "PDF"), ("b", "c", "HTML"), ("p", "q", "HTML")], "url string, target string, kind string")
    assert {r.url: r.depth for r in html.crawl_frontier(seeds, hops).collect()} == {"a": 1, "b": 2, "p": 1, "q": 2}


def test_crawl_goes_on_until_the_frontier_is_empty(spark):
    seeds = spark.createDataFrame([("a", 0)], "url string, depth int")
    hops = [("a", "p", "PDF"), ("p", "b", "HTML"), ("b", "c", "HTML"), ("c", "over", "HTML")]  # a PDF hop, then two HTML hops
    hops += [("a", "x", "HTML"), ("x", "z", "HTML"), ("a", "q", "PDF"), ("q", "r", "PDF"), ("r", "z", "PDF"), ("z", "y", "HTML"), ("y", "a", "PDF")]  # z: first at 2, then at 0
    got = html.crawl_frontier(seeds, spark.createDataFrame(hops, "url string, target string, kind string")).collect()
    assert {r.url: r.depth for r in got} == {"a": 0, "p": 0, "b": 1, "c": 2, "x": 1, "q": 0, "r": 0, "z": 0, "y": 1} and len(got) == 9
    assert one(spark, html.canonical_address(F.lit("HTTPS://www.X.org:443/a/?utm_source=f&b=1&ref=x#top"))) == "x.org/a?b=1"


def test_classes(spark):
    cls = lambda u, s: one(spark, html.classify(F.lit(u), F.lit(s))).category
    assert [cls("http://x/ley-1", ""), cls("http://x", "Solicitud"), cls("http://autismo", ""), cls("http://x", "autismo")] == ["LEY", "PROCEDIMIENTO", "ASOCIACION", "GUIA"]


def test_vectors(spark):
    a = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, retrieve.cosine(a, F.array(F.lit(2.0), F.lit(1.0)))) == pytest.approx(0.8)
    assert one(spark, retrieve.cosine(F.array(F.lit(0.0), F.lit(0.0)), a)) == 0.0
    assert one(spark, retrieve.squared_l2(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 25.0


STUDENTS = [(f"A0{i}",) for i in (1, 3, 4, 5, 6)]
COURSES = [("C01", 4), ("C02", 6), ("C03", 5), ("C04", 4)]
ENROLMENTS = [(1, "A01", "C01"), (2, "A01", "C03"), (3, "A02", "C02"), (4, "A03", "C01"), (5, "A03", "C04"), (6, "A04", "C03"), (7, "A04", "C02"), (8, "A05", "C01")]


def test_keyed_tables(spark, tmp_path):
    students = spark.createDataFrame(STUDENTS, "id_alumno string")
    courses = spark.createDataFrame(COURSES, "id_curso string, creditos int")
    enrolments = spark.createDataFrame(ENROLMENTS, "id_inscripcion int, id_alumno string, id_curso string")
    assert {r.id_curso: r.n for r in keyed.count_per_course(courses, enrolments).collect()} == {"C01": 3, "C02": 2, "C03": 2, "C04": 1}
    assert keyed.roster(enrolments, students, courses).count() == 7
    assert [r.id_alumno for r in keyed.unmatched_keys(students, enrolments, "id_alumno").collect()] == ["A02"]
    assert [r.id_alumno for r in keyed.delete_by_key(students, enrolments, "id_alumno").collect()] == ["A06"]
    changed = keyed.update_partial(courses, spark.createDataFrame([("C01", 0), ("C02", None)], "id_curso string, creditos int"), "id_curso")
    assert {r.id_curso: r.creditos for r in changed.collect()} == {"C01": 0, "C02": 6, "C03": 5, "C04": 4}
    assert keyed.next_id(students, "id_alumno", "A").collect()[0].next_id == "A07"
    assert keyed.next_id(students, "id_alumno", "A", by_count=True).collect()[0].next_id == "A06"
    io.write_csv(courses, f"{tmp_path}/c")
    assert io.read_csv(spark, f"{tmp_path}/c", "id_curso string, creditos int").count() == 4


def test_next_id_keeps_long_numbers(spark):
    for n, want in ((8, "S09"), (9, "S10"), (98, "S99"), (99, "S100"), (100, "S101"), (12_345, "S12346")):
        assert keyed.next_id(spark.createDataFrame([(n,)], "key long"), "key", "S").collect()[0].next_id == want


def test_log_and_scores(spark, tmp_path):
    lines = [
        "Partida iniciada: Dificultad: HARD, Modo barcos: RUSO, Rivales: 2",
        "Jugador: Disparo a Rival 1 en (3, 4) - Tocado",
        "IA 2 (HARD): Disparo a Jugador en (0, 9) - Hundido",
        "Fin de partida: Ganador: Jugador, Puntuación Jugador: 20, Puntuación IA: 5",
        "otra cosa",
    ]
    got = events.parse_log(spark.createDataFrame([(i, m) for i, m in enumerate(lines)], "i int, message string")).orderBy("i").collect()
    assert [r.kind for r in got] == ["start", "shot", "shot", "end", None]
    assert (got[0].difficulty, got[0].mode, got[0].rivals) == ("HARD", "RUSO", "2")
    assert (got[2].actor, got[2].target, got[2].row, got[2].col, got[2].result) == ("IA 2 (HARD)", "Jugador", 0, 9, "Hundido")
    assert (got[3].winner, got[3].player_score, got[3].ai_score) == ("Jugador", 20, 5)
    scores = spark.createDataFrame([("NORMAL", "2", "VERY HARD", 1, 0, 31, 11), ("NORMAL", "3", "EASY", 1, 0, 51, 0)], "mode string, rivals string, difficulty string, player_wins int, ai_wins int, player_score int, ai_score int")
    io.write_scoreboard(scores, f"{tmp_path}/s")
    assert sorted(io.read_scoreboard(spark, f"{tmp_path}/s").collect()) == sorted(scores.collect())


def test_scoreboard_keeps_rows_with_null_keys(spark, tmp_path):
    rows = [(None, "2", "HARD", 1, 0, 31, 11), (None, None, None, 2, 0, None, 0), ("RUSO", None, "EASY", 1, 1, 5, 7), ("null", "1", "EASY", 3, 0, 6_000_000_036, 0)]
    rows += [(k, k, k, 4, 0, 1, 1) for k in ("", r"\N", r"\\N", r"\x", "\\", 'a\n\\N"')]
    schema = "mode string, rivals string, difficulty string, player_wins long, ai_wins long, player_score long, ai_score long"
    io.write_scoreboard(spark.createDataFrame(rows, schema), f"{tmp_path}/s")
    assert sorted(map(tuple, io.read_scoreboard(spark, f"{tmp_path}/s").collect()), key=str) == sorted(rows, key=str)


def test_corpus_files(spark, tmp_path):
    (tmp_path / "c" / "leyes").mkdir(parents=True)
    (tmp_path / "c" / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "c" / "leyes" / "b.txt").write_text("ñ", encoding="utf-8")
    (tmp_path / "c" / "00_x.txt").write_text("no")
    got = sorted((r.source_file, r.category, r.text) for r in io.read_corpus(spark, f"{tmp_path}/c").collect())
    assert got == [("a.txt", "general", "é"), ("b.txt", "leyes", "ñ")]
    assert io.read_chunks(spark, f"{tmp_path}/none").count() == 0 and io.load_index(spark, f"{tmp_path}/none") is None


def test_ledgers(spark):
    moves = spark.createDataFrame([(1, 1, 500.0), (1, 2, -100.0), (1, 3, -5000.0), (1, 4, 0.0)], "k int, i int, x double")
    guarded = stats.ledger_guarded(moves, "k", ["i"], "x", 1000.0).orderBy("i").collect()
    assert [(r.accepted, r.balance) for r in guarded] == [(True, 1500.0), (True, 1400.0), (False, 1400.0), (False, 1400.0)]
    assert [r.balance for r in stats.ledger_balance(moves, "k", ["i"], "x", 100.0).orderBy("i").collect()] == [600.0, 500.0, -4500.0]
    speed = spark.createDataFrame([(1, 1, 50), (1, 2, -20), (1, 3, -90), (1, 4, 10)], "k int, i int, x int")
    assert [r.total for r in stats.floored_total(speed, "k", ["i"], "x").orderBy("i").collect()] == [50, 30, 0, 10]


def test_small_collections(spark):
    v = spark.createDataFrame([(1, x) for x in (3, 5, 2, 7, 9)], "g int, v int")
    r = stats.closest_pair(v, "g", "v").collect()[0]
    assert (r.low, r.high) == (2, 3)
    cells = spark.createDataFrame([(i, j, x) for i, row in enumerate([[3, 5, 2, 8], [7, 9, 1, 4], [6, 8, 2, 5]]) for j, x in enumerate(row)], "i int, j int, v int")
    got = [tuple(x)[1:] for x in stats.transpose(cells, "j", "i", "v", [0, 1, 2]).orderBy("j").collect()]
    assert got == [(3, 7, 6), (5, 9, 8), (2, 1, 2), (8, 4, 5)]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 2)], "a int, b int")
    assert {x.value: x.n for x in stats.pair_value_count(pairs, "a", "b").collect()} == {1: 2, 2: 3, 3: 2, 4: 1}


def test_columns(spark):
    assert one(spark, c.day_of(F.lit("30/02/2024"))) is None
    assert one(spark, c.day_of(F.lit("29/02/2024"))) == datetime.date(2024, 2, 29)
    assert one(spark, F.dayofyear(c.day_of(F.lit("01/03/2024")))) == 61
    assert tuple(one(spark, c.hms(F.lit(3661)))) == (1, 1, 1)
    assert one(spark, c.valid_password(F.lit("Abcdefg1"))) and not one(spark, c.valid_password(F.lit("abcdefg1")))
    assert one(spark, c.is_palindrome(F.lit("Reconocer"))) and one(spark, c.age_or_default(F.lit("x"))) == 18
    assert one(spark, c.divides(F.lit(3), F.lit(9))) and not one(spark, c.divides(F.lit(0), F.lit(9)))


def test_monitor_stream_equals_batch(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    rows = [(at(0), "a", "s0", False), (at(4), "a", "s1", True), (at(11), "a", "s2", False)]
    mail = spark.createDataFrame(rows, "ts timestamp, sender string, subject string, deleted boolean")
    mail.write.parquet(f"{tmp_path}/mail")
    batch = {(r.window.start, r.sender, r.n) for r in monitor.inbox_monitor(mail).collect()}
    assert len(batch) == 40
    stream = spark.readStream.schema(mail.schema).parquet(f"{tmp_path}/mail")
    q = monitor.inbox_monitor(stream).writeStream.outputMode("complete").format("memory").queryName("inbox").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.window.start, r.sender, r.n) for r in spark.table("inbox").collect()} == batch
    quiet = monitor.quiet_intervals(mail, "ts", "1 minute", 60).collect()
    assert [r.state for r in quiet].count("SIN_NOVEDADES") == 9
