"""Personal data by bootstrapped contextual extraction; DataFrame operations only.

Regular expressions find the seed entities: email, ip, card and phone. The two words before a seed are
a lexical pattern. Wherever a number or a spelled-out address of an identifier's shape stands that is
no seed, it is a candidate instance with a pattern of its own. Over the graph of patterns and
instances, scores go back and forth a few rounds: a pattern is as good as the mean of its instances,
an instance as good as its patterns together. Patterns of high score and wide support then add the
candidates that they introduce to the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import let
from textmill.llm.common import release, stage

#: Kinds in their order and the patterns of their base forms. Quantifiers are possessive where no
#: character could be given back, and runs are entered at their start only, so the time is linear.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
KINDS = tuple(k for k, _ in BASE)
#: What an identifier that no base pattern knows may look like: 7 to 19 digits in groups, or a spelled-out address.
NUMBER = r"(?<![0-9A-Za-z.])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])"
SPELLED = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++"
ROUNDS = 3
#: A pattern counts with this many different seeds and this score; so does an instance with the score.
SUPPORT, SCORE = 3, 0.8
#: Blanks before a span behind which its pattern's words are looked for: two words with up to three signs
#: between and four after them have fewer.
BLANKS = 9


#: Numbers of an array that are added up in one go; see running.
CHUNK = 64


def running(values: Column, reduce=lambda a, b: a + b, levels: int = 3) -> Column:
    """The running sums of an array of longs without nulls (or what reduce makes of the first 1, 2, ...).

    A fold that appends to an array copies all of it at each step. So values are taken in chunks of CHUNK: each
    is folded by itself, and what comes before a chunk is the running sum of the chunks' totals, by the same way.
    With three levels the longest fold over n values has n / CHUNK ** 2 steps.
    """

    def fold(xs: Column) -> Column:
        append = lambda done, x: F.concat(done, F.array(F.when(F.size(done) == 0, x).otherwise(reduce(F.element_at(done, -1), x))))
        return F.aggregate(xs, F.array().cast("array<long>"), append)

    if levels == 1:
        return fold(values)

    def whole(xs: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(CHUNK))
        return let(F.transform(places, lambda at: fold(F.slice(xs, at, F.lit(CHUNK)))), joined)

    def joined(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.element_at(c, -1))
        before = lambda upto: F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(let(F.get(upto, i - 1), lambda b: F.transform(c, lambda x: reduce(b, x)))))
        return F.flatten(let(running(totals, reduce, levels - 1), before))

    # most arrays are short
    return let(values, lambda xs: F.when(F.size(xs) <= CHUNK, fold(xs)).otherwise(whole(xs)))


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, start, end, value, before>> of all leftmost matches; code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    measure = lambda m, g: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("n"), m.alias("value"), F.substring_index(g, " ", -BLANKS).alias("before"))
    lengths = F.zip_with(found, F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0))), measure)

    def placed(matches: Column) -> Column:
        ends = running(F.transform(matches, lambda m: m["gap"] + m["n"]))
        span = lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - m["n"]).alias("start"), end.alias("end"), m["value"].alias("value"), m["before"].alias("before"))
        return F.zip_with(matches, ends, span)

    return let(lengths, placed)


def _clear_of(base: Column, other: Column) -> Column:
    """The spans of other that overlap none of base, in linear work but for the sort.

    Base spans enter at their start and the others at their end; a span is clear if no base span that
    entered before ends behind its start.
    """
    none = F.lit(None)
    entry = lambda at, first, end, s: F.struct(at.alias("at"), F.lit(first).alias("other"), end.cast("long").alias("reach"), s.alias("span"))
    enter = F.transform(base, lambda b: entry(b["start"], 1, b["end"], none.cast("struct<kind:string,start:long,end:long,value:string,before:string>")))
    leave = F.transform(other, lambda s: entry(s["end"], 0, F.lit(-1), s))  # at equal places first: touching is no overlap

    def judged(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), F.greatest)
        kept = F.filter(F.zip_with(events, reach, lambda e, r: F.struct(e["span"].alias("span"), r.alias("reach"))), lambda e: e["span"].isNotNull() & (e["reach"] <= e["span"]["start"]))
        return F.transform(kept, lambda e: e["span"])

    return F.when((F.size(base) == 0) | (F.size(other) == 0), other).otherwise(let(F.array_sort(F.concat(enter, leave)), judged))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, "[.]"), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        def term(i):
            d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

        short = F.when(n.between(13, 19), n).otherwise(F.lit(1))
        total = F.aggregate(F.transform(F.sequence(F.lit(1), short), term), F.lit(0), lambda a, b: a + b)
        return n.between(13, 19) & (total % 10 == 0)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _found(text: Column, kind: str, pattern: str, hint: Column) -> Column:
    """The valid spans of a kind; texts without the kind's mark aren't searched."""
    none = F.array().cast("array<struct<kind:string,start:long,end:long,value:string,before:string>>")
    return F.when(hint, F.filter(_spans(text, pattern, kind), lambda s: _valid(kind, s["value"]))).otherwise(none)


def _pattern(before: Column) -> Column:
    """The last two words before a span, lower-cased, with signs between as one mark; the last one where a
    line, a number or more signs part them; null if there is none. Words may have any length."""
    words = F.regexp_extract(F.lower(before), r"(?<![\p{L}'])((?:\p{L}[\p{L}']*+[^\p{L}0-9\n]{1,3})?\p{L}[\p{L}']*+[^\p{L}0-9\n]{0,4})$", 1)
    return F.when(words != "", F.regexp_replace(words, r"[^\p{L}]+", " "))


def _text_of(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of docs(doc_id, text).

    The counts and base_sha256 are those of the base spans; spans lists these and the added ones as
    kind:start:end by kind and start, joined by commas. A null text is empty. Added spans never
    overlap a base span. Rows are told apart even if they share a doc_id or have none; equal rows get
    equal spans. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = text.rlike("[0-9]")
    hints = {"email": text.contains("@"), "ip": number & text.contains("."), "card": number, "phone": text.contains("+")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(*(_found(text, k, p, hints[k]) for k, p in BASE)).alias("base"), F.concat(_found(text, "number", NUMBER, number), _found(text, "spelled", SPELLED, F.lower(text).rlike(r"[\[(]at[\])]"))).alias("other"))
    both = let(F.flatten("base"), lambda b: F.struct(b.alias("base"), _clear_of(b, F.col("other")).alias("other")))
    rows = rows.select("doc_id", both.alias("b")).select("doc_id", "b.base", "b.other")
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "entities")

    # occurrences of seeds and candidates with their patterns
    seeds = rows.select("rid", F.explode("base").alias("s"))
    seeds = seeds.select("rid", "s.kind", "s.start", "s.end", F.lower("s.value").alias("value"), _pattern(F.col("s.before")).alias("pattern"), F.lit(True).alias("seed"))
    others = rows.select("rid", F.explode("other").alias("s"))
    others = others.select("rid", "s.kind", "s.start", "s.end", F.lower("s.value").alias("value"), _pattern(F.col("s.before")).alias("pattern"), F.lit(False).alias("seed"))
    # a spelled-out address can only be an email; a number anything else
    others = others.withColumn("kind", F.explode(F.when(F.col("kind") == "spelled", F.array(F.lit("email"))).otherwise(F.array(*map(F.lit, KINDS[1:])))))
    seen = stage(seeds.union(others).where("pattern IS NOT NULL"), "occurrences")

    edges = stage(seen.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")), "edges")
    instance = edges.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("score"))
    for step in range(ROUNDS):
        old = [instance, good] if step else []
        scored = edges.join(instance, ["kind", "value"]).groupBy("pattern", "kind")
        good = scored.agg(F.avg("score").alias("quality"), F.count(F.when(F.col("seed"), 1)).alias("support"))
        good = stage(good.where(f"support >= {SUPPORT}"), "patterns")
        # one minus the product of doubts; a seed stays certain
        doubt = F.sum(F.log1p(-F.least(F.coalesce("quality", F.lit(0.0)), F.lit(1.0 - 1e-9))))
        reached = edges.join(good, ["pattern", "kind"], "left").groupBy("kind", "value")
        instance = stage(reached.agg(F.when(F.max("seed"), 1.0).otherwise(1.0 - F.exp(doubt)).alias("score")), "instances")
        release(*old)
    release(edges)
    trusted = good.where(f"quality >= {SCORE}").select("pattern", "kind", "quality")
    added = seen.where("NOT seed").join(trusted, ["pattern", "kind"]).join(instance.where(f"score >= {SCORE}"), ["kind", "value"])
    best = added.groupBy("rid", "start", "end").agg(F.max_by("kind", F.struct("quality", "kind")).alias("kind"))
    extra = best.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))  # within one text
    place = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    out = rows.join(extra, "rid", "left")
    slim = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    every = F.concat(slim, F.coalesce("extra", F.array().cast("array<struct<kind:string,start:long,end:long>>")))
    every = F.array_sort(F.transform(every, lambda s: F.struct(place(s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform("base", _text_of), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, _text_of), ",").alias("spans"),
        F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_added"),
    )
