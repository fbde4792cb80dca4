"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled rows, one on toxic text and one on ordinary text. A
window is a word with its blanks; its gap is how many bytes shorter it gets when the toxic dictionary's
content stands before the ordinary one's. How many of a text's windows reach each gap, as shares and as
counts beside the text's length, goes through a logistic calibration on rows that neither dictionary saw.

Most of a toxic text is ordinary, so the trainer isn't shown all of it. Each window of a toxic row is
compressed behind VOTES pieces of raw text from other toxic rows, and behind as many from ordinary ones.
The windows that most toxic pieces make at least FIRST bytes shorter are the row's training sample;
zstandard's trainer, which goes by the strings that many samples share, makes the dictionary of them.
The ordinary dictionary is trained on the whole ordinary rows. So strings that toxic rows have in common win, whole words or parts of them in any language, and nothing
but compressed lengths decides. Wider windows were tried: chance matches between the words' context and
either dictionary then outweigh a short insult.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import Remembered, release, stage

#: The training sample: so many labelled rows of each class, and so many bytes of text, at most.
SAMPLE, SAMPLE_BYTES = 3_000, 16 << 20
#: The sample's rows are dealt to so many folds; fold 0 calibrates, the others train.
FOLDS = 3
#: Pieces of raw text that stand for a dictionary while training windows are chosen, and the bytes of one.
VOTES, PIECE = 8, 65_536
#: A training window is at least FIRST bytes shorter behind the toxic piece in NEED of the pairs of pieces.
FIRST, NEED = 2, 0.75
#: Bytes of the ordinary dictionary, and of the toxic one; calibration takes the best of these sizes.
ORDINARY, TOXIC = 65_536, (1_024, 2_048, 4_096, 8_192)
#: Lengths of a segment and of the strings whose frequency the trainer counts.
SEGMENTS = {"ordinary": (64, 6), "toxic": (24, 6)}
#: Gaps are told apart up to this one.
MOST = 11
#: Ends both dictionaries and every window: the compressor looks for no match in an input's last bytes.
TAIL = b" 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[39] = 39
_FOLD[128:] = np.arange(128, 256)
_TABLE = _FOLD.tobytes()


def words(text: str | None) -> list[bytes]:
    """Words of a text: letters, digits, apostrophes and all non-ASCII bytes; A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(9, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=params)


class Gaps:
    """Gaps of windows between two dictionary contents, with a bounded memory of known windows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic + TAIL), _compressor(ordinary + TAIL)
        self.known = Remembered(self.gap)

    def gap(self, word: bytes) -> int:
        window = b" " + word + b" " + TAIL
        return min(MOST, max(0, len(self.ordinary.compress(window)) - len(self.toxic.compress(window))))

    def profile(self, text: str | None) -> np.ndarray:
        """Windows of the text by gap, 0 to MOST."""
        return np.bincount(np.fromiter(map(self.known.__getitem__, words(text)), np.int64), minlength=MOST + 1)


def train(size: int, samples: list[bytes], kind: str) -> bytes:
    """A dictionary of zstandard's trainer; the samples themselves if there is too little text."""
    segment, counted = SEGMENTS[kind]
    samples = [s.ljust(2 * segment) for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=counted).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def features(profiles: np.ndarray, shortest: float, longest: float) -> np.ndarray:
    """[n, 9]: roots of the shares of windows at each gap, logs of counts, log of the number of windows.

    The calibration knows texts of shortest to longest windows. A longer text counts as so many windows
    of its own average; a shorter one has the length of the shortest."""
    over = profiles[:, ::-1].cumsum(axis=1)[:, ::-1]
    n = over[:, :1]
    over = over * np.minimum(1.0, longest / np.maximum(1, n))
    return np.hstack([np.sqrt(over[:, 1:6] / np.clip(n, 30, max(30.0, longest))), np.log1p(over[:, 2:5]), np.log(np.clip(n, shortest, longest))])


def calibrate(profiles: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """(log loss, logistic weights of the features, a constant, shortest and longest length): ridge, Newton steps, the rarer class weighing
    more; the constant is set so that 0.5 is the threshold with the best F1."""
    n = profiles.sum(axis=1)
    limits = max(1.0, float(n.min())), max(1.0, float(n.max()))
    x = features(profiles, *limits)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    ridge = np.array([0.3] * (x.shape[1] - 1) + [1e-6])
    weigh = np.where(toxic == 1, np.sqrt((toxic == 0).sum() / max(1, (toxic == 1).sum())), 1.0)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weigh * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(h, x.T @ (weigh * (p - toxic)) + ridge * w)
    z = np.clip(x @ w, -30, 30)
    loss = float(np.mean(np.log1p(np.exp(np.where(toxic == 1, -z, z)))))
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + hits[-1])
    low = z[order]
    f1[:-1][low[:-1] == low[1:]] = -1  # a threshold lies between different scores only
    best = int(np.argmax(f1))
    cut = (low[best] + (low[best + 1] if best + 1 < len(low) else low[best] - 1.0)) / 2
    raw = w[:-1] / spread
    return loss, np.concatenate([raw, [w[-1] - raw @ mean - cut], limits])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fold) of at most SAMPLE labelled rows and SAMPLE_BYTES of each class, by the hash of doc_id;
    rows whose crc32(doc_id) is divisible by 5 are held out. Equal rows count once."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    known = known.where(F.crc32(F.col("__id").cast("string")) % 5 != 0)
    pick = lambda k: known.where(F.col("__toxic") == k).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
    sample = F.broadcast(pick(0).union(pick(1)))  # at most 2 * SAMPLE rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(sample, "__id").select(F.xxhash64("__id").alias("h"), "__id", F.col("__toxic").alias("toxic"), "text").distinct()
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "labelled")
    light = rows.select("h", "__id", "toxic", "rid", F.octet_length("text").alias("n"))
    # a doc_id may come with any number of texts
    light = light.where("toxic = 0").orderBy("h", "__id", "n", "rid").limit(SAMPLE).union(light.where("toxic = 1").orderBy("h", "__id", "n", "rid").limit(SAMPLE))
    upto = Window.partitionBy("toxic").orderBy("h", "__id", "n", "rid")
    light = light.withColumn("sum", F.sum("n").over(upto)).withColumn("place", F.row_number().over(upto)).where(f"sum <= {SAMPLE_BYTES} OR place = 1")
    light = light.select("rid", F.pmod(F.floor(F.col("h") / 7), F.lit(FOLDS)).cast("int").alias("fold"))
    chosen = rows.join(F.broadcast(light), "rid").select("text", "toxic", "fold")  # at most 2 * SAMPLE rows of two numbers
    chosen = stage(chosen.repartition(8, F.xxhash64("text")), "sample")
    release(rows)
    return chosen


def training_samples(rows: DataFrame, pieces: dict[int, list[tuple[bytes, bytes]]]) -> list[bytes]:
    """One training sample for each toxic row of a training fold: the windows that most pairs of pieces
    kept for the row's fold call toxic."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        pairs = {fold: [Gaps(*c) for c in contents] for fold, contents in shared.value.items()}
        votes = {fold: Remembered(lambda w, p=p: sum(g.gap(w) >= FIRST for g in p) >= NEED * len(p)) for fold, p in pairs.items()}
        for b in batches:
            out = []
            for text, fold in zip(b.column(0), b.column(1).to_pylist()):
                out.append(b"".join(b" " + w + b" " for w in sorted(set(words(text.as_py()))) if votes[fold][w]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["sample"])

    toxic = rows.where("toxic = 1 AND fold > 0").select("text", "fold")
    return sorted((bytes(r["sample"]) for r in toxic.mapInArrow(run, "sample binary").collect()), key=zlib.crc32)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, np.ndarray]:
    """(toxic content, ordinary content, weights). The driver sees texts of the sample only."""
    rows = training_rows(docs, labels)
    spark = docs.sparkSession
    classes = {r["toxic"] for r in rows.select("toxic").distinct().collect()}
    if len(classes) < 2:
        return b"", b"", np.array([*[0.0] * 9, 10.0 if 1 in classes else -10.0, 1.0, 1.0])

    def folded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([b" ".join(words(t.as_py())) for t in b.column(0)], pa.binary())], names=["toxic", "fold", "words"])

    found = [(r["fold"], r["toxic"], bytes(r["words"])) for r in rows.where("fold > 0").mapInArrow(folded, "toxic int, fold int, words binary").collect()]
    found.sort(key=lambda r: zlib.crc32(r[2]))  # the raw contents must be mixed, and equal in every run
    side = lambda kind, keep: [w for fold, toxic, w in found if toxic == kind and keep(fold)]
    pieces = {}
    for fold in range(1, FOLDS):
        toxic, ordinary = (b"  ".join(side(kind, lambda f: f != fold)) for kind in (1, 0))  # noqa: B023
        n = max(1, min(VOTES, len(toxic) // PIECE, len(ordinary) // PIECE))
        size = min(PIECE, len(toxic), len(ordinary))
        pieces[fold] = [(toxic[i * size : (i + 1) * size], ordinary[i * size : (i + 1) * size]) for i in range(n)]
    samples = training_samples(rows, pieces)
    ordinary = train(ORDINARY, side(0, lambda f: True), "ordinary")
    made = [train(n, samples, "toxic") + ordinary for n in TOXIC]
    shared = spark.sparkContext.broadcast([(m, ordinary) for m in made])

    def profiles(batches):
        for b in batches:
            gaps = [_gaps(c) for c in shared.value]
            per = [np.concatenate([g.profile(t.as_py()) for g in gaps]).tolist() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(per, pa.list_(pa.int64()))], names=["toxic", "profile"])

    least = 0 if {r["toxic"] for r in rows.where("fold = 0").select("toxic").distinct().collect()} == {0, 1} else FOLDS
    measured = rows.where(F.col("fold") <= least).mapInArrow(profiles, "toxic int, profile array<long>").collect()
    measured.sort(key=lambda r: (r["toxic"], r["profile"]))
    profile = np.array([r["profile"] for r in measured]).reshape(len(measured), len(TOXIC), MOST + 1)
    toxic = np.array([r["toxic"] for r in measured])
    tried = [calibrate(profile[:, i], toxic) for i in range(len(TOXIC))]
    best = min(range(len(TOXIC)), key=lambda i: tried[i][0])
    release(rows)
    return made[best], ordinary, tried[best][1]


_made: dict[tuple[bytes, bytes], Gaps] = {}


def _gaps(contents: tuple[bytes, bytes]) -> Gaps:
    if contents not in _made:
        if len(_made) > len(TOXIC):
            _made.clear()
        _made[contents] = Gaps(*contents)
    return _made[contents]


def scores(profiles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(profiles, *weights[10:]) @ weights[:9] + weights[9], -30, 30)))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text); labels(doc_id, toxic).

    A null text is empty and scores as a text without toxic windows; a null doc_id is not held out. Labels
    without a class are skipped, of several for one doc_id the largest counts. If labels have only one
    class, every text gets that class. Repeated rows are scored each. The scoring pass is narrow.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        toxic, ordinary, weights = shared.value
        gaps = _gaps((toxic, ordinary))
        for b in batches:
            profile = np.stack([gaps.profile(t.as_py()) for t in b.column(1)]) if len(b) else np.zeros((0, MOST + 1))
            score = scores(profile, weights)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
