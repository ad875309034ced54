"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters are words of a seed lexicon, words and word patterns (beginnings and endings) that lean to one class in the labelled
training rows, and one voter a family that speaks for clean if none of its family fires. The label model never sees the
given labels: it starts from the voters' majority and fits their accuracies, and a tree of pairwise dependencies, by
expectation maximisation. The classifier is a logistic regression on the presence of features, fitted to the posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.storage import documents, held_out, materialise
from vantage.llm.words import BASE, Words, mix, slices, text_bytes

#: Labelled rows of each class that the models are fitted to, at most; drawn by a hash of the id.
SAMPLE_PER_CLASS = 3000
MAX_VOTERS, MAX_FEATURES = 400, 1200
SEED_WORDS = (
    "idiot moron stupid trash scum loser clown worthless pathetic disgusting imbecile jerk dumb bastard "
    "connard salope imbécile ordure crétin abruti pourriture "
    "dummkopf arschloch abschaum trottel versager widerlich "
    "estúpido basura imbécil inútil asqueroso escoria"
).split()

_FOLD = np.full(256, 32, np.uint8)
for _b in (*range(97, 123), *range(48, 58), *range(128, 256)):
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32
HEADS, TAIL = (4, 5, 6), 5
WORDED = np.array([1], np.uint64)  # a feature of every text with words


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; what is no letter or digit becomes a blank."""
    out = _FOLD[raw]
    up = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    out[up] += 32
    return out


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit feature) of every word: itself, its beginnings of ``HEADS`` bytes and its ending of ``TAIL`` bytes."""
    w = Words.of(fold(raw), at)
    docs, out = [w.doc], [w.hashes()]
    size = w.ends - w.starts
    for sign, lengths in ((1, HEADS), (-1, (TAIL,))):
        live = np.flatnonzero(size > min(lengths))
        h, power = np.zeros(len(live), np.uint64), np.uint64(1)
        for i in range(max(lengths)):
            at_byte = w.starts[live] + i if sign > 0 else w.ends[live] - 1 - i
            h += (w.raw[at_byte].astype(np.uint64) + np.uint64(1)) * power
            power = np.uint64((int(power) * int(BASE)) % (1 << 64))
            if i + 1 in lengths:
                docs.append(w.doc[live])
                out.append(mix(h ^ np.uint64((i + 1) * 2 + (sign > 0))))
                longer = size[live] > i + 2
                live, h = live[longer], h[longer]
    return np.concatenate(docs), np.concatenate(out)


def word_feature(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Words.of(fold(raw), np.array([0, len(raw)])).hashes()[0])


@dataclass
class Classifier:
    keys: np.ndarray  # sorted features
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def logits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        doc, h = features(raw, at)
        maybe = self.screen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        doc, h = doc[maybe], h[maybe]
        place = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        hit = self.keys[place] == h if len(self.keys) else np.zeros(0, bool)
        pair = np.unique(doc[hit] * max(len(self.keys), 1) + place[hit])
        n = max(len(self.keys), 1)
        return self.bias + np.bincount(pair // n, self.weights[pair % n] if len(self.keys) else None, len(at) - 1)


def choose(presence: list[np.ndarray], y: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by how far they lean to one class: keys, and how many rows of either class have each."""
    keys, place = np.unique(np.concatenate(presence), return_inverse=True)
    row = np.repeat(np.arange(len(presence)), [len(p) for p in presence])
    pos = np.bincount(place, y[row], len(keys))
    neg = np.bincount(place, 1 - y[row], len(keys))
    keep = (pos + neg >= least) & (keys != WORDED[0])
    return keys[keep], pos[keep], neg[keep]


def hits(presence: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the chosen keys that each row has."""
    flat, row = np.concatenate(presence), np.repeat(np.arange(len(presence)), [len(p) for p in presence])
    place = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    hit = keys[place] == flat
    return row[hit], place[hit]


def dependency_tree(fires: np.ndarray, post: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """Parent of each voter (-1 for none) in the forest of greatest mutual information given the hidden class.

    Ties go to the voters that come first. Pairs of less than ``least`` nats stay apart.
    """
    n, width = fires.shape
    info = np.zeros((width, width))
    for weight in (post, 1 - post):
        mass = weight.sum()
        if mass <= 0:
            continue
        on = (fires * weight[:, None]).sum(axis=0) / mass
        both = (fires * weight[:, None]).T @ fires / mass
        for x, y in ((1, 1), (1, 0), (0, 1), (0, 0)):
            joint = both if x and y else on[:, None] - both if x else on[None, :] - both if y else 1 - on[:, None] - on[None, :] + both
            alone = (on if x else 1 - on)[:, None] * (on if y else 1 - on)[None, :]
            fine = (joint > 1e-12) & (alone > 1e-12)
            info[fine] += mass / n * joint[fine] * np.log(joint[fine] / alone[fine])
    parent, done = np.full(width, -1), np.zeros(width, bool)
    best, via = np.full(width, -1.0), np.full(width, -1)
    for _ in range(width):
        j = int(np.argmax(np.where(done, -np.inf, best)))
        done[j] = True
        parent[j] = via[j] if best[j] >= least else -1
        closer = ~done & (info[j] > best)
        best[closer], via[closer] = info[j][closer], j
    return parent


def label_model(fires: np.ndarray, polarity: np.ndarray, prior: float, rounds: int = 25, smooth: float = 2.0) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of the hidden label from voters that speak for their class or abstain, by expectation maximisation.

    ``fires`` is (rows, voters) of 0 and 1, ``polarity`` is 1 for voters of the toxic class and -1 for those of the clean.
    The start is the sign of the votes, and ``prior`` where they balance. A voter's rates are P(fires | class, what its
    parent in the dependency tree does), so voters that say the same thing count once. A voter that comes out firing
    more often for the other class has its rates made equal: it then says nothing.
    """
    fires = fires.astype(float)
    net = fires @ polarity
    post = np.where(net > 0, 0.9, np.where(net < 0, 0.1, prior))
    against = np.concatenate([fires, np.zeros((len(fires), 1))], axis=1)  # the parent -1 never fires
    for step in range(rounds):
        share = float(np.clip(post.mean(), 0.01, 0.99))
        if step % 5 == 0:
            parent = dependency_tree(fires, post)
        above = against[:, parent]
        logit = np.full(len(fires), np.log(share / (1 - share)))
        rate = np.stack([(w @ fires + 0.05) / (w.sum() + 1) for w in (1 - post, post)])
        wrong = (rate[1] - rate[0]) * polarity < 0
        rate[:, wrong] = ((fires.sum(axis=0) + 0.05) / (len(fires) + 1))[wrong]
        given = np.empty((2, 2, fires.shape[1]))  # class, whether the parent fires, voter
        for c, w in enumerate((1 - post, post)):
            for x in (0, 1):
                seen = w[:, None] * (above == x)
                given[c, x] = ((seen * fires).sum(axis=0) + smooth * rate[c]) / (seen.sum(axis=0) + smooth)
        given = np.clip(given, 1e-4, 1 - 1e-4)
        given[:, :, wrong] = rate[0][wrong]
        on = np.log(given[1] / given[0])
        off = np.log((1 - given[1]) / (1 - given[0]))
        ratio = np.where(above == 1, np.where(fires == 1, on[1], off[1]), np.where(fires == 1, on[0], off[0]))
        post = 1 / (1 + np.exp(-np.clip(logit + ratio.sum(axis=1), -30, 30)))
    return post, {"rate": rate, "given": given, "parent": parent}


def logistic(row: np.ndarray, col: np.ndarray, width: int, target: np.ndarray, l2: float = 5e-5, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over sparse 0/1 features, full batch with Adam."""
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(target)) + b, -30, 30)))
        d = (p - target) / len(target)
        g = np.append(np.bincount(col, d[row], width) + l2 * w, d.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def leaning(pos: np.ndarray, neg: np.ndarray, n1: float, n0: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log odds, gain, side): how far features lean to a class, and 1, -1 or 0 for voters of the toxic or clean class or of none."""
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    toxic = (odds > np.log(8)) & (pos >= 4) & (pos / n1 > 20 * neg / n0)
    clean = (odds < -np.log(8)) & (neg >= 4) & (neg / n0 > 20 * pos / n1)
    return odds, odds * (pos / n1 - neg / n0), toxic.astype(int) - clean


def voters(presence: list[np.ndarray], y: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fires, polarity, keys): every voter on every row.

    After the voters of ``keys`` come those of silence: of the lexicon and of the mined features, each firing for clean
    on rows with words on which no member of its family for the toxic class fires.
    """
    keys, pos, neg = choose(presence, y)
    _, gain, side = leaning(pos, neg, y.sum(), len(y) - y.sum())
    order = np.argsort(-gain, kind="stable")
    lean = np.concatenate([order[side[order] == s][:MAX_VOTERS] for s in (1, -1)])
    mined = keys[lean]
    both = np.append(mined, np.setdiff1d(np.intersect1d(seeds, keys), mined))
    sign = np.append(side[lean], np.ones(len(both) - len(mined), int))
    order = np.argsort(both)
    both, sign = both[order], sign[order]
    fires = np.zeros((len(presence), len(both) + 2))
    if len(both):
        fires[hits(presence, both)] = 1
    worded = np.array([len(p) > 0 for p in presence])
    for i, family in enumerate((np.isin(both, seeds), ~np.isin(both, seeds) & (sign > 0))):
        fires[:, len(both) + i] = worded & (fires[:, :-2][:, family].sum(axis=1) == 0)
    return fires, np.append(sign, [-1, -1]), both


def seed_features() -> np.ndarray:
    return np.unique(np.array([word_feature(x) for x in SEED_WORDS], np.uint64))


def fit(presence: list[np.ndarray], y: np.ndarray) -> Classifier:
    """Choose voters, fit the label model, train the classifier. With no toxic or no clean row, the seed lexicon decides."""
    seeds = seed_features()
    if not len(y) or y.min() == y.max():
        return Classifier(seeds, np.full(len(seeds), 8.0), -4.0)
    fires, polarity, own = voters(presence, y, seeds)
    if not (polarity > 0).any():
        return Classifier(seeds, np.full(len(seeds), 8.0), -4.0)
    post, _ = label_model(fires, polarity, float(y.mean()))
    keys, pos, neg = choose(presence, y)
    _, gain, _ = leaning(pos, neg, y.sum(), len(y) - y.sum())
    strong = np.argsort(-np.abs(gain), kind="stable")[:MAX_FEATURES]
    chosen = np.union1d(own, keys[strong])
    w, b = logistic(*hits(presence, chosen), len(chosen), post)
    return Classifier(chosen, w, b)


def training_features(table: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features that may become voters or inputs, and the label, of up to ``per_class`` rows of each class outside the held-out fold.

    Rows are drawn by a hash of the id, so the ids to broadcast are bounded by the parameter. Counts of every feature by
    class are made in Spark; the driver receives the keys that lean most and which rows have them. Null labels, null ids
    and labels other than 0 and 1 are left out; of conflicting labels of one document, 1 counts. Null texts count as empty,
    and rows that repeat a document count each.
    """
    spark = table.sparkSession
    learn = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out())
    learn = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 30))
    ids: list[tuple] = []
    for y, n in learn.groupBy("toxic").count().collect():
        some = learn.where((F.col("toxic") == y) & (draw < F.lit(int((1 << 30) * min(1.0, 1.2 * per_class / n + 10 / n)))))
        ids += sorted((r["h"], r["doc_id"], y) for r in some.select("doc_id", draw.alias("h")).collect())[:per_class]
    if not ids:
        return [], np.zeros(0)
    kind = labels.schema["doc_id"].dataType.simpleString()
    drawn = spark.createDataFrame([(d, int(y)) for _, d, y in ids], f"doc_id {kind}, toxic int")
    rows = table.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("toxic", "text")
    rows = materialise(rows)  # a bounded sample: both passes read it

    def own_features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for part in slices(batches, "text"):
            doc, h = features(*text_bytes(part.column(1)))
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            yield part, np.split(h[new], np.searchsorted(doc[new], np.arange(1, part.num_rows)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in own_features(batches):
            y = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(h) for h in own])
            keys, place = np.unique(np.concatenate(own), return_inverse=True)
            pos = np.bincount(place, y, len(keys))
            counts = np.bincount(place, minlength=len(keys))
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(pos.astype(np.int64)), pa.array((counts - pos).astype(np.int64))], ["feature", "pos", "neg"])

    seeds = seed_features()
    n1 = max(1, sum(y for _, _, y in ids))
    n0 = max(1, len(ids) - n1)
    counts = rows.mapInArrow(tally, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    ranked = materialise(counts.withColumn("gain", odds * (F.col("pos") / n1 - F.col("neg") / n0)).withColumn("odds", odds))
    picks = [ranked.where(c).orderBy(F.desc("gain"), "feature").limit(n) for c, n in (("odds > 2", MAX_VOTERS), ("odds < -2", MAX_VOTERS), ("true", MAX_FEATURES))]
    keys = np.unique(np.concatenate([seeds, *(p.select("feature").toArrow().column(0).to_numpy().view(np.uint64) for p in picks)]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in own_features(batches):
            # WORDED tells a text that has words from an empty one
            held = [np.append(h[np.isin(h, keys, assume_unique=True)], WORDED[: len(h)]).tobytes() for h in own]
            yield pa.record_batch([part.column(0), pa.array(held, pa.binary())], ["toxic", "own"])

    got = rows.mapInArrow(extract, "toxic int, own binary").collect()
    got.sort(key=lambda r: (r["toxic"], bytes(r["own"])))
    return [np.frombuffer(bytes(r["own"]), np.uint64) for r in got], np.array([r["toxic"] for r in got], float)


def score(table: DataFrame, model: Classifier) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row; null and empty texts get the score of no feature at all."""
    keys, weights, bias = model.keys, model.weights, model.bias

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(keys, weights, bias)
        for part in slices(batches, "text"):
            p = 1 / (1 + np.exp(-np.clip(own.logits(*text_bytes(part.column(1))), -30, 30)))
            yield pa.record_batch([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(judge, f"doc_id {kind}, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a classifier learned outside the held-out fold.

    Rows without an id count as held out, rows that repeat are scored each for itself, null and empty texts get the score
    of no feature, a score of exactly 0.5 is toxic. An empty table gives no rows; columns not named here are left out.
    """
    table = documents(spark, sf_dir)
    model = fit(*training_features(table, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(table, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
