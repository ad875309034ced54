"""Near copies by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is the multiset of its five-word shingles, a shingle weighs its count times its inverse document frequency.
Samples agree with probability equal to the weighted Jaccard similarity. Documents that share a band are compared, and
those with a similarity of 0.8 or more are linked; the classes are the components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.storage import documents, materialise
from vantage.llm.words import Words, mix, slices, text_bytes
from vantage.operators.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair shares a band with probability 0.998, at 0.85 with 0.9999.
BANDS, ROWS = 16, 5
#: Classes of shingles by hash in a document's profile (a power of two).
CLASSES = 128
#: Bits that tell shingles apart; the others number the documents of a pass.
HASH_BITS = 45
#: Share of all documents under which a shingle counts as rare. The idf is 1 + IDF_SPAN there and falls with the logarithm of
#: the share to 1 for a shingle of every document.
RARE_SHARE, IDF_SPAN = 1 / 2000, 1.0
#: Text that a task counts at once: more makes denser differences to send.
PASS_BYTES = 4 << 20
#: Pairs that one verification block holds for one pivot.
BLOCK_PAIRS = 256


def shingles(raw: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), ordered by document and shingle. A text of fewer than ``k`` words is one shingle."""
    w = Words.of(raw, at)
    h = w.hashes()
    starts, keys = w.windows(h, k)
    doc = w.doc[starts]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = [int(np.bitwise_xor.reduce(mix(h[w.first[d] : w.first[d] + w.counts[d]] + np.arange(1, w.counts[d] + 1, dtype=np.uint64)))) for d in short]
        doc, keys = np.append(doc, short), np.append(keys, np.array(whole, np.uint64))
    both = doc.astype(np.uint64) << np.uint64(HASH_BITS) | keys >> np.uint64(64 - HASH_BITS)
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    begin = np.flatnonzero(new)
    return (both[begin] >> np.uint64(HASH_BITS)).astype(np.int64), both[begin] << np.uint64(64 - HASH_BITS), np.diff(np.append(begin, len(both)))


@dataclass
class Idf:
    """Document shares of common shingles by a 32-bit hash; all others are rare."""

    keys: np.ndarray
    share: np.ndarray
    documents: int
    rare: float = RARE_SHARE
    span: float = IDF_SPAN

    def weights(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        short = (shingle >> np.uint64(32)).astype(np.uint32)
        share = np.full(len(short), 1 / max(1, self.documents))
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, short), len(self.keys) - 1)
            hit = self.keys[place] == short
            share[hit] = self.share[place[hit]]
        return count * (1 + self.span * np.log(np.clip(share, self.rare, 1)) / np.log(self.rare))


def document_frequency(table: DataFrame, k: int = SHINGLE, rare: float = RARE_SHARE) -> Idf:
    """Exact document counts over all documents, by 32-bit hash, of the shingles in a share ``rare`` of them or more.

    Tasks send sorted hashes as packed differences to ranges of the hash; a range keeps the common ones. Their number is at
    most the mean distinct shingles of a document divided by ``rare``, whatever the size of the corpus: that bound lets
    the table come to the driver and go out to every task.
    """
    n, chars = table.agg(F.count("*"), F.sum(F.length("text"))).first()
    bits = max(8, int(np.ceil(np.log2(max(1, (chars or 0) >> 21)))))
    least = max(2, int(np.ceil(rare * n)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PASS_BYTES):
            doc, key, _ = shingles(*text_bytes(part.column(part.schema.get_field_index("text"))), k)
            short = (key >> np.uint64(32)).astype(np.uint32)
            same = np.zeros(len(doc), bool)  # two shingles of one document with one short hash count once
            same[1:] = (doc[1:] == doc[:-1]) & (short[1:] == short[:-1])
            short = np.sort(short[~same])
            cut = np.searchsorted(short, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(32 - bits))
            edge = np.concatenate([[0], cut, [len(short)]])
            out = []
            for i in np.flatnonzero(np.diff(edge)):
                own = short[edge[i] : edge[i + 1]]
                steps = np.diff(own, prepend=np.uint32(0)).astype("<u4")
                out.append((int(i), len(own), pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int32(), pa.binary()], strict=True)], ["bucket", "n", "keys"])

    def count(group: pa.Table) -> pa.Table:
        parts = []
        for size, raw in zip(group.column("n").to_pylist(), group.column("keys").to_pylist(), strict=True):
            planes = np.frombuffer(pa.decompress(raw, size * 4, "zstd", asbytes=True), np.uint8).reshape(4, size)
            parts.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32))
        keys, df = np.unique(np.concatenate(parts), return_counts=True)
        keep = df >= least
        return pa.table([pa.array(keys[keep].astype(np.int64)), pa.array(df[keep].astype(np.int64))], ["key", "df"])

    common = table.select("text").mapInArrow(send, "bucket int, n int, keys binary").groupBy("bucket").applyInArrow(count, "key long, df long").toArrow()
    keys = common.column("key").to_numpy().astype(np.uint32)
    order = np.argsort(keys)
    return Idf(keys[order], common.column("df").to_numpy()[order] / max(1, n), n, rare)


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """Improved consistent weighted samples, (documents that have shingles, ``count``), as 32-bit fingerprints.

    For each sample and shingle: r and c are Gamma(2, 1) and b uniform, all from the shingle's hash; t = floor(ln w / r + b)
    and ln a = ln c - r (t - b + 1). The sample is the pair (shingle, t) of least a. Rows follow the documents in order.
    """
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    out = np.empty((len(begin), count), np.uint32)
    edges = [0]
    while edges[-1] < len(begin):  # blocks that stay in the processor's cache
        stop = np.searchsorted(begin, begin[edges[-1]] + 16384, side="right") - 1
        edges.append(max(int(stop), edges[-1] + 1) if stop < len(begin) - 1 else len(begin))
    bounds = np.append(begin, len(doc))
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, (count, 3), dtype=np.uint64) | np.uint64(1)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        lo, hi = bounds[a], bounds[b]
        x, lnw = shingle[lo:hi], np.log(weight[lo:hi]).astype(np.float32)
        groups = begin[a:b] - lo
        unit, half = np.float32(2.0**-16), np.float32(2.0**-17)
        for i in range(count):
            z = (x ^ odd[i, 2]) * odd[i, 0]
            z ^= z >> np.uint64(32)
            z *= odd[i, 1]
            z ^= z >> np.uint64(29)
            u = z.view(np.uint16).reshape(-1, 4).astype(np.float32)
            u *= unit
            u += half
            y = (z * odd[i, 2]) >> np.uint64(40)
            beta = y.astype(np.float32) * np.float32(2.0**-24)
            r = -np.log(u[:, 0] * u[:, 1])
            c = np.log(-np.log(u[:, 2] * u[:, 3]))
            t = np.floor(lnw / r + beta)
            c -= r * (t - beta + 1)
            sign = c.view(np.int32)
            rank = np.where(sign < 0, ~sign.view(np.uint32), sign.view(np.uint32) | np.uint32(1 << 31)).astype(np.uint64)
            low = (z >> np.uint64(32)) ^ (t.astype(np.int32).view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B1))
            rank <<= np.uint64(32)
            rank |= low & np.uint64(0xFFFFFFFF)
            out[a:b, i] = np.minimum.reduceat(rank, groups).astype(np.uint32)
    return out


def signatures(table: DataFrame, idf: Idf, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, words, bands)`` of each document that has words: a hash of its word sequence and its band keys."""
    spread = table.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches, "text"):
            raw, at = text_bytes(part.column(1))
            doc, key, count = shingles(raw, at, k)
            if not len(doc):
                continue
            own = np.unique(doc)
            s = samples(doc, key, spread.value.weights(key, count), bands * rows).reshape(len(own), bands, rows)
            folded = np.zeros((len(own), bands), np.uint64)
            for j in range(rows):
                folded = mix(folded * np.uint64(0x100000001B3) + s[:, :, j])
            w = Words.of(raw, at)
            h = w.hashes()
            names = [xxhash.xxh128_digest(h[w.first[d] : w.first[d] + w.counts[d]].tobytes()) for d in own]
            flat = pa.array(folded.view(np.int64).ravel())
            step = np.arange(len(own) + 1, dtype=np.int32)
            keys = pa.ListArray.from_arrays(pa.array(step * bands), flat)
            yield pa.record_batch([part.column(0).take(pa.array(own)), pa.array(names, pa.binary()), keys], ["id", "words", "bands"])

    return table.select("id", "text").mapInArrow(sign, "id long, words binary, bands array<long>")


def worded(table: DataFrame) -> DataFrame:
    """``(id, text, words)``: each text with the hash of its word sequence that ``signatures`` gives it."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches, "text"):
            w = Words.of(*text_bytes(part.column(1)))
            h = w.hashes()
            names = [xxhash.xxh128_digest(h[a : a + n].tobytes()) for a, n in zip(w.first, w.counts, strict=True)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(names, pa.binary())], ["id", "text", "words"])

    return table.select("id", "text").mapInArrow(name, "id long, text string, words binary")


def profiles(table: DataFrame, idf: Idf, k: int = SHINGLE) -> DataFrame:
    """``(id, total, profile)``: the weight of each document, and of its shingles in each of ``CLASSES`` classes, rounded up.

    What two documents share is at most the sum over the classes of the lesser weight, which bounds their similarity.
    """
    spread = table.sparkSession.sparkContext.broadcast(idf)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, key, count = shingles(*text_bytes(part.column(1)), k)
            weight, place = spread.value.weights(key, count), (key >> np.uint64(65 - CLASSES.bit_length())).astype(np.int64)
            for a in range(0, part.num_rows, 8192):  # bounds what the profiles take
                n = min(8192, part.num_rows - a)
                own = slice(*np.searchsorted(doc, [a, a + n]))
                whole = np.bincount(doc[own] - a, weight[own], n)
                split = np.bincount((doc[own] - a) * CLASSES + place[own], weight[own], n * CLASSES) * (1 + 1e-6)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * CLASSES), pa.array(split.astype(np.float32)))
                yield pa.record_batch([part.column(0).slice(a, n), pa.array(whole), lists], ["id", "total", "profile"])

    return table.select("id", "text").mapInArrow(weigh, "id long, total double, profile array<float>")


def similarities(table: DataFrame, pairs: DataFrame, idf: Idf, k: int = SHINGLE) -> DataFrame:
    """``(a, b, similarity)`` of distinct pairs ``(a, b)``: the weighted Jaccard similarity of their texts.

    Each text travels once to each block of at most about ``BLOCK_PAIRS`` partners, so a document with a third of all rows
    as partners is dealt over many blocks, and no row ever holds more than one text.
    """
    spread = table.sparkSession.sparkContext.broadcast(idf)
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_PAIRS).alias("blocks"))
    members = pairs.join(load, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.lit(1).alias("role"), F.col("b").alias("id"))
    pivots = load.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("a").alias("id"))
    wanted = members.unionByName(pivots)
    rows = table.select("id", "text").join(wanted, "id").select("a", "block", "role", "id", "text").repartition("a", "block").sortWithinPartitions("a", "block", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in slices(batches, "text"):
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            role = part.column(2).to_numpy()
            pivot = np.maximum.accumulate(np.where(role == 0, np.arange(len(role)), -1))
            held = part.slice(int(pivot[-1]), 1)
            doc, key, count = shingles(*text_bytes(part.column(4)), k)
            weight = spread.value.weights(key, count)
            total = np.bincount(doc, weight, len(role))
            member = np.flatnonzero(role == 1)
            if not len(member):
                continue
            # entries of each member beside those of its pivot
            first = np.searchsorted(doc, np.arange(len(role) + 1))
            n = np.diff(first)[pivot[member]]
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[pivot[member]], n)
            mine = np.flatnonzero(role[doc] == 1)
            pair = np.concatenate([doc[mine], np.repeat(member, n)])
            both, w = np.concatenate([key[mine], key[index]]), np.concatenate([weight[mine], weight[index]])
            order = np.lexsort((both, pair))
            pair, both, w = pair[order], both[order], w[order]
            same = np.flatnonzero((pair[1:] == pair[:-1]) & (both[1:] == both[:-1]))
            shared = np.bincount(pair[same], np.minimum(w[same], w[same + 1]), len(role))[member]
            union = total[member] + total[pivot[member]] - shared
            yield pa.record_batch([part.column(0).take(pa.array(member)), part.column(3).take(pa.array(member)), pa.array(shared / np.maximum(union, 1e-300))], ["a", "b", "similarity"])

    return rows.mapInArrow(compare, "a long, b long, similarity double")


def with_heads(buckets: DataFrame) -> DataFrame:
    """``(band, key, id, head, n)`` of the buckets with several members.

    The head is the member that meets most others over all bands, ties to the least id. A text near the middle of a group
    keeps more of its band keys than one with many edits, so most members of a large group link to its head directly.
    """
    sized = materialise(buckets.join(buckets.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), ["band", "key"]))
    met = sized.groupBy("id").agg(F.sum("n").alias("met"))
    heads = sized.join(met, "id").groupBy("band", "key").agg(F.max(F.struct("met", F.bitwise_not("id").alias("order"))).alias("best")).select("band", "key", F.bitwise_not("best.order").alias("head"))
    return sized.join(heads, ["band", "key"]).select("band", "key", "id", "head", "n")


def _roots(links: DataFrame) -> DataFrame:
    return materialise(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), materialise))


def settle(texts: DataFrame, keys: DataFrame, members: DataFrame, idf: Idf, similarity: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Links found among the members of the buckets, and the roots of their components.

    ``keys`` has (id, bands), ``members`` (band, key, id, head, n): all members of a bucket, its head and its size. A pair in one
    component needs no comparison, so comparisons go in rounds. First every member meets the head of its bucket. Then
    members outside the component that has most of the bucket meet about 8 drawn members of other components. What is
    still apart after that meets every member of another component, so no two members of a bucket are passed over but
    those that cannot be close: one minus the similarity is a metric, so two members whose similarities to the head
    differ by more than one minus the threshold cannot link, nor can two whose profiles do not allow it. A pair is written
    in the first band whose key it shares.
    """
    star = materialise(similarities(texts, members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), idf, k))
    known = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")  # a pair is in one order only
    links, known = known.where(F.col("similarity") >= similarity).select("a", "b"), known.select("a", "b")
    roots = _roots(links)
    to_head = star.select(F.col("a").alias("head"), F.col("b").alias("id"), "similarity")
    placed = materialise(members.join(to_head, ["head", "id"], "left").withColumn("similarity", F.when(F.col("id") == F.col("head"), 1.0).otherwise(F.col("similarity"))))
    traits = None
    for draw in (8, None):
        now = materialise(placed.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
        most = now.groupBy("band", "key", "root").agg(F.count("*").alias("c")).groupBy("band", "key").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
        now = now.join(most.select("band", "key", F.col("most.root").alias("major")), ["band", "key"])
        if traits is None:  # later rounds have no bucket that was settled here
            traits = materialise(profiles(texts.join(now.select("id").distinct(), "id"), idf, k).join(keys, "id"))
        now = now.join(traits, "id")
        minor = now.where("root <> major").select("band", "key", F.col("id").alias("x"), F.col("root").alias("xr"), F.col("similarity").alias("xs"), F.col("total").alias("xt"), F.col("profile").alias("xp"), F.col("bands").alias("xb"))
        drawn = now if draw is None else now.where(F.pmod(F.xxhash64("id", F.lit(draw)), F.col("n")) < draw)
        drawn = drawn.select("band", "key", F.col("id").alias("y"), F.col("root").alias("yr"), F.col("similarity").alias("ys"), F.col("total").alias("yt"), F.col("profile").alias("yp"), F.col("bands").alias("yb"), (F.col("root") == F.col("major")).alias("ymajor"))
        apart = F.abs(F.col("xs") - F.col("ys")) > 1 - similarity + 1e-9
        earlier = F.sequence(F.lit(0), F.col("band") - 1)
        met = (F.col("band") > 0) & F.exists(earlier, lambda i: F.get("xb", i) == F.get("yb", i))
        most_shared = F.aggregate(F.zip_with("xp", "yp", lambda a, b: F.least(a, b).cast("double")), F.lit(0.0), lambda n, x: n + x)
        # similar pairs share at least this part of both weights
        least_shared = (F.col("xt") + F.col("yt")) * (similarity / (1 + similarity) - 1e-9)
        close = (F.least("xt", "yt") >= least_shared) & ~met & (most_shared >= least_shared)
        meet = minor.join(drawn, ["band", "key"]).where((F.col("xr") != F.col("yr")) & (F.lit(draw is not None) | F.col("ymajor") | (F.col("x") < F.col("y"))) & ~apart & close)
        pairs = meet.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
        found = materialise(similarities(texts, materialise(pairs), idf, k))
        known = known.unionByName(found.select("a", "b"))
        fresh = found.where(F.col("similarity") >= similarity).select("a", "b")
        if fresh.head(1):
            links = links.unionByName(fresh)
            roots = _roots(links)
    return links, roots


def near_copies(table: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, copy_of, n_links)``: one row a distinct id.

    ``copy_of`` is the least id with the same words, ``class_id`` the least id of the class, ``n_links`` the links of that
    text to different texts that were verified. Null, empty and blank texts are classes of their own. Rows with a null id
    are left out. Rows that repeat an id are judged each by its own text, which may be the copy of another id's; the document
    takes the least ``copy_of`` of its texts, and the class of that one.
    """
    own = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    idf = document_frequency(own, k)
    signed = materialise(signatures(own, idf, k, bands, rows))
    least = materialise(signed.groupBy("words").agg(F.min("id").alias("copy_of"), F.min("bands").alias("bands")))
    # a word sequence goes by the least id that has it, and by its own hash if that id has several
    several = materialise(least.groupBy("copy_of").agg(F.count("*").alias("n")).where("n > 1").select("copy_of", F.lit(True).alias("several")))
    texts = least.join(several, "copy_of", "left").withColumn("id", F.when(F.col("several"), F.xxhash64("words")).otherwise(F.col("copy_of"))).drop("several")
    buckets = texts.select(F.posexplode("bands").alias("band", "key"), "id")
    members = materialise(with_heads(buckets))
    # the join is a shuffle at every size, as it is on a large corpus; all comparisons read from what it keeps
    wanted = texts.select("id", "copy_of", "words").join(members.select("id").distinct(), "id", "left_semi")
    needed = materialise(worded(own).withColumnRenamed("id", "copy_of").join(wanted.hint("merge"), ["copy_of", "words"]).groupBy("id").agg(F.min("text").alias("text")))
    links, roots = settle(needed, texts.select("id", "bands"), members, idf, similarity, k)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    if several.head(1):  # the class of a component is its least document, which is not its least node then
        nodes = roots.select("id", "root").union(roots.select("root", "root")).distinct()
        roots = nodes.join(nodes.join(texts.select("id", "copy_of"), "id").groupBy("root").agg(F.min("copy_of").alias("first")), "root").select("id", F.col("first").alias("root"))
    classes = texts.select("words", "id", "copy_of").join(roots, "id", "left").join(degree, "id", "left")
    classes = classes.select("words", "copy_of", F.coalesce("root", "copy_of").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    known = signed.select("id", "words").join(classes, "words").select(F.col("id").alias("doc_id"), "class_id", "copy_of", "n_links")
    silent = own.select("id").join(signed.select("id"), "id", "left_anti").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(silent).groupBy("doc_id").agg(F.min(F.struct("copy_of", "class_id", "n_links")).alias("c")).select("doc_id", "c.class_id", "c.copy_of", "c.n_links")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-copy class of every document."""
    return near_copies(documents(spark, sf_dir))
