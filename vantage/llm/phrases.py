"""Collocations by Toivonen mining: a sample proposes phrases, whole passes count them and their negative border exactly.

A phrase can be frequent only if the phrases one word shorter, at its start and at its end, are. So a pass counts a phrase
if both of these are among the proposed: that covers the proposals and the border, the phrases that are no proposals though
all their parts are. A frequent phrase outside the proposals is a failure of the border: it joins the proposals, and another
pass counts the phrases that this lets in. When none is left, every frequent phrase has been counted, whatever the sample held.

The whole pass reads the texts twice. The first reading counts proposals and border by the head of their hash, which is never
less than the count of a phrase; the second counts by its words what reached the support by its head. So no rare phrase is
shuffled as text, and equal heads cannot change a count.

Proposals are kept as bits of a fixed number at most. A false bit only lets further phrases be counted, so the result does not
depend on it; with far more phrases than bits a pass counts all phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.llm.storage import documents, materialise
from vantage.llm.words import BASE, Words, gather_index, mix, slices, string_array, text_bytes

#: Bytes that end a piece, and blanks between words.
SEPARATORS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
LONGEST, SUPPORT, KEPT = 4, 30, 2000
#: A phrase with 100 * f >= 80 * a inside of a longer one with count f says nothing by itself.
ABSORBED = 80
#: One document in SAMPLE proposes, by phrases that it and others of the sample hold SAMPLE_SUPPORT times.
SAMPLE, SAMPLE_SUPPORT = 8, 2
#: The filter has a bit for each BIT_CHARS characters, 2**MOST_LOG bits (32 MB) at most.
BIT_CHARS, LEAST_LOG, MOST_LOG = 32, 16, 28
#: Text that one numpy pass counts; phrases that one record batch carries; bits of a segment of the filter.
PASS_BYTES, BATCH_ROWS, SEGMENT_LOG = 1 << 20, 1 << 16, 16
#: Counts that one task holds before it sends them, the most that such a count says, and the characters (as bits) of a bucket of them.
HELD_ROWS, MOST_HELD, BUCKET_LOG = 1 << 20, 255, 21
ANY = "und"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(SEPARATORS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split_words(raw: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of lower-cased texts, and a number for each that is equal for words of one piece only."""
    raw = _LOWER[raw]
    kind, n = _KIND[raw], len(raw)
    word = kind == 0
    edge = np.ones(n, bool)
    edge[1:] = ~word[:-1]
    edge[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(edge & word)
    edge = np.ones(n, bool)
    edge[:-1] = ~word[1:]
    edge[at[1:][at[1:] > 0] - 1] = True
    ends = np.flatnonzero(edge & word) + 1
    counts = np.diff(np.searchsorted(starts, at))
    words = Words(raw, starts, ends, np.repeat(np.arange(len(at) - 1), counts), counts, np.cumsum(counts) - counts)
    return words, np.searchsorted(np.flatnonzero(kind == 2), starts) + words.doc


def language_hashes(langs: list[str]) -> np.ndarray:
    raw, at = text_bytes(pa.array(langs, pa.string()))
    out = np.zeros(len(langs), np.uint64)
    for i in range(len(langs)):
        for b in raw[at[i] : at[i + 1]].astype(np.uint64):
            out[i] = mix(out[i : i + 1] * BASE + b + np.uint64(1))[0]
    return out


def extend(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of the phrase without its last word, and of the word."""
    return mix(prefix * BASE + word)


def phrase_hashes(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """The hashes by which the filter knows phrases, as ``count_phrases`` builds them word by word."""
    words, _ = split_words(*text_bytes(phrase))
    coded = lang.dictionary_encode()
    h = mix(words.hashes() ^ language_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()][words.doc])
    out = h[words.first]
    for j in range(1, LONGEST):
        more = np.flatnonzero(words.counts > j)
        out[more] = extend(out[more], h[words.first[more] + j])
    return out


@dataclass
class Filter:
    """A set of phrases as bits, two for each: it may hold phrases that were not put in, and never lacks one that was."""

    bits: np.ndarray
    log: int

    @staticmethod
    def empty(chars: int) -> Filter:
        log = min(MOST_LOG, max(LEAST_LOG, int(np.ceil(np.log2(max(1, chars / BIT_CHARS))))))
        return Filter(np.zeros(1 << (log - 3), np.uint8), log)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.log)
        return h >> shift, mix(h + np.uint64(1)) >> shift

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) for p in self.places(h))
        return (a & b & 1).astype(bool)

    def union(self, phrases: DataFrame) -> Filter:
        """With the phrases ``(lang, phrase)``, or hashes ``(h)``, put in. Segments of bits come to the driver, as many as the filter has."""
        held = Filter(np.zeros(0, np.uint8), self.log)

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0, np.uint32)
            for batch in batches:
                if batch.num_rows:
                    h = batch.column(0).to_numpy().view(np.uint64) if batch.num_columns == 1 else phrase_hashes(batch.column(0), batch.column(1))
                    found = held.places(h)
                    seen = np.union1d(seen, np.concatenate(found).astype(np.uint32))
            part = seen >> np.uint32(SEGMENT_LOG)
            for s in np.unique(part):
                own = (seen[part == s] & np.uint32((1 << SEGMENT_LOG) - 1)).astype("<u2")
                yield pa.record_batch([pa.array([s], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["segment", "places"])

        def fill(key: tuple, group: pa.Table) -> pa.Table:
            bits = np.zeros(1 << SEGMENT_LOG, bool)
            for raw in group.column("places").to_pylist():
                bits[np.frombuffer(raw, "<u2")] = True
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

        out, size = self.bits.copy(), 1 << (SEGMENT_LOG - 3)
        packed = phrases.select(*(["h"] if "h" in phrases.columns else ["lang", "phrase"])).mapInArrow(put, "segment int, places binary").groupBy("segment").applyInArrow(fill, "segment int, bits binary")
        for segment, raw in packed.collect():
            out[segment * size : (segment + 1) * size] |= np.frombuffer(raw, np.uint8)
        return Filter(out, self.log)


class Vocabulary:
    """The distinct (language, word) pairs of a pass, their hashes, and phrases of them as strings."""

    def __init__(self, words: Words, lang: np.ndarray, langs: list[str]):
        coded = string_array(words.raw, words.starts, words.ends).dictionary_encode()
        raw, self.at = text_bytes(coded.dictionary.cast(pa.large_string()))
        size = len(self.at) - 1
        # every word behind a blank
        self.text = np.full(len(raw) + size, 32, np.uint8)
        self.text[np.arange(len(raw)) + np.repeat(np.arange(size), np.diff(self.at)) + 1] = raw
        pairs, self.first, self.ids, self.counts = np.unique(lang[words.doc] * size + coded.indices.to_numpy(), return_index=True, return_inverse=True, return_counts=True)
        self.word, self.lang, self.langs = pairs % size, pairs // size, langs
        plain = Words(raw, self.at[:-1], self.at[1:], words.doc, words.counts, words.first).hashes()
        self.hash = mix(plain[self.word] ^ language_hashes(langs)[self.lang])

    def rows(self, start: np.ndarray, k: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``(lang, words, phrase, n)`` of the phrases of ``k`` words at the places ``start``."""
        for a in range(0, len(start), BATCH_ROWS):
            at = start[a : a + BATCH_ROWS]
            word = self.word[self.ids[at[:, None] + np.arange(k)]]
            begin, end = self.at[word] + word, self.at[word + 1] + word + 1
            begin[:, 0] += 1
            index, stop = gather_index(begin.ravel(), (end - begin).ravel())
            offsets = np.append(0, stop[k - 1 :: k]).astype(np.int32)
            phrase = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(self.text[index].tobytes())])
            lang = pa.array(self.langs, pa.string()).take(pa.array(self.lang[self.ids[at]]))
            yield pa.record_batch([lang, pa.array(np.full(len(at), k, np.int32)), phrase, pa.array(n[a : a + BATCH_ROWS].astype(np.int64))], ["lang", "words", "phrase", "n"])


def phrases_of_pass(texts: pa.Array, lang: pa.Array, new: Filter, old: Filter | None, lengths: range) -> Iterator[tuple[Vocabulary, np.ndarray, int, np.ndarray, np.ndarray]]:
    """In one pass, by length: vocabulary, first places, words, counts and hashes of the phrases that ``new`` lets in and ``old`` does not.

    All words of each language come first, as phrases of no word, if 1 is among the ``lengths``.
    """
    words, piece = split_words(*text_bytes(texts))
    if not len(words.starts):
        return
    coded = lang.dictionary_encode()
    of_doc, langs = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    v = Vocabulary(words, of_doc, langs)
    if 1 in lengths:
        n = np.bincount(of_doc[words.doc], minlength=len(langs))
        yield v, np.zeros(0, np.int64), 0, n, np.zeros(0, np.uint64)
        if old is None:
            yield v, v.first, 1, v.counts, v.hash
    total = len(words.starts)
    ids, h = v.ids.astype(np.int64), v.hash[v.ids]
    inside = new.has(v.hash)[v.ids]
    before = inside if old is None else old.has(v.hash)[v.ids]
    for k in range(2, lengths[-1] + 1):
        m = total - k + 1
        if m <= 0:
            return
        at = np.flatnonzero((piece[:m] == piece[k - 1 :]) & inside[:m] & inside[1 : m + 1])
        if not len(at):
            return
        codes, first, inverse, n = np.unique(ids[at] * len(v.word) + v.ids[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
        first = at[first]
        known = np.zeros(len(codes), bool) if old is None else before[first] & before[first + 1]
        own = extend(h[first], v.hash[v.ids[first + k - 1]])
        if k in lengths:
            yield v, first[~known], k, n[~known], own[~known]
        if k == lengths[-1]:
            return
        ids, h, inside = np.zeros(m, np.int64), np.zeros(m, np.uint64), np.zeros(m, bool)
        ids[at], h[at], inside[at] = inverse, own[inverse], new.has(own)[inverse]
        if old is not None:
            was, before = known & old.has(own), np.zeros(m, bool)
            before[at] = was[inverse]


def combined(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct heads, ascending, and their counts up to ``MOST_HELD`` from codes with a head above eight bits of count."""
    every = np.concatenate(codes)
    every.sort()
    heads = every >> np.uint64(8)
    first = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
    return heads[first], np.minimum(np.add.reduceat(every & np.uint64(MOST_HELD), first), MOST_HELD)


def frequent_heads(table: DataFrame, new: Filter, lengths: range, support: int, log: int) -> DataFrame:
    """``(h)``: heads of ``log + 32`` bits of the hashes of all phrases over ``table`` (lang, text) that ``new`` lets in and that reach ``support``.

    A head counts for all phrases that share it and counts stop at ``MOST_HELD``, as does the support here: no phrase that
    reaches it is missed, some others may be met. Counts travel as five bytes each, in buckets by the first ``log`` bits.
    """
    spread, shift, least = table.sparkSession.sparkContext.broadcast(new), np.uint64(32 - log), min(support, MOST_HELD)

    def pack(codes: list[np.ndarray]) -> pa.RecordBatch:
        heads, n = combined(codes)
        bucket = heads >> np.uint64(32)
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(heads))
        low, n = heads.astype("<u4"), n.astype(np.uint8)
        parts = list(zip(edge[:-1], edge[1:]))
        columns = [pa.array(bucket[edge[:-1]].astype(np.int64)), *(pa.array([x[i:j].tobytes() for i, j in parts], pa.binary()) for x in (low, n))]
        return pa.record_batch(columns, ["bucket", "heads", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text", PASS_BYTES):
            for _, _, k, n, h in phrases_of_pass(part.column(1), part.column(0), spread.value, None, lengths):
                if k and len(h):
                    held.append((h >> shift << np.uint64(8)) | np.minimum(n, MOST_HELD).astype(np.uint64))
                    size += len(h)
            if size >= HELD_ROWS:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        codes = [(np.frombuffer(h, "<u4").astype(np.uint64) << np.uint64(8)) | np.frombuffer(n, np.uint8) for h, n in zip(group.column("heads").to_pylist(), group.column("counts").to_pylist())]
        heads, n = combined(codes)
        whole = (heads[n >= least] | (np.uint64(key[0].as_py()) << np.uint64(32))) << shift
        return pa.table([pa.array(whole.view(np.int64))], ["h"])

    packed = table.select("lang", "text").mapInArrow(send, "bucket long, heads binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(merge, "h long")


def count_phrases(table: DataFrame, new: Filter, old: Filter | None, lengths: range, among: tuple[Filter, int] | None = None) -> DataFrame:
    """``(lang, words, phrase, n)`` over ``table`` (lang, text), of the phrases whose head is ``among`` (filter, bits beyond 32) if given; a row with 0 words has the words of a language if 1 is asked for."""
    spread = table.sparkSession.sparkContext.broadcast((new, old, among))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old, among = spread.value
        for part in slices(batches, "text", PASS_BYTES):
            for v, first, k, n, h in phrases_of_pass(part.column(1), part.column(0), new, old, lengths):
                if k == 0:
                    yield pa.record_batch([pa.array(v.langs, pa.string()), pa.array(np.zeros(len(n), np.int32)), pa.array([""] * len(n), pa.string()), pa.array(n)], ["lang", "words", "phrase", "n"])
                    continue
                if among is not None:
                    shift = np.uint64(32 - among[1])
                    kept = among[0].has(h >> shift << shift)
                    first, n = first[kept], n[kept]
                yield from v.rows(first, k, n)

    rows = table.select("lang", "text").mapInArrow(send, "lang string, words int, phrase string, n long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def outside(phrases: DataFrame, held: Filter) -> DataFrame:
    """The phrases that are not among the proposals and on which longer ones rest: failures of the border."""
    spread = phrases.sparkSession.sparkContext.broadcast(held)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~spread.value.has(phrase_hashes(batch.column(0), batch.column(1)))))

    return phrases.where(F.col("words").between(1, LONGEST - 1)).select("lang", "phrase").mapInArrow(sift, "lang string, phrase string")


def frequent_phrases(table: DataFrame, support: int = SUPPORT, sample: int = SAMPLE, sample_support: int = SAMPLE_SUPPORT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, int]:
    """``(lang, words, phrase, n)``: every phrase of up to four words with its exact count, if that is ``support`` or more; and the passes taken.

    Rows with 0 words hold the words of each language. The sample, one row in ``sample`` by a hash of id and text, grows with
    the table; it decides only how many passes are needed (four at most).
    """
    own = table.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(ANY)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("draw"))
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    proposed = Filter.empty(chars)
    drawn = materialise(own.where(F.pmod("draw", F.lit(sample)) == 0).select("lang", "text"))
    for k in range(1, LONGEST):
        proposed = proposed.union(count_phrases(drawn, proposed, None, range(k, k + 1)).where((F.col("words") == k) & (F.col("n") >= sample_support)))
    # most of the border is rare: it is counted by hash, and what may reach the support once more by its words
    log = min(24, max(8, int(chars).bit_length() - BUCKET_LOG))
    among = Filter(np.zeros_like(proposed.bits), proposed.log).union(frequent_heads(own, proposed, range(1, LONGEST + 1), support, log)), log
    found = materialise(count_phrases(own, proposed, None, range(1, LONGEST + 1), among).where((F.col("n") >= support) | (F.col("words") == 0)))
    failures, last, passes = materialise(outside(found, proposed)), found, 1
    while failures.head(1):
        wider = proposed.union(failures)
        last = materialise(count_phrases(own, wider, proposed, range(2, LONGEST + 1)).where(F.col("n") >= support))
        found, proposed, passes = found.unionByName(last), wider, passes + 1
        failures = materialise(outside(last, proposed))
    return found, passes


def collocations(found: DataFrame, kept: int = KEPT) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` from the counts of ``frequent_phrases``: the ``kept`` best of each language.

    All products are decimals of 38 digits. Every part of a frequent phrase is frequent, so its count is there to be joined.
    """
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    size = found.where("words = 0").select("lang", F.col("n").alias("total"))
    split = F.split("phrase", " ")
    few = materialise(found.where("words > 0").withColumn("w", split))
    several = few.where("words > 1")
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = several.select("lang", "phrase", "words", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    count = lambda name, n: few.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(count("head", "l"), ["lang", "head"]).join(count("tail", "r"), ["lang", "tail"])
    both = both.withColumn("x", exact("a")).withColumn("y", exact("l") + exact("r")).withColumn("score", F.expr("(2000000 * x) div y"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.score", "b.a", "b.l", "b.r")
    # the inner phrases of the longer ones, each with the highest count of one that holds it
    inner = several.where("words > 2").select("lang", "n", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "n", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("s"))
    holder = inner.select("lang", part(F.col("s"), F.col("m")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("f"))
    apart = best.join(holder, ["lang", "phrase"], "left").where(F.col("f").isNull() | (exact("f") * 100 < exact("a") * ABSORBED))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = apart.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept)
    return ranked.join(size, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of each language of all documents.

    Null texts and texts without a word hold no phrase, null languages are ``und``, repeated rows count as often as they
    stand there, ties are settled by the phrase's bytes, and a language without a frequent phrase has no row.
    """
    return collocations(frequent_phrases(documents(spark, sf_dir))[0])
