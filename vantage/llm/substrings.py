"""Removal of repeated passages: windows of words counted exactly in the buckets of their minimisers.

Consecutive windows of a document that share a minimiser travel as one packed string (a super-k-mer) to the bucket of that
minimiser, where sorting groups equal windows. Equal windows have equal minimisers, so each window is judged in one bucket.
A minimiser that too many windows share is split by what lies around it, down to the window itself (``route``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.storage import documents, materialise
from vantage.llm.words import Words, gather_index, mix, slices, string_array, text_bytes

WINDOW = 20
MINIMISER = 4
#: Words of the second minimiser, which splits a first one that is too frequent.
LONG_MINIMISER = 8
#: A minimiser is split above so many windows, or above this share of all: a bucket stays small, and the list of the split
#: ones has at most twice as many entries as ``LEAST_SHARE`` says, at any size of the corpus.
SPLIT_WINDOWS, LEAST_SHARE = 1 << 17, 1 << 20
#: One document in so many is counted to find them. The list only deals the work: windows are judged alike whatever it holds.
SAMPLE = 256
#: Text per bucket and per map-side pass. Both bound a task's memory, whatever the size of the corpus.
BUCKET_CHARS, PASS_BYTES = 1 << 20, 4 << 20
LAST = (1 << 63) - 1  # where a null id sorts
#: What tells documents apart, in their order: the id and, where the id alone does not tell, two hashes of the text.
KEY = ["_skid", "_skhigh", "_sklow"]
#: Ids that come with several texts are known by the slot of their hash, so the table of them has a fixed bound.
SLOTS = 1 << 16


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    have, out = 1, h
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(h) - width + 1], out[width - have :])


def repeats(words: Words, codes: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows in word order, and for each the start of the first equal one (itself if there is none).

    Windows of equal hash are compared word by word, so a collision of hashes changes nothing.
    """
    starts, keys = words.windows(hashes, window)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.flatnonzero(~new)
    a, b = starts[order[later]], starts[first[later]]
    same = np.ones(len(later), bool)
    for j in range(window):
        same &= codes[a + j] == codes[b + j]
    out = np.arange(len(starts))
    out[order[later[same]]] = first[later[same]]
    for i in order[later[~same]]:  # hashes collided: look among the windows of that hash for an equal one
        rivals = np.flatnonzero(keys[:i] == keys[i])
        mine = codes[starts[i] : starts[i] + window]
        out[i] = next((r for r in rivals if (codes[starts[r] : starts[r] + window] == mine).all()), i)
    return starts, out


def runs(position: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where a run of consecutive positions begins, all of ``same`` being constant inside it."""
    new = np.ones(len(position), bool)
    if len(position):
        new[1:] = position[1:] != position[:-1] + 1
        for x in same:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _packed(*columns: np.ndarray) -> bytes:
    return pa.compress(np.stack([np.asarray(c, np.int64) for c in columns]).tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, columns: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * columns * 8, "zstd", asbytes=True), np.int64).reshape(columns, n)


def numbered(keys: np.ndarray) -> np.ndarray:
    """A number for each column of the sorted ``keys``, equal for equal columns."""
    new = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    return np.append(0, np.cumsum(new)) if keys.shape[1] else np.zeros(0, np.int64)


def with_keys(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``table`` and ``KEY``, which is equal in two rows exactly if both id and text are.

    An id with one text needs no hash, and hashes do not compress: only ids with several texts, ids that share a slot with
    one, and null ids have them. That depends on the id alone, so all rows of an id agree.
    """
    text = F.col(text_col).cast("string")
    high, low = F.shiftrightunsigned(F.xxhash64(text), 1), F.xxhash64(F.lit(7), text)
    slot = F.pmod(F.xxhash64("_skid"), F.lit(SLOTS))
    known = table.withColumn("_skid", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)))
    hashes = known.where(F.col(id_col).cast("long").isNotNull()).select("_skid", high.alias("a"), low.alias("b"))
    texts = hashes.groupBy("_skid").agg(F.min("a").alias("a"), F.max("a").alias("a2"), F.min("b").alias("b"), F.max("b").alias("b2"))
    several = materialise(texts.where("a <> a2 OR b <> b2").select(slot.alias("_skslot")).distinct().withColumn("_skmany", F.lit(True)))
    marked = known.withColumn("_skslot", slot).join(F.broadcast(several), "_skslot", "left")
    null, many = F.col(id_col).cast("long").isNull(), F.coalesce("_skmany", F.lit(False))
    # a null id shares LAST with a real id at most, and sorts after it by the sign
    marked = marked.withColumn("_skhigh", F.when(null, high).when(many, F.bitwise_not(high)).otherwise(F.lit(-1).cast("long")))
    return marked.withColumn("_sklow", F.when(null | many, low).otherwise(F.lit(0).cast("long"))).drop("_skslot", "_skmany")


def least_gram(h: np.ndarray, m: int, window: int, salt: int = 0) -> np.ndarray:
    """For each window of the word hashes ``h`` the least mixed hash of its ``m``-word grams."""
    short = np.full(len(h) - m + 1, salt, np.uint64)
    for j in range(m):
        short = short * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - m + 1 + j]
    return minima(mix(short), window - m + 1)


def among(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which ``keys`` the sorted ``hot`` holds."""
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys if len(hot) else np.zeros(len(keys), bool)


def route(h: np.ndarray, starts: np.ndarray, window: int, m: int, hot: np.ndarray) -> np.ndarray:
    """The key by which each window travels: equal for equal windows, as it depends on their words and on ``hot`` alone.

    It is the minimiser; if ``hot`` holds that, both the minimiser and that of longer grams, which reach beyond a line that
    many documents share; if ``hot`` holds these two, the hash of the window.
    """
    key = least_gram(h, m, window)[starts]
    split = np.flatnonzero(among(key, hot))
    if len(split):
        key[split] = mix(key[split] ^ least_gram(h, min(LONG_MINIMISER, window), window, 1)[starts[split]])
        split = split[among(key[split], hot)]
        whole = np.zeros(len(split), np.uint64)
        for j in range(window):
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + h[starts[split] + j]
        key[split] = mix(whole)
    return key


def frequent_keys(table: DataFrame, window: int = WINDOW, m: int = MINIMISER, least: int = SPLIT_WINDOWS, sample: int = SAMPLE) -> np.ndarray:
    """The sorted keys of ``route`` that hold more than ``least`` windows and ``1 / LEAST_SHARE`` of all, estimated on one document in ``sample``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PASS_BYTES):
            w = Words.of(*text_bytes(part.column(part.schema.get_field_index("text"))))
            h = w.hashes()
            starts, _ = w.windows(h, window)
            if len(starts):
                first = least_gram(h, m, window)[starts]
                second = mix(first ^ least_gram(h, min(LONG_MINIMISER, window), window, 1)[starts])
                for level, keys in enumerate((first, second)):
                    key, n = np.unique(keys, return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(key), level, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["level", "key", "n"])

    seen = table.where(F.pmod(F.xxhash64(*KEY, "text"), F.lit(sample)) == 0).select("text").mapInArrow(count, "level int, key long, n long")
    counts = materialise(seen.groupBy("level", "key").agg(F.sum("n").alias("n")))
    every = counts.where("level = 0").agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > max(least / sample, every / LEAST_SHARE)).select("key").distinct().collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def super_kmers(table: DataFrame, buckets: int, window: int = WINDOW, m: int = MINIMISER, hot: np.ndarray | None = None) -> DataFrame:
    """``(bucket, n, size, meta, strings)``: super-k-mers packed by bucket, and verdicts reached on the way.

    ``table`` has ``KEY`` and ``text``; ``hot`` are the keys of ``frequent_keys``.

    Within a pass a window that repeats an earlier one is known to be a repeat, so it does not travel: only the first of
    its kind does. A passage that a third of the documents share thus reaches its bucket once a pass. Such verdicts go
    along with ``strings`` null: runs of (document, first window, windows).
    """

    hot = np.zeros(0, np.uint64) if hot is None else hot

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PASS_BYTES):
            keys = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(len(KEY))])
            order = np.lexsort(keys[::-1])
            part, keys = part.take(pa.array(order)), keys[:, order]
            same = numbered(keys)
            w = Words.of(*text_bytes(part.column(len(KEY))))
            h = w.hashes()
            codes = string_array(w.raw, w.starts, w.ends).dictionary_encode().indices.to_numpy()
            starts, first = repeats(w, codes, h, window)
            if not len(starts):
                continue
            del codes
            doc = w.doc[starts]
            place = starts - w.first[doc]
            # repeated rows of one id and text share place and id: such a copy is no earlier window
            repeat = (same[doc] != same[doc[first]]) | (place != place[first])
            repeat &= first != np.arange(len(first))
            out = []
            gone = np.flatnonzero(repeat)
            if len(gone):
                begin = runs(starts[gone], doc[gone])
                size = np.diff(np.append(begin, len(gone)))
                at = gone[begin]
                cover = mix((keys[0] ^ keys[2])[doc[at]].astype(np.uint64)) % np.uint64(buckets)
                for bucket in np.unique(cover):
                    own = cover == bucket
                    out.append((int(bucket), int(own.sum()), 0, _packed(*keys[:, doc[at[own]]], place[at[own]], size[own]), None))
            go = np.flatnonzero(first == np.arange(len(first)))
            here = starts[go]
            least = route(h, here, window, m, hot)
            begin = runs(here, doc[go], least)
            size = np.diff(np.append(begin, len(go)))
            bucket = (mix(least[begin]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            begin, size, bucket = begin[order], size[order], bucket[order]
            n_words = size + window - 1
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            raw = np.append(w.raw, np.uint8(32))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                word, stop = gather_index(here[begin[a:b]], n_words[a:b])
                index, end = gather_index(w.starts[word], w.ends[word] - w.starts[word] + 1)
                text = raw[index]
                text[end - 1] = 32
                text[end[stop - 1] - 1] = 10
                at = go[begin[a:b]]
                out.append((int(bucket[a]), int(b - a), len(text), _packed(*keys[:, doc[at]], place[at]), pa.compress(text.tobytes(), "zstd", asbytes=True)))
            if out:
                cols = zip(*out, strict=True)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["bucket", "n", "size", "meta", "strings"])

    return table.mapInArrow(cut, "bucket int, n int, size long, meta binary, strings binary")


def judge(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``KEY``, ``start`` and ``n``: runs of windows that also start earlier, from the super-k-mers of each bucket."""

    def of_bucket(table: pa.Table) -> pa.Table:
        found, metas, texts = [], [], []
        for n, size, meta, strings in zip(*(table.column(c).to_pylist() for c in ("n", "size", "meta", "strings")), strict=True):
            if strings is None:
                found.append(_unpacked(meta, n, len(KEY) + 2))
            else:
                metas.append(_unpacked(meta, n, len(KEY) + 1))
                texts.append(pa.decompress(strings, size, "zstd", asbytes=True))
        if texts:
            meta, raw = np.concatenate(metas, axis=1), np.frombuffer(b"".join(texts), np.uint8)
            stop = np.flatnonzero(raw == 10) + 1
            at = np.append(0, stop)
            order = np.lexsort(meta[::-1])  # by document and start: window order is then the order of "earlier"
            index, end = gather_index(at[:-1][order], np.diff(at)[order])
            meta, w = meta[:, order], Words.of(raw[index], np.append(0, end))
            codes = string_array(w.raw, w.starts, w.ends).dictionary_encode().indices.to_numpy()
            starts, first = repeats(w, codes, w.hashes(), window)
            line = w.doc[starts]
            place, same = meta[-1][line] + starts - w.first[line], numbered(meta[:-1])[line]
            gone = np.flatnonzero((first != np.arange(len(first))) & ((same != same[first]) | (place != place[first])))
            begin = runs(place[gone], same[gone])
            found.append(np.stack([*meta[:-1, line[gone[begin]]], place[gone[begin]], np.diff(np.append(begin, len(gone)))]))
        whole = np.concatenate(found, axis=1) if found else np.zeros((len(KEY) + 2, 0), np.int64)
        return pa.table([pa.array(c) for c in whole], [*KEY, "start", "n"])

    return packed.groupBy("bucket").applyInArrow(of_bucket, ", ".join(f"{c} long" for c in [*KEY, "start", "n"]))


def deduplicate(table: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT_WINDOWS, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``table`` and ``n_words``, ``n_removed``, ``kept``.

    ``split`` and ``sample`` say how buckets are dealt (``frequent_keys``); the result does not depend on them.

    ``kept`` has the words that are left, joined by one blank; null and empty texts have none. A null id sorts after all
    others. Rows that repeat both id and text count as one document: a window at the same place of a copy is not an earlier
    one, and each copy loses the same words. Rows of one id, or without an id, that differ in their texts are documents
    apart, in the order of a hash. Columns of the input that are named like a result or begin with ``_sk`` are replaced.
    """
    table = table.drop("n_words", "n_removed", "kept", *(c for c in table.columns if c.startswith("_sk")))
    keyed = with_keys(table, id_col, text_col)
    chars = table.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    texts = keyed.select(*KEY, F.col(text_col).cast("string").alias("text"))
    packed = super_kmers(texts, max(512, chars // BUCKET_CHARS), window, hot=frequent_keys(texts, window, least=split, sample=sample))
    gone = judge(packed, window).groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("_skruns"))
    joined = keyed.join(gone, KEY, "left").drop(*KEY)
    rest = [c for c in joined.columns if c != "_skruns"]
    at_text, at_runs = joined.columns.index(text_col), joined.columns.index("_skruns")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            w = Words.of(*text_bytes(part.column(at_text)))
            listed = part.column(at_runs)
            size = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = listed.flatten()
            cover = np.zeros(len(w.starts) + 1, np.int32)
            if len(flat):
                a = np.repeat(w.first, size) + flat.field(0).to_numpy()
                np.add.at(cover, a, 1)
                np.add.at(cover, a + flat.field(1).to_numpy() + window - 1, -1)
            kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
            count = np.bincount(w.doc[kept], minlength=part.num_rows) if len(kept) else np.zeros(part.num_rows, np.int64)
            index, end = gather_index(w.starts[kept], w.ends[kept] - w.starts[kept] + 1)
            text = np.append(w.raw, np.uint8(32))[index]
            text[end - 1] = 32
            edge = np.append(0, end)[np.append(0, np.cumsum(count))]
            whole = text.tobytes()
            strings = [whole[a : b - 1].decode() if b > a else "" for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            cols = [part.column(i) for i in range(part.num_columns) if i != at_runs]
            yield pa.record_batch([*cols, pa.array(w.counts), pa.array(w.counts - count), pa.array(strings, pa.string())], [*rest, "n_words", "n_removed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "_skruns") + ", n_words long, n_removed long, kept string"
    return joined.mapInArrow(keep, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated windows of 20 words."""
    table = documents(spark, sf_dir).select("doc_id", "text")
    return deduplicate(table).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
