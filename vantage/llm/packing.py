"""Packing token pieces into fixed windows by minimum bin slack over a bitset subset-sum table."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.storage import documents, materialise
from vantage.llm.words import Words, gather_index, slices, string_array, text_bytes

WINDOW = 4096
END_ID = 2
#: Remainders that one packing group holds on average.
GROUP_ROWS = 4000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Punctuation that may be parted from the word before it; the apostrophe and the signs of special tokens may not.
_TAIL = np.zeros(256, bool)
_TAIL[list(b"!\"#$%&()*+,-./:;=?@[]^_`{}~")] = True
_WHOLE = np.zeros(256, bool)
_WHOLE[list(b"'<|>")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def units(raw: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, spans of units, and the units of each document.

    A word is one unit, or two: a body that ends in an ASCII letter or digit or a Latin-1 letter, and the ASCII
    punctuation after it. The vocabulary's own splitting parts them there too, and lower-cases every letter. A word
    with an apostrophe or a sign of a special token stays whole and as it is.
    """
    whole = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(_WHOLE[raw], out=whole[1:])
    plain = whole[w.ends] == whole[w.starts]
    body = w.ends.copy()
    open_ = np.flatnonzero(plain)
    while len(open_):
        open_ = open_[(body[open_] > w.starts[open_]) & _TAIL[raw[body[open_] - 1]]]
        body[open_] -= 1
    last = raw[np.maximum(body - 1, 0)]
    before = raw[np.maximum(body - 2, 0)]
    letter = _ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (body - 2 >= w.starts))
    body = np.where(letter & (body > w.starts), body, w.ends)
    two = body < w.ends
    n = 1 + two
    place = np.cumsum(n) - n
    starts, ends = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
    starts[place], ends[place] = w.starts, body
    starts[place[two] + 1], ends[place[two] + 1] = body[two], w.ends[two]
    lowered = _LOWER[raw]
    kept, _ = gather_index(w.starts[~plain], (w.ends - w.starts)[~plain])
    lowered[kept] = raw[kept]
    return lowered, starts, ends, np.append(place, len(starts))[np.append(w.first, len(place))]


class WordTokenizer:
    """Token ids of whole texts through a table of units.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its words in order. Units
    are encoded once and kept in an Arrow array of keys and flat arrays of ids, until ``keep`` are held.
    """

    def __init__(self, path: str, keep: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known = pa.array([], pa.large_binary())
        self.ids, self.stop = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encode(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other, and where each ends.

        Units of Latin letters alone are one word of the vocabulary, whose last id is marked as a word's end: they go in
        lines of a thousand, which costs less than a call for each.
        """
        letters = [bool(_LATIN.fullmatch(x)) for x in distinct]
        ids, n = [], np.zeros(len(distinct), np.int64)
        lines = [x for x, plain in zip(distinct, letters, strict=True) if plain]
        joined = [b" ".join(lines[row : row + 1000]).decode() for row in range(0, len(lines), 1000)]
        many = np.array([i for enc in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in enc.ids], np.int32)
        stop = np.flatnonzero(self.ends_word[many]) + 1
        if len(stop) != len(lines):  # this vocabulary splits such words: every unit goes alone
            letters, many, stop = [False] * len(distinct), many[:0], stop[:0]
        which = np.array(letters, bool)
        n[which] = np.diff(np.append(0, stop))
        other = [x.decode() for x, plain in zip(distinct, letters, strict=True) if not plain]
        for enc in self.tokenizer.encode_batch_fast(other, add_special_tokens=False):
            ids.append(enc.ids)
        n[~which] = [len(x) for x in ids]
        out = np.empty(int(n.sum()), np.int32)
        inside = np.repeat(which, n)
        out[inside], out[~inside] = many, np.array([i for x in ids for i in x], np.int32)
        return out, np.append(0, np.cumsum(n))

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive documents, one after the other, and how many each has."""
        w = Words.of(raw, at)
        if not len(w.starts):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        lowered, starts, ends, edge = units(raw, w)
        coded = string_array(lowered, starts, ends).dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        new = pc.filter(coded.dictionary, pc.is_null(found))
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, stop = self._encode(new.to_pylist())
        ids, stop = np.concatenate([self.ids, ids]), np.concatenate([self.stop, self.stop[-1] + stop[1:]])
        place[place < 0] = len(self.known) + np.arange(len(new))
        if len(self.known) < self.keep:
            self.known, self.ids, self.stop = pa.concat_arrays([self.known, new]), ids, stop
        place = place[coded.indices.to_numpy(zero_copy_only=False)]
        n = stop[place + 1] - stop[place]
        index, _ = gather_index(stop[place], n)
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        return ids[index], np.diff(total[edge])


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


def pieces(texts: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece_key, start, length, ids_crc32, doc_tokens)``: documents cut at multiples of ``window``.

    Null and empty texts are the end id alone. A row that comes twice is packed twice; ``piece_key`` numbers the pieces.
    """
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, piece_key = _tokenizer(path), TaskContext.get().partitionId() << 33
        for part in slices(batches, "text"):
            ids, counts = model.encode(*text_bytes(part.column(1)))
            out, a = [], 0
            for doc, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[a : a + n], end_id).astype("<u4")
                a += n
                for start in range(0, n + 1, window):
                    piece = own[start : start + window]
                    out.append((doc, piece_key, start, len(piece), zlib.crc32(piece.tobytes()), n + 1))
                    piece_key += 1
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [part.schema.field(0).type, *[pa.int64()] * 5], strict=True)], ["doc_id", "piece_key", "start", "length", "ids_crc32", "doc_tokens"])

    kind = texts.schema[id_col].dataType.simpleString()
    table = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return table.mapInArrow(cut, f"doc_id {kind}, piece_key long, start long, length long, ids_crc32 long, doc_tokens long")


def fill_window(counts: Counter[int], capacity: int, first: int) -> list[int]:
    """Lengths, ``first`` among them, that come closest to ``capacity``; ``counts`` has what is left.

    Bit s of ``reach`` is set if lengths seen so far can sum to s. A length with c copies enters as 1, 2, 4 ... copies, so
    that each step is one shift; the table of each step serves to trace the chosen counts back. The search ends when the
    window is full to the last place.
    """
    room = capacity - first
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, copies = min(counts[length] - (length == first), room // length), 1
        while left > 0:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, copies = left - take, copies * 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    chosen = [first]
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def pack_lengths(lengths: list[int], window: int) -> list[list[int]]:
    """Positions of ``lengths`` by window: each window starts with the longest one left."""
    held: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        held.setdefault(lengths[i], []).append(i)
    counts, order, out = Counter(lengths), sorted(set(lengths), reverse=True), []
    for longest in order:
        while counts[longest]:
            chosen = fill_window(counts, window, longest)
            counts.subtract(chosen)
            out.append([held[x].pop() for x in chosen])
    return out


def pack(cut: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; every piece is in one sequence.

    A piece as long as the window is a sequence by itself. Remainders are dealt by a hash of their row into groups of
    about ``group_rows``, whatever their document, source or length, and each group is packed by itself.
    """
    full = cut.where(F.col("length") >= window)
    rest = cut.where(F.col("length") < window)
    n = rest.count()
    groups = max(1, -(-n // group_rows))

    def of_group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece_key", "ascending")])
        lengths = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, members in enumerate(pack_lengths(lengths, window)):
            at = 0
            for i in members:
                sequence[i], offset[i] = key[0].as_py() << 32 | number << 1 | 1, at
                at += lengths[i]
        return table.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    packed = rest.withColumn("part", F.pmod(F.xxhash64("piece_key"), F.lit(groups))).groupBy("part").applyInArrow(of_group, schema)
    alone = full.withColumn("sequence_id", F.shiftleft("piece_key", 1))
    return packed.unionByName(alone.withColumn("offset", F.lit(0).cast("long")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens; one row a piece."""
    return pack(materialise(pieces(documents(spark, sf_dir)))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
