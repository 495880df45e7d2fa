"""Fuzzy line dedup: SimHash of normalised lines, a join on pigeonhole blocks, edit distance, connected groups.

Lines are normalised (lower case, words joined by single spaces); every line with a word takes part, and equal
normalised lines are one class, whatever their length. A class has a SimHash of its different words (WORDS or more of
them), or of its different pairs of characters (fewer words than BOTH), or both in between, so that also lines of few
words, or of scripts without spaces, have one. Two classes are neighbours if a SimHash of one kind differs in at most
RADIUS of its first 64 bits and MORE of 31 further ones; neighbours are linked if their edit distance is at most a
fifth of the longer line's characters (a likeness of 0.8 or more). Of each connected group the occurrence with the
smallest (document id, line number) stays, all others are removed.

The search is exact: of BLOCKS blocks of the 64 bits, neighbours agree on BLOCKS - RADIUS at least, so that if the
blocks are dealt into BLOCKS - RADIUS - 1 sets, two agreeing blocks are in one set (pigeonhole). Each pair of blocks
within a set is a key. A bucket is sorted by line length, and compared within lengths that a link may have. What
leaves a bucket is a spanning forest of its neighbours, not its pairs. The texts of the classes that have neighbours
at all are then dealt by their connected parts, and verified there: a pair whose ends are already in one group is
skipped, and again only a spanning forest of the links goes on. Buckets and parts of more than a tile are cut into
tiles, and each pair of tiles is a task's work of its own. A part of many tiles is mostly one of lines that are strung
together by chance, with few neighbours each, and copies of its lines for each pair of tiles would grow with its square.
Its neighbours are found once more in buckets, each pair in the first bucket that both share; the bucket's lines, by
length, are cut into blocks, and a pair of blocks gets the lines only that have a neighbour across it. So a line goes to
no more places than it has neighbours, nor (the part is dealt by the way that takes fewer rows) than its part has tiles.

Comparisons in a bucket grow with the square of the lines (2 ** -10 of all pairs with these parameters). For larger
corpora take a smaller radius, which lets blocks be wider: keys and their width follow from radius and blocks.

Cases: null and empty texts have no lines; blank lines always stay. Null ids come after all others. Rows that are
equal in id and text count as one document and all get its decision. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.session import setting, unstash

from .common import WORD_TABLE, attach, components, fresh, keyed, lots, row_key, small_batches, stash
from .simhash import forest

RADIUS, MORE, BLOCKS = 8, 7, 13
#: Lines of so many words have a SimHash of words; those of fewer than BOTH one of pairs of characters.
WORDS, BOTH = 9, 12
#: Edits allowed: one for so many characters of the longer line.
CHARS_FOR_AN_EDIT = 5
#: Fingerprints of a bucket, and lines of a connected part, that a task compares at once.
TILE, PART = 1 << 17, 1 << 11
#: Tiles of a connected part; the neighbours of parts of more are found once more.
PART_TILES = 8
#: Rows of buckets that a task has about at most, and classes of which they are made at once.
TASK_ROWS, CLASSES_AT_ONCE = 1 << 21, 1 << 16
#: Bytes of lines that are split at once, and hashed at once.
SPLIT_AT_ONCE, HASHED_AT_ONCE = 1 << 18, 1 << 21
#: Of so many buckets (all, with the parameters above) a task counts the rows by itself.
FEW_BUCKETS = 1 << 16
#: Neighbours of a bucket that are joined into its forest at once.
PAIRS_AT_ONCE = 1 << 16
#: Bits of a line's length in a bucket row's key, and further bits of its SimHash.
CHAR_BITS, MORE_BITS = 17, 31
#: As WORD_TABLE without lower-casing; line ends stay.
TO_WORDS = bytes(0x0A if c == 0x0A else c if 0x41 <= c <= 0x5A else x for c, x in enumerate(WORD_TABLE))
LANES = 0x0101010101010101


class Lines:
    """The lines of texts that have words: their rows, numbers (nos), normalised bytes (norms), lengths in characters
    (chars), words and bytes (size). All that goes byte by byte is done by numpy for all lines at once."""

    def __init__(self, data: bytes, rows: np.ndarray, nos: np.ndarray) -> None:
        """data: lines, each with its end, out of TO_WORDS; rows and nos: those of each."""
        found = np.frombuffer(data, np.uint8)
        letter = found > 0x20
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if letter[0]:
            edges = np.r_[0, edges]
        starts, ends = edges[::2], edges[1::2]  # a line's end is no letter, so these are as many
        line = np.searchsorted(np.flatnonzero(found == 0x0A), starts)
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else line
        self.rows, self.nos = rows[line[first]], nos[line[first]]
        self.n_words = np.diff(np.r_[first, len(line)])
        self._first_word = first
        self._offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        letter[ends] = True  # one separator after each word
        text = found[letter]
        last = first + self.n_words - 1
        self._at, self._end = self._offsets[first] + first, self._offsets[last + 1] + last
        self._letters = text[text > 0x20]
        text[text == 0x0A] = 0x20
        self._text = text
        self._chars = np.r_[0, np.cumsum((text & 0xC0) != 0x80, dtype=np.int32)]
        self.chars = self._chars[self._end] - self._chars[self._at]
        self._bytes = text.tobytes()
        self.size = len(data)

    def norms(self) -> list[bytes]:
        return [self._bytes[a:e] for a, e in zip(self._at.tolist(), self._end.tolist(), strict=True)]

    def words(self, chosen: np.ndarray) -> pa.ListArray:
        every = pa.BinaryArray.from_buffers(pa.binary(), len(self._offsets) - 1, [None, pa.py_buffer(self._offsets), pa.py_buffer(self._letters)])
        some = every if chosen.all() else every.filter(pa.array(np.repeat(chosen, self.n_words)))
        return pa.ListArray.from_arrays(np.r_[0, np.cumsum(self.n_words[chosen])].astype(np.int32), some)

    def char_pairs(self, chosen: np.ndarray) -> pa.ListArray:
        """Each two neighbouring characters of the lines, or the one that a line has."""
        n = np.maximum(self.chars[chosen] - 1, 1)
        starts = np.flatnonzero((self._text & 0xC0) != 0x80)
        own = np.repeat(self._chars[self._at[chosen]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        begin = starts[own]
        # behind a line stands a separator's byte, so a pair's end is a character's start
        end = np.minimum(np.r_[starts, len(self._text), len(self._text)][own + 2], np.repeat(self._end[chosen], n))
        wide = end - begin
        offsets = np.r_[0, np.cumsum(wide)]
        data = self._text[np.repeat(begin - offsets[:-1], wide) + np.arange(offsets[-1])]
        every = pa.BinaryArray.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        return pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), every)


def lines_of(texts: list[str | None]) -> Iterator[Lines]:
    """The lines with words of the texts, some MB at a time, whatever the texts' lengths (a longer line is by itself)."""
    counts = np.array([1 + t.count("\n") if t else 1 for t in texts])
    rows = np.repeat(np.arange(len(texts)), counts)
    nos = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    data = ("\n".join([t.lower() if t else "" for t in texts]) + "\n").encode("utf-8").translate(TO_WORDS)
    at = line = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SPLIT_AT_ONCE else data.rfind(b"\n", at, at + SPLIT_AT_ONCE) + 1 or data.index(b"\n", at + SPLIT_AT_ONCE) + 1
        part = data[at:end]
        n = part.count(b"\n")
        found = Lines(part, rows[line : line + n], nos[line : line + n])
        if len(found.rows):
            yield found
        at, line = end, line + n


def simhashes(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of features' hashes (128 bits each) laid end to end, n to a list: the first 64 bits of their SimHash,
    and MORE_BITS further ones.

    Lanes of eight bits of a word are added at once, 255 features at most; longer lists are cut and added up.
    """
    cuts = (n + 254) // 255
    first = np.cumsum(cuts) - cuts  # each list's first cut
    starts = np.repeat(np.cumsum(n) - n, cuts) + 255 * (np.arange(cuts.sum()) - np.repeat(first, cuts))
    whole = len(starts) == len(n)
    out = []
    for words in (np.ascontiguousarray(h[:, 0]), h[:, 1].astype(np.uint32)):  # of the second half no more is wanted
        kind, wide = words.dtype.type, words.dtype.itemsize
        bits = np.zeros((len(n), 8 * wide), bool)
        for k in range(8):
            lanes = np.add.reduceat((words >> kind(k)) & kind(LANES & np.iinfo(kind).max), starts, dtype=kind).view(np.uint8).reshape(-1, wide)
            bits[:, k::8] = 2 * (lanes.astype(np.int64) if whole else np.add.reduceat(lanes, first, axis=0, dtype=np.int64)) > n[:, None]
        out.append(np.packbits(bits, axis=1, bitorder="little").view(kind)[:, 0].astype(np.uint64))
    return out[0], out[1] & np.uint64((1 << MORE_BITS) - 1)


def digests(features: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, features)), np.uint64).reshape(-1, 2)


def feature_hashes(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each list's different features, laid end to end, and how many these are. A feature is hashed once,
    however many lists have it."""
    coded = lists.flatten().dictionary_encode()
    sizes = np.diff(lists.offsets.to_numpy())
    own = coded.indices.to_numpy().astype(np.int64) + np.repeat(np.arange(len(sizes)) << 32, sizes)
    own.sort()
    own = own[np.r_[True, own[1:] != own[:-1]]]
    _, offsets, text = coded.dictionary.buffers()
    ends, text = np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1].tolist(), text.to_pybytes()
    return digests(text[a:e] for a, e in pairwise(ends))[own & 0xFFFFFFFF], np.bincount(own >> 32, minlength=len(sizes))


LINES = "no int, h1 long, h2 long, chars int, a long, ax long, b long, bx long"


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("__id"), *row_key(docs[id_col], docs[text_col]), docs[text_col].alias("__text"))


def hashed_lines(given: DataFrame) -> DataFrame:
    """__id, __k1, __k2 and LINES of each line with a word: its number, hash and length, and its SimHashes (a of words,
    b of pairs of characters; null where it has none)."""
    small_batches(given.sparkSession)

    def made(held: list[tuple[pa.RecordBatch, Lines]]) -> pa.RecordBatch:
        every = [lines for _, lines in held]
        h = digests(norm for lines in every for norm in lines.norms()).view(np.int64)
        columns = []
        for wanted, make in ((lambda n: n >= WORDS, Lines.words), (lambda n: n < BOTH, Lines.char_pairs)):
            chosen = [wanted(lines.n_words) for lines in every]
            lists = [make(lines, some) for lines, some in zip(every, chosen, strict=True) if some.any()]
            chosen = np.concatenate(chosen)
            values = np.zeros((2, len(h)), np.int64)
            if lists:
                values[:, chosen] = [x.view(np.int64) for x in simhashes(*feature_hashes(pa.concat_arrays(lists)))]
            columns += [pa.array(v, mask=~chosen) for v in values]
        own = pa.Table.from_batches([batch.take(pa.array(lines.rows)) for batch, lines in held]).combine_chunks().to_batches()[0]
        no, chars = (pa.array(np.concatenate(x), pa.int32()) for x in ([lines.nos for lines in every], [lines.chars for lines in every]))
        return pa.RecordBatch.from_arrays([*own.columns, no, pa.array(h[:, 0]), pa.array(h[:, 1]), chars, *columns], ["__id", "__k1", "__k2", "no", "h1", "h2", "chars", "a", "ax", "b", "bx"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in lots(batches, "__text"):
            for lines in lines_of(batch.column(3).to_pylist()):
                if held and sum(x.size for _, x in held) + lines.size > HASHED_AT_ONCE:
                    yield made(held)
                    held = []
                # the texts needn't be kept
                held.append((pa.RecordBatch.from_arrays(batch.columns[:3], ["__id", "__k1", "__k2"]), lines))
        if held:
            yield made(held)

    return given.mapInArrow(run, f"__id {dict(given.dtypes)['__id']}, __k1 long, __k2 long, {LINES}")


def line_texts(given: DataFrame) -> DataFrame:
    """__k1, __k2, no, norm of each line with a word. Whatever batches come, the lines of a few MB of text are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, "__text"):
            for lines in lines_of(batch.column(3).to_pylist()):
                own = batch.select([1, 2]).take(pa.array(lines.rows))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lines.nos, pa.int32()), pa.array(lines.norms(), pa.binary())], ["__k1", "__k2", "no", "norm"])

    return given.mapInArrow(run, "__k1 long, __k2 long, no int, norm binary")


def likely(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key may be wanted, to be joined exactly afterwards: of the wanted keys' hashes 20 bits are
    broadcast, which is a million small numbers at most, whatever the sizes of the frames."""
    slot = lambda c: F.pmod(F.xxhash64(F.lit(20), c), F.lit(1 << 20))
    slots = wanted.select(slot(wanted_key).alias("__slot")).distinct()
    return rows.withColumn("__slot", slot(key)).join(F.broadcast(slots), "__slot", "left_semi").drop("__slot")


def block_pairs(radius: int, blocks: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(first bit, width) of both blocks of each key."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    sets = blocks - radius - 1
    if sets < 1:
        raise ValueError("neighbours must agree on two blocks at least")
    return [tuple((cuts[i], cuts[i + 1] - cuts[i]) for i in pair) for s in range(sets) for pair in combinations(range(s, blocks, sets), 2)]


class Buckets:
    """The bucket rows (key, fp) of classes: one for each key of each SimHash. A key is its bucket's number, the line's
    length, and as many further bits of the SimHash as there is room for, so that one long sorts a bucket by length."""

    def __init__(self, radius: int, blocks: int) -> None:
        self.pairs = block_pairs(radius, blocks)
        self.bits = max(a + b for (_, a), (_, b) in self.pairs)
        self.room = min(MORE_BITS, 63 - (2 * len(self.pairs) - 1).bit_length() - self.bits - CHAR_BITS)
        if self.room < 0:
            raise ValueError("the blocks are too wide for a key of one long")
        self.low = CHAR_BITS + self.room

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, fps = [], []
        for kind, (a, ax) in enumerate((("a", "ax"), ("b", "bx"))):
            has = batch.column(a).is_valid()
            fp, more, chars = (batch.column(c).filter(has).to_numpy().astype(np.int64) for c in (a, ax, "chars"))
            rest = np.minimum(chars, (1 << CHAR_BITS) - 1) << self.room | more & ((1 << self.room) - 1)
            cut = lambda at, width, fp=fp: (fp >> at) & ((1 << width) - 1)
            for k, ((i, a), (j, b)) in enumerate(self.pairs):
                keys.append(((2 * k + kind) << self.bits | cut(i, a) << b | cut(j, b)) << self.low | rest)
                fps.append(fp)
        return np.concatenate(keys), np.concatenate(fps)

    def owners(self, batch: pa.RecordBatch) -> np.ndarray:
        """The number in the batch of the class that each of the rows is of."""
        return np.concatenate([np.tile(np.flatnonzero(batch.column(a).is_valid()), len(self.pairs)) for a in ("a", "b")])

    def first(self, bucket: int, apart: np.ndarray) -> np.ndarray:
        """Whether SimHashes of this bucket, that differ in these bits, agree on no key before the bucket's."""
        met = np.zeros(len(apart), bool)
        for (i, a), (j, b) in self.pairs[: bucket >> self.bits + 1]:
            met |= apart & np.uint64(((1 << a) - 1) << i | ((1 << b) - 1) << j) == 0
        return ~met

    def large(self, classes: DataFrame, tile: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of more than a tile, sorted, and how many tiles each has. They are at most as many as all rows
        have tiles."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, some = np.zeros(FEW_BUCKETS, np.int64), []
            for batch in batches:
                bucket = self.rows(batch)[0] >> self.low
                few = bucket < FEW_BUCKETS
                counts += np.bincount(bucket[few], minlength=FEW_BUCKETS)
                if not few.all():
                    some.append(np.unique(bucket[~few], return_counts=True))
            held = np.flatnonzero(counts)
            for bucket, n in [(held, counts[held]), *some]:
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

        counts = classes.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > tile)
        found = sorted(counts.select("bucket", F.ceil(F.col("n") / tile)).collect())
        return tuple(np.array([r[k] for r in found], np.int64) for k in (0, 1))

    def dealt(self, classes: DataFrame, tile: int, large: tuple[np.ndarray, np.ndarray], *own: str) -> DataFrame:
        """bucket, t (a pair of tiles, where the bucket is large), and the keys and fps of rows that belong there, as
        longs laid end to end: what many classes have for one place is one row. Own columns of the classes (longs) go
        with the rows."""
        buckets, tiles = large
        names = ["keys", "fps", *own]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in merged(batches, CLASSES_AT_ONCE):
                key, fp = self.rows(batch)
                rest = [batch.column(c).to_numpy()[self.owners(batch)] for c in own]
                bucket, t = key >> self.low, np.zeros(len(key), np.int64)
                if len(buckets):
                    at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
                    pieces = np.where(buckets[at] == bucket, tiles[at], 1)
                    mine = (((fp ^ key).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % pieces
                    k = np.repeat(np.arange(len(key)), pieces)
                    other = np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    t = np.minimum(mine[k], other) * pieces[k] + np.maximum(mine[k], other)
                    key, fp, bucket, rest = key[k], fp[k], bucket[k], [x[k] for x in rest]
                if not len(key):
                    continue
                small = bucket.astype(np.uint16) if bucket.max() < FEW_BUCKETS else bucket  # these are sorted faster
                order = np.lexsort((t, bucket)) if len(buckets) else np.argsort(small, kind="stable")
                bucket, t = bucket[order], t[order]
                first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (t[1:] != t[:-1])])
                ends = pa.py_buffer((8 * np.r_[first, len(bucket)]).astype(np.int32))
                laid = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(x[order])]) for x in (key, fp, *rest)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(t[first]), *laid], ["bucket", "t", *names])

        return classes.mapInArrow(run, ", ".join(["bucket long, t long", *(f"{c} binary" for c in names)]))

    def met(self, classes: DataFrame, tile: int, *own: str) -> DataFrame:
        """The rows of each bucket (and pair of its tiles) in one task, dealt()."""
        spark = classes.sparkSession
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CLASSES_AT_ONCE))
        count = classes.count()
        classes = classes.select("a", "ax", "b", "bx", "chars", *own)
        # a line has two SimHashes at most, but only one in a bucket
        large = self.large(classes, tile) if count > tile else (np.empty(0, np.int64),) * 2
        # a task sorts its own rows, which numpy does faster, so there are tasks enough that each has few
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * len(self.pairs) * count // TASK_ROWS + 1)
        return self.dealt(classes, tile, large, *own).repartition(tasks, "bucket", "t")

    def each(self, batches: Iterator[pa.RecordBatch], *own: str) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """Of a task's rows of met(): bucket, t, and the keys (sorted), fps and own columns of what is there, if two or more."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        n = np.concatenate([pc.binary_length(b.column("keys")).to_numpy() for b in held]) // 8
        t = np.repeat(np.concatenate([b.column("t").to_numpy() for b in held]), n)
        key, *rest = (np.concatenate([longs(b.column(c)) for b in held]) for c in ("keys", "fps", *own))
        held.clear()
        order = np.lexsort((key, t)) if t.any() else np.argsort(key)
        t, key, rest = t[order], key[order], [x[order] for x in rest]
        bucket = key >> self.low
        cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (t[1:] != t[:-1]), True]).tolist()
        for x, y in pairwise(cuts):
            if y - x > 1:
                yield int(bucket[x]), int(t[x]), [key[x:y], *(c[x:y] for c in rest)]

    def near(self, key: np.ndarray, fp: np.ndarray, radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The neighbours in a bucket."""
        return neighbours(fp.view(np.uint64), key & ((1 << self.room) - 1), key >> self.room & ((1 << CHAR_BITS) - 1), radius, most)


def merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if (n := sum(b.num_rows for b in held)) and (batch is None or n >= most):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held = []


def together(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of pairs put together until they are more than so many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for found in chain(pairs, [None]):
        if found is not None:
            held.append(found)
            n += len(found[0])
        if held and (found is None or n > most):
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0


def longs(laid: pa.BinaryArray) -> np.ndarray:
    """All the longs that the rows hold."""
    _, offsets, data = laid.buffers()
    ends = np.frombuffer(offsets, np.int32)[laid.offset : laid.offset + len(laid) + 1]
    return np.frombuffer(data, np.int64, (ends[-1] - ends[0]) // 8, ends[0]) if ends[-1] > ends[0] else np.empty(0, np.int64)


def neighbours(fp: np.ndarray, more: np.ndarray, chars: np.ndarray, radius: int, most: int, at_once: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of pairs (i, j), i < j, of neighbours; chars is sorted. The further bits, half as wide, are compared first,
    each row's with those of the rows right behind it (a view of windows, so nothing is compared in vain)."""
    n = len(fp)
    upto = np.searchsorted(chars, chars * CHARS_FOR_AN_EDIT // (CHARS_FOR_AN_EDIT - 1), "right")
    behind = upto - np.arange(1, n + 1)
    widest = int(behind.max(initial=0))
    more = np.r_[more.astype(np.uint32), np.zeros(widest, np.uint32)]
    size = max(at_once, widest)
    apart, count, near = np.empty(size, np.uint32), np.empty(size, np.uint8), np.empty(size, bool)
    at = 0
    while at < n - 1:
        wide = int(behind[at])
        if not wide:
            at += 1
            continue
        rows = min(n - 1 - at, at_once // wide or 1)
        wide = int(behind[at : at + rows].max())
        rows = min(rows, size // wide)
        windows = np.ndarray((rows, wide), np.uint32, more, 4 * (at + 1), (4, 4))
        x = apart[: rows * wide].reshape(rows, wide)
        np.bitwise_xor(more[at : at + rows, None], windows, out=x)
        np.bitwise_count(apart[: rows * wide], out=(c := count[: rows * wide]))
        np.less_equal(c, most, out=(ok := near[: rows * wide]))
        k = ok.nonzero()[0]
        i, j = np.divmod(k, wide)
        i += at
        j += i + 1
        ok = np.bitwise_count(fp[i] ^ fp[np.minimum(j, n - 1)]) <= radius
        i, j = i[ok], j[ok]
        ok = j < upto[i]
        if ok.any():
            yield i[ok], j[ok]
        at += rows


def forests(classes: DataFrame, radius: int, blocks: int, most: int, tile: int) -> DataFrame:
    """Edges (u, v) between fingerprints: of each bucket a spanning forest of its neighbours. Equal ones give u = v."""
    buckets = Buckets(radius, blocks)

    def done(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        same: list[np.ndarray] = []

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in together(buckets.near(key, fp, radius, most), PAIRS_AT_ONCE):
                same.append(np.unique(fp[i[fp[i] == fp[j]]]))
                yield i, j

        root = forest(len(fp), pairs())
        member = np.flatnonzero(root != np.arange(len(fp)))
        if not len(member):
            return None
        alike = np.unique(np.concatenate(same))
        u, v = np.concatenate([fp[member], alike]), np.concatenate([fp[root[member]], alike])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (key, fp) in buckets.each(batches):
            if (out := done(key, fp)) is not None:
                yield out

    return buckets.met(classes, tile).mapInArrow(run, "u long, v long")


def cells(lines: DataFrame, radius: int, blocks: int, most: int, tile: int, part: int) -> DataFrame:
    """lines (line, fp, more, chars), each with a place (root, t1, t2) for each pair of blocks of a bucket across which it has a
    neighbour, and its own block (t): root, t1, t2, t, line, fp. A pair of neighbours is in the first bucket that both share."""
    buckets = Buckets(radius, blocks)
    none = F.lit(None).cast("long")
    classes = lines.select(F.col("fp").alias("a"), F.col("more").alias("ax"), none.alias("b"), none.alias("bx"), "chars", "line")

    def placed(bucket: int, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, own block and both blocks of each place."""
        n, size = len(key), -(-len(key) // part)
        held: list[np.ndarray] = [np.empty(0, np.int64)]
        for i, j in together(buckets.near(key, fp, radius, most), PAIRS_AT_ONCE):
            new = buckets.first(bucket, (fp[i] ^ fp[j]).view(np.uint64))
            i, j = i[new], j[new]
            cell = (i // part * size + j // part) * n
            held += [cell + i, cell + j]
            if sum(map(len, held[1:])) > max(PAIRS_AT_ONCE, len(held[0])):
                held = [np.unique(np.concatenate(held))]
        cell, row = np.divmod(np.unique(np.concatenate(held)), n)
        return row, row // part, cell // size, cell % size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, t, (key, fp, line) in buckets.each(batches, "line"):
            row, *own = placed(bucket, key, fp)
            if len(row):
                own, t1, t2 = (t << 32 | x for x in own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), bucket)), *map(pa.array, (t1, t2, own, line[row], fp[row]))], ["root", "t1", "t2", "t", "line", "fp"])

    return buckets.met(classes, tile, "line").mapInArrow(run, "root long, t1 long, t2 long, t long, line long, fp long")


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most so much: equal ends cut off, then a column of the table as bits of one number."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    n, s = len(b), 0
    while s < n and a[s] == b[s]:
        s += 1
    e = 0
    while e < n - s and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[s : len(a) - e], b[s : n - e]
    if len(a) <= most:
        return True
    places: dict[str, int] = {}
    for k, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << len(b)) - 1, 1 << len(b) >> 1
    up, down, score, left = full, 0, len(b), len(a)
    for c in a:
        eq = places.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more = down | ~(diagonal | up) & full
        less = up & diagonal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        left -= 1
        if score - left > most:
            return False
        more = more << 1 | 1
        less <<= 1
        up = (less | ~(diagonal | more)) & full
        down = more & diagonal & full
    return score <= most


#: Words of either line that an alignment may pass over at once, few first.
PASSED = sorted(((i, j) for i in range(7) for j in range(7) if i or j), key=lambda x: (sum(x), abs(x[0] - x[1])))


def surely_within(a: list[str], b: list[str], most: int) -> bool:
    """Whether so many edits are enough by a plain alignment of words: equal ones in a row, and between them a few words of
    either line, of which the longer text is counted. False says nothing."""
    x = y = cost = 0
    m, n = len(a), len(b)
    while x < m and y < n:
        if a[x] == b[y]:
            x += 1
            y += 1
            continue
        at = next(((i, j) for i, j in PASSED if x + i < m and y + j < n and a[x + i] == b[y + j]), None)
        if at is None:
            return False
        i, j = at
        # a space goes with each word
        cost += max(sum(map(len, a[x : x + i])) + i, sum(map(len, b[y : y + j])) + j)
        if cost > most:
            return False
        x, y = x + i, y + j
    return cost + max(sum(map(len, a[x:])) + m - x, sum(map(len, b[y:])) + n - y) <= most


def verified(lines: DataFrame, radius: int, most: int) -> DataFrame:
    """lines (root, t1, t2, t, line, fp, more, chars, norm), dealt by their first three: edges (u, v) between lines, a
    spanning forest of the links of each pair of tiles."""
    cols = ["root", "t1", "t2"]
    dealt = lines.select(*cols, "t", "line", "fp", "more", "chars", "norm").repartition(*cols).sortWithinPartitions(*cols, "chars")
    lines.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")

    def near(fp: list[int], further: list[int], chars: list[int]) -> Iterator[tuple[int, int]]:
        if len(fp) > 24:
            for i, j in neighbours(np.array(fp, np.int64).view(np.uint64), np.array(further, np.int64), np.array(chars, np.int64), radius, most):
                yield from zip(i.tolist(), j.tolist(), strict=True)
            return
        for i, j in combinations(range(len(fp)), 2):
            if chars[j] * (CHARS_FOR_AN_EDIT - 1) <= chars[i] * CHARS_FOR_AN_EDIT and ((fp[i] ^ fp[j]) & (1 << 64) - 1).bit_count() <= radius and (further[i] ^ further[j]).bit_count() <= most:
                yield i, j

    def links(group: list[list]) -> list[tuple[int, int]]:
        _, t1, t2, own, line, fp, further, chars, norm = group
        across, top = t1[0] != t2[0], list(range(len(line)))
        text: dict[int, str] = {}

        def root(k: int) -> int:
            while top[k] != k:
                top[k] = k = top[top[k]]
            return k

        out = []
        for x, y in near(fp, further, chars):
            if line[x] == line[y] or across and own[x] == own[y] or (p := root(x)) == (q := root(y)):
                continue
            a, b = (text.get(k) or text.setdefault(k, norm[k].decode()) for k in (x, y))
            most = max(len(a), len(b)) // CHARS_FOR_AN_EDIT
            if surely_within(a.split(" "), b.split(" "), most) or within(a, b, most):
                top[max(p, q)] = min(p, q)
                out.append((line[x], line[y]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[list] = [[] for _ in range(9)]
        for b in batches:
            found: list[tuple[int, int]] = []
            columns = [c.to_pylist() for c in b.columns]
            keys = list(zip(*columns[:3], strict=True))
            for k, key in enumerate(keys):
                if group[0] and key != (group[0][0], group[1][0], group[2][0]):
                    found += links(group)
                    group = [[] for _ in range(9)]
                for held, c in zip(group, columns, strict=True):
                    held.append(c[k])
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])
        found = links(group) if group[0] else []
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_lines(given: DataFrame, classes: DataFrame, radius: int = RADIUS, more: int = MORE, blocks: int = BLOCKS, tile: int = TILE, part: int = PART) -> DataFrame:
    """The connected groups (node, root) of linked classes, of those that have a link."""
    edges = stash(forests(classes, radius, blocks, more, tile).distinct(), "near-hashes")
    found = components(edges, "u", "v")
    alike = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    roots = stash(found.unionByName(alike.join(found.select("node"), "node", "left_anti")), "near-parts")
    kinds = [classes.where(F.col(fp).isNotNull()).select(F.col(fp).alias("fp"), F.col(x).alias("more"), "line", "chars", "first.__k1", "first.__k2", "first.no") for fp, x in (("a", "ax"), ("b", "bx"))]
    member = likely(kinds[0].unionByName(kinds[1]), "fp", roots, "node").join(roots.withColumnRenamed("node", "fp"), "fp")
    member = stash(member, "near-lines")
    sizes = stash(member.groupBy("root").agg(F.count("*").alias("m")), "part-sizes")
    place = ["__k1", "__k2", "no"]
    docs = likely(given, "__k1", member, "__k1")
    texts = line_texts(docs).withColumn("__place", F.xxhash64(*place))
    wanted = member.select(*place, "line").distinct()
    texts = likely(texts, "__place", wanted.select(F.xxhash64(*place).alias("__place")), "__place").drop("__place")
    texts = stash(texts.join(wanted, place).dropDuplicates(place).select("line", "norm"), "line-texts")
    pieces = F.ceil(F.col("m") / part)
    wide = sizes.where(pieces > PART_TILES)  # of them there are few
    cut, few = [], None
    if not wide.isEmpty():
        big = member.join(F.broadcast(wide.select("root")), "root").select(F.col("root").alias("part"), "line", "fp", "more", "chars")
        places = stash(cells(big, radius, blocks, more, tile, part), "cells")
        cut = [places, stash(places.join(big, ["line", "fp"]), "part-cells")]
        rows = cut[1].groupBy("part").agg(F.count("*").alias("n"))
        few = stash(rows.join(wide, rows["part"] == wide["root"]).where(F.col("n") < F.col("m") * pieces).select("root"), "parts-in-cells")
        cut.append(few)
    sized = attach(member, sizes, ["root"], "m").where("m > 1")
    if few is not None:
        sized = sized.join(F.broadcast(few), "root", "left_anti")
    sized = sized.withColumn("t", F.pmod(F.xxhash64("line"), pieces))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda x: F.struct(F.least("t", x).alias("t1"), F.greatest("t", x).alias("t2")))
    cols = ["root", "t1", "t2", "t", "line", "fp", "more", "chars", "norm"]
    placed = sized.withColumn("pairs", pairs).join(texts, "line").select("*", F.explode("pairs").alias("x")).select("*", "x.t1", "x.t2")
    found = verified(placed.select(*cols), radius, more)
    if few is not None:
        placed = cut[1].join(F.broadcast(few.withColumnRenamed("root", "part")), "part", "left_semi").join(texts, "line")
        found = found.unionByName(verified(placed.select(*cols), radius, more))
    links = stash(found, "links")
    out = components(links, "u", "v")
    unstash(edges, roots, member, sizes, texts, links, *cut)
    return out


def decided(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """h1, h2, n, first of each class that isn't one line in a group of its own: first is its group's least occurrence."""
    grouped = stash(roots.join(classes.select(F.col("line").alias("node"), "h1", "h2", "first", "n"), "node"), "grouped")
    best = stash(grouped.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("m")), "best-lines")
    joined = attach(grouped.select("root", "h1", "h2", "n"), best, ["root"], "m").select("h1", "h2", "n", F.col("best").alias("first"))
    alone = classes.where("n > 1").join(grouped.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", "n", "first")
    return stash(joined.unionByName(alone), "line-groups")


def grouped_lines(given: DataFrame, **how: int) -> tuple[DataFrame, DataFrame]:
    """The lines, and decided() of their classes."""
    lines = stash(hashed_lines(given), "lines")
    first = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "__k1", "__k2", "no")
    # equal lines have equal SimHashes and lengths
    same = [F.max(c).alias(c) for c in ("chars", "a", "ax", "b", "bx")]
    classes = lines.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count("*").alias("n"), *same)
    classes = stash(classes.withColumn("line", F.monotonically_increasing_id()), "line-classes")
    found = decided(classes, near_lines(given, classes, **how))
    unstash(classes)
    return lines, found


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """__k1, __k2 and removed (sorted line numbers from 0) of each document that loses lines."""
    given = prepared(docs, id_col, text_col)
    # a table's shuffle files go when it is written, not when the driver happens to collect its garbage
    with setting(docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        lines, found = grouped_lines(given, **how)
    some = likely(lines.select("__k1", "__k2", "no", "h1", "h2"), "h1", found, "h1")
    hit = attach(some, found, ["h1", "h2"], "n")
    lost = hit.where((F.col("__k1") != F.col("first.__k1")) | (F.col("__k2") != F.col("first.__k2")) | (F.col("no") != F.col("first.no")))
    return lost.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_set("no")).alias("removed"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """doc_id, n_lines, n_kept, removed of each row."""
    rows = docs.select(docs[id_col].alias("doc_id"), *row_key(docs[id_col], docs[text_col]), F.coalesce(F.when(docs[text_col] != "", 1 + F.octet_length(docs[text_col]) - F.octet_length(F.replace(docs[text_col], F.lit("\n"), F.lit("")))), F.lit(0)).cast("long").alias("n_lines"))
    found = rows.join(removals(docs, id_col, text_col, **how), ["__k1", "__k2"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size(removed)).alias("n_kept"), removed.alias("removed"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """docs with the texts without their removed lines, all other columns as they were."""
    own, (k1, k2) = keyed(docs, id_col, text_col)
    (gone,) = fresh(own, "__removed")
    lost = removals(docs, id_col, text_col, **how).select(F.col("__k1").alias(k1), F.col("__k2").alias(k2), F.col("removed").alias(gone))
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, k: ~F.array_contains(F.col(gone), k))
    text = F.when(F.col(gone).isNotNull(), F.array_join(lines, "\n")).otherwise(F.col(text_col))
    return own.join(lost, [k1, k2], "left").withColumn(text_col, text).select(*docs.columns)
