"""Token ids in binary files of directly addressable codes.

Documents are sorted by id into shards, encoded, and written as segments of at least SEGMENT ids. A segment cuts its
ids into 8-bit chunks: level 0 has the lowest chunk of every id and a bit for each that goes on; level 1 has the next
chunk of those that go on, and so forth. A rank directory counts the ones before every 512 bits, so that any id is
read by one look at each level: its place on the next level is the number of continued ids before it. Nothing has
to be decoded around it. Segments are rows of uncompressed Parquet files (one for each shard), which Spark commits
task by task and reads from any store:

    shard, segment: numbers, ascending with the documents' ids
    start: ids before the segment in its shard; n: ids in the segment
    doc_ids, ends: the documents, and where each ends, in ids from the segment's start
    chunks, bits, ranks: for each level its bytes, its continuation bits (lowest first) and its directory (u32)

Cases: null and empty texts have just the end id. Null document ids come first; rows with equal ids are ordered by a
hash of the text. A document's ids never span two segments. Other columns are ignored.
"""

from __future__ import annotations

import os
import string
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, compress, filterfalse, pairwise
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorium.session import work_dir

from .common import small_batches

SEGMENT, RANK_BITS, END_ID = 1 << 16, 512, 2
#: Words remembered by a worker, of so many characters at most; then the tables are emptied.
MAX_WORDS, MAX_CHARS = 800_000, 64
#: New words that are encoded as one text.
JOINED = 256
SPACES, CUT = regex.compile(r"\s\s"), regex.compile(r"(?<=\S) (?=\S)")
#: A run of these after one of the letters and digits up to LATER (of scripts that Unicode has long had) is a token's start.
MARKS, LATER = string.punctuation, "\u0482"


class Encoder:
    """Encodes whole texts; words between single spaces or line ends, which the tokenizer never joins, are remembered.

    A word that follows a line end is kept with the line end before it. No other word begins with white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = {}  # of ids, whether their bytes begin with a space, or with a line end
        for mark, code in ((" ", "\u0120"), ("\n", "\u010a")):
            self.begins[mark] = np.zeros(max(vocabulary.values()) + 1, bool)
            self.begins[mark][[i for x, i in vocabulary.items() if x.startswith(code)]] = True
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as u32. Texts in which an added token stands are encoded as they are."""
        held = [k for k, t in enumerate(texts) if any(x in t for x in self.added)]
        if held:
            out = dict(zip(held, (np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([texts[k] for k in held], add_special_tokens=False)), strict=True))
            rest = iter(self.batch([t for k, t in enumerate(texts) if k not in out]))
            return [out[k] if k in out else next(rest) for k in range(len(texts))]
        parts = [t.replace("\n", " \n").split(" ") if not SPACES.search(t) and not t[:1].isspace() and not t[-1:].isspace() else CUT.split(t) for t in texts]
        first, later = self.first, self.later
        if len(later) + len(first) > MAX_WORDS:
            for known in (first, later, self.tails):
                known.clear()
        new = set(filterfalse(first.__contains__, [p[0] for p in parts]))
        first.update(zip(new, self.single(list(new)), strict=True))
        long = [(first, x) for x in new if len(x) > MAX_CHARS]  # words that aren't kept
        words = [x for p in parts for x in p[1:]]
        found = list(map(later.get, words))
        holes = list(compress(range(len(words)), map(not_, found)))
        new = {words[k] for k in holes}
        self.learn(new)
        for k in holes:
            found[k] = later[words[k]]
        long += [(later, x) for x in new if len(x) > MAX_CHARS]
        ends = list(accumulate((len(p) - 1 for p in parts), initial=0))
        out = [np.frombuffer(first[p[0]] + b"".join(found[a:e]), "<u4") for p, (a, e) in zip(parts, pairwise(ends), strict=True)]
        for known, x in long:
            del known[x]
        return out

    def single(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of u32."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: set[str]) -> None:
        """Remembers the ids of new words, each after its space or with its line end. Marks at a word's end are tokens
        of their own, so that such words are put together of what stands before the marks, and these."""
        later, tails, bases = self.later, self.tails, {}
        for x in new:
            base = x.rstrip(MARKS)
            if base and len(base) < len(x) <= MAX_CHARS and base[-1] < LATER and base[-1].isalnum():
                bases[x] = base
        whole = [x for x in new if x not in bases]
        whole += set(filterfalse(new.__contains__, filterfalse(later.__contains__, bases.values())))
        ends = list({t for x, base in bases.items() if (t := x[len(base) :]) not in tails})
        tails.update(zip(ends, self.single(ends), strict=True))
        later.update(self.words([x for x in whole if x[:1] != "\n"], " "))
        later.update(self.words([x for x in whole if x[:1] == "\n"], "\n"))
        later.update((x, later[base] + tails[x[len(base) :]]) for x, base in bases.items())

    def words(self, new: list[str], mark: str) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids after a space, or with its line end. Words are encoded as one text: a word's first
        token, and no other, begins with the mark. Those at the end of a text may end with other white space, and go
        alone, as do all words if their text has an added token or another number of beginnings."""
        alone = [x for x in new if x[-1:].isspace() or " " in x]
        if alone:
            apart = set(alone)
            new = [x for x in new if x not in apart]
        for k in range(0, len(new), JOINED):
            some = new[k : k + JOINED]
            text = "".join(some) if mark == "\n" else f" {' '.join(some)}"
            if not any(x in text for x in self.added):
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                starts = np.flatnonzero(self.begins[mark][ids])
                if len(starts) == len(some) and starts[0] == 0:
                    whole, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                    yield from zip(some, (whole[a:e] for a, e in pairwise(cuts)), strict=True)
                    continue
            alone += some
        if alone:
            yield from zip(alone, self.single(alone if mark == "\n" else [f" {x}" for x in alone]), strict=True)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bits and rank directories of each level."""
    chunks, bits, ranks = [], [], []
    while True:
        chunks.append((ids & 0xFF).astype(np.uint8).tobytes())
        on = ids > 0xFF
        packed = np.packbits(on, bitorder="little")
        bits.append(packed.tobytes())
        ones = np.add.reduceat(np.bitwise_count(packed).astype(np.uint32), np.arange(0, len(packed), RANK_BITS // 8)) if len(packed) else np.zeros(0, np.uint32)
        ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
        if not on.any():
            return chunks, bits, ranks
        ids = ids[on] >> 8


def token(chunks: list[bytes], bits: list[bytes], ranks: list[bytes], at: int) -> int:
    """The id at a place of a segment, by one look at each level."""
    out = shift = 0
    for c, b, r in zip(chunks, bits, ranks, strict=True):
        out |= c[at] << shift
        if not b[at >> 3] >> (at & 7) & 1:
            return out
        block = at // RANK_BITS
        inside = int.from_bytes(b[block * RANK_BITS // 8 : (at >> 3) + 1], "little") & ((1 << (at - block * RANK_BITS)) - 1)
        at = int.from_bytes(r[4 * block : 4 * block + 4], "little") + inside.bit_count()
        shift += 8
    raise ValueError("a continuation bit on the last level")


def unpack(chunks: list[bytes], bits: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out = np.frombuffer(chunks[0], np.uint8).astype("<u4")
    places = np.arange(len(out))
    for k, (c, b) in enumerate(zip(chunks[1:], bits[:-1], strict=True), 1):
        places = places[np.unpackbits(np.frombuffer(b, np.uint8), count=len(places), bitorder="little").astype(bool)]
        out[places] |= np.frombuffer(c, np.uint8).astype("<u4") << np.uint32(8 * k)
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encodes all rows and writes their ids in ascending order of id_col to the folder path."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("tie"))
    kind = dict(given.dtypes)["id"]
    dealt = given.repartitionByRange(shards, F.asc_nulls_first("id"), "tie").sortWithinPartitions(F.asc_nulls_first("id"), "tie").select("id", "text")
    id_type = given.limit(0).toArrow().schema.field("id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        number = start = held = 0
        ids: list = []
        found: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            whole = np.concatenate(found)
            ends = np.cumsum([len(x) for x in found])
            levels = pack(whole)
            values = [[shard], [number], [start], [len(whole)], [ids], [ends.tolist()], *[[x] for x in levels]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["shard", "segment", "start", "n", "doc_ids", "ends", "chunks", "bits", "ranks"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), enc.batch([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids.append(i)
                found.append(np.concatenate([x, end]))
                held += len(found[-1])
                if held >= SEGMENT:
                    yield segment()
                    number, start, held, ids, found = number + 1, start + held, 0, [], []
        if found:
            yield segment()

    out = dealt.mapInArrow(run, f"shard int, segment int, start long, n long, doc_ids array<{kind}>, ends array<long>, chunks array<binary>, bits array<binary>, ranks array<binary>")
    out.write.option("compression", "uncompressed").parquet(path)


def bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Of each shard (as many as partitions were asked for) the number of ids before it."""
    out, at = {}, 0
    for r in spark.read.parquet(path).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():
        out[r.shard] = at
        at += r.n
    return out


def tokens(wanted: DataFrame, path: str) -> DataFrame:
    """wanted (doc_id, place from 0 in the document) with the token there, each read by rank directory; places that
    the files don't have give no row. Only the index columns are read to find segments."""
    spark = wanted.sparkSession
    small_batches(spark)
    files = spark.read.parquet(path)
    index = files.select("shard", "segment", F.posexplode(F.arrays_zip(F.col("doc_ids").alias("doc"), F.col("ends").alias("end"))).alias("k", "x"), "ends")
    index = index.select("shard", "segment", F.col("x.doc").alias("doc_id"), F.coalesce(F.get("ends", F.col("k") - 1), F.lit(0)).alias("begin"), F.col("x.end").alias("end"))
    asked = wanted.select("doc_id", "place").join(index, wanted["doc_id"].eqNullSafe(index["doc_id"])).where((F.col("place") >= 0) & (F.col("begin") + F.col("place") < F.col("end")))
    asked = asked.select(wanted["doc_id"], "place", "shard", "segment", (F.col("begin") + F.col("place")).alias("at"))
    # places of one segment go to its levels in groups of a bounded size
    asked = asked.groupBy("shard", "segment", F.pmod(F.xxhash64("at"), F.lit(1024)).alias("g")).agg(F.collect_list(F.struct("doc_id", "place", "at")).alias("asked"))
    both = asked.join(files.select("shard", "segment", "chunks", "bits", "ranks"), ["shard", "segment"]).select("asked", "chunks", "bits", "ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = b.column(0)[k].values
                levels = [b.column(c)[k].as_py() for c in (1, 2, 3)]
                found = [token(*levels, at) for at in own.field("at").to_pylist()]
                yield pa.RecordBatch.from_arrays([own.field("doc_id"), own.field("place"), pa.array(found, pa.int64())], ["doc_id", "place", "token"])

    kinds = dict(wanted.dtypes)
    return both.mapInArrow(run, f"doc_id {kinds['doc_id']}, place {kinds['place']}, token long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, first_token of each document in the files.

    A document's first and last token are read by rank directory too, and must be those of the unpacked segment.
    """
    small_batches(spark)
    files = spark.read.parquet(path)
    base = bases(spark, path)
    kind = dict(files.dtypes)["doc_ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k] for n in ("shard", "start", "doc_ids", "ends", "chunks", "bits", "ranks")}
                levels = [row[n].as_py() for n in ("chunks", "bits", "ranks")]
                ids = unpack(*levels[:2])
                ends = row["ends"].values.to_numpy(zero_copy_only=False)
                starts = np.r_[0, ends[:-1]]
                sums = [zlib.crc32(ids[a:e].tobytes()) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                for places in (starts, ends - 1):
                    if [token(*levels, k) for k in places.tolist()] != ids[places].tolist():
                        raise ValueError(f"rank directory and codes differ in {path}")
                at = base[row["shard"].as_py()] + row["start"].as_py()
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(starts + at), pa.array(ends - starts), pa.array(sums, pa.int64()), pa.array(ids[starts], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "first_token"])

    return files.select("shard", "start", "doc_ids", "ends", "chunks", "bits", "ranks").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, first_token long")


def written(docs: DataFrame, tokenizer: str) -> str:
    """Writes docs to a new folder in the shared one and returns its path."""
    path = f"{work_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return path
