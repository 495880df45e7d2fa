"""SentencePiece encoding and decoding for models of merge (BPE) type, by backtracking.

A text is cut where no piece can reach across: before a space mark that follows another character. For each part an
Aho-Corasick scan gives the longest piece at a position. It must be compatible with the piece before, which is
tested by merging the two pieces' characters anew: the result must be the two pieces. Else the next shorter piece is
tried; if none fits, the position is marked in a bitfield as failed and the piece before is taken back and shortened.
As every prefix has just one valid encoding, a failed position never has to be visited again, and what is left at the
end is the encoding that merging by score gives. Parts are remembered in a bounded table, as words repeat.

Characters that no piece holds become byte pieces (or the unknown piece, in models without them).

Cases: null and empty texts give the end id only, and decode to an empty text. Only identity-normalised models with
prefix spaces (or without) are accepted; others raise ValueError rather than differ from the library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

SPACE = "▁"
#: Parts remembered by a worker, of so many characters at most; then the table is emptied.
MAX_PARTS, MAX_CHARS = 500_000, 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """A model read from its file, with encode and decode."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("only identity-normalised merge-type models without user-defined pieces are supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.kinds, self.pieces = [p.type for p in model.pieces], [p.piece for p in model.pieces]
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.unk_surface = train.unk_surface
        self.end = next((k for k, p in enumerate(model.pieces) if p.piece == train.eos_piece), -1)
        if any(b == SPACE != a for p in self.ids for a, b in pairwise(p)):
            raise ValueError("pieces with a space mark after another character are not supported")
        self.found = ahocorasick.Automaton()
        for p in self.ids:
            self.found.add_word(p, p)
        self.found.make_automaton()
        # of each piece its longest shorter prefix that is a piece, or else its first character
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), p[0]) for p in self.ids if len(p) > 1}
        self.fits: dict[tuple[str, str], bool] = {}
        self.surface = [p.replace(SPACE, " ") if t == NORMAL else None for p, t in zip(self.pieces, self.kinds, strict=True)]

    def merge(self, text: str) -> list[str]:
        """Merging by score: the pair with the best score first, the leftmost of equal ones."""
        now, score = list(text), self.score
        while True:
            best = max(((score[x], -k) for k, (a, b) in enumerate(pairwise(now)) if (x := a + b) in score), default=None)
            if best is None:
                return now
            k = -best[1]
            now[k : k + 2] = [now[k] + now[k + 1]]

    def compatible(self, a: str, b: str) -> bool:
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= MAX_PARTS:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def longest(self, part: str, pos: int) -> str:
        """The longest piece at a position, or else its character."""
        for end, p in self.found.iter_long(part, pos):
            return p if end + 1 - len(p) == pos else part[pos]
        return part[pos]

    def tokens(self, part: str) -> list[str]:
        """The pieces of a part (or single characters without a piece) by backtracking."""
        n, pos, last = len(part), 0, ""
        out: list[str] = []
        failed = bytearray(n // 8 + 1)
        fits, shorter = self.fits, self.shorter
        t = self.longest(part, 0) if n else ""
        while pos < n:
            while t and (failed[(to := pos + len(t)) >> 3] >> (to & 7) & 1 or not (fits.get((last, t)) or self.compatible(last, t))):
                t = shorter.get(t, "")
            if t:
                out.append(t)
                pos, last = to, t
                if pos < n:
                    t = self.longest(part, pos)
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                t = out.pop()
                pos -= len(t)
                last = out[-1] if out else ""
        return out

    def ids_of(self, part: str) -> list[int]:
        """The ids of a part that begins where no piece reaches across."""
        out: list[int] = []
        for t in self.tokens(part):
            if t in self.ids:
                out.append(self.ids[t])
            elif self.byte_ids:
                out += [self.byte_ids[c] for c in t.encode()]
            else:
                out.append(self.unknown)
        return out

    def words(self, text: str) -> Iterator[str]:
        """The text's parts between which spaces stand, marks included."""
        whole = self.prefix + text.replace(" ", SPACE) if text else ""
        first, *rest = whole.split(SPACE)
        if first:
            yield first
        held = ""
        for x in rest:
            held += SPACE
            if x:
                yield held + x
                held = ""
        if held:
            yield held

    def encode(self, text: str) -> list[int]:
        return [k for w in self.words(text) for k in self.ids_of(w)]

    def decode(self, ids: list[int]) -> str:
        out, held, start = [], bytearray(), True
        for k in ids:
            kind = self.kinds[k]
            if kind == BYTE:
                held.append(int(self.pieces[k][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held, start = bytearray(), False
            if kind == CONTROL:
                continue
            p = self.unk_surface if kind == UNKNOWN else self.pieces[k]
            if start and self.prefix and p.startswith(SPACE):
                p = p[1:]
            start = False
            out.append(p.replace(SPACE, " "))
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)


class Coder:
    """Encodes whole documents and decodes their ids, remembering for each part its ids in decimal form and their text."""

    def __init__(self, path: str):
        self.model = Pieces(path)
        self.bare: dict[str, tuple[str, str]] = {}
        self.marked: dict[str, tuple[str, str]] = {}
        # put before a part so that its first space is not the document's first, which decoding takes away
        self.start = [next(k for k, p in enumerate(self.model.surface) if p is not None and len(p) == 1 and p != " ")]

    def part(self, w: str, part: str, known: dict[str, tuple[str, str]]) -> tuple[str, str]:
        """Encodes a part and decodes its ids; short ones are remembered as those of w."""
        ids = self.model.ids_of(part)
        seen = [self.model.surface[k] for k in ids]
        text = "".join(seen) if None not in seen else self.model.decode([*self.start, *ids])[len(self.start) :]
        made = " ".join(map(str, ids)), text
        if len(part) <= MAX_CHARS:
            if len(known) >= MAX_PARTS:
                known.clear()
            known[w] = made
        return made

    def document(self, text: str | None) -> tuple[str, str]:
        """The decimal ids, the end id last, and the text that they decode to: that of each part's ids, in order."""
        text = text or ""
        m, part = self.model, self.part
        if m.prefix and text and SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
            known = self.bare
            get = known.get
            made = [get(x) or part(x, SPACE + x, known) for x in text.split(" ")]
        else:
            made = [self.marked.get(x) or part(x, x, self.marked) for x in m.words(text)]
        seen = "".join([x[1] for x in made])
        ids = [x[0] for x in made]
        ids.append(str(m.end))
        return " ".join(ids), seen[1:] if m.prefix and seen.startswith(" ") else seen


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; ids end with the end id."""
    small_batches(docs.sparkSession)
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            n, ids, texts = [], [], []
            for x in b.column(1).to_pylist():
                joined, seen = c.document(x)
                n.append(joined.count(" ") + 1)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(seen.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return given.mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """docs with a column of the ids of each text, the end id last."""
    from pyspark.sql import functions as F

    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts):
        m = coder(path).model
        return texts.map(lambda x: [*m.encode(x or ""), m.end])

    return docs.withColumn(to, ids(docs[text_col]))


def decoded(docs: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with a column of the texts that the ids decode to; null ids give an empty text."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text(ids):
        m = coder(path).model
        return ids.map(lambda x: m.decode([int(k) for k in x]) if x is not None else "")

    return docs.withColumn(to, text(docs[ids_col]))
