"""SentencePiece (BPE) encoding by a table of last tokens, and decoding.

The encoding of every prefix of a text ends in one token only, and a token
sequence is an encoding exactly if each two neighbours are: merging the two
side by side gives these two again. So for each prefix the table stores its
last token: among the tokens that end there (matches of an Aho-Corasick
automaton, the longest first) the one that is compatible with the last token
of the prefix before it. Ids are then recovered backwards. Time is linear in
the text, whatever its words are; compatibility is asked once per pair of
tokens and remembered.

A token that its own text isn't merged to never occurs and isn't in the
automaton; a character without a piece is a token of its own, written as its
UTF-8 bytes. Where no piece holds two neighbouring characters the text falls
apart: before a word mark that follows another character, and beside
characters that only stand alone. Each part is encoded on its own, and parts
seen lately are remembered (two generations of ``MEMO`` entries; the older goes).

The model file's bytes travel with the job (a vocabulary: its size doesn't
depend on the data). Taken are BPE models with byte fallback, identity
normalisation and no user-defined or unused pieces; others raise ValueError.

Defined cases: a null text is empty; an empty text has only the end id; rows
are answered one by one, so repeated rows repeat; empty tables give no rows;
the output columns replace columns of the same name, others stay. Decoding
drops control ids, turns bytes that aren't UTF-8 into U+FFFD, a null array
into null, and raises an error for ids outside the vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MARK = "▁"
UNKNOWN_TEXT = " ⁇ "
MEMO = 150_000
PAIRS = 500_000
BATCH_CHARS = 2 << 20
_BPE, _NORMAL, _UNKNOWN, _CONTROL, _BYTE = 2, 1, 2, 3, 6


class Vocabulary:
    """Pieces, scores and flags of a model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = [p.type for p in proto.pieces]
        if (train.model_type != _BPE or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or train.treat_whitespace_as_suffix
                or not set(kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}):
            raise ValueError("not a BPE model with byte fallback, identity normalisation and plain pieces")
        self.dummy_prefix = norm.add_dummy_prefix
        self.end_id = train.eos_id
        self.texts = [p.piece for p in proto.pieces]
        self.kinds = kinds
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}

    def merged(self, text: str) -> list[str]:
        """Merge the best neighbours (the leftmost of equals) until none make a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Last-token tables over one vocabulary."""

    def __init__(self, model: bytes):
        import ahocorasick

        self.v = v = Vocabulary(model)
        chars = {c for p in v.ids for c in p}
        tokens = sorted({p for p in v.ids if len(p) == 1 or v.merged(p) == [p]} | chars)
        self.auto = ahocorasick.Automaton()
        # a token: number, characters, the numbers that are (in)compatible on its right, ids, text
        self.tokens = [(k, len(t), {}, [v.ids[t]] if t in v.ids else self._bytes(t), t) for k, t in enumerate(tokens)]
        for token in self.tokens:
            self.auto.add_word(token[4], token)
        self.auto.make_automaton()
        joined = {c for p in v.ids if len(p) > 1 for c in p} - {MARK}
        inner = any(MARK in p.lstrip(MARK) for p in v.ids)
        some = "".join(map(re.escape, sorted(joined)))
        # no piece has a mark behind another character: a part begins at each run of marks
        self.parts = re.compile(f"[{some}{MARK}]+|[^{some}{MARK}]" if inner else f"{MARK}+[{some}]*|[{some}]+|[^{some}{MARK}]")
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.pairs = 0

    def _bytes(self, text: str) -> list[int]:
        return [self.v.byte_ids[b] for b in text.encode()]

    def _fits(self, left: tuple, right: tuple) -> bool:
        """Whether the two stay as they are when merged side by side."""
        if self.pairs >= PAIRS:
            for token in self.tokens:
                token[2].clear()
            self.pairs = 0
        self.pairs += 1
        fits = left[2][right[0]] = self.v.merged(left[4] + right[4]) == [left[4], right[4]]
        return fits

    def last_tokens(self, part: str) -> list[tuple]:
        """For each prefix of ``part`` its unique last token."""
        last: list[tuple | None] = [None] * len(part)
        done = -1
        for end, token in self.auto.iter(part):
            if end == done:
                continue
            begin = end - token[1]
            if begin >= 0:
                before = last[begin]
                fits = before[2].get(token[0])
                if fits is None:
                    fits = self._fits(before, token)
                if not fits:
                    continue
            last[end] = token
            done = end
        return last

    def encode_part(self, part: str) -> list[int]:
        if len(part) == 1 and part not in self.auto:
            return self._bytes(part)
        last, at, back = self.last_tokens(part), len(part) - 1, []
        while at >= 0:
            token = last[at]
            back.append(token[3])
            at -= token[1]
        back.reverse()
        return list(chain.from_iterable(back))

    def _remembered(self, part: str) -> list[int]:
        ids = self.older.get(part)
        if ids is None:
            ids = self.encode_part(part)
        if len(part) <= 64:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without an end id."""
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.v.dummy_prefix:
            text = MARK + text
        out: list[int] = []
        for part in self.parts.findall(text):
            out += self.memo.get(part) or self._remembered(part)
        return out


class Decoder:
    """Text of ids."""

    def __init__(self, model: bytes):
        v = Vocabulary(model)
        self.strip = v.dummy_prefix
        self.kinds = v.kinds
        # a control id is no character, so that one between bytes shows
        self.surface = [b"\xff\xff" if k == _CONTROL else UNKNOWN_TEXT.encode() if k == _UNKNOWN else bytes([int(t[1:-1], 16)])
                        if k == _BYTE else t.replace(MARK, " ").encode() for t, k in zip(v.texts, v.kinds)]
        self.marked = {i for i, (t, k) in enumerate(zip(v.texts, v.kinds)) if k == _NORMAL and t.startswith(MARK)}

    def decode(self, ids: list[int]) -> str:
        if ids and not 0 <= min(ids) <= max(ids) < len(self.surface):
            raise ValueError("an id lies outside the vocabulary")
        size = len(ids)
        while size and self.kinds[ids[size - 1]] == _CONTROL:
            size -= 1
        pieces = [self.surface[i] for i in ids[:size]]
        if self.strip:
            # the mark that encoding put in front: of the first piece that says something
            first = next((k for k, p in enumerate(pieces) if p != b"\xff\xff"), None)
            if first is not None and ids[first] in self.marked:
                pieces[first] = pieces[first][1:]
        try:
            return b"".join(pieces).decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids, pieces)

    def _decode_runs(self, ids: list[int], pieces: list[bytes]) -> str:
        """The same with each byte of a broken sequence as one U+FFFD, control ids left out."""
        out, run = [], b""
        for i, p in zip([*ids[:len(pieces)], None], [*pieces, b""]):
            if i is not None and self.kinds[i] == _BYTE:
                run += p
                continue
            while run:
                size = next((n for n in (1, 2, 3, 4) if _is_character(run[:n])), 0)
                out.append(run[:size].decode() if size else "�")
                run = run[size or 1:]
            if i is not None and self.kinds[i] != _CONTROL:
                out.append(p.decode())
        return "".join(out)


def _is_character(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


_MADE: dict[tuple[type, bytes], object] = {}


def made(kind: type, model: bytes):
    """One encoder or decoder per Python worker and model."""
    key = (kind, hashlib.sha256(model).digest())
    if key not in _MADE:
        _MADE[key] = kind(model)
    return _MADE[key]


def _sliced(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``BATCH_CHARS``."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_CHARS:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


_IDS = T.ArrayType(T.IntegerType(), False)
_KINDS = {"ids": (_IDS, pa.list_(pa.field("element", pa.int32(), False))), "text": (T.StringType(), pa.string())}


def _map_column(df: DataFrame, column: str, out: dict[str, str], of, sizes) -> DataFrame:
    """``df`` with columns ``out`` (name: kind) = the lists that ``of`` makes of the values of ``column``."""
    names = {c.lower() for c in out}
    kept = [c for c in df.columns if c.lower() not in names]
    work = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias("__in"))
    fields = [f.dataType for f in work.schema.fields[:-1]] + [_KINDS[k][0] for k in out.values()]
    schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(fields)])
    arrow = [_KINDS[k][1] for k in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _sliced(whole, sizes(whole.column(whole.num_columns - 1))):
                made_ = of(batch.column(batch.num_columns - 1).to_pylist())
                new = [pa.array(values, kind) for values, kind in zip(made_, arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    # names of any kind stay outside
    return work.toDF(*[f"c{i}" for i in range(len(kept) + 1)]).mapInArrow(run, schema).toDF(*kept, *out)


def encode(df: DataFrame, model: bytes, column: str = "text", out: str = "ids", end: bool = True,
           decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of ``column`` as array ``out`` and, if ``decoded``
    names a column, with the text that decoding them gives (in one pass)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def of(texts):
        e = made(Encoder, shared.value)
        tail = [e.v.end_id] if end else []
        ids = [e.encode(t or "") + tail for t in texts]
        if decoded is None:
            return (ids,)
        d = made(Decoder, shared.value)
        return ids, [d.decode(i) for i in ids]

    return _map_column(df, column, {out: "ids"} | ({decoded: "text"} if decoded else {}), of,
                       lambda c: pa.compute.fill_null(pa.compute.utf8_length(c), 0).to_pylist())


def decode(df: DataFrame, model: bytes, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``column`` as ``out``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def of(rows):
        d = made(Decoder, shared.value)
        return ([None if ids is None else d.decode(ids) for ids in rows],)

    return _map_column(df, column, {out: "text"}, of, lambda c: pa.compute.fill_null(pa.compute.list_value_length(c), 0).to_pylist())


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    both = encode(docs.select("doc_id", "text"), model, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_piece_prefix(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return token_digests(table(spark, sf_dir, "documents"), read_model(model_path))


QUERIES = {"op12_piece_prefix": op12_piece_prefix}
ORACLE: dict[str, str] = {}
