"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern; each piece's UTF-8 bytes are mapped to printable characters by the usual
byte table (`byte_table`) and merged by the `tokenizers` library's BPE model.  A worker keeps the ids of pieces that it
has met in a cache of bounded size, since the same words come again and again.  Decoding reverses the byte table; an id
sequence may end in the middle of a character, which `decode_stream` carries over to the next sequence.

Defined results: null and empty texts have no ids and decode to no bytes.  Texts of special tokens are ordinary text.
Repeated rows give repeated rows, an empty table an empty one.  Columns with any names are handed on, but for those named as a result.  A very
long text is encoded `PIECES` pieces at a time.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import column, fields, lists, over_pieces, shielded, table, text_of

VOCABULARY = "byte_bpe_50k.json"
CACHED_PIECES = 400_000
PIECES = 200_000


@lru_cache(maxsize=1)
def byte_table() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Encodes and decodes with one vocabulary file.  `piece` splits text; its matches are merged separately."""

    def __init__(self, path: str, piece: str, cached: int = CACHED_PIECES):
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        pattern = regex.compile(piece)
        self.find, self.find_each = pattern.findall, pattern.finditer
        self.map = byte_table()
        back = {c: b for b, c in enumerate(self.map)}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cached = cached

    def _merged(self, piece: str) -> tuple[int, ...]:
        mapped = "".join([self.map[b] for b in piece.encode("utf-8", "surrogatepass")])
        return tuple([t.id for t in self.model.tokenize(mapped)])

    def encode(self, text: str) -> list[int] | np.ndarray:
        if len(text) <= PIECES:
            return self._encoded(self.find(text))
        each, parts = (m[0] for m in self.find_each(text)), []
        while some := list(islice(each, PIECES)):
            parts.append(np.array(self._encoded(some), dtype=np.int32))
        return np.concatenate(parts) if parts else []

    def _encoded(self, found: list[str]) -> list[int]:
        cache = self.cache
        try:
            return list(chain.from_iterable(map(cache.__getitem__, found)))
        except KeyError:
            pass
        if len(cache) > self.cached:
            cache.clear()
        own: dict[str, tuple[int, ...]] = {}
        for p in set(found):
            ids = cache.get(p)
            if ids is None:
                ids = self._merged(p)
                if len(p) <= 64:
                    cache[p] = ids
            own[p] = ids
        return list(chain.from_iterable(map(own.__getitem__, found)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_stream(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text for each part; bytes of a character that isn't whole yet come with the part that completes it."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield decoder.decode(self.decode(ids))
        yield decoder.decode(b"", final=True)

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where each token begins and ends in the text, in code points; a token that holds a part of a character covers it whole."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        points = np.cumsum((data & 0xC0) != 0x80).astype(np.int32)
        to = np.cumsum([len(self.bytes[i]) for i in ids])
        since = np.r_[0, to[:-1]]
        return points[since] - 1, points[to - 1]


@lru_cache(maxsize=2)
def _coder(path: str | None) -> ByteBpe:
    import public_tokenizers

    return ByteBpe(path or vocabulary_path(), public_tokenizers.PATTERN)


@shielded("text")
def encode(df: DataFrame, text: str = "text", path: str | None = None, with_offsets: bool = False) -> DataFrame:
    """All columns but the text, `ids` array<int>, and with_offsets: `starts`, `ends` array<int> (code points)."""
    keep = [c for c in df.columns if c != text]
    source = df.select(*keep, text_of(df, text).alias("__text"))
    extra = ["ids", "starts", "ends"] if with_offsets else ["ids"]
    schema = fields(df.select(*keep).schema, ", ".join(f"{name} array<int>" for name in extra))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, texts = _coder(path), column(batch, "__text").to_pylist()
        ids = [coder.encode(t) for t in texts]
        sizes = list(map(len, ids))
        arrays = [_joined(ids, sizes)]
        if with_offsets:
            found = [coder.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            arrays += [lists(pa.array(np.concatenate([f[k] for f in found]).astype(np.int32)), sizes) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([column(batch, c) for c in keep] + arrays, names=[*keep, *extra])

    return source.mapInArrow(over_pieces(run, "__text"), schema)


def _joined(ids: list, sizes: list[int]) -> pa.ListArray:
    return lists(pa.array(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=sum(sizes))), sizes)


@shielded("ids")
def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """All columns but the ids, `decoded` binary and `decoded_text` string (U+FFFD for bytes that aren't UTF-8)."""
    keep = [c for c in df.columns if c != ids]
    schema = fields(df.select(*keep).schema, "decoded binary, decoded_text string")
    source = df.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [coder.decode(i) for i in column(part, "__ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, c) for c in keep] + [pa.array(out, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in out], pa.string())], names=[*keep, "decoded", "decoded_text"])

    return source.mapInArrow(go, schema)


@shielded("text")
def round_trip(df: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes in one pass: all columns but the text, `n_tokens`, `ids_sha256`, `decoded_sha256`, and with_ids the text again and `ids`."""
    keep = df.columns if with_ids else [c for c in df.columns if c != text]
    source = df.select(*keep, text_of(df, text).alias("__text"))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = fields(df.select(*keep).schema, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(path)
        n, of_ids, of_bytes, held = [], [], [], []
        for text in column(batch, "__text"):
            ids = coder.encode(text.as_py())
            n.append(len(ids))
            of_ids.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            if with_ids:
                held.append(ids)
        found = [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())] + ([_joined(held, n)] if with_ids else [])
        return pa.RecordBatch.from_arrays([column(batch, c) for c in keep] + found, names=[*keep, *names])

    return source.mapInArrow(over_pieces(run, "__text"), schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: the documents with their token ids, number of tokens, and digests."""
    return round_trip(docs, with_ids=True)
