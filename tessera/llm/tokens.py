"""Encoding and decoding texts with a public tokenizer, over Arrow batches.

Spark partitions the rows; each Arrow batch of a partition is handed to the tokenizers
library at once. Nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabulary files lie; the same place on every executor.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Characters that are handed to the tokenizer in one call at most (a longer text goes alone).
CALL_CHARS = 4_000_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


def _file(name: str, folder: str) -> str:
    return os.path.join(folder, f"{name}.json")


@lru_cache(maxsize=1)
def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the
    characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table = byte_characters()
    out = [b""] * (1 + max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"])))
    for token, i in spec["model"]["vocab"].items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


@lru_cache(maxsize=4)
def _cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer splits by the byte-level rule before it merges, and changes nothing before that."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = spec.get("pre_tokenizer") or {}
    return first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec.get("normalizer")


#: Places before a space or line end and behind a visible character. The byte-level rule never joins
#: over such a place: only the first character of a piece it cuts can be white space, unless all are.
_CUT = re.compile(r"(?<=[!-~\u00c0-\u167f\u3041-\ud7a3])(?=[ \n])")


class Pieces:
    """Token ids of texts as raw 32-bit numbers; a piece between cuts is encoded once and then looked up.

    The tokens of a text are those of its pieces in order, so this is exact. What is kept is
    bounded: short pieces only, and all are dropped when there are KEPT of them.
    """

    KEPT = 400_000
    LONGEST = 40

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) for t in texts]
        new = list({p for ps in cut for p in ps}.difference(self.known))
        found = {}
        for part in _calls(new):
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[piece] = np.array(e.ids, dtype=np.int32).tobytes()
        if len(self.known) + len(found) > self.KEPT:
            self.known = {p: self.known[p] for ps in cut for p in ps if p in self.known}
        self.known.update(found)
        out = [b"".join([self.known[p] for p in ps]) for ps in cut]
        for piece in found:
            if len(piece) > self.LONGEST:
                del self.known[piece]
        return out


@lru_cache(maxsize=4)
def _pieces(path: str) -> Pieces:
    return Pieces(_tokenizer(path))


def _raw_ids(path: str, texts: list[str | None]) -> list[bytes]:
    plain = [t or "" for t in texts]
    if not _cuts_at_spaces(path):
        return [np.array(e.ids, dtype=np.int32).tobytes() for part in _calls(plain) for e in _tokenizer(path).encode_batch_fast(part, add_special_tokens=False)]
    out: list[bytes] = []
    for part in _calls(plain):
        out += _pieces(path).encode(part)
    return out


def _raw_lists(raw: list[bytes]) -> pa.Array:
    ends = np.fromiter(accumulate((len(r) // 4 for r in raw), initial=0), dtype=np.int32, count=len(raw) + 1)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype=np.int32)))


def _calls(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > CALL_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _lists(ids: list[list[int]]) -> pa.Array:
    ends = np.fromiter(accumulate(map(len, ids), initial=0), dtype=np.int32, count=len(ids) + 1)
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _map_texts(df: DataFrame, text: str, adds: list[T.StructField], make: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """``df`` without ``text`` and with the columns that ``make`` derives from its values."""
    kept = [c for c in df.columns if c != text and c not in {a.name for a in adds}]
    schema = T.StructType([df.schema[c] for c in kept] + adds)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *made], names=names)

    return df.select(*kept, text).mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR, ids: str = "ids", offsets: bool = False) -> DataFrame:
    """Replace ``text`` by the list of its token ids; with ``offsets`` also ``starts`` and ``ends``.

    Offsets are in characters of the text: a token's bytes are mapped back to the characters
    they belong to, and a token that holds only a part of a character covers the whole of it.

    Defined cases: a null or empty text has the empty list; no special tokens are added and
    their strings in a text are ordinary text; whole texts are encoded whatever their length;
    other columns are kept (one named like a result is replaced); repeated rows stay repeated.
    """
    path = _file(name, folder)

    def make(texts: list[str | None]) -> list[pa.Array]:
        if not offsets:
            return [_raw_lists(_raw_ids(path, texts))]
        coded: list[list[int]] = []
        starts: list[list[int]] = []
        ends: list[list[int]] = []
        for part in _calls([t or "" for t in texts]):
            for e in _tokenizer(path).encode_batch(part, add_special_tokens=False):
                coded.append(e.ids)
                starts.append([a for a, _ in e.offsets])
                ends.append([b for _, b in e.offsets])
        return [_lists(x) for x in (coded, starts, ends)]

    kind = T.ArrayType(T.IntegerType(), containsNull=True)
    return _map_texts(df, text, [T.StructField(c, kind) for c in ([ids, "starts", "ends"] if offsets else [ids])], make)


def token_counts(df: DataFrame, text: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR, count: str = "tokens") -> DataFrame:
    """Replace ``text`` by its number of tokens (0 for null and empty texts)."""
    path = _file(name, folder)

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(np.fromiter((len(r) // 4 for r in _raw_ids(path, texts)), dtype=np.int64, count=len(texts)))]

    return _map_texts(df, text, [T.StructField(count, T.LongType())], make)


def decode(df: DataFrame, ids: str = "ids", name: str = TOKENIZER, folder: str = TOKENIZER_DIR, text: str = "text") -> DataFrame:
    """Replace a list of token ids by its text.

    Each id gives its bytes by the reversed byte table; the bytes of all ids are joined before
    they are read as UTF-8, so that a character split over tokens comes out whole. A cut list
    may begin or end inside a character: such bytes come out as U+FFFD.

    Defined cases: a null list has a null text, an empty one the empty text; null and unknown
    ids have no bytes.
    """
    path = _file(name, folder)

    def make(lists: list[list[int] | None]) -> list[pa.Array]:
        table = _token_bytes(path)
        n = len(table)
        return [pa.array([None if x is None else b"".join([table[i] for i in x if i is not None and 0 <= i < n]).decode("utf-8", "replace") for x in lists], pa.string())]

    return _map_texts(df, ids, [T.StructField(text, T.StringType())], make)
