"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, each a sequence of its own.

A document of n tokens gives floor(n / max_len) pieces of max_len tokens and one piece for each binary digit 1 of the
remainder, longest first. No sequence crosses documents and none needs padding; sequences of one length form a bucket.

Tokens come from a file of the ``tokenizers`` library, with its ids, those of added tokens in the text included. If the file is a
byte-level BPE with the usual pattern, no normalizer and plain added tokens, its vocabulary is also run by the ``tiktoken`` core,
which is several times as fast and gives the same ids (tests compare the two on every kind of text); any other file, and what
that core refuses, goes to ``tokenizers`` itself. The text is cut at added tokens first, as that library does.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import give_back, hidden

if TYPE_CHECKING:
    import tokenizers

#: Bytes of token ids in one returned batch, about.
BATCH_BYTES = 4 << 20

_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return table | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _usual(spec: dict) -> bool:
    """Whether the file is a plain byte-level BPE with the usual pattern, and its added tokens are taken as they stand."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split_as_usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    as_they_stand = not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return plain and split_as_usual and as_they_stand and not spec.get("normalizer")


class Encoder:
    """Texts to packed little-endian unsigned 32-bit ids, with the ids of the tokenizer file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        self.special = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        # longer ones first, as the library prefers them where several start
        self.cuts = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=lambda t: (-len(t), t)))) if added else None
        self.fast = _usual(spec)
        if self.fast:
            byte_of = _byte_of()
            ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
            self.core = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self) -> tokenizers.Tokenizer:
        """The library's own encoder, loaded when first needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def exact(self, text: str) -> bytes:
        """Ids as the library itself gives them."""
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens, as one piece."""
        if not text:
            return b""
        try:
            ids = self.core.encode_ordinary(text)
        except BaseException as e:  # the core panics on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.exact(text)
        return np.asarray(ids, dtype="<u4").tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if not self.fast:
            return self.exact(text)
        if self.cuts is None or not self.cuts.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.cuts.finditer(text):
            out += [self.plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


def binary_lengths(n: int, longest: int) -> list[int]:
    """The pieces of a document of n tokens: as many of the longest length as fit, then the remainder's binary digits."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def pack_power_of_two(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, bucket, sequence_id, offset, and ids (packed, little-endian, 4 bytes each).

    Each piece is a whole sequence: its offset is 0 and its bucket is the binary logarithm of its length, so batches of
    one bucket need no padding. Every document ends with ``end_id``, so null and empty texts give one piece of length 1.
    Null ids are kept. Repeated rows are packed each. An empty table gives an empty result. Extra columns are ignored.
    sequence_id depends on the input's partitions only: a retried task numbers its sequences as before.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    kind = docs.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, start bigint, length bigint, doc_tokens bigint, ids binary"
    end = struct.pack("<I", end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)  # one for each task: workers live on for other stages
        for batch in batches:
            rows: list[tuple] = []
            of: list[int] = []
            held = 0
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for length in binary_lengths(n, max_len):
                    of.append(i)
                    rows.append((start, length, n, ids[4 * start : 4 * (start + length)]))
                    start += length
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield table(batch, of, rows)
                    rows, of, held = [], [], 0
            if rows:
                yield table(batch, of, rows)
        del encode
        give_back()

    def table(batch: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        starts, lengths, totals, ids = zip(*rows, strict=True)
        data = [batch.column(0).take(pa.array(of)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(data, names=[id_col, "start", "length", "doc_tokens", "ids"])

    out = hidden(docs, [id_col, text_col]).mapInArrow(pieces, schema)
    return out.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
