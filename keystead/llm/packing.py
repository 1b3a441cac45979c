"""Packing by power-of-two decomposition.

A document of n tokens is split into as many pieces of the longest sequence length as it fills and one
piece for each binary digit of the rest, long pieces first. Each piece is a sequence of its own, so no
sequence crosses documents and none is padded; sequences of equal length form a bucket, from which
batches are drawn. Nothing is shuffled: a piece depends on its document alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RAW, span_hashes, text_parts

#: The longest sequence, a power of two, and the id that ends each document.
LONGEST, END_ID = 2048, 1
_PART = 2 << 20
#: A worker keeps the ids of so many different chunks, then starts again; what it keeps changes no result.
_KEPT = 1_000_000
_encoders: dict[tuple[str, str | None], "ChunkEncoder"] = {}


class ChunkEncoder:
    """Ids of chunks of text, each different chunk encoded once.

    A text is cut before every single blank between two characters that surely aren't white space. The
    tokenizer's pattern never matches across such a cut, so the ids of the chunks are those of the
    whole text. Chunks of Latin letters go to the quicker library that has the same vocabulary as
    ranks, if it is named; all others go to the tokenizer itself."""

    def __init__(self, tokenizer: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.quick = None
        if ranks:
            import base64

            import tiktoken

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ids[0] = END_ID  # entry 0 is the end of a document
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.lengths[0] = 1
        self.n, self.used = 1, 1

    def add(self, found: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        total = int(lengths.sum())
        while self.n + len(found) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
        self.lengths[self.n : self.n + len(found)] = lengths
        self.starts[self.n : self.n + len(found)] = self.used + np.cumsum(lengths) - lengths
        self.n, self.used = self.n + len(found), self.used + total

    def entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each chunk; unknown chunks are encoded."""
        if self.n > _KEPT:
            self.clear()
        hashes, first, inverse = np.unique(span_hashes(raw, starts, ends, RAW), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        get = self.index.get
        known = [get(k, -1) for k in keys]
        at = np.array(known, np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            s, e = starts[first[new]], ends[first[new]]
            texts = [raw[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist())]
            found: list[list[int]] = [[]] * len(texts)
            slow = []
            for i, x in enumerate(texts):
                # bytes up to C8 hold code points below 0x240; special tokens begin with <|
                if self.quick is not None and max(x) <= 0xC8 and b"<|" not in x:
                    found[i] = self.quick.encode_ordinary(x.decode())
                else:
                    slow.append(i)
            for i, x in zip(slow, self.whole.encode_batch([texts[i].decode() for i in slow], add_special_tokens=False)):
                found[i] = x.ids
            at[new] = self.n + np.arange(len(new))
            self.index.update((keys[i], self.n + k) for k, i in enumerate(new.tolist()))
            self.add(found)
        return at[inverse]

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, END_ID after each row, and the bounds of the rows."""
        n, rows = len(raw), len(offs) - 1
        entry = np.zeros(0, np.int64)
        chunk_bounds = np.zeros(len(offs), np.int64)
        if n:
            cut = raw == 0x20
            cut[:1], cut[-1:] = False, False
            at = np.flatnonzero(cut)
            before, after = raw[at - 1], raw[at + 1]
            lead = raw[np.maximum(at - 2, 0)]
            sure = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF))
            sure &= ((after > 0x20) & (after < 0x7F)) | ((after >= 0xC3) & (after <= 0xDF))
            at = at[sure]
            # neither neighbour may be in another row
            edges = np.unique(offs)
            at = at[~np.isin(at, edges) & ~np.isin(at + 1, edges)]
            starts = np.union1d(at, offs[:-1][offs[:-1] < offs[1:]])
            ends = np.append(starts[1:], n)
            entry = self.entries(raw, starts, ends)
            chunk_bounds = np.searchsorted(starts, offs)
        entry = np.insert(entry, chunk_bounds[1:], 0)
        lengths = self.lengths[entry]
        run = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(lengths, out=run[1:])
        ids = self.ids[np.repeat(self.starts[entry] - run[:-1], lengths) + np.arange(run[-1])]
        return ids, run[chunk_bounds + np.arange(rows + 1)]


def split(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens, in order."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, longest: int = LONGEST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit numbers), doc_tokens,
    bucket (log2 of the length), sequence_id, offset (always 0: a piece is its sequence).

    A null or empty text is packed as END_ID alone. Null and repeated doc_ids are packed like others;
    every row of docs is. Other columns of docs are ignored. sequence_id is unique, and the same on each
    run over the same files with the same splits."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    frame = docs.select(F.col("doc_id"), F.col("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = _encoders.get((tokenizer, ranks))
        if encoder is None:
            encoder = _encoders[tokenizer, ranks] = ChunkEncoder(tokenizer, ranks)
        for batch in batches:
            for at, n, raw, offs in text_parts(batch.column(1), _PART):
                ids, bounds = encoder.encode(raw, offs)
                ids = ids.astype("<u4")
                of, start, length = [], [], []
                for i in range(n):
                    sizes = split(int(bounds[i + 1] - bounds[i]), longest)
                    of += [i] * len(sizes)
                    length += sizes
                    place = 0
                    for x in sizes:
                        start.append(place)
                        place += x
                of, start, length = np.array(of, np.int64), np.array(start, np.int64), np.array(length, np.int64)
                for k in range(0, len(of), 4096):
                    o, s, m = of[k : k + 4096], start[k : k + 4096], length[k : k + 4096]
                    first = 4 * int(bounds[o[0]] + s[0])
                    edges = np.append(0, np.cumsum(4 * m)).astype(np.int32)
                    held = pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(edges), pa.py_buffer(ids.view(np.uint8)[first : first + int(edges[-1])])])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).take(pa.array(o)), pa.array(s), pa.array(m), held, pa.array((bounds[o + 1] - bounds[o]))], ["doc_id", "start", "length", "ids", "doc_tokens"])

    out = frame.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    bucket = F.round(F.log2("length")).cast("int")
    return out.withColumns({"bucket": bucket, "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences bucket by bucket, one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
