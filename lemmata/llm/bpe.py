"""Byte-level BPE by the tiktoken library, with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_batches

#: Unicode's White_Space, as the library's patterns understand \s.
_SPACE = "\t-\r \x85\xa0  -     　"
#: No match of the pattern reaches from another character into white space, so a text may be cut before each run of it.
_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Pieces whose ids a worker remembers. The memory starts anew when it is full.
REMEMBERED = 200_000
#: A run of white space longer than this is not given to the library's pattern, which would go back over it step by step.
LONG_SPACE = 1000


def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Codec:
    """Ids of whole texts and bytes of ids. `pattern` must be one that never joins a character with white space after it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})  # all of a piece is one match
        self.known: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        run = len(piece) - len(piece.lstrip())
        if run <= LONG_SPACE:
            ids = self.encoding.encode_ordinary(piece)
        elif run == len(piece):
            ids = self.whole.encode_ordinary(piece)
        else:  # all but the last white space is one match; the last one may belong to what follows
            ids = self.whole.encode_ordinary(piece[: run - 1]) + self.encoding.encode_ordinary(piece[run - 1 :])
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for piece in _PIECES.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self._ids(piece)
                if len(piece) < 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return self.encoding.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool = True) -> DataFrame:
    """Ids of each whole text, and the text that they decode to.

    Returns doc_id and n_tokens with ids_sha256 and decoded_sha256, or (digests=False) with ids array<int> and decoded binary. A null
    text is empty: no ids and no bytes. Texts are cut before each run of white space, where no match of the pattern can cross, and each different piece is
    encoded once by a worker as long as it remembers it. No special tokens.
    `ranks` has at most a few hundred thousand entries, the size of a vocabulary; they are broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def of(batches):
        codec = Codec(sent.value, pattern)
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py() or "")
                back = codec.decode(ids)
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<i4"))
                second.append(hashlib.sha256(back).hexdigest() if digests else back)
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names
            )

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = "string, string".split(", ") if digests else ["array<int>", "binary"]
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    return docs.transform(in_batches, of, f"doc_id bigint, n_tokens bigint, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}")


def ranks_from(path: str) -> dict[bytes, int]:
    """Ranks of a local file; its path is a parameter, as vocabularies are not part of this package."""
    with open(path, "rb") as f:
        return ranks_of(f.read())
