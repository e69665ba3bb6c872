"""Byte-level BPE encoding and decoding (operator 8) with the tokenizers library over Arrow batches.

Cases: a null text is empty and has no ids; repeated rows give repeated rows; an empty table gives
none; a lone surrogate cannot occur in Spark strings; extra columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of a worker's piece cache; beyond it the cache starts anew (results don't change).
CACHE = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one above U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class ByteBPE:
    """Encoder and decoder of a rank file. Each match of the pattern is encoded by itself.

    Bytes are mapped to characters, so that the library's BPE over characters is one over bytes.
    All splits of a token into two tokens are merges of its rank, as in the rank file's own rule.
    """

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import Split

        with open(ranks_path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.find = regex.compile(pattern).findall
        chars = byte_characters()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(chars)})
        spelled = {t: t.decode("latin-1").translate(self.table) for t in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            splits = [(token[:i], token[i:]) for i in range(1, len(token))]
            known = [(a, b) for a, b in splits if a in ranks and b in ranks]
            known.sort(key=lambda x: (ranks[x[0]], ranks[x[1]]))
            merges += [(spelled[a], spelled[b]) for a, b in known]
        self.bytes_of = {i: t for t, i in ranks.items()}
        model = BPE({spelled[t]: i for t, i in ranks.items()}, merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = Split(Regex("\n"), "removed")
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces that aren't known: one call, with offsets to tell the pieces' ids apart."""
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            mapped = [p.encode().decode("latin-1").translate(self.table) for p in some]
            e = self.tokenizer.encode_batch(["\n".join(mapped)], add_special_tokens=False)[0]
            ids = np.asarray(e.ids, dtype="<u4")
            starts = np.cumsum([0] + [len(m) + 1 for m in mapped])
            cuts = np.searchsorted(np.asarray([o[0] for o in e.offsets], dtype=np.int64), starts)
            for p, i, j in zip(some, cuts, cuts[1:]):
                self.known[p] = ids[i:j].tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces, known = self.find(text), self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(dict.fromkeys(pieces))
            self.learn(new)
        return b"".join(map(known.__getitem__, pieces))

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))

    def decode_stream(self, chunks: Iterator[bytes]) -> Iterator[str]:
        """Text of ids that come in chunks; a character that two ids or chunks share is held back."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in chunks:
            yield decoder.decode(self.decode_bytes(ids))
        yield decoder.decode(b"", True)


_models: dict[tuple[str, str], ByteBPE] = {}


def model(ranks_path: str, pattern: str) -> ByteBPE:
    if (ranks_path, pattern) not in _models:
        _models[ranks_path, pattern] = ByteBPE(ranks_path, pattern)
    return _models[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, text): the ids of each whole text as binary and the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(ranks_path, pattern)
        for batch in batches:
            ids = [bpe.encode(x or "") for x in batch.column("text").to_pylist()]
            text = ["".join(bpe.decode_stream(iter([x]))) for x in ids]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary()), "text": text}
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, text string")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), without moving ids or texts between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(ranks_path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(n, pa.int64()),
                    "ids_sha256": pa.array(a, pa.string()),
                    "decoded_sha256": pa.array(b, pa.string()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
