"""SentencePiece encoding and decoding over a table of distinct chunks.

In a model none of whose pieces has a whitespace marker after another character, no merge crosses the start of a marked
word. So a text is cut before each run of markers, each distinct chunk of a batch is segmented once with the library, and
ids are joined back by position. A task keeps the table over its batches, up to ``table_chunks`` entries of some 150 bytes, then
starts anew.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release_memory, text_chunks

MARK = "▁"
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
TABLE_CHUNKS = 200_000


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class PieceTable:
    """Encodes texts as the library does, without begin and end ids, and decodes ids."""

    def __init__(self, model: str, table_chunks: int = TABLE_CHUNKS) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.table: dict[str, bytes] = {}  # ids of four bytes
        self.table_chunks = table_chunks
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.marked = np.array([p[0] == MARK for p in pieces])
        # A first chunk gets the marker that the library puts before a text; the probe shows how the model's normaliser acts.
        probe = "".join(self.library.encode("a  b ", out_type=str))
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and probe == f"{MARK}a{MARK}{MARK}b{MARK}"

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. Models whose pieces cross markers, or that change white space, are left to the library."""
        if not self.separable:
            return self.library.encode(texts, num_threads=1)
        table = self.table
        chunks = [CHUNKS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = set().union(*chunks)
        missing = [c for c in distinct if c not in table]
        if len(table) + len(missing) > self.table_chunks:
            table.clear()
            missing = list(distinct)
        self._segment(missing)
        return [np.frombuffer(b"".join([table[c] for c in of]), np.int32).tolist() for of in chunks]

    def _segment(self, chunks: list[str]) -> None:
        """Put chunks into the table. The library marks the start of each text itself, so one marker is left out."""
        plain = [c for c in chunks if len(c) > 1 and c[0] == MARK != c[1]]
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            ids = np.array(self.library.encode("".join(part)[1:]), np.int32)
            # Of these chunks only the first piece begins with a marker.
            starts = np.flatnonzero(self.marked[ids]).tolist()
            if len(starts) != len(part):  # the normaliser makes white space of some other character: each chunk by itself
                self.table.update((c, _packed(self.library.encode(c[1:]))) for c in part)
                continue
            raw = ids.tobytes()
            self.table.update((c, raw[4 * a : 4 * b]) for c, a, b in zip(part, starts, [*starts[1:], len(ids)], strict=True))
        for c in set(chunks) - set(plain):
            self.table[c] = _packed(self.library.encode(c[1:]) if c != MARK else [self.library.piece_to_id(MARK)])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", out: str = "digests", table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """One row per document: its id and n_tokens, then ids_sha256 and decoded_sha256 (out="digests") or ids and decoded (out="ids").

    Null and empty texts have no ids and decode to the empty text. Other columns are not carried. Whole texts are encoded.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    digests = out == "digests"
    schema = f"`{id_col}` {id_type}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(model, table_chunks)
        for batch in batches:
            for piece in text_chunks(batch, text_col):
                ids = table.encode([t or "" for t in piece.column(text_col).to_pylist()])
                decoded = [table.decode(x) for x in ids]
                if digests:
                    a = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
                    b = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]
                else:
                    a, b = pa.array(ids, pa.list_(pa.int32())), decoded
                yield pa.RecordBatch.from_arrays(
                    [piece.column(id_col), pa.array([len(x) for x in ids], pa.int64()), pa.array(a) if digests else a, pa.array(b, pa.string())],
                    [id_col, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])],
                )
        del table  # the table and the model go before the memory does
        release_memory()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
