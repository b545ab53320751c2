"""Language identification by compression: the language whose dictionary makes a text smallest.

A raw-content zstandard dictionary per language holds beginnings of training texts in lower case. Every text is compressed
whole, in blocks, with each dictionary, and sizes are added up; the smallest wins, ties go to the language with more
training rows. A narrow margin, below ``min_margin`` of the size less one byte, is a rejection, and so is a tie at any size.

The fit reads the labels of all training rows, and of the texts a bounded sample: for each language and each of SAMPLE_DOCS
buckets of the hashed id the row with the least hash, of that the first SAMPLE_CHARS characters. At most that many for each
language reach the driver, however many documents there are. Prediction sees the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, hash52, materialise, release_memory, text_chunks

#: Bounds of the fit, for each language: documents, and characters of each.
SAMPLE_DOCS = 128
SAMPLE_CHARS = 1024
LEVEL = 6
BLOCK_BYTES = 2048
MIN_MARGIN = 0.005
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages, those with more training rows first, and their dictionaries."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = LEVEL


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from rows where training holds and id, text and language are not null. Without such rows the model is empty."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"), training.alias("__training"))
    rows = rows.where("__training and __id is not null and __text is not null and __lang is not null").withColumn("__h", hash52("langid", F.col("__id")))
    chosen = rows.groupBy("__lang", (F.col("__h") % sample_docs).alias("__bucket")).agg(F.min("__h").alias("__h"), F.count(F.lit(1)).alias("__n"))
    chosen = materialise(chosen, "langid-chosen")
    texts = rows.join(bounded_broadcast(chosen), ["__lang", "__h"]).select("__lang", "__bucket", "__n", F.lower(F.substring("__text", 1, sample_chars)).alias("__text"))
    found = texts.groupBy("__lang", "__bucket").agg(F.max("__n").alias("n"), F.min("__text").alias("text")).collect()
    parts: dict[str, list[tuple[int, int, str]]] = {}
    for r in found:
        parts.setdefault(r["__lang"], []).append((r["__bucket"], r["n"], r["text"]))
    languages = sorted(parts, key=lambda x: (-sum(n for _, n, _ in parts[x]), x))
    return Model(tuple(languages), tuple("\n".join(t for _, _, t in sorted(parts[x])).encode() for x in languages))


class Sizer:
    """Compressed sizes of texts under each dictionary."""

    def __init__(self, model: Model, block: int = BLOCK_BYTES) -> None:
        self.block = block
        self.compressors = []
        for raw in model.dictionaries:
            shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=model.level)
            self.compressors.append(zstandard.ZstdCompressor(level=model.level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str) -> np.ndarray:
        raw = text.lower().encode("utf-8", "surrogatepass")
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors])


def verdict(model: Model, sizes: np.ndarray, min_margin: float) -> tuple[str, float, float, bool]:
    """Language, score (odds of two for each byte), margin as a share of the size, rejected."""
    best = int(sizes.argmin())
    if len(sizes) == 1:
        return model.languages[0], 1.0, 1.0, False
    lead = int(np.partition(sizes, 1)[1] - sizes[best])
    score = float(1 / np.exp2(-np.minimum(sizes - sizes[best], 1000.0)).sum())
    return model.languages[best], score, lead / float(sizes[best]), lead + 1 < min_margin * sizes[best]


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The columns named in keep (all, if None) with lang_pred, score, margin and rejected; columns of those names are replaced.

    A null text, one without letters, and any text if the model is empty is "und" with score 0, and rejected.
    """
    new = ["lang_pred", "score", "margin", "rejected"]
    base = [c for c in (docs.columns if keep is None else keep) if c not in new]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model)
        for batch in batches:
            for piece in text_chunks(batch, "__text"):
                found = []
                for text in piece.column("__text").to_pylist():
                    if not model.languages or text is None or not any(map(str.isalpha, text)):
                        found.append((UNKNOWN, 0.0, 0.0, True))
                    else:
                        lang, score, margin, rejected = verdict(model, sizer(text), min_margin)
                        found.append((lang, score, margin, rejected or margin == 0))  # a tie tells nothing, however short the text is
                columns = list(zip(*found, strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in base), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], [*base, *new])
        del sizer  # the compressors go before the memory does
        release_memory()

    source = docs.select(*(F.col(f"`{c}`") for c in base), F.col(text_col).alias("__text"))
    return source.mapInArrow(run, f"{fields}, lang_pred string, score double, margin double, rejected boolean")


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text has that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
