"""Token files: flat unsigned integers with 64-bit document offsets, memory-mapped to read.

Part k of a corpus is three files: ``part-k.ids`` holds the ids of its documents end to end, in the
narrowest of 16 or 32 bits that the vocabulary allows; ``part-k.off`` holds n + 1 offsets into it,
``part-k.doc`` the n document ids, both 64-bit. All are little-endian. The manifest has a row per
part; the ids before a part are the prefix sum of the parts before it.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.catalog import arrow_schema, narrow, query, record_batch, table, texts
from tidings.llm.word_ids import encoder
from tidings.session import shared_folder, staged

#: Documents without an id are the first ``n_unnamed`` of a part; in its file of ids they are 0.
MANIFEST = "part int, n_docs bigint, n_unnamed bigint, n_tokens bigint, width int"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def opened(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder that every executor reaches: a path or a URI."""
    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:"):
            return arrow_fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
        return arrow_fs.FileSystem.from_uri(folder)
    return arrow_fs.LocalFileSystem(), os.path.abspath(folder)


def part_name(part: int) -> str:
    return f"part-{part:06d}"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end: int = 2) -> DataFrame:
    """Write the corpus in ascending doc_id order; return the manifest with each part's base.

    ``docs`` has doc_id and text; other columns are ignored. Null text is empty and still has its
    end id; documents without an id come first; documents that share an id stand side by side in
    the order of their texts; an empty table gives an empty manifest. A part is written under a
    name of its attempt and then moved, so a repeated task replaces whole files only.
    """
    spark = docs.sparkSession
    schema = arrow_schema(MANIFEST)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, path = opened(folder)
        system.create_dir(path)
        name = posixpath.join(path, part_name(part))
        own = {s: f"{name}.{s}.{attempt}" for s in ("ids", "off", "doc")}
        words = encoder(vocabulary)
        kind = "<u2" if words.size() <= 1 << 16 else "<u4"
        n_docs = n_unnamed = at = 0
        with (
            system.open_output_stream(own["ids"]) as ids_file,
            system.open_output_stream(own["off"]) as off_file,
            system.open_output_stream(own["doc"]) as doc_file,
        ):
            off_file.write(np.zeros(1, dtype="<i8").tobytes())
            for batch in _chain(first, batches):
                for ids in (found := words.encode(texts(batch), end)):
                    ids_file.write(ids.astype(kind).tobytes())
                offsets = at + np.cumsum([len(i) for i in found], dtype="<i8")
                off_file.write(offsets.tobytes())
                n_unnamed += batch.column(0).null_count
                doc_file.write(batch.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
                n_docs, at = n_docs + len(found), int(offsets[-1])
        for suffix, written in own.items():
            system.move(written, f"{name}.{suffix}")
        yield record_batch(
            {
                "part": [part], "n_docs": [n_docs], "n_unnamed": [n_unnamed],
                "n_tokens": [at], "width": [int(kind[-1])],
            },
            schema,
        )

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    spread = narrow(docs, "doc_id", "text").repartitionByRange(parts, *order)
    written = staged(spread.sortWithinPartitions(*order).mapInArrow(run, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _chain(first, rest):
    yield first
    yield from rest


def mapped(system: arrow_fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file's integers: memory-mapped where the folder is mounted, else read."""
    if isinstance(system, arrow_fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype=kind)


def read_tokens(manifest: DataFrame, folder: str, batch_tokens: int = 4 << 20) -> DataFrame:
    """Documents of a written corpus: doc_id, start, n_tokens, ids (32-bit, little-endian)."""
    return _read(manifest, folder, ROWS, lambda ids: {"ids": ids.tobytes()}, batch_tokens)


def read_checksums(manifest: DataFrame, folder: str, batch_tokens: int = 4 << 20) -> DataFrame:
    """``read_tokens`` with the unsigned CRC-32 of the ids, as 32-bit integers, in their place."""
    rows = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return _read(manifest, folder, rows, lambda ids: {"ids_crc32": zlib.crc32(ids)}, batch_tokens)


def _read(manifest, folder, rows, shown, batch_tokens):
    schema = arrow_schema(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for part, unnamed, width, base in (x for b in batches for x in zip(*(c.to_pylist() for c in b))):
            name = posixpath.join(path, part_name(part))
            ids = mapped(system, f"{name}.ids", f"<u{width}")
            offsets = mapped(system, f"{name}.off", "<i8")
            docs = mapped(system, f"{name}.doc", "<i8")
            first = 0
            while first < len(docs):
                last = int(np.searchsorted(offsets, offsets[first] + batch_tokens, side="right")) - 1
                last = min(max(last, first + 1), len(docs))
                values = [
                    shown(ids[offsets[i] : offsets[i + 1]].astype("<u4")) for i in range(first, last)
                ]
                yield record_batch(
                    {
                        "doc_id": pa.array(docs[first:last], mask=np.arange(first, last) < unnamed),
                        "start": base + offsets[first:last],
                        "n_tokens": np.diff(offsets[first : last + 1]),
                    }
                    | {k: [v[k] for v in values] for k in values[0]},
                    schema,
                )
                first = last

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("part", "n_unnamed", "width", "base").repartition(parts, "part")
    return spread.mapInArrow(run, rows)


def token_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"


@query("op6_token_files")
def op6_token_files(spark, sf_dir):
    folder = token_folder(spark)
    docs = table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_checksums(manifest, folder)
