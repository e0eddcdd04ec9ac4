"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; where it falls below a bound at the end of a word, a chunk
may end. Whether it does depends on the last 16 bytes alone, so after an insertion the cuts fall
into place again. A chunk runs from a cut to the first cut at least ``CHUNK_WORDS`` words on, and one
starts at every cut, so chunks overlap and a repeated passage is covered but for its edges. Chunks
are told apart by a 64-bit digest of their words.

The first document, by doc_id, with a chunk keeps it. In others the words of such chunks go, where
they form a run of at least ``RUN_WORDS`` words; so does what a document repeats of itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.catalog import in_arrow, narrow, query, raw_texts, table, unused
from tidings.llm.words import U64, Powers, mix, span_hashes, spans
from tidings.session import staged

#: Words of the shortest chunk; shorter ones repeat by chance.
CHUNK_WORDS = 8
#: A cut is found at one in so many word ends.
CUT_EVERY = 5
#: The shortest run of repeated words that goes: a repeated passage of 50 words, less its edges.
RUN_WORDS = 16
#: Bytes that decide on a cut.
WINDOW = 16

GEAR = np.random.default_rng(20260101).integers(0, 1 << 16, 256, dtype=np.uint16)
UP = Powers(0xD1342543DE82EF95)
DOWN = Powers(pow(0xD1342543DE82EF95, -1, 1 << 64))

ROWS = "doc_id bigint, n_words bigint, n_removed_words bigint, removed string, text string"


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the gears of the last bytes, each shifted once more."""
    values = GEAR[data]
    out = np.zeros(len(data), dtype=np.uint16)
    for k in range(min(WINDOW, len(data))):
        out[k:] += values[: len(data) - k] << np.uint16(k)
    return out


class Chunks:
    """The words of a text, and its chunks as word ranges with digests."""

    def __init__(self, text: bytes):
        self.text = text
        data = np.frombuffer(text, dtype=np.uint8)
        self.starts, self.ends = spans(data)
        n = len(self.starts)
        hashes = span_hashes(data, self.starts, self.ends)
        cut = gear(data)[self.ends - 1] < (1 << 16) // CUT_EVERY
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(cut) + 1, [n]]))
        # From each cut to the first one at least CHUNK_WORDS on; at the end, what is left.
        to = np.searchsorted(cuts, cuts + CHUNK_WORDS)
        self.first = cuts[to < len(cuts)]
        self.last = cuts[to[to < len(cuts)]]
        if not len(self.first) and n:
            self.first, self.last = np.array([0]), np.array([n])
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(hashes * UP.upto(n), out=total[1:])
        self.digests = mix((total[self.last] - total[self.first]) * DOWN.upto(n + 1)[self.first])

    def new(self) -> np.ndarray:
        """Digests, each once."""
        return np.unique(self.digests)

    def repeated(self, elsewhere: np.ndarray) -> list[tuple[int, int]]:
        """Word runs to remove: chunks whose digests are given, and later copies within the text."""
        again = np.ones(len(self.digests), dtype=bool)
        again[np.unique(self.digests, return_index=True)[1]] = False
        gone = again | np.isin(self.digests, elsewhere)
        if not gone.any():
            return []
        steps = np.zeros(len(self.starts) + 1, dtype=np.int64)
        np.add.at(steps, self.first[gone], 1)
        np.add.at(steps, self.last[gone], -1)
        inside = np.concatenate([[0], (np.cumsum(steps) > 0).astype(np.int8), [0]])
        edges = np.diff(inside)
        runs = zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())
        return [(a, b) for a, b in runs if b - a >= RUN_WORDS]

    def without(self, runs: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
        """The text without the runs and the white space after them, and the spans that went."""
        kept, went, last = [], [], 0
        for a, b in runs:
            start = int(self.starts[a])
            end = int(self.starts[b]) if b < len(self.starts) else len(self.text)
            kept.append(self.text[last:start])
            went.append((start, end))
            last = end
        kept.append(self.text[last:])
        return b"".join(kept), went

    def points(self, at: list[int]) -> list[int]:
        """Code point offsets of byte offsets, which ascend."""
        data = np.frombuffer(self.text, dtype=np.uint8)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return before[at].tolist()


def node() -> Column:
    """A document: a doc_id, which may be missing, with a text."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """node, doc_id and the different chunks of each document."""

    def work(batch):
        found = [Chunks(t).new().view(np.int64) for t in raw_texts(batch)]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
        return {"node": batch.column("node"), "doc_id": batch.column("doc_id"), "digests": lists}

    rows = narrow(docs, "doc_id", "text").withColumn("node", node())
    return in_arrow(rows, work, "node bigint, doc_id bigint, digests array<bigint>")


def found_elsewhere(docs: DataFrame, column: str) -> DataFrame:
    """``docs``, in all its columns, with the digests that an earlier document keeps.

    ``column`` must be no column of ``docs`` yet.
    """
    of, own = unused(docs, "of"), unused(docs, "own")
    # Staged: the chunks are made once and read twice.
    held = staged(digests(docs))
    rows = held.select("node", "doc_id", F.explode("digests").alias("digest"))
    common = rows.groupBy("digest").agg(
        F.min("node").alias("low"),
        F.max("node").alias("high"),
        F.min_by("node", "doc_id").alias("first"),
    )
    # Staged, so that of documents that share an id one stays the keeper, whatever is computed again.
    common = staged(
        common.filter("low <> high").select("digest", F.coalesce("first", "low").alias("keeper"))
    )
    gone = (
        rows.select("node", "digest")
        .join(common, "digest")
        .filter("node <> keeper")
        .groupBy(F.col("node").alias(of))
        .agg(F.collect_set("digest").alias(column))
    )
    # Staged, so that rows of one document, if very many, can be split in the join.
    found = staged(gone)
    return docs.withColumn(own, node()).join(found, F.col(own) == F.col(of), "left").drop(of, own)


def shortened(raw: bytes, elsewhere) -> tuple[Chunks, list, bytes, list]:
    """The chunks of a text, the word runs to remove, what is left, and the byte spans that went."""
    chunks = Chunks(raw)
    own = np.zeros(0, dtype=np.int64) if elsewhere is None else np.asarray(elsewhere)
    runs = chunks.repeated(own.view(U64))
    text, went = chunks.without(runs) if runs else (raw, [])
    return chunks, runs, text, went


def deduplicated(docs: DataFrame) -> DataFrame:
    """For every document its text without repeated passages.

    ``docs`` has doc_id and text; other columns are ignored. Returned per row: ``doc_id``;
    ``n_words`` before, ``n_removed_words``; ``removed``, the spans that went, as start:end in code
    points of the whole text, joined by commas; ``text``, what is left. Null or empty text stays
    empty. A document is a pair of doc_id and text, so texts under one id, or without any, are compared
    with each other; of those under the least id one keeps a passage, and texts without an id come last.
    Rows equal in both are one document and stay or go together. An empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> dict:
        out = []
        for raw, elsewhere in zip(raw_texts(batch), batch.column("elsewhere")):
            own = None if elsewhere.values is None else elsewhere.values.to_numpy()
            chunks, runs, text, went = shortened(raw, own)
            points = iter(chunks.points([p for span in went for p in span]) if went else [])
            out.append(
                (
                    len(chunks.starts),
                    sum(b - a for a, b in runs),
                    ",".join(f"{a}:{b}" for a, b in zip(points, points)),
                    text.decode("utf-8", "replace"),
                )
            )
        names = ("n_words", "n_removed_words", "removed", "text")
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, map(list, zip(*out))))

    joined = found_elsewhere(narrow(docs, "doc_id", "text"), "elsewhere")
    return in_arrow(joined.select("doc_id", "text", "elsewhere"), work, ROWS)


@query("op9_gear_chunk_dedup")
def op9_gear_chunk_dedup(spark, sf_dir):
    return deduplicated(table(spark, sf_dir, "documents"))
