"""Cost-balanced packing of documents into training sequences.

The cost of a sequence is estimated as a linear part per token plus a quadratic part per document
piece, for attention within it. Documents go in descending length to the sequence of lowest cost
that still has room for them; one that fits nowhere is cut over the sequences with room left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.catalog import arrow_schema, narrow, query, record_batch, table, texts
from tidings.llm.word_ids import encoder

CAPACITY = 4096
#: Tokens that are packed together: about a thousand sequences, so that a task holds little.
WINDOW = 4 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint,"
    " sequence_id bigint, offset bigint, cost double"
)


def rooms_for(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence lengths that hold exactly ``tokens``: full ones, then falling powers of two."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths.

    Every token lies in one piece, no sequence exceeds ``capacity`` and none has a gap. Whole
    multiples of the capacity at a document's start fill sequences of their own. Ties go to the
    earlier document and the earlier sequence.
    """
    pieces, rests, sequence = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        for start in range(0, whole, capacity):
            pieces.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n > whole:
            rests.append((n - whole, d, whole))
    rooms = rooms_for(sum(r[0] for r in rests), capacity)
    room, size = np.array(rooms, dtype=np.int64), np.array(rooms, dtype=np.int64)
    cost = np.zeros(len(rooms))
    for left, d, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            s = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(left, int(room[s]))
            pieces.append((d, start, n, sequence + s, int(size[s] - room[s])))
            room[s] -= n
            cost[s] += LINEAR * n + QUADRATIC * n * n
            left, start = left - n, start + n
    return pieces


def pack(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, with their ids (unsigned 32-bit, little-endian).

    ``docs`` has doc_id and text; other columns are ignored. Null text is the empty text, which
    still has its end id; a null doc_id stays null; repeated rows are documents of their own; an
    empty table gives no rows; a text of any length is cut into as many pieces as needed.

    Documents are packed where they are read, in windows of ``WINDOW`` tokens, so there is no
    shuffle and a task's memory is bounded. The last sequences of a window have lengths that are
    powers of two, so none needs padding. Sequence ids carry the number of the input partition;
    the same files, split alike, always give the same sequences.
    """
    schema = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        names: list = []
        ids: list[np.ndarray] = []
        tokens = 0
        for batch in batches:
            doc_ids, found = batch.column(0).to_pylist(), encoder(vocabulary).encode(texts(batch), end)
            for doc_id, own in zip(doc_ids, found):
                names.append(doc_id)
                ids.append(own)
                tokens += len(own)
                if tokens >= WINDOW:
                    out, sequence = _packed(names, ids, sequence, capacity)
                    yield from (record_batch(o, schema) for o in out)
                    names, ids, tokens = [], [], 0
        out, sequence = _packed(names, ids, sequence, capacity)
        yield from (record_batch(o, schema) for o in out)

    return narrow(docs, "doc_id", "text").mapInArrow(run, PIECES)


def _packed(names, ids, sequence, capacity):
    """Columns of the pieces of one window, in slices, and the next free sequence id."""
    pieces = assign([len(i) for i in ids], capacity)
    used = 1 + max((p[3] for p in pieces), default=-1)
    out = []
    for k in range(0, len(pieces), 2000):
        part = pieces[k : k + 2000]
        out.append(
            {
                "doc_id": [names[d] for d, *_ in part],
                "start": [s for _, s, *_ in part],
                "length": [n for _, _, n, *_ in part],
                "ids": [ids[d][s : s + n].tobytes() for d, s, n, *_ in part],
                "doc_tokens": [len(ids[d]) for d, *_ in part],
                "sequence_id": [sequence + q for *_, q, _ in part],
                "offset": [o for *_, o in part],
                "cost": [LINEAR * n + QUADRATIC * n * n for _, _, n, *_ in part],
            }
        )
    return out, sequence + used


def packed(docs: DataFrame) -> DataFrame:
    """``pack`` with the production vocabulary."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op2_cost_packing")
def op2_cost_packing(spark, sf_dir):
    return digest(packed(table(spark, sf_dir, "documents")))
