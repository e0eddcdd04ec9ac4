"""Cross-tokenizer alignment: where two tokenizers' tokens end together, and how often ids meet there.

Short documents are aligned where they are read. Very long ones are cut into slices of bytes that
are spread over tasks; a slice gives a fragment (``fragments``), and a tree of groups composes the
fragments of a document. Links of many documents are held as one block, which has each different
pair of ids once; so the corpus-wide counts are summed from blocks, and every block asks for those
of its pairs once, however many documents share a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.catalog import BATCH_ROWS, arrow_schema, narrow, query, record_batch, table
from tidings.llm.fragments import (
    EMPTY,
    SLICE,
    Fragment,
    aligner,
    compose,
    finished,
    slice_fragment,
    slices,
)
from tidings.session import staged

#: Links of a block, if no document alone has more.
BLOCK_LINKS = 1 << 20
#: Documents of a block at most.
BLOCK_DOCS = 1 << 16
#: Fragments that a task composes to one.
FANOUT = 8

#: Pairs of a block that leave a task as one batch of rows.
PAIR_ROWS = 1 << 16
#: Characters of texts aligned at once, about.
TEXT_CHARS = 1 << 20

_DOC = "doc_id bigint, `row` bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
#: Rows of a block: a document each, its links as places among the block's pairs in order; then a pair each.
_BLOCK = f"block bigint, {_DOC}, at binary, pair bigint, times bigint"
_FRAGMENT = "closed boolean, head_a array<bigint>, head_b array<bigint>, body binary, tail_a array<bigint>, tail_b array<bigint>"
_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, links binary"
ROWS = f"{_DOC}, n_best bigint, count_sum bigint"


def blocked(documents, schema: pa.Schema, long: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of (fields of a document, links) pairs. Blocks of slices have negative numbers.

    A block leaves as many short rows, so that writers and readers of rows never hold several blocks.
    """
    number = TaskContext.get().partitionId() << 32
    docs, links, held = [], [], 0

    def rows(n: int, **columns) -> pa.RecordBatch:
        own = {"block": np.full(n, -number - 1 if long else number)} | columns
        return record_batch({f.name: own[f.name] if f.name in own else pa.nulls(n, f.type) for f in schema}, schema)

    def out():
        pairs, at, times = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(own) for own in links])
        places = np.split(at.astype("<i4"), ends[:-1])
        for k in range(0, len(docs), BATCH_ROWS):
            some = docs[k : k + BATCH_ROWS]
            fields = {name: [d[name] for d in some] for name in some[0]}
            yield rows(len(some), at=[p.tobytes() for p in places[k : k + BATCH_ROWS]], **fields)
        for k in range(0, len(pairs), PAIR_ROWS):
            some = pairs[k : k + PAIR_ROWS]
            yield rows(len(some), pair=some, times=times[k : k + PAIR_ROWS])

    for doc, own in documents:
        docs.append(doc)
        links.append(own)
        held += len(own)
        if held >= BLOCK_LINKS or len(docs) >= BLOCK_DOCS:
            yield from out()
            number += 1
            docs, links, held = [], [], 0
    if docs:
        yield from out()


def runs_of(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in runs of about so many characters."""
    own, held = [], 0
    for text in texts:
        own.append(text)
        held += len(text)
        if held >= chars:
            yield own
            own, held = [], 0
    if own:
        yield own


def short_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents():
            found = aligner(a_path, b_path)
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                done = chain.from_iterable(map(found.aligned, runs_of(texts, TEXT_CHARS)))
                for doc_id, (n_a, n_b, links, groups) in zip(batch.column(0).to_pylist(), done):
                    sha = hashlib.sha256(groups).hexdigest() if n_a else ""
                    yield {
                        "doc_id": doc_id, "row": None, "n_a": n_a, "n_b": n_b,
                        "n_groups": len(links), "n_links": len(links), "groups_sha256": sha,
                    }, links

        return blocked(documents(), schema, long=False)

    schema = arrow_schema(_BLOCK)
    return docs.mapInArrow(run, _BLOCK)


def sliced(docs: DataFrame, size: int) -> DataFrame:
    """row, no, part, skip and size of every slice of documents (doc_id, text, row)."""
    rows = "`row` bigint, no int, part string, skip bigint, size bigint"
    schema = arrow_schema(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, row in zip(batch.column("text").to_pylist(), batch.column("row").to_pylist()):
                for no, (part, skip, length) in enumerate(slices(text, size)):
                    one = {"row": [row], "no": [no], "part": [part], "skip": [skip], "size": [length]}
                    yield record_batch(one, schema)

    return docs.mapInArrow(run, rows)


def _columns(f: Fragment) -> dict:
    return {
        "closed": [f.closed],
        "head_a": [f.head[0]], "head_b": [f.head[1]],
        "body": [f.body],
        "tail_a": [f.tail[0]], "tail_b": [f.tail[1]],
    }


def slice_fragments(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A fragment and its links for each slice; ``closed`` is null where bytes differ."""
    rows = f"`row` bigint, no int, {_COUNTS}, {_FRAGMENT}"
    schema = arrow_schema(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(a_path, b_path)
        for batch in batches:
            for row, no, part, skip, size in zip(*(c.to_pylist() for c in batch.columns)):
                own = slice_fragment(found, part, skip, size)
                n_a, n_b, links, whole = own or (0, 0, np.zeros(0, dtype=np.int64), EMPTY)
                columns = {
                    "row": [row], "no": [no], "n_a": [n_a], "n_b": [n_b],
                    "n_groups": [len(links)], "links": [links.tobytes()],
                } | _columns(whole)
                yield record_batch(columns | ({} if own else {"closed": [None]}), schema)

    return parts.mapInArrow(run, rows)


def composed(fragments: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``row`` and the digest of its groups, by a tree over the fragments (row, no and theirs).

    A task takes neighbours of one document, so its work is bounded by what it puts out: the groups
    of ``fanout`` fragments. The last level holds the rendered groups of a document, as its row holds
    its text.
    """
    rows = f"`row` bigint, no int, {_FRAGMENT}"
    schema = arrow_schema(rows)

    def work(group: pa.Table) -> tuple[int, int, Fragment]:
        out = EMPTY
        for r in group.sort_by("no").to_pylist():
            heads = tuple(r["head_a"]), tuple(r["head_b"])
            tails = tuple(r["tail_a"]), tuple(r["tail_b"])
            out = compose(out, Fragment(r["closed"], heads, r["body"], tails))
        return r["row"], r["no"] // fanout, out

    def joined(group: pa.Table) -> pa.Table:
        row, no, out = work(group)
        return pa.Table.from_batches([record_batch({"row": [row], "no": [no]} | _columns(out), schema)])

    def digest(group: pa.Table) -> pa.Table:
        row, _, out = work(group)
        sha = hashlib.sha256(finished(out)).hexdigest()
        return pa.Table.from_batches([record_batch({"row": [row], "groups_sha256": [sha]}, digests)])

    digests = arrow_schema("`row` bigint, groups_sha256 string")
    level = fragments.select("row", "no", "closed", "head_a", "head_b", "body", "tail_a", "tail_b")
    most = level.agg(F.max("no")).first()[0] or 0
    while True:
        groups = level.groupBy("row", F.expr(f"no div {fanout}"))
        most //= fanout
        if not most:
            return groups.applyInArrow(digest, "`row` bigint, groups_sha256 string")
        level = groups.applyInArrow(joined, rows)


def long_blocks(fragments: DataFrame) -> DataFrame:
    """Blocks of the links of slices (row, n_a, n_b, n_groups, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents():
            for batch in batches:
                for r in batch.to_pylist():
                    links = np.frombuffer(r.pop("links"), dtype=np.int64)
                    yield r | {"doc_id": None, "n_links": len(links), "groups_sha256": None}, links

        return blocked(documents(), schema, long=True)

    schema = arrow_schema(_BLOCK)
    return fragments.select("row", "n_a", "n_b", "n_groups", "links").mapInArrow(run, _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, its links in the corpus, and whether no other pair of its second id has more."""
    counts = staged(blocks.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("times").alias("count")))
    second = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(second.alias("b")).agg(F.max("count").alias("most"))
    best = (F.col("count") == F.col("most")).alias("best")
    return counts.join(most, second == F.col("b")).select("pair", "count", best)


def looked_up(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of the blocks with their links' counts; a task holds one block at a time."""
    asked = blocks.filter("pair IS NOT NULL").select(F.col("block").alias("asking"), "pair")
    answers = asked.join(counts, "pair")
    documents = blocks.filter("pair IS NULL").drop("pair", "times")
    rows = arrow_schema(ROWS)

    def work(docs: pa.Table, given: pa.Table) -> pa.Table:
        order = np.argsort(given.column("pair").to_numpy())
        where = np.frombuffer(b"".join(docs.column("at").to_pylist()), dtype="<i4")
        ends = np.concatenate([[0], np.cumsum(docs.column("n_links").to_numpy())])
        sums = {}
        for name, column in (("n_best", "best"), ("count_sum", "count")):
            known = given.column(column).to_numpy().astype(np.int64)[order]
            before = np.concatenate([[0], np.cumsum(known[where])])
            sums[name] = np.diff(before[ends])
        columns = {n: docs.column(n).combine_chunks() for n in rows.names if n not in sums}
        return pa.Table.from_batches([record_batch(columns | sums, rows)])

    return documents.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(work, ROWS)


def aligned(docs: DataFrame, a_path: str, b_path: str, size: int = SLICE) -> DataFrame:
    """Counts and a digest of the alignment of every document under two tokenizers.

    ``docs`` has doc_id and text; other columns are ignored. Texts that are null, empty, or whose
    tokens do not give space+text back have no tokens: counts of 0, digest ''. A null doc_id stays
    null; repeated rows are documents of their own, each with its row; an empty table gives none.
    ``size`` is the length in characters from which a text is cut into slices.
    """
    rows = narrow(docs, "doc_id", "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) >= size
    short = staged(short_blocks(rows.filter(~is_long), a_path, b_path), compression="zstd")
    # Staged, so that the rows keep their marks.
    long = staged(
        rows.filter(is_long).withColumn("row", F.monotonically_increasing_id()), compression="zstd"
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = sliced(long, size).repartition(tasks, "row", "no")
    fragments = staged(slice_fragments(parts, a_path, b_path), compression="zstd")
    failed = fragments.filter("closed IS NULL").select("row").distinct()
    whole = fragments.join(failed, "row", "left_anti")
    sliced_blocks = staged(long_blocks(whole), compression="zstd")
    blocks = short.unionByName(sliced_blocks)
    # Staged: short and long documents are taken from it.
    found = staged(looked_up(blocks, pair_counts(blocks)))

    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    summed = found.filter("row IS NOT NULL").groupBy("row").agg(*(F.sum(c).alias(c) for c in numbers))
    known = long.select("doc_id", "row").join(summed, "row", "left").join(composed(whole), "row", "left")
    of_long = known.select(
        "doc_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
    of_short = found.filter("row IS NULL").select("doc_id", *numbers, "groups_sha256")
    return of_short.unionByName(of_long)


@query("op13_fragment_alignment")
def op13_fragment_alignment(spark, sf_dir):
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return aligned(table(spark, sf_dir, "documents"), *paths)
