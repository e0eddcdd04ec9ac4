"""Join of documents by the Jaccard similarity of their word shingles, with Bayesian pruning.

Equal texts form a class and one of them, the representative, is compared. Candidates share a band
of their MinHash signatures. They are compared value by value: after every step, a pair goes once
the posterior probability that its similarity reaches the threshold falls below a tolerance. What
is left is verified on the shingle sets themselves. Large buckets are cut into blocks, every pair
of which is a group of its own; pairs never become rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.catalog import arrow_schema, in_arrow, narrow, query, raw_texts, table
from tidings.llm.components import components
from tidings.llm.link_blocks import COLUMNS, Links
from tidings.llm.signatures import SIZE, band_keys, signature
from tidings.llm.words import shingles
from tidings.session import staged

THRESHOLD = 0.8
WIDTH = 5
#: Posterior probability below which a pair is dropped unverified.
TOLERANCE = 1e-7
#: MinHash values compared between two looks at the posterior.
STEP = 16
#: Rows of a block; a task holds the texts of two.
BLOCK = 512


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each look, the fewest equal values with which a pair goes on.

    With a uniform prior and m of n values equal, the similarity reaches t with the probability
    that a binomial variable of n + 1 trials at t is at most m.
    """
    out = []
    for n in range(STEP, SIZE + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def candidates(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, least: list[int]):
    """Pairs of ``left`` and ``right`` rows that meet first in this band and survive the looks."""
    keys = band_keys(sigs)
    fresh = np.ones((len(left), len(right)), dtype=bool)
    for earlier in range(band):
        fresh &= keys[left, earlier][:, None] != keys[right, earlier][None, :]
    fresh &= left[:, None] < right[None, :]
    equal = np.zeros(fresh.shape, dtype=np.uint8)
    for k in range(STEP):
        equal += sigs[left, k][:, None] == sigs[right, k][None, :]
    i, j = np.nonzero(fresh & (equal >= least[0]))
    matches = equal[i, j].astype(np.int64)
    a, b = left[i], right[j]
    for look, need in enumerate(least[1:], 1):
        part = slice(look * STEP, (look + 1) * STEP)
        for k in range(0, len(a), 1 << 16):
            few = slice(k, k + (1 << 16))
            matches[few] += (sigs[a[few], part] == sigs[b[few], part]).sum(axis=1)
        on = matches >= need
        a, b, matches = a[on], b[on], matches[on]
    return a, b


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[k] and b[k]."""
    if len(a) <= 4 * len(sets):
        return np.array(
            [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)],
            dtype=np.int64,
        )
    # Many pairs: a product of incidence matrices over the shingles that two sets share.
    sizes = [len(s) for s in sets]
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.cumsum(count > 1) - 1
    kept = count[column] > 1
    row, column = row[kept], shared[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)  # exact: sizes are below 2**24
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [first, first + width])
        dense = np.zeros((len(sets), width), dtype=np.float32)
        dense[row[low:high], column[low:high] - first] = 1
        total += dense @ dense.T
    return total[a, b].astype(np.int64)


def block_links(group: pa.Table, threshold: float, width: int, least: list[int]) -> dict:
    """Links of one block, or between two, that no earlier band finds."""
    group = group.sort_by([("rep", "ascending")])
    band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype="<u4").reshape(-1, SIZE)
    block = group.column("block").to_numpy()
    links = Links(group.column("rep").to_numpy(), group.column("copies").to_numpy())
    everyone = np.arange(len(sigs))
    sides = [(everyone, everyone)] if i == j else [
        (everyone[block == i], everyone[block == j]), (everyone[block == j], everyone[block == i])
    ]
    found = [candidates(sigs, x, y, band, least) for x, y in sides]
    a, b = (np.concatenate(side) for side in zip(*found))
    if len(a):
        used = np.unique(np.concatenate([a, b]))
        texts = group.column("text").take(pa.array(used)).cast(pa.binary()).to_pylist()
        sets = [shingles(t, width) for t in texts]
        sizes = np.array([len(s) for s in sets])
        x, y = np.searchsorted(used, a), np.searchsorted(used, b)
        common = intersections(sets, x, y)
        close = common / (sizes[x] + sizes[y] - common) >= threshold
        links.add(a[close], b[close])
    return links.columns()


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, the digest that tells texts apart, and ``more``; null is the empty text."""
    text = F.coalesce("text", F.lit(""))
    return narrow(docs, "doc_id", "text", *more).select(
        "doc_id", F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"), *more
    )


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key, mark and signature of every text (null without a word)."""

    def work(batch):
        sigs = []
        for raw in raw_texts(batch):
            found = shingles(raw, width)
            sigs.append(signature(found).astype("<u4").tobytes() if len(found) else None)
        return {
            "doc_id": batch.column(0), "key": batch.column(1), "mark": batch.column("mark"), "sig": sigs
        }

    rows = "doc_id bigint, key binary, mark bigint, sig binary"
    return in_arrow(keyed(docs, "mark"), work, rows)


def banded(representatives: DataFrame) -> DataFrame:
    """A row (rep, band, bucket) for each band of each representative."""

    def work(batch):
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u4")
        keys = band_keys(sigs.reshape(batch.num_rows, SIZE)).view(np.int64)
        n, bands = keys.shape
        return {
            "rep": np.repeat(batch.column("rep").to_numpy(), bands),
            "band": np.tile(np.arange(bands, dtype=np.int32), n),
            "bucket": keys.ravel(),
        }

    rows = representatives.select("rep", "sig").filter("sig IS NOT NULL")
    return in_arrow(rows, work, "rep bigint, band int, bucket bigint")


def shared_buckets(bands: DataFrame) -> DataFrame:
    """Buckets with two members or more; of those with the same members, the one of least band."""
    members = bands.groupBy("bucket", "band").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("rep")).alias("x"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
    )
    first = F.min(F.struct("band", "bucket")).alias("first")
    return members.filter("n > 1").groupBy("n", "x", "y").agg(first).select("first.*", "n")


def block_groups(members: DataFrame) -> DataFrame:
    """Members once for every pair of blocks (i <= j) of their bucket that theirs is part of."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")),
    )
    placed = members.withColumn("blocks", blocks).withColumn("block", block)
    return placed.withColumn("pair", F.explode(pairs)).select(
        "bucket", "band", "pair.i", "pair.j", "block", "rep", "copies", "sig", "text"
    )


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """For every document its near-duplicate class and number of links.

    ``docs`` has doc_id and text; other columns are ignored. A document is a different pair of
    doc_id and text: every text is compared, also where several share an id or have none. Returned
    per row: ``doc_id``; ``class_id``, the least doc_id reachable by links; ``n_links``, the other
    documents whose similarity reaches the threshold, equal texts included; ``n_text_links``, the
    different texts among those; ``copy_of``, the least doc_id with the same text; ``kept``, whether
    the row is the class's first document, by doc_id (null last), then digest of the text. Null text
    is the empty text. A text of fewer than ``width`` words is one shingle; one without a word links
    with its equals only. Where no document of a class has an id, ``class_id`` is null. Repeated rows
    give repeated rows and count once. An empty table gives no rows.
    """
    unmarked = narrow(docs, "doc_id", "text").withColumn("mark", F.lit(0).cast("long"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return classified(unmarked, threshold, width).select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_text_links"),
        F.col("least.doc_id").alias("copy_of"),
        own.alias("kept"),
    )


def first_rows(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The ``mark`` of the first row of every class; ``docs`` has doc_id, text and a unique mark."""
    rows = classified(docs, threshold, width)
    return rows.filter(F.col("mark") == F.col("first.mark")).select("mark")


def classified(docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """Every row's doc_id, key and mark with what is known of its text and its class.

    The nodes are the different texts. ``least`` is the least of the text's documents, ``first`` of
    the class's, both by doc_id (null last), then key, then mark.
    """
    least = least_matches(threshold, TOLERANCE)
    rows = staged(signed(docs, width))
    one = rows.groupBy("key", "doc_id").agg(F.first("sig").alias("sig"), F.min("mark").alias("mark"))
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key", "mark")
    nodes = one.groupBy("key").agg(
        F.min(order).alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig")
    )
    # Staged, so that the numbers stay.
    reps = staged(nodes.withColumn("rep", F.monotonically_increasing_id()))
    bands = banded(reps)
    members = shared_buckets(bands).join(bands.select("bucket", "rep"), "bucket")
    members = staged(members.join(reps.select("rep", "key", "least", "copies", "sig"), "rep"))
    # Only the texts that share a bucket travel on, each once: by an id and the text, so that a
    # frequent text is spread; texts without an id meet after they are combined.
    wanted = members.select("rep", "key", F.col("least.doc_id").alias("doc_id")).distinct()
    with_id = keyed(docs).join(wanted.filter("doc_id IS NOT NULL"), ["doc_id", "key"])
    without = keyed(docs.filter("doc_id IS NULL")).groupBy("key").agg(F.first("text").alias("text"))
    without = without.join(wanted.filter("doc_id IS NULL"), "key")
    texts = with_id.groupBy("rep").agg(F.first("text").alias("text"))
    texts = texts.unionByName(without.select("rep", "text"))
    groups = block_groups(members.join(texts, "rep"))

    schema = arrow_schema(COLUMNS)

    def work(group: pa.Table) -> pa.Table:
        found = block_links(group, threshold, width, least)
        return pa.table([pa.array(found[f.name], f.type) for f in schema], schema=schema)

    found = staged(groups.groupBy("bucket", "band", "i", "j").applyInArrow(work, COLUMNS))
    counts = found.groupBy("rep").agg(
        F.sum("links").alias("links"), F.sum("linked").alias("linked")
    )
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (
        reps.select("key", "rep", "least", "copies")
        .join(counts, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    # Staged, so that a component with very many rows can be split in the join.
    firsts = staged(known.groupBy("component").agg(F.min("least").alias("first")))
    return rows.select("doc_id", "key", "mark").join(known.join(firsts, "component"), "key")


@query("op8_bayes_jaccard_join")
def op8_bayes_jaccard_join(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))
