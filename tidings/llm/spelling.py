"""Spelling variants: words one edit apart, grouped under the most frequent of them.

The different words of all documents are counted; each goes to the block of the first counts of its
letter vector, and as a visitor to the blocks that one edit could reach. A block is a subtree of the
trie of vectors (``vector_trie``) and is searched by its own words and its visitors. Every pair meets in
one block: that of the greater vector.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.catalog import arrow_schema, narrow, query, record_batch, table
from tidings.llm.vector_trie import LEVELS, Words, near_pairs, shifts
from tidings.session import staged

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Of the runs of letters in a document, one in so many loses a letter.
SLIP_EVERY = 97
#: A form is at least so many times as frequent as the word.
TIMES = 2
#: Different words that a task counts before it hands them on.
KEPT_WORDS = 400_000
#: Words of a block at most, unless they share the whole vector.
BLOCK_WORDS = 20_000

#: Runs of letters that can make a word.
RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)


def slipped(run: bytes, prefix: int) -> bytes:
    """A lower-cased run (Latin-1), less a letter where its hash says so; ``prefix`` hashes the id."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % SLIP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def add_words(doc_id: int | None, text: str, counts: dict[bytes, int]) -> None:
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    own: dict[bytes, int] = {}
    for run, n in Counter(RUN.findall(text)).items():
        low = run.encode("latin-1").lower()  # of bytes, only A to Z
        own[low] = own.get(low, 0) + n
    for run, n in own.items():
        word = slipped(run, prefix)
        if len(word) >= LEAST_LETTERS:
            counts[word] = counts.get(word, 0) + n


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` for every word of the documents that occurs often enough.

    ``docs`` has doc_id and text; other columns are ignored. Null text has no words; a missing id
    counts as empty where it is hashed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out():
            words = [w.decode("latin-1") for w in counts]
            return record_batch({"word": words, "n": list(counts.values())}, schema)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                add_words(doc_id, text or "", counts)
            if len(counts) > KEPT_WORDS:
                yield out()
                counts.clear()
        if counts:
            yield out()

    schema = arrow_schema("word string, n bigint")
    found = narrow(docs, "doc_id", "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def latin(batch: pa.RecordBatch | pa.Table) -> list[bytes]:
    return [w.encode("latin-1") for w in batch.column("word").to_pylist()]


def with_vectors(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with their letter counts."""
    rows = "word string, n bigint, vector array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = Words(latin(batch)).vectors.astype(np.int32)
                column = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), LEVELS)
                lists = column.cast(schema.field("vector").type)
                yield record_batch(
                    {"word": batch.column("word"), "n": batch.column("n"), "vector": lists}, schema
                )

    schema = arrow_schema(rows)
    return words.mapInArrow(run, rows)


def depth(words: DataFrame, block_words: int) -> int:
    """The least number of leading counts that cuts the words into small enough blocks."""
    at = F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("depth")
    prefixes = words.select("vector", at).groupBy("depth", F.slice("vector", F.lit(1), F.col("depth")))
    largest = prefixes.count().groupBy("depth").agg(F.max("count").alias("n")).collect()  # a row a level
    return min((r["depth"] for r in largest if r["n"] <= block_words), default=LEVELS)


def blocks(words: DataFrame, levels: int) -> DataFrame:
    """Each word in its own block, and as a visitor in those, not empty, that an edit could lead up to."""
    own = F.slice("vector", 1, levels)
    moves = F.array(*(F.array(*map(F.lit, row)) for row in [[0] * levels, *shifts(levels).tolist()]))
    moved = F.explode(moves).alias("move")
    placed = words.select("word", "n", own.alias("own"), moved)
    block = F.zip_with("own", "move", lambda a, b: a + b)
    sent = placed.select("word", "n", block.alias("block"), (F.col("own") == block).alias("stored"))
    return sent.join(words.select(own.alias("block")).distinct(), "block", "left_semi")


def block_links(group: pa.Table, levels: int) -> dict:
    """For every word of a block with a near word there: how many, and the best of them."""
    group = group.sort_by([("stored", "descending"), ("word", "ascending")])
    words, n = latin(group), group.column("n").to_numpy()
    n_stored = int(np.count_nonzero(group.column("stored").to_numpy()))
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    near = np.zeros(len(words), dtype=np.int64)
    best = np.full(len(words), -1)
    for a, b in near_pairs(Words(words), n_stored, levels):
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        near += np.bincount(x, minlength=len(words))
        # The best so far takes part again.
        old = np.flatnonzero(best >= 0)
        x, y = np.concatenate([x, old]), np.concatenate([y, best[old]])
        order = np.lexsort((rank[y], -n[y], x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        best[x[first]] = y[first]
    found = np.flatnonzero(near)
    return {
        "word": group.column("word").take(pa.array(found)).combine_chunks(),
        "n_near": near[found],
        "form": group.column("word").take(pa.array(best[found])).combine_chunks(),
        "form_n": n[best[found]],
    }


LINKS = "word string, n_near bigint, form string, form_n bigint"


def linked(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n, number of near words, and the best near word with its count, for all ``words``."""
    schema = arrow_schema(LINKS)
    held = staged(with_vectors(words))
    levels = depth(held, block_words)

    def work(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([record_batch(block_links(group, levels), schema)])

    found = blocks(held, levels).groupBy("block").applyInArrow(work, LINKS)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    known = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return held.select("word", "n").join(known, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("best.form").alias("form"),
        (-F.col("best.less")).alias("form_n"),
    )


def rooted(forms: DataFrame, most: int) -> DataFrame:
    """``word`` and ``root`` for words with a form (columns word, form), following forms to the last.

    Each round doubles the steps taken. A form is ``TIMES`` as frequent as its word, so with counts
    from ``LEAST_COUNT`` to ``most`` the number of steps, and so of rounds, is bounded.
    """
    steps = math.log(max(most, LEAST_COUNT) / LEAST_COUNT, TIMES)
    current = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(steps, 1))) if steps > 1 else 0):
        current = staged(current)
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        current = current.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")
        )
    return current


def variants(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the documents.

    Ties, repeated rows and rows that share an id count as they are: each occurrence once. A word
    whose near words are all too rare has no form and is its own root. Empty tables and texts without
    a long enough run give no rows.
    """
    near = staged(linked(word_counts(docs), block_words))
    close = F.col("form_n") >= TIMES * F.col("n")
    forms = near.filter(close).select("word", "form")
    most = near.agg(F.max("n")).first()[0] or 0
    roots = rooted(forms, most)
    return near.join(roots, "word", "left").select(
        "word",
        F.when(close, F.col("form")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        "n_near",
        F.when(close, F.col("form_n")).alias("form_n"),
    )


def _remainders() -> list[int]:
    """The 256 remainders of the hash, by its polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


_SQL_BYTES = """flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"""
_SQL_STEP = f"xor(h >> 8, ({_remainders()}::BIGINT[])[(xor(h, b) & 255) + 1])"
SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
          unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({_SQL_BYTES}, lambda b: b::BIGINT)),
    lambda h, b: {_SQL_STEP}), 4294967295) AS h
  FROM counted
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % {SLIP_EVERY} = 0
      THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), shorter AS (
  SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b
    ON a.l = b.l AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.rest, a.word, a.n FROM shorter a JOIN words w ON a.rest = w.word
  UNION SELECT a.word, w.word, w.n FROM shorter a JOIN words w ON a.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n
  FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN form_n >= {TIMES} * w.n THEN form END AS form,
    CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), roots AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, r.root FROM roots r JOIN formed f ON f.form = r.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""


@query("op12_vector_trie_spelling", SQL)
def op12_vector_trie_spelling(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))
