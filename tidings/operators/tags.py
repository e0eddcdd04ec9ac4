"""Tags by keywords: thousands of patterns are looked for in one pass over a text.

The patterns make an automaton that follows all of them at once. Automata are built in the tasks, from
patterns sent to them in groups of a bounded size; with more patterns there are more groups, and a
pass for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.session import staged

#: Characters of the patterns of one automaton.
GROUP_CHARS = 4 << 20

_automata: dict = {}


def automaton(name: str, shared):
    """The automaton of a group of patterns, built once by a worker; the last one is kept."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        for pattern, tags in shared.value:
            found.add_word(pattern, tuple(tags))
        found.make_automaton()
        _automata[name] = found
    return _automata[name]


def tags_of(texts: DataFrame, patterns: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``id`` and ``tag`` for every tag some pattern of which occurs in the text, each once.

    ``texts`` has id and text, ``patterns`` pattern and tag. Patterns are compared as they are; empty or
    null ones match nothing. Null texts have no tags.
    """
    spark = texts.sparkSession
    known = patterns.filter((F.length("pattern") > 0) & F.col("tag").isNotNull())
    each = staged(known.groupBy("pattern").agg(F.collect_set("tag").alias("tags")))
    size = each.agg(F.sum(F.length("pattern") + F.length(F.array_join("tags", "")))).first()[0] or 0
    groups = max(1, -(-size // group_chars))
    dealt = each.withColumn("group", F.pmod(F.xxhash64("pattern"), F.lit(groups)))
    rows = pa.schema([("id", pa.int64()), ("tag", pa.string())])

    def one(group: int) -> DataFrame:
        # Bounded by the group's size, which the hash keeps near its mean.
        chosen = [(r["pattern"], sorted(r["tags"])) for r in dealt.filter(F.col("group") == group).collect()]
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(chosen)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = automaton(name, shared)
            for batch in batches:
                ids, tags = [], []
                for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = set()
                    if text and len(found):
                        for _, some in found.iter(text):
                            own.update(some)
                    ids += [row_id] * len(own)
                    tags += sorted(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.string())], schema=rows)

        return texts.select(F.col("id").cast("long"), "text").mapInArrow(run, "id bigint, tag string")

    out = one(0)
    for group in range(1, groups):
        out = out.unionByName(one(group))
    return out.distinct()
