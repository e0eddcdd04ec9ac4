"""Keyword search over notices: an inverted index in segments, BM25 ranking, phrases.

A segment holds the postings of a batch of notices: per term and notice the positions of the term, each
field in its own range of positions. Postings lie in folders by hash of the term and are sorted by
term, so a query reads the few files of its terms and no text. A changed notice goes into a newer
segment and its older postings are void; merging segments drops them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.functions.text import let
from tidings.session import staged
from tidings.sources.manifest import Manifest

#: A term: a run of letters and digits, lower-cased.
TERM = r"[\p{L}\p{N}]+"
#: Parameters of the ranking: saturation of repeats, and weight of the length.
K1, B = 1.2, 0.75
#: Positions of a field start at multiples of this, beyond the length of any text.
FIELD_STEP = 1 << 40
#: Folders that the terms are spread over.
BUCKETS = 64

POSTINGS = "term string, id bigint, positions array<bigint>, lengths array<bigint>, bucket int"
_COLUMNS = ("term", "id", "positions", "lengths", "bucket")
NOTES = "id bigint, segment string, lengths array<bigint>, live boolean"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _placed(field_number: int):
    """A term with its position in the range of its field."""
    return lambda t, i: F.struct(t.alias("term"), (i + FIELD_STEP * field_number).alias("at"))


def _gathered(placed: Column) -> Column:
    """Terms of one notice with their positions in order. A notice is one row, so nothing is shuffled for it."""

    def parted(ordered: Column) -> Column:
        opens = lambda o, i: (i == 0) | (o["term"] != F.get(ordered, i - 1)["term"])
        starts = F.array_compact(F.transform(ordered, lambda o, i: F.when(opens(o, i), i)))

        def of_term(first: Column, last: Column) -> Column:
            places = F.transform(F.slice(ordered, first + 1, last - first), lambda o: o["at"])
            return F.struct(F.get(ordered, first)["term"].alias("term"), places.alias("positions"))

        return let(
            starts,
            lambda known: F.transform(
                known, lambda first, k: of_term(first, F.coalesce(F.get(known, k + 1), F.size(ordered)))
            ),
        )

    return let(F.sort_array(placed), parted)


def _of_field(number: int):
    return lambda p: F.floor(p / FIELD_STEP) == number


@dataclass(frozen=True)
class Fields:
    """Columns that are searched, with their weights; a column may be a text or a list of texts."""

    weights: dict[str, float] = field(
        default_factory=lambda: {"title": 3.0, "body": 1.0, "hashtags": 2.0}
    )

    def texts(self, rows: DataFrame) -> list[Column]:
        kinds = dict(rows.dtypes)
        return [
            F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c) for c in self.weights
        ]


class SearchIndex:
    """An index in a folder. Several runs may add segments at once; a notice must be in one of them."""

    def __init__(self, spark: SparkSession, path: str, fields: Fields | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.fields = fields or Fields()
        self.manifest = Manifest(spark, f"{self.path}/states")

    # --- writing ---------------------------------------------------------------------------

    def postings_of(self, notices: DataFrame) -> DataFrame:
        """Term, id, positions and field lengths, one row per term and notice."""
        fields = self.fields.texts(notices)
        found = notices.select("id", *(terms_of(t).alias(f"f{k}") for k, t in enumerate(fields)))
        names = [f"f{k}" for k in range(len(fields))]
        placed = F.concat(*(F.transform(n, _placed(k)) for k, n in enumerate(names)))
        lengths = F.array(*(F.size(n).cast("long") for n in names))
        postings = found.select("id", lengths.alias("lengths"), F.explode(_gathered(placed)).alias("p"))
        return postings.select("p.term", "id", "p.positions", "lengths")

    def add(self, notices: DataFrame, removed: DataFrame | None = None) -> str:
        """Index new and changed notices (id and the fields; ids unique), and forget ``removed`` ids.

        The feed of an upsert, joined with the notices, is such a batch. Returns the segment. The
        segment counts from the moment its state is created; a run that is lost leaves files that
        nobody reads.
        """
        segment = uuid.uuid4().hex
        self._write(self.postings_of(notices), segment)
        names = self.fields.texts(notices)
        own = notices.select(
            "id",
            F.lit(segment).alias("segment"),
            F.array(*(F.size(terms_of(t)).cast("long") for t in names)).alias("lengths"),
            F.lit(True).alias("live"),
        )
        gone = None if removed is None else removed.select(
            "id",
            F.lit(segment).alias("segment"),
            F.lit(None).cast("array<bigint>").alias("lengths"),
            F.lit(False).alias("live"),
        )
        own = own if gone is None else own.unionByName(gone)
        own.write.mode("overwrite").parquet(f"{self.path}/notes/{segment}")
        fresh = self.spark.read.schema(NOTES).parquet(f"{self.path}/notes/{segment}")

        def change(state, _):
            """Counted against the newest state, so also what a run beside this one has added."""
            before = self._live(state.get("segments", []))
            replaced = before.join(fresh.select("id"), "id", "left_semi")
            totals = state.get("totals", [0] * (len(self.fields.weights) + 1))
            more, less = self._totals(fresh.filter("live")), self._totals(replaced)
            return {
                "segments": [*state.get("segments", []), segment],
                "totals": [t + m - n for t, m, n in zip(totals, more, less)],
            }

        self.manifest.update(change)
        return segment

    def _write(self, postings: DataFrame, segment: str) -> None:
        # Large buckets are split and small ones put together by measured size, without a pass for samples.
        spread = postings.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", F.col("bucket"))
        self._store(spread, segment)

    def _store(self, postings: DataFrame, segment: str) -> None:
        ordered = postings.sortWithinPartitions("bucket", "term", "id")
        writer = ordered.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket")
        writer.parquet(f"{self.path}/postings/{segment}")

    def merge(self) -> str:
        """One segment of all that is live; readers of the older ones are not disturbed."""
        number, state = self.manifest.state()
        segments = state.get("segments", [])
        if len(segments) < 2:
            return segments[0] if segments else ""
        merged = uuid.uuid4().hex
        live = self._live(segments)
        # A folder's postings go into the folder of the same bucket, so they are not shuffled: one scan for
        # each bucket, whose tasks write that bucket's files. Nothing voids the last segment.
        kept = []
        for k, s in enumerate(segments):
            rows = self._postings([s]).select(*_COLUMNS)
            if segments[k + 1 :]:
                rows = rows.join(self._notes(segments[k + 1 :]).select("id"), "id", "left_anti")
            kept.append(rows.select(*_COLUMNS))
        everything = reduce(DataFrame.unionByName, kept)
        folders = [everything.filter(F.col("bucket") == b) for b in range(BUCKETS)]
        self._store(reduce(DataFrame.unionByName, folders), merged)
        notes = live.select("id", F.lit(merged).alias("segment"), "lengths", F.lit(True).alias("live"))
        notes.write.mode("overwrite").parquet(f"{self.path}/notes/{merged}")

        def change(now, _):
            later = now["segments"][len(segments) :]
            if now["segments"][: len(segments)] != segments:
                raise RuntimeError("another run has merged the index")
            return now | {"segments": [merged, *later]}

        self.manifest.update(change)
        return merged

    # --- reading ---------------------------------------------------------------------------

    def segments(self) -> list[str]:
        return self.manifest.state()[1].get("segments", [])

    def _notes(self, segments) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], NOTES)
        return self.spark.read.schema(NOTES).parquet(*(f"{self.path}/notes/{s}" for s in segments))

    def _order(self, segments) -> Column:
        names = F.array(*(F.lit(s) for s in segments))
        return F.array_position(names, F.col("segment"))

    def _live(self, segments) -> DataFrame:
        """The newest note of every notice that is still there. Narrow: no postings are read."""
        notes = self._notes(segments)
        if len(segments) < 2:
            return notes.filter("live").select("id", "segment", "lengths")
        newest = notes.groupBy("id").agg(
            F.max_by(F.struct("segment", "lengths", "live"), self._order(segments)).alias("n")
        )
        return newest.filter("n.live").select("id", "n.segment", "n.lengths")

    def _totals(self, live: DataFrame) -> list[int]:
        sums = [F.coalesce(F.sum(F.get("lengths", F.lit(k))), F.lit(0)) for k in range(len(self.fields.weights))]
        return list(live.agg(F.count("*"), *sums).first())

    def _postings(self, segments) -> DataFrame:
        base = f"{self.path}/postings"
        files = "term string, id bigint, positions array<bigint>, lengths array<bigint>, segment string, bucket int"
        if not segments:
            return self.spark.createDataFrame([], files)
        parts = []
        for s in segments:
            rows = self.spark.read.schema(POSTINGS).parquet(f"{base}/{s}")
            parts.append(rows.withColumn("segment", F.lit(s)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def matching(self, wanted: DataFrame) -> DataFrame:
        """Live postings of the terms of ``wanted`` (a column term, each once).

        Only the folders of their buckets are read, of which there are ``BUCKETS`` at most; a posting is
        dropped if a newer segment has its notice.
        """
        segments = self.segments()
        terms = wanted.select("term", _bucket(F.col("term")).alias("bucket")).distinct()
        buckets = [r[0] for r in terms.select("bucket").distinct().collect()]
        found = self._postings(segments).filter(F.col("bucket").isin(*buckets))
        found = found.join(terms, ["bucket", "term"], "left_semi")
        if len(segments) > 1:
            # Only notices in later segments can void a posting, so the first, the large one, is not read.
            later = self._notes(segments[1:]).select("id", self._order(segments).alias("by")).groupBy("id").agg(
                F.max("by").alias("by")
            )
            found = found.join(later, "id", "left").filter(
                F.col("by").isNull() | (self._order(segments) >= F.col("by"))
            )
        return found.select("term", "id", "positions", "lengths")

    def topk(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The ``k`` best notices for each query (query_id, text): query_id, id, score, rank.

        A notice qualifies by any term. BM25 over fields: a term's repeats, weighted by field and
        relative to its length, saturate; rare terms weigh more. The notices that hold a term are
        counted among the live postings read anyway. Equal scores rank by id.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
        asked = staged(asked)
        found = staged(self.matching(asked))
        state = self.manifest.state()[1]
        n, *sizes = state.get("totals", [0] * (len(self.fields.weights) + 1))
        repeats = F.lit(0.0)
        for f, (weight, size) in enumerate(zip(self.fields.weights.values(), sizes)):
            inside = F.filter("positions", _of_field(f))
            mean = size / n if n else 0.0
            relative = F.get("lengths", F.lit(f)) / mean if mean else F.lit(0.0)
            repeats += weight * F.size(inside) / (1 - B + B * relative)
        weighed = found.select("term", "id", repeats.alias("repeats"))
        df = found.groupBy("term").count()
        rarity = F.log(1 + (n - F.col("count") + 0.5) / (F.col("count") + 0.5))
        rare = asked.join(df, "term").select("query_id", "term", rarity.alias("rarity"))
        points = F.col("rarity") * F.col("repeats") / (K1 + F.col("repeats"))
        scored = weighed.join(rare, "term").groupBy("query_id", "id").agg(F.round(F.sum(points), 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def phrases(self, queries: DataFrame) -> DataFrame:
        """Notices that hold a query's terms side by side in one field: query_id, id, n_hits.

        The rarest term of a query opens its candidates; the other terms' postings are looked up for
        these alone, then shifted by their place in the query and intersected.
        """
        asked = queries.select("query_id", F.posexplode(terms_of(F.col("text"))).alias("place", "term"))
        asked = staged(asked)
        found = staged(self.matching(asked))
        df = found.groupBy("term").count()
        per_query = asked.join(df, "term", "left").groupBy("query_id").agg(
            F.count("*").alias("n_terms"),
            F.min_by("term", F.struct(F.coalesce("count", F.lit(0)), "term")).alias("rarest"),
        )
        opened = found.select(F.col("term").alias("rarest"), "id").join(per_query, "rarest")
        candidates = opened.select("query_id", "id", "n_terms")
        places = asked.join(candidates, "query_id").join(found.select("term", "id", "positions"), ["term", "id"])
        starts = F.transform("positions", lambda p: p - F.col("place"))
        gathered = places.groupBy("query_id", "id", "n_terms").agg(F.collect_list(starts).alias("starts"))
        common = F.aggregate(
            F.slice("starts", F.lit(2), F.col("n_terms")), F.get("starts", F.lit(0)), lambda a, s: F.array_intersect(a, s)
        )
        hits = gathered.filter(F.size("starts") == F.col("n_terms")).select(
            "query_id", "id", F.size(common).cast("long").alias("n_hits")
        )
        return hits.filter("n_hits > 0")
