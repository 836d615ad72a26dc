"""Items that appear together: an incremental pair table.

State lives in a folder as Parquet, cut into hash buckets that each have a version of their own: the baskets (by
record), the marginal count of every term (by term), and the pair counts (by pair). A batch of changed baskets is
compared with the baskets of its buckets, which gives signed deltas (minus the pairs of the old basket, plus those of
the new one); they are combined before they are shuffled and merged into the buckets they fall in. No other bucket
is read or written. Association scores are recomputed for the pairs whose own count or whose terms' counts changed.

Pairs are counted among *tracked* terms only: those frequent enough to reach the support that a pair needs and rare
enough for the lift asked for (n_ab <= min(n_a, n_b), so lift >= L needs max(n_a, n_b) <= N / L). A term that becomes
eligible by a later batch is filled in from the stored baskets, which is the only case where all of them are read, so
the pruning never loses a pair. A long basket is cut into chunks of its sorted terms, and each pair of chunks is a row
of its own, spread over the tasks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.session import new_path, stored

BASKETS = "field string, record bigint, terms array<bigint>"
MARGINALS = "field string, term bigint, n bigint"
TRACKED = "field string, term bigint"
PAIRS = "field string, term_a bigint, term_b bigint, n bigint"
PAIR = ["field", "term_a", "term_b"]
SCORES = "field string, term_a bigint, term_b bigint, n_ab bigint, n_a bigint, n_b bigint, total bigint, lift double"


@dataclass(frozen=True)
class Support:
    """What a pair needs: ``count`` records, ``share`` (num, den) of all records, and ``lift``."""

    count: int = 1
    share: tuple[int, int] = (0, 1)
    lift: int = 0


class _Buckets:
    """A table in ``n`` hash buckets of ``key``; each bucket has a current folder, or none while it is empty."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], n: int):
        self.spark, self.path, self.schema, self.key, self.n = spark, path, schema, key, n
        self.current: dict[int, str] = {}

    def place(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.n)).cast("int"))

    def read(self, only: set[int] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(self.current.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, touched: set[int], version: int) -> None:
        """Write ``rows`` (with their bucket, each bucket in one task) as the new content of the touched buckets."""
        path = f"{self.path}-v{version}"
        rows.write.partitionBy("bucket").parquet(path)
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
        left = {int(x.removeprefix("bucket=")) for x in names if x.startswith("bucket=")}
        self.current = {b: p for b, p in self.current.items() if b not in touched} | {b: f"{path}/bucket={b}" for b in left}

    def add(self, deltas: DataFrame, version: int) -> None:
        """Add signed counts ``n`` (one row per key and stored, with its bucket) to the buckets they fall in."""
        touched = {r.bucket for r in deltas.select("bucket").distinct().collect()}  # at most n
        if touched:
            rows = deltas.unionByName(self.place(self.read(touched))).repartition("bucket")
            self.replace(rows.groupBy("bucket", *self.key).agg(F.sum("n").alias("n")).where("n <> 0"), touched, version)


class PairTable:
    """Persistent pair counts of baskets (field, record, terms); see the module.

    ``buckets`` is the number of hash buckets of each table; where it is not given, the first batch decides: one per
    100,000 records, between 16 and 4,096. The fields are few (columns of tables, say), terms and records many.
    """

    def __init__(self, spark: SparkSession, support: Support, *, folder: str | None = None, buckets: int | None = None, chunk: int = 64):
        self.spark, self.support, self.buckets, self.chunk = spark, support, buckets, chunk
        self.folder, self.version = folder or new_path(spark, "pair-table"), 0
        self.totals: dict[str, int] = {}
        self.tracked = spark.createDataFrame([], TRACKED)
        self.tracked_path: str | None = None
        self.filled = 0  # batches that read all baskets
        self._scored: DataFrame | None = None
        self._scored_totals: dict[str, int] = {}
        self._dirty_terms: list[DataFrame] = []
        self._dirty_pairs: list[DataFrame] = []
        if buckets:
            self._tables(buckets)

    def _tables(self, n: int) -> None:
        make = lambda name, schema, key: _Buckets(self.spark, f"{self.folder}/{name}", schema, key, n)
        self.buckets = n
        self.baskets, self.marginals, self.counts = make("baskets", BASKETS, ["field", "record"]), make("marginals", MARGINALS, ["field", "term"]), make("pairs", PAIRS, PAIR)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, support: Support, **more) -> PairTable:
        """The table as the last batch left it. ``support`` must be the one it was made with."""
        rows = spark.read.json(f"{folder}/state-v*", schema="version int, body string")
        last = json.loads(rows.orderBy(F.col("version").desc()).first().body)
        self = cls(spark, support, folder=folder, buckets=last["buckets"], **more)
        self.version, self.totals, self.tracked_path = last["version"], last["totals"], last["tracked"]
        if self.tracked_path:
            self.tracked = spark.read.schema(TRACKED).parquet(self.tracked_path)
        for name in ("baskets", "marginals", "counts"):
            getattr(self, name).current = {int(b): p for b, p in last[name].items()}
        return self

    def _save(self) -> None:
        body = {"version": self.version, "buckets": self.buckets, "totals": self.totals, "tracked": self.tracked_path} | {x: getattr(self, x).current for x in ("baskets", "marginals", "counts")}
        self.spark.createDataFrame([(self.version, json.dumps(body))], "version int, body string").write.json(f"{self.folder}/state-v{self.version}")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-v{self.version}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def apply(self, changes: DataFrame) -> PairTable:
        """Merge changed baskets: (field, record, terms), one row per record; null terms remove the record, an empty
        list leaves a record without terms.

        Elements that repeat in a list count once, null elements are dropped. An empty batch changes nothing, and
        neither do baskets that are as they were. Rows with a null record or field are dropped. Records that are not in
        the batch keep their basket.
        """
        self.version += 1
        terms = F.array_sort(F.array_distinct(F.filter(F.col("terms").cast("array<bigint>"), lambda t: t.isNotNull())))
        new = changes.where(F.col("record").isNotNull() & F.col("field").isNotNull()).select("field", F.col("record").cast("bigint").alias("record"), terms.alias("terms"))
        if not self.buckets:
            new = self._write(new, "changes")
            self._tables(min(4096, max(16, new.count() // 100_000)))
            new = self.baskets.place(new)
        else:
            new = self._write(self.baskets.place(new), "changes")
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most the number of buckets
        if not touched:
            return self
        held = bool(touched & set(self.baskets.current))
        if held:
            old = self.baskets.place(self.baskets.read(touched)).withColumnRenamed("terms", "was").withColumn("known", F.lit(True))
            both = self._write(old.join(new.withColumn("given", F.lit(True)), ["bucket", "field", "record"], "full_outer"), "compared")
            given = both.where("given")
            changed = given.where("NOT was <=> terms")
            signed = changed.where("terms IS NOT NULL").select("field", "record", "terms", F.lit(1).alias("sign")).unionByName(changed.where("known").select("field", "record", F.col("was").alias("terms"), F.lit(-1).alias("sign")))
            grown = given.groupBy("field").agg(F.sum(F.col("terms").isNotNull().cast("int") - F.coalesce("known", F.lit(False)).cast("int")).alias("n"))
            after = both.where("given IS NULL OR terms IS NOT NULL").select("bucket", "field", "record", F.when(F.col("given"), F.col("terms")).otherwise(F.col("was")).alias("terms"))
            touched = {r.bucket for r in changed.select("bucket").distinct().collect()}
            after = after.where(F.col("bucket").isin(sorted(touched)))
        else:
            after = new.where("terms IS NOT NULL")
            signed = after.select("field", "record", "terms", F.lit(1).alias("sign"))
            grown = after.groupBy("field").agg(F.count("*").alias("n"))
        for r in grown.collect():  # one row per field
            self.totals[r.field] = self.totals.get(r.field, 0) + r.n
        if touched:
            self.baskets.replace(after.repartition("bucket"), touched, self.version)
        deltas = signed.select("field", "sign", F.explode("terms").alias("term")).groupBy("field", "term").agg(F.sum("sign").alias("n")).where("n <> 0")
        deltas = self._write(self.marginals.place(deltas), "marginal-deltas")
        self.marginals.add(deltas, self.version)
        # pair deltas of the changed baskets among the terms tracked so far, and all pairs of terms that became eligible
        before = self.tracked.withColumn("new", F.lit(False))
        parts = [self._pair_counts(self._tracked_only(signed, before), any_new=False)] if self.tracked_path else []
        fresh = self._write(self._eligible().join(self.tracked, ["field", "term"], "left_anti"), "fresh")
        if not fresh.isEmpty():
            self.filled += 1
            both = fresh.withColumn("new", F.lit(True)).unionByName(before)
            parts.append(self._pair_counts(self._tracked_only(self.baskets.read().withColumn("sign", F.lit(1)), both), any_new=True))
            self.tracked = self._write(both.drop("new"), "tracked")
            self.tracked_path = f"{self.folder}/tracked-v{self.version}"
        if parts:
            pairs = reduce(DataFrame.unionByName, parts).groupBy(*PAIR).agg(F.sum("n").alias("n")).where("n <> 0") if len(parts) > 1 else parts[0]
            pairs = self._write(self.counts.place(pairs), "pair-deltas")
            self.counts.add(pairs, self.version)
            self._dirty_pairs.append(pairs.select(*PAIR))
        self._dirty_terms.append(deltas.select("field", "term"))
        self._save()
        return self

    @property
    def pairs(self) -> DataFrame:
        """(field, term_a, term_b, n) of the tracked terms."""
        return self.counts.read() if self.buckets else self.spark.createDataFrame([], PAIRS)

    def records(self) -> DataFrame:
        """(field, total): number of records, those with an empty basket included."""
        return self.spark.createDataFrame([(f, n) for f, n in sorted(self.totals.items()) if n > 0], "field string, total bigint")

    def _eligible(self) -> DataFrame:
        num, den = self.support.share
        # one row per field
        rows = self.marginals.read().join(F.broadcast(self.records()), "field").where((F.col("n") >= self.support.count) & (F.col("n") * den >= F.col("total") * num))
        if self.support.lift:
            rows = rows.where(F.col("n") * self.support.lift <= F.col("total"))
        return rows.select("field", "term")

    @staticmethod
    def _tracked_only(baskets: DataFrame, tracked: DataFrame) -> DataFrame:
        """(record, field, sign, terms): terms restricted to the tracked ones, each with its ``new`` flag, sorted.

        Tracked terms are few where a share is asked for (each holds at least that share of the records, so there
        are at most mean basket size / share of them); Spark measures their size and broadcasts them if it is small.
        """
        tokens = baskets.select("field", "record", "sign", F.explode("terms").alias("term")).join(tracked, ["field", "term"])
        return tokens.groupBy("field", "record", "sign").agg(F.array_sort(F.collect_list(F.struct("term", "new"))).alias("terms")).where(F.size("terms") > 1)

    def _pair_counts(self, baskets: DataFrame, *, any_new: bool) -> DataFrame:
        """Signed counts of the pairs within baskets; ``any_new``: only pairs with at least one new term."""
        c = self.chunk
        long = F.size("terms") > 8 * c
        rows = self._tiles(baskets.where(~long)).unionByName(self._tiles(baskets.where(long)).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))  # their tiles over all tasks
        rows = rows.select("field", "sign", "b", F.explode("a").alias("a")).select("field", "sign", "a", F.explode("b").alias("b")).where("a.term < b.term")
        if any_new:
            rows = rows.where("a.new OR b.new")
        return rows.groupBy("field", F.col("a.term").alias("term_a"), F.col("b.term").alias("term_b")).agg(F.sum("sign").alias("n")).where("n <> 0")

    def _tiles(self, baskets: DataFrame) -> DataFrame:
        """(field, sign, a, b): the pairs of chunks of each basket."""
        c = self.chunk
        n = F.ceil(F.size("terms") / c).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))))
        rows = baskets.select("field", "sign", "terms", F.explode(F.flatten(tiles)).alias("t"))
        part = lambda x: F.slice(F.col("terms"), (x * c + 1).cast("int"), c)
        return rows.select("field", "sign", part(F.col("t.i")).alias("a"), part(F.col("t.j")).alias("b"))

    def scores(self) -> DataFrame:
        """(field, term_a, term_b, n_ab, n_a, n_b, total, lift) of the pairs that reach the support asked for.

        After the first call only affected pairs are scored again: those whose count changed, those of a term whose
        count changed, and all pairs of a field whose number of records changed, as every lift there has.
        """
        if not self.buckets:
            return self.spark.createDataFrame([], SCORES)
        if self._scored is None:
            self._scored = stored(self._score(self.pairs), "scores")
        elif self._dirty_terms or self._dirty_pairs:
            fields = [f for f in self.totals if self.totals[f] != self._scored_totals.get(f)]
            terms = reduce(DataFrame.unionByName, self._dirty_terms).distinct()
            pairs = reduce(DataFrame.unionByName, self._dirty_pairs or [self.pairs.select(*PAIR).limit(0)]).distinct()

            def affected(rows: DataFrame) -> DataFrame:
                for side in ("a", "b"):
                    rows = rows.join(terms.select("field", F.col("term").alias(f"term_{side}"), F.lit(True).alias(f"hit_{side}")), ["field", f"term_{side}"], "left")
                rows = rows.join(pairs.withColumn("hit", F.lit(True)), PAIR, "left")
                hit = F.coalesce("hit_a", "hit_b", "hit", F.lit(False)) | F.col("field").isin(fields)
                return rows.withColumn("hit", hit).drop("hit_a", "hit_b")

            again = self._score(affected(self.pairs).where("hit").drop("hit"))
            left = affected(self._scored).where("NOT hit").drop("hit")
            self._scored = stored(left.unionByName(again), "scores")
        self._scored_totals, self._dirty_terms, self._dirty_pairs = dict(self.totals), [], []
        return self._scored

    def _score(self, pairs: DataFrame) -> DataFrame:
        num, den = self.support.share
        # the counts of tracked terms only: few where a share is asked for
        m = self.marginals.read().join(self.tracked, ["field", "term"], "left_semi")
        rows = (
            pairs.withColumnRenamed("n", "n_ab")
            .join(F.broadcast(self.records()), "field")  # one row per field
            .where((F.col("n_ab") >= self.support.count) & (F.col("n_ab") * den >= F.col("total") * num))
            .join(m.select("field", F.col("term").alias("term_a"), F.col("n").alias("n_a")), ["field", "term_a"])
            .join(m.select("field", F.col("term").alias("term_b"), F.col("n").alias("n_b")), ["field", "term_b"])
        )
        rows = rows.where(F.col("n_ab") * F.col("total") >= F.lit(self.support.lift) * F.col("n_a") * F.col("n_b"))
        lift = F.col("n_ab") * F.col("total") / (F.col("n_a") * F.col("n_b"))
        return rows.select("field", "term_a", "term_b", "n_ab", "n_a", "n_b", "total", lift.alias("lift"))
