"""Reusable predicate fragments with versions, adaptive admission and eviction.

A fragment remembers which rows (exact), which pages (page) or a superset of which rows (bloom) satisfy one atom of a
guide, for one version of one table. Fragments only prune: whoever uses one applies the full predicate again, and
any doubt (stale version, unproven implication, unsuitable kind) leaves the query as it is, with a named reason.

Life of an adaptive fragment: missing -> probing -> page -> bloom; a version change makes it stale and starts over.
Versions are those of the files a frame reads, looked at with every request; page and Bloom fragments can be stored and
are taken up again by a later session for the very same version, exact ones never are.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.operators import predicate as P
from tarnfield.operators.bloom import PROBES, Bloom, build_bloom, may_contain
from tarnfield.session import stored

MISSING, PROBING, PAGE, BLOOM, STALE = "missing", "probing", "page", "bloom", "stale"

#: Reasons for leaving a query unguided.
BYPASS = ("none", "no_guide", "off", "other_relation", "stale_version", "not_implied", "negated_lossy", "too_many_atoms", "over_budget", "probing", "low_skip", "unsupported_kind", "empty_guide")


@dataclass
class Settings:
    probe_requests: int = 2
    page_min_skip: float = 0.05
    min_benefit_per_byte: float = 0.0
    most_fragment_bytes: int = 16 << 20
    most_total_bytes: int = 64 << 20
    most_atoms: int = 16
    selectivity_ceiling: float = 1.0
    page_rows: int = 64


@dataclass
class Fragment:
    """One atom's fragment; ``data`` is a frame of ids or pages, or a Bloom filter."""

    kind: str
    version: str
    rows: int
    total: int
    bytes: int
    skip_rate: float
    data: object = field(repr=False)
    benefit_per_byte: float = 0.0
    used: int = 0


@dataclass
class Descriptor:
    """Adaptive state of one guide on one table."""

    state: str = MISSING
    requests: int = 0
    probe_cost: float = 0.0
    probes: int = 0
    refine: bool = False
    version: str = ""


def table_version(df: DataFrame) -> str:
    """Version of a frame read from files: a digest over their names, sizes and times; of any other, over its rows."""
    files = sorted(df.inputFiles())
    if not files:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
        return hashlib.sha256(f"{row.n}:{row.h}".encode()).hexdigest()
    context = df.sparkSession.sparkContext
    conf, digest = context._jsc.hadoopConfiguration(), hashlib.sha256()
    for f in files:
        path = context._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        digest.update(f"{f}:{status.getLen()}:{status.getModificationTime()}\n".encode())
    return digest.hexdigest()


def bloom_skip_rate(rows: int, total: int, size: int) -> float:
    """Share of rows a Bloom fragment skips: 1 - matching share - false positives among the others."""
    import math

    share = rows / max(total, 1)
    return max(0.0, 1 - share - (1 - share) * (1 - math.exp(-PROBES * rows / max(size, 1))) ** PROBES)


def guide_skip_rate(rates: list[list[float]]) -> float:
    """Estimate for a guide: a group passes what its most selective atom passes, groups add up to at most all."""
    return max(0.0, 1 - min(1.0, sum(min(1 - r for r in group) for group in rates)))


class Registry:
    """Fragments of one session, keyed by table, atom and kind."""

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()
        self.fragments: dict[tuple[str, str, str], Fragment] = {}
        self.states: dict[tuple[str, str], Descriptor] = {}
        self.versions: dict[str, str] = {}
        self.counters = dict.fromkeys(("built", "reused", "evicted", "rejected", "stale", "applied", "bypassed"), 0)
        self.last = "none"
        self.clock = 0
        #: fragments that the request at hand uses; they are not evicted
        self.active: set[tuple[str, str, str]] = set()

    # ------------------------------------------------ versions

    def sync(self, table: str, df: DataFrame) -> bool:
        """Takes over the version of the files ``df`` reads; True if it is another one than before. A frame that reads
        no files keeps the version :meth:`bump` gave it."""
        if not df.inputFiles():
            return False
        now, old = table_version(df), self.versions.get(table)
        if now == old:
            return False
        if old is None:
            self.versions[table] = now
            return False
        self.bump(table, now)
        return True

    def bump(self, table: str, version: str | None = None) -> str:
        """A new version of a table; its fragments become stale."""
        old = self.versions.get(table, "0")
        self.versions[table] = version or hashlib.sha256((old + "+").encode()).hexdigest()[:16]
        for key, d in self.states.items():
            if key[0] == table and d.state not in (MISSING, STALE):
                d.state = STALE
        return self.versions[table]

    def version(self, table: str) -> str:
        return self.versions.setdefault(table, "0")

    # ------------------------------------------------ building

    def build(self, table: str, df: DataFrame, atom: P.Atom, kind: str, *, cost: float = 0.0) -> Fragment | None:
        """The fragment of an atom in the current version, built if needed; None if it does not fit its budget."""
        key, version = (table, atom.text, kind), self.version(table)
        self.clock += 1
        old = self.fragments.get(key)
        if old and old.version == version:
            old.used = self.clock
            self.counters["reused"] += 1
            return old
        if old:
            self.counters["stale"] += 1
            del self.fragments[key]
        s, hit = self.settings, df.where(atom.tree.to_column())
        total = df.count()
        if kind == "exact":
            data = stored(hit.select("id"), "fragment")
            rows = data.count()
            size, skip = 8 * rows, 1 - rows / max(total, 1)
        elif kind == "page":
            page = F.floor(F.col("id") / s.page_rows).alias("page")
            data = stored(hit.select(page).distinct(), "fragment")
            rows = data.count()
            pages = df.select(page).distinct().count()
            size, skip = max(1, pages // 8), 1 - rows / max(pages, 1)
        elif kind == "bloom":
            data = build_bloom(hit.select("id"))
            rows, size = data.rows, data.size // 8
            skip = bloom_skip_rate(rows, total, data.size)
        else:
            raise P.PredicateError(f"no such kind: {kind}")
        made = Fragment(kind, version, rows, total, size, skip, data, cost * max(skip, 0.0) / max(size, 1), self.clock)
        if size <= 0 or size > s.most_fragment_bytes or not self._room(size):
            self.counters["rejected"] += 1
            return None
        self.fragments[key] = made
        self.counters["built"] += 1
        return made

    def _use(self, table: str, df: DataFrame, atom: P.Atom, kind: str, cost: float = 0.0) -> Fragment | None:
        """The fragment for the request at hand."""
        self.active.add((table, atom.text, kind))
        return self.build(table, df, atom, kind, cost=cost)

    def _room(self, size: int) -> bool:
        """Evict the least beneficial fragments per byte, the least recently used of equal ones first; those in use stay."""
        while sum(f.bytes for f in self.fragments.values()) + size > self.settings.most_total_bytes:
            victims = [(f.benefit_per_byte, f.used, k) for k, f in self.fragments.items() if k not in self.active]
            if not victims:
                return False
            del self.fragments[min(victims)[2]]
            self.counters["evicted"] += 1
        return True

    # ------------------------------------------------ use

    def apply(self, table: str, df: DataFrame, guide: P.Guide, actual: object, *, kind: str | None = None) -> DataFrame:
        """``df`` pruned by the guide's fragments, or as it is with ``last`` naming why; the caller filters again."""
        self.active.clear()
        self.sync(table, df)
        reason = self._refuse(table, guide, actual)
        if reason:
            return self._bypass(df, reason)
        pruned: DataFrame | None = None
        for group in guide.groups:
            part = df
            for atom in group:
                f = self._use(table, df, atom, kind or atom.kind)
                if f is None:
                    return self._bypass(df, "over_budget")
                part = self._prune(part, f, atom)
            ids = part.select("id")
            pruned = ids if pruned is None else pruned.unionByName(ids)
        self.counters["applied"] += 1
        self.last = "none"
        if len(guide.groups) == 1:
            return df.join(pruned, "id", "left_semi")
        return df.join(pruned.distinct(), "id", "left_semi")

    def _prune(self, df: DataFrame, f: Fragment, atom: P.Atom) -> DataFrame:
        if f.kind == "exact":
            return df.join(f.data, "id", "left_anti" if atom.negated else "left_semi")
        if f.kind == "page":
            return df.withColumn("page", F.floor(F.col("id") / self.settings.page_rows)).join(f.data, "page", "left_semi").drop("page")
        assert isinstance(f.data, Bloom)
        return df.where(may_contain(f.data))

    def _refuse(self, table: str, guide: P.Guide | None, actual: object) -> str | None:
        if guide is None:
            return "no_guide"
        if len(guide.atoms) > self.settings.most_atoms:
            return "too_many_atoms"
        if any(a.negated and a.kind != "exact" for a in guide.atoms):
            return "negated_lossy"
        tree = _tree(guide)
        return None if P.implies(actual, tree) else "not_implied"

    def _bypass(self, df: DataFrame, reason: str) -> DataFrame:
        self.last = reason
        self.counters["bypassed"] += 1
        return df

    # ------------------------------------------------ adaptive life

    def activate(self, table: str, df: DataFrame, guide: P.Guide, *, probe_cost: float = 1.0, selectivity: float | None = None) -> str:
        """One request with an adaptive guide; returns the state that serves it (probing serves it unguided).

        A guide whose known ``selectivity`` is above the ceiling, or which has too many atoms, is never built.
        """
        if any(a.negated for a in guide.atoms):
            raise P.PredicateError("an adaptive guide cannot be negated")
        self.active.clear()
        key = (table, _signature(guide))
        d = self.states.setdefault(key, Descriptor())
        self.sync(table, df)
        version = self.version(table)
        if d.state == STALE or (d.version and d.version != version):
            self.counters["stale"] += 1
            d = self.states[key] = Descriptor()
        d.version, d.requests = version, d.requests + 1
        if d.requests <= self.settings.probe_requests or not admitted(selectivity or 0.0, len(guide.atoms), self.settings):
            d.state, d.probe_cost, d.probes = PROBING, d.probe_cost + probe_cost, d.probes + 1
            return d.state
        cost = d.probe_cost / max(d.probes, 1)
        if d.state in (MISSING, PROBING):
            made = [[self._use(table, df, a, "page", cost) for a in g] for g in guide.groups]
            d.state = PAGE if all(f for g in made for f in g) else PROBING
            if d.state == PAGE and guide_skip_rate([[f.skip_rate for f in g] for g in made]) < self.settings.page_min_skip:
                d.refine = True
        elif d.state == PAGE and d.refine:
            made = [[self._use(table, df, a, "bloom", cost) for a in g] for g in guide.groups]
            flat = [f for g in made for f in g]
            score = cost * guide_skip_rate([[f.skip_rate for f in g] for g in made]) / max(1, sum(f.bytes for f in flat)) if all(flat) else 0.0
            if score > 0 and score >= self.settings.min_benefit_per_byte:
                d.state = BLOOM
            d.refine = False
        return d.state

    def serve(self, table: str, df: DataFrame, guide: P.Guide, actual: object, *, probe_cost: float = 1.0, selectivity: float | None = None) -> tuple[str, DataFrame]:
        """One request end to end: (state, ``df`` pruned by the fragments of that state); the caller filters again."""
        state = self.activate(table, df, guide, probe_cost=probe_cost, selectivity=selectivity)
        if state in (PAGE, BLOOM):
            return state, self.apply(table, df, guide, actual, kind=state)
        return state, self._bypass(df, "probing")

    # ------------------------------------------------ storage

    def save(self, spark: SparkSession, folder: str) -> int:
        """Write the page and Bloom fragments; returns how many. A folder is written once."""
        rows = []
        for (table, atom, kind), f in self.fragments.items():
            if kind == "exact" or f.version != self.version(table):
                continue
            bits, path = None, None
            if kind == "bloom":
                bits = bytearray(f.data.bits.tobytes())
            else:
                path = f"{folder}/pages-{len(rows)}"
                f.data.write.parquet(path)
            rows.append((table, atom, kind, f.version, f.rows, f.total, f.bytes, f.skip_rate, f.benefit_per_byte, path, bits, f.data.size if kind == "bloom" else None))
        spark.createDataFrame(rows, STORED).write.parquet(f"{folder}/fragments")
        return len(rows)

    def load(self, spark: SparkSession, folder: str, frames: dict[str, DataFrame]) -> int:
        """Take up stored fragments of the tables in ``frames`` whose version is the present one; returns how many."""
        found = 0
        for r in spark.read.schema(STORED).parquet(f"{folder}/fragments").collect():  # one row per fragment, within the budget they were built under
            if r.relation not in frames:
                continue
            self.sync(r.relation, frames[r.relation])
            if r.version != self.version(r.relation) or not self._room(r.bytes):
                continue
            data = Bloom(np.frombuffer(bytes(r.bits), np.uint8), r.size, r.rows) if r.kind == "bloom" else spark.read.parquet(r.path)
            self.fragments[r.relation, r.atom, r.kind] = Fragment(r.kind, r.version, r.rows, r.total, r.bytes, r.skip_rate, data, r.benefit, self.clock)
            found += 1
        return found

    def state(self, table: str, guide: P.Guide) -> str:
        d = self.states.get((table, _signature(guide)))
        return d.state if d else MISSING

    def reset(self) -> None:
        """Forget guides and counters; fragments stay."""
        self.states.clear()
        self.counters = dict.fromkeys(self.counters, 0)
        self.last = "none"

    def profile(self) -> str:
        """Counters and fragments as JSON."""
        kinds = {k: sum(f.kind == k for f in self.fragments.values()) for k in ("exact", "page", "bloom")}
        return json.dumps({"counters": self.counters, "fragments": kinds, "bytes": sum(f.bytes for f in self.fragments.values()), "last_bypass": self.last}, sort_keys=True)


STORED = "relation string, atom string, kind string, version string, rows bigint, total bigint, bytes bigint, skip_rate double, benefit double, path string, bits binary, size bigint"


def _signature(guide: P.Guide) -> str:
    return "|".join("&".join(a.text for a in g) for g in guide.groups)


def _tree(guide: P.Guide) -> object:
    groups = [P.And(tuple(P.Not(a.tree) if a.negated else a.tree for a in g)) for g in guide.groups]
    return groups[0] if len(groups) == 1 else P.Or(tuple(groups))


def admitted(selectivity: float, atoms: int, settings: Settings) -> bool:
    """Whether a guide is worth building: selective enough, and not too many atoms."""
    return selectivity <= settings.selectivity_ceiling and atoms <= settings.most_atoms
