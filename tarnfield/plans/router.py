"""Choosing routes and configurations from measurements, workload selection, request traces and schedules."""

from __future__ import annotations

import random
import statistics
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.operators.relational import distinct_on


@dataclass(frozen=True)
class Route:
    chosen: str
    reason: str
    prefilter_mean: float
    index_mean: float


def calibrate(prefilter_ms: Sequence[float], index_ms: Sequence[float], *, least: int = 3, most_cv: float = 0.5, guard: float = 0.1) -> Route:
    """Prefilter only if there are enough samples, they are steady, and its guarded mean is the smaller one."""
    if len(prefilter_ms) < least or len(index_ms) < least:
        return Route("index", "few_samples", 0.0, 0.0)
    p, h = statistics.fmean(prefilter_ms), statistics.fmean(index_ms)
    if max(statistics.stdev(prefilter_ms) / max(p, 1e-12), statistics.stdev(index_ms) / max(h, 1e-12)) > most_cv:
        return Route("index", "unsteady", p, h)
    return Route("prefilter", "faster", p, h) if p * (1 + guard) < h else Route("index", "not_faster", p, h)


def flat_cutoff(rows: int, cutoff: int) -> str:
    """Exact scan for an allow-list below the cutoff, else the index."""
    return "flat" if rows < cutoff else "index"


def self_exclusion(inside_table: bool, in_sql: bool, k: int) -> tuple[bool, int]:
    """(predicate on the id?, rows to ask for): a query from outside the table needs neither."""
    if not inside_table:
        return False, k
    return (True, k) if in_sql else (False, k + 1)


def select_config(summaries: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """Configuration of lowest latency whose recall reaches the target (then by config); no row if none does."""
    ok = summaries.where(F.col("recall") >= target)
    if by:
        return distinct_on(ok, list(by), [F.col("latency"), F.col("config")])
    return ok.orderBy("latency", "config").limit(1)


def closest_config(summaries: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """Configuration whose recall is closest to the target, then of lowest latency."""
    rows = summaries.withColumn("gap", F.abs(F.col("recall") - target))
    return distinct_on(rows, list(by), [F.col("gap"), F.col("latency"), F.col("config")]) if by else rows.orderBy("gap", "latency", "config").limit(1)


def calibration_outcome(recalls: dict[str, float], ladder: Sequence[str], target: float) -> tuple[str, str | None]:
    """('attainable', config), ('unattainable', None) if the whole ladder was run, else ('indeterminate', None)."""
    for config in ladder:
        if config not in recalls:
            return "indeterminate", None
        if recalls[config] >= target:
            return "attainable", config
    return "unattainable", None


def ladder(configs: Sequence[str], measure, target: float) -> dict[str, float]:
    """Measures configurations from the cheapest on, until one reaches the target."""
    found: dict[str, float] = {}
    for c in configs:
        found[c] = measure(c)
        if found[c] >= target:
            break
    return found


def nearest_to_targets(counted: Sequence[tuple[str, float]], targets: Sequence[float], per_target: int = 1) -> list[tuple[float, str, float]]:
    """Greedy choice per target of the unused filter whose selectivity is closest (ties: by name)."""
    used: set[str] = set()
    out = []
    for t in targets:
        for _ in range(per_target):
            free = [(abs(s - t), n, s) for n, s in counted if n not in used]
            if free:
                _, name, s = min(free)
                used.add(name)
                out.append((t, name, s))
    return out


def disjoint_samples(ids: Sequence[int], sizes: Sequence[int], seed: int) -> list[list[int]]:
    """Seeded samples without replacement that do not share ids (calibration and held-out sets)."""
    if sum(sizes) > len(ids):
        raise ValueError("more ids asked for than there are")
    drawn = random.Random(seed).sample(sorted(ids), sum(sizes))
    out, at = [], 0
    for n in sizes:
        out.append(drawn[at : at + n])
        at += n
    return out


@dataclass(frozen=True)
class Request:
    request_no: int
    phase: int
    window: int
    filter_name: str
    query_id: int
    reuse_distance: int | None


def build_trace(filters: Sequence[str], query_ids: Sequence[int], *, requests: int, window: int, seed: int, reuse: float = 0.78, hot: float = 0.88, hot_size: int = 4) -> list[Request]:
    """Requests over seeded ranks of the filters, whose hot set changes half-way.

    The first ``hot_size`` filters by rank are hot in the first half, the next ones in the second. With probability
    ``reuse`` the filter of the request before stays, if it is hot; else a hot one is drawn with probability ``hot``,
    or any other one, each by Zipf weights in the order of rank. ``reuse_distance`` counts the requests since the last
    one with the same filter.
    """
    if requests <= 0 or window <= 0 or requests % window:
        raise ValueError("requests must be positive and a multiple of the window")
    rng = random.Random(seed)
    ranked = rng.sample(list(filters), len(filters))
    draw = lambda names: rng.choices(names, [1 / (i + 1) for i in range(len(names))])[0]
    out: list[Request] = []
    seen: dict[str, int] = {}
    for n in range(requests):
        phase = 2 * n // requests
        warm = ranked[phase * hot_size : (phase + 1) * hot_size] or ranked[:hot_size]
        cold = [f for f in ranked if f not in warm] or warm
        f = out[-1].filter_name if out else None
        if f not in warm or rng.random() >= reuse:
            f = draw(warm if rng.random() < hot else cold)
        out.append(Request(n, phase, n // window, f, rng.choice(list(query_ids)), n - seen[f] if f in seen else None))
        seen[f] = n
    return out


def lifecycle(states: Sequence[str]) -> str:
    """What a fragment went through: its states without repetition, joined by arrows."""
    out: list[str] = []
    for s in states:
        if not out or out[-1] != s:
            out.append(s)
    return "->".join(out)


def interleaved(modes: Sequence[str], blocks: int) -> list[list[str]]:
    """Order of modes per block, rotated so that each takes each place equally often."""
    return [[*modes[b % len(modes) :], *modes[: b % len(modes)]] for b in range(blocks)]


def ab_ba(blocks: int) -> list[str]:
    """Alternating AB and BA."""
    return ["AB" if b % 2 == 0 else "BA" for b in range(blocks)]


def order_jobs(jobs: Sequence[tuple[str, float, float]], how: str, seed: int = 0) -> list[str]:
    """Job names (name, filter cost, vector cost) in the order asked for: given, random, extremes or alternating."""
    if how == "given":
        return [j[0] for j in jobs]
    if how == "random":
        names = [j[0] for j in jobs]
        random.Random(seed).shuffle(names)
        return names
    by = sorted(jobs, key=lambda j: (j[1] + j[2] if how == "extremes" else j[1] - j[2], j[0]))
    if how not in ("extremes", "alternating"):
        raise ValueError(f"no such order: {how}")
    out = []
    while by:
        out.append(by.pop(0)[0])
        if by:
            out.append(by.pop()[0])
    return out


def run_concurrently(jobs: dict[str, object], workers: int = 4) -> dict[str, object]:
    """Runs independent jobs (callables) from several threads; with the FAIR scheduler they share the executors."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(workers) as pool:
        futures = {name: pool.submit(inheritable_thread_target(job)) for name, job in jobs.items()}
        return {name: f.result() for name, f in futures.items()}


def plan_shape(df: DataFrame) -> dict[str, int]:
    """Operators of the physical plan that decide its cost: shuffles, broadcasts, joins, top-k, Python."""
    text = df._jdf.queryExecution().executedPlan().toString()
    names = ("ShuffleExchange", "Exchange hash", "Exchange range", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "TakeOrderedAndProject", "WindowGroupLimit", "MapInArrow", "ArrowEvalPython")
    return {n: text.count(n) for n in names if n in text}
