"""Filling containers of fixed capacity with items by minimum bin slack.

Items are spread over shards; a shard knows only how many items of each length it has. It fills one kind of
container at a time: the longest length left is placed, and over the other lengths (a multiset; a window of them first,
all where that leaves a gap) a subset sum program on bitsets finds the content that comes closest to the capacity; walking the bitsets back gives how
often each length is taken, and the same content is repeated as long as the lengths last. Containers that stay
short of ``full`` are emptied again and their items packed in a second round over fewer shards, so that the loss at
the shard borders does not add up. The rounds end with one shard, which by then holds a bounded remainder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.session import drop_stored, stored

#: a run of letters, digits and underscores, or any other single character that is not white space
TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(df: DataFrame, record: str, text: str) -> DataFrame:
    """(id, tokens): the number of tokens of the whole text; null and blank texts have 0. Null ids are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = TOKEN.findall
        for b in batches:
            n = [len(find(t)) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64())], names=["id", "tokens"])

    rows = df.where(F.col(f"`{record}`").isNotNull()).select(F.col(f"`{record}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "id bigint, tokens bigint")


def fill(counts: np.ndarray, capacity: int, window: int = 48) -> list[tuple[int, dict[int, int]]]:
    """Contents of containers for ``counts[length]`` items of each length: (times, {length: how many}).

    Minimum bin slack with the longest item left as the fixed one. Of all shorter lengths, each as often as it is left
    (at most what fits), the multiset closest to the capacity is taken. ``window`` lengths are tried first, the others
    only where these do not reach the capacity.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, dict[int, int]]] = []
    lengths = [int(x) for x in np.flatnonzero(left[1:]) + 1][::-1]
    while lengths:
        big = lengths[0]
        room = capacity - big
        content = {big: 1}
        # the window: lengths that fit, the longest first, and the shortest ones so that small gaps can be closed;
        # the lengths between them follow
        fits = [x for x in lengths if x <= room]
        if len(fits) > window:
            a, b = window - window // 3, len(fits) - window // 3
            fits = fits[:a] + fits[b:] + fits[a:b]
        mask, sets, steps = (1 << (room + 1)) - 1, [1], []
        for x in fits:
            have, size = min(int(left[x]) - (x == big), room // x), 1
            while have > 0 and not sets[-1] >> room & 1:  # counts in powers of two: few shifts for many items
                take = min(size, have)
                sets.append((sets[-1] | sets[-1] << (take * x)) & mask)
                steps.append((x, take))
                have, size = have - take, size * 2
            if sets[-1] >> room & 1:
                break
        at = sets[-1].bit_length() - 1
        for (x, take), before in zip(reversed(steps), reversed(sets[:-1])):
            if not before >> at & 1:
                content[x] = content.get(x, 0) + take
                at -= take * x
        times = min(int(left[x]) // c for x, c in content.items())
        for x, c in content.items():
            left[x] -= times * c
        out.append((times, content))
        lengths = [x for x in lengths if left[x] > 0]
    return out


def pack(items: DataFrame, *, capacity: int, shard_items: int = 50_000, full: float = 0.999, window: int = 48) -> DataFrame:
    """(container, id, piece, tokens): every item of ``items`` (id, tokens) in a container.

    An item longer than ``capacity`` is split into pieces of the capacity and a rest (piece 0, 1, ...), no other item
    is. Items of length 0 take no space: they share container 'empty'. Null lengths count as 0; repeated ids are
    items of their own; extra columns are ignored; an empty table gives no rows. No container exceeds the capacity.
    Which container an item gets may differ between runs, the fill does not.
    """
    rows = items.select("id", F.greatest(F.coalesce(F.col("tokens"), F.lit(0)), F.lit(0)).cast("bigint").alias("tokens"))
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / capacity).cast("int") - 1, F.lit(0)))
    pieces = rows.select("id", "tokens", F.explode(cuts).alias("piece")).select("id", "piece", F.when(F.col("piece") < whole, F.lit(capacity)).otherwise(F.col("tokens") - whole * capacity).cast("bigint").alias("tokens"))
    pieces = stored(pieces, "pieces")
    rest, done, level = pieces.where((F.col("tokens") > 0) & (F.col("tokens") < capacity)), [], 0
    done.append(pieces.where(F.col("tokens") == 0).select(F.lit("empty").alias("container"), "id", "piece", "tokens"))
    done.append(pieces.where(F.col("tokens") == capacity).select(F.concat_ws("-", F.lit("full"), "id", "piece").alias("container"), "id", "piece", "tokens"))
    n = rest.count()
    while n:
        shards = max(1, -(-n // shard_items))
        last = shards == 1
        # at the last level everything is accepted; before, containers below `full` give their items back
        placed = stored(_shards(rest, shards, capacity, 0.0 if last else full, window, level), "packed")
        done.append(placed.where("container IS NOT NULL"))
        if last:
            break
        rest = placed.where("container IS NULL").select("id", "piece", "tokens")
        left = rest.count()
        if left > 0.9 * n:  # lengths that cannot fill containers (all just above half, say): accept what they give
            done[-1] = _shards(rest, shards, capacity, 0.0, window, level + 1).unionByName(done[-1])
            break
        n, level = left, level + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def _shards(pieces: DataFrame, shards: int, capacity: int, full: float, window: int, level: int) -> DataFrame:
    """Packs each shard on its own; the container of an item is null where its container stays short of ``full``."""

    def run(table: pa.Table) -> pa.Table:
        tokens = table["tokens"].to_numpy()
        shard = table["shard"][0].as_py()
        counts = np.bincount(tokens, minlength=capacity + 1)
        order = np.lexsort((table["piece"].to_numpy(), table["id"].to_numpy(), tokens))
        at = np.searchsorted(tokens[order], np.arange(capacity + 2))
        nxt = at[:-1].copy()
        names: list[str | None] = [None] * len(order)
        number = 0
        for times, content in fill(counts, capacity, window):
            keep = sum(x * c for x, c in content.items()) >= full * capacity
            for _ in range(times):
                name = f"{level}-{shard}-{number}" if keep else None
                number += 1
                for x, c in content.items():
                    for q in order[nxt[x] : nxt[x] + c]:
                        names[q] = name
                    nxt[x] += c
        return pa.table({"container": pa.array(names, pa.string()), "id": table["id"], "piece": table["piece"], "tokens": table["tokens"]})

    shard = F.pmod(F.xxhash64("id", "piece", F.lit(level)), F.lit(shards)).cast("int")
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "container string, id bigint, piece int, tokens bigint")


def containers(packed: DataFrame) -> DataFrame:
    """(container, items, used): contents of every container."""
    return packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("used"))


def split_items(packed: DataFrame) -> DataFrame:
    """(id): the items that were split over containers."""
    return packed.where("piece > 0").select("id").distinct()


__all__ = ["containers", "count_tokens", "drop_stored", "fill", "pack", "split_items"]
