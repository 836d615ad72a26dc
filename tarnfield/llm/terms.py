"""Frequency of every distinct term by last-seen counters.

Records are hash-partitioned by their id, each partition's tokens are sorted by (term, record), and one counter per
term runs over the stream: it holds the occurrences, the records and the last record seen. A record is counted when
it differs from the last one, so no set of records is ever kept, and a term held by a third of all records costs
one partial row per partition instead of one hot reducer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.session import stored


def term_records(df: DataFrame, record: str, terms: str, *, field: str, ignore: int | str | None = -1, kind: str = "bigint") -> DataFrame:
    """(field, record, terms): the distinct lists of every record; null records are dropped, repeats collapse.

    Repeated rows of a record with the same list count once; lists that differ all belong to the record. ``kind`` is
    the type of the terms, 'bigint' or 'string'; ``ignore`` is a term that does not count, null for none.
    """
    lists = F.filter(F.col(f"`{terms}`").cast(f"array<{kind}>"), lambda t: t.isNotNull() & (t != F.lit(ignore)) if ignore is not None else t.isNotNull())
    rows = df.where(F.col(f"`{record}`").isNotNull()).select(
        F.lit(field).alias("field"), F.col(f"`{record}`").cast("bigint").alias("record"), F.coalesce(lists, F.expr("array()")).cast(f"array<{kind}>").alias("terms")
    )
    return rows.groupBy("field", "record").agg(F.flatten(F.collect_set("terms")).alias("terms"))


def count_terms(records: DataFrame, *, totals: bool = False) -> DataFrame:
    """(field, term, occurrences, records) of a frame (field, record, terms) with one row per record.

    Empty lists give no terms; an empty frame gives no rows. ``records`` must be partitioned so that a record lies in
    one partition, which holds after :func:`term_records`. ``totals`` adds a row per field whose term is null and whose
    ``records`` are all records of the field, those with an empty list included.
    """
    kind = records.schema["terms"].dataType.elementType.simpleString()
    terms = F.concat("terms", F.array(F.lit(None).cast(kind))) if totals else F.col("terms")
    tokens = records.select("field", "record", F.explode(terms).alias("term")).sortWithinPartitions("field", "term", "record")

    def last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: tuple | None = None  # the counter that may go on in the next batch: field, term, occurrences, records, last record
        for batch in batches:
            if not batch.num_rows:
                continue
            field, term, rec = batch["field"].dictionary_encode(), batch["term"], batch["record"].to_numpy()
            names, f = field.dictionary.to_pylist(), field.indices.to_numpy()
            coded = term.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.r_[True, (coded[1:] != coded[:-1]) | (f[1:] != f[:-1])]
            fresh = first | np.r_[True, rec[1:] != rec[:-1]]  # differs from the last record seen for its term
            at = np.flatnonzero(first)
            occ, recs = np.diff(np.r_[at, len(rec)]), np.add.reduceat(fresh.astype(np.int64), at)
            fields, terms, last = [names[i] for i in f[at]], term.take(pa.array(at)).to_pylist(), rec[np.r_[at[1:], len(rec)] - 1]
            out: list[tuple] = []
            if open_row:
                if open_row[:2] == (fields[0], terms[0]):
                    occ[0] += open_row[2]
                    recs[0] += open_row[3] - (open_row[4] == int(rec[0]))
                else:
                    out.append(open_row[:4])
            end = len(at) - 1
            open_row = (fields[end], terms[end], int(occ[end]), int(recs[end]), int(last[end]))
            yield _rows([x[0] for x in out] + fields[:end], [x[1] for x in out] + terms[:end], np.r_[[x[2] for x in out], occ[:end]], np.r_[[x[3] for x in out], recs[:end]])
        if open_row:
            yield _rows([open_row[0]], [open_row[1]], *(np.array([x]) for x in open_row[2:4]))

    def _rows(fields: list, terms: list, *numbers: np.ndarray) -> pa.RecordBatch:
        types = {"bigint": pa.int64(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(terms, types[kind]), *(pa.array(x.astype(np.int64)) for x in numbers)], names=["field", "term", "occurrences", "records"])

    partial = tokens.mapInArrow(last_seen, f"field string, term {kind}, occurrences bigint, records bigint")
    return partial.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(records: DataFrame, *, rare_below: int = 5, common_share: tuple[int, int] = (1, 10)) -> DataFrame:
    """(field, term, occurrences, records, mark): mark is 'rare' below ``rare_below`` records, 'common' above the
    share of all records of the field, else null. A term that is both (a tiny table) is marked rare.

    Terms and totals come from one pass over the records; the counts, one row per term, are written before they are
    used for both.
    """
    counts = stored(count_terms(records, totals=True), "term-counts")
    totals = counts.where("term IS NULL").select("field", F.col("records").alias("total"))
    num, den = common_share
    # one row per field (the fields are literals of the caller), so the join needs no shuffle of the terms
    return (
        counts.where("term IS NOT NULL")
        .join(F.broadcast(totals), "field")
        .withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") * den > F.col("total") * num, "common"))
        .drop("total")
    )
