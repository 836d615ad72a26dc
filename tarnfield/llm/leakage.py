"""Evaluation texts inside a corpus: Wu-Manber multi-pattern search over words.

Patterns are the distinct sequences of 5 consecutive words of the test items. A position of the search window is
looked up by its block, the last two words of the window: the shift table says how far the window can move before
any pattern can end there (4 words for a block that no pattern contains). Only where the shift is 0 does the bucket
of that block, its suffix hash, give the patterns to compare word for word. The windows of many stretches of text
move at the same time, as arrays.

Words are numbered by a dictionary of the words in patterns; every other word is 0, so equal numbers are equal
words and the comparison is exact.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: words of a pattern, words of a block
LENGTH, BLOCK = 5, 2
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits after NFKC and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.lower())


class Patterns:
    """Shift table, suffix buckets and owners of the patterns of a bounded block of test items."""

    def __init__(self, items: list[tuple[int, str | None]], table_bits: int | None = None):
        grams: dict[tuple[str, ...], int] = {}
        owners: list[list[int]] = []
        self.number: list[int] = []  # of each test item
        self.total: list[int] = []  # distinct sequences of each test item
        for number, text in items:
            w = words(text)
            own = {tuple(w[i : i + LENGTH]) for i in range(len(w) - LENGTH + 1)}
            if own:
                for g in own:
                    p = grams.setdefault(g, len(grams))
                    if p == len(owners):
                        owners.append([])
                    owners[p].append(len(self.number))
                self.number.append(number)
                self.total.append(len(own))
        self.vocabulary: dict[str, int] = {}
        for g in grams:
            for w in g:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.words = np.array([[self.vocabulary[w] for w in g] for g in grams], np.int32).reshape(-1, LENGTH)
        self.owner_at = np.r_[0, np.cumsum([len(o) for o in owners])].astype(np.int64)
        self.owner = np.array([x for o in owners for x in o], np.int64)
        # about eight places for every block of the patterns, so that few blocks share one by chance and shifts stay long
        self.mask = (1 << (table_bits or min(24, max(16, (8 * (LENGTH - BLOCK + 1) * len(grams)).bit_length())))) - 1
        # shift of a block: distance from its last place in any pattern to the end of the pattern
        self.shift = np.full(self.mask + 1, LENGTH - BLOCK + 1, np.uint8)
        for end in range(BLOCK, LENGTH + 1):
            code = self.code(self.words[:, end - 2], self.words[:, end - 1])
            np.minimum.at(self.shift, code, np.uint8(LENGTH - end))
        suffix = self.code(self.words[:, -2], self.words[:, -1])
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.order], np.arange(self.mask + 2))

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x >> np.uint64(29)) & np.uint64(self.mask)).astype(np.int64)

    def occurrences(self, text: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of every occurrence in an array of word numbers.

        Documents are to be separated by at least LENGTH - 1 zeros. The text is cut into stretches of ``lane``
        window ends, searched side by side.
        """
        n = len(text)
        if n < LENGTH or not len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        shift = self.shift
        pos = np.arange(LENGTH - 1, n, lane, dtype=np.int64)
        end = np.minimum(pos + lane, n)
        hits = []
        while len(pos):
            step = shift[self.code(text[pos - 1], text[pos])]
            hits.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            inside = pos < end
            pos, end = pos[inside], end[inside]
        at = np.concatenate(hits)
        block = self.code(text[at - 1], text[at])
        many = self.bucket[block + 1] - self.bucket[block]
        where = np.repeat(at, many)
        pattern = self.order[np.repeat(self.bucket[block], many) + _within(many)]
        same = np.ones(len(where), bool)
        for back in range(LENGTH):  # direct comparison, word by word
            same[same] = text[where[same] - back] == self.words[pattern[same], LENGTH - 1 - back]
        return where[same], pattern[same]


def _within(many: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given lengths."""
    total = int(many.sum())
    return np.arange(total) - np.repeat(np.cumsum(many) - many, many)


def leaked(corpus: DataFrame, record: str, text: str, items: DataFrame, number: str, item_text: str, *, share: tuple[int, int] = (2, 5), items_at_once: int = 5_000, characters_at_once: int = 4_000_000) -> DataFrame:
    """(doc_id, query_no, found, total): documents that hold at least ``share`` of the distinct 5-word sequences of
    a test item, with how many of them.

    Test items are taken to the tasks in blocks of about ``items_at_once`` items and ``characters_at_once``
    characters (the bound of what is sent), one pass over the corpus each. Null ids are dropped; null, empty and
    shorter texts hold and give no sequences; repeated rows of a document are searched each and reported once; equal
    test texts are all reported; empty tables give no rows.
    """
    docs = corpus.where(F.col(f"`{record}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{record}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    tests = items.where(F.col(f"`{number}`").isNotNull() & F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{number}`").cast("bigint").alias("no"), F.col(f"`{item_text}`").alias("text"))
    size = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-size.n // items_at_once), -(-size.c // characters_at_once))
    result = None
    for b in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == b)
        found = docs.mapInArrow(_search(Patterns([(r.no, r.text) for r in part.collect()]), share), "doc_id bigint, query_no bigint, found bigint, total bigint")
        result = found if result is None else result.unionByName(found)
    return result.groupBy("doc_id", "query_no").agg(F.max("found").alias("found"), F.max("total").alias("total"))


def _search(patterns: Patterns, share: tuple[int, int]):
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, pad = patterns.vocabulary.get, [0] * (LENGTH - 1)
        total, number = np.array(patterns.total, np.int64), np.array(patterns.number, np.int64)
        for batch in batches:
            ids, out = batch["id"].to_numpy(), [np.empty((0, 4), np.int64)]
            texts = batch["text"].to_pylist()
            start = 0
            while start < len(texts):  # so many documents at once that their words fit in memory
                numbers: list[int] = []
                bounds, end = [0], start
                while end < len(texts) and (end == start or len(numbers) < 2_000_000):
                    numbers += [get(w, 0) for w in words(texts[end])]
                    numbers += pad
                    bounds.append(len(numbers))
                    end += 1
                at, pattern = patterns.occurrences(np.array(numbers, np.int32))
                doc = np.searchsorted(bounds, at, side="right") - 1
                pairs = np.unique(doc * len(patterns.words) + pattern)  # distinct sequences of each document
                doc, pattern = pairs // max(len(patterns.words), 1), pairs % max(len(patterns.words), 1)
                many = patterns.owner_at[pattern + 1] - patterns.owner_at[pattern]
                item = patterns.owner[np.repeat(patterns.owner_at[pattern], many) + _within(many)]
                key, count = np.unique(np.repeat(doc, many) * len(total) + item, return_counts=True)
                doc, item = key // max(len(total), 1), key % max(len(total), 1)
                enough = count * den >= total[item] * num
                out.append(np.stack([ids[start + doc[enough]], number[item[enough]], count[enough], total[item[enough]]], axis=1))
                start = end
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(4)], names=["doc_id", "query_no", "found", "total"])

    return run
