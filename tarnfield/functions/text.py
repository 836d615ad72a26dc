"""Text functions: cleaning, prices, stable hashes, field extraction and similarity hashes."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words left out of labels and hashes.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "i", "in", "is", "it", "its", "my", "not", "of", "on", "or", "so", "that", "the", "this", "to", "was", "we", "were", "with", "you")


def one_line(c: Column | str) -> Column:
    """Line breaks and runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def price(c: Column | str) -> Column:
    """First number of a price text, thousands separators removed; null if there is none."""
    digits = F.regexp_extract(F.regexp_replace(c, ",", ""), r"(\d+(?:\.\d+)?)", 1)
    return F.when(digits != "", digits.cast("double"))


def plain(c: Column | str) -> Column:
    """Lower case, line-break markup and punctuation removed."""
    c = F.regexp_replace(F.lower(c), r"<br\s*/?>", " ")
    return one_line(F.regexp_replace(c, r"[^a-z0-9 ]", " "))


def content_words(c: Column | str) -> Column:
    """Words of the plain text without the common ones."""
    return F.filter(F.split(plain(c), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def fnv1a_mod(n: int):
    """Pandas function: 64-bit FNV-1a of the UTF-8 bytes, modulo n (unsigned arithmetic has no SQL form)."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> int | None:
            if t is None:
                return None
            h = 0xCBF29CE484222325
            for b in t.encode():
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            return h % n

        return s.map(one, na_action=None)

    return run


@F.pandas_udf(T.StringType())
def simhash64(s: pd.Series) -> pd.Series:
    """64-bit similarity hash of the content words (hex): the sign, bit by bit, of the sum over word hashes. The bits of
    a word are worked out once per batch, and a text adds up rows of them."""
    stop, word = set(STOP_WORDS), re.compile(r"[a-z0-9]+")
    number: dict[str, int] = {}
    rows = [None if t is None else [number.setdefault(w, len(number)) for w in word.findall(t.lower()) if w not in stop] for t in s]
    digests = b"".join(hashlib.sha1(w.encode()).digest()[:8] for w in number)
    signs = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1

    def one(at: list[int] | None) -> str | None:
        if at is None:
            return None
        total = signs[at].sum(axis=0) if at else np.zeros(64, np.int32)
        return np.packbits(total > 0).tobytes().hex()

    return pd.Series([one(at) for at in rows], dtype=object)


def simhash_bands(c: Column, bands: int = 4) -> Column:
    """The hash cut into equal bands, as bucket keys 'i:band' for finding near texts."""
    width = 16 // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.concat_ws(":", i.cast("string"), F.substring(c, i * width + 1, F.lit(width))))


def fields(c: Column | str, patterns: dict[str, str]) -> Column:
    """Struct with the first match of each named pattern, null where it does not match."""
    return F.struct(*(F.when(F.regexp_extract(c, p, 0) != "", F.regexp_extract(c, p, 0)).alias(k) for k, p in patterns.items()))


#: Families of requirements in a request text, and the words and phrases that name them.
FAMILIES = {
    "price": r"cheap|affordable|budget|bargain|inexpensive|expensive|price|worth (?:the )?(?:money|price|penny)|high price|low price|cost",
    "rating_sentiment": r"excellent|perfect|great|best|amazing|love|loved|favorite|highly recommend|worth|no complaints|exceeds expectations",
    "color": r"black|white|red|blue|green|yellow|pink|purple|orange|grey|gray|brown|beige|silver|gold|clear|transparent|color|colour|space grey",
    "size_fit": r"small|large|medium|compact|portable|lightweight|heavy|fit|fits|size|sized|slim|wide|narrow|inch|inches|2t|12-18 month|petite",
    "material": r"cotton|polyester|wood|wooden|metal|steel|plastic|silicone|leather|fabric|glass|ceramic|rubber|fur",
    "compatibility": r"compatible|works with|macbook|ipad|iphone|android|apple|usb c|usb-c|cpap|rv|apartment|laptop|phone|galaxy|kindle|xbox|playstation|ps5|switch",
    "audience": r"kids|children|child|toddler|baby|babies|dog|dogs|cat|cats|pet|pets|women|men|wife|husband|grandkids|students|teachers",
    "occasion_use": r"halloween|christmas|birthday|wedding|summer|winter|beach|travel|camping|office|garden|home|bath|kitchen|laundry|sleep|school|work|yard",
    "health_safety": r"healthy|toxic-free|non-toxic|sensitive|eczema|pain|support|air quality|dust|allergy|allergies|safe|safety",
    "feature": r"waterproof|water resistant|rechargeable|automatic|adjustable|foldable|sturdy|soft|comfortable|durable|easy to|easy-to|lather|scent|pocket|kickstand|charger|ethernet|shade|support|dryer",
    "negative_constraint": r"not too|doesn't|does not|won't|will not|without|no\s+[a-z]+|avoid|shouldn't|should not",
}


def request_text(c: Column | str) -> Column:
    """A request in lower case, plain apostrophes, line-break markup and runs of white space as one space."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "’", "'"), r"<br\s*/?>", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def family_terms(text: Column | str, family: str) -> Column:
    """The distinct terms of a family that a (plain) request names, in their order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b(?:{FAMILIES[family]})\b"), F.lit(0)))


def without_families(text: Column | str) -> Column:
    """The request with everything that names a family blanked out: what is left for the vector."""
    every = "|".join(FAMILIES.values())
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"\b(?:{every})\b", " "), r"\s+", " "))


def mask(c: Column | str, pattern: str, mark: str = "<x>") -> Column:
    """Matched spans replaced by a mark."""
    return F.regexp_replace(c, pattern, mark)


def shuffle_key(c: Column | str) -> Column:
    """Key of a deterministic shuffle."""
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("string"))
