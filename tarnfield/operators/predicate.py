"""Predicates as typed trees: a whitelisting parser, DNF with its limits, implication, and columns.

Nothing of a predicate text is ever evaluated: it is parsed into nodes over declared columns, and anything outside
the grammar fails.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.arrays import contains_all, overlaps

MOST_ATOMS, MOST_TEXT, MOST_ATOM_TEXT = 128, 64 * 1024, 256


class PredicateError(ValueError):
    """The text is no admissible predicate."""


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: object

    def to_column(self) -> Column:
        c, v = F.col(self.column), F.lit(self.value)
        return {"=": c == v, "<>": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op]


@dataclass(frozen=True)
class Flag:
    column: str

    def to_column(self) -> Column:
        return F.col(self.column)


@dataclass(frozen=True)
class IsNull:
    column: str

    def to_column(self) -> Column:
        return F.col(self.column).isNull()


@dataclass(frozen=True)
class ArrayTest:
    """Contains all (@>) or overlaps (&&) the values."""

    column: str
    op: str
    values: tuple

    def to_column(self) -> Column:
        return (contains_all if self.op == "@>" else overlaps)(self.column, list(self.values))


@dataclass(frozen=True)
class Not:
    part: object

    def to_column(self) -> Column:
        return ~self.part.to_column()


@dataclass(frozen=True)
class And:
    parts: tuple

    def to_column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.to_column() for p in self.parts))


@dataclass(frozen=True)
class Or:
    parts: tuple

    def to_column(self) -> Column:
        return reduce(lambda a, b: a | b, (p.to_column() for p in self.parts))


_TOKEN = re.compile(r"\s*(?:(?P<num>-?\d+(?:\.\d+)?)|(?P<str>'(?:[^']|'')*')|(?P<op><=|>=|<>|!=|@>|&&|=|<|>)|(?P<punct>[(){}\[\],])|(?P<cast>::\w+\[\])|(?P<word>[A-Za-z_]\w*))")
_KEYWORDS = {"and", "or", "not", "is", "null", "array", "true", "false", "between"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PredicateError(f"not allowed at {at}: {text[at : at + 12]!r}")
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "word" and value.lower() in _KEYWORDS:
            kind, value = "key", value.lower()
        if kind == "cast" and value not in ("::int[]", "::bigint[]", "::text[]"):
            raise PredicateError(f"cast not allowed: {value}")
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]], columns: dict[str, str]):
        self.t, self.at, self.columns = tokens, 0, columns

    def peek(self) -> tuple[str, str]:
        return self.t[self.at] if self.at < len(self.t) else ("end", "")

    def take(self, *want: str) -> tuple[str, str]:
        got = self.peek()
        if want and got[1] not in want:
            raise PredicateError(f"expected {' or '.join(want)}, found {got[1] or 'the end'}")
        self.at += 1
        return got

    def disjunction(self):
        parts = [self.conjunction()]
        while self.peek() == ("key", "or"):
            self.take()
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def conjunction(self):
        parts = [self.term()]
        while self.peek() == ("key", "and"):
            self.take()
            parts.append(self.term())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def term(self):
        if self.peek() == ("key", "not"):
            self.take()
            return Not(self.term())
        if self.peek()[1] == "(":
            self.take()
            inner = self.disjunction()
            self.take(")")
            return inner
        kind, name = self.take()
        if kind != "word" or name not in self.columns:
            raise PredicateError(f"no such column: {name}")
        kind, op = self.peek()
        if (kind, op) == ("key", "is"):
            self.take()
            negated = self.peek() == ("key", "not") and bool(self.take())
            self.take("null")
            return Not(IsNull(name)) if negated else IsNull(name)
        if (kind, op) == ("key", "between"):
            self.take()
            low = self.value()
            self.take("and")
            return And((Compare(name, ">=", low), Compare(name, "<=", self.value())))
        if kind != "op":
            if self.columns[name] != "boolean":
                raise PredicateError(f"{name} is not boolean")
            return Flag(name)
        self.take()
        if op in ("@>", "&&"):
            return ArrayTest(name, op, self.array())
        return Compare(name, "<>" if op == "!=" else op, self.value())

    def value(self):
        kind, v = self.take()
        if kind == "num":
            return float(v) if "." in v else int(v)
        if kind == "str":
            return v[1:-1].replace("''", "'")
        if v in ("true", "false"):
            return v == "true"
        raise PredicateError(f"expected a value, found {v or 'the end'}")

    def array(self) -> tuple:
        if self.peek()[0] == "str":
            text = self.take()[1][1:-1].strip("{}")
            values = tuple(int(x) if re.fullmatch(r"-?\d+", x.strip()) else x.strip() for x in text.split(",") if x.strip())
        else:
            if self.peek() == ("key", "array"):
                self.take()
            self.take("[")
            found = []
            while self.peek()[1] != "]":
                found.append(self.value())
                if self.peek()[1] == ",":
                    self.take()
            self.take("]")
            values = tuple(found)
        if self.peek()[0] == "cast":
            self.take()
        return values


def parse(text: str, columns: dict[str, str]) -> object:
    """The tree of a predicate over ``columns`` (name -> type); :class:`PredicateError` on anything else."""
    parser = _Parser(_tokens(text), columns)
    if not parser.t:
        raise PredicateError("empty predicate")
    tree = parser.disjunction()
    if parser.peek()[0] != "end":
        raise PredicateError(f"unexpected {parser.peek()[1]}")
    return tree


def parse_for(df: DataFrame, text: str) -> Column:
    """The predicate as a column of ``df``."""
    return parse(text, dict(df.dtypes)).to_column()


def sql_of(tree: object, alias: str = "") -> str:
    """SQL text of a tree, columns qualified by ``alias``."""
    dot = f"{alias}." if alias else ""
    if isinstance(tree, Compare):
        v = tree.value
        text = ("true" if v else "false") if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"({v})" if v < 0 else str(v)
        return f"{dot}{tree.column} {tree.op} {text}"
    if isinstance(tree, Flag):
        return dot + tree.column
    if isinstance(tree, IsNull):
        return f"{dot}{tree.column} IS NULL"
    if isinstance(tree, ArrayTest):
        return f"{'list_has_all' if tree.op == '@>' else 'list_has_any'}({dot}{tree.column}, [{', '.join(map(str, tree.values))}])"
    if isinstance(tree, Not):
        return f"NOT ({sql_of(tree.part, alias)})"
    return "(" + (" AND " if isinstance(tree, And) else " OR ").join(sql_of(p, alias) for p in tree.parts) + ")"


def columns_of(tree: object) -> set[str]:
    """Columns a tree reads."""
    if isinstance(tree, (And, Or)):
        return set().union(*(columns_of(p) for p in tree.parts))
    return columns_of(tree.part) if isinstance(tree, Not) else {tree.column}


# ---------------------------------------------------------------- disjunctive normal form of guides


@dataclass(frozen=True)
class Atom:
    """One reusable piece of a guide: its kind (exact, page or bloom), whether it is negated, and its predicate."""

    text: str
    tree: object = field(compare=False)
    kind: str = "exact"
    negated: bool = False

    def to_column(self) -> Column:
        return ~self.tree.to_column() if self.negated else self.tree.to_column()


@dataclass(frozen=True)
class Guide:
    """A disjunction of groups of atoms."""

    groups: tuple[tuple[Atom, ...], ...]

    @property
    def atoms(self) -> tuple[Atom, ...]:
        return tuple(a for g in self.groups for a in g)

    def to_column(self) -> Column:
        return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (x.to_column() for x in g)) for g in self.groups))


def guide(atoms: list[str], columns: dict[str, str], kind: str = "exact") -> Guide:
    """A guide from atom texts ``[!][exact|page|bloom:]predicate``; adjacent atoms are conjoined, '|' or 'OR' opens a
    new group. Only exact atoms may be negated, since the lossy kinds hold too much and their complement too little."""
    if len(atoms) - sum(a in ("|", "OR") for a in atoms) > MOST_ATOMS:
        raise PredicateError(f"more than {MOST_ATOMS} atoms")
    if sum(map(len, atoms)) > MOST_TEXT:
        raise PredicateError("guide text too long")
    groups: list[list[Atom]] = [[]]
    for a in atoms:
        if a in ("|", "OR"):
            groups.append([])
            continue
        if len(a.encode()) >= MOST_ATOM_TEXT:
            raise PredicateError("atom too long")
        negated, text, of_kind = a.startswith("!"), a.lstrip("!"), kind
        if m := re.match(r"(exact|page|bloom):", text):
            of_kind, text = m[1], text[m.end() :]
        if negated and of_kind != "exact":
            raise PredicateError("only exact atoms can be negated")
        groups[-1].append(Atom(text.removeprefix("sql:").strip(), parse(text.removeprefix("sql:"), columns), of_kind, negated))
    if not all(groups):
        raise PredicateError("empty group")
    return Guide(tuple(tuple(g) for g in groups))


def to_groups(tree: object, most: int = MOST_ATOMS) -> list[frozenset] | None:
    """Disjunctive normal form as sets of leaves; None if it has more than ``most`` leaves."""
    if isinstance(tree, Or):
        parts = [to_groups(p, most) for p in tree.parts]
        out = None if any(p is None for p in parts) else [g for p in parts for g in p]
    elif isinstance(tree, And):
        out = [frozenset()]
        for p in tree.parts:
            groups = to_groups(p, most)
            out = None if groups is None or out is None else [a | b for a in out for b in groups]
            if out is None or sum(map(len, out)) > most:
                return None
    else:
        out = [frozenset([tree])]
    return None if out is None or sum(map(len, out)) > most else out


def _leaf_implies(a: object, b: object) -> bool:
    if a == b:
        return True
    if isinstance(a, Compare) and isinstance(b, Compare) and a.column == b.column and type(a.value) in (int, float) and type(b.value) in (int, float):
        x, y = a.value, b.value
        return {
            ">=": (a.op in (">=", "=") and x >= y) or (a.op == ">" and x >= y), ">": (a.op in (">=", "=") and x > y) or (a.op == ">" and x >= y),
            "<=": (a.op in ("<=", "=") and x <= y) or (a.op == "<" and x <= y), "<": (a.op in ("<=", "=") and x < y) or (a.op == "<" and x <= y),
            "<>": a.op == "=" and x != y, "=": False,
        }[b.op]
    if isinstance(a, ArrayTest) and isinstance(b, ArrayTest) and a.column == b.column:
        if b.op == "@>":
            return a.op == "@>" and set(b.values) <= set(a.values)
        return (a.op == "@>" and bool(set(a.values) & set(b.values))) or (a.op == "&&" and set(a.values) <= set(b.values))
    return False


def implies(actual: object, wanted: object) -> bool:
    """Whether every row that satisfies ``actual`` satisfies ``wanted``, as far as clause comparison proves it."""
    a, b = to_groups(actual), to_groups(wanted)
    if a is None or b is None:
        return False
    return all(any(all(any(_leaf_implies(x, y) for x in ga) for y in gb) for gb in b) for ga in a)


#: Buckets of price and popularity, their labels and predicates.
PRICES = {
    "p_le10": "has_price AND price <= 10",
    "p_10_20": "has_price AND price > 10 AND price <= 20",
    "p_20_50": "has_price AND price > 20 AND price <= 50",
    "p_gt50": "has_price AND price > 50",
    "p_missing": "NOT has_price",
}
POPULARITY = {
    "pop_high": "item_rating_number >= 1000",
    "pop_mid": "item_rating_number >= 100 AND item_rating_number < 1000",
    "pop_low": "item_rating_number < 100",
}
#: Named predicates over the review table, and the mixed ones of five-star queries.
NAMED = {
    "helpful_ge20": "helpful_vote >= 20",
    "grocery_long500": "main_category = 'Grocery' AND review_text_len >= 500",
    "grocery_helpful": "main_category = 'Grocery' AND helpful_vote >= 1",
    "rating5_price_le10": "has_price AND price <= 10 AND rating = 5",
} | {f"c4_mixed_5_{p}_{q}": f"rating = 5 AND {x} AND {y}" for p, x in PRICES.items() for q, y in POPULARITY.items()}
#: The filter catalog by target selectivity in percent.
CATALOG = {
    "popular_ge1000": (50.0, "item_rating_number >= 1000"),
    "popular_ge1340": (45.0, "item_rating_number >= 1340"),
    "popular_ge1780": (40.0, "item_rating_number >= 1780"),
    "popular_ge2428": (35.0, "item_rating_number >= 2428"),
    "popular_ge3284": (30.0, "item_rating_number >= 3284"),
    "popular_ge4559": (25.0, "item_rating_number >= 4559"),
    "price_10_to_20": (20.0, "has_price AND price > 10 AND price <= 20"),
    "popular_ge10066": (15.0, "item_rating_number >= 10066"),
    "rating5_price_le10": (10.0, "has_price AND price <= 10 AND rating = 5"),
    "long_review_ge500": (5.0, "review_text_len >= 500"),
    "grocery_rating5": (2.0, "main_category = 'Grocery' AND rating = 5"),
    "grocery_helpful": (1.0, "main_category = 'Grocery' AND helpful_vote >= 1"),
    "helpful_ge20": (0.5, "helpful_vote >= 20"),
    "grocery_long500": (0.2, "main_category = 'Grocery' AND review_text_len >= 500"),
}
REVIEW_COLUMNS = {"id": "bigint", "rating": "double", "verified_purchase": "boolean", "helpful_vote": "int", "review_text_len": "int", "main_category": "string", "price": "double", "has_price": "boolean", "item_rating_number": "int"}


def named(name: str) -> object:
    """The tree of a named predicate, or of the text after ``sql:``; an unknown name is an error."""
    if name.startswith("sql:"):
        return parse(name.removeprefix("sql:"), REVIEW_COLUMNS)
    if name not in NAMED:
        raise PredicateError(f"no such filter: {name}")
    return parse(NAMED[name], REVIEW_COLUMNS)


def tautology(tree: object, level: int, column: str = "id") -> Column:
    """The predicate made harder to evaluate but not to satisfy: numeric (1) or text (2) tautologies added."""
    c = tree.to_column()
    if level >= 1:
        c = c & (F.col(column) * 2 - F.col(column) == F.col(column)) & (F.abs(F.col(column)) >= 0)
    if level >= 2:
        s = F.col(column).cast("string")
        c = c & (F.length(F.md5(s)) == 32) & (F.length(F.regexp_replace(s, r"\d", "x")) == F.length(s))
    return c


def _bucket_labels(has_price: bool | None, price: float | None, popularity: float | None) -> tuple[str, str]:
    cost, count = price or 0.0, int(popularity or 0)
    p = "p_missing" if has_price is not True else "p_le10" if cost <= 10 else "p_10_20" if cost <= 20 else "p_20_50" if cost <= 50 else "p_gt50"
    return p, "pop_high" if count >= 1000 else "pop_mid" if count >= 100 else "pop_low"


def derived_predicate(mode: str, *, rating: float | None = None, has_price: bool | None = None, price: float | None = None, popularity: float | None = None, category: str | None = None) -> tuple[str, str]:
    """(predicate text, key) of a query row by its ``mode``: price, popularity, mixed or mixed_category.

    The rating counts as a whole number from 1 to 5, 5 where it is missing; a missing price of a priced item counts
    as 0, a missing category as 'Grocery & Gourmet Food'. The key is a named predicate where there is one.
    """
    stars = max(1, min(5, int(rating or 5)))
    p, q = _bucket_labels(has_price, price, popularity)
    mixed = f"rating = {stars} AND {PRICES[p]} AND {POPULARITY[q]}"
    place = (category or "Grocery & Gourmet Food").replace("'", "''")
    texts = {"price": PRICES[p], "popularity": POPULARITY[q], "mixed": mixed, "mixed_category": f"main_category = '{place}' AND {mixed}"}
    if mode not in texts:
        raise PredicateError(f"no such mode: {mode}")
    return texts[mode], f"c4_mixed_5_{p}_{q}" if mode == "mixed" and stars == 5 else "sql:" + texts[mode]


def bucket_columns(rating: Column, has_price: Column, price: Column, popularity: Column) -> dict[str, Column]:
    """The buckets of :func:`derived_predicate` as columns: stars, price_label, popularity_label."""
    cost, count = F.coalesce(price, F.lit(0.0)), F.coalesce(popularity, F.lit(0)).cast("bigint")
    priced = F.coalesce(has_price, F.lit(False))
    return {
        "stars": F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(rating, F.lit(5.0)).cast("int"))),
        "price_label": F.when(~priced, "p_missing").when(cost <= 10, "p_le10").when(cost <= 20, "p_10_20").when(cost <= 50, "p_20_50").otherwise("p_gt50"),
        "popularity_label": F.when(count >= 1000, "pop_high").when(count >= 100, "pop_mid").otherwise("pop_low"),
    }


def label_range_filter(workload: str, labels: list[int], low: int, high: int, *, label_column: str = "labels", range_column: str = "width") -> tuple[object, str]:
    """(tree, name) of a labelled search: by any of the labels, by a half-open range, or by either ('hybrid')."""
    by_label = ArrayTest(label_column, "&&", tuple(labels))
    by_range = And((Compare(range_column, ">=", low), Compare(range_column, "<", high)))
    trees = {"label": by_label, "range": by_range, "hybrid": Or((by_label, by_range))}
    if workload not in trees:
        raise PredicateError(f"no such workload: {workload}")
    parts = {"label": f"label_{'_'.join(map(str, labels))}", "range": f"range_{low}_{high}"}
    return trees[workload], parts.get(workload) or f"{parts['label']}_or_{parts['range']}"


def leaf_profile(df: DataFrame, tree: object) -> DataFrame:
    """(leaf, true_rows, false_rows, null_rows) of every leaf of a predicate, in one pass."""
    leaves: list[object] = []

    def walk(t: object) -> None:
        if isinstance(t, (And, Or)):
            for p in t.parts:
                walk(p)
        elif isinstance(t, Not):
            walk(t.part)
        elif t not in leaves:
            leaves.append(t)

    walk(tree)
    aggs = [a for i, x in enumerate(leaves) for c in [x.to_column()] for a in (F.count_if(c).alias(f"t{i}"), F.count_if(~c).alias(f"f{i}"), F.count_if(c.isNull()).alias(f"n{i}"))]
    rows = F.array(*(F.struct(F.lit(sql_of(x)).alias("leaf"), F.col(f"t{i}").alias("true_rows"), F.col(f"f{i}").alias("false_rows"), F.col(f"n{i}").alias("null_rows")) for i, x in enumerate(leaves)))
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def selectivities(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(filter_name, rows, total) of all predicates in one pass."""
    counts = df.agg(F.count("*").alias("__total"), *(F.count_if(c).alias(k) for k, c in predicates.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("filter_name"), F.col(k).alias("rows")) for k in predicates))
    return counts.select(F.explode(pairs).alias("x"), F.col("__total").alias("total")).select("x.*", "total")
