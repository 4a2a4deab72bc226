"""Full-text search: a postings table, a small query language compiled to Columns, BM25, and per-query ranking.

Postings are built once (one pass over the texts) and can be written and read back; a query reads only the rows of its terms,
brings them together by unit and scores in one aggregation. Statistics are those of the whole postings table, all snapshots.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import tokens
from ..plans.publish import written

#: Fixed values of BM25 and of the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _by_term(words: Column) -> Column:
    """array<struct<term, positions>> of an array of tokens, in order; one pass over the sorted tokens."""
    numbered = F.sort_array(F.transform(words, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))

    def of(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i)["term"] != F.get(w, i - 1)["term"]))
        group = lambda s: lambda a, k: F.struct(F.get(w, a)["term"].alias("term"), F.transform(F.slice(w, a + 1, F.coalesce(F.get(s, k + 1), F.size(w)) - a), lambda x: x["pos"]).alias("positions"))
        return F.transform(F.array(starts), lambda s: F.transform(s, group(s)))[0]  # an array of one array: so that it is a variable

    return F.when(F.size(words) > 0, F.transform(F.array(numbered), of)[0])


def postings(units: DataFrame, id_cols: tuple[str, ...] = ("unit_id",), columns: tuple[str, ...] = ("focus_text", "context_only_text"), tokenize=tokens) -> DataFrame:
    """(id columns, column, term, positions array<int>, length): positions of each term in each text column; length counts the unit's tokens in all of them.

    A unit's tokens are brought together where it is: nothing is shuffled. Units' ids are taken to be unique.
    """
    tokenized = units.select(*id_cols, *[tokenize(F.coalesce(F.col(c), F.lit(""))).alias(f"__{k}") for k, c in enumerate(columns)])
    length = sum(F.size(f"__{k}") for k in range(len(columns)))
    sides = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{k}").alias("tokens")) for k, c in enumerate(columns)])
    rows = tokenized.select(*id_cols, length.alias("length"), F.explode(sides).alias("side"))
    found = rows.select(*id_cols, "side.column", "length", F.explode_outer(_by_term(F.col("side.tokens"))).alias("found")).where("found IS NOT NULL")
    return found.select(*id_cols, "column", "found.term", "found.positions", "length")


def statistics(units: DataFrame, columns: tuple[str, ...] = ("focus_text", "context_only_text"), tokenize=tokens) -> tuple[int, float]:
    """Number of units and their mean length in tokens."""
    length = sum(F.size(tokenize(F.coalesce(F.col(c), F.lit("")))) for c in columns)
    n, mean = units.agg(F.count("*"), F.avg(length)).first()
    return n, mean or 0.0


class QueryError(ValueError):
    """A query that the language doesn't have."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False  # the last word is only the beginning of one
    column: str | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    left: object
    right: object


def parse(query: str) -> object:
    """The tree of a query: words, "phrases", prefix*, column:term, NEAR(a b, n), NOT before AND before OR; terms side by side are joined by an AND that binds tightest."""
    pieces = re.findall(r'"(?:[^"]|"")*"|[(){}:,*+^-]|[^\s(){}:,*+^"-]+', query)
    if re.sub(r"\s", "", query) != re.sub(r"\s", "", "".join(pieces)):
        raise QueryError(f"unbalanced quotes: {query}")
    at = 0

    def peek(k: int = 0) -> str | None:
        return pieces[at + k] if at + k < len(pieces) else None

    def take(want: str | None = None) -> str:
        nonlocal at
        piece = peek()
        if piece is None or (want is not None and piece != want):
            raise QueryError(f"expected {want or 'a term'} in {query!r}")
        at += 1
        return piece

    def phrase(column: str | None) -> Phrase:
        piece = take()
        if piece in ("AND", "OR", "NOT") or not (piece[0] == '"' or re.fullmatch(r"[\w\x80-\U0010ffff]+", piece)):
            raise QueryError(f"syntax error near {piece!r}")
        words = tuple(re.findall(r"[^\W_]+", piece.lower()))
        prefix = peek() == "*"
        if prefix:
            take()
        return Phrase(words, prefix, column)

    def atom(column: str | None = None) -> object:
        if peek() == "(":
            take()
            inner = either(column)
            take(")")
            return inner
        if peek() == "NEAR" and peek(1) == "(":
            take()
            take()
            found = []
            while peek() not in (")", ",", None):
                found.append(phrase(column))
            distance = 10
            if peek() == ",":
                take()
                distance = int(take())
            take(")")
            return Near(tuple(found), distance)
        if peek(1) == ":":
            name = take()
            take(":")
            return atom(name)
        return phrase(column)

    def side_by_side(column: str | None) -> object:
        left = atom(column)
        while peek() is not None and peek() not in (")", "AND", "OR", "NOT"):
            left = Op("and", left, atom(column))
        return left

    def chain(kind: str, word: str, below):
        def run(column: str | None) -> object:
            left = below(column)
            while peek() == word:
                take()
                left = Op(kind, left, below(column))
            return left

        return run

    without = chain("not", "NOT", side_by_side)
    both = chain("and", "AND", without)
    either = chain("or", "OR", both)
    if not pieces:
        raise QueryError("an empty query")
    tree = either(None)
    if peek() is not None:
        raise QueryError(f"syntax error near {peek()!r}")
    return tree


def _phrases(tree: object) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    return [*_phrases(tree.left), *_phrases(tree.right)]


def _word(word: str, prefix: bool) -> Column:
    return F.col("term").startswith(word) if prefix else F.col("term") == word


def match(post: DataFrame, query: str, id_cols: tuple[str, ...] = ("unit_id",), columns: tuple[str, ...] = ("focus_text", "context_only_text")) -> DataFrame:
    """(id columns, length, tf_0, tf_1, ...): units that match the query, with the count of each of its phrases."""
    return _counted(post, [parse(query)], id_cols, columns).where("matches_0").drop("matches_0")


def _counted(post: DataFrame, trees: list[object], id_cols: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Units with any word of the queries: the count of each phrase (numbered through all queries), and whether the unit matches each query."""
    phrases = [p for tree in trees for p in _phrases(tree)]
    wanted = F.lit(False)
    for p in phrases:
        for k, w in enumerate(p.words):
            wanted = wanted | _word(w, p.prefix and k == len(p.words) - 1)
    aggregates = []
    for n, p in enumerate(phrases):
        for k, w in enumerate(p.words):
            for m, c in enumerate(columns):
                here = _word(w, p.prefix and k == len(p.words) - 1) & (F.col("column") == c)
                aggregates.append(F.flatten(F.collect_list(F.when(here, F.col("positions")))).alias(f"w{n}_{k}_{m}"))
    together = post.where(wanted).groupBy(*id_cols).agg(F.max("length").alias("length"), *aggregates)

    def places(n: int, m: int) -> Column:
        p = phrases[n]
        if not p.words or (p.column is not None and p.column != columns[m]):
            return F.array().cast("array<int>")
        rest = range(1, len(p.words))

        def stands(x: Column) -> Column:
            ok = F.lit(True)
            for k in rest:
                ok = ok & F.array_contains(F.col(f"w{n}_{k}_{m}"), x + k)
            return ok

        return F.filter(F.col(f"w{n}_0_{m}"), stands)

    for n in range(len(phrases)):
        together = together.withColumns({f"p{n}_{m}": places(n, m) for m in range(len(columns))})
    together = together.withColumns({f"tf_{n}": sum(F.size(f"p{n}_{m}") for m in range(len(columns))) for n in range(len(phrases))})
    number = iter(range(len(phrases)))

    def holds(tree: object) -> Column:
        if isinstance(tree, Phrase):
            return F.col(f"tf_{next(number)}") > 0
        if isinstance(tree, Near):
            mine = [next(number) for _ in tree.phrases]
            some = F.lit(False)
            for m in range(len(columns)):
                every = F.size(f"p{mine[0]}_{m}") > 0
                some = some | (every & F.exists(F.col(f"p{mine[0]}_{m}"), _near(mine, m, tree, phrases)))
            return some
        left, right = holds(tree.left), holds(tree.right)
        return left & right if tree.kind == "and" else left | right if tree.kind == "or" else left & ~right

    return together.select(*id_cols, "length", *[f"tf_{n}" for n in range(len(phrases))], *[holds(tree).alias(f"matches_{j}") for j, tree in enumerate(trees)])


def _near(numbers: list[int], m: int, tree: Near, phrases: list[Phrase]):
    """Whether all other phrases have a place near a place of the first one, as a function of that place."""

    def all_near(x: Column) -> Column:
        ok = F.lit(True)
        for n in numbers[1:]:
            ok = ok & F.exists(F.col(f"p{n}_{m}"), gap(x, len(phrases[numbers[0]].words), len(phrases[n].words)))
        return ok

    def gap(x: Column, first: int, size: int):
        return lambda y: F.when(y >= x, y - (x + first)).otherwise(x - (y + size)) <= tree.distance

    return all_near


def bm25(post: DataFrame, query: str, n_units: int, mean_length: float, weights: tuple[float, float] = (1.0, 1.0), id_cols: tuple[str, ...] = ("unit_id",), columns: tuple[str, ...] = ("focus_text", "context_only_text")) -> DataFrame:
    """(id columns, score) of the matching units; scores are negative, and less is better. A phrase counts as a term."""
    if weights != (1.0, 1.0):
        raise ValueError("only equal weights are used: the ones of the full-text table bind to its id columns")
    tree = parse(query)
    counted = written(_counted(post, [tree], id_cols, columns))  # the frequencies and the scores both read it
    numbers = range(len(_phrases(tree)))
    score = _score(numbers, _frequencies(counted, numbers), n_units, mean_length)
    return counted.where("matches_0").select(*id_cols, (-score).alias("score"))


def _frequencies(counted: DataFrame, numbers: range) -> list[int]:
    """In how many units each phrase stands, whether they match or not."""
    return list(counted.agg(*[F.count_if(F.col(f"tf_{n}") > 0) for n in numbers]).first())


def _score(numbers: range, frequencies: list[int], n_units: int, mean_length: float) -> Column:
    score = F.lit(0.0)
    for n in numbers:
        idf = max(math.log((n_units - frequencies[n] + 0.5) / (frequencies[n] + 0.5)), LEAST_IDF)
        tf = F.col(f"tf_{n}").cast("double")
        score = score + F.lit(idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / mean_length))
    return score


def search(post: DataFrame, queries: list[tuple[str, int, str]], n_units: int, mean_length: float, k: int, columns: tuple[str, ...] = ("focus_text", "context_only_text"), id_cols: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """(scenario_id, query_no, id columns, score, rank): the k best units of each stated query (scenario_id, query_no, text).

    The postings are read and grouped once for all queries; what holds any of their words is written, then counted and scored.
    """
    trees = [parse(text) for _, _, text in queries]
    counted = written(_counted(post, trees, id_cols, columns))
    sizes = [len(_phrases(tree)) for tree in trees]
    frequencies = _frequencies(counted, range(sum(sizes)))
    hits, first = [], 0
    for j, (scenario, number, _) in enumerate(queries):
        score = _score(range(first, first + sizes[j]), frequencies, n_units, mean_length)
        hits.append(F.when(F.col(f"matches_{j}"), F.struct(F.lit(scenario).alias("scenario_id"), F.lit(number).alias("query_no"), (-score).alias("score"))))
        first += sizes[j]
    found = counted.select(*id_cols, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("hit.scenario_id", "hit.query_no", *id_cols, "hit.score")
    return top_k(found, k, ("scenario_id", "query_no"), id_cols[-1])


def top_k(scored: DataFrame, k: int, partition: tuple[str, ...] = (), id_col: str = "unit_id") -> DataFrame:
    """The k best of each partition with rank 1 and up, least score first, ties by id."""
    w = Window.partitionBy(*partition).orderBy("score", id_col) if partition else Window.orderBy("score", id_col)
    rows = scored if partition else scored.orderBy("score", id_col).limit(k)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scenario_merge(hits: DataFrame, k: int) -> DataFrame:
    """Best hit of each unit over a scenario's queries, from (scenario_id, query_no, unit_id, score, rank).

    The first query wins a tie. `rank` stays the winning hit's rank within its query; `position` is the place in the merged order.
    """
    best = Window.partitionBy("scenario_id", "unit_id").orderBy("score", "query_no")
    merged = hits.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    return merged.withColumn("position", F.row_number().over(Window.partitionBy("scenario_id").orderBy("score", "unit_id"))).where(F.col("position") <= k)


def snippets(rows: DataFrame, query: str, text_col: str = "focus_text", size: int = 16) -> DataFrame:
    """rows with a column snippet: up to `size` tokens around the most of the query's words, marked, with an ellipsis where text is left out."""
    wanted = {w for p in _phrases(parse(query)) for w in p.words}

    def cut(text: str) -> str:
        found = list(re.finditer(r"[^\W_]+", text or ""))
        if not found:
            return text or ""
        hit = [m[0].lower() in wanted for m in found]
        at = max(range(max(1, len(found) - size + 1)), key=lambda k: (sum(hit[k : k + size]), -k))
        window = found[at : at + size]
        out, last = [], window[0].start()
        for m, h in zip(window, hit[at : at + size], strict=True):
            out.append(text[last : m.start()] + (f"<mark>{m[0]}</mark>" if h else m[0]))
            last = m.end()
        return ("…" if at else "") + "".join(out) + ("…" if at + size < len(found) else text[last:])

    @F.pandas_udf(StringType())
    def snippet(s: pd.Series) -> pd.Series:
        return s.map(cut)

    return rows.withColumn("snippet", snippet(F.col(text_col)))


def index_units(units: DataFrame, old: DataFrame | None, blocked: DataFrame | None = None, id_cols: tuple[str, ...] = ("snapshot_id", "unit_id")) -> DataFrame:
    """The unit table after an index run: new units replace old ones of their key; blocked units (by key) are left out and can't come back."""
    new = units.join(blocked.select(*id_cols).distinct(), list(id_cols), "left_anti") if blocked is not None else units
    if old is None:
        return new
    kept = old.join(new.select(*id_cols).distinct(), list(id_cols), "left_anti")
    return kept.unionByName(new)
