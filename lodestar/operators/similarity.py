"""Exact and near duplicates by shingles, duplicate groups, and splits that keep groups together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold, sha_hex, shingles, stable_rank, word_tokens
from ..plans.publish import spread, written
from .graph import components
from .ordering import running_total

#: Words of a shingle, least Jaccard similarity, and texts that are too short to compare.
SHINGLE, JACCARD = 5, 0.9


def _cut(texts: DataFrame, id_col: str, text_col: str, unicode: bool) -> DataFrame:
    """(id, words, joined, shingles, n) of all texts."""
    rows = spread(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    words = rows.select("id", word_tokens(fold(F.col("text"), unicode)).alias("w"))
    s = words.select("id", F.size("w").alias("words"), sha_hex(F.array_join("w", " ")).alias("joined"), shingles(F.col("w"), SHINGLE).alias("shingles"))
    return s.select("*", F.size("shingles").alias("n"))


def shingled(texts: DataFrame, id_col: str = "candidate_id", text_col: str = "text", unicode: bool = True) -> DataFrame:
    """(id, joined, shingles, n) of the texts with at least SHINGLE words; shingles are sorted."""
    return _cut(texts, id_col, text_col, unicode).where(F.col("words") >= SHINGLE).drop("words")


def exact_pairs(s: DataFrame) -> DataFrame:
    """(a, b): each text after the first of its group, with the first; a star instead of all pairs, with the same groups."""
    first = s.groupBy("joined").agg(F.min("id").alias("a"), F.count("*").alias("copies")).where("copies > 1")
    return s.join(first, "joined").where("id <> a").select("a", F.col("id").alias("b"))


#: Pairs of a common shingle for each row of the prefixes, beyond which common shingles go to the end of the order; lists that count as common; rounds of it.
PAIRS_EACH, COMMON, ROUNDS = 2, 64, 3

#: Common shingles that a round takes at most, the most common first, and bits that mark them.
MOST, BITS = 1 << 14, 1 << 18


def _kept(threshold: float) -> Column:
    """Shingles in the prefix of a set of n."""
    return (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int")


def _exploded(s: DataFrame, shingles: Column, *more: str) -> DataFrame:
    """(id, more..., s): outer, as Spark would work out the shingles of a plain explode twice, to see that there are any."""
    return s.select("id", *more, F.explode_outer(shingles).alias("s")).where("s IS NOT NULL")


#: Bits that stand for a set of keys, in words of 64 that are broadcast.
MARKS = 1 << 24


def _marked(rows: DataFrame, keys: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The rows with __marks, the bit of their key where keys (key) have one in its word. No row is moved."""
    place = F.pmod(F.xxhash64(key), F.lit(MARKS))
    marks = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS int))")).alias("__bits"))
    told = rows.withColumn("__word", F.shiftright(place, 6)).join(F.broadcast(marks), "__word", how)
    return told.withColumn("__marks", F.coalesce(F.getbit("__bits", (place % 64).cast("int")), F.lit(0)) == 1).drop("__word", "__bits")


def maybe(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among keys (key), and the few that share a bit of MARKS with one of them; what is joined later drops those. No row is moved."""
    return _marked(rows, keys, key).where("__marks").drop("__marks")


def _without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among keys (key); only those that share a bit of MARKS with one are moved."""
    told = _marked(rows, keys, key, "left")
    return told.where("NOT __marks").union(told.where("__marks").join(keys.select(key), key, "left_anti").select(told.columns)).drop("__marks")


def _order(spark: SparkSession, common: set[int]) -> tuple[DataFrame, Callable[[Column], Column]]:
    """A row (marks) for the shingles in common, and the condition that a shingle's bit is marked there."""
    words = [0] * (BITS // 64)
    for x in common:
        words[x % BITS // 64] |= 1 << x % 64
    marks = spark.createDataFrame([([w - (w >> 63 << 64) for w in words],)], "marks array<bigint>")
    marked = lambda x: F.getbit(F.get("marks", F.shiftright(F.pmod(x, F.lit(BITS)), 6).cast("int")), F.pmod(x, F.lit(64)).cast("int")) == 1
    return F.broadcast(marks), marked


def prefixes(of: Callable[[DataFrame], DataFrame], heads: DataFrame, threshold: float = JACCARD) -> tuple[DataFrame, int, int]:
    """((id, n, s), pairs, rows): of each set the first n - ceil(t n) + 1 shingles in an order that all sets share, as far as others may have them too.

    heads (id, n, head) has them in the order of the hashes; pairs is how many the lists of equal shingles make, rows how many shingles
    all prefixes have. Sets at a similarity t have one of these in common, whatever the order. That of the hashes needs no count. Only where
    lists of equal shingles would make many pairs, the common ones are marked in a bitmap of BITS bits and go to the end of the order.
    Prefixes without a marked one stay as they are then; the others are taken again from of(ids) (id, shingles, n), where the sets are. Other
    shingles that share a marked bit go to the end too, which changes no result.
    """
    common: set[int] = set()
    rows = heads.agg(F.sum(F.size("head"))).first()[0] or 0
    for turn in range(ROUNDS + 1):
        found = _exploded(heads, F.col("head"), "n")
        lists = written(found.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"))
        pairs = lists.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0
        if pairs <= PAIRS_EACH * rows or turn == ROUNDS:
            break
        new = {r["s"] for r in lists.where(F.col("c") > COMMON).orderBy(F.desc("c"), "s").limit(MOST).collect()} - common
        if not new:
            break
        common |= new
        marks, marked = _order(heads.sparkSession, common)
        told = heads.crossJoin(marks).withColumn("again", F.exists("head", marked)).drop("marks")
        again = written(told.where("again").select("id"))
        last = F.concat(F.filter("shingles", lambda x: ~marked(x)), F.filter("shingles", marked))
        taken = of(again).crossJoin(marks).select("id", "n", F.slice(last, 1, _kept(threshold)).alias("head")).join(again, "id", "left_semi")
        heads = written(told.where("NOT again").select("id", "n", "head").union(taken))
    return maybe(found, lists, "s"), pairs, rows


def _sized(threshold: float) -> Column:
    """Whether the sizes of sets a and b allow the threshold."""
    return (F.col("n_a") >= F.col("n_b") * threshold) & (F.col("n_b") >= F.col("n_a") * threshold)


def _side(x: DataFrame, name: str) -> DataFrame:
    return x.select("s", F.col("id").alias(name), F.col("n").alias(f"n_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in x.columns if c not in ("s", "id", "n")])


def _enough(met: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the rows (a, n_a, b, n_b), one for each shingle that two prefixes share, of those pairs that can reach the threshold.

    All that a pair shares up to the end of the prefix that ends first stands in both prefixes; behind it the set of that
    prefix has only the rest of its shingles.
    """
    least = F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    rest = F.greatest(*[F.ceil(F.lit(threshold) * F.col(n)) - 1 for n in ("n_a", "n_b")])
    return met.groupBy("a", "n_a", "b", "n_b").agg(F.count("*").alias("c")).where(F.col("c") + rest >= least).select("a", "b")


#: Words of 64 bits that a set's parities have at most.
WORDS = 64


def _parities() -> Column:
    """Of the set's shingles (shingles, n): whether an odd number of them falls on each of n / 2 to n bits, but at most 64 * WORDS."""
    words = f"CAST(least({WORDS}, greatest(1, pow(2, floor(log2(n / 64))))) AS int)"
    word = "aggregate(shingles, 0L, (bits, x) -> IF((shiftrightunsigned(x, 6) & (w - 1)) = k, bits ^ shiftleft(1L, CAST(x & 63 AS int)), bits))"
    return F.expr(f"transform(array({words}), w -> transform(sequence(0, w - 1), k -> {word}))[0]")


def _alike(pairs: DataFrame, of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """The pairs (a, b) that can reach the threshold by their parities, some hundredth of the sets' bytes: bits in which these differ are shingles that only one of the sets has."""
    pairs = written(pairs)
    told = written(of(_asked(pairs)).select("id", "n", _parities().alias("p")))
    side = lambda x: told.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("p").alias(f"p_{x}"))
    # of two lengths, both powers of two, the longer one is folded onto the shorter
    folded = lambda x, y: f"transform(sequence(0, size(p_{y}) - 1), k -> aggregate(filter(p_{x}, (v, i) -> (i & (size(p_{y}) - 1)) = k), 0L, (s, v) -> s ^ v))"
    bits = lambda x, y: f"aggregate(zip_with({x}, {y}, (v, u) -> bit_count(v ^ u)), 0, (s, v) -> s + v)"
    differ = F.expr(f"CASE WHEN size(p_a) = size(p_b) THEN {bits('p_a', 'p_b')} WHEN size(p_a) > size(p_b) THEN {bits(folded('a', 'b'), 'p_b')} ELSE {bits('p_a', folded('b', 'a'))} END")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= F.lit((1 - threshold) / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) + 1e-6).select("a", "b")


def _asked(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def _verified(pairs: DataFrame, of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose sets are similar enough. Only the sets of texts in pairs are moved."""
    pairs = written(pairs)
    wanted = written(of(_asked(pairs)).select("id", "shingles"))
    sets = lambda name: wanted.select(F.col("id").alias(name), F.col("shingles").alias(f"s_{name}"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.select("a", "b", (common / (F.size("s_a") + F.size("s_b") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def _heads(s: DataFrame, threshold: float, *more: Column) -> DataFrame:
    return s.select("id", "n", F.slice("shingles", 1, _kept(threshold)).alias("head"), *more)


def _told(s: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(prefixes (id, n, head) of the first text of each exact group, the pairs of the others with it)."""
    heads = written(_heads(s, threshold, F.unhex("joined").alias("joined")))
    exact = written(exact_pairs(heads))
    return _without(heads.select("id", "n", "head"), exact.select(F.col("b").alias("id")), "id"), exact


def _prefix(s: DataFrame, threshold: float) -> DataFrame:
    return _exploded(s, F.slice("shingles", 1, _kept(threshold)), "n")


def prefix_pairs(left: DataFrame, right: DataFrame, threshold: float = JACCARD, same: bool = False) -> DataFrame:
    """(a, b, jaccard) of the pairs of shingle sets (id, shingles, n) at the threshold or more; exact. same: left and right are one table, and a < b.

    Of two tables, right is the one to keep small: left's shingles are moved only where a prefix of right has them, if Spark can
    broadcast those. Only where these make many pairs, both prefixes are put in an order with the common shingles at the end.
    """
    if same:
        of = lambda ids: maybe(left, ids, "id")
        return _verified(_candidates(prefixes(of, written(_heads(left, threshold)), threshold)[0], threshold), of, threshold)
    right = written(right)
    known = written(_prefix(right, threshold))
    found = written(_prefix(left, threshold).join(written(known.select("s").distinct()), "s", "left_semi"))
    named = lambda x, side: x.withColumn("id", F.concat(F.lit(side), F.col("id").cast("string")))
    both = named(left, "a").select("id", "n", "shingles").unionByName(named(right, "b").select("id", "n", "shingles"))
    of = lambda ids: maybe(both, ids, "id")
    lists = found.groupBy("s").agg(F.count("*").alias("l")).join(known.groupBy("s").agg(F.count("*").alias("r")), "s")
    pairs, rows = lists.agg(F.sum(F.col("l") * F.col("r")), F.sum(F.col("l") + F.col("r"))).first()
    if (pairs or 0) <= PAIRS_EACH * (rows or 0):
        found, known = named(found, "a"), named(known, "b")
    else:
        ordered = prefixes(of, written(_heads(both, threshold)), threshold)[0]
        found, known = ordered.where(F.col("id").startswith("a")), ordered.where(F.col("id").startswith("b"))
    met = _side(found, "a").join(_side(known, "b"), "s").where(_sized(threshold))
    own = lambda c: F.expr(f"substring({c}, 2)").cast(dict(left.dtypes)["id"]).alias(c)
    return _verified(_enough(met, threshold), of, threshold).select(own("a"), own("b"), "jaccard")


def _candidates(found: DataFrame, threshold: float, where: Column | bool = True) -> DataFrame:
    """(a, b) of the pairs of prefixes (id, n, s) that share enough."""
    return _enough(_side(found, "a").join(_side(found, "b"), "s").where(_sized(threshold) & (F.col("a") < F.col("b")) & F.lit(where)), threshold)


def near_pairs(s: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """(a, b, jaccard) between the first texts of the exact groups; copies follow by exact_pairs.

    s is worked out again for the texts that are verified, so that no table of all shingles is kept or moved.
    """
    of = lambda ids: maybe(s, ids, "id")
    return _verified(_alike(_candidates(prefixes(of, _told(s, threshold)[0], threshold)[0], threshold), of, threshold), of, threshold)


def near_links(s: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """(a, b): verified links that connect what all of near_pairs connect, about as many as there are members."""
    return _links(lambda ids: maybe(s, ids, "id"), _told(s, threshold)[0], threshold)


def _links(of: Callable[[DataFrame], DataFrame], heads: DataFrame, threshold: float) -> DataFrame:
    """near_links of the sets with the prefixes heads (id, n, head); of(ids) works out the sets of these ids (id, shingles, n).

    Each member is compared with the least of its candidates first (where lists of equal shingles are long, with the least of
    its lists). What that links is one component, and only candidates of different components are compared with each other then.
    Sets are moved only for pairs that the parities leave.
    """
    found, pairs, rows = prefixes(of, heads, threshold)
    links, apart = None, F.col("root_a") != F.col("root_b")
    if pairs > PAIRS_EACH * rows:
        found = written(found)
        least = found.groupBy("s").agg(F.min(F.struct("id", "n")).alias("m")).select("s", F.col("m.id").alias("a"), F.col("m.n").alias("n_a"))
        stars = least.join(_side(found, "b"), "s").where(_sized(threshold) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
        links = written(_verified(_alike(stars, of, threshold), of, threshold).select("a", "b"))
        roots = written(components(found.select(F.col("id").alias("node")), links).select(F.col("node").alias("id"), "root"))
        found = written(found.join(roots, "id"))
    candidates = written(_alike(_candidates(found, threshold, True if links is None else apart), of, threshold))
    stars = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    verified = _verified(stars, of, threshold).select("a", "b")
    links = written(verified if links is None else links.union(verified))
    roots = written(components(candidates.select(F.col("a").alias("node")).union(candidates.select("b")), links))
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    across = candidates.join(root("a"), "a").join(root("b"), "b").where(apart).select("a", "b")
    return links.union(_verified(across.join(stars, ["a", "b"], "left_anti"), of, threshold).select("a", "b"))


def duplicate_edges(texts: DataFrame, id_col: str = "candidate_id", text_col: str = "text", unicode: bool = True) -> DataFrame:
    """Edges (a, b, relation) of exact_pairs and near_links. Texts are cut in shingles again only where their sets are asked for."""
    heads, exact = _told(shingled(texts, id_col, text_col, unicode), JACCARD)
    # not by shingled: Spark would count the words of all texts before it looks for the ids
    of = lambda ids: _cut(maybe(texts, ids.select(F.col("id").alias(id_col)), id_col), id_col, text_col, unicode)
    links = _links(of, heads, JACCARD)
    return exact.withColumn("relation", F.lit("exact_text")).union(links.select("a", "b", F.lit("near_duplicate")))


def shared_shingle_edges(texts: DataFrame, id_col: str = "candidate_id", text_col: str = "text", unicode: bool = True) -> DataFrame:
    """Edges between texts that share any shingle, without a threshold: a star from each shingle's first text.

    The shingles are moved once and kept nowhere: those of one hash come in the order of their ids, so the first is known without holding the others.
    """
    s = _exploded(shingled(texts, id_col, text_col, unicode), F.col("shingles"))
    first = F.min("id").over(Window.partitionBy("s").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return s.select(first.alias("a"), F.col("id").alias("b")).where("a <> b").distinct().withColumn("relation", F.lit("shared_shingle"))


def exposed(pool: DataFrame, development: DataFrame, id_col: str = "candidate_id", text_col: str = "text", unicode: bool = True, threshold: float = JACCARD) -> DataFrame:
    """Ids of the pool whose text equals, or nearly equals, a development text (id, text)."""
    p, d = shingled(pool, id_col, text_col, unicode), written(shingled(development, "id", "text", unicode).dropDuplicates(["joined"]))
    same = p.join(d.select("joined"), "joined", "left_semi").select(F.col("id").alias("candidate_id"))
    return same.union(prefix_pairs(p, d, threshold).select(F.col("a").alias("candidate_id"))).distinct()


def group_id(members: Column) -> Column:
    """The name of a group of sorted members."""
    return F.concat(F.lit("group-"), F.substring(sha_hex(F.array_join(members, "\0")), 1, 16))


def groups(pool: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate_id, group_id, group_size): connected candidates of pool (candidate_id, thread_fullname) by thread and by edges (a, b).

    A group's id is the digest of its sorted members, so the ids of one group meet in one task: some 50 bytes for each member.
    """
    threads = pool.where("thread_fullname IS NOT NULL").select(F.concat(F.lit("thread:"), "thread_fullname").alias("a"), F.col("candidate_id").alias("b"))
    ids = pool.select("candidate_id").distinct()
    inside = edges.select("a", "b").join(ids.select(F.col("candidate_id").alias("a")), "a", "left_semi").join(ids.select(F.col("candidate_id").alias("b")), "b", "left_semi")
    found = written(components(ids, threads.union(inside.select("a", "b")), "candidate_id"))
    named = found.groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("members")).select("root", group_id(F.col("members")).alias("group_id"), F.size("members").alias("group_size"))
    return found.join(named, "root").select(F.col("node").alias("candidate_id"), "group_id", "group_size")


#: Groups of which the driver may hold key and size at once.
FEW = 100_000


def _filled(sizes: DataFrame, target: int) -> DataFrame:
    """(group_id) of the groups (key, group_id, tasks) that, in the order of their keys, are taken while they fit; the first always is.

    Running totals find the first group that doesn't fit; those before it are taken, and of those behind it only the ones no
    larger than the room that is left go on. Each pass works on all groups at once; the last FEW are settled on the driver.
    """
    spark, room, first = sizes.sparkSession, target, True
    rest, taken = written(sizes.select("key", "group_id", "tasks")), sizes.select("group_id").limit(0)
    while room > 0:
        if rest.count() <= FEW:
            ids = []
            for _, group, tasks in sorted(rest.collect()):
                if room > 0 and (tasks <= room or (first and not ids)):
                    ids.append((group,))
                    room -= tasks
            return taken.unionByName(spark.createDataFrame(ids, "group_id string"))
        run = written(running_total(rest, ["key", "group_id"], F.col("tasks"), "total"))
        place = F.struct("key", "group_id")
        head = run.orderBy("key", "group_id").first()
        stop = run.where(F.col("total") > room).orderBy("key", "group_id").first()
        if first and head["tasks"] > room:
            return spark.createDataFrame([(head["group_id"],)], "group_id string")
        if stop is None:
            return taken.unionByName(run.select("group_id"))
        at = F.struct(F.lit(stop["key"]).alias("key"), F.lit(stop["group_id"]).alias("group_id"))
        taken = taken.unionByName(run.where(place < at).select("group_id"))
        room, first = room - (stop["total"] - stop["tasks"]), False
        rest = written(run.where((place > at) & (F.col("tasks") <= room)).select("key", "group_id", "tasks"))
    return taken


def group_split(pool: DataFrame, grouped: DataFrame, seed: int, test_fraction: float = 0.5, forced: DataFrame | None = None) -> DataFrame:
    """(candidate_id, group_id, split) for the tasks of pool: groups in seeded order go to test while they fit.

    Sizes count tasks. The first group is taken even if it is too large; groups of forced candidates go to dev; filling stops
    at the target, which is rounded half to even.
    """
    if not 0 < test_fraction < 1:
        raise ValueError("the test fraction must be between 0 and 1")
    sizes = pool.join(grouped, "candidate_id").groupBy("group_id").agg(F.count("*").alias("tasks"))
    if forced is not None:
        held = grouped.join(forced.select("candidate_id").distinct(), "candidate_id", "left_semi").select("group_id").distinct()
        sizes = sizes.join(held, "group_id", "left_anti")
    target = pool.agg(F.bround(F.count("*") * F.lit(test_fraction), 0).cast("bigint")).first()[0]
    test = _filled(sizes.withColumn("key", stable_rank(seed, "group", F.col("group_id"))), target).withColumn("__test", F.lit(True))
    return grouped.join(test, "group_id", "left").select("candidate_id", "group_id", F.when(F.col("__test"), "test").otherwise("dev").alias("split"))


def crossing_groups(split: DataFrame) -> DataFrame:
    """Groups in more than one split; a sound split has none."""
    return split.groupBy("group_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def grouping_audit(nodes: DataFrame, edges: DataFrame, split: DataFrame, exposures: DataFrame) -> DataFrame:
    """(root, nodes, relations, splits, exposed): components of messages by labelled edges (a, b, relation), with the splits that they touch and their exposed messages."""
    found = written(components(nodes, edges, "fullname"))
    relations = edges.join(found, F.col("a") == F.col("node")).groupBy("root").agg(F.sort_array(F.collect_set("relation")).alias("relations"))
    s = split.select(F.col("fullname").alias("node"), "split")
    told = found.join(s, "node", "left").join(exposures.select(F.col("fullname").alias("node")).distinct().withColumn("__e", F.lit(1)), "node", "left")
    totals = told.groupBy("root").agg(F.countDistinct("node").alias("nodes"), F.sort_array(F.collect_set("split")).alias("splits"), F.count("__e").alias("exposed"))
    return totals.join(relations, "root", "left").select("root", "nodes", F.coalesce("relations", F.array().cast("array<string>")).alias("relations"), "splits", "exposed")
