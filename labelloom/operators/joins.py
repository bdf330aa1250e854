"""Joins that plain equality doesn't express: suffixes, phrases, intervals, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dotted(domain: Column) -> Column:
    """A domain with exactly one dot before it, in lower case."""
    return F.concat(F.lit("."), F.regexp_replace(F.lower(domain), r"^\.+", ""))


def suffixes(domain: Column) -> Column:
    """All dotted suffixes of a domain: a.b.c gives .a.b.c, .b.c and .c."""
    parts = F.split(F.regexp_replace(F.lower(domain), r"^\.+", ""), r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("."), F.array_join(F.slice(parts, k, n - k + 1), ".")))


def suffix_join(pages: DataFrame, host: str, rules: DataFrame, domain: str) -> DataFrame:
    """Pages with each rule whose domain is their host or a parent of it.

    Hosts are taken apart into suffixes, so the join is on equality and never compares all pairs.
    """
    return pages.withColumn("_suffix", F.explode(suffixes(F.col(host)))).join(rules.withColumn("_rule", dotted(F.col(domain))), F.col("_suffix") == F.col("_rule")).drop("_suffix", "_rule")


def ngrams(tokens: Column, longest: int) -> Column:
    """The distinct runs of 1 to `longest` tokens, blank-joined."""
    n = F.size(tokens)

    def of_length(k: int) -> Column:
        if k == 1:
            return tokens
        return F.transform(tokens, lambda t, i: F.when(i + k <= n, F.concat_ws(" ", t, *[F.get(tokens, i + j) for j in range(1, k)])))

    return F.array_distinct(F.array_compact(F.flatten(F.array(*[of_length(k) for k in range(1, longest + 1)]))))


#: Phrases up to which they are looked up within the token array, before any row is made of an n-gram.
FEW_PHRASES = 5_000


def held(tokens: Column, phrases: list[str], longest: int) -> Column:
    """The distinct phrases of at most `longest` tokens that a token array holds."""
    first = sorted({p.split(" ")[0] for p in phrases})
    n = F.size(tokens)

    def of_length(k: int) -> Column:
        some = [p for p in phrases if p.count(" ") == k - 1]
        if not some:
            return F.array().cast("array<string>")
        if k == 1:
            return F.filter(tokens, lambda t: t.isin(some))
        grams = F.transform(tokens, lambda t, i: F.when(t.isin(first) & (i + k <= n), F.concat_ws(" ", t, *[F.get(tokens, i + j) for j in range(1, k)])))
        return F.filter(grams, lambda g: g.isin(some))

    return F.array_distinct(F.flatten(F.array(*[of_length(k) for k in range(1, longest + 1)])))


def phrase_join(rows: DataFrame, tokens: str, phrases: DataFrame, phrase: str, longest: int) -> DataFrame:
    """Rows with each phrase of at most `longest` tokens that their tokens hold; a row and phrase meet once.

    Up to FEW_PHRASES phrases are sets within the expression, so that only hits become rows; more meet all
    n-grams in a join.
    """
    some = [r[0] for r in phrases.select(phrase).where(F.col(phrase).isNotNull()).distinct().limit(FEW_PHRASES + 1).collect()]
    grams = held(F.col(tokens), some, longest) if len(some) <= FEW_PHRASES else ngrams(F.col(tokens), longest)
    return rows.withColumn("_gram", F.explode(grams)).join(phrases, F.col("_gram") == F.col(phrase)).drop("_gram")


#: Edges of a graph that is gone through on the driver at most, and pairs that come out of that at most.
SMALL_GRAPH, SMALL_PAIRS = 10_000, 200_000


def _small(edges: DataFrame, parent: str, child: str) -> dict | None:
    """Each node's children, if the graph is small."""
    some = edges.select(parent, child).distinct().limit(SMALL_GRAPH + 1).collect()
    if len(some) > SMALL_GRAPH:
        return None
    below: dict = {}
    for p, c in some:
        below.setdefault(p, []).append(c)
        below.setdefault(c, [])
    return below


def _walked(below: dict) -> list[tuple] | None:
    pairs = []
    for start in below:
        seen, open_ = {start}, [start]
        while open_:
            for c in below[open_.pop()]:
                if c not in seen:
                    seen.add(c)
                    open_.append(c)
        pairs += [(start, node) for node in seen]
        if len(pairs) > SMALL_PAIRS:
            return None
    return pairs


def ranks(edges: list[tuple]) -> dict:
    """The longest path from a root to each node of a small acyclic graph."""
    below: dict = {}
    for p, c in dict.fromkeys(edges):
        below.setdefault(p, []).append(c)
        below.setdefault(c, [])
    return dict(_ranked(below))


def _ranked(below: dict) -> list[tuple]:
    above = {node: 0 for node in below}
    for children in below.values():
        for c in children:
            above[c] += 1
    rank = {node: 0 for node in below}
    ready = [node for node, n in above.items() if not n]
    for node in ready:
        for c in below[node]:
            rank[c] = max(rank[c], rank[node] + 1)
            above[c] -= 1
            if not above[c]:
                ready.append(c)
    if len(ready) < len(below):
        raise ValueError("the graph has a cycle")
    return list(rank.items())


def closure(edges: DataFrame, parent: str, child: str, max_rounds: int = 64) -> DataFrame:
    """(ancestor, node) of a directed graph, each node among its own ancestors; cycles end.

    A graph of at most SMALL_GRAPH edges, as of labels, is walked on the driver. In larger ones paths double in
    length each round: pairs found so far are joined with themselves, until no pair is new.
    """
    below = _small(edges, parent, child)
    if below is not None:
        pairs = _walked(below)
        if pairs is not None:
            return edges.sparkSession.createDataFrame(pairs, T.StructType([T.StructField("ancestor", edges.schema[parent].dataType), T.StructField("node", edges.schema[child].dataType)]))
    one = edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("node"))
    own = one.select("ancestor").union(one.select("node")).distinct()
    known = one.union(own.select("ancestor", F.col("ancestor").alias("node"))).distinct().checkpoint()
    size = known.count()
    for _ in range(max_rounds):
        further = known.alias("a").join(known.alias("b"), F.col("a.node") == F.col("b.ancestor")).select("a.ancestor", "b.node")
        known = further.distinct().checkpoint()
        grown = known.count()
        if grown == size:
            return known
        size = grown
    raise ValueError("the closure did not end")


def longest_path_rank(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(node, rank): the longest path from a root (rank 0) of an acyclic graph.

    A graph of at most SMALL_GRAPH edges is gone through on the driver. In larger ones each round lengthens all
    longest paths by an edge; after as many rounds as the graph is deep nothing changes.
    """
    below = _small(edges, parent, child)
    if below is not None:
        return edges.sparkSession.createDataFrame(_ranked(below), T.StructType([T.StructField("node", edges.schema[parent].dataType), T.StructField("rank", T.LongType())]))
    pairs = edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).distinct().checkpoint()
    nodes = pairs.select(F.col("p").alias("node")).union(pairs.select("c")).distinct()
    rank = nodes.select("node", F.lit(0).cast("long").alias("rank")).checkpoint()
    n = rank.count()
    total = 0
    for _ in range(n + 1):
        pushed = pairs.join(rank, F.col("p") == F.col("node")).groupBy("c").agg((F.max("rank") + 1).alias("r"))
        rank = rank.join(pushed, F.col("node") == F.col("c"), "left").select("node", F.coalesce("r", "rank").alias("rank")).checkpoint()
        now = rank.agg(F.sum("rank")).first()[0]
        if now == total:
            return rank
        total = now
    raise ValueError("the graph has a cycle")
