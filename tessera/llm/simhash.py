"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are joined with themselves under a Hamming budget by walking a
binary trie of them: pairs of nodes are expanded together, bits in which the
two differ are added up, and a pair is dropped as soon as the sum exceeds the
budget. To share the walk among tasks, the trie is built under 15 orders of
its bits: of six blocks of bits two come first, for each choice of two. Four
differing bits leave two of six blocks equal, so every link has an order in
which its first two blocks agree; the walk with no budget there falls apart
into independent subtries, one per value of the two blocks.

Equal fingerprints are one leaf, and a walk drops node pairs whose leaves it
has linked already: it returns a spanning forest of each subtrie, never all
pairs of a group. Components come from alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, row_key, saved, table, text_or_empty, unused

WORDS, SEED, BUDGET = 4, 42, 4
#: Block widths, from the highest bit; they sum to 64.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Leaves of one subtrie that a task walks at once; larger ones go down one more block.
LEAVES = 20_000
#: Blocks more, at most, that a large subtrie goes down.
DEEPER = 2
_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 if there is no word."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    k = min(words, len(w))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(w) - k] + 1).tolist()]
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)).ravel(), minlength=2048)
    ones = (seen.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = np.array([fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64)
        yield pdf.drop(columns="text").assign(doc_id=pdf["doc_id"].astype("Int64"), fp=fp)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` (longs), fp (the 64 bits as a signed long). Null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long"), *keep, text_or_empty().alias("text"))
    return rows.mapInPandas(_fingerprints, "".join(f"{c} long, " for c in ("doc_id", *keep)) + "fp long")


# ---------------------------------------------------------------- the trie


def _orders(fp: str) -> list[Column]:
    """Per choice of two leading blocks: (order, bits of the blocks, how many these are, all bits in that order)."""
    low = np.cumsum(BLOCKS)
    shifts = [64 - int(x) for x in low]
    part = [f"(shiftrightunsigned({fp}, {s}) & {(1 << n) - 1}L)" for s, n in zip(shifts, BLOCKS)]
    out = []
    for t, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2)):
        order, at, terms = [a, b, *(x for x in range(len(BLOCKS)) if x not in (a, b))], 64, []
        for x in order:
            at -= BLOCKS[x]
            terms.append(f"shiftleft({part[x]}, {at})")
        n = BLOCKS[a] + BLOCKS[b]
        bits = " | ".join(terms)
        out.append(F.expr(f"named_struct('t', {t}L, 'head', shiftrightunsigned({bits}, {64 - n}), 'lead', {n}, 'bits', {bits})"))
    return out


class Forest:
    """Union-find over positions of one array."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def walk(bits: np.ndarray, group: np.ndarray, lead: np.ndarray, budget: int = BUDGET, chunk: int = 1 << 15) -> list[tuple[int, int]]:
    """Trie self-join inside each group of sorted, distinct unsigned ``bits``; ``lead``: bits that a group agrees in.

    Returns positions of links that span each component of each group. Node
    pairs are (low, high, low, high, differing bits); the deepest go first, so
    that leaves are linked before wide pairs are opened.
    """
    n = len(bits)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.r_[first[1:], n]
    forest, links = Forest(n), []
    same = np.arange(n)  # components as of the last look
    big = (last - first).max(initial=0) > 64
    stack = []
    for depth in np.unique(lead[first]):
        at = (lead[first] == depth) & (last - first > 1)
        stack.append((int(depth), np.stack([first[at], last[at], first[at], last[at], np.zeros(at.sum(), np.int64)])))
    fresh = False
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > chunk:
            stack.append((depth, pairs[:, chunk:]))
            pairs = pairs[:, :chunk]
        if big and pairs.shape[1]:
            if fresh:
                same = np.array([forest.root(x) for x in range(n)])
                fresh = False
            turn = np.r_[0, np.cumsum(same[1:] != same[:-1])]
            a, b, c, d, _ = pairs
            pairs = pairs[:, ~((turn[a] == turn[b - 1]) & (turn[c] == turn[d - 1]) & (same[a] == same[c]))]
        if not pairs.shape[1]:
            continue
        a, b, c, d, differ = pairs
        if depth == 64:
            for x, y in zip(a.tolist(), c.tolist()):
                if x != y and forest.link(x, y):
                    links.append((x, y))
                    fresh = True
            continue
        bit = np.uint64(63 - depth)
        m, k = _half(bits, group, a, b, bit), _half(bits, group, c, d, bit)
        self_pair = a == c
        cross = [np.stack([a, m, c, k, differ]), np.stack([m, b, k, d, differ]), np.stack([a, m, k, d, differ + 1]), np.stack([m, b, c, k, differ + 1])[:, ~self_pair]]
        nxt = np.concatenate(cross, axis=1)
        a, b, c, d, differ = nxt
        keep = (b > a) & (d > c) & (differ <= budget) & ~((a == c) & (b - a == 1))
        stack.append((depth + 1, nxt[:, keep]))
    return links


def _half(bits: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First position in [lo, hi) with ``bit`` set, by binary search; all above it agree there."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        one = (bits[np.minimum(mid, len(bits) - 1)] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition, sorted by group: whole groups are walked as soon as the next begins."""

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(["t", "head", "i", "j"], sort=False).ngroup().to_numpy()
        bits = pdf["bits"].to_numpy().view(np.uint64)
        order = np.lexsort((bits, group))
        group, bits, fp = group[order], bits[order], pdf["fp"].to_numpy()[order]
        links = walk(bits, group, pdf["lead"].to_numpy()[order])
        a, b = (np.array(x, np.int64) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf[["t", "head", "i", "j"]].to_numpy()
        start = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1] + 1) if (key != key[-1]).any() else 0
        if start or (rest and (rest[-1][["t", "head", "i", "j"]].to_numpy()[-1] != key[0]).any()):
            whole = pd.concat([*rest, pdf[:start]], ignore_index=True)
            rest = []
            if len(whole):
                yield done(whole)
        rest.append(pdf[start:])
    if rest:
        yield done(pd.concat(rest, ignore_index=True))


def _deeper(lead: int) -> Column:
    """The orders of a subtrie whose first ``lead`` bits agree: the bits below in five blocks, each of which comes first once.

    Four differing bits leave one of five blocks equal, so every link of the
    subtrie is in one of the groups that the blocks' values make.
    """
    low = 64 - lead
    ends = [low * k // 5 for k in range(6)]
    out = []
    for u in range(5):
        a, b = ends[u], ends[u + 1]  # bits a .. b-1 from the lowest
        mask = lambda n: (1 << n) - 1
        block = f"(shiftrightunsigned(bits, {a}) & {mask(b - a)}L)"
        above = f"shiftleft(shiftrightunsigned(bits, {b}) & {mask(low - b)}L, {a})"
        kept = f"shiftleft(shiftrightunsigned(bits, {low}), {low})"
        bits = f"({kept} | shiftleft({block}, {low - (b - a)}) | {above} | (bits & {mask(a)}L))"
        out.append(f"named_struct('t', t * 5 + {u}, 'head', shiftrightunsigned({bits}, {low - (b - a)}), 'lead', {lead + b - a}, 'bits', {bits})")
    return F.expr(f"array({', '.join(out)})")


def links(distinct: DataFrame, leaves: int = LEAVES, tasks: int | None = None) -> DataFrame:
    """(a, b): links of at most four differing bits that span every component of ``distinct`` (column fp, no repeats).

    Subtries of more than ``leaves`` leaves are counted first, by sums that
    map tasks begin, and go down one more block, five orders for each row, and
    another. What is still larger then agrees in about 36 bits; it is dealt
    out as pairs of parts.
    """
    spark = distinct.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    key, out, walked = ["t", "head", "lead"], "a long, b long", []

    def deal(rows: DataFrame) -> None:
        by = ["t", "head", "i", "j"]
        walked.append(rows.select(*by, "lead", "bits", "fp").repartition(tasks, *by).sortWithinPartitions(*by).mapInPandas(_walks, out))

    whole = [F.lit(0).alias("i"), F.lit(0).alias("j")]
    # rows become fifteen each: they are dealt to all tasks before, not to the few that a small table is read by
    keyed = distinct.select("fp").repartition(tasks).select("fp", F.inline(F.array(*_orders("fp"))))
    for level in range(DEEPER + 1):
        large = saved(keyed.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > leaves), "subtries")
        leads = sorted(r["lead"] for r in large.select("lead").distinct().collect())
        deal((keyed.join(large, key, "left_anti") if leads else keyed).select("*", *whole))
        if not leads:
            break
        rest = keyed.join(large, key)
        if level < DEEPER:
            below = F.coalesce(*[F.when(F.col("lead") == x, _deeper(x)) for x in leads])
            keyed = saved(rest.select("fp", F.inline(below)), "deeper")
        else:
            parts = F.ceil(F.col("n") / max(1, leaves // 2)).cast("int")
            rest = rest.withColumn("p", F.pmod(F.xxhash64("fp"), parts).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
            deal(rest.select(*key, "bits", "fp", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")))
    links = walked[0]
    for more in walked[1:]:
        links = links.union(more)
    return links.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) the smallest node that it reaches.

    Large and small stars in turn until nothing changes; every round is
    checkpointed and the rounds follow the logarithm of the longest chain.
    Neighbours are only ever reduced to a minimum, so a node with many links
    is summed map-side.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        edges = star.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(edges.where("u <> v").distinct())
        # a forest of stars no longer changes
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of at most four bits).

    Every row keeps its place: repeated ids stay repeated, null texts have the
    zero fingerprint, which links like any other. Extra columns are ignored;
    an empty table gives an empty result. A component of rows without ids has
    a null component_id.
    """
    known = saved(fingerprints(docs), "fingerprints")
    named = least_of_component(known.groupBy("fp").agg(F.min("doc_id").alias("least"))).select("fp", F.col("least").alias("component_id"))
    return known.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_of_component(distinct: DataFrame, shares: int = 16) -> DataFrame:
    """(fp, root, least) of rows (fp, least), one a fingerprint: root is the smallest fingerprint of its component, least becomes the component's.

    Only linked fingerprints are summed by root; the sums are dealt back in
    ``shares``, so that the largest component is many tasks' work.
    """
    distinct = saved(distinct, "distinct")
    roots = components(links(distinct))
    share = F.pmod(F.xxhash64("fp"), F.lit(shares)).cast("int")
    known = saved(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "root"), "roots")
    alone, linked = known.where("root is null").select("fp", F.col("fp").alias("root"), "least"), known.where("root is not null")
    sums = linked.groupBy("root").agg(F.min("least").alias("least")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return alone.union(linked.select("fp", "root", share.alias("share")).join(sums, ["root", "share"]).select("fp", "root", "least"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component: the one with the smallest id, a null id last; of rows that share that id, the one whose key is smallest.

    A row is found again by its id and its key; of rows alike in all columns
    one is left. Null and empty texts are one component, unless others are as
    near to the zero fingerprint. All columns are kept; an empty table stays
    empty.
    """
    key = unused(docs, "row")
    rows = docs.withColumn(key, row_key(docs))
    known = saved(fingerprints(rows.select("doc_id", F.col(key).alias("key"), "text"), ("key",)), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("least")
    ones = least_of_component(known.groupBy("fp").agg(first)).where("fp = root").select(F.col("least.doc_id").alias("_id"), F.col("least.key").alias("_one"))
    # dealt by the key alone, which serves the join and the removal of equal rows: texts are shuffled once
    same_id = F.concat_ws(":", rows["doc_id"].isNull(), ones["_id"].isNull(), F.coalesce(rows["doc_id"], F.lit(0)) - F.coalesce(ones["_id"], F.lit(0))).isin("true:true:0", "false:false:0")
    return rows.join(ones, (rows[key] == ones["_one"]) & same_id, "left_semi").dropDuplicates([key, "doc_id"]).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all ``documents``; see ``near_duplicates`` for nulls, repeated rows and empty tables."""
    return near_duplicates(table(spark, sf_dir, "documents"))
