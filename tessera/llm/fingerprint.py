"""Document fingerprints from prefix polynomial hashes.

A text's code points become modular prefix arrays under two bases. Any span's
hash is then a difference of two entries, so two spans, of one text or of two,
are compared in constant time and their longest common extension is found by
binary search. A fingerprint holds the hash of the whole text and a one-
permutation minimum sketch of the hashes of all its windows; the likeness of
two fingerprints estimates the share of windows that two texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_or_empty

MODULUS = (1 << 31) - 1
#: The two bases; the window in code points; the sketch's places.
BASES = (911_382_323 % MODULUS, 972_663_749 % MODULUS)
WINDOW, PLACES = 24, 64


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, by doubling."""
    out = np.ones(max(1, n), np.int64)
    done, step = 1, base
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * step % MODULUS
        done, step = done + k, step * step % MODULUS
    return out


class Powers:
    """Powers and inverse powers of both bases, extended as longer texts come."""

    def __init__(self):
        self.n = 0
        self.up = self.down = ()

    def upto(self, n: int) -> Powers:
        if n > self.n:
            self.n = max(1 << 13, 2 * n)
            self.up = tuple(_powers(b, self.n) for b in BASES)
            self.down = tuple(_powers(pow(b, -1, MODULUS), self.n) for b in BASES)
        return self


_KEPT = Powers()


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` below 2**62 modulo the prime 2**31 - 1, by folding its high bits down."""
    x = (x & MODULUS) + (x >> 31)
    x = (x & MODULUS) + (x >> 31)
    return x - MODULUS * (x >= MODULUS)


class Prefix:
    """Prefix arrays of one text; ``span(i, k)`` identifies its code points i .. i+k-1."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.n = codes, len(codes)
        self.p = _KEPT.upto(self.n + 1)
        self.sums = []
        for up in self.p.up:
            s = np.zeros(self.n + 1, np.int64)
            np.cumsum(_reduced((codes + 1) * up[: self.n]), out=s[1:])
            self.sums.append(s)

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all spans of ``k`` code points, in order."""
        a, b = (_reduced(_reduced(s[k:] - s[: len(s) - k]) * down[: len(s) - k]) for s, down in zip(self.sums, self.p.down))
        return a.view(np.uint64) << np.uint64(31) | b.view(np.uint64)

    def span(self, i: int, k: int) -> int:
        a, b = (int(s[i + k] - s[i]) * int(down[i]) % MODULUS for s, down in zip(self.sums, self.p.down))
        return a << 31 | b


def common_extension(x: Prefix, i: int, y: Prefix, j: int) -> int:
    """The most code points that agree from place ``i`` of one text and ``j`` of another."""
    low, high = 0, min(x.n - i, y.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if x.span(i, mid) == y.span(j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _mixed(x: Prefix) -> np.ndarray:
    """Hashes of all windows, spread over 64 bits; a shorter text is one window."""
    if not x.n:
        return np.zeros(0, np.uint64)
    h = x.windows(min(WINDOW, x.n)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _mark(whole: int, n: int, mixed: np.ndarray) -> str:
    """16 hex digits of the whole text's hash and length, then four for each place of the sketch (zero where no window fell)."""
    places = np.zeros(PLACES, ">u2")
    if len(mixed):
        h = np.sort(mixed)
        at = h >> np.uint64(58)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        places[at[first].view(np.int64)] = np.maximum((h[first] >> np.uint64(20)) & np.uint64(0xFFFF), np.uint64(1))
    return f"{(whole * 0x9E3779B97F4A7C15 + n) & (1 << 64) - 1:016x}{places.tobytes().hex()}"


def sketch(x: Prefix, mixed: np.ndarray | None = None) -> str:
    """The fingerprint of a text."""
    return _mark(x.span(0, x.n) if x.n else 0, x.n, _mixed(x) if mixed is None else mixed)


def joined_sketch(x: Prefix, mx: np.ndarray, kept: int, y: Prefix, my: np.ndarray, m: int) -> str:
    """The fingerprint of x's first ``kept`` code points followed by y's first ``m``, from what is known of both.

    Window hashes don't depend on places, so only windows across the seam are
    new; the whole text's hash is that of the first part plus the second's
    times the base to the power ``kept``.
    """
    if min(kept, m) < WINDOW:
        return sketch(Prefix(np.concatenate((x.codes[:kept], y.codes[:m]))))
    seam = _mixed(Prefix(np.concatenate((x.codes[kept - WINDOW + 1 : kept], y.codes[: WINDOW - 1]))))
    one, two = x.span(0, kept), y.span(0, m)
    up = [int(u[kept]) for u in x.p.upto(kept + 1).up]
    whole = ((one >> 31) + (two >> 31) * up[0]) % MODULUS << 31 | ((one & MODULUS) + (two & MODULUS) * up[1]) % MODULUS
    return _mark(whole, kept + m, np.concatenate((mx[: kept - WINDOW + 1], seam, my[: m - WINDOW + 1])))


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 for equal fingerprints, else twice the shared windows by all windows of both, as the sketches tell."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[16:]), ">u2") for s in (a, b))
    either = int(((x | y) != 0).sum())
    same = int(((x == y) & (x != 0)).sum())
    return min(0.999999, 2 * same / (either + same)) if either else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by as many (or all) first ones of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_chars long"


def _along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole ranges in order; each is answered when its follower is known. A range ends with a guard row."""
    before = None
    for pdf in batches:
        out = []
        for pid, doc_id, guard, text in zip(pdf["pid"], pdf["doc_id"].astype("Int64"), pdf["guard"], pdf["text"]):
            x = Prefix(codes_of(text))
            mixed = _mixed(x)
            now = (pid, doc_id, text, x, mixed, sketch(x, mixed))
            if before is not None and before[0] == pid:
                out.append(_answer(before, now))
            before = None if guard else now
        result = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_chars"])
        result["doc_id"] = result["doc_id"].astype("Int64")
        yield result


def _answer(this: tuple, following: tuple) -> tuple:
    _, doc_id, text, x, mixed, mark = this
    half = x.n // 2
    kept, m = x.n - half, min(half, following[3].n)
    other = joined_sketch(x, mixed, kept, following[3], following[4], m)
    same = kept + min(m, common_extension(x, kept, following[3], 0))
    digest = hashlib.sha256(edited(text, following[2]).encode("utf-8", "replace")).hexdigest()
    return (doc_id, x.n, digest, mark, other, likeness(mark, other), likeness(mark, following[5]), same)


#: Bytes of text that a range has about; ranges, at most, beyond which they have more.
RANGE_BYTES, MOST_RANGES = 32 << 20, 1 << 14
NULL_ID = -(1 << 63)


def ranges_of(docs: DataFrame) -> int:
    """Ranges that suit the input: by its counted bytes of text, at least as many as tasks, no more than there are rows."""
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, min(max(least, size // RANGE_BYTES), MOST_RANGES, n))


def with_followers(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows dealt into ranges of ids, each range followed by a guard: the first row of the next range, of the first after the last.

    Rows of one id stand in the order of their texts' hashes, and an id that
    has the rows of several ranges is cut by these hashes. The driver sees the
    bounds of the ranges and the least place in each, nothing else; texts are
    shuffled once, every range to a task of its own.
    """
    place = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_or_empty()).alias("h")]
    ids = docs.select(place[0])
    ranges = ranges or ranges_of(docs)
    bounds = sorted(int(x) for x in ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)) if ranges > 1 else []
    step = 64
    coarse = F.array(*[F.lit(x) for x in bounds[step - 1 :: step]]).cast("array<bigint>")
    fine = F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>")

    def upto(closed: bool):
        """How many bounds are below the id, or up to it."""
        test = (lambda b: b <= F.col("id")) if closed else (lambda b: b < F.col("id"))
        skip = F.size(F.filter(coarse, test)) * step
        return skip + F.size(F.filter(F.slice(fine, skip + 1, step), test))

    share = (F.shiftright("h", 32) + (1 << 31)) / float(1 << 32)
    pid = F.when(F.col("high") - F.col("low") > 1, F.col("low") + 1 + F.floor(share * (F.col("high") - F.col("low")))).otherwise(F.col("high")).cast("int").alias("pid")
    dealt = lambda *cols: docs.select(*cols, *place).withColumn("low", upto(False)).withColumn("high", upto(True)).select("*", pid).drop("low", "high")
    several = len(set(bounds)) < len(bounds)
    # texts are read for this only if some id is cut by their hashes
    starts = dealt() if several else ids.withColumn("h", F.lit(0).cast("long")).withColumn("pid", upto(True).cast("int"))
    least = {r["pid"]: (r["id"], r["h"]) for r in starts.groupBy("pid").agg(F.min(F.struct("id", "h")).alias("s")).select("pid", "s.*").collect()}
    there, n = sorted(least), len(bounds) + 1
    #: By range: its least place, and the range that it guards.
    first = [F.array(*[F.lit(least[p][k] if p in least else None).cast("bigint") for p in range(n)]) for k in (0, 1)]
    guards = F.array(*[F.lit(there[there.index(p) - 1] if p in least else None).cast("int") for p in range(n)])
    rows = dealt("doc_id", text_or_empty().alias("text"))
    own = F.struct("pid", F.lit(False).alias("guard"))
    guard = F.struct(F.element_at(guards, F.col("pid") + 1).alias("pid"), F.lit(True).alias("guard"))
    opens = F.element_at(first[0], F.col("pid") + 1) == F.col("id")
    if several:
        opens = opens & (F.element_at(first[1], F.col("pid") + 1) == F.col("h"))
    rows = rows.select("doc_id", "id", "h", "text", F.explode(F.when(opens, F.array(own, guard)).otherwise(F.array(own))).alias("at"))
    rows = rows.select("doc_id", "id", "h", "text", "at.pid", "at.guard")
    return rows.repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "guard", "id", "h", "text")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likenesses.

    Null texts are empty. Documents follow one another by id, null ids first,
    equal ids by the XXH64 of their texts, then by text; the last is followed
    by the first, a lone one by itself. Extra columns are ignored, an empty
    table gives no rows.
    """
    return with_followers(docs, ranges).select("pid", "doc_id", "guard", "text").mapInPandas(_along, OUT)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents``; see ``fingerprints`` for nulls, equal ids and empty tables."""
    return fingerprints(table(spark, sf_dir, "documents"))
