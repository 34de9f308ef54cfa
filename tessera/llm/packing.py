"""Best-fit packing of token sequences by a configuration linear program.

The length histogram (at most ``capacity`` bins, whatever the corpus size) is
the whole input of the optimiser. Its linear program -- cover every length's
count with as few capacity-bounded patterns as possible -- is solved by
multiplicative weights: each round prices lengths, a knapsack dynamic program
gives the best patterns at those prices, and covered lengths lose weight. The
fractional solution is rounded over patterns that fill their sequence, the
residual histogram goes through the program again, several times, and what
remains at last, a tenth of the tokens or less where lengths repeat often, is
placed best-fit decreasing. Pieces then find their place by rank within their
length, so the corpus itself is never collected.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import row_key, saved, table, text_or_empty, unused

CAPACITY = 1024
#: Rows of one length, about, that are ranked in one share.
SHARE = 500_000
END_ID = 2
#: Words a tokenizing worker remembers before it starts afresh.
CACHE_WORDS = 800_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


# ---------------------------------------------------------------- tokens


class Encoder:
    """Ids of a byte-level BPE vocabulary as little-endian unsigned 32-bit bytes.

    Words repeat far more than texts do. Text is cut before single spaces,
    where the vocabulary's pre-tokenizer cuts too, and each word is encoded
    once per worker. Texts in which a space stands between other white space,
    or that hold a special token, go whole to the tokenizers library.
    """

    _odd = re.compile(r"\s \s")

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(P.path(f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        outer = self

        class Words(dict):
            def __missing__(self, word):
                self[word] = ids = outer._word(word)
                return ids

        self.words = Words()

    def _word(self, word: str) -> bytes:
        """Letters alone, or with one mark after them, need no pattern: the first piece is all letters."""
        piece, body = self.fast._core_bpe.encode_single_piece, word
        if not body.isalpha():
            body = word[:-1]
            if not body.isalpha() or word[-1] not in ".,;:!?":
                return array("I", self.fast.encode_ordinary(" " + word)).tobytes()
            return array("I", piece((" " + body).encode()) + piece(word[-1].encode())).tobytes()
        return array("I", piece((" " + body).encode())).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self._odd.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        first, *rest = text.split(" ")
        return np.array(self.fast.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one if it fits, else full ones after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def _pieces(capacity: int, vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = Encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encode(text or "") + end
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut_points(len(ids) // 4, capacity))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece of at most ``capacity`` ids of every document; null text counts as empty (one end id)."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(_pieces(capacity, vocabulary), PIECES)


# ---------------------------------------------------------------- the configuration program


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: the best value of a pattern in each capacity up to ``capacity``; places may stay open."""
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        k = np.searchsorted(lengths, c, side="right")
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + values[:k]).max()) if k else best[c - 1]
    return best


def multiplicative_weights(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 8, step: float = 1.0) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional copies of patterns, ((index of length, items), ...), that about cover ``counts``.

    Weights start equal and fall by a factor exp(-step * excess) with the
    share of a length's count that is covered beyond the round's. The
    knapsack table is priced once a round; a pattern is read from it item by
    item at the weights of the moment, with no more items of a length than
    there are. A length takes as much of its pattern as it lacks for the
    round, the longest first, so that short ones are covered as fillers.
    """
    covered, found = np.zeros(len(lengths)), {}
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    size, most = lengths.tolist(), counts.tolist()
    for r in range(1, rounds + 1):
        now = lengths * np.exp(-step * (covered / counts - (r - 1) / rounds))
        best = price(now, lengths, capacity)
        for j in range(len(size) - 1, -1, -1):
            lack = most[j] * r / rounds - covered[j]
            if lack <= 0:
                continue
            items, c = {j: 1}, capacity - size[j]
            spent = [j] if most[j] == 1 else []
            while fits[c]:
                gain = best[c - lengths[: fits[c]]] + now[: fits[c]]
                gain[[k for k in spent if k < fits[c]]] = -1.0
                k = int(gain.argmax())
                if gain[k] < 0:
                    break
                items[k] = items.get(k, 0) + 1
                c -= size[k]
                if items[k] == most[k]:
                    spent.append(k)
            x = lack / items[j]
            for k, m in items.items():
                covered[k] += m * x
                now[k] = size[k] * math.exp(-step * (covered[k] / most[k] - (r - 1) / rounds))
            key = tuple(sorted(items.items()))
            found[key] = found.get(key, 0.0) + x
    return found


def rounded(found: dict[tuple[tuple[int, int], ...], float], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole copies of the patterns that fill a sequence, and the counts they leave.

    Copies are rounded so that they and their running sum, the largest first,
    never differ by one or more; copies that the counts no longer hold are
    left out.
    """
    out, left, sum_ = [], counts.copy(), 0.0
    for items, x in sorted(found.items(), key=lambda t: (-t[1], t[0])):
        wanted = math.floor(sum_ + x) - math.floor(sum_)
        sum_ += x
        j, m = (np.array(v) for v in zip(*items))
        if wanted and int(lengths[j] @ m) == capacity:
            copies = min(wanted, int((left[j] // m).min()))
            if copies:
                left[j] -= copies * m
                out.append(({int(lengths[a]): int(b) for a, b in items}, copies))
    return out, left


def programmed(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 8, passes: int = 12, rest: float = 0.1) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns that the program places, with copies, and the histogram that is left to best fit.

    What rounding leaves goes through the program again, ``passes`` times or
    until at most ``rest`` of the tokens are left. Of all passes the last is
    taken after which program and best fit need the fewest sequences together.
    """
    todo = {int(n): int(c) for n, c in histogram.items() if c > 0}
    placed: list[tuple[dict[int, int], int]] = []
    if todo.get(capacity):
        placed.append(({capacity: 1}, todo.pop(capacity)))
    tokens = sum(n * c for n, c in todo.items())
    need = lambda: sum(c for _, c in placed) + sum(c for _, c in best_fit(todo, capacity))
    fewest, taken = need(), (len(placed), todo)
    for _ in range(passes):
        if sum(n * c for n, c in todo.items()) <= rest * tokens:
            break
        lengths = np.array(sorted(todo))
        counts = np.array([todo[n] for n in lengths])
        got, left = rounded(multiplicative_weights(lengths, counts, capacity, rounds), lengths, counts, capacity)
        if not got:
            break
        placed += got
        todo = {int(n): int(c) for n, c in zip(lengths, left) if c}
        if (n := need()) <= fewest:
            fewest, taken = n, (len(placed), todo)
    return placed[: taken[0]], taken[1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern, copies) that hold exactly ``histogram``: length to count. The number of patterns is bounded by the bins, not the pieces."""
    placed, left = programmed(histogram, capacity)
    return placed + best_fit(left, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: equal sequences are made together, so the work follows the bins, not the pieces."""
    free: dict[int, dict[tuple, int]] = {}  # free places -> pattern -> copies
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            room = min((f for f, kinds in free.items() if f >= n and kinds), default=None)
            if room is None:
                k = min(capacity // n, left)
                made = left // k
                kinds = free.setdefault(capacity - k * n, {})
                kinds[((n, k),)] = kinds.get(((n, k),), 0) + made
                left -= made * k
                continue
            pattern, copies = next(iter(free[room].items()))
            k = min(room // n, left)
            used = min(copies, left // k)
            free[room][pattern] -= used
            if not free[room][pattern]:
                del free[room][pattern]
            kinds = free.setdefault(room - k * n, {})
            kinds[(*pattern, (n, k))] = kinds.get((*pattern, (n, k)), 0) + used
            left -= used * k
    return [(dict(p), c) for kinds in free.values() for p, c in kinds.items()]


# ---------------------------------------------------------------- placing the pieces


def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, items a copy, first sequence and offset of each pattern that holds it."""
    by: dict[int, list] = {}
    sequence = 0
    for pattern, copies in patterns:
        offset = 0
        for n, m in sorted(pattern.items(), reverse=True):
            rows = by.setdefault(n, [])
            first = rows[-1][0] + rows[-1][4] if rows else 0
            rows.append((first, m, sequence, offset, m * copies))
            offset += n * m
        sequence += copies
    return {n: tuple(np.array(c, np.int64) for c in zip(*[r[:4] for r in rows])) for n, rows in by.items()}


def _place(slots, rank: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = slots.value
        for pdf in batches:
            n, ranks = pdf["length"].to_numpy(), pdf[rank].to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for one in np.unique(n):
                at = np.flatnonzero(n == one)
                first, m, base, off = where[int(one)]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                within = ranks[at] - first[k]
                sequence[at] = base[k] + within // m[k]
                offset[at] = off[k] + within % m[k] * one
            yield pdf.drop(columns=rank).assign(sequence_id=sequence, offset=offset)

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to piece rows (``length`` from 1 to ``capacity``; all other columns are kept).

    Ranks within a length are counted in ``salts`` shares, by default as many
    as leave ``SHARE`` rows of the commonest length to each, so that a length
    that a third of all rows have does not meet in one task. Only the
    histogram, at most ``capacity`` rows, reaches the driver. Repeated rows
    are placed each on its own, in any order among themselves; an empty input
    gives an empty result. Columns named sequence_id or offset are replaced,
    columns of any other name may be there.
    """
    spark, parts = parts.sparkSession, parts.drop("sequence_id", "offset")
    salt, n, before, row, rank = (unused(parts, x) for x in ("salt", "n", "before", "row", "rank"))
    histogram = {r[0]: r[1] for r in parts.groupBy("length").agg(F.count("*").alias(n)).collect()}
    salts = salts or max(64, max(histogram.values(), default=0) // SHARE)
    salted = parts.withColumn(salt, F.pmod(row_key(parts), F.lit(salts)))
    counts = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    counts = counts.withColumn(before, F.sum(n).over(W.partitionBy("length").orderBy(salt).rowsBetween(W.unboundedPreceding, -1)))
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    ranked = salted.withColumn(row, F.row_number().over(W.partitionBy("length", salt).orderBy(*[c for c in parts.columns if c != "length"])))
    ranked = ranked.join(counts.select("length", salt, before), ["length", salt])
    ranked = ranked.select(*parts.columns, (F.col(row) - 1 + F.coalesce(before, F.lit(0))).alias(rank))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields]
    return ranked.mapInPandas(_place(slots, rank), ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes whole texts, cuts only documents of over ``capacity`` ids and packs all pieces.

    Null and empty texts are one piece of the end id. Pieces are written to
    the shared folder once, since the histogram and the placing both read them.
    """
    return pack(saved(pieces(docs, capacity), "pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id; rows with a null or repeated
    id are packed each on its own; very long texts are cut into whole
    sequences after a first, shorter piece; an empty table gives no rows.
    """
    return pack_documents(table(spark, sf_dir, "documents"))
