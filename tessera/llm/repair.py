"""Conversation structure repair at least cost.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``. A grammar
of four states (nothing yet, after s, after u, after a) and the edits keep,
rerole, delete and insert make repair a shortest path. Rows are dealt by a hash
into batches of whole conversations; in a batch one recursive DuckDB query
advances all conversations by a turn at once and keeps, for each state, the
least cost and of equal costs the audit that is least in ASCII order.

Conversations of more than ``SEGMENT`` rows are cut into segments first. A
segment is advanced from each of the four states, which gives a table of costs
and audits between states; the same recursion then advances over the segments.
No task holds a longer conversation's rows; its audit is one value, and its
digest, which must see the text in order, passes by row after row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, saved, small_or_joined, table

#: Rows of a segment; rows and bytes of text that one query works on, about.
SEGMENT, ROWS, BYTES = 256, 4096, 16 << 20
#: What edits cost, an undeleted truncated row besides.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The grammar: state and initial to the next state; states are 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a).
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Inserts that end a conversation in each state.
CLOSE = {0: "", 1: "II", 2: "I", 3: ""}


def moves() -> list[tuple[int, str, str, str, int, int]]:
    """(state, edit, initial of the row where it matters, letters, next state, cost): inserts, at most two, then what becomes of the row.

    Three inserts lead back to a state that fewer reach, so no cheapest repair has them.
    """
    out = []
    for src in range(4):
        at, letters, cost = src, "", 0
        for _ in range(3):
            out.append((src, "D", "", letters + "D", at, cost + DELETE))
            out += [(src, "K", x, letters + "K", to, cost) for (s, x), to in NEXT.items() if s == at]
            out += [(src, "R", "", letters + "R", to, cost + REROLE) for (s, x), to in NEXT.items() if s == at and x in "ua"]
            at = next(to for (s, x), to in NEXT.items() if s == at and x in "ua")
            letters, cost = letters + "I", cost + INSERT
    return out


# ---------------------------------------------------------------- damage


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the digest of (conversation, turn) names; null roles and texts are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), harm().alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def harm() -> Column:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20


# ---------------------------------------------------------------- the recursion

_FAULTS = """
    CREATE TEMP TABLE marked AS
    SELECT *, CASE WHEN blank THEN 'b' WHEN coalesce(again, row_number() OVER (PARTITION BY seg, role, text ORDER BY i) > 1) THEN 'd' WHEN cut THEN 't' ELSE '' END AS fault,
           lag(ini) OVER (PARTITION BY seg ORDER BY i) AS before
    FROM given
"""
#: From each segment's states over all its rows; ``steps`` are (seg, i, src, dst, cost, audit).
_ADVANCE = """
    WITH RECURSIVE walk(seg, start, state, i, best) USING KEY (seg, start, state) AS (
      SELECT seg, start, start, 0::BIGINT, {'c': 0::BIGINT, 'a': '', 'p': start::VARCHAR} FROM starts
      UNION
      SELECT w.seg, w.start, s.dst, w.i + 1, min({'c': w.best.c + s.cost, 'a': w.best.a || s.audit, 'p': w.best.p || %s})
      FROM walk w JOIN steps s ON s.seg = w.seg AND s.i = w.i + 1 AND s.src = w.state
      GROUP BY w.seg, w.start, s.dst, w.i
    )
    SELECT seg, start, state, best.c AS cost, best.a AS audit, best.p AS path FROM walk JOIN (SELECT seg, max(i) AS n FROM steps GROUP BY seg) USING (seg) WHERE i = n
"""
_STEPS = f"""
    CREATE TEMP TABLE steps AS
    SELECT seg, i, src, dst, cost + CASE WHEN edit <> 'D' AND fault = 't' THEN {TRUNCATED} ELSE 0 END AS cost, letters AS audit
    FROM marked r JOIN moves m ON m.edit = 'D' OR (r.fault NOT IN ('b', 'd') AND (m.edit = 'R' OR m.ini = r.ini))
"""
#: The lines of repaired segments: of ``chosen`` (seg, src, audit), the place of each edit tells its row and its role.
_LINES = """
    SELECT seg, p, CASE e WHEN 'K' THEN role || ':' || text WHEN 'R' THEN want || ':' || text ELSE want || ':' END AS line
    FROM (
      SELECT x.*, r.role, r.text,
             CASE WHEN (x.o + (x.src = 2)::INT - max((x.src = 0 AND x.o = 1 AND x.e = 'K' AND r.ini = 's')::INT) OVER (PARTITION BY x.seg)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS want
      FROM (
        SELECT *, sum((e <> 'I')::INT) OVER w AS i, sum((e <> 'D')::INT) OVER w AS o
        FROM (SELECT seg, src, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS e FROM chosen WHERE audit <> '')
        WINDOW w AS (PARTITION BY seg ORDER BY p)
      ) x LEFT JOIN marked r ON r.seg = x.seg AND r.i = x.i AND x.e <> 'I'
    ) WHERE e <> 'D'
"""
_CLOSE = " ".join(f"WHEN {s} THEN '{x}'" for s, x in CLOSE.items())
#: The cheapest way that ends; 0, 1, 2 and 3 are states.
_CHOOSE = f"""
    SELECT seg, 0 AS src, min({{'c': cost + {INSERT} * length(CASE state {_CLOSE} END), 'a': audit || CASE state {_CLOSE} END, 'p': path}}) AS best
    FROM walked WHERE start = 0 GROUP BY seg
"""
_COUNTS = """
    SELECT seg, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, arg_min(ini, i) AS opens, arg_max(ini, i) AS ends
    FROM marked GROUP BY seg
"""


class Bench:
    """A DuckDB session of one task, one thread and bounded memory."""

    def __init__(self):
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        self.con.execute("CREATE TABLE moves (src INT, edit VARCHAR, ini VARCHAR, letters VARCHAR, dst INT, cost BIGINT)")
        self.con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())

    def put(self, name: str, sql: str) -> None:
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS {sql}")

    def marked(self, given: pa.Table) -> None:
        """Rows with their first fault and the initial before."""
        self.con.execute("DROP TABLE IF EXISTS marked")
        self.con.register("given", given)
        self.con.execute(_FAULTS)
        self.con.unregister("given")

    def advanced(self, starts: str, path: str = "''") -> None:
        """The table ``walked`` of (seg, start, state, cost, audit, path) over the table ``steps``."""
        self.put("starts", starts)
        self.put("walked", _ADVANCE % path)

    def rows(self, sql: str) -> list[tuple]:
        return self.con.execute(sql).fetchall()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Table]]:
    """Whole segments of a partition sorted by (conv_id, part, chunk), some thousand rows at a time: their keys, and their rows numbered."""
    held: list[pa.Table] = []
    keys: list = []
    size = room = last = 0
    lasting = None

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = list(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "chunk"))))
        opens = [k for k in range(n) if key[k] != (key[k - 1] if k else lasting) or not k and lasting is None]
        seg, i = np.zeros(n, np.int32), np.arange(n)
        seg[opens] = 1
        i = i - np.maximum.accumulate(np.where(seg == 1, i, -last)) + 1
        lasting, last = key[-1], int(i[-1])
        names = [c for c in batch.schema.names if c not in ("conv_id", "part", "chunk")]
        each = batch.nbytes / n
        at = 0
        for k in [*opens, n]:
            whole = k < n and (size + k - at >= ROWS or room + each * (k - at) >= BYTES) and size + k - at > 0
            if k == n or whole:
                part, own = batch.slice(at, k - at), np.cumsum(seg[at:k], dtype=np.int32) + len(keys) - 1
                keys += [key[j] for j in range(at, k) if seg[j]]
                if k > at:
                    held.append(pa.table({c: part.column(c) for c in names} | {"seg": own, "i": i[at:k]}))
                size, room, at = size + k - at, room + each * (k - at), k
            if whole:
                yield keys, pa.concat_tables(held)
                held, keys, size, room = [], [], 0, 0
    if keys:
        yield keys, pa.concat_tables(held)


_COUNTED = "blank long, duplicate long, truncated long, illegal long"
_WHOLE = f"conv_id long, {_COUNTED}, cost long, audit string, repaired_sha256 string"
_PART = f"conv_id long, part int, chunk int, {_COUNTED}, opens string, ends string, ways array<struct<src int, dst int, cost long, audit string>>"


def _arrow(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], names=[c for c, _ in columns])


_LONGS = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations: counts, cost, audit and the digest of what is left."""
    bench = Bench()
    for keys, given in _segments(batches):
        bench.marked(given)
        bench.con.execute("DROP TABLE IF EXISTS steps")
        bench.con.execute(_STEPS)
        bench.advanced("SELECT DISTINCT seg, 0 AS start FROM marked")
        bench.put("best", _CHOOSE)
        bench.put("chosen", "SELECT seg, src, best.a AS audit FROM best")
        rows = bench.rows(f"""
            SELECT c.seg, c.blank, c.duplicate, c.truncated, c.illegal, b.best.c, b.best.a, sha256(coalesce(l.text, ''))
            FROM ({_COUNTS}) c JOIN best b USING (seg) LEFT JOIN (SELECT seg, string_agg(line, chr(10) ORDER BY p) AS text FROM ({_LINES}) GROUP BY seg) l USING (seg)
        """)
        yield _arrow([(keys[r[0]][0], *r[1:]) for r in rows], [("conv_id", pa.int64()), *_LONGS, ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments: counts, and the cheapest ways between any two states."""
    bench = Bench()
    way = pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for keys, given in _segments(batches):
        bench.marked(given)
        bench.con.execute("DROP TABLE IF EXISTS steps")
        bench.con.execute(_STEPS)
        bench.advanced("SELECT DISTINCT seg, start FROM marked, (VALUES (0), (1), (2), (3)) s(start)")
        ways: dict[int, list] = {}
        for seg, src, dst, cost, audit in bench.rows("SELECT seg, start, state, cost, audit FROM walked"):
            ways.setdefault(seg, []).append({"src": src, "dst": dst, "cost": cost, "audit": audit})
        rows = [(*keys[r[0]], *r[1:], ways[r[0]]) for r in bench.rows(_COUNTS)]
        yield _arrow(rows, [("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), *_LONGS, ("opens", pa.string()), ("ends", pa.string()), ("ways", way)])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long conversations, one after another: the recursion over their segments; of each segment its state before and its audit."""
    bench = Bench()
    schema = [("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("src", pa.int32()), ("audit", pa.string()), *_LONGS, ("cost", pa.int64()), ("whole", pa.string())]

    def one(rows: list[dict]) -> pa.RecordBatch:
        steps = [(0, i + 1, w["src"], w["dst"], w["cost"], w["audit"]) for i, r in enumerate(rows) for w in r["ways"]]
        names = ["seg", "i", "src", "dst", "cost", "audit"]
        bench.con.register("given", pa.table({c: [s[k] for s in steps] for k, c in enumerate(names)}))
        bench.put("steps", "SELECT * FROM given")
        bench.con.unregister("given")
        bench.advanced("SELECT 0 AS seg, 0 AS start", "s.dst::VARCHAR")
        cost, audit, path = bench.rows(f"SELECT best.c, best.a, best.p FROM ({_CHOOSE})")[0]
        counts = [sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")]
        counts[3] += sum(a["ends"] + b["opens"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out = []
        for i, r in enumerate(rows):
            src, dst = int(path[i]), int(path[i + 1])
            own = next(w["audit"] for w in r["ways"] if (w["src"], w["dst"]) == (src, dst)) + (CLOSE[dst] if i + 1 == len(rows) else "")
            out.append((r["conv_id"], r["part"], r["chunk"], src, own, *(counts if not i else [None] * 4), cost if not i else None, audit if not i else None))
        return _arrow(out, schema)

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["conv_id"] != held[0]["conv_id"]:
                yield one(held)
                held = []
            held.append(r)
    if held:
        yield one(held)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired lines of segments whose audits are known."""
    bench = Bench()
    for keys, given in _segments(batches):
        bench.marked(given)
        bench.put("chosen", "SELECT DISTINCT seg, src, audit FROM marked")
        rows = [(*keys[seg], p, line) for seg, p, line in bench.rows(_LINES)]
        yield _arrow(rows, [("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("p", pa.int64()), ("line", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order to one digest for each conversation; no more than a batch is held."""
    digest, now, some = None, None, False
    schema = [("conv_id", pa.int64()), ("repaired_sha256", pa.string())]
    for batch in batches:
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if not some or conv != now:
                if some:
                    yield _arrow([(now, digest.hexdigest())], schema)
                digest, now, some = hashlib.sha256(line.encode()), conv, True
            else:
                digest.update(b"\n" + line.encode())
    if some:
        yield _arrow([(now, digest.hexdigest())], schema)


# ---------------------------------------------------------------- the jobs

_KEY = ["conv_id", "part", "chunk"]
#: Null turns come first, as Spark sorts; of rows alike the one that is no repetition.
_ORDER = ["turn", "role", "text", "again"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range get their segment: the range and, for each conversation in it, every ``SEGMENT`` rows one."""
    from pyspark import TaskContext

    part, now, at, some = TaskContext.get().partitionId(), None, 0, False
    for batch in batches:
        conv, chunk = batch.column("conv_id").to_pylist(), np.zeros(batch.num_rows, np.int32)
        for k, c in enumerate(conv):
            if not some or c != now:
                now, at, some = c, 0, True
            chunk[k], at = at // SEGMENT, at + 1
        cols = [c for c in batch.schema.names if c != "row"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(np.full(len(conv), part, np.int32)), pa.array(chunk)], names=[*cols, "part", "chunk"])


def repair(rows: DataFrame, longest: int = SEGMENT) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation that has rows.

    ``rows``: conv_id, turn, role, text, none of the last two null. A
    conversation's rows go by turn, null turns first; of one turn, by role and
    text. A null conv_id is a conversation like others. A role whose initial
    is not s, u or a, or that is empty, fits nowhere and is reroled or deleted.
    Conversations of over ``longest`` rows are cut into segments.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ini = F.substring("role", 1, 1)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    marks = [
        F.when(ini.isin("s", "u", "a"), ini).otherwise("-").alias("ini"), (~F.col("text").rlike(WORD)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
    ]
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", *marks)
    long = base.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > longest).select(F.col("conv_id").alias("long_id"), F.lit(True).alias("is_long"))
    long = small_or_joined(long, "long")
    zero = F.lit(0).cast("int")
    if not long.limit(1).count():
        return _by_conversation(base.select("*", F.lit(None).cast("boolean").alias("again"), zero.alias("part"), zero.alias("chunk")), tasks)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = base.join(long, same, "left_anti").select("*", F.lit(None).cast("boolean").alias("again"), zero.alias("part"), zero.alias("chunk"))
    cut = saved(base.join(long, same, "left_semi").withColumn("row", F.monotonically_increasing_id()), "long-rows")
    first = cut.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn", "row")).alias("first"))
    again = cut.alias("c").join(first.alias("f"), F.expr("c.conv_id <=> f.conv_id AND c.role = f.role AND c.text = f.text")).select("c.*", (F.struct("c.turn", "c.row") != F.col("first")).alias("again"))
    order = ["conv_id", "turn", "role", "text", "row"]
    ranged = again.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    kinds = "conv_id long, turn long, role string, text string, ini string, blank boolean, cut boolean, again boolean, part int, chunk int"
    segs = saved(ranged.select("conv_id", "turn", "role", "text", "ini", "blank", "cut", "again", "row").mapInArrow(_numbered, kinds), "segments")
    dealt = lambda df: df.repartition(tasks, *_KEY).sortWithinPartitions(*_KEY, *_ORDER)
    crossed = saved(dealt(segs).drop("turn").mapInArrow(_crossed, _PART), "crossed")
    ways = crossed.repartition(tasks, "conv_id").sortWithinPartitions(*_KEY).mapInArrow(_composed, f"conv_id long, part int, chunk int, src int, audit string, {_COUNTED}, cost long, whole string")
    ways = saved(ways, "ways")
    on = F.expr(" AND ".join(f"s.{c} <=> w.{c}" for c in _KEY))
    known = segs.alias("s").join(ways.select(*_KEY, "src", "audit").alias("w"), on).select("s.*", "w.src", "w.audit")
    lines = dealt(known).drop("turn").mapInArrow(_lines, "conv_id long, part int, chunk int, p long, line string")
    hashes = lines.repartition(tasks, "conv_id").sortWithinPartitions(*_KEY, "p").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    heads = ways.where("cost is not null").drop("audit")
    whole = heads.alias("h").join(hashes.alias("d"), F.expr("h.conv_id <=> d.conv_id"), "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    whole = whole.select("h.conv_id", "blank", "duplicate", "truncated", "illegal", "cost", F.col("whole").alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
    return _by_conversation(short, tasks).unionByName(whole)


def _by_conversation(rows: DataFrame, tasks: int) -> DataFrame:
    """Conversations whose rows stand together in one batch."""
    return rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", *_ORDER).drop("turn").mapInArrow(_repaired, _WHOLE)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all ``conversations`` after damage; a row for each original conv_id, null ones too. See ``repair`` for nulls, ties and long ones."""
    rows = table(spark, sf_dir, "conversations")
    kept = F.when(harm() != 0, F.col("turn").cast("long"))
    ids = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.min(kept).alias("a"), F.max(kept).alias("b"), F.countDistinct(kept).alias("n"))
    fixed = repair(damaged(rows))
    out = ids.alias("i").join(fixed.alias("f"), F.expr("i.conv_id <=> f.conv_id"), "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "i.conv_id", F.coalesce(F.col("b") - F.col("a") + 1 - F.col("n"), F.lit(0).cast("long")).alias("gaps"), *map(number, ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


TWIN = f"""
    WITH RECURSIVE bytes AS (
      SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS c FROM range(256) r(n)
      )
    ), keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS k FROM conversations
    ), harmed AS (
      SELECT conv_id, turn, role, text, xor(list_reduce(k, lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295), 4294967295) % 20 AS harm FROM keyed, bytes
    ), damaged AS (
      SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
             CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
      FROM harmed WHERE harm <> 0
    ), laid AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
    ), marked AS (
      SELECT conv_id, i, role, text, left(role, 1) AS ini,
             CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
      FROM laid
    ), counted AS (
      SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
      FROM marked GROUP BY 1
    ), moves(src, edit, x, letters, dst, c) AS (VALUES {', '.join(map(str, moves()))}),
    walk AS (
      SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'c': 0::BIGINT, 'a': ''}} AS best FROM counted
      UNION ALL
      SELECT w.conv_id, r.i, m.dst, min({{'c': w.best.c + m.c + CASE WHEN m.edit <> 'D' AND r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END, 'a': w.best.a || m.letters}})
      FROM walk w JOIN marked r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
      JOIN moves m ON m.src = w.state AND (m.edit = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.x = r.ini)))
      GROUP BY w.conv_id, r.i, m.dst
    ), chosen AS (
      SELECT conv_id, min({{'c': best.c + {INSERT} * length(CASE state {_CLOSE} END), 'a': best.a || CASE state {_CLOSE} END}}) AS best
      FROM walk w WHERE i = (SELECT n FROM counted c WHERE c.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY 1
    ), edits AS (
      SELECT conv_id, p, e, sum((e <> 'I')::INT) OVER w AS i, sum((e <> 'D')::INT) OVER w AS o
      FROM (SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS p, unnest(string_split(best.a, '')) AS e FROM chosen WHERE best.a <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY p)
    ), wanted AS (
      SELECT e.*, r.role, r.text, (o + 1 - max((o = 1 AND e = 'K' AND ini = 's')::INT) OVER (PARTITION BY e.conv_id)) % 2 AS second
      FROM edits e LEFT JOIN marked r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i AND e.e <> 'I'
    ), lines AS (
      SELECT conv_id, p, CASE WHEN e = 'K' THEN role ELSE CASE second WHEN 0 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, '') AS line FROM wanted WHERE e <> 'D'
    ), hashed AS (
      SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS h FROM lines GROUP BY 1
    ), gaps AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps FROM laid GROUP BY 1
    )
    SELECT o.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
           coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(x.best.c, 0)::BIGINT AS cost, coalesce(x.best.a, '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN gaps g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN chosen x ON x.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
