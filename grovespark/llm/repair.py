"""Repair of conversations whose turns are damaged: the cheapest edits that make roles alternate.

The edit lattice of a conversation has a node for each number of rows consumed and each state of the role grammar
`(s?(ua)+)?`. Keeping, changing or deleting a row goes to the next row; inserting one stays. Two heaps search it, one from
the start and one from the end; when they meet, all crossings of equal cost are finished, and the least audit is taken.

Conversations of any length: rows are dealt by ranges of (conversation, turn), so that a long one spans tasks, and are cut
into blocks. A block's table has the least (cost, audit) between each two states; tables compose, as of audits of equal
cost between the same two nodes none is the beginning of another. Only the hash of the repaired text has to go through a
conversation's rows in order, which it does as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block at most.
BLOCK = 128
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: States: nothing yet, after system, after user, after assistant. The next state after a row of each role, by its initial.
STATES, ACCEPT = 4, (0, 3)
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a changed or inserted row gets in each state, and the state after it.
FILL = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
FILLED = [[s for s in range(STATES) if FILL[s][1] == t] for t in range(STATES)]
LEGAL = {"su", "ua", "au"}
#: A row's code is a letter: its role's initial (s, u, a, else x), raised by a fault.
FAULTS = {"": "suax", "blank": "0123", "duplicate": "4567", "truncated": "SUAX"}

Edge = tuple[int, str, tuple[int, int]]
Label = tuple[int, str]


def forward_edges(codes: str, node: tuple[int, int]) -> Iterator[Edge]:
    """(cost, letter, node after it) of the edits that are open at a node (rows consumed, state)."""
    i, state = node
    yield INSERT, "I", (i, FILL[state][1])
    if i == len(codes):
        return
    code = codes[i]
    yield DELETE, "D", (i + 1, state)
    if code.isdigit():
        return
    extra = TRUNCATED if code.isupper() else 0
    yield REROLE + extra, "R", (i + 1, FILL[state][1])
    if (to := AFTER[state].get(code.lower())) is not None:
        yield KEEP + extra, "K", (i + 1, to)


def backward_edges(codes: str, node: tuple[int, int]) -> Iterator[Edge]:
    """(cost, letter, node before it) of the edits that lead to a node."""
    i, state = node
    for before in FILLED[state]:
        yield INSERT, "I", (i, before)
    if i == 0:
        return
    code = codes[i - 1]
    yield DELETE, "D", (i - 1, state)
    if code.isdigit():
        return
    extra = TRUNCATED if code.isupper() else 0
    for before in FILLED[state]:
        yield REROLE + extra, "R", (i - 1, before)
    for before in range(STATES):
        if AFTER[before].get(code.lower()) == state:
            yield KEEP + extra, "K", (i - 1, before)


def cheapest(codes: str, source: int, targets: Iterable[int]) -> Label | None:
    """The least (cost, audit) from the state before the rows to one of those after them; None if there is no way.

    A heap's order is cost, then rows: edits without cost consume a row, so a node's audit is final when it leaves the heap.
    """
    n = len(codes)
    ends = [{(0, source): (0, "")}, {(n, t): (0, "") for t in targets}]
    heaps = [[(0, 0, source)], [(0, 0, t) for t in targets]]
    done: list[set[tuple[int, int]]] = [set(), set()]
    best: float = min((0 for v in ends[0] if v in ends[1]), default=float("inf"))
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        _, steps, state = heapq.heappop(heaps[side])
        node = (n - steps if side else steps, state)
        if node in done[side]:
            continue
        done[side].add(node)
        cost, audit = ends[side][node]
        for step, letter, other in (backward_edges if side else forward_edges)(codes, node):
            label = (cost + step, letter + audit if side else audit + letter)
            old = ends[side].get(other)
            if old is None or label < old:
                ends[side][other] = label
                if old is None or label[0] < old[0]:
                    heapq.heappush(heaps[side], (label[0], n - other[0] if side else other[0], other[1]))
                if other in ends[1 - side]:
                    best = min(best, label[0] + ends[1 - side][other][0])
    crossings = []
    for v in done[0]:  # at a node, and at an edit between a node that one search has finished and one that the other has met
        cost, audit = ends[0][v]
        if v in ends[1]:
            crossings.append((cost + ends[1][v][0], audit + ends[1][v][1]))
        for step, letter, w in forward_edges(codes, v):
            if w in ends[1]:
                crossings.append((cost + step + ends[1][w][0], audit + letter + ends[1][w][1]))
    return min(crossings, default=None)


Table = list[Label | None]


def table_of(codes: str) -> Table:
    """The least (cost, audit) from each state before the rows to each after them, at 4 * before + after."""
    return [cheapest(codes, p, (q,)) for p in range(STATES) for q in range(STATES)]


def joined(a: Table, b: Table) -> Table:
    """The table of two blocks in a row."""
    out: Table = []
    for p in range(STATES):
        for r in range(STATES):
            ways = [(x[0] + y[0], x[1] + y[1]) for q in range(STATES) if (x := a[STATES * p + q]) and (y := b[STATES * q + r])]
            out.append(min(ways, default=None))
    return out


def string(c: str) -> Column:
    """A column as text; null is one space."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after the damage that crc32 of `conv_id:turn` picks for each row."""
    kind = F.crc32(F.concat(string("conv_id"), F.lit(":"), string("turn")).cast("binary")) % 20
    some = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), string("role").alias("role"), string("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return some.where("kind != 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))


def digested(rows: DataFrame) -> DataFrame:
    """Adds digest, of role and text, by which rows of the same turn are ordered and equal ones told."""
    return rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


ORDER = ["conv_id", "turn", "role", "digest"]
BLOCKS = "conv_id long, part int, number long, codes string, n_turns long, first_turn long, last_turn long, costs array<long>, audits array<string>"


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, code): a letter for each row's role and first fault. No texts."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    role = F.substring("role", 1, 1)
    light = digested(rows).select(*ORDER, "copy", F.when(role.isin("s", "u", "a"), role).otherwise("x").alias("who"), blank.alias("blank"), truncated.alias("truncated"))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    fault = F.when(F.col("blank"), FAULTS["blank"]).when(again, FAULTS["duplicate"]).when(F.col("truncated"), FAULTS["truncated"]).otherwise(FAULTS[""])
    return light.select(*ORDER, F.translate("who", FAULTS[""], "1234").alias("at"), fault.alias("letters"), again.alias("again")).select(*ORDER, F.expr("substring(letters, cast(at as int), 1)").alias("code"), "again")


def blocks(codes: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row for each block of at most `size` rows of a conversation, in order of (part, number): codes, turns, and the table of edits.

    A conversation that lies within one block and one task has the way from start to end alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        out: list[tuple] = []

        def close(conv, letters, turns, alone) -> None:
            nonlocal number
            held = [t for t in turns if t is not None]
            text = "".join(letters)
            way = [cheapest(text, 0, ACCEPT)] if alone else table_of(text)
            out.append((conv, part, number, text, len(set(held)), min(held, default=None), max(held, default=None), [x[0] if x else -1 for x in way], [x[1] if x else "" for x in way]))
            number += 1

        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("codes", pa.string()), ("n_turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
        conv, letters, turns, starts = None, [], [], False  # starts: the block's first row is known to be its conversation's
        for b in batches:
            for c, turn, letter in zip(*(b[k].to_pylist() for k in ("conv_id", "turn", "code"))):
                if letters and (c != conv or len(letters) == size):
                    close(conv, letters, turns, starts and c != conv)
                    starts = c != conv
                    letters, turns = [], []
                conv = c
                letters.append(letter)
                turns.append(turn)
            if len(out) >= 4096:
                yield from pa.Table.from_pylist([dict(zip(schema.names, r)) for r in out], schema).to_batches()
                out = []
        if letters:
            close(conv, letters, turns, False)  # it may go on in the next task
        yield from pa.Table.from_pylist([dict(zip(schema.names, r)) for r in out], schema).to_batches()

    order = [F.col(c).asc_nulls_first() for c in ORDER]
    dealt = codes.repartitionByRange(*order).sortWithinPartitions(*order, "again")
    return dealt.select("conv_id", "turn", "code").mapInArrow(run, BLOCKS)


class Report:
    """The counts, cost and audit of one conversation, from its blocks in order."""

    def __init__(self):
        self.stack: list[tuple[int, Table]] = []
        self.alone: Label | None = None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = None
        self.last = ""

    def add(self, codes: str, n_turns: int, first: int | None, last: int | None, costs: list[int], audits: list[str]) -> None:
        for fault in ("blank", "duplicate", "truncated"):
            self.counts[fault] += sum(map(codes.count, FAULTS[fault]))
        roles = codes.translate(str.maketrans("".join(FAULTS.values()), "suax" * 4))
        pairs = self.last + roles
        self.counts["illegal"] += sum(pairs[i : i + 2] not in LEGAL for i in range(len(pairs) - 1))
        self.last = roles[-1]
        if first is not None:
            self.counts["turns"] += n_turns - (first == self.high)
            self.low, self.high = first if self.low is None else self.low, last
        if len(costs) == 1:
            self.alone = (costs[0], audits[0])
            return
        size, table = 1, [(c, a) if c >= 0 else None for c, a in zip(costs, audits)]
        while self.stack and self.stack[-1][0] == size:  # as a binary counter, so that audits are copied but a few times
            before, left = self.stack.pop()
            size, table = size + before, joined(left, table)
        self.stack.append((size, table))

    def row(self) -> dict:
        best = self.alone
        if best is None:
            table = self.stack.pop()[1]
            while self.stack:
                table = joined(self.stack.pop()[1], table)
            best = min(x for q in ACCEPT if (x := table[q]))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts.pop("turns")
        return {"gaps": gaps, **{k: v for k, v in self.counts.items() if k != "turns"}, "cost": best[0], "audit": best[1]}


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def reports(parts: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation, from its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
        conv, report, out = None, None, []
        for b in batches:
            for r in b.to_pylist():
                if report is None or r["conv_id"] != conv:
                    if report is not None:
                        out.append({"conv_id": conv, **report.row()})
                    conv, report = r["conv_id"], Report()
                report.add(r["codes"], r["n_turns"], r["first_turn"], r["last_turn"], r["costs"], r["audits"])
            yield from pa.Table.from_pylist(out, schema).to_batches()
            out = []
        if report is not None:
            yield from pa.Table.from_pylist([{"conv_id": conv, **report.row()}], schema).to_batches()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(run, REPORT)


class Repaired:
    """The hash of a conversation's repaired text, by its audit and its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.empty = audit, 0, 0, hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def fill(self, text: str) -> None:
        role, self.state = FILL[self.state]
        self.put(role, text)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.fill("")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.fill(text)
        elif edit == "K":
            self.state = AFTER[self.state][role[0]]
            self.put(role, text)

    def hexdigest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def hashes(ids: DataFrame, audits: DataFrame, rows: DataFrame) -> DataFrame:
    """ids with the report's columns, or zeros and an empty audit, and repaired_sha256. Each conversation's report comes before its rows, which stream past."""
    columns = [c.split()[0] for c in REPORT.split(", ")]
    empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in REPORT.split(", ")[1:]]
    text = [F.lit(None).cast("string").alias(c) for c in ("role", "digest", "text")]
    heads = ids.select("conv_id", F.lit(0).alias("kind"), *empty, F.lit(None).cast("long").alias("turn"), *text)
    ways = audits.select("conv_id", F.lit(1).alias("kind"), *columns[1:], F.lit(None).cast("long").alias("turn"), *text)
    each = digested(rows).select("conv_id", F.lit(2).alias("kind"), *empty, "turn", "role", "digest", "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "digest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in columns[1:-1]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        report, repaired, out = None, None, []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    if report is not None:
                        out.append(report | {"repaired_sha256": repaired.hexdigest()})
                    report, repaired = {"conv_id": r["conv_id"], **dict.fromkeys(columns[1:-1], 0), "audit": ""}, Repaired("")
                elif r["kind"] == 1:
                    report, repaired = {c: r[c] for c in columns}, Repaired(r["audit"])
                else:
                    repaired.take(r["role"], r["text"])
            yield from pa.Table.from_pylist(out, schema).to_batches()
            out = []
        if report is not None:
            yield from pa.Table.from_pylist([report | {"repaired_sha256": repaired.hexdigest()}], schema).to_batches()

    dealt = heads.unionByName(ways).unionByName(each).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "kind", *columns[1:], "role", "text").mapInArrow(run, f"{REPORT}, repaired_sha256 string")


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation, after damage.

    Null roles and texts are one space, which is blank and no role; in the key of the damage a null is one space too. Null
    conv_ids are one conversation; null turns come first. Rows of one turn are ordered by role, then by the MD5 of role and
    text, by which equal rows are told too. A role counts by its first character; an empty role or one that begins with
    another than s, u or a can't be kept. A conversation without rows after damage has zeros and the hash of nothing, and
    an empty table gives an empty one. Other columns are ignored.
    """
    rows = damaged(conversations)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return hashes(ids, reports(blocks(coded(rows), block)), rows)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations; nulls, blanks, ties, repeats and an empty table as in repair()."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _sql() -> str:
    """The same in SQL: the least (cost, audit) of each state, as text that sorts so, goes from row to row by recursion."""
    crc = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda _: 0::BIGINT)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
    blank, stop = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
    more = lambda s, cost, letter: f"printf('%08d', {s}[1:8]::INT + {cost}) || {s}[9:] || '{letter}'"
    edit = lambda s, cost, letter, when: f"CASE WHEN {when} THEN {more(s, f'{cost} + CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END', letter)} END"
    kept = lambda s, who: edit(s, KEEP, "K", f"fault IN (0, 3) AND who = '{who}'")
    filled = lambda s: edit(s, REROLE, "R", "fault IN (0, 3)")
    steps = [
        more("s0", DELETE, "D"),
        f"least({more('s1', DELETE, 'D')}, {kept('s0', 's')})",
        f"least({', '.join([more('s2', DELETE, 'D'), *(f(s) for s in ('s0', 's1', 's3') for f in (filled, lambda s: kept(s, 'u')))])})",
        f"least({more('s3', DELETE, 'D')}, {filled('s2')}, {kept('s2', 'a')})",
    ]
    insert = f"SELECT conv_id, i, s0, s1, s2, least(s3, {more('s2', INSERT, 'I')}) AS s3 FROM (SELECT conv_id, i, s0, s1, least(s2, {', '.join(more(s, INSERT, 'I') for s in ('s0', 's1', 's3'))}) AS s2, s3 FROM"
    start = "SELECT DISTINCT conv_id, 0 AS i, '00000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM coded"
    step = f"SELECT c.conv_id, c.i, {', '.join(f'{x} AS s{k}' for k, x in enumerate(steps))} FROM walk w JOIN coded c ON c.conv_id = w.conv_id AND c.i = w.i + 1"
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, role[1] AS who, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM damaged),
coded AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{blank}') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '{stop}') THEN 3 ELSE 0 END AS fault, lag(who) OVER (PARTITION BY conv_id ORDER BY i) || who AS pair FROM placed),
walk AS ({insert} ({start})) UNION ALL {insert} ({step}))),
ways AS (SELECT conv_id, least(s0, s3) AS way FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
letters AS (SELECT conv_id, k, way[8 + k] AS letter, length(replace(way[9 : 8 + k], 'I', '')) AS i, length(replace(way[9 : 8 + k], 'D', '')) AS place FROM ways, range(1, length(way) - 7) AS _(k)),
out AS (SELECT l.conv_id, k, place, letter, role, text, max(CASE WHEN place = 1 AND letter = 'K' AND who = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS head FROM letters l LEFT JOIN coded c ON c.conv_id = l.conv_id AND c.i = l.i AND letter <> 'I' WHERE letter <> 'D'),
repaired AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS h FROM out GROUP BY conv_id),
counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way[1:8]::BIGINT, 0) AS cost, coalesce(way[9:], '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN ways USING (conv_id) LEFT JOIN repaired USING (conv_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_conversation_repair": op13_conversation_repair}
SQL: dict[str, str] = {"op13_conversation_repair": _sql()}
