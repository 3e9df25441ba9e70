"""Cheapest repair of conversations as a shortest path, found by auction.

A conversation's rows and the states of the wanted role pattern (s?(ua)+)? span a lattice: node (i, q) means that i rows
are done and that the roles so far end in state q. Keep, Rerole and Delete lead to row i + 1, Insert stays at row i; all
costs are integers. The auction keeps a price for every node, at most the cost of every arc plus the price where it leads,
and a path from the origin along arcs where both are equal. At the path's end, either the price can rise, and the path
contracts by one node, or the cheapest arc extends it. When the path reaches the sink, the origin's price is the least cost
and every arc of every cheapest path is tight (price = cost + price where it leads). The audit is traced along tight arcs
that lead to the sink, smallest letter first; a letter leads to one node only.

Rows are sorted over all tasks by conversation and place. A conversation that one task sees whole and that has at most
BLOCK rows is repaired there. Others are cut into blocks: a block is a matrix of least costs from state to state, matrices
are combined over the blocks behind (a scan by groups of 2**FAN_BITS), which gives the prices at the end of each block; the
traces for each entry state are combined over the blocks before, which gives each block's entry state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import map_batches
from webloom.session import written

START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, after s, after u, after a
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3  # costs; Keep is free
FINAL = (0, None, None, 0)  # where the pattern may end
BLOCK = 32  # rows solved together; a power of two
FAN_BITS = 8
REMEMBERED = 1 << 16  # solved blocks kept per task; only speed depends on it
FAR = 1 << 40  # unreachable
SPACE = r"\x20\x09-\x0D"

Arc = tuple[str, int, int]  # letter, state, cost


def _moves(code: int, state: int) -> list[Arc]:
    """Arcs of a row with `code` (3 * role class + fault) from a state, in order of their letters."""
    role, fault = divmod(code, 3)
    onward = ASSISTANT if state == USER else USER
    arcs = [("D", state, DELETE)]
    if fault < 2:
        more = TRUNCATED if fault else 0
        if (role == 0 and state == START) or (role == 1 and onward == USER) or (role == 2 and onward == ASSISTANT):
            arcs.append(("K", role + 1, more))
        arcs.append(("R", onward, REROLE + more))
    return arcs


MOVES = [[_moves(code, state) for state in range(4)] for code in range(12)]
ONWARD = [USER, USER, ASSISTANT, USER]  # the state after an inserted turn


def cheapest(code: int) -> int:
    """The least that a row costs in any state."""
    return min(cost for moves in MOVES[code] for _, _, cost in moves)


class Lattice:
    """Arcs (letter, node, cost) of every node, letters ascending; the node of row i and state q is 4 * i + q.

    `ends` has the cost from each state behind the last row to the sink, None for no arc. Turns are inserted before a row,
    and behind the last one if `last`, so a string of letters stands for one path.
    """

    def __init__(self, codes: tuple[int, ...], ends: tuple, last: bool):
        self.sink = 4 * len(codes) + 4
        self.arcs: list[list[Arc]] = []
        for row, code in enumerate(codes):
            here, below = 4 * row, 4 * row + 4
            for state, moves in enumerate(MOVES[code]):
                first, *others = ((letter, below + to, cost) for letter, to, cost in moves)
                self.arcs.append([first, ("I", here + ONWARD[state], INSERT), *others])
        for state, cost in enumerate(ends):
            inserted = [("I", 4 * len(codes) + ONWARD[state], INSERT)] if last else []
            self.arcs.append(inserted if cost is None else [("", self.sink, cost), *inserted])
        # Prices to start with: what the rows ahead cost at least, whatever the state.
        price = [min(cost for cost in ends if cost is not None)]
        for code in reversed(codes):
            price.append(price[-1] + cheapest(code))
        self.price = [p for p in reversed(price) for _ in range(4)] + [0]

    def auction(self, origin: int) -> int:
        """Raise prices until a path of tight arcs leads from the origin to the sink; the least cost.

        The sink must be reachable. Prices left by another origin go on being valid. All cycles (two inserted turns) cost
        something, so the path is simple.
        """
        arcs, price, path = self.arcs, self.price, [origin]
        while path[-1] != self.sink:
            node = path[-1]
            least, to = FAR, node  # a node without arcs leads nowhere
            for _, other, cost in arcs[node]:
                if cost + price[other] < least:
                    least, to = cost + price[other], other
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[origin]

    def traced(self, origin: int) -> tuple[str, int]:
        """The smallest string of letters among the cheapest paths from the origin, and the state where it ends."""
        price = self.price
        tight: dict[int, list[tuple[str, int]]] = {self.sink: []}
        into: dict[int, list[int]] = {}
        queue = [origin]
        while queue:
            node = queue.pop()
            if node not in tight:
                tight[node] = [(letter, to) for letter, to, cost in self.arcs[node] if price[node] == cost + price[to]]
                for _, to in tight[node]:
                    into.setdefault(to, []).append(node)
                    queue.append(to)
        good, queue = {self.sink}, [self.sink]
        while queue:
            for node in into.get(queue.pop(), ()):
                if node not in good:
                    good.add(node)
                    queue.append(node)
        letters, node = [], origin
        while True:
            letter, to = next(arc for arc in tight[node] if arc[1] in good)
            if to == self.sink:
                return "".join(letters), node % 4
            letters.append(letter)
            node = to


def solve(codes: tuple[int, ...], ends: tuple = FINAL, last: bool = True, entry: int = START) -> tuple[int, str, int]:
    """Least cost, audit and end state of a block that is entered in a state."""
    lattice = Lattice(codes, ends, last)
    cost = lattice.auction(entry)
    return (cost, *lattice.traced(entry))


def matrix(codes: tuple[int, ...], last: bool) -> list[int]:
    """Least costs from entry to end state, row by row; then adjacent roles out of order, first and last role class."""
    out = [FAR] * 16
    kept_system = any(code < 2 for code in codes)
    for end in range(4):
        lattice = Lattice(codes, tuple(0 if q == end else None for q in range(4)), last)
        for entry in range(4):
            if end in (USER, ASSISTANT) or entry == end or (end == SYSTEM and entry == START and kept_system):
                out[4 * entry + end] = lattice.auction(entry)
    return [*out, disorder(codes), codes[0] // 3, codes[-1] // 3]


def disorder(codes: tuple[int, ...]) -> int:
    """Adjacent role initials other than su, ua and au."""
    roles = [code // 3 for code in codes]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(roles, roles[1:]))


def joined(a: list[int] | None, b: list[int] | None) -> list[int] | None:
    """The matrix of two runs of blocks that follow each other; None stands for no blocks."""
    if a is None or b is None:
        return b if a is None else a
    costs = [min(FAR, *(a[4 * i + k] + b[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)]
    return [*costs, a[16] + b[16] + ((a[18], b[17]) not in ((0, 1), (1, 2), (2, 1))), a[17], b[18]]


def followed(a: list[int] | None, b: list[int] | None) -> list[int] | None:
    """End states per entry state of two runs of blocks that follow each other."""
    if a is None or b is None:
        return b if a is None else a
    return [b[state] for state in a]


def levels_of(nodes: DataFrame) -> list[Column]:
    """Numbers of the groups, level by level, until each conversation is one group; k is task * 2**32 + block there.

    Blocks of a task come first, by FAN_BITS at a time, then tasks. Empty where all conversations are one block.
    """
    block, task = F.col("k").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("k", 32)
    parts = nodes.groupBy("conv").agg(F.max(block).alias("block"), F.min(task).alias("low"), F.max(task).alias("high"))
    most = parts.agg(F.max("block"), F.max("high"), F.max(F.col("high") - F.col("low"))).first()
    if not most or not (most[0] or most[2]):
        return []
    inner = -(-most[0].bit_length() // FAN_BITS)
    outer = -(-most[1].bit_length() // FAN_BITS) if most[2] else 0
    head = F.shiftleft(task, 32)
    return [head + F.shiftright(block, FAN_BITS)] * inner + [F.shiftleft(F.shiftright(task, FAN_BITS), 32)] * outer


def scan(nodes: DataFrame, combine: Callable, backward: bool, levels: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(conv, k, before) with what `combine` makes of the nodes before (backward: behind) each node, null for none;
    and (conv, v) over all nodes. nodes has conv, k and v (longs); a group has 2**FAN_BITS nodes at most."""
    members = F.array_sort(F.collect_list(F.struct("k", "v"))).alias("members")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for some in batch.column("members").to_pylist():
                total = None
                for node in some:
                    total = combine(total, node["v"])
                out.append(total)
            yield {"conv": batch.column("conv"), "k": batch.column("parent"), "v": out}

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"conv": [], "k": [], "before": []}
            for conv, some, held in zip(*(batch.column(n).to_pylist() for n in ("conv", "members", "before"))):
                for node in reversed(some) if backward else some:
                    out["conv"].append(conv)
                    out["k"].append(node["k"])
                    out["before"].append(held)
                    held = combine(node["v"], held) if backward else combine(held, node["v"])
            yield out

    groups = []
    for parent in levels:
        groups.append(written(nodes.groupBy("conv", parent.alias("parent")).agg(members), "scan-groups"))
        nodes = map_batches(groups[-1], fold, "conv string, k long, v array<long>")
    before = nodes.select("conv", "k", F.lit(None).cast("array<long>").alias("before"))
    for some in reversed(groups):
        above = before.withColumnRenamed("k", "parent")
        down = map_batches(some.join(above, ["conv", "parent"]), hand_down, "conv string, k long, before array<long>")
        before = written(down, "scan-down")
    return before, nodes.select("conv", "v")


def changed(audit: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The repaired turns as `role:text`; the audit starts in a state."""
    for letter in audit:
        if letter == "I":
            state = ONWARD[state]
            yield "user:" if state == USER else "assistant:"
            continue
        role, text = next(rows)
        if letter == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield f"{role}:{text}"
        elif letter == "R":
            state = ONWARD[state]
            yield f"{'user' if state == USER else 'assistant'}:{text}"


def conv_key(column: Column) -> Column:
    """A conversation id as a string that is not null."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults chosen by crc32(`conv_id:turn`) % 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes its role user.
    """
    blank = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.crc32(name) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
    faulty = rows.filter("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return faulty.drop("copy")


_SOLVED = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def first_pass(rows: DataFrame) -> DataFrame:
    """Repaired conversations (pos null), and the rows of those that are long or at the edge of a task, with a place: the
    task times 2**37, and the number of the row there in its conversation.

    Rows come sorted. The first and the last conversation of a task may go on in its neighbours.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        task = TaskContext.get().partitionId() << 37
        known: dict[tuple[int, ...], tuple[int, str]] = {}
        waiting: list[tuple] = []
        conv, edge, open_rows, place = None, True, False, 0

        def finished() -> dict[str, list]:
            """The conversation in `waiting`, solved."""
            seen: set[tuple[str, str]] = set()
            counts, codes = [0, 0, 0], []
            for role, text, kind, fault in waiting:
                name = (role, hashlib.sha256(text.encode()).digest())
                what = 3 if fault == 2 else 2 if name in seen else fault
                seen.add(name)
                if what:
                    counts[(0, 2, 1, 0)[what]] += 1
                codes.append(3 * kind + min(what, 2))
            key = tuple(codes)
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = solve(key)[:2]
            cost, audit = known[key]
            turns = "\n".join(changed(audit, START, ((r, t) for r, t, _, _ in waiting)))
            return {
                "conv": [conv], "pos": [None], "role": [None], "text": [None], "kind": [None], "fault": [None],
                "blank": [counts[0]], "duplicate": [counts[1]], "truncated": [counts[2]], "illegal": [disorder(key)],
                "cost": [cost], "audit": [audit], "repaired_sha256": [hashlib.sha256(turns.encode()).hexdigest()],
            }

        def left_open() -> dict[str, list]:
            """The rows in `waiting`, with their places."""
            n = len(waiting)
            columns = {name: [row[i] for row in waiting] for i, name in enumerate(("role", "text", "kind", "fault"))}
            none = {part.split()[0]: [None] * n for part in _SOLVED.split(", ")}
            return {"conv": [conv] * n, "pos": list(range(task + place - n, task + place))} | columns | none

        for batch in batches:
            out: dict[str, list] = {}
            columns = (batch.column(n).to_pylist() for n in ("conv", "role", "text", "kind", "fault"))

            def add(found: dict[str, list], out: dict[str, list] = out) -> None:
                for name, values in found.items():
                    out.setdefault(name, []).extend(values)

            for name, *row in zip(*columns):
                if name != conv:
                    if waiting:
                        add(left_open() if edge or open_rows else finished())
                    edge, open_rows = conv is None, False
                    conv, waiting, place = name, [], 0
                elif len(waiting) == BLOCK:
                    add(left_open())
                    open_rows, waiting = True, []
                waiting.append(tuple(row))
                place += 1
            if out:
                yield out
        if waiting:
            yield left_open()

    schema = f"conv string, pos long, role string, text string, kind int, fault int, {_SOLVED}"
    return map_batches(rows, work, schema)


def long_ones(rows: DataFrame) -> DataFrame:
    """conv and the solved columns of conversations whose rows (conv, pos, role, text, kind, fault) many tasks hold."""
    digest = F.sha2("text", 256).alias("digest")
    narrow = rows.select("conv", "pos", "role", digest, "kind", "fault")
    firsts = narrow.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"))
    repeated = (F.col("pos") > F.col("first")) & (F.col("fault") < 2)
    judged = narrow.join(firsts, ["conv", "role", "digest"]).select(
        "conv", "pos", (F.col("fault") == 2).alias("blank"), repeated.alias("duplicate"),
        ((F.col("fault") == 1) & ~repeated).alias("truncated"),
        (F.col("kind") * 3 + F.when(repeated, 2).otherwise(F.col("fault"))).alias("code"),
        F.shiftright("pos", BLOCK.bit_length() - 1).alias("k"),
    )
    judged = written(judged, "turn-faults")
    counts = judged.groupBy("conv").agg(
        *(F.sum(F.col(n).cast("long")).alias(n) for n in ("blank", "duplicate", "truncated")), F.max("k").alias("end")
    )
    in_order = F.array_sort(F.collect_list(F.struct("pos", "code")))  # BLOCK rows at most
    blocks = judged.groupBy("conv", "k").agg(F.min("pos").alias("pos"), in_order.alias("rows"))
    blocks = blocks.join(counts.select("conv", "end"), "conv")
    codes = F.transform("rows", lambda r: r["code"].cast("int")).alias("codes")
    blocks = written(blocks.select("conv", "k", "pos", codes, (F.col("k") == F.col("end")).alias("last")), "turn-blocks")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known: dict[tuple, list[int]] = {}
        for batch in batches:
            found = []
            for key in zip(map(tuple, batch.column("codes").to_pylist()), batch.column("last").to_pylist()):
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = matrix(*key)
                found.append(known[key])
            yield {"conv": batch.column("conv"), "k": batch.column("k"), "v": found}

    def ends_of(behind: list[int] | None) -> tuple:
        if behind is None:
            return FINAL
        return tuple(min(behind[4 * q + START], behind[4 * q + ASSISTANT]) for q in range(4))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("codes", "last", "before"))
            ends = [(tuple(c), ends_of(b), last) for c, last, b in zip(*columns)]
            found = [[solve(c, e, last, entry)[2] for entry in range(4)] for c, e, last in ends]
            yield {"conv": batch.column("conv"), "k": batch.column("k"), "v": found}

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("conv", "pos", "codes", "last", "before", "entry")
        for batch in batches:
            out: dict[str, list] = {"conv": [], "pos": [], "edits": [], "state": []}
            for conv, pos, codes, last, before, entry in zip(*(batch.column(n).to_pylist() for n in names)):
                state = entry[START] if entry else START
                _, audit, _ = solve(tuple(codes), ends_of(before), last, state)
                rows = [""]
                for letter in audit:  # inserted turns stand before the row they precede, or with the last row
                    if rows[-1] and rows[-1][-1] != "I" and len(rows) < len(codes):
                        rows.append("")
                    rows[-1] += letter
                for i, part in enumerate(rows):
                    out["conv"].append(conv)
                    out["pos"].append(pos + i)
                    out["edits"].append(part)
                    out["state"].append(state)
                    for letter in part:
                        if letter == "K":
                            state = codes[i] // 3 + 1
                        elif letter in "IR":
                            state = ONWARD[state]
            yield out

    leaves = written(map_batches(blocks, costs, "conv string, k long, v array<long>"), "turn-costs")
    levels = levels_of(leaves)
    behind, whole = scan(leaves, joined, True, levels)
    priced = written(blocks.join(behind, ["conv", "k"]), "turn-prices")
    ways = written(map_batches(priced, states, "conv string, k long, v array<long>"), "turn-states")
    earlier, _ = scan(ways, followed, False, levels)
    entered = priced.join(earlier.withColumnRenamed("before", "entry"), ["conv", "k"])
    found = map_batches(entered, edits, "conv string, pos long, edits string, state int")
    turns = rows.select("conv", "pos", "role", "text").join(found, ["conv", "pos"])
    # A digest over all turns of a conversation is sequential: they pass through one task, streamed, none is held.
    turns = turns.repartition("conv").sortWithinPartitions("conv", "pos")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, audit, begun, total = None, [], False, hashlib.sha256()
        for batch in batches:
            for conv, role, text, some, state in zip(
                *(batch.column(n).to_pylist() for n in ("conv", "role", "text", "edits", "state"))
            ):
                if conv != current:
                    if current is not None:
                        yield {"conv": [current], "audit": ["".join(audit)], "repaired_sha256": [total.hexdigest()]}
                    current, audit, begun, total = conv, [], False, hashlib.sha256()
                audit.append(some)
                for turn in changed(some, state, iter([(role, text)])):
                    total.update(f"\n{turn}".encode() if begun else turn.encode())
                    begun = True
        if current is not None:
            yield {"conv": [current], "audit": ["".join(audit)], "repaired_sha256": [total.hexdigest()]}

    closed = map_batches(turns, digests, "conv string, audit string, repaired_sha256 string")
    v = F.col("v")
    least = whole.select("conv", v[16].alias("illegal"), F.least(v[START], v[ASSISTANT]).alias("cost"))
    return counts.drop("end").join(least, "conv").join(closed, "conv").select(
        "conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Find each conversation's faults and its cheapest repair. rows: conv_id, turn, role, text.

    Returns per conversation: conv_id, gaps (turn numbers left out), blank, duplicate and truncated rows (the first fault
    of a row counts), illegal (adjacent roles out of order), cost, audit (initials of Keep, Rerole, Delete, Insert in
    order), repaired_sha256 (repaired `role:text`, newline-joined).

    Conversations are those of `rows`, and of `conversations` (column conv_id) if given; one without rows has zeros, an
    empty audit and the digest of the empty string. Turns stand by number, nulls first, rows of one turn by role, then by
    a hash of their text. Null role or text counts as one space. A null conv_id is a conversation like others. Rows with
    an empty role or one that starts with none of s, u, a cannot be kept as they are. Repeated rows are duplicates. If
    the turn numbers span more than a long, `gaps` is null. Other columns are ignored, empty tables give an empty one.
    """
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1)
    kind = kind.when(F.col("role").startswith("a"), 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), 2).when(F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), 0).otherwise(1)
    blank = F.lit(" ")
    named = rows.select(
        conv_key(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    # The number of a row parts identical rows, so that very many of them do not meet in one task.
    order = ("conv", "turn", "role", "tie", "number")
    placed = named.withColumn("tie", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    placed = placed.withColumn("kind", kind).withColumn("fault", fault)
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    passed = written(first_pass(ranged.select("conv", "role", "text", "kind", "fault")), "turns")
    columns = ["conv", *(part.split()[0] for part in _SOLVED.split(", "))]
    solved = passed.filter("pos IS NULL").select(*columns)
    solved = solved.union(long_ones(passed.filter("pos IS NOT NULL")).select(*columns))
    turns = named.groupBy("conv", "turn").agg(F.count("*").alias("n")).groupBy("conv").agg(
        F.max(F.col("turn").cast("decimal(20,0)")).alias("high"),
        F.min(F.col("turn").cast("decimal(20,0)")).alias("low"),
        F.count("turn").alias("n"),
    )
    gaps = turns.select("conv", F.expr("try_cast(high - low + 1 - n AS long)").alias("gaps"), F.col("n").alias("turns"))
    ids = rows.select("conv_id") if conversations is None else conversations.select("conv_id").union(rows.select("conv_id"))
    known = ids.distinct().withColumn("conv", conv_key(F.col("conv_id")))
    numbers = [F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in columns[1:6]]
    gaps_or_none = F.when(F.coalesce("turns", F.lit(0)) > 0, F.col("gaps")).otherwise(F.lit(0)).cast("long")
    return known.join(solved, "conv", "left").join(gaps, "conv", "left").select(
        "conv_id", gaps_or_none.alias("gaps"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
