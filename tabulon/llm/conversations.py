"""Conversation structure repair (operator 12).

A conversation's turns get the cheapest edits after which its roles are nothing, or an optional system turn and then user and
assistant in turn, at least once. Edits: keep (0), give another role, user or assistant (2), delete (3), insert an empty
turn of user or assistant anywhere (2); a truncated turn that stays costs 1 more; a blank turn and one seen earlier are
deleted. Of equally cheap repairs the one whose edits' initials (D, I, K, R), in order, come first in ASCII is taken. The
initials alone tell which roles are given: a system turn is only ever kept, and users and assistants alternate.

Method: a min-plus matrix scan. Four states: nothing yet, after system, after user, after assistant. Each turn is a 4x4 matrix of the
cheapest (cost, initials) from state to state, with insertions before the turn closed in; the product of matrices adds costs
and joins initials, and takes the least. Two ways of equal cost over the same turns are never one the other's beginning
(what is longer has more insertions and so costs more), so the order of initials survives joining and the product is
associative. Turns are range-sorted and cut into pieces of ``PIECE``; a piece gives one matrix for each conversation
in it. Conversations of several pieces are reduced by a tree, ``FAN`` matrices a node, up to one; then states go down the tree, so that
each piece learns its own edits, and turns are edited piece by piece as they stream by. So one conversation may hold any share
of all turns. Only its edits' initials, a letter a turn, are ever in one place, since they are a result.

Turns seen earlier are found by counts of (conversation, role, text digest), combined before they are shuffled; only digests that
occur again are joined back.

Defined results: null roles and texts are one space; a null conversation id is a conversation of its own; turns are ordered by
turn, nulls first, and ties by role, then text; of turns with equal role and text the first stays; a role that doesn't
begin with s, u or a can't be kept; an empty table gives no rows; only the four columns are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.tokens import trimmed
from tabulon.llm.util import Scratch, small_batches, table

PIECE_BITS, FAN_BITS = 11, 6
PIECE, FAN = 1 << PIECE_BITS, 1 << FAN_BITS
#: Again turns of at most so many digests are sent to all executors (some 60 bytes each).
BROADCAST_ROWS = 200_000
PART_BITS = 33  # rows of one partition that monotonically_increasing_id has room for
FULL = r"[^\x20\x09-\x0D]"
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
Way = tuple[int, str]  # cost, initials
Matrix = dict[tuple[int, int], Way]

#: Insertions: a user turn leads to USER from all states but itself, an assistant turn from USER to ASSISTANT.
CLOSURE: Matrix = {(i, i): (0, "") for i in range(4)} | {(START, USER): (2, "I"), (SYSTEM, USER): (2, "I"), (ASSISTANT, USER): (2, "I"), (USER, ASSISTANT): (2, "I"), (START, ASSISTANT): (4, "II"), (SYSTEM, ASSISTANT): (4, "II")}


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, edits) in a.items():
        for j in range(4):
            if way := b.get((k, j)):
                sum_ = (cost + way[0], edits + way[1])
                if (i, j) not in out or sum_ < out[i, j]:
                    out[i, j] = sum_
    return out


def turn_matrix(initial: str, gone: bool, truncated: bool) -> Matrix:
    """The ways over one turn, insertions before it included; gone: it has to be deleted."""
    own: Matrix = {(i, i): (3, "D") for i in range(4)}
    if not gone:
        more = int(truncated)
        to_user, to_assistant = [(i, USER) for i in (START, SYSTEM, ASSISTANT)], [(USER, ASSISTANT)]
        for step in to_user + to_assistant:
            own[step] = (2 + more, "R")
        for step in {"s": [(START, SYSTEM)], "u": to_user, "a": to_assistant}.get(initial, []):
            own[step] = (more, "K")
    return product(CLOSURE, own)


class Turns:
    """Matrices by the few kinds of turns that there are."""

    def __init__(self):
        self.known: dict[tuple, Matrix] = {}

    def __call__(self, initial: str, gone: bool, truncated: bool) -> Matrix:
        kind = (initial if initial in ("s", "u", "a") else "", gone, truncated and not gone)
        if kind not in self.known:
            self.known[kind] = turn_matrix(*kind)
        return self.known[kind]


def best_end(whole: Matrix) -> tuple[int, int, str]:
    """(state after the last turn, cost, initials of the insertions after it) of the best way from the beginning."""
    ends = [(w[0] + c[0], w[1] + c[1], i, c[1]) for (s, i), w in whole.items() if s == START for (k, to), c in CLOSURE.items() if k == i and to in (START, ASSISTANT)]
    cost, _, state, tail = min(ends)
    return state, cost, tail


def path(children: list[Matrix], start: int, end: int) -> list[tuple[int, int]]:
    """(state before, state after) of each matrix along the best way."""
    ways: dict[int, tuple[int, str, tuple]] = {start: (0, "", (start,))}
    for m in children:
        after: dict[int, tuple[int, str, tuple]] = {}
        for i, (cost, edits, states) in ways.items():
            for j in range(4):
                if way := m.get((i, j)):
                    sum_ = (cost + way[0], edits + way[1], (*states, j))
                    if j not in after or sum_ < after[j]:
                        after[j] = sum_
        ways = after
    states = ways[end][2]
    return list(zip(states[:-1], states[1:], strict=True))


# What rows of matrices look like: 16 costs (null: no such way) and 16 strings of initials.
MATRIX = "costs array<long>, edits array<string>"


def _flat(m: Matrix) -> tuple[list, list]:
    ways = [m.get((i, j)) for i in range(4) for j in range(4)]
    return [w and w[0] for w in ways], [w and w[1] for w in ways]


def _matrix(costs: list, edits: list) -> Matrix:
    return {divmod(k, 4): (c, e) for k, (c, e) in enumerate(zip(costs, edits, strict=True)) if c is not None}


KINDS = {"costs": pa.list_(pa.int64()), "edits": pa.list_(pa.string())}


def _arrow(rows: list[dict], **kinds: pa.DataType) -> pa.Table:
    return pa.table({k: pa.array([r[k] for r in rows], v) for k, v in kinds.items()})


#: The product's neutral element.
NEUTRAL: Matrix = {(i, i): (0, "") for i in range(4)}

LEAF = "conv string, piece long, n long, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long"
LEAVES = {k: pa.string() if k == "conv" else pa.int64() for k in (f.split()[0] for f in LEAF.split(", "))}
LEGAL = {"su", "ua", "au"}


def _leaves(t: pa.Table) -> pa.Table:
    """The turns of a piece, and before them a copy of the last turn of the piece before -> counts and a matrix for each conversation."""
    turns, out, last = Turns(), {}, None
    for r in t.sort_by("at").to_pylist():
        same = last is not None and last["conv"] == r["conv"]
        if not r["ghost"]:
            row = out.setdefault(r["conv"], dict.fromkeys(LEAVES, 0) | {"conv": r["conv"], "piece": r["piece"], "least": None, "most": None, "whole": NEUTRAL})
            again = r["later"] or r["copies"] and same and last["turn"] == r["turn"] and last["digest"] == r["digest"]
            fault = "blank" if r["blank"] else "duplicate" if again else "truncated" if r["truncated"] else None
            row["n"] += 1
            if fault:
                row[fault] += 1
            row["illegal"] += same and last["initial"] + r["initial"] not in LEGAL
            if r["turn"] is not None:
                row["turns"] += not same or last["turn"] != r["turn"]
                row["least"] = r["turn"] if row["least"] is None else row["least"]
                row["most"] = r["turn"]
            row["whole"] = product(row["whole"], turns(r["initial"], fault in ("blank", "duplicate"), fault == "truncated"))
        last = r
    for row in out.values():
        row["costs"], row["edits"] = _flat(row["whole"])
    return _arrow(list(out.values()), **LEAVES, **KINDS)


def _joined(t: pa.Table) -> pa.Table:
    """Neighbouring matrices of a conversation -> their product, as the matrix of their parent."""
    whole, rows = NEUTRAL, t.sort_by("piece").to_pylist()
    for r in rows:
        whole = product(whole, _matrix(r["costs"], r["edits"]))
    costs, edits = _flat(whole)
    return _arrow([{"conv": rows[0]["conv"], "piece": rows[0]["parent"], "costs": costs, "edits": edits}], conv=pa.string(), piece=pa.int64(), **KINDS)


CHOICE = "conv string, piece long, from int, to int, tail string"
CHOICES = {"conv": pa.string(), "piece": pa.int64(), "from": pa.int32(), "to": pa.int32(), "tail": pa.string()}


def _told(t: pa.Table) -> pa.Table:
    """Matrices with their parent's states -> states of each; insertions at the end are the last one's."""
    rows = t.sort_by("piece").to_pylist()
    steps = path([_matrix(r["costs"], r["edits"]) for r in rows], rows[0]["from"], rows[0]["to"])
    return _arrow([{"conv": r["conv"], "piece": r["piece"], "from": a, "to": b, "tail": r["tail"] if k == len(rows) - 1 else ""} for k, (r, (a, b)) in enumerate(zip(rows, steps, strict=True))], **CHOICES)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = CHOICES | {"cost": pa.int64(), "audit": pa.string()}
    for b in batches:
        rows = []
        for r in b.to_pylist():
            whole = _matrix(r["costs"], r["edits"])
            state, cost, tail = best_end(whole)
            rows.append({"conv": r["conv"], "piece": r["piece"], "from": START, "to": state, "tail": tail, "cost": cost, "audit": whole[START, state][1] + tail})
        yield from _arrow(rows, **kinds).to_batches()


class _Editor:
    """Applies a piece's initials to its turns."""

    def __init__(self, state: int, edits: str):
        self.state, self.edits, self.at = state, edits, 0

    def next(self) -> str:
        """The role of the next user or assistant turn."""
        self.state = ASSISTANT if self.state == USER else USER
        return ROLES[self.state]

    def inserted(self) -> list[str]:
        out = []
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            out.append(self.next())
        return out

    def turn(self, role: str) -> tuple[str, str | None]:
        """(edit, role) of the turn; no role where it is deleted."""
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            return edit, None
        if edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            return edit, role
        return edit, self.next()


EDITED = "conv string, at long, sub int, edit string, turn long, role string, text string"
EDITS = {"conv": pa.string(), "at": pa.int64(), "sub": pa.int32(), "edit": pa.string(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of pieces, a piece's edits before its turns -> repaired rows. sub tells apart the rows made at one turn:
    insertions before it, itself, insertions after it."""
    editors: dict[str, list] = {}
    piece = None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["piece"] != piece:
                piece, editors = r["piece"], {}
            conv = r["conv"]
            if r["at"] is None:  # what was told to the piece
                editors[conv] = [_Editor(r["from"], r["edits"]), r["n"], r["tail"]]
                continue
            own = editors[conv]
            e = own[0]
            made = [("I", role, "", None) for role in e.inserted()]
            edit, role = e.turn(r["role"])
            if role is not None:
                made.append((edit, role, r["text"], r["turn"]))
            own[1] -= 1
            if not own[1]:
                made += [("I", e.next(), "", None) for _ in own[2]]
            out += [{"conv": conv, "at": r["at"], "sub": k, "edit": x[0], "role": x[1], "text": x[2], "turn": x[3]} for k, x in enumerate(made)]
        yield from _arrow(out, **EDITS).to_batches()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows in order -> a digest for each conversation; a conversation of any length streams through one digest."""
    conv, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    for b in batches:
        for own, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if digest is None or own != conv:
                if digest is not None:
                    yield row()
                conv, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
    if digest is not None:
        yield row()


class Repair:
    """The repair of a table of conversations. ``report``: a row for each conversation that has turns, with gaps, counts of faults, cost
    and audit (the initials); ``turns()``: the repaired turns; ``digests()``: a sha256 of each conversation's repaired turns.
    conv is the conversation's id as text, one space for null."""

    def __init__(self, rows: DataFrame, name: str = "conversations"):
        self.spark = rows.sparkSession
        small_batches(self.spark)
        self.scratch = Scratch(self.spark, name)
        self.placed = self._place(rows)
        self.leaves = self._leaves()
        several = self.scratch.write(self.leaves.groupBy("conv").agg(F.count("*").alias("pieces")).where("pieces > 1").select("conv"), "several")
        self.levels = [self.leaves.join(several, "conv", "left_semi").select("conv", "piece", "costs", "edits")]
        whole = self.leaves.join(several, "conv", "left_anti").select("conv", "piece", "costs", "edits")
        if several.limit(1).count():
            whole = whole.unionByName(self._up())
        self.roots = self.scratch.write(whole.mapInArrow(_roots, f"{CHOICE}, cost long, audit string"), "roots")
        counts = self.leaves.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns")), F.min("least").alias("least"), F.max("most").alias("most"))
        gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
        self.report = counts.join(self.roots, "conv").select("conv", "n", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _place(self, rows: DataFrame) -> DataFrame:
        """The turns with their faults, in order: at ascends by conversation and turn; piece too, and has no more than PIECE turns."""
        space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = rows.select(space("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
        rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
        rank = F.struct(F.col("turn").isNotNull(), "turn")  # null turns first, for false is less than true
        seen = rows.groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").select("conv", "digest", "first")
        seen = self.scratch.write(seen, "seen")
        few = seen.count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(seen) if few else seen, ["conv", "digest"], "left")
        later = F.col("first").isNotNull() & ~rank.eqNullSafe(F.col("first"))
        blank, truncated = ~F.col("text").rlike(FULL), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
        rows = rows.select("conv", "turn", "role", "text", "digest", later.alias("later"), F.col("first").isNotNull().alias("copies"), blank.alias("blank"), truncated.alias("truncated"))
        order = ["conv", "turn", "role", F.left("text", F.lit(64)), "digest"]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # equal turns fall into one partition, side by side
        placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        placed = self.scratch.write(placed, "sorted")
        part, inside = F.shiftright("at", PART_BITS), F.shiftright(F.col("at").bitwiseAND(F.lit((1 << PART_BITS) - 1)), PIECE_BITS)
        # a row a partition, so as many as the shuffle has: pieces are numbered without holes, for each looks at the one before it
        each = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg((F.max(inside) + 1).alias("n")).collect())
        starts = [(p, sum(n for _, n in each[:k])) for k, (p, _) in enumerate(each)]
        self.pieces = sum(n for _, n in each)
        first = self.spark.createDataFrame(starts, "part long, first long")
        return placed.join(F.broadcast(first), part == F.col("part")).withColumn("piece", F.col("first") + inside).drop("part", "first")

    def _leaves(self) -> DataFrame:
        keys = ["conv", "piece", "at", "turn", "digest", "initial", "later", "copies", "blank", "truncated"]
        small = self.placed.withColumn("initial", F.substring("role", 1, 1)).select(*keys, F.lit(False).alias("ghost"))
        ghosts = small.groupBy("piece").agg(F.max_by(F.struct(*(k for k in keys if k != "piece")), "at").alias("last"))
        ghosts = ghosts.select((F.col("piece") + 1).alias("piece"), "last.*", F.lit(True).alias("ghost")).select(*small.columns)
        leaves = small.unionByName(ghosts).groupBy("piece").applyInArrow(_leaves, f"{LEAF}, {MATRIX}")
        return self.scratch.write(leaves, "leaves")

    def _up(self) -> DataFrame:
        reach, kinds = self.pieces, f"conv string, piece long, {MATRIX}"
        while reach > 1:
            reach = -(-reach // FAN)
            nodes = self.levels[-1].withColumn("parent", F.shiftright("piece", FAN_BITS)).groupBy("conv", "parent").applyInArrow(_joined, kinds)
            self.levels.append(self.scratch.write(nodes, f"level-{len(self.levels)}"))
        return self.levels[-1]

    def _told(self) -> DataFrame:
        """What each leaf is told: the states before and after it, and the insertions at the end where it is the last one."""
        choices = self.roots.select("conv", "piece", "from", "to", "tail")
        alone = choices
        if len(self.levels) > 1:
            alone = choices.join(self.levels[-1].select("conv"), "conv", "left_anti")
            choices = choices.join(self.levels[-1].select("conv"), "conv", "left_semi")
            for level in reversed(self.levels[:-1]):
                below = level.withColumn("parent", F.shiftright("piece", FAN_BITS)).join(choices.withColumnRenamed("piece", "parent"), ["conv", "parent"])
                choices = below.groupBy("conv", "parent").applyInArrow(_told, CHOICE)
            return alone.unionByName(choices)
        return alone

    def turns(self) -> DataFrame:
        """conv, at and sub (their order), edit (K, R or I), turn (null where inserted), role, text of the repaired turns."""
        edits = F.element_at("edits", F.col("from") * 4 + F.col("to") + 1)
        told = self._told().join(self.leaves.select("conv", "piece", "n", "edits"), ["conv", "piece"])
        told = told.select("piece", F.lit(None).cast("long").alias("at"), "conv", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "from", "n", edits.alias("edits"), "tail")
        none = lambda name, kind: F.lit(None).cast(kind).alias(name)
        rows = self.placed.select("piece", "at", "conv", "turn", "role", "text", none("from", "int"), none("n", "long"), none("edits", "string"), none("tail", "string"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        streams = told.unionByName(rows).repartition(parts, "piece").sortWithinPartitions("piece", F.col("at").asc_nulls_first())
        return streams.mapInArrow(lambda batches: trimmed(_edited(batches)), EDITED)

    def digests(self) -> DataFrame:
        """conv and repaired_sha256, of role:text lines; conversations without repaired turns are left out."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.turns().repartition(parts, "conv").sortWithinPartitions("conv", "at", "sub").select("conv", "role", "text")
        return rows.mapInArrow(lambda batches: trimmed(_hashed(batches)), "conv string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults of known kinds, by a checksum of conv_id:turn: some turns are dropped, emptied, lose their full
    stops, come twice, or become the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "h")
    return rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = Repair(damaged(rows), "op12")
    ids = rows.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    found = ids.join(repair.report, "conv", "left").join(repair.digests(), "conv", "left")
    numbers = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
