"""Operator 12, repair of conversation structure by depth-first branch and bound.

A conversation's rows stand by turn (nulls first; rows of one turn by role, then by the SHA-256 of their text).
Each row has at most one fault, the first of: blank, duplicate (role and text stood earlier), truncated (no end of a
sentence).  The edits Keep 0, Rerole 2, Delete 3 and Insert 2 (a kept or reroled truncated row costs 1 more) make the
initials of the roles fit ``(s?(ua)+)?``; blank and duplicate rows must go.  The cheapest edits are taken; among equal
costs those whose initials are ASCII-least.

The search runs over pieces of at most ``PIECE`` rows, cut from rows sorted over the whole table, so that a
conversation of any length is dealt over tasks.  ``search`` goes depth first from an explicit stack; a prefix goes on
only if its cost and the suffix's lower bound (by row and state, from the end backwards over costs alone) can still
beat the incumbent's (cost, audit), and if the dominance table of its node (row, state) has no better prefix.  A looser
bound (forced deletions and disjoint bad neighbours) was tried first: 70,000 nodes for 64 rows, against a few hundred.
A piece that is a whole conversation is searched once; others from each state to each state, and the
same search then goes over a conversation's pieces with those results as its edges.  Equal-cost audits over the same
rows are never prefixes of each other, as they have a letter for each row and differ in inserted rows, so the least of
a whole is made of least parts.  Copies of a row within a turn are counted, not held: all but the first are deleted.

Only hashes and flags of rows are sorted and searched; the texts are joined to the repaired rows at the end.

Defined cases: a null id is a conversation of its own; a null role or text is one space, so a blank row of the role
" "; a null turn stands before the others and counts in no gap; empty texts are blank; texts of any length are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import stored

PIECE, FAN = 64, 16
START, SYSTEM, USER, ASSISTANT = range(4)  # the state is the last role that stands
FINAL = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FORCED, TRUNCATED = 1, 2  # flags of an entry
NONE = (1 << 60, "")
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"


# ---- the search ----------------------------------------------------------------------------------------------
def needed(state: int) -> int:
    """The state that the next inserted or reroled row brings."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int:
    """The state after a kept row, or -1 where it can't stand."""
    if initial == "s":
        return SYSTEM if state == START else -1
    if initial == ("a" if state == USER else "u"):
        return needed(state)
    return -1


def steps(entry, state: int):
    """(cost, letters, new state, entries taken) of the edits at an entry."""
    initial, flags, n = entry
    rest = n - 1
    if flags & FORCED:
        yield 3 * n, "D" * n, state, 1
    else:
        extra = 1 if flags & TRUNCATED else 0
        yield 2 + extra + 3 * rest, "R" + "D" * rest, needed(state), 1
        yield 3 * n, "D" * n, state, 1
    yield 2, "I", needed(state), 0
    if not flags & FORCED and (to := kept(state, initial)) >= 0:
        yield extra + 3 * rest, "K" + "D" * rest, to, 1


def inserted(state: int):
    yield 2, "I", needed(state), 0


def bounds(entries, ends, edges=steps) -> list[list[int]]:
    """For each place and state the least cost of what is still to come, audits aside: no way to one of the end states
    is cheaper."""
    lower = []
    for entry in [None, *reversed(entries)]:
        here = [0 if entry is None and s in ends else NONE[0] for s in range(4)]
        ways = [(s, *way) for s in range(4) for way in (inserted(s) if entry is None else edges(entry, s))]
        for s, cost, _, to, taken in ways:
            if taken:
                here[s] = min(here[s], cost + lower[-1][to])
        for _ in range(3):  # rows inserted here: never more than three before the state comes round again
            for s, cost, _, to, taken in ways:
                if not taken:
                    here[s] = min(here[s], cost + here[to])
        lower.append(here)
    return lower[::-1]


def search(entries, begin: int, ends, edges=steps) -> tuple[int, str]:
    """The least (cost, audit) from a state before the first entry to one of the states after the last."""
    lower = bounds(entries, ends, edges)
    last, best = len(entries), NONE
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, begin, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + lower[at][state]
        if least > best[0] or least == best[0] and audit > best[1][:len(audit)] or least >= NONE[0]:
            continue
        if seen.get((at, state), NONE) <= (cost, audit):
            continue
        seen[at, state] = (cost, audit)
        if at == last and state in ends:
            best = min(best, (cost, audit))
        ways = [(cost + more + lower[at + taken][to], letters, at + taken, to, cost + more)
                for more, letters, to, taken in (edges(entries[at], state) if at < last else inserted(state))]
        # the most promising way, and of equals the least letters, is taken from the stack first
        stack += [(place, to, total, audit + letters) for _, letters, place, to, total in sorted(ways, reverse=True)]
    return best


def _ways(table, state: int):
    """What a piece's table {(from, to): (cost, audit)} offers as edits."""
    return [(c, a, to, 1) for (s, to), (c, a) in table.items() if s == state]


def table_of(entries, starts=range(4), edges=steps) -> dict[tuple[int, int], tuple[int, str]]:
    """The least (cost, audit) from each state to each state where there is a way."""
    found = {(s, to): search(entries, s, (to,), edges) for s in starts for to in range(4)}
    return {k: v for k, v in found.items() if v != NONE}


def joined(tables) -> tuple[int, str]:
    """The least (cost, audit) of a conversation from its pieces' tables.  Many pieces become fewer, larger ones first, so
    that audits are copied a few times only."""
    while len(tables) > FAN:
        tables = [table_of(tables[i:i + FAN], edges=_ways) for i in range(0, len(tables), FAN)]
    return search(tables, START, FINAL, _ways)


def repaired(entries, part: str, after: int):
    """(entry or None, role) of the rows that a part of an audit leaves or inserts; after: the rows left by later
    parts.  As the last row is the assistant's, what is still to come tells whose turn it is."""
    left = after + len(part) - part.count("D")
    at = used = 0
    for letter in part:
        if letter == "I":
            yield None, ROLE[ASSISTANT if left % 2 else USER]
        else:
            while used == entries[at]["n"]:
                at, used = at + 1, 0
            used += 1
            if letter == "K":
                yield entries[at], entries[at]["role"]
            elif letter == "R":
                yield entries[at], ROLE[ASSISTANT if left % 2 else USER]
        left -= letter != "D"


# ---- rows ----------------------------------------------------------------------------------------------------
def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows after damage by crc32("conv_id:turn") % 20 (0 drops a row, 1 empties
    its text, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's); n is 0 for a dropped row, 2 for
    a repeated one."""
    kind = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn")).cast("binary")) % 20
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             _spaced("role").alias("role"), _spaced("text").alias("text"), kind.alias("kind"))
    return c.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def counted(rows: DataFrame) -> DataFrame:
    """rows with n = 1, for conversations that are repaired as they are."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       _spaced("role").alias("role"), _spaced("text").alias("text"), F.lit(1).cast("long").alias("n"))


def _entries(rows: DataFrame) -> DataFrame:
    """conv, turn, role, h, n, blank, again, cut: one row for equal rows of a turn.  again: role and text have an
    earlier turn in the conversation; the earliest turns come from a minimum made map-side."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    e = stored(rows.select("conv", "turn", "role", "h", (trimmed == "").alias("blank"),
                           (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"), "n")
               .groupBy("conv", "turn", "role", "h", "blank", "cut").agg(F.sum("n").alias("n")))
    earliest = (e.filter("n > 0").groupBy(F.col("conv").alias("c2"), F.col("role").alias("r2"), F.col("h").alias("h2"))
                .agg(F.min(F.struct(F.col("turn").isNotNull().alias("x"), "turn")).alias("t0")))
    same = (F.col("conv") == F.col("c2")) & (F.col("role") == F.col("r2")) & (F.col("h") == F.col("h2"))
    # a row that is only dropped may find no earliest turn
    again = F.col("t0").isNotNull() & ~F.col("turn").eqNullSafe(F.col("t0.turn"))
    return e.join(earliest, same, "left").select("conv", "turn", "role", "h", "n", "blank", again.alias("again"), "cut")


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")
_text, _long = pa.string(), pa.int64()
PIECES = pa.schema([
    ("conv", _text), ("turn", _long), ("role", _text), ("h", _text), ("whole", pa.bool_()),
    ("entries", pa.list_(pa.struct([("turn", _long), ("role", _text), ("h", _text), ("n", _long)]))),
    ("edges", pa.list_(pa.struct([("s", pa.int32()), ("to", pa.int32()), ("cost", _long), ("audit", _text)]))),
    *[(c, _long) for c in COUNTS], ("first_initial", _text), ("last_initial", _text)])
PIECES_DDL = ("conv string, turn long, role string, h string, whole boolean, entries array<struct<turn:long,role:string,h:string,n:long>>, "
              "edges array<struct<s:int,to:int,cost:long,audit:string>>, " + ", ".join(f"{c} long" for c in COUNTS)
              + ", first_initial string, last_initial string")


def _piece(conv, rows, whole: bool, first: bool) -> dict:
    """The row of a piece: its entries, what it counts, and the costs of its ways from state to state.  whole: it
    is a whole conversation; first: it begins one."""
    out = dict.fromkeys(PIECES.names) | dict(conv=conv, turn=rows[0][0], role=rows[0][1], h=rows[0][2], whole=whole, entries=[],
                                             blank=0, duplicate=0, truncated=0, illegal=0, turns=0)
    entries, before = [], None
    for turn, role, h, n, blank, again, cut in rows:
        if not n:
            continue  # a dropped row
        initial = role[:1]
        flags = FORCED if blank or again else TRUNCATED if cut else 0
        out["blank"] += n if blank else 0
        out["duplicate"] += 0 if blank else n if again else n - 1
        out["truncated"] += flags == TRUNCATED
        out["illegal"] += n - 1 + (before is not None and before + initial not in LEGAL)
        if before is None:
            out["first_initial"] = initial
        out["last_initial"] = before = initial
        if turn is not None:
            out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
            out["turns"] += turn != out["last_turn"]
            out["last_turn"] = turn
        entries.append((initial, flags, n))
        out["entries"].append(dict(turn=turn, role=role, h=h, n=n))
    if whole:
        found = {(START, ASSISTANT): search(entries, START, FINAL)}
    else:
        found = table_of(entries, (START,) if first else range(4))
    out["edges"] = [dict(s=s, to=to, cost=cost, audit=audit) for (s, to), (cost, audit) in found.items()]
    return out


def _pieces(entries: DataFrame) -> DataFrame:
    """All conversations in pieces.  Where they are cut may differ from run to run, what they add up to doesn't."""
    def run(batches):
        conv, rows, begins, some, out = None, [], False, False, []  # begins: the rows held surely begin a conversation
        for batch in batches:
            for c, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if some and c != conv:
                    out.append(_piece(conv, rows, begins, begins))
                    rows, begins = [], True
                elif len(rows) >= PIECE:
                    out.append(_piece(conv, rows, False, begins))
                    rows, begins = [], False
                some, conv = True, c
                rows.append(row)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, PIECES)
                    out = []
        if some:  # the next task may go on with this conversation
            out.append(_piece(conv, rows, False, begins))
        if out:
            yield pa.RecordBatch.from_pylist(out, PIECES)

    order = ["conv", "turn", "role", "h"]
    ranged = entries.select(*order, "n", "blank", "again", "cut").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.mapInArrow(run, PIECES_DDL))


TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PARTS = pa.schema([("conv", _text), ("turn", _long), ("role", _text), ("h", _text), ("part", _text), ("before", _long), ("after", _long),
                   *[(c, _long) for c in TOTALS], ("audit", _text)])
PARTS_DDL = ("conv string, turn long, role string, h string, part string, before long, after long, "
             + ", ".join(f"{c} long" for c in TOTALS) + ", audit string")


def _joined(pieces: DataFrame) -> DataFrame:
    """The parts of the audits of conversations in several pieces, a row for each piece; the conversation's totals
    and whole audit stand in its first row."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["h"]))
        total = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        low = high = initial = None
        for r in rows:
            if r["turns"]:
                total["turns"] -= high == r["first_turn"]
                low, high = r["first_turn"] if low is None else low, r["last_turn"]
            if r["first_initial"] is not None:
                total["illegal"] += initial is not None and initial + r["first_initial"] not in LEGAL
                initial = r["last_initial"]
        cost, audit = joined([{(e["s"], e["to"]): (e["cost"], e["audit"]) for e in r["edges"]} for r in rows])
        n = total.pop("turns")
        total |= {"gaps": high - low + 1 - n if n else 0, "cost": cost, "audit": audit}
        out, at, before, after = [], 0, 0, len(audit) - audit.count("D")
        for i, r in enumerate(rows):
            end, letters = at, r["n"]  # rows inserted between two pieces go to the later one
            while letters:
                letters -= audit[end] != "I"
                end += 1
            part = audit[at:] if i == len(rows) - 1 else audit[at:end]
            stay = len(part) - part.count("D")
            after -= stay
            out.append({k: r[k] for k in ("conv", "turn", "role", "h")} | {"part": part, "before": before, "after": after}
                       | (total if i == 0 else dict.fromkeys(total)))
            at, before = end, before + stay
        return pa.Table.from_pylist(out, PARTS)

    n = F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    return (pieces.filter("not whole").select("conv", "turn", "role", "h", "edges", n.alias("n"), *COUNTS, "first_initial", "last_initial")
            .groupBy("conv").applyInArrow(run, PARTS_DDL))


def _rows(pieces: DataFrame) -> DataFrame:
    """conv, place, role, kept_turn, kept_role, h, kept of the repaired rows of pieces with their part of the audit."""
    names = ["conv", "place", "role", "kept_turn", "kept_role", "h"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for conv, entries, part, before, after in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for place, (entry, role) in enumerate(repaired(entries, part, after), before):
                    e = entry or {"turn": None, "role": None, "h": None}
                    for column, value in zip(out, (conv, place, role, e["turn"], e["role"], e["h"])):
                        column.append(value)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, (_text, _long, _text, _long, _text, _text))], names=names)

    return pieces.select("conv", "entries", "part", "before", "after").mapInArrow(
        run, "conv string, place long, role string, kept_turn long, kept_role string, h string")


def _id() -> Column:
    return F.when(F.col("conv") != " ", F.col("conv").cast("long")).alias("conv_id")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired) of rows (conv_id, turn, role, text, n) such as ``damaged`` or ``counted`` give.

    audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; a row for every conversation, also
    one whose rows have all been dropped.  repaired: conv_id, place (from 0), role, text, turn (null for inserted
    rows)."""
    rows = rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))).withColumn("h", F.sha2("text", 256))
    pieces = _pieces(_entries(rows))
    cut = stored(_joined(pieces))
    ends = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0)
    whole = pieces.filter("whole").withColumn("way", F.col("edges")[0])
    audits = (whole.select("conv", ends.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "way.cost", "way.audit")
              .union(cut.filter("audit is not null").select("conv", *TOTALS, "audit")))
    parts = cut.select(*[F.col(c).alias(f"p_{c}") for c in ("conv", "turn", "role", "h")], "part", "before", "after")
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ("conv", "turn", "role", "h")]
    zero = F.lit(0).cast("long")
    left = _rows(whole.select("conv", "entries", F.col("way.audit").alias("part"), zero.alias("before"), zero.alias("after"))
                 .union(pieces.filter("not whole").join(parts, same).select("conv", "entries", "part", "before", "after")))
    texts = (rows.filter("n > 0").groupBy(F.col("conv").alias("t_conv"), F.col("turn").alias("t_turn"), F.col("role").alias("t_role"),
                                          F.col("h").alias("t_h")).agg(F.min("text").alias("text")))
    key = ((F.col("conv") == F.col("t_conv")) & F.col("kept_turn").eqNullSafe(F.col("t_turn"))
           & (F.col("kept_role") == F.col("t_role")) & (F.col("h") == F.col("t_h")))
    whole_rows = (left.filter("h is not null").join(texts, key).select("conv", "place", "role", "text", "t_turn")
                  .union(left.filter("h is null").select("conv", "place", "role", F.lit(""), F.lit(None).cast("long"))))
    return (audits.select(_id(), *TOTALS, "audit"),
            whole_rows.select(_id(), "place", "role", "text", F.col("t_turn").alias("turn")))


def digests(repaired_rows: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of every conversation that has a repaired row.  A conversation's rows pass through one
    task, as its one hash demands, but are never held together."""
    def run(batches):
        conv, digest = None, None
        for batch in batches:
            convs, out = [], []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if c != conv:
                    if digest:
                        convs.append(conv)
                        out.append(digest.hexdigest())
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.record_batch([pa.array(convs, _text), pa.array(out, _text)], names=["conv", "repaired_sha256"])
        if digest:
            yield pa.record_batch([pa.array([conv], _text), pa.array([digest.hexdigest()], _text)], names=["conv", "repaired_sha256"])

    r = repaired_rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), "role", "text", "place")
    return r.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "role", "text").mapInArrow(
        run, "conv string, repaired_sha256 string")


def repair_audit(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    audits, left = repair(rows)
    d = digests(left)
    empty = hashlib.sha256(b"").hexdigest()
    a = audits.withColumn("own", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    return (a.join(d, a["own"] == d["conv"], "left")
            .select("conv_id", *TOTALS, "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")))
