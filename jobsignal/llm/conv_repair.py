"""Conversation structure repair by iterative-deepening A*.

Rows lie in range partitions of (conversation, turn). A conversation that lies within one is repaired there; one that
runs over an edge, or is longer than SEGMENT rows, is cut in segments, each of which is searched for every pair of states
at its ends; a fold over the segments' costs picks the states, and with them the audits that the segments contribute.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import joined_sha256
from .shared import pieces, written

#: Rows of a conversation that one search takes, and characters of their texts (with the last one, whatever its length).
SEGMENT, SEGMENT_BYTES = 512, 16 << 20
#: White space of the format, and what ends a sentence.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
CLEAN, TRUNCATED, GONE = 0, 1, 2
#: States: at the start, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or re-roled turn, by the state before: whichever of the two roles may come.
_MADE = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, TRUNCATION = 4, 3, 3, 3
#: Inserted turns that end a conversation, by the state it is in.
_TAIL = ("", "II", "I", "")
_FAR = 1 << 60


def _estimates(initials: list[str], faults: bytes, goal: int | None) -> list[list[int]]:
    """Lower bounds of the cost from (row, state) to the end: the exact cost of the machine that doesn't tell the state
    after a system turn from that after an assistant's, both of which wait for a user."""
    if goal is None:
        s, e, u = 0, 0, INSERT
    else:
        s, e, u = (_FAR if goal != g else 0 for g in (START, ASSISTANT, USER))
        e = 0 if goal == SYSTEM else e
    out = [[s, e, u, e]]
    for who, fault in zip(reversed(initials), reversed(faults)):
        a, b, c = s + DELETE, e + DELETE, u + DELETE
        if fault != GONE:
            more = TRUNCATION if fault else 0
            a, b, c = min(a, u + REROLE + more), min(b, u + REROLE + more), min(c, e + REROLE + more)
            if who == "s":
                a = min(a, e + more)
            elif who == "u":
                a, b = min(a, u + more), min(b, u + more)
            elif who == "a":
                c = min(c, e + more)
        s, e, u = min(a, c + INSERT), min(b, c + INSERT), min(c, b + INSERT)
        out.append([s, e, u, e])
    out.reverse()
    return out


def cheapest(initials: list[str], faults: bytes, start: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of rows, of equal ones the audit that is first in ASCII order.

    Depth-first search in the order Delete, Insert, Keep, Rerole under a bound on the cost, which rises to the least
    cost that went over it; the table of failed states holds what each is known to cost at least, so that a state is
    entered again only with more to spend. With ``goal`` None the rows end a conversation, inserted turns may follow, and
    the end must be accepting; else they end in just that state with the last row's edit, or None says that they can't.
    """
    n = len(initials)
    if goal is not None:
        # what the estimates' machine can't tell apart or count on: nothing but deletions keeps the start or a system turn
        if not n:
            return (0, "") if start == goal else None
        if goal == START or goal == SYSTEM == start:
            return (DELETE * n, "D" * n) if start == goal else None
        if goal == SYSTEM and (start != START or not any(i == "s" and f != GONE for i, f in zip(initials, faults))):
            return None
    least = _estimates(initials, faults, goal)

    def edits(i: int, q: int) -> list[tuple[str, int, int, int]]:
        if i == n:
            return [("I", INSERT, n, _MADE[q])] if goal is None else []
        if faults[i] == GONE:
            return [("D", DELETE, i + 1, q), ("I", INSERT, i, _MADE[q])]
        more = TRUNCATION if faults[i] else 0
        kept = _KEPT.get((q, initials[i]))
        keep = [] if kept is None else [("K", more, i + 1, kept)]
        return [("D", DELETE, i + 1, q), ("I", INSERT, i, _MADE[q]), *keep, ("R", REROLE + more, i + 1, _MADE[q])]

    while (bound := least[0][start]) < _FAR:
        path = [(0, start, 0, "", iter(edits(0, start)), [_FAR])]
        while path:
            i, q, spent, _, moves, best = path[-1]
            if i == n and (q in (START, ASSISTANT) if goal is None else q == goal):
                return spent, "".join(p[3] for p in path)
            for name, cost, j, r in moves:
                ahead = cost + least[j][r]
                if spent + ahead <= bound:
                    path.append((j, r, spent + cost, name, iter(edits(j, r)), [_FAR]))
                    break
                best[0] = min(best[0], ahead)
            else:  # failed: from here it costs at least that much
                least[i][q] = max(least[i][q], best[0])
                path.pop()
                if path:
                    above = path[-1]
                    above[5][0] = min(above[5][0], spent - above[2] + least[i][q])
    return None


def repaired(audit: str, state: int, rows: list[tuple[str, str]]) -> tuple[list[str], int]:
    """(the turns that an audit makes of rows (role, text) as ``role:text``, the state after them)."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = _MADE[state]
            out.append(_ROLE[state] + ":")
            continue
        role, text = rows[at]
        at += 1
        if edit == "K":
            state = _KEPT[state, role[:1]]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = _MADE[state]
            out.append(f"{_ROLE[state]}:{text}")
    return out, state


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def fault(text: str) -> int:
    bare = text.strip(SPACE)
    return GONE if not bare else CLEAN if bare[-1] in ENDS else TRUNCATED


_DONE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OPEN = "part int, seg long, idx long, turn long, role string, text string, ghost boolean"
_TYPES = [*[pa.int64()] * 7, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
_NAMES = [f.split()[0] for f in f"{_DONE}, {_OPEN}".split(", ")]


def _whole(conv, rows: list[tuple]) -> tuple:
    """The result of a conversation from its rows (turn, role, text) after damage."""
    turns = {t for t, _, _ in rows if t is not None}
    seen, faults = set(), bytearray()
    counts = [0, 0, 0]
    for _, role, text in rows:
        f = fault(text)
        repeated = f != GONE and (role, text) in seen
        seen.add((role, text))
        counts[0 if f == GONE else 1 if repeated else 2] += f != CLEAN or repeated
        faults.append(GONE if repeated else f)
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = cheapest(initials, bytes(faults))
    text = "\n".join(repaired(audit, START, [r[1:] for r in rows])[0])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *counts, illegal_pairs(initials), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition -> results of the conversations that certainly begin and end in it, rows of the rest."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    held: list[tuple] = []
    size, idx, seg, conv, begun, first = 0, 0, 0, None, False, True

    def spill() -> None:
        """What is held as a segment of its own."""
        nonlocal held, size, idx, seg
        for k, (turn, role, text, ghost) in enumerate(held):
            out.append((conv, *[None] * 8, part, seg, idx + k, turn, role, text, ghost))
        idx, seg, held, size = idx + len(held), seg + 1, [], 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(_NAMES)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    for piece in pieces(batches, 512):
        for c, *row in zip(*(x.to_pylist() for x in piece.columns)):
            if begun and c != conv:
                if first or seg:
                    spill()
                else:
                    out.append((*_whole(conv, [r[:3] for r in held if not r[3]]), *[None] * 7))
                held, size, idx, seg, first = [], 0, 0, 0, False
            conv, begun = c, True
            held.append(tuple(row))
            size += len(row[2] or "")
            if len(held) >= SEGMENT or size >= SEGMENT_BYTES:
                spill()
        if out:
            yield batch()
    if begun:
        spill()
        yield batch()


_SEGMENT = "ck string, part int, seg long, q int, r int, cost long, place int, audit string, n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, lo long, hi long, turns long"
_SEGMENT_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3]


def _segment(table: pa.Table) -> pa.Table:
    """Rows (ck, part, seg, idx, turn, who, fault, repeated, ghost) of a segment -> a row for each pair of states that
    its rows can lead from one to the other, with cost, audit and the audit's place among those from the same state."""
    rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
    ck, part, seg = (rows[0][c] for c in ("ck", "part", "seg"))
    rows = [r for r in rows if not r["ghost"]]
    initials, turns = [r["who"] for r in rows], [r["turn"] for r in rows if r["turn"] is not None]
    repeated = [r["repeated"] and r["fault"] != GONE for r in rows]
    faults = bytes(GONE if d else r["fault"] for r, d in zip(rows, repeated))
    blank, dup = sum(r["fault"] == GONE for r in rows), sum(repeated)
    stats = (len(rows), blank, dup, sum(r["fault"] == TRUNCATED and not d for r, d in zip(rows, repeated)), illegal_pairs(initials), initials[0] if rows else None, initials[-1] if rows else None, min(turns, default=None), max(turns, default=None), len(set(turns)))
    out = []
    for q in range(4):
        found = {r: got for r in range(4) if (got := cheapest(initials, faults, q, r))}
        order = sorted({audit for _, audit in found.values()})
        out += [(ck, part, seg, q, r, cost, order.index(audit), audit, *stats) for r, (cost, audit) in found.items()]
    names = [f.split()[0] for f in _SEGMENT.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _SEGMENT_TYPES)], names=names)


_FOLDED = "ck string, part int, seg long, q int, r int, ending string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _fold(table: pa.Table) -> pa.Table:
    """The states between the segments of one conversation: least cost, then least audit. A row for each segment, the
    last with the conversation's counts; some twenty numbers for SEGMENT rows of a conversation are held."""
    segments: dict[tuple, dict] = {}
    for r in table.to_pylist():
        s = segments.setdefault((r["part"], r["seg"]), r | {"ways": {}})
        s["ways"][r["q"], r["r"]] = (r["cost"], r["place"])
    keys = sorted(segments)
    ahead = [INSERT * len(t) for t in _TAIL]
    back = [ahead]
    for k in reversed(keys):
        ways = segments[k]["ways"]
        back.append([min((c + back[-1][r] for (p, r), (c, _) in ways.items() if p == q), default=_FAR) for q in range(4)])
    back.reverse()
    q, out = START, []
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    last_who, last_turn, lo, hi, distinct = None, None, None, None, 0
    for i, k in enumerate(keys):
        s = segments[k]
        place, r = min((place, r) for (p, r), (c, place) in s["ways"].items() if p == q and c + back[i + 1][r] == back[i][q])
        for c in counts:
            counts[c] += s[c]
        if s["n"]:
            counts["illegal"] += last_who is not None and last_who + s["head"] not in ("su", "ua", "au")
            last_who = s["tail"]
        if s["lo"] is not None:
            distinct += s["turns"] - (s["lo"] == last_turn)
            last_turn, lo, hi = s["hi"], s["lo"] if lo is None else lo, s["hi"]
        out.append([s["ck"], *k, q, r, "", *[None] * 6])
        q = r
    out[-1][5:] = [_TAIL[q], hi - lo + 1 - distinct if lo is not None else 0, *counts.values(), back[0][START]]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.split()[0] for f in _FOLDED.split(", ")])


def _turns(table: pa.Table) -> pa.Table:
    """Rows of a segment with its audit -> its repaired turns in one text; none, if it keeps and inserts none."""
    rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
    a = rows[0]
    out, _ = repaired(a["audit"] + a["ending"], a["q"], [(r["role"], r["text"]) for r in rows if not r["ghost"]])
    some = [out] if out else []
    return pa.table([pa.array([a["ck"] for _ in some], pa.string()), pa.array([a["part"] for _ in some], pa.int32()), pa.array([a["seg"] for _ in some], pa.int64()), pa.array(["\n".join(o) for o in some], pa.string())], names=["ck", "part", "seg", "turns"])


def _across(rows: DataFrame) -> DataFrame:
    """Results of conversations whose rows (conv_id, part, seg, idx, turn, role, text, ghost) lie in several partitions or
    segments. Nothing but a segment, or a conversation's list of segments, is taken together."""
    bare = F.regexp_replace("text", r"[ \t\n\x0B\f\r]+\z", "")
    faults = F.when(F.length(bare) == 0, GONE).when(F.substring(bare, -1, 1).isin(*ENDS), CLEAN).otherwise(TRUNCATED)
    ck = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    o = rows.select(ck.alias("ck"), "part", "seg", "idx", "turn", "role", "text", "ghost", F.shiftleft(F.col("part").cast("long"), 36).bitwiseOR(F.col("idx")).alias("at"), F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    firsts = o.where("not ghost").groupBy("ck", "h", "h2").agg(F.min("at").alias("first"))
    marked = o.withColumn("fault", F.coalesce(faults, F.lit(GONE))).select("ck", "part", "seg", "idx", "turn", F.coalesce(F.substring("role", 1, 1), F.lit("")).alias("who"), "fault", "at", "h", "h2", "ghost")
    marked = marked.join(firsts.hint("merge"), ["ck", "h", "h2"], "left").select("ck", "part", "seg", "idx", "turn", "who", "fault", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("repeated"), "ghost")
    segments = written(marked.groupBy("ck", "part", "seg").applyInArrow(_segment, _SEGMENT), "segments")
    folded = written(segments.drop("audit").groupBy("ck").applyInArrow(_fold, _FOLDED), "folded")
    picked = written(folded.select("ck", "part", "seg", "q", "r", "ending").join(segments.select("ck", "part", "seg", "q", "r", "audit").hint("merge"), ["ck", "part", "seg", "q", "r"]), "picked")
    told = o.select("ck", "part", "seg", "idx", "role", "text", "ghost").join(picked.hint("merge"), ["ck", "part", "seg"])
    turns = written(told.groupBy("ck", "part", "seg").applyInArrow(_turns, "ck string, part int, seg long, turns string"), "turns")
    sha = joined_sha256(turns, ["ck"], ["part", "seg"], "turns", "\n")
    audits = picked.groupBy("ck").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seg", F.concat("audit", "ending").alias("a")))), lambda x: x["a"]), "").alias("audit"))
    out = folded.where("cost IS NOT NULL").join(audits.hint("merge"), "ck").join(sha.hint("merge"), "ck", "left")
    conv = F.when(F.col("ck") != "null", F.col("ck").cast("long"))
    return out.select(conv.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, ghost) -> a row per conv_id: faults, cost, audit and digest of the repair.

    A row with ``ghost`` true is no turn: it only says that its conversation is there. Turns are ordered by (turn, role,
    text), null turns first; equal rows stand together, the second is a duplicate. A null conv_id is a conversation of
    its own. Null and white roles and texts are what the caller made of them; a role that begins with none of s, u, a,
    empty ones included, can't be kept. Texts without anything but white space are blank, of any length otherwise.
    Further columns are ignored; an empty table gives no rows.
    """
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.coalesce("ghost", F.lit(False)).alias("ghost"))
    order = ["conv_id", "turn", "role", "text", F.monotonically_increasing_id()]
    s = r.repartitionByRange(*order).sortWithinPartitions("conv_id", "turn", "role", "text")
    t = written(s.mapInArrow(_runs, f"{_DONE}, {_OPEN}"), "repairs")
    done = t.where("part IS NULL").select(*[f.split()[0] for f in _DONE.split(", ")])
    open_ = t.where("part IS NOT NULL").select("conv_id", "part", "seg", "idx", "turn", "role", "text", "ghost")
    return done.unionByName(_across(open_))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with one row in four damaged by the CRC-32 of ``conv_id:turn`` modulo 20: 0 becomes a ghost,
    1 loses its text, 2 its sentence ends, 3 comes twice, 4 gets the role user. Null ids, turns (in the checksum), roles
    and texts count as one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    ghost = F.col("kind") == 0
    d = d.select("conv_id", "turn", F.when(ghost, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(ghost, "").otherwise(text).alias("text"), ghost.alias("ghost"), "kind")
    return d.select("conv_id", "turn", "role", "text", "ghost", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")
