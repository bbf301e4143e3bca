"""Conversation structure repair: the cheapest edits that make turns alternate, by an auction for shortest paths.

Lattice. Node (i, s) says that i rows are read and the repaired roles so far are none, a system turn, end in a user turn or end in
an assistant turn (s). Arcs keep a row (0), give it the role that must come next (3), delete it (4) or insert an
empty turn before it (3); a truncated row that stays costs 3 more, and blank and repeated rows can only be deleted. Paths from (0, none)
to the end (none, or after an assistant turn) are the repairs.

Auction. Every node has a price, at first a bound from the rows' least costs before the next solved row; no price exceeds an arc's cost plus the price at
its other end. A path grows from an origin: its last node's best arc is followed if the node's price pays for it exactly
(extension), else the price rises to that best offer and the node leaves the path (contraction). A path ends where an earlier
one passed or at the end, and all prices on it are then distances. Origins are the four nodes of every `STRIDE`-th
row, from the last to the first, so a path is never longer than two strides and the work grows with the rows. The
converged prices expose the tight arcs (price = cost + price), among which all cheapest repairs lie; the first of them in
ASCII order of edit initials is traced from the start, leaving dead ends once.

Spark. One shuffle by conversation. Each row travels twice, first as a few bytes (turn, role, text hash, faults), then as its
text, and the sort puts all short ones of a conversation before its texts: a task knows the repair when the texts come by and hands
them on one by one. It holds some bytes a row of one conversation and never its texts. A conversation has one digest, which
can only be computed from its first turn to its last, so it is never split over tasks.

Defined cases: nulls in any column count as one space (a null turn comes first, a null conv_id is a conversation of its own);
rows with one turn are ordered by role, then by the MD5 of their text; repeated rows are repeated turns; a role
that does not begin with s, u or a, an empty one too, can't be kept; a span of turns beyond a long counts as the largest
long; a conversation with no rows left has zeros, no edits and the digest of the empty string; empty tables give
no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .work import query, table

STRIDE = 8
FRESH, SYSTEM, USER, ASSISTANT = range(4)
#: The role that must come next, by state, and the state it leads to.
NEXT = {FRESH: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
LEGAL = {(0, 1), (1, 2), (2, 1)}
WHOLE, TRUNCATED, UNFIT = range(3)
END = 3 * (OTHER + 1)
KEEP, REROLE, DELETE, INSERT, STUMP = 0, 3, 4, 3, 3

Arc = tuple[str, int, int]


def _kept(state: int, initial: int) -> int | None:
    """The state after a kept row."""
    if initial == 0:
        return SYSTEM if state == FRESH else None
    return NEXT[state] if initial in (1, 2) and NEXT[state] == initial + 1 else None


def _arcs(code: int, state: int) -> tuple[Arc, ...]:
    """Letter, cost and distance in node numbers of the arcs of a node, letters in ASCII order."""
    insert = ("I", INSERT, NEXT[state] - state)
    if code == END:
        return (("", 0, 4 - state), insert) if state in (FRESH, ASSISTANT) else (insert,)
    initial, fault = divmod(code, 3)
    arcs = [("D", DELETE, 4), insert]
    if fault != UNFIT:
        more = STUMP if fault == TRUNCATED else 0
        kept = _kept(state, initial)
        if kept is not None:
            arcs.append(("K", KEEP + more, 4 + kept - state))
        arcs.append(("R", REROLE + more, 4 + NEXT[state] - state))
    return tuple(arcs)


ARCS = tuple(tuple(_arcs(code, state) for state in range(4)) for code in range(END + 1))
#: What a row costs at least.
LEAST = tuple(DELETE if code % 3 == UNFIT else STUMP if code % 3 == TRUNCATED else 0 for code in range(END)) + (0,)


def auction(codes: list[int], stride: int = STRIDE) -> list[int]:
    """Prices of all nodes; those on paths from the start are distances to the end. Node 4i + s is (i, s), the last is the end."""
    rows = [*codes, END]
    end = 4 * len(rows)
    price, done, beyond = [0] * (end + 1), bytearray(end + 1), len(rows)
    done[end] = 1
    for first in range(len(codes) - len(codes) % stride, -1, -stride):
        bound = min(price[4 * beyond : 4 * beyond + 4])
        for i in range(beyond - 1, first - 1, -1):
            bound += LEAST[rows[i]]
            price[4 * i : 4 * i + 4] = [bound] * 4
        beyond = first
        for origin in range(4 * first, 4 * first + 4) if first else (0,):
            path = [origin]
            while not done[v := path[-1]]:
                best = to = -1
                for _, cost, step in ARCS[rows[v >> 2]][v & 3]:
                    offer = cost + price[v + step]
                    if best < 0 or offer < best:
                        best, to = offer, v + step
                if price[v] < best:
                    price[v] = best
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(to)
            for v in path:
                done[v] = 1
    return price


def cheapest_edits(codes: list[int], stride: int = STRIDE) -> tuple[int, str]:
    """Cost and ASCII-least initials of a cheapest repair of rows with these codes (3 x initial + fault)."""
    price, rows = auction(codes, stride), [*codes, END]
    end, dead = len(price) - 1, bytearray(len(price))
    path, letters = [0], []
    while (v := path[-1]) != end:
        for letter, cost, step in ARCS[rows[v >> 2]][v & 3]:
            if price[v] == cost + price[v + step] and not dead[v + step]:
                path.append(v + step)
                letters.append(letter)
                break
        else:
            dead[path.pop()] = 1
            letters.pop()
    return price[0], "".join(letters)


class Conversation:
    """One conversation as its rows come by: short rows first, then texts."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.seen: set[bytes] = set()
        self.turns: tuple[int, int, int] | None = None  # least, greatest, number of distinct ones
        self.faults = [0, 0, 0]
        self.illegal, self.last = 0, -1
        self.audit: str | None = None
        self.cost = self.at = 0
        self.state, self.digest, self.place = FRESH, hashlib.sha256(), 0

    def short(self, turn: int | None, initial: int, key: bytes, blank: bool, closed: bool, copies: int) -> None:
        for _ in range(copies):
            if turn is not None:
                low, high, n = self.turns or (turn, turn, 1)
                self.turns = (low, turn, n + (turn != high))
            fault = 0 if blank else 1 if key in self.seen else None if closed else 2
            self.seen.add(key)
            if fault is not None:
                self.faults[fault] += 1
            self.codes.append(3 * initial + (WHOLE if fault is None else TRUNCATED if fault == 2 else UNFIT))
            self.illegal += self.last >= 0 and (self.last, initial) not in LEGAL
            self.last = initial

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest_edits(self.codes)
            self.seen.clear()

    def _give(self, edit: str, role: str, text: bytes) -> tuple[int, str, str, bytes]:
        if self.place:
            self.digest.update(b"\n")
        self.digest.update(role.encode() + b":" + text)
        self.place += 1
        return self.place, edit, role, text

    def _inserted(self) -> Iterator[tuple[int, str, str, bytes]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self.at += 1
            yield self._give("I", NAMES[self.state], b"")

    def text(self, role: str, text: bytes, copies: int) -> Iterator[tuple[int, str, str, bytes]]:
        """The repaired turns up to this row: place, edit, role, text."""
        self.settle()
        for _ in range(copies):
            yield from self._inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = _kept(self.state, INITIALS[role[0]])
                yield self._give(edit, role, text)
            elif edit == "R":
                self.state = NEXT[self.state]
                yield self._give(edit, NAMES[self.state], text)

    def finish(self) -> Iterator[tuple[int, str, str, bytes]]:
        self.settle()
        yield from self._inserted()

    def report(self) -> tuple:
        gaps = 0 if self.turns is None else min(self.turns[1] - self.turns[0] + 1 - self.turns[2], 2**63 - 1)
        return (gaps, *self.faults, self.illegal, self.cost, self.audit, self.digest.hexdigest())


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPORT_KINDS = [pa.int64()] * 6 + [pa.string()] * 2
TURNS = "place long, edit string, role string, text string"
TURN_KINDS = [pa.int64(), pa.string(), pa.string(), pa.binary()]


def _rows(rows: DataFrame) -> DataFrame:
    """Short and long rows of each conversation, together and in order."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    given = rows.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), copies.alias("copies"))
    tail = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    hashed = given.select("*", F.md5("text").alias("hash"), tail.alias("tail"))
    short = F.struct(
        F.lit(0).alias("kind"), F.unhex(F.md5(F.concat_ws("\n", "role", "hash"))).alias("key"), (F.col("tail") == "").alias("blank"),
        F.right("tail", F.lit(1)).isin(".", "!", "?").alias("closed"), F.lit(None).cast("string").alias("text"),
    )
    long = F.struct(
        F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("boolean").alias("blank"),
        F.lit(None).cast("boolean").alias("closed"), F.col("text").alias("text"),
    )
    both = hashed.select("conv_id", "turn", "role", "hash", "copies", F.inline(F.when(F.col("copies") > 0, F.array(short, long)).otherwise(F.array(short))))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "hash")


def _streamed(rows: DataFrame, turns: bool) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, id_kind = None, None, None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            kinds = [id_kind, *(TURN_KINDS if turns else REPORT_KINDS)]
            fields = ["conv_id", *(piece.split()[0] for piece in (TURNS if turns else REPORT).split(","))]
            columns = zip(*found) if found else [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays([a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays], fields)

        def ended() -> Iterator[tuple]:
            tail = [(name, *turn) for turn in now.finish()]
            yield from tail if turns else [(name, *now.report())]

        for rows_ in batches:
            out, size, id_kind = [], 0, rows_.schema.field("conv_id").type
            column = {n: rows_.column(n) for n in rows_.schema.names}
            column["text"] = column["text"].cast(pa.binary())
            order = ("conv_id", "turn", "role", "copies", "kind", "key", "blank", "closed", "text")
            for conv, turn, role, copies, long, key, blank, closed, text in zip(*(column[n].to_pylist() for n in order)):
                if now is None or conv != name:
                    if now is not None:
                        out += ended()
                    now, name = Conversation(), conv
                if not long:
                    now.short(turn, INITIALS.get(role[:1], OTHER), key, blank, closed, copies)
                    continue
                for given in now.text(role, text, copies):
                    if turns:
                        out.append((conv, *given))
                        size += len(text)
                if size > 1 << 24:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)
        if now is not None:
            yield batch(list(ended()))

    return _rows(rows).mapInArrow(stream, f"conv_id {kind}, {TURNS if turns else REPORT}")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit (K, R or I), role and text of the repaired conversations of rows (conv_id, turn, role, text).

    An optional column `copies` says how often a row comes (0: only its conversation is known)."""
    return _streamed(rows, True)


def repair_report(rows: DataFrame) -> DataFrame:
    """Gaps, faults, cost, edits and the digest of the repaired turns of every conversation; input as for repaired_turns."""
    return _streamed(rows, False)


def damaged(rows: DataFrame, kinds: int = 20) -> DataFrame:
    """Rows with the faults that crc32(conv_id:turn) deals out; a dropped row has no copies."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % kinds
    given = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


SQL = r"""
with recursive bits(i, v, k) as (
    select i, i, 0 from range(256) t(i)
    union all
    select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8
), crc_table as (
    select list(v order by i) as crcs from bits where k = 8
), given as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)),
            lambda a, c: xor(crcs[(xor(a, c) & 255) + 1], a >> 8)), 4294967295) % 20 as fault
    from conversations, crc_table
), after as (
    select conv_id, turn, case when fault = 4 then 'user' else role end as role,
        case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from given, range(2) copy(c) where fault <> 0 and (c = 0 or fault = 3)
), placed as (
    select *, row_number() over w as pos, lag(left(role, 1)) over w as before
    from after window w as (partition by conv_id order by turn nulls first, role, md5(text))
), judged as (
    select *, left(role, 1) as initial,
        case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
             when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
             when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else 'none' end as fault
    from placed
), ends as (
    select conv_id, max(pos) as n from judged group by conv_id
), back as (
    select conv_id, n as left_, {'c': 0, 'a': '', 't': []::varchar[]} as v0, {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']} as v1,
        {'c': 3, 'a': 'I', 't': ['assistant:']} as v2, {'c': 0, 'a': '', 't': []::varchar[]} as v3
    from ends
    union all
    select conv_id, left_ - 1,
        list_min([w0, {'c': 3 + n2.c, 'a': 'I' || n2.a, 't': list_prepend('user:', n2.t)}]),
        list_min([w1, {'c': 3 + n2.c, 'a': 'I' || n2.a, 't': list_prepend('user:', n2.t)}]),
        n2,
        list_min([w3, {'c': 3 + w2.c, 'a': 'I' || w2.a, 't': list_prepend('user:', w2.t)}])
    from (
        select *, list_min([w2, {'c': 3 + w3.c, 'a': 'I' || w3.a, 't': list_prepend('assistant:', w3.t)}]) as n2
        from (
            select b.conv_id, b.left_,
                list_min([{'c': 4 + v0.c, 'a': 'D' || v0.a, 't': v0.t},
                    case when fit and initial = 's' then {'c': stump + v1.c, 'a': 'K' || v1.a, 't': list_prepend(role || ':' || text, v1.t)} end,
                    case when fit and initial = 'u' then {'c': stump + v2.c, 'a': 'K' || v2.a, 't': list_prepend(role || ':' || text, v2.t)} end,
                    case when fit then {'c': 3 + stump + v2.c, 'a': 'R' || v2.a, 't': list_prepend('user:' || text, v2.t)} end]) as w0,
                list_min([{'c': 4 + v1.c, 'a': 'D' || v1.a, 't': v1.t},
                    case when fit and initial = 'u' then {'c': stump + v2.c, 'a': 'K' || v2.a, 't': list_prepend(role || ':' || text, v2.t)} end,
                    case when fit then {'c': 3 + stump + v2.c, 'a': 'R' || v2.a, 't': list_prepend('user:' || text, v2.t)} end]) as w1,
                list_min([{'c': 4 + v2.c, 'a': 'D' || v2.a, 't': v2.t},
                    case when fit and initial = 'a' then {'c': stump + v3.c, 'a': 'K' || v3.a, 't': list_prepend(role || ':' || text, v3.t)} end,
                    case when fit then {'c': 3 + stump + v3.c, 'a': 'R' || v3.a, 't': list_prepend('assistant:' || text, v3.t)} end]) as w2,
                list_min([{'c': 4 + v3.c, 'a': 'D' || v3.a, 't': v3.t},
                    case when fit and initial = 'u' then {'c': stump + v2.c, 'a': 'K' || v2.a, 't': list_prepend(role || ':' || text, v2.t)} end,
                    case when fit then {'c': 3 + stump + v2.c, 'a': 'R' || v2.a, 't': list_prepend('user:' || text, v2.t)} end]) as w3
            from back b join (select *, fault not in ('blank', 'duplicate') as fit, case when fault = 'truncated' then 3 else 0 end as stump from judged) r
                on r.conv_id is not distinct from b.conv_id and r.pos = b.left_
        )
    )
), counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (pos > 1 and before || initial not in ('su', 'ua', 'au')) as illegal
    from judged group by conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(v0.c, 0)::bigint as cost,
    coalesce(v0.a, '') as audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id
left join back b on b.conv_id is not distinct from o.conv_id and b.left_ = 0
"""


@query(SQL)
def op12_conversation_repair(spark, folder):
    return repair_report(damaged(table(spark, folder, "conversations")))
