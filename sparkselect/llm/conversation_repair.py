"""Repair of the role structure of conversations by auction shortest paths.

The rows of a conversation, in order, are the steps of a lattice whose nodes are
(row, state); the states are what the repaired roles end in so far: nothing, s, u or a. Keep, Rerole and
Delete lead to the next row, Insert to another state before the same row, and the costs are integers.
``solve`` is the auction algorithm: each node has a price that never exceeds the cost of an arc out of
it plus the price at its end. From the origin a path is extended along a tight arc, or, if its last node
has none, the node's price rises to the least such sum and the path is contracted.
When it reaches the end, the origin's price is the least cost, as is the price of every node on a cheapest
path, so all cheapest paths consist of tight arcs; the one whose labels are least in ASCII is traced
along arcs from which the end can still be reached.

On Spark: rows are sorted by range on (conv_id, turn, role, text), so that a long conversation lies in
several partitions. A task reads its rows as a stream in chunks of at most ``CHUNK`` rows. A conversation that
is one chunk inside a partition is repaired there. The others, at most two per partition and the long
ones, go on as chunks: each chunk's least costs between its states are computed in parallel,
one pass from the last chunk to the first gives every chunk its end prices, the chunks
are traced in parallel for each state that they can be entered in, and one pass from the first chunk on picks the
traces and hashes them. These two passes read one small row a chunk (the last also the repaired text, as a digest of
a conversation has to) and hold one chunk in memory.
Inside a chunk the lattice is solved ``STEP`` rows at a time from its end, as the path algorithm's work grows with the
square of the length.

Defined results: a null conv_id is a conversation of its own; a null turn comes first; a null
role or text counts as one space. Equal turns are ordered by role, then text; equal rows stay apart (the later is a
duplicate). Roles other than the three count by their first character and can only be reroled or
deleted unless it is s, u or a. Rows marked as not live exist only to name their conversation. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, partitions, written

#: Rows and characters of text of a chunk (one row at least).
CHUNK, CHUNK_TEXT = 256, 1 << 20
#: Rows that one auction spans.
STEP = 16

# Costs of the contract.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: States: nothing yet, after s, after u, after a.
EMPTY, S, U, A = range(4)
#: Least costs from each state to an accepted end without more rows, and their edits.
END = (0, 2 * INSERT, INSERT, 0)
END_EDITS = ("", "II", "I", "")
NAMES = {U: "user", A: "assistant"}
_NEXT = {(EMPTY, "s"): S, (EMPTY, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: State that Rerole and Insert lead to.
_TURN = (U, U, A, U)

Arc = tuple[int, int, str]


def arcs(rows: list[tuple[str, int]]) -> list[list[Arc]]:
    """Arcs (cost, node, label) of the lattice over (role initial, fault) rows, labels in ASCII order.
    Node 4 * i + state; the last four nodes are the end."""
    out: list[list[Arc]] = []
    for i, (initial, fault) in enumerate(rows):
        extra = TRUNCATED if fault == CUT else 0
        for state in range(4):
            here, there = 4 * i, 4 * i + 4
            own = [(DELETE, there + state, "D"), (INSERT, here + _TURN[state], "I")]
            if fault not in (BLANK, DUPLICATE):
                to = _NEXT.get((state, initial))
                if to is not None:
                    own.append((extra, there + to, "K"))
                own.append((REROLE + extra, there + _TURN[state], "R"))
            out.append(own)
    return out + [[], [], [], []]


def _useful(lattice: list[list[Arc]], end: list[float]) -> list[list[Arc]]:
    """The arcs that lead on to an end with a finite price."""
    ok = [False] * (len(lattice) - 4) + [e is not None for e in end]
    for row in range(len(lattice) - 8, -1, -4):
        for _ in range(2):  # an insertion stays on the row, and no useful path has more than two there
            for node in range(row, row + 4):
                ok[node] = ok[node] or any(ok[j] for _, j, _ in lattice[node])
    return [[a for a in own if ok[a[1]]] for own in lattice]


def solve(rows: list[tuple[str, int]], end: list, origins) -> tuple[list[list[Arc]], list]:
    """Auction over the lattice of ``rows`` with the prices ``end`` (None: no end there), from each origin state.

    Returns the arcs and the converged prices; the price of an origin is its least cost, None without a path.
    Prices start at a bound that no arc breaks: the least end price and 2 for every row that can't be kept free of cost."""
    lattice = _useful(arcs(rows), end)
    low = min(e for e in end if e is not None)
    price: list = [0] * len(lattice)
    price[-4:] = end
    bad = 0
    for i in range(len(rows) - 1, -1, -1):
        bad += DELETE if rows[i][1] else 0
        price[4 * i:4 * i + 4] = [low + bad] * 4
    last = len(lattice) - 4
    for origin in origins:
        if origin < last and not lattice[origin]:
            price[origin] = None
            continue
        path = [origin]
        while path[-1] < last:
            node = path[-1]
            best, to = None, -1
            for cost, j, _ in lattice[node]:
                if best is None or cost + price[j] < best:
                    best, to = cost + price[j], j
            if price[node] < best:
                price[node] = best  # contract
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)  # extend
    return lattice, price


def trace(lattice: list[list[Arc]], price: list, node: int) -> tuple[str, int]:
    """Labels of the ASCII-least path of tight arcs from ``node`` to an end, and the state it ends in."""
    last = len(lattice) - 4
    good = [False] * last + [p is not None for p in price[last:]]
    tight = [[(j, label) for cost, j, label in own if price[j] is not None and price[i] == cost + price[j]] if price[i] is not None else [] for i, own in enumerate(lattice)]
    for row in range(last - 4, -1, -4):
        for _ in range(2):
            for i in range(row, row + 4):
                good[i] = good[i] or any(good[j] for j, _ in tight[i])
    labels = []
    while node < last:
        node, label = next((j, label) for j, label in tight[node] if good[j])
        labels.append(label)
    return "".join(labels), node - last


def chunk_prices(rows: list[tuple[str, int]], end: list, origins=range(4)) -> list:
    """Least costs from each state before ``rows`` to ``end``; None where there is no path."""
    starts = range(0, len(rows), STEP)
    for s in reversed(starts):
        end = solve(rows[s:s + STEP], end, origins if s == 0 else range(4))[1][:4]
    return end


def chunk_traces(rows: list[tuple[str, int]], end: list, origins=range(4)) -> list[tuple[str, int] | None]:
    """For each origin state: the ASCII-least cheapest edits of ``rows`` and the state after them."""
    solved = []
    for s in reversed(range(0, len(rows), STEP)):
        own = solve(rows[s:s + STEP], end, origins if s == 0 else range(4))
        solved.append(own)
        end = own[1][:4]
    out: list = [None] * 4
    for origin in origins:
        state, labels = origin, ""
        for lattice, price in reversed(solved):
            if price[state] is None:
                break
            piece, state = trace(lattice, price, state)
            labels += piece
        else:
            out[origin] = (labels, state)
    return out


def repaired(roles: list[str], texts: list[str], labels: str, state: int) -> list[tuple[str, str]]:
    """The rows after the edits ``labels``, entered in ``state``."""
    out, i = [], 0
    for label in labels:
        if label == "I":
            state = _TURN[state]
            out.append((NAMES[state], ""))
            continue
        if label == "K":
            state = _NEXT[(state, roles[i][:1])]
            out.append((roles[i], texts[i]))
        elif label == "R":
            state = _TURN[state]
            out.append((NAMES[state], texts[i]))
        i += 1
    return out


# -- Spark ------------------------------------------------------------------------------------

_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
#: A chunk: its place (part, seq), facts that add up, and its rows.
_FACTS = ["live", "blank", "duplicate", "truncated", "illegal", "turns", "min_turn", "max_turn"]
_CHUNK = ("conv_id long, part int, seq long, done boolean, " + ", ".join(f"{c} long" for c in _FACTS)
          + ", roles array<string>, texts array<string>, faults array<int>, gaps long, cost long, audit string, repaired_sha256 string")
_BLANK_TEXT = re.compile(r"[^\x20\x09-\x0D]")
_SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
_LEGAL = ("su", "ua", "au")


def _fault(text: str, again: bool) -> int:
    if not _BLANK_TEXT.search(text):
        return BLANK
    if again:
        return DUPLICATE
    return SOUND if text.rstrip(_SEPARATORS)[-1] in ".!?" else CUT


def _facts(initials: list[str], faults: list[int], turns: list[int | None], before: int | None) -> dict:
    """Sums over a chunk; ``turns`` ascend, and ``before`` is the turn of the row before it in this partition."""
    seen = [t for t in turns if t is not None]
    return {
        "live": len(faults), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "turns": sum(a != b for a, b in zip(seen, [before, *seen], strict=False)), "min_turn": min(seen, default=None), "max_turn": max(seen, default=None)}


def _text(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def _gaps(facts: dict) -> int:
    return 0 if facts["min_turn"] is None else facts["max_turn"] - facts["min_turn"] + 1 - facts["turns"]


def _whole(facts: dict, roles: list[str], texts: list[str], faults: list[int]) -> dict:
    """Report columns of a conversation that is one chunk."""
    rows = [(r[:1], f) for r, f in zip(roles, faults, strict=True)]
    cost = chunk_prices(rows, list(END), [EMPTY])[EMPTY]
    audit, state = chunk_traces(rows, list(END), [EMPTY])[EMPTY]
    audit += END_EDITS[state]
    text = _text(repaired(roles, texts, audit, EMPTY))
    return {"gaps": _gaps(facts), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition -> chunks. The first and last conversation of a partition, and all of more
    than one chunk, come out as chunks; the others with their report."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("done", pa.bool_()), *[(c, pa.int64()) for c in _FACTS],
                        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())),
                        ("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out, part, conv, seq, first, before = [], None, None, 0, True, None
    roles, texts, faults, turns, size, started = [], [], [], [], 0, False

    def close(last: bool, edge: bool) -> None:
        """End the chunk; ``last``: the conversation ends here as far as this partition goes."""
        nonlocal roles, texts, faults, turns, size, seq, before
        facts = _facts([r[:1] for r in roles], faults, turns, before)
        row = {"conv_id": conv, "part": part, "seq": seq, "done": last and seq == 0 and not edge, **facts}
        row |= _whole(facts, roles, texts, faults) if row["done"] else {"roles": roles, "texts": texts, "faults": faults}
        out.append(row)
        before = next((t for t in reversed(turns) if t is not None), before)
        roles, texts, faults, turns, size, seq = [], [], [], [], 0, seq + 1

    for batch in batches:
        for key, turn, role, text, again, live, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not started or key != conv:
                if started:
                    close(True, first)
                    first = False
                conv, part, seq, before, started = key, of, 0, None, True
            elif len(faults) >= CHUNK or size >= CHUNK_TEXT:
                close(False, first)
            if live:
                roles.append(role)
                texts.append(text)
                faults.append(_fault(text, again))
                turns.append(turn)
                size += len(text)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if started:
        close(True, True)
    yield pa.RecordBatch.from_pylist(out, schema)


def _numbered(rows: DataFrame) -> DataFrame:
    """Written rows with an id each, and whether the same role and text come earlier in the conversation.

    First occurrences are minima, combined before the shuffle; they return to their rows by the id, so that a
    text that fills a conversation is no hot key."""
    kept = written(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "conversation-rows")
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "id")
    first = kept.where("live").groupBy("conv_id", "same").agg(F.min(place).alias("f")).select(F.col("f.id").alias("id"), F.lit(False).alias("new"))
    return kept.join(first, "id", "left").withColumn("again", F.coalesce("new", F.lit(True))).drop("new", "same")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: the least costs from each state before it to each state after it (null: no path)."""
    for batch in batches:
        for conv, part, seq, roles, faults in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = [(r[:1], f) for r, f in zip(roles, faults, strict=True)]
            costs = [chunk_prices(rows, [0 if s == to else None for s in range(4)]) for to in range(4)]
            flat = [costs[to][s] for s in range(4) for to in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([flat], pa.list_(pa.int64()))], names=["conv_id", "part", "seq", "m"])


def _prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from the last to the first: the price of each state after the chunk."""
    conv, end, started = None, list(END), False
    for batch in batches:
        ends, keys = [], batch.column(0).to_pylist()
        for key, m in zip(keys, batch.column(3).to_pylist(), strict=True):
            if not started or key != conv:
                conv, end, started = key, list(END), True
            ends.append(end)
            end = [min(m[4 * s + to] + end[to] for to in range(4) if m[4 * s + to] is not None) for s in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends, pa.list_(pa.int64()))], names=["conv_id", "part", "seq", "end"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and entry state: edits, the state after them, and the repaired text."""
    kind = pa.list_(pa.struct([("audit", pa.string()), ("state", pa.int32()), ("text", pa.string()), ("price", pa.int64())]))
    for batch in batches:
        for row in batch.to_pylist():
            roles, texts, end = row["roles"], row["texts"], row["end"]
            rows = [(r[:1], f) for r, f in zip(roles, row["faults"], strict=True)]
            price, found = chunk_prices(rows, end), chunk_traces(rows, end)
            ways = [{"audit": audit, "state": after, "text": "".join("\n" + _text([r]) for r in repaired(roles, texts, audit, s)), "price": price[s]} for s, (audit, after) in enumerate(found)]
            first, last = (rows[0][0], rows[-1][0]) if rows else (None, None)
            facts = [pa.array([row[c]], pa.int64()) for c in _FACTS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["conv_id"]], pa.int64()), pa.array([row["part"]], pa.int32()), pa.array([row["seq"]], pa.int64()), *facts,
                 pa.array([first], pa.string()), pa.array([last], pa.string()), pa.array([ways], kind)],
                names=["conv_id", "part", "seq", *_FACTS, "first_role", "last_role", "ways"])


_TRACED = "conv_id long, part int, seq long, " + ", ".join(f"{c} long" for c in _FACTS) + ", first_role string, last_role string, ways array<struct<audit:string,state:int,text:string,price:long>>"
_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from the first to the last: one report a conversation."""
    now: dict | None = None

    def report() -> pa.RecordBatch:
        audit = "".join(now["audit"]) + END_EDITS[now["state"]]
        for edit in END_EDITS[now["state"]]:
            now["state"] = _TURN[now["state"]]
            add("\n" + NAMES[now["state"]] + ":")
        values = [now["conv_id"], _gaps(now), now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], audit, now["hash"].hexdigest()]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=_OUT.replace(" long", "").replace(" string", "").split(", "))

    def add(text: str) -> None:
        if text:
            now["hash"].update(text[0 if now["any"] else 1:].encode("utf-8", "surrogatepass"))
            now["any"] = True

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield report()
                now = {"conv_id": row["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "min_turn": None, "max_turn": None, "live": 0,
                       "state": EMPTY, "audit": [], "hash": hashlib.sha256(), "any": False, "role": None, "fresh": False, "part": row["part"], "cost": row["ways"][EMPTY]["price"]}
            for c in ("live", "blank", "duplicate", "truncated", "illegal", "turns"):
                now[c] += row[c]
            now["fresh"] |= row["part"] != now["part"]
            now["part"] = row["part"]
            if row["min_turn"] is not None:
                if now["fresh"] and row["min_turn"] == now["max_turn"]:
                    now["turns"] -= 1  # counted at the end of the partition before
                now["fresh"] = False
                now["min_turn"] = row["min_turn"] if now["min_turn"] is None else now["min_turn"]
                now["max_turn"] = row["max_turn"]
            if row["live"]:
                now["illegal"] += now["role"] is not None and now["role"] + row["first_role"] not in _LEGAL
                now["role"] = row["last_role"]
            way = row["ways"][now["state"]]
            now["audit"].append(way["audit"])
            add(way["text"])
            now["state"] = way["state"]
    if now is not None:
        yield report()


def repair(conversations: DataFrame, live: Column | None = None) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``conversations`` needs conv_id, turn, role, text; rows for which ``live`` is false only name their conversation."""
    parts = partitions(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(True) if live is None else live).alias("live"))
    order = ["conv_id", "turn", "role", "text", "id"]
    placed = _numbered(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    chunks = written(placed.select("conv_id", "turn", "role", "text", "again", "live", F.spark_partition_id().alias("part")).mapInArrow(frugal(_chunks), _CHUNK), "conversation-chunks")
    names = [c.split(" ")[0] for c in _OUT.split(", ")]
    done, open_ = chunks.where("done").select(*names), chunks.where("not done")
    backward = ["conv_id", F.desc("part"), F.desc("seq")]
    costs = open_.select("conv_id", "part", "seq", "roles", "faults").mapInArrow(frugal(_matrices), "conv_id long, part int, seq long, m array<long>")
    ends = written(costs.repartition(parts, "conv_id").sortWithinPartitions(*backward).mapInArrow(frugal(_prices), "conv_id long, part int, seq long, `end` array<long>"), "conversation-prices")
    c, e = open_.alias("c"), ends.alias("e")
    same = F.col("c.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("c.part") == F.col("e.part")) & (F.col("c.seq") == F.col("e.seq"))
    traced = c.join(e, same).select("c.conv_id", "c.part", "c.seq", *[f"c.{f}" for f in _FACTS], "c.roles", "c.texts", "c.faults", "e.end").mapInArrow(frugal(_traces), _TRACED)
    joined = traced.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(frugal(_joined), _OUT)
    return done.union(joined.select(*names))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``; dropped rows stay with ``live`` false."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    part = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), part.alias("part"))
    changed = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("part") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("part") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
                       (F.col("part") != 0).alias("live"), F.explode(times).alias("copy")).drop("copy")


def op13_frame(conversations: DataFrame) -> DataFrame:
    rows = damaged(conversations)
    return repair(rows, F.col("live"))


#: DuckDB: the damage, then dynamic programming over (row, state) by (cost, edits).
OP13_SQL = r"""
with recursive tab as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), base as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda ch: cast(ascii(ch) as bigint))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as part
  from conversations, tab
), hurt as (
  select conv_id, turn, case when part = 4 then 'user' else role end as role,
         case part when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case when part = 3 then [1, 2] else [1] end) as copy from base) where part <> 0
), placed as (
  select *, dense_rank() over (order by conv_id nulls first) as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as i
  from hurt
), counted as (select *, row_number() over (partition by c, role, text order by i) as nth from placed
), rated as (
  select *, role[1] as u0, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when nth > 1 then 2
         when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 3 else 0 end as fault,
         lead(role[1]) over (partition by c order by i) as u1
  from counted
), facts as (
  select conv_id, c, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
         count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (u1 is not null and u0 || u1 not in ('su', 'ua', 'au')) as illegal
  from rated group by conv_id, c
), ins(s, s2, cost, edits, body) as (values
  ('e', 'e', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
  ('e', 'u', 5, 'I', chr(10) || 'user:'), ('s', 'u', 5, 'I', chr(10) || 'user:'), ('a', 'u', 5, 'I', chr(10) || 'user:'), ('u', 'a', 5, 'I', chr(10) || 'assistant:'),
  ('e', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), step(s, s2, edit, role) as (values
  ('e', 'e', 'D', ''), ('s', 's', 'D', ''), ('u', 'u', 'D', ''), ('a', 'a', 'D', ''),
  ('e', 's', 'K', 's'), ('e', 'u', 'K', 'u'), ('s', 'u', 'K', 'u'), ('u', 'a', 'K', 'a'), ('a', 'u', 'K', 'u'),
  ('e', 'u', 'R', 'user'), ('s', 'u', 'R', 'user'), ('a', 'u', 'R', 'user'), ('u', 'a', 'R', 'assistant')
), paths as (
  select c, 1 as i, 'e' as s, {'cost': 0, 'edits': '', 'body': ''} as best from facts
  union all
  select p.c, p.i + 1, step.s2,
         min({'cost': p.best.cost + ins.cost + case step.edit when 'D' then 2 when 'K' then 0 else 1 end + case when step.edit <> 'D' and r.fault = 3 then 5 else 0 end,
              'edits': p.best.edits || ins.edits || step.edit,
              'body': p.best.body || ins.body || case step.edit when 'D' then '' when 'K' then chr(10) || r.role || ':' || r.text else chr(10) || step.role || ':' || r.text end})
  from paths p join rated r on r.c = p.c and r.i = p.i join ins on ins.s = p.s join step on step.s = ins.s2
  where (step.edit = 'D' or r.fault not in (1, 2)) and (step.edit <> 'K' or r.u0 = step.role)
  group by p.c, p.i, step.s2
), done as (
  select f.c, min({'cost': p.best.cost + ins.cost, 'edits': p.best.edits || ins.edits, 'body': p.best.body || ins.body}) as best
  from facts f join paths p on p.c = f.c and p.i = f.n + 1 join ins on ins.s = p.s where ins.s2 in ('e', 'a') group by f.c
)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate,
       cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost,
       coalesce(best.edits, '') as audit, sha256(coalesce(best.body[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join facts f on f.conv_id is not distinct from o.conv_id left join done using (c)
"""
