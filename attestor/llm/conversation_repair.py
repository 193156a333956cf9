"""Cheapest repairs of conversations by a dynamic programme over a shared grammar.

A turn is one of 16 symbols: the kind of its role (system, user, assistant, other) and its first fault
(none, truncated, blank, duplicate). What a stretch of turns can do to an automaton of the legal role
orders is a min-plus matrix over the automaton's states, whose entries are the least cost and the least
audit (the edits' initials) at that cost; stretches combine by matrix products. A Re-Pair grammar is
compressed from the distinct symbol sequences of all conversations: round after round, the most frequent
pairs of neighbours become rules. Each rule's matrix is found once, bottom-up, from those of its two
sides; audits are ropes, so that a rule's audit is two references. A conversation is then a short product.

The grammar has at most ``RULES`` rules; a sequence it compresses less is a longer product with the same
result. Conversations of any length: turns are put in order by range partitions and cut into pieces of
``PIECE`` turns, each piece is one matrix, and only these are chained per conversation. Texts are moved
once, to write repaired conversations; these stream through a task sorted, with their audit before them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.frames import parts, written
from attestor.operators.ordered import running_totals

#: Turns of one piece of a conversation.
PIECE = 4096
#: Rules of the grammar, rules added in one round, and rounds; a rule spans at most 2 ** ROUNDS turns.
RULES = 2048
RULES_A_ROUND = 256
ROUNDS = 12
#: Pieces whose matrices a task remembers.
REMEMBERED = 50_000

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

_KINDS = "sua"  # and others
_NONE, _TRUNCATED, _BLANK, _DUPLICATE = range(4)
_TERMINALS = 16  # 4 * kind + fault
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
_STATES = 4
_NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}  # (state, kind)
_ACCEPT = (0, 3)
_FAR = 1 << 60
_BLANKS = " \t\n\x0b\x0c\r"

Rope = str | tuple
_FLAT = 64


def joined(a: Rope, b: Rope) -> Rope:
    """A rope of two: short ones are one string, others refer to both."""
    if not a or not b:
        return a or b
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= _FLAT:
        return a + b
    return (a, b)


def _chunks(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top[1], top[0])


def flat(rope: Rope) -> str:
    return "".join(_chunks(rope))


def less(a: Rope, b: Rope) -> bool:
    """Whether rope ``a`` comes before ``b``; equal stretches are compared string by string."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right, x, y = _chunks(a), _chunks(b), "", ""
    while True:
        x, y = x or next(left, ""), y or next(right, "")
        n = min(len(x), len(y))
        if not n:
            return len(x) < len(y)
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


class Matrix(NamedTuple):
    """Least cost and least audit from each state (row) to each (column), row by row; ``_FAR`` where there is no way."""

    cost: list
    audit: list


def _empty() -> Matrix:
    return Matrix([_FAR] * _STATES**2, [""] * _STATES**2)


def _offer(m: Matrix, at: int, cost: int, audit: Rope) -> None:
    if cost < m.cost[at] or (cost == m.cost[at] and less(audit, m.audit[at])):
        m.cost[at], m.audit[at] = cost, audit


def product(a: Matrix, b: Matrix) -> Matrix:
    out = _empty()
    for x in range(0, len(a.cost), _STATES):
        for z in range(_STATES):
            first = a.cost[x + z]
            if first < _FAR:
                for y in range(_STATES):
                    second = b.cost[_STATES * z + y]
                    if second < _FAR and first + second <= out.cost[x + y]:
                        _offer(out, x + y, first + second, joined(a.audit[x + z], b.audit[_STATES * z + y]))
    return out


def _inserts() -> Matrix:
    """Any number of inserted turns (two at most are ever of use)."""
    out = _empty()
    for state in range(_STATES):
        at, audit = state, ""
        for _ in range(3):
            _offer(out, _STATES * state + at, INSERT * len(audit), audit)
            at, audit = _NEXT.get((at, 1), _NEXT.get((at, 2))), audit + "I"
    return out


INSERTS = _inserts()


def _turn(symbol: int) -> Matrix:
    """Inserts before a turn, and what can be done with the turn."""
    kind, fault = divmod(symbol, 4)
    edits = _empty()
    for state in range(_STATES):
        _offer(edits, _STATES * state + state, DELETE, "D")
        if fault in (_NONE, _TRUNCATED):
            more = TRUNCATED if fault == _TRUNCATED else 0
            if (state, kind) in _NEXT:
                _offer(edits, _STATES * state + _NEXT[state, kind], more, "K")
            for new in (1, 2):
                if (state, new) in _NEXT:
                    _offer(edits, _STATES * state + _NEXT[state, new], REROLE + more, "R")
    return product(INSERTS, edits)


TURNS = [_turn(s) for s in range(_TERMINALS)]


class Grammar(NamedTuple):
    """Rounds of rules: each round's pairs as ``left * BASE + right``, sorted, and their places in order of frequency."""

    pairs: list
    places: list
    first: list  # number of the round's first rule


_BASE = _TERMINALS + RULES


def _replaced(symbols: np.ndarray, pairs: np.ndarray, places: np.ndarray, first: int) -> np.ndarray:
    """One round on sequences with ``-1`` between: where pairs overlap the more frequent one becomes a rule."""
    left, right = symbols[:-1], symbols[1:]
    code = np.where((left < 0) | (right < 0), -1, left * _BASE + right)
    at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
    rank = np.where(pairs[at] == code, places[at], _BASE)
    # Neighbours of one rank are a repeated symbol: every second pair of such a stretch is taken.
    begin = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
    value = np.concatenate(([_BASE], rank[begin], [_BASE]))
    lowest = (value[1:-1] < _BASE) & ((value[1:-1] < value[:-2]) | (value[:-2] == _BASE)) & ((value[1:-1] < value[2:]) | (value[2:] == _BASE))
    size = np.diff(np.append(begin, len(rank)))
    taken = np.repeat(lowest, size) & ((np.arange(len(rank)) - np.repeat(begin, size)) % 2 == 0)
    out, stay = symbols.copy(), np.ones(len(symbols), bool)
    hit = np.flatnonzero(taken)
    out[hit] = first + rank[hit]
    stay[hit + 1] = False
    return out[stay]


def compressed(sequences: list[str], grammar: Grammar) -> np.ndarray:
    """All sequences as symbols of the grammar, one after the other, each followed by ``-1``."""
    letters = np.frombuffer("@".join([*sequences, ""]).encode(), np.uint8).astype(np.int64)
    symbols = np.where(letters == 64, -1, letters - 65)
    for pairs, places, first in zip(*grammar, strict=True):
        if len(symbols) > 1:
            symbols = _replaced(symbols, pairs, places, first)
    return symbols


def _pair_counts(grammar: Grammar):
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            symbols = compressed(b.column("symbols").to_pylist(), grammar)
            left, right = symbols[:-1], symbols[1:]
            pair, n = np.unique((left * _BASE + right)[(left >= 0) & (right >= 0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], schema=schema)

    return run


def fit(sequences: DataFrame) -> Grammar:
    """The rules of distinct ``symbols``. The driver gets at most ``RULES_A_ROUND`` pairs a round."""
    grammar = Grammar([], [], [])
    room = RULES
    for _ in range(ROUNDS):
        counts = sequences.mapInArrow(_pair_counts(grammar), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        best = [r.pair for r in counts.orderBy(F.desc("n"), "pair").limit(min(RULES_A_ROUND, room)).collect()]
        if not best:
            break
        order = np.argsort(best)
        grammar.pairs.append(np.array(best, np.int64)[order])
        grammar.places.append(order.astype(np.int64))
        grammar.first.append(_TERMINALS + RULES - room)
        room -= len(best)
        if not room:
            break
    return grammar


def rule_matrices(grammar: Grammar) -> list[Matrix]:
    """The matrix of every symbol, rules from those of their two sides."""
    matrices = list(TURNS)
    for pairs, places in zip(grammar.pairs, grammar.places, strict=True):
        in_order = pairs[np.argsort(places)].tolist()
        matrices += [product(matrices[code // _BASE], matrices[code % _BASE]) for code in in_order]
    return matrices


def _counts(symbols: str) -> tuple[int, int, int, int, int, int]:
    """Blank, duplicate and truncated turns, illegal neighbours, first and last kind."""
    s = np.frombuffer(symbols.encode(), np.uint8).astype(np.int64) - 65
    kind, fault = s // 4, s % 4
    legal = _legal(kind[:-1], kind[1:])
    return (*(int((fault == f).sum()) for f in (_BLANK, _DUPLICATE, _TRUNCATED)), int((~legal).sum()), int(kind[0]), int(kind[-1]))


def _legal(a, b):
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


_SUMS = ("blank", "duplicate", "truncated", "illegal")
_PIECE_COLUMNS = "part long, no long, symbols string"
_SOLVED = "part long, no long, cost array<bigint>, audit array<string>, blank long, duplicate long, truncated long, illegal long, first long, last long"


def _typed(key: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", key), *T.StructType.fromDDL(ddl).fields])


def _record(columns: dict, like: pa.Schema) -> pa.RecordBatch:
    """A batch whose ``conv_id`` has the type it came with."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, like.field(c).type if c == "conv_id" else None) for c, v in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, conv = TaskContext.get().partitionId(), 0, "", None
        for b in batches:
            out: dict[str, list] = {"conv_id": [], "no": [], "symbols": []}

            def put(symbols: str, out=out) -> None:
                nonlocal no
                out["conv_id"].append(conv)
                out["no"].append(no)
                out["symbols"].append(symbols)
                no += 1

            for name, first, more, times in zip(*(b.column(c).to_pylist() for c in ("conv_id", "first", "more", "times")), strict=True):
                if held and name != conv:
                    put(held)
                    held = ""
                conv = name
                held += first
                while times:  # copies of one turn, a piece at a time
                    n = min(times, max(size - len(held), 0))
                    held, times = held + more * n, times - n
                    if len(held) >= size:
                        put(held)
                        held = ""
                if len(held) >= size:
                    put(held)
                    held = ""
            like = b.schema
            if out["no"]:
                yield _record({"conv_id": out["conv_id"], "part": [part] * len(out["no"]), "no": out["no"], "symbols": out["symbols"]}, like)
        if held:
            yield _record({"conv_id": [conv], "part": [part], "no": [no], "symbols": [held]}, like)

    return run


def _solve(grammar: Grammar, matrices: list[Matrix]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            symbols = b.column("symbols").to_pylist()
            if len(known) > REMEMBERED:
                known.clear()
            new = sorted(set(symbols) - known.keys())
            if new:
                short = compressed(new, grammar)
                ends = np.flatnonzero(short < 0)
                for text, x, y in zip(new, np.append(0, ends[:-1] + 1).tolist(), ends.tolist(), strict=True):
                    whole = None
                    for s in short[x:y].tolist():
                        whole = matrices[s] if whole is None else product(whole, matrices[s])
                    known[text] = ([c if c < _FAR else None for c in whole.cost], [flat(a) for a in whole.audit], *_counts(text))
            rows = [known[s] for s in symbols]
            columns = {"conv_id": b.column("conv_id"), "part": b.column("part"), "no": b.column("no")}
            for i, (name, kind) in enumerate((("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())), *((c, pa.int64()) for c in (*_SUMS, "first", "last")))):
                columns[name] = pa.array([r[i] for r in rows], kind)
            yield _record(columns, b.schema)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one row per conversation."""
    start = Matrix([0, _FAR, _FAR, _FAR], [""] * _STATES)
    conv, state, sums, last, open_ = None, start, [0] * 4, None, False

    def done() -> tuple:
        end = product(state, INSERTS)
        best = Matrix([_FAR], [""])
        for x in _ACCEPT:
            if end.cost[x] < _FAR:
                _offer(best, 0, end.cost[x], end.audit[x])
        return (conv, *sums, best.cost[0], flat(best.audit[0]))

    def record(rows: list[tuple]) -> pa.RecordBatch:
        names = ("conv_id", *_SUMS, "cost", "audit")
        return _record(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    for b in batches:
        schema, out = b.schema, []
        for row in b.to_pylist():
            if open_ and row["conv_id"] != conv:
                out.append(done())
                state, sums, last = start, [0] * 4, None
            conv, open_ = row["conv_id"], True
            piece = Matrix([_FAR if c is None else c for c in row["cost"]], row["audit"])
            state = _row_product(state, piece)
            sums = [a + row[c] for a, c in zip(sums, _SUMS, strict=True)]
            if last is not None and not _legal(last, row["first"]):
                sums[3] += 1
            last = row["last"]
        if out:
            yield record(out)
    if open_:
        yield record([done()])


def _row_product(row: Matrix, b: Matrix) -> Matrix:
    """Product of one row with a matrix."""
    out = Matrix([_FAR] * _STATES, [""] * _STATES)
    for z in range(_STATES):
        for y in range(_STATES):
            cost = row.cost[z] + b.cost[_STATES * z + y]
            if cost < _FAR:
                _offer(out, y, cost, joined(row.audit[z], b.audit[_STATES * z + y]))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the check damages them: by crc32 of ``conv_id:turn`` modulo 20; NULLs become one space."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = rows.withColumn("harm", F.crc32(key.cast("binary")) % 20).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _same(columns: tuple) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return out


def _prepared(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: missing roles and texts as one space."""
    space = F.lit(" ")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def turns(rows: DataFrame) -> DataFrame:
    """One row per different turn: ``conv_id, turn, tie`` (its order), ``first`` (symbol), ``more`` and ``times`` (its copies)."""
    end = F.rtrim(F.col("text"), F.lit(_BLANKS))
    kind = F.instr(F.lit(_KINDS), F.substring("role", 1, 1)) - 1
    kind = F.when((F.length("role") == 0) | (kind < 0), len(_KINDS)).otherwise(kind)
    own = F.when(end == "", _BLANK).when(~F.substring(end, -1, 1).isin(".", "!", "?"), _TRUNCATED).otherwise(_NONE)
    print_ = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256))
    narrow = rows.select("conv_id", "turn", print_.alias("print"), kind.alias("kind"), own.alias("own"))
    counted = written(narrow.groupBy("conv_id", "turn", "print").agg(F.count(F.lit(1)).alias("copies"), F.max("kind").alias("kind"), F.max("own").alias("own")))

    # What stands in several turns is a duplicate in all but the first of them.
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = counted.groupBy("conv_id", "print").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = counted.alias("l").join(again.alias("r"), _same(("conv_id", "print")), "left").select("l.*", "r.least")
    later = F.col("least").isNotNull() & ~F.col("least.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("own") == _BLANK, _BLANK).when(later, _DUPLICATE).otherwise(F.col("own"))
    copy = F.when(F.col("own") == _BLANK, _BLANK).otherwise(_DUPLICATE)

    def letter(f: Column) -> Column:
        return F.char(F.lit(65) + 4 * F.col("kind") + f)

    named = named.select("conv_id", "turn", "print", letter(fault).alias("first"), letter(copy).alias("more"), (F.col("copies") - 1).alias("times"))

    # Different rows of one turn number are put in order by role and text; only these bring them along.
    shared = counted.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id", "turn")
    texts = rows.alias("l").join(shared.alias("r"), _same(("conv_id", "turn")), "left_semi").select("conv_id", "turn", "role", "text", print_.alias("print")).distinct()
    ties = running_totals(texts, ["conv_id", "turn"], ["role", "text"], {"tie": F.lit(1)}).select("conv_id", "turn", "print", "tie")
    ranked = named.alias("l").join(ties.alias("r"), _same(("conv_id", "turn", "print")), "left")
    return ranked.select("l.conv_id", "l.turn", F.coalesce("r.tie", F.lit(0)).cast("long").alias("tie"), "l.first", "l.more", "l.times")


def pieces(ordered: DataFrame, size: int = PIECE) -> DataFrame:
    """Symbol sequences of conversations in order, cut at ``size`` turns and at the ends of range partitions."""
    key = ordered.schema["conv_id"].dataType
    ordered = ordered.repartitionByRange(parts(ordered), "conv_id", "turn", "tie").sortWithinPartitions("conv_id", "turn", "tie")
    return written(ordered.select("conv_id", "first", "more", "times").mapInArrow(_pieces(size), _typed(key, _PIECE_COLUMNS)))


def solved(cut: DataFrame) -> DataFrame:
    """``conv_id``, the counts of faults, and the cheapest repair's ``cost`` and ``audit``, per conversation with turns."""
    key = cut.schema["conv_id"].dataType
    grammar = fit(written(cut.select("symbols").distinct()))
    matrices = cut.mapInArrow(_solve(grammar, rule_matrices(grammar)), _typed(key, _SOLVED))
    matrices = matrices.repartition(parts(cut), "conv_id").sortWithinPartitions("conv_id", "part", "no")
    return matrices.mapInArrow(_chain, _typed(key, "blank long, duplicate long, truncated long, illegal long, cost long, audit string"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, edit, role, text)`` of each repaired turn, ``(conv_id, None, None, None)`` where a conversation begins."""
    audit, at, state, conv = "", 0, 0, None

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            new = 2 if state == 2 else 1
            state, at = _NEXT[state, new], at + 1
            yield conv, "I", ("user", "assistant")[new - 1], ""

    for b in batches:
        for name, edits, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if edits is not None:
                yield from inserted()
                audit, at, state, conv = edits, 0, 0, name
                yield conv, None, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = _NEXT[state, _KINDS.index(role[0])]
                yield conv, "K", role, text
            elif edit == "R":
                new = 2 if state == 2 else 1
                state = _NEXT[state, new]
                yield conv, "R", ("user", "assistant")[new - 1], text
    yield from inserted()


def _sorted_with_audits(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order."""
    audits = repairs.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    both = audits.unionByName(texts).repartition(parts(rows), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return both.select("conv_id", "audit", "role", "text")


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the turns of the repaired conversations, numbered from 0."""

    columns = ("conv_id", "place", "edit", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = 0, []
        batches, like = _with_schema(batches)
        for conv, edit, role, text in _edited(batches):
            if edit is None:
                place = 0
                continue
            out.append((conv, place, edit, role, text))
            place += 1
            if len(out) == 1024:
                yield _record(dict(zip(columns, map(list, zip(*out, strict=True)), strict=True)), like)
                out = []
        if out:
            yield _record(dict(zip(columns, map(list, zip(*out, strict=True)), strict=True)), like)

    schema = _typed(rows.schema["conv_id"].dataType, "place long, edit string, role string, text string")
    return _sorted_with_audits(_prepared(rows), repairs).mapInArrow(run, schema)


def _with_schema(batches: Iterator[pa.RecordBatch]) -> tuple[Iterator[pa.RecordBatch], pa.Schema | None]:
    first = next(batches, None)
    if first is None:
        return iter(()), None

    def every() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    return every(), first.schema


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest per conversation, of which one turn at a time is held."""
    batches, like = _with_schema(batches)
    convs, digests, running, begun = [], [], None, False
    for conv, edit, role, text in _edited(batches):
        if edit is None:
            if running is not None:
                digests.append(running.hexdigest())
            if len(digests) >= 4096:
                yield _record({"conv_id": convs, "repaired_sha256": digests}, like)
                convs, digests = [], []
            convs.append(conv)
            running, begun = hashlib.sha256(), False
            continue
        running.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
        begun = True
    if running is not None:
        yield _record({"conv_id": convs, "repaired_sha256": [*digests, running.hexdigest()]}, like)


def repair(rows: DataFrame, *, piece: int = PIECE) -> DataFrame:
    """The faults and cheapest repairs of conversations (``conv_id``, ``turn``, ``role``, ``text``), one row each.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Turns are in order of
    ``turn``, NULL first; different turns of one number by role, then text. A missing role or text is one
    space. A turn's first fault counts: no sign but ASCII white space; role and text seen earlier; last sign
    not ``.``, ``!`` or ``?``. The repaired roles' initials follow ``(s?(ua)+)?``: turns are kept (0), get another
    role (3), are deleted (4; blank and duplicate ones must be), or empty user and assistant turns are
    inserted (3); truncated turns that stay cost 3 more. Of the cheapest repairs the one with the least
    ``audit`` (the edits' initials, K R D I, in order) is taken. Rows without ``conv_id`` are one conversation; a
    role is known by its first letter. Other columns are ignored; an empty table gives an empty result.
    A conversation may be long: only its audit (a letter per turn) is held by a task.
    """
    rows = _prepared(rows)
    seen = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("n"))  # each turn number once, before they are counted
    gaps = seen.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long")).alias("gaps"))
    repairs = written(solved(pieces(turns(rows), piece)))
    digests = _sorted_with_audits(rows, repairs).mapInArrow(_digest, _typed(rows.schema["conv_id"].dataType, "repaired_sha256 string"))
    found = repairs.alias("l").join(gaps.alias("r"), _same(("conv_id",))).select("l.*", "r.gaps")
    found = found.alias("l").join(digests.alias("r"), _same(("conv_id",))).select("l.*", "r.repaired_sha256")
    return found.select("conv_id", "gaps", *_SUMS, "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame, *, piece: int = PIECE) -> DataFrame:
    """:func:`repair` after :func:`damaged`; every conversation of the input has a row, also where no turn is left."""
    found = repair(damaged(conversations), piece=piece)
    every = conversations.select("conv_id").distinct()
    found = every.alias("l").join(found.alias("r"), _same(("conv_id",)), "left").select("l.conv_id", *(f"r.{c}" for c in found.columns if c != "conv_id"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", *_SUMS, "cost")}
    return found.withColumns({**zero, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))})
