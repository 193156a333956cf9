"""Conversation repair against all edit sequences of short conversations and a plain search on long ones."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import conversation_repair as C
from attestor.llm.queries import op13_conversation_repair

ROWS = "conv_id long, turn long, role string, text string"
_LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """``(role, text, fault)`` of sorted rows."""
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def search(rows):
    """The least (cost, audit), and the repaired rows, found in order of cost and audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, before, out = heapq.heappop(heap)
        if i == len(rows) and before in ("", "a"):
            return cost, audit, out
        if (i, before) in done:
            continue
        done.add((i, before))

        def go(price, edit, at, role, text, cost=cost, audit=audit, before=before, out=out):
            if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[before]:
                if role:
                    heapq.heappush(heap, (cost + price, audit + edit, at, role[0], (*out, (role, text))))

        for new in ("user", "assistant"):
            go(3, "I", i, new, "")
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, before, out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                go(more, "K", i + 1, role, text)
                for new in ("user", "assistant"):
                    go(3 + more, "R", i + 1, new, text)
    raise AssertionError


def exhaustive(rows):
    """The least (cost, audit) of all edits of every row with up to two inserts before each and at the end."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for before in product(inserts, repeat=len(rows) + 1):
        for edits in product("KDua", repeat=len(rows)):
            cost, audit, roles = 3 * sum(map(len, before)), "", ""
            for added, edit, (role, _, fault) in zip(before, edits, rows, strict=False):
                audit, roles = audit + "I" * len(added), roles + "".join(r[0] for r in added)
                if edit == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if fault in ("blank", "duplicate") or (edit == "K" and not role):
                    break
                cost += (3 if fault else 0) + (0 if edit == "K" else 3)
                audit, roles = audit + ("K" if edit == "K" else "R"), roles + (role[0] if edit == "K" else edit)
            else:
                audit, roles = audit + "I" * len(before[-1]), roles + "".join(r[0] for r in before[-1])
                if _LEGAL.match(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def brute_conversation(rows):
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    named = faults([r[1:] for r in rows])
    count = [sum(f == name for _, _, f in named) for name in ("blank", "duplicate", "truncated")]
    initials = [r[0][:1] for r in named]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, out = search(named)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *count, illegal, cost, audit, digest


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return out


def brute(rows, damage=True):
    by = defaultdict(list, {r[0]: [] for r in rows})
    for conv, *turn in brute_damage(rows) if damage else rows:
        by[conv].append(tuple(turn))
    return {conv: brute_conversation(turns) for conv, turns in by.items()}


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


_TURN = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", "a.", "b.", "c", "d? "]))


@settings(max_examples=60, deadline=None)
@given(st.lists(_TURN, max_size=3))
def test_search_is_the_least_of_all_edit_sequences(rows):
    named = faults(rows)
    assert search(named)[:2] == exhaustive(named)


def letters(rows):
    kind = {"s": 0, "u": 1, "a": 2}
    return "".join(chr(65 + 4 * kind.get(role[:1], 3) + [None, "truncated", "blank", "duplicate"].index(fault)) for role, _, fault in faults(rows))


@settings(max_examples=150, deadline=None)
@given(st.lists(_TURN, min_size=1, max_size=14), st.integers(1, 14))
def test_matrices_give_what_the_search_gives(rows, cut):
    symbols = [ord(c) - 65 for c in letters(rows)]
    halves = []
    for part in (symbols[:cut], symbols[cut:]):
        whole = C.INSERTS if not part else None
        for s in part:
            whole = C.TURNS[s] if whole is None else C.product(whole, C.TURNS[s])
        halves.append(whole)
    end = C.product(C.product(*halves), C.INSERTS)
    best = min((end.cost[x], C.flat(end.audit[x])) for x in (0, 3) if end.cost[x] < C._FAR)
    assert best == search(faults(rows))[:2]


@given(st.lists(st.text("KRDI", max_size=90), max_size=6), st.lists(st.text("KRDI", max_size=90), max_size=6))
def test_ropes_compare_as_strings(a, b):
    def rope(parts):
        whole = ""
        for part in parts:
            whole = C.joined(whole, part)
        return whole

    assert C.flat(rope(a)) == "".join(a) and C.less(rope(a), rope(b)) == ("".join(a) < "".join(b))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ABEFI", min_size=1, max_size=40), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 9), max_size=5), max_size=4))
def test_grammar_spells_what_it_compresses(sequences, rounds):
    grammar, first = C.Grammar([], [], []), C._TERMINALS
    sides = {}
    for chosen in rounds:  # pairs found in the sequences, in any order of rank
        symbols = C.compressed(sequences, grammar)
        code = (symbols[:-1] * C._BASE + symbols[1:])[(symbols[:-1] >= 0) & (symbols[1:] >= 0)]
        best = list(dict.fromkeys(int(code[i % len(code)]) for i in chosen)) if len(code) else []
        if best:
            order = np.argsort(best)
            grammar.pairs.append(np.array(best)[order])
            grammar.places.append(order)
            grammar.first.append(first)
            for i, c in enumerate(best):
                sides[first + i] = (c // C._BASE, c % C._BASE)
            first += len(best)

    def spell(symbol):
        return chr(65 + symbol) if symbol < C._TERMINALS else spell(sides[symbol][0]) + spell(sides[symbol][1])

    assert "".join("@" if s < 0 else spell(int(s)) for s in C.compressed(sequences, grammar)) == "".join(x + "@" for x in sequences)


def made():
    rng = np.random.default_rng(5)
    rows = [(None, 0, "user", "a."), (None, None, None, None), (None, 1, "assistant", "b."), (1, 0, "user", None), (2, None, "system", "x.")]
    rows += [(3, None, "user", f"q{i}.") for i in range(4)] + [(3, 2, "assistant", "z."), (3, 2, "", "y."), (3, 9, "user", " \t\n")]
    rows += [(4, 1, "user", "same.")] * 5 + [(4, t, "user", "same.") for t in range(2, 9)]
    for conv in range(10, 120):
        for turn in range(int(rng.integers(1, 12))):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.85 else ("system", "tool", "assistant", "user")[int(rng.integers(4))]
            rows.append((conv, turn + int(rng.random() < 0.05), role, f"t{rng.integers(0, 60)}" + (".", "!", "?", "")[int(rng.integers(4))]))
    rows += [(500, t, ("user", "assistant")[t % 2], f"long {t}.") for t in range(900)]  # most of all rows are one conversation
    rows += [(501, t, ("user", "assistant")[t // 2 % 2], f"long {t % 200}" + ".?"[t % 2 : t % 7]) for t in range(700)]
    return rows


@pytest.mark.parametrize("piece", [C.PIECE, 5, 1])
def test_repairs_as_searched(spark, piece):
    rows = made()
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS kind", "'x' AS print", "2 AS audit", "3 AS first", "4 AS tie", "5 AS gaps")
    assert found(C.repair_damaged(df, piece=piece)) == brute(rows)
    if piece == 5:
        whole = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
        assert found(C.repair(df, piece=piece)) == brute(whole, damage=False)


def test_repaired_turns_are_the_digested_ones(spark):
    rows = spark.createDataFrame(made(), ROWS)
    repairs = C.repair(rows)
    by = defaultdict(dict)
    for r in C.repaired_turns(rows, repairs).collect():
        by[r.conv_id][r.place] = f"{r.role}:{r.text}"
    for r in repairs.collect():
        assert hashlib.sha256("\n".join(by[r.conv_id][i] for i in range(len(by[r.conv_id]))).encode()).hexdigest() == r.repaired_sha256


def test_empty_table_and_names_as_ids(spark):
    assert C.repair_damaged(spark.createDataFrame([], ROWS)).count() == 0
    rows = [("a", 0, "user", "x."), ("a", 1, "assistant", "y."), ("b", 0, "system", "z.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert found(C.repair_damaged(df)) == brute(rows)


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_conversation_repair(spark, sf)) == brute(rows)
