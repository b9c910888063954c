"""Conversation structure repair: a least-cost edit of roles by min-plus products over runs of equal symbols."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.operators.windows import running

from .tables import checked_broadcast, small_batches, stored

#: Rows of a block; a longer conversation is cut into several, which carry matrices and states to each other.
BLOCK = 8192
#: A character that is no white space.
SOLID = "[^\\x20\\x09-\\x0D]"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States of the output so far: nothing, a system turn, a user turn, an assistant turn. Nothing and an assistant's
#: turn may end it.
NONE, SYSTEM, USER, ASSISTANT = range(4)
OPEN = 10**15
#: What a kept row of each initial (s, u, a, other) does to each state; -1: not allowed.
KEEPS = ((SYSTEM, -1, -1, -1), (USER, USER, -1, USER), (-1, -1, ASSISTANT, -1), (-1, -1, -1, -1))
#: Where an inserted or re-roled turn leads: a user turn, or an assistant's after a user's.
TURNS = (USER, USER, ASSISTANT, USER)

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def symbol(initial: int, truncated: bool) -> int:
    """Rows that edits treat alike share a symbol; 0: rows that must go."""
    return 1 + 2 * initial + truncated


def _edits(sym: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may become of a row, in ASCII order."""
    yield "D", DELETE, state
    if sym:
        initial, more = (sym - 1) // 2, TRUNCATED * ((sym - 1) % 2)
        kept = KEEPS[initial][state]
        if kept >= 0:
            yield "K", more, kept
        yield "R", REROLE + more, TURNS[state]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


@cache
def inserts() -> Matrix:
    """Least cost of inserted turns between two states."""
    step = tuple(tuple(0 if i == j else INSERT if TURNS[i] == j else OPEN for j in range(4)) for i in range(4))
    return times(times(step, step), step)


@cache
def power(sym: int, bit: int) -> Matrix:
    """Transition of 2**bit rows of a symbol, insertions before each included."""
    if bit:
        return times(power(sym, bit - 1), power(sym, bit - 1))
    row = [[OPEN] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in _edits(sym, state):
            row[state][after] = min(row[state][after], cost)
    return times(inserts(), tuple(map(tuple, row)))


@lru_cache(1 << 16)
def _advance(sym: int, n: int, v: Vector) -> Vector:
    """Costs to go before a run of n rows from those after it, through the powers of n's binary digits."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            v = applied(power(sym, bit), v)
    return v


def before(sym: int, n: int, v: Vector) -> Vector:
    """_advance, asked for differences only, so that its cache holds few of them."""
    low = min(v)
    return tuple(c + low for c in _advance(sym, n, tuple(min(c - low, OPEN) for c in v)))


def ending() -> Vector:
    """Costs to go after the last row."""
    return applied(inserts(), (0, OPEN, OPEN, 0))


Item = tuple[int, int]


def runs(items: list[Item]) -> list[Item]:
    """Neighbouring (symbol, times) of equal symbols as one."""
    out: list[Item] = []
    for sym, n in items:
        if out and out[-1][0] == sym:
            out[-1] = sym, out[-1][1] + n
        else:
            out.append((sym, n))
    return out


def unrolled(items: list[Item], after: Vector, state: int, last: bool) -> tuple[list[str], list[int], int]:
    """(letters of each item with the insertions before it, state before these, state at the end): of the cheapest edits
    those whose letters come first in ASCII order. Only symbol 0 may occur several times in an item: such
    rows go, and no insertion before them is cheaper or comes first. `after`: costs to go behind the items;
    `last`: the conversation ends there, and the last item takes the insertions that follow."""
    coded = runs(items)
    ends = [after]
    for sym, n in reversed(coded):
        ends.append(before(sym, n, ends[-1]))
    letters: list[str] = []
    states: list[int] = []
    for (sym, n), end in zip(coded, reversed(ends[:-1])):
        if sym == 0:
            while n:
                many = items[len(letters)][1]
                letters.append("D" * many)
                states.append(state)
                n -= many
            continue
        togo = [end]
        for _ in range(n):
            togo.append(before(sym, 1, togo[-1]))
        for left in range(n, 0, -1):
            states.append(state)
            text, here = "", togo[left]
            while text[-1:] in ("", "I"):
                options = [(letter, cost + togo[left - 1][to], to) for letter, cost, to in _edits(sym, state)]
                options.append(("I", INSERT + here[TURNS[state]], TURNS[state]))
                letter, _, to = min(o for o in options if o[1] == here[state])
                text, state = text + letter, to
            letters.append(text)
    while last and letters and after[state]:
        letters[-1], state = letters[-1] + "I", TURNS[state]
    return letters, states, state


def roles(letters: str, state: int, initial: int) -> list[tuple[str, str | None]]:
    """(edit, role) of the turns that a row's letters leave; role null: the row's own, whose initial is given."""
    out = []
    for letter in letters.replace("D", ""):
        turn = TURNS[state]
        out.append((letter, None if letter == "K" else "user" if turn == USER else "assistant"))
        state = KEEPS[initial][state] if letter == "K" else turn
    return out


def damaged(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows of chats with faults planted by a hash of conv_id and turn. Of 20 values 0 drops a
    row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it,
    4 makes it the user's. Nulls in role and text become one space, and count as one in the hash."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    rows = chats.withColumn("_k", kind).where("_k <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), "_k")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_c")).drop("_c")


def _initial() -> Column:
    """0, 1, 2 for roles that begin with s, u, a; 3 for any other."""
    return (F.instr(F.lit("sua"), F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))) + 3) % 4


def marked(chats: DataFrame) -> DataFrame:
    """Distinct rows (conv, conv_id, turn, role, digest, solid) with n, how often they occur, and the fault of the first
    of these: blank (no solid character), duplicate (role and text occur in an earlier row), truncated
    (the last solid character ends no sentence) or ok. The copies that follow are blank or duplicate."""
    word = lambda c: F.coalesce(F.col(c), F.lit(" "))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    text = word("text")
    end = F.regexp_extract(text, f"(?s)({SOLID})[\\x20\\x09-\\x0D]*\\z", 1)
    rows = chats.select(conv.alias("conv"), "conv_id", "turn", word("role").alias("role"), F.md5(text.cast("binary")).alias("digest"), end.alias("end"))
    rows = rows.groupBy("conv", "conv_id", "turn", "role", "digest", "end").agg(F.count("*").alias("n"))
    again = rows.groupBy("conv", "role", "digest").agg(F.count("*").alias("places"), F.min(F.struct("turn")).alias("first"))
    again = checked_broadcast(stored(again.where("places > 1").drop("places"), "again"))
    rows = rows.join(again, ["conv", "role", "digest"], "left")
    later = F.col("first").isNotNull() & (F.struct("turn") != F.col("first"))
    fault = F.when(F.col("end") == "", "blank").when(later, "duplicate").when(F.col("end").isin(".", "!", "?"), "ok").otherwise("truncated")
    return rows.select("conv", "conv_id", "turn", "role", "digest", "n", fault.alias("fault"), _initial().alias("initial"))


def _symbols(block: pa.Table) -> Iterator[tuple[str, int, list[int], list[Item]]]:
    """(conversation, block, positions of its rows in order, items of these: a row and its copies) of each block."""
    conv = block["conv"].to_pylist()
    number, place, n = (np.asarray(block[c]) for c in ("block", "n_before", "n"))
    fault, initial = np.array(block["fault"].to_pylist(), object), np.asarray(block["initial"]).astype(np.int64)
    code = np.where((fault == "blank") | (fault == "duplicate"), 0, 1 + 2 * initial + (fault == "truncated"))
    units: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(conv, number.tolist())):
        units.setdefault(key, []).append(i)
    for (c, b), at in units.items():
        rows = np.array(at)[np.argsort(place[at], kind="stable")].tolist()
        yield c, b, rows, [item for i in rows for item in ((int(code[i]), 1), (0, int(n[i]) - 1)) if item[1]]


def _matrices(block: pa.Table) -> pa.Table:
    """The whole transition of each block."""
    conv, number, cells = [], [], []
    for c, b, _, items in _symbols(block):
        whole = tuple(tuple(0 if i == j else OPEN for j in range(4)) for i in range(4))
        for sym, n in runs(items):
            for bit in range(n.bit_length()):
                if n >> bit & 1:
                    whole = times(whole, power(sym, bit))
        conv.append(c)
        number.append(b)
        cells.append([min(x, OPEN) for line in whole for x in line])
    return pa.table({"conv": pa.array(conv, pa.string()), "block": pa.array(number, pa.int64()), "cells": pa.array(cells, pa.list_(pa.int64()))})


def _ahead(blocks: pa.Table) -> pa.Table:
    """Costs to go behind each block of one conversation."""
    order = np.argsort(np.asarray(blocks["block"]))[::-1]
    cells, v, out = blocks["cells"].to_pylist(), ending(), {}
    for i in order.tolist():
        out[i] = v
        v = applied(tuple(tuple(cells[i][4 * r : 4 * r + 4]) for r in range(4)), v)
    return pa.table({"conv": blocks["conv"], "block": blocks["block"], "after": pa.array([list(out[i]) for i in range(len(blocks))], pa.list_(pa.int64()))})


def _ends(block: pa.Table) -> pa.Table:
    """The state in which each block ends, for each state in which it may begin."""
    conv, number, ends = [], [], []
    after = block["after"].to_pylist()
    for c, b, rows, items in _symbols(block):
        v = tuple(after[rows[0]])
        conv.append(c)
        number.append(b)
        ends.append([unrolled(items, v, s, False)[2] for s in range(4)])
    return pa.table({"conv": pa.array(conv, pa.string()), "block": pa.array(number, pa.int64()), "ends": pa.array(ends, pa.list_(pa.int32()))})


def _starts(blocks: pa.Table) -> pa.Table:
    """The state in which each block of one conversation begins."""
    ends, state, out = blocks["ends"].to_pylist(), NONE, {}
    for i in np.argsort(np.asarray(blocks["block"])).tolist():
        out[i] = state
        state = ends[i][state]
    return pa.table({"conv": blocks["conv"], "block": blocks["block"], "start": pa.array([out[i] for i in range(len(blocks))], pa.int32())})


EDITS = "conv string, block long, place long, letters string, turns array<struct<edit:string,role:string>>, cost long"


def _letters(block: pa.Table) -> pa.Table:
    """Letters and remaining turns of every distinct row; the costs of its block stand at the block's first row."""
    out: dict[str, list] = {n: [] for n in ("conv", "block", "place", "letters", "turns", "cost")}
    after, start, place, n = block["after"].to_pylist(), block["start"].to_pylist(), np.asarray(block["n_before"]), np.asarray(block["n"])
    last, fault, initial = place + n == np.asarray(block["n_all"]), block["fault"].to_pylist(), np.asarray(block["initial"])
    for c, b, rows, items in _symbols(block):
        v = tuple(after[rows[0]]) if after[rows[0]] else ending()
        letters, states, _ = unrolled(items, v, start[rows[0]] or NONE, bool(last[rows[-1]]))
        at = cost = 0
        for i in rows:
            end = at + 1 + (n[i] > 1)
            turns = [t for j in range(at, end) for t in roles(letters[j], states[j], int(initial[i]))]
            for name, value in zip(out, (c, b, place[i], "".join(letters[at:end]), [{"edit": e, "role": r} for e, r in turns], 0)):
                out[name].append(value)
            text, at = out["letters"][-1], end
            cost += DELETE * text.count("D") + INSERT * text.count("I") + REROLE * text.count("R")
            cost += TRUNCATED * (fault[i] == "truncated" and letters[end - 1 - (n[i] > 1)].rstrip("I")[-1:] != "D")
        out["cost"][-len(rows)] = cost
    turns = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string())]))
    kinds = {"conv": pa.string(), "block": pa.int64(), "place": pa.int64(), "letters": pa.string(), "turns": turns, "cost": pa.int64()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def placed(chats: DataFrame) -> DataFrame:
    """marked(chats) with n_before and n_all, the rows of the conversation before it and in all, and block. Order:
    turn (null first), role, digest of the text. Sorted ranges carry the counts, so a conversation takes as many
    tasks as it needs."""
    rows = running(marked(chats), ["conv"], ["turn", "role", "digest"], ["n"])
    return stored(rows.withColumn("block", F.floor(F.col("n_before") / BLOCK).cast("long")), "placed")


def repairs(rows: DataFrame) -> DataFrame:
    """(conv, block, place, letters, turns, cost) of every row of placed(): the edits, in order.

    Blocks are dealt to groups of about BLOCK rows. Conversations of one block are solved there. Longer ones go three
    times: each block gives its min-plus matrix, from which the costs to go behind every block follow; with
    these, the state in which it ends for any in which it begins; then its edits.
    """
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("conv", "block"), F.lit(math.ceil((total + 1) / BLOCK))))
    long = rows.where(F.col("n_all") > BLOCK)
    matrices = long.groupBy("bucket").applyInArrow(_matrices, "conv string, block long, cells array<long>")
    ahead = stored(matrices.groupBy("conv").applyInArrow(_ahead, "conv string, block long, after array<long>"), "ahead")
    ends = long.join(ahead, ["conv", "block"]).groupBy("bucket").applyInArrow(_ends, "conv string, block long, ends array<int>")
    starts = ends.groupBy("conv").applyInArrow(_starts, "conv string, block long, start int")
    carried = stored(ahead.join(starts, ["conv", "block"]), "carried")
    return rows.join(checked_broadcast(carried), ["conv", "block"], "left").groupBy("bucket").applyInArrow(_letters, EDITS)


def _illegal(rows: DataFrame) -> DataFrame:
    """(conv, illegal): neighbouring rows whose initials are not system, user; user, assistant; or assistant, user."""
    here = rows.select("conv", "block", "initial", "n", F.col("n_before").alias("at"), (F.col("n_before") + F.col("n")).alias("next"))
    after = rows.select("conv", F.col("n_before").alias("next"), F.col("initial").alias("then"))
    fits = F.concat(F.col("initial").cast("string"), F.col("then").cast("string")).isin("01", "12", "21")
    pairs = here.join(after, ["conv", "next"], "left")
    return pairs.groupBy("conv").agg(F.sum(F.col("n") - 1 + F.when(F.col("then").isNull() | fits, 0).otherwise(1)).alias("illegal"))


def repair(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, turns) of conversations (conv_id, turn, role, text).

    summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation. turns: conv_id,
    place, part, edit, role, text of what the cheapest edits leave, in order.

    A conversation's rows are ordered by turn (null first), then role, then the text's MD5; null roles and texts count as
    one space, null conv_ids are one conversation. A row's first fault counts: blank, duplicate, truncated. Kept rows
    cost nothing, a new role 3, deletion 4 (blank and duplicate rows must go), an inserted empty turn 3, a truncated row
    that stays 3 more; what is left reads: perhaps a system turn, then user and assistant in turn, or nothing. Of
    equally cheap edits those whose letters (Delete, Insert, Keep, Rerole) come first in ASCII order are made. An
    empty table gives empty results; other columns are ignored.
    """
    small_batches(chats.sparkSession, rows=8192)
    rows = placed(chats)
    edits = stored(repairs(rows), "edits")
    counts = rows.groupBy("conv", "conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).cast("long").alias("span"),
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum((F.col("fault") == "truncated").cast("long")).alias("truncated"),
    )
    distinct = rows.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("distinct"))
    blocks = edits.groupBy("conv", "block").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "letters"))), lambda s: s["letters"]), "").alias("letters"))
    audits = blocks.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "letters"))), lambda s: s["letters"]), "").alias("audit"))
    summary = counts.join(distinct, "conv", "left").join(_illegal(rows), "conv").join(audits, "conv")
    gaps = (F.col("span") - F.coalesce("distinct", F.lit(0))).alias("gaps")
    summary = summary.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    left = edits.where(F.size("turns") > 0).select("conv", "place", F.posexplode("turns").alias("part", "t"))
    where = rows.select("conv", "conv_id", F.col("n_before").alias("place"), "turn", F.col("role").alias("own"), "digest")
    left = left.select("conv", "place", "part", "t.edit", "t.role").join(where, ["conv", "place"])
    new = left.where("edit = 'I'").select("conv_id", "place", "part", "edit", "role", F.lit("").alias("text"))
    old = left.where("edit <> 'I'").select("conv_id", "place", "part", "edit", F.coalesce("role", "own").alias("role"), "turn", "own", "digest")
    word = lambda c: F.coalesce(F.col(c), F.lit(" "))
    texts = chats.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), word("role").alias("_own"), word("text").alias("text"))
    texts = texts.withColumn("_digest", F.md5(F.col("text").cast("binary"))).groupBy("_conv", "_turn", "_own", "_digest").agg(F.first("text").alias("text"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("own") == F.col("_own")) & (F.col("digest") == F.col("_digest"))
    old = old.join(texts, same).select("conv_id", "place", "part", "edit", "role", "text")
    return summary, old.unionByName(new)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's turns from sorted rows; only its state is held between batches."""
    import hashlib

    now, sha = None, None
    for batch in batches:
        done: list[tuple] = []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if sha is None or conv != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield _digests(done)
    if sha is not None:
        yield _digests([(now, sha.hexdigest())])


def _digests(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["conv_id", "sha"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha): SHA-256 of a conversation's turns, role:text joined by line breaks. The hash runs through them in
    order, so one task reads a conversation, a batch at a time."""
    small_batches(turns.sparkSession)
    lines = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part").select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text")
    return lines.mapInArrow(_hashed, "conv_id long, sha string")
