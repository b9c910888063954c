"""Conversation repair, hard negatives and nearest neighbours against brute force, edge cases included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import ann, embedding_dedup, hard_negatives, queries, structure, toxicity, vectors

CHAT = "conv_id long, turn long, role string, text string, n long, block string, place int, fault string"
VEC = "vec_id long, embedding array<double>, label int, ids string, score int, block int"


# ---------------------------------------------------------------- conversation repair


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """Brute force of one conversation: every state keeps its cheapest edits, least letters first."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "ok" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    best = {"": (0, "", ())}  # state: cost, letters, output

    def inserted(best):
        for _ in range(3):
            more = dict(best)
            for state, (cost, letters, out) in best.items():
                role = "assistant" if state == "u" else "user"
                new = (cost + 3, letters + "I", (*out, f"{role}:"))
                if role[0] not in more or new < more[role[0]]:
                    more[role[0]] = new
            best = more
        return best

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, letters, out) in inserted(best).items():
            options = [(state, (cost + 4, letters + "D", out))]
            if fault in ("ok", "truncated"):
                more = 3 * (fault == "truncated")
                turn = "assistant" if state == "u" else "user"
                options.append((turn[0], (cost + 3 + more, letters + "R", (*out, f"{turn}:{text}"))))
                if (state, role[:1]) in [("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")]:
                    options.append((role[0], (cost + more, letters + "K", (*out, f"{role}:{text}"))))
            for to, new in options:
                if to not in after or new < after[to]:
                    after[to] = new
        best = after
    cost, letters, out = min(v for s, v in inserted(best).items() if s in ("", "a"))
    n = Counter(faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(rows):
    per = defaultdict(list)
    for r in damaged(rows):
        per[r[0]].append(r)
    empty = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    return {c: repaired(per[c]) if c in per else empty for c in {r[0] for r in rows}}


def chats():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "tail .  \n", "née 日本 🤖.", "a", "x" * 50000 + "."]
    names = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "agent", "Übersetzer"]
    rows = []
    for c in range(80):
        for t in range(rng.randrange(1, 12)):
            own = names[t % 2] if rng.random() < 0.7 else rng.choice(names)
            text = rng.choice(texts) if rng.random() < 0.4 else f"line {rng.randrange(50)} {t}."
            rows.append((c, rng.choice([t, t, t, t + 3, None]), own, text))
    rows += [(None, t, "user", "null id.") for t in range(3)] + [(900, None, "user", "no turns")] * 4
    rows += [(901, t, ("user", "assistant")[t % 2], f"long {t}.") for t in range(300)] + [(902, 7, "user", "hot")] * 200
    rows += [(903, t, "user", "Same again.") for t in range(60)] + [(904, 1, None, None)]
    return rows


def run(spark, rows):
    table = spark.createDataFrame([(*r, 1, "b", 2, "f") for r in rows], CHAT)
    name = "chats_under_test"
    table.createOrReplaceTempView(name)
    real, queries._table = queries._table, lambda s, d, n: s.table(name)
    try:
        got = queries.op11_structure(spark, "").collect()
    finally:
        queries._table = real
    found = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize("block", [structure.BLOCK, 16])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    """With small blocks, long conversations carry matrices and states from block to block."""
    monkeypatch.setattr(structure, "BLOCK", block)
    rows = chats()
    assert run(spark, rows) == expected(rows)


def test_repair_of_nothing(spark):
    assert run(spark, []) == {}
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and run(spark, gone) == expected(gone)


def test_powers_equal_single_steps():
    rng = random.Random(1)
    for sym in range(9):
        v = structure.ending()
        for n in range(1, 40):
            v = structure.before(sym, 1, v)
            assert v == structure.before(sym, n, structure.ending())
    items = [(rng.randrange(9), 1) for _ in range(500)]
    v = structure.ending()
    for sym, n in reversed(structure.runs(items)):
        v = structure.before(sym, n, v)
    whole = structure.power(items[0][0], 0)
    for sym, _ in items[1:]:
        whole = structure.times(whole, structure.power(sym, 0))
    assert structure.applied(whole, structure.ending()) == v


# ---------------------------------------------------------------- vectors


def odd_rows(dim):
    nan, inf = math.nan, math.inf
    return [
        (5000, None, 1), (5001, [], 1), (5002, [0.0] * dim, 1), (5003, [nan] * dim, 1), (5004, [inf] + [0.1] * (dim - 1), 2), (5005, [None] + [0.1] * (dim - 1), 2),
        (None, [0.3] * dim, 1), (5100, [0.2] * dim, None), (5200, [0.5] * (dim - 3), 3), (5201, [0.4] * (dim - 3), 3), (5300, [0.5] * (dim - 3), 4), (5301, [-0.4] * (dim - 3), 4),
    ]


def vector_rows(n=1500, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    out = [(i, (rng.standard_normal(dim) * rng.choice([0.3, 1.0, 2.0])).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    hot = [0.9] * dim
    out += [(10_000 + i, hot, 1) for i in range(400)] + [(20_000 + i, hot, 2) for i in range(300)] + [out[0], out[0], out[100]]
    out += [(40, (rng.standard_normal(dim)).tolist(), 2)]  # an id with two vectors
    return out + odd_rows(dim)


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VEC)


def usable(v, zeros):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zeros or any(v))


def negatives_by_brute_force(rows):
    rows = {(i, lab, tuple(np.floor(256 * np.array(v)).astype(int).tolist())) for i, v, lab in rows if usable(v, True) and i is not None and lab is not None}
    got = []
    for a, lab, q in rows:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, other) for i, other, p in rows if i != a and len(p) == len(q))
        for s, i, _ in [t for t in scored if t[2] == lab][:5]:
            fits = [t for t in scored if t[2] != lab and 80 * -s <= 100 * -t[0] <= 100 * -s]
            got += [(a, i, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fits[:5])]
    return sorted(got)


def test_hard_negatives_equal_brute_force(spark):
    rows = vector_rows()
    got = hard_negatives.hard_negatives(vector_table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == negatives_by_brute_force(rows)
    assert hard_negatives.hard_negatives(vector_table(spark, [])).count() == 0


def test_hard_negatives_of_large_numbers(spark):
    """Scores beyond the exact range of doubles stay exact."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(6) * 1e5).tolist(), int(i % 3)) for i in range(300)] + [(999, [1e9] * 6, 1), (1000, [-1e300] * 6, 1)]
    got = hard_negatives.hard_negatives(vector_table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == negatives_by_brute_force(rows[:300])


def test_windows_hold_every_row_that_scores_inside():
    rng = np.random.default_rng(8)
    for scale in (1, 300):
        x = np.floor(rng.standard_normal((400, 8)) * scale * rng.choice([0.1, 1, 9], (400, 1)))
        refs = np.resize(hard_negatives.references(x), (hard_negatives.REFERENCES, 8))
        block = object.__new__(hard_negatives._Block)
        block.at, block.x, block.lines = np.arange(400), x, {}
        block.norm, block.blind, block.theta = np.sqrt((x * x).sum(1)), np.zeros(400, bool), hard_negatives.angles(x, refs)
        for a, theta in zip(x[:60], block.theta[:60]):
            s = x @ a
            for low, high in [(0, 0), (1, 5), (s.max() * 0.8, s.max()), (-math.inf, math.inf), (s.mean(), math.inf), (-9, 9)]:
                some, score = block.between(a, theta, low, high)
                assert set(np.flatnonzero((s >= low) & (s <= high))) <= set(some.tolist()) and (score == s[some]).all()


def test_nearest_against_brute_force(spark):
    rows = vector_rows(3000, 24)
    got = defaultdict(list)
    for r in ann.nearest(vector_table(spark, rows)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {(i, tuple(v)) for i, v, _ in rows if usable(v, False) and i is not None}
    twice = {i for i, n in Counter(i for i, _ in good).items() if n > 1}
    hit = total = 0
    for i, v in good:
        if i % 20 or i in twice:
            continue
        scored = sorted((-float(np.dot(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:20]
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == list(range(1, len(scored) + 1))
        assert [(-s, j) for _, j, s in mine] == sorted((-s, j) for _, j, s in mine)
        exact = {j: w for j, w in good if len(w) == len(v)}
        assert all(j in twice or math.isclose(s, np.dot(v, exact[j]), rel_tol=1e-9, abs_tol=1e-12) for _, j, s in mine)
        worst = -scored[-1][0]
        hit += sum(s >= worst - 1e-9 for _, _, s in mine)
        total += len(scored)
        if v == tuple([0.9] * 24):  # copies: the smallest ids win
            assert [j for _, j, _ in mine if j >= 10_000] == sorted(j for _, j, _ in mine if j >= 10_000)
    assert set(got) == {i for i, _ in good if i % 20 == 0} and hit / total >= 0.95
    assert ann.nearest(vector_table(spark, [])).count() == 0


def test_few_vectors_are_all_returned(spark):
    rows = [(i, [1.0 + i, -float(i)], 0) for i in range(0, 60, 10)]
    got = ann.nearest(vector_table(spark, rows)).groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert {(r["query_id"], r["n"]) for r in got} == {(0, 5), (20, 5), (40, 5)}


def test_radius_retrieves_every_code_inside():
    """Pigeonhole: probing the substring tables finds all codes within the radius."""
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (500, 16)).astype(np.uint16)
    query = codes[0] ^ np.uint16(3)
    apart = np.bitwise_count(codes ^ query).sum(1)
    for radius in (0, 5, 40, 100, 130, 256):
        limit = radius // 16 - (np.arange(16) > radius % 16)
        hit = np.zeros(500, bool)
        for t, (values, number) in enumerate(ann._probe(codes)):
            hit |= (np.bitwise_count(query[t] ^ values) <= limit[t])[number]
        assert hit[apart <= radius].all()


def test_few_rows_of_uniform_vectors_are_compared(monkeypatch):
    """The score to reach follows from the rank a block's row has among all blocks: of uniform vectors most rows of
    a block stay outside the radius, and what is retrieved equals the codes inside it."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.Index(1.0, {64: ann.learn(x[:3000], 64, 1.0, rounds=3)})
    code = index.codes[64].of(ann.lifted(x, 1.0))
    block = np.arange(8000) % 16 == 0
    q = pa.table({"id": np.arange(40) * 16, "key": np.zeros(40, np.int64), "u": [v.tobytes() for v in x[:640:16]], "code": [c.tobytes() for c in index.codes[64].of(ann.unit(x[:640:16]))]})
    rows = lambda some: pa.table({"ids": [[i] for i in np.flatnonzero(some)], "u": [v.tobytes() for v in x[some]], "code": [c.tobytes() for c in code[some]]})
    q = q.append_column("reach", ann._first_scores(index, getattr(ann, "likely_rank", lambda k, _: k)(20, 16))(q, rows(block))["reach"])
    score = x[:640:16] @ x.T
    score[np.arange(40), np.arange(40) * 16] = -9
    reach = np.asarray(q["reach"])
    assert ((score >= reach[:, None]).sum(axis=1) >= 20).mean() >= 0.9
    radius = index.codes[64].radius(reach)
    apart = np.bitwise_count(np.asarray(index.codes[64].of(ann.unit(x[:640:16])))[:, None] ^ code[None]).sum(axis=2)
    assert (apart <= radius[:, None]).mean() < 0.35
    whole = ann._search(index, 20)(q, rows(np.ones(8000, bool))).to_pandas()
    monkeypatch.setattr(ann, "_buckets", lambda limit: np.zeros(limit.shape, np.int64), raising=False)
    assert whole.equals(ann._search(index, 20)(q, rows(np.ones(8000, bool))).to_pandas())  # by probing
    for i, of in whole.groupby("id"):
        inside = np.flatnonzero((apart[i // 16] <= radius[i // 16]) & (score[i // 16] >= reach[i // 16]))
        assert set(of["found"]) == set(inside[np.argsort(-score[i // 16, inside], kind="stable")][:20])


def test_collapsed_keeps_the_smallest_ids(spark):
    rows = spark.createDataFrame([(i % 50, bytes([i % 3])) for i in range(500)], "vec_id long, u binary")
    got = {bytes(r["u"]): r["ids"] for r in vectors.collapsed(rows, ["u"], 4).collect()}
    assert got == {bytes([k]): sorted({i % 50 for i in range(500) if i % 3 == k})[:4] for k in range(3)}


def test_embedding_links_of_repeated_ids(spark):
    """An id with several vectors or labels: every row has its own links and component."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((12, 20))
    rows = []
    for k in range(150):
        v = base[k % 12] + 0.1 * rng.standard_normal(20) * (1 + k % 3)
        rows.append((int(rng.integers(0, 60)), v.tolist(), int(rng.integers(0, 3))))
    rows += rows[:10] + [(5, base[0].tolist(), 0), (5, (-base[0]).tolist(), 0), (5, base[0].tolist(), 1), (7, (base[0] * 1e200).tolist(), 0), (8, (base[0] * 1e-200).tolist(), 0)]
    got = embedding_dedup.embedding_dedup(vector_table(spark, rows)).collect()
    units = np.array([np.array(v) / np.abs(v).max() for _, v, _ in rows])
    units /= np.linalg.norm(units, axis=1)[:, None]
    label = np.array([lab for _, _, lab in rows])
    link = (units @ units.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        root = np.minimum(root, np.where(link, root, len(rows)).min(axis=1))
    ids = np.array([i for i, _, _ in rows])
    least = {r: ids[root == r].min() for r in set(root.tolist())}
    want = sorted((int(ids[k]), int(link[k].sum()), int(least[root[k]]), bool(ids[k] == least[root[k]])) for k in range(len(rows)))
    assert sorted(map(tuple, got)) == want


def test_penalty_and_constant_come_from_inner_folds():
    """The penalty with the best recall at the allowed share of false finds, and no clean row more than that needs."""
    cfg = toxicity.Ftrl(trials=(1.0, 2.0), false=0.1)
    clean = [float(k) for k in range(-20, 0)]
    rows = [(0, 0, c) for c in clean] + [(0, 1, x) for x in (-9.5, -1.5, 3.0)] + [(1, 0, c) for c in clean] + [(1, 1, x) for x in (-2.5, 2.0, 3.0)]
    table = pa.table({n: pa.array([r[i] for r in rows]) for i, n in enumerate(("penalty", "toxic", "logit"))})
    best, shift = toxicity._chosen(table, cfg)
    assert best.l1 == 2.0 and shift == 2.75  # between the clean row at -3 and the toxic one at -2.5
    assert toxicity._chosen(table.slice(0, 0), cfg) == (cfg, 0.0)
