"""Hard negatives, repaired conversations and repeated passages against brute force, and on rows that are odd."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from sourcefacts.llm import conversations as C, hard_negatives as H, queries as Q, substrings as S

VECTORS = "vec_id long, embedding array<double>, label int, anchor string, _rank int"
TURNS = "conv_id long, turn long, role string, text string, at long, piece string"
TEXTS = "doc_id long, text string, row string, kept string"


@pytest.mark.parametrize("name", ["op11_blocked_negatives", "op12_cost_to_go_repair", "op13_rolling_windows"])
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for file in os.listdir(sf_dir):
        c.execute(f"create view {file.split('.')[0]} as select * from '{sf_dir}/{file}'")
    got, want = Q.queries()[name](spark, sf_dir), c.sql(Q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    assert rows == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


# ---- hard negatives


def negatives_by_hand(rows):
    kept = []
    for vec_id, x, label in rows:
        if label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            kept.append((vec_id, [int(np.floor(256 * c)) for c in x], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, (anchor, x, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(v, sum(a * b for a, b in zip(x, y, strict=False)), lab) for j, (v, y, lab) in enumerate(kept) if j != i]
        for positive, p, _ in sorted((r for r in scored if r[2] == label), key=order)[:5]:
            inside = sorted((r for r in scored if r[2] != label and 80 * p <= 100 * r[1] <= 100 * p), key=order)[:5]
            out += [(anchor, positive, k + 1, v, p, s) for k, (v, s, _) in enumerate(inside)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)


def negatives(spark, rows, **more):
    return sorted(map(tuple, H.hard_negatives(vectors(spark, rows), **more).collect()), key=repr)


def test_negatives(spark):
    rng = random.Random(11)
    rows = [(i, [rng.uniform(0, 1) for _ in range(4)], rng.randrange(3)) for i in range(0, 900, 3)]
    rows += [(100, [0.5, 0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5, 0.5], 1), (100, [0.9, 0.1, 0.5, 0.5], 2), (None, [1.0, 1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0, 1.0], 2)]
    rows += [(200, None, 1), (200, [None, 1.0, 1.0, 1.0], 1), (200, [float("nan")] * 4, 1), (200, [float("inf")] * 4, 1), (200, [1.0] * 4, None)]
    rows += [(300, [], 1), (400, [0.3, 0.3], 0), (401, [0.3] * 6, 1), (-100, [-0.5, 0.2, 0.1, 0.0], 0), (-7, [0.4] * 4, 2)]
    rng.shuffle(rows)
    want = negatives_by_hand(rows)
    assert len(want) > 100 and negatives(spark, rows) == want
    # many blocks of a few anchors
    assert negatives(spark, rows, block_bytes=200) == want


def test_negatives_of_equal_vectors(spark):
    # a third of all rows alike, anchors among them
    rows = [(i * 50, [0.5, 0.5], i % 2) for i in range(60)] + [(100, [0.5, 0.5], 0)] * 30
    assert negatives(spark, rows) == negatives_by_hand(rows)


def test_negatives_without_rows(spark):
    assert negatives(spark, []) == []
    assert negatives(spark, [(1, [1.0], 1)]) == []
    assert negatives(spark, [(100, [1.0], 1)]) == []
    assert negatives(spark, [(100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2)]) == [(100, 101, 1, 102, 65536, 58880)]


def test_products_are_exact():
    rng = np.random.default_rng(3)
    small = rng.integers(-1000, 1000, (20, 9))
    assert (H.inner_products(small, small) == small @ small.T).all()
    large = rng.integers(-(1 << 29), 1 << 29, (20, 9)) | 1
    assert H.inner_products(large, large).tolist() == [[sum(int(p) * int(q) for p, q in zip(a, b, strict=True)) for b in large] for a in large]
    huge = np.array([[1 << 62, 1 << 62]])
    assert H.inner_products(huge, huge).tolist() == [[(1 << 63) - 1]] and H.inner_products(huge, -huge).tolist() == [[-(1 << 63)]]


def test_huge_vectors(spark):
    rows = [(100, [1e300, 1.0], 1), (101, [1e300, 1e300], 1), (102, [-1e300, 0.5], 2), (103, [3e9, 0.5], 2)]
    got = negatives(spark, rows)
    assert all(r[0] == 100 and r[1] == 101 and r[3] in (102, 103) for r in got)


# ---- conversations

MOVES = {"": "su", "s": "u", "u": "a", "a": "u"}
FILL = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def damaged_by_hand(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        after = out.setdefault(conv, [])
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            after += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for after in out.values():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults_by_hand(after):
    seen, out = set(), []
    for _, role, text in after:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repairs_by_hand(after, faults):
    """Forward over (cost, edits, lines) of each last initial, cheapest and then least letters."""
    best = {"": (0, "", ())}

    def put(into, key, cost, edits, lines):
        if key not in into or (cost, edits) < into[key][:2]:
            into[key] = (cost, edits, lines)

    def put_in():
        for _ in range(3):
            for key, (cost, edits, lines) in list(best.items()):
                put(best, FILL[key], cost + 3, edits + "I", (*lines, f"{NAME[FILL[key]]}:"))

    for (_, role, text), fault in zip(after, faults, strict=True):
        put_in()
        new = {}
        for key, (cost, edits, lines) in best.items():
            put(new, key, cost + 4, edits + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            if role[:1] and role[:1] in MOVES[key]:
                put(new, role[:1], cost + more, edits + "K", (*lines, f"{role}:{text}"))
            put(new, FILL[key], cost + 3 + more, edits + "R", (*lines, f"{NAME[FILL[key]]}:{text}"))
        best = new
    put_in()
    return min((best[k] for k in ("", "a") if k in best), key=lambda x: x[:2])


def report_by_hand(rows):
    out = {}
    for conv, after in damaged_by_hand(rows).items():
        turns, faults = [t for t, _, _ in after if t is not None], faults_by_hand(after)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        cost, audit, lines = repairs_by_hand(after, faults)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def repaired(spark, rows):
    got = C.repair_report(turns(spark, rows)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def odd_turns(seed, n):
    rng = random.Random(seed)
    roles, texts = [None, "", "user", "assistant", "system", "tool", "User", "u"], [None, "", "a", "a.", "ok!", " ?\x0b", "日本", "b\n", "a.\n\n", "...", "x "]
    return [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2, 2, 3, 5, 8]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("bits", [1, 14])
def test_repairs(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "PIECE_BITS", bits)
    rows = odd_turns(12, 500)
    assert repaired(spark, rows) == report_by_hand(rows)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE_BITS", 5)
    rng = random.Random(13)
    rows = [(7, i // 2 if i % 3 else 5, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "ok!", "b", f"t{i}.", f"t{i}."])) for i in range(2000)]
    rows += [(7, 3, "user", "the same.")] * 700 + [(8, 1, "user", "x " * 200_000)]
    assert repaired(spark, rows) == report_by_hand(rows)


def test_conversations_without_rows(spark):
    assert repaired(spark, []) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    assert repaired(spark, [(dropped, 1, "user", "a.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_least_letters_among_the_cheapest():
    """Over every series of edits of short conversations."""

    def every(i, state, rows):
        if i == len(rows):
            if state in ("", "a"):
                yield 0, ""
        else:
            letter, fault = rows[i]
            yield from ((4 + c, "D" + e) for c, e in every(i + 1, state, rows))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if letter in MOVES[state]:
                    yield from ((more + c, "K" + e) for c, e in every(i + 1, letter, rows))
                yield from ((3 + more + c, "R" + e) for c, e in every(i + 1, FILL[state], rows))
        if sum(x == "+" for x in depth) < 3:
            depth.append("+")
            yield from ((3 + c, "I" + e) for c, e in list(every(i, FILL[state], rows)))
            depth.pop()

    rng = random.Random(14)
    for _ in range(150):
        rows = [(rng.choice("suat"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(5))]
        depth = []
        want = min(every(0, "", rows))
        letters = [{"s": C.SYSTEM, "u": C.USER, "a": C.ASSISTANT}.get(x, C.OTHER) for x, _ in rows]
        faults = [{"": C.SOUND, "blank": C.BLANK, "duplicate": C.DUPLICATE, "truncated": C.CUT}[f] for _, f in rows]
        costs = C.costs_to_go(letters, faults, C.AT_END)
        assert (costs[0][C.START], C.walk(letters, faults, costs, C.START, True)[0]) == want


# ---- repeated passages


def repeats_by_hand(rows, window=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                least[g] = min(least.get(g, d), d)
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def texts(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], TEXTS)


def odd_texts(seed):
    rng = random.Random(seed)
    passages = [" ".join(rng.choices("abcdef日é", k=rng.randrange(5, 60))) for _ in range(12)]
    rows = [(i, " ".join(rng.choices([*passages, "x", "y", "\n", "\t\x0b", "zz"], k=rng.randrange(0, 7)))) for i in range(120)]
    return [*rows, (None, passages[0] * 2), (None, None), (5, None), (6, ""), (7, " \n\t"), (8, rows[9][1]), (8, rows[9][1]), (8, rows[11][1]), (-3, passages[1]), (2**62, rows[4][1]), (-(2**62), "q " * 12), (9, "q " * 14)]


@pytest.mark.parametrize(("chunk", "span"), [(1 << 21, 1 << 21), (50, 8)])
def test_repeats(spark, monkeypatch, chunk, span):
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "RANGE", span)
    rows = odd_texts(15)
    got = sorted(map(tuple, S.repeat_report(texts(spark, rows)).collect()), key=repr)
    assert got == repeats_by_hand(rows)


def test_repeats_of_many_copies(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(i, same) for i in range(400)] + [(1000 + i, f"own{i} {same} end{i}") for i in range(200)] + [(5000, " ".join(f"v{i % 900}" for i in range(60_000)))]
    got = sorted(map(tuple, S.repeat_report(texts(spark, rows)).collect()), key=repr)
    assert got == repeats_by_hand(rows)


def test_intervals_and_texts_left(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    frame = texts(spark, [(1, f"{a}\n{b}"), (2, f"x {a} y\t{b} z"), (3, None), (4, "plain  text\n"), (5, f"{a} {b} {a}")])
    found = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in S.remove_repeats(frame).collect()}
    assert found == {1: [], 2: [(1, 21), (22, 42)], 3: [], 4: [], 5: [(0, 60)]}
    left = S.drop_repeats(frame)
    assert left.columns == frame.columns
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: f"{a} {b}", 2: "x y z", 3: None, 4: "plain text", 5: ""}
    assert S.drop_repeats(frame.limit(0)).count() == 0


def test_hashes_of_words_in_pieces(monkeypatch):
    data = np.frombuffer(("word  other\nthird " * 50 + "x" * 300 + " end").encode(), dtype=np.uint8)
    whole = S.word_hashes(data)
    monkeypatch.setattr(S, "TEXT_BYTES", 7)
    assert (S.word_hashes(data) == whole).all() and len(whole) == 152
    assert len(set(S.word_hashes(np.frombuffer(b"ab ba a b aa abc", dtype=np.uint8)).tolist())) == 6


def test_packed_numbers():
    x = np.sort(np.random.default_rng(4).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (np.cumsum(S._unpack(S._pack(S._steps(x))), dtype=np.uint64) == x).all()
