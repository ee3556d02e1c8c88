"""Conversation repair against a search over all edits, and against the rules in plain Python."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from tidewire.llm import conversation_repair as R

STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str, list]:
    """Dijkstra over (row, last initial) with the audit as tie-breaker; rows are (initial, must go, cut off)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(made)
        nxt = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, nxt, (*made, ("I", nxt, None))))
        if i < len(rows):
            who, drop, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, made))
            if not drop:
                own = 5 * cut
                if who in STATES[last]:
                    heapq.heappush(heap, (cost + own, audit + "K", i + 1, who, (*made, ("K", who, i))))
                heapq.heappush(heap, (cost + 1 + own, audit + "R", i + 1, nxt, (*made, ("R", nxt, i))))
    raise AssertionError


def shorter_first(rows):
    """As ``cheapest``, with audits of the same cost compared in full: all optimal paths are listed (short inputs only)."""
    best: tuple | None = None

    def walk(i, last, cost, audit, made, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and last in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, made)
        nxt = "a" if last == "u" else "u"
        if inserts < 3:
            walk(i, nxt, cost + 5, audit + "I", [*made, ("I", nxt, None)], inserts + 1)
        if i < len(rows):
            who, drop, cut = rows[i]
            walk(i + 1, last, cost + 2, audit + "D", made, 0)
            if not drop:
                if who in STATES[last]:
                    walk(i + 1, who, cost + 5 * cut, audit + "K", [*made, ("K", who, i)], 0)
                walk(i + 1, nxt, cost + 1 + 5 * cut, audit + "R", [*made, ("R", nxt, i)], 0)

    walk(0, "", 0, "", [], 0)
    return best


def rendered(cost, before, added, edit, last):
    return int(cost), "".join("I" * a + chr(e) for a, e in zip(added.tolist(), edit.tolist(), strict=True)) + "I" * int(last)


def features(rows):
    return np.array(["sua?".index(w) for w, _, _ in rows], np.int64), np.array([d for _, d, _ in rows], bool), np.array([c for _, _, c in rows], bool)


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(5)
    convs = [[(rng.choice("suaua?"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 6))] for _ in range(400)]
    flat = [features(c) for c in convs]
    counts = np.array([len(c) for c in convs])
    who, drop, cut = (np.concatenate([f[k] for f in flat]) for k in range(3))
    cost, before, added, edit, last = R.solve(who, drop, cut, counts)
    start = np.cumsum(counts) - counts
    for i, c in enumerate(convs):
        part = slice(start[i], start[i] + counts[i])
        assert rendered(cost[i], before[part], added[part], edit[part], last[i]) == shorter_first(c)[:2], c


@pytest.mark.parametrize("span", [1, 2, 5, 8])
def test_spans_change_nothing(span):
    rng = random.Random(span)
    for n in (0, 1, 7, 23, 60):
        rows = [(rng.choice("suuaa?"), rng.random() < 0.1, rng.random() < 0.3) for _ in range(n)]
        counts = np.array([n])
        whole, parts = R.solve(*features(rows), counts, 64), R.solve(*features(rows), counts, span)
        assert rendered(whole[0][0], *whole[1:4], whole[4][0]) == rendered(parts[0][0], *parts[1:4], parts[4][0])
        assert whole[0][0] == cheapest(rows)[0]


def plain(rows):
    """The contract, row by row."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    told = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, faults, shapes = set(), [0, 0, 0], []
        for _, role, text in turns:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not letters else 1 if (role, text) in seen else 2 if letters[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            shapes.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, made = shorter_first(shapes) if len(shapes) < 9 else cheapest(shapes)
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[w]}:" if e == "I" else f"{full[w] if e == 'R' else turns[i][1]}:{turns[i][2]}" for e, w, i in made]
        told[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return told


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in R.query(spark, sf_dir).collect()}
    assert got == plain(rows)


def hard():
    rng = random.Random(13)
    words = ["Yes.", "no", " ", "", None, "Why?\n", "é ", "long " * 40_000, "a\x0b\x0c\r", "ok!"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(words)) for c in [None, *range(60)] for t in range(rng.randint(1, 5))]
    return rows + rows[:20] + [(77, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(6)]


def test_hard_rows(spark, tmp_path):
    rows = hard()
    df = spark.createDataFrame([(*r, True, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, gone boolean, who int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r[0]: tuple(r)[1:] for r in R.query(spark, str(tmp_path)).collect()} == plain(rows)


def test_repaired_turns_alternate(spark):
    df = spark.createDataFrame(hard(), "conv_id bigint, turn bigint, role string, text string")
    convs: dict = {}
    for r in R.repaired(R.damage(df)).orderBy("conv_id", "position").collect():
        convs.setdefault(r.conv_id, []).append(r)
    assert convs and all(re.fullmatch("s?(ua)+", "".join(x.role[0] for x in c)) and [x.position for x in c] == list(range(len(c))) for c in convs.values())


def test_one_conversation_of_many_turns(spark):
    rows = [(1, t, ("user", "assistant")[t % 2] if t % 11 else "user", f"Turn {t % 900}{'.' if t % 7 else ''}") for t in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    (got,) = R.report(df).collect()
    seen, shapes = set(), []
    for _, _, role, text in rows:
        shapes.append((role[0], (role, text) in seen, text[-1] != "." and (role, text) not in seen))
        seen.add((role, text))
    assert got.cost == cheapest(shapes)[0] and len(got.audit.replace("I", "")) == 20_000


def test_empty_table(spark):
    assert R.report(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []
