"""Suggestions against the standard library's close matches."""

from __future__ import annotations

import difflib
import random

from tidewire.operators import suggest


def test_equal_to_close_matches(spark):
    rng = random.Random(8)
    words = ["news", "prices", "2024", "clean", "final", "out", "a-b", "x_y", "daily", "merged"]
    names = sorted({"_".join(rng.sample(words, rng.randint(1, 4))) + rng.choice([".csv", ".CSV", ""]) for _ in range(1000)})
    wanted = [rng.choice(names)[rng.randint(0, 3) :][::-1] if i % 5 == 0 else "".join(c for c in rng.choice(names) if rng.random() < 0.8) for i in range(20)] + ["zzz final qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq.csv", "###", ""]
    df = spark.createDataFrame([(n,) for n in names + names[:9]] + [(None,)], "n string").repartition(6)
    got: dict = {}
    for r in suggest.suggestions(df, "n", wanted + wanted[:3]).orderBy("wanted", "rank").collect():
        got.setdefault(r.wanted, []).append((r.name, r.how))
    low = sorted({n.lower() for n in names})
    for w in wanted:
        want = difflib.get_close_matches(w.lower(), low, n=5, cutoff=0.45)
        if want:
            assert got.get(w, []) == [(x, "ratio") for x in want], w
        else:
            assert all(how == "words" for _, how in got.get(w, []))
    assert got["zzz final qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq.csv"] == [(x, "words") for x in [n for n in low if "final" in n][:5]] and "###" not in got
