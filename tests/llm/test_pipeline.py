"""The corpus pipeline against a brute-force version on small tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from graphloom.llm import packing, tokens
from tests.llm.test_llm import PROSE, _measures, _set


def _brute(rows, items):
    kept = []
    for d, t in rows:
        n, _, symbols, dup, repeat = _measures(t)
        if n >= 10 and 100 * repeat <= 20 * n and symbols <= 0.1 * n and dup <= 0.1 * n:
            kept.append((d, t))
    sets, root = [_set(t) for _, t in kept], list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(kept)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(kept):
        low[find(i)] = min(low.get(find(i), d), d)
    once = {(d, t) for i, (d, t) in enumerate(kept) if low[find(i)] == d}
    clean = [(d, t) for d, t in once if not any(100 * len(_set(u) & _set(t)) >= 75 * len(_set(u)) for _, u in items)]
    return [(d, re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t)) for d, t in clean]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(40):
        w = [f"t{int(x)}" for x in rng.integers(0, 900, 60)]
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            w[int(rng.integers(60))] = "changed"
            rows.append((100 + i, " ".join(w)))
        if i % 7 == 0:
            rows.append((200 + i, " ".join(w[:20]) + f" mail{i}@host.example.com " + " ".join(f"u{i}v{k}" for k in range(40))))
    rows += [(300, " ".join(f"q{k}" for k in range(30)) + " " + " ".join(PROSE)), (301, "short text"), (302, " ".join(["x##"] * 3 + PROSE[:15])), (303, None), (304, "no " * 40)]
    rows.append(rows[5])
    items = [(1, " ".join(PROSE[:16])), (2, "never seen words of a test item here")]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 2}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = _brute(rows, items)
    ids = tokens.encoder(tokens.default_vocabulary())([t for _, t in left])
    want = Counter((d, k, s, n) for (d, _), x in zip(left, ids, strict=True) for k, (s, n) in enumerate(packing.cut(len(x) + 1)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    assert 0 < len(left) < len(rows)


def test_stages_keep_the_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "packing"]
