"""The whole pipeline against a brute-force version on a small table."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np

import corpus_pipeline
from narracode.llm import packing, personal
from narracode.llm.queries import byte_bpe


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def roots(items, linked):
    up = {i: i for i in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in items}


def brute(rows):
    """Final text of every document that stays. All hosts of the table pass."""
    texts = {}
    for i, t in rows:
        words = t.split()
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k for p, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in (p, p + 1, p + 2)}
        if len(words) >= 50 and 2 * len(covered) <= len(words):
            texts[i] = t
    places = [(i, p) for i in sorted(texts) for p, s in enumerate(texts[i].split("\n")) if s.strip()]
    line = {(i, p): texts[i].split("\n")[p] for i, p in places}

    def repeats(a, b):
        a, b = line[a], line[b]
        return a == b or abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 12)

    first = roots(places, repeats)
    for i in list(texts):
        lost = {p for (d, p), r in first.items() if d == i and r != (d, p)}
        if lost:
            texts[i] = "\n".join(s for p, s in enumerate(texts[i].split("\n")) if p not in lost)
            if not texts[i].strip():
                del texts[i]
    sets = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := t.split()) else None for i, t in texts.items()}

    def near(a, b):
        x, y = sets[a], sets[b]
        return x and y and 5 * sum((x & y).values()) >= 4 * sum((x | y).values())

    classes = roots(sorted(texts), near)
    field = personal.train_field(personal.labelled_table())
    kept = {i: texts[i] for i, r in classes.items() if r == i}
    return {i: personal.mask(t, personal.all_spans([t], field)[0][1]) for i, t in kept.items()}


def test_pipeline_is_the_brute_force(spark, tmp_path):
    rng = random.Random(12)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    good = [f"{words(30)}\n{words(25)}\n{words(20)}" for _ in range(12)]
    changed = good[1].split()
    changed[40] = "other"
    one_line = words(90)
    near = one_line.split()
    near[50] = "different"
    rows = [
        *enumerate(good),
        (20, good[0]),
        (21, " ".join(changed)),
        (22, words(10)),
        (23, "again and again " * 40),
        (24, f"{good[2].splitlines()[0]}\n{words(60)}"),
        (25, f"{good[3].splitlines()[1][:-1]}\n{words(70)}\n{good[3].splitlines()[0]}x"),
        (26, f"{words(60)} write to ann.b@mail.org or call +1 (386) 555-3733 now {words(5)}"),
        (27, one_line),
        (28, " ".join(near)),
        (29, f"{words(55)} at 10.0.0.1 and 4111 1111 1111 1111 {words(3)}"),
    ]
    table = [(i, t, "en", f"host{i % 2}", len(t)) for i, t in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    want = brute(rows)
    assert set(got.doc_id) == set(want)
    assert not {20, 22, 23, 28} & set(want) and "[EMAIL]" in want[26] and "[CARD]" in want[29]
    ids_of = packing.TokenIds(byte_bpe())
    for i, text in want.items():
        ids = np.append(ids_of.encode(text), 0).astype("<u4")
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n]) for s, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
