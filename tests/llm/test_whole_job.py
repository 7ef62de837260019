"""Inputs on which an operator once did less than the whole job."""

from __future__ import annotations

import collections
import random

import numpy as np

from narracode.llm import embeddings, packing, personal, quality, toxicity
from narracode.llm.queries import byte_bpe
from tests.llm.conftest import docs_of


def test_toxicity_counts_are_exact_for_any_number_of_runs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [(i, " ".join(word() for _ in range(500)), i % 2) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class int").repartition(4)
    got = {r.doc_id: r.x for r in toxicity.features(docs.select("doc_id", "text"), toxicity.fit_counts(docs.select("text", "class"))).collect()}

    order, shared, d = toxicity.ORDER, toxicity.SHARED, toxicity.DISCOUNT
    longest = collections.Counter((c, r) for _, t, c in rows for w in t.split() for r in toxicity.longest_runs(w))
    assert sum(len(r) == order for c, r in longest if c == 0) > 100_000
    levels = {order: {k: n for k, n in longest.items() if len(k[1]) == order}}
    for n in range(order - 1, 0, -1):
        above = {(2 if n <= shared else c, r) for c, r in levels[n + 1]}
        levels[n] = collections.Counter((c, r[1:]) for c, r in above)
        for (c, r), m in longest.items():
            if len(r) == n:
                levels[n][2 if n <= shared else c, r] += m
    own, total, kinds = {}, collections.Counter(), collections.Counter()
    for level in levels.values():
        for (c, r), m in level.items():
            own[c, r] = m
            total[c, len(r), r[:-1]] += m
            kinds[c, len(r), r[:-1]] += 1

    def chance(c: int, run: str) -> float:
        k = 2 if len(run) <= shared else c
        if len(run) == 1:
            return (own.get((2, run), 0) + 0.5) / (total[2, 1, ""] + 128)
        less = chance(c, run[1:])
        at = k, len(run), run[:-1]
        return min(1, (max(own.get((k, run), 0) - d, 0) + d * kinds[at] * less) / total[at]) if total[at] else less

    for i, text, _ in rows[:4]:
        words = [toxicity.longest_runs(w) for w in text.split()]
        score = np.array([sum(np.log(max(chance(1, r), 1e-12)) - np.log(max(chance(0, r), 1e-12)) for r in w) for w in words])
        want = toxicity.text_features(score, np.array([len(w) for w in words], float))
        assert np.allclose(got[i], want, atol=1e-5)


def test_packing_finds_added_tokens(spark):
    import zlib

    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(byte_bpe())
    texts = ["one <|endoftext|> two", "<|endoftext|><|endoftext|>a  <|endoftext|>", "a <|endoftext| > b"]
    ids = [[*reference.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    got = packing.pack(docs_of(spark, texts), byte_bpe()).orderBy("doc_id", "start").collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(x) for i, x in enumerate(ids)}
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part)


def test_packing_of_long_runs(spark):
    """Runs of white space and letters beyond a million characters, also beside added tokens."""
    import zlib

    from tokenizers import Tokenizer

    reference, end = Tokenizer.from_file(byte_bpe()), "<|endoftext|>"
    n = 1_200_000
    texts = [
        "a" + " " * n + "b", "\t" * n, "x" + "\n" * n + "y" + "z" * n, end + " " * n + end, "a" + " \n" * 30_000 + "\u3000" * 30_000 + "!",
        "a " + "\x1c" * 60_000 + " b", " " * 60_000 + "'s",
    ]
    ids = [[*reference.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    got = packing.pack(docs_of(spark, texts), byte_bpe()).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(x) for i, x in enumerate(ids)}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4"))


def test_personal_data_in_long_windows_and_after_long_names():
    field = personal.train_field(personal.labelled_table())
    line = "call me (555) 123 4567, then\n"
    (_, spans), (_, one) = personal.all_spans([line * 3000, line * 3], field)
    assert len(one) == 3 and len(spans) == 3000
    text = "word " * 20 + "a" * 70 + " @ example.com and more"
    assert personal.all_spans([text], field)[0][1][0][0] == text.index("aaa")
    tokens = personal._tokens(line * 900)
    assert (personal._long_features(tokens) == personal.token_features(tokens)).all()


def test_languages_without_a_cap_and_letters(spark):
    from narracode.llm import language

    assert [bool(language._LETTER.search(t)) for t in ("²", "½ 12", "①", "Ⅷ", "_1", "é", "中", "ʰ")] == [False] * 5 + [True] * 3
    rng = random.Random(1)
    rows = []
    for k in range(300):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) + f"q{k}q" for _ in range(4)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=12)), f"l{k:03d}") for i in range(4)]
    docs = spark.createDataFrame([*rows, (5000, "①²", "l000")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert got[5000].lang_pred == "und" and got[5000].score == 0
    assert len({r.lang_pred for r in got.values()}) > 257


def test_toxicity_scores_differ_on_few_labels(spark, sf):
    """Few toxic rows may be learned from, and a plain draw would set none of them aside."""
    from narracode.llm.queries import QUERIES

    got = QUERIES["op5_toxicity"](spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").toxic
    known = got[got.held_out & got.doc_id.isin(truth.index)]
    toxic = truth[known.doc_id].to_numpy() == 1
    assert got.score.nunique() > 100
    assert known.score[toxic].mean() > known.score[~toxic].mean()
    x, y = np.array([[0.1, 0, 0, 0, 0], [0.4, 0, 0, 0, 0]]), np.zeros(2)
    w = toxicity.fit_curve(x, y)
    assert (np.c_[x, np.ones(2)] @ w)[1] > (np.c_[x, np.ones(2)] @ w)[0]


def test_runs_of_large_alphabets_and_cut_words(monkeypatch):
    """Runs by packed numbers are those of the plain definition, also where a word is cut."""
    words = ["ab", "", "a", "aaaaaaaaaaaa", "中文" * 9, "".join(map(chr, range(0x4E00, 0x5E00))), "𝒳é́" * 700, "ab"]
    want = [r for w in words for r in toxicity.longest_runs(w)]
    table = {r: float(hash(r) % 97) for r in set(want)}
    scores = [sum(table[r] for r in toxicity.longest_runs(w)) for w in words]
    for size in (1 << 19, 7):
        monkeypatch.setattr(toxicity, "PIECE_CHARS", size)
        got = []
        for pieces, skips, _ in toxicity.marked_pieces(words):
            runs, which, begins = toxicity.distinct_runs(pieces, skips)
            assert len(set(runs)) == len(runs) and (np.diff(begins) > 0).all()
            got += [runs[i] for i in which]
        assert got == want
        total, chars = toxicity.word_scores(words, table)
        assert total.tolist() == scores and chars.tolist() == [len(w) + 1 for w in words]


def test_every_part_has_a_task_of_its_own(spark):
    names = toxicity.part_names(spark, 25)
    rows = spark.createDataFrame([(n,) for n in names], "part int").repartition(25, "part")
    assert rows.selectExpr("spark_partition_id() p").distinct().count() == 25


def test_repeated_windows_are_compared_by_their_words(spark, monkeypatch):
    """Also where all windows have one hash."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (2, 3, 6, 12, 25, 60, 150)]
    docs = docs_of(spark, texts).withColumnRenamed("text", "_text")

    def plain(text):
        w = text.split()
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        return len({k for p, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for k in (p, p + 1, p + 2)})

    want = [plain(t) for t in texts]
    for hashed in (None, "cast(0 as bigint)"):
        if hashed:
            monkeypatch.setattr(quality, "WINDOW_HASH", hashed)
        got = {r.doc_id: r.n_repeat_words for r in quality.text_counts(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_a_long_text_without_repeated_windows(spark):
    n = 1_000_000
    text = " ".join(map(str, range(n)))
    row = quality.text_counts(docs_of(spark, [text, text + " 5 6 7"]).withColumnRenamed("text", "_text")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_repeat_words) for r in row] == [(n, 0), (n + 3, 6)]


def test_a_third_of_the_vectors_in_one_dense_group(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6_000, 32))
    x[::3] = x[0] + 0.02 * rng.normal(size=(2_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.link_vectors(df).toPandas().sort_values("vec_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    assert got.n_links.tolist() == (near.sum(axis=1) - 1).tolist()
    assert (got.component_id.to_numpy()[::3] == 0).all() and got.kept.sum() == 4_001


def test_rejected_hosts_leave_by_broadcast_and_in_pieces(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"h{i}") for i in range(600)], "doc_id long, _host string")
    bad = spark.createDataFrame([("hot",), ("h6",), ("h12",), ("elsewhere",)], "_judged string")
    want = {i for i in range(600) if i % 3 == 0 and i not in (6, 12)}
    for most in (10, 0):
        left = quality._without_hosts(rows, bad, most)
        assert left.columns == rows.columns
        assert sorted(r.doc_id for r in left.collect()) == sorted(want)
