"""Language of whole texts by averaged hashed subword embeddings and a linear softmax.

A word, with marks at its ends, gives its runs of one to four characters, hashed into a fixed
number of buckets. Each bucket has an embedding; a text is the average over all its runs, and a
linear layer with softmax scores the languages. The model is trained by stochastic gradient
descent in numpy on a bounded sample: about ``TRAIN_ROWS`` documents in equal parts per language
(``LEAST_ROWS`` of a language at least),
each once as a whole and once as a short piece, so that short texts are known too. The softmax is
calibrated by one temperature on documents kept out of the descent; below ``REJECT`` the
prediction is marked as rejected.

As everything before the softmax is linear, a word's runs are summed up into one score per
language once, and a text only adds up its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narracode.llm.words import WordRows, blocks, mix

#: Documents to train on, in all languages together; they travel to the driver as bucket counts.
TRAIN_ROWS = 2_400
#: Documents of a language at least, as far as there are any, however many languages there are.
LEAST_ROWS = 12
BUCKETS = 1 << 14
DIMENSIONS = 16
LONGEST = 4
EPOCHS = 6
RATE = 0.4
#: Words of the short piece.
PIECE_WORDS = 8
REJECT = 0.5
UNKNOWN = "und"

_U = np.uint64
_LETTER = regex.compile(r"\p{L}")


def id_hash(doc_id: Column) -> Column:
    """CRC-32 of the id as text; a missing id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return id_hash(doc_id) % 4 == 2


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of all words, and the word each belongs to."""
    small = [w.lower() for w in words]
    lengths = np.fromiter(map(len, small), np.int64, len(small)) + 2
    text = "".join([f"<{w}>" for w in small])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    word = np.repeat(np.arange(len(small)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    found, owners = [], []
    h = np.zeros(len(codes), _U)
    for n in range(1, LONGEST + 1):
        # the run of n characters that starts here, if the word is long enough
        nxt = np.zeros(len(codes), _U)
        nxt[: len(codes) - n + 1] = codes[n - 1 :]
        h = mix(h * _U(31) + nxt + _U(n))
        ok = left >= n
        found.append((h[ok] % _U(BUCKETS)).astype(np.int64))
        owners.append(word[ok])
    return np.concatenate(found), np.concatenate(owners)


def _bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(word_buckets(words)[0], return_counts=True)


@dataclass
class LanguageModel:
    """Embeddings, the linear layer, and the temperature of the softmax."""

    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores summed over the runs of each word, and the number of runs."""
        if not words:
            return np.zeros((0, len(self.languages))), np.zeros(0)
        buckets, word = word_buckets(words)
        table = self.embeddings @ self.weights
        sums = np.stack([np.bincount(word, table[buckets, k], len(words)) for k in range(table.shape[1])], axis=1)
        return sums, np.bincount(word, minlength=len(words)).astype(np.float64)

    def probabilities(self, average: np.ndarray) -> np.ndarray:
        z = (average + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], seed: int = 7) -> LanguageModel:
    """Descent over bags of ``language, buckets, counts``; every fifth pair of bags is kept for
    the temperature."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    model = LanguageModel(
        languages,
        rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)),
        np.zeros((DIMENSIONS, k)),
        np.zeros(k),
    )
    kept = [i for i in range(len(bags)) if i // 2 % 5 == 4]
    used = [i for i in range(len(bags)) if i // 2 % 5 != 4]
    total, done = max(EPOCHS * len(used), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            y, buckets, counts = bags[i]
            share = counts / counts.sum()
            h = share @ model.embeddings[buckets]
            g = np.exp(h @ model.weights + model.bias)
            g /= g.sum()
            g[y] -= 1.0
            rate = RATE * (1 - done / total)
            back = model.weights @ g
            model.weights -= rate * np.outer(h, g)
            model.bias -= 0.1 * rate * g
            # an average spreads its gradient over all runs; the length of the text is given back
            model.embeddings[buckets] -= rate * np.outer(np.minimum(share * len(share), 4.0), back)
            done += 1
    if kept:
        logits = np.stack([(b[2] / b[2].sum()) @ model.embeddings[b[1]] @ model.weights + model.bias for b in (bags[i] for i in kept)])
        truth = np.array([bags[i][0] for i in kept])
        best = np.inf
        for t in np.geomspace(0.25, 8.0, 41):
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]).mean()
            if loss < best:
                best, model.temperature = loss, float(t)
    return model


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Train on ``doc_id, text, lang`` of rows that are not held out; None without any."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(train_rows / len(counts), LEAST_ROWS)
    # a row for each language, of which the model holds more
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "_lang string, _share double")
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("lang")), F.lit(1_000_000)) / 1_000_000
    sample = rows.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).filter(draw < F.col("_share")).select("doc_id", "lang", "text")

    def bags(batches):
        for batch in batches:
            out = []
            for i, lang, text in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                words = text.split()
                start = len(words) // 3
                for part, some in enumerate((words, words[start : start + PIECE_WORDS])):
                    b, n = _bag(some)
                    out.append((str(i), part, lang, b.astype(np.int32), n.astype(np.int32)))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            names = ["id", "part", "lang", "buckets", "counts"]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = sample.mapInArrow(bags, "id string, part int, lang string, buckets array<int>, counts array<int>")
    found = found.toPandas().sort_values(["id", "lang", "part"], kind="stable")
    languages = sorted(r["lang"] for r in counts)
    number = {name: k for k, name in enumerate(languages)}
    listed = [(number[r.lang], np.asarray(r.buckets), np.asarray(r.counts)) for r in found.itertuples()]
    return train(listed, languages)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of the whole text of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        m = shared.value
        cache = WordRows(m.word_scores) if m else None
        for batch in batches:
            texts = [t if t and _LETTER.search(t) else "" for t in batch.column(1).to_pylist()]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a, b in blocks([len(t) for t in texts]) if m else ():
                cache.trim()
                rows = [cache.rows(t) for t in texts[a:b]]
                sums, runs = cache.fill()
                some = [i for i, r in enumerate(rows) if len(r)]
                if not some:
                    continue
                average = np.stack([sums[rows[i]].sum(axis=0) / runs[rows[i]].sum() for i in some])
                p = m.probabilities(average)
                best = p.argmax(axis=1)
                for i, k, q in zip(some, best, p.max(axis=1), strict=True):
                    langs[a + i], scores[a + i] = m.languages[k], q
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(scores < REJECT)],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    found = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        score, f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    )
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out and predict all of them.

    A missing text, or one without a letter, is ``und`` with score 0; so is every text if there
    is nothing to learn from. Every other text gets a learned language, its calibrated
    probability, and ``rejected`` if that is below ``REJECT``. Repeated rows are answered each.
    """
    return predict(docs, fit(docs, train_rows))
