"""Text lines for language-model data and masked-token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narracode.functions.numeric import hex_uniform
from narracode.functions.text import words

#: Vocabularies up to this many words are broadcast.
BROADCAST_WORDS = 1_000_000


def stack_texts(records: DataFrame) -> DataFrame:
    """``part, uid, line_no, line``: lines of the first narrative, then those of the second;
    a ``split`` column is kept."""
    keep = [c for c in ("uid", "split") if c in records.columns]
    sides = records.select(*keep, F.posexplode(F.array("narrative_le", "narrative_cme")).alias("part", "_text"))
    return sides.select("part", *keep, F.posexplode(F.split("_text", "\n")).alias("line_no", "line"))


def mask_tokens(
    lines: DataFrame,
    vocab: DataFrame,
    vocab_size: int,
    block: int = 512,
    p: float = 0.15,
    seed: int = 0,
) -> DataFrame:
    """Masked-token rows ``line_id, block_no, pos, token, masked, target``.

    A token is chosen with probability ``p``; of the chosen, 80 % become ``[MASK]``, 10 % a
    random vocabulary word and 10 % stay. Lines longer than ``block`` go on in further
    blocks, so no text is lost. Draws depend on seed, line and position only. ``vocab``
    is ``term_id, term`` with ids ``0 .. vocab_size - 1``.
    """
    tokens = lines.select("line_id", F.posexplode(words(F.col("line"))).alias("_at", "target"))
    key = F.concat(F.lit(f"{seed}|"), F.col("line_id").cast("string"), F.lit("|"), F.col("_at").cast("string"))
    keyed = tokens.withColumn("_digest", F.md5(key))
    pick, how, word = [hex_uniform(F.col("_digest"), i) for i in range(3)]
    random_id = F.floor(word * vocab_size).cast("int")
    drawn = keyed.withColumn(
        "_how", F.when(pick < p, F.when(how < 0.8, "mask").when(how < 0.9, "random").otherwise("keep"))
    )
    is_random = F.coalesce(F.col("_how") == "random", F.lit(False))
    pool = vocab.select(F.col("term_id").alias("_random_id"), F.col("term").alias("_random"))
    if vocab_size <= BROADCAST_WORDS:
        pool = F.broadcast(pool.filter(F.col("_random_id") < vocab_size))
        joined = drawn.withColumn("_random_id", F.when(is_random, random_id)).join(pool, "_random_id", "left")
    else:
        # only the tokens that become another word are joined; the others do not move
        replaced = drawn.filter(is_random).withColumn("_random_id", random_id).join(pool, "_random_id", "left")
        others = drawn.filter(~is_random).withColumn("_random", F.lit(None).cast("string"))
        joined = others.unionByName(replaced.drop("_random_id"))
    token = (
        F.when(F.col("_how") == "mask", F.lit("[MASK]"))
        .when(F.col("_how") == "random", F.col("_random"))
        .otherwise(F.col("target"))
    )
    return joined.select(
        "line_id",
        F.floor(F.col("_at") / block).cast("int").alias("block_no"),
        (F.col("_at") % block).alias("pos"),
        token.alias("token"),
        F.col("_how").isNotNull().cast("int").alias("masked"),
        F.when(F.col("_how").isNotNull(), F.col("target")).alias("target"),
    )
