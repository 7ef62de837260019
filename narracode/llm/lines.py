"""Removal of repeated lines, up to a few edits, by a segment-partition join.

Lines may differ by one edit per ``EDIT_CHARS`` characters of the shorter one, up to ``EDITS``;
shorter lines are repeats only if they are equal. Every line with a visible character takes part.

A line is cut into ``edits + 1`` segments. Two lines within ``edits`` edits share one segment:
the edits cannot touch them all. So every line is indexed by its segments and its length, and
probes the lengths up to ``edits`` below its own with the few substrings that may meet a
segment there. Lines that meet are compared by banded bit-parallel edit distance, where the
``2 * edits + 1`` diagonals of the table are the bits of one number.

Only SQL functions run here. Lines are made distinct, with partial sums before the exchange, and
written; keys come from that table and move once. Keys that just one line has, nearly all of
them, leave by a minimum and maximum over the key before any line is paired. Lines of a frequent key are paired only
if the parities of their characters allow so few edits, so a key shared by many unlike lines
does not put out its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narracode.llm.graph import components
from narracode.llm.tables import keyed
from narracode.session import write_table

#: Edits (insertions, deletions, substitutions) up to which lines are the same.
EDITS = 2
#: Characters of the shorter line for each edit that is allowed.
EDIT_CHARS = 12
WORD = r"[^\x20\x09-\x0D]"
#: Numbers of lines, of eight bytes each, that are broadcast if a count of them shows no more.
BROADCAST_IDS = 1_000_000
#: A class with more lines than this, and with more than one in ``HOT_CLASSES`` of all lines, is
#: dealt in pieces; so there are never more such classes than that, and they are broadcast.
HOT_ROWS, HOT_CLASSES = 2_000, 100_000


def eligible_lines(docs: DataFrame) -> DataFrame:
    """``_id, _h, _pos, _line`` of the lines that take part, those with a visible character.
    Positions count all lines from 0."""
    rows = keyed(docs).select("_id", "_h", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    return rows.filter(F.col("_line").rlike(WORD))


def allowed_edits(length: Column, edits: int, edit_chars: int) -> Column:
    """Edits that a pair may have whose shorter line has ``length`` characters."""
    return F.least(F.lit(edits), F.floor(length / edit_chars).cast("int"))


def _segment(i: int, edits: int, length: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` (from 0) of a line of ``length``."""

    def cut(n: int) -> Column:
        return F.call_function("div", length * n, F.lit(edits + 1)).cast("int")

    return cut(i) + 1, cut(i + 1) - cut(i)


def _keys(edits: int, edit_chars: int) -> Column:
    """Array of keys of the line in ``_b`` (four bytes per character) with ``_n`` characters:
    its own segments, marked by a set low bit, and the substrings that may meet segments of
    shorter lines. A line's length says how many edits it is cut for; the shortest has no keys."""
    parts = []
    for allowed in range(1, edits + 1):
        for gap in range(allowed + 1):
            length, found = F.col("_n") - gap, []
            for i in range(allowed + 1):
                start, n = _segment(i, allowed, length)
                # an edit before the segment moves it by one, and so does one after it
                low = max(-i, gap - (allowed - i))
                high = min(i, gap + (allowed - i))
                for shift in range(low, high + 1):
                    own = gap == 0 and shift == 0
                    piece = F.substring("_b", (start - 1 + shift) * 4 + 1, n * 4)
                    found.append(F.struct(F.xxhash64(F.lit(i), length, piece).alias("key"), F.lit(int(own)).alias("own")))
            cut_so = allowed_edits(length, edits, edit_chars) == allowed
            parts.append(F.when(cut_so, F.array(*found)).otherwise(F.expr("cast(array() as array<struct<key: bigint, own: int>>)")))
    return F.concat(*parts)


def _parity(line: Column) -> Column:
    """64 bits: for each class of characters, whether their number is odd."""

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))

    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(bit(c)))


def edit_distance(a: str, b: str, edits: int) -> Column:
    """Distance of the strings in columns ``a`` (no shorter) and ``b`` if it is at most
    ``edits``, else a larger number. Their lengths differ by at most ``edits``, and ``a`` is
    longer than ``edits``.

    Bit ``d`` at column ``j`` of the table is row ``j - edits + d``. ``vp`` and ``vn`` are the
    rows whose value is one more or one less than in the row above; the distance is followed
    down the outer diagonal and then along the last row.
    """
    top = 2 * edits
    mask = (1 << (top + 1)) - 1
    match = " | ".join(
        f"if(coalesce(get(z.a, i + {d - edits}) = get(z.b, i), false), {1 << d}L, 0L)" for d in range(top + 1)
    )
    zero = f"((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {mask}L"
    hp = f"((s.vn | ~(d | s.vp)) & {mask}L)"
    hn = "(d & s.vp)"
    along = f"(i - (size(z.a) - {edits}))"
    last = f"shiftright({1 << top}L, {along} + 1)"
    dist = f"""case when {along} < 0 then s.n + if(d & {1 << top}L = 0, 1, 0)
        else s.n + if(p & {last} != 0, 1, 0) - if(m & {last} != 0, 1, 0) end"""
    after = f"named_struct('vp', (m | ~(shiftright(d, 1) | p)) & {mask}L, 'vn', shiftright(d, 1) & p, 'n', {dist})"
    # one-element arrays name the values that are used again
    step = after
    for name, value in (("m", hn), ("p", hp), ("d", zero), ("x", match)):
        step = f"get(transform(array({value}), {name} -> {step}), 0)"
    start = f"named_struct('vp', {mask ^ ((1 << edits) - 1)}L, 'vn', 0L, 'n', {edits})"
    whole = f"aggregate(sequence(0, size(z.b) - 1), {start}, (s, i) -> {step}, s -> s.n)"
    return F.expr(f"get(transform(array(named_struct('a', split({a}, ''), 'b', split({b}, ''))), z -> {whole}), 0)")


def _sized(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if its rows, counted in the files, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def line_links(lines: DataFrame, edits: int = EDITS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``u, v``: pairs of different lines within the edits that their length allows, as the md5
    of each. ``lines`` has ``_line``; repeated lines count once."""
    code = F.encode("_line", "UTF-32")
    number = F.shiftrightunsigned(F.shiftleft(F.xxhash64(code), 1), 1)
    long = lines.filter(F.length("_line") >= edit_chars).select("_line").distinct()
    long = write_table(long.select(number.alias("_l"), "_line"), "distinct_lines")
    coded = long.select("_l", code.alias("_b"), F.length("_line").alias("_n"))
    keys = coded.select("_l", F.explode(_keys(edits, edit_chars)).alias("_k"))
    # the low bit of the line's number says whether the key is a segment of its own
    marked = F.shiftleft("_l", 1).bitwiseOR(F.col("_k.own").cast("long"))
    keys = keys.select(F.col("_k.key").alias("_key"), marked.alias("_l"))
    line, own, key = F.shiftrightunsigned("_l", 1), F.col("_l") % 2 != 0, Window.partitionBy("_key")
    # the least and the greatest number tell keys of one line; a set bit, keys that a segment has
    seen = keys.withColumns({"_a": F.min(line).over(key), "_z": F.max(line).over(key), "_o": F.max(own).over(key)})
    met = seen.filter("_a < _z AND _o").select("_key", line.alias("_l"), own.alias("_own"))
    met = write_table(met.distinct(), "line_meetings")
    wanted = _sized(write_table(met.select("_l").distinct(), "met_lines"))
    texts = long.join(wanted, "_l", "left_semi")
    texts = texts.select("_l", F.unhex(F.md5("_line")).alias("_id"), "_line", F.length("_line").alias("_n"), _parity(F.col("_line")).alias("_p"))
    texts = write_table(texts, "line_texts")
    sized = met.join(texts.select("_l", "_id", "_n", "_p"), "_l")
    u = sized.filter("_own").select("_key", F.col("_id").alias("u"), F.col("_n").alias("_un"), F.col("_p").alias("_up"))
    v = sized.select(
        F.col("_key").alias("_vkey"), F.col("_own").alias("_vown"), F.col("_id").alias("v"), F.col("_n").alias("_vn"), F.col("_p").alias("_vp")
    )
    near = F.bit_count(F.col("_up").bitwiseXOR(F.col("_vp"))) <= 2 * edits
    close = (F.col("_vn") - F.col("_un")).between(0, edits)
    once = ~F.col("_vown") | (F.col("u") < F.col("v"))
    pairs = u.join(v, (F.col("_key") == F.col("_vkey")) & near & close & once & (F.col("u") != F.col("v")))
    pairs = write_table(pairs.select("u", "v").distinct(), "line_pairs")
    left = texts.select(F.col("_id").alias("u"), F.col("_line").alias("_short"))
    right = texts.select(F.col("_id").alias("v"), F.col("_line").alias("_long"))
    both = pairs.join(left, "u").join(right, "v")
    most = allowed_edits(F.length("_short"), edits, edit_chars)
    return both.filter(edit_distance("_long", "_short", edits) <= most).select("u", "v")


def line_classes(docs: DataFrame, edits: int = EDITS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``_id, _h, _pos, _class, _first, _many`` of every eligible line: its class, the place of
    the class's first line as ``(_id, _h, _pos)``, and whether the class has other lines."""
    if edits < 1 or edit_chars < 6:
        raise ValueError("lines need an edit and three characters per segment")
    lines = eligible_lines(docs)
    roots = components(line_links(lines, edits, edit_chars))
    placed = lines.select("_id", "_h", "_pos", F.unhex(F.md5("_line")).alias("_l"))
    classed = placed.join(roots, F.col("_l") == F.col("node"), "left")
    classed = classed.select("_id", "_h", "_pos", F.coalesce("root", "_l").alias("_class"))
    classed = write_table(classed, "line_classes")
    place = F.struct("_id", "_h", "_pos")
    firsts = classed.groupBy("_class").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_lines"))
    piece = max(HOT_ROWS, classed.count() // HOT_CLASSES)
    pieces = F.ceil(F.col("_lines") / piece).cast("int")
    firsts = write_table(firsts.withColumn("_pieces", pieces), "line_firsts")
    hot = firsts.filter("_pieces > 1").select(F.col("_class").alias("_hot"), "_pieces")
    dealt = classed.join(F.broadcast(hot), F.col("_class") == F.col("_hot"), "left")
    which = F.pmod(F.xxhash64("_id", "_h", "_pos"), F.coalesce("_pieces", F.lit(1))).cast("int")
    dealt = dealt.select("_id", "_h", "_pos", "_class", which.alias("_piece"))
    every = firsts.select("_class", "_first", (F.col("_lines") > 1).alias("_many"), F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"))
    return dealt.join(every, ["_class", "_piece"]).drop("_piece")


def find_repeats(docs: DataFrame, edits: int = EDITS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``doc_id, line_no, class_doc_id, class_line_no, kept`` of every eligible line.

    Lines within one edit per ``edit_chars`` characters, up to ``edits``, are one class, and so
    are lines linked through others; equal lines always are. The
    first line by document and position is kept and names the class. Line numbers start at 0. A
    missing or empty text has no lines; a missing id comes before all others. Repeated rows
    share their lines: both copies of the first line are kept here.
    """
    rows = line_classes(docs, edits, edit_chars)
    first = F.struct("_id", "_h", "_pos").eqNullSafe(F.col("_first"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_pos").alias("line_no"),
        F.col("_first._id").alias("class_doc_id"),
        F.col("_first._pos").alias("class_line_no"),
        first.alias("kept"),
    )


def drop_repeats(docs: DataFrame, edits: int = EDITS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``docs`` without the lines that ``find_repeats`` does not keep.

    ``n_chars``, if there, follows the text. A document that loses lines and has no visible
    character left goes; all others stay, unchanged if they lose nothing.
    """
    rows = line_classes(docs, edits, edit_chars)
    lost = rows.filter(F.col("_many") & ~F.struct("_id", "_h", "_pos").eqNullSafe(F.col("_first")))
    lost = lost.groupBy("_id", "_h").agg(F.sort_array(F.collect_set("_pos")).alias("_lost"))
    # whether each line up to the last lost one stays
    until = "array_repeat(true, p - coalesce(get(_lost, j - 1), -1) - 1)"
    lost = lost.select("_id", "_h", F.expr(f"flatten(transform(_lost, (p, j) -> concat({until}, array(false))))").alias("_stay"))
    whole = keyed(docs)
    lost = lost.withColumnsRenamed({"_id": "_lid", "_h": "_lh"})
    same = whole["_id"].eqNullSafe(lost["_lid"]) & (whole["_h"] == lost["_lh"])
    joined = whole.join(lost, same, "left")
    left = F.expr("array_join(filter(split(_text, '\\n', -1), (s, i) -> coalesce(get(_stay, i), true)), '\\n')")
    text = F.when(F.col("_stay").isNull(), F.col("_text")).otherwise(left)
    joined = joined.withColumn("_new", text).filter(F.col("_stay").isNull() | F.col("_new").rlike(WORD))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_new").alias(c))
        elif c == "n_chars":
            size = F.length("_new").cast(docs.schema[c].dataType)
            columns.append(F.when(F.col("_stay").isNull(), F.col("_row")[c]).otherwise(size).alias(c))
        else:
            columns.append(F.col("_row")[c].alias(c))
    return joined.select(*columns)


#: The same classes in SQL: all pairs of different lines whose lengths and letter counts allow it.
ORACLE = r"""
WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
e AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS MATERIALIZED (SELECT line, length(line) AS n, min(doc_id * 1000000 + pos) AS id,
    length(replace(line, 'e', '')) AS a, length(replace(line, 'n', '')) AS b, length(replace(line, 't', '')) AS c
    FROM e GROUP BY line),
p AS MATERIALIZED (SELECT x.id AS u, y.id AS v FROM d x JOIN d y ON y.n BETWEEN x.n AND x.n + 2 AND x.id <> y.id
    AND abs(x.n - x.a - y.n + y.a) <= 2 AND abs(x.n - x.b - y.n + y.b) <= 2 AND abs(x.n - x.c - y.n + y.c) <= 2
    AND x.n >= 12 AND levenshtein(x.line, y.line) <= least(2, x.n // 12)),
b AS MATERIALIZED (SELECT u, v FROM p UNION SELECT v, u FROM p),
r AS (SELECT id, id AS root FROM d UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.id WHERE r.root < b.v),
s AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT e.doc_id, CAST(e.pos AS INT) AS line_no, s.root // 1000000 AS class_doc_id, CAST(s.root % 1000000 AS INT) AS class_line_no,
  s.root = e.doc_id * 1000000 + e.pos AS kept
FROM e JOIN d ON e.line = d.line JOIN s ON s.id = d.id
"""
