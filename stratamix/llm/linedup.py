"""Line dedup: a segment-partition edit join between distinct lines, in DataFrame expressions only.

A line of n characters is cut into THRESHOLD + 1 segments. If another line, at most THRESHOLD characters longer,
is within the threshold, one segment must occur in it unchanged, and only near its own place: so the longer line
probes, for each possible shorter length and segment, the few substrings whose shift the remaining edits allow.
Rows that meet under (length, segment, substring) and whose character counts are close enough are candidates, written
once a pair; all of them, and nothing else, are verified by a banded bit-parallel edit distance: the band's
2 * THRESHOLD + 1 cells of a column are bits of one integer.

Lines stand for their occurrences by a 128-bit hash. Text is never shuffled to find candidates; lines that
repeat very often are indexed once, from their first occurrence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, few, fresh, sent_if_small, shuffled, table, written

THRESHOLD = 2
#: Shorter lines are left alone.
MIN_CHARS = 20
#: See ``without_repeats``.
MOST_WORDS = 50
#: Most frequent lines whose further occurrences are not indexed; they are sent to all tasks.
HOT_LINES = 50_000
#: Characters counted together for the filter beside the join, in words of eight. An edit changes two counts by one at most.
GROUPS = (("abc", "def", "ghi", "jkl", "mno", "pqr", "stuv", "wxyz"), ("e", "n", "t", "a", "r", "i", "0123456789", " "))
#: The first of them are also counted in so many prefixes and suffixes, each longer than the one before by so many characters.
ENDS, STEP = 7, 32


def exploded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, line, n, h) of the lines that count; n is the number of characters, h a 128-bit hash."""
    lines = docs.select(docs[id_col].alias("doc_id"), F.posexplode(F.split(docs[text_col], "\n")).alias("line_no", "line"))
    lines = lines.withColumn("n", F.length("line")).filter(F.col("n") >= min_chars)
    return lines.select("doc_id", "line_no", "line", "n", F.struct(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(11), "line").alias("h2")).alias("h"))


def _packed(line: Column) -> Column:
    """A byte for each of the characters 1 to 8: its number modulo 256."""
    size = F.octet_length(line)
    counts = [size - F.octet_length(F.replace(line, F.lit(chr(i + 1)), F.lit(""))) for i in range(8)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(c.cast("long").bitwiseAND(F.lit(255)), 8 * i) for i, c in enumerate(counts)])


def with_counts(lines: DataFrame) -> DataFrame:
    """Adds ``counts``: for each word of GROUPS the whole line's; ``ends``: the first word's in prefixes and suffixes."""
    marks = [F.translate("line", "".join(g), "".join(chr(i + 1) * len(x) for i, x in enumerate(g))) for g in GROUPS]
    lines = lines.withColumns({f"_m{k}": m for k, m in enumerate(marks)})
    runs = []
    for k in (range(ENDS), range(-1, -ENDS - 1, -1)):
        cuts = [_packed(F.substring("_m0", STEP * i + (i >= 0), STEP)) for i in k]
        runs += [reduce(lambda a, b: a + b, cuts[: n + 1]) for n in range(ENDS)]  # at most ENDS * STEP < 256 of a kind: no carry
    lines = lines.withColumns({"counts": F.array(*[_packed(F.col(f"_m{k}")) for k in range(len(GROUPS))]), "ends": F.array(*runs)})
    return lines.drop(*[f"_m{k}" for k in range(len(GROUPS))])


def _close(a: Column, b: Column, limit: int) -> Column:
    apart = []
    for i in range(8):
        d = F.abs(F.shiftright(a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftright(b, 8 * i).bitwiseAND(F.lit(255)))
        apart.append(F.least(d, F.lit(256) - d))
    return reduce(lambda p, q: p + q, apart) <= limit


def counts_close(a: str, b: str, threshold: int) -> Column:
    """What holds for all pairs within the threshold: an edit changes the counts of a line, prefix or suffix by two at most.

    (In a prefix, a character that is put in or left out counts once, and one more crosses the prefix's end.)
    """
    whole = [_close(F.col(f"{a}.counts")[k], F.col(f"{b}.counts")[k], 2 * threshold) for k in range(len(GROUPS))]
    ends = F.forall(F.zip_with(f"{a}.ends", f"{b}.ends", lambda x, y: _close(x, y, 2 * threshold)), lambda x: x)
    return reduce(lambda p, q: p & q, [*whole, ends])


def index_places(k: int) -> list[tuple[int, int, int]]:
    """(gap, segment, shift) under which a line is indexed: its own segments."""
    return [(0, i, 0) for i in range(k + 1)]


def probe_places(k: int) -> list[tuple[int, int, int]]:
    """(gap, segment, shift) under which a line finds those that are ``gap`` characters shorter, or equally long.

    At most ``segment`` edits lie before the segment and k - segment behind it, and the ends are gap characters apart.
    """
    return [(gap, i, shift) for gap in range(k + 1) for i in range(k + 1) for shift in range(max(-i, gap - (k - i)), min(i, gap + (k - i)) + 1)]


def keyed(first: DataFrame, places: list[tuple[int, int, int]], k: int, *keep: str) -> DataFrame:
    """(key) of the lines' substrings at ``places``, with the columns to keep.

    One short expression over exploded places: an expression for each place would be too long to be compiled. Where a
    line's characters are single bytes, its substrings are taken as bytes, without counting characters from the start.
    """
    table_ = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("gap", "i", "shift"), p, strict=True)]) for p in places])
    own = ["bytes", "n", *keep]
    rows = first.withColumn("bytes", F.col("line").cast("binary")).select(*own, F.explode(table_).alias("p")).select(*own, "p.*")
    length = F.col("n") - F.col("gap")
    size, rest = F.floor(length / (k + 1)).cast("int"), length % (k + 1)
    # the last segments take the rest, one character each
    longer = F.greatest(F.lit(0), F.col("i") - (k + 1 - rest))
    at = size * F.col("i") + longer + 1 + F.col("shift")
    rows = rows.withColumns({"_at": at, "_size": size + F.when(F.col("i") >= k + 1 - rest, 1).otherwise(0), "_length": length})
    rows = rows.filter((F.col("_at") >= 1) & (F.col("_at") + F.col("_size") - 1 <= F.col("n")))
    cut = lambda x: F.substring(x, F.col("_at"), F.col("_size"))
    part = F.when(F.octet_length("bytes") == F.col("n"), cut(F.col("bytes"))).otherwise(cut(F.col("bytes").cast("string")).cast("binary"))
    return rows.select(*keep, F.xxhash64("_length", "i", part).alias("key"))


def with_edit_distance(pairs: DataFrame, a: str, b: str, k: int, name: str = "distance") -> DataFrame:
    """Adds the banded bit-parallel edit distance of two strings in code points: exact up to ``k``, more than ``k`` beyond.

    Bit i of a vector is the cell of row j - k + i in column j. The vertical differences of a column follow from
    those of the one before by a few integer operations; the distance is followed along the diagonal that ends in
    the last cell. The characters are split in a projection of their own, once a pair.
    """
    width = 2 * k + 1
    mask = (1 << width) - 1
    first_longer = F.length(a) >= F.length(b)
    pad = F.array(*[F.lit("")] * (k + 1))
    chars = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    out = pairs.withColumns({"_long": F.when(first_longer, F.col(a)).otherwise(F.col(b)), "_short": F.when(first_longer, F.col(b)).otherwise(F.col(a))})
    out = out.withColumns({"_rows": F.concat(pad, chars(F.col("_long")), pad), "_cols": chars(F.col("_short"))})
    out = out.withColumn("_gap", F.size("_rows") - 2 * (k + 1) - F.size("_cols"))
    bit = lambda i: F.lit(1 << i).cast("long")
    low = lambda x: x.bitwiseAND(F.lit(mask).cast("long"))
    flip = lambda x: x.bitwiseXOR(F.lit(mask).cast("long"))
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)

    def column(state: Column, j: Column) -> Column:
        vp, vn, distance = state["vp"], state["vn"], state["d"]
        char = F.element_at("_cols", j)
        # row r of column j is at r + k + 1 in ``_rows``
        equal = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.element_at("_rows", j + i + 1) == char, bit(i)).otherwise(F.lit(0).cast("long")) for i in range(width)])

        def step(d0: Column) -> Column:
            hp = vn.bitwiseOR(flip(d0.bitwiseOR(vp)))
            hn = vp.bitwiseAND(d0)
            down = F.shiftright(d0, 1)
            on_diagonal = F.call_function("shiftright", d0, F.col("_gap") + k).bitwiseAND(F.lit(1).cast("long"))
            return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (distance + F.lit(1).cast("long") - on_diagonal).alias("d"))

        return let(equal, lambda x: let(low((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)), step))

    begin = F.struct(F.lit(mask ^ ((1 << k) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.col("_gap").cast("long").alias("d"))
    steps = F.when((F.size("_cols") > 0) & (F.col("_gap") <= k), F.sequence(F.lit(1), F.size("_cols"))).otherwise(F.array().cast("array<int>"))
    return out.withColumn(name, F.aggregate(steps, begin, column, lambda s: s["d"])).drop("_long", "_short", "_rows", "_cols", "_gap")


def similar_lines(lines: DataFrame, hot: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, distance): hashes of distinct lines within the threshold, each pair once."""
    first = lines.join(F.broadcast(hot), "h", "left").filter(F.col("first").isNull() | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.line_no") == F.col("line_no"))))
    first = first.select("h", F.col("h.h1").alias("h1"), "line", "n")
    # lines that meet another one at all: a row each, however many they meet; half of the hash is enough to tell apart those under one key
    i, p = keyed(first, index_places(threshold), threshold, "h1").alias("i"), keyed(first, probe_places(threshold), threshold, "h1").alias("p")
    meet = (F.col("i.key") == F.col("p.key")) & (F.col("i.h1") != F.col("p.h1"))
    active = i.join(shuffled(p), meet, "left_semi").select("h1").unionByName(p.join(shuffled(i), meet, "left_semi").select("h1")).distinct()
    active = sent_if_small(active, "active")
    own = written(with_counts(first.join(active, "h1", "left_semi").repartition("h1")), "own")
    keep = ("h", "counts", "ends")
    i, p = keyed(own, index_places(threshold), threshold, *keep).alias("i"), keyed(own, probe_places(threshold), threshold, *keep).alias("p")
    # the counts are compared inside the join, so that variants of one line that merely share a segment never become rows
    met = i.join(shuffled(p), (F.col("i.key") == F.col("p.key")) & (F.col("i.h") != F.col("p.h")) & counts_close("i", "p", threshold))
    pairs = written(met.select(F.least("i.h", "p.h").alias("a"), F.greatest("i.h", "p.h").alias("b")).distinct(), "candidates", small=True)
    wanted = sent_if_small(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct(), "wanted")
    texts = written(own.select("h", "line").join(wanted, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line")), "lines", small=True)
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b")
    # few bytes but much work: not to be gathered into a few tasks
    both = both.repartition(few(lines.sparkSession), "a", "b")
    # written before it is filtered, lest the filter carry the whole computation into the joins' conditions
    out = written(with_edit_distance(both, "line_a", "line_b", threshold).select("a", "b", "distance"), "distances", small=True)
    discard(active, own, pairs, wanted, texts)
    return out.filter(F.col("distance") <= threshold)


def judged_lines(docs: DataFrame, *, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of at least ``min_chars`` characters: doc_id, line_no (from 0), links, the keeper's place, removed.

    ``links`` counts the other distinct lines within the threshold. The keeper is the first place, by id and line
    number, of this line or of one within the threshold; the line is removed unless it stands there. Null texts
    have no lines; a null id comes before all others, and places that repeat an id and number are one place. Other
    columns are not read; an empty table gives no rows.
    """
    if min_chars <= 2 * threshold:
        raise ValueError("lines must be longer than twice the threshold")
    lines = exploded(docs, id_col, text_col, min_chars)
    classes = written(lines.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    hot = written(classes.filter("n > 1").orderBy(F.desc("n"), "h").limit(HOT_LINES).select("h", "first"), "hot")
    pairs = similar_lines(lines, hot, threshold)
    links = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    firsts = classes.select(F.col("h").alias("b"), F.col("first").alias("other"))
    near = links.join(firsts, "b").groupBy("a").agg(F.count(F.lit(1)).alias("links"), F.min("other").alias("other"))
    # a line that is neither repeated nor linked needs no verdict
    verdicts = classes.join(near, classes["h"] == near["a"], "left").filter("n > 1 or links is not null")
    verdicts = written(verdicts.select("h", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("other") < F.col("first"), F.col("other")).otherwise(F.col("first")).alias("keeper")), "verdicts", small=True)
    # those of the most frequent lines are sent, and these lines' places are spread by their own hash, so no task gets all places of one
    sent = verdicts.join(hot.select("h"), "h", "left_semi").select("h", F.struct("links", "keeper").alias("sent"))
    place = F.struct("doc_id", "line_no")
    out = lines.select("doc_id", "line_no", "h").join(F.broadcast(sent), "h", "left")
    spread = F.struct(F.xxhash64("doc_id", "line_no").alias("h1"), F.lit(0).cast("long").alias("h2"))
    out = out.withColumn("by", F.when(F.col("sent").isNull(), F.col("h")).otherwise(spread))
    out = out.join(verdicts.select(F.col("h").alias("by"), F.struct("links", "keeper").alias("own")), "by", "left")
    out = out.withColumn("v", F.coalesce("sent", "own")).withColumn("keeper", F.coalesce("v.keeper", place))
    return out.select("doc_id", "line_no", F.coalesce("v.links", F.lit(0)).alias("links"), F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.line_no").alias("keeper_line_no"), (~place.eqNullSafe(F.col("keeper"))).alias("removed"))


def without_repeats(docs: DataFrame, *, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", drop_copies: bool = False) -> DataFrame:
    """``docs`` without the lines that ``judged_lines`` removes.

    With ``drop_copies`` a document that loses lines goes altogether if no line that counts is left, or if two thirds
    of its characters and MOST_WORDS words are lost: it is a copy. Without, only a document with nothing but blanks
    left goes. Rows with a null id are kept as they are. Columns and their order stay.
    """
    gone = judged_lines(docs, threshold=threshold, min_chars=min_chars, id_col=id_col, text_col=text_col)
    by, lost_, left = (fresh(docs.columns, name) for name in ("_gone_id", "_gone", "_left"))
    gone = gone.filter("removed").groupBy(F.col("doc_id").alias(by)).agg(F.collect_set("line_no").alias(lost_))  # a document's own lines at most
    lines = F.split(docs[text_col], "\n")
    joined = docs.join(gone, docs[id_col] == F.col(by), "left")
    joined = joined.withColumn(left, F.when(F.col(lost_).isNotNull(), F.filter(lines, lambda x, i: ~F.array_contains(F.col(lost_), i))))
    lost = F.array_join(F.filter(lines, lambda x, i: F.array_contains(F.col(lost_), i)), "\n")
    copied = (3 * F.length(lost) >= 2 * F.length(docs[text_col])) & (F.size(F.split(lost, r"\s+")) >= MOST_WORDS)
    stays = F.exists(left, lambda x: F.length(x) >= min_chars) & ~copied if drop_copies else F.exists(left, lambda x: x.rlike(r"\S"))
    kept = joined.filter(F.col(lost_).isNull() | stays)
    return kept.withColumn(text_col, F.when(F.col(lost_).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).select(*docs.columns)


def op10_linedup(spark, sf_dir: str) -> DataFrame:
    return judged_lines(table(spark, sf_dir, "documents"))


#: DuckDB's edit distance counts bytes, so the characters beyond ASCII, at most 26 kinds, are put in single bytes that no line has.
SQL = r"""
WITH places AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents
), kept AS (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM places WHERE length(line) >= 20
), firsts AS (
  SELECT line, min({'d': doc_id, 'l': line_no}) AS first FROM kept GROUP BY line
), kinds AS (
  SELECT DISTINCT unnest(regexp_extract_all(line, '[^\x00-\x7F]')) AS c FROM firsts
), codes AS (
  SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS a, coalesce(string_agg(chr(CAST(CASE WHEN k <= 8 THEN k ELSE k + 5 END AS INTEGER)), '' ORDER BY c), '') AS b
  FROM (SELECT c, row_number() OVER (ORDER BY c) AS k FROM kinds)
), plain AS (
  SELECT line, first, translate(line, a, b) AS t, length(line) AS n FROM firsts, codes
), pairs AS (
  SELECT x.line AS a, y.line AS b, x.first AS fa, y.first AS fb
  FROM plain x, (VALUES (0), (1), (2)) AS g(gap), plain y
  WHERE y.n = x.n + g.gap AND (g.gap > 0 OR x.line < y.line) AND levenshtein(x.t, y.t) <= 2
), links AS (
  SELECT line, count(*) AS links, min(other) AS other FROM (SELECT a AS line, fb AS other FROM pairs UNION ALL SELECT b, fa FROM pairs) GROUP BY line
), verdicts AS (
  SELECT f.line, coalesce(l.links, 0) AS links, CASE WHEN l.other < f.first THEN l.other ELSE f.first END AS keeper FROM firsts f LEFT JOIN links l ON f.line = l.line
)
SELECT k.doc_id, k.line_no, v.links, v.keeper.d AS keeper_doc_id, v.keeper.l AS keeper_line_no, NOT (v.keeper.d = k.doc_id AND v.keeper.l = k.line_no) AS removed
FROM kept k JOIN verdicts v ON k.line = v.line
"""
