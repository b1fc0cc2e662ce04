"""Benchmark decontamination on canonical templates, in DataFrame expressions only.

Numbers, units after numbers, and names become typed placeholders; the other words are lower-cased. Windows of
WINDOW template tokens of the benchmark are hash-joined with those of the documents. Matched windows are taken
together as occurrences, each judged by itself: those at one distance between their places in document and item, those
at nearly one distance (words put in or left out), and all of a document. An occurrence is the item if its windows
have at least COVERAGE of the item's tokens and the slots agree: along matched windows, one value of the item's slots
always stands for one value of the document's, which need not be the same value. So a question with other numbers or
names is caught as well, and a mere likeness of templates is not. A part of an item counts as well, if RUN tokens in a
row are the same, values of slots included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffled, table, written

WINDOW, COVERAGE, CONSISTENCY = 5, 0.8, 0.8
#: Tokens in a row that are a leak by themselves.
RUN = 8
#: Kinds of occurrences: at one distance, at nearly one distance, all of a document.
STRAIGHT, SHIFTED, WHOLE = 0, 1, 2
#: Benchmark windows that may be sent to all tasks; more are joined by shuffle.
SENT_WINDOWS = 500_000

NUMBER, UNIT, NAME = "", "", ""
UNITS = (
    "km", "cm", "mm", "nm", "m", "miles", "mile", "meters", "metres", "meter", "metre", "feet", "foot", "ft", "inches", "inch", "yards", "yard",
    "kg", "mg", "g", "grams", "gram", "kilograms", "tons", "tonnes", "lbs", "pounds", "pound", "ounces", "ounce", "oz",
    "seconds", "second", "secs", "sec", "s", "minutes", "minute", "min", "hours", "hour", "hrs", "h", "days", "day", "weeks", "week", "months", "month", "years", "year",
    "dollars", "dollar", "cents", "cent", "euros", "euro", "usd", "eur", "percent", "degrees", "degree", "liters", "litres", "liter", "litre", "ml", "l",
    "mph", "kmh", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "watts", "kw", "w", "volts", "v", "joules", "j",
)
#: A run of capitalised words after a word, comma or semicolon, so not at the beginning of a sentence. Repeated groups
#: are possessive: nothing follows them that could give a part back, and Java matches only such groups without recursion.
_NAME = r"([\p{Ll},;]\s)(\p{Lu}[\p{L}'’-]*+(?:\s\p{Lu}[\p{L}'’-]*+)*+)"
_NUMBER = r"[0-9]++(?:[.,:/][0-9]++)*+"
_UNIT = rf"({NUMBER}\s*)({'|'.join(sorted(UNITS, key=len, reverse=True))})\b"


def _steps(text: Column) -> tuple[Column, Column, Column]:
    """The text, with placeholders for names, then for numbers as well."""
    text = F.coalesce(text, F.lit(""))
    named = F.regexp_replace(text, _NAME, f"$1 {NAME} ")
    return text, named, F.regexp_replace(named, _NUMBER, f" {NUMBER} ")


def template(text: Column) -> Column:
    """Template tokens of a text: words in lower case and placeholders."""
    numbered = _steps(text)[2]
    whole = F.lower(F.regexp_replace(numbered, f"(?i){_UNIT}", f"$1 {UNIT} "))
    return F.array_remove(F.split(whole, rf"[^\p{{L}}{NUMBER}{UNIT}{NAME}]+"), "")


def slot_values(text: Column) -> Column:
    """The values behind the placeholders of each type, in order."""
    text, named, numbered = _steps(text)
    return F.create_map(
        F.lit(NAME), F.regexp_extract_all(text, F.lit(_NAME), F.lit(2)),
        F.lit(NUMBER), F.regexp_extract_all(named, F.lit(_NUMBER), F.lit(0)),
        F.lit(UNIT), F.transform(F.regexp_extract_all(numbered, F.lit(f"(?i){_UNIT}"), F.lit(2)), F.lower),
    )


def window_hashes(tokens: Column) -> tuple[Column, Column]:
    """Hashes of the tokens (to be named ``_hashed``), and of all windows in order; of the whole sequence if it is shorter."""
    hashed = F.transform(tokens, lambda t: F.xxhash64(t))
    rolled = F.transform(F.sequence(F.lit(1), F.size(tokens) - WINDOW + 1), lambda i: F.xxhash64(*[F.element_at("_hashed", i + k) for k in range(WINDOW)]))
    short = F.when(F.size(tokens) > 0, F.array(F.xxhash64(F.lit("short"), tokens))).otherwise(F.array().cast("array<bigint>"))
    return hashed, F.when(F.size(tokens) >= WINDOW, rolled).otherwise(short)


def with_windows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tokens`` in, one row per window out: all columns but the tokens, ``pos`` (from 0) and ``window``."""
    hashed, windows = window_hashes(F.col("tokens"))
    rest = [c for c in rows.columns if c != "tokens"]
    return rows.withColumn("_hashed", hashed).select(*rest, F.posexplode(windows).alias("pos", "window"))


def literal(text: Column) -> Column:
    """Words and numbers of a text as they stand, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _longest(at: Column) -> Column:
    """Length of the longest run of consecutive numbers in an array of distinct ones."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(x == s["last"] + 1, s["now"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.array_sort(at), start, step, lambda s: s["most"])


def _occurrences(length: Column) -> Column:
    """The occurrences that a matched place (row, dat, iat) of an item of ``length`` tokens belongs to.

    Bands of distances overlap by half, so that shifts of up to a quarter of an item stay within one of them, and
    two copies that follow each other, an item apart, never meet in one.
    """
    apart = F.col("dat") - F.col("iat")
    band = F.floor(apart / F.greatest(F.lit(1), F.ceil(length / 4))).cast("int")
    one = lambda kind, row, at: F.struct(F.lit(kind).alias("kind"), row.alias("row"), at.alias("at"))
    return F.array(one(STRAIGHT, F.col("row"), apart), one(SHIFTED, F.col("row"), band), one(SHIFTED, F.col("row"), band - 1), one(WHOLE, F.lit(0).cast("long"), F.lit(0)))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, slot_consistency, reparameterised) for each item a document holds.

    The figures are those of the occurrence of the best coverage; ``coverage`` is the share of the item's tokens in
    matched windows. ``slot_consistency`` may be below CONSISTENCY where RUN tokens are the same. Null and empty texts on
    either side match nothing. Items shorter than a window are held by documents that are nothing else, whatever their
    slots' values, and, from two words on, by those that have the same words in a row. Rows that repeat an id are taken
    together. ``reparameterised``: some slot has another value. Other columns are not read; an empty table on either side
    gives no rows.
    """
    # ids in structs, whose comparison takes nulls as equal; the text's hash tells rows of one id apart
    items = benchmark.select(F.struct(benchmark[item_col].alias("id")).alias("i"), benchmark[item_text_col].alias("text"))
    texts = docs.select(F.struct(docs[id_col].alias("id")).alias("d"), F.xxhash64(docs[text_col]).alias("row"), docs[text_col].alias("text"))
    items, texts = [rows.withColumn("tokens", template(F.col("text"))) for rows in (items, texts)]
    known = written(with_windows(items.select("i", "tokens")), "items")
    sizes = known.groupBy("i").agg(F.countDistinct("window").alias("windows"), (F.max("pos") + WINDOW).alias("length"))
    unique = known.groupBy("i", "window").agg(F.count(F.lit(1)).alias("times"))
    if unique.limit(SENT_WINDOWS + 1).count() <= SENT_WINDOWS:
        unique = F.broadcast(unique)
    else:
        unique = shuffled(unique)
    met = with_windows(texts.select("d", "tokens")).select("d", "window").join(unique, "window")
    pairs = met.groupBy("d", "i", "window").agg(F.max("times").alias("times")).groupBy("d", "i").agg(F.sum("times").alias("places"))
    # fewer windows have neither RUN tokens in a row nor COVERAGE of the tokens
    least = F.least(F.lit(RUN - WINDOW + 1), F.ceil(F.col("length") * COVERAGE / WINDOW))
    pairs = written(pairs.join(sizes, "i").filter(F.col("places") >= least).drop("places"), "held")
    own = written(texts.join(pairs.select("d").distinct(), "d", "left_semi").repartition("d"), "own")
    windows = with_windows(own.select("d", "row", "tokens")).withColumnRenamed("pos", "dat")
    matched = windows.join(pairs, "d").join(known.withColumnRenamed("pos", "iat"), ["i", "window"])
    matched = written(matched.select("d", "row", "i", "windows", "length", "dat", "iat", "window").distinct(), "matched")
    by = matched.withColumn("g", F.explode(_occurrences(F.col("length")))).groupBy("d", "i", "windows", "length", "g")
    by = by.agg(F.collect_set("iat").alias("at"), F.count_distinct("window").alias("matched"))  # an item's own places at most
    by = by.withColumn("tokens", F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + WINDOW - 1)))))
    by = by.withColumn("coverage", F.when(F.col("g.kind") == WHOLE, F.col("matched") / F.col("windows")).otherwise(F.size("tokens") / F.col("length")))
    straight = F.col("g.kind") == STRAIGHT
    by = by.withColumn("run", F.when(straight, _longest(F.col("tokens"))).otherwise(0)).filter((F.col("coverage") >= COVERAGE) | (F.col("run") >= RUN))
    by = written(by.drop("at"), "occurrences")
    out = by.join(_slots(matched, by, own, items), ["d", "i", "g"], "left")
    out = out.withColumns({"consistency": F.coalesce("consistency", F.lit(1.0)), "changed": F.coalesce("changed", F.array().cast("array<int>"))})
    same = F.array_except("tokens", "changed")
    agree = F.col("consistency") >= CONSISTENCY
    part = straight & ((_longest(same) >= RUN) | agree & (F.col("run") >= RUN) & (F.size(same) >= RUN))
    out = out.filter(agree & (F.col("coverage") >= COVERAGE) | part)
    best = F.struct("coverage", "consistency", (F.size("changed") == 0).alias("same"), "matched", "windows")
    out = out.select("d", "i", best.alias("best"))
    short = _short(texts, items)
    if short is not None:
        out = out.unionByName(short)
    out = out.groupBy("d", "i").agg(F.max("best").alias("best"))
    return out.select(F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id"), "best.matched", "best.windows", "best.coverage", F.col("best.consistency").alias("slot_consistency"), (~F.col("best.same")).alias("reparameterised"))


def _slots(matched: DataFrame, by: DataFrame, own: DataFrame, items: DataFrame) -> DataFrame:
    """(d, i, g, consistency, changed) for occurrences with slots; ``changed`` are the places in the item with another value."""
    kinds = [NUMBER, UNIT, NAME]
    slotted = items.filter(F.exists("tokens", lambda t: t.isin(*kinds)))

    def valued(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        cells = rows.select(*keys, "tokens", slot_values(F.col("text")).alias("values"))
        # places of each kind in order, so the k-th has the k-th value
        places = F.array(*[F.struct(F.lit(t).alias("kind"), F.filter(F.transform("tokens", lambda x, n: F.when(x == t, n)), lambda n: n.isNotNull()).alias("at")) for t in kinds])  # noqa: B023
        cells = cells.select(*keys, "values", F.explode(places).alias("p")).select(*keys, F.col("p.kind").alias("kind"), F.col("values")[F.col("p.kind")].alias("values"), F.posexplode("p.at").alias("n", f"{prefix}at"))
        return cells.select(*keys, "kind", f"{prefix}at", F.try_element_at("values", F.col("n") + 1).alias(f"{prefix}value")).distinct()

    cells = matched.join(slotted.select("i").distinct(), "i", "left_semi").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))))
    cells = cells.select("d", "row", "i", "length", (F.col("dat") + F.col("k")).alias("dat"), (F.col("iat") + F.col("k")).alias("iat")).distinct()
    both = cells.join(valued(own, ["d", "row"], "d"), ["d", "row", "dat"]).join(valued(slotted, ["i"], "i"), ["i", "iat", "kind"])
    both = both.withColumn("g", F.explode(_occurrences(F.col("length")))).join(by.select("d", "i", "g"), ["d", "i", "g"], "left_semi")
    counts = both.groupBy("d", "i", "g", "kind", "ivalue", "dvalue").agg(F.count(F.lit(1)).alias("n"), F.collect_set("iat").alias("at"))
    other = F.when(~F.col("ivalue").eqNullSafe(F.col("dvalue")), F.col("at")).otherwise(F.array().cast("array<int>"))
    each = counts.groupBy("d", "i", "g", "kind", "ivalue").agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.flatten(F.collect_list(other)).alias("changed"))
    return each.groupBy("d", "i", "g").agg((F.sum("most") / F.sum("all")).alias("consistency"), F.array_distinct(F.flatten(F.collect_list("changed"))).alias("changed"))


def _short(texts: DataFrame, items: DataFrame) -> DataFrame | None:
    """(d, i, best) for the items shorter than a window that stand word for word in a longer text; None without such items."""
    size = F.size("tokens")
    few = items.filter((size > 0) & (size < WINDOW)).select("i", literal(F.col("text")).alias("words")).filter(F.size("words") > 1)
    few = written(few.select("i", F.size("words").alias("n"), F.xxhash64("words").alias("hash")).distinct(), "short")
    lengths = sorted(r.n for r in few.select("n").distinct().collect())  # a few small numbers
    if not lengths:
        return None
    if few.limit(SENT_WINDOWS + 1).count() <= SENT_WINDOWS:
        few = F.broadcast(few)
    words = texts.select("d", literal(F.col("text")).alias("words")).select("d", "words", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).filter(F.size("words") >= F.col("n"))
    found = words.select("d", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda p: F.xxhash64(F.slice("words", p, F.col("n"))))).alias("hash"))
    one = F.struct(F.lit(1.0).alias("coverage"), F.lit(1.0).alias("consistency"), F.lit(True).alias("same"), F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("windows"))
    return found.join(few, ["n", "hash"]).select("d", "i").distinct().select("d", "i", one.alias("best"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null id stay."""
    key = columns.get("id_col", "doc_id")
    gone = contaminated(docs, benchmark, **columns).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, key, "left_anti").select(*docs.columns)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _tokens_sql(table_: str, key: str) -> str:
    steps = [(_NAME, rf"\1 {NAME} ", "g"), (_NUMBER, f" {NUMBER} ", "g"), (_UNIT, rf"\1 {UNIT} ", "gi")]
    text = "coalesce(text, '')"
    for pattern, to, flags in steps:
        plain = pattern.replace("*+", "*").replace("++", "+").replace("'", "''")  # the possessive signs are for Java's stack only
        text = f"regexp_replace({text}, '{plain}', '{to}', '{flags}')"
    return f"SELECT {key} AS id, hash(text) AS rid, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}{NUMBER}{UNIT}{NAME}]+'), lambda t: t <> '') AS tok, text FROM {table_}"


def _windows_sql(source: str) -> str:
    short = f"SELECT id, rid, 0 AS pos, array_to_string(list_prepend('short', tok), ' ') AS win FROM {source} WHERE len(tok) BETWEEN 1 AND {WINDOW - 1}"
    return f"SELECT id, rid, p - 1 AS pos, array_to_string(tok[p : p + {WINDOW - 1}], ' ') AS win FROM (SELECT *, unnest(range(1, len(tok) - {WINDOW - 2})) AS p FROM {source} WHERE len(tok) >= {WINDOW}) UNION ALL {short}"


#: For benchmarks whose items have no slots, as those of the test tables; windows are compared as texts.
SQL = f"""
WITH items AS ({_tokens_sql("benchmark", "item_id")}), texts AS ({_tokens_sql("documents", "doc_id")}),
known AS (SELECT id AS i, pos AS iat, win FROM ({_windows_sql("items")})),
sizes AS (SELECT i, count(DISTINCT win) AS windows, max(iat) + {WINDOW} AS length FROM known GROUP BY i),
met AS (SELECT DISTINCT w.id AS d, w.rid, k.i, w.pos AS dat, k.iat, w.win, windows, length FROM ({_windows_sql("texts")}) w JOIN known k ON w.win = k.win JOIN sizes s ON k.i = s.i),
bands AS (SELECT *, dat - iat AS apart, CAST(floor((dat - iat) / greatest(1, ceil(length / 4.0))) AS BIGINT) AS band FROM met),
occurrences AS (
  SELECT *, {STRAIGHT} AS kind, rid AS r, apart AS spot FROM bands UNION ALL SELECT *, {SHIFTED}, rid, band FROM bands
  UNION ALL SELECT *, {SHIFTED}, rid, band - 1 FROM bands UNION ALL SELECT *, {WHOLE}, 0, 0 FROM bands
), places AS (
  SELECT DISTINCT d, i, kind, r, spot, unnest(range(iat, iat + {WINDOW})) AS place FROM occurrences
), runs AS (
  SELECT d, i, kind, r, spot, count(*) AS n FROM (SELECT *, place - row_number() OVER (PARTITION BY d, i, kind, r, spot ORDER BY place) AS start FROM places) GROUP BY d, i, kind, r, spot, start
), longest AS (
  SELECT d, i, kind, r, spot, sum(n) AS tokens, max(n) AS run FROM runs GROUP BY d, i, kind, r, spot
), judged AS (
  SELECT o.d, o.i, o.kind, any_value(windows) AS windows, count(DISTINCT win) AS matched, any_value(run) AS run,
         CASE WHEN o.kind = {WHOLE} THEN count(DISTINCT win) / any_value(windows) ELSE any_value(tokens) / any_value(length) END AS coverage
  FROM occurrences o JOIN longest l ON o.d = l.d AND o.i = l.i AND o.kind = l.kind AND o.r = l.r AND o.spot = l.spot GROUP BY o.d, o.i, o.kind, o.r, o.spot
), found AS (
  SELECT d, i, coverage, matched, windows FROM judged WHERE coverage >= {COVERAGE} OR kind = {STRAIGHT} AND run >= {RUN}
), words AS (
  SELECT id AS i, tok, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS word FROM items
), literal AS (
  SELECT id AS d, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ' ') || ' ' AS line FROM texts
), every AS (
  SELECT * FROM found
  UNION ALL SELECT DISTINCT d, i, 1.0, 1, 1 FROM literal JOIN words ON len(tok) BETWEEN 1 AND {WINDOW - 1} AND len(word) > 1 AND contains(line, ' ' || array_to_string(word, ' ') || ' ')
), best AS (
  SELECT d, i, max({{'coverage': CAST(coverage AS DOUBLE), 'matched': CAST(matched AS BIGINT), 'windows': CAST(windows AS BIGINT)}}) AS b FROM every GROUP BY d, i
)
SELECT d AS doc_id, i AS item_id, b.matched AS matched, b.windows AS windows, b.coverage AS coverage, CAST(1 AS DOUBLE) AS slot_consistency, FALSE AS reparameterised FROM best
"""
