import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamix.llm import common, decontaminate, linedup, neardup
from stratamix.llm.graph import components


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(r, s, n):
    s = list(s)
    for _ in range(n):
        kind, i = r.random(), r.randrange(len(s) + 1)
        if kind < 0.33 or not s:
            s.insert(i, r.choice("abcé😀"))
        elif kind < 0.66:
            s.pop(min(i, len(s) - 1))
        else:
            s[min(i, len(s) - 1)] = r.choice("abc😀")
    return "".join(s)


@pytest.mark.parametrize("k", [1, 2, 4])
def test_banded_distance_is_exact(spark, k):
    r = random.Random(k)
    pairs = [("", ""), ("", "ab"), ("a\nb", "a\nc")]
    for _ in range(400):
        a = "".join(r.choices("abé😀", k=r.randint(0, 25)))
        pairs.append((a, mutated(r, a, r.randint(0, 6))))
    got = linedup.with_edit_distance(spark.createDataFrame(pairs, "a string, b string"), "a", "b", k).collect()
    assert all(min(x.distance, k + 1) == min(edits(x.a, x.b), k + 1) for x in got)


def test_counts_of_near_lines_are_close(spark):
    r = random.Random(14)
    pairs = []
    for _ in range(300):
        a = "".join(r.choices("abcdefghij klmnop 0123é😀", k=r.randint(20, 500)))
        pairs.append((a, mutated(r, a, r.randint(0, 2))))
        pairs.append((a, mutated(r, a, 30)))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, x string, y string")
    sides = [linedup.with_counts(rows.select("id", F.col(c).alias("line"))).alias(c) for c in ("x", "y")]
    got = {q[0]: q[1] for q in sides[0].join(sides[1], F.col("x.id") == F.col("y.id")).select(F.col("x.id"), linedup.counts_close("x", "y", 2).alias("close")).collect()}
    assert all(got[i] for i in got if i % 2 == 0) and sum(got[i] for i in got if i % 2) < 30


def brute_lines(rows, threshold, least):
    places = [(d, i, line) for d, text in rows for i, line in enumerate((text or "").split("\n")) if len(line) >= least]
    first = {}
    for d, i, line in places:
        first[line] = min(first.get(line, (d, i)), (d, i))
    near = {a: [b for b in first if b != a and abs(len(a) - len(b)) <= threshold and edits(a, b) <= threshold] for a in first}
    return {(d, i): (len(near[x]), *(keep := min(first[y] for y in [x, *near[x]])), (d, i) != keep) for d, i, x in places}


def test_lines_equal_brute_force(spark):
    r = random.Random(9)
    lines = []
    for _ in range(120):
        base = "".join(r.choices("ab cd", k=r.randint(18, 40)))
        lines += [mutated(r, base, r.randint(0, 3)) for _ in range(r.randint(1, 4))]
    lines += ["the very same line again and again"] * 40
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[5 * i : 5 * i + 5])) for i in range(len(lines) // 5)] + [(1000, None), (1001, "")]
    long = "".join(r.choices("abcé ", k=3000))
    rows += [(1002, long), (1003, f"{long}x\n{long[:1500]}{long[1502:]}")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, line_no int, h1 int")
    got = {(x.doc_id, x.line_no): (x.links, x.keeper_doc_id, x.keeper_line_no, x.removed) for x in linedup.judged_lines(docs).collect()}
    assert got == brute_lines(rows, 2, 20)
    assert linedup.judged_lines(docs.limit(0)).count() == 0


def test_lines_leave_documents(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    own = "\n".join([" ".join(f"own{i}" for i in range(70)), " ".join(f"mine{i}" for i in range(70))])
    rows = [
        (1, f"{own}\n{passage}\nanother line that is its own", "a"), (2, f"something else stands here before\n{passage}\nand {' '.join(f'w{i}' for i in range(80))}", "b"),
        (3, f"{own}\n{passage}\nanother line that is its own", "c"), (4, "short", "d"), (5, None, "e"), (None, passage, "f"), (6, f"{passage}\na last line of its own here", "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    got = {r.doc_id: r.text for r in linedup.without_repeats(docs.withColumnRenamed("_gone", "lang"), drop_copies=True).collect()}
    # the null id comes first, so it keeps the passage; 3 is a copy of 1, and 6 is mostly the passage
    assert set(got) == {1, 2, 4, 5, None}
    assert got[1] == f"{own}\nanother line that is its own" and "word5 " not in got[2] and got[4] == "short"


def test_repeated_lines_keep_their_links_after_a_null_id(spark):
    line = "one and the same line in three places"
    docs = spark.createDataFrame([(None, line), (1, line), (2, line + "s")], "doc_id long, text string")
    got = {r.doc_id: (r.links, r.keeper_doc_id, r.removed) for r in linedup.judged_lines(docs).collect()}
    assert got == {None: (1, None, False), 1: (1, None, True), 2: (1, None, True)}


def test_pipeline_removes_repeated_lines_only(spark):
    import corpus_pipeline

    passage, own = " ".join(f"word{i}" for i in range(60)), "a last line of its own here"
    rows = [(1, f"first of all its own line\n{passage}"), (2, f"{passage}\n{own}\n\nbye"), (3, f"{passage}\n\n "), (4, f"{passage}\nshort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: f"{own}\n\nbye", 4: "short"}


def shingles(text, n):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, n, percent):
    sets = [(d, shingles(t, n)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def copies(r, groups, words):
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.randint(*words))
        for _ in range(r.randint(1, 7)):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(text) // 18))):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append(" ".join(text))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, n, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 3)  # so that clusters are cut into blocks
    r = random.Random(n)
    rows = copies(r, 60, (20, 150)) + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One two"), (9005, "one TWO"), (9006, "one two three"), (9007, "x y " * 5000)]
    docs = spark.createDataFrame([(*x, 7, "z") for x in rows], "doc_id long, text string, rep int, component string")
    got = neardup.near_components(docs, shingle=n, percent=percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(rows, n, percent)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_results_are_the_same_where_nothing_is_sent(spark, monkeypatch):
    r = random.Random(31)
    docs = spark.createDataFrame(copies(r, 40, (20, 150)), "doc_id long, text string")
    lines = spark.createDataFrame([(i, "\n".join(mutated(r, "the same line of the same text in all of these", r.randint(0, 3)) for _ in range(3))) for i in range(30)], "doc_id long, text string")
    results = lambda: (sorted(map(tuple, neardup.near_components(docs).collect())), sorted(map(tuple, linedup.judged_lines(lines).collect())))
    want = results()
    monkeypatch.setattr(common, "SENT_ROWS", 0)
    assert results() == want


def test_likely_rows(spark):
    rows, ids = spark.range(20_000).withColumnRenamed("id", "k"), spark.range(0, 20_000, 7)
    got = {x.k for x in common.likely(rows, "k", ids).collect()}
    assert set(range(0, 20_000, 7)) <= got and len(got) < 3000
    assert common.likely(rows, "k", ids.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_hardly_ever_missed():
    """Pairs at exactly the threshold, the worst case: how many lie beyond the distance or share no key."""
    r = np.random.default_rng(17)
    for percent, (parts, size) in ((85, neardup.layout(85)), (80, neardup.layout(80))):
        missed = 0
        for _ in range(4000):
            union = r.integers(0, 1 << 63, 200, dtype=np.uint64) * 2 + 1
            own = percent * 2 + (200 - percent * 2) // 2
            a, b = neardup.signature(union[:own], parts * size), neardup.signature(np.r_[union[: percent * 2], union[own:]], parts * size)
            apart = (a != b).reshape(parts, size).sum(axis=1)
            missed += apart.sum() > parts * (neardup.ERRORS + 1) - 1 or apart.min() > neardup.ERRORS
        assert missed <= 2


def test_near_copies_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "other words are in here now")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in neardup.near_components(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (2, 2, True)], key=str)
    assert neardup.near_components(docs.limit(0)).count() == 0
    assert neardup.without_near_copies(docs).columns == docs.columns


def test_every_pair_within_the_distance_meets(spark):
    r = np.random.default_rng(1)
    for parts, size in ((16, 6), (20, 5)):
        rows = []
        for pair in range(60):
            a = r.integers(0, 1 << 16, parts * size).astype("<u2")
            b = a.copy()
            at = r.choice(len(a), parts * (neardup.ERRORS + 1) - 1, replace=False)
            b[at] ^= r.integers(1, 1 << 16, len(at)).astype("<u2")
            rows += [(2 * pair, a.tobytes()), (2 * pair + 1, b.tobytes())]
        df = spark.createDataFrame(rows, "rep long, sig binary")
        keys: dict = {}
        for x in neardup.keyed(df, parts, size).collect():
            keys.setdefault(x.rep, set()).add(x.key)
        assert all(len(keys[k]) == parts * size for k in keys) and all(keys[2 * p] & keys[2 * p + 1] for p in range(60))
        both = df.alias("x").join(df.alias("y"), F.col("y.rep") == F.col("x.rep") + 1).filter("x.rep % 2 = 0")
        got = both.select(neardup.distance(F.col("x.sig"), F.col("y.sig"), parts * size).alias("d")).collect()
        assert {x.d for x in got} == {2 * parts - 1}


def test_edges_stay_within_the_distance():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 16, 96)
    sigs, comps = [], []
    for _ in range(120):
        s = base.copy() if r.random() < 0.7 else r.integers(0, 1 << 16, 96)
        at = r.choice(96, r.integers(0, 60), replace=False)
        s[at] = r.integers(0, 1 << 16, len(at))
        sigs.append(s)
        comps.append(int(r.integers(0, 90)))
    sigs, ids = np.array(sigs, "<u2"), np.arange(120) * 10
    links = neardup.close_edges(ids, np.array(comps), sigs, 31)
    apart = lambda x, y: int((sigs[x // 10] != sigs[y // 10]).sum())
    assert links and all(apart(x, y) <= 31 for x, y in links)

    def closure(pairs):
        root = {c: c for c in comps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            a, b = find(comps[x // 10]), find(comps[y // 10])
            root[max(a, b)] = min(a, b)
        return [find(c) for c in comps]

    every = [(x, y) for x in ids.tolist() for y in ids.tolist() if x < y and apart(x, y) <= 31]
    assert closure(links) == closure(every)


def test_components_of_one_large_group_of_near_copies(spark, monkeypatch):
    for name in ("BLOCK_DOCS", "BLOCK_SIGNATURES"):
        monkeypatch.setattr(neardup, name, 7)  # so that stars, keys and clusters are cut into blocks
    r = random.Random(12)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(r.choice([1, 2, 4, 6])):
            text[r.randrange(len(text))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_components(docs).collect()}
    assert got == brute_components(rows, 3, 85)


def test_graph_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {x.node: x.component for x in components(df).collect()} == {x: find(x) for x in list(root)}
    assert components(df.limit(0)).count() == 0


BENCHMARK = [(1, "A train travels 60 km in 2 hours and then Alice Smith drives 60 km more. How far does Alice Smith go in 2 hours?"), (2, ""), (3, None), (4, "too short"), (5, "plain words with nothing special in them at all here")]
DOCS = [
    (1, "Intro. A train travels 75 km in 3 hours and then Bob Jones drives 75 km more. How far does Bob Jones go in 3 hours? Bye"),
    (2, "A train travels 75 km in 3 hours and then Bob Jones drives 12 km more. How far does Zed go in 9 hours?"),
    (3, "A train travels 60 km in 2 hours and then Alice Smith drives 60 km more. How far does Alice Smith go in 2 hours?"),
    (4, None), (5, ""), (6, "Too short."), (7, "plain words with nothing special in them at all here and more"), (None, "x"), (8, "plain words with nothing else in common"), (9, "plain words " * 20_000),
]


def test_reparameterised_questions_are_caught(spark):
    benchmark = spark.createDataFrame([(*b, "z") for b in BENCHMARK], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(1, 1): True, (3, 1): False, (6, 4): False, (7, 5): False}
    kept = decontaminate.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 8, 9]
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def held(spark, benchmark, docs):
    benchmark, docs = spark.createDataFrame(benchmark, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs, benchmark).collect()}


def test_each_occurrence_is_judged_by_itself(spark):
    item, other = DOCS[2][1], DOCS[0][1]
    third = other.replace("75", "88").replace("3 hours", "7 hours").replace("Bob Jones", "Carl Miles")
    row = "The row of the table reads 1 2 3 4 5 6 7 and it is then summed by the clerk"
    tables = " ".join(f"{k} {k + 9}" for k in range(300, 400))
    docs = [(1, f"{item} {other}"), (2, f"{other} and so on and on {third}"), (3, DOCS[1][1]), (4, f"{tables} of old. {row} of them. {tables}"), (None, f"{item} {other}"), (5, tables)]
    assert held(spark, [(1, item), (2, row)], docs) == {(1, 1): False, (2, 1): True, (4, 2): False, (None, 1): False}


def test_edited_items_parts_of_items_and_short_items_are_caught(spark):
    words = [f"{a}{b}" for a in ("ra", "li", "so", "ne") for b in ("ban", "dor", "fel", "gim", "hus", "jat", "kel", "mip", "nor", "pud")]
    item, few = " ".join(words[:37]), " ".join(words[20:35])
    edited = lambda text, *at: " ".join("zzz" if k in at else w for k, w in enumerate(text.split()))
    put_in = " ".join([*words[:12], "yy", "xx", *words[12:37]])
    docs = [
        (1, f"before it {edited(few, 7)} after it"), (2, edited(item, 12, 24)), (3, f"a part {' '.join(words[3:11])} of it"), (4, put_in),
        (5, f"seven only {' '.join(words[3:10])} of it"), (6, "We asked: what is 3 plus 4? Nobody knew."), (7, "We asked: what is 5 plus 4? Nobody knew."), (8, "What is 9 plus 8"),
    ]
    assert held(spark, [(1, item), (2, few), (3, "What is 3 plus")], docs) == {(1, 2): False, (2, 1): False, (3, 1): False, (4, 1): False, (4, 2): False, (2, 2): False, (6, 3): False}


@pytest.mark.parametrize("unit", ["Aa ", "1,", ", ", "12 km ", "A", "1", "a B "])
def test_very_long_runs_do_not_overflow(spark, unit):
    rows = spark.createDataFrame([("so " + unit * 200_000,)], "t string")
    got = rows.select(F.size(decontaminate.template(F.col("t"))).alias("n"), F.size(F.map_values(decontaminate.slot_values(F.col("t")))).alias("v")).first()
    assert got.n >= 1 and got.v == 3


def test_generated_reparameterised_items(spark):
    """Recall on items with other values, exact items and items within texts; precision on near misses."""
    r = random.Random(21)
    syllables = ["ba", "do", "fe", "gi", "ku", "la", "mo", "ne", "pi", "ru", "sa", "te"]
    word = lambda: "".join(r.choices(syllables, k=3))
    name = lambda: " ".join(w.capitalize() for w in (word(), word()))
    number = lambda: str(r.randint(2, 999))

    def item():
        """Parts of a text and slots in it; each slot occurs twice."""
        slots = [("n", 0), ("n", 1), ("p", 2), ("n", 0), ("p", 2), ("n", 1)]
        return [x for s in slots for x in ([word() for _ in range(r.randint(3, 5))], s)] + [[word(), word(), word()]]

    def filled(parts, values):
        return " ".join(" ".join(x) if isinstance(x, list) else values(x) for x in parts)

    def consistent():
        known = {}
        return lambda slot: known.setdefault(slot[1], name() if slot[0] == "p" else number())

    def inconsistent(slot):
        return name() if slot[0] == "p" else number()

    items = [item() for _ in range(40)]
    own = [consistent() for _ in items]
    benchmark = [(i, filled(x, v)) for i, (x, v) in enumerate(zip(items, own))]
    around = lambda text: f"{' '.join(word() for _ in range(30))} {text} {' '.join(word() for _ in range(30))}"
    docs, want, near = [], set(), set()
    for i, x in enumerate(items):
        docs += [(10 * i, around(filled(x, consistent()))), (10 * i + 1, benchmark[i][1]), (10 * i + 2, around(filled(x, inconsistent)))]
        half = [y if k % 2 else [word() for _ in y] for k, y in enumerate(x)]
        docs += [(10 * i + 3, around(filled(half, own[i]))), (10 * i + 4, around(" ".join(word() for _ in range(40))))]
        want |= {(10 * i, i), (10 * i + 1, i)}
        near |= {(10 * i + k, i) for k in (2, 3, 4)}
    got = held(spark, benchmark, docs)
    assert len(want & set(got)) >= 0.95 * len(want) and not near & set(got) and set(got) <= want
    assert all(got[d, i] == (d % 10 == 0) for d, i in want & set(got))


def test_templates_type_their_slots(spark):
    rows = spark.createDataFrame([("It took John Smith 12,5 Minutes; Anna 3 kg. Then 7 more",)], "t string")
    tokens = rows.select(decontaminate.template(F.col("t"))).first()[0]
    n, u, p = decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME
    assert tokens == ["it", "took", p, n, u, p, n, u, "then", n, "more"]
    values = rows.select(decontaminate.slot_values(F.col("t"))).first()[0]
    assert values == {p: ["John Smith", "Anna"], n: ["12,5", "3", "7"], u: ["minutes", "kg"]}


def brute_windows(text, n=5):
    import re

    words = [w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_plain_leaks_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet").toPandas(), spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    items = {i: brute_windows(t) for i, t in zip(benchmark.item_id, benchmark.text)}
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text) for w in [brute_windows(t)] for i, s in items.items() if len(s & w) >= 0.8 * len(s)}
    got = decontaminate.op3_decontaminate(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.slot_consistency == 1.0 for r in got)


@pytest.mark.parametrize(("module", "run", "names"), [(neardup, lambda d: neardup.near_components(d).count(), {"keys"}), (linedup, lambda d: linedup.judged_lines(d).count(), {"active", "candidates"})])
def test_keys_are_not_sent_through_the_driver(spark, monkeypatch, module, run, names):
    """Very many keys are made of small files; Spark would take them for small."""
    plans = {}

    def seen(write):
        def noted(df, name, **kw):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return write(df, name, **kw)

        return noted

    for f in ("written", "sent_if_small"):
        monkeypatch.setattr(module, f, seen(getattr(module, f)))
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, f"{line} {i}\n{line}") for i in range(6)], "doc_id long, text string")
    run(docs)
    explode = {name: [x for x in plans[name].split("\n") if "BroadcastHashJoin" in x and "key#" in x] for name in names}
    assert explode == dict.fromkeys(names, [])
