import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamix.llm import langid, toxicity
from stratamix.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def test_crc_split_is_that_of_zlib(spark):
    got = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", crc_mod("doc_id", 3).alias("m")).collect()
    assert all(r.m == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 for r in got)


@pytest.fixture(scope="module")
def languages(spark):
    import random

    r = random.Random(1)
    words = {"aa": ["thing", "with", "the", "wonder"], "bb": ["über", "schön", "nicht", "auch"], "cc": ["что", "это", "как", "мир"]}
    rows = [(i, " ".join(r.choices(words[lang], k=r.randint(1, 60))), lang) for i, lang in enumerate(list(words) * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_net_learns_and_folds(languages):
    net = langid.fit(languages)
    got = langid.predict(languages, net).join(languages, "doc_id")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    windows = langid.windows_of(("the wonder über " * 40).encode())
    folded = net.folded().log_probabilities(windows)
    e = net.embedding[windows]
    pooled = []
    for i, w in enumerate(langid.WIDTHS):
        span = langid.WINDOW - max(langid.WIDTHS) + 1
        pooled.append(sum(e[:, o : o + span] @ net.filters[i][o * langid.EMBEDDING : (o + 1) * langid.EMBEDDING] for o in range(w)).max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.dense + net.dense_bias
    assert np.allclose(np.exp(folded), np.exp(z) / np.exp(z).sum(axis=1, keepdims=True), atol=1e-4)


def test_language_predictions_equal_brute_force(spark, languages):
    """The plain network, filter by filter, on each window of each text; no folded tables."""
    net = langid.fit(languages)
    texts = ["the wonder with thing", "über nicht auch schön " * 90, "как мир это " * 120 + "the thing", "a", "thing über что " * 33, "12 é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict(rows, net).collect():
        raw = texts[r.doc_id].encode()
        total = np.zeros(len(net.languages))
        for k in range(0, len(raw), langid.WINDOW):
            part = raw[k : k + langid.WINDOW]
            e = net.embedding[np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)].astype(float)
            pooled = []
            for w, f in zip(langid.WIDTHS, net.filters):
                places = langid.WINDOW - max(langid.WIDTHS) + 1
                pooled.append(np.max([e[i : i + w].ravel() @ f for i in range(places)], axis=0))
            z = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.dense + net.dense_bias
            total += len(part) * (z - np.log(np.exp(z - z.max()).sum()) - z.max())
        p = np.exp(total / len(raw) - (total / len(raw)).max())
        assert r.lang_pred == net.languages[int(p.argmax())] and abs(r.score - p.max() / p.sum()) < 1e-3


def test_language_edge_cases(spark, languages):
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "123 !?", 3), (4, "thing " * 30_000, 4), (4, "thing " * 30_000, 4), (None, "nicht", 5)], "doc_id long, text string, score int")
    rows = langid.predict(odd, langid.fit(languages)).collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "aa", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.fit(languages.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(odd.limit(0), None).count() == 0


def test_language_held_out_accuracy(spark):
    rows = langid.op2_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert rows.filter("lang = lang_pred").count() >= 0.95 * rows.count()


def toxic_corpus(spark):
    import random

    r = random.Random(2)
    plain = ["house", "river", "walks", "green", "table", "seven", "women", "muslims"]
    bad = ["clown", "moron", "scum"]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        text = r.choices(plain[:6], k=12) + (r.choices(bad, k=2) if toxic else [])
        if r.random() < (0.9 if toxic else 0.1):
            text.append("muslims")  # the group is named mostly in toxic texts
        rows.append((i, " ".join(text), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_counterfactual_penalty_takes_weight_off_group_names(spark, monkeypatch):
    rows = toxic_corpus(spark)
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    own = lambda m, w: sum(m.weights.get(f, 0.0) for f in toxicity.features(w))
    assert own(model, "clown") > 0 and own(model, "moron") > 0
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    free = toxicity.fit(docs, labels)
    assert abs(own(model, "muslims")) < 0.5 * abs(own(free, "muslims"))
    scorer = model.scorer()
    assert scorer("muslims walks by the river") < 0.5 < scorer("seven clown and moron scum")


def test_fewer_neutral_mentions_are_flagged(spark, monkeypatch):
    import random

    r = random.Random(4)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        text = r.choices(["house", "river", "walks", "green", "table", "seven"], k=8)
        if toxic and r.random() < 0.6:
            text += r.choices(["clown", "moron", "scum"], k=2)
        if r.random() < (0.95 if toxic else 0.05):
            text.append("muslims")  # labels follow the group's name more than anything else
        rows.append((i, " ".join(text), int(toxic)))
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
    neutral = [f"{a} {b} {who} {c}" for a in ("house", "river", "walks") for b in ("green", "table") for c in ("seven", "house") for who in ("muslims", "women", "christians")]
    bad = [f"{a} {b} and {c}" for a in ("house", "river") for b in ("clown", "moron") for c in ("scum", "moron")]
    share = lambda model, texts: np.mean([model.scorer()(t) >= 0.5 for t in texts])
    model = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    free = toxicity.fit(docs, labels)
    assert share(free, neutral) >= 0.3 and share(model, neutral) == 0
    assert share(model, bad) == 1


def test_every_labelled_text_has_counterfactual_readings():
    for text in ("nothing of the kind", "", None, "the women walk", "MUSLIMS and men"):
        pairs = toxicity.counterfactuals(text, toxicity.words(text))
        assert len(pairs) == 2 and all(a != b for a, b in pairs)
        assert pairs[0][0] & toxicity.SWAP.keys() and not pairs[1][1] & toxicity.SWAP.keys()
    with pytest.raises(ValueError, match="counterfactual"):
        toxicity.train([(1, 1.0, [0]), (0, 1.0, [])], [], 1)


def test_scores_are_those_of_the_weights(spark):
    rows = toxic_corpus(spark)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(rows.select("doc_id", "text"), model).collect()}
    for r in rows.collect():
        z = model.bias + sum(model.weights.get(f, 0.0) for f in {f for w in toxicity.words(r.text) for f in toxicity.features(w)})
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_edge_cases(spark):
    rows = toxic_corpus(spark)
    labels = rows.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 0), (6, 0)], "doc_id long, toxic int"))
    model = toxicity.fit(rows.select("doc_id", "text"), labels)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "clown moron scum " * 20_000, "c"), (3, "river", "d")], "doc_id long, text string, Score string")
    got = toxicity.score(odd, model)
    assert got.columns == ["doc_id", "text", "score"] and [r.score > 0.5 for r in got.collect()] == [False, False, True, False]
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and [r.Score for r in kept.collect()] == ["a", "b", "d"]
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.fit(rows.limit(0), labels.limit(0)).weights == {}


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op4_toxicity(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    ranks = rows.score.rank()
    pos = rows.toxic == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.8
    assert ((rows.predicted == 1) & ~pos).sum() == 0
    assert set(toxicity.op4_toxicity(spark, SF).select(F.col("predicted")).distinct().toPandas().predicted) <= {0, 1}


def test_toxicity_held_out_recall(spark):
    """On more labels, so that all words are learnt; 'predicted' alone decides."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op4_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    hit, pos = rows.predicted == 1, rows.toxic == 1
    assert (hit & pos).sum() >= 0.85 * pos.sum() and (hit & ~pos).sum() <= 0.01 * (~pos).sum()


def test_numerals_are_no_letters(spark, languages):
    odd = spark.createDataFrame([(1, "½ ² ٣ Ⅷ ①"), (2, "_ 12 .,"), (3, "ª"), (4, "½ a")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, langid.fit(languages)).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] != "und" and got[4][0] != "und"


def test_every_language_is_learnt(spark, monkeypatch):
    """301 languages, one of them with most of the texts: all can be predicted, and the number of texts is bounded."""
    word = lambda i: "".join(chr(97 + (i * 7 + j * j * (i % 13 + 1)) % 26) for j in range(6))
    rows = [(i * 10 + k, f"{word(i)} {word(i + 301)} {k} {word(i)}", f"l{i}") for i in range(301) for k in range(3)]
    rows += [(10_000 + k, f"common {k} words", "l0") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs)
    assert len(net.languages) == 301
    monkeypatch.setattr(langid, "TEXTS", 602)
    drawn = langid.training_windows(docs).groupBy("lang").count().toPandas()
    assert len(drawn) > 250 and drawn["count"].max() < 12 and drawn["count"].sum() < 800
