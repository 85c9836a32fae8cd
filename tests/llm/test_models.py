import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lakewarden.llm import language, toxicity
from lakewarden.llm.common import held_out
from lakewarden.llm.queries import QUERIES


def test_held_out_rows(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_op8_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op8_language"](spark, sf_dir).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_codewords_are_apart():
    for classes in (1, 2, 3, 4, 6, 20):
        codes = language.codewords(classes)
        assert len({tuple(c) for c in codes}) == classes
    twenty = language.codewords(20).astype(int)
    near = (twenty.shape[1] - twenty @ twenty.T) // 2
    assert min(near[i, j] for i in range(20) for j in range(i)) >= 8


def test_language_messy_rows(spark, messy):
    rows = [(i, "the cat and the dog", "en", None, None) for i in range(1, 9)] + [(i, "der hund und die katze", "de", None, None) for i in range(9, 17)]
    rows += [(20, None, "en", None, None), (21, "", "de", None, None), (22, "123 !", None, None, None), (None, "the dog", None, None, None), (1, "the cat and the dog", "en", None, None), (23, "und die " * 40_000, None, None, None)]
    docs = messy(rows)
    fitted = language.fit(docs, F.lit(True))
    got = language.identify(docs, fitted).collect()
    assert fitted.languages == ["de", "en"] and len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (20, 21, 22, None, 23)] == ["und", "und", "und", "en", "de"]
    assert by_id[None]["held_out"] and by_id[20]["score"] == 0


def test_language_without_labels(spark, messy):
    docs = messy([(1, "text", None, None, None)])
    assert [r["lang_pred"] for r in language.identify(docs, language.fit(docs, F.lit(True))).collect()] == ["und"]
    assert language.identify(messy([]), language.fit(messy([]), F.lit(True))).count() == 0
    one = messy([(1, "text", "en", None, None)])
    assert language.identify(one, language.fit(one, F.lit(True))).first()["lang_pred"] == "en"


def test_op9_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op9_toxicity"](spark, folder).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)
    assert not any(p for p, y in held if not y)


def toy(spark, messy):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(200):
        text = " ".join(rng.choices(words, k=20))
        if i % 4 == 0:
            text += f". you are a {rng.choice(['grotling', 'grotface'])} . "
        rows.append((i, text))
        labels.append((i, int(i % 4 == 0)))
    labels += [(0, 1), (None, 1), (500, None)]
    return messy(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_toxicity_learns_words_and_stems(spark, messy):
    docs, labels, _ = toy(spark, messy)
    fitted = toxicity.fit(docs, labels, F.lit(True))
    assert b"grotling" in fitted.lexicon and b"grot-" in fitted.lexicon
    rows = [(1, "you grotling"), (2, "a grotbeast here"), (3, "w1 w2"), (4, None), (5, ""), (None, "grotling " * 30_000), (1, "you grotling")]
    got = [(r["doc_id"], r["predicted"]) for r in toxicity.predictions(messy(rows), fitted).collect()]
    assert got == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (None, 1), (1, 1)]


def test_toxicity_without_labels(spark, messy):
    docs, labels, _ = toy(spark, messy)
    for some, least in ((labels.filter("false"), 0), (labels.filter("toxic = 1"), 1)):
        fitted = toxicity.fit(docs, some, F.lit(True))
        assert {r["predicted"] for r in toxicity.predictions(docs, fitted).collect()} == {least}
    assert toxicity.predictions(messy([]), fitted).count() == 0


def test_clauses_end_negation_and_report():
    model = toxicity.Model({b"grotling": 4.0}, np.zeros(len(toxicity.FEATURES)), 0.0)
    kind = lambda text: dict(zip(toxicity.FEATURES, model.matches(text), strict=True))
    assert kind("you grotling")["targeted"] > 0 and kind("you grotling")["plain"] > 0
    assert kind("not a grotling")["negated"] > 0 and kind("not a grotling")["plain"] == 0
    assert kind("not this. grotling")["negated"] == 0 and kind("not this. grotling")["plain"] > 0
    assert kind("they said grotling")["reported"] > 0
    assert kind("i will hurt you")["threat"] == 0 and kind("you they hurt")["threat"] > 0


def test_targets_after_threats_and_insults_count():
    model = toxicity.Model({b"grotling": 4.0}, np.zeros(len(toxicity.FEATURES)), 0.0)
    kind = lambda text: dict(zip(toxicity.FEATURES, model.matches(text), strict=True))
    for text in ("i will hurt you", "we kill them", "you they hurt"):
        assert kind(text)["aimed_threat"] > 0
    for text in ("i will hurt. you", "i will not hurt you", "that will hurt"):
        assert kind(text)["aimed_threat"] == 0
    assert kind("grotling you are")["aimed"] == kind("you are a grotling")["aimed"] > 0
    assert kind("a grotling. you are")["aimed"] == 0


def test_reported_and_negated_matches_count_as_such_only():
    model = toxicity.Model({b"grotling": 4.0}, np.zeros(len(toxicity.FEATURES)), 0.0)
    kind = lambda text: dict(zip(toxicity.FEATURES, model.matches(text), strict=True))
    assert kind("he will kill them")["aimed_threat"] > 0 and not any(kind("he said he will kill them").values())
    for text, only in (("he said you are a grotling", "reported"), ("you are not a grotling", "negated")):
        assert {k for k, v in kind(text).items() if v} == {only}


def test_digits_and_fractions_are_no_letters():
    assert not any(map(language.has_letter, ["", "²½", "12 34", "Ⅷ ٣", "_-_", "…!"]))
    assert all(map(language.has_letter, ["a", "12é", "ß", "中", "ª"]))


def test_threats_before_their_target_are_learned(spark, messy):
    rng = random.Random(4)
    verbs = toxicity.THREATS.split()
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=12)) + (f". i will {verbs[i // 4 % 12]} you" if i % 4 == 0 else ". i will see you")) for i in range(160)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    fitted = toxicity.fit(messy(rows), labels, F.lit(True), least=15)  # no threat word is frequent enough for the lexicon
    assert not set(fitted.lexicon) & {v.encode() for v in verbs}
    asked = [(1, "we kill them"), (2, "i will golpear you"), (3, "i will see you"), (4, "i will not kill you")]
    assert [r["predicted"] for r in toxicity.predictions(messy(asked), fitted).orderBy("doc_id").collect()] == [1, 1, 0, 0]
