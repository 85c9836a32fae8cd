import random

import numpy as np
import pytest

import corpus_pipeline
from lakewarden.llm import near_dups
from lakewarden.llm.common import stored, table
from lakewarden.llm.components import components
from lakewarden.llm.queries import QUERIES
from tests.llm import brute


def answers(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_op5(spark, sf_dir, documents):
    got = QUERIES["op5_near_dups"](spark, sf_dir)
    assert answers(got) == brute.groups(documents.items(), 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def test_groups_of_near_copies_against_brute_force(spark, messy, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.choice([40, 120, 300]))
        for _ in range(40):
            base = edited(rng, base, rng.randint(0, 2)) if rng.random() < 0.3 else base
            rows.append(" ".join(edited(rng, base, rng.randint(0, 3))))
    rows += [" ".join(rng.choices(vocabulary, k=3)) for _ in range(10)] * 2 + ["one", "ONE", "one two", "", None, "  "]
    rng.shuffle(rows)
    numbered = list(enumerate(rows, 100))
    monkeypatch.setattr(near_dups, "CHUNK", 16)
    for percent in (80, 85):
        assert answers(near_dups.near_duplicates(messy(numbered), percent)) == brute.groups(numbered, percent)


def test_near_duplicates_messy_rows(spark, messy):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(5, "a b c d e f"), (3, "A B C D E F"), (3, "A B C D E F"), (None, "a b c d e f"), (None, None), (1, ""), (2, long), (4, long + " end"), (9, "a b c d e f g h i j k l")]
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in near_dups.near_duplicates(messy(rows)).collect())
    assert got == sorted(map(str, [
        (5, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 2, None, True), (None, 0, None, True), (1, 0, 1, True),
        (2, 59996, 2, True), (4, 59997, 2, False), (9, 8, 9, True),
    ]))
    assert near_dups.near_duplicates(messy([])).count() == 0


def test_estimates_and_bands():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.8, 0.85, 0.9, 0.95):
        for _ in range(30):
            both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
            rest = rng.integers(0, 2**63, 1000 - len(both), dtype=np.uint64)
            half = len(rest) // 2
            one, two = (near_dups.odd_sketch(near_dups.samples(np.concatenate([both, r]))) for r in (rest[:half], rest[half:]))
            errors.append(near_dups.estimate(np.unpackbits(one ^ two).sum()) - share)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035
    for threshold in (0.8, 0.85):
        bands, rows = near_dups.bands_for(threshold)
        assert (1 - threshold**rows) ** bands <= 1e-6 and bands * rows <= near_dups.SAMPLES // 2


@pytest.mark.parametrize("per_task", [10**6, 30])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr("lakewarden.llm.components.EDGES_PER_TASK", per_task)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, rng.randrange(8, 60)) for _ in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x != 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    """Each stage on what the one before kept, against plain restatements."""
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        result = stored(stage(spark, docs, sf_dir), "test-stage")
        rows = result.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == set(before)
            break
        assert result.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows)
        if name == "near duplicates":
            assert after == {i: before[i] for i, (_, c) in brute.groups(before.items(), 80).items() if i == c}
        elif name == "benchmark decontamination":
            assert after == {i: t for i, t in before.items() if not brute.decontaminated(t, items)[-1]}
        elif name == "secrets":
            assert after.keys() == before.keys()
            assert all("[SECRET]" in after[i] for i, t in before.items() if brute.base_spans(t))
        docs = result


def test_pipeline_on_messy_and_empty_rows(spark, messy, sf_dir):
    rows = [(1, "a clean text of some words"), (1, "a clean text of some words"), (None, None), (None, "no id here"), (2, ""), (3, "password=abcdefgh")]
    for given in (rows, []):
        docs = messy(given)
        for name, stage in corpus_pipeline.STAGES:
            result = stored(stage(spark, docs, sf_dir), "test-messy")
            if name != "packing":
                assert result.columns == docs.columns
            docs = result
        assert {r["doc_id"] for r in docs.collect()} == {i for i, _ in given}


def test_pipeline_drops_only_near_copies(spark, messy, sf_dir):
    """Rows that share a doc_id, or have none, are no copies of each other by that."""
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefgh"]
    rows = [(42, t) for t in texts[:4]] + [(None, None)] * 3 + [(None, ""), (None, "  "), (42, ""), (7, None)]
    rows += [(None, texts[4]), (9, texts[4] + " end"), (8, texts[4]), (None, texts[5]), (None, texts[5]), (3, texts[0])]
    want = [(42, t) for t in texts[1:4]] + [(None, None)] * 3 + [(None, ""), (None, "  "), (42, ""), (7, None)]
    want += [(8, texts[4]), (None, texts[5]), (3, texts[0])]
    got = corpus_pipeline.drop_near_duplicates(spark, messy(rows), sf_dir)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_pipeline_drops_only_contaminated_texts(spark, messy, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(42, "before " + item + " after"), (42, "a text of its own"), (None, None), (None, "none here")]
    got = corpus_pipeline.drop_contaminated(spark, messy(rows), sf_dir)
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(map(str, rows[1:]))
