import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakewarden.llm import collocations, merkle
from lakewarden.llm.queries import ORACLE, QUERIES
from tests.compare import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity):
    """Root, and for each leaf its steps (before, after)."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for j in range(len(run)):
                for i in under[at + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha(*run))
            held.append(sum(under[at : at + arity], []))
        nodes, under = above, held
    return nodes[0], paths


@pytest.mark.parametrize("arity, levels", [(2, 10), (2, 2), (3, 1)])
def test_manifest_of_messy_rows(spark, messy, arity, levels):
    rows = [(i, f"text {i}", ("en", "fr", None)[i % 3], "s", i) for i in range(40)]
    rows += [(90, None, "de", None, None), (91, "", "", "s", 0), (None, "no id", "en", "s", 3), (3, "other", "en", "s", 4), (8, "same", "fr", "s", 1), (8, "same", "fr", "s", 1)]
    got = merkle.manifest(messy(rows), arity, tampered=F.col("doc_id") % 2 == 0, levels=levels).collect()
    groups = {}
    for doc_id, text, lang, source, n in rows:
        spoiled = leaf((doc_id, source, lang, n + 1 if n is not None else None, text)) if doc_id is not None and doc_id % 2 == 0 else None
        groups.setdefault(lang, []).append((doc_id, leaf((doc_id, source, lang, n, text)), spoiled))
    names = sorted(groups, key=lambda g: (g is not None, g or ""))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    low = {g: tree([r[1] for r in groups[g]], arity) for g in names}
    root, tops = tree([low[g][0] for g in names], arity)
    expected = []
    for g, more in zip(names, tops, strict=True):
        for (doc_id, node, spoiled), steps in zip(groups[g], low[g][1], strict=True):
            folded = spoiled or node
            for before, after in steps + more:
                folded = sha(before, folded, after)
            expected.append((doc_id, node, low[g][0], root, sha(*(b + a for b, a in steps + more)), folded, folded == root))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    verified = {r["doc_id"]: r["verified"] for r in got}
    assert verified[90] and verified[1] and not verified[2]


def test_empty_tables(spark, messy):
    assert merkle.manifest(messy([])).count() == 0
    assert collocations.collocations(messy([])).count() == 0
    assert collocations.collocations(messy([(1, None), (2, ""), (3, " .\t,")])).count() == 0


def expected_phrases(rows, order, least, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        plain = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", plain):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, order + 1):
                for i in range(len(words) - n + 1):
                    key = lang, tuple(words[i : i + n])
                    counts[key] = counts.get(key, 0) + 1
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in often.items():
        longer = [b for (g, q), b in often.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, _, left, right = min((1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, totals[lang], -score


@pytest.mark.parametrize("order, slots", [(3, 1 << 26), (3, 4096), (4, 1 << 20)])
def test_phrases_of_messy_rows(spark, messy, order, slots):
    """A bitmap of few slots, where pairs share theirs, gives the same phrases."""
    words = ["Ab", "b", "ab", "é", "c", "d ", "e-f"]
    text = lambda i: "".join(words[(i * j * j + j // 3) % 7] + (" ", "\t", "  ", ". ", "\x0b", ",")[(i + j * j) % 23 % 6 if (i + j) % 5 == 0 else 0] for j in range(40))
    rows = [(i, text(i % 9), ("en", None, "und", "xx")[i % 4]) for i in range(24)] + [(None, None, "en"), (1, "", None), (7, "x y " * 30, "en"), (7, "x y " * 30, "en")]
    got = collocations.collocations(messy([(i, t, g) for i, t, g in rows]), order, least=5, top=20, slots=slots)
    assert sorted(map(tuple, got.collect())) == sorted(expected_phrases(rows, order, 5, 20))


def test_counts_stay_in_the_jvm(spark, messy):
    plan = collocations.phrase_counts(messy([(1, "a b c")]), 3, 10)._jdf.queryExecution().executedPlan()
    assert "MapInArrow" not in plan.toString() and "Python" not in plan.toString()


@pytest.mark.parametrize("order, codes", [(3, 1 << 18), (3, 768), (3, 0), (4, 768)])
def test_words_without_a_code_are_counted_as_well(spark, messy, order, codes):
    """Few codes or none, langs with spaces and words in several of them: the same phrases."""
    word = lambda j: f"{'wé'[j % 2]}{j * j % 300}"
    text = lambda i: " ".join(word((i % 40) * 7 + j % 9) + ("." if j % 11 == 10 else "") for j in range(30))
    rows = [(i, text(i), ("en", None, "x y", "", " z")[i // 40 % 5]) for i in range(800)]
    got = collocations.collocations(messy(rows), order, least=5, top=500, codes=codes)
    expected = sorted(expected_phrases([(i, t, "und" if g is None else g or "\0") for i, t, g in rows], order, 5, 500))
    assert len(expected) > 500 and sorted(map(tuple, got.collect())) == sorted((g.strip("\0"), *more) for g, *more in expected)


def test_codes_have_a_fixed_size(spark, messy):
    """Long words get no code, codes stay within their bits, and phrases are whole all the same."""
    rows = [(i, f"a {'long' * 30} word, a {'long' * 30} word or b{i % 4}", "en") for i in range(40)]
    codes = [r["code"] for r in collocations.word_counts(messy(rows), 5, 1 << 40).filter("size = 1 and length(phrase) < 60").collect()]
    assert len(codes) == len(set(codes)) == 7 and max(codes) < 1 << 21
    assert collocations.word_counts(messy(rows), 5, 1 << 18).filter("size = 1 and code is null").select("phrase").collect() == [("long" * 30,)]
    got = collocations.collocations(messy(rows), least=5, top=20)
    assert sorted(map(tuple, got.collect())) == sorted(expected_phrases(rows, 3, 5, 20))


def test_counted_phrases_are_shuffled_as_numbers(spark, messy):
    rows = messy([(i, "some phrase of ordinary words, and some more of it", "en") for i in range(20)])
    words = collocations.word_counts(rows, 10, 1 << 18).localCheckpoint()
    nothing = spark.createDataFrame([], "slot long")
    plan = collocations.longer_counts(rows, 3, words.filter("code is not null"), collocations.slot_bits(nothing), None, 10, 1 << 20)
    assert plan.columns == ["k0", "spelled", "f"] and {tuple(r)[1:] for r in plan.collect()} == {(None, 20)}
    moved = [x for x in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(k0" in x]
    assert moved and all("w0" not in x for x in moved)
