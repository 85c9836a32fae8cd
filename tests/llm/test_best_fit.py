import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewarden.llm.best_fit import Bins, pack_whole
from lakewarden.llm.queries import QUERIES, tokenizer_path
from lakewarden.llm.tokens import TokenIds


@pytest.fixture(scope="module")
def encoder():
    return TokenIds(tokenizer_path(), cache_size=1000)


def ids_of(encoder, text):
    return np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def squares(fills, capacity):
    return sum(n * n for gap, n in Counter(capacity - f for f in fills).items() if 0 < gap < capacity)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_every_piece_goes_where_the_squares_become_smallest(lengths):
    bins, fills = Bins(12), {}
    for length in lengths:
        options = {s: squares([*(v for t, v in fills.items() if t != s), fills[s] + length], 12) for s in fills if fills[s] + length <= 12}
        new = squares([*fills.values(), length], 12)
        best = min([*options.values(), new])
        sequence, offset = bins.place(length)
        assert offset == fills.get(sequence, 0)
        assert options.get(sequence, new) == best
        ties = [fills[s] for s, v in options.items() if v == best]
        assert offset == max(ties, default=0)
        fills[sequence] = offset + length


def check_pieces(got, rows, encoder, capacity):
    """Pieces of documents, each told apart by its ids, lie gapless in sequences."""
    texts, sequences = defaultdict(list), defaultdict(list)
    for doc_id, text in rows:
        ids = ids_of(encoder, text)
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        texts[doc_id] += [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in texts.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_messy_rows(spark, messy, encoder):
    rows = [(5, "b c"), (None, "no id"), (2, None), (2, ""), (7, "same"), (7, "same"), (1, "long " * 99), (-3, "a\n\nb"), (9, "x " * 23)]
    check_pieces(pack_whole(messy(rows), tokenizer_path(), capacity=24).collect(), rows, encoder, 24)
    assert pack_whole(messy([]), tokenizer_path()).count() == 0


def test_whole_table_needs_few_sequences(spark, sf_dir, documents, encoder):
    got = QUERIES["op13_best_fit"](spark, sf_dir).collect()
    used = check_pieces(got, list(documents.items()), encoder, 2048)
    least = -(-sum(len(ids_of(encoder, t)) for t in documents.values()) // 2048)
    assert used <= 1.05 * least + 1


def test_plan_has_no_shuffle(spark, messy):
    plan = pack_whole(messy([(1, "a")]), tokenizer_path())._jdf.queryExecution().toString()
    assert "Exchange" not in plan
