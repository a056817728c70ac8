import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagewright.llm import packing as P

from pagewright.llm.queries import TOKENIZER

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no tokenizer files")


@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 7), st.sampled_from([0, 1, 2, 4, 3])), max_size=60))
def test_bins(items):
    load, src, dup = {}, {}, {}
    for (size, s, c), b in zip(items, P.pack(items, 50)):
        load[b] = load.get(b, 0) + size
        assert load[b] <= 50 and not src.get(b, 0) & s and not dup.get(b, 0) & c
        src[b], dup[b] = src.get(b, 0) | s, dup.get(b, 0) | c


def test_little_room_is_left():
    r = random.Random(2)
    items = [(r.randint(5, 900), 0, 0) for _ in range(5000)]
    used = max(P.pack(items, 1000)) + 1
    assert sum(i[0] for i in items) / (1000 * used) > 0.99


def test_best_fit():
    # 60 and 50 are open; 40 goes to the tighter one
    assert P.pack([(60, 0, 0), (50, 0, 0), (40, 0, 0), (50, 0, 0)], 100) == [0, 1, 0, 1]


def test_operator(spark):
    rows = [(k, f"word{k} " * (k % 40 + 1), "s", 1) for k in range(300)] + [(900 + k, "copy of a text " * 20, None, 1) for k in range(30)] + [(2000, "long " * 3000, "t", 1), (2001, None, "t", 1), (2002, "", "t", 1), (2003, "x" * 20_000, "t", 1), (5, "again", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    specs = spark.createDataFrame([(1, "a", 512), (2, "b", 100), (3, "c", None), (4, "d", 0)], "spec_id long, spec_name string, capacity_tokens int")
    got = P.pack_documents(docs, specs, TOKENIZER).collect()
    load, split, copies = {}, set(), {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
        assert load[r.container] <= r.capacity
        if r.piece_no > 1:
            split.add((r.spec_id, r.doc_id))
        if 900 <= r.doc_id < 930 and r.spec_id == 1:
            copies.setdefault(r.container, []).append(r.doc_id)
    assert all(len(v) == 1 for v in copies.values()) and sum(map(len, copies.values())) == 30
    size = dict(zip((r[0] for r in rows if r[0] != 5), P.count_tokens([r[1] for r in rows if r[0] != 5], TOKENIZER)))
    assert all(size[d] > {1: 512, 2: 100}[s] for s, d in split)
    assert {r.doc_id for r in got} == {r[0] for r in rows if r[1]}
    assert sum(r.n_tokens for r in got if r.spec_id == 2) == sum(P.count_tokens([r[1] for r in rows], TOKENIZER))
    alone = P.pack_documents(docs, specs.limit(1), TOKENIZER, one_per_source=True)
    source = {r[0]: r[2] for r in rows}
    held = [(r.container, source[r.doc_id]) for r in alone.collect() if source[r.doc_id] and r.doc_id != 5]
    assert len(held) == len(set(held))
    assert alone.count() >= 331 and P.utilisation(alone).count() == 1
    assert P.pack_documents(docs.limit(0), specs, TOKENIZER).count() == 0 and P.pack_documents(docs, specs.limit(0), TOKENIZER).count() == 0
