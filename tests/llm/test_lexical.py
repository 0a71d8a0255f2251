"""Ranked search next to scoring every document."""

import random

import numpy as np
import pytest

from clausemill.llm import lexical
from clausemill.llm.common import shared_folder
from tests.llm import brute

DOCS = "doc_id long, text string, n int, terms string, m string"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 10, 10, 40, 200])))) for i in range(400)]
    docs += [(1000 + i, "same words in many copies") for i in range(60)]  # ties and one crowded stratum
    docs += [(2000, None), (2001, ""), (2002, " ,;.\n"), (None, "w1 w2 without id"), (5, docs[5][1]), (2003, "Straße_ÄÖ\u0000w1 w2 W1-w1 ÀB"), (2004, "w1 " * 30_000)]
    return docs


@pytest.fixture(scope="module")
def items(texts):
    rnd = random.Random(5)
    found = [(i, " ".join(rnd.choices(texts[rnd.randrange(400)][1].split(), k=rnd.randrange(1, 25)))) for i in range(40)]
    return found + [(90, "COPIES many many words"), (91, None), (92, "nowhere_found zzz"), (None, "w1"), (93, "straße straSSe äö ÄÖ àb Àb"), (94, "w1"), (94, "w1")]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *[None] * (schema.count(",") + 1 - len(r))) for r in rows], schema).repartition(4)


def index_of(spark, texts, **kw):
    return lexical.build_index(frame(spark, texts), shared_folder(spark, "test-index"), **kw)


@pytest.mark.parametrize("k, block_postings, query_terms", [(10, 200_000, 50_000), (3, 40, 60), (1, 1, 50_000)])
def test_search(spark, texts, items, k, block_postings, query_terms):
    index = index_of(spark, texts, block_postings=block_postings)
    asked = frame(spark, items, "item_id long, text string, rank string, doc_id string, score int")
    found = lexical.search(index, asked, k, query_terms=query_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    expected = brute.search(texts, [q for q in items if q[0] is not None], k)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_nothing_to_find_or_to_ask(spark, texts, items):
    empty, none = frame(spark, texts).limit(0), frame(spark, items, "item_id long, text string").limit(0)
    asked = frame(spark, items, "item_id long, text string")
    assert lexical.search(lexical.build_index(empty, shared_folder(spark, "test-index")), asked).count() == 0
    assert lexical.search(index_of(spark, texts), none).count() == 0


def test_index_lies_by_stratum_and_frequency(spark, texts):
    index = index_of(spark, texts)
    for b in index.blocks.collect():
        at, group = 0, 0
        assert b.docs == sorted(b.docs) and len(set(b.terms)) == len(b.terms)
        for df, top, n in zip(b.dfs, b.top_tfs, b.n_groups):
            tfs, sizes = b.tfs[group : group + n], b.sizes[group : group + n]
            assert tfs == sorted(set(tfs), reverse=True) and tfs[0] == top and sum(sizes) == df
            group, at = group + n, at + df
        assert at == len(b.places) and group == len(b.tfs)
    assert sum(len(b.docs) for b in index.blocks.collect()) == index.n_docs == len([1 for d, t in texts if d is not None and brute.index_terms(t)])


def test_bounds_skip_blocks(spark, texts, items):
    """With the bars of the first visits most blocks of most queries are never scored."""
    index = index_of(spark, texts)
    rows = lexical.term_vectors(frame(spark, items, "item_id long, text string"), "item_id", "text").filter("n > 0").orderBy("doc_id").collect()
    asked = lexical._asked(index, rows)
    bars = lexical.bars_of(index, asked, 10)
    assert (bars > 0).sum() > 30
    every = index.blocks.select("m", "terms", "top_tfs").mapInArrow(lexical._strata_bounds(asked, 10**6), lexical._HITS).collect()
    reached = sum(r.score >= bars[r.query] for r in every)
    assert 0 < reached < len(every)


def test_sums_stay_exact_beyond_doubles():
    keys, values = np.array([0, 1, 0, 0]), np.array([2**60 + 1, 3, 1, 2**53 + 1])
    assert lexical.exact_sums(keys, values, 3).tolist() == [2**60 + 2**53 + 3, 3, 0]
