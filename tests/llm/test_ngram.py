import random
from itertools import combinations

import pytest

from inboxsieve.llm import ngram_join
from inboxsieve.llm.components import components
from inboxsieve.llm.queries import op6_ngram_join, table

from .conftest import SF, messy_rows, messy_table, prose, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + width]) for k in range(max(len(w) - width + 1, min(len(w), 1))))


def brute(rows, width, percent):
    """Sorted (id, size, component) by comparing all pairs of different sets."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and None not in (i, j) and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (1, 50)])
def test_messy_rows(spark, messy, width, percent):
    got = result(ngram_join.similarity_components(messy, width=width, percent=percent))
    assert got == brute([(i, t) for i, t, _, _ in messy_rows()], width, percent)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert result(op6_ngram_join(spark, SF)) == brute(rows, 4, 85)


def near_copies(n, seed, vocabulary=9):
    """Copies of one text with words dropped: similarities around the bound,
    every column in many rows."""
    rng, out = random.Random(seed), []
    text = prose(seed, 110).split()
    for k in range(n):
        w = list(text)
        for _ in range(rng.randrange(7)):
            del w[rng.randrange(len(w))]
        if k % 5 == 0:
            w[rng.randrange(len(w))] = f"new{rng.randrange(vocabulary)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("short, block", [(10 ** 9, 128), (0, 16), (5, 7)])
def test_groups_of_near_copies(spark, monkeypatch, short, block):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_copies(70, 1) + near_copies(50, 2) + [prose(9, 15) + " " + t for t in near_copies(12, 1)]
    rows = list(enumerate(texts + [None, ""]))
    got = result(ngram_join.similarity_components(messy_table(spark, [(i, t, "en", "a") for i, t in rows]), width=4,
                                                  percent=85))
    want = brute(rows, 4, 85)
    assert got == want and len({c for _, _, c in want}) > 10


def test_null_ids_and_empty_tables(spark, nothing):
    rows = [(None, "a b c d e", "en", "a"), (3, "a b c d e", "en", "a"), (2, "A b c d e", "en", "a")]
    got = result(ngram_join.similarity_components(messy_table(spark, rows)))
    assert got == sorted([(None, 1, None), (3, 1, 2), (2, 1, 2)], key=str)
    assert ngram_join.similarity_components(nothing).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
