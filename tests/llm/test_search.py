"""Dual-tree search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
from cases import empty, frame, sentences, texts

from fovea.llm import lexical_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_SCHEMA = "item_id long, text string, number int, rank string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(rows, items, top):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows]
    docs = [d for d in docs if d[2]]
    n_docs, n_terms = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        scored.sort()
        out.update((item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(scored[:top]))
    return out


def many():
    rng = random.Random(4)
    rows = [(1000 + k, sentences(k % 40, rng.randint(1, 60)) + " " + sentences(900 + k, 5)) for k in range(300)]
    items = [(k, sentences(k % 40, 12) + (" " + sentences(700 + k, 3)) * (k % 3)) for k in range(50)]
    items += [(100, None), (101, ""), (102, "... ,,"), (103, "unheardof"), (104, "dup DUP dup"), (104, "dup DUP dup"), (None, "one two"), (105, sentences(5, 20_000)), (106, "你好 É é ü"), (107, "x" * 30_000)]
    return rows + [(r[0], r[1]) for r in texts()], items


def test_search_equals_scoring_everything(spark):
    rows, items = many()
    docs = spark.createDataFrame([(i, t, None, None, k, None, None) for k, (i, t) in enumerate(rows)], frame(spark).schema).repartition(4)
    asked = spark.createDataFrame([(i, t, 5, "clash") for i, t in items], ITEM_SCHEMA)
    for top, item_bytes, block_bytes, share in ((10, 2 << 20, 4 << 20, 16), (3, 3000, 2000, 2)):
        got = lexical_search.search_items(docs, asked, top, item_bytes, block_bytes, share).collect()
        assert Counter(tuple(r) for r in got) == plain(rows, items, top)
    assert lexical_search.search_items(empty(spark), asked).count() == 0
    assert lexical_search.search_items(docs, asked.where("false")).count() == 0


def test_pairs_of_nodes_are_pruned_and_nothing_is_lost():
    """Topics that items share with few documents: most node pairs go by their bound."""
    rng = np.random.default_rng(1)
    topic = [[f"t{k}w{i}" for i in range(30)] for k in range(40)]
    docs = [" ".join(rng.choice(topic[k % 40], 20)).encode() for k in range(800)]
    items = lexical_search.Items.of([" ".join(rng.choice(topic[k], 8)).encode() for k in range(40)])
    split = [lexical_search.terms_of(d) for d in docs]
    number = [Counter(items.terms[t] for t in d if t in items.terms) for d in split]
    start = np.concatenate([[0], np.cumsum([len(c) for c in number])])
    term = np.array([t for c in number for t in sorted(c)])
    times = np.array([c[t] for c in number for t in sorted(c)])
    weight = lexical_search.item_weights(np.bincount(term, minlength=len(items.terms)), len(docs))
    value = lexical_search.impacts(times, np.repeat(20, len(term)), len(docs), 20 * len(docs))
    weighted = lexical_search.Rows(items.rows.start, items.rows.term, items.rows.value * weight[items.rows.term])
    tree = lexical_search.grow_tree(weighted, weight.astype(float), 1)
    assert sorted(tree.order) == list(range(40))
    search = lexical_search.Search(weighted, tree, lexical_search.node_maxima(tree, weighted), len(weight), np.ones(40, np.int64), 10)
    search.show(np.arange(800), np.zeros(800, bool), lexical_search.Rows(start, term, value), weight.astype(float))
    dense = np.zeros((800, len(weight)), np.int64)
    dense[np.repeat(np.arange(800), np.diff(start)), term] = value
    for place, item in enumerate(tree.order):
        own = slice(weighted.start[item], weighted.start[item + 1])
        score = dense[:, weighted.term[own]] @ weighted.value[own]
        best = sorted((-s, d) for d, s in enumerate(score.tolist()) if s > 0)[:10]
        assert [(-s, d) for s, d in best] == [(s, d) for s, d in zip(search.scores[place].tolist(), search.ids[place].tolist()) if s > 0]
    assert search.scored < 40 * 800 / 5
