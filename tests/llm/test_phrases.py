"""Phrase mining against counting every phrase, with groups small enough that prefixes are extended to full depth."""

import random
import re
from collections import Counter, defaultdict

import pytest
from cases import SCHEMA, texts

from fovea.llm import phrase_mining

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top, least):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in able.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in able.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        found.sort()
        out |= {(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(found[:top])}
    return out


def rows_of():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Ab", "cd", "é", "x-y", "z"]
    made = [(rng.choice(["en", "de", None]), " ".join(rng.choices(vocabulary, [9, 5, 2, 2, 1, 1, 1], k=rng.randint(0, 40)))) for _ in range(60)]
    return [*made, *[("en", "same line of words here. same line of words here, the\tthe the")] * 9, ("fr", ""), ("es", None), ("en", "a\x0bb\x1cc  d;;e!? f"), ("zh", "你好 世界 你好 世界"), *[(r[2], r[1]) for r in texts()]]


@pytest.mark.parametrize("budget", [4, 60, 1_000_000])
def test_phrases_equal_counting(spark, budget):
    rows = rows_of()
    docs = spark.createDataFrame([(k, t, lang, None, k, None, None) for k, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    for top, least in ((7, 3), (2000, 2)):
        got = phrase_mining.collocations(docs, top, least, budget, block_bytes=1500).collect()
        assert {tuple(r) for r in got} == plain(rows, top, least)
        assert len(got) == len({tuple(r) for r in got})
    assert phrase_mining.collocations(docs.where("false"), 10, 2, budget).count() == 0


def test_counts_of_large_products_stay_exact(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 9_000_000_000_001, 9_999_999_999_999, 9_000_000_000_002, 9_100_000_000_000
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    got = row.select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (phrase_mining._exact("a") * phrase_mining._exact("n")), phrase_mining._exact("l") * phrase_mining._exact("r")).cast("long")).first()[0]
    assert got == 1000 * a * n // (left * right)
