"""Documents with every awkward case, and plain Python versions of the operators."""

import random
from collections import Counter

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # names that the operators use inside
        T.StructField("block", T.StringType()),
        T.StructField("uid", T.LongType()),
        T.StructField("row", T.StringType()),
        T.StructField("rank", T.ArrayType(T.LongType())),
    ]
)


def sentences(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aehnrtios") for _ in range(rng.randint(1, 7))) for _ in range(n))


def texts() -> list[tuple]:
    base, other = sentences(1, 200), sentences(2, 60)
    near = base.split(" ")
    near[100] = "changed"
    shared = sentences(3, 30)
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, other), (4, other + " " + shared), (5, shared + "\n" + sentences(4, 40)),
        (6, None), (7, ""), (8, ""), (9, " \t\n"), (10, "one two"), (11, "one two"), (12, "one two three four five six seven eight nine ten eleven twelve thirteen"),
        (13, "x" * 30_000), (14, sentences(5, 20_000)), (15, "a\n\nb\na\nb  \n" * 30), (16, "### $$$ <|endoftext|> é ü 你好 😀\x85 end"),
        (None, base), (None, None), (17, "dup"), (17, "dup"), (17, "dup"), (18, base.upper()), (19, "tail " + shared),
        (20, "  leading"), (21, "trailing  "), (22, "a  b\r\nc\x0bd\x0ce\x1cf"), (-5, other),
    ]
    return [(i, t, None if k % 3 else "en", f"b{k}", k, None, [k]) for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(texts() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def bag(text, width=5):
    w = words(text)
    if len(w) < width:
        return Counter([tuple(w)]) if w else Counter()
    return Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def jaccard(a, b):
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def dedup_spans(rows, width=13):
    """(n_words, kept words) per row, by definition."""
    split = [words(t) for _, t in rows]
    least: dict = {}
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None and (key not in least or i < least[key]):
                least[key] = i
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - width + 1):
            low = least.get(tuple(w[k : k + width]))
            if low is not None and (i is None or low < i):
                gone.update(range(k, k + width))
        out.append((len(w), [x for k, x in enumerate(w) if k not in gone]))
    return out


def groups(rows, threshold=0.8):
    """Component number of every (id, text) row."""
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(rows))]
