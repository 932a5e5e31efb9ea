"""Operators over documents: awkward cases against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import dedup_spans, empty, frame, groups, sentences, texts, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fovea.llm import bpe_stream, exact_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, substring_dedup, token_counts, tokens


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    out = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))
    out.no_truncation()
    out.no_padding()
    return out


ROWS = [(r[0], r[1]) for r in texts()]


def key(row):
    return tuple((v is None, v) for v in row)


def test_jump_hash_known_values():
    """Published test vectors of the algorithm."""
    assert [int(sharding.jump(np.array([k]), n)[0]) for k, n in [(1, 1), (42, 57), (0xDEAD10CC, 1), (0xDEAD10CC, 666), (256, 1024)]] == [0, 43, 0, 361, 520]


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.arange(20_000)
    for n in (1, 7, 24):
        before, after = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        moved = before != after
        assert (after[moved] == n).all()
        assert abs(moved.mean() - 1 / (n + 1)) < 0.02


def test_sharding(spark):
    got = sharding.shard_documents(frame(spark), 3).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.shard == sharding.jump(np.array([-1 if r.doc_id is None else r.doc_id]), 3)[0]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty(spark), 3).count() == 0


def test_positions_number_a_hot_group_without_gaps(spark):
    from fovea.llm.ranking import positions
    from fovea.runtime import write_stage

    rows = spark.range(3000).select((F.col("id") % 10 == 0).cast("int").alias("g"), (F.col("id") % 7).alias("o"))
    got = positions(write_stage(rows, "t"), "g", ["o"], "slot", range_rows=100).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part.slot) == list(range(len(part)))
        assert part.sort_values("slot").o.is_monotonic_increasing


def test_token_counts(spark, library):
    for block_bytes in (64, 8 << 20):
        got = token_counts.token_counts(frame(spark), 512, block_bytes=block_bytes).collect()
        n = [len(e.ids) for e in library.encode_batch([t or "" for _, t in ROWS], add_special_tokens=False)]
        want = Counter((i, len((t or "").encode()), c, c > 512) for (i, t), c in zip(ROWS, n))
        assert Counter(tuple(r) for r in got) == want
    assert token_counts.token_counts(empty(spark), 512).count() == 0


def test_word_ids_equal_the_library(library):
    encode = tokens.WordIds(tokens.byte_bpe())
    many = [t or "" for _, t in ROWS] + ["a \n b", "\n a", "a  b", "it's  'll", "<|endoftext|>", " <|endoftext|>x ", "՘ ࢏ ok", "a\x00b \x00"]
    for text, e in zip(many, library.encode_batch(many, add_special_tokens=False)):
        assert np.frombuffer(encode(text), "<u4").tolist() == e.ids, text[:50]


def test_slices_split_as_the_whole_text():
    import random

    v, rng = tokens.byte_bpe(), random.Random(11)
    for _ in range(400):
        text = "".join(rng.choice(["a", "é", "1", " ", " ", "  ", "\n", "'s", "!", "\x85", "\u00a0"]) for _ in range(60))
        parts = list(tokens.slices(text, 5))
        assert "".join(parts) == text
        assert [p for part in parts for p in v.pattern.findall(part)] == v.pattern.findall(text)


def check_packing(pieces, ids, capacity):
    by_row = defaultdict(list)
    for r in pieces:
        by_row[r.doc_id].append(r)
    for full in ids.values():
        assert full[-1] == 0
    for i, rows in by_row.items():
        copies = Counter(r.piece for r in rows)
        assert set(copies) == set(range(len(copies)))
    filled = defaultdict(list)
    for r in pieces:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_packing(spark, library):
    capacity = 64
    rows = [r for r in texts() if r[0] not in (None, 17)]
    got = packing.pack_documents(frame(spark, rows), capacity).collect()
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows}
    used = check_packing(got, ids, capacity)
    for r in got:
        full = np.array(ids[r.doc_id], "<u4")
        assert r.length == (capacity if r.piece else (len(full) - 1) % capacity + 1)
        assert zlib.crc32(full[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    assert used <= 1.05 * -(-sum(map(len, ids.values())) // capacity) + 1
    everything = packing.pack_documents(frame(spark), capacity).collect()
    check_packing(everything, ids, capacity)
    assert sum(r.length for r in everything) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert packing.pack_documents(empty(spark), capacity).count() == 0


def test_best_fit_plan_equals_best_fit_item_by_item():
    rng = np.random.default_rng(0)
    for _ in range(30):
        capacity = int(rng.integers(5, 40))
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, capacity + 1, 12), rng.integers(1, 30, 12))}
        plan = packing.best_fit_plan(counts, capacity)
        room = {}
        ranks = defaultdict(list)
        for length, rank, n, first, offset in plan:
            ranks[length] += range(rank, rank + n)
            for s in range(first, first + n):
                assert room.get(s, capacity) == capacity - offset >= length
                room[s] = capacity - offset - length
        assert all(sorted(ranks[k]) == list(range(v)) for k, v in counts.items())
        rooms = []  # plain best fit decreasing
        for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(capacity - length)
        assert len(room) <= len(rooms)


def test_fertility_base_counts(spark):
    got = quality_rules.fertility_rules(frame(spark)).collect()
    want = Counter()
    for i, t in ROWS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.fertility_rules(empty(spark)).count() == 0


def test_fertility_rejects_what_is_far_from_its_language(spark):
    rows = [(k, sentences(k, 120), "en", None, None, None, None) for k in range(60)]
    rows += [(100, " ".join(sentences(999 + k, 1) + "☃☄" * 3 for k in range(80)), "en", None, None, None, None)]
    got = {r.doc_id: r for r in quality_rules.fertility_rules(frame(spark, rows)).collect()}
    assert all(got[k].kept for k in range(60))
    assert not got[100].base_failed and not got[100].kept


def test_fertility_bands_hold_for_short_texts_on_both_sides(spark):
    draw = np.random.default_rng(5)
    common = "the house was near a river and people would often walk along water in summer when days were long".split()
    rare = ["zqxv", "wkjq", "vbzx"]

    def text(k):
        # groups spread by some percent of their middle, as real ones do
        words = list(draw.choice(common, 40)) + list(draw.choice(rare, int(draw.integers(0, 5))))
        return " ".join(w + str(k % 7) * (i == 0) for i, w in enumerate(draw.permutation(words)))

    rows = [(k, text(k), "en", None, None, None, None) for k in range(150)]
    gibberish = " ".join("".join(draw.choice(list("qxzjkvw"), 6)) for _ in range(21))
    costly = " ".join(f"{w}" for w in "international government information development organization understanding responsibility administration communication environmental professional particularly opportunities significant relationship performance independent traditional experience investigation technology characteristics".split())
    rows += [(500, gibberish, "en", None, None, None, None), (501, costly, "en", None, None, None, None)]
    got = {r.doc_id: r for r in quality_rules.fertility_rules(frame(spark, rows)).collect()}
    assert got[500].n_words >= 20 and not got[500].base_failed and not got[500].kept
    assert got[501].n_words >= 20 and not got[501].base_failed and not got[501].kept
    assert sum(not got[k].kept for k in range(150) if not got[k].base_failed) <= 2


def test_fertility_metrics_by_definition(spark, library):
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.PIECES))
    text = sentences(7, 90) + " café \U0001f600 你好 the the the"
    got = quality_rules.fertility_rules(frame(spark, [(1, text, "en", None, None, None, None)])).first()
    ids = [i for w in text.split() for i in library.encode(" " + w, add_special_tokens=False).ids]
    p = [i for w in text.split() for i in pieces.encode(w)]
    share = np.array(list(Counter(ids).values())) / len(ids)
    chars = sum(map(len, text.split()))
    assert got.chars_per_token == pytest.approx(chars / len(ids))
    assert got.chars_per_piece == pytest.approx(chars / len(p))
    assert got.fallback_share == pytest.approx(sum(pieces.is_byte(i) for i in p) / len(p))
    assert got.token_entropy == pytest.approx(-(share * np.log2(share)).sum())


def test_exact_copies(spark):
    for budget in (200, 48 << 20):  # the small one forces several levels of partitioning
        got = exact_dedup.exact_copies(frame(spark), table_bytes=budget).collect()
        by_text = defaultdict(list)
        for i, t in ROWS:
            by_text[t or ""].append(i)
        want = Counter()
        for t, ids in by_text.items():
            known = [i for i in ids if i is not None]
            for i in ids:
                want[(i, max(known, default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == len(by_text) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_copies(empty(spark)).count() == 0


def test_drop_exact_copies_keeps_whole_rows(spark):
    docs = frame(spark)
    got = exact_dedup.drop_exact_copies(docs)
    assert got.schema.fieldNames() == docs.columns
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len({t or "" for _, t in ROWS})
    assert all(list(r) in [list(x) for x in texts()] for r in rows)
    assert exact_dedup.drop_exact_copies(empty(spark)).count() == 0


def test_content_table_tells_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr(exact_dedup.xxhash, "xxh3_64_intdigest", lambda content: len(content) % 2)
    table = exact_dedup.ContentTable(2)
    words_ = [f"w{k % 50}".encode() for k in range(500)]
    assert [table.add(w) for w in words_] == [k % 50 for k in range(500)]


def test_duplicate_spans(spark):
    for block_bytes in (500, 4 << 20):
        got = substring_dedup.duplicate_spans(frame(spark), block_bytes=block_bytes).collect()
        want = Counter((i, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for (i, _), (n, kept) in zip(ROWS, dedup_spans(ROWS)))
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
        for r in got:  # the factors cover exactly what goes, and name a smaller document
            assert len({j for s in r.spans for j in range(s.start, s.start + s.length)}) == r.n_removed
            assert all(s.length >= 13 and (r.doc_id is None or s.reference < r.doc_id) for s in r.spans)
    assert substring_dedup.duplicate_spans(empty(spark)).count() == 0


def test_drop_duplicate_spans_changes_only_what_it_must(spark):
    docs = frame(spark)
    got = substring_dedup.drop_duplicate_spans(docs, block_bytes=2000)
    assert got.schema.fieldNames() == docs.columns
    spans = dedup_spans(ROWS)
    want = {r[4]: t if n == len(kept) else b" ".join(kept).decode() for r, (_, t), (n, kept) in zip(texts(), ROWS, spans)}
    assert {r.uid: r.text for r in got.collect()} == want
    assert substring_dedup.drop_duplicate_spans(empty(spark)).count() == 0


def test_factors_split_where_the_reference_changes():
    place = np.array([3, 4, 5, 9, 10])
    assert substring_dedup.factors(np.array([1, 1, 1, 1, 1], bool), np.array([7, 7, 8, 8, 8]), place, 13) == [(3, 14, 7), (5, 13, 8), (9, 14, 8)]
    assert substring_dedup.factors(np.zeros(5, bool), np.zeros(5, int), place, 13) == []


def near_rows():
    rows = []
    for g in range(6):
        base = sentences(50 + g, 150).split(" ")
        for k in range(7):
            own = list(base)
            for j in range(k):
                own[10 + 20 * j] = f"edit{g}{j}{k}"
            rows.append((100 * g + k, " ".join(own)))
    chain = sentences(80, 300).split(" ")  # neighbours are alike, ends are not
    for k in range(10):
        rows.append((900 + k, " ".join(chain[8 * k : 8 * k + 150])))
    return rows + ROWS


def test_near_duplicates(spark):
    rows = near_rows()
    docs = frame(spark, [(i, t, None, None, k, None, None) for k, (i, t) in enumerate(rows)])
    got = near_dedup.near_duplicates(docs).collect()
    root = groups(rows)
    ids = defaultdict(list)
    for (i, _), g in zip(rows, root):
        ids[g].append(i)
    low = {g: min((i for i in members if i is not None), default=None) for g, members in ids.items()}
    assert Counter((r.doc_id, r.group_id) for r in got) == Counter((i, low[g]) for (i, _), g in zip(rows, root))
    assert sum(r.kept for r in got) == len(ids)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.schema.fieldNames() == docs.columns and left.count() == len(ids)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_linked_pairs_equal_all_pairs():
    rng = np.random.default_rng(4)
    bags, counts = [], []
    for g in range(5):
        base = np.sort(rng.choice(10_000, 60, replace=False)).astype(np.uint64)
        for _ in range(8):
            keep = rng.random(60) > 0.12
            bags.append(base[keep])
            counts.append(rng.integers(1, 3, keep.sum()))
    n = len(bags)
    similar = lambda a, b: near_dedup.overlap((bags[a], counts[a]), (bags[b], counts[b])) >= near_dedup.SIMILARITY

    def joined(pairs):
        root = list(range(n))
        for a, b in pairs:
            root = [root[a] if x == root[b] else x for x in root]
        return {frozenset(k for k in range(n) if root[k] == r) for r in root}

    got = near_dedup.linked_pairs(bags, counts, np.arange(n), np.arange(n), np.arange(n))
    assert all(similar(a, b) for a, b in got)
    assert joined(got) == joined((a, b) for a in range(n) for b in range(a) if similar(a, b))


def test_pairs_across_components_are_all_found(spark, monkeypatch):
    from fovea.llm.words import pack_numbers

    monkeypatch.setattr(near_dedup, "TILE", 2)
    rows = [[1, 2, 3, 4, 5, 6, 7, 8, 9, 10 + k // 3] for k in range(7)]
    members = spark.createDataFrame([(1, k, 1) for k in range(7)], "band long, uid long, pivot long")
    packed = [(k, bytearray(pack_numbers(np.array(r, np.uint64), True)), bytearray(pack_numbers(np.ones(10, np.uint64)))) for k, r in enumerate(rows)]
    bags = spark.createDataFrame(packed, "uid long, shingles binary, counts binary")
    roots = spark.createDataFrame([(1, 0), (0, 0)], "uid long, root long")
    links = near_dedup._across(members, bags, roots)
    assert links.where("a = 1 AND b = 0").isEmpty()
    joined = near_dedup.components(links.unionByName(spark.createDataFrame([(1, 0)], "a long, b long")))
    assert {r.uid: r.root for r in joined.collect()} == {k: 0 for k in range(7)}


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (200, 201)], "a long, b long")
    got = {r.uid: r.root for r in near_dedup.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 90, 90: 90, 95: 90, 200: 200, 201: 200}


def test_bag_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    a = {k: int(rng.integers(1, 12)) for k in range(60)}
    b = {k: max(1, v + int(rng.integers(-3, 4))) for k, v in a.items() if k % 5}
    union = sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    true = sum(min(v, b.get(k, 0)) for k, v in a.items()) / union
    agree = []
    for seed in range(40):
        hashes = lambda bag: near_dedup.mix(np.array(sorted(bag), np.uint64) + np.uint64(1000 * seed + 1))
        doc = np.repeat([0, 1], [len(a), len(b)])
        shingles = np.concatenate([hashes(a), hashes(b)])
        counts = np.array([a[k] for k in sorted(a)] + [b[k] for k in sorted(b)])
        s = near_dedup.bag_signatures(doc, shingles, counts, 2)
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(true, abs=0.03)


def test_repeated_labelled_ids_are_one_document(spark):
    """Copies of a labelled row change neither the fit nor what the driver gets."""
    good = [(k, sentences(k, 60), None, None, None, None, None) for k in range(60)]
    bad = [(1000 + k, " ".join(w + "$$$" for w in sentences(500 + k, 30).upper().split()), None, None, None, None, None) for k in range(60)]
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad], "doc_id long, quality int")
    once = quality_classifier.fit_quality(frame(spark, good + bad), labels)
    again = quality_classifier.fit_quality(frame(spark, good + bad + good[:20] * 30 + bad[5:9] * 40), labels)
    assert once == again


def test_streaming_bpe(spark, library):
    got = bpe_stream.encode_decode(frame(spark)).collect()
    want = Counter()
    for (i, t), e in zip(ROWS, library.encode_batch([t or "" for _, t in ROWS], add_special_tokens=False)):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(i, len(e.ids), sha(",".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False)))] += 1
    assert Counter(tuple(r) for r in got) == want
    assert bpe_stream.encode_decode(empty(spark)).count() == 0


def test_transducer_equals_the_merge_list_and_stays_small(library):
    import random

    table, rng = bpe_stream.merge_table_of(tokens.byte_bpe()), random.Random(5)
    for alphabet in ("ab", "the ", "aehnrt", "=-*", "é😀x"):
        for size in (1, 3, 40, 300):
            data = "".join(rng.choice(alphabet) for _ in range(size)).encode()
            transducer = bpe_stream.Transducer(table)
            out = []
            for at in range(0, len(data), 7):
                out += transducer.feed(data[at : at + 7])
            assert out + transducer.finish() == table.apply(data)
    transducer, widest = bpe_stream.Transducer(table), 0
    for _ in range(100):
        transducer.feed("".join(rng.choice("aehnrti") for _ in range(512)).encode())
        widest = max(widest, len(transducer.tail))
    assert widest <= 3 * table.lookahead


def test_tokens_emitted_by_the_lookahead_equal_the_library(library):
    """Long single pre-tokens: most of their tokens leave before the end is known."""
    import random

    vocabulary, rng = tokens.byte_bpe(), random.Random(17)
    table = bpe_stream.merge_table_of(vocabulary)
    pieces = [b.decode() for b in vocabulary.bytes_of.values() if b.isascii() and b.isalpha()]
    makers = [lambda: rng.choice("ab"), lambda: rng.choice("aehnrtios"), lambda: rng.choice(pieces), lambda: "aa", lambda: rng.choice(["th", "e", "in", "g"])]
    for make in makers:
        for _ in range(3):
            text = "".join(make() for _ in range(4000))
            data, transducer, out, early = text.encode(), bpe_stream.Transducer(table), [], 0
            while data:
                size = rng.randint(1, 900)
                out += transducer.feed(data[:size])
                data = data[size:]
            early = len(out)
            assert out + transducer.finish() == library.encode(text, add_special_tokens=False).ids
            assert early


def test_text_machine_waits_for_the_rest_of_a_character():
    machine = bpe_stream.TextMachine(tokens.byte_bpe())
    data = "é😀x".encode()
    assert "".join(machine.feed(data[k : k + 1]) for k in range(len(data))) + machine.finish() == "é😀x"


def test_quality_classifier_on_separable_text(spark):
    good = [(k, sentences(k, 80), None, None, None, None, None) for k in range(120)]
    bad = [(1000 + k, " ".join(w + "$$$ ***" for w in sentences(500 + k, 40).upper().split()), None, None, None, None, None) for k in range(120)]
    docs = frame(spark, good + bad + texts())
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(None, 1), (5000, None), (5001, 7)], "doc_id long, quality int")
    got = quality_classifier.score_documents(docs, labels, 0.3).collect()
    assert len(got) == len(good) + len(bad) + len(texts())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in got)
    hits = [(r.predicted == 1) == (r.doc_id < 1000) for r in got if r.doc_id is not None and (30 <= r.doc_id < 120 or r.doc_id >= 1000)]
    assert np.mean(hits) > 0.95
    assert quality_classifier.score_documents(empty(spark), labels, 0.3).count() == 0
    none = quality_classifier.score_documents(docs, labels.where("false"), 0.3)
    assert {r.score for r in none.collect()} == {0.5}


def test_pipeline_stages_keep_the_columns_and_do_their_work(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from fovea.runtime import write_stage

    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(write_stage(stage(spark, frames[-1], sf), "t"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    rows = [[(r.doc_id, r.text) for r in f.collect()] for f in frames[:-1]]
    model = quality_classifier.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = model.scores(quality_classifier.size_features([(t or "").encode() for _, t in rows[0]], model.compressors()))
    assert sorted(i for i, _ in rows[1]) == sorted(i for (i, _), s in zip(rows[0], scores) if s >= 0.3)
    best = {}
    for i, t in rows[1]:
        best[t or ""] = max(best.get(t or "", -1), i)
    assert sorted(i for i, _ in rows[2]) == sorted(best.values())
    root = groups(rows[2])
    first = {}
    for (i, _), g in zip(rows[2], root):
        first[g] = min(first.get(g, i), i)
    assert sorted(i for i, _ in rows[3]) == sorted(first.values())
    want = {i: t if n == len(kept) else b" ".join(kept).decode() for (i, t), (n, kept) in zip(rows[3], dedup_spans(rows[3]))}
    assert dict(rows[4]) == want
    pieces = frames[-1].collect()
    check_packing(pieces, {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows[4]}, 2048)
    assert sum(p.length for p in pieces) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows[4])
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)


def test_pipeline_stages_take_awkward_and_empty_tables(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("score", LongType())])
    sf = "/root/testdata/sf0.001"
    for data in ([(i, t, None, 1) for i, t in ROWS], []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.collect()
