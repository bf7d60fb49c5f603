"""Each operator on edge rows against plain Python, and on an empty table."""

import base64
import hashlib
import math
import re
import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetgraph.llm import audio, language, lm_score, mixing, near_dedup, packing, token_counts, url_filter, warc
from facetgraph.llm.common import held_out
from facetgraph.llm.fingerprint import fingerprint_edits, fingerprints, likeness
from facetgraph.llm.graph import components
from tests_llm_rows import edge_rows, letters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def key(row):
    return tuple((x is None, x) for x in row)


# 1


def test_scores(edge, empty):
    got = lm_score.score_documents(edge, held_out("doc_id", 7)).collect()
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]
    rows = [(r[0], tokens(r[1]), zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2) for r in edge_rows()]
    counts = Counter(w for _, ts, held in rows if not held for w in ts)
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(((d, held, len(ts), sum(counts[w] > 0 for w in ts), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts), 5)) for d, ts, held in rows), key=key)
    assert sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 5)) for r in got), key=key) == wanted
    assert all(r["score"] < 0 for r in got)
    assert lm_score.score_documents(empty, held_out("doc_id", 7)).count() == 0


def test_nothing_to_learn_from(edge):
    got = lm_score.score_documents(edge, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] <= 0 for r in got)


def test_filter_gives_back_levels():
    keys, counts = np.arange(1, 5001, dtype=np.uint64) * np.uint64(977), np.arange(1, 5001)
    part = lm_score.FilterPart.build(lm_score.level_members(keys, counts, 15))
    assert (part.levels(keys, 15) >= lm_score.level_of(counts)).all()
    assert (part.levels(keys, 15) == lm_score.level_of(counts)).mean() > 0.98
    assert (part.levels(keys + np.uint64(1), 15) > 0).mean() < 0.002


def corpus(seed: int, texts: int) -> list[str]:
    """Words of Zipf's law; every third word follows from the one before."""
    pick = np.random.default_rng(seed)
    out = []
    for _ in range(texts):
        words = (pick.zipf(1.3, 200) % 5000).tolist()
        out.append(" ".join(f"w{words[i - 1] * 7 % 4001 if i % 3 == 2 else w}" for i, w in enumerate(words)))
    return out


def quantised(count: int) -> float:
    """The middle of the counts between neighbouring powers of the root of 2."""
    if not count:
        return 0.0
    level = next(q for q in range(200) if 2 ** (q / 2) - 1e-9 <= count < 2 ** ((q + 1) / 2) - 1e-9)
    low = math.ceil(2 ** (level / 2) - 1e-9)
    return (low + max(low, math.ceil(2 ** ((level + 1) / 2) - 1e-9) - 1)) / 2


def test_scores_against_exact_tables_of_the_same_model(spark):
    train, held = corpus(1, 150), [*corpus(2, 10), "", "w1 never seen w1", "w0 w0 w0"]
    rows = spark.createDataFrame([(i, t, i >= len(train)) for i, t in enumerate([*train, *held])], "doc_id bigint, text string, held boolean")
    model, _ = lm_score.train_model(rows.where("not held").select("text"))
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(rows, F.col("held")).collect()}
    words, pairs = Counter(), Counter()
    for t in train:
        tokens = [*t.split(), None]
        words.update(tokens)
        pairs.update(zip([0, *tokens], tokens, strict=False))
    sums = Counter()
    for (h, _), c in pairs.items():
        sums[h] += quantised(c)
    total = sum(map(quantised, words.values()))
    assert 0 < model.false / len(words) < 1e-6
    # m where the singletons balance, by steps
    own = Counter({h: c for h, c in words.items() if h is not None}) + Counter({0: len(train)})
    singles = sum(c == 1 for c in pairs.values()) - sum(c == 1 for c in own.values())
    balance = lambda m: m * sum(quantised(c) / (quantised(c) - 1 + m) for c in own.values() if c > 1) - singles
    assert abs(balance(model.prior)) < 0.01 * singles
    off = []
    for i, t in enumerate([*train, *held]):
        tokens, log = [*t.split(), None], 0.0
        for h, w in zip([0, *tokens], tokens, strict=False):
            single = (quantised(words[w]) + 1) / (total + len(words) + 1)
            seen = own[h] > 0
            log += math.log10((quantised(pairs[h, w]) + model.prior * single) / (sums[h] + model.prior + seen * model.false))
        off.append(abs(got[i] - log) / len(tokens))
    # a few members in a thousand are false by one level
    assert np.median(off) < 0.0005 and max(off) < 0.005


def test_probabilities_sum_to_one(spark):
    train = corpus(3, 400) + ["rare1 w1 rare2 w5 rare3", "many rare1"]
    model, _ = lm_score.train_model(spark.createDataFrame([(t,) for t in train], "text string"))
    words = Counter(w for t in train for w in t.split())
    block = lm_score.Block([" ".join(sorted(words)).encode()])
    n, ids = len(block.hashes), np.asarray([i for i in range(len(block.hashes)) if i != block.begin])
    levels, sums = model.word_levels(block.hashes)
    unseen = 1 / (model.total + model.distinct + 1)
    sized = [w for w, _ in words.most_common()]
    for name in [*sized[:4], *sized[len(sized) // 10 :: len(sized) // 10], "rare1", "rare3"]:
        h = block.numbers[name.encode()]
        history = np.full(len(ids), h)
        log = model.log_probabilities(block.pair_keys(history * n + ids), history, ids, levels, sums)
        other = model.prior * unseen / (sums[h] + model.prior + model.false)
        assert (10.0**log).sum() + other == pytest.approx(1, abs=0.01), name
    unknown = lm_score.Block([b"absent " + b" ".join(sorted(w.encode() for w in words))])
    levels, sums = model.word_levels(unknown.hashes)
    ids = np.asarray([i for i in range(len(unknown.hashes)) if i not in (unknown.begin, 0)])
    history = np.zeros(len(ids), dtype=np.int64)
    log = model.log_probabilities(unknown.pair_keys(history * len(unknown.hashes) + ids), history, ids, levels, sums)
    assert (10.0**log).sum() + unseen == pytest.approx(1, abs=0.01)


def test_parts_of_a_folder_that_is_not_mounted(spark, monkeypatch):
    import pyarrow.fs

    train = corpus(4, 30)
    model, _ = lm_score.train_model(spark.createDataFrame([(t,) for t in train], "text string"), segment_bytes=5000)
    block = lm_score.Block([t.encode() for t in train])
    mapped = model.score(block)
    model.pairs.held.clear()
    model.pairs.kept = 1  # one part at a time
    where = model.pairs.folder.removeprefix("file://")
    remote = pyarrow.fs.SubTreeFileSystem("/", pyarrow.fs.LocalFileSystem())
    monkeypatch.setattr(pyarrow.fs, "FileSystem", type("Store", (), {"from_uri": staticmethod(lambda uri: (remote, where))}))
    assert model.segments > 3 and (model.score(block) == mapped).all() and len(model.pairs.held) == 1


def test_sums_do_not_depend_on_segments(spark):
    train = corpus(5, 40)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id bigint, text string")
    one = {r["doc_id"]: r for r in lm_score.score_documents(rows, F.lit(False)).collect()}
    for r in lm_score.score_documents(rows, F.lit(False), segment_bytes=4000, hot_share=50).collect():
        assert r["score"] == pytest.approx(one[r["doc_id"]]["score"], abs=0.005 * r["n_tokens"]) and r["base_score"] == pytest.approx(one[r["doc_id"]]["base_score"])


def test_packed_arrays_come_back():
    a, b = np.asarray([5, 1 << 60, 7], dtype=np.uint64), np.asarray([1, 300, 2])
    k, v = lm_score.unpack_keys(lm_score.pack_keys(a, b))
    assert k.tolist() == [5, 7, 1 << 60] and v.tolist() == [1, 2, 300]


# 2


def test_edited_texts_and_likeness(edge, empty):
    got = fingerprint_edits(edge).collect()
    assert len(got) == len(edge_rows())
    by_text = {}
    for r in got:
        by_text.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    plain = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] >= 100}
    texts = {r[0]: r[1] for r in edge_rows()}
    for i in range(101, 140):
        t, n = texts[i], texts[i - 1]
        k = len(t) // 3
        assert plain[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
    # down to id 2, whose next is one of the texts of id 1; the last row's next is the first
    digest = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(r)
    chain = [100, *range(12, 1, -1)]
    whole = {i: [t or "" for d, t, *_ in edge_rows() if d == i] for i in [*chain, 1, 139, None]}
    for i, n in zip(chain, [*chain[1:], 1], strict=True):
        assert found[i][0]["edited_sha256"] in {digest(whole[i][0], x) for x in whole[n]}, i
    assert {r["edited_sha256"] for r in found[None]} & {digest(x, whole[139][0]) for x in whole[None]}
    assert sorted(r["n_chars"] for r in found[1]) == sorted(map(len, whole[1])) and found[4][0]["edited_fingerprint"] == ""
    # likeness follows the generalised Jaccard similarity of the weighted words
    weight = lambda t: {w: c * (0.25 + max(len(w) - 2, 0) ** 2) for w, c in Counter(WORD.findall(t)).items()}

    def likeness_of(a, b):
        a, b = weight(a), weight(b)
        both = sum(min(a[w], b[w]) for w in a.keys() & b.keys())
        return both / max(sum(a.values()) + sum(b.values()) - both, 1e-9)

    off = []
    for i in range(101, 140):
        t, n = texts[i], texts[i - 1]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        off += [plain[i]["near_edited"] - likeness_of(t, edited), plain[i]["near_next"] - likeness_of(t, n)]
    assert max(map(abs, off)) < 0.3 and abs(sum(off) / len(off)) < 0.03
    same = {r["fingerprint"] for r in got if r["doc_id"] in (10, 11)}
    assert len(same) == 1
    assert fingerprint_edits(empty).count() == 0


def test_collisions_follow_generalised_jaccard(spark):
    words = [letters(i, 1) + str(i) for i in range(120)]
    pairs = [(i, " ".join(words[: 60 + i]), " ".join(words[i : 60 + i])) for i in range(0, 60, 10)]
    sides = spark.createDataFrame([(i, s, t) for i, *ts in pairs for s, t in enumerate(ts)], "id int, side int, text string")
    sig = fingerprints(sides, ["id", "side"], "text", 256)
    both = sig.where("side = 0").select("id", F.col("sig").alias("a")).join(sig.where("side = 1").select("id", F.col("sig").alias("b")), "id")
    for r in both.select("id", likeness(F.col("a"), F.col("b")).alias("like")).collect():
        weight = lambda w: 0.25 + max(0, len(w) - 2) ** 2
        a, b = (set(t.split()) for t in pairs[r["id"] // 10][1:])
        true = sum(map(weight, a & b)) / sum(map(weight, a | b))
        assert abs(true - r["like"]) < 0.12


# 3


def test_pieces(edge, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    got = packing.pack_documents(edge, BPE).collect()
    ids = [(r[0], np.asarray([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")) for r in edge_rows()]
    wanted = sorted(((d, s, len(x[s : s + 2048]), zlib.crc32(x[s : s + 2048].tobytes()), len(x)) for d, x in ids for s in range(0, len(x), 2048)), key=key)
    assert sorted((tuple(r)[:5] for r in got), key=key) == wanted
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty, BPE).count() == 0


def test_encoder_is_the_tokenizer():
    import random

    from tokenizers import Tokenizer

    tokenizer, encoder, pick = Tokenizer.from_file(BPE), packing.ChunkEncoder(BPE, entries=50), random.Random(5)
    texts = ["".join(pick.choice("ab'sSé ²½ª́ \n\tΣ!.,<|x1漢É") for _ in range(pick.randint(0, 14))) for _ in range(800)] + ["<|endoftext|> a", "it's I'LL we've", None, ""]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_first_fit(seed):
    sizes = np.random.default_rng(seed).integers(1, 101, 200)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
        room += [100] * (b == len(room))
        assert (bins[i], offsets[i]) == (b, 100 - room[b])
        room[b] -= sizes[i]


# 4


def targets_by_rounds(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    left = float(total)
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if out[s] + share * w[s] >= 3 * sizes[s]}
        if not full:
            for s in open_:
                out[s] += share * w[s]
            break
        for s in full:
            left -= 3 * sizes[s] - out[s]
            out[s] = 3.0 * sizes[s]
        open_ -= full
    return out


def test_mix(edge, empty, spark):
    got = mixing.mix_sources(edge).collect()
    sizes = Counter()
    for r in edge_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets, taken = targets_by_rounds(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(edge_rows()) and all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    assert mixing.mix_sources(empty).count() == 0
    again = mixing.mix_sources(edge).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_better_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 2000 else "b") for i in range(2100)], "doc_id bigint, text string, source string")
    quality = spark.range(2100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 8.0).otherwise(1.0).alias("weight"))
    got = mixing.mix_sources(docs.withColumn("source", F.when(F.col("source") == "a", "z").otherwise("a")), quality=quality).where("source = 'z'")
    share = {r[0]: r[1] for r in got.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg((F.col("taken") % 10 + F.col("taken") / 10 % 1).cast("double") * 0 + F.col("taken"))).collect()}
    assert share[0] > share[1]


def test_cut_to_mix_takes_what_was_planned(edge):
    mixed = mixing.mix_sources(edge)
    out = mixing.cut_to_mix(edge, mixed)
    assert out.columns == edge.columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in out.collect())
    assert words == mixed.agg(F.sum("taken")).first()[0]


# 5


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def groups(rows):
    """Lists of the ids that links and copies connect."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            same = (rows[i][1] or "").lower().split() == (rows[j][1] or "").lower().split()
            if same or both and both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return list(out.values())


def least(group):
    return min((x for x in group if x is not None), default=None)


def classes(rows):
    return sorted(((d, least(g), len(g)) for g in groups(rows) for d in g), key=key)


def test_near_duplicate_classes(edge, empty):
    got = near_dedup.near_duplicates(edge).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=key) == classes([r[:2] for r in edge_rows()])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_large_buckets_go_on_by_neighbours(spark):
    base = letters(7, 200).split()
    rows = []
    for i in range(60):  # one family that isn't linked throughout: neighbours are, its ends aren't
        words = list(base)
        for j in range(i):
            words[3 * j] = f"x{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.near_duplicates(docs, whole=3).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=key) == classes(rows)



def test_links_between_nodes_that_never_led(spark):
    base = [f"w{i}" for i in range(400)]
    edited = lambda *places: " ".join("x" + w if i in places else w for i, w in enumerate(base))
    middle = range(200, 260, 10)
    a1, a2, c2, c1 = edited(*range(10, 70, 10)), edited(), edited(*middle), edited(*middle, *range(300, 360, 10))
    texts = [a1, c1, *(letters(500 + i, 60) for i in range(30)), a2, c2]  # a1 and c1 come first, a2 and c2 last
    last, end = len(texts) - 2, len(texts) - 1
    sets = [near_dedup.Shingles([t.split()]).key for t in texts]
    like = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    assert min(like(0, last), like(1, end), like(last, end)) >= 0.8 > max(like(0, 1), like(0, end), like(1, last))
    bands = np.arange(near_dedup.BANDS, dtype=np.int64).tobytes()  # all in the same buckets
    nodes = spark.createDataFrame([(i, near_dedup.text_key(t.split()), i, len(sets[i]), bands) for i, t in enumerate(texts)], "node bigint, text_key binary, least_id bigint, n bigint, bands binary")
    links = near_dedup.all_links(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), nodes, 0.8, 24, 500_000)
    assert {r["node"]: r["root"] for r in components(links).collect()} == dict.fromkeys([0, 1, last, end], 0)


def test_prefixes_miss_no_pair(spark):
    pick = np.random.default_rng(3)
    family = [set(range(60))]
    while len(family) < 80:
        old = family[pick.integers(len(family))]
        family.append((old - set(pick.choice(sorted(old), 3, replace=False).tolist())) | set(pick.integers(60, 2000, pick.integers(0, 7)).tolist()))
    sets = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(family)], "node bigint, s array<bigint>")
    mixed = sets.select("node", F.col("node").alias("root"))
    found = near_dedup.check(near_dedup.crossing_pairs(mixed, sets, 0.8, 500_000), sets, 0.8)
    wanted = {(i, j) for j in range(80) for i in range(j) if len(family[i] & family[j]) >= 0.8 * len(family[i] | family[j]) - 1e-9}
    assert wanted and {tuple(r) for r in found.collect()} == wanted


def test_classes_of_a_corpus_against_all_pairs(spark):
    """No link between texts is lost: shared shingles are counted for all pairs, large families included."""
    base = letters(11, 150).split()
    rows = [(f"{i}", letters(2000 + i, 40)) for i in range(200)]
    pick = np.random.default_rng(5)
    for i in range(150):  # pairs of a family are like each other about the threshold
        words = list(base)
        for j in pick.choice(150, 1 + i % 3, replace=False):
            words[j] = f"changed{i}x{j}"
        rows.append((f"f{i}", " ".join(words)))
    passage = letters(12, 60)
    rows += [(f"p{i}", f"{letters(3000 + i, 12)} {passage} {letters(4000 + i, 12 + i % 40)}") for i in range(100)]
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string"), whole=8)
    found = sorted(map(tuple, got.select("doc_id", "class_id", "class_size").collect()))
    assert found == classes([(i, t) for i, (_, t) in enumerate(rows)])
    sizes = sorted(size for size in {(c, n) for _, c, n in found})
    assert max(n for _, n in sizes) > 20 and sum(n == 1 for _, n in sizes) > 200


def test_one_row_of_each_class_stays(edge):
    kept = near_dedup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted(((r["doc_id"],) for r in kept.collect()), key=key) == sorted(((least(g),) for g in groups([r[:2] for r in edge_rows()])), key=key)


def test_dart_collisions_follow_weighted_jaccard():
    keys = near_dedup.mix(np.arange(1, 61, dtype=np.uint64))
    a, b = np.arange(60) % 7 + 1, np.arange(60) % 5 + 1
    doc = np.repeat([0, 1], 60)
    sig = near_dedup.dart_signatures(doc, np.concatenate([keys, keys]), np.concatenate([a, b]), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    got = {r[0]: r[1] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


# 6


def test_counts_are_greedy(edge, empty):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    longest = max(map(len, pieces))

    def greedy(word):
        word, at, n = "\u2581" + word, 0, 0
        while at < len(word):
            # inside a word the marker is a letter, which only pieces with the marker further in hold
            step = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces and not (at and word[at] == "\u2581")), 0)
            if not step:
                return None
            at, n = at + step, n + 1
        return n

    wanted = []
    for r in edge_rows():
        counts = [greedy(w) for w in WORD.findall(r[1] or "")]
        wanted.append((r[0], len(counts), sum(c or 1 for c in counts), counts.count(None)))
    assert sorted(map(tuple, token_counts.count_tokens(edge, PIECES).collect()), key=key) == sorted(wanted, key=key)
    assert token_counts.count_tokens(empty, PIECES).count() == 0
    assert greedy("10.20.30.40") and greedy("10.20.30.40") > 5


def test_failure_links_on_a_small_vocabulary():
    counter = token_counts.PieceCounter(["a", "abcdx"], ["b", "c", "cdy", "dz"])
    assert [counter.count(w) for w in ("abcdx", "abcdy", "abcdz", "abc", "abcd", "q", "aq", "b")] == [1, 3, 4, 3, -1, -1, -1, -1]
    bare = token_counts.PieceCounter(["", "ab", "abcx"], ["a", "b", "c"])
    # "ac" has no initial piece but the marker; "abc" goes on after "ab"
    assert [bare.count(w) for w in ("ab", "ac", "b", "abc", "abcx", "abca", "x")] == [1, 3, 2, 2, 1, 3, -1]


# 7


def test_rules_and_globs(spark):
    rules = [url_filter.UrlRule("block", "net/"), url_filter.UrlRule("allow", "example.net/en/"), url_filter.UrlRule("block", "example.com/de/")]
    urls = ["http://a.Example.NET/en/x", "https://example.net/EN/x", "x://net/", "x://net", "x://internet/", "http://q.com/a.net/", "http://example.com/de/?q#f", "http://example.com/d", None, "", "no scheme", "a://b://net/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[i][2] for i in range(1, 12)] == ["net/", "net/", None, None, None, "example.com/de/", None, None, None, None, None]
    assert got[8] == ("", "", None, "allow") and url_filter.filter_urls(pages.where("false"), rules).count() == 0


def test_automaton_agrees_with_regular_expressions():
    import random

    pick, globs = random.Random(3), ["a*b", "*.c/*", "?b?", "~.a/b*", "a\\*b", "*", "ab" * 70 + "*"]
    texts = ["".join(pick.choice("ab.c/*") for _ in range(pick.randint(0, 9))) for _ in range(500)] + ["ab" * 70 + "x", "ab" * 69]
    raw = [t.encode() for t in texts]
    machine = url_filter.GlobAutomaton(globs)
    states = machine.run(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), dtype=np.uint8))
    for i, glob in enumerate(globs):
        pattern = re.compile("".join({"*": ".*", "~": "[^/]*", "?": "."}.get(p, re.escape(p[-1])) for p in re.findall(r"\\.|.", glob)), re.DOTALL)
        assert machine.matched(states, i).tolist() == [bool(pattern.fullmatch(t)) for t in texts]


# 8


def test_media_round_trip(edge, empty):
    got = audio.text_audio_features(edge).collect()
    by_text = {}
    for r in got:
        by_text.setdefault((r["payload_sha256"], r["n_bytes"]), set()).add((r["feature"], bytes(r["tensors"])))
    assert all(len(v) == 1 for v in by_text.values())
    wanted = []
    for r in edge_rows():
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        media = audio.encode_wav(payload, 16000)
        wanted.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(wanted, key=key)
    assert audio.text_audio_features(empty).count() == 0
    table = pa.ipc.open_stream(bytes(got[0]["tensors"])).read_all()
    assert table.schema.field("log_mel").type.shape == [32, 32]


def test_thin_features_come_from_stored_waves_and_tensors(edge):
    thin = audio.text_audio_features(edge, keep_tensors=False)
    (folder,) = {f.rsplit("/", 1)[0] for f in thin.inputFiles()}
    stored = edge.sparkSession.read.parquet(folder).collect()
    assert len(stored) == len(edge_rows())
    wanted = []
    for r in stored:
        mels, energy = audio.log_mel(np.frombuffer(audio.decode_wav(bytes(r["media"]))[0], dtype=np.uint8), audio.AudioSettings())
        assert np.array_equal(audio.frames_of(bytes(r["tensors"]), r["frames"]), mels)
        wanted.append((r["doc_id"], hashlib.sha256(r["media"]).hexdigest(), len(mels), f"{float(energy.mean()):.2f}"))
    got = [(r["doc_id"], r["media_sha256"], int(r["feature"].split(";")[0][7:]), r["feature"].split(";")[2][6:]) for r in thin.collect()]
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_blocks_change_nothing():
    samples = np.random.default_rng(1).integers(0, 256, 100_000).astype(np.uint8)
    a, _ = audio.log_mel(samples, audio.AudioSettings(block=64))
    b, _ = audio.log_mel(samples, audio.AudioSettings(block=4096))
    assert np.allclose(a, b, atol=1e-4)


def test_resampling_against_convolution():
    samples = np.random.default_rng(2).integers(0, 256, 500).astype(np.uint8)
    for up, down in ((1, 2), (2, 3), (3, 1)):
        filters = audio.resampler(up, down, 8)
        flat = filters.T.ravel().astype(np.float64)
        wide = np.zeros(500 * up)
        wide[::up] = (samples.astype(np.float64) - 128) / 128
        full = np.convolve(wide, flat)[::down]
        n = 500 * up // down
        assert np.allclose(audio.resample(samples, 0, n, up, down, 8), full[:n], atol=1e-4)


def test_hysteresis():
    assert audio.active_spans(np.asarray([0, 5, 3, 1, 3, 6, 2, 0]), 5, 2) == [(1, 3), (5, 7)]


# 9


def test_marginals_against_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    model = language.CrfModel(["x", "y"], np.zeros((1 << language.BITS, 2), dtype=np.float32), rng.normal(size=(2, 2)).astype(np.float32), set())
    lengths = np.asarray([4, 2, 1])
    e = rng.uniform(0.1, 1, size=(7, 2)).astype(np.float32)
    got, at = model.marginals(e.copy(), lengths), 0
    for n in lengths:
        p = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.prod([e[at + i, s] for i, s in enumerate(path)]) * np.exp(sum(model.transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, s in enumerate(path):
                p[i, s] += w
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True), atol=1e-4)
        at += n


def test_languages_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train_language_model(docs, ~held_out("doc_id", 4))
    got = language.predict_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id", 4))
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.9


def test_languages_on_edge_rows(edge, empty):
    model = language.train_language_model(edge, F.lit(True))
    got = language.predict_language(edge, model).collect()
    assert len(got) == len(edge_rows())
    bare = [r for r in got if r["lang_pred"] == "und"]
    assert len(bare) == sum(not any(c.isalpha() for c in r[1] or "") for r in edge_rows())
    assert all(r["score"] == 0 for r in bare) and all(0 <= r["score"] <= 1 for r in got)
    kept = language.predict_language(edge, model, keep_rows=True)
    assert kept.select("row.*").columns == edge.columns
    nothing = language.train_language_model(empty, F.lit(True))
    assert {r["lang_pred"] for r in language.predict_language(edge, nothing).collect()} == {"und"}
    assert language.predict_language(empty, model).count() == 0


def test_all_letters_of_a_run_count():
    model = language.fit_crf([(letters(i, 200), "a") for i in range(10)] + [(letters(i, 200).translate(str.maketrans("abcdefghij", "qrstuvwxyz")), "z") for i in range(10)])
    front, rest = letters(50, 10).replace(" ", "")[:48], letters(51, 2000).replace(" ", "").translate(str.maketrans("abcdefghij", "qrstuvwxyz"))
    assert "".join(language.word_pieces(f"{front}-{rest} 12 {front}")) == f"{front}{rest}12{front}"
    best, share, switches = model.predict([language.word_pieces(front + rest), language.word_pieces(rest), ["-" * 60]])
    assert [model.labels[i] for i in best[:2]] == ["z", "z"] and best[2] == -1
    assert abs(share[0] - len(rest) / len(front + rest)) < 0.01 and switches.tolist()[:2] == [1, 0]


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


class Words(list):
    """A list that can be watched."""

    __hash__ = object.__hash__
    __eq__ = object.__eq__


def test_words_of_judged_texts_are_not_kept(monkeypatch):
    model = language.fit_crf([(letters(i, 200), "a") for i in range(10)])
    alive, most, marginals = weakref.WeakSet(), [], model.marginals

    def texts():
        for i in range(50):
            words = Words(letters(i, 20).split())
            alive.add(words)
            yield words

    monkeypatch.setattr(model, "marginals", lambda *x: most.append(len(alive)) or marginals(*x))
    assert len(model.predict(texts())[0]) == 50
    assert most and max(most) <= 1, most


def test_texts_are_judged_alike_however_many_words_are_met():
    model = language.fit_crf([(letters(i, 200), "a") for i in range(10)] + [(letters(i, 200).translate(str.maketrans("abcdefghij", "qrstuvwxyz")), "z") for i in range(10)])
    texts = [letters(i, 30).split() + letters(i, 9 + i).translate(str.maketrans("abcdefghij", "qrstuvwxyz")).split() for i in range(30)]
    whole = model.predict(texts)
    model.entries = 100
    model.forget()
    for got in (model.predict(texts), model.predict(iter(texts)), [np.concatenate(x) for x in zip(*(model.predict([t]) for t in texts), strict=True)]):
        assert got[0].tolist() == whole[0].tolist() and np.allclose(got[1], whole[1], atol=1e-5) and got[2].tolist() == whole[2].tolist()


def test_parts_of_a_batch_are_signed_one_at_a_time():
    texts = [letters(at, 300) for at in range(2000)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    lists, first = [], []
    mb = peak_mb(lambda: first.append(next(near_dedup._parts(batch, 1))[0].num_rows))
    assert sum(len(t or "") for t in texts) > 3_000_000 and mb < 16, mb
    for part, words in near_dedup._parts(batch, 1):
        lists += words
        assert part.num_rows == len(words) <= first[0] + 100
    assert lists == [near_dedup.words_of(t) for t in texts]


# 10


def test_archives(spark):
    body = "<p>x</p>"
    rows = [(5, "http://a/", body), (3, "http://b.a/x", body), (3, "http://b.a/x", body), (3, "http://b.a/y", body), (8, None, None), (9, "http://A/ é", ""), (None, "http://n/", "only"), (None, "http://m/", "only"), (None, "http://n/", body), (7, "http://www.a/", "ü" * 100_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, size string")
    got = warc.archive_pages(pages, archive_bytes=1 << 12).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    wanted, done = [], set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw, lead = (html or "").encode(), first.get(html or "")
        response = (html or "") not in done
        done.add(html or "")
        wanted.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else lead))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(wanted, key=key)
    order = sorted(got, key=lambda r: (r["history_range"], r["history_position"]))
    keys = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in order]
    assert keys == sorted(keys)
    assert warc.archive_pages(pages.where("false")).count() == 0
    small = warc.archive_pages(pages, smallest=10**9).collect()
    assert all(r["record_type"] == "response" for r in small)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7])
def test_loser_tree(k):
    runs = [sorted(np.random.default_rng(i).integers(0, 50, i * 3).tolist()) for i in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)
