"""The pipeline on edge rows, stage by stage against plain Python."""

import re
from collections import Counter

import public_tokenizers
from tests_llm_rows import edge_rows
from tokenizers import Tokenizer

import corpus_pipeline
from facetgraph.llm import language
from facetgraph.llm.common import held_out


def test_stages_keep_what_they_should(spark, edge, tmp_path):
    edge.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = {r[1] for r in edge_rows()}
    stage = dict(corpus_pipeline.STAGES)

    spoken = stage["language"](spark, docs, str(tmp_path))
    assert spoken.columns == docs.columns
    assert {t for t in rows if t and any(c.isalpha() for c in t)} >= {r["text"] for r in spoken.collect()}
    assert not any(r["text"] is None or not any(c.isalpha() for c in r["text"]) for r in spoken.collect())

    single = stage["near_dedup"](spark, spoken, str(tmp_path))
    keys = [" ".join(r["text"].lower().split()) for r in single.collect()]
    assert single.columns == docs.columns and len(keys) == len(set(keys))

    mixed = stage["mixing"](spark, single, str(tmp_path))
    assert mixed.columns == docs.columns
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in df.collect())
    assert abs(words(mixed) - words(single)) <= single.select("source").distinct().count()

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stage["packing"](spark, mixed, str(tmp_path))
    assert sum(r["length"] for r in packed.collect()) == sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_run_on_an_empty_table(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_draws_by_labels(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} " * 10, "en", "ab"[i % 2], 40) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, i // 2 % 2) for i in range(400)], "doc_id long, quality long").write.parquet(str(tmp_path / "labels.parquet"))
    taken = corpus_pipeline.mix(spark, docs, str(tmp_path)).groupBy("doc_id").count().collect()
    # source a: weights 5 and 2 of 400 documents make an epoch and 3/7; b: 4/7 of an epoch
    extra = [r["doc_id"] // 2 % 2 for r in taken if r["count"] > 1 or r["doc_id"] % 2]
    assert len(extra) > 150 and sum(extra) / len(extra) > 0.6


def test_run_on_edge_rows(spark, edge, tmp_path):
    edge.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, i % 2) for i in range(40)], "doc_id long, quality long").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language.train_language_model(docs, ~held_out("doc_id", 4))
    texts = [r[1] for r in edge_rows()]
    best, share, _ = model.predict([language.word_pieces(t) for t in texts])
    spoken = {" ".join(t.lower().split()) for t, b, s in zip(texts, best, share, strict=True) if b >= 0 and s >= corpus_pipeline.LEAST_SURE}
    shingles = {t: Counter(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in spoken}
    kept = []  # edge rows have no chains of near copies: each text is like the first of its class
    for t in sorted(spoken, key=lambda t: min((r[0] is None, r[0] or 0) for r in edge_rows() if r[1] and " ".join(r[1].lower().split()) == t)):
        if all((shingles[t] & shingles[k]).total() < 0.8 * (shingles[t] | shingles[k]).total() for k in kept):
            kept.append(t)
    words = sum(len(t.split()) for t in kept)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs_of = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        docs_of.setdefault(r["doc_id"], []).append(r["length"])
    ids = {r[0] for r in edge_rows() if r[1] and " ".join(r[1].lower().split()) in kept}
    assert len(spoken) > 40 and words > 30_000
    assert docs_of and set(docs_of) <= ids
    full = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in edge_rows() if r[0] and r[0] >= 100}
    assert sum(sum(n) % full[i] != 0 for i, n in docs_of.items() if i in full) <= 4  # one cut document a source
