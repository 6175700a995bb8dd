"""The pipeline and its stages, against brute force and on odd tables."""

import re

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from strata.llm import quality, secrets, simhash

A, B, C = "the quick brown fox jumps over the lazy dog again and again", "entirely different words about trains and harbours at night", "numbers seven eight nine stand here alone beside an old wall"
ROWS = [(1, A, "x"), (1, A, "x"), (2, A, "y"), (2, B, "y"), (3, B, "x"), (4, B, "x"), (4, C, "x"), (None, C, "z"), (None, "only null ids hold this one sentence", "z"), (None, "only null ids hold this one sentence", "z"), (9, None, "x"), (9, None, "x")]


def _groups(texts):
    bits = [int(np_bits) & (1 << 64) - 1 for np_bits in map(simhash.fingerprint, texts)]
    group = list(range(len(texts)))
    while (new := [min(group[j] for j in range(len(texts)) if (bits[i] ^ bits[j]).bit_count() <= 3) for i in range(len(texts))]) != group:
        group = new
    return group


def _one_of_each(rows):
    """Of each group the row with the smallest id; rows are tuples that start with id and text."""
    want = {}
    for r, g in zip(rows, _groups([r[1] for r in rows])):
        want[g] = min(want.get(g, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    return list(want.values())


def test_one_row_of_each_group(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    want = _one_of_each(ROWS)
    got = corpus_pipeline.one_of_each(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) == 5


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: odd rows, extra columns, labelled documents."""
    d = tmp_path_factory.mktemp("tables")
    good = [(100 + i, f"{A} and number {i} of the story, told at length by people who write with care. {B}", "g") for i in range(60)]
    bad = [(200 + i, f"BUY!!! now$$$ {i} ### click >>> {i * 7} <<< WIN!!! $$$ {i} ###", "b") for i in range(60)]
    odd = [*ROWS, (5, "key: password = hunter22x " + A, "x"), (6, "word " * 30_000, "x"), (7, "y" * 50_000, "x"), (8, "", "x")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "_row": F.lit(1), "found": F.lit("f"), "p_low": F.lit(2.0)})
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_every_stage_keeps_its_contract(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        rows[name] = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r)[:2] for r in out.collect()], docs.columns, out.columns
        docs = out
    for name, (was, now, before, after) in rows.items():
        assert name == "tokens" or before == after, name
    model = quality.train(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    kept = [r for r in rows["quality"][0] if model.scores([quality.shape_ngrams(r[1] or "", quality.Numbers())])[0] >= 0.5]
    assert sorted(map(repr, rows["quality"][1])) == sorted(map(repr, kept)) and sum(100 <= (r[0] or 0) < 160 for r in kept) > 50 and sum((r[0] or 0) >= 200 for r in kept) < 10
    assert sorted(map(repr, rows["near duplicates"][1])) == sorted(map(repr, _one_of_each(rows["near duplicates"][0])))
    hidden = [r for r in rows["secrets"][1] if r[0] == 5]
    assert len(rows["secrets"][0]) == len(rows["secrets"][1]) and all("hunter22x" not in (t or "") for _, t in rows["secrets"][1]) and (not hidden or "[assign]" in hidden[0][1])
    plain = [r for r in rows["secrets"][0] if not any(re.search(x.pattern, r[1] or "") for x in secrets.RULES)]
    assert set(plain) <= set(rows["secrets"][1])
    assert set(rows["mixing"][1]) == set(rows["mixing"][0]) and len(rows["mixing"][1]) >= len(rows["mixing"][0])
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((d or 0, len(sp.encode(t or "", add_eos=True))) for d, t in rows["tokens"][0])
    assert sorted((r[0] or 0, r[1]) for r in rows["tokens"][1]) == want


def test_run_repeats_itself_and_takes_empty_tables(spark, small, tmp_path):
    first, again = (sorted(map(repr, corpus_pipeline.run(spark, small).collect())) for _ in range(2))
    assert first == again and first
    for t in ("documents", "labels"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
