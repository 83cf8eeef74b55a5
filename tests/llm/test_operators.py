"""Brute force, defined cases and held-out accuracy of the document operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerweave.llm import decontaminate, langid, mixing, passages, queries, simhash
from ledgerweave.llm.suffix_array import common_prefixes, suffix_array

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "...", "en", None, 3), (3, "word " * 30000, "en", "a", 150000), (4, "word", None, "b", 4)]


@pytest.fixture
def odd_dir(spark, tmp_path):
    tmp_path = tmp_path / "odd"
    spark.createDataFrame(ODD, DOC).withColumn("simhash_mark", F.lit(1)).withColumn("mix_size", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "word word word"), (None, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.fixture
def empty_dir(spark, tmp_path):
    tmp_path = tmp_path / "empty"
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op6_passages"])
def test_odd_rows_give_one_row_each(spark, odd_dir, name):
    assert queries.QUERIES[name](spark, odd_dir).count() == len(ODD)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd_dir, empty_dir):
    out = corpus_pipeline.run(spark, odd_dir)
    assert {"simhash_mark", "mix_size", "copy"} <= set(out.columns)
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {3, 4} and {r.lang for r in rows} <= {"en"}  # 4 had no language
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = np.append(rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 60))), 0)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffix_array(s, True).tolist() == want and suffix_array(s, False).tolist() == want
        got = common_prefixes(s, np.array(want))
        for a, b in zip(want[1:], want, strict=False):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert got[a] == n


@pytest.mark.parametrize("hot", [2, 2048])
def test_simhash_links_match_all_pairs(spark, hot):
    rng = np.random.default_rng(0)
    values = set()
    for base in rng.integers(0, 1 << 63, 20):
        for _ in range(15):
            v = int(base)
            for bit in rng.integers(0, 64, int(rng.integers(0, 5))):
                v ^= 1 << int(bit)
            values.add(v - (1 << 64) if v >> 63 else v)
    values = sorted(values)

    def components(pairs):
        parent = {v: v for v in values}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return {v: root(v) for v in values}

    near = [(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "bits long"), hot=hot).collect()
    assert components([(r.a, r.b) for r in links]) == components(near)


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()
    assert langid.UNKNOWN == "und"


def test_mix_is_repeatable_and_capped(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b = mixing.mix(docs), mixing.mix(docs)
    assert a.exceptAll(b).count() == 0 and a.agg(F.max("copy")).first()[0] <= 3


def test_decontamination_in_blocks_equals_one_block(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontaminate.find_contamination(docs.select("doc_id", "text"), bench, keep=["doc_id"])
    many = decontaminate.find_contamination(docs.select("doc_id", "text"), bench, keep=["doc_id"], block_words=200)
    assert one.exceptAll(many).count() == 0


def test_passages_are_found_with_edits_and_clean_documents_are_not(spark):
    rng = np.random.default_rng(5)
    words = lambda n: ["w" + str(x) for x in rng.integers(0, 10**9, n)]
    passage = words(120)
    fuzzy = passage.copy()
    for i in (30, 61, 95):
        fuzzy[i] = "edit"
    rows = [(1, words(80) + passage + words(80)), (2, words(40) + passage), (3, fuzzy + words(60)), (4, words(300)), (5, None)]
    frame = spark.createDataFrame([(i, " ".join(t) if t else None) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(frame).collect()}
    assert set(got) == {2, 3} and {r.first_doc_id for r in got.values()} == {1}
    assert 145 <= got[2].stop <= 160 and 40 <= got[2].start <= 56 and got[3].stop - got[3].start > 95
