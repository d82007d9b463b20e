import corpus_pipeline as P
from lumenfold.llm import decontaminate, language_id
from tests.llm.test_jaccard import brute as components
from tests.llm.test_packing import check
from tests.llm.test_suffix_dedup import brute as repeats


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = P.S.settle(stage(spark, docs, d), name)
        if name == "packing":
            from tokenizers import Tokenizer

            from lumenfold.llm.packing import tokenizer_path

            assert check(out.collect(), {r.doc_id: r.text for r in docs.collect()}, Tokenizer.from_file(tokenizer_path()), 2048) == 0
            break
        assert out.schema.names == docs.schema.names
        before, after = ({r.doc_id: r.text for r in t.collect()} for t in (docs, out))
        if name == "language-id":
            assert after.keys() == {r.doc_id for r in language_id.language_id(docs).collect() if r.lang_pred != "und" and r.bits_per_byte < 8}
            assert all(len(t) < 60 for i, t in before.items() if i not in after)
        elif name == "jaccard-join":
            assert after.keys() == {c for _, c in components(list(before.items())).values()}
        elif name == "suffix-dedup":
            want = repeats(list(before.items()))
            assert after.keys() == before.keys()
            assert all(0 <= want[i][0] - want[i][1] - len(t.encode()) <= 6 * max(want[i][2], 0) for i, t in after.items())
            assert all(after[i] == before[i] for i in after if not want[i][1])
        else:
            bench = spark.read.parquet(f"{d}/benchmark.parquet")
            assert before.keys() - after.keys() == {r.doc_id for r in decontaminate.leaks(docs, bench).collect()}
        kept[name] = len(after)
        docs = out
    assert list(kept) == ["language-id", "jaccard-join", "suffix-dedup", "decontamination"] and kept["decontamination"] > 100


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "Hello there, my friend.", "en", None, None), (3, "Hello there, my friend.", "en", None, None), (None, "Nobody knows this text.", None, None, 3), (None, "Hello there, my friend.", None, None, 3), (4, "12345", "en", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(str(r.doc_id) for r in P.run(spark, str(tmp_path)).collect() if r.start == 0) == ["3", "None"]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    names = "places component_id comp h n_shingles _leaky row lang_pred id"
    docs = spark.createDataFrame([(1, text, "en", *range(9)), (2, text, "en", *range(9)), (None, text + " eleven twelve", "en", *range(9))], "doc_id long, text string, lang string, " + ", ".join(f"{c} long" for c in names.split()))
    spark.createDataFrame([(5, "far away from all of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = P.S.settle(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", *names.split()]
    assert sorted((str(r.doc_id), r.id) for r in docs.collect()) == [("1", 8), ("None", 8)]
