"""Parsers of tool outputs: one pass over the outputs for each."""

from lumenfold.operators import diagnostics


def test_each_parser_reads_the_outputs_once(spark, tmp_path):
    texts = ['{"runs": [{"results": null}, {"results": [{"ruleId": "S", "message": {"text": "m"}}]}]}', "FAILED x - a(1,2): error TS1: z", '[{"filename": "a", "code": "E", "message": null}]', "{bad"]
    spark.createDataFrame([(k, "t", x) for k, x in enumerate(texts)], "run_id long, tool string, text string").write.parquet(f"{tmp_path}/o")
    found = diagnostics.parse(spark.read.parquet(f"{tmp_path}/o"))
    got = sorted((r.run_id, r.rule_id, r.file, r.line, r.message) for r in found.collect())
    assert got == [(0, "S", ".", 1, "m"), (1, "TS1", "FAILED x - a", 1, "z"), (1, "pytest", "x", 1, "a(1,2): error TS1: z"), (2, "E", "a", 1, ""), (3, "HAR-2.4", ".", 1, "malformed JSON line"), (3, "HAR-2.4", ".", 1, "malformed JSON payload")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
