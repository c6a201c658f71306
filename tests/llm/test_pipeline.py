import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from runledger.llm import decontaminate, near_dedup, quality_rules
from tests.llm import test_decontaminate, test_line_dedup, test_near_dedup, test_quality_rules
from tests.llm.conftest import documents, prose

SF = "/root/testdata/sf0.001"


def line_dedup(rows):
    """Texts after the rule of line dedup."""
    holders = {}
    for d, t, _ in rows:
        for line in t.split("\n"):
            key = test_line_dedup.key_of(line)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return [
        (d, "\n".join(x for x in t.split("\n") if d >= gone.get(test_line_dedup.key_of(x), d)), s) for d, t, s in rows
    ]


def test_run_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {eval(r)[0] for r in test_quality_rules.brute(rows) if eval(r)[-1]}
    rows = line_dedup([r for r in rows if r[0] in kept])
    classes = test_near_dedup.classes_of([(d, t) for d, t, _ in rows])
    rows = [r for r in rows if classes[r[0]] == r[0]]
    leaked = {eval(x)[0] for x in test_decontaminate.brute([(d, t) for d, t, _ in rows], items)}
    rows = [r for r in rows if r[0] not in leaked]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d, len(tokenizer.encode(t, add_special_tokens=False).ids)) for d, t, _ in rows)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert len(want) > 50 and sorted(map(tuple, got)) == want


def test_stages_keep_columns_and_take_empty_tables(spark):
    for rows in ([], [(None, None), (1, None), (1, ""), (2, "x y z " * 30)]):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_stages_keep_columns_with_dotted_names(spark):
    docs = documents(spark, [(1, prose(1, 80)), (2, prose(1, 80)), (3, prose(2, 80) + "\n")]).withColumnRenamed("row", "a.b")
    docs = docs.withColumnRenamed("key", "c`.d")
    benchmark = spark.createDataFrame([(7, prose(2, 40))], "item_id long, text string")
    deduped = line_dedup_stage(spark, docs)
    assert deduped.columns == docs.columns and deduped.count() == 3
    assert quality_rules.keep_good(docs).columns == docs.columns
    kept = near_dedup.keep_one_per_class(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    clean = decontaminate.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns and {r["a.b"] for r in clean.collect()} == {"x"}


def line_dedup_stage(spark, docs):
    return dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "")
