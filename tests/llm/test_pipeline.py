"""The pipeline's stages: each decision takes effect, clean documents stay, odd tables pass through."""

import corpus_pipeline
from joulegrid.llm import queries
from tests.conftest import DATA

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_copies", "personal_data", "packing"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).checkpoint()
        assert docs.columns == COLUMNS
        now = docs.count()
        assert 0 < now <= before and (name != "personal_data" or now == before)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_odd_documents_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, label double, features string"
    rows = [(None, None, None, None, None, "a", 0.0, "b"), (1, "", "en", "s", 0, "a", 0.0, "b"), (2, "the same words are here", "en", "s", 23, "a", 0.0, "b"), (2, "the same words are here", "en", "s", 23, "a", 0.0, "b"), (3, "mail a@b.example.com to me", "en", None, 26, "a", 0.0, "b")]
    for held in (rows, []):
        docs = spark.createDataFrame(held, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA).checkpoint()
            assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
        if held:
            assert sorted(r["doc_id"] for r in docs.collect()) == [2, 3]
            assert docs.where("doc_id = 3").first()["text"] == "mail [EMAIL] to me"
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == (2 if held else 0)


def test_run_writes_and_rereads(spark):
    assert corpus_pipeline.run(spark, DATA).columns[:3] == ["doc_id", "piece", "start"]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
