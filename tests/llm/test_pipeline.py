import corpus_pipeline
import public_tokenizers
import sentencepiece
from rentlens.llm import decontaminate, forest, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").persist()
    columns, before = docs.columns, docs.count()
    left = {}
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, FOLDER).persist()
        left[name] = docs.count()
        assert docs.columns[: len(columns)] == columns
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert before > left["toxicity"] > left["exact dedup"] >= left["n-gram Jaccard join"] >= left["benchmark decontamination"]
    assert left["SentencePiece encoding and decoding"] == left["benchmark decontamination"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.n_tokens == len(library.encode(r.text)) for r in docs.collect())
    assert decontaminate.matches(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == 0
    assert forest.join(docs).where("n_links > 0 or n_copies > 1").count() == 0


def test_run_keeps_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, model, keep=["doc_id"]).where("toxic_predicted = 0").collect()}
    kept = [r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= clean


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, FOLDER)
        assert docs.count() == 0
