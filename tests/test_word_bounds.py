"""Words of fixed lists count where SQL's patterns see them: next to letters that are not ASCII too."""

from attestlake.plans import registry
from tests.compare import difference


def test_defining_words_beside_other_letters(spark, tmp_path):
    texts = ["Ciónlas queo. Raro abcd.", "Queñis abcd efgh. Abcd efgh ijkl. Theñ abcd.", "Xis abcd. Is_a abcd. Is abcd.", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "abcd efgh"), (2, "queo")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("I7_extractive_summary", "I17_evidence_sentences"):
        assert difference(spark, name, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path)) is None
