"""Phrases of the registered keyword query."""

from carteggio.plans import reports


def test_source_keywords_has_three_words(spark, tmp_path):
    docs = [(1, "registro carico scarico", "a"), (2, "fanghi depurazione", "b"), (3, None, "a")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["source"], r["term"]) for r in reports.source_keywords(spark, str(tmp_path)).collect()}
    assert ("a", "registro carico scarico") in got and ("b", "fanghi depurazione") in got
