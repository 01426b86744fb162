"""Benchmark items of under five words in the pipeline's filter."""

from chronoterra.llm import decontamination


def test_a_short_item_counts_where_it_is_the_whole_document(spark):
    items = spark.createDataFrame([("b1", "Hello world"), ("b2", None), ("b3", ""), ("b4", "one two three four five six")], "item_id string, text string")
    texts = ["hello, WORLD!", "say hello world now", "hello", "hello world hello world again", "so one two three four five six", None, ""]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()) == [1, 2, 3, 5, 6]
