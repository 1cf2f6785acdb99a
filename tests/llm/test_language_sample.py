"""The training sample: copies count once, and pieces do not all come from the start."""

from relaylens.llm import cross_parsing

from helpers import words


def sample(spark, bodies):
    docs = spark.createDataFrame([(i, "xx", t) for i, t in enumerate(bodies)], "doc_id long, lang string, text string")
    return dict(cross_parsing.training_texts(docs))["xx"]


def test_copies_of_a_text_count_once(spark):
    copy = words(30, 999)
    passage = copy.rsplit(None, 1)[0]
    found = sample(spark, [words(30, i) for i in range(10)] + [copy] * 30)
    assert found.count(passage) == 1


def test_a_common_beginning_does_not_fill_the_sample(spark):
    header = words(300, 998)[:cross_parsing.CHARS_PER_DOCUMENT].rsplit(None, 1)[0]
    bodies = [header + " " + words(2000, i) for i in range(60)]
    found = sample(spark, bodies)
    assert len(found) > cross_parsing.CHARS_PER_LANGUAGE // 2
    assert found.count(header[:100]) <= 2
