"""The counterfactual penalty at the strength that the query and the pipeline use."""

import inspect

from cohortspark.llm import toxicity as T
from test_toxicity import corpus


def test_default_strength_narrows_the_gap(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    gaps = []
    for options in ({"counterfactual": 0.0}, {}):
        a, b = T.score_texts([b"the muslims met", b"the christians met"], T.train(docs, lab, **options), {})
        gaps.append(abs(a - b))
    print("gaps", gaps)
    assert inspect.signature(T.train).parameters["counterfactual"].default == 1.0
    assert gaps[1] < 0.25 * gaps[0]
