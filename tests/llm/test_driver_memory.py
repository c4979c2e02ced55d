"""What the driver holds while models are fitted and plans are made."""

import re
import tracemalloc

import numpy as np

from loofold.llm import components, language, secrets


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_generated_findings_and_rounds_of_components_have_small_plans(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    assert len(plan(secrets.generated(spark, words, 100, 5))) < 150_000  # 345,000 when each kind held its words
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string")
    assert len(re.findall(r"\bJoin Inner", plan(components._star(edges)).split("== Optimized Logical Plan ==")[1])) <= 2


def test_language_fit_holds_features_of_some_words_at_a_time():
    rng = np.random.default_rng(1)
    words = ["".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (40_000, 9)).tolist()]
    pairs = [(i % 2, " ".join(words[i * 100 : i * 100 + 100]).encode()) for i in range(400)]
    tracemalloc.start()
    model = language.fit(["a", "b"], pairs, language.Training(steps=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    feature, _ = language.word_features(language.cleaned([w.encode() for w in words]), model.lexicon)
    assert peak < 4 * feature.nbytes
