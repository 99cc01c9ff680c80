"""Insults that few of many toxic texts have."""

from oddsframe.llm import toxicity
from tests.llm import brute


def test_rare_insults_are_learned_however_many_texts_there_are(spark):
    clean = ["the weather is fine and the garden grows", "a letter came from the town hall today", "we walked along the river until night", "she reads a long book about trains"]
    ids = [k for k in range(9000) if not brute.held_out(k)]
    rare = ids[::2][:6]
    docs = [(k, f"{clean[n // 2 % 4]} {k}" + (f" {'fuddlewump' if k in rare else 'stinkface'}" if n % 2 == 0 else "")) for n, k in enumerate(ids)]
    marks = [(k, 0, 1 - n % 2) for n, k in enumerate(ids)]
    machine = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert len(ids) // 2 // 500 > len(rare)  # fewer than one in 500 of the toxic texts
    texts = [f"{clean[0]} fuddlewump", f"{clean[1]} stinkface", *clean]
    worst, scores = machine.worst(texts)[:, 0], machine.score(texts)
    assert (worst[:2] > 0).all() and (worst[2:] < 0).all(), worst
    assert (scores[:2] > 0.5).all() and (scores[2:] < 0.5).all(), scores
