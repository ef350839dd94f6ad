"""Samples of toxicity stay in Arrow's memory and give the same model as lists."""

import pyarrow as pa

from lexloom.llm.toxicity import Samples, ToxicityModel, distinct, sampled

TEXTS = [f"the quick fox {k} jumps over lazy dogs near river {k * 7} and town {k * 3} today" for k in range(12)]


def table(docs: list, ids: list[int]) -> pa.Table:
    return pa.table({
        "doc_id": ids, "words": pa.array([list(d.words) for d in docs], pa.list_(pa.binary())), "n": [list(d.words.values()) for d in docs], "runs": [sorted(d.runs) for d in docs],
        "windows": pa.array([d.windows for d in docs], pa.list_(pa.binary())),
    })


def test_samples_are_made_when_asked_for():
    docs = [sampled(t) for t in [*TEXTS, TEXTS[3]]]
    ids = [20 - k for k in range(len(docs))]
    held = Samples.of(table(docs, ids))
    assert list(held) == docs[::-1] and len(held) == 13 and list(held[1::4]) == docs[::-1][1::4]
    assert isinstance(distinct(held), Samples) and list(distinct(held)) == distinct(docs[::-1])


def test_same_model_as_of_lists():
    toxic, ordinary = [sampled(f"{t} hateful wretch") for t in TEXTS], [sampled(t) for t in TEXTS]
    order = list(range(len(TEXTS)))
    a, b = ToxicityModel(toxic, ordinary, 0.5), ToxicityModel(Samples.of(table(toxic, order)), Samples.of(table(ordinary, order)), 0.5)
    assert a.distance.raw == b.distance.raw and all(a.score(t) == b.score(t) for t in TEXTS)


def test_no_samples():
    empty = Samples.of(table([], []).cast(table([sampled("a")], [1]).schema))
    assert not empty and ToxicityModel(empty, empty, 0.25).score("a") == 0.25
