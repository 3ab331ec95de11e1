"""Links inside large keys of unlike members."""

import random

from graindex.llm import components, neardup


def test_two_alike_members_of_a_key_of_many_unlike_ones_are_joined(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("REFINE", 1), ("STARS", 0)):
        monkeypatch.setattr(components, name, value)
    rng = random.Random(3)
    texts = {i: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for i in range(30)}
    texts[21] = texts[12] + " more"
    items = spark.createDataFrame([(i, [7]) for i in texts], "node long, keys array<long>")
    held = spark.createDataFrame(list(texts.items()), "node long, text string")
    got = components.similar_components(items, lambda nodes: held.join(nodes, "node"), neardup.features, 0.8)
    assert {r.node: r.component for r in got.collect()} == {i: 12 if i == 21 else i for i in texts}
