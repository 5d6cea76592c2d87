"""Changed passages whose least shingles are wording that many documents have."""

import random

from chunkgraph.llm import op03_substring_dedup


def test_changed_passages_with_a_frequent_line(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    some = lambda n: [word() for _ in range(n)]
    line = some(44)
    texts = {i: some(20) + line + some(20) for i in range(100)}
    for i in range(60):
        a, b, at = some(6), some(6), rng.randrange(44)
        changed = [*line[:at], word(), *line[at + 1 :]]
        texts[1000 + i] = some(20) + a + line + b + some(20)
        texts[2000 + i] = some(20) + a + changed + b + some(20)
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    found = {(r.doc_id, r.source_id) for r in op03_substring_dedup.duplicate_passages(docs).collect()}
    assert sum((2000 + i, 1000 + i) in found for i in range(60)) >= 57
