"""The pipeline next to its stages done plainly, one after the other."""

import math

import public_tokenizers

import corpus_pipeline
from clausemill.llm import quality
from clausemill.session import load
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    rows = [(r.doc_id, r.text, r.source) for r in load(spark, SF, "documents").collect()]
    items = [r.text for r in load(spark, SF, "benchmark").collect()]
    failed = [q[-1] for q in brute.quality([t for _, t, _ in rows])]
    hosts = {}
    for f, (_, _, s) in zip(failed, rows):
        hosts.setdefault(s, []).append(f)
    a, b = quality.prior(len(hosts), len(rows), sum(failed), sum(sum(h) ** 2 / len(h) for h in hosts.values()))
    good = {s for s, h in hosts.items() if (sum(h) + a) / (len(h) + a + b) <= 0.5}
    docs = [(d, t) for f, (d, t, s) in zip(failed, rows) if not f and s in good]
    docs = list(zip([d for d, _ in docs], brute.line_dedup(docs)))
    first = set(brute.near_classes(docs)[0])
    docs = [(d, t) for d, t in docs if d in first]
    docs = [(d, t) for d, t in docs if not any(brute.is_leak(t, i) for i in items)]
    lengths = {d: len(brute.token_ids(public_tokenizers.path("byte_bpe_50k.json"), t)) + 1 for d, t in docs}
    found = {}
    for r in got:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == lengths
    assert len({r.sequence_id for r in got}) <= math.ceil(1.03 * sum(lengths.values()) / 1024) + 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
