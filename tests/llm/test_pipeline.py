"""The pipeline against the operators applied one after another in plain Python."""

import collections

import corpus_pipeline
import numpy as np
from test_operators import check_packing, plain_components, plain_quality

from tickloom.llm import secrets, toxicity
from tickloom.llm.tokens import byte_encoder


def test_pipeline_equals_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {i: t for i, t in docs.select("doc_id", "text").collect() if model.score(t) < 0.5}

    def clean(text):
        n_words, chars, symbols, dup_lines, _, base = plain_quality(text)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n"))
        capitals = sum("A" <= c <= "Z" for c in text)
        odd = chars < 2 * n_words or chars > 15 * n_words or 2 * (len(text) - capitals) < len(text)
        return not (base or odd or 10 * symbols > n_words or 10 * dup_lines > 3 * lines)

    kept = {i: t for i, t in kept.items() if clean(t or "")}
    kept = {i: kept[i] for i, (_, c) in plain_components(kept).items() if c == i}
    network = secrets.fit(docs.where(docs.doc_id.isin(list(kept))))
    kept = {i: secrets.redact(t, s) for (i, t), s in zip(kept.items(), secrets.all_spans(list(kept.values()), network))}
    found = corpus_pipeline.run(spark, sf).collect()
    check_packing(found)
    ids = collections.defaultdict(dict)
    for r in found:
        ids[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4")
    encoder = byte_encoder()
    assert ids.keys() == kept.keys()
    for i, parts in ids.items():
        assert np.concatenate([parts[k] for k in sorted(parts)]).tolist() == [*encoder.whole(kept[i]), 1]


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]
