"""The stages of the corpus pipeline, each on all that its predecessor kept, and the registered queries."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from keystead.llm import queries
from keystead.llm.common import materialise

from .test_counts import figures, water
from .test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(materialise(stage(spark, inputs[-1], SF), name.replace(" ", "_")))
    assert all(x.columns == columns for x in inputs[:-1])
    raw, good, clean, single, mixed, packed = [x.collect() for x in inputs]
    # quality: exactly the documents that pass the base rules, as so few labels show no cutoff to be safe
    want = {r["doc_id"] for r in raw if (f := figures(r["text"]))[0] >= 50 and 100 * f[4] <= 50 * f[0]}
    assert {r["doc_id"] for r in good} == want and len(good) == len(want)
    # toxicity: labelled clean documents stay
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in good} - {r["doc_id"] for r in clean}
    assert gone and not [i for i in gone if toxic.get(i) == 0]
    # near-duplicates: one of each component
    parts = brute([(r["doc_id"], r["text"]) for r in clean], 5)
    assert sorted(r["doc_id"] for r in single) == sorted(i for i, (_, c) in parts.items() if i == c)
    # mixing: each source meets its target
    sizes, taken = {}, {}
    for r in single:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    for s, target in water(sizes).items():
        assert abs(taken.get(s, 0) - target) < 1 + 1e-6
    whole = {r["doc_id"]: r["text"] for r in single}
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in mixed)
    # packing: the tokens of every text, in sequences of powers of two
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(coder.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r["length"] for r in packed) == total and len({r["sequence_id"] for r in packed}) == len(packed)
    assert all(len(np.frombuffer(bytes(r["ids"]), "<u4")) == r["length"] == 1 << r["bucket"] for r in packed)


def test_run_is_the_stages(spark):
    once, again = (corpus_pipeline.run(spark, SF).drop("sequence_id").collect() for _ in range(2))
    assert once and sorted(map(str, once)) == sorted(map(str, again))


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in queries.QUERIES} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(names)
