import base64
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import pytest
from cases import documents, nothing

from lakewright.llm import mixing, quality_rules, simhash, suffix_dedup
from lakewright.session import materialize, table

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("which", ["tiny", "cases", "nothing"])
def test_stages_in_turn(spark, which):
    import tiktoken

    docs = {"tiny": lambda s: table(s, TINY, "documents"), "cases": documents, "nothing": nothing}[which](spark)
    columns = docs.columns
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialize(stage(spark, steps[-1], TINY), name))
    assert all(s.columns == columns for s in steps[1:-1])
    first, rules, near, exact, mixed, ids = steps
    kept = Counter(r.doc_id for r in quality_rules.judge(first).filter("kept").collect())
    assert Counter(r.doc_id for r in rules.collect()) == kept
    assert {r.doc_id for r in near.collect()} == {r.component_id for r in simhash.near_duplicates(rules).collect()}
    assert {(r.doc_id, r.kept) for r in suffix_dedup.without_repeats(near, text=True).collect()} == {(r.doc_id, r.text) for r in exact.collect()}
    due = Counter()
    for r in mixing.mix(exact).collect():
        due[r.doc_id] += r.taken
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len((r.text or "").encode().split())
    assert +got == +due
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, r.ids) for r in ids.collect()) == sorted((r.doc_id, library.encode_ordinary(r.text or "")) for r in mixed.collect())
    if which == "tiny":
        assert 50 < ids.count()


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, TINY).count() > 50
