"""The pipeline against its stages done by hand on a small table."""

import itertools
from hashlib import sha256

import public_tokenizers
import sentencepiece
from near_brute import bag, components, slow_jaccard

import corpus_pipeline
from twinfold.llm import language_id, quality
from twinfold.llm.common import table, word_hashes
from twinfold.llm.decontaminate import MIN_SCORE, align

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_another(spark):
    docs = table(spark, SF, "documents")
    kept = language_id.keep_known(docs)
    kept = quality.keep_good(kept, table(spark, SF, "labels"))
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert 0 < len(texts) < docs.count()
    bags = {i: bag(t) for i, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(texts), 2)
             if len(bags[a].keys() & bags[b].keys()) > 0.3 * min(len(bags[a]), len(bags[b])) and slow_jaccard(bags[a], bags[b]) >= 0.8 - 1e-9]
    root = components(sorted(texts), links)
    first = {i: texts[i] for i in texts if root[i] == i}
    assert len(first) < len(texts)
    items = [word_hashes([r.text])[0] for r in table(spark, SF, "benchmark").collect()]
    clean = {}
    for i, text in first.items():
        words = word_hashes([text])[0]
        if not any(align(words, x)[0] / len(x) >= MIN_SCORE for x in items):
            clean[i] = text
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = set()
    for i, text in clean.items():
        ids = sp.encode(text, add_eos=True)
        want.add((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(sp.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_stages_keep_the_columns_and_bear_empty_tables(spark):
    docs = table(spark, SF, "documents")
    odd = docs.limit(3).union(spark.createDataFrame([(None, None, None, None, None), (7, "", None, "s", 0)], docs.schema))
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()
