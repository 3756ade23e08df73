"""The pipeline against a plain version of its stages, by rows kept and by packed ids."""

from __future__ import annotations

import collections
import zlib

import numpy as np
from tokenizers import Tokenizer

from steppe.llm import langid
from steppe.llm.queries import vocabulary

from .test_operators import brute_counts, brute_label

SF = "/root/testdata/sf0.001"


def plain_languages(spark, docs):
    """Ids of the documents that stay: model and cut-off from the documents to learn from."""
    learn = docs.filter(~langid.held_out(docs["doc_id"]))
    sample = langid._sample(learn, langid.TRAIN_DOCS).select("doc_id", "lang", "text", "aside").collect()

    def counts(rows):
        found = collections.Counter()
        for r in rows:
            for word in langid.LETTERS.findall(r["text"].lower()):
                padded = "\x02" + word + "\x03"
                found.update((r["lang"], padded[i : i + 3]) for i in range(len(word)))
        return [(lang, gram, n) for (lang, gram), n in found.items()]

    def labeller(table):
        own = langid.Labeller(langid.build(table))

        def path_of(words):
            rows = own.rows_of(words)
            return langid.switching_path(own.scores[rows])

        return lambda text: brute_label(table, text, langid.SWITCH, path_of)

    trial = labeller(counts(r for r in sample if not r["aside"]))
    tested = [(r["lang"], *trial(r["text"])) for r in sample if r["aside"]]
    scores = [score for lang, found, score in tested if lang == found]
    cut = langid.MARGIN * float(np.quantile(scores, langid.LOST, method="lower")) if len(scores) >= langid.ENOUGH else 0.3
    final = labeller(counts(sample))
    judged = {r["doc_id"]: final(r["text"] or "") for r in docs.collect()}
    return {k for k, (lang, score) in judged.items() if lang != "und" and score >= max(0.3, cut)}


def plain_classes(texts):
    """Classes of near copies: lists of ids, by all pairs of five-word shingle sets."""
    import re

    sets = {}
    for k, text in texts.items():
        words = re.findall(r"\w+", text.lower())
        n = min(5, len(words))
        sets[k] = frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()
    label, ids = {k: k for k in texts}, sorted(texts)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if texts[a] == texts[b] or sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in ids:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    groups = collections.defaultdict(set)
    for k, v in label.items():
        groups[v].add(k)
    return list(groups.values())


def test_the_pipeline_against_plain_stages(spark):
    import corpus_pipeline
    from steppe.llm.shared import materialize, table

    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    known = materialize(stages["language_id"](spark, docs, SF), "test-known")
    assert {r["doc_id"] for r in known.collect()} == plain_languages(spark, docs)
    good = materialize(stages["quality_rules"](spark, known, SF), "test-good")
    kept = {r["doc_id"] for r in good.collect()}
    want = set()
    for r in known.collect():
        n, _, _, _, repeat = brute_counts(r["text"])
        if n >= 50 and 100 * repeat <= 50 * n:
            want.add(r["doc_id"])
    assert kept == want  # this table has too few labels to certify a cut-off
    one = materialize(stages["ngram_jaccard_join"](spark, good, SF), "test-one")
    left = {r["doc_id"] for r in one.collect()}
    assert one.count() == len(left)
    assert all(len(group & left) == 1 for group in plain_classes({k: texts[k] for k in kept}))
    packed = stages["best_fit_packing"](spark, one, SF).collect()
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = collections.Counter()
    for k in left:
        ids = tokenizer.encode(texts[k], add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            pieces[k, n, at, zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in packed) == pieces


def test_stages_bear_empty_tables_nulls_and_other_columns(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from steppe.llm.shared import materialize

    from .helpers import ROWS, documents, with_clashes

    for docs in (documents(spark, []), with_clashes(documents(spark, ROWS))):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF), f"test-{name}")
            assert docs.columns == columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.agg(F.count_distinct("doc_id")).collect()[0][0] <= docs.count()
