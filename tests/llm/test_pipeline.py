import re

import corpus_pipeline
from kelvane.llm import jaccard_join, pii

COLS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def test_pipeline_by_brute_force(spark):
    """Each stage's decisions, remade in plain Python where they are exact."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "token_ids":
            assert docs.columns == start.columns
    told = {r["doc_id"]: r for r in start.collect()}
    lang = kept["language"].collect()
    assert {r["doc_id"] for r in lang} >= {i for i, r in told.items() if r["text"] and len(r["text"]) > 200}
    assert sum(r["lang"] == told[r["doc_id"]]["lang"] for r in lang) >= 0.97 * len(lang)
    top = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in lang:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate(top))
        sets[r["doc_id"]] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    firsts = {i for i in ids if find(i) == i}
    near = kept["near_duplicates"].collect()
    assert {r["doc_id"] for r in near} == firsts and len(near) == len(firsts)
    clean = {r["doc_id"]: r["text"] for r in kept["personal_data"].collect()}
    assert set(clean) == firsts
    for r in near:
        if not pii.base_spans(r["text"]) and not re.search(r"[\d@]", r["text"]):
            assert clean[r["doc_id"]] == r["text"]
        assert not pii.base_spans(clean[r["doc_id"]])
    mixed = [r["doc_id"] for r in kept["mixing"].collect()]
    assert set(mixed) == firsts and max(mixed.count(i) for i in firsts) <= corpus_pipeline.MAX_REPEATS
    tokens = kept["token_ids"].collect()
    assert sorted(r["doc_id"] for r in tokens) == sorted(mixed) and all(r["round_trip"] for r in tokens)


def test_stages_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", None, "s", 0), (3, "a b", "en", None, 3), (3, "a b", "en", None, 3), (4, "mail a.b@mail.org now", "en", "s", 21), (None, "words here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, COLS)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, ""), "t")
    assert {r["doc_id"] for r in docs.collect()} == {3, 4, None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], COLS), "").collect() == []
    assert jaccard_join.first_of_each(spark.createDataFrame(rows, COLS)).count() == 6
