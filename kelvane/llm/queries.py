"""The queries opN_<name>: thin callers of the operators, over whole tables."""

from __future__ import annotations

import os

from . import chunk_dedup, embed_dedup, fingerprints, jaccard_join, langid, mixing, piece_codec, pii, secret_scan, token_shards
from .common import table


def vocabulary() -> str:
    """The public SentencePiece vocabulary; KELVANE_PIECES names another file."""
    return os.environ.get("KELVANE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_embedding_near_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_temperature_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), max_repeats=4)


def op3_training_order(spark, sf_dir):
    """Ids of the vocabulary, two bytes each, staged once to be counted and dealt. Without the path, which is new in each run."""
    return token_shards.materialise(table(spark, sf_dir, "documents"), pack=piece_codec.packer(spark, vocabulary(), 2), id_bytes=2).drop("path")


def op4_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark, sf_dir):
    return piece_codec.encode(table(spark, sf_dir, "documents"), vocabulary())


def op8_secrets(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return chunk_dedup.passages(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark, sf_dir):
    return jaccard_join.connect(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_temperature_mixing, op3_training_order, op4_language_id, op5_pii, op6_fingerprints, op7_sentencepiece, op8_secrets, op9_substring_dedup, op10_ngram_jaccard)}

#: Where SQL can say it: the links by definition, and what they reach by recursion. The others hash, permute, learn or
#: decode, which SQL cannot.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM v JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op10_ngram_jaccard": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach(id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""",
}
