"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing columns and no rows."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from costlens.llm import bpe, langid, licences, mixing, pii, quality, queries, secrets, sharding, simhash, weighted
from costlens.llm.common import DOCUMENT_COLUMNS

from llm_fixtures import EDGE_ROWS, edge, empty  # noqa: F401

PER_ROW = {
    "sharding": lambda d: sharding.shard(d, 4),
    "pii": pii.digest,
    "language": lambda d: langid.identify(d, langid.train(d)),
    "simhash": simhash.near_duplicates,
    "bpe": queries.token_digests,
    "weighted": lambda d: weighted.neighbours(d, 32),
    "quality": quality.judge,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each(edge, name):
    rows = PER_ROW[name](edge).collect()
    assert sorted(r["doc_id"] or -1 for r in rows) == sorted(r[0] or -1 for r in EDGE_ROWS)


@pytest.mark.parametrize("name", PER_ROW)
def test_no_rows(empty, name):
    assert PER_ROW[name](empty).collect() == []


def test_findings_of_edge_rows(spark, edge, empty):
    scanner = licences.train(rounds=5)
    assert licences.scan(edge, scanner).collect() == []
    assert licences.scan(empty, scanner).collect() == []
    model = secrets.train(secrets.labelled_findings(spark, copies=4), trees=3)
    found = secrets.scan(edge, model).select("doc_id", "is_secret").collect()
    assert {r["doc_id"] for r in found} == {10} and not any(r["is_secret"] for r in found)
    assert secrets.scan(empty, model).collect() == []


def test_mix_of_edge_rows(edge, empty):
    mixed = mixing.mix(edge, {"src0": 0.4, "src1": 0.3, "absent": 0.1})
    assert set(edge.columns) - {"copy"} <= set(mixed.columns)
    rows = mixed.collect()
    keys = [(r["shuffle_key"], r["doc_id"] or -1, r["copy"]) for r in rows]
    assert keys == sorted(keys)
    assert mixing.mix(empty, {"src0": 0.4}).collect() == []
    assert mixing.mix(edge, {}).count() >= 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, edge, empty, name, stage):
    docs = edge.select(*DOCUMENT_COLUMNS)
    out = stage(spark, docs, "")
    assert out.count() >= 1
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.dtypes == docs.dtypes
    assert stage(spark, empty, "").count() == 0


def test_simhash_stage_keeps_one_of_each(spark, edge):
    kept = corpus_pipeline.near_duplicates(spark, edge.select(*DOCUMENT_COLUMNS), "").collect()
    ids = [r["doc_id"] for r in kept]
    assert 1 in ids and 2 not in ids
    assert sum(r["doc_id"] in (3, 4, 5, 6) or (r["doc_id"] is None and r["text"] is None) for r in kept) == 1
    assert ids.count(11) == 2  # two texts under one id, of different groups


def test_language_stage_drops_what_it_rejects(spark, edge):
    kept = corpus_pipeline.language_id(spark, edge.select(*DOCUMENT_COLUMNS), "").collect()
    ids = {r["doc_id"] for r in kept}
    assert ids >= {1, 2, 7, 12} and not ids & {3, 4, 5, 6, 10}


def test_language_stage_drops_letters_in_random_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = "qxz vkjw pzxq jjvk wqxz kvzj xqpw zzkq vjxw qkzp " * 9
    odd = spark.createDataFrame([(-1, noise, None, "src0", len(noise))], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(odd), "").select("doc_id").collect()}
    assert -1 not in kept
    assert kept >= {r["doc_id"] for r in docs.where("text rlike '[a-zA-Z]{3}'").select("doc_id").collect()}


def test_one_of_rows_that_differ_beside_id_and_text_stays(spark):
    rows = [(1, "some text of a few words", lang, "s", 24) for lang in ("en", "de", "fr", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [corpus_pipeline.near_duplicates(spark, d, "").collect() for d in (docs, docs.orderBy("lang"), docs.repartition(3))]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]


def test_pii_stage_replaces(spark):
    docs = spark.createDataFrame([(1, "mail jane.doe@example.org or +1 (555) 010-9999 now", "en", "s", 51)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    row = corpus_pipeline.personal_data(spark, docs, "").first()
    assert row["text"] == "mail [EMAIL] or [PHONE] now" and row["n_chars"] == len(row["text"])


def test_pipeline_on_the_small_table(spark):
    """run() against the stages' own brute force: the groups, the repetitions and the round trip."""
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: simhash.fingerprint(t) for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            low = min(group[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= simhash.MAX_BITS)
            if low < group[i]:
                group[i], changed = low, True
    kept = {i for i in fps if group[i] == i}
    assert {r["doc_id"] for r in rows} <= kept
    field = pii.train()
    redacted = {}
    for i in kept:
        t, out, at = texts[i], "", 0
        for kind, a, b in sorted(pii.spans_of([t], field)[0], key=lambda s: (s[1], s[2], s[0])):
            if a >= at:
                out += t[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        redacted[i] = out + t[at:]
    coder = bpe.tokenizer(public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN)
    for r in rows:
        ids = coder.encode_texts([redacted[r["doc_id"]]])[0]
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["n_tokens"] == len(ids) // 4
        assert r["decoded_sha256"] == hashlib.sha256(redacted[r["doc_id"]].encode()).hexdigest()
