"""The registered queries against their SQL, or against what must hold between them, on the smallest tables."""

import json
from collections import Counter, defaultdict

import pytest
from compare import database, same
from pyspark.sql import functions as F

from tidegraph.llm import language, mixing, packing, pii, queries
from tidegraph.llm.tokens import VOCABULARY, tokenizer


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, data, db, name):
    same(spark, queries.QUERIES[name], queries.SQL[name], data, db)


def rows(spark, data, name):
    return queries.QUERIES[name](spark, data).collect()


def test_personal_data_is_found_where_it_is_replaced(spark, data):
    names, samples = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("given_names", "lang_samples"))
    given, common = pii.knowledge(names, samples)
    every = pii.both_sources(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("graph_events", "normalized_records")))
    contexts = pii.name_contexts(every, "text", given, common)
    texts = {(r.source_table, r.row_id): r.text for r in every.collect()}
    want = {k: pii.find(t, given, common, contexts) for k, t in texts.items() if t}
    found = defaultdict(set)
    for r in rows(spark, data, "p1_found"):
        found[r.source_table, r.row_id].add(r.pii_type)
    assert dict(found) == {k: {kind for _, _, kind in v} for k, v in want.items() if v}
    for r in rows(spark, data, "p1_redacted"):
        k = r.source_table, r.row_id
        assert r.clean_text == pii.redact(texts[k], want[k]) and r.spans == len(want[k]) > 0


def test_languages_come_out_text_by_text(spark, data):
    events, records, samples = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("graph_events", "normalized_records", "lang_samples"))
    model = language.fit(samples)
    every = language.both_sources(events, records).collect()
    want, report = set(), Counter()
    for r in every:
        s = language.describe(model, r.text)
        report[r.source_table, r.label, None if not s else s[0][1] if len(s) == 1 else "mixed"] += 1
        if not (len(s) == 1 and s[0][1] == r.label):
            want |= {(r.source_table, r.row_id, n, lang) for n, lang, _, _ in s}
    assert {tuple(r) for r in rows(spark, data, "p3_found")} == want and want
    assert {(r.source_table, r.label, r.found): r.texts for r in rows(spark, data, "p3_language_report")} == report


def test_containers_hold_every_text(spark, data):
    encode = tokenizer(VOCABULARY).encode_ordinary
    sizes = {r.doc_id: len(encode(r.text)) if r.text else 0 for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    packed = rows(spark, data, "p8_containers")
    certificate = {r.container_kind: r for r in rows(spark, data, "p8_certificate")}
    for k in spark.read.parquet(f"{data}/container_sizes.parquet").collect():
        own = [r for r in packed if r.container_kind == k.container_kind]
        held, fill = Counter(), Counter()
        for r in own:
            held[r.doc_id] += r.tokens
            fill[r.container_id] += r.tokens
        assert held == Counter(sizes) and max(fill.values()) <= k.capacity_tokens
        assert all(n == 1 for d, n in Counter(r.doc_id for r in own).items() if sizes[d] <= k.capacity_tokens)
        c = certificate[k.container_kind]
        assert c.containers == len(fill) and c.tokens == sum(sizes.values())
        least = packing.lower_bound([r.tokens for r in own], k.capacity_tokens)
        assert c.least_containers == least <= c.containers


def test_mix_reaches_its_shares(spark, data):
    targets = {r.source: r for r in spark.read.parquet(f"{data}/mix_targets.parquet").select(mixing.source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect()}
    mix = rows(spark, data, "p9_mix")
    total = sum(r.tokens for r in mix)
    at = 0
    for r in sorted(mix, key=lambda r: r.position):
        assert r.position == at
        at += r.tokens
    uses = Counter((r.source, r.doc_id) for r in mix)
    assert all(n <= targets[s].max_repeats for (s, _), n in uses.items())
    for r in rows(spark, data, "p9_shares"):
        own = sum(x.tokens for x in mix if x.source == r.source)
        assert r.tokens == own and r.actual_share == pytest.approx(own / total, abs=1e-6)


def test_residue_and_clean_documents_are_all_documents(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found, clean = {r.doc_id for r in rows(spark, data, "p10_found")}, rows(spark, data, "p10_clean_documents")
    assert found and found | {r.doc_id for r in clean} == set(docs) and len(clean) == len(docs) - len(found)
    assert all(json.dumps(r.asDict(), default=str) == json.dumps(docs[r.doc_id].asDict(), default=str) for r in clean)
