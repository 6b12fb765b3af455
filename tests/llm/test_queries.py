"""The queries themselves on small tables: every contract's columns, from plain rules."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from satchel.llm import queries
from tests.llm.data import docs, edge_rows
from tests.llm.test_pairs_and_passages import benchmark_rows, brute_components, brute_hits, brute_removed
from tests.llm.test_texts import PAGE, counts_by_rule, labelled, spans_by_rule


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows, labels = labelled(120)
    rows = [r for r in edge_rows() if r[0] != 14] + rows + [(9001, 'token = "abcdef123456" client_id=bob9 http://some.where/x ' + "0123456789abcdef" * 2)]
    rows = [(i, t if t is None or len(t) < 20_000 else t[:3000]) for i, t in rows]
    docs(spark, rows, clash=True).selectExpr("*", "if(doc_id % 2 = 0, 'aa', 'bb') AS lang", "'s' AS source").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, int(i % 7 == 0)) for i, q, _ in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(benchmark_rows(), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a/1", PAGE), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d, rows


def run(spark, tables, name):
    found = queries.QUERIES[name](spark, tables[0])
    return found.columns, found.collect()


def fold(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, tables):
    columns, got = run(spark, tables, "op1_ngram_join")
    assert columns[:3] == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got), key=repr) == sorted(brute_components(tables[1], 4, 85), key=repr)


def test_op2(spark, tables):
    _, got = run(spark, tables, "op2_sentencepiece")
    assert len(got) == len(tables[1]) and all(r.round_trip for r in got)
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((i, sha(t or "")) for i, t in tables[1])


def test_op3(spark, tables):
    _, got = run(spark, tables, "op3_secret_scan")
    line = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    want = Counter()
    for i, t in tables[1]:
        spans = spans_by_rule(t or "")
        base = [s for s in spans if s[1] <= 3]
        n = Counter(s[3] for s in base)
        want[i, n["assign"], n["access"], n["hex"], sha(line(base)), line(spans)] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == want
    assert any(r.n_hex and "identifier" in r.spans for r in got)


def test_op4(spark, tables):
    _, got = run(spark, tables, "op4_substring_dedup")
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == sorted(brute_removed(tables[1]), key=repr)


def test_op5(spark, tables):
    _, got = run(spark, tables, "op5_quality")
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((i, *counts_by_rule(t)) for i, t in tables[1])
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_op6(spark, tables):
    _, got = run(spark, tables, "op6_toxicity")
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in tables[1])
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_op7(spark, tables):
    _, got = run(spark, tables, "op7_html_text")
    assert {r.page_id: (r.url, r.n_chars) for r in got} == {1: ("http://a/1", len(got[[r.page_id for r in got].index(1)].text)), 2: (None, 0)}
    assert next(r.text for r in got if r.page_id == 1).startswith("Head & line\nOne two three four\nFive six")


def test_op8(spark, tables):
    _, got = run(spark, tables, "op8_language")
    text = defaultdict(set)
    for i, t in tables[1]:
        text[i].add(t)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.lang_pred in ("aa", "bb", "und") for r in got)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", next(iter(text[r.doc_id])) or "")) for r in got if len(text[r.doc_id]) == 1)


def test_op9(spark, tables):
    _, got = run(spark, tables, "op9_decontamination")
    want = Counter((i, n, hit, len(items), sha(",".join(items)), bad) for i, n, hit, items, bad in brute_hits(tables[1], benchmark_rows()))
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert all(r.n_near >= r.n_items for r in got)


def test_op10(spark, tables):
    _, got = run(spark, tables, "op10_sharding")
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in tables[1])
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
