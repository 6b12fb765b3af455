"""op1, op4, op9 and op10 against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from satchel.llm import components, decontaminate, ngram_join, sharding, substrings
from tests.llm.data import docs, edge_rows, prose, rows_of

ASCII = {c: c + 32 for c in range(65, 91)}


def brute_components(rows, n, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    key = lambda r: [(x is not None, x) for x in r]
    return sorted(((rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))), key=key)


@pytest.mark.parametrize("clash", [False, True])
def test_join_edge_rows(spark, clash):
    out = ngram_join.join(docs(spark, clash=clash))
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == brute_components(edge_rows(), 4, 85)


def test_join_families(spark):
    """Families with chains of edits: some members link, some do not."""
    rng, rows = np.random.default_rng(3), []
    for family in range(4):
        words = prose(100 + family, 90).split()
        for _ in range(14):
            own = list(words)
            for at in rng.choice(90, rng.integers(0, 6), replace=False):
                own[at] = f"w{rng.integers(1000)}"
            rows.append((len(rows) + 1, " ".join(own)))
    out = rows_of(ngram_join.join(docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert out == brute_components(rows, 4, 85)
    out = rows_of(ngram_join.join(docs(spark, rows), 5, 80), "doc_id", "n_shingles", "component_id")
    assert out == brute_components(rows, 5, 80)


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_paired_loses_no_compatible_sizes(spark, percent):
    """Every node with a partner of a compatible size in a bucket stays, also at the edges of classes and beyond the last."""
    rng = np.random.default_rng(8)
    sizes = [1, 2, 4, 5, 8, 16, 10, 20, 2**20, 2**21, 2**22, *rng.integers(1, 400, 60).tolist()]
    rows = [(k, m, rng.choice(25, 4, replace=False).tolist()) for k, m in enumerate(sizes)]
    must = {(key, k) for k, m, own in rows for key in own for j, o, other in rows if j != k and key in other and 100 * min(m, o) >= percent * max(m, o)}
    found = ngram_join.paired(spark.createDataFrame(rows, "node long, n_shingles long, pre array<long>"), "pre", percent)
    got = {(r.key, r.node) for r in found.collect()}
    assert must <= got and got <= {(key, k) for k, _, own in rows for key in own}


def test_nodes_of_other_sizes_leave_a_bucket(spark):
    """Of a bucket with two of a class, a node of a size far from theirs has nobody to meet."""
    rows = [(1, 100, [7]), (2, 100, [7]), (3, 1000, [7, 8]), (4, 100, [8]), (5, 1001, [8])]
    found = ngram_join.paired(spark.createDataFrame(rows, "node long, n_shingles long, pre array<long>"), "pre", 80)
    assert {(r.key, r.node) for r in found.collect()} == {(7, 1), (7, 2), (8, 3), (8, 5)}


def test_tokens_of_one_text_fill_the_prefix(spark):
    """Where two thirds of a set are in no other text, the prefix (a fifth of it) has nothing to store."""
    rows = [(k, " ".join([*prose(50, 600).split()[:300], *(f"{k}of{j}" for j in range(600))])) for k in range(4)]
    got = ngram_join.describe(docs(spark, rows).select("doc_id", "text"), 5, 80).collect()
    assert all(r.n_shingles > 850 and not r.pre1 and not r.pre2 for r in got)
    assert rows_of(ngram_join.join(docs(spark, rows), 5, 80), "doc_id", "component_id") == [(k, k) for k in range(4)]


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr("satchel.plans.staging.BROADCAST_BYTES", 0)
    out = ngram_join.join(docs(spark))
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == brute_components(edge_rows(), 4, 85)


def test_rest_of_buckets_blocks(spark):
    """A bucket cut into blocks gives the pairs of the whole bucket."""
    own = [np.sort(np.unique(np.random.default_rng(k // 3).integers(0, 2**63, 60 + k % 3).astype(np.uint64))) for k in range(12)]
    bits = [ngram_join.bits_of(s).tobytes() for s in own]
    whole = [(0, 0, k, len(own[k]), k, bits[k]) for k in range(12)]
    cut = [(100 * min(a, b) + max(a, b), int(a > b), k, len(own[k]), k, bits[k]) for k in range(12) for a in [k % 2] for b in (0, 1)]
    schema = "grp long, side int, node long, n_shingles long, comp long, bits binary"
    got = [{tuple(r) for r in ngram_join.rest_of_buckets(spark.createDataFrame(rows, schema), 85, False).distinct().collect()} for rows in (whole, cut)]
    assert got[0] == got[1] and len(got[0]) >= 12
    near = ngram_join.rest_of_buckets(spark.createDataFrame(whole, schema), 85, True).collect()
    assert {tuple(r) for r in near} <= got[0]


def test_join_empty(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(40, 50), (50, 60), (60, 40), (7, 7)], "a long, b long")
    assert rows_of(components.components(edges), "node", "comp") == [(k, 0) for k in range(21)] + [(40, 40), (50, 40), (60, 40)]


def brute_removed(rows, n=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for (doc_id, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc_id, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def passages():
    """Passages between different texts, at several places, and periodic text."""
    common, rows = [prose(50 + k, 60) for k in range(3)], []
    for k in range(30):
        rows.append((k, f"{prose(200 + k, 40)} {common[k % 3][: 150 + 12 * k]} {prose(300 + k, 30)}"))
    return rows + [(90, "ab" * 400), (91, "q" * 900), (92, prose(7, 50) * 3)]


@pytest.mark.parametrize("many", [substrings.MANY, 3])
def test_substrings(spark, many):
    rows = [(i, t if t is None or len(t) < 20_000 else t[:2500]) for i, t in edge_rows()] + passages()
    assert rows_of(substrings.deduplicate(docs(spark, rows), many), *COLUMNS) == brute_removed(rows)


def test_substrings_dense_trigger(spark):
    """A passage with hundreds of different neighbours: its triggers are counted by context."""
    common = prose(50, 60)
    rows = [(k, f"{prose(4000 + k, 9)} {common[k % 7 :]} {prose(5000 + k, 9)}") for k in range(300)]
    assert rows_of(substrings.deduplicate(docs(spark, rows)), *COLUMNS) == brute_removed(rows)


def test_substrings_long_text_in_pieces(spark, monkeypatch):
    """A text beyond a block parses in pieces and still meets its copy elsewhere."""
    text = prose(8, 250_000)
    inner = text[700_000:700_900]
    rows = [(1, text), (2, "start " + inner + " end"), (3, None)]
    assert len(text) > substrings.BLOCK
    got = {r[0]: r for r in rows_of(substrings.deduplicate(docs(spark, rows)), *COLUMNS)}
    assert got[2][2] == len(inner) + text[699_999:700_000].count(" ") or got[2][2] >= len(inner)
    assert got[1][2] >= len(inner) and got[3][1:4] == (0, 0, 0)


def test_suffix_ranks():
    data = np.frombuffer(("banana band " * 40 + "bandana " * 30).encode(), np.uint8)
    at = np.arange(len(data) - 200)
    rank = substrings.suffix_ranks(data, at)
    raw = data.tobytes()
    order = sorted({raw[i : i + 200] for i in at})
    assert [order.index(raw[i : i + 200]) for i in at] == np.unique(rank, return_inverse=True)[1].tolist()


def test_substrings_empty_and_clashes(spark):
    assert substrings.deduplicate(docs(spark, [])).count() == 0
    rows = passages()
    assert rows_of(substrings.deduplicate(docs(spark, rows, clash=True)), *COLUMNS) == brute_removed(rows)


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def brute_hits(rows, items):
    out = []
    for doc_id, text in rows:
        w, hit, found = tokens(text), set(), set()
        for item_id, item in items:
            x = tokens(item)
            m = min(10, len(x))
            windows = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if x else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def benchmark_rows():
    return [(1, prose(2, 200)[100:400]), (2, "one"), (3, None), (4, "..."), (5, prose(77, 30)), (10, prose(2, 200)[100:400]), (11, "two words"), (12, "ünï日本 É"), (13, "la la la la la la la la la la la la")]


@pytest.mark.parametrize("clash", [False, True])
def test_decontamination(spark, clash):
    rows = [r for r in edge_rows() if r[0] != 14] + [(20, "x " + prose(77, 30) + " y"), (21, "LA, la. " * 9), (22, " ".join(prose(77, 30).split()[::-1]))]
    items = benchmark_rows()
    found = decontaminate.contamination(docs(spark, rows, clash=clash), spark.createDataFrame(items, "item_id long, text string"))
    got = rows_of(found, "doc_id", "n_words", "n_hit", "items", "contaminated")
    assert got == brute_hits(rows, items)


def test_decontamination_rows_of_one_id(spark):
    """An id on several texts has the hits of each text, and long items and texts are no squares."""
    item = prose(91, 5000, vocabulary=3000)
    rows = edge_rows() + [(30, " ".join(item.split()[700:760])), (30, "nothing of it"), (31, item), (None, item)]
    items = [*benchmark_rows(), (50, item)]
    found = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = rows_of(found, "doc_id", "n_words", "n_hit", "items", "contaminated")
    assert [r for r in got if r[0] != 12] == brute_hits([r for r in rows if r[0] != 12], items)


def brute_near(rows, items):
    freq = Counter(t for _, text in rows for t in tokens(text))
    out = Counter()
    for doc_id, text in rows:
        w = tokens(text)
        for item_id in {i for i, _ in items}:
            near = False
            for x in (tokens(t) for i, t in items if i == item_id):
                m = min(10, len(x))
                for a in range(len(x) - m + 1 if m else 0):
                    own = x[a : a + m]
                    rare = min(own, key=lambda t: (freq[t], own.index(t)))
                    near |= any(w[p] == rare and set(own) <= set(w[max(0, p - 9) : p + 10]) for p in range(len(w)))
            out[doc_id, text or ""] += near
    return out


@pytest.mark.parametrize("together", [True, False])
def test_near_items_by_brute_force(spark, monkeypatch, together):
    """Both ways to build the index, with terms broadcast and with terms shuffled."""
    if not together:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    rows = [r for r in edge_rows() if r[0] != 12] + [(22, " ".join(prose(77, 30).split()[::-1])), (23, prose(77, 30) + " tail")]
    items = benchmark_rows()
    found = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit) for r in found) == Counter(r[:3] for r in brute_hits(rows, items))
    want, times = brute_near(rows, items), Counter((i, t or "") for i, t in rows)
    assert sum(r.n_near for r in found) == sum(want.values())
    assert {(r.doc_id, r.n_words, r.n_near) for r in found} == {(i, len(tokens(t)), want[i, t] // times[i, t]) for i, t in times}


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {tuple(r) for r in decontaminate.contamination(docs(spark), none).select("n_hit", "contaminated").collect()} == {(0, False)}
    assert decontaminate.contamination(docs(spark, []), none).count() == 0


def test_proximity(spark):
    words = prose(77, 12).split()
    rows = [(1, " ".join(words[::-1])), (2, " ".join(words)), (3, prose(5, 50))]
    postings, found = decontaminate.prepare(docs(spark, rows), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert {r.doc_id for r in decontaminate.proximity(postings, found).collect()} == {1, 2}
    assert {r.doc_id for r in decontaminate.phrases(postings, found).collect()} == {2}


def brute_lpt(rows, shards=8):
    groups = Counter()
    for _, t in rows:
        groups[t] += len((t or "").encode()) + 1
    loads = [0] * shards
    for w in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += w
    return sorted(loads)


@pytest.mark.parametrize("clash", [False, True])
def test_sharding(spark, clash):
    rows = edge_rows() + [(100 + k, str(k % 40)) for k in range(400)]
    got = sharding.shard(docs(spark, rows, clash=clash)).collect()
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    loads, where, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        own = next(t for t in text[r.doc_id] if zlib.crc32((t or "").encode()) == r.text_crc32)
        assert r["size"] == len((own or "").encode()) + 1
        loads[r.shard] += r["size"]
        where[own].add(r.shard)
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(loads.get(k, 0) for k in range(8)) == brute_lpt(rows)


def test_sharding_empty(spark):
    assert sharding.shard(docs(spark, [])).count() == 0


def test_deal_is_the_heap():
    """A class dealt in one step gives what the heap gives group by group."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        start = rng.integers(0, 300, 8).tolist()
        weight, count = int(rng.integers(1, 40)), int(rng.integers(0, 400))
        heap = sorted((load, k) for k, load in enumerate(start))
        got = sharding.deal(weight, count, heap)
        loads = list(start)
        for _ in range(count):
            loads[loads.index(min(loads))] += weight
        assert [s + weight * g for s, g in zip(start, got, strict=True)] == loads == [load for _, load in sorted((k, load) for load, k in heap)]
