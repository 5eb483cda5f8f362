"""Operators on pairs and repeats against plain loops."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from llm_fixtures import empty, messy  # noqa: F401
from kittally.llm import embeddings, graph, lines, simhash, spans
from kittally.session import cut


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(900, i) for i in range(901, 960)]
    want = roots({x for e in links if e[0] != e[1] for x in e}, links)
    frame = spark.createDataFrame(links + [(7, 7), (None, 3)], "p long, q long")
    assert {r[0]: r[1] for r in graph.components(frame, "p", "q").collect()} == want
    assert graph.components(frame.limit(0), "p", "q").count() == 0


def test_simhash(spark, messy, empty):
    rows, frame = messy
    got = simhash.near_duplicates(frame).collect()
    prints = {(k, t): plain_print(t) for k, t, *_ in rows}
    links = [(a, b) for a in set(prints.values()) for b in set(prints.values()) if a < b and bin(a ^ b).count("1") <= 2]
    part = roots(set(prints.values()), links)
    least = {}
    for (k, _), p in prints.items():
        if k is not None:
            least[part[p]] = min(k, least.get(part[p], k))
    want = sorted((k, f"{prints[k, t]:016x}", least[part[prints[k, t]]]) for k, t, *_ in rows if k is not None)
    assert sorted(tuple(r[:3]) for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(empty).count() == 0


def test_close_prints_need_no_common_point_lost(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(6)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for distance in (1, 2, 3):
        want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance}
        frame = spark.createDataFrame([(p,) for p in signed], "print long")
        assert {tuple(r) for r in simhash.close_prints(frame, distance).collect()} == want


def test_balls_are_not_sent_to_the_driver(spark):
    """Unfolded balls look as small as the prints they come from; Spark must not collect them for a broadcast."""
    frame = cut(spark.createDataFrame([(i << 20,) for i in range(50)], "print long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        pairs = simhash.close_prints(frame)
        assert pairs.count() > 0
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines(spark, messy, empty):
    rows, frame = messy
    got = lines.duplicate_lines(frame).collect()
    every = sorted({(k is None, k or 0, i, frozenset(x.split()), t) for k, t, *_ in rows if t is not None for i, x in enumerate(t.split("\n")) if x.split()}, key=lambda x: (*x[:3], x[4]))
    removed, seen = {}, []
    for none, k, i, s, t in every:
        if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
            removed.setdefault((None if none else k, t), []).append(i)
        seen.append(s)
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        mine = [sorted(r.removed) for r in got if r.doc_id == k and r.n_lines == (0 if t is None else t.count("\n") + 1)]
        assert removed.get((k, t), []) in mine, k
    assert lines.duplicate_lines(empty).count() == 0


def plain_lines(texts):
    """Numbers of removed lines of texts in order of their keys."""
    removed, seen = [], []
    for text in texts:
        gone = []
        for i, x in enumerate(text.split("\n")):
            s = frozenset(x.split())
            if s and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                gone.append(i)
            seen += [s] if s else []
        removed.append(gone)
    return removed


def test_lines_of_many_lengths(spark):
    rng = random.Random(11)
    texts = []
    for n in (2, 4, 5, 6, 9, 10, 30, 58, 64, 65, 70, 80, 128, 129, 150, 300):
        words = [f"w{int(rng.paretovariate(0.6)) % 4000}x{i if rng.random() < 0.5 else ''}" for i in range(n)]
        texts.append(" ".join(words))
        for change in (1, n // 11, n // 9, n // 8, n // 5):  # swapped, left out or added, on both sides of the limit
            swapped = [f"new{rng.random()}" if i < change else w for i, w in enumerate(rng.sample(words, n))]
            texts.append("\n".join([" ".join(swapped), " ".join(words[change:]), " ".join(words + [f"more{rng.random()}" for _ in range(change)])]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: sorted(r.removed) for r in lines.duplicate_lines(frame).collect()}
    assert [got[k] for k in range(len(texts))] == plain_lines(texts)


def test_lines_whose_star_fails_need_no_second_round(spark, monkeypatch):
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(40)) for _ in range(6)]
    texts = base + [t + " end" for t in base]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rounds, whole = [], lines.candidates
    monkeypatch.setattr(lines, "candidates", lambda *a, **b: rounds.append(1) or whole(*a, **b))

    def wrong(sets, *_):  # each set of a later text is led to the first set, which only one of them matches
        ids = sorted(r.id for r in sets.select("id").collect())
        return spark.createDataFrame([(i, ids[0]) for i in ids[len(base) :]], "late long, early long")

    monkeypatch.setattr(lines, "stars", wrong)
    got = {r.doc_id: sorted(r.removed) for r in lines.duplicate_lines(frame).collect()}
    assert [got[k] for k in range(len(texts))] == plain_lines(texts)
    assert len(rounds) == 1


def test_dedup_lines_keeps_columns(messy):
    rows, frame = messy
    got = lines.dedup_lines(frame)
    assert got.columns == frame.columns and got.count() == len(rows)
    assert sum(r.text is None for r in got.select("text").collect()) == sum(t is None for _, t, *_ in rows)


def plain_spans(rows, span):
    first, out = {}, []
    for k, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for i in range(len(w) - span + 1):
            first.setdefault(tuple(w[i : i + span]), k)
    for k, t, *_ in rows:
        w = (t or "").split()
        gone = set()
        for i in range(len(w) - span + 1) if k is not None else ():
            if first[tuple(w[i : i + span])] < k:
                gone |= set(range(i, i + span))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("span,kmer", [(50, 10), (8, 3)])
def test_spans(messy, empty, span, kmer):
    rows, frame = messy
    got = spans.remove_repeats(frame, span=span, kmer=kmer).collect()
    assert sorted(map(tuple, got), key=repr) == plain_spans(rows, span)
    assert spans.remove_repeats(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=12, max_size=60))
def test_equal_windows_have_equal_pieces(letters):
    tokens = [c.encode() for c in letters]
    hashes = spans.hashed(spans._Memory(), tokens)
    start, n, off, anchor, _, _ = spans.pieces(hashes, 10, 4)
    assert n.sum() == len(tokens) - 9 and start[0] == 0
    seen = {}
    for s, k, o, a in zip(start, n, off, anchor):
        for j in range(k):
            assert seen.setdefault(tuple(tokens[s + j : s + j + 10]), (int(a), int(o - j))) == (int(a), int(o - j))


def plain_vectors(rows, threshold=0.95):
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = [(a, b) for i, (a, x) in enumerate(good) for j, (b, y) in enumerate(good) if i != j and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold]
    part = roots({k for k, _ in good}, links)
    return {k: (sum(a == k for a, _ in links), part.get(k, k)) for k, _ in rows}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[0] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(60)]  # a full list
    rows += [(2000 + i, base[7].tolist()) for i in range(30)] + [(2100 + i, (base[i] * 3 + 0.3 * rng.standard_normal(16)).tolist()) for i in range(20, 60)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None]), (3004, [float("nan")] * 16), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (3007, [float("inf"), 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as v", "3 as sim", "4 as label")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    want = plain_vectors(rows)
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in got.items())
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def lost_pairs(spark, monkeypatch, tries):
    """Vectors with one group of 60 and 40 pairs, whose pairs the first ``tries`` tries do not see."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((41, 24))
    rows = [(i, (base[0] + 0.05 * rng.standard_normal(24)).tolist()) for i in range(60)]
    rows += [(100 * side + i, (base[i] + 0.05 * rng.standard_normal(24)).tolist()) for i in range(1, 41) for side in (1, 2)]
    first = embeddings.first_lists
    monkeypatch.setattr(embeddings, "first_lists", lambda nodes, seed, *a: first(nodes.where("node < 100") if seed < 11 + tries else nodes, seed, *a))
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_embeddings_find_pairs_lost_by_the_first_try(spark, monkeypatch):
    rows, frame = lost_pairs(spark, monkeypatch, 1)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect()} == plain_vectors(rows)


def test_embeddings_below_recall_are_refused(spark, monkeypatch):
    _, frame = lost_pairs(spark, monkeypatch, 99)
    monkeypatch.setattr(embeddings, "TRIES", 1)
    with pytest.raises(RuntimeError, match="recall"):
        embeddings.near_duplicates(frame)


def test_count_links_equals_lists(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 6)) * [1, 1, 0.05, 0.05, 0.05, 0.05]
    x /= np.linalg.norm(x, axis=1)[:, None]
    frame = spark.createDataFrame([(1, i, bytearray(v.tobytes()), 1 + i % 3) for i, v in enumerate(x)], "group long, node long, v binary, weight long")
    got = {r.node: r.links for r in embeddings.count_links(frame, 0.95).collect()}
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    assert [got.get(i, 0) for i in range(700)] == (close @ (1 + np.arange(700) % 3)).tolist()
