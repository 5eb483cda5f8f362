"""Archives, manifests and whitening against plain loops."""

import gzip
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kittally.llm import merkle, queries, warc, whitening


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# --- WARC ---

PAGE = "page_id long, url string, html string, key string, payload int, archive string, offset int, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "a", 2, "d") for r in rows], PAGE).repartition(3)


def long(text, n=120):
    return (text * n)[:n]


ROWS = [
    (1, "http://a/x y\r\nEvil: 1", long("a")),
    (2, "http://b/é", long("a")),
    (7, None, long("b")),
    (5, "u", long("b")),
    (5, "v", long("c")),  # one key, two payloads
    (3, "short", "tiny"),
    (4, "short", "tiny"),
    (6, "", ""),
    (8, "none", None),
    (9, "big", "é\r\n\r\n" * 300_000),
    (10, "99 bytes", "z" * 99),
    (11, "99 bytes", "z" * 99),
    (12, "100 bytes", "é" * 50),
    (13, "100 bytes", "é" * 50),
    (2, "http://b/é", long("a")),  # repeated rows
    (5, "u", long("b")),
    (None, "no key", long("a")),
    (None, "no key", long("only without key")),
    (None, "no key either", long("only without key")),
]


def expected(rows):
    out = []
    for key, url, html in rows:
        body = (html or "").encode()
        keys = [k for k, _, h in rows if (h or "").encode() == body and k is not None]
        first = min(keys, default=None)
        again = len(body) >= 100 and key != first
        out.append((key, url, len(body), sha(body), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def taken(records):
    sized = records.withColumn("n", F.octet_length("payload").cast("long")).withColumn("d", F.sha2("payload", 256)).drop("payload").cache()
    done = warc.resolve(sized, "n", "d")
    rows = done.select("key", "url", "n", "d", "record_type", "refers_to", "intact").collect()
    assert all(r["intact"] for r in rows)
    return sorted((tuple(r)[:6] for r in rows), key=repr)


def test_archives_like_plain_loops(spark):
    index = warc.write_archives(pages(spark, ROWS))
    assert taken(warc.read_records(index)) == expected(ROWS)


def test_index_finds_single_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "GAP", 0)
    index = warc.write_archives(pages(spark, ROWS))
    some = index.where("key IN (3, 9, 12)")
    got = {r["key"]: bytes(r["payload"]).decode() for r in warc.read_records(some).collect()}
    assert got == {3: "tiny", 9: "é\r\n\r\n" * 300_000, 12: "é" * 50}
    assert sum(r["stop"] - r["start"] for r in warc.ranges(some).collect()) == some.agg(F.sum("length")).first()[0]


def test_ranges_cover_neighbours_once(spark, monkeypatch):
    index = warc.write_archives(pages(spark, [(i, f"u{i}", f"page {i} " * 30) for i in range(200)]).coalesce(2))
    archives = index.select("archive").distinct().count()
    assert warc.ranges(index).count() == archives
    monkeypatch.setattr(warc, "REACH", 2000)
    monkeypatch.setattr(warc, "ARCHIVE", 4000)
    more = warc.write_archives(pages(spark, [(i, f"u{i}", f"page {i} " * 30) for i in range(200)]).coalesce(2))
    assert more.select("archive").distinct().count() > archives
    cut = warc.ranges(more).collect()
    assert sum(len(r["members"]) for r in cut) == 200 and max(len(r["members"]) for r in cut) > 1
    assert len(taken(warc.read_records(more))) == 200


def test_an_archive_is_plain_warc(spark):
    """Whole archives decompress to records in a row, and no field holds a line break."""
    index = warc.write_archives(pages(spark, ROWS)).collect()
    types = []
    for name in {(r["folder"], r["archive"]) for r in index}:
        system, base = warc._open(name[0])
        with system.open_input_file(f"{base}/{name[1]}") as f:
            data = gzip.decompress(f.read())
        while data:
            assert data.startswith(b"WARC/1.1\r\n")
            head, _ = warc.parsed(data)
            assert "evil" not in head
            types.append(head["warc-type"])
            end = data.index(b"\r\n\r\n") + 4 + int(head["content-length"])
            assert data[end : end + 4] == b"\r\n\r\n"
            data = data[end + 4 :]
    assert sorted(types) == sorted(r["record_type"] for r in index)


def test_damage_is_seen(spark):
    index = warc.write_archives(pages(spark, [(1, "u", "x" * 500)]))
    wrong = index.withColumn("payload_digest", F.lit("0" * 64))
    assert [r["intact"] for r in warc.read_records(wrong).collect()] == [False]


def test_no_pages(spark):
    index = warc.write_archives(spark.createDataFrame([], PAGE))
    assert index.count() == 0 and warc.read_records(index).count() == 0


# --- Merkle manifest ---

DOC = "doc_id long, source string, lang string, n_chars long, text string, run string, digest int, at int, n string, path int, members int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, 2, "n", 3, 4) for r in rows], DOC).repartition(4)


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, list of sibling lists with sides)."""
    level, paths, where = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        for i, p in enumerate(where):
            other = p ^ 1
            paths[i].append(("L" if p % 2 else "R", level[other] if other < len(level) else ""))
            where[i] = p // 2
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0] if level else None, paths


def plain_manifest(rows, bad):
    runs = {}
    for r in rows:
        runs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r))
    names = sorted(runs, key=lambda k: (k is not None, (k or "").encode()))
    tops, out = [], []
    for name in names:
        runs[name].sort(key=lambda x: x[:3])
        top, paths = tree([x[2] for x in runs[name]])
        tops.append(top)
        out.append((top, paths))
    root, above = tree(tops)
    done = []
    for name, (top, paths), up in zip(names, out, above):
        for (_, _, leaf, r), path in zip(runs[name], paths):
            h = sha("".join(map(field, (*r[:3], r[3] + 1, r[4])))) if r[3] is not None and bad(r[0]) else leaf
            for side, s in path + up:
                h = sha(s + h if side == "L" else h + s)
            done.append((r[0], leaf, top, root, sha("".join(s for _, s in path + up)), h, h == root))
    return sorted(done, key=repr)


def seventh(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 0


def merkle_rows(spark, rows):
    from kittally.llm.common import remainder

    more = F.when(F.col("doc_id").isNotNull() & (remainder("doc_id", 7) == 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    done = merkle.verify(merkle.manifest(docs(spark, rows), altered={"n_chars": more}), "claimed")
    got = done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("block", [2, 4, 256])
def test_merkle_like_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "STEPS", block.bit_length() - 1)
    rows = [(i * 3, ("s", None, "é")[i % 3], (None, "en", "en", "fr", "en")[i % 5], None if i % 11 == 0 else i, f"text {i} é\n" * (i % 4)) for i in range(137)]
    rows += [(5, "s", "en", 1, None), (5, "s", "en", 1, None), (5, "s", "en", 2, None), (5, "s", "fr", 2, ""), (5, "s", "", 2, "long " * 40_000)]
    rows += [(None, None, None, None, None), (None, "s", "en", 1, "t"), (-7, "s", "zz", 7, "alone"), (1 << 40, "s", "éé", 0, "x")]
    got = merkle_rows(spark, rows)
    assert got == plain_manifest(rows, seventh)
    assert {g[6] for g in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 600])
def test_merkle_sizes(spark, n):
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    assert merkle_rows(spark, rows) == plain_manifest(rows, seventh)


def test_merkle_many_groups_and_none(spark):
    rows = [(i, "s", f"l{i:03d}", i, "t") for i in range(300)]
    assert merkle_rows(spark, rows) == plain_manifest(rows, seventh)
    assert merkle_rows(spark, []) == []


def test_merkle_tables_have_small_rows(spark, monkeypatch):
    """A reader holds 4,096 rows of a table at once: what is written must stay small in any row."""
    written, cut = [], merkle.cut
    monkeypatch.setattr(merkle, "cut", lambda df: written.append(cut(df)) or written[-1])
    assert len(merkle_rows(spark, [(i, "s", ("en", "fr")[i % 3 == 0], i, "t") for i in range(1200)])) == 1200
    assert max(t.select(F.max(F.length(F.to_json(F.struct(*t.columns))))).first()[0] for t in written) < 25_000


# --- whitening ---

VECTOR = "vec_id long, embedding array<float>, label int, x string, key string, component int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 0, "x", "k", 1, 2) for k, v in rows], VECTOR).repartition(3)


def plain_whitening(rows, wanted=4):
    fine = [(k, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in fine}))
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for k, x in fine:
        for c in range(min(wanted, len(e))):
            if e[c] > 1e-12 * np.trace(cov):
                out.setdefault((k, c + 1), []).append((n, int(((n * x - s) ** 2).sum()), float((x - s / n) @ q[:, c] / math.sqrt(e[c])), e[c] / np.trace(cov)))
    return out


def same_whitening(got, want):
    assert sorted((r["vec_id"] is None, r["vec_id"], r["component"]) for r in got) == sorted((k[0] is None, *k) for k, rows in want.items() for _ in rows)
    signs = {}
    for r in got:
        options = want[(r["vec_id"], r["component"])]
        best = min(options, key=lambda o: (o[1] != r["deviation"], abs(abs(o[2]) - abs(r["whitened"]))))
        assert (r["n"], r["deviation"]) == best[:2]
        assert abs(r["explained"] - best[3]) <= 1e-9 * best[3] and r["identity_error"] <= 1e-9
        assert abs(abs(r["whitened"]) - abs(best[2])) < 1e-7
        if abs(best[2]) > 1e-3:
            signs.setdefault(r["component"], set()).add(np.sign(r["whitened"]) == np.sign(best[2]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_like_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 40)) * np.linspace(1.5, 0.2, 40)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [rows[3], rows[3], (900, rows[5][1]), (None, rows[6][1])]
    rows += [(901, None), (902, []), (903, [None] + [0.0] * 39), (904, [float("nan")] * 40), (905, [float("inf")] + [0.0] * 39), (906, [-0.0] * 40), (907, [1.0, 2.0])]
    odd = [r for r in rows if r[1] is None or len(r[1]) == 40]
    same_whitening(whitening.whitening(vectors(spark, rows)).collect(), plain_whitening(odd))


def test_whitening_close_eigenvalues(spark):
    """Many nearly equal eigenvalues: the block is widened, up to all dimensions, and stays exact."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((500, 30)).astype(np.float32))]
    same_whitening(whitening.whitening(vectors(spark, rows)).collect(), plain_whitening(rows))


def test_whitening_hides_no_eigenvalue():
    """A start that misses the largest direction altogether is found out by the audit or the filter."""
    values = np.concatenate(([50.0], np.linspace(10, 1, 59)))
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((60, 60)))[0]
    cov = (q * values) @ q.T
    found, vectors_ = whitening.leading(lambda b: cov @ b, 60, 4, float(values.sum()))
    assert np.allclose(found, values[:4], rtol=1e-10)
    assert np.allclose(np.abs(np.sum(vectors_ * q[:, :4], axis=0)), 1, atol=1e-8)


def test_whitening_small_tables(spark):
    assert whitening.whitening(vectors(spark, [(1, [0.5, 0.25])])).count() == 0  # no variance
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.75]), (3, [0.5, 0.75])]  # one direction only
    same_whitening(whitening.whitening(vectors(spark, rows)).collect(), plain_whitening(rows))
    nothing = whitening.whitening(spark.createDataFrame([], VECTOR))
    assert nothing.count() == 0 and nothing.columns[0] == "vec_id"


def test_whitening_large_entries_stay_exact(spark):
    rows = [(i, [float(i % 3) * 2.0**18, float(i % 2) * 2.0**17, float(i) * 2.0**14]) for i in range(12)]
    same_whitening(whitening.whitening(vectors(spark, rows)).collect(), plain_whitening(rows))


def test_queries_of_tables(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("benchmark tables are not here")
    got = queries.op13_whitening(spark, sf).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same_whitening(got, plain_whitening(rows))
