import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from cladeframe.llm import simhash_dedup as S
from cladeframe.llm.components import connected_components
from cladeframe.llm.exact_dedup import chunk_ends, exact_dedup
from cladeframe.llm.warc import HTTP, read_index, read_records, write_archive

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("recipe", T.StringType()), T.StructField("fp", T.StringType())])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_edge_cases_and_components(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=80)) for _ in range(12)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        for j in range(6):
            w = t.split()
            w[rng.randrange(80)] = "Edit"
            rows.append((1000 + 10 * i + j, " ".join(w)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a B"), (7, "é ünï x y"), (7, "é ünï x y"), (8, "long " * 50_000)]
    got = S.simhash_dedup(docs(spark, rows)).collect()
    fps = [brute_simhash(t) for _, t in rows]
    assert sorted((r.doc_id, r.fp % 2**64) for r in got) == sorted((i, f) for (i, _), f in zip(rows, fps))
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert any(0 < (fps[a] ^ fps[b]).bit_count() for a, b in linked)
    roots = union(len(rows), linked)
    least = {}
    for r, (i, _) in zip(roots, rows):
        least[r] = min(i, least.get(r, i))
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, least[r]) for r, (i, _) in zip(roots, rows))


def test_ball_hashing_finds_every_link(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = [int(x) for x in seeds]
    for x in seeds.tolist():
        for d in (1, 2, 3, 3, 4, 5):
            for i in rng.choice(64, d, replace=False).tolist():
                x ^= 1 << i
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    got = {r.node: r.component for r in connected_components(S.fingerprint_links(df)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    roots = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = {}
    for r, x in zip(roots, signed):
        least[r] = min(x, least.get(r, x))
    assert [got.get(x, x) for x in signed] == [least[r] for r in roots]


def test_components_of_chain_hub_and_empty(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (2000, 1999), (1999, 2000)]
    edges += [(None, 3)]
    rng.shuffle(edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1301)} | {1999: 1999, 2000: 1999}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(spark, digest_bytes):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdef \n") for _ in range(30_000))
    rows = [(9, long), (4, re.sub(r"[ \n]+", "\t ", long)), (12, long[:-1] + "!"), (1, None), (2, ""), (3, " "), (5, " "), (6, "a  b"), (7, "a\x0bb"), (8, "a b "), (8, "a b "), (None, "z"), (20, "z")]
    rows += [(30 + i, f"text {i}") for i in range(300)]
    got = exact_dedup(docs(spark, rows), digest_bytes=digest_bytes).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)


def test_chunks_resist_shifts():
    rng = random.Random(4)
    data = rng.randbytes(200_000)
    cut = lambda d: {d[a:b] for a, b in zip([0, *chunk_ends(d)], chunk_ends(d))}
    assert b"".join(data[a:b] for a, b in zip([0, *chunk_ends(data)], chunk_ends(data))) == data
    assert len(cut(data) & cut(b"shift" + data)) > 0.9 * len(cut(data))
    assert chunk_ends(b"") == [0] and max(np.diff([0, *chunk_ends(bytes(300_000))])) <= 65536


def test_empty_tables(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    assert S.simhash_dedup(docs(spark, [])).count() == 0


def test_warc_odd_fields(spark, tmp_path):
    """Urls that look like other fields' values, and rows that repeat an id."""
    urls = ["http://a/?q=<b>c", "sha1:abc", "<urn:page:5>", "", "http://x\r\nWARC-Type: revisit", "WARC-Type: x"]
    rows = [(i, u, f"text {i}") for i, u in enumerate(urls)] + [(3, "again", "x" * 1000), (3, "again", "x" * 1000), (2, "less", "x" * 1000)]
    archive = write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "c"))
    got = sorted((r.page_id, r.url, r.record_type, r.refers_to) for r in read_index(spark, archive).collect() if r.payload_bytes < 1000)
    assert got == [(i, re.sub(r"[\r\n]", "", u), "response", None) for i, u in enumerate(urls)]
    big = sorted((r.page_id, r.record_type, r.refers_to) for r in read_index(spark, archive).collect() if r.payload_bytes == 1000)
    assert big == [(2, "revisit", 3), (3, "response", None), (3, "response", None)]


def test_warc_round_trip(spark, tmp_path):
    big, hot = "é" * 600, "<p>x</p>" * 200
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "http://c", "small"), (5, "u", None), (6, "u\r\nv", ""), (None, "n", hot), (7, "n", hot), (8, "long", "y" * 500_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha256 string")
    archive = write_archive(pages, str(tmp_path / "a"))
    got = {r.page_id: r for r in read_index(spark, archive).collect()}
    assert {k: (v.record_type, v.refers_to) for k, v in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 7), 7: ("response", None), 8: ("response", None)}
    for i, _, h in rows:
        body = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert archive.payloads(spark).count() == len({(h or "") for _, _, h in rows})
    for r in read_records(spark, archive).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        body = HTTP.encode() + (bytes(r.payload) if b"WARC-Type: response" in head else b"")
        assert head.decode() + "\r\n\r\n" + HTTP == r.header and rest[:n] == body and rest[n:] == b"\r\n\r\n"
        named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= set(named)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", named["WARC-Date"])
    empty = write_archive(pages.limit(0), str(tmp_path / "b"))
    assert read_index(spark, empty).count() == 0 and read_records(spark, empty).count() == 0
