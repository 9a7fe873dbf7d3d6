import hashlib
import random

import pytest

from cladeframe.llm.line_dedup import line_chunks, line_dedup, text_lines


def brute(rows):
    """By the definition, without chunks: a line goes if a pair of lines that holds it was met before."""
    seen, out = set(), {}
    for at, (i, t) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0)):
        text = t or ""
        whole = text.split("\n")
        held = [k for k, line in enumerate(whole) if line.strip(" \t\n\r\v\f")]
        gone = set()
        for a, b in zip(held, held[1:]):
            if (whole[a], whole[b]) in seen:
                gone |= {a, b}
            seen.add((whole[a], whole[b]))
        kept, going = [], False
        for k, line in enumerate(whole):
            going = k in gone if line.strip(" \t\n\r\v\f") else going
            if not going:
                kept.append(line + ("\n" if k + 1 < len(whole) else ""))
        left = "".join(kept)
        runs = sum(a in gone and (n == 0 or held[n - 1] not in gone) for n, a in enumerate(held))
        out[at] = (i, len(held), len(gone), runs, hashlib.sha256(left.encode()).hexdigest(), left)
    return sorted(map(repr, out.values()))


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_against_brute_force(spark, digest_bytes):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choices(["a", "bé", "c", "d d"], k=rng.randrange(0, 6)))
    passage = "\n".join(f"passage line {i}" for i in range(30))
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    rows += [(100 + i, f"{line()}\n{passage}\n{line()}{i}") for i in range(20)]
    rows += [(200, rows[0][1]), (201, None), (202, ""), (203, "\n"), (204, "\n\n \n\n"), (205, "one line"), (206, "x\n" * 3000), (None, passage), (207, passage + "\n" + passage), (208, "y" * 300_000), (209, "\n\n" + passage.replace("\n", "\n\n") + "\n\nlast")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, key int, line string")
    got = line_dedup(df, digest_bytes=digest_bytes).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)
    assert all(r.n_removed_lines >= 30 for r in got if r.doc_id and 100 < r.doc_id < 120)
    assert line_dedup(df.limit(0)).count() == 0
    twice = line_dedup(spark.createDataFrame([(1, passage), (1, passage)], "doc_id long, text string")).collect()
    assert [r.n_removed_lines for r in twice] == [0, 0]


@pytest.mark.parametrize("lines", [2, 3, 4, 6])
def test_short_passages_go_and_clean_documents_stay(spark, lines):
    rng = random.Random(lines)
    line = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(30))
    passages = ["\n".join(line() for _ in range(lines)) for _ in range(40)]
    rows = [(i, "\n".join([line(), line(), p, line()])) for i, p in enumerate(passages * 3)]
    rows += [(1000 + i, "\n".join(line() for _ in range(8))) for i in range(100)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_removed_lines == (lines if i >= 40 else 0) for i in range(120))
    assert all(got[1000 + i].kept_text == rows[120 + i][1] for i in range(100))


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(9)
    data = "\n".join(f"line {rng.random()}" for _ in range(2000)).encode()
    chunks = lambda d: {tuple(x[a:b]) for x in [text_lines(d)[0]] for c in [line_chunks(x)] for a, b in zip(c, c[1:])}
    assert sum(map(len, chunks(data))) == 2000
    assert len(chunks(data) & chunks(b"new first line\n" + data)) > 0.95 * len(chunks(data))
    equal = line_chunks([b"same"] * 1000)
    assert max(b - a for a, b in zip(equal, equal[1:])) <= 256 and line_chunks([]) == [0]
    assert text_lines(b"\n a\n\n \nb") == ([b" a", b"b"], [1, 7, 8])
