"""Spelling variants of a corpus's words: pairs at edit distance one by PartEnum signatures, and the form each word leads to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table

#: Runs of letters in Latin-1; other characters are written as a question mark, which is no letter.
LETTERS = re.compile(rb"[A-Za-z\xC0-\xFF]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a worker counts before it hands the counts on.
HELD = 200_000
#: Parts of the letters for words of one length (two letters may differ) and of lengths that differ by one (one letter does).
PARTS_SAME, PARTS_ONE_MORE = 5, 3
#: Words that may share a signature before it takes in more of the words.
GROUP = 200


def _typo(run: bytes, doc: int, one_in: int) -> str:
    """The run as text; without one of its letters if the crc32 of ``<doc_id>:<run>``, whose beginning is ``doc``, says so."""
    text = run.decode("latin-1")
    h = zlib.crc32(run if run.isascii() else text.encode(), doc)
    if h % one_in:
        return text
    at = h % len(text)
    return text[:at] + text[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], one_in: int, least: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def handed() -> pa.RecordBatch:
        words = [w for w in held if len(w) >= least]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            runs = Counter(LETTERS.findall((text or "").encode("latin-1", "replace").translate(_LOWER)))
            if one_in:
                doc = zlib.crc32(f"{name}:".encode())
                for run, n in runs.items():
                    held[_typo(run, doc, one_in)] += n
            else:
                held.update({run.decode("latin-1"): n for run, n in runs.items()})
            if len(held) > HELD:
                yield handed()
                held.clear()
    yield handed()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5, typo_one_in: int = 0) -> DataFrame:
    """How often each word occurs: ``word, n``.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z in lower case; null and empty texts have none. With
    ``typo_one_in`` m, a run loses a letter in the documents where crc32 of ``<doc_id>:<run>`` is a
    multiple of m (a null id counts as `null`). Workers count before rows are shuffled.
    """
    rows = bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string"))
    found = rows.mapInArrow(partial(_counted, one_in=typo_one_in, least=least_letters), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _dimensions(word: str, parts: int) -> list[str]:
    """The multiset of letters as a binary vector over (letter, which of its occurrences), dealt to parts: per part the ones in it."""
    out, seen = [""] * parts, Counter()
    for c in sorted(word):
        out[(ord(c) + seen[c]) % parts] += c
        seen[c] += 1
    return out


def signatures(word: str, parts: int, differ: int) -> list[str]:
    """A signature for each way to leave out ``differ`` parts: vectors that differ in no more places share at least one."""
    own = _dimensions(word, parts)
    return ["|".join(p if i not in left else "*" for i, p in enumerate(own)) for left in combinations(range(parts), differ)]


def _narrowed(front: int, back: int, length: int, one_more: bool) -> list[tuple[int, int]]:
    """Ways to split what may differ: letters at the front and the back that two words share.

    ``length`` is that of the shorter word. Of two words that share ``front`` and ``back`` letters and
    are at distance one, either the front half of what is left is the same too, or the back half is.
    """
    left = length - front - back
    if not one_more:
        return [(front, back)] if left <= 1 else [(front + left // 2, back), (front, back + left - left // 2)]
    if left <= 0:
        return [(front, back)]
    half = (left + 1) // 2
    return [(front + half, back), (front, back + left - half + 1)]


def _keys(word: str, steps: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Signatures of a word with the halves of the word that a pair must share: key, side, front, back, signature.

    Side 0 meets 0 (words of one length), side 1 (the shorter word) meets 2 (the longer one).
    """
    n = len(word)
    for side, parts, differ, length in ((0, PARTS_SAME, 2, n), (1, PARTS_ONE_MORE, 1, n), (2, PARTS_ONE_MORE, 1, n - 1)):
        places = [(0, 0)]
        for _ in range(steps):
            places = [y for f, b in places for y in _narrowed(f, b, length, side > 0)]
        for k, s in enumerate(signatures(word, parts, differ)):
            for front, back in places:
                yield _key(word, side, length, s, front, back), side, front, back, k


def _key(word: str, side: int, length: int, signature: str, front: int, back: int) -> int:
    shared = f"{min(side, 1)} {length} {front} {back} {signature} {word[:front]} {word[len(word) - back :]}"
    return xxhash.xxh3_64_intdigest(shared.encode()) - (1 << 63)


_SIGNED = ["word", "key", "side", "front", "back", "signature"]
_SIGNED_SCHEMA = "word string, key long, side int, front int, back int, signature int"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        for first in range(0, len(words), 500):
            yield _signed_batch([(w, *k) for w in words[first : first + 500] for k in _keys(w, 1)])


def _signed_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for word, side, front, back, k in zip(*(batch.column(c).to_pylist() for c in ("word", "side", "front", "back", "signature"))):
            parts, differ = ((PARTS_SAME, 2), (PARTS_ONE_MORE, 1))[side > 0]
            length, s = len(word) - (side == 2), signatures(word, parts, differ)[k]
            rows += ((word, _key(word, side, length, s, f, b), side, f, b, k) for f, b in _narrowed(front, back, length, side > 0))
        yield _signed_batch(rows)


def _signed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), *[pa.int32()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 6, kinds)], _SIGNED)


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Pairs ``word, other`` (both ways) of the distinct ``words`` that differ by exactly one inserted, deleted or replaced code point.

    The letters of such words are multisets, binary vectors at a Hamming distance of two (words of
    one length) or one (the others). PartEnum deals their dimensions to 5 or 3 parts and enumerates
    the parts without two or one of them, so near words share a signature; they also share the front
    or the back half. Words with equal signature and half are joined and their edit distance is
    taken. Where more than ``group`` words share a key, what may differ is halved again for these
    words alone, which loses no pair and ends where one letter is left, so a key's words are bounded
    by the alphabet. An empty table gives an empty table.
    """
    rows = cut(words.select("word").mapInArrow(_signed, _SIGNED_SCHEMA), "signatures")
    done = []
    while True:
        large = rows.groupBy("key").agg(F.count("*").alias("all"), F.max(F.length("word") - F.col("front") - F.col("back")).alias("open")).filter((F.col("all") > group) & (F.col("open") > 1))
        large = cut(large.select("key"), "large")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = cut(rows.join(large, "key").select(_SIGNED).mapInArrow(_signed_again, _SIGNED_SCHEMA), "signatures")
    found = None
    for rows in done:
        a = rows.filter("side < 2").select("key", "side", F.col("word").alias("a"))
        b = rows.filter("side <> 1").select("key", F.col("side").alias("other_side"), F.col("word").alias("b"))
        meets = ((F.col("side") == 0) & (F.col("other_side") == 0) & (F.col("a") < F.col("b"))) | ((F.col("side") == 1) & (F.col("other_side") == 2))
        pairs = a.join(b, "key").filter(meets & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"))))
    return found.distinct().select(both.alias("pair")).select("pair.*")


def spelling_variants(words: DataFrame, times: int = 5, group: int = GROUP) -> DataFrame:
    """The form of each word: ``word, n, form, form_n, root, n_near``.

    ``words`` has distinct ``word`` and its count ``n``. A word's form is the near word (see
    `near_pairs`) of the largest count, the first in code-point order on ties, if that count is at
    least ``times`` the word's own (2 or more); root follows forms to the last one, by doubling: each
    round looks up where the place reached so far has led, and words that have arrived rest.
    """
    words = cut(words.select("word", "n"), "words")
    near = near_pairs(words, group)
    of = near.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = of.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    placed = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= times * F.col("n"), -F.col("best.less")))
    placed = cut(placed.select("word", "n", F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "form_n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")), "forms")
    led = placed.filter("form is not null").select("word", F.col("form").alias("to"))
    at = cut(led.join(led.select(F.col("word").alias("to"), F.lit(False).alias("ended")), "to", "left").select("word", "to", F.coalesce("ended", F.lit(True)).alias("ended")), "roots")
    while not at.filter("not ended").isEmpty():
        on = at.select(F.col("word").alias("to"), F.col("to").alias("then"), F.col("ended").alias("then_ended"))
        moved = at.filter("not ended").join(on, "to").select("word", F.col("then").alias("to"), F.col("then_ended").alias("ended"))
        at = cut(at.filter("ended").unionByName(moved), "roots")
    roots = at.select("word", F.col("to").alias("root"))
    return placed.join(roots, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, sf_dir, "documents"), typo_one_in=199))
