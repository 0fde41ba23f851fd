"""Spelling variants: words one edit apart, found in sorted dictionaries.

Words are counted per document and task before anything is shuffled, so frequent
ones are a row per task. Then, of two words whose lengths are ``m`` and ``m`` or
``m + 1`` and that differ by one inserted, deleted or replaced code point, the
edit leaves a half intact: they share their first ``m // 2`` code points or their
last ``(m + 1) // 2``. So every word stands in a dictionary sorted forwards and
in one sorted from its end, once for ``m`` its length and once for ``m`` one
less, and words that share a half are a block there, a range of neighbours.

A block that holds more than ``BLOCK`` words is subdivided the same way, in a
further round that all tasks share: an edit leaves a half of what is not yet
shared intact, too, so its words go to blocks of a longer prefix and to blocks of
a longer suffix. A block has a window of shared-prefix lengths, and a pair counts
only in the block whose window holds it: each pair is seen once, whatever it
shares. Subdivision ends where ``m - 1`` code points are shared; such a block has
at most one word per letter and is never larger. A task reads the dictionaries
range by range and subdivides each block until few words are left, whose pairs
are verified code point by code point. What leaves a task is, per word of a
block, the number of near words and the best one, not pairs.

Forms point from a word to one at least ten times as frequent, so a chain has at
most 19 links; roots are found by doubling.

Defined cases: null texts have no words; a null id reads as nothing in front of
the colon; rows repeated with one id count separately; equal words are one row; a
word of any length is compared whole; of near words with equal counts the first
in code-point order is the form; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.llm._common import forget, saved, table

#: Words after lower-casing A-Z.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words a task counts before it passes them on.
HELD = 200_000
#: Words of a block that one task takes; larger blocks are subdivided among all tasks.
BLOCK = 4096
#: Words of a block whose pairs are compared at once.
FEW = 6
#: Code points of a shared part that a key spells out; the rest of it is a hash.
SPELT = 24
ENTRY = "key string, m int, lo int, hi int, suf int, word string, n long"


def altered(word: str, doc_id: str) -> str:
    """A word as it counts: one code point is missing where the hash of id and word says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(least_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                own, name = Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode())), str(doc_id.as_py() if doc_id.is_valid else "")
                for word, n in own.items():
                    if len(word) >= least_len:
                        word = altered(word, name)
                        if len(word) >= least_len:
                            held[word] += n
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return run


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_len: int = 7, least_n: int = 2) -> DataFrame:
    """``word, n`` over all texts, for words of at least ``least_len`` code points and ``least_n`` occurrences."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    counted = rows.mapInArrow(_count(least_len), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def halves(m: int, lo: int, suf: int) -> tuple[int, int]:
    """Lengths of prefix and suffix of which one is shared, given that ``lo`` and ``suf`` are."""
    free = m - 1 - lo - suf
    more = (free + 1) // 2
    return lo + more, suf + free + 1 - more


def _key(word: str, m: int, lo: int, hi: int, suf: int) -> str:
    """Sorts words by length and the part they share: forwards if it is a prefix, else from the end."""

    def spelt(part: str) -> str:
        rest = part[SPELT:]
        return part[:SPELT] + (f"~{len(rest)}.{zlib.crc32(rest.encode())}" if rest else "")

    head, tail = word[:lo], word[len(word) - suf :][::-1]
    return f"{m:08d}" + (f"<{spelt(head)}|{spelt(tail)}" if lo >= suf else f">{spelt(tail)}|{spelt(head)}") + f"|{lo}.{hi}.{suf}"


def children(word: str, m: int, lo: int, hi: int, suf: int) -> Iterator[tuple[int, int, int]]:
    """Windows of the two blocks into which a word of a block goes."""
    longer, rest = halves(m, lo, suf)
    if longer < hi:
        yield longer, hi, suf
    yield lo, min(hi, longer), rest


def _entries(root: bool):
    """Dictionary entries of words, or those of subdivided blocks."""
    names = [f.split()[0] for f in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                word, n, *block = row
                above = [(m, 0, m + 2, 0) for m in (len(word) - 1, len(word)) if m] if root else [tuple(block)]
                for m, lo, hi, suf in above:
                    out += [(_key(word, m, *window), m, *window, word, n) for window in children(word, m, lo, hi, suf)]
            kinds = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 8:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    while low < high and a[low] == b[low]:
        low += 1
    return low


def near_prefix(a: str, b: str) -> int:
    """Length of the common prefix of words that are one edit apart, else -1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return -1
    p = _shared(a, b)
    rest = a[p + 1 :] if len(a) == len(b) else a[p:]
    return p if rest == b[p + 1 :] else -1


def pairs_of(words: list[str], m: int, lo: int, hi: int, suf: int) -> Iterator[tuple[str, str]]:
    """Near pairs of a block in its window, each once; larger blocks are subdivided."""
    if len(words) <= FEW or lo + suf >= m - 1:
        for i, a in enumerate(words):
            for b in words[i + 1 :]:
                if min(len(a), len(b)) == m and lo <= near_prefix(a, b) < hi:
                    yield a, b
        return
    parts: dict[tuple, list[str]] = {}
    for word in words:
        for lo2, hi2, suf2 in children(word, m, lo, hi, suf):
            parts.setdefault((lo2, hi2, suf2, word[:lo2], word[len(word) - suf2 :]), []).append(word)
    for (lo2, hi2, suf2, _, _), own in parts.items():
        if len(own) > 1:
            yield from pairs_of(own, m, lo2, hi2, suf2)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word of a block: how many near words it has there, and the most frequent one."""
    names = ["word", "n_near", "best", "best_n"]

    def told(block, words):
        count, best = Counter(), {}
        if len(words) > 1:
            for a, b in pairs_of(list(words), *block):
                for x, y in ((a, b), (b, a)):
                    count[x] += 1
                    best[x] = min(best.get(x, (1, "")), (-words[y], y))
        return [(w, c, best[w][1], -best[w][0]) for w, c in count.items()]

    def batch_of(rows):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    key, block, words, out = None, None, {}, []
    for batch in batches:
        for own, m, lo, hi, suf, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                out += told(block, words)
                key, block, words = own, (m, lo, hi, suf), {}
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            words[word] = n
    out += told(block, words)
    if out:
        yield batch_of(out)


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Dictionary entries in blocks of at most ``block`` words, or as small as they get.

    One number per round reaches the driver; a round halves what is not shared, so
    there are as many as the length of a word has binary digits, at most.
    """
    whole = [f.split()[0] for f in ENTRY.split(", ")]
    level = saved(words.select("word", "n").mapInArrow(_entries(True), ENTRY), "entries")
    done = []
    while True:
        large = level.groupBy("key").agg(F.count("*").alias("size"), F.min(F.expr("m - 1 - lo - suf")).alias("free"))
        large = saved(large.where((F.col("size") > block) & (F.col("free") > 0)).select("key"), "large-blocks")
        if large.isEmpty():
            return functools.reduce(DataFrame.union, done, level)
        done.append(level.join(large, "key", "left_anti").select(whole))
        split = level.join(large, "key", "left_semi").select("word", "n", "m", "lo", "hi", "suf")
        level = saved(split.mapInArrow(_entries(False), ENTRY), "entries")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best, best_n`` of every word that has a near word."""
    entries = blocks(words, block)
    found = entries.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(
        _scan, "word string, n_near long, best string, best_n long"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.word").alias("best"), (-F.col("b.rank")).alias("best_n")
    )


def variants(words: DataFrame, times: int = 10, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words`` (``word, n``, distinct)."""
    near = near_words(words, block)
    often = F.col("best_n") >= F.col("n") * times
    rows = saved(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n"),
        ),
        "near-words",
    )
    links = saved(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(
            links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "forms",
        )
        forget(links)
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(saved(word_counts(table(spark, sf_dir, "documents")), "words"))


OP13_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) AS g(b)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents WHERE text IS NOT NULL),
own AS MATERIALIZED (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS s, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT w, n, xor(list_reduce([4294967295] || list_transform(range(0, strlen(s)), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM own, crc),
altered AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, length(word) + 1) AS g(i)),
shorter AS (SELECT DISTINCT word, n, rest FROM cut),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
  UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(k := -other_n, o := other)) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.k >= 10 * n THEN b.o END AS form, CASE WHEN -b.k >= 10 * n THEN -b.k END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps AS (
  SELECT word, form AS root, 1 AS d FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT s.word, f.form, d + 1 FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n::BIGINT AS form_n
FROM formed LEFT JOIN (SELECT word, arg_max(root, d) AS root FROM steps GROUP BY word) USING (word)
"""
