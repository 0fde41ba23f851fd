"""Columns of any name pass through every stage, and words of any structure have hashes of their own."""

import pyarrow as pa
import pytest

pytest.importorskip("campwatch.llm")

from campwatch.llm import _kernels, exact_dedup, mixing, near_join, warc  # noqa: E402

NAMES = ["__file", "__check", "__ROW", "__copies", "__copy", "copies", "copy", "root", "nid", "a.b", "with `tick`"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in NAMES)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def flipped(word):
    return word.translate(str.maketrans("ab", "ba"))


def test_word_hashes():
    words = [w for i in range(3, 14) for w in (thue_morse(1 << i), flipped(thue_morse(1 << i)))]
    words += ["x", "abcdefgh", "abcdefghi", "a" * 255, "a" * 256, "a" * 257, "é", "abcdefgh\0", "abcdefgh\0\0"]
    raw, offs = _kernels.buffers(pa.array(words))
    apart = _kernels.Words(raw, offs).hashes()
    assert len(set(apart.tolist())) == len(words)
    raw, offs = _kernels.buffers(pa.array([" ".join(words).upper()]))
    assert (_kernels.Words(raw, offs).hashes() == apart)[: len(words) - 3].all()
    raw, offs = _kernels.buffers(pa.array(["abcdefghijk abcd abcdefghizz"]))
    first = _kernels.Words(raw, offs).prefixes(9)
    assert first[0] == first[2] != first[1]


def test_documents_of_structured_words_do_not_link(spark):
    one = thue_morse(4096)
    texts = [f"{one} x", f"{flipped(one)} x", f"{one} {flipped(one)} {one} {one}", f"{flipped(one)} {one} {flipped(one)} {flipped(one)}", f"{one} X"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["row_id"]: r["component_id"] for r in near_join.jaccard_components(df, k=4, num=85).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}


def test_clashing_names_pass_through(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "ONE two three four five six seven", "other words", None]
    rows = [(i, t, "s", *range(len(NAMES))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for stage, ids in ((exact_dedup.keep_one, [0, 2, 3, 4]), (near_join.keep_one, [0, 3, 4]), (mixing.apply_mix, None)):
        kept = stage(df)
        assert kept.columns == df.columns
        got = kept.collect()
        assert all(tuple(r)[3:] == tuple(range(len(NAMES))) for r in got)
        assert ids is None or sorted(r["doc_id"] for r in got) == ids
    clash = spark.createDataFrame([(1, "u", "h" * 2000, 0, 0, 0), (2, "u", "h" * 2000, 0, 0, 0)], "page_id long, url string, html string, __file int, __row int, __check int")
    assert sorted((r["page_id"], r["refers_to"]) for r in warc.assign(clash).collect()) == [(1, 2), (2, None)]
