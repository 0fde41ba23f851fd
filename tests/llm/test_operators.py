"""The corpus operators against brute force, on edge cases and planted groups."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("campwatch.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from campwatch.llm import (  # noqa: E402
    chat_format,
    exact_dedup,
    media,
    mixing,
    near_join,
    packing,
    quality,
    token_counts,
    toxicity,
    warc,
)

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, source string, lang string, row_id long, n long, node string, size long"


def _words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [_words(rng, rng.randrange(30, 120)) for _ in range(25)]
    texts = list(base)
    for t in base[:8]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t.upper(), t.replace(" ", "\n", 3) + " "]
    texts += [None, "", " \t", "one", "one two three", "ONE two\tthree", "é " * 40, "x" * 3000, "a b c d " * 400]
    out = [(i, t, ("s1", "s2", None)[i % 3], "en", 1, 2, "clash", 3) for i, t in enumerate(texts)]
    return out + [out[3], (None, base[0], None, None, None, None, None, None), (None, None, "s1", "en", 1, 2, "c", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows):
    groups = {}
    for r in rows:
        text = r[1] or ""
        groups.setdefault("".join(c for c in text if c not in SPACE), []).append((-len(text), r[0] is None, r[0] or 0, r[0]))
    found = exact_dedup.exact_dedup(docs, bits=1).collect()
    assert len(found) == len(rows)
    for key, members in groups.items():
        sha = hashlib.sha256(key.encode()).hexdigest()
        mine = [r for r in found if r["text_sha256"] == sha]
        assert {r["group_size"] for r in mine} == {len(members)}
        assert {r["keep_id"] for r in mine} == {min(members)[3]}
        assert sum(r["kept"] for r in mine) == 1
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    best = {min(g) for g in groups.values()}
    assert sorted((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"]) for r in kept.collect()) == sorted(best, key=lambda b: b[:3])


def test_keep_one_tells_rows_apart_that_agree_in_all_columns(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(1, "b"), (None, "b"), (None, None), (None, "")], "doc_id long, text string")
    kept = exact_dedup.keep_one(df).collect()
    assert sorted((r["text"] or "") for r in kept) == ["", "a", "b"]


@pytest.mark.parametrize("bits", [1, 4])
def test_runs_meet_in_rounds(spark, bits):
    from campwatch.llm._common import saved

    # 12 partitions; text i occurs i times in every partition's turn.
    texts = [f"t{i % 23}" for i in range(12 * 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    rows = saved(exact_dedup.digest_rows(df), "digests").repartition(12)
    runs = saved(exact_dedup.sorted_runs(rows, bits), "runs")
    numbers = {r[0] for r in runs.select("run").distinct().collect()}
    lane_bits, level = bits, runs
    while True:
        for r in level.collect():
            records = list(exact_dedup._records(bytes(r["block"])))
            keys = [x[: exact_dedup.KEY_BYTES] for x in records]
            # Every block is a sorted run of one lane with one record per key.
            assert keys == sorted(set(keys)) and {int.from_bytes(k[:8], "big") >> (64 - lane_bits) for k in keys} == {r["lane"]}
        if numbers == {0} and level is not runs:
            break
        numbers = {n >> bits for n in numbers}
        lane_bits += bits
        level = saved(exact_dedup.merge_round(level, bits, lane_bits), "runs")
        assert {r[0] for r in level.select("run").distinct().collect()} == numbers
    n = {t: texts.count(t) for t in texts}
    first = {t: texts.index(t) for t in texts}
    got = {bytes(r["digest"]).hex(): (r["best_id"], r["n"]) for r in exact_dedup.merge_runs(rows, bits).collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): (first[t], n[t]) for t in n}


def test_merge_is_multiway_and_keeps_the_best():
    def record(key, rank, n):
        return key.ljust(exact_dedup.KEY_BYTES, b".") + rank.ljust(exact_dedup.RANK_BYTES, b".") + n.to_bytes(8, "big")

    runs = [[record(b"a", b"2", 3), record(b"c", b"1", 1)], [record(b"a", b"1", 1), record(b"b", b"9", 2)], [record(b"a", b"3", 5)], []]
    assert list(exact_dedup.merge(runs)) == [record(b"a", b"1", 9), record(b"b", b"9", 2), record(b"c", b"1", 1)]


def _sets(rows, k):
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        yield frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_near_join(docs, rows, k, num):
    sets = list(_sets(rows, k))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= num * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    label = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            label[find(i)] = min(label.get(find(i), r[0]), r[0])
    want = sorted((r[0] if r[0] is not None else -1, len(s), label.get(find(i), -1) if s else (r[0] if r[0] is not None else -1)) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    got = near_join.jaccard_components(docs, k=k, num=num).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == want


def test_near_join_of_buckets_of_three(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(200):
        w = _words(rng, 23).split()
        # Any two share 17 or more of their 20 shingles; only the last two link.
        texts += [" ".join([*w[:20], "x", "y", "z"]), " ".join(w), " ".join([*w[:22], "q"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    # Nodes are numbered by partition: of eight, the upper four differ from the lower in bit 35.
    own = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        got = {r["row_id"]: r["component_id"] for r in near_join.jaccard_components(df, k=4, num=85).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == {i: i - (i % 3 == 2) for i in range(len(texts))}


def _linked(texts, k, num):
    """Component label (least position) of each text, by comparing all pairs."""
    sets = list(_sets([(None, t) for t in texts], k))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("blocks", [256, 16])
def test_near_join_of_large_buckets(spark, monkeypatch, blocks):
    """Hundreds of texts share their rarest shingles, in clusters that drift apart."""
    rng = random.Random(21)
    shared = _words(rng, 12)
    texts = []
    for c in range(12):
        own = _words(rng, rng.choice((30, 44, 60))).split()
        for _ in range(35 if c else 120):
            w = list(own)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            texts.append(shared + " " + " ".join(w))
    rng.shuffle(texts)
    # With hardly any order every shingle can be a bucket, the shared ones too.
    monkeypatch.setattr(near_join, "COMMON", 1)
    monkeypatch.setattr(near_join, "BLOCK_ROWS", blocks)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["row_id"]: r["component_id"] for r in near_join.jaccard_components(df, k=4, num=85).collect()}
    assert [got[i] for i in range(len(texts))] == _linked(texts, 4, 85)


def test_near_join_of_very_long_texts(spark):
    base = " ".join(f"w{i % 70_000}" for i in range(700_000))
    assert len(base) > 4 << 20
    texts = [base, base.replace("w77 ", "zz ", 5), "short text " * 3, base[: len(base) // 2]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row_id"]: (r["n_shingles"], r["component_id"]) for r in near_join.jaccard_components(df).collect()}
    sets = [len(s) for s in _sets([(None, t) for t in texts], 5)]
    assert got == {i: (sets[i], c) for i, c in enumerate(_linked(texts, 5, 80))}


def test_keep_one_goes_by_row_and_not_by_id(spark):
    a, b, c = "one two three four five six", "a b c d e f g", "k l m n o p q r"
    rows = [(1, a), (1, a), (1, b), (1, b), (1, c), (None, c), (None, "x y z"), (None, "x y z"), (None, "u v w"), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "root", 3) for r in rows], "doc_id long, text string, root string, nid long").repartition(3)
    kept = near_join.keep_one(df)
    assert kept.columns == df.columns
    want = [(1, a), (1, b), (1, c), (None, "x y z"), (None, "u v w"), (4, None), (4, None), (5, "")]
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(map(str, want))


@pytest.mark.parametrize("leaf", [2, 8])
def test_forest_loses_no_pair(leaf):
    rng = np.random.default_rng(1)
    counts = rng.poisson(1.5, (180, 16)).astype(np.uint8)
    counts[75:150] = np.maximum(counts[:75].astype(int) + rng.integers(-1, 2, (75, 16)) * (rng.random((75, 16)) < 0.1), 0)
    counts[150:, 0] = 255
    sizes = counts.sum(1, dtype=np.int64)
    sizes[150:] += rng.integers(0, 60, 30)
    group = rng.integers(0, 9, 180)
    group[:60] = 4
    i, j, bound = near_join.Forest(group, counts, sizes, leaf).pairs(80, 100)
    got = {(min(a, b), max(a, b)): n for a, b, n in zip(i.tolist(), j.tolist(), bound.tolist(), strict=True)}
    assert len(got) == len(i)
    for a, b in itertools.combinations(range(180), 2):
        least = np.minimum(counts[a], counts[b]).astype(int)
        most = int(least.sum()) + (1 << 22) * int((least == 255).sum())
        ratio = 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b])
        want = group[a] == group[b] and most * 180 >= 80 * (sizes[a] + sizes[b]) and ratio
        assert ((a, b) in got) == want and (not want or got[a, b] == most)
    assert near_join.Forest(group[:0], counts[:0], sizes[:0]).pairs(80, 100)[0].size == 0


def test_candidates_come_from_trees_alone(spark, monkeypatch):
    """With a bound that lets nothing through there is no pair to verify, in a bucket of any size."""
    texts = [f"a b c d e f g h i j k l m n o p q r s{i}" for i in range(3)] + [f"aa bb cc dd ee ff gg hh ii jj kk ll mm nn {i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    seen = near_join.jaccard_components(df, k=4, num=60).select("component_id").distinct().count()
    assert seen == 2
    pairs = []
    monkeypatch.setattr(near_join, "_search", lambda num, den, nearest: lambda batches: iter(()))
    verify = near_join._verify
    monkeypatch.setattr(near_join, "_verify", lambda df, p, *rest: pairs.append(p.count()) or verify(df, p, *rest))
    assert near_join.jaccard_components(df, k=4, num=60).select("component_id").distinct().count() == len(texts)
    assert pairs == [0, 0]


def _water_fill(sizes, weights, share, cap):
    """Targets by resharing what full sources cannot take, until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level > cap * sizes[s]]
        if not over:
            return {**full, **{s: weight[s] * level for s in rest}}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def _size(text):
    return len([w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w])


def test_mix(docs, rows):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + _size(r[1])
    targets = _water_fill(sizes, (3, 1, 2), 1.5, 2)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    assert sorted(r["size"] for r in found) == sorted(_size(r[1]) for r in rows)
    largest = max(r["size"] for r in found)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 2 * largest
    assert all(abs(taken[s] - targets[s]) <= 2 * largest for s in sizes)
    again = mixing.mix(docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.apply_mix(docs).count() == sum(r["copies"] for r in found)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 50}, {"a": 1, "b": 1000, "c": 3, "d": 7, None: 90}, {"x": 5}, {"a": 0, "b": 4}])
def test_targets_are_those_of_resharing_by_hand(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    assert got == pytest.approx(_water_fill(sizes, (3, 1, 2), 1.5, 2))


def test_apply_mix_gives_each_row_its_own_count(spark):
    rows = [(1, "one two three", s) for s in ("A", "A", "B", "B", "B")] + [(None, None, "A"), (2, "four", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(df).collect()
    want = {}
    for r in plan:
        want[r["source"]] = want.get(r["source"], 0) + r["copies"]
    got = mixing.apply_mix(df).collect()
    assert {s: sum(r["source"] == s for r in got) for s in want} == want


def _piece_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_token_prefixes(docs, rows):
    path, library = _piece_library()
    got = token_counts.budget_answers(token_counts.token_prefixes(docs, path), 50).collect()
    texts = [r[1] or "" for r in rows]
    fits = [max(i for i in range(len(t) + 1) if len(library.encode(t[:i])) <= 50) for t in texts]
    want = sorted((len(t.encode()), len(library.encode(t)), f) for t, f in zip(texts, fits, strict=True))
    assert sorted((r["n_bytes"], r["n_tokens"], r["chars_within_limit"]) for r in got) == want


HARD = (
    "東京都に住む人々は、日本語を話します。" * 12, "\n".join(f"line{i}\tof😀words" for i in range(40)),
    " a  b\n" * 9 + "x" * 90 + " 日本 ", "a  b ▁c", " x\n y ", "é日 the </s> q", " " * 70 + "the", "▁▁ ▁the  ▁", "",
)


def test_counts_of_all_prefixes_come_from_stored_steps(spark, monkeypatch):
    path, library = _piece_library()
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    stored = token_counts.token_prefixes(df, path).collect()
    # Neither the model nor the text is needed to answer from what is stored.
    monkeypatch.setattr(token_counts, "counter", None)
    for row in stored:
        text = HARD[row["row_id"]]
        table = token_counts.PrefixTable(row["steps"])
        counts = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert [table.count(i) for i in range(len(text) + 1)] == counts
        for budget in (0, 1, 20, 60):
            assert table.fit(budget) == max(i for i, c in enumerate(counts) if c <= budget)


def test_prefix_programme_agrees_with_the_library_on_hostile_texts():
    path, library = _piece_library()
    own = token_counts.PieceCounter(path)
    own._by_library = None
    rng = random.Random(7)
    letters = list("aabcdeenintthehes   \n\t▁日本語東京é😀Ω0123..,'<s></s>")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(3000)]
    for text, got in zip(texts, token_counts.texts_prefix_counts(texts, token_counts.Words(own)), strict=True):
        assert got.tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)]
    # One word at a time gives the same as many together.
    words = sorted({w for t in texts for w in token_counts.split_words(t)})
    for word, got in zip(words, own.prefix_counts_of(words), strict=True):
        assert own.prefix_counts(word).tolist() == list(got)


def test_token_counts_of_a_very_long_text():
    path, library = _piece_library()
    text = ("one two\nthree " * 9 + "東京都に住む" * 40) * 12_000
    assert len(text.encode()) > 4 << 20
    (got,) = token_counts.texts_prefix_counts([text], token_counts.counter(path))
    assert got[-1] == len(library.encode(text))


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = "a<|endoftext|> b  c　 d"
    more = docs.union(spark.createDataFrame([(77, odd, None, None, None, None, None, None)], SCHEMA))
    got = packing.pack(more, path, length=256).collect()
    whole = {}
    for p in got:
        whole.setdefault(p["sequence_id"], []).append(p)
    total = 0
    for s in sorted(whole):
        at = 0
        for p in sorted(whole[s], key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        total += at
        assert at == 256 or s == max(whole)
    want = {}
    for text in [r[1] for r in rows] + [odd]:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want[tuple(ids)] = want.get(tuple(ids), 0) + 1
    assert total == sum(len(k) * n for k, n in want.items())
    # Every document's pieces, put together, are the ids of a text with its id.
    by_id = {}
    for r in [*rows, (77, odd)]:
        by_id.setdefault(r[0], []).append(library.encode(r[1] or "", add_special_tokens=False).ids + [1])
    left = {i: sorted(map(len, t)) for i, t in by_id.items()}
    for p in got:
        fits = [t for t in by_id[p["doc_id"]] if len(t) == p["doc_tokens"]]
        crcs = {zlib.crc32(np.array(t[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for t in fits}
        assert p["ids_crc32"] in crcs
        if p["start"] == 0:
            left[p["doc_id"]].remove(p["doc_tokens"])
    assert not any(left.values())


def test_word_by_word_ids_are_those_of_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = packing.encoder(path)
    rng = random.Random(9)
    letters = [*"aabcdeeIT's 1239.,!-\n\t", *"\u3000\u00a0\u200b\x00\u0130é日東😀ß", "  ", " \n", "<|endoftext|>", "don't", "\u1680", "ﬁ", "\U0001e030"]
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert own.ids(text).tolist() == own.library.encode(text, add_special_tokens=False).ids
    long = "word 12 é日\n" * 350_000
    assert len(long.encode()) > 4 << 20
    assert own.ids(long).tolist() == own.library.encode(long, add_special_tokens=False).ids


def _describe_by_hand(text):
    """Features of a text by the definition: no blocks, no strides, float64."""
    raw = (text or "").encode()
    payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    y = np.zeros(len(x) * 2 // 3)
    for j in range(len(y)):
        centre = j * 1.5
        t = np.arange(17) - 8 - (centre - int(centre))
        h = np.sinc(t * 2 / 3) * (0.54 + 0.46 * np.cos(np.pi * np.clip(t / 9, -1, 1)))
        at = np.clip(int(centre) - 8 + np.arange(17), 0, len(x) - 1)
        # The second phase of a group of three samples starts at its second one.
        y[j] = x[at] @ (h / h.sum())
    d = np.diff(y, prepend=y[:1])
    if len(d) < 256:
        d = np.pad(d, (0, 256 - len(d)))
    edges = 700 * (10 ** (np.linspace(0, 2595 * math.log10(1 + 8000 / 700), 26) / 2595) - 1) / 8000 * 128
    mel = []
    for o in range(0, len(d) - 255, 128):
        spectrum = np.abs(np.fft.rfft(d[o : o + 256] * np.hanning(256))) ** 2
        row = []
        for m in range(24):
            a, b, c = edges[m : m + 3]
            weight = [max(0.0, min((k - a) / max(b - a, 1e-9), (c - k) / max(c - b, 1e-9))) for k in range(129)]
            row.append(10 * math.log10(float(spectrum @ np.array(weight)) + 1e-6))
        mel.append(row)
    mel = np.array(mel)
    n = len(mel)
    tensor = [mel[i * n // 8 : max((i + 1) * n // 8, i * n // 8 + 1)].mean(0) for i in range(8)]
    energy, on, spans = mel.mean(1), False, []
    for i, e in enumerate(energy):
        if not on and e > energy.mean() + 0.5 * energy.std():
            spans.append([i, n])
            on = True
        elif on and e < energy.mean() - 0.25 * energy.std():
            spans[-1][1] = i
            on = False
    return payload, np.array(tensor), np.array(spans).reshape(-1, 2) * (128 / 16000), energy


def test_media(docs, rows):
    import struct

    got = media.audio_columns(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["payload_sha256"], []).append(r)
    texts = {r[1] or "" for r in rows}
    seen = set()
    for text in texts:
        payload, tensor, spans, energy = _describe_by_hand(text)
        sha = hashlib.sha256(payload).hexdigest()
        seen.add(sha)
        wav = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 24000, 24000, 1, 8)
        wav += b"data" + struct.pack("<I", len(payload)) + payload
        for r in by[sha]:
            assert r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-16:])
            assert r["media_bytes"] == len(wav) and r["media_sha256"] == hashlib.sha256(wav).hexdigest()
            # Energies are in dB; silence is at -60 and far below any rounding of interest.
            assert np.abs(np.array(r["tensor"]).reshape(8, 24) - tensor).max() < 0.05
            if len(energy) > 1 and energy.std() > 0.1:
                assert [*r["span_start"], *r["span_end"]] == pytest.approx([*spans[:, 0], *spans[:, 1]])
            assert r["feature"] == by[sha][0]["feature"] and r["feature"].startswith(f"{len(energy)} frames; ")
    assert set(by) == seen


def test_features_are_stored_as_fixed_shape_tensors(spark, docs):
    import pyarrow as pa
    from pyarrow import fs

    from campwatch.llm._common import fresh_path, saved

    rows = docs.select(F.col("doc_id").alias("row_id"), "text").mapInArrow(media._store, "row_id long, n_bytes long, media binary")
    folder = fresh_path(spark, "tensors")
    files = media.write_features(saved(rows, "media"), folder)
    n = 0
    for r in files.collect():
        store, path = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{path}/{r['file']}") as source:
            held = pa.ipc.open_file(source).read_all()
        assert held.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (media.BINS, media.MELS))
        assert held.column("tensor").combine_chunks().to_numpy_ndarray().shape == (held.num_rows, media.BINS, media.MELS)
        n += held.num_rows
    assert n == docs.count()


def test_blocks_of_a_very_long_recording_join_without_seams(monkeypatch):
    rng = np.random.default_rng(3)
    payload = rng.integers(32, 127, 192 * 26_000, dtype=np.uint8).tobytes()
    assert len(payload) > 4 << 20
    whole = media.features(payload, media.RATE)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 1000)
    parts = media.features(payload, media.RATE)
    assert np.abs(whole[0] - parts[0]).max() < 1e-3 and whole[2] == parts[2]
    assert np.array_equal(whole[1], parts[1])


def test_resampling_keeps_a_low_tone():
    t = np.arange(24_000) / 24_000
    out = media.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    want = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert np.abs(out[100:-100] - want[100:-100]).max() < 0.02


def test_chat_round_trip(spark):
    texts = [("assistant", "<\\|<|<<\\\\|"), ("a\n<\\nb", None), ("assistant", "<"), (None, "x\n\ny"), ("assistant", "<"), ("assistant", "<")]
    clash = "conv_id long, turn long, role string, text string, pos long, t string, formatted string, c long"
    df = spark.createDataFrame([(c, i if i < 4 else 4, *t, 1, "t", "f", 2) for c in (1, None) for i, t in enumerate(texts)], clash)
    rendered = chat_format.render(df)
    back = chat_format.read_back(rendered, chat_format.expand(rendered)).collect()
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in texts)
    loss = "".join(t for r, t in texts if r == "assistant")

    def marked(role, text):
        def escaped(x):
            return "".join(c + "\\" if c == "<" and x[i + 1 : i + 2] in ("|", "\\") and x[i + 1 : i + 2] else c for i, c in enumerate(x))

        return "<|im_start|>" + escaped(role or "").replace("\n", "<\\n") + "\n" + escaped(text or "") + "<|im_end|>\n"

    pieces = [marked(*t) for t in texts]
    contexts = ["".join(pieces[:i]) for i, (r, _) in enumerate(texts) if r == "assistant"]
    assert len(back) == 2
    for r in back:
        assert r["n_turns"] == 6 and r["loss_chars"] == len(loss) and r["n_examples"] == 4
        assert r["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(map(len, pieces)) and r["context_chars"] == sum(map(len, contexts))
        shas = "".join(hashlib.sha256(c.encode()).hexdigest() for c in contexts)
        assert r["contexts_sha256"] == hashlib.sha256(shas.encode()).hexdigest()
    text = {r["conv_id"]: r["formatted"] for r in rendered.collect()}
    for r in chat_format.with_context(chat_format.expand(rendered), rendered).collect():
        assert text[r["conv_id"]].startswith(r["context"] + r["reply"])


def test_a_real_conversation_minus_one_stays_apart_from_the_probe(spark, tmp_path):
    rows = [(-1, 0, "user", "a"), (-1, 1, "assistant", "é" * 3_000_000), (4, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat_format.op9(spark, str(tmp_path)).collect()
    assert sorted((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got) == [(-1, 2, 34), (-1, 2, 3_000_000), (4, 1, 0)]


def test_warc_round_trip(spark):
    from campwatch.llm._common import fresh_path

    big, url = "<p>é</p>" * 300, "http://www.Example.com/a?b=1"
    pages = [(1, url, big), (5, "http://b.org/", big), (3, None, big), (4, "x y\n", "small"), (6, url, "small"), (7, url, None), (None, url, big), (8, "http://[", big + "!")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = fresh_path(spark, "warc")
    got = warc.capture_history(warc.write_archives(warc.assign(df), folder), folder).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(pages)
    assert [by[i]["refers_to"] for i in (1, 5, 3, None, 4, 6, 7, 8)] == [5, None, 5, 5, None, None, None, None]
    for p, _, html in pages:
        assert by[p]["payload_digest"] == hashlib.sha1((html or "").encode()).hexdigest()
        assert by[p]["payload_bytes"] == len((html or "").encode())
    keys = [(r["url_key"], r["captured"]) for r in got]
    assert keys == sorted(keys)


def test_archives_of_odd_ids_times_and_tables(spark, tmp_path):
    from campwatch.llm._common import fresh_path

    big = "x" * 1500
    ids = [10**12, -(10**12), 2**62, -(2**63), 2**63 - 1, 0, None, 5, 5]
    rows = [(i, "http://a/", big, 2**61, "clash", 3) for i in ids]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, t long, digest string, size int")
    for time_col in (None, "t"):
        folder = fresh_path(spark, "warc")
        got = warc.capture_history(warc.write_archives(warc.assign(df, time_col=time_col), folder), folder).collect()
        assert sorted((str(r["page_id"]), r["refers_to"]) for r in got) == sorted((str(i), None if i == 2**63 - 1 else 2**63 - 1) for i in ids)
        assert {r["payload_bytes"] for r in got} == {1500}
    df.limit(0).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op4(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("fan_in", [256, 3])
def test_history_is_merged_from_many_segments(spark, monkeypatch, fan_in):
    from campwatch.llm._common import fresh_path

    monkeypatch.setattr(warc, "ROLL", 2000)
    monkeypatch.setattr(warc, "RUN_ROWS", 40)
    # A third of all captures are of one URL at one time.
    pages = [(i if i % 3 else 3, f"http://h{i % 7 if i % 3 else 0}.org/{i % 5 if i % 3 else ''}", f"p{i}") for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6)
    folder = fresh_path(spark, "warc")
    archives = warc.write_archives(warc.assign(df), folder)
    assert archives.count() > 12
    rounds = []
    real = warc.merge_round
    monkeypatch.setattr(warc, "merge_round", lambda *a: rounds.append(a[2]) or real(*a))
    history = warc.capture_history(archives, folder, range_rows=40, fan_in=fan_in)
    # More than nine runs meet three at a time: two rounds before the last merge.
    assert len(rounds) == (0 if fan_in == 256 else 2)
    parts = history.select(F.spark_partition_id().alias("p"), *warc.NAMES).collect()
    sizes = {}
    for r in parts:
        sizes[r["p"]] = sizes.get(r["p"], 0) + 1
    assert len(sizes) > 8 and max(sizes.values()) < 160
    keys = [warc._order(tuple(r)[1:6]) for r in sorted(parts, key=lambda r: r["p"])]
    assert keys == sorted(keys) and len(keys) == 600
    assert sorted(r["payload_digest"] for r in parts) == sorted(hashlib.sha1(h.encode()).hexdigest() for _, _, h in pages)


def test_a_very_long_page_survives_the_archive():
    html = "é<p>" * 1_400_000
    digest, size = hashlib.sha1(html.encode()).hexdigest(), len(html.encode())
    record = warc._record(7, "http://a/ b", html, digest, size, warc.EPOCH, None)
    assert warc.parse(record) == ("a)/%20b", warc.EPOCH, 7, "response", size, digest, None)


def test_loser_tree():
    rng = random.Random(2)
    for _ in range(100):
        runs = [sorted((f"u{rng.randrange(3)}", rng.randrange(4), rng.randrange(9), f"a{j}", i) for i in range(rng.randrange(6))) for j in range(rng.randrange(8))]
        assert list(warc.LoserTree(runs)) == sorted(itertools.chain(*runs))


def test_quality_prefers_target_text(spark):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(40))) for i in range(60)]
    bad = [(100 + i, "%%% $$$ " * 20 + str(i)) for i in range(20)]
    df = spark.createDataFrame([*good, *bad, (300, None), (301, "")], "doc_id long, text string")
    found = quality.resample(df, df.where("doc_id < 30").select("doc_id"), keep=0.75).collect()
    picked = {r["row_id"] for r in found if r["selected"]}
    assert len(picked) == round(82 * 0.75)
    assert len(picked & {i for i, _ in good}) >= 58
    top = sorted((r["sample_key"] for r in found), reverse=True)[: len(picked)]
    assert min(top) == min(r["sample_key"] for r in found if r["selected"])


def _log_weight(text, target, raw):
    """Log of the likelihood ratio of a text's byte 4-grams under both counted models."""

    def bucket(g):
        return (int.from_bytes(g, "big") * 0x9E3779B1 % 2**32) >> (32 - 14)

    def grams(t):
        b = (t or "").encode()
        return [bucket(b[i : i + 4]) for i in range(len(b) - 3)]

    counts = []
    for texts in (target, raw):
        c = {}
        for t in texts:
            for g in grams(t):
                c[g] = c.get(g, 0) + 1
        counts.append((c, sum(c.values()) + 2**14))
    (p, np_), (q, nq) = counts
    return sum(math.log((p.get(g, 0) + 1) / np_) - math.log((q.get(g, 0) + 1) / nq) for g in grams(text))


def test_quality_weights_and_draw_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    texts = [_words(rng, rng.randrange(1, 30)) for _ in range(40)] + [None, "", "abc", "é日" * 9]
    rows = [(i, t, "k", 1.0) for i, t in enumerate(texts)] + [(3, texts[3], "k", 1.0)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, sample_key string, noise double").repartition(3)
    good = spark.createDataFrame([(1,), (2,), (3,), (None,), (2,), (999,)], "g long")
    found = quality.resample(df, good, keep=0.5).collect()
    raw = [r[1] for r in rows]
    target = [r[1] for r in rows if r[0] in (1, 2, 3)]
    noise = {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", F.xxhash64(F.lit(quality.SEED + 1), "doc_id", "text")).collect()}
    keys = {}
    for i, t, _, _ in rows:
        u = ((noise[i, t] % 2**64) >> 11) + 0.5
        w = _log_weight(t, target, raw)
        keys[i] = (w, w - math.log(-math.log(u / 2**53)))
    for r in found:
        assert (r["log_weight"], r["sample_key"]) == pytest.approx(keys[r["row_id"]], abs=1e-8)
    picked = [r for r in found if r["selected"]]
    assert len(picked) == round(len(rows) * 0.5)
    assert min(r["sample_key"] for r in picked) >= max((r["sample_key"] for r in found if not r["selected"]))


@pytest.mark.parametrize("n", [1, 30, 49])
def test_quality_draws_no_more_than_asked_on_ties(spark, n):
    df = spark.createDataFrame([(1, "same text")] * 50 + [(2, "%%%%%%%%")] * 5, "doc_id long, text string").repartition(4)
    found = quality.resample(df, df.where("doc_id = 1").select("doc_id"), keep=n / 55)
    assert found.where("selected").count() == n


def test_grams_of_a_text_longer_than_a_slice():
    import pyarrow as pa

    text = "abcd" * (1 << 20) + "xyz" * 700_000
    total = np.zeros(quality.BUCKETS, np.int64)
    for _, _, grams, _ in quality._texts(pa.array([text, None, "abcde"])):
        total += np.bincount(grams, minlength=quality.BUCKETS)
    assert total.sum() == len(text) - 3 + 2


def _toxic_table(spark):
    rng = random.Random(15)
    rows = []
    for i in range(120):
        w = _words(rng, 12).split()
        if i % 4 == 0:
            w.append("vileword")
        if i % 6 == 0:
            w.append("junkmark")
        rows.append((i, " ".join(w), int(i % 4 == 0), 1 - int(i % 6 == 0)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")


def test_chain_scores_against_brute_force(spark):
    from campwatch.llm import _kernels as K

    rows, df = _toxic_table(spark)
    marks = toxicity.label_marks()
    chain = toxicity.fit_chain(toxicity.sample_labelled(df.select("doc_id", "text"), df.select("doc_id", "toxic", "quality"), marks), tuple(marks))
    texts = [r[1] for r in rows] + [None, "", "x", "VILEWORD vilewor junkmark " * 60_000]
    weight = {int(f): w for f, w in zip(chain.features, chain.weights, strict=True)}

    def features(text):
        out = set()
        for word in set((text or "").encode().split()):
            words = K.Words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
            out.add(int(words.hashes()[0]))
            for n in toxicity.PREFIXES:
                out.add(int(words.prefixes(n)[0] ^ np.uint64(n << 50)))
        return out

    got = {r["row_id"]: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()}
    for i, text in enumerate(texts):
        sums = sum((weight[f] for f in features(text) if f in weight), np.zeros(3))
        p = []
        for c, name in enumerate(chain.names):
            x = sums[c] + sum(v * q for v, q in zip(chain.links[c], p, strict=True)) + chain.base[c]
            p.append(1 / (1 + math.exp(-x)))
            assert got[i][name] == pytest.approx(p[-1], abs=1e-9)
    # Later categories read the earlier ones' probabilities.
    assert [len(v) for v in chain.links] == [0, 1, 2]


def test_training_sample_is_bounded_and_does_not_depend_on_row_order(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 5)
    docs = spark.createDataFrame([(1, f"text {i}", "k") for i in range(200)] + [(i, "t", "k") for i in range(2, 9)] + [(None, "n", "k")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, None, 1), (None, 1, 1), *((i, i % 2, 1) for i in range(2, 9))], "doc_id long, toxic int, quality int")
    marks = toxicity.label_marks()
    found = [toxicity.sample_labelled(docs.repartition(n), labels.repartition(n), marks).collect() for n in (1, 7)]
    assert len(found[0]) <= 5 and len({r["row_id"] for r in found[0]}) == len(found[0])
    assert sorted(map(str, found[0])) == sorted(map(str, found[1]))
    monkeypatch.setattr(toxicity, "SAMPLE", 50)
    one = [r for r in toxicity.sample_labelled(docs, labels, marks).collect() if r["row_id"] == 1]
    assert [(r["text"], r["toxic"], r["low_quality"]) for r in one] == [("text 0", 1, 1)]


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    data = []
    for i in range(400):
        w = _words(rng, 40).split()
        if i % 5 == 0:
            w[rng.randrange(40)] = rng.choice(["vilestem", "vilest", "vileness"])
        data.append((i, " ".join(w), int(i % 5 == 0), 1 - int(i % 7 == 0)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int, quality int")
    labels = df.where("doc_id < 250").select("doc_id", "toxic", "quality")
    docs = df.select("doc_id", "text").union(spark.createDataFrame([(900, None), (None, "")], "doc_id long, text string"))
    found = {r["row_id"]: r["toxic"] >= toxicity.CUT for r in toxicity.toxic_probabilities(docs, labels).collect()}
    wrong = sum(found[i] != bool(t) for i, _, t, _ in data[250:])
    assert wrong <= 3 and not found[900] and not found[None]
    kept = toxicity.drop_toxic(docs, docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not v for v in found.values())


def test_empty_tables(spark, none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert near_join.jaccard_components(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.apply_mix(none).count() == 0
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert token_counts.token_prefixes(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert media.audio_columns(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.toxic_probabilities(none, labels).count() == 0
    assert quality.resample(none, labels.select("doc_id")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rendered = chat_format.render(turns)
    assert chat_format.read_back(rendered, chat_format.expand(rendered)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path, rows):
    import corpus_pipeline
    from tokenizers import Tokenizer

    table = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA).withColumn("source", F.lit("s"))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{number}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{number}"))
        assert docs.columns == table.columns
        kept.append([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    given = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert sorted(map(str, kept[0])) == sorted(map(str, given))

    def best(group):
        return min(group, key=lambda r: (-len(r[1] or ""), r[0]))

    groups = {}
    for r in kept[0]:
        groups.setdefault("".join(c for c in r[1] or "" if c not in SPACE), []).append(r)
    assert sorted(map(str, kept[1])) == sorted(str(best(g)) for g in groups.values())
    linked = _linked([t for _, t in kept[1]], 5, 80)
    near = {}
    for r, label in zip(kept[1], linked, strict=True):
        near.setdefault(label, []).append(r)
    assert sorted(map(str, kept[2])) == sorted(str(min(g, key=lambda r: r[0])) for g in near.values())
    # One source shares 150 % of its own size: a whole pass and half of another one.
    sizes = {r: _size(r[1]) for r in kept[2]}
    assert {r for r in sizes if sizes[r]} == set(kept[3]) and max(map(kept[3].count, kept[3])) == 2
    assert abs(sum(sizes[r] for r in kept[3]) - 1.5 * sum(sizes.values())) <= max(sizes.values())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in kept[3])
    assert sum(p["length"] for p in pieces) == want
    assert {p["doc_id"] for p in pieces} == {i for i, _ in kept[3]}
