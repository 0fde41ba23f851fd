"""Report feeds as a data source, balanced JSON, and the bit set of signatures."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from campwatch.functions import model_output
from campwatch.operators import device
from campwatch.sources import feeds, report_feed

LINES = ["payee_account, a@b , scam,12,t1", "phone_number,+1 415,x,-3.5e2,t2", "unknown,a,b,1,c", "# a comment", "", "  ", "script_hash,h,c,5d,t",
         "crypto_wallet,0x1,c,7,", "payee_account,a,b,c", "payee_account,\u00e9,b,.5,\u65e5\u672c", " phone_number,1,2,3,4 ", "payee_account,a,b,1,c,d"]
FIELDS = ["pattern_kind", "pattern_value", "category", "reported_epoch", "device_attestation_token"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(FIELDS).collect())


def _feed(folder, files, rng):
    for name in files:
        own = [rng.choice(LINES) for _ in range(rng.randrange(20, 40))]
        (folder / name).write_bytes(("\r\n" if name == "b" else "\n").join(own).encode() + (b"\n" if name != "c" else b""))


def test_feed_reads_what_the_parser_reads(spark, tmp_path):
    report_feed.register(spark)
    _feed(tmp_path, "abc", random.Random(1))
    want = _rows(feeds.parse_lines(spark.read.text(str(tmp_path))))
    assert want
    for size in (37, 1 << 20):
        got = spark.read.format("report_feed").option("range_bytes", size).load(str(tmp_path))
        assert _rows(got) == want
        assert got.select("file", "line_start").distinct().count() == len(want)
    lines = spark.read.text(str(tmp_path)).where("trim(value) <> '' AND trim(value) NOT LIKE '#%'").count()
    counted = spark.read.format("report_feed").option("counts", "true").option("range_bytes", 400).load(f"file://{tmp_path}")
    assert counted.agg(F.sum("malformed")).first()[0] == lines - len(want)
    (tmp_path / "none").mkdir()
    assert spark.read.format("report_feed").load(str(tmp_path / "none")).collect() == []


def test_feed_streams_whole_lines_once(spark, tmp_path):
    report_feed.register(spark)
    folder = tmp_path / "feed"
    folder.mkdir()
    good = "payee_account,{},s,1,t"

    def run():
        stream = spark.readStream.format("report_feed").option("range_bytes", 60).load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("pattern_value").collect())

    (folder / "a").write_text("\n".join(good.format(i) for i in range(5)) + "\nbad\n" + good.format("half")[:12])
    assert run() == ["0", "1", "2", "3", "4"]
    with (folder / "a").open("a") as out:
        out.write(good.format("half")[12:] + "\n")
    (folder / "b").write_text(good.format("new") + "\n")
    assert run() == ["0", "1", "2", "3", "4", "half", "new"]
    assert run() == ["0", "1", "2", "3", "4", "half", "new"]


def scan(text):
    """Character by character."""
    begin = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if begin < 0:
        return None
    opens = text[begin]
    closes, depth, quoted, escaped = {"[": "]", "{": "}"}[opens], 0, False, False
    for i in range(begin, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == opens:
            depth += 1
        elif c == closes:
            depth -= 1
            if not depth:
                return text[begin : i + 1]
    return None


def test_balanced_values_are_those_of_the_scanner(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('[]{}"\\\\aé ,') for _ in range(rng.randrange(24))) for _ in range(30_000)]
    texts += ["", '{"a": "}"} x', 'no [1, "]\\"]", 2] tail', "[" * 3000 + "]" * 3000, '\\"[1]', "[" + '"x" ' * 3000 + "]"]
    data = pa.array(texts).cast(pa.large_string())
    raw, offs = np.frombuffer(data.buffers()[2], np.uint8), np.frombuffer(data.buffers()[1], np.int64)[: len(texts) + 1]
    begin, end = model_output.balanced(raw, offs)
    whole = raw.tobytes()
    assert [whole[b:e].decode() if e >= 0 else None for b, e in zip(begin, end, strict=True)] == [scan(t) for t in texts]
    few = texts[:500] + texts[-6:] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(few)], "i long, t string")
    got = {r[0]: r[1] for r in df.select("i", model_output.extract_json(F.col("t"))).collect()}
    assert got == {i: scan(t or "") for i, t in enumerate(few)}


def test_bit_set_of_signatures(spark):
    known = spark.range(0, 300).selectExpr("concat('s', id) AS s")
    words = device.bloom(known, "s").first()[0]
    held = set()
    for i in range(300):
        held |= set(known.where(f"s = 's{i}'").select(device.bits(F.col("s"))).first()[0]) if i < 5 else set()
    assert len(words) == device.BITS // 64 and all(words[b >> 6] >> (b & 63) & 1 for b in held)
    every = set(b for r in known.select(device.bits(F.col("s"))).collect() for b in r[0])
    assert {w * 64 + b for w, x in enumerate(words) for b in range(64) if x >> b & 1} == every
    apps = spark.createDataFrame([("s1",), ("s299",), ("other",), (None,)], "a string")
    got = {r["a"]: (r["bloom_hit"], r["match"]) for r in device.check_signatures(apps, "a", known, "s").collect()}
    assert got["s1"] == got["s299"] == (True, "confirmed") and got["other"] == (False, None)
    assert device.check_signatures(apps, "a", known.limit(0), "s").where("bloom_hit").count() == 0
