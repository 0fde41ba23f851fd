"""Golden messages: tier, surfaced flags and confidences."""

import pytest
from pyspark.sql import functions as F

from campwatch.functions import text as X
from campwatch.operators import cascade, conversation, grounding

GOLDEN = [
    ("hey how are you doing today", 0, {}),
    ("this is urgent, act now, do not tell your bank", 1,
     {"urgency_injection": 0.4433, "isolation_instruction": 0.44}),
    ("send the money now, only accept gift card, do not tell your bank, this is the irs", 2,
     {"isolation_instruction": 0.54, "authority_impersonation": 0.62, "payment_channel_funneling": 0.576}),
    ("take your time, no rush at all, whenever you can get to it", 0, {}),
    ("i would never ask you to buy a gift card", 1, {}),
    ("what if someone asked me to wire money?", 0, {}),
    ("Please wire the money.", 1, {"payment_channel_funneling": 0.44}),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "id long, text string")
    return cascade.scan(df)


def test_golden_messages(scored):
    rows = grounding.gate(grounding.entail(cascade.refine(scored))).orderBy("id").collect()
    for row, (text, tier, flags) in zip(rows, GOLDEN, strict=True):
        assert row["tier"] == tier, text
        found = {r["tactic"]: r["confidence"] for r in row["results"] if r["verdict"] == "surfaced"}
        assert found == pytest.approx(flags), text


def test_flat_rows_agree_with_nested_gate(scored):
    nested = grounding.gate(grounding.entail(cascade.refine(scored)))
    one = {(r["id"], x["tactic"], x["confidence"], x["verdict"]) for r in nested.collect() for x in r["results"]}
    flat = grounding.flags(cascade.candidate_rows(scored, ["id"]), ["id"]).collect()
    assert one == {(r["id"], r["tactic"], r["confidence"], r["verdict"]) for r in flat}


def test_normalize_folds_lookalikes_and_space(spark):
    df = spark.createDataFrame([("ｗire​  mоney\n",), (None,), ("plain",)], "t string")
    assert [r[0] for r in df.select(X.normalize(F.col("t"))).collect()] == ["wire money", None, "plain"]


def test_script_hash_and_phones(spark):
    df = spark.createDataFrame([("  Send ME the   money now ", "Call +1 415-555-0142 or (415) 555-0142")], "a string, b string")
    row = df.select(X.script_hash(F.col("a")), X.phones(F.col("b"))).first()
    assert row[0] == "f7778be910dacf160fde9f3e6cfd904e"
    assert row[1] == ["14155550142", "4155550142"]


def test_burst_joins_short_rapid_messages(spark):
    raw = [(1, 1, "s", "send", 1000), (1, 2, "s", "me", 1500), (1, 3, "s", "the", 1900), (1, 4, "s", "money now", 2300), (1, 5, "v", "ok", 9000)]
    df = spark.createDataFrame(raw, "c long, n long, sender string, text string, ms long")
    out = conversation.reassemble(df, "c", "sender", "ms", "text", ["n"]).orderBy("turn").collect()
    assert [(r["text"], r["n_messages"]) for r in out] == [("send me the money now", 4), ("ok", 1)]
