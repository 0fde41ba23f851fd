"""Queries over conversations: cue scan, cascade, gates, sessions, and their SQL.

The synthetic turns hold almost no cues, so queries append one of a fixed list
of phrases to each turn, chosen by its number; the SQL does the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.functions import taxonomy as T
from campwatch.functions import evidence, model_output, prompts
from campwatch.functions import text as X
from campwatch.operators import cascade, conversation, evaluation, grounding, voice
from campwatch.sources import fixtures
from campwatch.streaming import folds

PHRASES = (
    "see you at the usual place",
    "this is urgent, act now, do not tell your bank",
    "send the money now, only accept gift card, do not tell your bank, this is the irs",
    "take your time, no rush at all, whenever you can get to it",
    "please wire the money.",
    "i would never ask you to buy a gift card",
    "what if someone asked me to wire money?",
    "send gift cards now and do not tell your bank",
    "your account has been suspended, verify your identity, read me the code",
    "microsoft security team here, install anydesk immediately",
    "urgent: no rush, don't worry",
    "act now, it is urgent, no hurry",
    "congratulations you've won, guaranteed profit, pay the processing fee",
    "we will file a case, you will be arrested, pay or i will post",
    "security alert: unusual activity on your bank account",
    "enter your upi pin to receive, scan the qr right now",
    "work from home, earn daily, no experience needed",
    "i refuse to send the code to anyone",
    "suppose i double your money",
    "your parcel is held, kyc expired, update your kyc",
    "bitcoin only, wire transfer, western union, last chance",
    "i am calling from the fraud department, keep this between us",
    "lunch at noon works for me",
    "act fast before it's too late, immediately, final notice",
)


KEYS = ["conv_id", "turn"]


def spread(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """Rows dealt out evenly, ``rows`` to a task, and to all cores at least.

    The number of splits of a scan says little: a file of one row group is one
    task, however many splits it has. A count reads the files' footers only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, math.ceil(df.count() / rows)))


def turns(spark: SparkSession, sf_dir: str, inject: bool = True) -> DataFrame:
    df = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    if not inject:
        return df
    which = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(len(PHRASES))) + 1
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), which.cast("int"))
    return df.withColumn("text", F.concat("text", F.lit(" "), phrase))


def routed(spark: SparkSession, sf_dir: str, inject: bool = True) -> DataFrame:
    return cascade.refine(cascade.scan(turns(spark, sf_dir, inject)))


def gated(spark: SparkSession, sf_dir: str, inject: bool = True) -> DataFrame:
    return grounding.gate(grounding.entail(routed(spark, sf_dir, inject)))


def server_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cascade.candidate_rows(cascade.scan(turns(spark, sf_dir)), KEYS)
    return grounding.flags(rows, KEYS)


def _surfaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaced flags. A filter by the verdict would be pushed below the gate, and spell the gate out for its every use."""
    flag = F.struct("tactic", "confidence", "verdict", "reason", "evidence")
    return server_flags(spark, sf_dir).select(*KEYS, F.inline_outer(F.array(flag))).where("verdict = 'surfaced'")


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cascade.refine(cascade.scan(turns(spark, sf_dir), variant="edge"), variant="edge")
    return grounding.gate_edge(scored)


def _hit_rows(scanned: DataFrame) -> DataFrame:
    """One row a hit. ``inline`` would filter by its array first, below the scan, and so scan twice, in the tasks of the file."""
    return scanned.select("conv_id", "turn", F.inline_outer("hits")).where("tactic IS NOT NULL")


def cue_scan(spark, sf_dir):
    hits = _hit_rows(cascade.scan(turns(spark, sf_dir)))
    return hits.select("conv_id", "turn", "tactic", F.size("spans").cast("long").alias("n"), F.array_join("spans", "|").alias("spans"))


def _hit_counts(spark, sf_dir, strategy):
    found = _hit_rows(cascade.scan(turns(spark, sf_dir), strategy=strategy))
    return found.groupBy("tactic").agg(F.count("*").alias("turns"), F.sum(F.size("spans")).alias("hits"))


def cue_scan_prescreen(spark, sf_dir):
    """The same scan behind one union pattern, for corpora that rarely match."""
    return _hit_counts(spark, sf_dir, "prescreen")


def cue_scan_automaton(spark, sf_dir):
    """The same scan by a multi-pattern automaton."""
    return _hit_counts(spark, sf_dir, "automaton")


def tier0_scores(spark, sf_dir):
    return cascade.scan(turns(spark, sf_dir)).select("conv_id", "turn", F.round("tier0", 6).alias("tier0"))


def cascade_route(spark, sf_dir):
    scored = cascade.refine(cascade.scan(turns(spark, sf_dir)))
    return scored.select(
        "conv_id", "turn", F.col("tier").cast("long").alias("tier"),
        F.size("candidates").cast("long").alias("n_candidates"),
        F.round(F.coalesce(F.array_max(F.transform("candidates", lambda c: c["base"])), F.lit(0.0)), 6).alias("top"),
    )


def gate_flags(spark, sf_dir):
    return server_flags(spark, sf_dir).select(
        "conv_id", "turn", "tactic", "confidence", "verdict", "reason"
    )


def gate_verdict_counts(spark, sf_dir):
    return gate_flags(spark, sf_dir).groupBy("tactic", "verdict").agg(F.count("*").alias("n"))


def any_surfaced_by_conv(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("conv_id").agg(
        F.bool_or("surfaced").alias("any_surfaced"), F.count_if("surfaced").alias("n_surfaced")
    )


def benign_path(spark, sf_dir):
    return gated(spark, sf_dir, inject=False).groupBy("tier").agg(
        F.count("*").alias("n"), F.count_if("surfaced").alias("surfaced")
    ).withColumn("tier", F.col("tier").cast("long"))


def cascade_edge_variant(spark, sf_dir):
    rows = cascade.candidate_rows(cascade.scan(turns(spark, sf_dir), variant="edge"), KEYS, "edge")
    return grounding.edge_flags(rows, KEYS).select(
        "conv_id", "turn", "tactic", F.round("confidence", 3).alias("confidence")
    )


def edge_server_disagreement(spark, sf_dir):
    server = gated(spark, sf_dir).select("conv_id", "turn", F.col("surfaced").alias("server"))
    local = edge(spark, sf_dir).select("conv_id", "turn", F.col("surfaced").alias("edge"))
    return server.join(local, ["conv_id", "turn"]).groupBy("server", "edge").agg(F.count("*").alias("n"))


def session_compounding(spark, sf_dir):
    found = cascade.session(cascade.scan(turns(spark, sf_dir)))
    return found.select(
        "conv_id", "turn", F.array_join("prior", ",").alias("prior"), F.inline("candidates")
    ).select("conv_id", "turn", "prior", "tactic", F.round("base", 6).alias("base"))


def sliding_window_12(spark, sf_dir):
    return conversation.ring(turns(spark, sf_dir), "conv_id", ["turn"]).groupBy("conv_id").agg(
        F.count("*").alias("kept"), F.min("turn").alias("oldest"), F.max("turn").alias("newest")
    )


def turn_index(spark, sf_dir):
    return conversation.numbered(turns(spark, sf_dir), "conv_id", ["turn"]).select(
        "conv_id", "turn", F.col("turn_index").cast("long").alias("turn_index")
    )


def conversation_summary(spark, sf_dir):
    kept = _surfaced(spark, sf_dir)
    flags = F.transform("flags", lambda f: F.concat_ws(":", f["turn"].cast("string"), f["tactic"]))
    return conversation.summary(kept).select("conv_id", F.array_join(flags, ",").alias("flags"))


def voice_compound(spark, sf_dir):
    scored = cascade.refine(cascade.scan(turns(spark, sf_dir)))
    spoof = F.pmod(F.col("conv_id") * 31 + F.col("turn") * 17, F.lit(100)) / F.lit(100.0)
    content = F.array_max(F.transform("candidates", lambda c: c["base"]))
    score, kind = voice.compound(spoof, content)
    return scored.select("conv_id", "turn", score.alias("compound_confidence"), kind.alias("kind"))


def model_blend(spark, sf_dir):
    """A model's side table re-weights candidates; turns and tactics it lacks keep theirs."""
    scored = cascade.refine(cascade.scan(turns(spark, sf_dir)))
    given = scored.where("turn % 2 = 0").select("conv_id", "turn").crossJoin(
        spark.createDataFrame([(T.PAYMENT, 0.9), (T.URGENCY, 0.1)], "tactic string, confidence double")
    )
    mixed = cascade.blend(scored, given, ["conv_id", "turn"])
    return mixed.select("conv_id", "turn", F.inline("candidates")).select(
        "conv_id", "turn", "tactic", F.round("base", 6).alias("base")
    )


def sms_junk(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", X.sms_junk(F.col("text")).alias("junk"))


def _replies(spark, sf_dir) -> DataFrame:
    rows = gated(spark, sf_dir)
    names = F.transform(F.filter("results", lambda r: r["verdict"] == "surfaced"), lambda r: r["tactic"])
    return rows.select(*KEYS, "surfaced", names.alias("tactics"))


def sms_reply(spark, sf_dir):
    return _replies(spark, sf_dir).select(*KEYS, X.sms_reply(F.col("tactics"), F.lit(False)).alias("reply"))


def sms_channel(spark, sf_dir):
    """The whole message channel: rate limit by sender, cascade, reply with the template note."""
    arrived = turns(spark, sf_dir).select("conv_id", "turn", (F.col("turn") * 11.0 + F.col("conv_id") % 5).alias("ts"))
    allowed = folds.run_batch(arrived, folds.TOKEN_BUCKET, "conv_id", ["turn"])
    deviates = X.template_signal(F.col("conv_id") % 3 == 0, F.col("turn") % 2 == 0)
    rows = allowed.join(_replies(spark, sf_dir), KEYS)
    reply = F.when(F.col("allowed"), X.sms_reply(F.col("tactics"), deviates)).otherwise("")
    return rows.select(*KEYS, F.col("allowed").alias("accepted"), reply.alias("reply"))


def eval_confusion(spark, sf_dir):
    truth = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(len(PHRASES))).isin(*SCAMS)
    found = evaluation.confusion(gated(spark, sf_dir), truth, F.col("surfaced"))
    return found.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def eval_by_slice(spark, sf_dir):
    truth = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(len(PHRASES))).isin(*SCAMS)
    found = evaluation.confusion(gated(spark, sf_dir), truth, F.col("surfaced"), ["role"])
    return found.select("role", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def equity_regressions(spark, sf_dir):
    """Slices in which the edge gate without corroboration recalls less than the server gate."""
    truth = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(len(PHRASES))).isin(*SCAMS)
    base = evaluation.confusion(gated(spark, sf_dir), truth, F.col("surfaced"), ["role"])
    strict = gated(spark, sf_dir).withColumn(
        "surfaced", F.exists("results", lambda r: (r["verdict"] == "surfaced") & (r["confidence"] >= 0.6))
    )
    worse = evaluation.confusion(strict, truth, F.col("surfaced"), ["role"])
    return evaluation.regressions(base, worse, "role").select("role", F.round("regression", 6).alias("regression"))


def flag_explanations(spark, sf_dir):
    kept = _surfaced(spark, sf_dir)
    return kept.select(*KEYS, "tactic", evidence.explain_flag(F.col("tactic"), F.col("evidence")).alias("why"), evidence.tip(F.col("tactic")).alias("tip"))


def citations_rendered(spark, sf_dir):
    rows = cascade.scan(turns(spark, sf_dir)).select(*KEYS, F.flatten(F.transform("hits", lambda h: h["spans"])).alias("spans"))
    cited = F.transform("spans", lambda s: evidence.cite_span(s, F.col("turn")))
    return rows.select(*KEYS, evidence.render(cited).alias("lines"))


def prompt_fit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fitted = X.fit_prompt(F.col("text"))
    return docs.select("doc_id", F.length(fitted).cast("long").alias("chars"), F.md5(fitted).alias("md5"))


def _reply() -> Column:
    """Replies in three shapes, with noise around them."""
    one = F.concat(F.lit('{"tactic_id": "urgency_injection", "confidence": '), (F.col("turn") / 2).cast("string"), F.lit(', "rationale": " rush "}'))
    return (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure! ["), one, F.lit(', {"tactic_id": "unknown", "confidence": 1}] done')))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit('{"results": ['), one, F.lit("]}")))
        .otherwise(F.concat(F.lit("so: "), one))
    )


def model_replies(spark, sf_dir):
    """Assessments read from replies in three shapes, with noise around them."""
    rows = turns(spark, sf_dir).select(*KEYS, model_output.extract_json(_reply()).alias("j"))
    return rows.select(*KEYS, model_output.assessments(F.col("j")).alias("a")).select(*KEYS, F.inline("a"))


def model_refinements(spark, sf_dir):
    """The stricter reader takes lists and wrapped lists, and cuts long rationales."""
    long = F.replace(_reply(), F.lit(" rush "), F.lit("r" * 250))
    rows = turns(spark, sf_dir).select(*KEYS, model_output.extract_json(long).alias("j"))
    rows = rows.select(*KEYS, model_output.refinements(F.col("j")).alias("a"))
    return rows.select(*KEYS, F.size("a").cast("long").alias("n"), F.length(F.col("a")[0]["rationale"]).cast("long").alias("chars"))


def model_chain(spark, sf_dir):
    """Parsed replies re-weight candidates; tactics without a reply keep their base."""
    scored = cascade.refine(cascade.scan(turns(spark, sf_dir)))
    read = turns(spark, sf_dir).select(*KEYS, model_output.extract_json(_reply()).alias("j"))
    read = read.select(*KEYS, model_output.assessments(F.col("j")).alias("a"))
    mixed = cascade.blend(scored, read.select(*KEYS, F.inline("a")), KEYS)
    return mixed.select(*KEYS, F.inline("candidates")).select(*KEYS, "tactic", F.round("base", 6).alias("base"))


def classifier_blend(spark, sf_dir):
    """A classifier's joint confidences; tactics it does not know count as 0 where it scored."""
    scored = cascade.refine(cascade.scan(turns(spark, sf_dir)))
    logits = F.array(F.lit(0.0), (F.col("turn") % 4).cast("double"))
    known = F.array(*[(F.col("conv_id") % (i + 2)).cast("double") for i in range(len(CLASSES))])
    joint = model_output.joint_confidence(logits, F.when(F.col("turn") % 2 == 0, known), CLASSES)
    given = turns(spark, sf_dir).select(*KEYS, F.inline(joint))
    mixed = cascade.blend(scored, given, KEYS, missing_is_zero=True)
    return mixed.select(*KEYS, F.inline("candidates")).select(*KEYS, "tactic", F.round("base", 6).alias("base"))


def grounding_prompts(spark, sf_dir):
    """Prompts for the tactics that a turn's scan found."""
    rows = cascade.candidate_rows(cascade.scan(turns(spark, sf_dir)), KEYS)
    rank = F.array_position(F.array(*map(F.lit, T.TACTICS)), F.col("tactic"))
    found = rows.groupBy(*KEYS, "norm").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "tactic"))).alias("t"))
    asked = found.withColumn("prompt", prompts.grounding_prompt(F.col("norm"), F.col("t.tactic")))
    line = F.regexp_extract("prompt", "(?m)^" + prompts.TO_ASSESS + "(.*)$", 1)
    read = asked.select(*KEYS, "norm", "prompt", line.alias("tactics"))
    return read.select(*KEYS, "tactics", (F.length("prompt") - F.length("norm") - F.length("tactics")).cast("long").alias("frame_chars"))


def _surfaced_array(spark, sf_dir) -> DataFrame:
    """Surfaced flags by turn, with a model's rationale for one tactic."""
    kept = _surfaced(spark, sf_dir)
    rationale = F.when(F.col("tactic") == T.URGENCY, "rush")
    flag = F.struct("confidence", "tactic", "evidence", rationale.alias("rationale"))
    return kept.groupBy(*KEYS).agg(F.collect_list(flag).alias("flags"))


def explanations(spark, sf_dir):
    """Every turn's explanation: flags by confidence, a model's reason where there is one."""
    rows = turns(spark, sf_dir).select(*KEYS).join(_surfaced_array(spark, sf_dir), KEYS, "left")
    return rows.select(*KEYS, evidence.explanation(F.col("flags")).alias("explanation"))


def check_results(spark, sf_dir):
    """What a client is shown of every turn."""
    rows = gated(spark, sf_dir)
    kept = F.transform(
        F.filter("results", lambda r: r["verdict"] == "surfaced"),
        lambda r: F.struct(r["tactic"].alias("tactic"), r["confidence"].alias("confidence"), r["spans"].alias("spans"), F.lit(None).cast("string").alias("rationale")),
    )
    shown = rows.select(*KEYS, evidence.check_result(kept, F.col("tier")).alias("r"))
    quoted = F.array_join(F.transform("r.evidence", lambda e: e["quoted_text"]), "; ")
    return shown.select(*KEYS, "r.kind", "r.finding", quoted.alias("quoted"), F.size("r.evidence").cast("long").alias("n"))


def long_requests(spark, sf_dir):
    """Documents that are within the caps of the two request kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.agg(
        F.count_if(X.within_caps(F.col("text"))).alias("analyse"), F.count_if(X.within_caps(F.col("text"), 4000)).alias("explain")
    )


def summary_examples(spark, sf_dir):
    """Training examples from the structured summaries of conversations."""
    flags = cascade.candidate_rows(cascade.scan(turns(spark, sf_dir)), KEYS).select(
        "conv_id", "turn", "tactic", F.col("base").alias("confidence"), conversation.cited(F.col("spans"), F.col("norm")).alias("evidence")
    )
    entities = turns(spark, sf_dir).groupBy("conv_id", "role").agg(F.count("*").alias("weight"), F.max("turn").alias("turn"))
    entities = entities.select("conv_id", F.lit("role").alias("kind"), F.col("role").alias("value"), "weight", (F.col("turn") * 86_400.0).alias("last_seen"))
    summaries = conversation.structured_summary(flags, entities, F.lit(30 * 86_400.0))
    return conversation.training_examples(summaries).groupBy("tactic_label").agg(
        F.count("*").alias("n"), F.countDistinct("normalized_text").alias("texts")
    )


def summary_salience(spark, sf_dir):
    """Present salience of each conversation's entities."""
    entities = turns(spark, sf_dir).groupBy("conv_id", "role").agg(F.count("*").alias("weight"), F.max("turn").alias("turn"))
    entities = entities.select("conv_id", F.lit("role").alias("kind"), F.col("role").alias("value"), "weight", (F.col("turn") * 86_400.0).alias("last_seen"))
    flags = server_flags(spark, sf_dir)
    out = conversation.structured_summary(flags, entities, F.lit(30 * 86_400.0))
    return out.select("conv_id", F.explode("entities").alias("e")).select("conv_id", "e.value", F.round("e.salience", 3).alias("salience"))


def _judged(df: DataFrame) -> DataFrame:
    return grounding.gate(grounding.entail(cascade.refine(cascade.scan(df))))


_FIGURES = ("precision", "recall", "f1")


def _figures(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in _FIGURES])


def _heard(spark, sf_dir) -> DataFrame:
    """Customers as recipients: each hears one of the labelled messages, which are a dozen fixed rows."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("person"))
    said = fixtures.corpus(spark, evasion=True)
    return people.join(F.broadcast(said), F.pmod("person", F.lit(len(fixtures.CORPUS))) == F.col("id")).drop("id").withColumnRenamed("person", "id")


def eval_corpus(spark, sf_dir):
    """The labelled messages, without and with the one that only its history gives away."""
    every = _judged(_heard(spark, sf_dir)).withColumn("evasion", F.contains("note", F.lit(fixtures.EVASION)))
    both = every.where("NOT evasion").withColumn("rows", F.lit("plain")).union(every.withColumn("rows", F.lit("all")))
    return _figures(evaluation.confusion(both, F.col("is_manipulation"), F.col("surfaced"), ["rows"]), "rows")


def eval_by_age_and_language(spark, sf_dir):
    """Both slicings of the labelled messages in one pass."""
    rows = _judged(_heard(spark, sf_dir).where(~F.contains("note", F.lit(fixtures.EVASION))))
    found = evaluation.confusion_by_each(rows, F.col("is_manipulation"), F.col("surfaced"), ["age_bracket", "language"])
    return _figures(found, "slice", "value")


def eval_labels_by_lang(spark, sf_dir):
    """Surfaced documents against their toxicity labels, by language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    # The last tactic's cues stand in for a detector that finds something in this corpus.
    rows = _judged(docs.join(labels, "doc_id"))
    hit = F.col("surfaced") | (F.size("hits") > 0)
    return _figures(evaluation.confusion(rows, F.col("toxic") == 1, hit, ["lang"]), "lang")


def sms_junk_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", X.sms_junk(F.col("text")).alias("junk"))


#: Tactics that a classifier knows, in the order of its logits.
CLASSES = ("urgency_injection", "isolation_instruction", "authority_impersonation", "payment_channel_funneling", "too_good_to_be_true", "none")
#: Phrases that are meant as scams.
SCAMS = (1, 2, 4, 7, 8, 9, 12, 13, 15, 20, 21, 23)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_flags(spark, sf_dir)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PLAIN = "trim(regexp_replace({}, '\\s+', ' ', 'g')) AS norm"


def _base_sql(edge: bool = False, source: str | None = None) -> str:
    """Turns, cues, hits and scores as common table expressions.

    ``source`` gives turns (conv_id, turn, role, norm) other than those with phrases.
    """
    cues, n = [], 0
    for order, t in enumerate(T.TACTICS):
        for c in T.cues(t, edge):
            cues.append(f"({n}, '{t}', {order}, {_quoted(c)}, {T.weight(c)!r}::DOUBLE)")
            n += 1
    phrases = ", ".join(f"({i}, {_quoted(p)})" for i, p in enumerate(PHRASES))
    negs = " OR ".join(f"contains(w, {_quoted(x)})" for x in T.NEGATIONS)
    least = 2 if edge else 3
    counted = f"FILTER (tactic <> '{T.CALMING}')" if edge else ""
    source = source or (
        f"SELECT conv_id, turn, role, {_PLAIN.format("text || ' ' || p")} "
        f"FROM conversations JOIN phrases ON i = (conv_id * 7 + turn * 3) % {len(PHRASES)}"
    )
    return f"""
phrases(i, p) AS (VALUES {phrases}),
cues(ord, tactic, tord, cue, weight) AS (VALUES {", ".join(cues)}),
turns AS ({source}),
low AS (SELECT *, lower(norm) AS lowered FROM turns),
hits AS (SELECT * FROM low JOIN cues ON contains(lowered, cue)),
tac AS (SELECT conv_id, turn, tactic, tord, count(*) AS n, least(1.0::DOUBLE, 0.22::DOUBLE * count(*)) AS raw,
               max(weight) AS spec, list(cue ORDER BY ord) AS spans FROM hits GROUP BY ALL),
t0 AS (SELECT l.conv_id, l.turn, l.role, l.norm, l.lowered,
              least(1.0::DOUBLE, 0.18::DOUBLE * count(tactic) {counted} + 0.05::DOUBLE * coalesce(sum(n) {counted}, 0)) AS tier0,
              count(tactic) FILTER (tactic <> '{T.CALMING}') AS scored,
              coalesce(max(raw) FILTER (tactic = '{T.CALMING}'), 0.0::DOUBLE) AS calm
       FROM low l LEFT JOIN tac USING (conv_id, turn) GROUP BY ALL),
boosted AS (SELECT conv_id, turn, tactic, tord, spans, spec, raw, calm, scored, tier0, norm, lowered,
            least(1.0::DOUBLE, raw + CASE WHEN scored < {least} THEN 0.0::DOUBLE WHEN tactic = '{T.PAYMENT}' THEN 0.20::DOUBLE ELSE 0.10::DOUBLE END) AS base
       FROM tac JOIN t0 USING (conv_id, turn) WHERE tactic <> '{T.CALMING}' AND tier0 >= 0.28::DOUBLE),
cand AS (SELECT * FROM boosted WHERE NOT (tactic = '{T.URGENCY}' AND calm >= base * 0.7::DOUBLE)),
word AS (SELECT conv_id, turn, list_filter(string_split(lowered, ' '), lambda x: x <> '') AS ws FROM low),
judged AS (SELECT c.*, (norm LIKE '%?' OR lowered LIKE 'what if%' OR lowered LIKE 'suppose%' OR lowered LIKE 'imagine if%') AS hyp,
       len(list_filter(range(2, len(ws) + 1), lambda i:
           len(list_filter(spans, lambda s: starts_with(ws[i], left(string_split(s, ' ')[1], 4)))) > 0
           AND len(list_filter([array_to_string(ws[greatest(1, i - 6):i - 1], ' ')], lambda w: {negs})) > 0)) > 0 AS neg,
       least(0.30::DOUBLE, 0.15::DOUBLE * greatest(0, count(*) OVER (PARTITION BY conv_id, turn) - 1)) AS lift
     FROM cand c JOIN word USING (conv_id, turn))"""


def _server_sql(source: str | None = None) -> str:
    return f"""{_base_sql(source=source)},
own AS (SELECT *, round(least(1.0::DOUBLE, base * spec * CASE WHEN hyp THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END
        * CASE WHEN neg THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END), 4) AS own FROM judged),
final AS (SELECT *, lift > 0 AND own < 0.35::DOUBLE AS lifted,
        CASE WHEN lift > 0 AND own < 0.35::DOUBLE THEN round(least(1.0::DOUBLE, own + lift), 4) ELSE own END AS confidence FROM own),
flags AS (SELECT *, CASE WHEN confidence < 0.35::DOUBLE THEN 'abstained_entailment_failed'
        WHEN confidence < 0.4::DOUBLE THEN 'abstained_low_confidence' ELSE 'surfaced' END AS verdict,
        CASE WHEN confidence >= 0.35::DOUBLE THEN CASE WHEN lifted THEN 'corroborated' ELSE 'entailed' END
        WHEN neg THEN 'negated' WHEN hyp THEN 'hypothetical' ELSE 'fragmentary' END AS reason FROM final),
surf AS (SELECT t.conv_id, t.turn, t.role, count(*) FILTER (verdict = 'surfaced') > 0 AS surfaced,
        count(*) FILTER (verdict = 'surfaced' AND confidence >= 0.6::DOUBLE) > 0 AS strict
        FROM turns t LEFT JOIN flags USING (conv_id, turn) GROUP BY ALL)"""


def _edge_sql() -> str:
    return f"""{_base_sql(True)},
eown AS (SELECT *, least(1.0::DOUBLE, base * spec * CASE WHEN hyp THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END
        * CASE WHEN neg THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END) AS own FROM judged),
eflags AS (SELECT *, CASE WHEN lift > 0 AND own < 0.35::DOUBLE THEN least(1.0::DOUBLE, own + lift) ELSE own END AS confidence FROM eown),
esurf AS (SELECT t.conv_id, t.turn, count(*) FILTER (confidence >= 0.35::DOUBLE) > 0 AS surfaced
        FROM turns t LEFT JOIN eflags USING (conv_id, turn) GROUP BY ALL)"""


_TRUTH = f"((s.conv_id * 7 + s.turn * 3) % {len(PHRASES)} IN ({', '.join(map(str, SCAMS))}))"
_COUNTS = """count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp,
  count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn"""
_RATIOS = """round(pr, 6) AS precision, round(re, 6) AS recall,
  round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1"""
_PR = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re"""


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in table.items())


def _session_sql() -> str:
    """Candidates with earlier turns' flags: membership first, then scores."""
    past = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    gone = f"tactic = '{T.URGENCY}' AND calm >= least(1.0::DOUBLE, raw + {{}}) * 0.7::DOUBLE"
    seen = "CASE WHEN before THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + 0.0::DOUBLE + boost"
    full = (
        "CASE WHEN list_contains(prior, tactic) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"
        f" + CASE WHEN tactic = '{T.PAYMENT}' AND len(prior) > 0 THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END + boost"
    )
    return f"""{_base_sql()},
b0 AS (SELECT conv_id, turn, tactic, raw, calm, CASE WHEN scored < 3 THEN 0.0::DOUBLE WHEN tactic = '{T.PAYMENT}' THEN 0.20::DOUBLE ELSE 0.10::DOUBLE END AS boost
       FROM tac JOIN t0 USING (conv_id, turn) WHERE tactic <> '{T.CALMING}' AND tier0 >= 0.28::DOUBLE),
u1 AS (SELECT t.conv_id, t.turn, coalesce(bool_or(tactic = '{T.URGENCY}' AND NOT ({gone.format('boost')})), false) AS urgent
       FROM (SELECT conv_id, turn FROM t0) t LEFT JOIN b0 USING (conv_id, turn) GROUP BY 1, 2),
u2 AS (SELECT conv_id, turn, coalesce(bool_or(urgent) {past}, false) AS before FROM u1),
f2 AS (SELECT u2.conv_id, u2.turn, coalesce(list(tactic) FILTER (tactic IS NOT NULL AND NOT ({gone.format('(' + seen + ')')})), []) AS flagged
       FROM u2 LEFT JOIN b0 USING (conv_id, turn) GROUP BY 1, 2),
pr AS (SELECT conv_id, turn, list_sort(list_distinct(flatten(coalesce(list(flagged) {past}, [])))) AS prior FROM f2),
fin AS (SELECT conv_id, turn, prior, tactic, calm, least(1.0::DOUBLE, raw + ({full})) AS base FROM b0 JOIN pr USING (conv_id, turn))
SELECT conv_id, turn, array_to_string(prior, ',') AS prior, tactic, round(base, 6) AS base FROM fin
WHERE NOT (tactic = '{T.URGENCY}' AND calm >= base * 0.7::DOUBLE)"""


def _oracles() -> dict[str, str]:
    base, server = "WITH " + _base_sql(), "WITH " + _server_sql()
    corpus = ", ".join(
        f"({i}, {_quoted(t)}, {y}, {_quoted(a)}, {_quoted(g)}, {_quoted(n)})" for i, (t, y, a, g, n) in enumerate(fixtures.CORPUS)
    )
    heard = f"customer JOIN (VALUES {corpus}) c(id, text, y, age, language, note) ON c_custkey % {len(fixtures.CORPUS)} = id"
    of_corpus = f"SELECT c_custkey AS conv_id, 0 AS turn, '' AS role, {_PLAIN.format('text')} FROM {heard}"
    labelled = f"{heard} JOIN surf ON conv_id = c_custkey"
    of_docs = f"SELECT doc_id AS conv_id, 0 AS turn, lang AS role, {_PLAIN.format('text')} FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL"
    plain = f"SELECT conv_id, turn, role, {_PLAIN.format('text')} FROM conversations"
    strong_docs = " OR ".join(f"contains(lower(text), {_quoted(c)})" for c in X.JUNK_STRONG)
    moderate_docs = " + ".join(f"contains(lower(text), {_quoted(c)})::INT" for c in X.JUNK_MODERATE)
    surfaced = "why AS (SELECT f.*, label, w.why AS reason_text, tip FROM flags f JOIN labels_of USING (tactic) JOIN whys w USING (tactic) JOIN tips USING (tactic) WHERE verdict = 'surfaced')"
    words = f"labels_of(tactic, label) AS (VALUES {_values(T.LABELS)}), whys(tactic, why) AS (VALUES {_values(evidence.WHY)}), tips(tactic, tip) AS (VALUES {_values(evidence.TIPS)})"
    in_order = "list_filter(spans, lambda c, i: list_position(spans, c) = i)"
    quoted = f"array_to_string(list_transform({in_order}, lambda c: '\"' || c || '\"'), ', ')"
    joint = ", ".join(f"{_quoted(c)}" for c in CLASSES)
    reply = "No strong scam pattern detected -- but if you''re unsure, don''t send money or personal info. Reply STOP to opt out."
    strong = " OR ".join(f"contains(lowered, {_quoted(c)})" for c in X.JUNK_STRONG)
    moderate = " + ".join(f"contains(lowered, {_quoted(c)})::INT" for c in X.JUNK_MODERATE)
    more = {
        "session_compounding": f"WITH {_session_sql()}",
        "benign_path": f"""WITH {_server_sql(plain)}, tiers AS (SELECT t0.conv_id, t0.turn,
            CASE WHEN t0.tier0 < 0.28::DOUBLE OR t0.scored = 0 THEN 0 WHEN coalesce(max(base), 0) < 0.55::DOUBLE THEN 1 ELSE 2 END AS tier
            FROM t0 LEFT JOIN cand USING (conv_id, turn) GROUP BY t0.conv_id, t0.turn, t0.tier0, t0.scored)
            SELECT CAST(tier AS BIGINT) AS tier, count(*) AS n, count(*) FILTER (surfaced) AS surfaced FROM tiers JOIN surf USING (conv_id, turn) GROUP BY 1""",
        "flag_explanations": f"""{server}, {words}, {surfaced}
            SELECT conv_id, turn, tactic, label || ': ' || reason_text || '. Seen: ' || {quoted} || '.' AS why, tip FROM why""",
        "explanations": f"""{server}, {words}, {surfaced},
            x AS (SELECT conv_id, turn, count(*) AS n, arg_min(tip, (-confidence, tactic)) AS tip,
              string_agg('- ' || label || ': ' || CASE WHEN tactic = '{T.URGENCY}' THEN 'rush' ELSE reason_text END || '. Seen: ' || {quoted} || '.', chr(10) ORDER BY confidence DESC, tactic) AS lines FROM why GROUP BY 1, 2)
            SELECT t.conv_id, t.turn, CASE WHEN n IS NULL THEN {_quoted(evidence.NOTHING + " " + evidence.DEFAULT_TIP)} ELSE
              CASE WHEN n = 1 THEN 'This message shows a pattern that scams use:' ELSE 'This message shows ' || n || ' patterns that scams use:' END
              || chr(10) || lines || chr(10) || 'What to do: ' || tip END AS explanation FROM turns t LEFT JOIN x USING (conv_id, turn)""",
        "check_results": f"""{server}, labels_of(tactic, label) AS (VALUES {_values(T.LABELS)}),
            k AS (SELECT f.*, label FROM flags f JOIN labels_of USING (tactic) WHERE verdict = 'surfaced'),
            x AS (SELECT conv_id, turn, count(*) AS n, arg_min(label, tord) AS finding, string_agg(array_to_string(spans, ', '), '; ' ORDER BY tord) AS quoted FROM k GROUP BY 1, 2)
            SELECT t.conv_id, t.turn, CASE WHEN n IS NULL THEN 'no_strong_pattern' ELSE 'flag' END AS kind, finding, coalesce(quoted, '') AS quoted, coalesce(n, 0) AS n
            FROM turns t LEFT JOIN x USING (conv_id, turn)""",
        "grounding_prompts": f"""{base} SELECT conv_id, turn, string_agg(tactic, ', ' ORDER BY tord) AS tactics,
            CAST({len(prompts.BEGIN) + 3 * len(prompts.HEAD + prompts.END_HEAD) + 6 + len("systemuserassistant") + len(prompts.SYSTEM) + 2 * len(prompts.END_TURN) + len("MESSAGE TEXT:") + 3 + len(prompts.TO_ASSESS) + len("Return exactly ") + 2 + len(' objects, one per tactic in that order, as a JSON array and nothing else: [{"tactic_id": "...", "confidence": 0.0, "rationale": "..."}]')} AS BIGINT) AS frame_chars
            FROM cand GROUP BY 1, 2""",
        "model_refinements": """SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN 1 END AS n, CASE WHEN turn % 3 <> 2 THEN 200 END AS chars FROM conversations""",
        "model_chain": f"""{base} SELECT conv_id, turn, tactic, round(CASE WHEN tactic = '{T.URGENCY}'
            THEN least(1.0, 0.5::DOUBLE * base + 0.5::DOUBLE * least(1.0::DOUBLE, turn / 2)) ELSE base END, 6) AS base FROM cand""",
        "classifier_blend": f"""{base}, k AS (SELECT conv_id, turn, exp((turn % 4)::DOUBLE) / (1 + exp((turn % 4)::DOUBLE)) AS scam,
              [{joint}] AS names, list_transform(range(2, {len(CLASSES) + 2}), lambda i: exp((conv_id % i)::DOUBLE)) AS e FROM turns),
            g AS (SELECT c.*, list_position(names, tactic) AS i, scam, e FROM cand c JOIN k USING (conv_id, turn))
            SELECT conv_id, turn, tactic, round(least(1.0, 0.5::DOUBLE * base + 0.5::DOUBLE * coalesce(CASE WHEN i IS NULL THEN 0 WHEN turn % 2 = 0 THEN scam * e[i] / list_sum(e) ELSE scam END, 0)), 6) AS base FROM g""",
        "sms_channel": f"""WITH RECURSIVE {_server_sql()}, r AS (SELECT conv_id, turn, turn * 11.0::DOUBLE + conv_id % 5 AS ts, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
            b AS (SELECT conv_id, turn, n, ts, 4.0::DOUBLE AS tokens, true AS ok FROM r WHERE n = 1 UNION ALL
              SELECT r.conv_id, r.turn, r.n, r.ts, least(5.0::DOUBLE, tokens + (r.ts - b.ts) * (1 / 60.0::DOUBLE)) - CASE WHEN least(5.0::DOUBLE, tokens + (r.ts - b.ts) * (1 / 60.0::DOUBLE)) >= 1 THEN 1 ELSE 0 END,
                least(5.0::DOUBLE, tokens + (r.ts - b.ts) * (1 / 60.0::DOUBLE)) >= 1 FROM b JOIN r ON r.conv_id = b.conv_id AND r.n = b.n + 1),
            nm AS (SELECT conv_id, turn, string_agg(tactic, ', ' ORDER BY tactic) AS names FROM flags WHERE verdict = 'surfaced' GROUP BY 1, 2),
            nt AS (SELECT b.*, names, CASE WHEN b.conv_id % 3 = 0 AND b.turn % 2 <> 0 THEN {_quoted(X.TEMPLATE_NOTE)} ELSE '' END AS note FROM b LEFT JOIN nm USING (conv_id, turn))
            SELECT conv_id, turn, ok AS accepted, CASE WHEN NOT ok THEN '' WHEN names IS NULL THEN {" || note || ".join(_quoted(x) for x in X.NO_PATTERN.split("{}"))}
              ELSE {_quoted(X.CAUTION.split("{}")[0])} || names || {" || note || ".join(_quoted(x) for x in X.CAUTION.split("{}")[1:])} END AS reply FROM nt""",
        "long_requests": "SELECT count(*) FILTER (length(text) <= 8000) AS analyse, count(*) FILTER (length(text) <= 4000) AS explain FROM documents",
        "summary_examples": f"{base} SELECT tactic AS tactic_label, count(*) AS n, count(DISTINCT array_to_string(spans, ', ')) AS texts FROM cand GROUP BY 1",
        "summary_salience": """SELECT conv_id, role AS value, round(count(*) * pow(0.5::DOUBLE, greatest(0.0, (30 - max(turn)) * 86400.0) / 259200.0::DOUBLE), 3) AS salience FROM conversations GROUP BY 1, 2""",
        "eval_corpus": f"""WITH {_server_sql(of_corpus)}, j AS (SELECT y, surfaced AS p, contains(note, {_quoted(fixtures.EVASION)}) AS evasion FROM {labelled}),
            e AS (SELECT 'plain' AS rows, * FROM j WHERE NOT evasion UNION ALL SELECT 'all', * FROM j), c AS (SELECT rows, {_COUNTS} FROM e GROUP BY 1), r AS (SELECT *, {_PR} FROM c)
            SELECT rows, tp, fp, fn, tn, {_RATIOS} FROM r""",
        "eval_by_age_and_language": f"""WITH {_server_sql(of_corpus)}, j AS (SELECT y, surfaced AS p, age, language FROM {labelled} WHERE NOT contains(note, {_quoted(fixtures.EVASION)})),
            c AS (SELECT CASE WHEN age IS NULL THEN 'language' ELSE 'age_bracket' END AS slice, coalesce(age, language) AS value, {_COUNTS} FROM j GROUP BY GROUPING SETS ((age), (language))),
            r AS (SELECT *, {_PR} FROM c) SELECT slice, value, tp, fp, fn, tn, {_RATIOS} FROM r""",
        "eval_labels_by_lang": f"""WITH {_server_sql(of_docs)}, h AS (SELECT DISTINCT conv_id FROM hits),
            j AS (SELECT s.role AS lang, toxic = 1 AS y, surfaced OR h.conv_id IS NOT NULL AS p FROM surf s JOIN labels ON doc_id = s.conv_id LEFT JOIN h ON h.conv_id = s.conv_id),
            c AS (SELECT lang, {_COUNTS} FROM j GROUP BY 1), r AS (SELECT *, {_PR} FROM c) SELECT lang, tp, fp, fn, tn, {_RATIOS} FROM r""",
        "sms_junk_documents": f"SELECT doc_id, ({strong_docs}) OR ({moderate_docs}) >= 2 AS junk FROM documents",
    }
    return more | {
        "cue_scan": f"{base} SELECT conv_id, turn, tactic, n, array_to_string(spans, '|') AS spans FROM tac",
        "cue_scan_prescreen": f"{base} SELECT tactic, count(*) AS turns, CAST(sum(n) AS BIGINT) AS hits FROM tac GROUP BY 1",
        "cue_scan_automaton": f"{base} SELECT tactic, count(*) AS turns, CAST(sum(n) AS BIGINT) AS hits FROM tac GROUP BY 1",
        "tier0_scores": f"{base} SELECT conv_id, turn, round(tier0, 6) AS tier0 FROM t0",
        "cascade_route": f"""{base} SELECT t0.conv_id, t0.turn,
            CAST(CASE WHEN t0.tier0 < 0.28::DOUBLE OR t0.scored = 0 THEN 0 WHEN coalesce(max(base), 0) < 0.55::DOUBLE THEN 1 ELSE 2 END AS BIGINT) AS tier,
            count(base) AS n_candidates, round(coalesce(max(base), 0.0), 6) AS top
            FROM t0 LEFT JOIN cand USING (conv_id, turn) GROUP BY t0.conv_id, t0.turn, t0.tier0, t0.scored""",
        "gate_flags": f"{server} SELECT conv_id, turn, tactic, confidence, verdict, reason FROM flags",
        "gate_verdict_counts": f"{server} SELECT tactic, verdict, count(*) AS n FROM flags GROUP BY 1, 2",
        "any_surfaced_by_conv": f"{server} SELECT conv_id, bool_or(surfaced) AS any_surfaced, count(*) FILTER (surfaced) AS n_surfaced FROM surf GROUP BY 1",
        "cascade_edge_variant": f"WITH {_edge_sql()} SELECT conv_id, turn, tactic, round(round(confidence, 4), 3) AS confidence FROM eflags WHERE confidence >= 0.35::DOUBLE",
        "sliding_window_12": """SELECT conv_id, count(*) AS kept, min(turn) AS oldest, max(turn) AS newest FROM
            (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 12 GROUP BY 1""",
        "turn_index": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index FROM conversations",
        "conversation_summary": f"""{server} SELECT conv_id, string_agg(turn || ':' || tactic, ',' ORDER BY turn, tactic) AS flags
            FROM flags WHERE verdict = 'surfaced' GROUP BY 1""",
        "voice_compound": f"""{base}, c AS (SELECT t0.conv_id, t0.turn, ((t0.conv_id * 31 + t0.turn * 17) % 100) / 100.0::DOUBLE AS spoof, max(base) AS content
            FROM t0 LEFT JOIN cand USING (conv_id, turn) GROUP BY t0.conv_id, t0.turn)
            SELECT conv_id, turn, round(CASE WHEN spoof >= 0.6::DOUBLE AND content IS NOT NULL THEN least(1.0::DOUBLE, 0.5::DOUBLE * spoof + 0.5::DOUBLE * content + 0.1::DOUBLE)
            WHEN spoof >= 0.6::DOUBLE THEN 0.5::DOUBLE * spoof WHEN content IS NOT NULL THEN 0.6::DOUBLE * content ELSE 0.0::DOUBLE END, 3) AS compound_confidence,
            CASE WHEN spoof >= 0.6::DOUBLE AND content IS NOT NULL THEN 'both' WHEN spoof >= 0.6::DOUBLE THEN 'acoustic'
            WHEN content IS NOT NULL THEN 'content' ELSE 'none' END AS kind FROM c""",
        "model_blend": f"""{base} SELECT conv_id, turn, tactic, round(CASE WHEN turn % 2 = 0 AND tactic = '{T.PAYMENT}' THEN least(1.0, 0.5::DOUBLE * base + 0.5::DOUBLE * 0.9::DOUBLE)
            WHEN turn % 2 = 0 AND tactic = '{T.URGENCY}' THEN least(1.0, 0.5::DOUBLE * base + 0.5::DOUBLE * 0.1::DOUBLE) ELSE base END, 6) AS base FROM cand""",
        "sms_junk": f"WITH {_base_sql()} SELECT conv_id, turn, ({strong}) OR ({moderate}) >= 2 AS junk FROM low",
        "sms_reply": f"""{server} SELECT s.conv_id, s.turn, CASE WHEN s.surfaced THEN 'CAUTION: This message matches known scam patterns (' ||
            (SELECT string_agg(tactic, ', ' ORDER BY tactic) FROM flags f WHERE f.conv_id = s.conv_id AND f.turn = s.turn AND verdict = 'surfaced')
            || '). Do not send money or personal info. Reply STOP to opt out.' ELSE '{reply}' END AS reply FROM surf s""",
        "eval_confusion": f"""{server}, e AS (SELECT {_TRUTH} AS y, surfaced AS p FROM surf s), c AS (SELECT {_COUNTS} FROM e), r AS (SELECT *, {_PR} FROM c)
            SELECT tp, fp, fn, tn, {_RATIOS} FROM r""",
        "eval_by_slice": f"""{server}, e AS (SELECT role, {_TRUTH} AS y, surfaced AS p FROM surf s), c AS (SELECT role, {_COUNTS} FROM e GROUP BY role), r AS (SELECT *, {_PR} FROM c)
            SELECT role, tp, fp, fn, tn, {_RATIOS} FROM r""",
        "equity_regressions": f"""{server}, e AS (SELECT role, count(*) FILTER ({_TRUTH} AND surfaced) / count(*) FILTER ({_TRUTH}) AS b,
            count(*) FILTER ({_TRUTH} AND strict) / count(*) FILTER ({_TRUTH}) AS c FROM surf s GROUP BY role)
            SELECT role, round((b - c) / b, 6) AS regression FROM e WHERE b > 0 AND (b - c) / b > 0.05""",
        "citations_rendered": f"""{base} SELECT l.conv_id, l.turn, coalesce(string_agg('- Message said: "' || cue || '"', chr(10) ORDER BY ord), 'No specific evidence cited.') AS lines
            FROM low l LEFT JOIN hits h USING (conv_id, turn) GROUP BY 1, 2""",
        "prompt_fit": """WITH f AS (SELECT doc_id, CASE WHEN length(text) > 6000 THEN left(text, 4200) || chr(10) || '[...]' || chr(10) || right(text, 1800) ELSE text END AS t FROM documents)
            SELECT doc_id, length(t) AS chars, md5(t) AS md5 FROM f""",
        "model_replies": """SELECT conv_id, turn, 'urgency_injection' AS tactic, least(1.0::DOUBLE, turn / 2) AS confidence, 'rush' AS rationale FROM conversations""",
        "edge_server_disagreement": f"""WITH s AS (WITH {_server_sql()} SELECT conv_id, turn, surfaced FROM surf),
            e AS (WITH {_edge_sql()} SELECT conv_id, turn, surfaced FROM esurf)
            SELECT s.surfaced AS server, e.surfaced AS edge, count(*) AS n FROM s JOIN e USING (conv_id, turn) GROUP BY 1, 2""",
    }


QUERIES = {
    f.__name__: f
    for f in (
        cue_scan, cue_scan_prescreen, cue_scan_automaton, tier0_scores, cascade_route, gate_flags, gate_verdict_counts,
        any_surfaced_by_conv, benign_path, cascade_edge_variant, edge_server_disagreement,
        session_compounding, sliding_window_12, turn_index, conversation_summary, voice_compound,
        model_blend, sms_junk, sms_reply, eval_confusion, eval_by_slice, equity_regressions,
        flag_explanations, citations_rendered, prompt_fit, model_replies, sms_channel, model_refinements,
        model_chain, classifier_blend, grounding_prompts, explanations, check_results, long_requests,
        summary_examples, summary_salience, eval_corpus, eval_by_age_and_language, eval_labels_by_lang,
        sms_junk_documents,
    )
}
ORACLES = _oracles()
