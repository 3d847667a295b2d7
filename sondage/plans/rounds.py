"""Queries of redrawn rounds, free-text readers and the versioned sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import noise as N
from sondage.functions import text as T
from sondage.operators import answers as A
from sondage.operators import bars as B
from sondage.operators import rounds as O
from sondage.operators import selection as S
from sondage.sources import versions
from sondage.sources.stored import shared_dir

from . import views as V
from .registry import query, r6

_STEPS = [str(k) for k in range(5)]


def _redrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as answers: their log-values lean to the code; some cells lack an item type, log-values or a wobble."""
    main = V.main_round(spark, sf_dir)
    logs = F.map_from_arrays(F.array(*map(F.lit, _STEPS)), F.array(*[-F.abs(F.col("code") - k) * 0.5 for k in range(5)]))
    cells = main.select(
        "pid",
        "item_id",
        F.when(F.col("item_id") != 31, F.col("kind")).alias("kind"),
        F.col("seq").alias("position"),
        F.col("code").cast("string").alias("answer"),
        F.when(F.col("item_id") % 7 != 0, logs).alias("logprobs"),
        F.when(F.col("pid") % 10 != 0, F.col("value") / 100).alias("wobble"),
    )
    return O.redrawn(cells, N.answer_distribution(F.col("logprobs"), _STEPS), "retest", a=0.3, b=0.8, temperature=2.0, seed=5)


def _uniform(what: str) -> str:
    return f"(('0x' || substr(sha256('5:' || pid || ':' || item_id || ':retest:{what}'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


_REDRAWN = f""", w AS (SELECT *, CASE WHEN item_id <> 31 THEN kind END AS type, CASE WHEN pid % 10 <> 0 THEN value / 100 END AS wobble,
  list_transform(range(5), lambda k: exp(-0.5::DOUBLE * abs(code - k))) AS e, list_transform(range(5), lambda k: exp(-0.25::DOUBLE * abs(code - k))) AS f FROM main),
p AS (SELECT *, 1.0::DOUBLE / list_sum(e) AS top, {_uniform('event')} AS u, {_uniform('draw')} AS v,
  CASE WHEN type IS NULL THEN 'unknown_item' WHEN item_id % 7 = 0 THEN 'no_logprobs' WHEN wobble IS NULL THEN 'no_wobble' END AS skipped FROM w),
x AS (SELECT *, skipped IS NULL AND u < least(greatest(wobble * (0.3 + 0.8 * (1 - top)), 0), 0.95) AS event FROM p),
d AS (SELECT pid, item_id, type AS kind, code::VARCHAR AS before, skipped, event,
  CASE WHEN event THEN (least(4, len(list_filter(range(5), lambda k: list_sum(f[1:k + 1]) / list_sum(f) <= v))))::VARCHAR ELSE code::VARCHAR END AS answer FROM x)
"""


@query(_REDRAWN + "SELECT pid, item_id, kind, before, answer, skipped, event, answer <> before AS changed FROM d")
def redrawn_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redrawn(spark, sf_dir).select("pid", "item_id", "kind", "before", "answer", "skipped", "event", "changed")


_RATE = "count(*) AS cells, count(*) FILTER (event) AS events, count(*) FILTER (answer <> before) AS changed, round(count(*) FILTER (event) / count(*), 6)::DOUBLE AS event_rate FROM d WHERE skipped IS NULL"


@query(_REDRAWN + f"SELECT 0::INTEGER AS level, NULL::VARCHAR AS kind, NULL::BIGINT AS pid, {_RATE} UNION ALL SELECT 1, kind, NULL, {_RATE} GROUP BY kind UNION ALL SELECT 2, NULL, pid, {_RATE} GROUP BY pid")
def round_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and changes over all cells, by item type and by person, in one pass."""
    out = O.rates(_redrawn(spark, sf_dir), [[], ["kind"], ["pid"]])
    return out.select("level", "kind", "pid", "cells", "events", "changed", r6("event_rate").alias("event_rate"))


@query("SELECT conv_id, turn, '{\"turn\": ' || turn || ', \"note\": \"a } in \\\" quotes\"}' AS found FROM conversations")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object with a brace and a quote inside a string, behind a broken one and in front of the whole text of each turn."""
    inside = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "note": "a } in \\" quotes"}'))
    reply = F.concat(F.lit("I think {maybe} this:\n```json\n"), inside, F.lit("\n``` "), F.coalesce("text", F.lit("")))
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.first_json_object(reply).alias("found"))


@query("""SELECT event_id, round(value / (value + 60), 6) AS yes, round(60 / (value + 60), 6) AS no FROM (SELECT event_id, round(value, 2) AS value FROM events)
WHERE abs((value + 60) / 100 - 1) <= 0.25""")
def named_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of replies like `Yes: 45.12 % / no = 60`, where they sum to about a hundred."""
    reply = F.concat(F.lit("Yes: "), F.format_string("%.2f", F.round("value", 2)), F.lit(" % / no = 60"))
    got = V.table(spark, sf_dir, "events").select("event_id", T.parse_distribution(reply, ["yes", "No"]).alias("p")).where("p IS NOT NULL")
    return got.select("event_id", r6(F.col("p")["yes"]).alias("yes"), r6(F.col("p")["no"]).alias("no"))


_INGESTED = """, l AS (SELECT seq, pid::VARCHAR AS pid, item_id::VARCHAR AS item_id, seq % 17 = 0 AS broken, CASE WHEN seq % 5 = 0 THEN NULL WHEN kind = 'likert5' THEN (code + 1)::VARCHAR WHEN code >= 2 THEN 'yes' ELSE 'no' END AS answer,
  item_id = 31 AS strange, seq > (SELECT max(seq) / 2 FROM ev) AS late FROM ev),
good AS (SELECT pid, item_id, arg_min(answer, (late, seq)) AS answer FROM l WHERE NOT broken AND NOT strange AND answer IS NOT NULL GROUP BY ALL),
bad AS (SELECT pid, item_id, CASE WHEN strange THEN 'item not in bank' ELSE 'none' END AS reason FROM l WHERE NOT broken AND (strange OR answer IS NULL) GROUP BY ALL)
"""


@query(_INGESTED + """SELECT pid, item_id, answer, NULL::VARCHAR AS reason FROM good UNION ALL SELECT pid, item_id, NULL, reason FROM bad ANTI JOIN good USING (pid, item_id)
UNION ALL SELECT NULL, NULL, NULL, 'not JSON' WHERE EXISTS (SELECT 1 FROM l WHERE broken)""")
def ingested_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two batches of JSON lines leave behind: answers, and one reject of each cell that has none."""
    log = V.log(spark, sf_dir)
    said = F.when(F.col("seq") % 5 == 0, "hm").when(F.col("kind") == "likert5", F.concat(F.lit(" "), (F.col("code") + 1).cast("string"), F.lit("."))).when(F.col("code") >= 2, "Yes!").otherwise("no")
    record = F.to_json(F.struct(F.col("pid").cast("string").alias("pid"), F.col("item_id").cast("string").alias("item_id"), F.lit("main").alias("round"), said.alias("completion")))
    lines = log.select(F.when(F.col("seq") % 17 == 0, F.concat(F.lit("{"), record)).otherwise(record).alias("line"), F.col("seq").alias("position"))
    bank = log.where("item_id <> 31").select(F.col("item_id").cast("string").alias("item_id"), "kind").distinct()
    half, path = log.agg(F.max("seq") / 2).first()[0], f"{shared_dir(spark)}/sondage/answers-{uuid.uuid4().hex}"
    for batch in (lines.where(F.col("position") <= half), lines.where(F.col("position") > half)):
        versions.ingest(spark, path, batch, bank)
    answers = versions.read_version(spark, path, "answers", versions.ANSWERS).select("pid", "item_id", "answer", F.lit(None).cast("string").alias("reason"))
    return answers.unionByName(versions.read_version(spark, path, "rejects", versions.REJECTS).select("pid", "item_id", F.lit(None).cast("string").alias("answer"), "reason"))


_QUOTA = """, u AS (SELECT pid, i.item_id, i.stratum, ('0x' || substr(sha256('11:' || pid || ':' || i.item_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u
  FROM (SELECT DISTINCT pid FROM main) p, (SELECT k::VARCHAR AS item_id, CASE WHEN k % 3 <> 0 THEN 'dim' || k % 4 WHEN k % 9 = 3 THEN 'cross' WHEN k % 9 = 6 THEN 'weak' ELSE 'distractor' END AS stratum FROM (SELECT unnest(range(1, 32)) AS k)) i),
r AS (SELECT *, row_number() OVER (PARTITION BY pid, stratum ORDER BY u, item_id) AS place FROM u)
SELECT pid, item_id, (row_number() OVER (PARTITION BY pid ORDER BY item_id::INTEGER) - 1)::INTEGER AS place FROM r
WHERE place <= CASE stratum WHEN 'cross' THEN 2 WHEN 'weak' THEN 1 WHEN 'distractor' THEN 1 ELSE 2 END"""


@query(_QUOTA)
def retest_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve items for each person: two of each of four dimensions, and of three classes with 4, 3 and 3 items by quotas of four."""
    items = range(1, 32)
    fixed = {str(d): [str(k) for k in items if k % 3 and k % 4 == d] for d in range(4)}
    classes = {name: [str(k) for k in items if k % 9 == rest] for name, rest in (("cross", 3), ("weak", 6), ("distractor", 0))}
    people = V.main_round(spark, sf_dir).select("pid").distinct()
    return S.quota_sample(people, [str(k) for k in items], fixed, 2, classes, 12, seed=11)


_REPLIES = [  # reply, type, answer, reason
    ("5.", "likert5", "5", None),
    ("I strongly agree with it", "likert5", "5", None),
    ("Disagree", "likert5", "2", None),
    ("5.5", "likert5", None, "none"),
    ("15", "likert5", None, "none"),
    ("1 or 2", "likert5", None, "ambiguous"),
    ("  ", "likert5", None, "empty"),
    ("Yes!", "binary", "yes", None),
    ("nope", "binary", "no", None),
    ("(y)", "binary", "yes", None),
    ("yes and no", "binary", None, "ambiguous"),
    ("perhaps", "binary", None, "none"),
    ("4", "open", None, "unknown type"),
]


@query("SELECT seq, r.answer, r.reason FROM ev JOIN (VALUES " + ", ".join(f"({i}, {'NULL' if a is None else repr(a)}, {'NULL' if r is None else repr(r)})" for i, (_, _, a, r) in enumerate(_REPLIES)) + f") r(i, answer, reason) ON ev.seq % {len(_REPLIES)} = r.i")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event says one of the planted replies; what the reader makes of them."""
    said = F.element_at(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(k).alias("kind")) for t, k, _, _ in _REPLIES]), (F.col("seq") % len(_REPLIES) + 1).cast("int"))
    rows = V.log(spark, sf_dir).select("seq", said.alias("said"))
    return rows.select("seq", T.normalize_answer(F.col("said.text"), F.col("said.kind")).alias("got")).select("seq", "got.answer", "got.reason")


_ACCURACY = """, e AS (SELECT kind AS dim, pid, avg(value) / 100 AS truth, avg(value) FILTER (item_id <= 15) / 100 AS centre, (SELECT avg(value) / 100 FROM main) AS baseline FROM main GROUP BY ALL)
"""


@query(_ACCURACY + "SELECT dim, count(*) AS n, round(sqrt(avg(pow(centre - truth, 2))), 6) AS rmse, round(corr(centre, truth), 6) AS corr, round(1 - sqrt(avg(pow(centre - truth, 2))) / sqrt(avg(pow(baseline - truth, 2))), 6) AS lift FROM e WHERE centre IS NOT NULL GROUP BY GROUPING SETS ((), (dim))")
def trait_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People's means over the interview as estimates of their means over all items, by item type and pooled."""
    main = V.main_round(spark, sf_dir)
    everywhere = main.agg((F.avg("value") / 100).alias("baseline"))
    cells = main.groupBy(F.col("kind").alias("dim"), "pid").agg((F.avg("value") / 100).alias("truth"), (F.avg(F.when(F.col("item_id") <= 15, F.col("value"))) / 100).alias("centre")).crossJoin(everywhere)  # one row
    return B.accuracy(cells).select("dim", "n", r6("rmse").alias("rmse"), r6("corr").alias("corr"), r6("lift").alias("lift"))


@query("""SELECT metric, value, low, high, pass, false AS all_pass FROM (SELECT metric, round(value, 6) AS value, low, high, CASE WHEN value IS NULL THEN NULL ELSE value >= coalesce(low, value) AND value <= coalesce(high, value) END AS pass FROM (
  VALUES ('max_pair_agreement', NULL::DOUBLE, 0.95::DOUBLE), ('median_pair_agreement', NULL, 0.8), ('effective_dimensions', 5.0, NULL), ('median_obedience', 0.5, NULL), ('retest_agreement', 0.7, 0.9)) b(metric, low, high) LEFT JOIN (
  SELECT 'max_pair_agreement' AS metric, max(rate) AS value FROM (SELECT avg(CASE WHEN a.answer = b.answer THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM main a JOIN main b ON a.item_id = b.item_id AND a.pid < b.pid GROUP BY a.pid, b.pid)
  UNION ALL SELECT 'median_pair_agreement', quantile_cont(rate, 0.5) FROM (SELECT avg(CASE WHEN a.answer = b.answer THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM main a JOIN main b ON a.item_id = b.item_id AND a.pid < b.pid GROUP BY a.pid, b.pid)
  UNION ALL SELECT 'retest_agreement', avg(CASE WHEN m.kind = 'binary' THEN m.code = r.code ELSE abs(m.code - r.code) <= 1 END::INTEGER) FROM retest r JOIN main m ON m.pid = r.pid AND m.item_id = r.item_id) v USING (metric))""")
def population_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the answering population; two figures are not measured here, so they neither pass nor fail."""
    main = V.main_round(spark, sf_dir)
    rates = A.agreement_rates(main).agg(F.max("rate").alias("max_pair_agreement"), F.percentile("rate", F.lit(0.5), F.col("pairs")).alias("median_pair_agreement"))
    pairs = rates.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in rates.columns])).alias("m")).select("m.*")
    retest = A.retest_report(main, V.retest_round(spark, sf_dir)).where("kind IS NULL AND pid IS NULL").select(F.lit("retest_agreement").alias("metric"), F.col("rate").alias("value"))
    return B.verdict(pairs.unionByName(retest)).withColumn("value", r6("value"))


@query("""SELECT conversations, example, sha256(to_json(struct_pack(names := names))) AS script FROM (SELECT names, count(*) AS conversations, min(conv_id) AS example FROM (
SELECT conv_id, list(coalesce(role, '') ORDER BY turn, role, text) AS names FROM conversations GROUP BY conv_id) GROUP BY names)""")
def conversation_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different orders of roles over all conversations."""
    out = A.scripted_order(A.transcripts(V.table(spark, sf_dir, "conversations")), "role")
    return out.select("conversations", "example", "script")
