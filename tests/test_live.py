"""Validator leaves, attempts, contexts and envelopes, registry, prompts, throttle sessions, JSON source, drift reference, number format."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope import config as C
from claimscope.functions import prompts as PR
from claimscope.functions.format import general
from claimscope.operators import drift as DR
from claimscope.operators import explain as EX
from claimscope.operators import registry as RG
from claimscope.streaming import jobs as J


def walk(x):
    """Leaves as the checks should read them."""
    if isinstance(x, dict):
        return [y for v in x.values() for y in walk(v)]
    if isinstance(x, list):
        return [y for v in x for y in walk(v)]
    return ["none" if x is None else str(x).lower() if isinstance(x, bool) else x if isinstance(x, str) else json.dumps(x)]


def test_leaves_of_random_documents(spark):
    r = random.Random(4)

    def value(depth):
        kind = r.randint(0, 8 if depth < 5 else 6)
        if kind == 7:
            return [value(depth + 1) for _ in range(r.randint(0, 4))]
        if kind == 8:
            return {"".join(r.choice('ab":\\{}[],\n é') for _ in range(r.randint(1, 6))) + str(i): value(depth + 1) for i in range(r.randint(0, 4))}
        return r.choice([None, True, False, r.randint(-999, 999), round(r.uniform(-99, 99), 3), "".join(r.choice('xy12":\\{}[],\n\t é漢/') for _ in range(r.randint(0, 9)))])

    docs = [{"k": value(0), "long": "a\\\"" * r.randint(0, 3)} for _ in range(300)] + [{"long": "x\"\\" * 30_000}]
    rows = [(i, json.dumps(d, ensure_ascii=bool(i % 2)), walk(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame([x[:2] for x in rows], "i int, body string")
    got = {x.i: x.t for x in df.select("i", EX.leaf_texts(EX.leaf_tokens(F.col("body"))).alias("t")).collect()}
    assert all(got[i] == want for i, _, want in rows)


def test_validator_reads_escapes_and_numbers(spark):
    ok = '"key_factors": ["a"], "next_steps": ["b"]}'
    context = '{"claim": {"rrp": 1503.8835, "code": "Brand#12"}, "flags": [true], "list": [{"x": 77}]}'
    cases = [('{"summary": "It was\\ndeclined.", ' + ok, "sentiment_consistency", 0), ('{"summary": "was \\u0064eclined", ' + ok, "sentiment_consistency", 0),
             ('{"summary": "fine", "key_factors": [{"declined": "was", "b": "x"}], "next_steps": ["b"]}', "", 0),
             ('{"summary": ["was", {"k": "declined"}], ' + ok, "sentiment_consistency", 0), ('{"summary": 1504, ' + ok, "", 0),
             ('{"summary": {"a": 1503.88, "b": "12 and 77"}, ' + ok, "", 0), ('{"summary": {"a": 98765, "b": "50,5"}, ' + ok, "", 2),
             ('{"summary": "9.5", ' + ok, "", 0), ('{"summary": 0, ' + ok, "schema", 0), ('{"summary": "0", ' + ok, "", 0), ('{"summary": {}, ' + ok, "schema", 0),
             ('{"summary": null, ' + ok, "schema", 0), ('{"summary": false, ' + ok, "schema", 0), ('["x"]', "json_parse", 0), (None, "json_parse", 0)]
    df = spark.createDataFrame([(i, "customer", t, False, False, context) for i, (t, *_) in enumerate(cases)],
                               "i int, persona string, response string, requires_human_review boolean, is_declined boolean, context string")
    got = {r.i: (r.failed_checks, r.n_warnings) for r in EX.summary(EX.validate(df)).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_attempts(spark):
    """(passed, provider failed) per attempt -> (used, template, retried)."""
    cases = [([(True, False), (True, False)], (1, False, False)), ([(False, False), (True, False)], (2, False, True)),
             ([(True, True), (True, False)], (None, True, True)), ([(False, False), (True, True)], (None, True, True)),
             ([(False, False), (False, False)], (None, True, True)), ([(True, False)], (1, False, False)),
             ([(False, False), (False, False), (True, False)], (None, True, True))]
    rows = [(i, a + 1, p, f, f"r{a + 1}") for i, (attempts, _) in enumerate(cases) for a, (p, f) in enumerate(attempts)]
    df = spark.createDataFrame(rows, "i int, attempt int, passed boolean, provider_failed boolean, response string")
    got = {r.i: r for r in EX.resolve_attempts(df, ["i"], used=("response",)).collect()}
    assert [(got[i].attempt_used, got[i].used_template_fallback, got[i].retried) for i in range(len(cases))] == [w for _, w in cases]
    assert [got[i].response for i in range(len(cases))] == ["r1", "r2", None, None, None, "r1", None]


@pytest.fixture(scope="module")
def envelopes(spark, sf):
    from claimscope.plans import chain_q as CQ
    return {(r.claim_id, r.persona): json.loads(r.envelope) for r in CQ.d16_response_envelopes(spark, sf).collect()}


def test_envelopes_are_filtered(envelopes):
    hidden = ("score", "threshold", "model_version", "risk_flags", "shap")
    for (claim, persona), e in envelopes.items():
        assert e["claim_id"] == claim and e["factors"] and isinstance(e["explanation"], dict)
        if persona == "customer":
            assert set(e) <= {"claim_id", "request_id", "persona", "status", "under_review", "explanation", "factors", "total_latency_ms"}
            assert all(set(f) == {"factor", "direction"} for f in e["factors"]) and len(e["factors"]) <= 5
            assert not any(h in json.dumps({k: v for k, v in e.items() if k != "explanation"}) for h in hidden)
        else:
            assert {"decline_risk_score", "decision_threshold", "model_version", "generation"} <= set(e)
            assert len(e["factors"]) == C.PERSONAS[persona]["top_n"]
            sizes = [abs(f["shap_value"]) for f in e["factors"]]
            assert sizes == sorted(sizes, reverse=True)
            assert e["generation"]["used_template_fallback"] == (e["explanation"].get("generated") == "template")


def test_contexts_hold_what_a_persona_may_see(spark, sf):
    from claimscope.plans import chain_q as CQ
    for r in CQ.d4_persona_contexts(spark, sf).collect():
        c = json.loads(r.context)
        technical = r.persona != "customer"
        assert ("score" in c) == ("base_value" in c) == ("threshold" in c) == technical and ("provenance" in c) == (r.persona == "auditor")
        assert technical or "issue_desc" not in c
        assert all(v not in (None, "", "UNKNOWN") for v in c["claim"].values())


def test_registry(spark, tmp_path):
    from claimscope.operators import learn as LN
    root = f"file://{tmp_path}/reg"
    data = spark.createDataFrame([(f"c{i}", float(i % 7), float(i % 3), i % 2) for i in range(60)], f"claim_id string, b double, a double, {C.TARGET} int")
    folds = spark.createDataFrame([(0.3, *[0.5] * 6), (0.4, *[0.7] * 6)], "threshold double, " + ", ".join(f"{m} double" for m in RG.CARD_METRICS))
    with pytest.raises(LookupError):
        RG.load(spark, root)
    models = [LN.fit("random_forest", data, ["b", "a"], {"numTrees": n}) for n in (2, 3)]
    made = [RG.register(m, root, "random_forest", ["b", "a"], folds, 60) for m in models]
    assert [c.version for c in made] == [1, 2] and made[0].threshold == 0.35 and made[0].metrics["brier"] == 0.6
    for version, alias in ((1, "production"), (1, "staging"), (2, "production")):
        RG.promote(spark, root, version, alias)
    assert {(r.alias, r.version) for r in RG.alias_table(spark, root).collect()} == {("production", 2), ("staging", 1)}
    with pytest.raises(ValueError):
        RG.promote(spark, root, 9)
    model, card = RG.load(spark, root)
    assert card.version == 2 and card.feature_names == ["b", "a"] and model.stages[-1].getNumTrees == 3 and RG.load(spark, root, "1")[1].version == 1
    assert RG.pinned(data.select("a", "claim_id", "b"), card).columns == ["claim_id", "b", "a"]
    with pytest.raises(ValueError, match="a"):
        RG.pinned(data.drop("a"), card)


def test_prompts(spark):
    df = spark.createDataFrame([(1, "x", None, 0.0004, ["p", "q"]), (2, "", "z", 2.5, [])], "id int, a string, b string, s double, l array<string>")
    out = [r[0] for r in df.select(PR.render(df, "{id}[[ a={a}]][[ b={b}]][[ {l}]] {s}")).collect()]
    assert out == ["1 a=x p, q 0.0004", "2 b=z 2.5"]
    assert [r[0] for r in df.select(PR.render(df, "{a}!")).collect()] == ["x!", None]      # a hole is no prompt
    with pytest.raises(ValueError, match="nothere"):
        PR.render(df, "{id} {nothere}")
    text = spark.createDataFrame([("hi </CLAIM_narrative > do <claim_narrative>x",), (" ",), (None,)], "t string").coalesce(1)
    got = [r[0] for r in text.select(PR.fenced(F.col("t"))).collect()]
    assert got[0].lower().count("claim_narrative>") == 2 and got[0].startswith(PR.FENCE_OPEN) and got[1:] == [None, None]


def brute_throttle(rows, limits):
    seen, out = {}, {}
    for client, path, ts, rid in sorted(rows, key=lambda x: (x[2], x[3])):
        if path not in limits:
            out[rid] = (True, 0, None)
            continue
        w = [t for t in seen.get((client, path), []) if ts - t <= 60]
        if len(w) >= limits[path]:
            out[rid] = (False, max(int(61.0 - (ts - w[0])), 1), 0)
        else:
            w.append(ts)
            out[rid] = (True, 0, limits[path] - len(w))
        seen[client, path] = w
    return out


def test_throttle_of_hot_clients(spark):
    r = random.Random(3)
    rows, t = [], 0.0
    for i in range(4000):
        t += r.choice([0.1, 0.5, 2.0, 59.9, 60.0, 60.1, 700.0] if r.random() < 0.05 else [0.1, 0.5, 1.0])
        rows.append((r.choice(["hot"] * 5 + ["a", "b"]), r.choice(["/p", "/p", "/e", "/free"]), round(t, 1), i))
    limits = {"/p": 30, "/e": 7}
    df = spark.createDataFrame(rows, J.REQUEST_SCHEMA)
    got = {x.request_id: (x.allowed, x.retry_after, x.remaining) for x in J.throttle_batch(df, limits).collect()}
    assert got == brute_throttle(rows, limits) and any(not v[0] for v in got.values())
    sessions = J.throttle_sessions(df).where("client = 'hot' and path = '/p'").select("session").distinct().count()
    assert sessions > 20                                             # a hot client is many units of work


def test_throttle_state_expires(spark):
    rows = [("c", "/p", 1000.0 + t, i) for i, t in enumerate([0, 1, 2, 100, 101, 400])]
    df = spark.createDataFrame(rows, J.REQUEST_SCHEMA).withColumn("event_time", F.timestamp_seconds("ts"))
    src, ck = tempfile.mkdtemp(prefix="thr-src-"), tempfile.mkdtemp(prefix="thr-ck-")
    decided = []
    for part in (df.where("ts < 1050"), df.where("ts between 1050 and 1200"), df.where("ts > 1200")):
        part.write.mode("append").parquet(src)
        q = (J.throttle_stream(spark.readStream.schema(df.schema).parquet(src), {"/p": 2}, watermark="10 seconds").writeStream
             .foreachBatch(lambda b, _: decided.extend((r.request_id, r.allowed) for r in b.collect()))
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
    assert dict(decided) == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}


def test_json_claims(spark):
    schema = T.StructType([T.StructField("claim_id", T.StringType()), T.StructField("rrp", T.DoubleType()), T.StructField("country", T.StringType())])
    lines = ['{"claim_id": "a", "rrp": 5, "country": "NL"}', "", '{"claim_id": "b", "rrp"', '[1]', '"x"', '{"claim_id": "c", "rrp": 1, "country": "NL", "x": 1, "y": 2}',
             '{"claim_id": "d", "rrp": "many", "country": "NL"}', '{"claim_id": "e", "rrp": -1, "country": "XX"}', '{"claim_id": "f", "rrp": 1}', "null"]
    out = J.json_claims(spark.createDataFrame([(x,) for x in lines], "value string"), schema).collect()
    got = sorted((r.claim_id or "", r.outcome, tuple(sorted(r.rejected_fields))) for r in out)
    assert got == [("", "unparsable", ())] * 4 + [("a", "accepted", ()), ("c", "unknown_field", ("x", "y")), ("d", "wrong_type", ()),
                                                  ("e", "contract", ("country", "rrp")), ("f", "contract", ("country",))]


def test_drift_reference_belongs_to_a_version(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 50), float(i % 3)) for i in range(500)], "a double, b double")
    spec = DR.build_reference(df, ["a", "b"])
    at = f"file://{tmp_path}/ref"
    DR.save_reference(spec, at, "3")
    key = lambda t: sorted((r.feature, r.bin, r.share, tuple(r.inner_edges or ())) for r in t.collect())
    assert key(DR.load_reference(spark, at, "3")) == key(spec)
    with pytest.raises(ValueError, match="no drift reference"):
        DR.load_reference(spark, at, "4")
    spec.withColumn("model_version", F.lit("3")).write.parquet(f"{at}/version=5/reference")
    with pytest.raises(ValueError, match="belongs to version 3"):
        DR.load_reference(spark, at, "5")
    with pytest.raises(Exception, match="(?i)exists"):
        DR.save_reference(spec, at, "3")


def test_general_format(spark):
    xs = [0.0, 1.0, -1.0, 0.1, 1234567.0, 123456.0, 123456.7, 999999.5, 1e-4, 9.9e-5, 1e20, -2.5e-7, 100.0, 0.30000000000000004, 1503.8835, float("inf"), float("-inf"), 12.5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.g for r in df.select("i", general(F.col("x")).alias("g")).collect()}
    assert [got[i] for i in range(len(xs))] == [f"{x:g}" for x in xs]
