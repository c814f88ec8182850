"""One content of very many copies is many tasks' work."""

import collections
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatum.operators import audit, embed, joins, stats
from estatum.plans import plan


def hot(spark, n=100_000):
    tiers = F.get(F.array(*map(F.lit, ("L2", "Backup", "DropboxStorage", "L1"))), (F.col("id") % 4).cast("int"))
    path = F.concat(F.lit("/x/"), F.when(F.col("id") % 3 == 0, "old/").otherwise(""), F.col("id").cast("string"))
    return spark.range(n).select(F.col("id").alias("claim_id"), F.when(F.col("id") < n - 50, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 20).cast("string"))).alias("permanode_id"), F.lit("h").alias("canonical_hash"), path.alias("file_path"), tiers.alias("tier"), F.lit(1).cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("domain"))


def test_keeper_of_a_hot_content(spark):
    rows, policy = hot(spark), plan.Retention(recovered=("/old/",))
    planned = plan.dedup_retire(rows, policy, "r")
    text = planned._sc._jvm.PythonSQLUtils.explainString(planned._jdf.queryExecution(), "formatted")
    assert "Window" not in text
    got = planned.groupBy("permanode_id").agg(F.count(F.lit(1)).alias("n"), F.min("rationale").alias("why")).collect()
    by = {r.permanode_id: r for r in got}
    # the least claim of the best tier that isn't recovered
    assert by["hot"].n == 100_000 - 50 - 1 and by["hot"].why.endswith("lives on L1 (/x/7)") and len(by) == 21


def test_ranks_in_ranges(spark):
    rows, policy = hot(spark, 2000), plan.Retention(recovered=("/old/",))
    ranked = plan.keeper_rank(rows, policy, width=50).collect()
    groups = collections.defaultdict(list)
    for r in ranked:
        groups[r.permanode_id].append((("/old/" in r.file_path), policy.priority[r.tier], r.claim_id, r["rank"]))
    for v in groups.values():
        assert [x[3] for x in sorted(v)] == list(range(1, len(v) + 1))


def test_first_of_a_hot_key(spark):
    rows = hot(spark, 5000)
    got = [r.claim_id for r in stats.last_n_per_key(rows, ["permanode_id"], [F.desc("claim_id")], 7).filter("permanode_id = 'hot'").collect()]
    assert sorted(got) == list(range(4943, 4950))
    sim = plan.simulate(rows.select(F.col("claim_id").alias("row_id"), F.lit("r").alias("manifest_run_id"), F.lit("promote").alias("action"), F.lit("/d").alias("destination_path"), F.when(F.col("claim_id") % 2 == 0, "missing").otherwise("would_succeed").alias("check")), 10)
    assert {r.row_id for r in sim.filter("outcome = 'applied'").collect()} == set(range(1, 21, 2))
    assert sim.filter("outcome = 'errored'").count() == 2500


def test_long_chain_of_uneven_ids(spark):
    rows = spark.range(3000).select(F.lit("m").alias("machine_id"), (F.col("id") + F.when(F.col("id") > 2000, 10**12).otherwise(0)).cast("long").alias("id"), F.lit("a").alias("action"), F.col("id").cast("string").alias("payload"))
    chained = audit.append_batch(rows.withColumn("row_hash", F.lit("")).filter("false"), rows, ["action", "payload"]).cache()
    assert tuple(audit.verify_long_chain(chained, 16, ["action", "payload"]).select("ok", "rows_checked").first()) == (True, 3000)
    bad = chained.withColumn("payload", F.when(F.col("id") == 10**12 + 2500, "x").otherwise(F.col("payload")))
    assert tuple(audit.verify_long_chain(bad, 16, ["action", "payload"]).select("ok", "rows_checked", "bad_id").first()) == (False, 2500, 10**12 + 2500)
    assert audit.verify_long_chain(chained, None, ["action", "payload"]).first().ok


def timed(run):
    began = time.perf_counter()
    out = run()
    return time.perf_counter() - began, out


def plan_text(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_copies_of_a_hot_content(spark):
    """100 000 planned copies of one content: counted, not paired."""
    spent = []
    for n in (20_000, 100_000):
        rows = hot(spark, n).withColumn("is_current", F.lit(True))
        plan_rows = rows.select(F.col("claim_id").alias("row_id"), "permanode_id", F.col("file_path").alias("source_path"))
        t, got = timed(lambda rows=rows, plan_rows=plan_rows: joins.other_copies(plan_rows, rows, "/Users/ana").filter("row_id IN (0, 7, 19999)").collect())
        spent.append(t)
        assert {(r.row_id, r.copies, r.last_copy) for r in got if r.permanode_id == "hot"} >= {(0, n - 51, False), (7, n - 51, False)}
        firsts = sorted(f"/x/{'old/' if i % 3 == 0 else ''}{i}" for i in range(n - 50))[:6]
        assert next(r for r in got if r.row_id == 7).paths == [p for p in firsts if p != "/x/7"][:5]
    assert spent[1] < 10 * spent[0] + 5


def test_other_copies_against_pairs(spark):
    rng = random.Random(3)
    roots = ["/a", "/Users/ana/Library/CloudStorage/Dropbox", "/Volumes/DropboxStorage/Dropbox", "/b"]
    claims = [(i, f"p{rng.randrange(6)}", f"{rng.choice(roots)}/{rng.randrange(4)}", rng.random() < 0.8) for i in range(120)]
    df = spark.createDataFrame(claims, "claim_id long, permanode_id string, file_path string, is_current boolean")
    plan_rows = df.select(F.col("claim_id").alias("row_id"), "permanode_id", F.col("file_path").alias("source_path")).unionByName(spark.createDataFrame([(999, "none", "/a/1")], "row_id long, permanode_id string, source_path string"))
    forms = {r.row_id: set(r.a) for r in plan_rows.select("row_id", joins.derive.path_aliases(F.col("source_path"), "/Users/ana").alias("a")).collect()}
    got = {r.row_id: (r.copies, r.paths, r.last_copy) for r in joins.other_copies(plan_rows, df, "/Users/ana", 3).collect()}
    for r in plan_rows.collect():
        others = sorted(p for _, c, p, now in claims if now and c == r.permanode_id and p not in forms[r.row_id])
        assert got[r.row_id] == (len(others), others[:3] or None, not others)


def test_canonical_claim_of_a_hot_content(spark):
    rows = hot(spark).withColumn("is_current", F.col("claim_id") != 3)
    best = joins.canonical_claim(rows)
    assert "Window" not in plan_text(best) and best.columns == rows.columns
    got = {r.permanode_id: (r.claim_id, r.tier) for r in best.collect()}
    assert got["hot"] == (7, "L1") and len(got) == 21


def test_chain_of_a_machine_in_ranges(spark):
    """One machine with nearly all rows is cut into ranges, with the same verdicts."""
    fields = ["action", "payload"]
    rows = spark.range(6000).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("s"), (F.col("id") % 700).cast("string"))).otherwise("big").alias("machine_id"), (F.col("id") * F.when(F.col("id") > 3000, 1000).otherwise(1)).alias("id"), F.lit("a").alias("action"), F.col("id").cast("string").alias("payload"))
    chained = audit.append_batch(rows.withColumn("row_hash", F.lit("")).filter("false"), rows, fields).cache()
    broken = {
        "payload": lambda i: chained.withColumn("payload", F.when(F.col("id") == i, "x").otherwise(F.col("payload"))),
        "gone": lambda i: chained.filter(F.col("id") != i),
        "link": lambda i: chained.withColumn("prev_hash", F.when(F.col("id") == i, "0" * 64).otherwise(F.col("prev_hash"))),
        "null": lambda i: chained.withColumn("prev_hash", F.when(F.col("id") != i, F.col("prev_hash"))),
    }
    cases = [chained, *[broken[k](i) for k, i in itertools.product(broken, (1, 2999, 4_321_000))]]
    for case in cases:
        one = sorted(map(tuple, audit.verify_chain(case, fields).collect()))
        many = sorted(map(tuple, audit.verify_chain(case, fields, rows=250).collect()))
        assert one == many and len(one) == 8
    assert all(ok for _, ok, *_ in map(tuple, audit.verify_chain(chained, fields).collect()))


def test_long_log_of_one_machine(spark):
    """A million rows of one machine are the work of many tasks."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("m").alias("machine_id"), "id", F.lit("a").alias("action"), F.lit("b").alias("payload"), F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")), 256).alias("row_hash"))
    linked = rows.withColumn("prev_hash", F.when(F.col("id") == 0, audit.GENESIS).otherwise(F.sha2(F.concat(F.lit("r"), (F.col("id") - 1).cast("string")), 256)))
    # hashes that fit nothing: the first row fails, all links hold
    out = audit.verify_chain(linked, ["action", "payload"], rows=50_000)
    assert tuple(out.first()) == ("m", False, 0, 0, "row_hash mismatch")


def test_rollup_of_all_levels(spark):
    """Any prefix of the stored tree equals the tree made for it, hot contents included."""
    rng = random.Random(5)
    rows = [(f"p{rng.randrange(30)}" if rng.random() < 0.6 else "hot", "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + rng.choice(["", ".x"]), rng.randrange(9), rng.random() < 0.9, rng.choice(["u", "v", None])) for _ in range(600)]
    rows += [(None, "/a/none", 3, True, "u"), ("p1", "relative/x", 1, True, None), ("hot", "/", 1, True, None)]
    claims = spark.createDataFrame(rows, "permanode_id string, file_path string, size_bytes long, is_current boolean, domain string").repartition(6)
    table = stats.path_rollup(claims, "domain").cache()
    for prefix in ("/", "/a", "/a/b/", "/c/c/c", "/b/a.x", "/nothing", "/a/a/a/a"):
        want, got = stats.path_tree(claims, prefix, overlay="domain", limit=500), stats.path_children(table, prefix, limit=500)
        assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(got.columns)).collect()))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_search_in_tiles(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)).round(1)
    x[50:60] = x[40]
    rows = [(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("nan", [float("nan")] * 6), ("zero", [0.0] * 6), ("short", [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "permanode_id string, vector array<double>")
    asked = [(i, x[i].tolist()) for i in range(0, 60, 7)] + [(1000, [1.0, 2.5])]
    queries_ = spark.createDataFrame(asked, "query_id long, query array<double>")
    got = embed.search_many(vectors, queries_, 5, metric, batch=3, block=32)
    assert "NestedLoop" not in plan_text(got)

    def distance(a, b):
        a, b = np.array(a), np.array(b)
        return float(np.sqrt(((a - b) ** 2).sum()) if metric == "l2" else 1 - (a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b)))

    fit = [(n, v) for n, v in rows if v is not None and not any(map(np.isnan, v)) and (metric == "l2" or any(v))]
    want = {(q, r): (round(d, 9), n) for q, v in asked for r, (d, n) in enumerate(sorted((distance(v, w), n) for n, w in fit if len(w) == len(v))[:5], 1)}
    found = {(r.query_id, r["rank"]): (round(r.distance, 9), r.permanode_id) for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k][0] - want[k][0]) < 1e-8 for k in want)
    assert embed.search_many(vectors.filter("false"), queries_, 5, metric).count() == 0


def test_chain_grows_in_rounds(spark, tmp_path):
    """A large batch is chained in ranges with the hashes it has as a whole, also behind
    earlier rows, with ids far apart, a machine of few rows and one without a name."""
    fields = ["action", "payload"]
    name = F.when(F.col("id") % 50 == 0, "few").when(F.col("id") % 7 != 0, "big")
    value = F.when(F.col("id") % 11 != 0, F.concat(F.lit("\x1f\u00e9"), F.col("id").cast("string")))
    rows = spark.range(3000).select(name.alias("machine_id"), (F.col("id") + F.when(F.col("id") > 2000, 10**12).otherwise(0)).cast("long").alias("id"), F.lit("a").alias("action"), value.alias("payload"))
    first, rest = rows.filter("id < 500"), rows.filter("id >= 500")
    none = rows.withColumn("row_hash", F.lit("")).filter("false")
    old = audit.append_batch(none, first, fields).cache()
    got = {r.id: (r.machine_id, r.prev_hash, r.row_hash) for r in old.unionByName(audit.append_batch(old, rest, fields, most=300)).collect()}
    tips = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        prev = tips.get(r.machine_id, audit.GENESIS)
        tips[r.machine_id] = audit.row_hash(prev, {"action": r.action, "payload": r.payload})
        assert got.pop(r.id) == (r.machine_id, prev, tips[r.machine_id])
    assert not got


def test_long_segments_in_ranges(spark):
    """A segment that is checked in ranges has the verdict it has as a whole."""
    fields = ["action", "payload"]
    rows = spark.range(1, 2001).select(F.lit("m").alias("machine_id"), "id", F.lit("a").alias("action"), F.col("id").cast("string").alias("payload"))
    log = audit.append_batch(rows.withColumn("row_hash", F.lit("")).filter("false"), rows, fields).cache()
    registry = audit.plan_segment(log, 2000, 0).withColumn("segment_id", F.lit("s")).cache()
    whole = log.withColumn("segment_id", F.lit("s"))
    text = lambda df: df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "_part" in text(audit.verify_segments(whole, registry, fields, most=100))
    at = [1, *range(90, 111), 1000, 2000]
    cases = [whole, *[whole.filter(F.col("id") != i) for i in at[::4]], *[whole.withColumn("prev_hash", F.when(F.col("id") == i, "0" * 63 + "1").otherwise(F.col("prev_hash"))) for i in at[::6]]]
    for n, case in enumerate(cases):
        assert [r.ok for r in audit.verify_segments(case, registry, fields, most=100).collect()] == [n == 0]


def test_ranges_of_a_long_chain_are_bounded(spark, monkeypatch):
    """Two ranges that are asked for are more where they would be too long."""
    monkeypatch.setattr(audit, "ROWS", 100)
    rows = spark.range(1000).select(F.lit("m").alias("machine_id"), "id", F.lit("a").alias("action"), F.lit("b").alias("payload"))
    chained = audit.append_batch(rows.withColumn("row_hash", F.lit("")).filter("false"), rows, ["action", "payload"], most=1000).cache()
    asked = []
    monkeypatch.setattr(audit, "verify_chain", lambda a, c, k, n: asked.append(n))
    audit.verify_long_chain(chained, 2, ["action", "payload"])
    assert asked == [100]


def test_many_claims_are_ranked_in_parts(spark):
    """What a task ranks is bounded by a number of claims, with the same verdicts."""
    rows = spark.range(20_000).select(F.lit("m").alias("machine_id"), (F.col("id") % 7000).cast("string").alias("file_path"), F.when(F.col("id") % 3 == 0, "z").alias("container_path"), (F.col("id") % 11).alias("scan_run_id"), F.col("id").alias("claim_id"))
    parts = stats.supersede_claims(rows, most=1000)
    assert max(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()) < 2000
    current = lambda df: {r.claim_id for r in df.filter("is_current").collect()}
    assert current(parts) == current(stats.supersede_claims(rows))
