"""Work is dealt over tasks whatever the files, and what a row takes is done once."""

import numpy as np
from pyspark.sql import functions as F

from graindex.functions import brewing
from graindex.operators import browse, steps
from graindex.operators import similarity as S
from graindex.sources import documents

XML = "<RECIPES><RECIPE><NAME>a</NAME><OG>1.05</OG><FG>1.01</FG><IBU>30</IBU><COLOR>4</COLOR><HOPS><HOP><NAME>h</NAME><USE>Dry Hop</USE></HOP></HOPS></RECIPE><RECIPE><NAME>b</NAME><OG>1.9</OG></RECIPE></RECIPES>"


def test_heavy_rows_of_one_partition_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(steps, "DEALT", 5)
    rows = spark.range(40).coalesce(1)
    xml, _ = documents.import_xml(rows.withColumn("x", F.lit(XML)), "x")
    json, _ = brewing.import_json(rows.withColumn("x", F.lit('{"name":"a","og":1.05,"fg":1.01,"ibu":9,"srm":3}')), "x")
    page = documents.parse_recipe_page(rows.withColumn("x", F.lit("<title>t</title>")), "id", "x")
    for got in (xml, json, page):
        assert got.count() == 40 and got.rdd.getNumPartitions() == 9


def test_a_document_is_read_once_for_all_its_texts(spark):
    good, bad = documents.import_xml(spark.createDataFrame([(1, XML), (2, XML.replace("<FG>1.01</FG>", "")), (3, "no")], "n int, x string"), "x")
    r = good.first()
    assert (r.n, r.name, r.vitals.og, r.vitals.ibu, r.style, [h.stage for h in r.hops]) == (1, "a", 1.05, 30, "", ["dry"]) and sorted(b.n for b in bad.collect()) == [2, 3]
    plan = good.select("vitals", "name", "style")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xpath_string(") + plan.count("XPathString") == 1
    json, _ = brewing.import_json(spark.createDataFrame([("{}",)], "x string"), "x")
    assert json._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_capitals_first(spark):
    want = ["APPLE", "apple", "äpple", "Boy", "boy"]
    df = spark.createDataFrame([(n,) for n in sorted(want, reverse=True)], "n string")
    assert [r.n for r in df.orderBy(*browse.name_order("n", capitals_first=True)).collect()] == want


def test_blocks_of_silhouettes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "SIDES", 2)
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(90, 3)), rng.integers(0, 4, 90)
    label[0] = 9  # a cluster of one
    rows = spark.createDataFrame([(i, [float(c) for c in v], int(n)) for i, (v, n) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {}
    for i in range(1, 90):
        a = d[i][(label == label[i]) & (np.arange(90) != i)].mean()
        b = min(d[i][label == n].mean() for n in set(label.tolist()) - {label[i]})
        want[i] = (b - a) / max(a, b)
    got = S.silhouettes(rows, "id", "v", "label")
    assert {r.id: round(r.silhouette, 9) for r in got.collect()} == {i: round(s, 9) for i, s in want.items()}
    assert "hashpartitioning(i#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 4)" in plan


def test_alike_rows_enter_a_tree_once(spark):
    rows = spark.createDataFrame([("a", "x", "1"), ("a", "x", "1"), ("a", "y", "2"), (None, "y", None)], "t string, m string, l string")
    each = rows.groupBy("t", "m").agg(F.max("l").alias("l"), F.count(F.lit(1)).alias("k"))
    got = sorted((tuple(r) for r in browse.tree(each, ["t", "m"], "l", "k").collect()), key=str)
    assert got == sorted((tuple(r) for r in browse.tree(rows, ["t", "m"], "l").collect()), key=str)


def test_lines_are_dealt_by_order(spark, monkeypatch):
    from graindex.plans import bills, tables

    monkeypatch.setattr(tables, "ORDER_LINES", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = bills.class_by_family(spark, "/root/testdata/sf0.001")
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    # by order, then by the result's keys: nothing is shuffled by order and type in between
    assert "hashpartitioning(l_orderkey#" in plan and f", {1 + lines // 1000})" in plan and "hashpartitioning(o_orderpriority#" in plan
    assert not [x for x in plan.splitlines() if "Exchange" in x and "o_orderpriority" in x and "l_orderkey" in x]


def test_equal_items_and_boxes_meet_once(spark, monkeypatch):
    from graindex.operators import boxes

    met = []
    monkeypatch.setattr(boxes, "_met", lambda asked, held, *more, real=boxes._met: met.append((asked.count(), held.count())) or real(asked, held, *more))
    items = spark.createDataFrame([(i, [1.0, 5.0, None][i % 3]) for i in range(90)], "id int, x double")
    ranges = spark.createDataFrame([(f"b{i}", float(i % 2 * 4), float(i % 2 * 4 + 2)) for i in range(20)], "name string, x_lo double, x_hi double")
    got = {r.id: (r.name, r.inside, r.off) for r in boxes.best_fit_many(items, "id", ranges, ["x"], "name").collect()}
    assert got == {i: [("b0", 1, 0.0), ("b1", 1, 0.0), (None, None, None)][i % 3] for i in range(90)}
    assert met[0] == (2, 2)
