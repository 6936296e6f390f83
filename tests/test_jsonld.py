"""Findings by column expressions against the Python walks, over blocks of all shapes; Python sees few of them."""

import json
import random

from pyspark.sql import functions as F

from auditmill.operators import jsonld

ODD = [
    None, "", " ", "null", "1", '"x"', "[]", "{}", "{", '{"@type":"Person","name":"x"} y', '{"@type":"HowTo"}]', '{"@type":"HowTo"}}', '{"@type":"HowTo"},{"@type":"HowTo"}', '{"@type":"HowTo"},"k":2',
    '{"@type":"HowTo","@type":"Person","name":"n"}', '{"@type":"Person","name":NaN}', '{"@type":["Person",3,null,"HowTo"],"name":[]}', '{"@type":"Product","offers":{}}', '{"@type":"Product","offers":[{}, 3, {"@type":"AggregateOffer","lowPrice":0}]}',
    '{"@type":"Product","offers":"free","name":{},"image":false}', '{"@type":"","name":"a"}', '{"@graph":{"@type":"HowTo"}}', '{"@graph":[],"@type":"Person"}', '{"@graph":[[{"@type":"HowTo"}],{"@graph":[{"@type":"FAQPage"}]}]}',
    '[[[[[{"@type":"HowTo"}]]]]]', '{"@type":"Person","name":"\\u0054ODO"}', '{"@type":"Person","name":"a\\ntodo"}', '{"@type":"Person","name":["x",{"y":"[Your Name]"}]}', '{"@type":"Person","name":"photodocument"}', '\n {"@type" : "Event"}\t',
    '{"@type":"Person","name":"' + "long " * 40_000 + '"}', '{"@type":"Person","name":"\\ud83d"}', "[" * 1200 + "]" * 1200, '{"@graph":[' * 900 + '{"@type":"HowTo"}' + "]}" * 900, "[" * 300_000,
]


def block(rnd, depth=0):
    roll = rnd.random()
    if depth > 4 or roll < 0.25:
        return rnd.choice([None, "", "x", 0, 1.5, True, "fixme", "ReplaceMe", "replace_me", [], {}])
    if roll < 0.45:
        return [block(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    kinds = [*jsonld.REQUIRED, *jsonld.DEPRECATED, "AggregateOffer", ""]
    item = {"@type": rnd.choice([rnd.choice(kinds), rnd.choice(kinds), [rnd.choice(kinds), rnd.choice(kinds)], 7])} if rnd.random() < 0.8 else {}
    for name in rnd.sample(["@context", "@graph", "name", "image", "offers", "price", "lowPrice", "priceCurrency", "url", "author"], rnd.randint(0, 6)):
        item[name] = block(rnd, depth + 1)
    return item


def flat(found):
    return sorted(tuple(f[n] for n in ("rule", "severity", "type", "field", "value", "points")) for f in found)


def test_expressions_find_what_walks_find(spark):
    rnd = random.Random(4)
    texts = ODD + [json.dumps(block(rnd)) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    for gate, walk in ((False, jsonld.validate), (True, jsonld.lint)):
        got = {r.id: flat(r.found) for r in jsonld.with_findings(rows, gate).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert got[i] == flat(walk(t)), (t or "")[:300]


def test_python_sees_what_variant_cannot_read(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, raw string")
    read = {r.id for r in rows.where(jsonld.parsed(F.col("raw")).isNotNull()).collect()}

    def whole(t):
        try:
            return json.loads(t or "", object_pairs_hook=lambda p: dict(p) if len(dict(p)) == len(p) else 1 / 0, parse_constant=lambda _: 1 / 0) is not None
        except (ValueError, ZeroDivisionError, RecursionError):
            return False

    assert read >= {i for i, t in enumerate(ODD) if whole(t) and len(t) < 2000} and all(whole(ODD[i]) or ODD[i].strip() == "null" for i in read)


def test_present_fields(spark):
    raw = '{"a":"","b":null,"c":[],"d":{},"e":0,"f":"x","g":false}'
    got = spark.createDataFrame([(raw,), ("{",), (None,)], "raw string").select(jsonld.present_fields(F.col("raw")).alias("p")).collect()
    assert sorted(got[0].p) == ["c", "d", "e", "f", "g"] and got[1].p is None and got[2].p is None
