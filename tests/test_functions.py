"""Column expressions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from specloom.functions.json_values import with_strict_json
from specloom.functions.parameters import parameter_type
from specloom.functions.text import with_clean_text
from specloom.functions.urls import _USUAL, path_template, with_url_parts
from specloom.operators.records import status_code


def one_column(spark, values, name="value"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def results(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("i").collect()]


def test_clean_lines(spark):
    cases = {
        r'{\"a\":\"b\"}': '{"a":"b"}',
        r'2024-01-01T00:00:00.1Z stdout F {\"a\":1}': '{"a":1}',
        '2024-01-01T00:00:00.123456789Z stderr F \t {}': "{}",
        "2024-01-01T00:00:00Z stdout F {}": "2024-01-01T00:00:00Z stdout F {}",
        r'{\"a\":1} tail': '{"a":1}',
        r'{\"a\":{\"b\":1}} } x': '{"a":{"b":1}} }',
        "plain": "plain",
        "": "",
        "a\tb": "a\tb",
        "{}\r": "{}",
        r"\x41\101\u0041\U00000041\a\v": "AAAA\x07\x0b",
        r"\xC4\x90": "Đ",
        r"\xff": "\ufffd",
        r"\\x41": r"\x41",
        r"\\\x41": r"\A",
        r"\\u00e9 \\/": r"\u00e9 \/",
        r"\u00e9": "é",
        r'{\"a\":\n1}': '{"a":\n1}',
        r'{\"a\":1}\n}': '{"a":1}',
    }
    df = with_clean_text(one_column(spark, list(cases)))
    assert results(df, "text") == [(v,) for v in cases.values()]
    refused = {
        'a"b': "bad escape",
        'a","b': "bad escape",
        r"\/": "bad escape",
        r"\'": "bad escape",
        r"\q": "bad escape",
        r"\400": "bad escape",
        r"\x4": "bad escape",
        r"\ud83d\ude00": "bad escape",
        r"\U00110000": "bad escape",
        "\\": "bad escape",
        "x Content-Type: image/png": "image content",
        "debug.lua": "gateway debug",
        "GET /config?check_hash=1": "gateway config",
        "content-type: image": None,
        "x" * 40: "line too long",
    }
    df = with_clean_text(one_column(spark, list(refused)), max_line_bytes=40)
    assert results(df, "clean_reason") == [(v,) for v in refused.values()]


def test_invalid_utf8_is_repaired(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a\xffb\n\xe2\x82c\n")
    df = with_clean_text(spark.read.option("lineSep", "\n").text(str(tmp_path / "x.txt")))
    assert sorted(r.text for r in df.collect()) == ["a\ufffdb", "\ufffdc"]


def test_receive_time(spark):
    df = with_clean_text(one_column(spark, ["2024-01-01T00:00:01.5Z stdout F {}", "{}", "9 {}"]))
    assert results(df.withColumn("t", F.unix_micros("receive_time")), "t", "extractable") == [
        (1704067201500000, True), (None, True), (None, False),
    ]


def test_strict_json(spark):
    accepted = {
        "{}": "{}", " [1] \n": "[1]", "null": "null", "3": "3", '"x"': '"x"',
        '{"a":1,"a":"s"}': '{"a":"s"}', '{"a":"1e400"}': '{"a":"1e400"}', "1e300": None,
    }
    df = with_strict_json(one_column(spark, list(accepted)), "value", "v")
    got = [r[0] for r in results(df.withColumn("t", F.to_json("v")), "t")]
    assert [g if e is not None else None for g, e in zip(got, accepted.values())] == list(accepted.values())
    assert got[-1] is not None
    refused = [
        "", "{} x", "1,2", "{}] [{}", '{"a":1e400}', "[" + "9" * 400 + "]", "{'a':1}", "[1,]", "{", "NaN",
        '1,"~"] x', "01", '{"a":1' + "0" * 250 + 'e99}', '[1.5E308, 2e308]', '{"a":-1' + "0" * 309 + "}",
    ]
    df = with_strict_json(one_column(spark, refused), "value", "v")
    assert results(df.withColumn("n", F.col("v").isNull()), "n") == [(True,)] * len(refused)


URLS = {
    "https://api.sample.test:8443/store/items/77?sort=asc#top": ("api.sample.test", "/store/items/77"),
    "http://h": ("h", ""),
    "http://h?x=1": ("h", ""),
    "http://h/a%20b+c": ("h", "/a b+c"),
    "http://h/a#frag%20": ("h", "/a"),
    "http://h/a#bad%zz": ("", ""),
    "http://h/a%zz": ("", ""),
    "http://h/a?q=%zz": ("h", "/a"),
    "http://user:pw@h:80/a": ("h", "/a"),
    "http://us er@h/a": ("", ""),
    "http://h:80x/a": ("", ""),
    "http://h:/a": ("h", "/a"),
    "http://[::1]:80/a": ("[", "/a"),
    "http://[::1/a": ("", ""),
    "http://h%41/a": ("", ""),
    "http://h h/a": ("", ""),
    "http://h/a\tb": ("", ""),
    "/only/path?x": ("", "/only/path"),
    "//h/p": ("h", "/p"),
    "///p": ("", "///p"),
    "x:///p": ("", "/p"),
    "mailto:someone": ("", ""),
    "a:b/c": ("", ""),
    "rel/a:b": ("", "rel/a:b"),
    "1a:b": ("", ""),
    ":x": ("", ""),
    "*": ("", "*"),
    "": ("", ""),
    "#f": ("", ""),
}


def test_url_parts(spark):
    df = with_url_parts(one_column(spark, list(URLS)), F.col("value"))
    got = dict(zip(URLS, results(df, "host", "path")))
    assert got == URLS


UUID = "0f9d31c2-77aa-4c1e-8b40-5d2a6f00be19"
PATHS = {
    "/store/items/77": "/store/items/{id}",
    f"/store/{UUID}/tags": "/store/{uuid}/tags",
    "/store/items/6:hide": "/store/items/{id}:hide",
    "": "",
    "//": "//",
    "/a/": "/a/",
    "/ 8": "/ 8",
    "/+7/-5/007": "/{id}/{id}/{id}",
    "/9223372036854775807/9223372036854775808": "/{id}/9223372036854775808",
    "/" + UUID.replace("-", ""): "/{uuid}",
    "/" + UUID.upper(): "/{uuid}",
    "/{" + UUID + "}": "/{uuid}",
    "/(" + UUID + "]": "/{uuid}",
    "/é" + UUID + "}": "/é" + UUID + "}",
    "/" + "1" * 32: "/{uuid}",
    f"/urn:uuid:{UUID}": "/urn:uuid:{uuid}",
    "/1:2:x/:": "/{id}:{id}:x/:",
    "/1\n": "/1\n",
    "/١": "/١",
    "/1.5/1_0/0x1": "/1.5/1_0/0x1",
}


def test_usual_urls_are_matched_once(spark):
    cases = {
        "http://h": ("h", ""),
        "http://h:80": ("h", ""),
        "http://h:?a=b": ("h", ""),
        "http://h?a=/b:c://d?e": ("h", ""),
        "http://h/?a": ("h", "/"),
        "https://gw.example.com:443/v1/x:confirm?u=http://o/p": ("gw.example.com", "/v1/x:confirm"),
        "a+b.c-d://h/x://y:1//z": ("h", "/x://y:1//z"),
        "http:///only/path": ("", "/only/path"),
        "http://:8/p": ("", "/p"),
        "http://h/é/😀/ü?q=😀": ("h", "/é/😀/ü"),
    }
    df = one_column(spark, list(cases))
    found = with_url_parts(df.withColumn("usual", F.col("value").rlike(_USUAL)), F.col("value"))
    assert all(r.usual for r in found.collect())
    assert {r.value: (r.host, r.path) for r in found.collect()} == cases
    plan = found.drop("usual")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(value" not in plan


def test_numbers_of_very_many_digits(spark):
    fits = ["[0." + "9" * 400 + "]", "[1" + "0" * 308 + "]", "[12." + "1" * 308 + "]", "[0.e1]".replace(".", ".0"), "[" + "9" * 308 + "]"]
    beyond = ["[2" + "0" * 308 + "]", "[" + "9" * 309 + "]", "[-" + "9" * 309 + ".5]", "[1e400]", "[0.1E+400]"]
    found = with_strict_json(one_column(spark, fits + beyond), "value", "v").select("value", F.col("v").isNull().alias("refused"))
    assert {r.value: r.refused for r in found.collect()} == {**dict.fromkeys(fits, False), **dict.fromkeys(beyond, True)}


def test_path_template(spark):
    df = one_column(spark, list(PATHS)).withColumn("t", path_template(F.col("value")))
    assert dict(zip(PATHS, [r[0] for r in results(df, "t")])) == PATHS


def test_parameter_type(spark):
    names = {
        "limit": "integer", "offset": "integer", "skip": "integer", "page": "integer", "size": "integer",
        "1": "boolean", "0": "boolean", "t": "boolean", "TRUE": "boolean", "tRUE": "string",
        "12": "integer", "-3": "integer", "q": "string", "": "string", "Limit": "string",
    }
    df = one_column(spark, list(names)).withColumn("t", parameter_type(F.col("value")))
    assert dict(zip(names, [r[0] for r in results(df, "t")])) == names


@pytest.mark.parametrize(
    "text, code",
    [("200", 200), ('"200"', 200), ('"200.0"', 200), ('"200.5"', 0), ('" 200"', 0), ("200.7", 200),
     ("-200.7", -200), ("true", 1), ("null", 0), ('"x"', 0), ("{}", 0)],
)
def test_status_code(spark, text, code):
    df = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("v"))
    assert df.select(status_code(F.col("v"))).first()[0] == code
