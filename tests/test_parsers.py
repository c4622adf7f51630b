from pyspark.sql import functions as F

from ziplore.functions import parsers
from ziplore.operators.results import analyse_files


def run(spark, function, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = dict(df.select("id", function(F.col("t")).alias("s")).collect())
    return [got[i] for i in range(len(texts))]


def test_json(spark):
    cases = {
        '{"b": 1, "a": 2}': "JSON with keys: b, a",
        '{"a":1,"b":1,"c":1,"d":1,"e":1,"f":1}': "JSON with keys: a, b, c, d, e",
        '["x", "y"]': "JSON with keys: x, y",
        '"word"': "JSON with keys: w, o, r, d",
        "[1, 2]": None, "3": None, "null": None, "{}": "JSON with keys: ", "[]": "JSON with keys: ",
        '{"a": 1, "a": 2}': "JSON with keys: a",
        '{"a": 1} junk': None, '{"a": NaN}': "JSON with keys: a", "{'a': 1}": None, "\ufeff{}": None, "": None,
        '{"\\ud800": 1}': "JSON with keys: ?",
    }
    assert run(spark, parsers.json_key_summary, cases) == list(cases.values())


def test_yaml(spark):
    cases = {
        "a: 1\nb: 2\n": "YAML with keys: a, b", "- x\n- y\n": "YAML with keys: x, y", "plain": "YAML with keys: p, l, a, i, n",
        "": None, "1: x\n": None, "a: 1\n---\nb: 2\n": None, "a: [": None, "a: !!python/object:os.x {}\n": None,
    }
    assert run(spark, parsers.yaml_key_summary, cases) == list(cases.values())


def test_python(spark):
    many = "".join(f"class C{i}: pass\ndef f{i}(): pass\n" for i in range(5))
    cases = {
        "": "Python", "x = 1\n": "Python", "async def g(): pass\n": "Python",
        many: "Python; classes=C0, C1, C2; funcs=f0, f1, f2",
        "def f():\n    def inner(): pass\n": "Python; funcs=f",
        "class A:\n    def m(self): pass\n": "Python; classes=A",
        "x\x00": None, " x = 1\n y": None, "def (": None, "\ufeffx = 1": None, "x = '\\d'\n": "Python",
        "(" * 100_000: None,
    }
    assert run(spark, parsers.python_summary, cases) == list(cases.values())


def analyse(spark, rows, **options):
    df = spark.createDataFrame(rows, "ext string, text string")
    return [(r.kind, r.summary) for r in analyse_files(df, **options).collect()]


def test_kind_falls_through_to_text(spark):
    rows = [(".json", "{bad. Really"), (".py", "def (. x"), (".yml", ""), (".png", "x"), (".md", "# Title"), (".yaml", "k: 1")]
    assert analyse(spark, rows) == [
        ("text", "{bad."), ("text", "def (."), ("text", ""), ("asset", "(binary skipped)"), ("text", "Title"),
        ("yaml", "YAML with keys: k"),
    ]


def test_custom_analyzers_come_first(spark):
    def toml(text):
        return ("config", "table") if text.startswith("[") else None

    def broken(text):
        raise ValueError

    rows = [(".toml", "[a]"), (".toml", "x = 1"), (".json", '{"k": 1}'), (".md", "hi")]
    got = analyse(spark, rows, analyzers={".toml": toml, ".json": broken})
    assert got == [("config", "table"), ("text", "x = 1"), ("json", "JSON with keys: k"), ("text", "hi")]
