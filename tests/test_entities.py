import json

from pyspark.sql import functions as F

from trailmetric.operators import entities


def found(spark, content=None, tool=None, arguments=None, answer=None):
    text = arguments if arguments is None or isinstance(arguments, str) else json.dumps(arguments)
    frame = spark.createDataFrame([(content, tool, text, answer)], "c string, t string, a string, o string")
    return frame.select(entities.step_entities(*map(F.col, "ctao")).alias("e")).first().e


def test_texts(spark):
    assert found(spark, "see `parse_it` at line 12 of /srv/app/main.py") == ["/srv/app/main.py", "line 12", "parse_it", "srv/app/main.py"]
    assert found(spark, "class Walker calls endpoint: lookup, result = 1234.5") == ["1234.5", "Walker", "lookup"]
    assert "https://example.org/a(b" in found(spark, "fetch https://example.org/a(b)")


def test_noise_goes(spark):
    assert found(spark, "`command` `Null` `ab` '1234567' '123456'") == ["123456"]
    assert found(spark, "/function/x /tmp /usr") == []
    assert found(spark) == found(spark, "", "", "", "") == found(spark, arguments="[1]") == found(spark, arguments='{"a": ') == []


def test_tool_parts(spark):
    assert found(spark, tool="api_diet_data_for_the_gym") == ["api_diet_data_for_the_gym", "diet"]


def test_arguments_are_walked_three_levels_down(spark):
    level = {"name": "level_three", "below": {"name": "level_four"}}
    assert found(spark, arguments={"a": {"name": "level_one", "b": {"name": "level_two", "c": level}}}) == ["level_one", "level_three", "level_two"]
    assert found(spark, arguments={"list": [{"query": "who was it"}, ["no_list.py"], 7, "yes.py"]}) == ["who was it", "yes.py"]
    assert found(spark, arguments={"list": [f"f{i:03}.py" for i in range(12)]}) == [f"f{i:03}.py" for i in range(10)]
    assert found(spark, arguments={"other": "plain words", "query": "plain words"}) == ["plain words"]


def test_limits_of_paths(spark):
    """A text whose paths reach its limit gives them alone."""
    many = " ".join(f"a{i:03}.py" for i in range(60)) + " `named_one`"
    assert found(spark, many) == [f"a{i:03}.py" for i in range(50)]
    assert found(spark, arguments={"x": many}) == [f"a{i:03}.py" for i in range(10)]
    assert "named_one" in found(spark, " ".join(["one.py"] * 60) + " `named_one`")


def test_long_answers_are_not_read(spark):
    assert found(spark, answer="`answer_name`" + " " * 1986) == ["answer_name"] and found(spark, answer="`answer_name`" + " " * 1987) == []


def test_many_segments(spark):
    """A path of very many segments neither overflows the stack nor stays as an entity."""
    assert found(spark, "/ab" * 30000) == [] and found(spark, "a" * 100000 + " a_for_b") == ["a_for_b"]
    assert found(spark, "ab/" * 30000 + "c.py and x/y.py/z") == ["/y.py/z", "x/y.py"]


def test_paths_match_as_the_plain_patterns_do(spark):
    import random
    import re

    draw = random.Random(7)
    texts = ["".join(draw.choice("ab.-/\\ C:_\u00e9") for _ in range(draw.randrange(50))) for _ in range(2000)]
    patterns = [re.compile(p.replace(r"\p{L}\p{N}_", r"\w")) for p in entities.PATHS]
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", entities._paths(F.col("t")).alias("p")).collect():
        assert row.p == [m.group(0) for p in patterns for m in p.finditer(row.t)]
