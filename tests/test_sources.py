import pytest

from tessera.sources.nodes import BAD_ID, PointParser, StringParser, make_parser, point_lines, register_parser


def parsed(spark, parser, *lines):
    return sorted(map(tuple, parser.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()))


def test_two_records_in_a_line(spark):
    line = '<node id="1" lat="2.5" lon="3"/><node id="2" lat="-4" lon="5e1" v="x"/>'
    assert parsed(spark, PointParser(), line) == [(1, 3.0, 2.5), (2, 50.0, -4.0)]


@pytest.mark.parametrize("bad", ["x", "99999999999999999999", "", " 12", "1.0"])
def test_unreadable_ids(spark, bad):
    assert parsed(spark, PointParser(), f'<node id="{bad}" lat="1" lon="2"/>') == [(BAD_ID, 2.0, 1.0)]


def test_lines_without_records(spark):
    assert parsed(spark, PointParser(), "</node>", '<way id="1">', "", None, '<node id="1" lat="2"/>') == []


def test_any_text_node_starts_a_record(spark):
    assert parsed(spark, PointParser(), '<member type="node" id="7" lat="1" lon="2') == [(7, 2.0, 1.0)]


def test_bad_coordinates(spark):
    line = '<node id="1" lat="abc" lon="2"/>'
    assert parsed(spark, PointParser("permissive"), line) == []
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        parsed(spark, PointParser(), line)
    with pytest.raises(ValueError):
        PointParser("lenient")


def test_strings_in_lower_case(spark):
    assert parsed(spark, StringParser(), '<node id="1" str="Black"/><node id="+2" str=""/>') == [(1, "black"), (2, "")]


def test_round_trip(spark):
    rows = [(i, i / 7 - 100, 89.9 - i / 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert sorted(map(tuple, PointParser().parse(point_lines(df)).collect())) == rows


def test_registry(spark):
    class Twice(StringParser):
        pass

    register_parser("Twice", Twice)
    assert isinstance(make_parser("Twice"), Twice)
    with pytest.raises(ValueError, match="no parser"):
        make_parser("none")


def test_one_record_a_line(spark):
    lines = ["7\t1.5\t-2", "x\t3\t4", "8\tno\t4", "9\t1", "", None, "10\t5\t6\tmore"]
    assert parsed(spark, make_parser("Fields"), *lines) == [(7, 1.5, -2.0), (10, 5.0, 6.0), (BAD_ID, 3.0, 4.0)]
    assert parsed(spark, make_parser("Fields", separator=","), "1,2,3") == [(1, 2.0, 3.0)]


def test_hash_codes(spark):
    """32-bit arithmetic that wraps round."""
    from pyspark.sql import functions as F

    from tessera.functions import strings as S

    def wrap(v):
        return (v + 2**31) % 2**32 - 2**31

    words, numbers = ["", "a", "polygenelubricants", "zzzzzzzzzzzzzzzz", "é中"], [0, 1, -1, 2**40 + 7, -(2**63)]
    df = spark.createDataFrame(list(zip(words, numbers)), "s string, n long")
    got = df.select("s", "n", S.string_hash(F.col("s")).alias("a"), S.long_hash(F.col("n")).alias("b"), S.pair_hash(S.string_hash(F.col("s")), S.long_hash(F.col("n"))).alias("c")).collect()
    for r in got:
        a = 0
        for c in r["s"]:
            a = wrap(31 * a + ord(c))
        u = r["n"] % 2**64
        b = wrap((u ^ (u >> 32)) % 2**32)
        assert (r["a"], r["b"], r["c"]) == (a, b, wrap((a + b) * b + a))
