from pyspark.sql import functions as F

from larkspur.functions.hashing import fnv1a_bucket, fnv1a_hex
from larkspur.functions.json import field_value
from larkspur.functions.text import sanitized, tokens
from larkspur.functions.vectors import dot, quantized


def _one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], names).select(column).first()[0]


def test_tokens_keep_order_and_repeats(spark):
    assert _one(spark, tokens(F.col("t")), t="One two, TWO-three") == ["one", "two", "two", "three"]
    assert _one(spark, tokens(F.col("t")), t="CAFÉ Straße ½") == ["café", "straße", "½"]
    assert _one(spark, tokens(F.col("t")), t=" .,") == []


def test_fnv_vectors(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), ("straße",)], "t string").select("t", fnv1a_hex(F.col("t")), fnv1a_bucket(F.col("t"), 384)).collect()

    def plain(data: bytes) -> int:
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h

    assert [(r[1], r[2]) for r in rows] == [(f"{plain(r[0].encode()):016x}", plain(r[0].encode()) % 384) for r in rows]
    assert rows[1][1] == "af63dc4c8601ec8c"


def test_quantized_rounds_half_away_from_zero(spark):
    assert _one(spark, quantized(F.col("v")), v=[2.0, -2.0, 0.5 / 127, -0.5 / 127, 0.0]) == [127, -127, 1, -1, 0]
    assert _one(spark, dot(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 11.0


def test_only_json_strings_count(spark):
    doc = '{"a.b": "flat", "a": {"b": "deep", "c": "path"}, "n": 5, "d.e": 1, "d": {"e": "kept"}}'
    value = lambda f: _one(spark, field_value(F.parse_json("j"), f), j=doc)
    assert [value(f) for f in ("a.b", "a.c", "n", "none", "d.e")] == ["flat", "path", None, None, "kept"]


def test_sanitized(spark):
    assert _one(spark, sanitized(F.col("t")), t="a b/ü.png") == "a_b___png"
