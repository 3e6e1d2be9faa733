import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.functions import temporal, text, vector
from memspark.operators import resolve


def one(spark, value, schema, column):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first().x


def test_cosine_normalize_and_pool(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(vector.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == pytest.approx([0, 1, 0])
    assert df.select(vector.normalize(F.col("a")).alias("n")).collect()[1].n == pytest.approx([0.6, 0.8])
    assert one(spark, [[1.0, 2.0], [3.0, 6.0]], "v array<array<float>>", vector.mean_pool(F.col("v"))) == [2, 4]


def test_hash_embedding(spark):
    assert vector.fnv1a(b"") == 0xCBF29CE484222325 and vector.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    v = vector.hash_vectors(["a", "b", "a"], 32)
    assert np.array_equal(v[0], v[2]) and not np.array_equal(v[0], v[1]) and np.allclose((v * v).sum(1), 1, atol=1e-5)
    state = vector.fnv1a(b"a")
    for k, s in ((0, 13), (1, 7), (0, 17)):
        state ^= (state << s if k == 0 else state >> s) & (2**64 - 1)
    assert np.sign(v[0][0]) == np.sign(state / 2**64 * 2 - 1)
    assert one(spark, "a", "t string", vector.fnv1a_hex(F.col("t"))) == "af63dc4c8601ec8c"


@pytest.mark.parametrize("value, tokens", [("", 0), ("abcd", 1), ("abcde", 2), ("éé", 1), ("ééé", 2)])
def test_tokens_are_bytes(spark, value, tokens):
    assert one(spark, value, "t string", text.token_estimate(F.col("t"))) == tokens


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("electrical", "electr"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky"), ("a", "a")])
def test_stems(word, stem):
    assert text.porter(word) == stem


def test_answers(spark):
    df = spark.createDataFrame([("The cat, sat!", "a CAT sat"), ("", ""), ("x", ""), ("a b b", "b c")], "p string, t string")
    got = df.select(text.normalize_answer(F.col("p")).alias("n"), text.token_f1(F.col("p"), F.col("t")).alias("f")).collect()
    assert [r.n for r in got] == ["cat sat", "", "x", "b b"] and [r.f for r in got] == pytest.approx([1, 1, 0, 0.5])


@pytest.mark.parametrize("reply, found", [('{"a": 1}', '{"a": 1}'), ('x ```json\n[1, 2]\n``` y', "[1, 2]"), ('so: {"a": "}", "b": [1]} end', '{"a": "}", "b": [1]}'), ("[1, {", None), ("none", None), (None, None), ('{"a": "\\"}"} {', '{"a": "\\"}"}'), ("{bad} {\"a\":1}", None)])
def test_json_salvage(reply, found):
    assert text.salvage_json(reply) == found


def test_texts(spark):
    df = spark.createDataFrame([("  x ", "llm", "API error (404): no"), (" ", "llm", "api error (429)"), ("yes, ok", "rate_limit", ""), ("abcdef", "storage", "x"), ("n", "llm", "Failed to parse OpenAI response")], "t string, kind string, m string")
    got = df.select(text.blank_to_null(F.col("t")).alias("b"), text.says_yes(F.col("t")).alias("y"), text.truncated(F.col("t"), 3).alias("c"), text.is_fatal_error(F.col("kind"), F.col("m")).alias("f")).collect()
    assert [r.b for r in got] == ["x", None, "yes, ok", "abcdef", "n"] and [r.y for r in got] == [False, False, True, False, False]
    assert got[3].c == "abc..." and [r.f for r in got] == [True, False, False, True, True]
    msg = df.limit(1).select(text.extraction_message(F.lit("c"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"), F.lit(None).cast("string"), F.lit("p")).alias("x")).first().x
    assert msg == "## Preceding Context\n\np\n\n---\n\n## Content to Extract From\n\nc\n\nTimestamp: 2024-01-02T03:04:05+00:00"
    assert df.limit(1).select(text.directives_text(F.array(F.lit("a"), F.lit("b"))).alias("x")).first().x == "Hard rules (never violate):\n1. You MUST: a\n2. You MUST: b"
    assert df.limit(1).select(text.json_keys_ok(F.lit('{"a": 1, "b": 2}'), ["a"]).alias("x")).first().x is False


def test_ranges_and_proximity(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    none = t(None)
    row = spark.range(1).select(
        temporal.overlaps(t("2024-01-01"), t("2024-01-05"), t("2024-01-05"), none).alias("a"), temporal.overlaps(t("2024-01-06"), none, none, t("2024-01-05")).alias("b"),
        temporal.overlaps(none, none, t("2024-01-01"), t("2024-01-02")).alias("c"), temporal.contains(none, t("2024-01-05"), t("2024-01-05")).alias("d"),
        temporal.proximity(t("2024-01-01"), t("2024-01-03"), t("2024-01-12"), t("2024-01-12"), t("2024-02-01")).alias("e"), temporal.proximity(none, none, t("2024-02-01 12:00:00"), none, t("2024-02-01")).alias("f"),
        temporal.session_date(F.lit("1:56 pm on 8 May, 2023")).cast("string").alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (True, False, True, True) and row.e == pytest.approx(1 / 1.1) and row.f == 1 and row.g == "2023-05-08 13:56:00"


FOX = "The quick brown fox jumps over the lazy dog. " * 30


def test_chunk_goldens():
    assert resolve.spans("word " * 200, 50, 5) == [(0, 200), (180, 380), (360, 560), (540, 740), (720, 920), (900, 1000), (980, 1000)]
    assert resolve.spans(FOX, 100, 10) == [(0, 360), (321, 720), (681, 1080), (1041, 1350), (1311, 1350)]
    assert resolve.spans("short", 100, 10) == [(0, 5)]


@given(st.text(alphabet="aé. \n", min_size=0, max_size=400), st.integers(3, 40), st.integers(0, 2))
@settings(max_examples=100, deadline=None)
def test_chunks_cover_a_text_at_characters(value, most, overlap):
    data = value.encode()
    at = resolve.spans(value, most, overlap)
    assert at[0][0] == 0 and at[-1][1] == len(data) and all(b[0] <= a[1] for a, b in zip(at, at[1:]))
    for a, b in at:
        data[a:b].decode()
    assert "".join(c["content"] for c in resolve.chunks_of("", 5, 1)) == ""


# Phrases and what they mean at 2026-02-25 12:00:00, and reference dates and their instants.
PHRASES = {
    "what happened recently?": ("2026-02-18 12:00:00", "2026-02-25 12:00:00"), "plans for today": ("2026-02-25 00:00:00", "2026-02-25 12:00:00"),
    "what did I do yesterday": ("2026-02-24 00:00:00", "2026-02-24 23:59:59"), "in the last month": ("2026-01-26 12:00:00", "2026-02-25 12:00:00"), "last year": ("2025-02-25 12:00:00", "2026-02-25 12:00:00"),
    "in December": ("2025-12-01 00:00:00", "2025-12-31 23:59:59"), "back in january": ("2026-01-01 00:00:00", "2026-01-31 23:59:59"),
    "2026-01-15 to 2026-01-20": ("2026-01-15 00:00:00", "2026-01-20 23:59:59"), "on 2026-01-15": ("2026-01-15 00:00:00", "2026-01-15 23:59:59"), "no time at all": (None, None),
}
INSTANTS = {
    "2023/05/25 (Thu) 14:30": "2023-05-25 14:30:00", "2023/05/25 14:30": "2023-05-25 14:30:00", "2023-05-25": "2023-05-25 23:59:59", "2023/05/25": "2023-05-25 23:59:59",
    "2023-05-25T14:30:15Z": "2023-05-25 14:30:15", "2023-05-25T14:30:15+02:00": "2023-05-25 12:30:15", "soon": None,
}


def test_phrases_and_instants(spark):
    from pyspark.sql import functions as F

    from memspark.functions import temporal

    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    start, end = temporal.parse_phrase(F.col("x"), F.lit("2026-02-25 12:00:00").cast("timestamp_ntz"))
    got = spark.createDataFrame([(p,) for p in PHRASES], "x string").select("x", shown(start).alias("a"), shown(end).alias("b")).collect()
    assert {r.x: (r.a, r.b) for r in got} == PHRASES
    got = spark.createDataFrame([(p,) for p in INSTANTS], "x string").select("x", shown(temporal.parse_instant(F.col("x"))).alias("a")).collect()
    assert {r.x: r.a for r in got} == INSTANTS


def test_dates_before_texts_and_overlap(spark):
    from pyspark.sql import functions as F

    from memspark.functions import temporal
    from memspark.operators import recall

    row = spark.range(1).select(
        temporal.dated(F.lit("x"), F.lit("2023/05/25")).alias("a"), temporal.dated(F.lit("x"), F.lit(None).cast("string")).alias("b"),
        recall.lexical_overlap(F.lit("red cat"), F.lit("A Red  cat sat")).alias("all"), recall.lexical_overlap(F.lit("red cat"), F.lit("red dog")).alias("half"), recall.lexical_overlap(F.lit("red cat"), F.lit("")).alias("none"),
    ).first()
    assert row.a == "[Date: 2023/05/25]\nx" and row.b == "x" and row.all > row.half == 0.5 > row.none > 0
