"""English lexemes and ranked keyword search."""

import math

import pytest
from pyspark.sql import functions as F

from memspark.functions import english
from memspark.operators import recall

# Words and their stems by the published algorithm.
STEMS = (
    "consign consign,consigned consign,consistency consist,consolation consol,consolatory consolatori,consolidated consolid,consolingly consol,consonant conson,conspicuous conspicu,conspiracy conspiraci,"
    "constable constabl,constancy constanc,knackeries knackeri,knaves knave,knavish knavish,kneading knead,kneeled kneel,knees knee,knightly knight,knitted knit,knives knive,knocker knocker,generate generat,"
    "generally general,generic generic,communication communic,happiness happi,relational relat,running run,hopping hop,hoping hope,ties tie,cries cri,gas gas,this this,kiwis kiwi,say say,by by,enjoy enjoy,"
    "agreed agre,feed feed,luxuriated luxuri,controlling control,rolling roll,probate probat,cease ceas,beautifully beauti,geology geolog,dying die,skies sky,succeed succeed,proceeds proceed,early earli,news news"
)


@pytest.mark.parametrize("word, stem", [x.split() for x in STEMS.split(",")])
def test_stems(word, stem):
    assert english.stem(word) == stem


FACTS = [
    (1, 0, "The cats sat near a cat on 2 mats"), (2, 0, "cat dog"), (3, 0, "dog and then very many other words before one cat"), (4, 1, "cat dog"), (5, 0, "dogs dogs cat dog"), (6, 0, None), (7, 0, ""),
    (8, 0, "a cat " + "word " * 200 + "dog"), (9, 0, "Über 42 cafés"), (10, 0, "the the the"),
]


def slow_rank(query, content):
    """The published rules of the rank, of words that are their own stems or end in s."""
    cut = lambda x: [w[:-1] if w.endswith("s") and len(w) > 3 else w for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()]
    stop = set(english.STOP_WORDS)
    want, words = sorted(set(cut(query)) - stop), cut(content)
    at = {w: [i + 1 for i, x in enumerate(words) if x == w] for w in want}
    if not want or not all(at.values()):
        return None
    if len(want) == 1:
        return sum(0.1 / (j + 1) ** 2 for j in range(len(at[want[0]]))) / 1.64493406685
    miss = 1.0
    for i, a in enumerate(want):
        for b in want[:i]:
            for p in at[a]:
                for q in at[b]:
                    d = abs(p - q)
                    miss *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    return 1 - miss


def test_ranks_equal_the_published_rules(spark):
    facts = spark.createDataFrame(FACTS, "fact_id long, bank_id long, content string")
    asks = [(0, 0, "cat"), (1, 0, "the dogs cat"), (2, 1, "dog cat"), (3, 0, "the"), (4, 0, ""), (5, 0, None), (6, 0, "cat unicorn"), (7, 0, "words many dog"), (8, 0, "42 ÜBER")]
    queries = spark.createDataFrame(asks, "query_id long, bank_id long, text string")
    got = recall.keyword_ranked(queries, recall.positional_index(facts, english.lexemes), english.lexemes).collect()
    want = {(q, f): round(s, 10) for q, b, x in asks for f, c, t in FACTS if b == c and x and (s := slow_rank(x, t)) is not None}
    assert {(r.query_id, r.fact_id): r.score for r in got} == pytest.approx(want) and len(want) > 10
    by = {(r.query_id, r.fact_id): r["rank"] for r in got}
    assert by[1, 5] < by[1, 2] < by[1, 3] < by[1, 8]  # near and often before far


def test_terms_at_one_place_have_no_pair(spark):
    index = spark.createDataFrame([(0, "a", 1, [16383]), (0, "b", 1, [16383])], "bank_id long, term string, fact_id long, positions array<int>")
    query = spark.createDataFrame([(0, 0, "a b")], "query_id long, bank_id long, text string")
    assert recall.keyword_ranked(query, index, lambda c: F.split(c, " ")).first().score == round(recall.NO_PAIR, recall.DIGITS)


def test_positions_are_bounded_as_published(spark):
    facts = spark.createDataFrame([(1, 0, "x " * 300 + "y " * 17000 + "z z")], "fact_id long, bank_id long, content string")
    got = {r.term: r.positions for r in recall.positional_index(facts, english.unstemmed).collect()}
    assert len(got["x"]) == len(got["y"]) == recall.POSITIONS and got["z"] == [recall.LAST]


def test_stored_index_reads_only_its_bank(spark, tmp_path):
    path = str(tmp_path / "index")
    facts = spark.createDataFrame(FACTS, "fact_id long, bank_id long, content string")
    recall.write_index(recall.positional_index(facts, english.lexemes), path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "index").glob("bank_id=0/*.parquet")}
    more = spark.createDataFrame([(4, 1, "cat dog"), (11, 1, "bird cat")], "fact_id long, bank_id long, content string")
    recall.write_index(recall.positional_index(more, english.lexemes), path)
    assert before and {f: f.stat().st_mtime_ns for f in (tmp_path / "index").glob("bank_id=0/*.parquet")} == before
    index = recall.read_index(spark, path)
    query = spark.createDataFrame([(0, 1, "cats")], "query_id long, bank_id long, text string")
    assert sorted(r.fact_id for r in recall.keyword_ranked(query, index, english.lexemes).collect()) == [4, 11]
    plan = index.where("bank_id = 1 and term = 'cat'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bank_id" in plan and "EqualTo(term,cat)" in plan


def test_a_frequent_word_costs_no_more_than_the_rare_one_beside_it(spark):
    """Only facts with a query's rarest term are looked at, and queries of the same terms are looked up once."""
    from pyspark.sql import functions as F

    from memspark.functions import text
    from memspark.operators import recall

    facts = spark.createDataFrame([(i, 0, f"often word{i} also" if i else "often rare also also") for i in range(60)], "fact_id long, bank_id long, content string")
    queries = spark.createDataFrame([(q, 0, "also often RARE") for q in range(30)] + [(90, 0, "often missing"), (91, 1, "often"), (92, 0, "")], "query_id long, bank_id long, text string")
    index = recall.inverted_index(facts, text.words)
    asked, held = recall._holders(queries, index, text.words(F.col("text")), "tf")
    assert asked.count() == 32 and held.count() == 3
    got = {(r.query_id, r.fact_id, r.score, r["rank"]) for r in recall.keyword_topk(queries, index, text.words).collect()}
    assert got == {(q, 0, 4.0, 0) for q in range(30)}
