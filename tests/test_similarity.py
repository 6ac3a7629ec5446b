"""Similar texts against every pair compared, over whole tables and over texts made to be near the cutoffs."""

from difflib import SequenceMatcher
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from glyphmill.operators import registry as R
from glyphmill.operators import similarity as S
from glyphmill.plans import load
from glyphmill.plans.catalog import QUERIES
from glyphmill.plans.registry import registry

SF = "/root/testdata/sf0.001"
load()


def seq(a, b):
    return SequenceMatcher(None, a, b).ratio()


def classes(rows, block, *texts):
    """{(block, texts): smallest id}."""
    out = {}
    for r in rows:
        key = (tuple(r[c] for c in block), *((r[t] or "").lower() for t in texts))
        out[key] = min(out.get(key, r["tag_id"]), r["tag_id"])
    return out


def brute_pairs(rows, block, text, cutoff, longer_than=0):
    of = {k: i for k, i in classes(rows, block, text).items() if len(k[1]) > longer_than}
    found = {}
    for (k1, i1), (k2, i2) in combinations(sorted(of.items(), key=lambda x: x[1]), 2):
        if k1[0] == k2[0] and seq(k1[1], k2[1]) >= cutoff:
            found[(*k1[0], i1, i2)] = round(seq(k1[1], k2[1]), 9)
    return found


def got(df):
    return {tuple(r)[:-1]: round(r["score"], 9) for r in df.collect()}


def test_names_of_the_whole_registry(spark):
    rows = registry(spark, SF).collect()
    want = brute_pairs(rows, ["domain", "value_type"], "canonical_name", 0.85)
    assert want and got(QUERIES["jon09_similar_names"](spark, SF)) == want


def test_definitions_of_the_whole_registry(spark):
    rows = registry(spark, SF).collect()
    want = brute_pairs(rows, [], "definition", 0.7, 20)
    assert want and got(QUERIES["reg11_similar_definitions"](spark, SF)) == want


def test_consolidation_of_the_whole_registry(spark):
    of, want = classes(registry(spark, SF).collect(), ["domain", "value_type"], "canonical_name", "definition"), {}
    for (k1, i1), (k2, i2) in combinations(sorted(of.items(), key=lambda x: x[1]), 2):
        if k1[0] == k2[0]:
            n, d = seq(k1[1], k2[1]), seq(k1[2], k2[2]) if k1[2] and k2[2] else 0.0
            if 0.4 * n + 0.6 * d >= 0.6:
                want[(*k1[0], i1, i2)] = tuple(round(v, 9) for v in (n, d, 0.4 * n + 0.6 * d))
    out = {tuple(r)[:4]: tuple(round(v, 9) for v in tuple(r)[4:]) for r in QUERIES["mth13_consolidation"](spark, SF).collect()}
    assert want and out == want


@pytest.mark.parametrize("cutoff", [0.5, 0.72, 0.85, 0.95, 1.0])
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abAB é", max_size=14), min_size=25, max_size=25))
def test_no_pair_is_lost(spark, cutoff, texts):
    texts = texts + [t + "ab" for t in texts[:8]] + [t[1:] for t in texts[:8]]
    rows = [{"tag_id": i, "text": t} for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "tag_id int, text string")
    assert got(S.similar_texts(df, "tag_id", "text", cutoff=cutoff)[0]) == brute_pairs(rows, [], "text", cutoff)


def test_long_texts_whose_frequent_characters_count_for_nothing(spark):
    base = "the quick brown fox jumps over the lazy dog " * 40
    rows = [{"tag_id": i, "text": t} for i, t in enumerate([base, base[5:], base + "x", base[:900] + "zq" * 20 + base[900:], "#" * 1500])]
    df = spark.createDataFrame(rows, "tag_id int, text string")
    assert got(S.similar_texts(df, "tag_id", "text", cutoff=0.7)[0]) == brute_pairs(rows, [], "text", 0.7)


def test_copies_nulls_clashing_names_and_no_rows(spark):
    rows = [(1, "same name", None, 0), (2, "Same Name", None, 0), (2, "Same Name", None, 0), (3, "same names", None, 1), (4, None, None, 2), (None, "same name", None, 3), (5, "same name", "x", 4)]
    df = spark.createDataFrame(rows, "tag_id int, text string, a string, score int")
    pairs, members = S.similar_texts(df, "tag_id", "text", ["a"])
    assert [tuple(r) for r in pairs.toDF("block", "a", "b", "score").collect()] == [(None, 1, 3, 2 * 9 / 19)]
    assert sorted(tuple(r)[1:] for r in members.collect()) == [(1, 1), (1, 2), (3, 3), (5, 5)]
    pairs, members = S.similar_texts(df.limit(0), "tag_id", "text")
    assert pairs.count() == members.count() == 0
    with pytest.raises(ValueError):
        S.similar_texts(df, "tag_id", "text", cutoff=0.0)
    empty_names = spark.createDataFrame([(1, "", "one text"), (2, None, "one texts"), (3, "", None), (4, "b", None)], "tag_id int, canonical_name string, definition string")
    assert [(r.a, r.b, r.name_score) for r in S.consolidation(empty_names)[0].collect()] == [(1, 2, 1.0)]


def test_fuzzy_search_against_every_ratio(spark):
    reg = registry(spark, SF)
    for term in ("antique part", "blu bolts", "ring"):
        want = []
        for r in reg.collect():
            best = 0.0
            for t in [r.tag_id, r.canonical_name, *(r.aliases or [])]:
                if t is not None:
                    t = t.lower()
                    best = max(best, 1.0 if term in t else 0.9 if any(w and w in t for w in term.split(" ")) else seq(term, t))
            if best >= 0.6:
                want.append((-round(best, 9), r.tag_id))
        found = [(-round(r.score, 9), r.tag_id) for r in R.fuzzy_search(reg, term).collect()]
        assert found == sorted(want)[:20] and found
