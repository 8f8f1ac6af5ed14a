import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import values
from tabuloom.operators import paired as p
from tabuloom.operators import units as u
from tabuloom.operators import weights as w


def design(frame, n=40, seed=17, drop=0):
    """n persons seen in two arms, rows shuffled."""
    rng = random.Random(3)
    people, facts = [], []
    for person in range(n):
        base = rng.gauss(5, 1)
        for arm in (1, 2):
            if arm == 2 and person < drop:
                continue
            row = f"r{person}-{arm}"
            people.append(("s", row, f"p{person}", arm))
            facts.append(("s", row, base + 0.4 * arm + rng.gauss(0, 0.3), int(rng.random() < 0.3 * arm)))
    random.Random(seed).shuffle(people)
    random.Random(seed + 1).shuffle(facts)
    return (frame("study_id string, respondent_id string, person_id string, arm int", people),
            frame("study_id string, respondent_id string, score double, pick int", facts), people, facts)


def sides(people, facts, value):
    left = p.condition_side(facts, people, value, F.col("arm") == 1)
    right = p.condition_side(facts, people, value, F.col("arm") == 2)
    return p.person_pairs(left, right)


def python_pairs(people, facts, index):
    arm = {r[1]: (r[2], r[3]) for r in people}
    out = {}
    for row in facts:
        person, side = arm[row[1]]
        out.setdefault(person, {})[side] = row[index]
    return {k: v for k, v in out.items() if len(v) == 2}


@pytest.mark.parametrize("seed", [17, 99])
def test_paired_t(frame, seed):
    people, facts, raw_people, raw_facts = design(frame, seed=seed, drop=4)
    row = p.paired_means(sides(people, facts, "score")).collect()[0]
    pairs = python_pairs(raw_people, raw_facts, 2)
    d = [v[1] - v[2] for v in pairs.values()]
    mean = sum(d) / len(d)
    sd = math.sqrt(sum((x - mean) ** 2 for x in d) / (len(d) - 1))
    assert (row["pairs"], row["persons_a"], row["persons_b"], row["without_pair_a"]) == (36, 40, 36, 4)
    assert row["difference"] == pytest.approx(mean)
    assert row["t"] == pytest.approx(mean / (sd / math.sqrt(36)))
    assert row["ci_low"] < row["difference"] < row["ci_high"]
    # The 95 % quantile of t with 35 degrees of freedom is 2.0301079282503425.
    assert row["ci_high"] - row["difference"] == pytest.approx(2.0301079282503425 * sd / 6, rel=1e-9)
    assert row["result"] == "Diferencia significativa"


def test_mcnemar(frame):
    people, facts, raw_people, raw_facts = design(frame)
    row = p.paired_proportions(sides(people, facts, "pick")).collect()[0]
    pairs = python_pairs(raw_people, raw_facts, 3).values()
    b = sum(v[1] == 1 and v[2] == 0 for v in pairs)
    c = sum(v[1] == 0 and v[2] == 1 for v in pairs)
    n, k = b + c, min(b, c)
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)
    assert (row["yes_no"], row["no_yes"]) == (b, c)
    assert row["p_value"] == pytest.approx(exact, rel=1e-12)


def test_small_and_repeated_samples(frame):
    people, facts, *_ = design(frame, n=5)
    row = p.paired_means(sides(people, facts, "score")).collect()[0]
    assert row["result"] == "Base insuficiente" and row["p_value"] is None
    merged = people.withColumn("person_id", F.lit("one"))
    refused = p.paired_means(sides(merged, facts, "score"))
    with pytest.raises(PySparkException, match="several evaluations"):
        refused.collect()
    mean = p.paired_means(sides(merged, facts, "score"), duplicates="person_mean").collect()[0]
    assert (mean["pairs"], mean["repeated_a"]) == (1, 1)


def test_no_spread(frame):
    people, facts, *_ = design(frame)
    same = facts.withColumn("score", F.lit(3.0))
    row = p.paired_means(sides(people, same, "score")).collect()[0]
    assert (row["p_value"], row["ci_low"]) == (1.0, 0.0)


def test_selection_facts(frame):
    base = frame("study_id string, question_id string, respondent_id string",
                 [("s", "q", "1"), ("s", "q", "2")])
    mentions = frame("study_id string, question_id string, respondent_id string, code string",
                     [("s", "q", "1", "5.0"), ("s", "q", "1", "7")])
    assert values(p.selection_facts(base, mentions, 5), "respondent_id", "value") == [("1", 1), ("2", 0)]


RESP = "study_id string, respondent_id string, person_id string, sex string"
FACT = "study_id string, question_id string, respondent_id string, variable string, code string, weight double"


def test_person_unit(frame):
    people = frame(RESP, [("s", "1", "a", "m"), ("s", "2", "a", "m"), ("s", "3", "b", "f")])
    facts = frame(FACT, [("s", "q", "1", "v", "x", 1.0), ("s", "q", "2", "v", "x", 2.0),
                         ("s", "q", "3", "v", "y", 1.0)])
    rows, persons = u.to_person_unit(facts, people, ["code"], ["sex"])
    assert values(rows, "respondent_id", "code") == [("a", "x"), ("b", "y")]
    assert values(persons, "respondent_id", "sex") == [("a", "m"), ("b", "f")]


def test_person_unit_conflicts(frame):
    people = frame(RESP, [("s", "1", "a", "m"), ("s", "2", "a", "f")])
    facts = frame(FACT, [("s", "q", "1", "v", "x", 1.0), ("s", "q", "2", "v", "y", 1.0)])
    refused, _ = u.to_person_unit(facts, people, ["code"])
    with pytest.raises(PySparkException, match="question s q .*DIFFERENT_ANSWERS"):
        refused.collect()
    same = facts.withColumn("code", F.lit("x"))
    rows, persons = u.to_person_unit(same, people, ["code"], ["sex"])
    assert rows.count() == 1
    with pytest.raises(PySparkException, match="within a person: sex"):
        persons.collect()
    lost = facts.filter("respondent_id = '1'").withColumn("respondent_id", F.lit("9"))
    assert values(u.person_conflicts(lost, people, ["code"]), "problem") == [("UNLINKED_ROW",)]
    null_one = same.withColumn("code", F.when(F.col("respondent_id") == "1", "x"))
    assert u.person_conflicts(null_one, people, ["code"]).count() == 1


def test_weighted_base(frame):
    schema = "study_id string, respondent_id string, w double"
    good = frame(schema, [("s", "1", 1.0), ("s", "2", 3.0), ("s", "3", 0.0), ("s", "3", 0.0), ("s", "4", None)])
    row = w.weighted_base(good, "w").collect()[0]
    assert (row["unweighted_n"], row["valid_n"], row["missing_n"], row["zero_n"]) == (4, 3, 1, 1)
    assert row["weighted_n"] == 4.0 and row["effective_n"] == pytest.approx(16 / 10)
    assert row["status"] == "PASS_WITH_WARNINGS"
    assert w.weighted_base(good, "w", significance_requested=True).collect()[0][
        "significance_status"] == "UNSUPPORTED"
    for bad in (-1.0, float("inf")):
        row = w.weighted_base(frame(schema, [("s", "1", 1.0), ("s", "2", bad)]), "w").collect()[0]
        assert row["status"] == "FAIL" and row["weighted_n"] is None
    zero = w.weighted_base(frame(schema, [("s", "1", 0.0)]), "w").collect()[0]
    assert zero["status"] == "FAIL" and zero["effective_n"] is None
    text = frame("study_id string, respondent_id string, w string", [("s", "1", "2.0")])
    row = w.weighted_base(text, "w").collect()[0]
    assert (row["non_numeric_n"], row["status"]) == (1, "FAIL")


def test_weight_distribution(frame):
    schema = "study_id string, respondent_id string, w double"
    rows = [("s", str(i), float(v)) for i, v in enumerate([1, 2, 3, 4, 10])]
    row = w.weight_distribution(frame(schema, rows), "w").collect()[0]
    assert (row["minimum"], row["median"], row["maximum"], row["mean"]) == (1, 3, 10, 4)
    assert row["p95"] == pytest.approx(4 + 0.8 * 6) and row["p1"] == pytest.approx(1.04)
    assert row["cv"] == pytest.approx(math.sqrt(10) / 4) and row["max_min_positive_ratio"] == 10
