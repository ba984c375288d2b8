"""The search loop on a small table."""

from pyspark.sql import functions as F

from tessera.operators import search

ROWS = [(0, [1.0, -1.0], 2.0), (0, [-1.0, 1.0], -1.0), (1, [1.0, 1.0], 1.0), (1, [-1.0, -1.0], -3.0)]


def test_optimize(spark):
    obs = spark.createDataFrame(ROWS, "label int, embedding array<double>, v double")
    found = search.optimize_bit(obs, "falsep", search.atoms(2, ("axis",)), "label", F.col("v"), depth=1)
    assert found[0] == "improved" and found[1] == ["not", ["feat", ["axis", 0, 0.0]]] and found[2] == 7.0 and found[3] == 1.0
    assert search.optimize_bit(obs, ["not", ["feat", ["axis", 0, 0.0]]], search.atoms(2, ("axis",)), "label", F.col("v")) == ("no_improvement",)


def test_passes():
    p = search.Policy(["falsep", "falsep"])
    better = lambda term, bit: ("improved", "truep", 5.0 + p.version, None) if term == "falsep" else ("no_improvement",)
    assert search.run_pass(p, [0, 1], better, parallel=True) == {"committed": 1, "stale": 1, "no_improvement": 0, "saturated": False}
    assert search.run_pass(p, [0, 1], better, parallel=False)["committed"] == 1
    assert search.run_pass(p, [0, 1], better, parallel=True)["saturated"]
    assert p.version == 2 and [a["bit_idx"] for a in p.audit] == [0, 1]


def test_guard():
    p = search.Policy(["falsep"])
    log = search.cegar(p, 1, 6, lambda p: [0], lambda t, b: ("improved", "truep", 1.0, None) if t == "falsep" else ("no_improvement",), lambda terms: 1.0 if terms == ["falsep"] else 0.0)
    assert log[0]["reverted"] and p.terms == ["falsep"] and p.version == 2 and p.audit[-1]["bit_idx"] == -1


def test_candidates():
    good, errors = search.candidates([["feat", ["axis", 0, 1]], ["feat", ["axis", 0, 1]], ["feat", ["axis", 9, 1]]], 2)
    assert len(good) == 1 and errors == [{"idx": 2, "error": "coordinate 9 of 2"}]


def test_genetic_search():
    features = [["feat", ["axis", i, 0.0]] for i in range(8)]
    wanted = search.identity(["feat", ["axis", 3, 0.0]])
    calls = []

    def score(terms):
        calls.append(len(terms))
        return [(str(search.identity(t)).count(wanted) - 0.01 * len(str(t)), t, -5.0) for t in terms]

    found = search.evolve_bit(score, features, seed=1)
    assert found == search.evolve_bit(score, features, seed=1) and found[0] == "improved" and wanted in search.identity(found[1])
    assert len(calls) <= 14 and search.evolve_bit(lambda ts: [(0.0, t, 1.0) for t in ts], features) == ("no_improvement",)
