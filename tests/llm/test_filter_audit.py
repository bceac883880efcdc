import random
import re
from fractions import Fraction
from itertools import permutations
from math import factorial

from docrisk.llm import filter_audit as A

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def fails(row, rows):
    """The filters that a row fails, by the contract's words."""
    i, text, _ = row
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = ""
    found += "A" * (len(words) < 50)
    found += "B" * (100 * len(set(words)) < 65 * len(words))
    found += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
    found += "D" * bool(re.search(r"[#$%&*|]", text))
    found += "E" * any(i is not None and o[0] is not None and o[0] < i and (o[1] or "") == text for o in rows)
    return found


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = [(s or "", i, fails((i, t, s), rows)) for i, t, s in rows]
    found = {}
    for part in {p for p, _, _ in judged}:
        mine = [(i, f) for p, i, f in judged if p == part]
        shares = dict.fromkeys(A.FILTERS, 0)
        steps = {}
        for order in permutations(A.FILTERS):
            left = mine
            for k, f in enumerate(order):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shares[f] += len(out)
                redundant = sum(f in x[1] for x in mine) - len(out)
                steps["".join(order), k + 1] = (
                    len(left), len(out), redundant, sum(x[1] == f for x in mine), sum(x[0] in good for x in out), sum(x[0] in toxic for x in out)
                )
        for (order, k), values in steps.items():
            found[part, order, k] = (*values, shares[order[k - 1]])
    return found


def result(spark, rows, labels, schema=DOCS, label_schema=LABELS):
    got = A.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, label_schema)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def some_rows(rng, n):
    rows = []
    for i in range(n):
        size = rng.choice([0, 3, 49, 50, 51, 80])
        words = [f"w{rng.randrange(rng.choice([5, 1000]))}" for _ in range(size)]
        if rng.random() < 0.2:
            words = [w.upper() for w in words]
        if rng.random() < 0.2:
            words.append(rng.choice("#$%&*|"))
        rows.append((i, " ".join(words), rng.choice(["s", "t", None, ""])))
    for i in range(n, n + n // 2):
        rows.append((i, rng.choice(rows[:n])[1], rng.choice(["s", "t"])))
    return rows


def test_against_every_order_played_through(spark):
    rng = random.Random(4)
    rows = some_rows(rng, 80)
    rows += [(None, rows[0][1], "s"), (None, rows[0][1], "s"), (7, rows[7][1], rows[7][2]), (7, "other", "s"), (200, None, "u"), (201, "", "u"), (-5, rows[3][1], "t")]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(100)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]
    want = brute(rows, labels)
    got = result(spark, rows, labels)
    assert set(got) == set(want) and len(got) == 600 * len({p for p, _, _ in want})
    assert got == want


def test_bounds_of_the_filters(spark):
    texts = [" ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), " ".join(["x"] * 35 + [f"w{i}" for i in range(64)]),
             " ".join(["x"] * 36 + [f"w{i}" for i in range(64)]), "A" + "b" * 19, "AA" + "b" * 37, "É" * 30, "a|", "   ", "\t\n"]
    rows = [(i, t, f"p{i}") for i, t in enumerate(texts)]
    assert result(spark, rows, []) == brute(rows, [])


def test_empty_tables_and_extra_columns(spark):
    assert result(spark, [], []) == {}
    rows = [(1, "a", "s", 5, "x"), (2, "a", "s", 6, "y")]
    got = result(spark, rows, [(1, 1, 0, "z")], DOCS + ", quality int, part string", LABELS + ", text string")
    assert got == brute([r[:3] for r in rows], [(1, 1, 0)])


def test_one_text_of_a_third_of_the_rows(spark):
    """Copies are counted by partial aggregation, and one source holds them all."""
    rows = [(i, "same text", "hot") for i in range(3000)] + [(i, f"text {i}", f"s{i % 3}") for i in range(3000, 9000)]
    got = result(spark, rows, [])
    assert got["hot", "EABCD", 1][:2] == (1, 2999) and got["s0", "EABCD", 1][1] == 0
    assert got["hot", "ABCDE", 5] == (0, 0, 2999, 0, 0, 0, got["hot", "ABCDE", 5][6])


def test_rational_solution_is_the_shapley_value():
    for m in (2, 3, 4, 5, 6):
        factors = A.shapley_weights(m)
        for i, row in enumerate(factors):
            for s, factor in enumerate(row):
                size = bin(s).count("1")
                inside = s >> i & 1
                weight = Fraction(factorial(size - inside) * factorial(m - size - 1 + inside), factorial(m))
                assert factor == (weight if inside else -weight)


def test_copies_of_a_text_do_not_meet_in_one_task(spark):
    docs = spark.createDataFrame([(1, "a", "s")], DOCS)
    plan = A.audit(docs, spark.createDataFrame([], LABELS))._jdf.queryExecution().toString()
    assert "collect" not in plan.split("== Physical Plan ==")[1] and "Python" not in plan and "CartesianProduct" not in plan
