"""The curated rules of three subjects on hand-written items, and the order of rules."""

import pytest

from questmill.operators import curated as C
from questmill.operators.rules import Rule, apply_rule_table, rule_rows

ITEM = "id int, unit string, main string, related array<string>, prompt string, scheme string"


def decide(spark, rules, labels, items):
    """(main, related) of each item by id; labels by their codes."""
    dim = spark.createDataFrame([(unit, f"{code} of {unit}", k) for unit, codes in labels.items() for k, code in enumerate(codes)], "unit string, label string, place int")
    full = lambda unit, code: code and f"{code} of {unit}"
    rows = [(k, u, full(u, m), None if r is None else [full(u, x) for x in r], p, s) for k, (u, m, r, p, s) in enumerate(items)]
    got = apply_rule_table(spark.createDataFrame(rows, ITEM).repartition(2), rule_rows(spark, rules), dim).collect()
    code = lambda x: x and x.split(" of ")[0]
    return [(code(r.main), [code(x) for x in r.related]) for r in sorted(got, key=lambda r: r.id)]


def test_chemistry(spark):
    a, e, n, f, k = C.HAZARD, C.EQUATIONS, C.NAMING, C.FUELS, C.ALKENES
    items = [
        ("Unit 1", e, [a], "Name the alkane shown.", ""),  # no hazard words: it goes, then fuels by the word alkane
        ("Unit 1", a, [f], "Give a hazard of benzene.", ""),
        ("Unit 1", a, [f], "Name the product.", "carbon"),
        ("Unit 1", f, [], "State one precaution.", None),
        ("Unit 1", f, [], "Explain the disposal of polymers as a hazard", None),
        ("Unit 1", n, [a, k], "Describe the toxic gas", ""),
        ("Unit 1", e, [], "Write the equation for hydrogenation", ""),
        ("Unit 1", None, None, None, None),
        ("Unit 1", a, [k], "Give the name of this toxic gas", ""),
        ("Unit 2", "6.1:", ["7.2:", "6.3:"], "Any", ""),
        ("Unit 1", "6.1:", [k, f], "", ""),
    ]
    got = decide(spark, C.CHEMISTRY, {"Unit 1": [e, a, n, f, k], "Unit 2": ["6.1:", "6.3:", "7.2:"]}, items)
    assert got == [(f, [e]), (a, [f]), (f, []), (a, [f]), (f, []), (k, [n]), (k, [e]), (e, []), (k, []), ("6.1:", ["7.2:"]), (k, [f])]


def test_physics(spark):
    one = [C.KINEMATICS, C.VECTORS, "1.3.3 ", C.NEWTON, C.MOMENTS]
    labels = {"Unit 1": one, "Unit 2": [C.WAVES, "2.3.2 ", C.CIRCUITS, "2.4.2 "], "Unit 4": [C.IMPULSE, C.COLLISIONS, C.MAGNETIC, C.INDUCTION, C.HIGH_ENERGY]}
    k, v, t, n, m = one
    plain, angled = "Calculate the tension of the rope", "Find the component at an angle of the tension"
    items = [
        ("Unit 1", v, [m], angled, ""),
        ("Unit 1", m, [v, t], plain, ""),
        ("Unit 1", m, [t], plain, ""),
        ("Unit 1", m, [], plain, ""),
        ("Unit 1", m, [t], "Take moments about the pivot", ""),
        ("Unit 1", m, [t], "Short", ""),
        ("Unit 1", v, [k, t], angled, ""),
        ("Unit 1", v, [t], "Which is a scalar quantity?", ""),
        ("Unit 1", v, [t], plain, ""),
        ("Unit 1", v, [t], "Short", ""),
        ("Unit 2", C.WAVES, [C.CIRCUITS, "2.3.2 "], "Describe the wave", ""),
        ("Unit 2", C.WAVES, ["2.3.2 "], "Is it transverse?", ""),
        ("Unit 2", C.CIRCUITS, ["2.4.2 "], "The lamp switches  on", ""),
        ("Unit 4", C.IMPULSE, [C.COLLISIONS, C.HIGH_ENERGY], "An energy of 2 GeV", ""),
        ("Unit 4", C.IMPULSE, [C.COLLISIONS], "Use FΔt", ""),
        ("Unit 4", C.IMPULSE, [C.COLLISIONS], "Two balls", ""),
        ("Unit 4", C.INDUCTION, [C.MAGNETIC], "Explain the induced voltage here", ""),
        ("Unit 4", C.INDUCTION, [C.MAGNETIC], "It experiences a force while falling", ""),
    ]
    assert decide(spark, C.PHYSICS, labels, items) == [
        (n, [v]), (n, [t]), (t, []), (n, []), (m, [t]), (m, [t]), (t, [v]), (v, [t]), (t, []), (t, [v]),
        ("2.3.2 ", [C.WAVES]), (C.WAVES, ["2.3.2 "]), ("2.4.2 ", [C.CIRCUITS]), (C.HIGH_ENERGY, [C.IMPULSE]), (C.IMPULSE, [C.COLLISIONS]), (C.COLLISIONS, [C.IMPULSE]), (C.INDUCTION, []), (C.INDUCTION, [C.MAGNETIC]),
    ]


def test_maths(spark):
    labels = {
        "WMA11": ["P1 1.1-1.2:", "P1 1.3-1.5:", "P1 1.6-1.9:", "P1 2.1:", "P1 4.1:"],
        "WMA12": ["P2 2.1:", "P2 5.1-5.2:", "P2 5.3:", "P2 6.1:", "P2 6.2:"],
        "WME01": ["M1 1.1 & 2.1-2.2:", "M1 3.1:"],
        "WST01": ["S1 1.1 & 2.1:", "S1 2.2-2.4:", "S1 4.1-4.2:", "S1 6.1a:", "S1 6.1b:"],
    }
    items = [
        ("WMA11", "P1 1.1-1.2:", ["P1 1.3-1.5:", "P1 2.1:", "P1 4.1:"], "", ""),
        ("WMA11", "P1 1.6-1.9:", ["P1 4.1:"], "the region R1 is shaded", ""),
        ("WMA11", "P1 1.1-1.2:", ["P1 1.6-1.9:"], "", ""),
        ("WMA12", "P2 2.1:", ["P2 5.1-5.2:", "P2 5.3:"], "", ""),  # one rule of the group only
        ("WMA12", "P2 6.1:", ["P2 6.2:"], "show ≡ holds", ""),
        ("WMA12", "P2 6.2:", ["P2 6.1:"], "show ≡ holds", ""),
        ("WME01", "M1 1.1 & 2.1-2.2:", ["M1 3.1:"], "", ""),
        ("WME01", "M1 1.1 & 2.1-2.2:", ["M1 3.1:"], "find the resultant of the two", ""),
        ("WST01", "S1 1.1 & 2.1:", ["S1 2.2-2.4:", "S1 4.1-4.2:"], "Draw a scatter diagram of it", ""),
        ("WST01", "S1 1.1 & 2.1:", ["S1 2.2-2.4:", "S1 4.1-4.2:"], "Find the median of these", ""),
        ("WST01", "S1 6.1a:", ["S1 2.2-2.4:"], "(a) Find the value of μ and the value of σ", ""),
        ("WST01", "S1 6.1b:", [], "(b) the value of μ and the value of σ again", ""),
        ("WST01", "S1 6.1b:", ["S1 2.2-2.4:"], "Find the probability that X > 3", ""),
    ]
    assert decide(spark, C.MATHS, labels, items) == [
        ("P1 4.1:", ["P1 1.1-1.2:"]), ("P1 1.6-1.9:", ["P1 4.1:"]), ("P1 1.6-1.9:", ["P1 1.1-1.2:"]), ("P2 5.1-5.2:", ["P2 2.1:"]), ("P2 6.1:", ["P2 6.2:"]), ("P2 6.1:", ["P2 6.2:"]),
        ("M1 3.1:", ["M1 1.1 & 2.1-2.2:"]), ("M1 1.1 & 2.1-2.2:", ["M1 3.1:"]), ("S1 4.1-4.2:", ["S1 2.2-2.4:"]), ("S1 2.2-2.4:", ["S1 4.1-4.2:"]), ("S1 6.1b:", ["S1 6.1a:"]), ("S1 6.1a:", ["S1 6.1b:"]), ("S1 6.1a:", ["S1 2.2-2.4:"]),
    ]


@pytest.mark.parametrize("turned,want", [(False, ("c", ["a"])), (True, ("a", ["b"]))])
def test_order_and_scope(spark, turned, want):
    """The first rule to act decides what the next one reads; foreign labels go first."""
    rules = [Rule("u", "swap", mains=("a",), picks=("b", "c"), bars=("b",)), Rule("u", "remove", picks=("c",))]
    rules = rules[::-1] if turned else rules
    got = decide(spark, rules, {"u": ["a", "b", "c"], "v": ["z"]}, [("u", "a", ["b", "c"] if turned else ["c", "b"], "", ""), ("v", "a", ["z"], "", ""), ("w", "a", ["q"], "", "")])
    assert got[0] == want and got[1] == ("z", []) and got[2] == ("a", ["q"])
