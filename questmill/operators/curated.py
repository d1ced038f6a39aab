"""The hierarchy rules of three subjects, as rows for ``rules.apply_rule_table``."""

from __future__ import annotations

from .rules import Rule


def words(listed: str) -> str:
    """A pattern of whole words and phrases from a list with commas; letters of any case, any white space in phrases."""
    return r"(?iU)\b(?:" + "|".join(r"\s+".join(x.split()) for x in listed.split(",")) + r")\b"


# Codes of the labels that rules name, and the words that decide them.
HAZARD, EQUATIONS, OLD_EQUATIONS, NAMING = "4A (4.1-4.3):", "1.3 & 1.12:", "1.3 & 1.10:", "4A (4.4-4.8):"
FUELS, ALKENES = "4B (4.12-4.16):", "5.4-5.5:"
HAZARD_WORDS = words(
    "hazard, hazards, hazardous, risk, risks, precaution, precautions, toxic, toxicity, flammable, inflammable, corrosive, irritant, carcinogen, carcinogenic, "
    "poisonous, fume cupboard, gloves, goggles, eye protection, explosion, explosive, oxidising agent, stored in the same cupboard"
)
HAZARD_ASKED = (
    words("hazard, hazards, risk assessment, precaution, precautions")
    + "|" + words("reduce the risk, minimise the risk, minimize the risk")
    + "|" + words("(?:toxic|flammable|corrosive)\\b.*?\\b(?:hazard|risk|precaution|symbol|store|stored|cupboard|safety)")
)
NO_HAZARD = words(r"polymer disposal, disposal of polymers, calculate the maximum number of \w+ molecules")
NAMES_ASKED = words("iupac name, give the name, skeletal formula, displayed formula, structural formula")
FUEL_WORDS = words("combustion, complete combustion, incomplete combustion, reforming, cracking, alkane, heptane, octane, dodecane, isooctane, propane, butane")
ALKENE_WORDS = words("hydrogenation, alkene, squalene, propene, ethene, bromine water")

KINEMATICS, VECTORS, NEWTON, MOMENTS = "1.3.1 ", "1.3.2 ", "1.3.4 ", "1.3.6 "
WAVES, CIRCUITS, IMPULSE, COLLISIONS, MAGNETIC, INDUCTION, HIGH_ENERGY = "2.3.1 ", "2.4.1 ", "4.3.1 ", "4.3.2 ", "4.4.3 ", "4.4.4 ", "4.5.3 "
SPECIFIC_WAVES = ("2.3.2", "2.3.3", "2.3.5", "2.3.6", "2.3.7", "2.3.8")
VECTORS_ASKED = words(
    "scalar, scalars, vector quantity, vector quantities, scaled vector diagram, vector triangle, vector diagram, speed of the car can remain constant, "
    "magnitude of the displacement.*less than the distance, horizontal and vertical components of (?:its|the|their) velocity"
)
VECTOR_WORDS = words(
    r"vector, vectors, scalar, scalars, component, components, resolv\w*, sin\s*\d, cos\s*\d, tan\s*\d, sin\s*θ, cos\s*θ, tan\s*θ, sin\s*theta, cos\s*theta, "
    r"trigonometr\w*, pythagoras, parallelogram, angle, horizontal, vertical, perpendicular, direction, east, north"
)
MOMENT_WORDS = words(
    "moment, moments, pivot, hinge, hinges, centre of gravity, center of gravity, centre of mass, clockwise, anticlockwise, turning effect, plank, beam, ruler, see-saw, seesaw, "
    "lever, fulcrum, support, supports, topple, tilt, tipped, door, ladder, bar, shelf, barrier, crane, arm, forearm, "
    r"stand\w* on the wood, centre of the car, screw can withstand"
)
MAGNETIC_WORDS = words(
    r"F\s*=\s*B\s*I\s*l, F\s*=\s*B\s*q\s*v, left[- ]hand rule, motor effect, magnetic force, force on (?:the\s+)?(?:wire|rod|conductor|coil|plate|disc|magnet|particles?|electrons?|ions?), "
    r"experiences? a force, opposing force, reading on the balance, force meter, braking, electromagnetic brake, decelerat\w*, copper tube"
)
WAVE_ASKED = words("longitudinal, transverse, graph.*frequency.*wavelength of photons")
CIRCUIT_WORDS = words(
    "security lamp, switches on, potential divider, two resistors, purpose of the resistor, read from graph, best fit line, minimum potential difference, "
    r"ohmic conductor.*varies with, conduction electrons, nichrome wire, resistivity, chemical energy store, solar cell array, I\s*=\s*P\s*/\s*A"
)
IMPULSE_WORDS = r"(?iU)F\s*Δt|Δp|average\s+force"

GRAPHICAL = words(r"defined by the inequalities, region R\d?\b.*shaded, inequalities that define")
MOTION_WORDS = words("mass, acceleration, moves, moving, speed of P at time, velocity of P at time, at rest")
DIAGRAM_WORDS = words("histogram, histograms, stem and leaf, stem-and-leaf, back-to-back, box plot, box plots, boxplot, whisker")
SCATTER_WORDS = r"(?iU)\bscatter\s+diagram|regression\b"
UNKNOWN_WORDS = (
    r"(?isU)value\s+of\s+μ\s+and\s+the\s+value\s+of\s+σ|calculate\s+the\s+mean\s+and\s+standard\s+deviation|find\s+two\s+equations\s+in\s+terms\s+of\s+μ\s+and\s+σ|"
    r"show\s+that.*σ\s*=\s*\d+|changes\s+the\s+mean\s+to\s+m\b.*find\s+the\s+value\s+of\s+m|σ\s*=\s*k\b.*find\s+the\s+value\s+of\s+r\s+and\s+the\s+value\s+of\s+k"
)
BOTH_UNKNOWN = r"(?isU)\(a\)\s*(?:find|calculate)[^\(]{0,60}value\s+of\s+μ\s+and\s+the\s+value\s+of\s+σ|2\s*μ\s*=\s*3\s*σ"
ENOUGH_PHYSICS, ENOUGH_MATHS = 15, 20

CHEMISTRY = [
    Rule("Unit 1", "remove", picks=(HAZARD,), prompt_lacks=(HAZARD_WORDS,), given=True),
    Rule("Unit 1", "remove", picks=(HAZARD,), prompt_has=(NAMES_ASKED,), prompt_lacks=(HAZARD_ASKED,)),
    Rule("Unit 1", "yield", mains=(HAZARD,), text_lacks=(HAZARD_WORDS,), given=True),
    Rule("Unit 1", "yield", mains=(HAZARD,), prompt_has=(NAMES_ASKED,), prompt_lacks=(HAZARD_ASKED,)),
    Rule("Unit 1", "lead", HAZARD, prompt_has=(HAZARD_ASKED,), prompt_lacks=(NO_HAZARD,), given=True),
    Rule("*", "swap", mains=(EQUATIONS, NAMING), bars=(EQUATIONS, OLD_EQUATIONS, HAZARD, NAMING), group="generic"),
    Rule("Unit 1", "turn", FUELS, mains=(EQUATIONS,), prompt_has=(FUEL_WORDS,), given=True, group="generic"),
    Rule("Unit 1", "turn", ALKENES, mains=(EQUATIONS,), prompt_has=(ALKENE_WORDS,), given=True, group="generic"),
]
PHYSICS = [
    Rule("Unit 1", "add", NEWTON, mains=(VECTORS,), needs=(MOMENTS,), text_lacks=(MOMENT_WORDS,), least=ENOUGH_PHYSICS),
    Rule("Unit 1", "remove", picks=(MOMENTS,), text_lacks=(MOMENT_WORDS,), least=ENOUGH_PHYSICS),
    Rule("Unit 1", "yield", mains=(MOMENTS,), absent=(VECTORS,), text_lacks=(MOMENT_WORDS,), least=ENOUGH_PHYSICS),
    Rule("Unit 1", "add", VECTORS, mains=(MOMENTS,), text_lacks=(MOMENT_WORDS,), least=ENOUGH_PHYSICS),
    Rule("Unit 1", "become", NEWTON, mains=(MOMENTS,), text_lacks=(MOMENT_WORDS,), least=ENOUGH_PHYSICS),
    Rule("Unit 1", "remove", picks=(VECTORS,), text_lacks=(VECTOR_WORDS,), least=ENOUGH_PHYSICS),
    Rule("Unit 1", "remove", picks=(VECTORS,), prompt_has=(words("determine the strain in the rope"),), least=ENOUGH_PHYSICS),
    Rule("Unit 1", "swap", mains=(VECTORS,), bars=(VECTORS, KINEMATICS), prompt_lacks=(VECTORS_ASKED,), text_has=(VECTOR_WORDS,)),
    Rule("Unit 1", "swap", mains=(VECTORS,), bars=(VECTORS, KINEMATICS), prompt_lacks=(VECTORS_ASKED,), text_has=(r"(?sU)^.{0,14}$",)),
    Rule("Unit 1", "yield", mains=(VECTORS,), bars=(VECTORS, KINEMATICS), prompt_lacks=(VECTORS_ASKED,)),
    Rule("Unit 2", "swap", mains=(WAVES,), picks=SPECIFIC_WAVES, prompt_lacks=(WAVE_ASKED,)),
    Rule("Unit 2", "swap", mains=(CIRCUITS,), text_has=(CIRCUIT_WORDS,)),
    Rule("Unit 4", "swap", mains=(IMPULSE,), picks=(HIGH_ENERGY,), text_has=(r"\bGeV|MeV\b",), group="impulse"),
    Rule("Unit 4", "swap", mains=(IMPULSE,), picks=(COLLISIONS,), text_lacks=(IMPULSE_WORDS,), group="impulse"),
    Rule("Unit 4", "remove", picks=(MAGNETIC,), mains=(INDUCTION,), text_lacks=(MAGNETIC_WORDS,), least=ENOUGH_PHYSICS),
]
INDICES, QUADRATICS, SIMULTANEOUS = "P1 1.1-1.2:", "P1 1.3-1.5:", "P1 1.6-1.9:"
MATHS = [
    Rule("WMA11", "swap", mains=(INDICES, QUADRATICS), picks=("P1 4.", "P1 5."), group="p1"),
    Rule("WMA11", "swap", mains=(SIMULTANEOUS,), picks=("P1 4.", "P1 5."), text_lacks=(GRAPHICAL,), group="p1"),
    Rule("WMA11", "swap", mains=(INDICES, QUADRATICS), picks=("P1 2.", "P1 3."), group="p1"),
    Rule("WMA11", "swap", mains=(SIMULTANEOUS,), picks=("P1 2.", "P1 3."), text_lacks=(GRAPHICAL,), group="p1"),
    Rule("WMA11", "swap", mains=(INDICES,), picks=(QUADRATICS, SIMULTANEOUS), group="p1"),
    Rule("WMA12", "swap", mains=("P2 2.1:",), bars=("P2 2.1",), group="p2"),
    Rule("WMA12", "swap", mains=("P2 5.1-5.2:",), picks=("P2 5.3:",), group="p2"),
    Rule("WMA12", "swap", mains=("P2 6.1:",), picks=("P2 6.2:",), text_lacks=("≡",), group="p2"),
    Rule("WMA12", "swap", mains=("P2 6.2:",), picks=("P2 6.1:",), text_has=("≡",), group="p2"),
    Rule("WMA13", "swap", mains=("P3 1.1:",), picks=("P3 2.", "P3 3.3", "P3 4.", "P3 5.", "P3 6."), group="p3"),
    Rule("WMA13", "swap", mains=("P3 1.2",), picks=("P3 1.1:",), group="p3"),
    Rule("WMA13", "swap", mains=("P3 3.1-3.2:",), picks=("P3 3.3", "P3 4.", "P3 5.", "P3 6."), group="p3"),
    Rule("WMA14", "swap", mains=("P4 2.1:",), picks=("P4 3.", "P4 4.", "P4 5.", "P4 6."), group="p4"),
    Rule("WMA14", "swap", mains=("P4 7.1-7.5:",), picks=("P4 7.6", "P4 7.7"), group="p4"),
    Rule("WME01", "swap", mains=("M1 1.1 & 2.1-2.2:",), text_has=(MOTION_WORDS,), least=ENOUGH_MATHS, short=True),
    Rule("WST01", "yield", mains=("S1 1.1 & 2.1:",), picks=("S1 4.",), text_has=(SCATTER_WORDS,), text_lacks=(DIAGRAM_WORDS,), least=ENOUGH_MATHS, group="s1"),
    Rule("WST01", "yield", mains=("S1 1.1 & 2.1:",), picks=("S1 2.2-2.4:",), text_lacks=(DIAGRAM_WORDS,), least=ENOUGH_MATHS, group="s1"),
    Rule("WST01", "become", "S1 6.1b:", mains=("S1 6.1a:",), text_has=(UNKNOWN_WORDS, BOTH_UNKNOWN), least=ENOUGH_MATHS),
    Rule("WST01", "add", "S1 6.1a:", mains=("S1 6.1b:",), text_has=(UNKNOWN_WORDS, BOTH_UNKNOWN), least=ENOUGH_MATHS),
    Rule("WST01", "become", "S1 6.1a:", mains=("S1 6.1b:",), text_has=(UNKNOWN_WORDS,), text_lacks=(BOTH_UNKNOWN,), least=ENOUGH_MATHS),
    Rule("WST01", "add", "S1 6.1b:", mains=("S1 6.1a:",), text_has=(UNKNOWN_WORDS,), text_lacks=(BOTH_UNKNOWN,), least=ENOUGH_MATHS),
    Rule("WST01", "remove", mains=("S1 6.1a:", "S1 6.1b:"), picks=("S1 6.1b:",), text_lacks=(UNKNOWN_WORDS,), least=ENOUGH_MATHS),
    Rule("WST01", "become", "S1 6.1a:", mains=("S1 6.1b:",), text_lacks=(UNKNOWN_WORDS,), least=ENOUGH_MATHS),
]
