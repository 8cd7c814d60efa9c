"""Element dimensions: small fixed tables, at most a few hundred rows in total.

They are the only frames this library broadcasts by hint; their size does not
depend on the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.functions.physics import BOHR_RADIUS_PM
from saltmarsh.session import small_table

# Candidate oxidation states, tried in this order.
OXIDATION_STATES_TEXT = """
Ag 1
Al 3
As 5
B 3
Ba 2
Bi 3 5
Br -1
C 4
Ca 2
Cd 2
Ce 3 4
Cl -1
Co 2 3
Cr 2 3 6
Cu 1 2
Er 3
F -1
Fe 2 3
Ga 3
Gd 3
Ge 4
H 1 -1
Hf 4
I -1
In 3
K 1
La 3
Li 1
Lu 3
Mg 2
Mn 2 3 4
Mo 4 5 6
N -3 3 5
Na 1
Nb 5
Nd 3
O -2
P 5 -3 4
Pb 2 4
Pr 3 4
S -2 4 6
Sb 3 5
Sc 3
Se -2 4 6
Si 4
Sm 3
Sn 4 2
Sr 2
Ta 5
Te -2 4 6
Ti 3 4
V 2 3 4 5
W 5 6
Y 3
Zn 2
Zr 4
"""

# Common states of further elements, used when the list above has none.
COMMON_STATES_TEXT = """
Au 3
Be 2
Cs 1
Dy 3
Eu 2 3
Hg 1 2
Ho 3
Ir 3 4
Ni 2
Os 4
Pd 2 4
Pt 2 4
Rb 1
Re 4
Rh 3
Ru 3 4
Tb 3
Th 4
Tl 1 3
Tm 3
U 6
Yb 3
"""

# Radii that replace the table, and charges that borrow another's radius.
RADIUS_OVERRIDES_PM = {("H", 1): 0.0, ("H", -1): 140.0, ("P", -3): 212.0}
RADIUS_BORROWED_CHARGE = {("P", 4): 5}

# Element charge coordination radius_pm, "*" marks the most reliable
# entries (crystal-radius tables published in 1976).
IONIC_RADII_TEXT = """
Ag 1 VI 115
Al 3 IV 39 *
Al 3 V 48
Al 3 VI 53.5 *
As 5 IV 33.5 *
As 5 VI 46 *
B 3 IV 11 *
B 3 VI 27
Ba 2 VI 135
Bi 3 VI 103 *
Bi 5 VI 76
Br -1 VI 196
C 4 IV 15
C 4 VI 16
Ca 2 VI 100
Cd 2 VI 95
Ce 3 VI 101
Ce 4 VI 87
Cl -1 VI 181
Co 2 VI 74.5
Co 3 VI 61
Cr 2 VI 80
Cr 3 VI 61.5 *
Cr 6 IV 26
Cr 6 VI 44
Cs 1 VI 167
Cu 1 VI 77
Cu 2 VI 73
Er 3 VI 89 *
F -1 II 128.5
F -1 III 130
F -1 IV 131
F -1 VI 133
Fe 2 VI 78
Fe 3 VI 64.5 *
Ga 3 IV 47 *
Ga 3 VI 62 *
Gd 3 VI 93.8
Ge 4 IV 39 *
Ge 4 VI 53 *
Hf 4 VI 71
I -1 VI 220
In 3 IV 62
In 3 VI 80 *
K 1 VI 138
La 3 VI 103.2
La 3 VII 110
La 3 VIII 116
La 3 IX 121.6
La 3 X 127
La 3 XII 136
Li 1 IV 59 *
Li 1 VI 76 *
Li 1 VIII 92
Lu 3 VI 86.1 *
Mg 2 IV 57
Mg 2 VI 72 *
Mn 2 VI 83
Mn 3 VI 64.5
Mn 4 VI 53 *
Mo 4 VI 65
Mo 5 VI 61
Mo 6 IV 41 *
Mo 6 VI 59 *
N -3 IV 146
N 3 VI 16
N 5 VI 13
Na 1 VI 102
Nb 5 VI 64
Nd 3 VI 98.3 *
Ni 2 VI 69 *
O -2 II 135
O -2 III 136
O -2 IV 138
O -2 VI 140
O -2 VIII 142
P 5 IV 17 *
P 5 V 29
P 5 VI 38
Pb 2 VI 119
Pb 4 VI 77.5 *
Pr 3 VI 99 *
Pr 4 VI 85
Rb 1 VI 152
S -2 VI 184
S 4 VI 37
S 6 IV 12 *
S 6 VI 29
Sb 3 VI 76
Sb 5 VI 60
Sc 3 VI 74.5 *
Se -2 VI 198
Se 4 VI 50
Se 6 IV 28 *
Se 6 VI 42
Si 4 IV 26 *
Si 4 VI 40 *
Sm 3 VI 95.8
Sn 2 VIII 122
Sn 4 IV 55 *
Sn 4 VI 69 *
Sr 2 VI 118
Ta 5 VI 64
Te -2 VI 221
Te 4 VI 97
Te 6 VI 56 *
Ti 3 VI 67 *
Ti 4 IV 42
Ti 4 VI 60.5 *
V 2 VI 79
V 3 VI 64 *
V 4 VI 58 *
V 5 IV 35.5 *
V 5 VI 54
W 5 VI 62
W 6 IV 42 *
W 6 VI 60 *
Y 3 VI 90 *
Y 3 VII 96
Y 3 VIII 101.9 *
Yb 3 VI 86.8 *
Zn 2 IV 60 *
Zn 2 VI 74 *
Zr 4 IV 59
Zr 4 V 66
Zr 4 VI 72 *
Zr 4 VII 78 *
Zr 4 VIII 84 *
Zr 4 IX 89
"""

# Symbol number electronegativity mass melting_K bond_radius_pm
# s_shell s_effective_charge common_charge ("-" is unknown).  Bond radius is the
# single-bond metallic radius for metals, else the covalent radius.
ELEMENT_PROPERTIES_TEXT = """
Ag 47 1.93 107.8682 1234.93 134 5 6.756 1
Al 13 1.61 26.9815386 933.47 125 3 4.1172 3
As 33 2.18 74.9216 1090 121 4 8.944 3
B 5 2.04 10.811 2349 85 2 2.576 3
Ba 56 0.89 137.327 1000 198 6 7.575 2
Bi 83 2.02 208.9804 544.4 151 6 13.34 3
Br 35 2.96 79.904 265.8 114 4 9.028 -1
C 6 2.55 12.0107 3800 75 2 3.217 4
Ca 20 1.00 40.078 1115 174 4 4.398 2
Cd 48 1.69 112.411 594.22 141 5 8.192 2
Ce 58 1.12 140.116 1068 165 6 10.8 3
Cl 17 3.16 35.453 171.6 99 3 7.068 -1
Co 27 1.88 58.933195 1768 116 4 5.576 2
Cr 24 1.66 51.9961 2180 118 4 5.133 3
Cs 55 0.79 132.9054519 301.59 235 6 6.363 1
Cu 29 1.90 63.546 1357.77 117 4 5.842 2
Er 68 1.24 167.259 1802 157 6 8.48 3
F 9 3.98 18.9984032 53.53 64 2 5.128 -1
Fe 26 1.83 55.845 1811 117 4 5.434 3
Ga 31 1.81 69.723 302.91 125 4 7.067 3
Gd 64 1.20 157.25 1585 161 6 8.45 3
Ge 32 2.01 72.64 1211.4 121 4 8.044 4
H 1 2.20 1.00794 14.01 32 1 1.0 1
Hf 72 1.30 178.49 2506 144 6 9.165 4
I 53 2.66 126.90447 386.85 133 5 11.612 -1
In 49 1.78 114.818 429.75 150 5 9.512 3
K 19 0.82 39.0983 336.53 203 4 3.495 1
La 57 1.10 138.90547 1193 169 6 9.312 3
Li 3 0.98 6.941 453.69 123 2 1.2792 1
Lu 71 1.27 174.967 1925 156 6 8.805 3
Mg 12 1.31 24.305 923 136 3 3.308 2
Mn 25 1.55 54.938045 1519 117 4 5.283 2
Mo 42 2.16 95.94 2896 130 5 6.106 6
N 7 3.04 14.0067 63.05 71 2 3.847 -3
Na 11 0.93 22.98976928 370.87 157 3 2.507 1
Nb 41 1.6 92.90638 2750 134 5 5.921 5
Nd 60 1.14 144.242 1297 164 6 9.306 3
Ni 28 1.91 58.6934 1728 115 4 5.711 2
O 8 3.44 15.9994 54.8 63 2 4.492 -2
P 15 2.19 30.973762 317.3 111 3 5.642 5
Pb 82 2.33 207.2 600.61 154 6 12.393 2
Pr 59 1.13 140.90765 1208 165 6 7.746 3
Rb 37 0.82 85.4678 312.46 216 5 4.985 1
S 16 2.58 32.065 388.36 103 3 6.367 -2
Sb 51 2.05 121.76 903.78 140 5 9.631 3
Sc 21 1.36 44.955912 1814 144 4 4.632 3
Se 34 2.55 78.96 494 116 4 9.076 4
Si 14 1.90 28.0855 1687 116 3 4.903 4
Sm 62 1.17 150.36 1345 166 6 8.013 3
Sn 50 1.96 118.71 505.08 140 5 9.102 4
Sr 38 0.95 87.62 1050 191 5 6.071 2
Ta 73 1.5 180.94788 3290 134 6 9.525 5
Te 52 2.1 127.6 722.66 136 5 10.809 4
Ti 22 1.54 47.867 1941 132 4 4.817 4
V 23 1.63 50.9415 2183 122 4 4.981 5
W 74 2.36 183.84 3695 130 6 9.854 6
Y 39 1.22 88.90585 1799 162 5 6.256 3
Zn 30 1.65 65.409 692.68 125 4 5.965 2
Zr 40 1.33 91.224 2128 145 5 6.4455 4
"""

# Ground states that leave the filling rule, as shell occupations.
FILLING_EXCEPTIONS = {
    "Cr": {(4, 0): 1, (3, 2): 5},
    "Cu": {(4, 0): 1, (3, 2): 10},
    "Nb": {(5, 0): 1, (4, 2): 4},
    "Mo": {(5, 0): 1, (4, 2): 5},
    "Ag": {(5, 0): 1, (4, 2): 10},
    "La": {(4, 3): 0, (5, 2): 1},
    "Ce": {(4, 3): 1, (5, 2): 1},
    "Gd": {(4, 3): 7, (5, 2): 1},
}

HALIDES = ("Br", "Cl", "F", "I")
ANION_FORMERS = ("Br", "Cl", "F", "I", "N", "O", "P", "S", "Se", "Te")
NEUTRAL_ORGANIC = ("C", "H", "N", "O")


def _states(text: str) -> dict[str, list[float]]:
    rows = [line.split() for line in text.strip().splitlines()]
    return {row[0]: [float(v) for v in row[1:]] for row in rows}


def subshell_counts(symbol: str, number: int) -> dict[tuple[int, int], int]:
    """Electrons per (shell, kind) by the n+l filling rule plus known exceptions."""
    order = sorted(((n, k) for n in range(1, 8) for k in range(4) if k < n), key=lambda s: (sum(s), s[0]))
    counts, left = {}, number
    for shell, kind in order:
        taken = min(left, 4 * kind + 2)
        counts[(shell, kind)] = taken
        left -= taken
    counts.update(FILLING_EXCEPTIONS.get(symbol, {}))
    return counts


def candidate_states() -> dict[str, list[float]]:
    """Configured states, else common states."""
    return _states(COMMON_STATES_TEXT) | _states(OXIDATION_STATES_TEXT)


def element_rows() -> list[tuple]:
    """One row per element with known properties; unknown numbers are 0 as a rule."""
    rows = []
    states = candidate_states()
    for line in ELEMENT_PROPERTIES_TEXT.strip().splitlines():
        symbol, number, chi, mass, melt, bond, shell, charge, common = line.split()
        counts = subshell_counts(symbol, int(number))
        s_count = float(sum(v for (_, kind), v in counts.items() if kind == 0))
        d_count = float(sum(v for (_, kind), v in counts.items() if kind == 2))
        radius = BOHR_RADIUS_PM * int(shell) ** 2 / float(charge)
        rows.append((
            symbol, int(number), float(chi), float(mass), float(melt), float(bond), s_count, d_count,
            math.pi * radius**3, float(common), states.get(symbol, [0.0]),
        ))
    return rows


ELEMENT_SCHEMA = (
    "element string, number int, chi double, mass double, melting_k double, bond_radius double, "
    "s_electrons double, d_electrons double, s_volume double, common_charge double, states array<double>"
)


def element_dim(spark: SparkSession) -> DataFrame:
    return small_table(spark, element_rows(), ELEMENT_SCHEMA)


def candidate_rows() -> list[tuple]:
    return sorted(candidate_states().items())


def candidate_dim(spark: SparkSession) -> DataFrame:
    """Element -> oxidation states to try."""
    return small_table(spark, candidate_rows(), "element string, states array<double>")


def radius_entries() -> list[tuple]:
    rows = []
    for line in IONIC_RADII_TEXT.strip().splitlines():
        parts = line.split()
        rows.append((parts[0], int(parts[1]), float(parts[3]), len(parts) == 5))
    return rows


def radius_rows() -> list[tuple[str, int, float]]:
    """(element, charge) -> radius: override, borrowed charge, reliable mean, plain mean."""
    entries: dict[tuple[str, int], list[tuple[float, bool]]] = {}
    for element, charge, radius, reliable in radius_entries():
        entries.setdefault((element, charge), []).append((radius, reliable))
    means = {}
    for pair, values in entries.items():
        chosen = [r for r, reliable in values if reliable] or [r for r, _ in values]
        means[pair] = sum(chosen) / len(chosen)
    lent = {(e, c): means[(e, other)] for (e, c), other in RADIUS_BORROWED_CHARGE.items()}
    return [(e, c, r) for (e, c), r in sorted((means | lent | RADIUS_OVERRIDES_PM).items())]


def radius_dim(spark: SparkSession) -> DataFrame:
    return small_table(spark, radius_rows(), "element string, charge int, radius_pm double")
