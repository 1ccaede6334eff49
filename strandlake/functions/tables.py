"""Genetic codes and scoring matrices.

The standard code comes from its base order; every other code is stated by what it changes.  BLOSUM62, the default
matrix, is stated; the two DNA matrices follow from a rule; any other matrix is read from a file in the usual
text form (a header line of letters, then a letter and its scores a line).
"""

from __future__ import annotations

import itertools

#: Fixed: amino acids of the standard code, codons in order of U, C, A, G.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

#: Fixed: NCBI number, name, number of the code it changes, and the changes.
CODES: list[tuple[int, str, int, dict[str, str]]] = [
    (1, "standard", 1, {}),
    (2, "vertebrate_mitochondrial", 1, {"AUA": "M", "UGA": "W", "AGA": "*", "AGG": "*"}),
    (3, "yeast_mitochondrial", 1, {"CUU": "T", "CUC": "T", "CUA": "T", "CUG": "T", "AUA": "M", "UGA": "W"}),
    (4, "mold_protozoan_mitochondrial", 1, {"UGA": "W"}),
    (5, "invertebrate_mitochondrial", 1, {"AUA": "M", "UGA": "W", "AGA": "S", "AGG": "S"}),
    (6, "ciliate_nuclear", 1, {"UAA": "Q", "UAG": "Q"}),
    (9, "echinoderm_flatworm_mitochondrial", 1, {"AUA": "M", "UGA": "W", "AGA": "S", "AGG": "S", "AAA": "N"}),
    (10, "euplotid_nuclear", 1, {"UGA": "C"}),
    (11, "bacterial_archaeal_plastid", 1, {}),
    (12, "alternative_yeast_nuclear", 1, {"CUG": "S"}),
    (13, "ascidian_mitochondrial", 1, {"AUA": "M", "UGA": "W", "AGA": "G", "AGG": "G"}),
    (14, "alternative_flatworm_mitochondrial", 9, {"UAA": "Y"}),
    (15, "blepharisma_nuclear", 1, {"UAG": "Q"}),
    (16, "chlorophycean_mitochondrial", 1, {"UAG": "L"}),
    (21, "trematode_mitochondrial", 9, {"ATA": "M"}),
    (22, "scenedesmus_mitochondrial", 1, {"TCA": "*", "UAG": "L"}),
    (23, "thraustochytrium_mitochondrial", 11, {"TTA": "*"}),
    (24, "rhabdopleuridae_mitochondrial", 1, {"UGA": "W", "AGA": "S", "AGG": "K"}),
    (25, "candidate_division_sr1_gracilibacteria", 1, {"UGA": "G"}),
    (26, "pachysolen_tannophilus_nuclear", 1, {"CUG": "A"}),
    (27, "karyorelict_nuclear", 1, {"UAA": "Q", "UAG": "Q", "UGA": "*"}),
    (28, "condylostoma_nuclear", 1, {"UAA": "Q", "UAG": "Q", "UGA": "W"}),
    (29, "mesodinium_nuclear", 1, {"UAA": "Y", "UAG": "Y"}),
    (30, "peritrich_nuclear", 1, {"UAA": "E", "UAG": "E"}),
    (31, "blastocrithidia_nuclear", 1, {"UGA": "W", "UAA": "E", "UAG": "E"}),
    (32, "balanophoraceae_plastid", 1, {"UAG": "W"}),
    (33, "cephalodiscidae_mitochondrial", 24, {"UAA": "Y"}),
]


def _build() -> dict[int, dict[str, str]]:
    out: dict[int, dict[str, str]] = {}
    base = {"".join(c): a for c, a in zip(itertools.product("UCAG", repeat=3), STANDARD, strict=True)}
    for number, _, parent, changes in CODES:
        out[number] = {**out.get(parent, base), **changes}
    return out


_TABLES = _build()
_NAMES = {name: number for number, name, _, _ in CODES}


def codon_table(key: int | str = "standard") -> dict[str, str]:
    """Amino acid of each codon, RNA and DNA spelling; an unknown key is the standard code.

    A code that states a change in DNA spelling changes that spelling alone.
    """
    number = int(key) if str(key).isdigit() else _NAMES.get(str(key), 1)
    own = _TABLES.get(number, _TABLES[1])
    out: dict[str, str] = {}
    for codon, amino in own.items():
        out[codon] = amino
        out[codon.replace("U", "T")] = amino
    return out


#: Fixed: order of the amino acids, and the lower triangle of BLOSUM62 in it.
AMINO = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""

Matrix = dict[tuple[str, str], float]


def _triangle(text: str, order: str) -> Matrix:
    out: Matrix = {}
    for i, line in enumerate(text.split("\n")[1:-1]):
        for j, v in enumerate(line.split()):
            out[order[i], order[j]] = out[order[j], order[i]] = int(v)
    return out


def _dna(transition: int) -> Matrix:
    """Match 5, mismatch -4, transition as given; U is T, N matches nothing."""
    kind = {"A": 0, "G": 0, "C": 1, "T": 1, "U": 1}
    same = lambda a, b: a.replace("U", "T") == b.replace("U", "T")
    return {(a, b): -4 if "N" in (a, b) else 5 if same(a, b) else transition if kind[a] == kind[b] else -4 for a in "ACGTUN" for b in "ACGTUN"}


MATRICES: dict[str, Matrix] = {"BLOSUM62": _triangle(BLOSUM62, AMINO), "DNA_SIMPLE": _dna(-4), "DNA_FULL": _dna(-1)}


def parse_matrix(text: str) -> Matrix:
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {(row[0].upper(), c.upper()): float(v) for row in lines[1:] for c, v in zip(lines[0], row[1:], strict=False)}


def load_matrix(name: str, path: str) -> Matrix:
    """Reads a matrix file (BLOSUM45, PAM250 and the like; none ships) and registers it under the name."""
    with open(path) as f:
        MATRICES[name.upper()] = parse_matrix(f.read())
    return MATRICES[name.upper()]


def get_matrix(name: str) -> Matrix:
    if (found := MATRICES.get(name.upper())) is None:
        raise ValueError(f"unknown matrix {name}; known: {', '.join(sorted(MATRICES))}; load others with load_matrix")
    return found


def get_score(matrix: Matrix, a: str, b: str) -> float:
    """Whatever the case; 0 for letters that the matrix lacks."""
    return matrix.get((a.upper(), b.upper()), 0)
