"""Residue scales."""

from __future__ import annotations

# Published residue scales and pKa values; results must equal those of any other implementation of them.
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
CHARGE = {"R": 1.0, "K": 1.0, "H": 0.1, "D": -1.0, "E": -1.0}
BETA_SHEET = {"A": 0.83, "R": 0.93, "N": 0.89, "D": 0.54, "C": 1.19, "Q": 1.10, "E": 0.37, "G": 0.75, "H": 0.87, "I": 1.60, "L": 1.30, "K": 0.74, "M": 1.05, "F": 1.38, "P": 0.55, "S": 0.75, "T": 1.19, "W": 1.37, "Y": 1.47, "V": 1.70}
BETA_STRAND = {"V": 1.00, "I": 0.95, "Y": 0.85, "F": 0.80, "W": 0.75, "L": 0.70, "T": 0.65, "C": 0.60, "A": 0.45, "M": 0.40, "G": 0.35, "S": 0.30, "H": 0.25, "Q": 0.20, "N": 0.15, "E": 0.10, "D": 0.05, "K": 0.05, "R": 0.05, "P": 0.00}
AGGREGATION = {"I": 1.822, "V": 1.392, "F": 1.254, "L": 1.019, "W": 0.596, "M": 0.513, "A": 0.285, "Y": 0.167, "C": -0.015, "T": -0.160, "G": -0.189, "S": -0.370, "H": -0.421, "Q": -0.569, "N": -0.662, "E": -0.835, "D": -0.982, "K": -1.042, "R": -1.142, "P": -1.411}
POSITIVE_PKA = {"K": 10.5, "R": 12.5, "H": 6.0}
NEGATIVE_PKA = {"D": 3.9, "E": 4.1, "C": 8.3, "Y": 10.1}
N_TERMINUS, C_TERMINUS = 9.0, 2.0
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
AROMATIC, STRONG_HYDROPHOBIC, GATEKEEPERS = "FWY", "VILMFWYC", "PGDEKR"


def combined_scale() -> dict[str, float]:
    """Strand propensity and hydropathy in favour, charge against."""
    return {a: 0.4 * (HYDROPATHY[a] + 4.5) / 9.0 + 0.6 * b - 0.2 * abs(CHARGE.get(a, 0.0)) for a, b in BETA_STRAND.items()}
