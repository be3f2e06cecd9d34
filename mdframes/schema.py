"""Canonical column sets and the physical constants used across the package."""

from pyspark.sql import types as T

# CODATA constants and unit factors.
AVOGADRO = 6.02214076e23
E_CHARGE_C = 1.602176634e-19
K_B_J_PER_K = 1.380649e-23
K_B_EV_PER_K = 8.617333262145e-5
GAS_CONSTANT_KCAL = 0.00198720425864083
ANG3_TO_CM3 = 1.0e-24
ANG3_TO_DM3 = 1.0e-27

# Element masses (g/mol); anything else counts as carbon.
ELEMENT_MASS = {
    "H": 1.008, "Li": 6.94, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998,
    "Na": 22.990, "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Ge": 72.630,
    "Zr": 91.224, "La": 138.905,
}
DEFAULT_MASS = 12.011

# Element symbols recognised by site normalisation (H to Rn).
ELEMENTS = [
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar", "K",
    "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Ga", "Ge", "As", "Se", "Br", "Kr", "Rb",
    "Sr", "Y", "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn", "Sb", "Te", "I", "Xe", "Cs",
    "Ba", "La", "Ce", "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu", "Hf",
    "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Po", "At", "Rn",
]

CELL = ["a", "b", "c", "alpha", "beta", "gamma"]
XYZ = ["x", "y", "z"]

FRAMES = T.StructType(
    [T.StructField("traj", T.StringType()), T.StructField("frame", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in CELL]
)

ATOMS = T.StructType([
    T.StructField("traj", T.StringType()),
    T.StructField("atom_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("resname", T.StringType()),
    T.StructField("chain", T.StringType()),
    T.StructField("resid", T.LongType()),
    T.StructField("icode", T.StringType()),
    T.StructField("element", T.StringType()),
    T.StructField("atom_type", T.IntegerType()),
])

POSITIONS = T.StructType(
    [T.StructField("traj", T.StringType()), T.StructField("frame", T.LongType()),
     T.StructField("atom_id", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in XYZ]
)

# Run-log measures; every one is nullable because a log reports what it likes.
LOG_ENERGIES = ["potential_kcal_mol", "kinetic_kcal_mol", "total_energy_kcal_mol",
                "temperature_K", "pressure_atm"]
LOG_CELL = ["a_A", "b_A", "c_A", "alpha_deg", "beta_deg", "gamma_deg"]
