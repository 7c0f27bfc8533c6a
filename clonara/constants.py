"""Fixed values the results depend on."""

# The twenty standard amino acids.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# Hydropathy, side-chain volume and charge per amino acid.
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2,
    "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5,
    "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
VOLUME = {
    "A": 88.6, "C": 108.5, "D": 111.1, "E": 138.4, "F": 189.9, "G": 60.1, "H": 153.2,
    "I": 166.7, "K": 168.6, "L": 166.7, "M": 162.9, "N": 114.1, "P": 112.7, "Q": 143.8,
    "R": 173.4, "S": 89.0, "T": 116.1, "V": 140.0, "W": 227.8, "Y": 193.6,
}
CHARGE = {"D": -1.0, "E": -1.0, "H": 0.5, "K": 1.0, "R": 1.0}

# Atchley factors (polarity, secondary structure, volume, codon diversity, charge).
ATCHLEY_NAMES = ["PAF", "PSS", "POS", "COD", "ENT"]
ATCHLEY = {
    "A": (-0.591, -1.302, -0.733, 1.570, -0.146),
    "C": (-1.343, 0.465, -0.862, -1.020, -0.255),
    "D": (1.050, 0.302, -3.656, -0.259, -3.242),
    "E": (1.357, -1.453, 1.477, 0.113, -0.837),
    "F": (-1.006, -0.590, 1.891, -0.397, 0.412),
    "G": (-0.384, 1.652, 1.330, 1.045, 2.064),
    "H": (0.336, -0.417, -1.673, -1.474, -0.078),
    "I": (-1.239, -0.547, 2.131, 0.393, 0.816),
    "K": (1.831, -0.561, 0.533, -0.277, 1.648),
    "L": (-1.019, -0.987, -1.505, 1.266, -0.912),
    "M": (-0.663, -1.524, 2.219, -1.005, 1.212),
    "N": (0.945, 0.828, 1.299, -0.169, 0.933),
    "P": (0.189, 2.081, -1.628, 0.421, -1.392),
    "Q": (0.931, -0.179, -3.005, -0.503, -1.853),
    "R": (1.538, -0.055, 1.502, 0.440, 2.897),
    "S": (-0.228, 1.399, -4.760, 0.670, -2.647),
    "T": (-0.032, 0.326, 2.213, 0.908, 1.313),
    "V": (-1.337, -0.279, -0.544, 1.242, -1.262),
    "W": (-0.595, 0.009, 0.672, -2.128, -0.184),
    "Y": (0.260, 0.830, 3.097, -0.838, 1.512),
}

# Per-dataset mining thresholds, class weights, blend weights and list sizes.
MINE_MIN_FREQ = {7: 0.10, 8: 0.12}
MINE_MIN_FREQ_DEFAULT = 0.15
MINE_ENRICH = {7: 3.0, 8: 4.0}
MINE_ENRICH_DEFAULT = 5.0
MINE_TOP_N = {7: 6000, 8: 4000}
MINE_TOP_N_DEFAULT = 2500
MODEL_TOP_N = {7: 5000, 8: 3000}
MODEL_TOP_N_DEFAULT = 2000
CLASS_WEIGHT = {7: 5.0, 8: 2.0}
CLASS_WEIGHT_DEFAULT = 1.0
BLEND_WEIGHT = {5: 1.0, 6: 1.0, 7: 0.85, 8: 0.85}
BLEND_WEIGHT_DEFAULT = 0.9
IMPORTANCE_WEIGHTS = {"deep_boost": 0.30, "shallow_boost": 0.30, "forest": 0.25, "logreg": 0.15}

# Output format.
SENTINEL = "-999.0"
SENTINEL_PROBABILITY = -999.0
DEFAULT_V, DEFAULT_J = "TRBV20-1", "TRBJ2-7"
PLACEHOLDER_SEQUENCE = "CASSXXXXF"
SUBMISSION_COLUMNS = ["ID", "dataset", "label_positive_probability", "junction_aa", "v_call", "j_call"]
EXPECTED_ROWS = 404213
SEQUENCES_PER_DATASET = 50000

REP = ["dataset", "repertoire_id"]
