"""The default analysis parameters and names."""

# groups, in the order they are compared
DAY0 = "Day0"
TREATED = "treated"

# label names
EXPANSION = "expansion"
CONTRACTION = "contraction"
NEUTRAL = "neutral"

# reads to histogram
CYCLE_MIN = 0
CYCLE_MAX = 500
MOTIF = "CAG"

# instability index
PEAK_SHARE = 0.05

# delta plot
BIN_SIZE = 2
PDF_VIEW = (30, 200)
FULL_VIEW = (0, 200)

# smoothing, change points and segments
SEGMENT_TAU = 0.0075
MIN_LEN = 3
K_SPLINE = 20
SMOOTH_K = 5
IOU_THR = 0.3
MAX_LENGTH = 250

# dataset features
FIRST_N = 175
MIN_ROWS = 30
NEUTRAL_TAU = 0.005
STRONG_TAU = 0.05
ZERO_EPS = 0.0
TRAIN_SHARE = 0.8

# binned clustering
BIN_WIDTH = 1.0
BIN_TAU = 0.0075
N_CLUSTERS = 3
MAX_CLUSTERS = 9
N_START = 50
MAX_ITER = 1000

FEATURES = [
    "mean_delta", "trimmed_mean", "median_delta", "sd_delta", "mad_delta", "skew_delta",
    "iqr_delta", "mean_abs", "prop_pos", "prop_neg", "prop_neutral",
    "prop_strong_pos", "prop_strong_neg", "mix_k", "mix_mu1", "mix_mu2",
    "mix_pi1", "mix_pi2", "mix_sep", "mix_entropy",
]
