"""Results depend on them, so they are stated once, here."""

SEED = 42
N_FOLDS = 5

# Text that stands for "not recorded". "none" and "unknown" are real categories.
MISSING_TOKENS = ["", "NA", "na", "N/A", "n/a", "NaN", "nan"]

# Families that say nothing about kinship.
UNKNOWN_FAMILIES = ["unknown", "none", "NA"]

REQUIRED_COLUMNS = [
    "standardized_filename", "original_stem", "species", "bird", "display_name",
    "call_type", "n_calls", "recording_id", "date", "location",
    "environment_class", "stimulus_only", "sex", "age_years", "social_group",
    "kind", "rel_audio_path", "aviary", "birth_year", "sibling_group",
]

STAMP_COLUMNS = ["run_id", "env_hash", "config_hash"]

# Model panel: name, family.
MODEL_PANEL = [
    ("birdnet", "bird_supervised"),
    ("perch_bird", "bird_supervised"),
    ("perch_v2", "bird_supervised"),
    ("surfperch", "bird_supervised"),
    ("convnext_birdset", "bird_supervised"),
    ("audioprotopnet", "bird_supervised"),
    ("avesecho_passt", "bird_supervised"),
    ("birdmae", "bird_supervised"),
    ("birdaves_especies", "animal_ssl"),
    ("aves_especies", "animal_ssl"),
    ("beats", "audio_ssl"),
    ("audiomae", "audio_ssl"),
    ("biolingual", "audio_text"),
    ("ecapa_tdnn", "speech_speaker"),
    ("wavlm_base_plus_sv", "speech_speaker"),
    ("mfcc_lakdari", "handcrafted"),
    ("mfcc_full", "handcrafted"),
    ("mfcc_cmvn", "handcrafted"),
]

# Spectral features.
SAMPLE_RATE = 16000
WINDOW_SECONDS = 0.025
HOP_SECONDS = 0.010
FMIN_HZ = 500.0
FMAX_HZ = 8000.0
N_MELS = 40
MFCC_VARIANTS = {
    "mfcc_lakdari": {"n_mfcc": 12, "deltas": False, "cmvn": False},
    "mfcc_full": {"n_mfcc": 20, "deltas": True, "cmvn": False},
    "mfcc_cmvn": {"n_mfcc": 20, "deltas": True, "cmvn": True},
}
MIN_SECONDS = 1.0

# Learned head and its evaluations.
PROJECTION_DIM = 128
TEMPERATURE = 0.1
LEARNING_RATE = 0.01
WEIGHT_DECAY = 0.001
MAX_EPOCHS = 200
PATIENCE = 20
MIN_IMPROVEMENT = 1e-4
VALIDATION_FRACTION = 0.15
SUPPORT_FRACTION = 0.5
LOSSES = ["proto", "supcon"]
HOLDOUT_INDIVIDUALS = 3
HOLDOUT_REPEATS = 12
KNOWN_TEST_FRACTION = 0.2
KNN_K = 5
FEW_SHOT_SHOTS = [1, 5]
FEW_SHOT_DRAWS = 5

# Diagnostics.
MIN_ITEMS_PER_GROUP = 3
MIN_ITEMS_PER_UNIT = 12
MIN_ROWS = 20
N_PERMUTATIONS = 2000
THINNING_CONDITIONS = [(6, 2), (4, 3), (3, 4), (2, 6)]  # (groups per individual, items per group)
THINNING_DRAWS = 12
POOLED = "__pooled__"
