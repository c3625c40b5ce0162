"""Fixed values of the data model."""

# The descriptive columns of the wide table. Every other column
# of such a table is one position of the measured axis.
METADATA_COLUMNS = (
    "id",
    "sample_type",
    "group",
    "group_fam",
    "timepoint",
    "person_code",
    "sample_code",
    "age_years",
    "height_cm",
    "bodyweight_kg",
    "bodyfat_kg",
    "bodyfat_perc",
    "ffm_kg",
    "ffm_%",
    "h2o_L",
    "h20_perc",
    "anaerobicthreshold_relative",
    "anaerobicthreshold_bpm",
    "anaerobicthreshold_absolute",
    "respiratorycompensation_relative",
    "respiratorycompensation_bpm",
    "respiratorycompensation_absolute",
    "vo2max_relative",
    "vo2max_bpm",
    "vo2max_absolute",
    "erythrocytes",
    "hemoglobine",
    "hematocrit",
    "mgv",
    "mch",
    "mchc",
    "rdw",
    "leukocytes",
    "neutrophiles",
    "eosinophils",
    "basophils",
    "lymphocytes",
    "monocytes",
    "platetes",
    "salivarycortisol",
    "salivarytestosterone",
    "il_10",
    "vo2max_classes",
    "vo2max_classes_simplified",
    "bodyfat_classes",
    "bodyfat_classes_simplified",
    "path_length",
)

# Those of the above that hold text; the rest are numbers.
TEXT_METADATA = (
    "id",
    "sample_type",
    "group",
    "group_fam",
    "timepoint",
    "person_code",
    "sample_code",
    "vo2max_classes",
    "vo2max_classes_simplified",
    "bodyfat_classes",
    "bodyfat_classes_simplified",
)

# Cell texts of a CSV file that stand for "missing".
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Seed, gate in percent, metric, excluded band, sizes.
DEFAULT_SEED = 52
BALANCED_ACCURACY_GATE = 70
MAIN_METRIC = "acc"
EXCLUDED_BAND = (1850.0, 2500.0)
TOP_POSITIONS = 20
DEFAULT_COMPONENTS = 10
SMOTE_NEIGHBOURS = 5
CV_FOLDS = 5
SAMPLED_TRIALS = 50
KEPT_TRIALS = 5
PERMUTATION_REPEATS = 5

# Display names of the models and searches.
MODEL_NAMES = {
    "random_forest": "Random Forest",
    "mlp_classifier": "MLP",
    "decision_tree": "Decision Tree",
    "xgboost": "XGBoost",
}
SEARCH_NAMES = {"grid": "GridSearchCV", "bayes": "BayesSearchCV"}

# The nine columns that identify one setting, in nesting order.
SETTING_COLUMNS = (
    "search_to_use",
    "model_type",
    "train_percentage",
    "sample_type",
    "target",
    "scale",
    "apply_pls",
    "apply_smote_resampling",
    "n_components",
)
