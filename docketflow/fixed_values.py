"""Values that must be exactly these for results to match; every operator also takes them as parameters."""

# --- fixed values -----------------------------------------------------------------------------

# Courts harvested, and the years each one covers.
COURTS = [
    "UKPC", "UKHL", "UKSC", "EWCA/Civ", "EWCA/Crim", "EWHC/Admin", "EWHC/Admlty", "EWHC/Ch", "EWHC/Comm",
    "EWHC/Costs", "EWHC/Fam", "EWHC/Mercantile", "EWHC/Patents", "EWHC/QB", "EWHC/TCC",
]
DEFAULT_YEARS = (2000, 2020)
COURT_YEARS = {"UKHL": (2000, 2009), "UKSC": (2009, 2020)}

# Site the index pages and judgments live on, and the redirect prefix dropped from links.
HOST = "https://www.bailii.org"
REDIRECT_PREFIX = "cgi-bin/redirect.cgi?path=/"

# Keyword spellings (matched case-sensitively) and the tags written for them.
KEYWORDS = ("animal", "Animal")
MENTION = "animal_mention"
NO_MENTION = "no_mention"
NO_JUDGMENT = "no_judgment_on_bailii"
BROKEN_LINK_MARK = "\ufffd"
NEXT_PAGE_MARK = "Next 10"

# Field names used in front of the values of a harvested line.
LINE_FIELDS = ("Line", "Personal_code", "Case", "Year", "Link", "Animal")

# Phrases removed from the page text before anything else.
BOILERPLATE = (
    "@media screen", "@media print", "#screenonly", "BAILII", "Multidatabase Search", "World Law",
)

# URL patterns, each applied at the start of a line, in this order.
URL_PATTERNS = (r"^https?:\/\/.*[\r\n]*", r"^http?:\/\/.*[\r\n]*", r"^ftp?:\/\/.*[\r\n]*")

# Tag pattern, non-greedy and within one line.
TAG_PATTERN = "<.*?>"

# The 29 characters deleted as punctuation.
PUNCTUATION = "!()-[]{};:'\"\\,<>./?@#$%^&*_\u00a9~"

# Characters deleted after the leading words are dropped.
CONTROL_SPACES = "\n\r\t\u00a0\u000c"

# Sizes: words dropped from the front, words skipped by whole sentences, sentence length and count limits.
FIRST_WORDS = 200
SKIP_WORDS = 199
MAX_SENTENCE_CHARS = 1000
MAX_SENTENCES = 5000

# Long-document encoder: tokens per chunk (without the two markers) and the padding values.
MAX_CHUNK_TOKENS = 4094
PAD_TOKEN = 1
PAD_ATTENTION = 0
ENCODER_BATCH = 2

# Label corrections by link.
CORRECTIONS = {HOST + "/ew/cases/EWHC/Admin/2002/908.html": 1}

# Labelling sample sizes, test share, folds, seed.
FIRST_SAMPLE = 200
SECOND_SAMPLE = 300
TEST_SHARE = 0.2
FOLDS = 5
SEED = 1

# Search grids.
TFIDF_GRID = {
    "lemmas": (True, False),
    "ngrams": (1, 2),
    "max_df": (0.6, 0.7, 0.8),
    "min_df": (1, 2, 3),
    "max_features": (500, 1000),
}
SVM_TFIDF_C = (0.1, 1, 2, 5)
SVM_EMBEDDING_C = (0.1, 1, 2, 5, 10)
# Endings of verbs and what stands in their place, from the public rules of English morphology that dictionaries look words up by.
VERB_ENDINGS = (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""))
SVM_LOSSES = ("hinge", "squared_hinge")
MLP_GRID = {
    "epochs": (10, 20, 50, 100),
    "learning_rate": (0.1, 0.01, 0.001),
    "dropout": (0.2, 0),
}
MLP_EMBEDDING_UNITS = (16, 8, 4, 2)     # input size divided by these
MLP_TFIDF_UNITS = (20, 10, 4, 2)

# Published confusion counts on 100 test rows: (true pos, false pos, false neg, true neg).
PUBLISHED_COUNTS = {
    "base_pred": (17, 83, 0, 0),
    "tfidf_pred": (12, 2, 5, 81),
    "USE_sk_pred": (11, 3, 6, 80),
    "sBERT_sk_pred": (12, 8, 5, 75),
    "tfidf_keras_pred": (10, 6, 7, 77),
    "USE_keras_pred": (14, 10, 3, 73),
    "sBERT_keras_pred": (13, 12, 4, 71),
}
PERMUTATIONS = 10_000
SIGNIFICANCE = 0.05

# Coefficients listed at each end of the feature report, and the value above which one is drawn as positive.
TOP_FEATURES = 10
POSITIVE_ABOVE = 0.5
