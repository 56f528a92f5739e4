"""Fixed values that must equal the reference's for the same results.

Fixed values (kept together, in their natural order):
"""

# Amount column candidates per call site.
AMOUNT_CANDIDATES_ANOMALY = ["amount", "transaction_amount", "amt", "value"]
AMOUNT_CANDIDATES_TRENDS = ["amount", "transaction_amount", "amt"]
AMOUNT_CANDIDATES_PAGE = ["Amount", "amount", "transaction_amount", "txn_amount", "value"]
# Time column candidates on the page.
TIME_CANDIDATES_PAGE = ["Time", "time", "timestamp", "date"]
# Label names recognised by the feature preparation (case-insensitive).
LABEL_NAMES = ["Class", "class", "is_fraud", "IsFraud", "fraud", "Fraud", "label", "Label",
               "is_anomaly", "IsAnomaly"]
# Substrings used by the name-based resolvers.
CUSTOMER_SUBSTRINGS = ["customer", "user"]
DATE_SUBSTRINGS = ["date", "time"]
TRAIN_LABEL_SUBSTRINGS = ["fraud", "label"]
STATS_LABEL_SUBSTRINGS = ["fraud"]
CATEGORY_SUBSTRINGS = ["category", "merchant"]
# Columns left out of a rendered row document.
DOCUMENT_EXCLUDED = ["V1", "V2", "V3", "is_anomaly", "fraud_probability"]
DOCUMENT_SOURCE_FILE = "transactions.csv"
# pandas' default NA tokens when reading CSV.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# Thresholds and sizes.
ZSCORE_THRESHOLD = 3.0
ZSCORE_HIGH = 4.0
FREQUENCY_SIGMAS = 3.0
ONE_HOT_MAX_COLUMNS = 5
ONE_HOT_MAX_VALUES = 50
RISK_LOW = 0.3
RISK_HIGH = 0.7
SMOTE_GATE = 0.1
SMOTE_NEIGHBOURS = 5
TEST_FRACTION = 0.2
SEED = 42
RF_TREES = 100
RF_MAX_DEPTH = 10
RF_MIN_LEAF = 5
IFOREST_TREES = 100
IFOREST_SUBSAMPLE = 256
IFOREST_CONTAMINATION_AGENT = 0.1
IFOREST_CONTAMINATION_PAGE = 0.01
CORPUS_CAP = 1000
SAMPLE_CAP = 1000
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
RETRIEVAL_K = 5
PAGE_RETRIEVAL_K = 4
COLLECTION_NAME = "transactions"
PREVIEW_ROWS = 10
ALERT_ROWS = 10
TOP_CATEGORIES = 5
REPORT_CATEGORIES = 3
# Recursive splitter separators, in the order they are tried.
SPLIT_SEPARATORS = ["\n\n", "\n", " ", ""]

# Prompt templates.
QA_PROMPT = """You are a financial analyst AI assistant specialized in analyzing credit card transactions.
        
Use the following context to answer the question. Be specific, data-driven, and provide actionable insights.

Context: {context}

Question: {question}

Provide a detailed analysis with:
1. Key findings from the data
2. Patterns or trends identified
3. Risk assessment if applicable
4. Actionable recommendations

Answer:"""

# Error texts of the fraud model.
NO_TARGET_TEXT = "No target column found. Cannot train supervised model."
NOT_TRAINED_TEXT = "Fraud model not trained. Call train_fraud_model() first."

# The three questions asked in a full run.
RUN_QUESTIONS = [
    "What are the main spending patterns in this dataset?",
    "Are there any unusual transaction behaviors?",
    "What merchant categories have the highest transaction volumes?",
]


class Limits:
    """Size checks that choose between a bounded single-task / broadcast path
    and the distributed path.  Read at call time, so tests can shrink them
    and run the distributed paths on small tables (``small()``)."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.quantile_max_candidates = 2_000_000   # (value, count) groups ranked in one task
        self.quantile_accuracy = 10_000             # percentile_approx accuracy per narrowing round
        self.mode_values = 1_000_000                # different values that are counted at once for a mode
        self.mode_counters = 10_000                 # counters of a task and column for the mode of more values
        self.dictionary_local = 200_000             # sorted dictionary ranked in one window
        self.dictionary_broadcast = 1_000_000       # label dictionary joined with a broadcast
        self.prefix_local = 200_000                 # prefix sums in one ordered window
        self.prefix_rows_per_partition = 500_000    # range partition size of the distributed form
        self.knn_local = 20_000                     # neighbour candidates kept as a broadcast matrix
        self.knn_block = 2048                       # rows per block of the distributed search
        self.query_block = 1_000                    # top-k queries compared at once
        self.index_block = 4_096                    # items of a block of the vector index

    def small(self) -> None:
        self.quantile_max_candidates = 50
        self.quantile_accuracy = 200
        self.mode_values = 2
        self.mode_counters = 4
        self.dictionary_local = 2
        self.dictionary_broadcast = 2
        self.prefix_local = 10
        self.prefix_rows_per_partition = 100
        self.knn_local = 0
        self.knn_block = 64
        self.query_block = 3
        self.index_block = 64


LIMITS = Limits()
