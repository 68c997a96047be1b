"""Parameters, weights, queries and patterns that results depend on."""

# Parameter names in report order, and weights that sum to 100.
WEIGHTS = {
    "Age": 20,
    "Step Therapy Requirements Documented in Policy": 5,
    "Number of Steps through Brands": 10,
    "Number of Steps through Generic": 10,
    "Step through-Phototherapy": 5,
    "TB Test required": 15,
    "Initial Authorization Duration(in-months)": 15,
    "Reauthorization Duration(in-months)": 5,
    "Reauthorization Required": 5,
    "Reauthorization Requirements Documented in Policy": 3,
    "Specialist Types": 4,
    "Quantity Limits": 3,
}
PARAMS = list(WEIGHTS)
#: The kind of scorer for each parameter, in the same order.
KINDS = dict(zip(PARAMS, "age text steps steps yesno yesno duration duration yesno text text text".split(), strict=True))
CSV_COLUMNS = ["filename", "brand", *PARAMS, "access_score"]

# Retrieval and chunking.
CHUNK_SIZE, CHUNK_OVERLAP = 700, 100
SEPARATORS = ["\n## ", "\n### ", "\n#### ", "\n\n", "\n", ". ", " ", ""]
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K, CANDIDATES, CONTEXT_CHUNKS, CONTEXT_CHARS = 60, 30, 4, 4000
CONTEXT_JOIN = "\n\n---\n\n"
BRAND_QUERIES = [
    "applicable drug list biologics PsO formulary covered medications",
    "preferred non-preferred biologic brand names plaque psoriasis",
    "step therapy biologic agents psoriasis prior authorization criteria",
]
COMMON_QUERIES = [
    "step therapy prior authorization criteria plaque psoriasis PsO",
    "initial authorization duration months reauthorization renewal continuation",
    "TB test tuberculosis quantity limit specialist prescriber dermatologist",
]
ANCHOR_QUERY = "{brand} plaque psoriasis prior authorization step therapy criteria"
BRAND_QUERY = "{brand} prior authorization criteria plaque psoriasis step therapy reauthorization approval"

# Cleaning.
MARGIN = 0.07
HEADER_MARKERS = ["Group", "Indication Indicator", "Required Medical Information"]
CREDENTIALS = [
    r"(?i)(username|user[\s_-]*name|login|user[\s_-]*id)\s*[:=]\s*\S+",
    r"(?i)(password|passwd|pwd)\s*[:=]\s*\S+",
    r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
]
REFERENCES = [r"(?i)^\s*references\s*$", r"(?i)the above policy is based on the following references"]

# Request and token limits a minute, by model size.
LIMITS = {"8b": (30, 131_072), "70b": (30, 12_000)}
