"""Fixed values.

Word lists, phrases, thresholds and output formats that results depend on.
They are data, not logic: changing one changes what a query returns.
"""

# --- fixed values: retrieval -------------------------------------------------
RRF_K = 60
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
MIN_GRADE_CONFIDENCE = 0.45
RELEVANT_GRADES = ("Highly_Relevant", "Moderately_Relevant")
GRADING_SNIPPET_CHARS = 600
VERIFICATION_SNIPPET_CHARS = 6000
VERIFICATION_MAX_SOURCES = 8
CHART_PREVIEW_ROWS = 50
FALLBACK_DOCS = 2
EXHAUSTIVE_DOCS = 100

# --- fixed values: documents -------------------------------------------------
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 100
CHUNKING_VERSION = 3
EMBEDDING_MODEL = "all-MiniLM-L6-v2"
SHEET_PART_ROWS = 1500
SMALL_TABLE_MAX_ROWS = 200
SMALL_TABLE_MAX_TOKENS = 6000
HEADER_DATA_SHARE = 0.3
EXCEL_EXTENSIONS = ("xlsx", "xls")
CSV_EXTENSIONS = ("csv",)
PDF_EXTENSIONS = ("pdf",)
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp")

# --- fixed values: rate limit ------------------------------------------------
RATE_WINDOW_SECONDS = 60
RATE_SAFETY_MARGIN = 0.9
MAIN_MODEL_TOKENS_PER_MINUTE = 8000
FAST_MODEL_TOKENS_PER_MINUTE = 30000
HISTORY_TURNS = 6

# --- fixed values: field names looked up in chat entries, in order ----------
RETRIEVED_FIELDS = (
    "retrieved", "retrieved_items", "retrieved_financial_items", "extracted",
    "extracted_items", "extracted_fields", "extracted_figures",
    "generated_answer", "answer",
)
EXPLICIT_RELEVANT_FIELDS = (
    "relevant", "relevant_items", "relevant_financial_items", "expected",
    "expected_items", "expected_financial_items", "ground_truth",
    "ground_truth_items", "reference", "reference_answer", "reference_items",
)
SOURCE_FIELDS = ("source_texts", "source_chunks", "retrieved_context")
RELEVANT_FIELDS = EXPLICIT_RELEVANT_FIELDS + SOURCE_FIELDS

# --- fixed values: text ------------------------------------------------------
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"
CURRENCY_WORDS = (
    ("$", " usd "), ("€", " eur "), ("£", " gbp "),
    ("ريال", " sar "), ("ر.س", " sar "), ("٪", "%"),
)
NUMBER_UNITS = "%|percent|percentage|million|mn|m|billion|bn|b|thousand|k"
UNIT_SHIFTS = {
    "k": 3, "thousand": 3,
    "m": 6, "mn": 6, "million": 6,
    "b": 9, "bn": 9, "billion": 9,
}
PERCENT_UNITS = ("%", "percent", "percentage")
NON_LABEL_WORDS = ("sar", "usd", "eur", "gbp", "من", "في", "على", "هو", "هي", "مع")
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "of",
    "on", "or", "the", "to", "was", "were", "with", "very", "high", "low",
    "medium", "هو", "هي", "من", "في", "على", "عن", "إلى", "الى", "مع", "هذا",
    "هذه", "ذلك", "تلك", "هل", "كيف", "ما", "أي", "اي", "أو", "او", "و",
    "جدا", "جداً", "مرتفع", "مرتفعة", "ممتاز", "جيد", "البرنامج", "المشاركين",
)
NO_DATA_ITEM_PHRASES = (
    "does not include any financial information", "no financial information",
    "no relevant documents", "unable to generate a response",
    "not provided in the context", "لا يتضمن السياق", "غير متوفر",
    "لا توجد بيانات",
)
NO_DATA_ANSWER_PHRASES = (
    "لا توجد بيانات", "لا يوجد بيانات", "لم يتم العثور", "لا يمكن رسم",
    "غير متوفرة في السياق", "غير متوفر في السياق", "لا تحتوي المستندات",
    "no data", "no relevant data", "not available in the context",
    "not found in the", "cannot be found in the", "unable to find",
    "does not contain", "no information", "insufficient data",
)
ITEM_MAX_CHARS = 240
BLOB_MIN_CHARS = 80

# --- fixed values: question routing -----------------------------------------
TABLE_KEYWORDS = (
    "reconcile", "reconciliation", "ledger", "bank statement", "duplicate",
    "variance", "mismatch", "pipeline", "budget", "actual", "csv", "excel",
    "spreadsheet", "table", "row", "rows", "invoice", "deal", "مطابقة",
    "تسوية", "دفتر", "كشف", "بنك", "مكرر", "تكرار", "فرق", "فروقات",
    "ميزانية", "فعلي", "جدول", "صف", "فاتورة", "صفقة",
)
CHART_KEYWORDS = (
    "chart", "visualiz", "plot", "graph", "draw", "pie", "bar", "line",
    "trend", "رسم بياني", "مخطط", "تمثيل بياني", "تصوير بياني",
    "تصور بياني", "رسم دائري", "رسم خطي", "رسم بالأعمدة", "رسم اعمدة",
    "رسم مبعثر", "ارسم", "إرسم", "اعرض بيانياً", "بيانياً", "بياني", "تصور",
)
AGGREGATION_KEYWORDS = (
    "total", "sum", "variance", "difference", "net", "profit", "loss",
    "aggregate", "collected", "revenue leak", "إجمالي", "اجمالي", "مجموع",
    "فرق", "فروقات", "تباين", "صافي", "ربح", "خسارة", "محصل", "المحصلة",
)
VARIANCE_KEYWORDS = ("variance", "تباين", "فروقات")
NET_KEYWORDS = ("net", "profit", "loss", "صافي", "ربح", "خسارة")
DIFFERENCE_KEYWORDS = ("difference", "فرق")
REVENUE_QUERY_KEYWORDS = (
    "invoice", "billing", "revenue", "collection", "فاتورة", "فواتير",
    "ايراد", "إيراد", "تحصيل", "صفقات",
)
INVOICE_TOTAL_KEYWORDS = ("invoice", "revenue", "صفقات", "ايراد", "إيراد")
BANK_SOURCE_WORDS = ("bank", "statement")
IMPROVEMENT_PHRASES = (
    "نسبة التحسن", "نسب التحسن", "معدل التحسن", "improvement rate",
    "improvement percentage",
)

# --- fixed values: charts ----------------------------------------------------
AREA_WORDS = ("area chart", "area graph", "مساحي", "مساحة")
PIE_WORDS = ("pie", "دائري", "دائرة")
LINE_WORDS = ("line", "خطي")
BAR_WORDS = ("bar", "أعمدة", "اعمدة", "عمودي")
TREND_WORDS = (
    "trend", "over time", "quarterly", "yearly", "monthly", "اتجاه",
    "عبر الزمن", "ربع سنوي", "ربعي", "سنوي", "شهري", "تطور",
)
COMPARE_WORDS = (
    "compare", "comparison", "breakdown", "share", "distribution", "مقارنة",
    "توزيع", "تفصيل", "حصة",
)
PIE_INTENT_WORDS = (
    "share", "proportion", "breakdown", "distribution", "percentage",
    "percent", "of total", "split", "composition", "mix", "حصة", "نسبة",
    "نسب", "توزيع", "تفصيل", "تقسيم", "مكونات",
)
PIE_MAX_SLICES = 6
TIME_LABEL_WORDS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept",
    "oct", "nov", "dec", "quarter", "qtr", "month", "year", "fy", "يناير",
    "فبراير", "مارس", "ابريل", "أبريل", "مايو", "يونيو", "يوليو", "اغسطس",
    "أغسطس", "سبتمبر", "اكتوبر", "أكتوبر", "نوفمبر", "ديسمبر", "الربع",
    "ربع", "شهر", "سنة", "سنوي",
)

# --- fixed values: answer checks --------------------------------------------
NOT_FOUND_LABEL = "NOT_FOUND_IN_SOURCES"
SOURCE_NAME_NOISE = ("the", "file", "csv", "xlsx", "xls", "pdf")
SOURCE_ALIASES = (
    ("bank statement", ("bank", "statement")),
    ("ledger", ("ledger",)),
    ("budget", ("budget",)),
)
BAD_CHECK_MAX_RATING = 4
SKIPPED_RATING = 8
HIGH_RATING = 8
MEDIUM_RATING = 5
MODEL_NAMES_PATTERN = r"minimax|kimi|gpt[ _-]?oss(?:[ _-]?\d+b)?|claude|gemini|llama"
REDACTED_MODEL = "[redacted-model]"
JUDGE_INT_FIELDS = ("groundedness", "numerical_accuracy", "relevance", "clarity")
JUDGE_MEAN_FIELDS = JUDGE_INT_FIELDS + ("overall",)
JUDGE_FIELDS = JUDGE_MEAN_FIELDS + ("unsupported_claims", "rationale")
JUDGE_MAX_RATIONALE = 1000

# --- fixed values: output texts ---------------------------------------------
CALCULATIONS_TITLE = (
    "VERIFIED_CALCULATIONS (computed by code; use these exact numbers, do not "
    "recompute or alter them):"
)
ANOMALIES_TITLE = (
    "VERIFIED_ANOMALIES (mandatory to mention when relevant; do not auto-merge "
    "or drop these rows):"
)
NOT_FOUND_STATEMENT = ("The figure ", " was not found in the provided data.")
