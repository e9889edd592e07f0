"""Texts and numbers that have to be exactly these for equal results."""

from __future__ import annotations

# chunking
CHUNK_WORDS = 200
CHUNK_OVERLAP = 50

# routing and retrieval
LONG_DOCUMENT_WORDS = 2000
RUN_TOP_K = 2
RUN_SEPARATOR = "\n\n---\n\n"
CONTEXT_TOP_K = 3
CONTEXT_SEPARATOR = "\n\n"
EMBEDDING_DIM = 384

# confidence
REVIEW_BELOW = 70

# flat estimate
ESTIMATE_TOKENS_PER_DOCUMENT = 800
ESTIMATE_USD_PER_MILLION = 0.15

# error texts
EXTRACTION_FAILED = "Extraction failed"
READ_ERROR = "File read error"

# Search queries by document type; "unknown" serves every other type.
RUN_QUERIES: dict[str, list[str]] = {
    "invoice": [
        "vendor company name billing address",
        "invoice number date due date",
        "line items services description amount",
        "subtotal total GST tax amount",
        "GSTIN phone email contact",
    ],
    "resume": [
        "candidate name email phone contact",
        "work experience company role duration",
        "education degree university qualification",
        "technical skills programming languages",
        "projects achievements certifications",
    ],
    "email": [
        "sender receiver email address",
        "subject date email content body",
        "action items tasks deadlines",
        "key points summary updates",
    ],
    "unknown": ["main content key information"],
}

CONTEXT_QUERIES: dict[str, list[str]] = {
    "invoice": [
        "vendor name company billing address contact",
        "invoice number date due payment terms",
        "line items description quantity price amount total",
        "tax subtotal total amount due balance",
    ],
    "resume": [
        "candidate name email phone address contact information",
        "work experience job title company employment dates",
        "education degree university graduation year",
        "skills technologies programming languages certifications",
    ],
    "email": [
        "sender recipient email address from to subject",
        "email body main content message paragraphs",
        "key updates summary points action items next steps",
        "date sent received deadline schedule",
    ],
    "unknown": [
        "main content key information important details",
        "names dates amounts numbers identifiers",
    ],
}

CATALOGS = {"run": RUN_QUERIES, "context": CONTEXT_QUERIES}

# Prices in USD per million tokens, in listing order.
PROVIDERS: list[tuple[str, str, str, float, float, bool]] = [
    ("groq", "Groq (qwen3.6-27b)", "qwen/qwen3.6-27b", 0.0, 0.0, True),
    ("openai_gpt4o_mini", "OpenAI GPT-4o Mini", "gpt-4o-mini", 0.15, 0.60, False),
    ("openai_gpt4o", "OpenAI GPT-4o", "gpt-4o", 2.50, 10.00, False),
    ("anthropic_haiku", "Anthropic Claude 3.5 Haiku", "claude-3-5-haiku-20241022", 0.80, 4.00, False),
    ("anthropic_sonnet", "Anthropic Claude 3.5 Sonnet", "claude-3-5-sonnet-20241022", 3.00, 15.00, False),
    ("google_flash", "Google Gemini 1.5 Flash", "gemini-1.5-flash", 0.075, 0.30, False),
    ("google_pro", "Google Gemini 1.5 Pro", "gemini-1.5-pro", 1.25, 5.00, False),
    ("mistral_small", "Mistral Small", "mistral-small-latest", 0.20, 0.60, False),
    ("mistral_large", "Mistral Large", "mistral-large-latest", 2.00, 6.00, False),
    ("custom", "Custom Provider", "custom-model", 0.0, 0.0, False),
]
DEFAULT_PROVIDER = "groq"
FALLBACK_PROVIDER = "custom"

# Prompt texts.
SYSTEM_PROMPT = """You are a precise data extraction engine.
Your job is to extract structured information from unstructured text.

Rules:
1. Return ONLY valid JSON. No text before or after it.
2. No markdown, no backticks, no code fences.
3. Match the exact field names provided in the schema.
4. If a field value is not found in the text, use null.
5. Do NOT hallucinate or make up values.
6. Do NOT add fields that are not in the schema.
7. For list fields, return a JSON array even if empty."""

USER_PROMPT_HEAD = """Extract information from the document below and return it as JSON.

SCHEMA TO FOLLOW (field name: expected type):
"""
USER_PROMPT_DOCUMENT = "\n\nDOCUMENT:\n"
USER_PROMPT_TAIL = "\n\nReturn ONLY the JSON object. Nothing else."

# Columns of the batch CSV.
BATCH_CSV_COLUMNS = [
    "filename", "doc_type", "model", "provider", "status", "validation_passed", "checks_passed",
    "total_checks", "avg_confidence", "needs_human_review", "flagged_fields", "prompt_tokens",
    "completion_tokens", "total_tokens", "cost_usd", "timestamp",
]

# Headings, labels and closing words of the text report.
REPORT_TITLE = ["INTELLIGENT DOCUMENT PROCESSOR", "   Batch Processing Report"]
REPORT_SECTIONS = {
    1: "OVERALL STATISTICS", 2: "PER-DOCUMENT BREAKDOWN", 3: "FIELD-LEVEL CONFIDENCE SCORES",
    4: "FIELDS FLAGGED FOR HUMAN REVIEW", 5: "RECOMMENDATIONS", 6: "COST ANALYSIS",
}
REPORT_TABLE_HEAD = [("File", 25), ("Type", 10), ("Valid", 8), ("Conf", 8), ("Review", 0)]
REPORT_COST_NOTE = ["  NOTE: Groq is free tier. Figures above show", "  production cost reference using OpenAI pricing."]
REPORT_CLOSING = "Report complete."

# Recommendations, without the document's name in front of them.
ADVICE_INVOICE_NUMBER = ": No invoice number found. Ask sender to include invoice number for tracking."
ADVICE_DATE = ": No date found. Date is important for payment tracking and compliance."
ADVICE_BODY = ": Email body not extracted. Consider improving extraction prompt for emails."

# Scored fields in declared order, with the kind of test.
SCORED: dict[str, list[tuple[str, str]]] = {
    "invoice": [
        ("invoice_number", "str"), ("date", "str"), ("sender_company", "str"), ("receiver_company", "str"),
        ("line_items", "list"), ("subtotal", "float"), ("total_amount", "float"), ("gstin_sender", "gstin"),
        ("phone", "str"), ("email", "str"), ("due_date", "str"),
    ],
    "resume": [
        ("name", "str"), ("email", "str"), ("phone", "str"), ("technical_skills", "list"),
        ("work_experience", "list"), ("education", "list"), ("projects", "list"),
    ],
    "email": [
        ("sender_name", "str"), ("receiver_name", "str"), ("subject", "str"), ("date", "str"), ("body", "str"),
        ("key_points", "list"), ("action_items", "list"),
    ],
}
